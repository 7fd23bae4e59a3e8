import numpy as np

from bulletria.llm import multi_index, topk


def recall(spark, x, queries, **options):
    """Share of the 10 nearest of some queries that the index finds."""
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    asked = df.where(df.vec_id.isin([int(q) for q in queries]))
    got = {(r.query_id, r.vec_id) for r in multi_index.approximate_top_k(df, 10, queries=asked, **options).collect()}
    d = multi_index.distances(x[queries], x)
    d[np.arange(len(queries)), queries] = np.inf
    want = {(int(q), int(v)) for q, row in zip(queries, d) for v in np.argpartition(row, 10)[:10]}
    return len(got & want) / len(want)


def test_recall_without_clusters(spark):
    x = np.random.default_rng(6).normal(size=(20_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert recall(spark, x, np.arange(0, 20_000, 40)) >= 0.9


def test_bound_leaves_cells_out():
    books = np.array([[0.0], [10.0]]), np.array([[0.0], [10.0]])
    low = multi_index._low(np.array([[0.5, 0.5]]), books, (np.ones(2), np.ones(2)))
    assert multi_index.visits(low[0][0], low[1][0], [1] * 4, bound=1.0) == [0]


def test_codebooks_are_means_of_all_vectors(spark):
    x = np.random.default_rng(7).normal(size=(25_000, 5))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    before, after = (multi_index.codebooks(df, 5, 8, rounds=n) for n in (0, 1))
    for half, c, got in zip((x[:, :2], x[:, 2:]), before, after):
        near = multi_index.distances(half, c).argmin(1)
        assert np.allclose(got, [half[near == i].mean(0) for i in range(8)])
    few = multi_index.codebooks(df.where("vec_id < 5"), 5, 8)
    assert [c.shape for c in few] == [(5, 2), (5, 3)]


def test_every_length_is_searched(spark):
    rng = np.random.default_rng(8)
    lengths = [1] * 40 + [3] * 50 + [6] * 90 + [7] * 2 + [8]
    df = spark.createDataFrame([(i, rng.normal(size=n).tolist()) for i, n in enumerate(lengths)], "vec_id long, embedding array<double>")
    got = {tuple(r) for r in multi_index.approximate_top_k(df, 5).collect()}
    assert got == {tuple(r) for r in topk.exact_top_k(df, 5).collect()}
    assert {q for q, *_ in got} == set(range(len(lengths) - 1))  # the last is alone
