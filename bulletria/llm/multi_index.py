"""Nearest neighbours by an inverted multi-index.

Each half of a vector is quantised by a codebook of its own; the pairs of
centroids are the cells of the index (Babenko and Lempitsky, 2012). By the
triangle inequality a half is at least as far from the entries of its centroid
as from the centroid, less the radius around it; the squares for both halves add
up to a lower bound for a cell. A heap over the sorted bounds of both halves
gives pairs in the order of the summed bounds. A query goes on through them
until the k-th best distance so far is under the bound of the next, so it loses
no neighbour whatever the size and shape of the table; where vectors are spread
evenly in many dimensions bounds exclude little, and work nears that of all
pairs. A query's first k-th distance comes from upper bounds of the nearest cells
(distance to the centroid plus radius) and from ``least`` vectors drawn by a
hash; it changes the work and not the result.

Codebooks are fitted by Lloyd's rounds over all vectors, from distinct halves in
the order of a hash; each round is an aggregation by centroid. Their size grows
with the fourth root of the number of vectors, from ``LEAST_CENTROIDS`` to
``MOST_CENTROIDS``. Only sums, cell counts and radii, of which there are at most
centroids squared, go to the driver. Queries are a table of their own (without
one, the vectors themselves), grouped by neighbouring cells; an entry is sent
once to each group that takes its cell, in slices of bounded size.

Defined results: those of ``topk`` for invalid, repeated and few rows, empty
tables and other columns. Vectors are compared with those of their own length
only: each length has an index of its own, or is one cell if it has no more
vectors than centroids. An odd dimension goes to the second half. Equal distances
go to the smaller vec_id.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .topk import K, best_k, matrix, vectors

LEAST_CENTROIDS, MOST_CENTROIDS = 32, 1024
ROUNDS = 12
LEAST = 1_000
GROUP_ROWS = 512  # queries that search together
SLICE_ROWS = 16_384  # entries that a task holds against them
BLOCK_ROWS = 1024  # entries that a group's queries are held against at once
_SLACK = 1e-9  # more than double precision can be off, relative to the squared lengths


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centroids."""
    return np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * x @ c.T, 0)


def visits(first: np.ndarray, second: np.ndarray, counts: np.ndarray, want: float = np.inf, bound: float = np.inf) -> list[int]:
    """Cells in the order of the sum of both halves' values, until they hold want entries or the sum is over bound.

    The multi-sequence algorithm: a pair enters the heap when both pairs before
    it in the two sorted lists are taken.
    """
    by_a, by_b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    a, b = first[by_a].tolist(), second[by_b].tolist()
    by_a, by_b = by_a.tolist(), by_b.tolist()
    wide, done, out, have = len(b), [0] * len(a), [], 0
    heap = [(a[0] + b[0], 0, 0)]
    while heap and have < want and heap[0][0] <= bound:
        _, i, j = heappop(heap)
        done[i] = j + 1
        cell = by_a[i] * wide + by_b[j]
        if counts[cell]:
            out.append(cell)
            have += counts[cell]
        if i + 1 < len(a) and done[i + 1] == j:
            heappush(heap, (a[i + 1] + b[j], i + 1, j))
        if j + 1 < wide and (i == 0 or done[i - 1] > j + 1):
            heappush(heap, (a[i] + b[j + 1], i, j + 1))
    return out


def _halves(v: np.ndarray, books: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances of both halves to their centroids."""
    half = books[0].shape[1]
    return distances(v[:, :half], books[0]), distances(v[:, half:], books[1])


def _high(v: np.ndarray, books: tuple[np.ndarray, np.ndarray], radii: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
    """What each half adds at most to the distance to an entry of each of its centroids."""
    return [(np.sqrt(d) + r) ** 2 for d, r in zip(_halves(v, books), radii)]


def _low(v: np.ndarray, books: tuple[np.ndarray, np.ndarray], radii: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
    """What each half adds at least to the distance to an entry of each of its centroids."""
    return [np.maximum(np.sqrt(d) - r, 0) ** 2 for d, r in zip(_halves(v, books), radii)]


def _slack(q: np.ndarray, x: np.ndarray) -> float:
    return _SLACK * float((q * q).sum(1).max(initial=0) + (x * x).sum(1).max(initial=0))


def _sums(books: tuple[np.ndarray, np.ndarray]):
    """Sums and numbers of the halves nearest to each centroid, one row a partition."""
    half = books[0].shape[1]
    dim = half + books[1].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = [np.zeros_like(c) for c in books], [np.zeros(len(c)) for c in books]
        for batch in batches:
            v = matrix(batch.column(0), dim)
            for h, (part, d) in enumerate(zip((v[:, :half], v[:, half:]), _halves(v, books))):
                own = (d.argmin(1)[:, None] == np.arange(len(books[h]))).astype(float)
                sums[h] += own.T @ part
                counts[h] += own.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (*sums, *counts)], names=["sa", "sb", "na", "nb"])

    return run


def codebooks(own: DataFrame, dim: int, centroids: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of both halves by Lloyd's rounds over all vectors; fewer if there are fewer distinct halves."""
    half, books = dim // 2, []
    for start, size in ((1, half), (half + 1, dim - half)):
        part = own.select(F.slice("embedding", start, size).alias("part")).distinct()
        first = part.orderBy(F.xxhash64(F.lit("ann"), "part"), "part").limit(centroids).collect()
        books.append(np.array([r["part"] for r in first], float).reshape(len(first), size))
    for _ in range(rounds):
        rows = own.select("embedding").mapInArrow(_sums(tuple(books)), "sa binary, sb binary, na binary, nb binary").collect()
        new = []
        for c, s, n in zip(books, ("sa", "sb"), ("na", "nb")):
            sums = sum(np.frombuffer(r[s]).reshape(c.shape) for r in rows)
            count = sum(np.frombuffer(r[n]) for r in rows)
            new.append(np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], c))
        if all(np.array_equal(c, x) for c, x in zip(books, new)):
            break
        books = new
    return books[0], books[1]


def _cells(books: tuple[np.ndarray, np.ndarray]):
    half = books[0].shape[1]
    dim = half + books[1].shape[1]

    def run(x: pa.Array) -> pa.Array:
        v = matrix(x, dim) if len(x) else np.zeros((0, dim))
        a, b = (d.argmin(1) for d in _halves(v, books))
        cell = (a * len(books[1]) + b).astype(np.int32)
        ra, rb = (np.sqrt(((y - c) ** 2).sum(1)) for y, c in ((v[:, :half], books[0][a]), (v[:, half:], books[1][b])))
        return pa.StructArray.from_arrays([pa.array(cell), pa.array(ra), pa.array(rb)], names=["cell", "ra", "rb"])

    return run


def centroids_for(n: int) -> int:
    """Centroids a half for n vectors: the more vectors, the more cells."""
    return max(LEAST_CENTROIDS, min(MOST_CENTROIDS, int(2 * n**0.25)))


def _plan(books, radii, counts: list[int], k: int, drawn: np.ndarray):
    """For one group of queries: the packed queries, a first bound of their k-th distances, and the cells to search in order."""
    dim = books[0].shape[1] + books[1].shape[1]

    def run(group: pa.Table) -> pa.Table:
        ids, v = group.column("vec_id").to_numpy(), matrix(group.column("embedding"), dim)
        order = np.lexsort((ids, group.column("cell").to_numpy()))
        ids, v = ids[order], v[order]
        slack, bounds = _slack(v, drawn), np.full(len(ids), np.inf)
        if len(drawn) > k:  # the query itself may be among them
            bounds = np.partition(distances(v, drawn), k, axis=1)[:, k] + slack
        for i, (first, second) in enumerate(zip(*_high(v, books, radii))):
            cells = visits(first, second, counts, k + 1)
            if sum(counts[c] for c in cells) > k:
                bounds[i] = min(bounds[i], max(first[c // len(second)] + second[c % len(second)] for c in cells) + slack)
        a, b = _low(v, books, radii)
        taken = np.zeros(len(counts), bool)
        for at in range(0, len(ids), BLOCK_ROWS):
            rows = slice(at, at + BLOCK_ROWS)
            taken |= (a[rows, :, None] + b[rows, None, :] <= bounds[rows, None, None] + slack).any(0).ravel()
        cells = [c for c in visits(a.min(0), b.min(0), counts, bound=bounds.max() + slack) if taken[c]]
        return pa.table(
            {
                "grp": pa.array([group.column("grp")[0].as_py()], pa.int32()),
                "ids": pa.array([ids.tobytes()], pa.binary()),
                "vs": pa.array([v.tobytes()], pa.binary()),
                "bounds": pa.array([bounds.tobytes()], pa.binary()),
                "cells": pa.array([cells], pa.list_(pa.int32())),
            }
        )

    return run


class Best:
    """The k nearest so far of each query, and the distance that an entry must not exceed."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, bounds: np.ndarray, k: int):
        self.ids, self.q, self.k, self.bounds = ids, q, k, bounds.copy()
        self.row, self.x, self.d = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def add(self, rows: np.ndarray, ids: np.ndarray, x: np.ndarray, slack: float) -> None:
        """Hold some of the queries against some entries."""
        d = distances(self.q[rows], x)
        limit = self.bounds[rows]
        free = ~np.isfinite(limit)
        if free.any() and len(ids) > self.k:  # the query itself may be among them
            limit[free] = np.partition(d[free], self.k, axis=1)[:, self.k] + slack
        r, c = np.nonzero(d <= limit[:, None] + slack)
        other = self.ids[rows[r]] != ids[c]
        r, c = rows[r[other]], c[other]
        if not len(r):
            return
        exact = [np.zeros(0)]
        for at in range(0, len(r), SLICE_ROWS):
            diff = x[c[at : at + SLICE_ROWS]] - self.q[r[at : at + SLICE_ROWS]]
            exact.append((diff * diff).sum(1))
        row, found, d = np.r_[self.row, r], np.r_[self.x, ids[c]], np.r_[self.d, *exact]
        order = np.lexsort((found, d, row))
        row, found, d = row[order], found[order], d[order]
        start = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        place = np.arange(len(row)) - np.repeat(start, np.diff(np.r_[start, len(row)]))
        last = place == self.k - 1
        self.bounds[row[last]] = np.minimum(self.bounds[row[last]], d[last])
        keep = place < self.k
        self.row, self.x, self.d = row[keep], found[keep], d[keep]


def _rerank(books, radii, k: int):
    dim, wide = books[0].shape[1] + books[1].shape[1], len(books[1])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out_q, out_x, out_d = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        if left.num_rows and right.num_rows:
            row = left.slice(0, 1).to_pylist()[0]
            q_ids, q = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["vs"], "<f8").reshape(-1, dim)
            best = Best(q_ids, q, np.frombuffer(row["bounds"], "<f8"), k)
            low_a, low_b = _low(q, books, radii)
            place = np.zeros(len(books[0]) * wide, np.int64)
            place[row["cells"]] = np.arange(len(row["cells"]))
            cell, ids = right.column("cell").to_numpy(), right.column("vec_id").to_numpy()
            order = np.lexsort((ids, place[cell]))
            cell, ids, x = cell[order], ids[order], matrix(right.column("embedding"), dim)[order]
            slack = _slack(q, x)
            for at in range(0, len(ids), BLOCK_ROWS):
                part = slice(at, at + BLOCK_ROWS)
                least = np.full(len(q), np.inf)
                for c in np.unique(cell[part]).tolist():
                    np.minimum(least, low_a[:, c // wide] + low_b[:, c % wide], out=least)
                rows = np.flatnonzero(least <= best.bounds + slack)
                if len(rows):
                    best.add(rows, ids[part], x[part], slack)
            out_q, out_x, out_d = q_ids[best.row], best.x, best.d
        return pa.table({"query_id": out_q, "vec_id": out_x, "distance": out_d})

    return run


_FOUND = "query_id long, vec_id long, distance double"


def _one_cell(k: int):
    """All queries and vectors of one length against each other."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out_q, out_x, out_d = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        if left.num_rows and right.num_rows:
            dim = left.column("dim")[0].as_py()
            q_ids, q = left.column("vec_id").to_numpy(), matrix(left.column("embedding"), dim)
            ids, v = right.column("vec_id").to_numpy(), matrix(right.column("embedding"), dim)
            best = Best(q_ids, q, np.full(len(q), np.inf), k)
            for at in range(0, len(q), BLOCK_ROWS):
                best.add(np.arange(at, min(at + BLOCK_ROWS, len(q))), ids, v, _slack(q, v))
            out_q, out_x, out_d = q_ids[best.row], best.x, best.d
        return pa.table({"query_id": out_q, "vec_id": out_x, "distance": out_d})

    return run


def approximate_top_k(embeddings: DataFrame, k: int = K, centroids: int | None = None, least: int = LEAST, queries: DataFrame | None = None) -> DataFrame:
    """(query_id, rank, vec_id, distance): the k nearest others of each query, by squared Euclidean distance.

    queries: (vec_id, embedding), every vector without it. centroids: of each
    half; by the number of vectors without it.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    own = materialize(vectors(embeddings).withColumn("dim", F.size("embedding")))
    asked = own if queries is None else materialize(vectors(queries).withColumn("dim", F.size("embedding")))
    lengths = {r["dim"]: r["count"] for r in own.groupBy("dim").count().collect()}
    large = {dim: c for dim, n in sorted(lengths.items()) if n > (c := centroids or centroids_for(n))}
    few, small = (df.where(~F.col("dim").isin(list(large))) for df in (asked, own))
    cut = F.pmod(F.xxhash64("vec_id"), F.lit(1 + few.count() // GROUP_ROWS)).alias("part")
    few = few.withColumn("part", cut)
    sent = few.select(F.col("dim").alias("to"), F.col("part").alias("at")).distinct().join(small, F.col("to") == F.col("dim"))
    near = few.groupBy("dim", "part").cogroup(sent.groupBy("to", "at")).applyInArrow(_one_cell(k), _FOUND)
    for dim, c in large.items():
        own_dim, asked_dim = (df.where(F.col("dim") == dim).drop("dim") for df in (own, asked))
        near = near.union(_near(own_dim, asked_dim, dim, lengths[dim], k, c, least))
    return best_k(near, k)


def _groups(counts: list[int]) -> list[tuple[int, int, int]]:
    """(cell, group, parts) of each cell with queries: neighbours together, a large one cut by vec_id."""
    out, at, size = [], 0, 0
    for cell, count in enumerate(counts):
        if not count:
            continue
        if size and size + count > GROUP_ROWS:
            at, size = at + 1, 0
        parts = -(-count // GROUP_ROWS)
        out.append((cell, at, parts))
        at, size = (at + parts, 0) if parts > 1 else (at, size + count)
    return out


def _near(own: DataFrame, asked: DataFrame, dim: int, n: int, k: int, centroids: int, least: int) -> DataFrame:
    """_FOUND of at least the k nearest of each query; all have one length."""
    spark = own.sparkSession
    books = codebooks(own, dim, centroids)
    placed = F.arrow_udf(_cells(books), "cell int, ra double, rb double")("embedding")
    entries = materialize(own.withColumn("at", placed).select("vec_id", "embedding", "at.cell", "at.ra", "at.rb"))
    counts = [0] * (len(books[0]) * len(books[1]))
    radii = np.zeros(len(books[0])), np.zeros(len(books[1]))
    for r in entries.groupBy("cell").agg(F.count("*").alias("n"), F.max("ra").alias("ra"), F.max("rb").alias("rb")).collect():
        counts[r["cell"]] = r["n"]
        i, j = divmod(r["cell"], len(books[1]))
        radii[0][i], radii[1][j] = max(radii[0][i], r["ra"]), max(radii[1][j], r["rb"])

    at_cells = materialize(asked.withColumn("at", placed).select("vec_id", "embedding", "at.cell"))
    wanted = [0] * len(counts)
    for r in at_cells.groupBy("cell").count().collect():
        wanted[r["cell"]] = r["count"]
    groups = spark.createDataFrame(_groups(wanted), "cell int, first int, parts int")
    grp = F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")
    some = own.orderBy(F.xxhash64(F.lit("drawn"), "vec_id"), "vec_id").limit(least).select("embedding").collect()
    drawn = np.array([r["embedding"] for r in some], float).reshape(-1, dim)
    plan = materialize(
        at_cells.join(groups, "cell").withColumn("grp", grp).groupBy("grp").applyInArrow(_plan(books, radii, counts, k, drawn), "grp int, ids binary, vs binary, bounds binary, cells array<int>")
    )
    slices = max(1, -(-n // SLICE_ROWS))
    cut = F.pmod(F.xxhash64("vec_id"), F.lit(slices)).cast("int").alias("cut")
    taken = plan.select(F.col("grp").alias("to"), F.explode("cells").alias("cell"))
    sent = taken.join(entries.select("cell", "vec_id", "embedding", cut), "cell")
    wide = plan.withColumn("cut", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    return wide.groupBy("grp", "cut").cogroup(sent.groupBy("to", "cut")).applyInArrow(_rerank(books, radii, k), _FOUND)
