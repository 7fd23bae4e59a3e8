"""The pipeline's rows against its stages, one by one, and on odd and empty tables."""

from __future__ import annotations

from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F
from test_llm_operators import brute_best_fit, brute_groups, brute_spans, brute_vector, fingerprints_of, words_of

from bulletria.llm import language_id, near_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(spark):
    base = "the committee wrote that every member of the house should read the letter before the end of the week because the question number {} of {} is open".format
    texts = [" ".join(base(i * 7 + j, i * 31 + j) + f" token{i}x{j} " + " ".join(f"u{i * 100 + j + k}" for k in range(6)) for j in range(6)) for i in range(40)]
    rows = [(i, t, "en", "ab"[i % 2], len(t)) for i, t in enumerate(texts)]
    rows += [(100 + i, texts[i], "en", "a", len(texts[i])) for i in range(5)]
    rows += [(200, None, None, None, None), (201, "", "en", "a", 0), (202, "1234 5678", "en", None, 9)]
    return spark.createDataFrame(rows, SCHEMA)


def written(docs, path):
    docs.write.parquet(f"{path}/documents.parquet")
    return path


def pieces_of(rows, capacity=2048):
    """(doc_id, start_word, words) of each piece, read from the sequences' texts alone."""
    out = Counter()
    for r in rows:
        words, at = words_of(r.text), 0
        assert len(words) == r.n_words <= capacity
        for p in r.pieces:
            out[p.doc_id, p.start_word, " ".join(words[at : at + p.n_words])] += 1
            at += p.n_words
        assert at == len(words)
    return out


def brute_pipeline(spark, docs, capacity=2048):
    """Pieces, and number of sequences, by loops over all rows and pairs."""
    rows = docs.collect()
    vectors = language_id.letters()[2]
    each = [brute_vector(r.text or "", vectors).astype(float) for r in rows]
    proto = {}
    for r, v in zip(rows, each):
        if r.lang and v.any():
            proto[r.lang] = proto.get(r.lang, 0) + np.rint(v / np.linalg.norm(v) * 4096)
    kept = []
    for r, v in zip(rows, each):
        if v.any():
            best = max(float(v @ p / np.linalg.norm(v) / np.linalg.norm(p)) for p in proto.values())
            if sum(c.isalpha() for c in r.text) < language_id.MIN_LETTERS or best >= language_id.MIN_COSINE:
                kept.append(r)
    prints = fingerprints_of(spark.createDataFrame(kept, docs.schema))
    gone = {i for i, group, *_ in brute_groups(prints, near_dedup.RADIUS) if i != group}
    kept = [r for r in kept if r.doc_id is None or r.doc_id not in gone]
    cuts = defaultdict(set)
    named = [(r.doc_id, r.text) for r in kept if r.doc_id is not None]
    for i, later, a, b in brute_spans([t for _, t in named], 50):
        if later:
            cuts[named[i][0]] |= set(range(a, b))
    texts = []
    for r in kept:
        words = words_of(r.text)
        left = [w for k, w in enumerate(words) if r.doc_id is None or k not in cuts[r.doc_id]]
        if left:
            whole = r.text if len(left) == len(words) else None
            texts.append((r.doc_id, r.source, left, whole))
    return texts


def test_pipeline_is_its_brute_force_version(spark, tmp_path):
    """Stages 1 to 3 by brute force give the words; mixing's targets and best fit's number of sequences follow from them."""
    docs = corpus(spark)
    passage = " ".join(f"shared{i}" for i in range(60))
    base = "the members of the committee read the letter that was sent before the end of the week number {}".format
    more = [(300 + i, f"{base(i)} {passage} " + " ".join(f"tail{i}x{k}" for k in range(40)), "en", "ab"[i % 2], 0) for i in range(4)]
    docs = docs.unionByName(spark.createDataFrame([*more, (None, base(77) + " no id here at all", "en", "b", 3)], SCHEMA))
    path = written(docs, str(tmp_path / "sf"))
    want = {(i, " ".join(words)) for i, _, words, _ in brute_pipeline(spark, docs)}
    got = pieces_of(corpus_pipeline.run(spark, path).collect())
    assert {(i, words) for i, _, words in got} == want and all(start == 0 for _, start, _ in got)
    assert any("shared0" in w for _, w in want) and sum("shared0" in w for _, w in want) == 1

    now = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        now = stage(spark, now, path)
    texts = [(r.doc_id, r.source, r.text) for r in now.collect()]
    total, sizes = sum(len(t) for *_, t in texts), Counter()
    for _, source, t in texts:
        sizes[source] += len(t)
    for i, source, t in texts:  # each expects its source's share
        each = total / len(sizes) / sizes[source]
        copies = got[i, 0, " ".join(words_of(t))]
        assert int(each) <= copies <= int(each) + 1
    lengths = sorted((len(w.split()) for (_, _, w), c in got.items() for _ in range(c)), reverse=True)
    assert corpus_pipeline.run(spark, path).count() == brute_best_fit(lengths, 2048)[0]


def test_stages(spark, tmp_path):
    docs = corpus(spark).withColumn("copy_no", F.lit("mine")).withColumn("_row", F.lit(1)).withColumn("gone", F.lit(2.5))
    path = written(docs, str(tmp_path / "sf"))
    now, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, path)
        assert {*docs.columns} - {"copy_no"} <= {*now.columns} <= {*docs.columns}
        seen[name] = {r.doc_id for r in now.collect()}
    assert seen["language_id"] == {*range(40), *range(100, 105)}
    assert seen["near_dedup"] == set(range(40))
    assert seen["suffix_dedup"] <= set(range(40))
    want = Counter()
    for r in now.collect():
        want[r.doc_id] += len(words_of(r.text))
    packed = Counter()
    for (doc_id, _, words), n in pieces_of(corpus_pipeline.run(spark, path).collect()).items():
        packed[doc_id] += n * len(words.split())
    assert packed == want


def test_empty(spark, tmp_path):
    path = str(tmp_path / "sf")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{path}/documents.parquet")
    assert corpus_pipeline.run(spark, path).count() == 0
