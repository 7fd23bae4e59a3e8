"""Language identification with hyperdimensional profiles.

Letters have random vectors of +1 and -1: each lower-case letter below U+0800
(Latin with its extensions, Greek, Cyrillic, Armenian, Hebrew, Arabic and more)
one of its own, those above one of ``SHARED`` by their code, so that the many
signs of Chinese, Japanese, Korean or Indian scripts are told apart but for chance
collisions. A trigram's vector binds (multiplies) those of its letters, permuted by a cyclic shift that tells their place; a
document's bundles (adds) the vectors of its trigrams, and a language's
prototype those of its training documents, scaled to one length. The language
is that of the prototype with the largest cosine.

Prototypes are fitted on documents that carry a language: at most about
``sample`` for each, drawn by a hash of doc_id, and every document below that
number. Everything is counted in whole numbers, so results repeat exactly.

Defined results: a text that is null or has no letter has a null language and
is rejected; texts of any length are read whole. One with ``MIN_LETTERS`` letters or more is rejected if its cosine
is under ``MIN_COSINE``; a shorter one never is, as its cosine says little.
Equal cosines go to the language first by name. With no labelled document all
languages are null and all documents are rejected. Rows are judged one by one, so
repeated ones repeat, with null doc_ids too; labelled rows need a doc_id to be in
the sample of a language that has more of them than the sample holds. No rows
give no rows. Columns other than doc_id, text and lang aren't looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textscan as S

DIMS = 1024
SAMPLE = 2_000
MIN_COSINE = 0.15
MIN_LETTERS = 40
SYMBOLS = 2048
SHARED = 911
_BITS = SYMBOLS.bit_length() - 1
_BLOCK = 1024
#: Bytes and documents whose bundles are made at once, so that memory depends neither on Arrow's batches nor on how short texts are.
SPAN_BYTES, SPAN_DOCS = 1 << 18, 512
RESULT = "struct<language: string, cosine: double, margin: double, accepted: boolean>"


def _symbol_table() -> np.ndarray:
    """Symbol of each code point up to U+FFFF: 0 is no letter, the last SHARED are shared."""
    table = np.zeros(0x10000, np.uint16)
    own: dict[str, int] = {}
    for c in range(0x10000):
        if chr(c).isalpha():
            low = chr(c).lower()
            table[c] = own.setdefault(low, len(own) + 1) if ord(low[0]) < 0x800 else SYMBOLS - SHARED + ord(low[0]) % SHARED
    assert len(own) < SYMBOLS - SHARED
    return table


_TABLE = _symbol_table()


def letters(dims: int = DIMS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The letters' vectors as they are permuted at each place of a trigram."""
    v = np.random.Generator(np.random.PCG64(7)).integers(0, 2, (SYMBOLS, dims)).astype(np.int8) * 2 - 1
    return np.roll(v, 2, axis=1), np.roll(v, 1, axis=1), v


def trigrams(span: S.Span) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, trigram, count), and the letters of each document.

    A trigram's middle is a letter, or the single space between words.
    """
    points = np.frombuffer(span.data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    heads = np.cumsum((span.data & 0xC0) != 0x80)
    ends = np.r_[0, heads][span.offsets]
    dtype = np.uint64
    symbol = _TABLE[np.minimum(points, 0xFFFF)].astype(dtype)
    far = points > 0xFFFF  # of these planes only those of further Chinese signs count as letters
    symbol[far] = np.where(points[far] >= 0x20000, SYMBOLS - SHARED + points[far] % SHARED, 0)
    full = np.insert(symbol, ends, 0)  # a space before each document and after the last
    edge = ends + np.arange(len(ends))
    space = full == 0
    drop = np.zeros(len(full), bool)
    drop[1:] = space[1:] & space[:-1]
    drop[edge] = False
    drop[edge[1:] - 1] |= space[edge[1:] - 1]
    drop[edge] = False
    keep = np.flatnonzero(~drop)
    seq = full[keep]
    border = np.zeros(len(full), bool)
    border[edge] = True
    middle = ~border[keep][1:-1]
    doc = (np.cumsum(border[keep]) - 1)[1:-1].astype(dtype)
    code = (((seq[:-2] << dtype(_BITS)) | seq[1:-1]) << dtype(_BITS)) | seq[2:]
    known = np.bincount(doc[middle & (seq[1:-1] > 0)], minlength=span.docs)
    key = np.sort(((doc << dtype(3 * _BITS)) | code)[middle])
    heads = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
    count = np.diff(np.r_[heads, len(key)])
    key = key[heads].astype(np.int64)
    return key >> 3 * _BITS, key & (SYMBOLS**3 - 1), count, known[: span.docs]


def bundles(span: S.Span, table: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The vector of each document of a span, and its number of letters."""
    doc, code, count, known = trigrams(span)
    kinds, column = np.unique(code, return_inverse=True)
    out = np.zeros((span.docs, table[0].shape[1]), np.float32)
    order = np.argsort(column, kind="stable")
    cuts = np.searchsorted(column[order], np.arange(0, len(kinds) + _BLOCK, _BLOCK))
    for b, (x, y) in enumerate(zip(cuts, cuts[1:])):
        at = order[x:y]
        part = kinds[b * _BLOCK : (b + 1) * _BLOCK]
        counts = np.zeros((span.docs, len(part)), np.float32)
        counts[doc[at], column[at] - b * _BLOCK] = count[at]
        bound = table[0][part // SYMBOLS**2] * table[1][part // SYMBOLS % SYMBOLS] * table[2][part % SYMBOLS]
        out += counts @ bound.astype(np.float32)
    return out, known


def _profile(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, sums = letters(dims), {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for span in S.spans(batch.column(1), SPAN_BYTES, SPAN_DOCS):
                vectors, known = bundles(span, table)
                for d in np.flatnonzero(known):
                    v = vectors[d].astype(np.float64)
                    if length := np.sqrt(v @ v):
                        one = sums.setdefault(langs[span.first + d], np.zeros(dims, np.int64))
                        one += np.rint(v / length * 4096).astype(np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([x.tolist() for x in sums.values()], pa.list_(pa.int64()))], names=["lang", "v"])

    return run


def fit(docs: DataFrame, sample: int = SAMPLE, dims: int = DIMS) -> dict[str, np.ndarray]:
    """Prototype of each language, from a bounded sample of labelled documents."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    counts = {r["lang"]: r["count"] for r in own.where("lang is not null").groupBy("lang").count().collect()}
    if not counts:
        return {}
    scale = 1 << 20
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(scale, int(scale * sample / n))))])
    drawn = own.where("lang is not null and text is not null").where(F.pmod(F.xxhash64(F.lit("lid"), "doc_id"), F.lit(scale)) < share[F.col("lang")])
    parts = drawn.select("lang", "text").mapInArrow(_profile(dims), "lang string, v array<bigint>").collect()
    out: dict[str, np.ndarray] = {}
    for r in parts:
        out[r["lang"]] = out.get(r["lang"], np.zeros(dims, np.int64)) + np.array(r["v"], np.int64)
    return {k: out[k] for k in sorted(out)}


def identify(text: Column, prototypes: dict[str, np.ndarray], min_cosine: float = MIN_COSINE, min_letters: int = MIN_LETTERS) -> Column:
    """RESULT for each text: language, its cosine, the lead over the next, accepted."""
    names = sorted(prototypes)
    dims = len(next(iter(prototypes.values()))) if names else DIMS
    unit = np.stack([prototypes[n] / np.linalg.norm(prototypes[n].astype(float)) for n in names]) if names else np.zeros((0, dims))

    @F.arrow_udf(RESULT)
    def run(texts: pa.Array) -> pa.Array:
        table = letters(dims)
        best = np.full(len(texts), -1)
        top, lead, known = np.zeros(len(texts)), np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        for span in S.spans(texts, SPAN_BYTES, SPAN_DOCS):
            here = slice(span.first, span.first + span.docs)
            vectors, known[here] = bundles(span, table)
            v = vectors.astype(np.float64)
            size = np.sqrt((v * v).sum(1))
            if len(names):
                cosine = (v @ unit.T) / np.maximum(size, 1e-300)[:, None]
                cosine = np.round(cosine, 9)
                best[here] = cosine.argmax(1)
                ranked = np.sort(cosine, axis=1)
                top[here] = ranked[:, -1]
                lead[here] = ranked[:, -1] - (ranked[:, -2] if len(names) > 1 else 0)
        some = (known > 0) & (best >= 0)
        good = some & ((known < min_letters) | (top >= min_cosine))
        return pa.StructArray.from_arrays(
            [
                pa.array([names[b] if s else None for b, s in zip(best, some)], pa.string()),
                pa.array(np.round(top, 6), mask=~some),
                pa.array(np.round(lead, 6), mask=~some),
                pa.array(good),
            ],
            names=["language", "cosine", "margin", "accepted"],
        )

    return run(text)


def identify_languages(docs: DataFrame, sample: int = SAMPLE, dims: int = DIMS, min_cosine: float = MIN_COSINE) -> DataFrame:
    """(doc_id, language, cosine, margin, accepted) of each row of docs."""
    found = identify(F.col("text").cast("string"), fit(docs, sample, dims), min_cosine)
    return docs.select("doc_id", found.alias("_found")).select("doc_id", "_found.*")


def keep_identified(docs: DataFrame, sample: int = SAMPLE, dims: int = DIMS, min_cosine: float = MIN_COSINE) -> DataFrame:
    """docs without the rows whose language is rejected."""
    found = identify(F.col("text").cast("string"), fit(docs, sample, dims), min_cosine)
    return docs.where(found["accepted"])
