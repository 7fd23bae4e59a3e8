"""Repeated passages: a depth-limited radix sort of suffixes.

Suffixes (one a token; tokens are runs of bytes above 32) are ordered only
through their first ``threshold`` tokens, in digits of ``DIGIT`` tokens, most
significant first. Groups of one drop out after each pass; those that are left
after the last are exactly the repeated windows.

The first pass looks at a part of the suffixes only, those at a minimiser: the
least digit among threshold - DIGIT + 1 successive ones. Equal windows hold the
same minimiser at the same place, so a window that is near no minimiser with an
equal elsewhere is in no group. The windows that are left are sent on with all
their digits, to a place that depends on the whole window, so that no digit is
hot, and there they are sorted digit by digit. Digits are compared as hashes, of
64 bits in the first pass and of 32 for each digit of a window later.

Before either shuffle equal keys of a batch of about ``RECORDS_A_BATCH`` records
are merged: those that are equal within a batch are known to be repeated, and
only the first of them goes on. A passage that a third of all documents hold
thus comes to its place once a batch.

Defined results: null and empty texts, and those under the threshold, have no
spans; texts of any length are read whole. Rows with a null doc_id have none and
are kept as they are. Rows that share both doc_id and text count once; of
different texts under one doc_id the least counts, and the others are kept as
they are. Of equal windows the first by (doc_id, position) stays. Repeats within
a document count. No rows give no spans. Columns other than doc_id, text and
n_chars aren't looked at. A doc_id must be a number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textscan as S
from .common import SCATTER, SCATTER_DDL, as_struct, gathered, give_back, materialize, scatter

THRESHOLD = 50
DIGIT = 10
RECORDS_A_TASK = 1_000_000
RECORDS_A_BATCH = 1 << 18

_U = np.uint64
#: twice: whether the batch that the record comes from has an equal one.
_ANCHOR = np.dtype([("key", "<u8"), ("doc", "<i8"), ("at", "<i4"), ("twice", "i1")])
_MARK = np.dtype([("doc", "<i8"), ("at", "<i4")])
_SPAN = np.dtype([("doc", "<i8"), ("at", "<i4"), ("later", "<i4")])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each width successive values, by doubling."""
    have, out = 1, x
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def _doc_windows(docs: np.ndarray, width: int) -> np.ndarray:
    """Which runs of width tokens lie in one document."""
    return docs[width - 1 :] == docs[: len(docs) - width + 1] if len(docs) >= width else np.zeros(0, bool)


def minimisers(tokens: np.ndarray, docs: np.ndarray, threshold: int, digit: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and digits of the tokens that are a minimiser of some window."""
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if len(tokens) < threshold:
        return none
    grams = S.window_hashes(tokens, digit)
    width = threshold - digit + 1
    least = sliding_min(grams, width)
    least = least[: len(tokens) - threshold + 1]
    whole = _doc_windows(docs, threshold)
    starts = np.flatnonzero(whole)
    if not len(starts):
        return none
    # A gram is a minimiser if it equals the least of a whole window that covers it: the largest of those least values is enough.
    fence = np.where(whole, least, _U(0))
    padded = np.concatenate([np.zeros(width - 1, np.uint64), fence, np.zeros(width - 1, np.uint64)])
    most = ~sliding_min(~padded, width)[: len(grams)]
    at = np.flatnonzero(grams[: len(most)] == most)
    at = at[most[at] != 0]
    return at, grams[at]


def _window_type(threshold: int, digit: int) -> np.dtype:
    return np.dtype([("digits", "<u4", (-(-threshold // digit),)), ("at", "<i4"), ("doc", "<i8"), ("twice", "i1")])


def _by_doc(docs: np.ndarray, places: int) -> np.ndarray:
    """Places behind those of the keys."""
    return places + (S.mix(docs.view(np.uint64)) % _U(places)).astype(np.int64)


def _sent(place: np.ndarray, rec: np.ndarray) -> pa.RecordBatch:
    return scatter(SCATTER, place.astype(np.int32), rec)


def _equal(group: np.ndarray) -> np.ndarray:
    """Which of the sorted keys have an equal beside them."""
    same = group[1:] == group[:-1]
    return np.r_[False, same] | np.r_[same, False]


def _heads(*columns: np.ndarray) -> np.ndarray:
    """Which rows begin a group of equal ones; rows with the same values lie together."""
    differ = np.zeros(max(0, len(columns[0]) - 1), bool)
    for c in columns:
        other = c[1:] != c[:-1]
        differ |= other.any(1) if other.ndim > 1 else other
    return np.r_[True, differ][: len(columns[0])]


def _send_anchors(found: list[np.ndarray], places: int) -> Iterator[pa.RecordBatch]:
    """Each key once to its place; the anchors that share a key within the batch to those of their documents."""
    rec = np.concatenate(found)
    rec = rec[np.argsort(rec["key"], kind="stable")]
    rec["twice"] = _equal(rec["key"])[: len(rec)]
    marks = np.empty(int(rec["twice"].sum()), _MARK)
    for k in ("doc", "at"):
        marks[k] = rec[k][rec["twice"] > 0]
    yield _sent(_by_doc(marks["doc"], places), marks)
    rec = rec[_heads(rec["key"])]
    yield _sent((rec["key"] >> _U(20)) % _U(places), rec)


def _anchors(threshold: int, digit: int, places: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[np.ndarray] = []
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for span in S.spans(batch.column(1)):
                starts, ends, docs = S.token_bounds(span)
                tokens = S.token_hashes(span, starts, ends)
                at, key = minimisers(tokens, docs, threshold, digit)
                out = np.zeros(len(at), _ANCHOR)
                out["key"], out["doc"] = key, ids[span.first + docs[at]]
                out["at"] = at - S.doc_token_starts(docs, span.docs)[docs[at]]
                found.append(out)
                if sum(map(len, found)) >= RECORDS_A_BATCH:
                    yield from _send_anchors(found, places)
                    found = []
        if found:
            yield from _send_anchors(found, places)
        del found
        give_back()

    return run


def _first_pass(places: int):
    """At a key's place: the anchors that share it with another batch. At a document's: what comes there."""

    def run(group: pa.Table) -> pa.Table:
        if group.column("place")[0].as_py() >= places:
            rec = gathered(group.column("records"), _MARK)
        else:
            rec = gathered(group.column("records"), _ANCHOR)
            rec = rec[np.argsort(rec["key"], kind="stable")]
            rec = rec[_equal(rec["key"])[: len(rec)] & (rec["twice"] == 0)]  # those that had an equal in their batch are marked already
        rec = rec[np.argsort(rec["doc"], kind="stable")]
        cuts = np.flatnonzero(_heads(rec["doc"]))
        at = np.ascontiguousarray(rec["at"])
        lists = [at[a:b].tobytes() for a, b in zip(cuts, np.r_[cuts[1:], len(rec)])]
        give_back()
        return pa.table({"doc_id": pa.array(rec["doc"][cuts], pa.int64()), "at": pa.array(lists, pa.binary())})

    return run


def _send_windows(found: list[np.ndarray], keys: list[np.ndarray], places: int) -> Iterator[pa.RecordBatch]:
    """Each window's text once to its place; the later ones of those that are equal within the batch to their documents."""
    rec, key = np.concatenate(found), np.concatenate(keys)
    order = np.argsort(key, kind="stable")
    rec, key = rec[order], key[order]
    twice = _equal(key)[: len(rec)]
    alone, some, key_some = rec[~twice], rec[twice], key[twice]
    order = np.lexsort((some["at"], some["doc"], *some["digits"].T, key_some))
    some, key_some = some[order], key_some[order]
    head = _heads(key_some, some["digits"])
    some["twice"] = head & ~np.r_[head[1:], True][: len(head)]
    spans = np.empty(int((~head).sum()), _SPAN)
    spans["doc"], spans["at"], spans["later"] = some["doc"][~head], some["at"][~head], 1
    yield _sent(_by_doc(spans["doc"], places), spans)
    yield _sent(np.concatenate([key[~twice], key_some[head]]) % _U(places), np.concatenate([alone, some[head]]))


def _windows(threshold: int, digit: int, places: int):
    reach = threshold - digit
    kind = _window_type(threshold, digit)
    steps = np.minimum(np.arange(kind["digits"].shape[0]) * digit, reach)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[np.ndarray] = []
        keys: list[np.ndarray] = []
        for batch in batches:
            ids, lists = batch.column(0).to_numpy(), batch.column(2)
            for span in S.spans(batch.column(1)):
                starts, ends, docs = S.token_bounds(span)
                tokens = S.token_hashes(span, starts, ends)
                whole = _doc_windows(docs, threshold)
                if not len(whole):
                    continue
                first = S.doc_token_starts(docs, span.docs)
                delta = np.zeros(len(tokens) + 1, np.int32)
                for d in range(span.docs):
                    for part in lists[span.first + d]:
                        at = np.frombuffer(part.as_buffer(), "<i4") + first[d]
                        np.add.at(delta, np.maximum(at - reach, first[d]), 1)
                        np.add.at(delta, at + 1, -1)
                take = np.flatnonzero(whole & (np.cumsum(delta)[: len(whole)] > 0))
                grams = (S.window_hashes(tokens, digit) >> _U(32)).astype(np.uint32)
                out = np.zeros(len(take), kind)
                for j, step in enumerate(steps):
                    out["digits"][:, j] = grams[take + step]
                out["doc"], out["at"] = ids[span.first + docs[take]], take - first[docs[take]]
                found.append(out)
                keys.append(S.window_hashes(tokens, threshold)[take])
                if sum(map(len, found)) >= RECORDS_A_BATCH:
                    yield from _send_windows(found, keys, places)
                    found, keys = [], []
        if found:
            yield from _send_windows(found, keys, places)
        del found, keys
        give_back()

    return run


def radix_groups(digits: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in the order of their digits, most significant first, and which of them begin a group of equal ones.

    Rows that are alone after a pass drop out, but for those in kept.
    """
    rows = np.arange(len(digits))
    group = np.zeros(len(digits), np.int64)
    head = np.ones(len(digits), bool)
    for j in range(digits.shape[1]):
        digit = digits[rows, j]
        order = np.argsort((group.astype(np.uint64) << _U(32)) | digit, kind="stable")
        rows, group, digit = rows[order], group[order], digit[order]
        head = _heads(group, digit)
        stay = ~(head & np.r_[head[1:], True][: len(head)]) | kept[rows]
        rows, head = rows[stay], head[stay]
        group = np.cumsum(head) - 1
    return rows, head


def _second_pass(threshold: int, digit: int, places: int):
    kind = _window_type(threshold, digit)

    def run(group: pa.Table) -> pa.Table:
        place = group.column("place")[0].as_py()
        if place >= places:
            return pa.Table.from_batches([b for b in group.select(["place", "records"]).cast(SCATTER).to_batches()], SCATTER)
        rec = gathered(group.column("records"), kind)
        rows, head = radix_groups(rec["digits"], rec["twice"] > 0)
        rec, name = rec[rows], np.cumsum(head)
        order = np.lexsort((rec["at"], rec["doc"], name))
        rec, first = rec[order], head  # groups keep their places, so their first rows are where heads were
        out = np.empty(len(rec), _SPAN)
        out["doc"], out["at"], out["later"] = rec["doc"], rec["at"], ~first
        del rec, rows, order
        give_back()
        return pa.Table.from_batches([_sent(_by_doc(out["doc"], places), out)])

    return run


def _spans(threshold: int):
    def run(group: pa.Table) -> pa.Table:
        rec = gathered(group.column("records"), _SPAN)
        rec = rec[np.lexsort((rec["at"], rec["later"], rec["doc"]))]
        far = np.r_[True, (rec["doc"][1:] != rec["doc"][:-1]) | (rec["later"][1:] != rec["later"][:-1]) | (rec["at"][1:] > rec["at"][:-1] + threshold)][: len(rec)]
        cuts = np.flatnonzero(far)
        last = np.r_[cuts[1:], len(rec)] - 1 if len(cuts) else cuts
        return pa.table(
            {
                "doc_id": pa.array(rec["doc"][cuts], pa.int64()),
                "later": pa.array(rec["later"][cuts] > 0),
                "start_token": pa.array(rec["at"][cuts], pa.int32()),
                "end_token": pa.array(rec["at"][last] + threshold, pa.int32()),
            }
        )

    return run


def _places(amount: int) -> int:
    return max(1, -(-amount // RECORDS_A_TASK))


def repeated_spans(docs: DataFrame, threshold: int = THRESHOLD, digit: int = DIGIT) -> DataFrame:
    """(doc_id, later, start_token, end_token): the tokens that repeated windows cover.

    later is false where the windows are the first of their kind, and true
    where an equal one comes before; windows that touch or overlap are one span.
    """
    if not 1 <= digit < threshold:
        raise ValueError("digit must be from 1 to threshold - 1")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    one = own.groupBy("doc_id").agg(F.min("text").alias("text")) if _repeats(docs) else own
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    places = _places(size // 4 // max(1, (threshold - digit) // 2))
    anchors = one.mapInArrow(_anchors(threshold, digit, places), SCATTER_DDL)
    near = anchors.groupBy("place").applyInArrow(_first_pass(places), "doc_id long, at binary")
    near = materialize(near.groupBy("doc_id").agg(F.collect_list("at").alias("at")))
    left = near.agg(F.sum(F.aggregate("at", F.lit(0).cast("long"), lambda n, x: n + F.octet_length(x)))).first()[0] or 0
    places = _places(left // 4 * (threshold - digit) // 2)
    found = one.join(near, "doc_id").select("doc_id", "text", "at").mapInArrow(_windows(threshold, digit, places), SCATTER_DDL)
    equal = found.groupBy("place").applyInArrow(_second_pass(threshold, digit, places), SCATTER_DDL)
    return equal.groupBy("place").applyInArrow(_spans(threshold), "doc_id long, later boolean, start_token int, end_token int")


def _repeats(docs: DataFrame) -> bool:
    """Whether some doc_id has several rows; reads that column alone."""
    return not docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty()


def _without(text: pa.Array, cuts: pa.Array) -> pa.Array:
    """The texts without the token spans in cuts; null where there are none."""
    out: list[str | None] = []
    for span in S.spans(text):
        starts, ends, docs = S.token_bounds(span)
        first = S.doc_token_starts(docs, span.docs)
        for d in range(span.docs):
            spans = cuts[span.first + d].as_py()
            if not spans:
                out.append(None)
                continue
            base = int(span.offsets[d])
            data = span.data[base : span.offsets[d + 1]].tobytes()
            kept, at = [], 0
            for s, e in sorted((x["s"], x["e"]) for x in spans):
                kept.append(data[at : int(starts[first[d] + s]) - base])
                at = int(ends[first[d] + e - 1]) - base
            out.append(b"".join([*kept, data[at:]]).decode("utf-8"))
    return pa.array(out, pa.string())


def remove_repeats(docs: DataFrame, threshold: int = THRESHOLD, digit: int = DIGIT) -> DataFrame:
    """docs whose texts lack the passages that come before in another document, or place.

    n_chars, where there is one, follows the text. A document of which nothing
    but white space is left goes. The others come back as they are.
    """
    spans = repeated_spans(docs, threshold, digit).where("later")
    cuts = spans.groupBy(F.col("doc_id").alias("_id")).agg(F.collect_list(F.struct(F.col("start_token").alias("s"), F.col("end_token").alias("e"))).alias("_cuts"))
    rows = docs.select(as_struct(docs).alias("_row"), F.col("doc_id").cast("long").alias("_doc"), F.col("text").cast("string").alias("_own"))
    match = F.col("_doc") == F.col("_id")
    if _repeats(docs):
        least = docs.where("text is not null").groupBy(F.col("doc_id").cast("long").alias("_of")).agg(F.min(F.col("text").cast("string")).alias("_least"))
        cuts = cuts.join(least, F.col("_id") == F.col("_of")).select("_id", "_cuts", F.xxhash64("_least").alias("_least"))
        match = match & (F.xxhash64("_own") == F.col("_least"))
    both = rows.join(materialize(cuts), match, "left")
    new = both.withColumn("_new", F.arrow_udf(_without, "string")(F.when(F.col("_cuts").isNotNull(), F.col("_own")), F.col("_cuts")))
    new = new.where(F.col("_new").isNull() | F.col("_new").rlike(r"[^\x00-\x20]"))
    row = F.col("_row")
    out = {"text": F.coalesce("_new", row["text"])}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(F.col("_new").isNotNull(), F.length("_new")).otherwise(row["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return new.select(*[out.get(c, row[c]).alias(c) for c in docs.columns])
