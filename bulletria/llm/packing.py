"""Best-fit-decreasing packing of documents into sequences of one capacity.

Lengths are words (runs of bytes above 32). A document longer than the capacity
is cut into full pieces and a rest. Pieces go, longest first, into the open bin
that they leave the least room in; a segment tree over remaining capacities
finds it in logarithmic time.

Best fit looks at lengths alone, and bins with the same room left are alike. So
pieces of one length are placed all at once: the tightest class of bins takes as
many as fit in each, then the next. The plan comes from the number of pieces of
each length, at most ``capacity`` numbers, whatever the number of documents, and
is that of a run over all pieces one by one. It maps the rank of a piece among
those of its length to a bin and an offset. Ranks are summed in two levels, over
buckets of a hash and within them, so the commonest length is ranked by many
tasks; rows that are repeated whole are merged batch by batch before they are
shuffled, and spread again once they are ranked.

Defined results: null and empty texts have no piece; texts of any length are
packed whole. Rows that share a doc_id are packed separately; null doc_ids are
packed too. Equal lengths go in the order of a hash of doc_id, text and piece. No
rows, no bins. Columns other than doc_id and text aren't looked at. A doc_id must
be a number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textscan as S
from .common import materialize

CAPACITY = 2048
#: Words of pieces of one length that a task ranks, in expectation.
BUCKET_WORDS = 4_000_000
SEPARATOR = "\n"
_PLAN = np.dtype([("first", "<i8"), ("each", "<i8"), ("bin", "<i8"), ("position", "<i8"), ("offset", "<i8")])


class OpenBins:
    """Classes of open bins by the room that is left, in a segment tree."""

    def __init__(self, capacity: int):
        self.leaves = 1 << int(capacity).bit_length()
        self.tree = bytearray(2 * self.leaves)  # whether some open bin has a room in the node's range
        self.classes: list[list[tuple[int, int, int]]] = [[] for _ in range(capacity + 1)]

    def tightest(self, n: int) -> int:
        """The least room of at least n among open bins, or 0."""
        node = self.leaves + n
        if self.tree[node]:
            return n
        while node > 1 and (node & 1 or not self.tree[node + 1]):
            node >>= 1
        if node <= 1:
            return 0
        node += 1
        while node < self.leaves:
            node = 2 * node if self.tree[2 * node] else 2 * node + 1
        return node - self.leaves

    def push(self, room: int, first: int, bins: int, pieces: int) -> None:
        if room and bins:
            self.classes[room].append((first, bins, pieces))
            node = self.leaves + room
            while node and not self.tree[node]:
                self.tree[node] = 1
                node >>= 1

    def pop(self, room: int) -> tuple[int, int, int]:
        top = self.classes[room].pop()
        if not self.classes[room]:
            node = self.leaves + room
            self.tree[node] = 0
            node >>= 1
            while node and not (self.tree[2 * node] or self.tree[2 * node + 1]):
                self.tree[node] = 0
                node >>= 1
        return top


def best_fit(counts: dict[int, int], capacity: int) -> tuple[dict[int, np.ndarray], int]:
    """_PLAN for each length, of so many pieces each, and the number of bins.

    A step of the plan puts ``each`` pieces into every bin from ``bin`` on,
    beginning with the piece of rank ``first``.
    """
    open_bins, made = OpenBins(capacity), 0
    plan: dict[int, np.ndarray] = {}
    for n in sorted(counts, reverse=True):
        rank, left, steps = 0, counts[n], []
        while left:
            room = open_bins.tightest(n)
            first, bins, pieces = open_bins.pop(room) if room else (made, -(-left // (capacity // n)), 0)
            if not room:
                room, made = capacity, made + bins
            each = room // n
            full, some = (bins, 0) if bins * each <= left else divmod(left, each)
            steps.append((rank, each, first, pieces, capacity - room))
            open_bins.push(room, first + full + (some > 0), bins - full - (some > 0), pieces)
            open_bins.push(room - each * n, first, full, pieces + each)
            open_bins.push(room - some * n, first + full, some > 0, pieces + some)
            rank, left = rank + full * each + some, left - full * each - some
        plan[n] = np.array(steps, _PLAN)
    return plan, made


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = np.zeros(batch.num_rows, np.int64)
        for span in S.spans(batch.column(2)):
            _, _, docs = S.token_bounds(span)
            counts[span.first : span.first + span.docs] = np.bincount(docs, minlength=span.docs)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts)], names=["doc_id", "hash", "words"])


def _once(batch: pa.RecordBatch) -> tuple[pa.RecordBatch, np.ndarray]:
    """The batch with rows of equal doc_id and text once, and how often each comes."""
    ids, texts = batch.column(0).to_pylist(), batch.column(2)
    seen: dict[tuple, int] = {}
    keep, times = [], []
    for i, key in enumerate(zip(ids, batch.column(1).to_pylist())):
        at = seen.setdefault(key, len(keep))
        if at < len(keep) and texts[keep[at]].equals(texts[i]):
            times[at] += 1
        else:
            keep.append(i)
            times.append(1)
    return batch.take(pa.array(keep, pa.int64())), np.array(times, np.int64)


def _cut(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, times = _once(batch)
            for span in S.spans(rows.column(2)):
                starts, ends, docs = S.token_bounds(span)
                first = S.doc_token_starts(docs, span.docs)
                at, piece, size, texts = [], [], [], []
                data = span.data.tobytes()
                for d in np.flatnonzero(np.diff(first)).tolist():
                    for k, a in enumerate(range(first[d], first[d + 1], capacity)):
                        b = min(a + capacity, first[d + 1])
                        at.append(span.first + d)
                        piece.append(k)
                        size.append(b - a)
                        texts.append(data[starts[a] : ends[b - 1]])
                here = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0).take(here), rows.column(1).take(here), pa.array(times[at] if at else [], pa.int64()), pa.array(piece, pa.int64()), pa.array(size, pa.int32()), pa.array(texts, pa.binary()).cast(pa.string())],
                    names=["doc_id", "hash", "times", "piece", "n_words", "text"],
                )

    return run


def _placed(plan: dict[int, np.ndarray]):
    """Where the piece of a rank goes among those of its length."""

    def run(lengths: pa.Array, ranks: pa.Array) -> pa.Array:
        n, rank = lengths.to_numpy(), ranks.to_numpy()
        out = np.zeros((3, len(n)), np.int64)
        for length in np.unique(n).tolist():
            rows = np.flatnonzero(n == length)
            steps = plan[length]
            step = steps[np.searchsorted(steps["first"], rank[rows], side="right") - 1]
            past, nth = np.divmod(rank[rows] - step["first"], step["each"])
            out[:, rows] = step["bin"] + past, step["position"] + nth, step["offset"] + nth * length
        return pa.StructArray.from_arrays([pa.array(out[0]), pa.array(out[1].astype(np.int32)), pa.array(out[2].astype(np.int32))], names=["bin_id", "position", "bin_offset"])

    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, bucket_words: int = BUCKET_WORDS) -> DataFrame:
    """(bin_id, n_words, pieces, doc_ids, text): the sequences, one row each.

    pieces tell doc_id, piece, start_word, n_words and bin_offset, in the order
    of the text, where they are separated by a line feed; doc_ids are those of
    the pieces, each once.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    text = F.col("text").cast("string")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("hash"), text.alias("text")).where("text is not null")
    words = materialize(own.mapInArrow(_words, "doc_id long, hash long, words long").where("words > 0"))
    cut = F.col("words") % capacity
    rests = words.groupBy(cut.cast("int").alias("rest")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.expr(f"words div {capacity}")).alias("full")).collect()
    counts = {r["rest"]: r["n"] for r in rests if r["rest"]}
    if full := sum(r["full"] for r in rests):
        counts[capacity] = full
    plan, _ = best_fit(counts, capacity)

    buckets = F.lit([max(1, -(-counts.get(n, 0) * n // bucket_words)) for n in range(1, capacity + 1)])
    bucket = F.pmod(F.xxhash64("doc_id", "hash", "piece"), F.element_at(buckets, F.col("n_words")).cast("long")).alias("bucket")
    each = words.select("doc_id", "hash", "words", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(words - 1) div {capacity}"))).alias("piece"))
    each = each.withColumn("n_words", F.least(F.col("words") - F.col("piece") * capacity, F.lit(capacity)).cast("int"))
    sizes = each.select("n_words", bucket).groupBy(F.col("n_words").alias("of"), F.col("bucket").alias("at")).count()
    before = Window.partitionBy("of").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("of", "at", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))

    pieces = own.mapInArrow(_cut(capacity), "doc_id long, hash long, times long, piece long, n_words int, text string").withColumn("bucket", bucket)
    known = pieces.join(base, (F.col("n_words") == F.col("of")) & (F.col("bucket") == F.col("at"))).drop("of", "at")
    order = Window.partitionBy("n_words", "bucket").orderBy("hash", "doc_id", "piece").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = known.withColumn("end", F.col("before") + F.sum("times").over(order))
    spread = ends.select("doc_id", "piece", "n_words", "text", F.explode(F.sequence(F.col("end") - F.col("times"), F.col("end") - 1)).alias("rank"))
    where = F.arrow_udf(_placed(plan), "bin_id long, position int, bin_offset int")("n_words", "rank")
    placed = spread.select("doc_id", "piece", "n_words", "text", where.alias("to"))
    one = F.struct(
        F.col("to.position").alias("position"), "doc_id", F.col("piece").cast("int").alias("piece"), (F.col("piece") * capacity).alias("start_word"), "n_words",
        F.col("to.bin_offset").alias("bin_offset"), "text",
    )
    bins = placed.groupBy(F.col("to.bin_id").alias("bin_id")).agg(F.sum("n_words").cast("int").alias("n_words"), F.sort_array(F.collect_list(one)).alias("all"))
    shown = F.transform("all", lambda p: F.struct(*[p[k].alias(k) for k in ("doc_id", "piece", "start_word", "n_words", "bin_offset")]))
    return bins.select(
        "bin_id", "n_words", shown.alias("pieces"), F.array_distinct(F.transform("all", lambda p: p["doc_id"])).alias("doc_ids"),
        F.array_join(F.transform("all", lambda p: p["text"]), SEPARATOR).alias("text"),
    )
