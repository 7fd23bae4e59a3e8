"""Near-duplicate documents: SimHash with pigeonring filtering.

A 128-bit SimHash over lower-cased words, weighted by the square root of their
frequency, is cut into a ring of ``SEGMENTS`` consecutive segments. If two
fingerprints differ in at most ``radius`` bits, some segment starts a chain in
which the first l segments differ in at most l * radius / SEGMENTS bits, for
every l (Qin and Xiao, Pigeonring, VLDB 2018). The chain's first segment then
differs in at most two bits, and any two such values share a neighbour at a
distance of at most one bit: fingerprints meet under the values that lie within
one bit of a segment's, and go through the chain check, which ends with the
full distance. A pair is taken at the first segment that starts a chain, and
under one of the values it meets at, so each link is found, and counted, once.

A task holds the values of one segment that share some leading bits. Flips of
the other bits stay there, so a fingerprint is sent once, and once more for each
leading bit: about log2(n / LEAF) times a segment. Crowded prefixes are made
longer; a crowded whole value is split further by the halves of the next
segment, which, by the chain of two segments, differ in at most five bits. The
same split thins out large buckets within a task. Nothing is capped.

Defined results: a text that is null or has no word (a run of ASCII letters,
digits and bytes above 127) has no fingerprint and belongs to no group; texts of
any length are read whole. Rows with a null doc_id are ignored here and kept by
``deduplicate``. Rows that share a doc_id are one document, whose fingerprint is
the least of theirs. Ties within a group go to the least doc_id, which stays. No
rows give no groups. Columns other than doc_id and text aren't looked at, and
come back from ``deduplicate`` as they are. A doc_id must be a number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textscan as S
from .common import discard, fresh, gathered, give_back, materialize, scatter

RADIUS = 14
SEGMENTS = 5
BITS = 128
#: Fingerprints whose values a task holds, about: twice as many call for a longer prefix.
LEAF = 16_384
#: Leading bits of a prefix at least, so that small tables have tasks enough, and at most before crowded ones are made longer.
LEAST_DEPTH, MOST_DEPTH = 3, 20
#: Pairs compared at once, and members of a bucket from which the next segment thins it out.
PAIRS_AT_ONCE = 1 << 18
LARGE_BUCKET = 2_048

_U = np.uint64
_SALTS = (_U(0x9999999999999999), _U(0x5851F42D4C957F2D))


def _masks() -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    cuts = [round(BITS * i / SEGMENTS) for i in range(SEGMENTS + 1)]
    high, low = [], []
    for a, b in zip(cuts, cuts[1:]):
        m = ((1 << (b - a)) - 1) << (BITS - b)
        high.append(m >> 64)
        low.append(m & (2**64 - 1))
    return np.array(high, np.uint64), np.array(low, np.uint64), list(zip(cuts, cuts[1:]))


_HIGH, _LOW, _CUTS = _masks()
_WIDTH = [b - a for a, b in _CUTS]
#: A fingerprint, and the bits of the segment's value, and of the next one's half, that were flipped on the way (-1: none).
_RECORD = np.dtype([("high", "<u8"), ("low", "<u8"), ("flip", "i1"), ("sub", "i1")])
_SENT = pa.schema([("place", pa.int64()), ("records", pa.binary())])
_SENT_DDL = "place long, records binary"
_LINKS_DDL = "high long, low long, to_high long, to_low long, links long"


def simhash(words: np.ndarray) -> tuple[int, int]:
    """Two 64-bit halves of the fingerprint of hashed words."""
    distinct, counts = np.unique(words, return_counts=True)
    weight = np.rint(np.sqrt(counts) * 16)  # whole numbers: sums don't depend on their order
    halves = np.stack([S.mix(distinct + salt) for salt in _SALTS], 1).astype(">u8")
    bits = np.unpackbits(halves.view(np.uint8).reshape(len(distinct), BITS // 8), axis=1)
    dtype = np.float32 if weight.sum() < 2**23 else np.float64
    votes = weight.astype(dtype) @ bits.astype(dtype)
    high, low = np.packbits(votes * 2 > weight.sum()).view(">u8")
    return int(high), int(low)


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.num_rows
        prints = np.zeros((n, 2), np.uint64)
        some = np.zeros(n, bool)
        for span in S.spans(batch.column(1)):
            starts, ends, docs = S.token_bounds(span, S.WORD_BYTE)
            words = S.token_hashes(span, starts, ends, S.LOWER_CODES)
            bounds = S.doc_token_starts(docs, span.docs)
            for d in range(span.docs):
                a, b = bounds[d], bounds[d + 1]
                if a < b:
                    prints[span.first + d] = simhash(words[a:b])
                    some[span.first + d] = True
        keep = pa.array(some)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(prints[:, 0].view(np.int64)), pa.array(prints[:, 1].view(np.int64))], names=["doc_id", "high", "low"]
        ).filter(keep)
    give_back()


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, high, low) of each document that has words."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    prints = own.mapInArrow(_fingerprint_batches, "doc_id long, high long, low long")
    return prints.groupBy("doc_id").agg(F.min(F.struct("high", "low")).alias("p")).select("doc_id", "p.high", "p.low")


def _segment(high: np.ndarray, low: np.ndarray, s: int) -> np.ndarray:
    a, b = _CUTS[s]
    if b <= 64:
        return (high & _HIGH[s]) >> _U(64 - b)
    if a >= 64:
        return (low & _LOW[s]) >> _U(128 - b)
    return ((high & _HIGH[s]) << _U(b - 64)) | (low >> _U(128 - b))


class Tree:
    """The leaves that the values of each segment are cut into.

    depths: for each prefix of ``depth`` bits the bits of the leaf it lies in.
    whole: the values that are a crowded leaf by themselves, by segment, sorted;
    those are cut by ``sub`` leading bits of both halves of the next segment.
    A place is a number that tells segment, leaf, half and part.
    """

    def __init__(self, depth: int, crowded: dict[tuple[int, int], int], whole: dict[int, list[int]], sub: int):
        self.depth, self.sub = depth, sub
        self.depths = [np.full(1 << depth, depth, np.int8) for _ in _CUTS]
        for (s, prefix), deeper in crowded.items():
            self.depths[s][prefix] = deeper
        self.whole = [np.array(sorted(whole.get(s, [])), np.uint64) for s in range(SEGMENTS)]

    def leaf_depth(self, s: int, value: np.ndarray) -> np.ndarray:
        return self.depths[s][(value >> _U(_WIDTH[s] - self.depth)).astype(np.int64)].astype(np.int64)

    def is_whole(self, s: int, value: np.ndarray) -> np.ndarray:
        return np.isin(value, self.whole[s]) if len(self.whole[s]) else np.zeros(len(value), bool)

    def place(self, s: int, value: np.ndarray) -> np.ndarray:
        depth = self.leaf_depth(s, value)
        leaf = (value >> (_WIDTH[s] - depth).astype(np.uint64)) | (_U(1) << depth.astype(np.uint64))
        return (_U(s << 48) | (leaf << _U(16))).view(np.int64)


def _halves(high: np.ndarray, low: np.ndarray, s: int) -> list[tuple[np.ndarray, int]]:
    """Values and widths of the two halves of a segment."""
    value, width = _segment(high, low, s), _WIDTH[s]
    cut = width // 2
    return [(value >> _U(cut), width - cut), (value & _U((1 << cut) - 1), cut)]


def _send(tree: Tree):
    def parts(s: int, value: np.ndarray, rec: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        place, split = tree.place(s, value), tree.is_whole(s, value)
        yield place[~split], rec[~split]
        place, rec = place[split], rec[split]
        if len(rec):
            for h, (half, width) in enumerate(_halves(rec["high"], rec["low"], (s + 1) % SEGMENTS)):
                top = min(tree.sub, width)
                for bit in [-1, *range(width - top, width)]:
                    out = rec.copy()
                    out["sub"] = bit
                    part = (half ^ _U(1 << bit if bit >= 0 else 0)) >> _U(width - top)
                    yield place | (1 + (part.view(np.int64) << 1 | h)), out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rec = np.empty(batch.num_rows, _RECORD)
            rec["high"], rec["low"] = (batch.column(i).to_numpy().view(np.uint64) for i in (0, 1))
            rec["flip"] = rec["sub"] = -1
            places, records = [], []
            for s, width in enumerate(_WIDTH):
                value = _segment(rec["high"], rec["low"], s)
                depth = tree.leaf_depth(s, value)
                for bit in [-1, *range(width)]:
                    go = np.ones(len(rec), bool) if bit < 0 else width - 1 - bit < depth
                    out = rec[go]
                    out["flip"] = bit
                    for place, part in parts(s, value[go] ^ _U(1 << bit if bit >= 0 else 0), out):
                        places.append(place)
                        records.append(part)
            yield scatter(_SENT, np.concatenate(places), np.concatenate(records))

    return run


def _chain(high: np.ndarray, low: np.ndarray, start: int, radius: int) -> np.ndarray:
    """Of pairs, given by the exclusive-or of their halves: which pass the chain that starts at a segment."""
    live, total = np.arange(len(high)), np.zeros(len(high), np.int64)
    for length in range(1, SEGMENTS + 1):
        s = (start + length - 1) % SEGMENTS
        total = total + np.bitwise_count(high & _HIGH[s]) + np.bitwise_count(low & _LOW[s])
        good = total * SEGMENTS <= length * radius
        live, high, low, total = live[good], high[good], low[good], total[good]
        if not len(live):
            break
    return live


def _meeting(value: np.ndarray, flip: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys, with rows and flips: each value as it is, and those without a flip with each of the low bits flipped."""
    own = np.flatnonzero(flip < 0).astype(np.int32)
    value = value.astype(np.uint32)
    key = np.concatenate([value, *(value[own] ^ np.uint32(1 << j) for j in range(bits))])
    rows = np.concatenate([np.arange(len(value), dtype=np.int32), *[own] * bits])
    flips = np.concatenate([flip, *(np.full(len(own), j, np.int8) for j in range(bits))])
    order = np.argsort(key, kind="stable").astype(np.int32)
    return key[order], rows[order], flips[order]


def _once(key: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of pairs that meet at keys with flips a and b: those for which it is the one that counts, the lesser of the two."""
    top = np.maximum(a, b)
    return (top < 0) | ((a != b) & (key >> np.maximum(top, 0).astype(np.uint32) & np.uint32(1) == 0))


def _bucket_pairs(start: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of positions within buckets, some at a time."""
    some = end - start > 1
    start, end = start[some], end[some]
    size = end - start
    left = np.repeat(end, size) - 1
    at = np.concatenate([np.arange(a, b) for a, b in zip(start, end)]) if len(start) else start
    more = left - at
    done = np.cumsum(more)
    i = 0
    while i < len(at):
        before = done[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(done, before + PAIRS_AT_ONCE, side="right")))
        n = more[i:j]
        p = np.repeat(at[i:j], n)
        q = p + 1 + np.arange(len(p)) - np.repeat(np.cumsum(n) - n, n)
        yield p, q
        i = j


class Links:
    """Links of each record of a task, and a forest that connects what they connect."""

    def __init__(self, rec: np.ndarray, start: int, radius: int):
        self.rec, self.start, self.radius = rec, start, radius
        self.links, self.root = np.zeros(len(rec), np.int64), np.arange(len(rec))

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        """Those of the pairs that are links, and start no chain at a segment before."""
        high, low = (self.rec[k][a] ^ self.rec[k][b] for k in ("high", "low"))
        live = _chain(high, low, self.start, self.radius)
        for s in range(self.start):
            if not len(live):
                return
            live = np.delete(live, _chain(high[live], low[live], s, self.radius))
        a, b = a[live], b[live]
        self.links += np.bincount(np.concatenate([a, b]), minlength=len(self.rec))
        while len(a):  # the larger of two roots is hung on the smaller until all pairs agree
            x, y = self.root[a], self.root[b]
            apart = x != y
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.root, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(up := self.root[self.root], self.root):
                self.root = up


def _find(radius: int, sub: int):
    def run(group: pa.Table) -> pa.Table:
        place = group.column("place")[0].as_py()
        rec = gathered(group.column("records"), _RECORD)
        s, leaf, part = place >> 48, place >> 16 & 0xFFFFFFFF, (place & 0xFFFF) - 1
        found = Links(rec, s, radius)
        after = (s + 1) % SEGMENTS

        def by_half(rows: np.ndarray, flips: np.ndarray, key: int, h: int, fixed: int) -> None:
            """Pairs of records under one key, that agree to two bits in a half of the next segment."""
            halves = _halves(rec["high"][rows], rec["low"][rows], after)
            value, width = halves[h]
            subs = rec["sub"][rows] if fixed else np.full(len(rows), -1, np.int8)
            value = np.where(subs >= 0, value ^ (_U(1) << np.maximum(subs, 0).astype(np.uint64)), value)
            keys, at, sub_flips = _meeting(value, subs, width - fixed)
            cuts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True]) if len(keys) else np.zeros(1, np.int64)
            for p, q in _bucket_pairs(cuts[:-1], cuts[1:]):
                a, b = at[p], at[q]
                good = _once(keys[p], sub_flips[p], sub_flips[q]) & _once(np.full(len(a), key, np.uint32), flips[a], flips[b])
                a, b = a[good], b[good]
                if h:
                    far = np.bitwise_count(halves[0][0][a] ^ halves[0][0][b]) > 2
                    a, b = a[far], b[far]
                found.add(rows[a], rows[b])

        value = _segment(rec["high"], rec["low"], s)
        value = np.where(rec["flip"] >= 0, value ^ (_U(1) << np.maximum(rec["flip"], 0).astype(np.uint64)), value)
        if part >= 0:  # one part of a half, under one whole value
            width = _halves(rec["high"][:1], rec["low"][:1], after)[part & 1][1]
            by_half(np.arange(len(rec)), rec["flip"], int(value[0]), part & 1, min(sub, width))
        else:
            keys, rows, flips = _meeting(value, rec["flip"], _WIDTH[s] - (leaf.bit_length() - 1))
            cuts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
            large = np.diff(cuts) > LARGE_BUCKET
            for p, q in _bucket_pairs(cuts[:-1][~large], cuts[1:][~large]):
                good = _once(keys[p], flips[p], flips[q])
                found.add(rows[p[good]], rows[q[good]])
            for i in np.flatnonzero(large):
                for h in (0, 1):
                    here = slice(cuts[i], cuts[i + 1])
                    by_half(rows[here], flips[here], int(keys[cuts[i]]), h, 0)
        some = np.flatnonzero(found.links)
        root = found.root[some]
        columns = [rec["high"][some], rec["low"][some], rec["high"][root], rec["low"][root]]
        return pa.table([*(pa.array(c.view(np.int64)) for c in columns), pa.array(found.links[some])], names=["high", "low", "to_high", "to_low", "links"])

    return run


def _prefix(s: int, depth: int | Column) -> Column:
    """Leading bits of a segment's value, of the columns high and low."""
    a, b = _CUTS[s]
    if b <= 64:
        value = F.shiftrightunsigned("high", 64 - b)
    elif a >= 64:
        value = F.shiftrightunsigned("low", 128 - b)
    else:
        value = F.shiftleft("high", b - 64).bitwiseOR(F.shiftrightunsigned("low", 128 - b))
    return F.shiftrightunsigned(value.bitwiseAND((1 << (b - a)) - 1), b - a - depth)


def _tree(prints: DataFrame, leaf: int) -> Tree:
    """Leaves of about so many fingerprints. To the driver go only prefixes and values that hold more than 2 * leaf: fewer than SEGMENTS * n / leaf."""

    def crowded(depth: int, of: DataFrame) -> list:
        each = of.select(F.explode(F.array(*[F.struct(F.lit(s).alias("s"), _prefix(s, depth or _WIDTH[s]).alias("p")) for s in range(SEGMENTS)])).alias("x")).select("x.*")
        return each.groupBy("s", "p").count().where(F.col("count") > 2 * leaf).collect()

    n = prints.count()
    depth = min(MOST_DEPTH, max(LEAST_DEPTH, (max(1, n) // leaf).bit_length()))
    deeper, whole, sub = {}, {}, 0
    for r in crowded(depth, prints):
        deeper[r["s"], r["p"]] = min(_WIDTH[r["s"]], depth + (r["count"] // leaf).bit_length())
    if deeper:
        for r in crowded(0, prints):
            deeper[r["s"], r["p"] >> (_WIDTH[r["s"]] - depth)] = _WIDTH[r["s"]]
            whole.setdefault(r["s"], []).append(r["p"])
            sub = max(sub, min(12, (r["count"] // leaf).bit_length()))
    return Tree(depth, deeper, whole, sub)


def similar_links(prints: DataFrame, radius: int = RADIUS, leaf: int = LEAF) -> DataFrame:
    """_LINKS_DDL: for fingerprints with others within radius bits, some of their links, and one that is connected to them.

    prints: (high, low), each fingerprint once. A fingerprint's links add up
    over its rows; its rows together connect what links connect.
    """
    if not 0 <= radius < 3 * SEGMENTS:
        raise ValueError(f"radius must be from 0 to {3 * SEGMENTS - 1}")
    tree = _tree(prints, leaf)
    sent = prints.select("high", "low").mapInArrow(_send(tree), _SENT_DDL)
    return sent.groupBy("place").applyInArrow(_find(radius, tree.sub), _LINKS_DDL)


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of the nodes that aren't the least of their component.

    Alternates large and small stars (Kiveris et al., 2014). Each step groups
    and joins by node, so no neighbour list is held in memory.
    """

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())

    now = materialize(edges.where("a < b").select("a", "b").distinct())
    seen = state(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a < b").distinct()
        up = large.select(F.col("b").alias("u"), F.col("a").alias("v"))
        least = up.groupBy("u").agg(F.min("v").alias("m"))
        linked = up.join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))
        old, now = now, materialize(linked.unionByName(least.select(F.col("m").alias("a"), F.col("u").alias("b"))).where("a < b").distinct())
        discard(old)
        if (state_now := state(now)) == seen:
            break
        seen = state_now
    return now.select(F.col("b").alias("id"), F.col("a").alias("root"))


def near_duplicate_groups(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, group_id, copies, links, kept) of each document that has a near copy.

    group_id is the least doc_id of those that pairs within radius bits connect.
    copies are the documents with the very same fingerprint, itself included;
    links are the other fingerprints within radius bits. kept marks the one
    document that stays.
    """
    prints = materialize(fingerprints(docs))
    same = materialize(prints.groupBy("high", "low").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("copies")))
    links = materialize(similar_links(same, radius))
    ends = same.select(F.col("high").alias("to_high"), F.col("low").alias("to_low"), F.col("id").alias("to"))
    edges = links.join(same, ["high", "low"]).join(ends, ["to_high", "to_low"]).select(F.least("id", "to").alias("a"), F.greatest("id", "to").alias("b"))
    roots = components(edges)
    counts = links.groupBy("high", "low").agg(F.sum("links").alias("links"))
    rooted = same.join(counts, ["high", "low"], "left").where("copies > 1 or links > 0").join(roots, "id", "left")
    grouped = rooted.select("high", "low", F.coalesce("root", "id").alias("group_id"), "copies", F.coalesce("links", F.lit(0)).cast("long").alias("links"))
    found = prints.join(grouped, ["high", "low"])
    return found.select("doc_id", "group_id", "copies", "links", (F.col("doc_id") == F.col("group_id")).alias("kept"))


def deduplicate(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """docs without the documents of which a near copy stays."""
    name = fresh(docs, "gone")
    gone = near_duplicate_groups(docs, radius).where(~F.col("kept")).select(F.col("doc_id").alias(name))
    return docs.join(gone, F.col("doc_id").cast("long") == F.col(name), "left_anti")
