"""Vectorised scanning of Arrow string columns as raw UTF-8 bytes.

A column is cut into spans of whole documents of about 256 KB each, so that
the temporary arrays, eight times that and more, stay in cache and small
whatever the Arrow batch holds; a
document longer than that is a span by itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
SPAN_BYTES = 1 << 18

_rng = np.random.Generator(np.random.PCG64(20240229))
BYTE_CODES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 2**64)
_WINDOW_BASE = 0xC2B2AE3D27D4EB4F
_WINDOW_BASE_INV = pow(_WINDOW_BASE, -1, 2**64)

LOWER_CODES = BYTE_CODES.copy()
LOWER_CODES[65:91] = BYTE_CODES[97:123]

NOT_SPACE = np.ones(256, bool)
NOT_SPACE[:33] = False
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[48:58] = WORD_BYTE[65:91] = WORD_BYTE[97:123] = WORD_BYTE[128:] = True

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 2 * SPAN_BYTES)
        have = np.full(size, base % 2**64, dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if n <= 2 * SPAN_BYTES:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@dataclass
class Span:
    """Some whole documents: their bytes, and offsets of each in them."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def docs(self) -> int:
        return len(self.offsets) - 1


def spans(column: pa.Array | pa.ChunkedArray, limit: int = SPAN_BYTES, most: int = SPAN_BYTES) -> Iterator[Span]:
    """Spans, of so many bytes and documents at most, of a string column; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), i + most, n)
        yield Span(i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        i = j


def token_bounds(span: Span, member: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and documents of the maximal runs of member bytes."""
    inside = member[span.data]
    if not len(inside):
        none = np.zeros(0, np.int64)
        return none, none, none
    after = np.empty_like(inside)
    after[0] = False
    after[1:] = inside[:-1]
    cuts = span.offsets[:-1]
    after[cuts[cuts < len(inside)]] = False
    starts = np.flatnonzero(inside & ~after)
    before = np.empty_like(inside)
    before[-1] = False
    before[:-1] = inside[1:]
    cuts = span.offsets[1:]
    before[cuts[cuts > 0] - 1] = False
    ends = np.flatnonzero(inside & ~before) + 1
    docs = np.searchsorted(span.offsets, starts, side="right") - 1
    return starts, ends, docs


def token_hashes(span: Span, starts: np.ndarray, ends: np.ndarray, codes: np.ndarray = BYTE_CODES) -> np.ndarray:
    """A 64-bit hash of each token, the same wherever it stands."""
    n = len(span.data)
    if not len(starts):
        return np.zeros(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(codes[span.data] * powers(_BASE, n), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * powers(_BASE_INV, n)[starts])


def window_hashes(tokens: np.ndarray, width: int) -> np.ndarray:
    """Hashes of each run of width tokens; those that cross documents too."""
    n = len(tokens)
    if n < width:
        return np.zeros(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(tokens * powers(_WINDOW_BASE, n), out=sums[1:])
    return mix((sums[width:] - sums[:-width]) * powers(_WINDOW_BASE_INV, n)[: n - width + 1])


def doc_token_starts(docs: np.ndarray, n: int) -> np.ndarray:
    """Index of the first token of each document, with the end appended."""
    return np.searchsorted(docs, np.arange(n + 1))
