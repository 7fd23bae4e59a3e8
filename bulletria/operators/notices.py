"""Notices of one text in plain Python: what segment.py hands to Arrow, a document at a time.

A text is cut into lines once; its notices, their scores and their records are
made from that list. Every step is linear in the lines. What counts as white
space, a digit or a letter is as in functions/text.py: texts of ASCII alone have
patterns of their own, which are faster and mean the same.
"""

from __future__ import annotations

import gc
import hashlib
import re
import sys
import unicodedata
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import cache, partial
from itertools import chain

import pyarrow as pa

from ..functions.text import CLOSERS
from . import body, patterns

_STOPS = frozenset([*CLOSERS, *",;:-"])
_CLOSERS = frozenset(CLOSERS)
_MAX_LONG = 2**63 - 1


@cache
def _word() -> str:
    """A class of the characters that (?U)\\w matches in Java: marks and connectors too, but no fractions."""
    spans, kinds = [], {"Lu", "Ll", "Lt", "Lm", "Lo", "Nl", "Nd", "Mn", "Me", "Mc", "Pc"}
    circled = [range(0x24B6, 0x24EA), range(0x1F130, 0x1F14A), range(0x1F150, 0x1F16A), range(0x1F170, 0x1F18A)]
    for c in range(sys.maxunicode + 1):
        if unicodedata.category(chr(c)) in kinds or c in (0x200C, 0x200D) or any(c in r for r in circled):
            if spans and spans[-1][1] == c - 1:
                spans[-1][1] = c
            else:
                spans.append([c, c])
    return "[" + "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in spans) + "]"


class Patterns:
    """The patterns for texts of ASCII alone, or for all."""

    def __init__(self, ascii: bool):
        def made(pattern: str, flags: int = 0) -> re.Pattern:
            pattern = pattern.replace("(?U)", "").replace("(?Ui)", "(?i)").replace("(?Um)", "(?m)")
            if not ascii:
                pattern = pattern.replace(r"\bDated", f"(?<!{_word()})Dated").replace(r"\s", r"[^\S\x1c-\x1f]").replace(r"\w", _word())
            return re.compile(pattern, flags | (re.ASCII if ascii else 0))

        self.header, self.noisy = made(patterns.HEADER), made(patterns.NOISY_HEADER.replace(r"[\s|]", r"(?:\s|[|])"))
        self.furniture = made(rf"\s*+(?:{patterns.EXACT_CASE}|(?i:{patterns.ANY_CASE}))\s*$")
        self.near, self.far = (made("(?i)" + "|".join(p for p, d in patterns.TRAILERS if d == n)) for n in (10, 20))
        self.body_start, self.serial = made(body.BODY_START), made(r"(?i)S/No[.]?\s+Name")
        self.numbered = made(r"(?i)S[.]?\s*/?\s*No[.]?")
        self.dated, self.signature = made(patterns.DATED), made(patterns.SIGNATURE)
        self.mid_capital = made(patterns.MID_CAPITAL)


@cache
def _patterns(ascii: bool) -> Patterns:
    return Patterns(ascii)


def patterns_for(text: str) -> Patterns:
    return _patterns(text.isascii())


_PLAIN = re.compile(patterns.PLAIN_HEADER, re.ASCII)


def without_furniture(lines: list[str], ps: Patterns) -> list[str]:
    match = ps.furniture.match
    return [x for x in lines if not match(x)]


def strict_headers(lines: list[str], ps: Patterns) -> tuple[list[tuple[int, str, str]], list[int]]:
    """Lines that are a header and nothing else, as (at, no, kind); and all that a header's pattern could match."""
    named = [i for i, x in enumerate(lines) if "GAZET" in x]
    found = ((i, ps.header.match(lines[i].strip())) for i in named)
    return [(i, m[1], "strict") for i, m in found if m], named


def recovered_headers(lines: list[str], strict: list[tuple[int, str, str]], named: list[int], ps: Patterns, min_gap: int = patterns.MIN_GAP) -> list[tuple[int, str, str]]:
    """Headers within noisy lines, in gaps of more than min_gap lines after a strict one."""
    spots, seen, out = [at for at, _, _ in strict], {no for _, no, _ in strict}, []
    for at in named:
        k = bisect_left(spots, at)
        if k == 0 or (k < len(spots) and spots[k] == at):
            continue
        after = spots[k] if k < len(spots) else len(lines)
        if after - spots[k - 1] > min_gap:
            fresh = next((m[1] for m in ps.noisy.finditer(lines[at]) if m[1] not in seen), None)
            if fresh is not None:
                seen.add(fresh)
                out.append((at, fresh, "recovered"))
    return out


class Piece:
    """A header's own stretch of lines, before stitching; its parts are made when asked for."""

    def __init__(self, idx: int, no: str | None, kind: str, start: int, end: int, header_line: str | None, raw: list[str], ps: Patterns):
        self.notice_idx, self.notice_no, self.header_match, self.line_start, self.line_end, self.header_line, self.raw, self.ps = idx, no, kind, start, end, header_line, raw, ps
        self.bare = kind == "none"
        self.header = None if self.bare else header_line.strip() if kind == "strict" else f"GAZETTE NOTICE NO. {no}"
        self._chunk = self._text = self._stack = None

    @property
    def chunk(self) -> list[str]:
        if self._chunk is None:
            self._chunk = self.raw if self.bare else without_furniture(self.raw, self.ps)
        return self._chunk

    @property
    def full_text(self) -> str:
        if self._text is None:
            self._text = body_text(self.header, self.chunk)
        return self._text

    @property
    def stack(self) -> tuple[list[str], list[str]] | None:
        if self._stack is None and not self.bare:
            self._stack = title_stack(self.chunk, self.ps)
        return self._stack

    @property
    def title_lines(self) -> list[str]:
        return [] if self.bare else [x.strip() for x in self.stack[0]]

    @property
    def body_segments(self) -> list[tuple[str, list[str]]]:
        return [] if self.bare else segment_lines(self.stack[1] or self.chunk, self.ps)

    @property
    def derived_table(self) -> dict | None:
        return None if self.bare else serial_table(self.chunk, self.ps)


def pieces(text: str | None) -> list[Piece]:
    if not text or text.isspace():
        return []
    lines, ps = text.splitlines(), patterns_for(text)
    strict, named = strict_headers(lines, ps)
    if not strict:
        return [Piece(0, None, "none", 0, len(lines), None, [text], ps)]
    more = recovered_headers(lines, strict, named, ps)
    found = sorted(strict + more) if more else strict
    ends = [at for at, _, _ in found[1:]] + [len(lines)]
    return [Piece(i, no, kind, at, end, lines[at], lines[at + (kind == "strict") : end], ps) for i, ((at, no, kind), end) in enumerate(zip(found, ends))]


def body_text(header: str | None, chunk: list[str]) -> str:
    whole = "\n".join(chunk).strip()
    return whole if header is None else f"{header}\n{whole}" if whole else header


def title_stack(chunk: list[str], ps: Patterns) -> tuple[list[str], list[str]]:
    """The heading lines, and what follows them."""
    first = None
    for i, x in enumerate(chunk):
        s = x.strip()
        if first is None:
            if not s:
                continue
            first = i
        if not s:
            return chunk[first:i], chunk[i + 1 :]
        if ps.body_start.match(s):
            return chunk[first:i], chunk[i:]
    return ([], []) if first is None else (chunk[first:], [])


_RUNS = re.compile(body.RUNS)
_SENTENCE = re.compile("[A-Z][a-z]")


def segment_lines(lines: list[str], ps: Patterns) -> list[tuple[str, list[str]]]:
    """Runs of blank, table and text lines, as body.segment_lines() has them."""

    def letter(x: str) -> str:
        s = x.strip()
        if not s:
            return "B"
        if "  " in s:
            return "T" if not _SENTENCE.match(s) or ps.numbered.match(s) else "W"
        return "S" if len(x) < 100 else "L"

    at, out = 0, []
    for run in _RUNS.findall("".join(map(letter, lines))):
        if run == "B":
            out.append(("blank", []))
        else:
            out.append(("table" if run[:2] in ("TT", "TW", "TS") else "text", lines[at : at + len(run)]))
        at += len(run)
    return out


def serial_table(chunk: list[str], ps: Patterns) -> dict | None:
    likely = "/" in "".join(chunk) and any("/" in x and ps.serial.match(x.strip()) for x in chunk)
    return body.parse_serial_table(chunk) if likely else None


def ends_clean(text: str) -> bool:
    return text.rstrip()[-1:] in _CLOSERS


class Notice:
    """Pieces that belong together, cut where the trailer begins."""

    def __init__(self, idx: int, ps: list[Piece], next_start: int | None):
        self.notice_idx, self.ps, self.next_start = idx, ps, next_start
        first, last = ps[0], ps[-1]
        self.first, self.patterns = first, first.ps
        self.notice_no, self.header, self.header_match, self.line_start, self.line_end = first.notice_no, first.header, first.header_match, first.line_start, first.line_end
        self.end_line, self.left = last.line_end, None
        self._text = self._segments = self._table = None

    def trim(self) -> Notice:
        """The last notice of a document, without prices, indexes and advertisements."""
        at = None if self.next_start is not None or self.first.bare else trailer_at(self.first.raw, self.header_match, self.patterns)
        if at is not None and at < self.line_end - self.line_start:
            self.left = without_furniture(self.first.raw[: max(at - (self.header_match == "strict"), 0)], self.patterns)
            self.line_end = self.end_line = self.line_start + at
        return self

    @property
    def full_text(self) -> str:
        if self._text is None:
            self._text = "\n".join(p.full_text for p in self.ps) if self.left is None else body_text(self.header, self.left)
        return self._text

    @property
    def body_segments(self) -> list[tuple[str, list[str]]]:
        if self._segments is None:
            self._segments = [s for p in self.ps for s in p.body_segments] if self.left is None else segment_lines(self.left, self.patterns)
        return self._segments

    @property
    def derived_table(self) -> dict | None:
        if self._table is None:
            self._table = (self.first.derived_table,)
        return self._table[0]

    @property
    def title_lines(self) -> list[str]:
        return self.first.title_lines

    @property
    def raw(self) -> list[str]:
        return self.first.raw

    @property
    def raw_header_line(self) -> str | None:
        return None if self.first.bare else self.first.header_line.strip()

    @property
    def stitched_from(self) -> list[str]:
        return [p.notice_no for p in self.ps[1:]]

    @property
    def lines_in_body(self) -> int:
        return sum(len(p.chunk) for p in self.ps) if self.left is None else len(self.left)

    @property
    def content_sha256(self) -> str:
        return hashlib.sha256(self.full_text.encode()).hexdigest()

    @property
    def scored(self) -> tuple[dict[str, float | None], list[str]]:
        if "_scored" not in self.__dict__:
            self._scored = score(self)
        return self._scored

    @property
    def confidence_scores(self) -> dict[str, float | None]:
        return self.scored[0]

    @property
    def confidence_reasons(self) -> list[str]:
        return self.scored[1]


def trailer_at(raw: list[str], kind: str, ps: Patterns) -> int | None:
    """Lines from the header to the first that ends the notices, or None."""
    shift = int(kind == "strict")
    for i in range(10 - shift, len(raw)):
        s = raw[i].strip()
        if ps.near.search(s) or (i + shift >= 20 and ps.far.search(s)):
            return i + shift
    return None


def stitched(text: str | None) -> list[Notice]:
    ps = pieces(text)
    firsts = [i for i, p in enumerate(ps) if i == 0 or p.header_match != "recovered" or ends_clean(ps[i - 1].full_text)]
    ends = [*firsts[1:], len(ps)]
    return [Notice(k, ps[i:j], ps[j].line_start if j < len(ps) else None) for k, (i, j) in enumerate(zip(firsts, ends))]


def split(text: str | None) -> list[Notice]:
    return [n.trim() for n in stitched(text)]


class Plain:
    """A notice of the plainer split."""

    def __init__(self, idx: int, no: str, lines: list[str], ps: Patterns):
        self.notice_idx, self.notice_no, self.body_lines, self.ps = idx, no, lines, ps
        self.stack = title_stack(lines, ps)
        self.title_lines = [x.strip() for x in self.stack[0]]

    @property
    def body_text(self) -> str:
        return "\n".join(self.body_lines).strip()

    @property
    def derived_table(self) -> dict | None:
        return serial_table(self.body_lines, self.ps)

    @property
    def body_segments(self) -> list[tuple[str, list[str]]]:
        return segment_lines(self.stack[1] or self.body_lines, self.ps)


def plain(text: str | None, strip_headers: bool) -> list[Plain]:
    if not text or text.isspace():
        return []
    lines, ps = text.splitlines(), patterns_for(text)
    found = [(i, m[1]) for i, m in ((i, _PLAIN.match(x.strip())) for i, x in enumerate(lines) if "GAZET" in x) if m]
    ends = [at for at, _ in found[1:]] + [len(lines)]
    raws = (lines[at + 1 : end] for (at, _), end in zip(found, ends))
    return [Plain(i, no, without_furniture(raw, ps) if strip_headers else raw, ps) for i, ((_, no), raw) in enumerate(zip(found, raws))]


def plain_of(strip_headers: bool) -> Callable[[str | None], list[Plain]]:
    return partial(plain, strip_headers=strip_headers)


# Scores: those of scoring.py, term by term in the same order.


def _clip(x: float) -> float:
    return max(0.0, min(1.0, x))


_NUMBERS = [
    (re.compile(r"[0-9]{2,6}\Z"), 1.0, None),
    (re.compile(r"[0-9]+/[0-9]{4}\Z"), 0.6, "notice number in year/number form"),
    (re.compile(r"[0-9]+[A-Za-z]\Z"), 0.5, "notice number has trailing letter"),
    (re.compile(r"[0-9]{7,}\Z"), 0.4, "notice number is unusually long"),
    (re.compile(r"[0-9]\Z"), 0.3, "single-digit notice number is suspicious"),
    (re.compile(r"[^0-9]+\Z"), 0.1, "notice number has no digits"),
]


def notice_number(no: str | None) -> tuple[float, list[str]]:
    s = (no or "").strip()
    if not s:
        return 0.0, ["empty notice number"]
    for test, value, why in _NUMBERS:
        if test.match(s):
            return value, [why] if why else []
    return 0.3, ["notice number has unexpected shape"]


_OTHER_ENDS = re.compile("\r\n|[\r\x85  ]")


def structure(text: str, low: str, n_lines: int, titled: bool, table: bool, ps: Patterns) -> tuple[float, list[str]]:
    n = len(text)
    signals = any(m in low for m in patterns.MARKERS)
    signals += "dated" in low and ps.dated.search(text) is not None
    signals += ps.signature.search(text if text.isascii() and "\r" not in text else _OTHER_ENDS.sub("\n", text)) is not None
    size, none, one = f"{n} chars)", signals == 0 and not table, signals == 1 and not table
    score, why = 1.0, []
    for hit, loss, reason in (
        (n < 50, 0.6, f"body very short ({size}"),
        (50 <= n < 120, 0.2, f"body short ({size}"),
        (n > 100_000, 0.3, f"body very long ({size} -- possible merge"),
        (n_lines <= 2, 0.4, "only header/no body content"),
        (none, 0.3, "no legal marker, date, or signature found"),
        (one, 0.1, "only one structural marker present"),
        (not titled, 0.05, "no title lines extracted"),
    ):
        if hit:
            score -= loss
            why.append(reason)
    return _clip(score), why


_WORDS = re.compile(r"\w+")
_LETTERS = bytes(c if chr(c).isalnum() or c == ord("_") else ord(" ") for c in range(128)) + b" " * 128


def words_of(low: str) -> list:
    """Words of a text in lower case: as bytes where it is ASCII, which is much faster, and only compared with each other."""
    return low.encode().translate(_LETTERS).split() if low.isascii() else _WORDS.findall(low)


def repeated_grams(words: list, width: int = 6) -> int:
    if len(set(zip(*[words[k:] for k in range(width)]))) == max(len(words) - width + 1, 0):
        return 0
    return sum(c > 1 for c in Counter(zip(*[words[k:] for k in range(width)])).values())


def _lower_first(x: str) -> bool:
    c = x[0]
    return "a" <= c <= "z" if c < "\x80" else unicodedata.category(c) == "Ll"


def spatial(text: str, low: str, lines: list[str], ps: Patterns) -> tuple[float, list[str]]:
    """lines: those that aren't blank, stripped."""
    if text == "":
        return 0.0, ["empty text"]
    if len(lines) < 2:
        return 1.0, []
    words = words_of(low)
    n = len(words)
    repeats = repeated_grams(words) if n > 50 else 0
    caps = len(ps.mid_capital.findall(text)) if n > 100 else 0
    breaks = sum(1 for a, b in zip(lines, lines[1:]) if a[-1] not in _STOPS and _lower_first(b))
    density, score, why = caps / max(1, n), 1.0, []
    if breaks >= 3:
        score -= min(0.5, breaks * 0.1)
        why.append(f"{breaks} mid-sentence breaks (possible column interleaving)")
    if repeats >= 3:
        score -= min(0.3, repeats * 0.05)
        why.append(f"{repeats} repeated 6-grams (possible column merge)")
    if density > 0.10 and caps > 20:
        score -= min(0.15, density * 0.5)
        why.append(f"high mid-sentence cap density {round(density, 2):.2f} ({caps}/{n} words)")
    return _clip(score), why


def boundary(kind: str, text: str, start: int, end: int, next_start: int | None) -> tuple[float, list[str]]:
    score, why = {"strict": (1.0, None), "recovered": (0.6, "header recovered from noisy line (capped at 0.6)"), "inferred": (0.4, "header inferred (capped at 0.4)")}.get(kind, (0.2, "no notice header found"))
    why, span, gap = [why] if why else [], end - start, None if next_start is None else next_start - end
    if span <= 1:
        score -= 0.4
        why.append("span is a single line")
    elif span < 3:
        score -= 0.2
        why.append("span is very short")
    if not ends_clean(text):
        score -= 0.15
        why.append("text does not end with terminal punctuation")
    if gap is not None and gap > 20:
        score -= 0.2
        why.append(f"gap of {gap} lines to next notice -- possible missing content")
    return _clip(score), why


def table_score(table: dict | None) -> tuple[float | None, list[str]]:
    if table is None:
        return None, []
    rows, repairs = table["rows"], len(table["repairs"])
    if not rows:
        return 0.2, ["derived_table has no rows"]
    digits = (s for s in (r["s_no"].strip() for r in rows) if s and s.isascii() and s.isdigit())
    serials = [n for n in map(int, digits) if n <= _MAX_LONG]
    jumps = sum(b - a != 1 for a, b in zip(serials, serials[1:]))
    lengths = [len(r["name"].strip()) for r in rows if r["name"]]
    mean = sum(lengths) / max(len(lengths), 1)
    odd = bool(lengths) and sum(x > mean * 3 for x in lengths) >= max(1, len(rows) // 10)
    score, why = 1.0, []
    if repairs:
        score -= min(0.3, repairs * 0.05)
        why.append(f"{repairs} merged-row repairs applied")
    if jumps:
        score -= min(0.3, jumps * 0.05)
        why.append(f"{jumps} non-sequential serial jumps")
    if odd:
        score -= 0.15
        why.append("some cells dramatically longer than others (likely merged)")
    return _clip(score), why


def composite(s: dict[str, float | None]) -> float:
    base = s["notice_number"] * 0.30 + s["structure"] * 0.25 + s["spatial"] * 0.25 + s["boundary"] * 0.20
    return _clip(base) if s["table"] is None else _clip(base * 0.85 + s["table"] * 0.15)


def score(n: Notice) -> tuple[dict[str, float | None], list[str]]:
    """Scores and reasons; parts are rounded before the composite is formed."""
    text, ps = n.full_text, n.patterns
    low, lines = text.lower(), [s for s in map(str.strip, text.splitlines()) if s]
    has_table = n.derived_table is not None or ("  " in text and any(kind == "table" for kind, _ in n.body_segments))
    found = {
        "notice_number": notice_number(n.notice_no),
        "structure": structure(text, low, len(lines), bool(n.title_lines), has_table, ps),
        "spatial": spatial(text, low, lines, ps),
        "boundary": boundary(n.header_match, text, n.line_start, n.line_end, n.next_start),
        "table": table_score(n.derived_table),
    }
    scores = {k: None if s is None else round(s, 3) for k, (s, _) in found.items()}
    scores["composite"] = round(composite(scores), 3)
    return scores, [f"{k}: {x}" for k, (_, why) in found.items() for x in why]


def cap_by_ocr(n: Notice, ocr: float | None) -> float | None:
    """Holds the boundary of a strict notice of a badly scanned document at 0.6; gives the OCR quality it then carries."""
    if ocr is None or ocr >= 0.5 or n.header_match != "strict":
        return None
    scores, why = n.scored
    if scores["boundary"] > 0.6:
        scores["boundary"] = 0.6
        scores["composite"] = round(composite(scores), 3)
        why.append("boundary: capped at 0.6 due to low OCR quality")
    return ocr


# Fields of the rows that are made, with their types, and how a list of values becomes an array.

_STRINGS = pa.list_(pa.string())
_SCORES = ("notice_number", "structure", "spatial", "boundary", "table", "composite")
_CELL = pa.struct([("s_no", pa.string()), ("name", pa.string()), ("position", pa.string())])
TABLE = pa.struct([("format", pa.string()), ("rows", pa.list_(_CELL)), ("repairs", _STRINGS)])
SEGMENTS = pa.list_(pa.struct([("type", pa.string()), ("lines", _STRINGS)]))
FIELDS: dict[str, tuple[str, pa.DataType]] = {
    **{k: ("int", pa.int32()) for k in ("notice_idx", "line_start", "line_end", "next_start", "end_line", "lines_in_body")},
    **{k: ("string", pa.string()) for k in ("notice_no", "header", "header_match", "header_line", "full_text", "raw_header_line", "body_text", "content_sha256")},
    **{k: ("array<string>", _STRINGS) for k in ("raw", "chunk", "title_lines", "stitched_from", "body_lines", "confidence_reasons")},
    "body_segments": (body.SEGMENTS, SEGMENTS),
    "derived_table": (body.TABLE, TABLE),
    "confidence_scores": ("struct<" + ",".join(f"{k}:double" for k in _SCORES) + ">", pa.struct([(k, pa.float64()) for k in _SCORES])),
}


@contextmanager
def _no_cycles() -> Iterator[None]:
    """Without the search for cycles of references, which go through all notices again and again; there are none."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


def _offsets(sizes: Iterator[int]) -> pa.Array:
    out, at = [0], 0
    for n in sizes:
        at += n
        out.append(at)
    return pa.array(out, pa.int32())


def lists_of(lists: list[list], values: Callable[[list], pa.Array]) -> pa.Array:
    """An array of lists, none of them null, by one flat array of what is in them."""
    return pa.ListArray.from_arrays(_offsets(map(len, lists)), values(list(chain.from_iterable(lists))))


def strings(xs: list) -> pa.Array:
    return pa.array(xs, pa.string())


def _segments(flat: list[tuple[str, list[str]]]) -> pa.Array:
    kinds, lines = strings([k for k, _ in flat]), lists_of([x for _, x in flat], strings)
    return pa.StructArray.from_arrays([kinds, lines], ["type", "lines"])


def _scores(values: list[dict]) -> pa.Array:
    return pa.StructArray.from_arrays([pa.array([v[k] for v in values], pa.float64()) for k in _SCORES], list(_SCORES))


def column(name: str, values: list) -> pa.Array:
    kind = FIELDS[name][1]
    if name == "body_segments":
        return lists_of(values, _segments)
    if name == "confidence_scores":
        return _scores(values)
    return lists_of(values, strings) if kind == _STRINGS else pa.array(values, kind)


def ddl(fields: tuple[str, ...]) -> str:
    return "array<struct<" + ",".join(f"{f}:{FIELDS[f][0]}" for f in fields) + ">>"


def rows(of: Callable[[str | None], list], fields: tuple[str, ...]) -> Callable[[pa.Array], pa.Array]:
    """For an array of texts, lists of structs of these fields of what of() finds in each."""

    def run(texts: pa.Array) -> pa.Array:
        sizes, values = [], [[] for _ in fields]
        with _no_cycles():
            for text in texts:
                found = of(text.as_py())
                sizes.append(len(found))
                for f, out in zip(fields, values):
                    out += [getattr(n, f) for n in found]
        made = pa.StructArray.from_arrays([column(f, v) for f, v in zip(fields, values)], list(fields))
        return pa.ListArray.from_arrays(_offsets(iter(sizes)), made)

    return run


_NO_MARK = "no GAZETTE NOTICE NO. markers found; entire text returned as one block"
_COLUMNS = ["s_no", "name", "position"]
_RECORD_TABLE = pa.struct([("columns", _STRINGS), ("rows", pa.list_(_STRINGS)), ("notice_id", pa.string()), ("format", pa.string()), ("repairs", _STRINGS)])


def _record_table(n: Notice, notice_id: str | None) -> dict | None:
    table = n.derived_table
    return table and {"columns": _COLUMNS, "rows": [[r[c] for c in _COLUMNS] for r in table["rows"]], "notice_id": notice_id, "format": table["format"], "repairs": table["repairs"]}


def _attributes(n: Notice) -> list[tuple[str, str]]:
    if n.first.bare:
        return [("reason", _NO_MARK)]
    return [("char_span_start_line", str(n.line_start)), ("char_span_end_line", str(n.end_line)), ("lines_in_body", str(n.lines_in_body))]


def records(texts: pa.Array, issues: pa.Array, ocrs: pa.Array) -> pa.Array:
    """For texts, the key of their issue and their OCR quality: the notices of split() as nested records, scored; and the rank of each table segment's notice."""
    sizes, flat, tables = [], [], []
    with _no_cycles():
        for text, issue, ocr in zip(texts, issues.to_pylist(), ocrs.to_pylist()):
            found, lost = split(text.as_py()), []
            sizes.append(len(found))
            for n in found:
                carried = cap_by_ocr(n, ocr)
                lost += [n.notice_idx for kind, _ in n.body_segments if kind == "table"]
                flat.append((n, issue, None if issue is None else f"{issue}:{n.notice_no if n.notice_no is not None else f'_orphan_{n.line_start}'}", carried))
            tables.append(lost)
    ns = [n for n, *_ in flat]

    def ints(xs: list[int]) -> pa.Array:
        return pa.array(xs, pa.int32())

    provenance = {
        "header_match": column("header_match", [n.header_match for n in ns]),
        "line_span": pa.ListArray.from_arrays(_offsets(2 for _ in ns), ints([x for n in ns for x in (n.line_start, n.line_end)])),
        "raw_header_line": column("raw_header_line", [n.raw_header_line for n in ns]),
        "stitched_from": column("stitched_from", [n.stitched_from for n in ns]),
        "ocr_quality": pa.array([ocr for *_, ocr in flat], pa.float64()),
    }
    made = {
        "notice_id": strings([i for _, _, i, _ in flat]),
        "gazette_issue_id": strings([i for _, i, _, _ in flat]),
        "gazette_notice_no": strings([n.notice_no for n in ns]),
        "gazette_notice_header": strings([n.header for n in ns]),
        "title_lines": column("title_lines", [n.title_lines for n in ns]),
        "gazette_notice_full_text": strings([n.full_text for n in ns]),
        "body_segments": column("body_segments", [[("text" if kind == "table" else kind, lines) for kind, lines in n.body_segments] for n in ns]),
        "derived_table": pa.array([_record_table(n, i) for n, _, i, _ in flat], _RECORD_TABLE),
        "other_attributes": pa.array([_attributes(n) for n in ns], pa.map_(pa.string(), pa.string())),
        "provenance": pa.StructArray.from_arrays(list(provenance.values()), list(provenance)),
        "confidence_scores": column("confidence_scores", [n.confidence_scores for n in ns]),
        "confidence_reasons": column("confidence_reasons", [n.confidence_reasons for n in ns]),
        "content_sha256": strings([n.content_sha256 for n in ns]),
    }
    notices = pa.ListArray.from_arrays(_offsets(iter(sizes)), pa.StructArray.from_arrays(list(made.values()), list(made)))
    return pa.StructArray.from_arrays([notices, lists_of(tables, ints)], ["notices", "tables"])


def header_marks(recovered: bool) -> Callable[[pa.Array], pa.Array]:
    """For texts, lists of the strict or the recovered headers, as structs (at, no)."""

    def run(texts: pa.Array) -> pa.Array:
        out = []
        for text in texts.to_pylist():
            lines, ps = (text or "").splitlines(), patterns_for(text or "")
            strict, named = strict_headers(lines, ps)
            out.append(recovered_headers(lines, strict, named, ps) if recovered else strict)
        flat = list(chain.from_iterable(out))
        marks = pa.StructArray.from_arrays([pa.array([at for at, _, _ in flat], pa.int32()), strings([no for _, no, _ in flat])], ["at", "no"])
        return pa.ListArray.from_arrays(_offsets(map(len, out)), marks)

    return run


def kept_lines(texts: pa.Array) -> pa.Array:
    """How many lines of each text are no furniture."""
    return pa.array([None if t is None else len(without_furniture(t.splitlines(), patterns_for(t))) for t in texts.to_pylist()], pa.int64())
