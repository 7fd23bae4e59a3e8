"""The body of a notice: title lines, text and table segments, serial tables."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import is_blank, is_wide, let, strip

BODY_START = "(?Ui)^(?:" + "|".join(
    [r"PURSUANT", r"NOTICE\s+(?:is|OF)", r"IT\s+IS\s+", r"IN\s+(?:EXERCISE|PURSUANCE)\s+", r"WHEREAS\s+", r"TAKE\s+NOTICE\s+", r"THE\s+following\s+"]
) + ")"
SEGMENTS = "array<struct<type:string,lines:array<string>>>"
TABLE = "struct<format:string,rows:array<struct<s_no:string,name:string,position:string>>,repairs:array<string>>"


def title_stack(chunk: Column) -> Column:
    """struct<titles, rest>: the heading lines, and what follows them.

    Headings run from the first line that isn't blank to the next blank one,
    or to one that opens statutory text.
    """
    none = F.expr("cast(array() as array<string>)")
    size = F.size(chunk)

    def cut(s: Column) -> Column:
        first, blank, opens = s["first"], s["blank"], s["opens"]
        stop = F.when(opens > 0, opens - 1).otherwise(blank)  # how many headings there are; 0 for all of the rest
        titles = F.when((first == 0) | (opens == 1), none).when(stop == 0, F.slice(chunk, first, size)).otherwise(F.slice(chunk, first, stop))
        rest = F.when((first == 0) | ((stop == 0) & (opens == 0)), none).otherwise(F.slice(chunk, first + stop + F.when(opens > 0, 0).otherwise(1), size))
        return F.struct(F.coalesce(titles, none).alias("titles"), F.coalesce(rest, none).alias("rest"))

    def opened(s: Column) -> Column:
        heads = F.when(s["first"] == 0, none).when(s["blank"] == 0, F.slice(chunk, s["first"], size)).otherwise(F.slice(chunk, s["first"], s["blank"]))
        opens = F.array_position(F.transform(heads, lambda x: F.coalesce(strip(x).rlike(BODY_START), F.lit(False))), True).cast("int")
        return F.struct(s["first"].alias("first"), s["blank"].alias("blank"), opens.alias("opens"))

    def from_first(blanks: Column) -> Column:
        return let(F.array_position(blanks, False).cast("int"), lambda f: F.struct(f.alias("first"), F.array_position(F.slice(blanks, f + 1, F.size(blanks)), True).cast("int").alias("blank")))

    blanks = F.transform(chunk, lambda x: F.coalesce(is_blank(x), F.lit(False)))
    return F.coalesce(let(let(let(blanks, from_first), opened), cut), F.struct(none.alias("titles"), none.alias("rest")))


#: A line is blank (B), opens a table (T), has columns but doesn't (W), is short (S) or long (L). Each match is a segment.
RUNS = "(B|T[TWS]+|T(?:L[SL]*)?|[WSL][SL]*)"


def segment_lines(lines: Column) -> Column:
    """Runs of blank, table and text lines.

    A table opens at a line of several columns that doesn't begin like a
    sentence (or begins like "S/No."), goes on over lines that have columns or
    are short, and needs two lines; a text ends before a line with columns.
    Each line becomes a letter, and a regular expression finds the runs: the
    work is in proportion to the lines, however many there are.
    """
    nothing = F.expr("cast(array() as array<string>)")
    opens = lambda x: ~x.rlike("^[A-Z][a-z]") | x.rlike(r"(?Ui)^S[.]?\s*/?\s*No[.]?")
    letter = lambda x: (
        F.when(is_blank(x), "B").when(is_wide(x), F.when(opens(strip(x)), "T").otherwise("W")).when(F.length(x) < 100, "S").otherwise("L")
    )

    def cut(marked: Column) -> Column:
        marks = F.filter(F.transform(F.split(marked, ""), lambda c, i: F.when(c == "|", i)), lambda i: i.isNotNull())
        return F.zip_with(marks, F.split(F.substring(marked, 2, 2147483647), r"\|"), lambda at, run: F.struct(at.alias("at"), run.alias("run")))

    def segment(lines: Column, s: Column, i: Column) -> Column:
        kind = F.when(s["run"] == "B", "blank").when(s["run"].rlike("^T[TWS]"), "table").otherwise("text")
        return F.struct(kind.alias("type"), F.when(s["run"] == "B", nothing).otherwise(F.slice(lines, s["at"] - i + 1, F.length(s["run"]))).alias("lines"))

    none = F.expr(f"cast(array() as {SEGMENTS})")

    def whole(lines: Column) -> Column:
        marked = F.regexp_replace(F.array_join(F.transform(lines, letter), ""), RUNS, r"|$1")
        return F.when(F.size(lines) > 0, F.transform(let(marked, cut), lambda s, i: segment(lines, s, i))).when(lines.isNotNull(), none)

    return let(lines, whole)


_TWO = re.compile(r"\s*(\d+)\s+(\d+)\.?\s*")
_GAP = re.compile(r"(?<=\S)\s{2,}(?=\S)")


def parse_serial_table(lines: list[str]) -> dict | None:
    """Rows of a three-column table whose cells came as lines of their own."""
    bare = [x.strip() for x in lines]
    at = next((i for i, x in enumerate(bare) if re.match(r"S/No\.?\s+Name", x, re.I)), None)
    if at is None or at + 1 >= len(bare) or bare[at + 1].lower() != "position":
        return None
    rows, cells = [], iter(bare[at + 2 :])
    for serial in cells:
        if not (re.fullmatch(r"\d+\.?", serial) or _TWO.fullmatch(serial)):
            break
        name = next(cells, None)
        if name is None:
            break
        position = next(cells, None)
        runs_on = position is not None and position.lower().startswith("as ") and len(position) > 80
        rows.append((serial.rstrip("."), name, "" if position is None or runs_on else position))
        if runs_on:
            break
    if not rows:
        return None
    out, repairs = [], []
    for serial, name, position in rows:
        pair = _TWO.fullmatch(serial)
        if pair and int(pair[2]) - int(pair[1]) == 1:
            names, positions = ([*_GAP.split(c, maxsplit=1), ""][:2] for c in (name, position))
            out += [{"s_no": str(int(n)), "name": a, "position": b} for n, a, b in zip(pair.groups(), names, positions)]
            repairs.append(f"split merged row {int(pair[1])}/{int(pair[2])}")
        else:
            out.append({"s_no": serial, "name": name, "position": position})
    return {"format": "s_no_name_position_lines", "rows": out, "repairs": repairs}


def _serial_tables(chunks: pa.Array) -> pa.Array:
    cell = pa.struct([("s_no", pa.string()), ("name", pa.string()), ("position", pa.string())])
    kind = pa.struct([("format", pa.string()), ("rows", pa.list_(cell)), ("repairs", pa.list_(pa.string()))])
    return pa.array([None if c is None else parse_serial_table(c) for c in chunks.to_pylist()], kind)


def serial_table(chunk: Column) -> Column:
    """TABLE, or null. Only chunks with the table's heading go to Python."""
    likely = F.exists(chunk, lambda x: x.contains("/") & strip(x).rlike(r"(?Ui)^S/No[.]?\s+Name"))
    return F.arrow_udf(_serial_tables, TABLE)(F.when(likely, chunk))
