"""Lines to notices: headers, spans, texts, stitching, trimming of the trailer, scores.

A document's text goes to Python once, and comes back as a list of its notices
with the fields that are asked for; the lists are then exploded, so none of this
needs a shuffle. What is done to a text is in notices.py.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import settled, split_lines, strip
from . import notices
from .patterns import ANY_CASE, EXACT_CASE, HEADER  # noqa: F401

LINES = ("notice_idx", "notice_no", "header_match", "line_start", "line_end", "header_line", "raw")
CUT = ("notice_idx", "notice_no", "header", "header_match", "line_start", "line_end", "header_line", "raw", "chunk", "full_text", "title_lines", "body_segments", "derived_table")
SPLIT = (
    "notice_idx", "next_start", "notice_no", "header", "header_match", "line_start", "line_end", "raw_header_line", "title_lines", "derived_table", "full_text", "body_segments",
    "stitched_from", "end_line", "lines_in_body",
)
SCORED = (*(f for f in SPLIT if f != "next_start"), "confidence_scores", "confidence_reasons")
PLAIN = ("notice_idx", "notice_no", "title_lines", "derived_table", "body_text", "body_lines", "body_segments")


def header_number(line: Column) -> Column:
    """The number in a strict header line, or an empty string."""
    return F.regexp_extract(strip(line), HEADER, 1)


def is_header(line: Column) -> Column:
    return line.contains("GAZET") & (header_number(line) != "")


def header_marks(text: Column, recovered: bool = False) -> Column:
    """array<struct<at, no>> of the lines that are a header and nothing else; or of those recovered from noisy lines."""
    return F.arrow_udf(notices.header_marks(recovered), "array<struct<at:int,no:string>>")(text)


def kept_lines(text: Column) -> Column:
    """How many lines are no running headers."""
    return F.arrow_udf(notices.kept_lines, "bigint")(text)


def listed(text: Column, of: Callable[[str | None], list], fields: tuple[str, ...]) -> Column:
    """array<struct> of what of() finds in a text, with these fields only: what isn't asked for isn't made."""
    return F.arrow_udf(notices.rows(of, fields), notices.ddl(fields))(text)


def _rows(docs: DataFrame, also: tuple[str, ...], of: Callable[[str | None], list], fields: tuple[str, ...]) -> DataFrame:
    # Without settled() a filter on the list's size would be pushed down, and make the list a second time.
    return settled(docs.select("doc_id", *also, "text"), _found=listed(F.col("text"), of, fields)).select("doc_id", *also, F.inline("_found"))


def notice_lines(docs: DataFrame, fields: tuple[str, ...] = LINES) -> DataFrame:
    """One row a notice, before stitching: number, kind, span, and its raw lines.

    docs: (doc_id, text). Blank texts have no notice; a text without any header
    is one, of kind "none".
    """
    return _rows(docs, (), notices.pieces, fields)


def cut_notices(docs: DataFrame, fields: tuple[str, ...] = CUT) -> DataFrame:
    """notice_lines() with header, text, titles, segments and table of each piece."""
    return _rows(docs, (), notices.pieces, fields)


def stitched_notices(docs: DataFrame, also: tuple[str, ...] = (), fields: tuple[str, ...] = (*SPLIT, "raw")) -> DataFrame:
    """Notices of (doc_id, text, *also) with their rank and the next one's start.

    A recovered notice is joined to the one before when that ends in
    mid-sentence.
    """
    return _rows(docs, also, notices.stitched, fields)


def split_notices(docs: DataFrame, also: tuple[str, ...] = (), fields: tuple[str, ...] = SPLIT) -> DataFrame:
    """All notices of (doc_id, text), in order of notice_idx; each carries its document's other columns that also names.

    What follows the last notice of each document is cut: prices, indexes,
    advertisements.
    """
    return _rows(docs, also, notices.split, fields)


def scored_notices(docs: DataFrame, also: tuple[str, ...] = (), fields: tuple[str, ...] = SCORED) -> DataFrame:
    """split_notices() with confidence_scores and confidence_reasons, as scoring.score_notices() adds them, in the same pass."""
    return _rows(docs, also, notices.split, fields)


def plain_notices(docs: DataFrame, strip_headers: bool = False, compact: bool = False, fields: tuple[str, ...] = PLAIN) -> DataFrame:
    """The plainer split of a text: strict headers alone, nothing recovered, stitched or trimmed.

    compact leaves out the lines and segments. preamble_notices() has what comes
    before the first header.
    """
    wanted = tuple(f for f in fields if not (compact and f in ("body_lines", "body_segments")))
    return _rows(docs, (), notices.plain_of(strip_headers), wanted)


def preamble_notices(docs: DataFrame) -> DataFrame:
    """(doc_id, preamble): the lines before the first strict header, all of them where there is none."""
    lined = docs.select("doc_id", split_lines(F.coalesce("text", F.lit(""))).alias("lines"))
    first = F.array_position(F.transform("lines", is_header), True).cast("int")
    return lined.select("doc_id", F.when(first > 0, F.slice("lines", 1, first - 1)).otherwise(F.col("lines")).alias("preamble"))
