"""Content hashes and composite keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_sha256(content: Column) -> Column:
    return F.sha2(content, 256)


def file_sha256(content: Column, name: Column) -> Column:
    """Of the bytes; of a file that couldn't be read, a name that says so."""
    return F.coalesce(F.sha2(content, 256), F.concat(F.lit("unknown_"), name))


def issue_id(volume: Column, issue_no: Column, date: Column, supplement: Column, sha256: Column) -> Column:
    """The key of an issue; from the content's hash where the masthead lacks a part."""
    known = F.concat_ws("-", F.lit("KE-GAZ"), volume, issue_no.cast("string"), date.cast("string"))
    part = F.when(supplement != 0, F.concat(F.lit("-S"), supplement.cast("string")))
    whole = F.concat(known, F.coalesce(part, F.lit("")))
    return F.when(volume.isNotNull() & issue_no.isNotNull() & date.isNotNull(), whole).otherwise(F.concat(F.lit("KE-GAZ-UNKNOWN-"), F.left(sha256, F.lit(12))))


def notice_id(issue: Column, no: Column, line_start: Column) -> Column:
    """Never from a notice's rank, which shifts; not always unique, so join with line_start."""
    return F.concat(issue, F.lit(":"), F.coalesce(no, F.concat(F.lit("_orphan_"), line_start.cast("string"))))


def extracted_at(fixed: str | None = None) -> Column:
    """Now, in whole seconds; or a given time, for repeatable output."""
    return F.lit(fixed).cast("timestamp") if fixed else F.date_trunc("second", F.current_timestamp())
