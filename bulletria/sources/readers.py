"""Inputs: laid-out documents as JSON, plain texts, raw files, labels, snapshots."""

from __future__ import annotations

import os
from collections.abc import Iterable
from glob import glob

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from ..operators.identity import file_sha256
from ..operators.layout import LAYOUT_DOCUMENT

SNAPSHOT = "map<string,struct<present:boolean,mean_composite:double,min_composite:double,layout:double,ocr_quality:double,n_notices:int>>"


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def clean_name(name: Column) -> Column:
    """A file name without separators, that ends in .pdf; a default for none."""
    plain = F.regexp_replace(F.coalesce(F.nullif(name, F.lit("")), F.lit("anonymous.pdf")), r"[/\\]", "_")
    return F.when(F.lower(plain).endswith(".pdf"), plain).otherwise(F.concat(plain, F.lit(".pdf")))


def read_files(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """(doc_id, name, path, content, pdf_sha256) of raw files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return named_bytes(files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "path", "content"))


def named_bytes(rows: DataFrame) -> DataFrame:
    """rows of (name, content) with a clean name, doc_id and pdf_sha256; equal bytes under one name give equal rows."""
    named = rows.withColumn("name", clean_name(F.col("name")))
    return named.withColumns({"doc_id": file_stem(F.col("name")), "pdf_sha256": file_sha256(F.col("content"), F.col("name"))})


def read_layouts(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, texts, tables, pages, ...) of layout documents, one JSON text a file; broken files are left out."""
    schema = f"{LAYOUT_DOCUMENT}, _broken string"
    raw = spark.read.schema(schema).json(path, multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_broken", recursiveFileLookup=True)
    return raw.withColumn("doc_id", file_stem(F.col("_metadata.file_path"))).where("_broken is null").drop("_broken")


def read_envelopes(spark: SparkSession, path: str, suffix: str = "_gazette_spatial") -> DataFrame:
    """(doc_id, value): the JSON texts of written envelopes; those that are no JSON objects are left out."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=f"*{suffix}.json")
    named = files.select(F.regexp_replace(file_stem(F.col("_metadata.file_path")), f"{suffix}$", "").alias("doc_id"), "value")
    return named.where(F.json_object_keys("value").isNotNull())


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text) of plain files, with bytes that aren't UTF-8 replaced."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(file_stem(F.col("path")).alias("doc_id"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def first_file(explicit: str | None, variable: str, folders: Iterable[str], pattern: str = "*.pdf") -> str:
    """The named file, that of an environment variable, or the first in the folders."""
    for path in (explicit, os.environ.get(variable)):
        if path and os.path.isfile(path):
            return path
    found = (sorted(glob(os.path.join(folder, pattern))) for folder in folders)
    return next((names[0] for names in found if names), None) or _missing(pattern)


def _missing(what: str) -> str:
    raise FileNotFoundError(f"nothing found for {what}")


def select_files(files: DataFrame, mode: str, names: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """The chosen rows of files (with a column name), with their rank; and the names that aren't there.

    mode "all" keeps every row, and rank grows with the name, with gaps: names are
    sorted in ranges, so no task sees them all. "selected" keeps those of names,
    in their order, each once, by base name where a path is given.
    """
    if mode == "all":
        return files.repartitionByRange("name").sortWithinPartitions("name").withColumn("rank", F.monotonically_increasing_id()), []
    if mode != "selected":
        raise ValueError("mode must be 'all' or 'selected'")
    wanted = list(dict.fromkeys(os.path.basename(n.strip()) for n in names or [] if n.strip()))
    chosen = files.where(F.col("name").isin(wanted)).withColumn("rank", F.array_position(F.array(*[F.lit(n) for n in wanted]) if wanted else F.array(F.lit("")), F.col("name")))
    here = {r["name"] for r in chosen.select("name").distinct().collect()}  # as many as names, at most
    if not here:
        raise ValueError("none of the selected files is there")
    return chosen, [n for n in wanted if n not in here]


def _scalar(raw: Column) -> tuple[Column, Column]:
    """Text of a value, and its kind: str, null, bool, float or int; a comment behind it is dropped."""
    quoted = F.regexp_extract(raw, r"^([\"'])(.*)\1\s*(?:#.*)?$", 2)
    is_quoted = raw.rlike(r"^([\"']).*\1\s*(#.*)?$")
    bare = strip(F.regexp_replace(raw, r"(^|\s+)#.*$", ""))
    kind = (
        F.when(is_quoted, "str")
        .when(bare.isin("", "null", "~"), "null")
        .when(F.lower(bare).isin("true", "false"), "bool")
        .when(bare.contains(".") & bare.try_cast("double").isNotNull(), "float")
        .when(bare.try_cast("bigint").isNotNull(), "int")
        .otherwise("str")
    )
    return F.when(is_quoted, quoted).when(kind == "null", F.lit(None).cast("string")).otherwise(bare), kind


def read_calibration(spark: SparkSession, path: str) -> DataFrame:
    """(record, pdf, notice_no, header, composite, band, is_correct) of a list of hand labels.

    One list of flat mappings, "- " before each first key. A comment behind a
    value isn't part of it.
    """
    files = spark.read.text(path, wholetext=True)
    lines = files.select(F.posexplode(F.split("value", r"\r?\n")).alias("n", "line")).where(~F.col("line").rlike(r"^\s*(#.*)?$"))
    starts = F.col("line").rlike(r"^\s*- ")
    order = Window.orderBy("n")  # one small file of labels
    counted = lines.withColumn("record", F.sum(starts.cast("int")).over(order)).where("record > 0")
    part = F.regexp_replace("line", r"^\s*(?:- )?\s*", "")
    pairs = counted.select("record", strip(F.regexp_extract(part, r"^([^:]+):", 1)).alias("k"), strip(F.regexp_extract(part, r"^[^:]+:(.*)$", 1)).alias("raw")).where("k <> ''")
    value, kind = _scalar(F.col("raw"))
    maps = pairs.select("record", "k", value.alias("v"), kind.alias("t")).groupBy("record").agg(
        *[F.max(F.when(F.col("k") == c, F.col("v"))).alias(c) for c in ("pdf", "notice_no", "header", "band")],
        F.max(F.when(F.col("k") == "composite", F.col("v").try_cast("double"))).alias("composite"),
        F.max(F.when((F.col("k") == "is_correct") & (F.col("t") == "bool"), F.col("v").try_cast("boolean"))).alias("is_correct"),
    )
    return maps.select("record", "pdf", "notice_no", "header", "composite", "band", "is_correct")


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, present, mean_composite, ...) of a snapshot of scores, keyed by document."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", SNAPSHOT)).alias("doc_id", "s")).select("doc_id", "s.*")
