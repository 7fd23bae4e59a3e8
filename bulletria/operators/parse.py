"""From laid-out documents to validated records in one call."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.readers import clean_name, file_stem
from .envelope import build_envelopes
from .fields import document_title, layout_summary
from .identity import file_sha256
from .layout import LAYOUT_DOCUMENT, document_layout, document_text, extract_elements, page_sizes, read_in_row, with_width


def read_order(layouts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text) in reading order, and document_layout(), of (doc_id, texts, tables, pages)."""
    elements = with_width(extract_elements(layouts), page_sizes(layouts))
    return document_text(elements), document_layout(elements)


def parse_layouts(layouts: DataFrame, extracted_at: str | None = None) -> DataFrame:
    """ENVELOPE rows of (doc_id, pdf_sha256, texts, tables, pages); nothing is written.

    A document without any box has an empty text, no notices and a layout
    confidence of 1.
    """
    count = F.coalesce(F.size("pages"), F.lit(0))
    plain = layouts.select("doc_id", "pdf_sha256", F.when(count > 0, count).otherwise(0).alias("_count"), "texts", "tables", "pages")
    return build_envelopes(read_in_row(plain).withColumnRenamed("_count", "pages"), None, extracted_at)


def layouts_of(rows: DataFrame) -> DataFrame:
    """(doc_id, name, pdf_sha256, title, summary, texts, tables, pages) of (name, content): the bytes of layouts in JSON.

    A name gets no separators, and ends in .pdf; content that is no layout is left out.
    """
    named = rows.select(clean_name(F.col("name")).alias("name"), F.col("content").cast("binary").alias("content"))
    parsed = named.withColumn("doc", F.from_json(F.make_valid_utf8(F.col("content").cast("string")), LAYOUT_DOCUMENT)).where("doc.texts is not null or doc.tables is not null or doc.pages is not null")
    stem = file_stem(F.col("name"))
    return parsed.select(
        stem.alias("doc_id"), "name", file_sha256(F.col("content"), F.col("name")).alias("pdf_sha256"), document_title(F.col("doc.texts"), stem).alias("title"),
        layout_summary(F.col("doc")).alias("summary"), "doc.texts", "doc.tables", "doc.pages",
    )


def parse_bytes(rows: DataFrame, extracted_at: str | None = None) -> DataFrame:
    """ENVELOPE rows of (name, content), as parse_files() gives for files of that name and content."""
    return parse_layouts(layouts_of(rows), extracted_at)


def parse_files(spark: SparkSession, path: str, pattern: str = "*.json", extracted_at: str | None = None) -> DataFrame:
    """ENVELOPE rows of the layouts in a folder, one JSON text a file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return parse_bytes(files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content"), extracted_at)
