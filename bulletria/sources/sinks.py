"""Output bundles: which projections of the envelopes are written, one folder each."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path

import pyarrow as pa
from pyarrow import fs as pa_fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.envelope import index_rows
from ..operators.fields import highlight_notices


@dataclass(frozen=True)
class Bundles:
    """What to write. Without any choice: records, notices and corrections."""

    notices: bool = True
    corrigenda: bool = True
    document_index: bool = False
    spatial_markdown: bool = False
    full_text: bool = False
    tables: bool = False
    debug_trace: bool = False
    images: bool = False
    gazette_spatial_json: bool = True
    docling_markdown: bool = False
    docling_json: bool = False


@dataclass(frozen=True)
class ModelPolicy:
    """Accepted and stored; parsing doesn't look at it."""

    mode: str = "disabled"
    model: str = ""
    api_key_env: str = ""
    stages: Mapping[str, bool] = field(default_factory=dict)
    cache_dir: str | None = None

    def __post_init__(self) -> None:
        if self.mode not in ("disabled", "optional", "required"):
            raise ValueError(f"unknown mode {self.mode!r}")


@dataclass(frozen=True)
class Runtime:
    deterministic: bool = False
    timeout_seconds: float | None = None
    include_full_docling_dict: bool = False


@dataclass(frozen=True)
class Config:
    llm: ModelPolicy = field(default_factory=ModelPolicy)
    runtime: Runtime = field(default_factory=Runtime)
    bundles: Bundles = field(default_factory=Bundles)


NAMES = tuple(f.name for f in fields(Bundles))
#: Those that need the source's own text or layout, with the column it is in.
RAW = {"full_text": "plain_text", "docling_markdown": "markdown", "spatial_markdown": "text", "docling_json": "layout_json"}
#: What is written where no choice is given at all.
LEGACY = ("gazette_spatial_json", "full_text", "docling_markdown", "spatial_markdown", "docling_json")


def resolve(bundles: Bundles | Mapping[str, bool] | None) -> list[str]:
    """Names of the chosen bundles; unknown ones are an error."""
    if bundles is None:
        return list(LEGACY)
    chosen = asdict(bundles) if isinstance(bundles, Bundles) else dict(bundles)
    if unknown := sorted(set(chosen) - set(NAMES)):
        raise ValueError(f"unknown bundles: {unknown}")
    return [n for n in NAMES if chosen.get(n)]


def _exploded(envelopes: DataFrame, name: str) -> DataFrame:
    return envelopes.select("doc_id", F.posexplode(name).alias("position", "item")).select("doc_id", "position", "item.*")


def project(envelopes: DataFrame, name: str, sources: DataFrame | None = None) -> DataFrame:
    """The rows of one bundle.

    sources: (doc_id, and the column that RAW names) for bundles that need it.
    """
    if name == "images":
        raise NotImplementedError("images aren't extracted")
    if name in RAW:
        if sources is None:
            raise ValueError(f"{name} needs the source documents")
        value = F.col(RAW[name])
        return sources.select("doc_id", (highlight_notices(value) if name.endswith("markdown") else value).alias("value"))
    if name == "gazette_spatial_json":
        return envelopes
    if name in ("notices", "corrigenda"):
        return _exploded(envelopes, name)
    if name == "document_index":
        return index_rows(envelopes)
    if name == "tables":
        return _exploded(envelopes, "notices").where("derived_table is not null").select("doc_id", "position", "notice_id", "gazette_notice_no", "derived_table")
    if name == "debug_trace":
        why = F.transform("notices", lambda n: F.struct(n["notice_id"].alias("notice_id"), n["confidence_scores"].alias("confidence_scores"), n["confidence_reasons"].alias("confidence_reasons")))
        return envelopes.select("doc_id", "warnings", "layout_info", why.alias("notices"))
    raise ValueError(f"unknown bundle {name!r}")


def write_bundles(envelopes: DataFrame, out_dir: str, bundles: Bundles | Mapping[str, bool] | None = None, sources: DataFrame | None = None) -> dict[str, str]:
    """Write each chosen bundle as JSON lines; returns its folder.

    All choices are checked before anything is written.
    """
    rows = {name: project(envelopes, name, sources) for name in resolve(bundles)}
    for name, df in rows.items():
        df.write.mode("overwrite").json(f"{out_dir}/{name}", ignoreNullFields=False)
    return {name: f"{out_dir}/{name}" for name in rows}


#: Ends of the names of a document's files, by bundle; texts are written as they are, everything else as JSON.
FILES = {
    "gazette_spatial_json": "_gazette_spatial.json", "notices": "_notices.json", "corrigenda": "_corrigenda.json", "document_index": "_index.json", "tables": "_tables.json",
    "debug_trace": "_trace.json", "full_text": ".txt", "docling_markdown": ".md", "spatial_markdown": "_spatial.md", "docling_json": ".json",
}


def _documents(rows: DataFrame, name: str) -> DataFrame:
    """(doc_id, body): what one bundle's file holds of each document."""
    if name in RAW:
        return rows.select("doc_id", F.col("value").cast("string").alias("body"))
    value = F.to_json(F.struct(*[F.col(c) for c in rows.columns if c not in ("doc_id", "position")]), {"ignoreNullFields": "false"})
    if name in ("notices", "corrigenda", "tables"):
        listed = rows.select("doc_id", F.struct("position", value.alias("v")).alias("x")).groupBy("doc_id").agg(F.sort_array(F.collect_list("x")).alias("xs"))
        return listed.select("doc_id", F.concat(F.lit("["), F.array_join(F.transform("xs", lambda x: x["v"]), ","), F.lit("]")).alias("body"))
    return rows.select("doc_id", value.alias("body"))


def _write(base: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = pa_fs.FileSystem.from_uri(base)
        for batch in batches:
            for path, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                system.create_dir(f"{root}/{path}".rpartition("/")[0], recursive=True)
                with system.open_output_stream(f"{root}/{path}") as out:
                    out.write(body.encode())
            yield batch.select([0])

    return run


def write_files(envelopes: DataFrame, out_dir: str, bundles: Bundles | Mapping[str, bool] | None = None, sources: DataFrame | None = None) -> DataFrame:
    """Write a file for each document and chosen bundle, in a folder a document; returns (path) of each.

    Files are named by doc_id, or, where it is null or blank, by the first twelve
    characters of pdf_sha256. out_dir is a URI, or a path that all executors
    share. A file that is written again, after a failure, is overwritten whole.
    Bundles without a row for a document (no table, no correction) have no file.
    """
    plain = F.regexp_replace(F.col("doc_id").cast("string"), r"[/\\]", "_")
    stems = envelopes.select("doc_id", F.when(F.coalesce(F.trim(plain), F.lit("")) == "", F.left("pdf_sha256", F.lit(12))).otherwise(plain).alias("stem"))
    parts = []
    for name in resolve(bundles):
        named = _documents(project(envelopes, name, sources), name).join(stems.withColumnRenamed("doc_id", "_of"), F.col("doc_id").eqNullSafe(F.col("_of")))
        parts.append(named.where("body is not null").select(F.concat(F.col("stem"), F.lit("/"), F.col("stem"), F.lit(FILES[name])).alias("path"), "body"))
    base = out_dir if "://" in out_dir else Path(out_dir).resolve().as_uri()
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    listing = f"{base}/_written"
    every.mapInArrow(_write(base), "path string").write.mode("overwrite").text(listing)
    return envelopes.sparkSession.read.text(listing).withColumnRenamed("value", "path")


def write_report(rows: DataFrame, path: str) -> None:
    """report.report_rows() as CSV."""
    rows.write.mode("overwrite").csv(path, header=True)
