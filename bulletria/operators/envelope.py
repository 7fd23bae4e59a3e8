"""From documents to validated, nested records, one row each."""

from __future__ import annotations

import json
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import is_blank, settled
from . import fields, identity, scoring
from .notices import records

LIBRARY_VERSION, SCHEMA_VERSION, OUTPUT_FORMAT_VERSION = "0.1.0", "1.0", 1

PROVENANCE = "struct<header_match:string,line_span:array<int>,raw_header_line:string,stitched_from:array<string>,ocr_quality:double>"
NOTICE = (
    "struct<notice_id:string,gazette_issue_id:string,gazette_notice_no:string,gazette_notice_header:string,title_lines:array<string>,"
    "gazette_notice_full_text:string,body_segments:array<struct<type:string,lines:array<string>>>,"
    "derived_table:struct<columns:array<string>,rows:array<array<string>>,notice_id:string,format:string,repairs:array<string>>,"
    f"other_attributes:map<string,string>,provenance:{PROVENANCE},"
    "confidence_scores:struct<notice_number:double,structure:double,spatial:double,boundary:double,table:double,composite:double>,"
    "confidence_reasons:array<string>,content_sha256:string>"
)
CORRIGENDUM = f"struct<scope:string,raw_text:string,provenance:{PROVENANCE},target_notice_no:string,target_year:int,amendment:string>"
WARNING = "struct<kind:string,message:string,where:map<string,string>>"
ENVELOPE = (
    "doc_id string, library_version string, schema_version string, output_format_version int, extracted_at timestamp, pdf_sha256 string, "
    "issue struct<gazette_issue_id:string,masthead_text:string,parse_confidence:double,volume:string,issue_no:int,publication_date:date,supplement_no:int>, "
    f"notices array<{NOTICE}>, corrigenda array<{CORRIGENDUM}>, "
    "document_confidence struct<layout:double,ocr_quality:double,notice_split:double,composite:double,counts:struct<high:int,medium:int,low:int>,"
    "mean_composite:double,min_composite:double,n_notices:int,ocr_reasons:array<string>>, "
    "layout_info struct<layout_confidence:double,pages:array<struct<page_no:int,layout_confidence:double,mode:string,n_bands:int,"
    "bands:array<struct<mode:string,confidence:double,n_elements:int>>>>>, "
    f"warnings array<{WARNING}>, cost struct<llm_calls:int,prompt_tokens:int,completion_tokens:int,usd_estimate:double>"
)

_FALLBACK = "Masthead could not be read in full; the issue's key comes from its content"
_SCOPE = "Corrigendum scope and provenance defaulted"
_TABLE = "Table body segment coerced to text"


def envelope_schema_ddl() -> str:
    return ENVELOPE


def keyed_notices(notices: DataFrame, issues: DataFrame | None = None) -> DataFrame:
    """notices with gazette_issue_id, notice_id and content_sha256; issues: (doc_id, gazette_issue_id), unless notices have it."""
    joined = notices if issues is None else notices.join(issues.select("doc_id", "gazette_issue_id"), "doc_id")
    return joined.withColumns(
        {"notice_id": identity.notice_id(F.col("gazette_issue_id"), F.col("notice_no"), F.col("line_start")), "content_sha256": identity.content_sha256(F.col("full_text"))}
    )


def _warning(kind: str, message: str, where: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), F.lit(message).alias("message"), where.alias("where")).cast(WARNING)


def _scoped(referenced: Column) -> Column:
    return _warning("corrigendum_scope_defaulted", _SCOPE, F.create_map(F.lit("notice_no"), referenced, F.lit("page_no"), F.lit(None).cast("string")))


def _coerced(notice_no: Column, notice_id: Column) -> Column:
    return _warning("table_coerced_to_text", _TABLE, F.create_map(F.lit("notice_no"), notice_no, F.lit("notice_id"), notice_id))


def warnings_of(issues: DataFrame, corrections: DataFrame, notices: DataFrame) -> DataFrame:
    """(doc_id, rank, at, kind, message, where): of the masthead, each correction, each coerced table."""
    nowhere = F.expr("cast(map() as map<string,string>)")
    head = issues.where(F.col("gazette_issue_id").startswith("KE-GAZ-UNKNOWN-")).select("doc_id", F.lit(0).alias("rank"), F.array(F.lit(0), F.lit(0)).alias("at"), _warning("masthead.parse_failed", _FALLBACK, nowhere).alias("w"))
    scoped = corrections.select("doc_id", F.lit(1).alias("rank"), F.array("position", F.lit(0)).alias("at"), _scoped(F.col("referenced_notice_no")).alias("w"))
    tables = notices.select("doc_id", "notice_idx", "notice_no", "notice_id", F.posexplode(F.filter("body_segments", lambda s: s["type"].isNotNull())).alias("i", "s")).where(F.col("s.type") == "table")
    coerced = tables.select("doc_id", F.lit(2).alias("rank"), F.array("notice_idx", "i").alias("at"), _coerced(F.col("notice_no"), F.col("notice_id")).alias("w"))
    return head.unionByName(scoped).unionByName(coerced).select("doc_id", "rank", "at", "w.*")


def _provenance(kind: Column, start: Column, end: Column, header: Column, stitched: Column, ocr: Column) -> Column:
    return F.struct(kind.alias("header_match"), F.array(start, end).alias("line_span"), header.alias("raw_header_line"), stitched.alias("stitched_from"), ocr.alias("ocr_quality"))


def corrigendum_struct(correction: Column) -> Column:
    none = F.lit(None)
    where = _provenance(F.lit("inferred"), F.lit(0), F.lit(0), none.cast("string"), F.expr("cast(array() as array<string>)"), none.cast("double"))
    return F.struct(
        F.lit("notice_references_other").alias("scope"),
        correction["raw_text"].alias("raw_text"),
        where.alias("provenance"),
        correction["referenced_notice_no"].alias("target_notice_no"),
        correction["referenced_year"].try_cast("int").alias("target_year"),
        correction["correction_text"].alias("amendment"),
    ).cast(CORRIGENDUM)


def build_envelopes(docs: DataFrame, layouts: DataFrame | None = None, extracted_at: str | None = None) -> DataFrame:
    """ENVELOPE rows of (doc_id, text, pdf_sha256[, pages, lengths]).

    layouts: document_layout(), unless docs have its layout_confidence and
    layout_pages; without either documents have a layout confidence of 1. pages and lengths feed the estimate of OCR quality; without them the text
    counts as one page, and its paragraphs as elements.
    """
    base = docs.withColumn("doc_id", F.col("doc_id").cast("string"))
    if "pages" not in docs.columns:
        base = base.withColumn("pages", F.greatest(F.lit(1), F.ceil(F.length("text") / 1500)))
    if "lengths" not in docs.columns:
        base = base.withColumn("lengths", F.transform(F.filter(F.split("text", "\n\n"), lambda x: ~is_blank(x)), F.length))
    score, why = scoring.ocr_quality(F.col("text"), F.col("pages"), F.col("lengths"))
    base = base.withColumns({"ocr_quality": score, "ocr_reasons": why})
    if layouts is None and "layout_pages" not in docs.columns:
        pages = "array<struct<page_no:int,layout_confidence:double,mode:string,n_bands:int,bands:array<struct<mode:string,confidence:double,n_elements:int>>>>"
        base = base.withColumns({"layout_confidence": F.lit(1.0), "layout_pages": F.expr(f"cast(array() as {pages})")})
    elif layouts is not None:
        base = base.join(layouts.select(F.col("doc_id").cast("string").alias("doc_id"), "layout_confidence", F.col("pages").alias("layout_pages")), "doc_id", "left")
        base = base.withColumn("layout_confidence", F.coalesce("layout_confidence", F.lit(1.0)))
    base = fields.masthead(base)
    base = base.withColumn("gazette_issue_id", identity.issue_id(*[F.col(c) for c in ("volume", "issue_no", "publication_date", "supplement_no", "pdf_sha256")]))

    # All of a record is made in its document's row: its text isn't made again, and nothing is grouped or joined.
    made = F.arrow_udf(records, f"struct<notices:array<{NOTICE}>,tables:array<int>>")("text", "gazette_issue_id", "ocr_quality")
    # The records come last: each settled column before them would copy them once more.
    whole = settled(fields.with_corrections(base), _made=made).drop("text")
    whole = scoring.with_sums(whole, F.col("_made.notices.confidence_scores.composite")).withColumn("notices", F.col("_made.notices"))
    whole = whole.withColumns(
        {
            "corrigenda": F.transform("corrections", corrigendum_struct),
            "_scoped": F.transform("corrections", lambda c: _scoped(c["referenced_notice_no"])),
            "_lost": F.transform("_made.tables", lambda i: _coerced(F.get("notices", i)["gazette_notice_no"], F.get("notices", i)["notice_id"])),
        }
    )
    whole = whole.select("*", F.struct(*scoring.document_scores()).alias("_conf"))
    no_warnings = F.expr(f"cast(array() as array<{WARNING}>)")
    fallback = F.when(F.col("gazette_issue_id").startswith("KE-GAZ-UNKNOWN-"), F.array(_warning("masthead.parse_failed", _FALLBACK, F.expr("cast(map() as map<string,string>)"))))
    warned = F.concat(*[F.coalesce(w, no_warnings) for w in (fallback, F.col("_scoped"), F.col("_lost"))])
    empty = {"notices": NOTICE, "corrigenda": CORRIGENDUM}
    c = F.col("_conf")
    counts = F.struct(*[c[b].cast("int").alias(b) for b in ("high", "medium", "low")])
    shown = {
        "library_version": F.lit(LIBRARY_VERSION),
        "schema_version": F.lit(SCHEMA_VERSION),
        "output_format_version": F.lit(OUTPUT_FORMAT_VERSION),
        "extracted_at": identity.extracted_at(extracted_at),
        "issue": F.struct("gazette_issue_id", "masthead_text", "parse_confidence", "volume", "issue_no", "publication_date", "supplement_no"),
        "document_confidence": F.struct(
            *[c[k].alias(k) for k in ("layout", "ocr_quality", "notice_split", "composite")], counts.alias("counts"), *[c[k].alias(k) for k in ("mean_composite", "min_composite")],
            c["n_notices"].cast("int").alias("n_notices"), "ocr_reasons",
        ),
        "layout_info": F.struct("layout_confidence", F.col("layout_pages").alias("pages")),
        "cost": F.lit(None).cast("struct<llm_calls:int,prompt_tokens:int,completion_tokens:int,usd_estimate:double>"),
    }
    shown["warnings"] = warned
    shown |= {k: F.coalesce(k, F.expr(f"cast(array() as array<{v}>)")) for k, v in empty.items()}
    names = T.StructType.fromDDL(ENVELOPE).fieldNames()
    return whole.select(*[shown[n].alias(n) if n in shown else F.col(n) for n in names])


def index_rows(envelopes: DataFrame) -> DataFrame:
    """One flat row a document, for catalogues."""
    c = F.col("document_confidence")
    return envelopes.select(
        "doc_id", "issue.gazette_issue_id", "pdf_sha256", "library_version", "schema_version",
        F.date_format("extracted_at", "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("extracted_at"),
        F.size("notices").alias("n_notices"), F.size("corrigenda").alias("n_corrigenda"), F.size("warnings").alias("n_warnings"),
        "issue.volume", "issue.issue_no", F.col("issue.publication_date").cast("string").alias("publication_date"),
        F.struct(*[c[k].alias(k) for k in ("layout", "ocr_quality", "notice_split", "composite", "mean_composite", "min_composite")]).alias("document_confidence"),
    )


RULES: dict[str, str] = {
    "segment type": "exists(notices, n -> exists(n.body_segments, s -> s.type not in ('text', 'blank')))",
    "header_match": "exists(notices, n -> n.provenance.header_match not in ('strict', 'recovered', 'inferred', 'none'))",
    "corrigendum scope": "exists(corrigenda, c -> c.scope not in ('issue_level', 'notice_is_corrigendum', 'notice_references_other'))",
    "content_sha256": "exists(notices, n -> n.content_sha256 is null or n.content_sha256 not rlike '^[0-9a-f]{64}$')",
    "notice_id": "exists(notices, n -> n.notice_id is null)",
    "full text": "exists(notices, n -> n.gazette_notice_full_text is null)",
    "composite": "exists(notices, n -> n.confidence_scores.composite is null)",
    "span": "exists(notices, n -> size(n.provenance.line_span) <> 2)",
    "issue": "issue.gazette_issue_id is null",
    "pdf_sha256": "pdf_sha256 is null",
    "versions": "library_version is null or schema_version is null or output_format_version <> 1",
    "raw_text": "exists(corrigenda, c -> c.raw_text is null)",
}


def violations(envelopes: DataFrame) -> DataFrame:
    """envelopes with broken: the rules that a row breaks. Empty for valid rows."""
    return envelopes.withColumn("broken", F.filter(F.array(*[F.when(F.expr(rule), F.lit(name)) for name, rule in RULES.items()]), lambda r: r.isNotNull()))


def conform(df: DataFrame) -> DataFrame:
    """df as ENVELOPE rows; unknown columns, at any depth, are an error."""
    schema = T.StructType.fromDDL(ENVELOPE)
    if extra := unknown_keys(df.schema, schema):
        raise ValueError(f"unknown keys: {extra}")
    return df.to(schema)


def unknown_keys(given: T.DataType, wanted: T.DataType, path: str = "") -> list[str]:
    if isinstance(given, T.ArrayType) and isinstance(wanted, T.ArrayType):
        return unknown_keys(given.elementType, wanted.elementType, path + "[]")
    if isinstance(given, T.StructType) and isinstance(wanted, T.StructType) and not path.endswith("derived_table"):
        known = {f.name: f.dataType for f in wanted}
        here = [f"{path}.{f.name}".strip(".") for f in given if f.name not in known]
        return here + [x for f in given if f.name in known for x in unknown_keys(f.dataType, known[f.name], f"{path}.{f.name}")]
    return []


_REQUIRED = {
    "library_version", "schema_version", "output_format_version", "extracted_at", "pdf_sha256", "issue", "notices", "corrigenda", "document_confidence", "layout_info", "warnings",
    "gazette_issue_id", "masthead_text", "parse_confidence", "notice_id", "gazette_notice_full_text", "content_sha256", "raw_text", "kind", "message", "composite", "n_notices", "scope",
}
_OPEN = {"derived_table", "where", "other_attributes"}
_ENUMS = {"header_match": ["strict", "recovered", "inferred", "none"], "scope": ["issue_level", "notice_is_corrigendum", "notice_references_other"]}


def json_schema(of: T.DataType | None = None, title: str = "Envelope", name: str = "") -> dict:
    """JSON Schema (2020-12) of a Spark type; the envelope's by default."""
    top = of is None
    of = T.StructType.fromDDL(ENVELOPE) if of is None else of
    if isinstance(of, T.StructType):
        out = {
            "type": "object",
            "properties": {f.name: json_schema(f.dataType, name=f.name) for f in of if not (top and f.name == "doc_id")},
            "required": [f.name for f in of if f.name in _REQUIRED],
            "additionalProperties": name in _OPEN,
        }
        return {"$schema": "https://json-schema.org/draft/2020-12/schema", "title": title} | out if top else out
    if isinstance(of, T.ArrayType):
        return {"type": "array", "items": json_schema(of.elementType, name=name)}
    if isinstance(of, T.MapType):
        return {"type": "object", "additionalProperties": True}
    kind = {"string": "string", "int": "integer", "bigint": "integer", "double": "number", "boolean": "boolean", "date": "string", "timestamp": "string"}[of.simpleString()]
    out = {"type": kind if name in _REQUIRED else [kind, "null"]}
    if name in _ENUMS:
        out["enum"] = _ENUMS[name]
    return out | ({"format": "date" if kind and of.simpleString() == "date" else "date-time"} if of.simpleString() in ("date", "timestamp") else {})


CONFIG_DDL = (
    "llm struct<mode:string,model:string,api_key_env:string,stages:map<string,boolean>,cache_dir:string>, "
    "runtime struct<deterministic:boolean,timeout_seconds:double,include_full_docling_dict:boolean>, bundles struct<" + ",".join(f"{b}:boolean" for b in (
        "notices", "corrigenda", "document_index", "spatial_markdown", "full_text", "tables", "debug_trace", "images", "gazette_spatial_json", "docling_markdown", "docling_json")) + ">"
)


def config_schema() -> dict:
    return {"$schema": "https://json-schema.org/draft/2020-12/schema", "title": "Config"} | json_schema(T.StructType.fromDDL(CONFIG_DDL), name="config")


def write_schema_file(path: str | Path, model: str = "envelope") -> Path:
    made = {"envelope": json_schema, "config": config_schema}
    if model not in made:
        raise ValueError(f"unknown model {model!r}; known: {sorted(made)}")
    Path(path).write_text(json.dumps(made[model](), indent=2, ensure_ascii=False) + "\n", encoding="utf-8")
    return Path(path)


_NO_NAMES = "cast(array() as array<string>)"


def stray_keys(raw: Column, of: T.StructType, path: str = "", also: tuple[str, ...] = ()) -> Column:
    """Paths of the keys, at any depth, of a JSON text that a type doesn't have; open objects aren't looked into."""

    def none_if_null(x: Column) -> Column:
        return F.coalesce(x, F.expr(_NO_NAMES))

    known = F.array(*[F.lit(n) for n in (*of.fieldNames(), *also)])
    here = F.transform(none_if_null(F.array_except(F.json_object_keys(raw), known)), lambda k: F.concat(F.lit(path), k))
    parts = [here]
    for f in of:
        kind, value = f.dataType, F.get_json_object(raw, f"$.{f.name}")
        if f.name in _OPEN:
            continue
        if isinstance(kind, T.StructType):
            parts.append(stray_keys(value, kind, f"{path}{f.name}."))
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            items = none_if_null(F.from_json(value, "array<string>"))
            parts.append(F.flatten(F.transform(items, _strays_within(kind.elementType, f"{path}{f.name}[]."))))
    return F.array_distinct(F.concat(*parts))


def _strays_within(of: T.StructType, path: str) -> Callable[[Column], Column]:
    return lambda x: stray_keys(x, of, path)


def validate_envelope_json(texts: DataFrame, column: str = "value") -> DataFrame:
    """texts with envelope, and problems: what keeps each JSON text from being one.

    Unknown keys are found at every level, in the text itself, as parsing would
    drop them; not within objects that are open by design.
    """
    schema = T.StructType.fromDDL(ENVELOPE)
    names = [f.name for f in schema if f.name != "doc_id"]
    raw = F.col(column)
    keys = F.json_object_keys(raw)
    missing = F.array_except(F.array(*[F.lit(n) for n in names if n in _REQUIRED]), F.coalesce(keys, F.expr(_NO_NAMES)))
    in_issue = F.coalesce(F.json_object_keys(F.get_json_object(raw, "$.issue")), F.expr(_NO_NAMES))
    lacking = F.array_except(F.array(*[F.lit(n) for n in schema["issue"].dataType.fieldNames() if n in _REQUIRED]), in_issue)
    out = texts.withColumn("envelope", F.from_json(raw, schema, {"mode": "PERMISSIVE"}))
    rules = F.filter(F.array(*[F.when(F.expr(_nested(rule)), F.lit(f"invalid: {name}")) for name, rule in RULES.items()]), lambda r: r.isNotNull())
    found = F.concat(
        F.when(keys.isNull(), F.array(F.lit("not a JSON object"))).otherwise(F.expr(_NO_NAMES)),
        F.transform(stray_keys(raw, schema), lambda k: F.concat(F.lit("unknown: "), k)),
        F.transform(missing, lambda k: F.concat(F.lit("missing: "), k)),
        F.transform(lacking, lambda k: F.concat(F.lit("missing: issue."), k)),
        rules,
    )
    return out.withColumn("problems", found)


def _nested(rule: str) -> str:
    """A rule on a row's columns as one on the struct "envelope"."""
    import re

    return re.sub(r"(?<![.\w'])(notices|corrigenda|issue|pdf_sha256|library_version|schema_version|output_format_version)\b", r"envelope.\1", rule)
