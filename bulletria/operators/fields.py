"""Fields of a document: masthead, corrigenda, title, summary, highlighted text."""

from __future__ import annotations

from calendar import month_abbr, month_name

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank, settled, split_lines, strip
from .segment import is_header

MASTHEAD_LINES = 30
_VOLUME = r"(?Ui)Vol[.]?\s*([CILVX]+)\s*-?\s*No[.]?\s*([0-9]+)"
_SUPPLEMENT = r"(?Ui)(?:Supplement\s+No[.]?\s*|-S)([0-9]+)"
_DATED = r"(?Ui)NAIROBI\s*[,]?\s*([0-9]{1,2})(?:st|[nr]d|th)?\s+([A-Za-z]+)[,]?\s*([0-9]{4})"
MONTHS = {name.lower(): i for names in (month_name, month_abbr) for i, name in enumerate(names) if i} | {"sept": 9}

_OTHER_NOTICE = r"(?:IN\s+)?Gazette\s+Notice\s+No[.]?\s*"
_REFERENCE = rf"(?Ui){_OTHER_NOTICE}([0-9]+)\s+of\s+([0-9]{{4}})"
_Q = "[\"'‘’“”]"
_AMEND = rf"(?Uis)amend\s+(?:the\s+)?(.+?)\s+(?:printed\s+as\s+)?{_Q}(.+?){_Q}\s+to\s+read\s+{_Q}(.+?){_Q}"
_MARK_STYLE = "background-color:#fff3cd;color:#1a1a1a;padding:0.15em 0.35em;border-radius:3px;font-weight:600;"


def masthead_text(text: Column) -> Column:
    """The first lines, cut at line feeds only."""
    return F.array_join(F.slice(F.split(text, "\n", -1), 1, MASTHEAD_LINES), "\n")


def _found(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def masthead(docs: DataFrame) -> DataFrame:
    """docs with volume, issue_no, publication_date, supplement_no, parse_confidence.

    What can't be read is null; a day that its month doesn't have is, too.
    """
    head = F.col("masthead_text")
    month = F.create_map(*[F.lit(x) for kv in MONTHS.items() for x in kv])[F.lower(_found(head, _DATED, 2))]
    day = F.try_to_date(F.format_string("%s-%02d-%s", _found(head, _DATED, 3), month, F.lpad(_found(head, _DATED, 1), 2, "0")), "yyyy-MM-dd")
    read = docs.withColumn("masthead_text", masthead_text(F.coalesce("text", F.lit("")))).withColumns(
        {
            "volume": F.upper(_found(head, _VOLUME, 1)),
            "issue_no": _found(head, _VOLUME, 2).try_cast("int"),
            "publication_date": F.when(month.isNotNull(), day),
            "supplement_no": _found(head, _SUPPLEMENT, 1).try_cast("int"),
        }
    )
    known = sum(F.col(c).isNotNull().cast("int") for c in ("volume", "issue_no", "publication_date", "supplement_no"))
    return read.withColumn("parse_confidence", F.when(known >= 3, 1.0).when(known >= 1, 0.5).otherwise(0.0))


def corrigenda(docs: DataFrame) -> DataFrame:
    """(doc_id, position, referenced notice and year, what was wrong and right, raw_text).

    Looks before the first strict header, from a heading CORRIGENDA if there is
    one. The text is cut before each mention of another notice; a cut falls both
    before "IN" and before "Gazette", so pieces begin with the latter.
    """
    return with_corrections(docs.select("doc_id", "text")).select("doc_id", F.inline("corrections"))


def with_corrections(docs: DataFrame) -> DataFrame:
    """docs with corrections: the rows of corrigenda() as a list, in order; null or empty where there is none."""
    lined = settled(docs, _lines=split_lines(F.when(~is_blank(F.col("text")), F.col("text"))))
    first = F.array_position(F.transform("_lines", is_header), True).cast("int")
    ahead = settled(settled(lined, _first=first), _ahead=F.when(F.col("_first") > 0, F.slice("_lines", 1, F.col("_first") - 1)).otherwise(F.col("_lines")))
    title = F.array_position(F.transform("_ahead", lambda x: strip(x).rlike("(?i)^CORRIGEND[AE]$")), True).cast("int")
    section = F.array_join(F.slice("_ahead", F.greatest(title, F.lit(1)), F.greatest(F.size("_ahead"), F.lit(1))), "\n")
    pieces = F.transform(F.split(section, rf"(?Ui)(?={_OTHER_NOTICE}[0-9])", -1), lambda x, i: F.struct(i.alias("position"), strip(x).alias("piece")))
    hits = settled(ahead, _hits=F.when(F.size("_ahead") > 0, F.filter(pieces, lambda p: p["piece"].rlike(_REFERENCE))))

    def correction(p: Column) -> Column:
        piece = p["piece"]
        return F.struct(
            p["position"].alias("position"),
            _found(piece, _REFERENCE, 1).alias("referenced_notice_no"),
            _found(piece, _REFERENCE, 2).alias("referenced_year"),
            strip(_found(piece, _AMEND, 1)).alias("what_corrected"),
            strip(_found(piece, _AMEND, 2)).alias("error_text"),
            strip(_found(piece, _AMEND, 3)).alias("correction_text"),
            strip(F.regexp_replace(piece, r"(?U)[\s\x1c-\x1f]+", " ")).alias("raw_text"),
        )

    return settled(hits, corrections=F.transform("_hits", correction)).drop("_lines", "_first", "_ahead", "_hits")


def document_title(texts: Column, stem: Column) -> Column:
    """The first text labelled a title, or the file's name."""
    titles = F.filter(texts, lambda t: (t["label"] == "title") & ~is_blank(F.coalesce(t["text"], F.lit(""))))
    return F.coalesce(strip(F.get(titles, F.lit(0))["text"]), F.replace(stem, F.lit("_"), F.lit(" ")))


def layout_summary(doc: Column) -> Column:
    """Sizes of a layout document's lists; pages is a map, which counts as no list."""
    return F.struct(
        F.when(doc["texts"].isNotNull(), F.size(doc["texts"])).alias("texts_count"),
        F.when(doc["tables"].isNotNull(), F.size(doc["tables"])).alias("tables_count"),
        F.lit(None).cast("int").alias("pages_count"),
    )


def highlight_notices(markdown: Column) -> Column:
    """Header lines wrapped in a coloured span; a heading stays one."""
    mark = f'$1<span style="{_MARK_STYLE}">$2</span>'
    return F.regexp_replace(markdown, r"(?m)^(## )?(GAZETTE NOTICE NO\. [0-9]+)\s*$", mark)
