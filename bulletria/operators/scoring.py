"""Rule-based confidence: five scores a notice, their composite, document roll-up.

Every score is a column expression over the notice's own row, but for the gap to
the next notice. Components are rounded before the composite is formed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import CLOSERS, clip, compact, ends_clean, fixed, is_blank, let, minus, round3, round_to, rstrip, settled, split_lines, strip
from .patterns import DATED, MARKERS, MID_CAPITAL, SIGNATURE

HIGH, MEDIUM = 0.80, 0.50


def notice_number(no: Column) -> tuple[Column, Column]:
    s = strip(F.coalesce(no.cast("string"), F.lit("")))
    ladder = [
        (s == "", 0.0, "empty notice number"),
        (s.rlike("^[0-9]{2,6}$"), 1.0, None),
        (s.rlike("^[0-9]+/[0-9]{4}$"), 0.6, "notice number in year/number form"),
        (s.rlike("^[0-9]+[A-Za-z]$"), 0.5, "notice number has trailing letter"),
        (s.rlike("^[0-9]{7,}$"), 0.4, "notice number is unusually long"),
        (s.rlike("^[0-9]$"), 0.3, "single-digit notice number is suspicious"),
        (s.rlike("^[^0-9]+$"), 0.1, "notice number has no digits"),
    ]
    score, reason = F.lit(0.3), F.lit("notice number has unexpected shape")
    for test, value, why in reversed(ladder):
        score = F.when(test, F.lit(value)).otherwise(score)
        reason = F.when(test, F.lit(why).cast("string")).otherwise(reason)
    return score, compact(reason)


def structure(text: Column, titled: Column, table: Column) -> tuple[Column, Column]:
    parts = structure_parts(text, titled, table, full_lines(F.coalesce(text, F.lit(""))))
    return parts["score"], parts["reasons"]


def full_lines(text: Column) -> Column:
    """The lines of a text that aren't blank."""
    return F.filter(split_lines(text), lambda x: ~is_blank(x))


def structure_parts(text: Column, titled: Column, table: Column, lines: Column) -> Column:
    """struct<score, reasons>; lines: full_lines(text)."""
    text = F.coalesce(text, F.lit(""))

    def marked(low: Column) -> Column:
        found = low.contains(MARKERS[0])
        for m in MARKERS[1:]:
            found = found | low.contains(m)
        return found

    signals = let(F.lower(text), marked).cast("int") + text.rlike(DATED).cast("int") + text.rlike(SIGNATURE).cast("int")
    facts = F.struct(F.length(text).alias("n"), F.size(lines).alias("lines"), signals.alias("signals"), titled.alias("titled"), table.alias("table"))
    return let(facts, _structure)


def _structure(facts: Column) -> Column:
    n, lines, signals, titled, table = (facts[k] for k in ("n", "lines", "signals", "titled", "table"))
    size = F.concat(n.cast("string"), F.lit(" chars)"))
    none, one = (signals == 0) & ~table, (signals == 1) & ~table
    score = (
        F.lit(1.0)
        + minus(n < 50, 0.6)
        + minus((n >= 50) & (n < 120), 0.2)
        + minus(n > 100_000, 0.3)
        + minus(lines <= 2, 0.4)
        + minus(none, 0.3)
        + minus(one, 0.1)
        + minus(~titled, 0.05)
    )
    reasons = compact(
        F.when(n < 50, F.concat(F.lit("body very short ("), size)),
        F.when((n >= 50) & (n < 120), F.concat(F.lit("body short ("), size)),
        F.when(n > 100_000, F.concat(F.lit("body very long ("), size, F.lit(" -- possible merge"))),
        F.when(lines <= 2, F.lit("only header/no body content")),
        F.when(none, F.lit("no legal marker, date, or signature found")),
        F.when(one, F.lit("only one structural marker present")),
        F.when(~titled, F.lit("no title lines extracted")),
    )
    return F.struct(clip(score).alias("score"), reasons.alias("reasons"))


def mid_sentence_breaks(text: Column) -> Column:
    """Lines that stop in mid-sentence before one that begins in lower case."""

    return let(full_lines(text), _breaks)


def _breaks(lines: Column) -> Column:
    def runs_on(a: Column, b: Column) -> Column:
        return b.isNotNull() & strip(b).rlike(r"^\p{Ll}") & ~F.substring(rstrip(a), -1, 1).isin([*CLOSERS, *",;:-"])

    return F.when(F.size(lines) < 2, 0).otherwise(F.size(F.filter(F.zip_with(lines, F.slice(lines, 2, F.size(lines)), runs_on), lambda x: x)))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))


def repeated_grams(words: Column, width: int = 6) -> Column:
    """How many distinct runs of width words come twice or more."""

    def grams(w: Column) -> Column:
        return F.sort_array(F.transform(F.sequence(F.lit(1), F.size(w) - (width - 1)), lambda i: F.array_join(F.slice(w, i, width), " ")))

    def twice(runs: Column) -> Column:
        return F.size(F.filter(runs, lambda g, i: (i > 0) & (g == F.get(runs, i - 1)) & ((i == 1) | (g != F.get(runs, i - 2)))))

    def hashed(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)]))

    def counted(w: Column) -> Column:
        # Runs are written out and sorted only where two have one hash: distinct hashes tell distinct runs.
        return let(hashed(w), lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), let(grams(w), twice)).otherwise(0))

    return let(words, lambda w: F.when(F.size(w) >= width, counted(w)).otherwise(0))


def mid_capitals(text: Column) -> Column:
    return F.regexp_count(text, F.lit(MID_CAPITAL))


def spatial_counts(text: Column, lines: Column) -> Column:
    """struct<many, breaks, repeats, caps, n>: what the score of the reading order is made of; lines: full_lines(text)."""

    def counts(words: Column, lines: Column) -> Column:
        n = F.size(words)
        return F.struct(
            n.alias("n"),
            F.when(n > 50, repeated_grams(words)).otherwise(0).alias("repeats"),
            F.when(n > 100, mid_capitals(text)).otherwise(0).alias("caps"),
            _breaks(lines).alias("breaks"),
        )

    none = F.struct(*[F.lit(0).alias(k) for k in ("n", "repeats", "caps", "breaks")])
    return let(lines, lambda ls: F.when(F.size(ls) >= 2, let(words_of(text), lambda words: counts(words, ls))).otherwise(none))


def spatial_parts(text: Column, lines: Column | None = None) -> Column:
    """struct<score, reasons>; lines: full_lines(text), where it is at hand."""
    text = F.coalesce(text, F.lit(""))
    lines = full_lines(text) if lines is None else lines

    def judge(c: Column) -> Column:
        breaks, repeats, caps, n = c["breaks"], c["repeats"], c["caps"], c["n"]
        density = caps / F.greatest(F.lit(1), n)
        dense = (density > 0.10) & (caps > 20)
        score = F.lit(1.0) + minus(breaks >= 3, F.least(F.lit(0.5), breaks * F.lit(0.1))) + minus(repeats >= 3, F.least(F.lit(0.3), repeats * F.lit(0.05)))
        score = score + minus(dense, F.least(F.lit(0.15), density * F.lit(0.5)))
        reasons = compact(
            F.when(breaks >= 3, F.concat(breaks.cast("string"), F.lit(" mid-sentence breaks (possible column interleaving)"))),
            F.when(repeats >= 3, F.concat(repeats.cast("string"), F.lit(" repeated 6-grams (possible column merge)"))),
            F.when(dense, F.concat(F.lit("high mid-sentence cap density "), fixed(density, 2), F.format_string(" (%d/%d words)", caps, n))),
        )
        empty = text == ""
        return F.struct(F.when(empty, F.lit(0.0)).otherwise(clip(score)).alias("score"), F.when(empty, F.array(F.lit("empty text"))).otherwise(reasons).alias("reasons"))

    return let(spatial_counts(text, lines), judge)


def boundary(kind: Column, text: Column, start: Column, end: Column, next_start: Column) -> tuple[Column, Column]:
    cap = F.when(kind == "strict", 1.0).when(kind == "recovered", 0.6).when(kind == "inferred", 0.4).otherwise(0.2)
    span, gap = end - start, next_start - end
    clean = ends_clean(F.coalesce(text, F.lit("")))
    score = cap + minus(span <= 1, 0.4) + minus((span > 1) & (span < 3), 0.2) + minus(~clean, 0.15) + minus(F.coalesce(gap > 20, F.lit(False)), 0.2)
    return clip(score), compact(
        F.when(kind == "strict", F.lit(None).cast("string"))
        .when(kind == "recovered", F.lit("header recovered from noisy line (capped at 0.6)"))
        .when(kind == "inferred", F.lit("header inferred (capped at 0.4)"))
        .otherwise(F.lit("no notice header found")),
        F.when(span <= 1, F.lit("span is a single line")).when(span < 3, F.lit("span is very short")),
        F.when(~clean, F.lit("text does not end with terminal punctuation")),
        F.when(gap > 20, F.concat(F.lit("gap of "), gap.cast("string"), F.lit(" lines to next notice -- possible missing content"))),
    )


def table_score(table: Column) -> tuple[Column, Column]:
    """table: body.TABLE or null."""
    rows, repairs = table["rows"], F.coalesce(F.size(table["repairs"]), F.lit(0))
    serials = F.filter(F.transform(rows, lambda r: F.when(strip(r["s_no"]).rlike("^[0-9]+$"), strip(r["s_no"]).try_cast("bigint"))), lambda s: s.isNotNull())
    jumps = F.size(F.filter(F.zip_with(serials, F.slice(serials, 2, F.size(serials)), lambda a, b: (b - a) != 1), lambda j: j))
    jumps = F.when(F.size(serials) >= 2, jumps).otherwise(0)
    lengths = F.transform(F.filter(rows, lambda r: F.coalesce(r["name"], F.lit("")) != ""), lambda r: F.length(strip(r["name"])))
    mean = F.aggregate(lengths, F.lit(0), lambda a, x: a + x) / F.greatest(F.size(lengths), F.lit(1))
    over = let(mean, lambda m: F.size(F.filter(lengths, lambda x: x > m * 3)))
    odd = (F.size(lengths) > 0) & (over >= F.greatest(F.lit(1), F.floor(F.size(rows) / 10)))
    score = F.lit(1.0) + minus(repairs > 0, F.least(F.lit(0.3), repairs * F.lit(0.05))) + minus(jumps > 0, F.least(F.lit(0.3), jumps * F.lit(0.05))) + minus(odd, 0.15)
    reasons = compact(
        F.when(repairs > 0, F.concat(repairs.cast("string"), F.lit(" merged-row repairs applied"))),
        F.when(jumps > 0, F.concat(jumps.cast("string"), F.lit(" non-sequential serial jumps"))),
        F.when(odd, F.lit("some cells dramatically longer than others (likely merged)")),
    )
    empty = table.isNotNull() & (F.coalesce(F.size(rows), F.lit(0)) == 0)
    none = F.expr("cast(array() as array<string>)")
    return (
        F.when(table.isNull(), F.lit(1.0)).when(empty, F.lit(0.2)).otherwise(clip(score)),
        F.when(table.isNull(), none).when(empty, F.array(F.lit("derived_table has no rows"))).otherwise(reasons),
    )


def composite(scores: dict[str, Column], table: Column | None = None) -> Column:
    base = scores["notice_number"] * F.lit(0.30) + scores["structure"] * F.lit(0.25) + scores["spatial"] * F.lit(0.25) + scores["boundary"] * F.lit(0.20)
    if table is None:
        return clip(base)
    return F.when(table.isNull(), clip(base)).otherwise(clip(base * F.lit(0.85) + table * F.lit(0.15)))


PARTS = ("notice_number", "structure", "spatial", "boundary")


def _prefixed(part: str, reasons: Column) -> Column:
    return F.transform(reasons, lambda x: F.concat(F.lit(f"{part}: "), x))


def score_notices(notices: DataFrame) -> DataFrame:
    """notices with confidence_scores and confidence_reasons."""
    if "next_start" not in notices.columns:
        notices = notices.withColumn("next_start", F.lead("line_start").over(Window.partitionBy("doc_id").orderBy("notice_idx")))
    table = F.col("derived_table")
    has_table = table.isNotNull() | F.exists("body_segments", lambda s: s["type"] == "table")
    found = {
        "notice_number": notice_number(F.col("notice_no")),
        "structure": (F.col("_form.score"), F.col("_form.reasons")),
        "spatial": (F.col("_read.score"), F.col("_read.reasons")),
        "boundary": boundary(F.col("header_match"), F.col("full_text"), F.col("line_start"), F.col("line_end"), F.col("next_start")),
        "table": table_score(table),
    }
    lined, text, lines = settled(notices, _lines=full_lines(F.coalesce("full_text", F.lit("")))), F.col("full_text"), F.col("_lines")
    scored = settled(lined, _read=spatial_parts(text, lines), _form=structure_parts(text, F.size("title_lines") > 0, has_table, lines)).drop("_lines")
    scored = settled(scored, **{f"_{k}": round3(s) for k, (s, _) in found.items()}, **{f"_why_{k}": _prefixed(k, r) for k, (_, r) in found.items()})
    scored = scored.withColumn("_table", F.when(table.isNotNull(), F.col("_table")))
    scored = settled(scored, _composite=round3(composite({k: F.col(f"_{k}") for k in PARTS}, F.col("_table"))))
    fields = [F.col(f"_{k}").alias(k) for k in (*PARTS, "table", "composite")]
    out = scored.withColumn("confidence_scores", F.struct(*fields)).withColumn("confidence_reasons", F.concat(*[F.col(f"_why_{k}") for k in (*PARTS, "table")]))
    return out.drop("next_start", "_read", "_form", "_composite", *[f"_{k}" for k in found], *[f"_why_{k}" for k in found])


def cap_by_ocr(notices: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """Boundaries of badly scanned documents are held at 0.6 at most.

    docs: (doc_id, ocr_quality), unless notices have it. Strict notices of such documents carry the score.
    """
    joined = notices.withColumnRenamed("ocr_quality", "_ocr") if docs is None else notices.join(docs.select("doc_id", F.col("ocr_quality").alias("_ocr")), "doc_id", "left")
    s = F.col("confidence_scores")
    poor = F.coalesce(F.col("_ocr") < 0.5, F.lit(False)) & (F.col("header_match") == "strict")
    held = poor & (s["boundary"] > 0.6)
    parts = {k: s[k] for k in PARTS} | {"boundary": F.lit(0.6)}
    lowered = F.struct(*[parts[k].alias(k) for k in PARTS], s["table"].alias("table"), round3(composite(parts, s["table"])).alias("composite"))
    return joined.withColumns(
        {
            "ocr_quality": F.when(poor, F.col("_ocr")),
            "confidence_reasons": F.when(held, F.concat("confidence_reasons", F.array(F.lit("boundary: capped at 0.6 due to low OCR quality")))).otherwise(F.col("confidence_reasons")),
            "confidence_scores": F.when(held, lowered).otherwise(s),
        }
    ).drop("_ocr")


def ocr_quality(text: Column, pages: Column, lengths: Column) -> tuple[Column, Column]:
    """How well a document was read; lengths: those of its stripped text elements."""
    letters, total = F.length(F.regexp_replace(text, r"\P{L}+", "")), F.length(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", ""))
    ratio = letters / F.greatest(F.lit(1), total)
    short = F.when(F.size(lengths) > 0, F.size(F.filter(lengths, lambda n: n <= 2)) / F.size(lengths)).otherwise(F.lit(0.0))
    density = F.least(F.lit(1.0), F.length(text) / F.greatest(F.lit(1), pages * 1500))
    score = F.least(ratio * F.lit(1.1), F.lit(1.0)) * F.lit(0.5) + (F.lit(1.0) - short) * F.lit(0.3) + density * F.lit(0.2)
    empty = F.coalesce(text, F.lit("")) == ""
    reasons = compact(
        F.when(ratio < 0.65, F.concat(F.lit("low letter ratio "), fixed(ratio, 2), F.lit(" (possible OCR noise)"))),
        F.when(short > 0.25, F.concat((round_to(short, 2) * 100).cast("int").cast("string"), F.lit("% of text elements are 1-2 chars (OCR fragments)"))),
        F.when(density < 0.3, F.concat(F.lit("text density "), fixed(density, 2), F.lit(" (sparse -- likely scanned)"))),
    )
    return F.when(empty, F.lit(0.0)).otherwise(clip(score)), F.when(empty, F.array(F.lit("no extractable text"))).otherwise(reasons)


def band(score: Column) -> Column:
    return F.when(score.isNull(), "unscored").when(score >= HIGH, "high").when(score >= MEDIUM, "medium").otherwise("low")


def confidence_sums() -> list[Column]:
    """Aggregates of a document's scored notices, that document_scores() reads; of whole thousandths, so they don't depend on the order of rows."""
    c = F.col("confidence_scores.composite")
    return [
        *[F.count_if(band(c) == b).alias(b) for b in ("high", "medium", "low")],
        F.sum(F.round(c * 1000).cast("bigint")).alias("_sum"),
        F.count(c).alias("_n"),
        F.min(c).alias("_min"),
        F.count(F.lit(1)).alias("n_notices"),
    ]


def _equals(value: str) -> Callable[[Column], Column]:
    return lambda x: x == value


def with_sums(docs: DataFrame, composites: Column) -> DataFrame:
    """docs with the columns of confidence_sums(), from a list of each document's composites."""
    bands = F.transform(composites, band)
    sums = {
        **{b: F.size(F.filter(bands, _equals(b))).cast("bigint") for b in ("high", "medium", "low")},
        "_sum": F.aggregate(composites, F.lit(0).cast("bigint"), lambda a, c: a + F.coalesce(F.round(c * 1000).cast("bigint"), F.lit(0))),
        "_n": F.size(F.filter(composites, lambda c: c.isNotNull())).cast("bigint"),
        "_min": F.array_min(composites),
        "n_notices": F.size(composites).cast("bigint"),
    }
    return docs.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in sums.items()]))))


def document_scores() -> list[Column]:
    """layout, ocr_quality, notice_split, composite, ... of rows with layout_confidence, ocr_quality and confidence_sums(), null for none."""
    layout, ocr = F.col("layout_confidence"), F.col("ocr_quality")
    zero = F.lit(0).cast("bigint")
    n, total = F.coalesce("_n", zero), F.coalesce("_sum", zero)
    mean = total / F.lit(1000.0) / F.greatest(n, F.lit(1))
    whole = F.when(n > 0, mean * F.lit(0.6) + layout * F.lit(0.2) + ocr * F.lit(0.2)).otherwise(layout * F.lit(0.5) + ocr * F.lit(0.5))
    return [
        round3(clip(layout)).alias("layout"),
        round3(clip(ocr)).alias("ocr_quality"),
        round3(clip(F.lit(1.0) - F.coalesce("low", zero) / F.greatest(n, F.lit(1)))).alias("notice_split"),
        round3(clip(whole)).alias("composite"),
        *[F.coalesce(b, zero).alias(b) for b in ("high", "medium", "low")],
        F.when(n > 0, round3(mean)).otherwise(F.lit(0.0)).alias("mean_composite"),
        F.when(n > 0, round3(F.col("_min"))).otherwise(F.lit(0.0)).alias("min_composite"),
        F.coalesce("n_notices", zero).alias("n_notices"),
    ]


def document_confidence(docs: DataFrame, notices: DataFrame) -> DataFrame:
    """(doc_id, layout, ocr_quality, notice_split, composite, high, medium, low, ...).

    docs: (doc_id, layout_confidence, ocr_quality), also those without notices.
    """
    both = docs.select("doc_id", "layout_confidence", "ocr_quality").join(notices.groupBy("doc_id").agg(*confidence_sums()), "doc_id", "left")
    return both.select("doc_id", *document_scores())
