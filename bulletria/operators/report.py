"""Analytics over scored notices and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import round3
from .enhance import SUB_SCORES
from .scoring import HIGH, band

TOLERANCE = 0.05


def filter_notices(notices: DataFrame, score: str, least: float = 0.70) -> DataFrame:
    """Notices of at least that score; those without one are left out."""
    return notices.where(F.col(score) >= least)


def partition_by_band(notices: DataFrame, score: str) -> DataFrame:
    return notices.withColumn("band", band(F.col(score)))


def _thousandths(score: Column) -> Column:
    return F.round(score * 1000).cast("bigint")


def aggregate_confidence(notices: DataFrame, score: str, *by: str) -> DataFrame:
    """mean, min, fraction_high and n of the scores; zeros where there is none.

    Scores have three decimals; whole thousandths are summed.
    """
    s = F.col(score)
    n = F.count(s)
    return notices.groupBy(*by).agg(
        F.coalesce(round3(F.sum(_thousandths(s)) / F.lit(1000.0) / F.nullif(n, F.lit(0))), F.lit(0.0)).alias("mean"),
        F.coalesce(round3(F.min(s)), F.lit(0.0)).alias("min"),
        F.coalesce(round3(F.count_if(s >= HIGH) / F.nullif(n, F.lit(0))), F.lit(0.0)).alias("fraction_high"),
        n.alias("n"),
    )


def confidence_rollup(scored: DataFrame, score: str, *by: str) -> DataFrame:
    """Counts and means for each level of by and band; null stands for all."""
    banded = partition_by_band(scored, score)
    return banded.rollup(*by, "band").agg(F.count(F.lit(1)).alias("n"), round3(F.sum(_thousandths(F.col(score))) / F.lit(1000.0) / F.count(score)).alias("mean_score"))


def lowest(scored: DataFrame, score: str, ties: list[str], n: int = 20) -> DataFrame:
    """The n lowest scores, ties in the order given: a top-n report."""
    return scored.where(F.col(score).isNotNull()).orderBy(score, *ties).limit(n)


def report_rows(notices: DataFrame) -> DataFrame:
    """The ten columns of the CSV report; reasons are joined by " | "."""
    s = F.col("confidence_scores")
    return notices.select(
        "doc_id", "notice_no", "header", s["composite"].alias("composite"), s["notice_number"].alias("notice_number"), s["structure"].alias("structure"),
        s["spatial"].alias("spatial"), s["boundary"].alias("boundary"), s["table"].alias("table"), F.array_join("confidence_reasons", " | ").alias("reasons"),
    )


def stratified_sample(scored: DataFrame, score: str, key: str, per_band: int = 20, seed: int = 42) -> DataFrame:
    """min(per_band, size) rows of each band, drawn by a hash of key and seed.

    The limit on the rank is applied within each partition before the shuffle
    (WindowGroupLimit), so a band's last task ranks per_band rows a partition.
    """
    banded = partition_by_band(scored, score).withColumn("_h", F.xxhash64(F.lit(seed), key))
    ranked = banded.withColumn("_rank", F.row_number().over(Window.partitionBy("band").orderBy("_h", key)))
    return ranked.where(F.col("_rank") <= per_band).drop("_h", "_rank")


def score_calibration(labelled: DataFrame) -> DataFrame:
    """(band, n, correct, precision, hint) of hand labels: (band, is_correct); unlabelled rows are left out."""
    sums = labelled.where(F.col("is_correct").isNotNull()).groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_correct").alias("correct"))
    precision = F.col("correct") / F.col("n")
    hint = F.when((F.col("band") == "high") & (precision < 0.85), "high band is too generous").when((F.col("band") == "low") & (precision > 0.30), "low band is too harsh")
    return sums.select("band", "n", "correct", round3(precision).alias("precision"), hint.alias("hint"))


def regression_snapshot(canonical: DataFrame, documents: DataFrame) -> DataFrame:
    """One row for each canonical document, present or not."""
    shown = documents.select("doc_id", F.lit(True).alias("_here"), "mean_composite", "min_composite", "layout", "ocr_quality", "n_notices")
    return canonical.select("doc_id").join(shown, "doc_id", "left").withColumn("present", F.coalesce("_here", F.lit(False))).drop("_here")


def write_snapshot(snapshot: DataFrame, path: str) -> None:
    """regression_snapshot() as read_snapshot() reads it: one JSON object, keyed by document; a few canonical ones."""
    import json

    names = [c for c in snapshot.columns if c != "doc_id"]
    rows = {str(r["doc_id"]): {c: r[c] for c in names if r["present"] or c == "present"} for r in snapshot.orderBy("doc_id").toLocalIterator()}
    spark = snapshot.sparkSession
    spark.createDataFrame([(json.dumps(rows, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def check_regression(expected: DataFrame, current: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """(doc_id, expected, actual, delta, failed): only a drop beyond the tolerance fails, a document that is missing doesn't."""
    both = expected.where("present").select("doc_id", F.col("mean_composite").alias("expected")).join(current.select("doc_id", F.col("mean_composite").alias("actual")), "doc_id")
    delta = F.col("actual") - F.col("expected")
    return both.select("doc_id", "expected", "actual", F.round(delta, 6).alias("delta"), (F.round(delta, 6) < -tolerance).alias("failed"))


def regression_ok(checked: DataFrame) -> DataFrame:
    return checked.agg((~F.coalesce(F.bool_or("failed"), F.lit(False))).alias("ok"))


def id_stability(before: DataFrame, after: DataFrame) -> DataFrame:
    """Whether each document has the same notice_ids in the same order; prefix: one list begins the other."""

    def listed(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("notice_idx", "notice_id"))), lambda x: x["notice_id"]).alias(name))

    both = listed(before, "a").join(listed(after, "b"), "doc_id", "full")
    none = F.expr("cast(array() as array<string>)")
    a, b = F.coalesce("a", none), F.coalesce("b", none)
    short = F.least(F.size(a), F.size(b))
    return both.select("doc_id", (a == b).alias("same"), (F.slice(a, 1, short) == F.slice(b, 1, short)).alias("prefix"))


def explain_opinion(opinion: Column) -> Column:
    """What a model said of a notice, as lines of text; null without an opinion."""
    given = F.concat_ws(", ", *[F.when(opinion[s].isNotNull(), F.concat(F.lit(f"{s}="), opinion[s].cast("string"))) for s in SUB_SCORES])
    issues = F.when(F.size(opinion["issues"]) > 0, F.concat(F.lit("\n    issues: "), F.array_join(opinion["issues"], "; ")))
    review = F.when(opinion["needs_human_review"], F.lit("\n    needs human review"))
    failed = F.when(opinion["error"].isNotNull(), F.concat(F.lit("\n    error: "), opinion["error"]))
    return F.when(opinion.isNotNull(), F.concat_ws("", F.lit("  model: "), given, issues, review, failed))


def explain_notice(
    notice_no: Column, header: Column, kind: Column, start: Column, end: Column, stitched: Column, scores: Column, reasons: Column, names: list[str], opinion: Column | None = None
) -> Column:
    """A notice's scores and reasons, and a model's opinion if there is one, as lines of text."""
    numbers = F.concat_ws(", ", *[F.when(scores[n].isNotNull(), F.concat(F.lit(f"{n}="), scores[n].cast("string"))) for n in names])
    listed = F.when(F.size(stitched) > 0, F.concat(F.lit("['"), F.array_join(stitched, "', '"), F.lit("']"))).otherwise("[]")
    place = F.concat(F.lit("  header_match="), F.coalesce(kind, F.lit("?")), F.format_string(" line_span=[%d, %d] stitched_from=", start, end), listed)
    why = F.when(F.size(reasons) > 0, F.concat(F.lit("  reasons:\n    - "), F.array_join(reasons, "\n    - ")))
    first = F.concat(F.lit("Notice "), F.coalesce(notice_no, F.lit("?")), F.lit(": "), F.coalesce(header, F.lit("(no header)")))
    return F.concat_ws("\n", first, place, F.concat(F.lit("  scores: "), numbers), why, F.lit(None).cast("string") if opinion is None else explain_opinion(opinion))
