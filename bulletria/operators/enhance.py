"""Optional second opinions of a model on notices of low confidence.

The model is a callable from texts to opinions; it sees only what the cache
lacks, in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank, round3

THRESHOLD = 0.80
MODEL_CHARS = 4000  # what the model is shown of a notice, as its cache key is
SUB_SCORES = ("coherence_score", "completeness_score", "single_notice_score", "legal_structure_score")
OPINION = "struct<" + ",".join(f"{s}:double" for s in SUB_SCORES) + ",issues:array<string>,needs_human_review:boolean,error:string>"

Judge = Callable[[list[str]], list[dict]]


def cache_key(model: str, body: Column) -> Column:
    return F.sha1(F.concat(F.lit(f"{model}|"), F.substring(body, 1, MODEL_CHARS)))


def validate_notices(notices: DataFrame, judge: Judge, model: str, cache: DataFrame | None = None, weak: Column | None = None) -> DataFrame:
    """notices with opinion. cache: (key, opinion); blank texts need a review without being asked about. weak: those to have an opinion on; all without it."""

    @F.arrow_udf(OPINION)
    def ask(texts: pa.Array) -> pa.Array:
        asked = [t for t in texts.to_pylist() if t is not None]
        answers = iter(judge(asked) if asked else [])
        scores = [(s, pa.float64()) for s in SUB_SCORES]
        kind = pa.struct([*scores, ("issues", pa.list_(pa.string())), ("needs_human_review", pa.bool_()), ("error", pa.string())])
        return pa.array([None if t is None else next(answers) for t in texts.to_pylist()], kind)

    chosen = F.lit(True) if weak is None else F.coalesce(weak, F.lit(False))
    keyed = notices.withColumn("_key", F.when(chosen, cache_key(model, F.col("full_text"))))
    if cache is None:
        keyed = keyed.withColumn("_kept", F.lit(None).cast(OPINION))
    else:
        keyed = keyed.join(cache.select(F.col("key").alias("_key"), F.col("opinion").alias("_kept")), "_key", "left")
    body = F.substring(F.col("full_text"), 1, MODEL_CHARS)
    blank = F.coalesce(is_blank(body), F.lit(True))
    review = F.from_json(F.lit('{"needs_human_review": true, "error": "empty body"}'), OPINION)
    asked = ask(F.when(chosen & ~blank & F.col("_kept").isNull(), body))
    return keyed.withColumn("opinion", F.when(chosen & blank, review).otherwise(F.coalesce("_kept", asked))).drop("_kept", "_key")


def new_cache_rows(validated: DataFrame, model: str) -> DataFrame:
    """(key, opinion) of those that may be cached: errors may not."""
    good = validated.where(F.col("opinion").isNotNull() & F.col("opinion.error").isNull() & ~is_blank(F.col("full_text")))
    return good.select(cache_key(model, F.col("full_text")).alias("key"), "opinion").dropDuplicates(["key"])


def enhance(scored: DataFrame, judge: Judge, model: str, cache: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """scored with opinion, semantic, composite_enhanced and needs_human_review.

    Only notices under the threshold are asked about. An opinion without scores
    changes no composite. A score under a half calls for a review.
    """
    c = F.col("confidence_scores.composite")
    judged = validate_notices(scored, judge, model, cache, c < threshold)
    given = F.filter(F.array(*[F.col(f"opinion.{s}") for s in SUB_SCORES]), lambda x: x.isNotNull())
    mean = F.aggregate(given, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(given), F.lit(0))
    return judged.withColumns(
        {
            "semantic": round3(mean),
            "composite_enhanced": round3(c * F.lit(0.6) + mean * F.lit(0.4)),
            "needs_human_review": F.coalesce(F.col("opinion.needs_human_review"), F.lit(False)) | F.exists(given, lambda x: x < 0.5),
        }
    )
