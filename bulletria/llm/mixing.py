"""Mixing sources to target weights by systematic sampling.

Each document of a source expects the same number of copies: the source's share
of the target total, divided by the size it has. Within a source the expected
copies are added up in the order of (bucket, doc_id), with one random offset in
front, and a document is emitted once for each whole number that its part of
the sum crosses: each gets its expectation rounded down or up, and each source
its target to within one document.

An expectation is a whole number and a fraction in units of 2**-62; sums are
128-bit whole numbers, so they don't depend on their order, and the rounding of
the fraction amounts to less than one copy in 10**18 rows. The sum is made in two
levels, over ``BUCKETS`` hashes of doc_id and within them: the largest source is
summed by as many tasks as there are. Sizes and rows are aggregated by source and
bucket in one pass over the texts.

Defined results: a null source is one source of its own. Sizes are characters;
null and empty texts have none but are sampled like the others of their source;
texts of any length count in full. A source without any character has its
documents once each. Sources that the weights leave out, or give 0, are left out.
Rows are sampled separately even if they share a doc_id (the order among them is
that of a hash of their text). Null doc_ids come first within their bucket. A
column copy_no of docs is replaced; all others come back as they are. No rows
give no rows. A doc_id must be a number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import as_struct, materialize

UNIT = 1 << 62
BUCKETS = 4096
SEED = 17


def _rates(counts: DataFrame, weights: dict[str, float] | None, total: int | None, seed: int) -> DataFrame:
    """(_of, _whole, _part, _shift): copies a document expects, and the offset, the last two in units of 1 / UNIT."""
    sizes = counts.groupBy("_of").agg(F.sum("_chars").alias("_n"))
    if weights is None:
        sizes = sizes.withColumn("_w", F.lit(1.0))
    else:
        if any(w < 0 for w in weights.values()):
            raise ValueError("weights must not be negative")
        given = [x for k, w in sorted(weights.items()) for x in (F.lit(k), F.lit(float(w)))]
        sizes = sizes.withColumn("_w", F.coalesce(F.create_map(*given)[F.col("_of")], F.lit(0.0)) if given else F.lit(0.0))
    every = sizes.agg(F.sum("_w").alias("_all_w"), F.sum("_n").alias("_all_n"))
    both = sizes.crossJoin(every)  # one row
    want = F.lit(float(total)) if total is not None else F.col("_all_n").cast("double")
    each = F.col("_w") / F.nullif(F.col("_all_w"), F.lit(0.0)) * want / F.nullif(F.col("_n"), F.lit(0)).cast("double")
    each = F.when(F.col("_w") <= 0, F.lit(0.0)).otherwise(F.coalesce(each, F.lit(1.0)))
    rated = both.select("_of", each.alias("_e")).withColumn("_whole", F.floor("_e"))
    part = F.floor((F.col("_e") - F.col("_whole").cast("double")) * F.lit(float(UNIT)))
    shift = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("_of"))), 1, 15), 16, 10).cast("long") * 4
    return rated.select("_of", "_whole", part.cast("long").alias("_part"), shift.alias("_shift"))


def _crossed(shift: Column, part: Column, rows: Column) -> Column:
    """Whole copies that the fractions of so many rows add up to."""
    wide = "decimal(38,0)"
    return F.call_function("div", shift.cast(wide) + part.cast("decimal(19,0)") * rows.cast("decimal(19,0)"), F.lit(UNIT).cast(wide))


def mix_sources(
    docs: DataFrame, weights: dict[str, float] | None = None, total: int | None = None, seed: int = SEED, buckets: int = BUCKETS, columns: list[str] | None = None
) -> DataFrame:
    """docs, each row as many times as it is drawn, with copy_no from 1.

    weights: target share of each source, in any unit; equal shares without
    them. total: characters to draw in all; as many as there are without it.
    columns: those of docs to return, all of them without it; only they are
    shuffled.
    """
    kept = docs.drop("copy_no") if columns is None else docs.select(*columns)
    key = F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("null"))
    plain = docs.select(
        as_struct(kept).alias("_row"),
        F.col("doc_id").cast("long").alias("_id"),
        F.when(F.col("source").isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), F.col("source").cast("string"))).alias("_source"),
        F.coalesce(F.length(F.col("text").cast("string")), F.lit(0)).cast("long").alias("_size"),
        F.xxhash64(F.col("text").cast("string")).alias("_tie"),
        (F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") % buckets).alias("_bucket"),
    )
    weights = None if weights is None else {f"={k}": w for k, w in weights.items()}
    counts = materialize(plain.groupBy(F.col("_source").alias("_of"), F.col("_bucket").alias("_at")).agg(F.count(F.lit(1)).alias("_rows"), F.sum("_size").alias("_chars")))
    before = Window.partitionBy("_of").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("_of", "_at", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before")).join(_rates(counts, weights, total, seed), "_of")
    placed = plain.drop("_size").join(base.where("_whole > 0 or _part > 0"), (F.col("_source") == F.col("_of")) & (F.col("_bucket") == F.col("_at")))
    rank = F.row_number().over(Window.partitionBy("_source", "_bucket").orderBy("_id", "_tie"))
    ranked = placed.select("_row", "_whole", "_part", "_shift", (F.col("_before") + rank).alias("_rank"))
    share = _crossed(F.col("_shift"), F.col("_part"), F.col("_rank")) - _crossed(F.col("_shift"), F.col("_part"), F.col("_rank") - 1)
    drawn = ranked.select("_row", (F.col("_whole") + share).alias("_copies")).where("_copies > 0")
    return drawn.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))).alias("copy_no")).select("_row.*", "copy_no")
