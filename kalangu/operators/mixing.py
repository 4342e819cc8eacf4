"""Temperature-weighted mixing of languages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from kalangu.functions.binding import let
from kalangu.functions.hashing import seeded_uniform
from kalangu.operators.scale import hash_ranked


def sampling_weights(counts: DataFrame, temperature: float = 0.3, group: str = "language",
                     n: str = "n") -> DataFrame:
    """weight = n^t / sum(n^t) per group; an empty input fails the query."""
    if not 0.0 < temperature <= 1.0:
        raise ValueError(f"temperature must be in (0, 1], got {temperature}")
    total = counts.agg(F.sum(F.pow(F.col(n).cast("double"), F.lit(temperature))).alias("t")).scalar()
    weights = counts.withColumn("weight", F.pow(F.col(n).cast("double"), F.lit(temperature)) / total)
    # a branch without rows, but for an empty input, where its one row fails the query
    none = counts.agg(F.count("*").alias("_c")).filter(F.when(F.col("_c") == 0, F.raise_error(
        F.lit("counts must be non-empty")).cast("boolean")).otherwise(F.lit(False)))
    return weights.union(none.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in weights.schema]))


def require_nonempty(counts: DataFrame) -> DataFrame:
    """The same rows, or a failed query when there are none."""
    if counts.isEmpty():
        raise ValueError("counts must be non-empty")
    return counts


def language_counts(df: DataFrame, group: str = "language") -> DataFrame:
    return df.groupBy(group).agg(F.count("*").alias("n"))


def weight_bounds(weights: DataFrame, group: str = "language") -> DataFrame:
    """Adds [lo, hi) of each group on the unit line, in group order.

    One row per language: the window is over a handful of rows.
    """
    run = W.orderBy(group).rowsBetween(W.unboundedPreceding, W.currentRow)
    hi = F.sum("weight").over(run)
    last = F.row_number().over(W.orderBy(F.col(group).desc())) == 1
    return weights.withColumns({"lo": hi - F.col("weight"), "hi": F.when(last, 1.0).otherwise(hi)})


def pick_group(df: DataFrame, u: Column, bounds: DataFrame, group: str = "language", out: str = "pick") -> DataFrame:
    """Adds struct<group, n, weight> of the interval that holds ``u``.

    The few intervals reach the rows as one scalar array, not as a join.
    """
    table = bounds.agg(F.sort_array(F.collect_list(F.struct("hi", group, "n", "weight"))).alias("b")).scalar()
    df = df.withColumns({"_t": table, "_u": u})
    pick = let(lambda t, u: F.get(F.filter(t, lambda b: u < b["hi"]), F.lit(0)), F.col("_t"), F.col("_u"))
    return df.withColumn(out, pick).drop("_t", "_u")


def mixed_plan(pool: DataFrame, key: str, total: int, temperature: float = 0.3, seed: int = 42,
               group: str = "language", batch_size: int | None = None,
               rows_per_copy: int = 1_000_000) -> DataFrame:
    """``total`` draws with replacement: a language by weight, then a uniform row.

    The pool rows of a language drawn from very often are copied, so that no
    join key receives more than about ``rows_per_copy`` draws; a draw goes to
    one of the copies and the result is the same.
    """
    require_nonempty(pool)
    weights = sampling_weights(language_counts(pool, group), temperature, group)
    bounds = weight_bounds(weights, group)
    draws = pool.sparkSession.range(total).withColumnRenamed("id", "draw")
    draws = pick_group(draws, seeded_uniform(F.col("draw"), seed), bounds, group, "_g")
    n = F.col("_g")["n"]
    slot = F.least(F.floor(seeded_uniform(F.col("draw"), seed + 1) * n), n - 1) + 1
    copies = F.greatest(F.lit(1), F.ceil(F.lit(float(total)) * F.col("_g")["weight"] / n / rows_per_copy))
    draws = draws.select("draw", F.col("_g")[group].alias(group), slot.cast("long").alias("slot"),
                         F.pmod(F.xxhash64("draw"), copies).alias("_copy"))
    ranked = hash_ranked(pool.select(group, key), [group], F.col(key), seed, out="slot")
    sizes = bounds.select(group, F.greatest(F.lit(1), F.ceil(
        F.lit(float(total)) * F.col("weight") / F.col("n") / rows_per_copy)).alias("_copies"))
    ranked = (ranked.join(sizes, group)
              .withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1)))
              .drop("_copies").withColumn("slot", F.col("slot").cast("long")))
    plan = draws.join(ranked, [group, "slot", "_copy"]).drop("_copy", "slot")
    if batch_size is not None:
        plan = plan.withColumn("batch_id", F.floor(F.col("draw") / batch_size))
    return plan


def batched_plan(pool: DataFrame, key: str, num_batches: int, batch_size: int, **kw) -> DataFrame:
    return mixed_plan(pool, key, num_batches * batch_size, batch_size=batch_size, **kw)


def expected_shares(hours: DataFrame, temperature: float = 0.3) -> DataFrame:
    """Share of each language by its hours."""
    return sampling_weights(hours, temperature, n="hours").withColumnRenamed("weight", "share")
