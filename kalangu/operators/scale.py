"""Building blocks that hold when one key owns a large part of all rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from kalangu.functions.hashing import seeded_hash
from kalangu.session import through_table

#: bits of a key filter at most, 8 MB
FILTER_BITS = 1 << 26


def key_filter(keys: DataFrame, key: str, most: int = FILTER_BITS) -> Callable[[Column], Column]:
    """A test that passes every value of ``keys[key]`` and few others: a Bloom filter of two bits a key.

    It may be applied where a join would have to move costly rows; what passes
    wrongly is left to a join of the results. The filter has about sixteen bits
    a key, up to ``most``: with more keys it lets more through, never less.
    """
    hashes = keys.select(F.xxhash64(key).alias("h"))
    size = min(most, max(1 << 16, 1 << (16 * keys.count()).bit_length()))
    cells = hashes.selectExpr(f"explode(array(h & {size - 1}L, shiftright(h, 32) & {size - 1}L)) AS cell")
    rows = cells.selectExpr("shiftright(cell, 6) AS at", "shiftleft(1L, cast(cell & 63 AS int)) AS bit")
    rows = rows.groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()  # size / 64 rows at most
    words = np.zeros(size // 64, "u8")
    words[rows.column("at").to_numpy()] = rows.column("bits").to_numpy().view("u8")
    bits = words.view("u1")

    @F.arrow_udf("boolean")
    def passes(hashed: pa.Array) -> pa.Array:
        h = hashed.to_numpy(zero_copy_only=False)
        found = np.ones(len(h), bool)
        for cell in (h & (size - 1), (h >> 32) & (size - 1)):
            found &= (bits[cell >> 3] >> (cell & 7).astype("u1")) & 1 == 1
        return pa.array(found)

    return lambda column: passes(F.xxhash64(column))


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row per key.

    Spark plans a group limit below the shuffle for ``row_number() = 1``, so
    each task sends at most one row per key, however hot the key.
    """
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int,
                salt: Column | None = None, salts: int = 16) -> DataFrame:
    """The first ``n`` rows per key.

    With ``salt`` (any well spread column) the rows of a key are first cut to
    ``n`` within each of its salts, so no task sees more than ``salts * n``
    rows of one key in the last round.
    """
    if salt is not None:
        df = df.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(salts)))
        w = W.partitionBy(*keys, "_salt").orderBy(*order)
        df = df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn", "_salt")
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def hash_ranked(df: DataFrame, keys: list[str], key: Column, seed: int = 42,
                digits: int = 3, out: str = "rank") -> DataFrame:
    """Adds a dense 1-based rank in seeded hash order within ``keys``.

    A plain window over few keys (or none) would put whole groups in one
    task. The leading hash digits cut every group into even ranges: rows are
    numbered within their range and shifted by the size of the ranges before.
    """
    df = df.withColumn("_h", seeded_hash(key, seed)).withColumn("_b", F.substring("_h", 1, digits))
    df = df.withColumn("_k", key)
    sizes = df.groupBy(*keys, "_b").count()
    before = W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    if keys:
        before = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_b", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_o"))
    near = W.partitionBy(*keys, "_b").orderBy("_h", "_k")
    ranked = df.withColumn("_n", F.row_number().over(near))
    return (equi_join(ranked, offsets, [*keys, "_b"], "inner")
            .withColumn(out, F.col("_n") + F.col("_o"))
            .drop("_h", "_b", "_k", "_n", "_o"))


def equi_join(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Null-safe equi-join that keeps the left columns and the right non-keys."""
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys],
                           *[c for c in right.columns if c not in keys])
    cond = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"_r_{k}"]) for k in keys])
    return left.join(renamed, cond, how).drop(*[f"_r_{k}" for k in keys])


def hash_cut(df: DataFrame, key: Column, count: Column, seed: int = 42, digits: int = 4) -> Column:
    """Scalar struct<h, k>: the last of the first ``count`` rows in hash order.

    ``count`` is a function of ``_total``, the number of rows. Only group sizes
    and the rows of the one boundary range are looked at; every other row is
    decided by comparing its own hash with the result.
    """
    h = df.select(seeded_hash(key, seed).alias("h"), key.alias("k"))
    h = h.withColumn("b", F.substring("h", 1, digits))
    sizes = h.groupBy("b").count()
    run = W.orderBy("b").rowsBetween(W.unboundedPreceding, W.currentRow)
    every = W.partitionBy()
    bounds = sizes.select(
        "b", (F.sum("count").over(run) - F.col("count")).alias("lo"), F.sum("count").over(run).alias("hi"),
        F.sum("count").over(every).alias("_total")).withColumn("_need", count)
    edge = bounds.filter((F.col("_need") > F.col("lo")) & (F.col("_need") <= F.col("hi"))).select(
        F.struct("b", (F.col("_need") - F.col("lo")).alias("left")).alias("e"))
    e = edge.scalar()
    inside = h.filter(F.col("b") == e["b"]).withColumn("n", F.row_number().over(W.partitionBy("b").orderBy("h", "k")))
    return inside.filter(F.col("n") == edge.scalar()["left"]).select(F.struct("h", "k").alias("cut")).scalar()


def floor_percentiles(df: DataFrame, keys: list[str], value: str, picks: dict[str, Column],
                      sums: dict[str, Column] | None = None, buckets: int = 128) -> DataFrame:
    """Exact order statistics per group, in one pass over ``df``.

    ``picks`` maps an output name to a 0-based index as a function of ``n``
    (the group size); ``sums`` maps a name to a condition to count. No group is
    sorted whole: equal values are counted first, the counts are summed over
    value ranges of about equally many distinct values (their edges may be
    approximate, the result is not), and only then numbered within each range.
    The ranges are stored: edges found again, from partitions merged in another
    order, may differ, and sums and numbers would be of different ranges.
    Output: keys, n, mean, min, max, one column per pick and per sum.
    """
    sums = sums or {}
    counts = (df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
              .groupBy(*keys, F.col(value).alias("_v"))
              .agg(F.count("*").alias("_c"), *[F.count_if(c).alias(f"_s_{k}") for k, c in sums.items()]))
    shares = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    ends = counts.groupBy(*keys).agg(F.struct(
        F.percentile_approx("_v", shares, F.lit(1000)).alias("edges"), F.sum("_c").alias("n")).alias("_e"))
    placed = equi_join(counts, ends, keys, "inner") if keys else counts.withColumn("_e", ends.scalar())
    placed = placed.withColumns({"n": F.col("_e.n"), "_edges": F.col("_e.edges")})
    placed = placed.withColumn("_b", F.size(F.filter("_edges", lambda e: e <= F.col("_v")))).drop("_e", "_edges")
    placed = through_table(placed, "ranges")
    sizes = placed.groupBy(*keys, "_b").agg(F.sum("_c").alias("_s"))
    earlier = W.partitionBy(*keys) if keys else W.partitionBy()
    before = earlier.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_b", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_o"))
    run = W.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(W.unboundedPreceding, W.currentRow)
    summed = (equi_join(placed.withColumn("_in", F.sum("_c").over(run)), offsets, [*keys, "_b"], "inner")
              .withColumn("_end", F.col("_o") + F.col("_in")))
    start = F.col("_end") - F.col("_c")
    return summed.groupBy(*keys, "n").agg(
        (F.sum(F.col("_v") * F.col("_c")) / F.sum("_c")).alias("mean"),
        F.min("_v").alias("min"), F.max("_v").alias("max"),
        *[F.max(F.when((start <= i) & (i < F.col("_end")), F.col("_v"))).alias(name) for name, i in picks.items()],
        *[F.sum(f"_s_{k}").alias(k) for k in sums])


def running_min(df: DataFrame, keys: list[str], order: list[str], value: Column, bucket: Column,
                before: str = "before") -> DataFrame:
    """Adds the minimum of ``value`` over all earlier rows of the group.

    ``bucket`` must not decrease along ``order``. Each bucket is scanned by its
    own task; what came before it arrives as one carried value per bucket.
    """
    df = df.withColumn("_v", value).withColumn("_b", bucket)
    per = df.groupBy(*keys, "_b").agg(F.min("_v").alias("_m"))
    earlier = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    carried = per.select(*keys, "_b", F.min("_m").over(earlier).alias("_carry"))
    near = W.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    local = df.withColumn("_near", F.min("_v").over(near))
    return (equi_join(local, carried, [*keys, "_b"], "inner")
            .withColumn(before, F.least("_carry", "_near")).drop("_v", "_b", "_carry", "_near"))
