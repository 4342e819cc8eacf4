"""Clip-by-clip comparison of two hypothesis sets, and the leaderboard."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from kalangu.functions import scoring as M
from kalangu.functions import text as X
from kalangu.functions.nested import map_mean

REGRESSED = ("REGRESSED", "CATASTROPHIC")


def score_pairs(pairs: DataFrame, variant: str = "narrow") -> DataFrame:
    """Adds wer_a, wer_b, delta (4 places), is_garbage and verdict.

    Verdicts use unrounded rates in the narrow variant and the rounded delta in
    the wide one, each as its report defines it.
    """
    a, b = (F.coalesce(F.col(c), F.lit("")) for c in ("hyp_a", "hyp_b"))
    # every text is split into words once
    df = pairs.withColumns({"_rw": X.words(F.col("ref")), "_aw": X.words(a), "_bw": X.words(b)})
    counts = (F.size("_rw"), F.size("_bw"))
    df = df.withColumns({
        "_a": M.words_wer(F.col("_rw"), F.col("_aw")), "_b": M.words_wer(F.col("_rw"), F.col("_bw")),
        "is_garbage": M.is_garbage(b, F.col("ref"), counts=counts)})
    df = df.withColumns({"wer_a": F.round("_a", 4), "wer_b": F.round("_b", 4),
                         "delta": F.round(M.delta_wer(F.col("_a"), F.col("_b")), 4)})
    verdict = (M.verdict_narrow(F.col("_a"), F.col("_b"), b, F.col("ref"), counts=counts) if variant == "narrow"
               else M.verdict_wide(F.col("delta"), F.col("is_garbage")))
    return df.withColumn("verdict", verdict).drop("_a", "_b", "_rw", "_aw", "_bw")


def verdict_counts(scored: DataFrame) -> DataFrame:
    """verdict, n, pct of all clips. The window spans the five verdicts, not the clips."""
    counts = scored.groupBy("verdict").agg(F.count("*").alias("n"))
    return counts.withColumn("pct", F.round(F.col("n") * 100.0 / F.sum("n").over(W.partitionBy()), 2))


def side_averages(scored: DataFrame) -> DataFrame:
    """Over clips with a delta: n, mean WER A and B, difference in points."""
    has = F.col("delta").isNotNull()
    mean = {s: F.coalesce(F.avg(F.when(has, F.col(f"wer_{s}"))), F.lit(0.0)) for s in "ab"}
    return scored.agg(F.count_if(has).alias("n"), F.round(mean["a"], 6).alias("mean_a"),
                      F.round(mean["b"], 6).alias("mean_b"),
                      F.round((mean["b"] - mean["a"]) * 100, 4).alias("delta_points"))


def overall_call(scored: DataFrame) -> DataFrame:
    """BROAD / MIXED / NARROW by the share of regressed clips."""
    bad = F.col("verdict").isin(*REGRESSED)
    s = scored.agg(F.count("*").alias("clips"), F.count_if(bad).alias("regressed"))
    pct = F.col("regressed") * 100.0 / F.col("clips")
    return s.withColumns({
        "regressed_pct": F.round(pct, 4),
        "call": F.when(pct >= 60, "BROAD").when(pct >= 30, "MIXED").otherwise("NARROW")})


def regression_pattern(scored: DataFrame) -> DataFrame:
    """Regressed clips against all: duration, reference words, garbage."""
    bad = F.col("verdict").isin(*REGRESSED)
    n = X.word_count(F.col("ref"))
    return scored.agg(
        F.count_if(bad).alias("regressed"), F.count("*").alias("clips"),
        F.round(F.avg(F.when(bad, F.col("duration"))), 4).alias("regressed_duration"),
        F.round(F.avg("duration"), 4).alias("all_duration"),
        F.round(F.avg(F.when(bad, n)), 4).alias("regressed_words"), F.round(F.avg(n), 4).alias("all_words"),
        F.count_if(bad & F.col("is_garbage")).alias("garbage"))


def regressed_by(scored: DataFrame, column: str, k: int | None = None) -> DataFrame:
    """Regressed and all clips per value of a column, most regressed first."""
    bad = F.col("verdict").isin(*REGRESSED)
    value = F.coalesce(F.when(F.col(column) != "", F.col(column)), F.lit("unknown"))
    out = scored.groupBy(value.alias(column)).agg(F.count_if(bad).alias("regressed"), F.count("*").alias("clips"))
    return out.orderBy(F.desc("regressed"), column).limit(k) if k else out


def failure_modes(scored: DataFrame) -> DataFrame:
    """Failure modes among clips with a positive delta.

    A filter on the delta would be pushed below the scores and compute them
    twice; counting the regressions only needs one evaluation.
    """
    worse = F.col("delta") > 0
    mode = F.when(worse, M.failure_mode(F.col("ref"), F.col("hyp_a"), F.col("hyp_b")))
    return (scored.groupBy(mode.alias("mode")).agg(F.count_if(worse).alias("n")).filter("n > 0"))


def ab_totals(scored: DataFrame) -> DataFrame:
    has = F.col("delta").isNotNull()
    return scored.agg(
        F.count_if(has).alias("analysed"), F.round(F.avg(F.when(has, F.col("wer_a"))), 6).alias("mean_a"),
        F.round(F.avg(F.when(has, F.col("wer_b"))), 6).alias("mean_b"),
        F.count_if(F.col("delta") > 0).alias("regressions"), F.count_if(F.col("delta") < 0).alias("improvements"))


def top_by_delta(scored: DataFrame, key: str, k: int = 10, worst: bool = True,
                 verdicts: tuple[str, ...] | None = None, missing: float | None = None) -> DataFrame:
    """The ``k`` largest (or smallest) deltas.

    ``missing`` is the sort value of a null or zero delta, as some reports
    define one (-999 or 0); by default a null comes last and 0 is 0.
    """
    d = F.col("delta")
    if missing is not None:
        d = F.when(d.isNull() | (d == 0), F.lit(float(missing))).otherwise(d)
    if verdicts is None:
        return scored.orderBy(d.desc_nulls_last() if worst else d.asc_nulls_last(), F.col(key)).limit(k)
    # wanted rows first, the others cut after the limit: each score is computed once
    rows = scored.withColumn("_in", F.col("verdict").isin(*verdicts))
    top = rows.orderBy(F.desc("_in"), d.desc_nulls_last() if worst else d.asc_nulls_last(), F.col(key)).limit(k)
    return top.filter("_in").drop("_in")


def file_sizes_of_regressed(scored: DataFrame, files: DataFrame) -> DataFrame:
    """Mean file size of regressed clips and of all clips (``files``: audio, size_bytes)."""
    bad = F.col("verdict").isin(*REGRESSED)
    return scored.join(files, "audio").agg(
        F.count("*").alias("clips"), F.round(F.avg("size_bytes"), 4).alias("all_bytes"),
        F.round(F.avg(F.when(bad, F.col("size_bytes"))), 4).alias("regressed_bytes"))


def leaderboard(reports: DataFrame, languages=("en", "ha", "ig", "yo", "pcm")) -> DataFrame:
    """Reports by mean language WER, lowest first, those without one last."""
    return (reports.select("run_id", "mode", map_mean(F.col("wer")).alias("overall"),
                           *[F.col("wer")[lang].alias(lang) for lang in languages])
            .orderBy(F.asc_nulls_last("overall"), "run_id"))


