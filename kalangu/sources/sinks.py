"""Sinks for rejects, reports, feedback and analysis results; the stage store."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kalangu import constants as C
from kalangu.operators.filters import filter_report, rejects


def write_rejects(df: DataFrame, key: str, passes: list[str], path: str) -> None:
    rejects(df, key, passes).write.mode("overwrite").json(path)


def write_filter_report(totals: DataFrame, level: str, path: str) -> None:
    filter_report(totals, level).write.mode("overwrite").json(path)


def write_results(df: DataFrame, path: str) -> None:
    """Leaderboard, tier, per-clip and A/B tables as JSON lines."""
    df.write.mode("overwrite").json(path)


def checked_feedback(df: DataFrame, tasks=C.FEEDBACK_TASKS) -> DataFrame:
    """Unknown tasks become 'other'; a rating outside 1..5 fails the query."""
    return df.withColumns({
        "task": F.when(F.col("task").isin(*tasks), F.col("task")).otherwise("other"),
        "rating": F.when(F.col("rating").between(1, 5), F.col("rating")).otherwise(
            F.raise_error(F.concat(F.lit("rating must be 1..5, got "),
                                   F.coalesce(F.col("rating").cast("string"), F.lit("null")))).cast("int"))})


def append_feedback(df: DataFrame, path: str) -> None:
    checked_feedback(df).write.mode("append").partitionBy("task").json(path)


def fingerprint(df: DataFrame, params: object = None) -> str:
    """Number of rows, sum of the hashes of whole rows, and a hash of the parameters."""
    whole = F.xxhash64(*[F.to_json(F.struct(c)) if "map<" in kind or kind == "variant" else F.col(f"`{c}`")
                         for c, kind in df.dtypes])
    r = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(whole.cast("decimal(38,0)")), F.lit(0)).alias("s")).first()
    with_params = hashlib.sha256(repr(params).encode()).hexdigest()[:12]
    return f"{r['n']}-{abs(int(r['s']))}{'m' if r['s'] < 0 else ''}-{with_params}"


def stage(df: DataFrame, path: str, compute: Callable[[DataFrame], DataFrame], params: object = None,
          dry_run: bool = False, known: DataFrame | None = None) -> DataFrame:
    """Result of ``compute(df)``, reused when stored for the same rows and parameters.

    Stored as Parquet under a fingerprint of all columns of the input and of
    ``params`` (whatever else the result depends on: limits, seeds, versions),
    so it outlives the session and the loss of executors. ``dry_run`` never
    writes. ``known`` stands for ``df`` in the fingerprint, where reading that
    would cost as much as the stage.
    """
    spark = df.sparkSession
    where = f"{path.rstrip('/')}/{fingerprint(df if known is None else known, params)}"
    if not written(spark, f"{where}-done"):
        if dry_run:
            return compute(df)
        compute(df).write.mode("overwrite").parquet(where)
        spark.range(1).write.mode("overwrite").parquet(f"{where}-done")
    return spark.read.parquet(where)


def written(spark: SparkSession, path: str) -> bool:
    """Whether a table is there. The marker of a stage is written after the stage itself."""
    try:
        spark.read.parquet(path)
    except AnalysisException as exc:
        if exc.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return False
        raise
    return True
