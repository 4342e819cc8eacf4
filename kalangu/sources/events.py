"""Event scans, typed event builders and the append sink."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kalangu import schema as S
from kalangu.functions import text as X
from kalangu.sources.lines import numbered

# Fields of each event type after the envelope (fixed values).
EVENT_FIELDS = {
    "train_start": ("stage", "run_name", "config_yaml", "total_steps", "augmentation"),
    "step": ("step", "loss", "lr", "grad_norm", "epoch"),
    "eval": ("step", "wer", "cs_wer", "eval_loss"),
    "checkpoint_saved": ("step", "path", "is_best"),
    "epoch_complete": ("epoch", "step", "avg_loss"),
    "error": ("message", "step"),
    "train_end": ("total_steps", "best_step", "best_eval_loss"),
}


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Lenient scan: malformed and blank lines are skipped, a missing path is empty.

    ``pos`` is the number of a line over all files of the path, in their order
    and that of the lines, for folds that follow file order among equal
    timestamps.
    """
    try:
        lines = numbered(spark, path)
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], S.EVENT).withColumns(
            {"pos": F.lit(0).cast("long"), "file": F.lit(""), "stage_name": F.lit("")})
    return _parsed(lines)


def file_stem(path: Column) -> Column:
    """Name without extension of a file; of a part of a folder x.jsonl, as Spark writes it, the folder's."""
    named = F.regexp_extract(X.plain_path(path), r"/([^/]+)\.jsonl(/|$)", 1)
    return F.when(named != "", named).otherwise(F.regexp_replace(F.regexp_extract(X.plain_path(path), r"([^/]*)$", 1), r"\.[^.]+$", ""))


def stage_of(file: Column) -> Column:
    return F.regexp_replace(file, "_events", "")


def _parsed(lines: DataFrame) -> DataFrame:
    rows = lines.select("value", file_stem(F.col("_file")).alias("file"), F.col("_place").alias("pos"))
    rows = rows.filter(X.strip(F.col("value")) != "")
    parsed = rows.withColumn("e", F.from_json("value", S.EVENT, {"mode": "PERMISSIVE"}))
    good = parsed.filter(F.json_object_keys("value").isNotNull())
    return good.select(
        *[F.coalesce(F.col("e.run_id"), F.col("file")).alias("run_id") if f == "run_id" else F.col(f"e.{f}").alias(f)
          for f in S.EVENT.names],
        "pos", "file", stage_of(F.col("file")).alias("stage_name"))


def read_all_events(spark: SparkSession, folder: str) -> DataFrame:
    """All ``*_events.jsonl`` files; stage name and default run id come from the file."""
    return read_events(spark, f"{folder.rstrip('/')}/*_events.jsonl")


def event(df: DataFrame, kind: str, ts: Column, run_id: Column, **fields: Column) -> DataFrame:
    """Events of one type from the rows of ``df``, in the event schema."""
    unknown = set(fields) - set(EVENT_FIELDS[kind])
    if unknown:
        raise ValueError(f"{kind} has no field {sorted(unknown)}")
    given = {"ts": ts, "run_id": run_id, "type": F.lit(kind), **fields}
    return df.select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in S.EVENT.fields])


def emit(events: DataFrame, path: str) -> None:
    """Append events as JSON lines; null fields are left out."""
    events.write.mode("append").option("ignoreNullFields", "true").json(path)
