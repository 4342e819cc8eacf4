"""Streaming forms of the event queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kalangu import schema as S
from kalangu.operators.runs import event_order, fold_events
from kalangu.sources.events import file_stem, stage_of
from kalangu.sources.sinks import written


def event_stream(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """New event lines of a folder; malformed lines are dropped.

    File offsets replace a last-seen timestamp, so events with equal
    timestamps are not lost between polls. As in a scan, the file names the
    stage, and the run where a line does not.
    """
    reader = spark.readStream.schema(S.EVENT).option("mode", "DROPMALFORMED")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    lines = reader.json(folder).filter(F.col("run_id").isNotNull() | F.col("type").isNotNull())
    return lines.withColumn("file", file_stem(F.col("_metadata.file_path"))).withColumns(
        {"run_id": F.coalesce("run_id", "file"), "stage_name": stage_of(F.col("file"))})


def tail(events: DataFrame, run_id: str) -> DataFrame:
    """The events of a run as they arrive."""
    return events.filter(F.col("run_id") == run_id)


def live_summaries(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Run summaries kept up to date as events arrive.

    The state holds one row of fixed size per run.
    """
    return fold_events(events, keys, order)


def keep_latest(updates: DataFrame, keys: list[str], path: str, checkpoint: str, available_now: bool = True,
                interval: str = "30 seconds") -> StreamingQuery:
    """Keep the newest version of each row below ``path``; read it with :func:`read_latest`.

    Each micro-batch merges what changed into the table of the one before and
    writes the other of two folders, so the table never grows beyond two
    versions of a row. A batch that is run again replaces its own folder; while
    it does, the other still has every row. ``keys`` name a row.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        new, before = batch.withColumn("batch", F.lit(batch_id)), f"{path}/slot={(batch_id + 1) % 2}"
        if written(batch.sparkSession, before):
            new = new.unionByName(batch.sparkSession.read.parquet(before))
        _newest(new, keys).write.mode("overwrite").parquet(f"{path}/slot={batch_id % 2}")

    w = updates.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=interval)
    return w.start()


def read_latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The newest version of each row written by :func:`keep_latest`."""
    return _newest(spark.read.parquet(path).drop("slot"), keys).drop("batch")


def _newest(rows: DataFrame, keys: list[str]) -> DataFrame:
    body = F.struct(*[c for c in rows.columns if c not in keys])
    return rows.groupBy(*keys).agg(F.max_by(body, "batch").alias("_v")).select(*keys, "_v.*")


def append_stream(events: DataFrame, path: str, checkpoint: str, partition_by: list[str] = (),
                  fmt: str = "parquet", available_now: bool = True,
                  interval: str = "1 second") -> StreamingQuery:
    """Append a stream to files, each row once."""
    w = events.writeStream.format(fmt).outputMode("append").option("path", path).option(
        "checkpointLocation", checkpoint)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=interval)
    return w.start()


def latest_figures(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Latest step and losses per group, for periodic snapshots."""
    at = F.col("_at")

    def last(column: str, kind: str) -> Column:
        return F.max_by(column, F.when(F.col("type") == kind, at)).alias(f"last_{column}")

    return events.withColumn("_at", event_order(F.col(order[0]), F.col(order[1]))).groupBy(*keys).agg(
        last("step", "step"), last("loss", "step"), last("eval_loss", "eval"), F.count("*").alias("events"))
