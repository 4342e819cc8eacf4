"""Streaming ingest without duplicates, and the feedback stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kalangu import constants as C
from kalangu.operators.filters import allowed_sample_rate, from_countries
from kalangu.operators.splits import not_yet_ingested
from kalangu.sources.sinks import written


def new_files(rows: DataFrame, existing: DataFrame | None = None, countries=C.COUNTRIES, rates=C.SAMPLE_RATES) -> DataFrame:
    """Rows of files not seen before, in a stream that can be resumed.

    The state holds the seen file names; it is keyed by file and so spread over
    all tasks. No file is too late: where the state must stay small, use
    :func:`ingest_new`, which looks at the target table instead.
    """
    good = allowed_sample_rate(from_countries(rows, countries).filter("has_audio"), rates)
    if existing is not None:
        good = not_yet_ingested(good, existing, "file")
    return good.dropDuplicates(["file"])


def ingest_new(rows: DataFrame, path: str, checkpoint: str, countries=C.COUNTRIES, rates=C.SAMPLE_RATES,
               available_now: bool = True, interval: str = "30 seconds") -> StreamingQuery:
    """Append files that the table below ``path`` does not have, without any state in the stream.

    Each micro-batch is joined against what earlier batches wrote; a batch that
    is run again replaces its own folder. However late a file comes, it is
    written once.
    """
    good = allowed_sample_rate(from_countries(rows, countries).filter("has_audio"), rates)

    def write(batch: DataFrame, batch_id: int) -> None:
        new = batch.dropDuplicates(["file"])
        if written(batch.sparkSession, path):
            seen = batch.sparkSession.read.parquet(path).filter(F.col("batch") != batch_id)
            new = not_yet_ingested(new, seen.select("file"), "file")
        new.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    w = good.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=interval)
    return w.start()


def feedback_rows(rows: DataFrame, tasks=C.FEEDBACK_TASKS) -> DataFrame:
    """Feedback ready to append: known tasks, ratings 1..5 (others are filtered from the stream)."""
    return rows.filter(F.col("rating").between(1, 5)).withColumn(
        "task", F.when(F.col("task").isin(*tasks), F.col("task")).otherwise("other"))
