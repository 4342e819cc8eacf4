"""Text lines with their numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """Lines as value, _file, _start (of their part of the file), _line (in the file, from 1) and _place (over all files).

    A file is read in parts by many tasks, none of which knows how many lines
    come before its own. The lines of every part are counted first; sums over
    the parts of a file, in order, give the number of its first line. Only
    these counts, one row a part, are sorted and joined.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"),
                                         F.monotonically_increasing_id().alias("_at"))
    parts = lines.groupBy("_file", "_start").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = parts.withColumns({"_in_file": before(W.partitionBy("_file").orderBy("_start")),
                               "_in_all": before(W.orderBy("_file", "_start"))}).drop("_n")
    here = F.col("_at") - F.col("_first")
    return lines.join(parts, ["_file", "_start"]).select(
        "value", "_file", "_start", (F.col("_in_file") + here + 1).alias("_line"), (F.col("_in_all") + here).alias("_place"))
