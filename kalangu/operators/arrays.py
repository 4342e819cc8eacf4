"""Batch collation and clip segmentation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kalangu.functions import audio as A


def pad_batches(df: DataFrame, batch: str, columns: dict[str, float]) -> DataFrame:
    """Right-pad arrays to the longest of their batch; adds <column>_length.

    ``columns`` maps an array column to its fill value. The longest length per
    batch is aggregated map-side; no batch is gathered.
    """
    longest = df.groupBy(batch).agg(*[F.max(F.size(c)).alias(f"_{c}") for c in columns])
    out = df.join(longest, batch)
    for c, fill in columns.items():
        element = df.schema[c].dataType.elementType
        pad = F.array_repeat(F.lit(fill).cast(element), F.col(f"_{c}") - F.size(c))
        out = out.withColumns({f"{c}_length": F.size(c), c: F.concat(F.col(c), pad)}).drop(f"_{c}")
    return out


def segment_clips(df: DataFrame, key: str, samples: str = "samples", sample_rate: str = "sample_rate",
                  **kw) -> DataFrame:
    """One row per fixed segment of a long clip: key, segment, start, end, samples."""
    parts = A.fixed_segments(F.col(samples), F.col(sample_rate), **kw)
    return df.select(key, F.posexplode(parts).alias("segment", "s")).select(key, "segment", "s.*")


def map_text(df: DataFrame, fn, column: str = "text") -> DataFrame:
    """Apply a caller's Column function (or pandas UDF) to a text column."""
    return df.withColumn(column, fn(F.col(column)))


def map_samples(df: DataFrame, fn, column: str = "samples") -> DataFrame:
    """Apply a caller's Column function (or pandas UDF) to a sample column."""
    return df.withColumn(column, fn(F.col(column)))


def absolute_paths(df: DataFrame, root: str, column: str = "audio_path") -> DataFrame:
    from kalangu.functions.text import under_root

    return df.withColumn(column, under_root(F.col(column), root))


def span_rows(df: DataFrame, key: str, text: str = "text", spans: str = "cs_spans") -> DataFrame:
    """One row per code-switch span: key, position, language, text."""
    from kalangu.functions.nested import span_texts

    cut: Column = span_texts(F.col(text), F.col(spans))
    return df.select(key, F.posexplode(cut).alias("pos", "s")).select(key, "pos", "s.*")
