"""Manifest and corpus-metadata scans and the manifest sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kalangu import schema as S
from kalangu.functions import text as X
from kalangu.sources.lines import numbered


def _defaults(row: str, schema: T.StructType) -> list[Column]:
    given = {"sample_rate": F.lit(16000), "is_code_switched": F.lit(False),
             "cs_spans": F.array().cast(schema["cs_spans"].dataType),
             **{c: F.lit("") for c in ("dialect", "speaker_id", "domain", "corpus")}}
    return [F.coalesce(F.col(row)[f.name], given[f.name]).alias(f.name) if f.name in given
            else F.col(row)[f.name].alias(f.name) for f in schema.fields]


def read_manifest(spark: SparkSession, path: str, extended: bool = False) -> DataFrame:
    """Strict scan of a JSON Lines manifest.

    A line that is not JSON, lacks a required key or has an unknown one fails
    the query and is named as path:line, with what is wrong and its text. A
    missing path fails at once. ``extended`` admits the extension columns.
    """
    schema = S.MANIFEST_EXTENDED if extended else S.MANIFEST
    known = [f.name for f in schema.fields]
    with_bad = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    df = numbered(spark, path).filter(X.strip(F.col("value")) != "").withColumns({
        "row": F.from_json("value", with_bad, {"columnNameOfCorruptRecord": "_bad"}),
        "keys": F.coalesce(F.json_object_keys("value"), F.array().cast("array<string>"))})
    unknown = F.array_except("keys", F.array(*map(F.lit, known)))
    missing = F.filter(F.array(*map(F.lit, S.MANIFEST_REQUIRED)), lambda k: ~F.array_contains("keys", k))
    problem = (F.when(F.col("row").isNull() | F.col("row")["_bad"].isNotNull(), "not a manifest row")
               .when(F.size(missing) > 0, F.concat(F.lit("missing "), F.array_join(missing, ",")))
               .when(F.size(unknown) > 0, F.concat(F.lit("unknown "), F.array_join(unknown, ","))))
    checked = df.withColumn("row", F.when(problem.isNull(), F.col("row")).otherwise(
        F.raise_error(F.concat(X.plain_path(F.col("_file")), F.lit(":"), F.col("_line").cast("string"), F.lit(": "),
                               problem, F.lit(": "), F.col("value"))).cast(with_bad)))
    return checked.select(*_defaults("row", schema))


def iter_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Lenient scan: columns may be absent or unknown, defaults are filled in; a line that is not JSON fails the query."""
    rows = spark.read.schema(S.MANIFEST_EXTENDED).option("mode", "FAILFAST").json(path)
    return rows.withColumn("_row", F.struct("*")).select(*_defaults("_row", S.MANIFEST_EXTENDED))


def write_manifest(df: DataFrame, path: str, mode: str = "overwrite", fmt: str = "json") -> None:
    """Write a manifest as JSON Lines or Parquet; ``mode`` is overwrite or append.

    Text is written as UTF-8, unescaped. Never write to a path being read.
    """
    if mode not in ("overwrite", "append"):
        raise ValueError(f"mode must be overwrite or append, got {mode!r}")
    df.write.mode(mode).format(fmt).save(path)


def write_by_language(df: DataFrame, path: str, mode: str = "overwrite", fmt: str = "parquet") -> None:
    """Split a manifest into one folder per language.

    Rows are rebalanced on the language: Spark splits what a dominant language
    holds into tasks of the advisory size and puts small languages together.
    """
    df.hint("rebalance", "language").write.partitionBy("language").mode(mode).format(fmt).save(path)


def split_by_language(df: DataFrame, languages: list[str]) -> dict[str, DataFrame]:
    return {lang: df.filter(F.col("language") == lang) for lang in languages}


def read_corpus_metadata(spark: SparkSession, path: str, audio_root: str,
                         corpus: str = "afrispeech-200") -> DataFrame:
    """Raw corpus metadata with its derived columns; a bad line fails the query.

    Duration is 0.0 when absent (audio headers are not probed).
    """
    raw = spark.read.schema(S.CORPUS_METADATA).option("mode", "FAILFAST").json(path)
    return derive_metadata(raw, audio_root, corpus)


def derive_metadata(raw: DataFrame, audio_root: str, corpus: str = "afrispeech-200") -> DataFrame:
    return raw.withColumns({
        "raw_audio_path": X.under_root(F.col("file"), audio_root),
        "speaker_id": X.speaker_from_file(F.col("file")),
        "domain": X.infer_domain(F.coalesce("transcript", F.lit(""))), "language": F.lit("en"),
        "source_corpus": F.lit(corpus),
        "accent": F.lower(X.strip(F.coalesce("accent", F.lit("")))),
        "duration": F.coalesce("duration", F.lit(0.0))})


def corpus_catalog(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Small dimension table of corpora."""
    return spark.createDataFrame(
        rows, "corpus_id string, languages array<string>, license string, approx_hours int, "
              "sample_rate int, audio_format string")
