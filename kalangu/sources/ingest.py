"""Incremental ingest of a country's rows into the corpus metadata table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kalangu import constants as C
from kalangu.operators.filters import allowed_sample_rate, from_countries
from kalangu.operators.scale import first_per_key
from kalangu.operators.splits import not_yet_ingested


def new_rows(rows: DataFrame, existing: DataFrame | None, countries=C.COUNTRIES, rates=C.SAMPLE_RATES,
             max_rows: int | None = None) -> DataFrame:
    """Rows to append: right country, audio present, allowed rate, file not yet there.

    ``rows`` has file, country, has_audio, sample_rate and an ``order`` column;
    of several rows with one file the first counts.
    """
    good = allowed_sample_rate(from_countries(rows, countries).filter("has_audio"), rates)
    good = first_per_key(good, ["file"], [F.col("order")])
    if existing is not None:
        good = not_yet_ingested(good, existing, "file")
    return good.orderBy("order").limit(max_rows) if max_rows is not None else good


def ingest_summary(rows: DataFrame, written: DataFrame, countries=C.COUNTRIES) -> DataFrame:
    """One row: scanned, matched (country), written."""
    matched = F.upper(F.trim("country")).isin(*countries)
    return rows.agg(F.count("*").alias("scanned"), F.count_if(matched).alias("matched")).select(
        "scanned", "matched", written.agg(F.count("*")).scalar().alias("written"))


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    return df.limit(n)
