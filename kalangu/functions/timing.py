"""Epoch seconds, ages and run identifiers (UTC throughout)."""

from pyspark.sql import Column
from pyspark.sql import functions as F

RUN_ID = r"^(.*)_(\d{8}_\d{6})_([0-9a-f]{4})$"


def epoch_seconds(ts_ntz: Column) -> Column:
    """Wall-clock UTC timestamp without zone to epoch seconds, whatever the session zone."""
    age = ts_ntz - F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    part = {p: F.extract(F.lit(p), age) for p in ("DAY", "HOUR", "MINUTE", "SECOND")}
    whole = (part["DAY"].cast("long") * 24 + part["HOUR"]) * 60 + part["MINUTE"]
    micros = (part["SECOND"] * 1000000).cast("long")
    return (whole * 60000000 + micros) / 1e6


def clock_time(epoch: Column) -> Column:
    """HH:mm:ss in UTC from epoch seconds."""
    second = F.pmod(F.floor(epoch), F.lit(86400))
    return F.format_string("%02d:%02d:%02d", F.floor(second / 3600),
                           F.floor(F.pmod(second, F.lit(3600)) / 60), F.pmod(second, F.lit(60)))


def to_timestamp(epoch: Column) -> Column:
    return F.timestamp_micros(F.round(epoch * 1e6).cast("long"))


def minutes_since(iso: Column, now_epoch: Column) -> Column:
    """Whole minutes from an ISO timestamp (UTC) to ``now``."""
    then = epoch_seconds(iso.cast("timestamp_ntz"))
    return F.floor((now_epoch - then) / 60)


def make_run_id(base: Column, stamp: Column, suffix: Column) -> Column:
    return F.concat_ws("_", base, F.date_format(stamp, "yyyyMMdd_HHmmss"), suffix)


def parse_run_id(run_id: Column) -> Column:
    """struct<base, stamp, suffix>; empty strings when the form differs."""
    return F.struct(*[F.regexp_extract(run_id, RUN_ID, k).alias(n)
                      for k, n in ((1, "base"), (2, "stamp"), (3, "suffix"))])


def percent_done(step: Column, total: Column) -> Column:
    return F.when(total == 0, 0).otherwise(F.round(100 * step / total)).cast("int")
