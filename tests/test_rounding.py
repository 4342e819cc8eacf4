"""Decimal text against Python and, where a query shows it, against its SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from check import compare
from kalangu.functions.rounding import decimals

SAMPLES = "[(((i * i * 6 + i * 4 + v) % 101 - 50) / CASE v % 2 WHEN 0 THEN 128.0 ELSE 32.0 END)::FLOAT for i in range(64)]"  # halves at six, at four places


@pytest.mark.parametrize("places", [2, 3, 4, 6])
def test_decimals_equal_python(one, places):
    values = [k / 2 ** n for n in (3, 4, 5, 7, 9) for k in range(-300, 300)] + [k * 5 / 10 ** (places + 1) for k in range(3000)]
    values += [1e9 + 0.125, 1234567.0625, 1e12 + 0.5, 5e-324, -1e-9]
    assert one("x double", [(v,) for v in values], decimals(F.col("x"), places)) == [f"{v:.{places}f}" for v in values]


def test_ties_up(one):
    assert one("x double", [(0.125,), (-0.125,), (0.375,)], decimals(F.col("x"), 2, ties_up=True)) == ["0.13", "-0.13", "0.38"]


@pytest.mark.parametrize("name", ["fixed_segments", "mono_mixdown", "peak_ceiling", "truncated_clips", "user_transforms"])
def test_samples_that_are_halves(spark, tmp_path, name):
    con = duckdb.connect()
    con.execute(f"""COPY (SELECT v AS vec_id, {SAMPLES} AS embedding, 1::INT AS label
        FROM range(8) t(v)) TO '{tmp_path}/embeddings.parquet' (FORMAT parquet)""")
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    message, *_ = compare(spark, con, str(tmp_path), name)
    assert message is None, message


def test_displayed_wer_that_is_a_half(spark, tmp_path):
    con = duckdb.connect()
    con.execute(f"""COPY (SELECT v AS event_id, TIMESTAMP '2024-01-01' + to_seconds(v) AS ts, v % 3 AS user_id, 'click' AS event_type,
        (v * 12.5 + CASE WHEN v % 5 = 0 THEN 0.0625 ELSE 0 END)::DOUBLE AS value, '{{"k": ' || v || '}}' AS props FROM range(200) t(v)) TO '{tmp_path}/events.parquet' (FORMAT parquet)""")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    message, *_ = compare(spark, con, str(tmp_path), "wer_display")
    assert message is None, message


def test_rates_near_a_half(spark, tmp_path):
    con = duckdb.connect()
    # 191 words and 1,280 characters are 2.0890625 words a second, its product with a million is below the half
    con.execute(f"""COPY (SELECT v AS doc_id, 'en' AS lang, repeat('a ', w - 1) || repeat('b', n - 2 * w + 2) AS text
        FROM (SELECT v * 3 + 1 AS v, 2 + v % 250 AS w, 128 * (4 + v // 250) AS n FROM range(4000) t(v))) TO '{tmp_path}/documents.parquet' (FORMAT parquet)""")
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    message, *_ = compare(spark, con, str(tmp_path), "speech_rates")
    assert message is None, message
