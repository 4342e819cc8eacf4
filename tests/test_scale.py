"""The skew-safe building blocks against plain Python."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from kalangu.operators import mixing as M
from kalangu.operators import runs as E
from kalangu.operators import scale as Z
from kalangu.operators import splits as J


def digest(k, seed=42):
    return hashlib.md5(f"{seed}:{k}".encode()).hexdigest()


@pytest.mark.parametrize("n", [1, 2, 3, 10, 101, 1000])
def test_floor_percentiles(spark, n):
    rng = random.Random(n)
    rows = [("hot", rng.choice([0.0, rng.random() * 10, 1e6])) for _ in range(n)] + [("one", 5.0), ("nan", float("nan")), ("nul", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    c = F.col("n")
    out = Z.floor_percentiles(df, ["g"], "v", {"p25": F.floor(c * 0.25), "p95": F.floor(c * 0.95), "top": c - 1}, {"big": F.col("v") > 5})
    got = {r.g: r for r in out.collect()}
    s = sorted(v for g, v in rows if g == "hot")
    assert set(got) == {"hot", "one"}
    r = got["hot"]
    assert (r.n, r.p25, r.p95, r.top, r.min, r.max) == (n, s[int(n * 0.25)], s[int(n * 0.95)], s[-1], s[0], s[-1])
    assert r.big == sum(v > 5 for v in s) and r["mean"] == pytest.approx(sum(s) / n)
    plain = Z.floor_percentiles(df.filter("g = 'hot'"), [], "v", {"p25": F.floor(c * 0.25)}).first()
    assert plain.p25 == s[int(n * 0.25)]


def test_hash_ranked(spark):
    rows = [("a", i) for i in range(700)] + [("b", i) for i in range(3)] + [(None, 1)]
    out = Z.hash_ranked(spark.createDataFrame(rows, "g string, k long"), ["g"], F.col("k")).collect()
    for g in ("a", "b", None):
        order = sorted((k for x, k in rows if x == g), key=lambda k: (digest(k), k))
        assert {r.k: r["rank"] for r in out if r.g == g} == {k: i + 1 for i, k in enumerate(order)}


@pytest.mark.parametrize("n", [1, 2, 9, 10, 500])
def test_shuffled_split(spark, n):
    out = J.shuffled_split(spark.range(n), "id").collect()
    train = sorted(range(n), key=lambda k: (digest(k), k))[:math.floor(n * 0.9)]
    assert {r.id for r in out if r.is_train} == set(train) and len(out) == n


def test_running_min_and_best(spark):
    rng = random.Random(3)
    rows = [("r", float(i), i, rng.choice([float("nan"), float(rng.randint(0, 20))])) for i in range(300)] + [("s", 0.0, 0, float("nan"))]
    df = spark.createDataFrame(rows, "run string, ts double, pos int, metric double")
    for width in (1, 7, 1000):
        out = E.best_so_far(df, "metric", ["run"], ["ts", "pos"], bucket=F.floor(F.col("ts") / width)).orderBy("run", "ts").collect()
        best, at = None, None
        for r in out[:300]:
            better = not math.isnan(r.metric) and (best is None or r.metric < best)
            if better:
                best, at = r.metric, r.pos
            assert r.is_best == better and (r.best.pos if r.best else None) == at
        assert out[300].is_best is False and out[300].best is None


def test_retention(spark):
    rng = random.Random(5)
    rows = [("r", float(i), i, float(rng.randint(0, 9))) for i in range(60)]
    df = spark.createDataFrame(rows, "run string, ts double, pos int, metric double")
    for keep in (1, 2, 4):
        for width in (1, 5, 100):
            out = E.retained_after(df, "pos", "metric", ["run"], ["ts", "pos"], keep, bucket=F.floor(F.col("ts") / width))
            for r in out.collect():
                seen = rows[:r.pos + 1]
                best = min(seen, key=lambda x: (x[3], x[1]))[2]
                assert set(r.kept) == {x[2] for x in seen[-keep:]} | {best}
        now = {r.pos for r in E.retained_now(df, "pos", "metric", ["run"], ["ts", "pos"], keep).collect()}
        assert now == {x[2] for x in rows[-keep:]} | {min(rows, key=lambda x: (x[3], x[1]))[2]}


def test_first_and_top_per_key(spark):
    rows = [("hot" if i % 3 else f"k{i}", i) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, v int")
    first = {r.k: r.v for r in Z.first_per_key(df, ["k"], [F.col("v")]).collect()}
    assert first["hot"] == 1 and len(first) == len({k for k, _ in rows})
    top = Z.top_per_key(df, ["k"], [F.desc("v")], 5, salt=F.col("v"))
    assert sorted(r.v for r in top.filter("k = 'hot'").collect()) == sorted(v for k, v in rows if k == "hot")[-5:]


def test_group_limit_is_planned_below_the_shuffle(spark, capsys):
    Z.first_per_key(spark.range(10).withColumn("k", F.col("id") % 3), ["k"], [F.col("id")]).explain()
    plan = capsys.readouterr().out
    assert plan.count("WindowGroupLimit") == 2 and plan.index("Final") < plan.index("Exchange") < plan.index("Partial")


WEIGHTS = {"en": 1000, "ha": 500, "yo": 300, "ig": 80, "pcm": 200}


def test_weights(spark):
    df = spark.createDataFrame(list(WEIGHTS.items()), "language string, n long")
    for t in (0.001, 0.3, 1.0):
        got = {r.language: r.weight for r in M.sampling_weights(df, t).collect()}
        total = sum(v ** t for v in WEIGHTS.values())
        assert sum(got.values()) == pytest.approx(1.0)
        assert got == pytest.approx({k: v ** t / total for k, v in WEIGHTS.items()})
    for t in (0.0, -1.0, 1.1):
        with pytest.raises(ValueError):
            M.sampling_weights(df, t)
    with pytest.raises(ValueError):
        M.require_nonempty(df.limit(0))


def test_empty_input_fails(spark):
    df = spark.createDataFrame(list(WEIGHTS.items()), "language string, n long").limit(0)
    pool = spark.createDataFrame([], "language string, audio_path string")
    for out in (M.sampling_weights, lambda _: M.mixed_plan(pool, "audio_path", 10), lambda _: M.batched_plan(pool, "audio_path", 2, 5)):
        with pytest.raises(Exception, match="counts must be non-empty"):
            out(df).collect()


def test_cap_above_a_thousand_is_limited_below_the_shuffle(spark):
    from kalangu.operators.scale import top_per_key

    df = spark.range(20_000).selectExpr("id % 2 AS k", "id")
    out = top_per_key(df, ["k"], [F.col("id")], 1001, salt=F.col("id"))
    assert out.count() == 2002 and out.agg(F.max("id")).first()[0] == 2001
    plan = top_per_key(df, ["k"], [F.col("id")], 1001, salt=F.col("id"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 4, plan


def test_shares_follow_the_formula(spark):
    from kalangu.constants import CORPUS_HOURS

    df = spark.createDataFrame(list(CORPUS_HOURS.items()), "language string, hours long")
    got = {r.language: round(r.share, 4) for r in M.expected_shares(df).collect()}
    assert got == {"en": 0.3025, "ha": 0.2213, "yo": 0.1960, "ig": 0.1209, "pcm": 0.1592}


def test_plan_follows_weights_and_is_complete(spark):
    pool = spark.createDataFrame([(lang, f"{lang}{i}") for lang, n in WEIGHTS.items() for i in range(n // 10)], "language string, key string")
    plain = M.mixed_plan(pool, "key", 4000).collect()
    copied = M.mixed_plan(pool, "key", 4000, rows_per_copy=10).collect()
    as_set = lambda rows: {(r.draw, r.language, r.key) for r in rows}
    assert len(plain) == 4000 and as_set(plain) == as_set(copied)
    assert all(r.key.startswith(r.language) for r in plain)
    total = sum((v // 10) ** 0.3 for v in WEIGHTS.values())
    for lang, v in WEIGHTS.items():
        assert sum(r.language == lang for r in plain) / 4000 == pytest.approx((v // 10) ** 0.3 / total, abs=0.03)


def test_batches(spark):
    pool = spark.createDataFrame([("en", "a"), ("ha", "b")], "language string, key string")
    out = M.batched_plan(pool, "key", 5, 8)
    assert [r["count"] for r in out.groupBy("batch_id").count().collect()] == [8] * 5


def test_null_speakers_are_never_excluded(spark):
    train = spark.createDataFrame([("a",), ("unknown",), ("",), (None,)], "speaker_id string")
    rows = spark.createDataFrame([("a", 1), ("unknown", 2), ("", 3), (None, 4), ("b", 5)], "speaker_id string, k int")
    assert sorted(r.k for r in J.without_speakers(rows, train).collect()) == [2, 3, 4, 5]
    assert tuple(J.leak_report(rows, train).first()) == (1, 1, 4, 1)
