import pytest
from pyspark.sql import functions as F

from kalangu.operators import filters as P
from kalangu.plans import curate as R
from kalangu.sources import manifests as MF

ROWS = [(f"p{i}", f"p{i}", 4.0, "the quick brown fox jumps over it", "the quick brown fox jumps over it", "acc", f"s{i % 4}", "en") for i in range(12)]
DDL = "audio_path string, raw_audio_path string, duration double, transcript string, text string, accent string, speaker_id string, language string"
PASSES = ["pass1", "preprocess", "pass2", "pass3"]


def given(spark, without_audio=(), without_pre=(), without_text=()):
    """Loud clips with a pause, and the rows that are missing from each table."""
    loud = [0.0] * 800 + [0.5, -0.5] * 7600
    keys = [r[0] for r in ROWS]
    frame = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    return {"audio": frame([(k, loud, 16000) for k in keys if k not in without_audio], "audio_path string, samples array<float>, sample_rate int"),
            "preprocessed": frame([(k, True) for k in keys if k not in without_pre], "audio_path string, ok boolean"),
            "transcripts": frame([(k, ROWS[0][3], "en") for k in keys if k not in without_text],
                                 "audio_path string, hypothesis string, detected_language string")}


def test_no_clip_vanishes(spark):
    rows = spark.createDataFrame(ROWS, DDL)
    out = R.curate(rows, "audio_path", **given(spark, ["p1", "p2"], ["p3"], ["p4"]))
    got = {r.audio_path: [r[p].reason if r[p] else None for p in PASSES] for r in out.collect()}
    assert len(got) == len(ROWS)
    assert got["p1"] == got["p2"] == ["pass", "pass", "corrupt_audio", None]
    assert got["p3"] == ["pass", "preprocess_failed", None, None] and got["p4"] == ["pass", "pass", "pass", "asr_error"]
    assert got["p5"] == ["pass"] * 4
    totals = {r["pass"]: (r.total, r.kept) for r in P.pass_totals(out, PASSES).collect()}
    assert totals == {"pass1": (12, 12), "preprocess": (12, 11), "pass2": (11, 9), "pass3": (9, 8)}
    rejected = {(r["pass"], r.audio_path) for r in P.rejects(out, "audio_path", PASSES).collect()}
    assert rejected == {("pass2", "p1"), ("pass2", "p2"), ("preprocess", "p3"), ("pass3", "p4")}


def test_guardrail_stops_before_the_costly_pass(spark):
    rows = spark.createDataFrame([(*r[:2], 0.1, *r[3:]) for r in ROWS], DDL)

    class Untouched:
        def __getattr__(self, name):
            raise AssertionError("audio was looked at")

    with pytest.raises(RuntimeError, match="pass1 rejected 100.0%"):
        R.curate(rows, "audio_path", audio=Untouched(), guardrails={"pass1": (30.0, 2.0)})


def test_run_writes_and_resumes(spark, tmp_path, monkeypatch):
    twice = [*ROWS, ROWS[0]]
    rows = spark.createDataFrame([*twice, ("px", "px", 4.0, "  the quick brown fox jumps", "t", "acc", "s9", "xx")], DDL)
    tables = given(spark)
    path = str(tmp_path / "run")
    totals = R.run(rows.dropDuplicates(["audio_path"]), "audio_path", path, guardrails={}, cap=50, **tables)
    assert {r["pass"]: r.total for r in totals.collect()}["pass1"] == 13
    manifest = MF.read_manifest(spark, f"{path}/manifest").collect()
    assert sorted(r.audio_path for r in manifest) == sorted(r[0] for r in ROWS)  # px has no audio
    measured = []
    real = P.audio_pass
    monkeypatch.setattr(P, "audio_pass", lambda *a, **k: measured.append(1) or real(*a, **k))
    R.run(rows.dropDuplicates(["audio_path"]), "audio_path", path, guardrails={}, cap=50, **tables)
    assert not measured  # pass 2 came from its stage
    R.run(rows.dropDuplicates(["audio_path"]), "audio_path", path, guardrails={}, cap=50, audio_limits=P.AudioLimits(min_samples=999), **tables)
    assert measured  # other limits, other stage


def test_manifest_is_deduplicated_and_valid(spark, tmp_path):
    rows = spark.createDataFrame([("a", "t", "en", "d1"), ("a", "t", "en", "d2"), ("b", " ", "en", "d"), ("c", "t", "zz", "d")],
                                 "raw_audio_path string, transcript string, language string, accent string")
    rows = rows.withColumn("duration", F.lit(1.0)).withColumn("pass1", F.struct(F.lit(True).alias("keep")))
    out = R.build_manifest(rows, ["pass1"], str(tmp_path / "m"))
    assert [(r.audio_path, r.dialect) for r in out.collect()] == [("a", "d1")]


def test_samples_are_not_exchanged(spark):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plans = []
        real = R.P.audio_pass

        def watched(df, limits):
            out = real(df, limits)
            plans.append(out.select("audio_path", "pass2")._jdf.queryExecution().toString())
            return out

        R.P.audio_pass = watched
        try:
            R.curate(spark.createDataFrame(ROWS, DDL), "audio_path", "audio", **given(spark)).count()
        finally:
            R.P.audio_pass = real
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert plans and not any("Exchange" in p or "Join" in p for p in plans)


def counted(spark, keys):
    """Clips whose waveforms count how often they are computed."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("array<float>")
    def samples(key):
        seen.add(1)
        return [0.0] * 800 + [0.5, -0.5] * 7600

    audio = spark.createDataFrame([(k,) for k in keys], "audio_path string").repartition(2)
    return audio.select("audio_path", samples("audio_path").alias("samples"), F.lit(16000).alias("sample_rate")), seen


def test_preprocessing_is_guarded_before_waveforms_are_read(spark):
    rows = spark.createDataFrame(ROWS, DDL)
    audio, seen = counted(spark, [r[0] for r in ROWS])
    failed = rows.select("audio_path", F.lit(False).alias("ok"))
    with pytest.raises(RuntimeError, match="preprocess rejected 100.0%"):
        R.curate(rows, "audio_path", audio=audio, preprocessed=failed, guardrails={"preprocess": (1.0, None)}, level="audio")
    assert seen.value == 0


def test_waveforms_are_computed_once_and_for_kept_clips_only(spark, tmp_path):
    rows = spark.createDataFrame([r if i < 4 else (*r[:2], 0.1, *r[3:]) for i, r in enumerate(ROWS)], DDL)  # eight are too short
    audio, seen = counted(spark, [r[0] for r in ROWS])
    out = R.curate(rows, "audio_path", audio=audio, level="audio", stages=str(tmp_path / "s"))
    assert out.filter("pass2.keep").count() == 4 and seen.value == 4
    again = R.curate(rows, "audio_path", audio=audio, level="audio", stages=str(tmp_path / "s"))
    assert again.filter("pass2.keep").count() == 4 and seen.value == 4
    R.curate(rows, "audio_path", audio=audio, level="audio", stages=str(tmp_path / "s"), audio_version="2")
    assert seen.value == 8


def test_key_filter_lets_every_key_through(spark):
    from kalangu.operators.scale import key_filter

    keys = spark.range(0, 3000, 3).selectExpr("cast(id AS string) AS k")
    every = spark.range(9000).selectExpr("cast(id AS string) AS k")
    for most, least in ((1 << 26, 8900), (64, 0)):
        passed = {int(r.k) for r in every.filter(key_filter(keys, "k", most)(F.col("k"))).collect()}
        assert passed >= set(range(0, 3000, 3)) and 9000 - len(passed) >= least - 1000
