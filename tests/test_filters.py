import pytest
from pyspark.sql import functions as F

from kalangu.operators import arrays as B
from kalangu.operators import filters as P
from kalangu.operators import metrics as R

ROW = "k string, duration double, transcript string, accent string, speaker_id string"


def reasons(spark, rows, **kw):
    df = spark.createDataFrame(rows, ROW).coalesce(1)
    return [r.pass1.reason for r in P.metadata_pass(df, P.MetadataLimits(**kw)).collect()]


def test_metadata_bounds(spark):
    w = lambda n: " ".join(["ab"] * n)
    rows = [("a", 0.999, w(2), "", ""), ("b", 1.0, w(2), "", ""), ("c", 30.0, w(60), "", ""), ("d", 30.001, w(60), "", ""),
            ("e", 2.0, " ab ", "", ""), ("f", 2.0, " abc ", "", ""), ("g", 4.0, w(2), "", ""), ("h", 4.1, w(2), "", ""),
            ("i", 2.0, w(12), "", ""), ("j", 2.0, w(13), "", ""), ("k", 1.0, "x" * 30, "", ""), ("l", 1.0, "x" * 31, "", ""),
            ("m", None, "abc", "", ""), ("n", 2.0, None, None, None), ("o", 2.0, "a bc de", "", "")]
    assert reasons(spark, rows) == ["too_short", "pass", "pass", "too_long", "empty_transcript", "pass", "pass", "impossible_speech_rate",
                                    "pass", "impossible_speech_rate", "pass", "transcript_too_long", "too_short", "empty_transcript", "pass"]


def test_metadata_details(spark):
    df = spark.createDataFrame([("a", 2.0, "the patient nurse x", " Hausa ", "s")], ROW)
    d = P.metadata_pass(df).first().pass1.details
    assert (d.words, d.words_per_sec, d.domain, d.accent, d.accent_listed, d.chars) == (4, 2.0, "clinical", "hausa", True, None)


def capped(spark, sizes, cap):
    rows = [(f"{s}-{i}", 2.0, "ab cd ef", "", None if s == "none" else s) for s, n in sizes.items() for i in range(n)]
    rows += [("bad", 0.1, "ab", "", "big")]
    return P.cap_per_speaker(P.metadata_pass(spark.createDataFrame(rows, ROW)), "k", cap=cap)


def test_cap_is_exact_for_hot_and_missing_speakers(spark):
    out = capped(spark, {"big": 3000, "at": 20, "over": 21, "small": 3, "": 15, "none": 15}, 20)
    got = {r[0]: (r[1], r[2]) for r in out.groupBy(F.coalesce("speaker_id", F.lit(""))).agg(
        F.count_if(F.col("pass1.keep")), F.count_if(F.col("pass1.reason") == "speaker_cap")).collect()}
    assert got == {"big": (20, 2980), "at": (20, 0), "over": (20, 1), "small": (3, 0), "": (20, 10)}
    assert out.filter("k = 'bad'").first().pass1.reason == "too_short"
    d = out.filter("pass1.reason = 'speaker_cap' and speaker_id = 'big'").first().pass1.details
    assert (d.speaker_id, d.kept, d.words) == ("big", 20, None)


def test_cap_does_not_depend_on_partitioning(spark):
    a = capped(spark, {"big": 500}, 7)
    b = capped(spark.newSession(), {"big": 500}, 7).repartition(13)
    keys = lambda d: sorted(r.k for r in d.filter("pass1.keep").collect())
    assert keys(a) == keys(b) and len(keys(a)) == 7


@pytest.mark.parametrize("name,total,kept,status", [
    ("pass1", 100, 70, "ok"), ("pass1", 1000, 699, "fail"), ("pass1", 100, 98, "ok"), ("pass1", 100, 99, "warn"), ("pass1", 0, 0, "warn"),
    ("preprocess", 100, 98, "ok"), ("preprocess", 100, 97, "fail"), ("preprocess", 100, 100, "ok"), ("pass2", 100, 80, "ok"),
    ("pass2", 100, 79, "fail"), ("pass2", 1000, 991, "warn"), ("pass3", 100, 75, "ok"), ("pass3", 100, 74, "fail"), ("pass3", 100, 99, "ok")])
def test_guardrails(spark, name, total, kept, status):
    t = spark.createDataFrame([(name, total, kept)], "pass string, total long, kept long").withColumn("reject_pct", P.reject_percent("total", "kept"))
    assert P.guardrail_status(t).first()["status"] == status
    if status == "fail":
        with pytest.raises(RuntimeError):
            P.require_guardrails(t)
    else:
        P.require_guardrails(t)


def test_rejects_and_report_add_up(spark):
    out = capped(spark, {"big": 50, "small": 3}, 20)
    totals = P.pass_totals(out, ["pass1"]).first()
    assert totals["total"] == 54 and totals["total"] - totals["kept"] == P.rejects(out, "k", ["pass1"]).count()
    assert P.filter_report(P.pass_totals(out, ["pass1"]), "metadata").first()["passes"]["pass1"]["kept"] == 23


WAVE = "samples array<float>, sample_rate int"


def audio(spark, *waves, **kw):
    df = spark.createDataFrame([(w, 16000) for w in waves], WAVE).coalesce(1)
    return [r.pass2.reason for r in P.audio_pass(df, P.AudioLimits(**kw)).collect()]


def test_audio_cascade(spark):
    loud, soft = [0.5, -0.5] * 200, [0.01, -0.01] * 200
    good = (loud + soft) * 3
    assert audio(spark, [], None, [0.1] * 999, [0.0] * 1000, [1.0] * 1000, [0.5] * 1000, good) == [
        "corrupt_audio", "corrupt_audio", "too_few_samples", "silent", "clipped", "low_snr", "pass"]
    quiet = loud + [0.001, -0.001] * 800
    assert audio(spark, quiet) == ["mostly_silence"]


def test_clip_share_bound(spark):
    wave = [0.5, -0.5] * 490 + [0.9999] * 20
    assert audio(spark, wave, wave[:980] + [0.9999] * 21) == ["low_snr", "clipped"]


def test_single_frame_is_low_snr(spark):
    df = spark.createDataFrame([([0.5, -0.5] * 600, 50000)], WAVE)
    assert P.audio_pass(df).first().pass2.reason == "low_snr"


def test_segments(spark):
    def run(n):
        df = spark.createDataFrame([("a", [0.0] * n, 1000)], "k string, " + WAVE)
        return [(r.start, r.end) for r in B.segment_clips(df, "k", min_samples=100).orderBy("segment").collect()]

    assert run(30000) == []
    assert run(30100)[-1] == (30.0, 30.1) and len(run(30100)) == 11
    assert len(run(30050)) == 10


def test_manifest_errors(spark):
    rows = [("a", 1.0, "x", "en", None), ("", 0.0, " ", "zz", [(5, 5, "qq"), (0, 3, "en")])]
    df = spark.createDataFrame(rows, "audio_path string, duration double, text string, language string, "
                                     "cs_spans array<struct<start:int,end:int,language:string>>").coalesce(1)
    out = [r[0] for r in df.select(P.manifest_errors()).collect()]
    assert out[0] == [] and len(out[1]) == 6


def test_manifest_stats_empty(spark):
    df = spark.createDataFrame([], "language string, duration double, is_code_switched boolean")
    assert tuple(R.manifest_stats(df).first()) == (0, 0.0, {}, 0, 0.0, 0.0)
