import json

import pytest
from pyspark.sql import functions as F

from kalangu import schema as S
from kalangu.functions import nested as N
from kalangu.functions import timing as D
from kalangu.operators import arrays as B
from kalangu.operators import filters as P
from kalangu.operators import splits as J
from kalangu.operators.hooks import score_with
from kalangu.plans.evaluate import evaluate
from kalangu.session import fresh_path
from kalangu.sources import events as EV
from kalangu.sources import ingest
from kalangu.sources import manifests as MF
from kalangu.sources import records, sinks

GOOD = {"audio_path": "a.flac", "duration": 3.0, "text": "Ina son ƙasar Najeriya", "language": "ha"}


def lines(path, *rows):
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r, ensure_ascii=False) for r in rows) + "\n", encoding="utf-8")
    return str(path)


def test_manifest_round_trip_with_defaults(spark, tmp_path):
    src = lines(tmp_path / "m.jsonl", GOOD, "", "   ", {**GOOD, "cs_spans": [{"start": 0, "end": 3, "language": "ha"}], "is_code_switched": True})
    df = MF.read_manifest(spark, src)
    assert df.count() == 2
    row = df.filter("not is_code_switched").first()
    assert (row.sample_rate, row.dialect, row.cs_spans, row.text) == (16000, "", [], GOOD["text"])
    out = str(tmp_path / "out")
    MF.write_manifest(df, out)
    assert "ƙasar" in "".join(r.value for r in spark.read.text(out).collect())
    assert MF.read_manifest(spark, out).exceptAll(df).count() == 0


@pytest.mark.parametrize("bad,why", [
    ("{not json", "not a manifest row"), ({"audio_path": "x"}, "missing duration,text,language"), ({**GOOD, "extra": 1}, "unknown extra"),
    ({**GOOD, "cer": 0.1}, "unknown cer"), ("[1, 2]", "not a manifest row"), ({**GOOD, "duration": "long"}, "not a manifest row")])
def test_strict_scan_fails(spark, tmp_path, bad, why):
    src = lines(tmp_path / "m.jsonl", GOOD, bad)
    with pytest.raises(Exception) as info:
        MF.read_manifest(spark, src).collect()
    assert why in str(info.value) and "m.jsonl" in str(info.value)


def test_strict_scan_of_extended_and_missing(spark, tmp_path):
    src = lines(tmp_path / "m.jsonl", {**GOOD, "cer": 0.25, "gender": "f"})
    assert MF.read_manifest(spark, src, extended=True).first().cer == 0.25
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        MF.read_manifest(spark, str(tmp_path / "none"))


def test_writer_modes(spark, tmp_path):
    df = MF.read_manifest(spark, lines(tmp_path / "m.jsonl", GOOD))
    out = str(tmp_path / "out")
    for mode, n in (("append", 1), ("append", 2), ("overwrite", 1)):
        MF.write_manifest(df, out, mode)
        assert MF.iter_manifest(spark, out).count() == n
    with pytest.raises(ValueError):
        MF.write_manifest(df, out, "ignore")


def test_metadata_scan(spark, tmp_path):
    row = {"file": "n/1_spk.flac", "transcript": "the patient nurse", "accent": " HAUSA ", "country": "NG", "split": "train", "duration": 4.5}
    src = lines(tmp_path / "m.jsonl", row, {**row, "file": "n/2.flac", "duration": None, "transcript": None})
    a, b = MF.read_corpus_metadata(spark, src, "/data").orderBy("file").collect()
    assert (a.raw_audio_path, a.speaker_id, a.domain, a.language, a.accent, a.duration) == (
        "/data/n/1_spk.flac", "spk", "clinical", "en", "hausa", 4.5)
    assert (b.speaker_id, b.domain, b.duration) == ("2", "general", 0.0)
    with pytest.raises(Exception):
        MF.read_corpus_metadata(spark, lines(tmp_path / "b.jsonl", "{bad"), "/data").collect()


def test_events_scan(spark, tmp_path):
    ev = {"ts": 1.0, "run_id": "r", "type": "step", "step": 3, "loss": 2.5}
    lines(tmp_path / "stage1_encoder_events.jsonl", ev, "{bad", "", {"ts": 2.0, "type": "error", "message": "x"})
    out = EV.read_all_events(spark, str(tmp_path)).orderBy("ts").collect()
    assert [(r.run_id, r.stage_name, r.type) for r in out] == [("r", "stage1_encoder", "step"), ("stage1_encoder_events", "stage1_encoder", "error")]
    assert out[0].pos < out[1].pos
    assert EV.read_events(spark, str(tmp_path / "missing.jsonl")).count() == 0


def test_event_sink_drops_nulls_and_checks_fields(spark, tmp_path):
    df = spark.createDataFrame([("r", 1.0)], "run string, t double")
    out = str(tmp_path / "e")
    EV.emit(EV.event(df, "step", F.col("t"), F.col("run"), step=F.lit(1), loss=F.lit(None).cast("double")), out)
    EV.emit(EV.event(df, "error", F.col("t"), F.col("run"), message=F.lit("boom")), out)
    written = [json.loads(r.value) for r in spark.read.text(out).collect()]
    assert sorted(written, key=str) == sorted([{"ts": 1.0, "run_id": "r", "type": "step", "step": 1},
                                               {"ts": 1.0, "run_id": "r", "type": "error", "message": "boom"}], key=str)
    with pytest.raises(ValueError):
        EV.event(df, "step", F.col("t"), F.col("run"), message=F.lit("x"))


def test_reports_skip_malformed_and_leaderboard(spark, tmp_path):
    for name, body in (("a", '{"run_id": "a", "mode": "clean",\n "wer": {"en": 0.1}}'), ("b", "{bad"), ("leaderboard", '{"run_id": "z"}')):
        (tmp_path / f"{name}.json").write_text(body)
    assert [r.run_id for r in records.read_reports(spark, str(tmp_path)).collect()] == ["a"]


def test_speaker_map_of_one_indented_object(spark, tmp_path):
    entry = {"speaker_id": "s", "age_group": "19-25", "gender": "", "split_origin": "train"}
    body = {"x/one.flac": entry, "two.flac": {**entry, "speaker_id": ""}, "y/one.wav": {**entry, "speaker_id": "last"}}
    (tmp_path / "map.json").write_text(json.dumps(body, indent=2))
    got = {r.stem: r.speaker_id for r in records.read_speaker_map(spark, str(tmp_path / "map.json")).collect()}
    assert got == {"one": "last", "two": ""}
    (tmp_path / "brace.json").write_text(json.dumps({"a}b.wav": {**entry, "speaker_id": "x}y\\"}, "c.wav": entry}))
    got = {r.stem: r.speaker_id for r in records.read_speaker_map(spark, str(tmp_path / "brace.json")).collect()}
    assert got == {"a}b": "x}y\\", "c": "s"}
    (tmp_path / "bad.json").write_text('{"a": {"speaker_id": }}')
    with pytest.raises(Exception, match="bad speaker entry"):
        records.read_speaker_map(spark, str(tmp_path / "bad.json")).collect()


def test_paths_with_blanks_and_diacritics(spark, tmp_path):
    root = tmp_path / "my corpus" / "ẹ+x%20"
    for sub in ("labels", "sentences/wav"):
        (root / sub).mkdir(parents=True)
    lines(root / "labels/x.lab", "u1 0.5 exc extra")
    (root / "sentences/wav/u1.wav").write_bytes(b"x")
    (root / "03-01-05-01.wav").write_bytes(b"x")
    assert [r.audio_path for r in records.read_lab_labels(spark, str(root)).collect()] == [str(root / "sentences/wav/u1.wav")]
    assert [r.label for r in records.read_stem_labels(spark, str(root)).collect()] == ["angry"]
    events = tmp_path / "my corpus" / "stage ẹ_events.jsonl"
    events.mkdir()
    for part in range(4):  # parts of one folder, equal times
        lines(events / f"part-{part}.json", *[{"ts": 1.0, "type": "step", "step": 10 * part + k} for k in range(5)])
    rows = EV.read_all_events(spark, str(tmp_path / "my corpus")).collect()
    assert {(r.stage_name, r.run_id) for r in rows} == {("stage ẹ", "stage ẹ_events")}
    assert len({r.pos for r in rows}) == len(rows) == 20


def test_lenient_scan_raises_on_a_bad_line_and_fills_defaults(spark, tmp_path):
    lines(tmp_path / "m.jsonl", {"audio_path": "a", "duration": 1.0, "text": "t", "language": "en"})
    row = MF.iter_manifest(spark, str(tmp_path / "m.jsonl")).first()
    assert (row.sample_rate, row.is_code_switched, row.cs_spans, row.dialect, row.corpus) == (16000, False, [], "", "")
    lines(tmp_path / "bad.jsonl", "{not json")
    with pytest.raises(Exception):
        MF.iter_manifest(spark, str(tmp_path / "bad.jsonl")).collect()


def test_stage_depends_on_all_columns_and_parameters(spark, tmp_path):
    made = []

    def compute(df):
        made.append(1)
        return df

    rows = spark.createDataFrame([("k", "text", {"a": 1})], "key string, text string, m map<string,int>")
    for df, params in ((rows, 1), (rows, 1), (rows.withColumn("text", F.lit("other")), 1), (rows, 2), (rows, 2)):
        sinks.stage(df, str(tmp_path / "st"), compute, params).collect()
    assert len(made) == 3


def test_filter_cache_last_file_wins(spark, tmp_path):
    for split, row in (("dev", {"audio_path": "a", "cer": 0.1}), ("test", {"keep": True, "details": {"audio_path": "a", "cer": 0.2}})):
        (tmp_path / split).mkdir()
        lines(tmp_path / split / "transcript_results.jsonl", row, {"cer": 0.3})
    out = records.read_filter_cache(spark, str(tmp_path / "*" / "transcript_results.jsonl")).collect()
    assert [(r.audio_path, r.cer) for r in out] == [("a", 0.2)]


def test_label_files(spark, tmp_path):
    for sub in ("s1/labels", "s1/sentences/wav"):
        (tmp_path / sub).mkdir(parents=True)
    lines(tmp_path / "s1/labels/x.lab", "u1 0.5 exc extra", "u2 0.5 zzz", "u3 0.5", "u4 0.5 fru", "u5 1 ang")
    for u in ("u1", "u2", "u3", "u4"):
        (tmp_path / f"s1/sentences/wav/{u}.wav").write_bytes(b"x")
    out = records.read_lab_labels(spark, str(tmp_path)).orderBy("audio_path").collect()
    assert [(r.audio_path.rsplit("/", 1)[1], r.label) for r in out] == [("u1.wav", "happy"), ("u4.wav", "neutral")]
    (tmp_path / "a").mkdir()
    for n in ("03-01-05-01", "03-01", "03-01-09-01"):
        (tmp_path / f"a/{n}.wav").write_bytes(b"x")
    assert [r.label for r in records.read_stem_labels(spark, str(tmp_path / "a")).collect()] == ["angry"]


def test_file_inventory(spark, tmp_path):
    (tmp_path / "stage1").mkdir()
    for n, size in (("root.pt", 3), ("stage1/step_1.pt", 5), ("stage1/x.txt", 1)):
        (tmp_path / n).write_bytes(b"x" * size)
    out = records.newest_files(records.read_files(spark, str(tmp_path))).collect()
    assert sorted((r.id, r.stage, r.size_bytes, r.path) for r in out) == [("root", "unknown", 3, "root.pt"), ("step_1", "stage1", 5, "stage1/step_1.pt")]


def test_feedback(spark, tmp_path):
    df = spark.createDataFrame([(1.0, "emotion", 5, None, "v"), (1.0, "zzz", 1, "c", "v")], S.FEEDBACK)
    sinks.append_feedback(df, str(tmp_path / "f"))
    sinks.append_feedback(df, str(tmp_path / "f"))
    assert {r.task: r["count"] for r in spark.read.json(str(tmp_path / "f")).groupBy("task").count().collect()} == {"emotion": 2, "other": 2}
    for rating in (0, 6, None):
        with pytest.raises(Exception, match="rating must be"):
            sinks.checked_feedback(spark.createDataFrame([(1.0, "emotion", rating, "", "v")], S.FEEDBACK)).collect()


def test_stage_is_reused_only_for_the_same_input(spark):
    path, runs = fresh_path(spark, "stage"), []

    def compute(df):
        runs.append(1)
        return df.withColumn("y", F.col("id") * 2)

    same = [sinks.stage(spark.range(5), path, compute, dry_run=dry).count() for dry in (True, False, False, True)]
    assert same == [5] * 4 and len(runs) == 2
    assert sinks.stage(spark.range(1, 6), path, compute).agg(F.sum("y")).first()[0] == 30
    assert len(runs) == 3


def test_score_merge_statuses(spark):
    m = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "audio_path string")
    cache = spark.createDataFrame([("a", 0.40, True, "ha"), ("b", 0.41, None, None), ("c", None, None, "")],
                                  "audio_path string, cer double, is_code_switched boolean, detected_language string")
    out = {r.audio_path: (r.status, r.is_code_switched, r.detected_language) for r in J.score_status(m, cache).collect()}
    assert out == {"a": ("kept", True, "ha"), "b": ("dropped", False, None), "c": ("kept", False, None), "d": ("missing", False, None)}
    assert {r.audio_path for r in J.apply_scores(m, cache).collect()} == {"a", "c"}


def test_ingest(spark):
    rows = spark.createDataFrame([("f1", "ng", True, 16000, 1), ("f1", "NG", True, 16000, 2), ("f2", "gh", True, 16000, 3), ("f3", " Nigeria ", False, 16000, 4),
                                  ("f4", "NG", True, 11025, 5), ("f5", "NG", True, 8000, 6), ("f6", "NG", True, 8000, 7)],
                                 "file string, country string, has_audio boolean, sample_rate int, order int")
    seen = spark.createDataFrame([("f6",)], "file string")
    assert sorted(r.file for r in ingest.new_rows(rows, seen).collect()) == ["f1", "f5"]
    assert [r.file for r in ingest.new_rows(rows, None, max_rows=1).collect()] == ["f1"]


def test_hook_isolates_failures(spark):
    def load():
        import pandas as pd

        def run(frame):
            if (frame["x"] == 3).any():
                raise ValueError("three")
            return pd.DataFrame({"y": frame["x"] * 10})
        return run

    out = score_with(spark.range(6).withColumnRenamed("id", "k").withColumn("x", F.col("k")), load, "k", "y long", batch_rows=4)
    assert {r.k: (r.y, r.error) for r in out.collect()} == {k: (None, "three") if k == 3 else (k * 10, None) for k in range(6)}


def test_spans_may_overrun(spark):
    text = "I go the market buy ƙayan abinci na gida"
    df = spark.createDataFrame([("k", text, [(0, 19, "en"), (20, 42, "ha"), (90, 95, "yo")])],
                               "k string, text string, cs_spans array<struct<start:int,end:int,language:string>>")
    assert [r.text for r in B.span_rows(df, "k").orderBy("pos").collect()] == [text[0:19], text[20:42], ""]


def test_payloads(one, spark):
    assert one("p string", [("aGVsbG8=",)], N.decode_payload(F.col("p"))) == [b"hello"]
    with pytest.raises(Exception, match="not base64"):
        spark.createDataFrame([("*",)], "p string").select(N.decode_payload(F.col("p"))).collect()


def test_event_envelope_and_wer_field(one):
    j = '{"ts": 1.5, "run_id": "r", "type": "eval", "step": 3, "wer": {"overall": 0.2}}'
    e = one("j string", [(j,)], N.envelope(F.col("j")))[0]
    assert (e.ts, e.run_id, e.type, sorted(e.data)) == (1.5, "r", "eval", ["step", "wer"])
    assert one("j string", [(j,), ('{"wer": 0.3}',), ('{"wer": {}}',), ("{}",)], N.wer_value(F.col("j"))) == [0.2, 0.3, None, None]


def test_times(one):
    assert one("i string", [("2024-01-01T00:00:59",)], D.minutes_since(F.col("i"), F.lit(1704067200.0 + 179))) == [2]
    p = one("r string", [("stage1_mini_20240131_235959_0a1f",), ("plain",)], D.parse_run_id(F.col("r")))
    assert tuple(p[0]) == ("stage1_mini", "20240131_235959", "0a1f") and tuple(p[1]) == ("", "", "")
    assert one("s int, t int", [(1, 0), (1, 3), (3, 3)], D.percent_done(F.col("s"), F.col("t"))) == [0, 33, 100]


def test_epoch_does_not_depend_on_session_zone(spark):
    df = spark.sql("select timestamp_ntz'2024-07-01 12:00:00.250' as t")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for z in ("UTC", "America/New_York", "Africa/Lagos"):
            spark.conf.set("spark.sql.session.timeZone", z)
            assert df.select(D.epoch_seconds(F.col("t"))).first()[0] == 1719835200.25
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_padding(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (1, [3.0]), (2, [4.0])], "b int, x array<double>")
    out = B.pad_batches(df, "b", {"x": -100}).orderBy("b", F.desc("x_length")).collect()
    assert [(r.x, r.x_length) for r in out] == [([1.0, 2.0], 2), ([3.0, -100.0], 1), ([4.0], 1)]


def test_evaluate_tiers(spark):
    rows = [(str(i), d, "a b c d", h) for i, (d, h) in enumerate([(0.4, "a"), (2.0, "a b c d"), (3.0, "a b c x"), (6.0, ""), (7.0, None)])]
    scored, tiers = evaluate(spark.createDataFrame(rows, "key string, duration double, ref string, hyp string").fillna({"hyp": ""}), "key")
    got = {r.tier: r for r in tiers.collect()}
    assert scored.count() == 4 and set(got) == {"all", "short_lt_3s", "ge_3s", "ge_5s"}
    a = got["all"]
    assert (a.n, a.mean_wer, a.median_wer, a.p25_wer, a.p95_wer, a.empty_hyps) == (4, 0.5625, 0.625, 0.25, 1.0, 2)


def test_thinning(spark):
    df = spark.range(1, 1001).select(F.col("id").alias("step"), F.lit(1000).alias("total_steps"))
    assert [r.step for r in P.thin_steps(df).orderBy("step").limit(3).collect()] == [1, 10, 20]
    assert P.thin_steps(df.withColumn("total_steps", F.lit(9))).count() == 1000
    assert P.thin_steps(df, 500).count() == 3


def test_line_numbers_over_many_parts(spark, tmp_path):
    from kalangu.sources.lines import numbered

    for name, n in (("a", 900), ("b", 1), ("c", 400)):
        (tmp_path / f"{name}.jsonl").write_text("".join(f"{name}{k}{'x' * (k % 40)}\n" for k in range(1, n + 1)))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        df = numbered(spark, str(tmp_path))
        assert df.select("_start").distinct().count() > 8
        rows = sorted((r._file, r._line, r._place, r.value) for r in df.collect())
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert [r[2] for r in rows] == list(range(1301))
    assert all(r[3].rstrip("x") == f"{r[0][-7]}{r[1]}" for r in rows)


def test_strict_scan_names_the_line(spark, tmp_path):
    good = {"audio_path": "a", "duration": 1.0, "text": "t", "language": "en"}
    lines(tmp_path / "m.jsonl", good, "", good, {**good, "odd": 1})
    with pytest.raises(Exception, match=r"m\.jsonl:4: unknown odd"):
        MF.read_manifest(spark, str(tmp_path / "m.jsonl")).collect()
