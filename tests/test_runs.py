import math

from pyspark.sql import functions as F

from kalangu import schema as S
from kalangu.operators import runs as E
from kalangu.session import fresh_path
from kalangu.sources import events as EV
from kalangu.streaming import events as ST
from kalangu.streaming import ingest as SI

LINES = [
    '{"ts": 1.0, "run_id": "r1", "type": "train_start", "stage": 1, "run_name": "r1", "config_yaml": "", "total_steps": 200000}',
    '{"ts": 2.0, "run_id": "r1", "type": "step", "step": 10, "loss": 3.1, "lr": 0.001, "grad_norm": 1.0, "epoch": 0}',
    '{"ts": 3.0, "run_id": "r1", "type": "step", "step": 20, "loss": 2.98, "lr": 0.001, "grad_norm": 1.0, "epoch": 0}',
    '{"ts": 4.0, "run_id": "r1", "type": "eval", "step": 1000, "wer": {"en": 0.09, "ha": 0.14, "yo": 0.12, "ig": 0.21, "pcm": 0.18}, "cs_wer": 0.24, "eval_loss": 1.87}',
    '{"ts": 5.0, "run_id": "r1", "type": "checkpoint_saved", "step": 1000, "path": "x", "is_best": true}',
    '{"ts": 1.0, "run_id": "r2", "type": "train_start", "total_steps": 100}', '{"ts": 2.0, "run_id": "r2", "type": "step", "step": 10, "loss": 2.5}',
    '{bad', '', '{"ts": 3.0, "run_id": "r2", "type": "eval", "step": 10, "wer": {}, "eval_loss": null}', '{"ts": 4.0, "run_id": "r2", "type": "train_end", "total_steps": 10}',
    '{"ts": 1.0, "run_id": "r3", "type": "error", "message": "x"}', '{"ts": 2.0, "run_id": "r3", "type": "step", "step": 5, "loss": 1.0}',
    '{"ts": 3.0, "run_id": "r3", "type": "step", "step": 4}', '{"ts": 3.0, "run_id": "r3", "type": "train_end"}',
]


def test_run_fold(spark, tmp_path):
    (tmp_path / "stage1_events.jsonl").write_text("\n".join(LINES) + "\n")
    got = {r.run_id: r for r in E.run_summaries(EV.read_all_events(spark, str(tmp_path))).collect()}
    a, b, c = got["r1"], got["r2"], got["r3"]
    assert (a.status, a.step, a.total_steps, a.train_loss, a.val_loss) == ("running", 20, 200000, 2.98, 1.87)
    assert math.isclose(a.wer, 0.148) and (a.created_at, a.updated_at) == (1.0, 5.0)
    assert (b.status, b.step, b.train_loss, b.val_loss, b.wer) == ("completed", 10, 2.5, None, None)
    # the last step has no loss, and the last of train_end and error decides
    assert (c.status, c.step, c.train_loss, c.total_steps) == ("completed", 5, None, 0)


def test_nan_becomes_null(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1.0, "r", "step", nan, None, 1), (2.0, "r", "eval", None, nan, 2)],
                               "ts double, run_id string, type string, loss double, eval_loss double, pos long")
    for f in S.EVENT.fields:
        if f.name not in df.columns:
            df = df.withColumn(f.name, F.lit(None).cast(f.dataType))
    r = E.run_summaries(df, keys=["run_id"]).first()
    assert (r.train_loss, r.val_loss, r.wer) == (None, None, None)


def test_stream_equals_batch(spark, tmp_path):
    src = tmp_path / "events"
    src.mkdir()
    rows = [x.replace('"run_id"', f'"epoch": {i}, "run_id"') for i, x in enumerate(LINES)]
    for k in range(3):
        (src / f"part{k}.jsonl").write_text("\n".join(rows[k::3]) + "\n")
    out = fresh_path(spark, "live")
    live = ST.live_summaries(ST.event_stream(spark, str(src), 1), ["run_id"], ["ts", "epoch"])
    ST.keep_latest(live, ["run_id"], out, fresh_path(spark, "ck")).awaitTermination()
    got = ST.read_latest(spark, out, ["run_id"])
    want = E.run_summaries(EV.read_events(spark, str(src)).drop("pos"), order=["ts", "epoch"], keys=["run_id"])
    assert spark.read.parquet(out).count() <= 2 * 3  # two versions at most, whatever the number of batches
    assert got.select(*want.columns).exceptAll(want).count() == 0 and got.count() == want.count() == 3


def test_ingest_stream_resumes(spark, tmp_path):
    src, out, ck = str(tmp_path / "src"), fresh_path(spark, "out"), fresh_path(spark, "ck")
    ddl = "file string, country string, has_audio boolean, sample_rate int"

    def feed(*files):
        spark.createDataFrame([(f, "NG", True, 16000) for f in files], ddl).write.mode("append").parquet(src)
        stream = spark.readStream.schema(ddl).parquet(src)
        ST.append_stream(SI.new_files(stream).select("file"), out, ck).awaitTermination()
        return sorted(r.file for r in spark.read.schema("file string").parquet(out).collect())

    assert feed("a", "b", "a") == ["a", "b"]
    assert feed("b", "c") == ["a", "b", "c"]


def test_late_files_are_written_once(spark, tmp_path):
    src, out, ck = str(tmp_path / "src"), fresh_path(spark, "out"), fresh_path(spark, "ck")
    ddl = "file string, country string, has_audio boolean, sample_rate int, ts timestamp"

    def feed(day, *files):
        rows = spark.createDataFrame([(f, "NG", True, 16000) for f in files], ddl[:ddl.rindex(",")])
        rows.withColumn("ts", F.lit(day).cast("timestamp")).write.mode("append").parquet(src)
        SI.ingest_new(spark.readStream.schema(ddl).parquet(src), out, ck).awaitTermination()
        return sorted(r.file for r in spark.read.parquet(out).collect())

    assert feed("2024-06-01", "a", "b", "a") == ["a", "b"]
    assert feed("2020-01-01", "late", "a") == ["a", "b", "late"]


def test_stream_names_stage_and_run_like_the_scan(spark, tmp_path):
    (tmp_path / "warm ẹ_events.jsonl").write_text('{"ts": 1.0, "type": "step", "step": 3}\n')
    out = fresh_path(spark, "named")
    stream = ST.event_stream(spark, str(tmp_path)).select("run_id", "stage_name", "step")
    ST.append_stream(stream, out, fresh_path(spark, "ck")).awaitTermination()
    want = EV.read_all_events(spark, str(tmp_path)).select("run_id", "stage_name", "step").collect()
    assert [tuple(r) for r in spark.read.parquet(out).select("run_id", "stage_name", "step").collect()] == [tuple(r) for r in want]


def test_loss_series_last_event_wins(spark):
    rows = [(1.0, 1, "step", 5, 3.0, None), (2.0, 2, "step", 5, 2.0, None), (3.0, 3, "eval", 5, None, 1.0), (4.0, 4, "eval", 7, None, None)]
    df = spark.createDataFrame(rows, "ts double, pos int, type string, step int, loss double, eval_loss double")
    assert [tuple(r) for r in E.loss_series(df, keys=[]).collect()] == [(5, 2.0, 1.0)]


def test_eta(spark):
    df = spark.createDataFrame([(9,), (10,), (None,)], "step int")
    out = E.eta(df, F.lit(220.0), F.lit(100.0), 110).collect()
    assert [r.eta for r in out] == ["calculating...", "0.3h", "calculating..."]
    assert E.eta(df, F.lit(219.0), F.lit(100.0), 110).filter("rate is not null").count() == 0
