"""Queries that run a stream over files to its end and read what it wrote."""

from pyspark.sql import functions as F

from kalangu.functions.timing import epoch_seconds
from kalangu.plans import views as V
from kalangu.plans.catalog import query
from kalangu.plans.run_queries import SUMMARY, SUMMARY_SQL
from kalangu.plans.split_queries import _INGEST
from kalangu.plans.views import with_views
from kalangu.session import fresh_path
from kalangu.streaming import events as ST
from kalangu.streaming import ingest as SI


def event_files(spark, sf, files=2):
    """The run events as JSON lines, a folder per stage with a few files each, bad lines among them."""
    path = fresh_path(spark, "event_files")
    e = V.run_events(spark, sf)
    # the order within equal timestamps travels as the epoch field
    good = e.select("pos", "stage_name", F.to_json(F.struct(*[c for c in e.columns if c not in ("stage_name", "pos")], F.col("pos").cast("int").alias("epoch"))).alias("value"))
    bad = e.filter("pos % 50 = 0").select("pos", "stage_name", F.lit('{"ts": 1, "run_').alias("value"))
    rows = good.unionByName(bad)
    for (stage,) in rows.select("stage_name").distinct().collect():
        rows.filter(F.col("stage_name") == stage).repartition(files, "pos").select("value").write.text(f"{path}/{stage}_events.jsonl")
    return f"{path}/*_events.jsonl"


@query("event_tail_stream", with_views("ev", body="SELECT ts, type, step, pos::INT AS epoch FROM ev WHERE run_id = 'run_7'"))
def _(spark, sf):
    out, ck = fresh_path(spark, "tail"), fresh_path(spark, "tail_ck")
    stream = ST.tail(ST.event_stream(spark, event_files(spark, sf), 2), "run_7").select("ts", "type", "step", "epoch")
    ST.append_stream(stream, out, ck).awaitTermination()
    return spark.read.schema("ts double, type string, step bigint, epoch int").parquet(out)


@query("live_run_summaries", with_views("runs", body=f"SELECT {SUMMARY_SQL} FROM runs"))
def _(spark, sf):
    out, ck = fresh_path(spark, "live"), fresh_path(spark, "live_ck")
    stream = ST.event_stream(spark, event_files(spark, sf), 2)
    keys = ["stage_name", "run_id"]
    ST.keep_latest(ST.live_summaries(stream, keys, ["ts", "epoch"]), keys, out, ck).awaitTermination()
    return ST.read_latest(spark, out, keys).withColumn("wer", F.round("wer", 9)).select(*SUMMARY)


@query("progress_snapshot_stream", with_views("ev", body="""SELECT run_id, arg_max(step, row(ts, pos)) FILTER (WHERE type = 'step') AS last_step, arg_max(loss, row(ts, pos)) FILTER (WHERE type = 'step') AS last_loss,
    arg_max(eval_loss, row(ts, pos)) FILTER (WHERE type = 'eval') AS last_eval_loss, count(*) AS events FROM ev GROUP BY run_id"""))
def _(spark, sf):
    out, ck = fresh_path(spark, "snapshot"), fresh_path(spark, "snapshot_ck")
    stream = ST.event_stream(spark, event_files(spark, sf), 2)
    ST.keep_latest(ST.latest_figures(stream, ["run_id"], ["ts", "epoch"]), ["run_id"], out, ck).awaitTermination()
    return ST.read_latest(spark, out, ["run_id"])


@query("ingest_stream", f"WITH {_INGEST} SELECT file FROM w")
def _(spark, sf):
    from kalangu.plans.split_queries import ingest_rows

    src, out, ck = (fresh_path(spark, x) for x in ("ingest_src", "ingest", "ingest_ck"))
    rows = ingest_rows(spark, sf)
    rows.repartition(4, "file").write.parquet(src)
    seen = V.table(spark, sf, "labels").select(F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("file"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(src)
    ST.append_stream(SI.new_files(stream, seen).select("file"), out, ck).awaitTermination()
    return spark.read.schema("file string").parquet(out)


@query("feedback_stream", """SELECT CASE WHEN event_type = 'click' THEN 'emotion' ELSE 'other' END AS task, count(*) AS n FROM events
    WHERE (props::JSON ->> '$.k')::BIGINT % 8 BETWEEN 1 AND 5 GROUP BY 1""")
def _(spark, sf):
    src, out, ck = (fresh_path(spark, x) for x in ("feedback_src", "feedback", "feedback_ck"))
    e = V.table(spark, sf, "events")
    rows = e.select(epoch_seconds(F.col("ts")).alias("ts"), F.when(F.col("event_type") == "click", "emotion").otherwise(F.col("event_type")).alias("task"),
                    (F.get_json_object("props", "$.k").cast("int") % 8).alias("rating"))
    rows.write.json(src)
    stream = spark.readStream.schema(rows.schema).json(src)
    ST.append_stream(SI.feedback_rows(stream), out, ck, ["task"], "json").awaitTermination()
    return spark.read.schema("ts double, rating int, task string").json(out).groupBy("task").agg(F.count("*").alias("n"))
