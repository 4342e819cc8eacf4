"""Queries: training events folded into runs, series, checkpoints."""

from pyspark.sql import functions as F

from kalangu.functions import nested as N
from kalangu.functions import timing as D
from kalangu.operators import runs as E
from kalangu.plans import views as V
from kalangu.plans.catalog import query
from kalangu.plans.views import with_views

SUMMARY = ("stage_name", "run_id", "status", "step", "total_steps", "train_loss", "val_loss", "wer", "created_at", "updated_at")
SUMMARY_SQL = "stage_name, run_id, status, step, total_steps, train_loss, val_loss, round(wer, 9) AS wer, created_at, updated_at"


def summaries(spark, sf):
    return E.run_summaries(V.run_events(spark, sf))


@query("run_summaries", with_views("runs", body=f"SELECT {SUMMARY_SQL} FROM runs"))
def _(spark, sf):
    return summaries(spark, sf).withColumn("wer", F.round("wer", 9)).select(*SUMMARY)


@query("newest_runs", with_views("runs", body="SELECT run_id, status, updated_at FROM runs ORDER BY updated_at DESC, run_id LIMIT 8"))
def _(spark, sf):
    return E.newest_runs(summaries(spark, sf), 8).select("run_id", "status", "updated_at")


@query("dashboard", with_views("runs", body="SELECT count(*) FILTER (WHERE status = 'running') AS active, count(*) AS runs, round(min(wer), 9) AS best_wer FROM runs"))
def _(spark, sf):
    return E.dashboard(summaries(spark, sf)).withColumn("best_wer", F.round("best_wer", 9))


@query("runs_with_wer", with_views("runs", body="SELECT run_id, round(wer, 9) AS wer FROM runs WHERE wer IS NOT NULL"))
def _(spark, sf):
    return E.runs_with_wer(summaries(spark, sf)).select("run_id", F.round("wer", 9).alias("wer"))


@query("run_tail", with_views("ev", body="SELECT ts, type, pos FROM ev WHERE run_id = 'run_7' AND ts > 1704800000"))
def _(spark, sf):
    return E.run_events(V.run_events(spark, sf), "run_7", 1704800000.0).select("ts", "type", "pos")


@query("loss_series", with_views("ev", body="""SELECT stage_name, run_id, step, arg_max(loss, row(ts, pos)) FILTER (WHERE type = 'step') AS train_loss,
    arg_max(eval_loss, row(ts, pos)) FILTER (WHERE type = 'eval') AS val_loss FROM ev WHERE type IN ('step', 'eval') GROUP BY ALL"""))
def _(spark, sf):
    return E.loss_series(V.run_events(spark, sf))


@query("run_comparison", with_views("runs", body="""SELECT a.stage_name AS stage_a, a.run_id AS run_a, b.stage_name AS stage_b, b.run_id AS run_b, a.step AS step_a, b.step AS step_b,
    a.val_loss AS val_loss_a, b.val_loss AS val_loss_b, a.status AS status_a, b.status AS status_b FROM runs a JOIN runs b
    ON substr(b.run_id, 5)::INT = substr(a.run_id, 5)::INT + 1"""))
def _(spark, sf):
    s = summaries(spark, sf)
    n = F.substring("run_id", 5, 12).cast("int")
    pairs = s.select(
        F.col("stage_name").alias("stage_a"), F.col("run_id").alias("run_a"),
        F.concat(F.lit("stage"), ((n + 1) % 4).cast("string")).alias("stage_b"), F.concat(F.lit("run_"), (n + 1).cast("string")).alias("run_b"))
    return E.compare_runs(s, pairs).select("stage_a", "run_a", "stage_b", "run_b", *[f"{c}_{x}" for c in ("step", "val_loss", "status") for x in "ab"])


@query("best_checkpoints", with_views("evals", body="""SELECT run_id, checkpoint, coalesce(metric < prev OR (metric IS NOT NULL AND prev IS NULL), FALSE) AS is_best FROM
    (SELECT *, min(metric) OVER (PARTITION BY run_id ORDER BY ts, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM evals)"""))
def _(spark, sf):
    return E.best_so_far(V.evals(spark, sf), "metric", ["run_id"], ["ts", "pos"], bucket=F.floor(F.col("ts") / 86400)).select(
        "run_id", "checkpoint", "is_best")


@query("best_checkpoints_max", with_views("evals", body="""SELECT run_id, checkpoint, coalesce(metric > prev OR (metric IS NOT NULL AND prev IS NULL), FALSE) AS is_best FROM
    (SELECT *, max(metric) OVER (PARTITION BY run_id ORDER BY ts, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM evals)"""))
def _(spark, sf):
    return E.best_so_far(V.evals(spark, sf), "metric", ["run_id"], ["ts", "pos"], mode="max").select("run_id", "checkpoint", "is_best")


@query("retained_after_each_eval", with_views("evals", body="""SELECT run_id, checkpoint, array_to_string(list_sort(list_distinct(list_append(newest, best))), ',') AS kept FROM
    (SELECT *, list(checkpoint) OVER (PARTITION BY run_id ORDER BY ts, pos ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS newest,
      (max(CASE WHEN metric IS NOT NULL THEN row(-metric, -ts, -pos, checkpoint) END) OVER (PARTITION BY run_id ORDER BY ts, pos ROWS UNBOUNDED PRECEDING))[4] AS best FROM evals)"""))
def _(spark, sf):
    out = E.retained_after(V.evals(spark, sf), "checkpoint", "metric", ["run_id"], ["ts", "pos"], 2, bucket=F.floor(F.col("ts") / 86400))
    return out.select("run_id", "checkpoint", F.array_join(F.array_sort("kept"), ",").alias("kept"))


@query("retained_now", with_views("evals", body="""SELECT run_id, checkpoint, rb = 1 AND metric IS NOT NULL AS is_best FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ts DESC, pos DESC) AS rn,
    row_number() OVER (PARTITION BY run_id ORDER BY metric NULLS LAST, ts, pos) AS rb FROM evals) WHERE rn <= 4 OR (rb = 1 AND metric IS NOT NULL)"""))
def _(spark, sf):
    return E.retained_now(V.evals(spark, sf), "checkpoint", "metric", ["run_id"], ["ts", "pos"], 4)


_LAST = "t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY stage_name ORDER BY ts DESC, pos DESC) AS rn FROM ev) WHERE rn <= 500)"


@query("last_events", f"{with_views('ev', body='').rstrip()}, {_LAST} SELECT stage_name, run_id, type, pos FROM t")
def _(spark, sf):
    return E.last_events(V.run_events(spark, sf), ["stage_name"]).select("stage_name", "run_id", "type", "pos")


_LATEST = f"""{with_views('ev', body='').rstrip()}, {_LAST}, l AS (SELECT stage_name, arg_max(step, row(ts, pos)) FILTER (WHERE type = 'step') AS step,
    arg_max(loss, row(ts, pos)) FILTER (WHERE type = 'step') AS train_loss, arg_max(lr, row(ts, pos)) FILTER (WHERE type = 'step') AS lr,
    arg_max(grad_norm, row(ts, pos)) FILTER (WHERE type = 'step') AS grad_norm, arg_max(eval_loss, row(ts, pos)) FILTER (WHERE type = 'eval') AS val_loss,
    coalesce(arg_max(run_id, row(ts, pos)) FILTER (WHERE type = 'train_start'), arg_min(run_id, row(ts, pos)) FILTER (WHERE type = 'step')) AS current_run
    FROM t GROUP BY stage_name)"""


@query("latest_metrics", f"{_LATEST} SELECT * FROM l")
def _(spark, sf):
    return E.latest_metrics(V.run_events(spark, sf), ["stage_name"]).drop("wer")


@query("progress_eta", f"""{_LATEST} SELECT stage_name, step, CASE WHEN step >= 10 THEN round(step / 7200.0::DOUBLE, 9) END AS rate,
    CASE WHEN step >= 10 THEN round((10000 - step) / (step / 7200.0::DOUBLE) / 3600, 6) END AS remaining_hours FROM l""")
def _(spark, sf):
    out = E.eta(E.latest_metrics(V.run_events(spark, sf), ["stage_name"]), F.lit(1704807200.0), F.lit(1704800000.0), 10000)
    return out.select("stage_name", "step", F.round("rate", 9).alias("rate"), F.round("remaining_hours", 6).alias("remaining_hours"))


@query("workspace_stats", with_views("runs", body="""SELECT round((SELECT count(*) FROM documents) * 5.0::DOUBLE / 3600, 1) AS total_hours,
    (SELECT count(*) FROM runs) AS runs_count, (SELECT count(*) FROM pages) AS checkpoints_count"""))
def _(spark, sf):
    return E.workspace_stats(V.table(spark, sf, "documents"), summaries(spark, sf), V.table(spark, sf, "pages"))


# --- functions over events -----------------------------------------------------------

@query("wer_display", with_views("ev", body="""SELECT pos, CASE WHEN wer_en IS NOT NULL THEN printf('EN: %.2f | HA: %.2f', wer_en, wer_ha)
    WHEN pos % 2 = 0 THEN printf('%.3f', eval_loss) ELSE '—' END AS wer_display FROM ev WHERE type = 'eval'"""))
def _(spark, sf):
    e = V.run_events(spark, sf).filter("type = 'eval'").withColumn("run_wer", F.when(F.col("pos") % 2 == 0, F.col("eval_loss")))
    return E.wer_display(e).select("pos", "wer_display")


@query("map_mean", with_views("ev", body="SELECT pos, round((wer_en + wer_ha) / 2, 9) AS wer FROM ev WHERE type = 'eval'"))
def _(spark, sf):
    e = V.run_events(spark, sf).filter("type = 'eval'")
    return e.select("pos", F.round(N.map_mean(F.col("wer")), 9).alias("wer"))


@query("wer_field", """SELECT event_id, CASE event_id % 3 WHEN 0 THEN value WHEN 1 THEN value / 2 END AS wer FROM events""")
def _(spark, sf):
    k, v = F.col("event_id") % 3, F.col("value").cast("string")
    j = (F.when(k == 0, F.concat(F.lit('{"wer": {"overall": '), v, F.lit(', "en": 1}}')))
         .when(k == 1, F.concat(F.lit('{"wer": '), (F.col("value") / 2).cast("string"), F.lit("}"))).otherwise('{"wer": {}}'))
    return V.table(spark, sf, "events").select("event_id", N.wer_value(j).alias("wer"))


@query("event_envelope", """SELECT event_id, 'run_' || user_id AS run_id, event_type AS type, (props::JSON ->> '$.k') AS k, 2::INT AS n_data FROM events""")
def _(spark, sf):
    e = V.table(spark, sf, "events")
    j = F.to_json(F.struct(D.epoch_seconds(F.col("ts")).alias("ts"), F.concat(F.lit("run_"), F.col("user_id").cast("string")).alias("run_id"),
                           F.col("event_type").alias("type"), F.get_json_object("props", "$.k").alias("k"), "value"))
    x = e.select("event_id", N.envelope(j).alias("e"))
    return x.select("event_id", "e.run_id", "e.type", F.col("e.data")["k"].alias("k"), F.size("e.data").alias("n_data"))


@query("clock_times", "SELECT event_id, strftime(ts, '%H:%M:%S') AS clock, strftime(ts, '%Y-%m-%d %H:%M:%S') AS stamp FROM events")
def _(spark, sf):
    e = V.table(spark, sf, "events").select("event_id", "ts", D.epoch_seconds(F.col("ts")).alias("s"))
    return e.select("event_id", D.clock_time(F.col("s")).alias("clock"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("stamp"))


@query("minutes_since", "SELECT event_id, floor((1706745600 - epoch_us(date_trunc('second', ts)) / 1e6::DOUBLE) / 60)::BIGINT AS minutes FROM events")
def _(spark, sf):
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    return V.table(spark, sf, "events").select("event_id", D.minutes_since(iso, F.lit(1706745600.0)).alias("minutes"))


@query("run_ids", """SELECT event_id, 'stage1_' || event_type || '_' || strftime(ts, '%Y%m%d_%H%M%S') || '_' || printf('%04x', (event_id % 65536)::INT) AS run_id,
    'stage1_' || event_type AS base, strftime(ts, '%Y%m%d_%H%M%S') AS stamp, printf('%04x', (event_id % 65536)::INT) AS suffix FROM events""")
def _(spark, sf):
    e = V.table(spark, sf, "events")
    rid = D.make_run_id(F.concat(F.lit("stage1_"), F.col("event_type")), F.col("ts"), F.lower(F.lpad(F.hex(F.col("event_id") % 65536), 4, "0")))
    return e.select("event_id", rid.alias("run_id")).select("event_id", "run_id", D.parse_run_id(F.col("run_id")).alias("p")).select("event_id", "run_id", "p.*")


@query("percent_done", with_views("runs", body="SELECT run_id, CASE WHEN total_steps = 0 THEN 0 ELSE round(100 * step / total_steps)::INT END AS pct FROM runs"))
def _(spark, sf):
    return summaries(spark, sf).select("run_id", D.percent_done(F.col("step"), F.col("total_steps")).alias("pct"))
