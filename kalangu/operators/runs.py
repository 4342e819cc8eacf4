"""Training-event analytics: run summaries, loss series, checkpoints."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from kalangu.functions.nested import format_wer, map_mean, nan_to_null
from kalangu.operators.scale import equi_join, running_min, top_per_key

RUN_KEYS = ["stage_name", "run_id"]


def event_order(ts: Column, pos: Column) -> Column:
    """One number that orders events by time (to the microsecond), then position.

    A number, unlike a struct, keeps the folds below in hash aggregation: no
    task has to sort its events by run.
    """
    micros = F.round(ts * 1e6).cast("decimal(18,0)")
    return micros * F.lit(Decimal(10) ** 19) + pos.cast("decimal(19,0)")


_STATUS = {1: "completed", 2: "error"}


def fold_events(events: DataFrame, keys: list[str], order: list[str] = ("ts", "pos")) -> DataFrame:
    """Summaries of runs; the same fold for a table and for a stream.

    Every partial result is a few numbers, so a run of any length is folded
    where its events are read.
    """
    kind = F.col("type")
    df = events.withColumn("_at", event_order(F.col(order[0]), F.col(order[1])))
    df = df.withColumn("_wer", map_mean(F.col("wer")))
    at = F.col("_at")

    def last(column: str, *types: str) -> Column:
        return F.max_by(column, F.when(kind.isin(*types), at))

    code = F.when(kind == "train_end", 1).when(kind == "error", 2)
    folded = df.withColumn("_code", code).groupBy(*keys).agg(
        last("_code", "train_end", "error").alias("_code"),
        F.max(F.when(kind == "step", F.coalesce("step", F.lit(0)))).alias("step"),
        last("total_steps", "train_start").alias("total_steps"),
        last("loss", "step").alias("train_loss"), last("eval_loss", "eval").alias("val_loss"),
        F.max_by("_wer", F.when((kind == "eval") & F.col("_wer").isNotNull(), at)).alias("wer"),
        F.min_by("ts", at).alias("created_at"), F.max_by("ts", at).alias("updated_at"))
    status = F.create_map(*[F.lit(x) for kv in _STATUS.items() for x in kv])[F.col("_code")]
    return folded.select(
        *keys, F.coalesce(status, F.lit("running")).alias("status"),
        F.coalesce("step", F.lit(0)).cast("long").alias("step"),
        F.coalesce("total_steps", F.lit(0)).cast("long").alias("total_steps"),
        *[nan_to_null(F.col(c)).alias(c) for c in ("train_loss", "val_loss", "wer")], "created_at", "updated_at")


def run_summaries(events: DataFrame, order: list[str] = ("ts", "pos"), keys: list[str] = RUN_KEYS) -> DataFrame:
    """One summary per run of an event table (stage_name, run_id)."""
    return fold_events(events, list(keys), order)


def newest_runs(summaries: DataFrame, k: int | None = None) -> DataFrame:
    out = summaries.orderBy(F.desc("updated_at"), "run_id")
    return out.limit(k) if k else out


def run_events(events: DataFrame, run_id: str, after_ts: float | None = None) -> DataFrame:
    """Events of a run, optionally only those newer than ``after_ts``."""
    out = events.filter(F.col("run_id") == run_id)
    return out if after_ts is None else out.filter(F.col("ts") > after_ts)


def dashboard(summaries: DataFrame) -> DataFrame:
    return summaries.agg(F.count_if(F.col("status") == "running").alias("active"),
                         F.count("*").alias("runs"), F.min("wer").alias("best_wer"))


def runs_with_wer(summaries: DataFrame) -> DataFrame:
    return summaries.filter(F.col("wer").isNotNull())


def loss_series(events: DataFrame, order: list[str] = ("ts", "pos"), keys: list[str] = RUN_KEYS) -> DataFrame:
    """Per run and step: the last train loss and the last eval loss."""
    is_train = (F.col("type") == "step") & F.col("loss").isNotNull()
    is_val = (F.col("type") == "eval") & F.col("eval_loss").isNotNull()
    wanted = events.filter(is_train | is_val).withColumn("_at", event_order(F.col(order[0]), F.col(order[1])))
    train, val = F.when(is_train, F.col("_at")), F.when(is_val, F.col("_at"))
    return (wanted.groupBy(*keys, F.coalesce("step", F.lit(0)).alias("step"))
            .agg(F.max_by("loss", train).alias("train_loss"), F.max_by("eval_loss", val).alias("val_loss")))


def compare_runs(summaries: DataFrame, pairs: DataFrame) -> DataFrame:
    """Two run summaries side by side for every (stage_a, run_a, stage_b, run_b) of ``pairs``.

    Summaries are per stage and run, so a run id alone does not name one.
    """
    cols = ["status", "step", "train_loss", "val_loss", "wer"]

    def side(x: str) -> DataFrame:
        return summaries.select(F.col("stage_name").alias(f"stage_{x}"), F.col("run_id").alias(f"run_{x}"),
                                *[F.col(c).alias(f"{c}_{x}") for c in cols])

    return pairs.join(side("a"), ["stage_a", "run_a"]).join(side("b"), ["stage_b", "run_b"])


def last_events(events: DataFrame, keys: list[str], n: int = 500, order: list[str] = ("ts", "pos")) -> DataFrame:
    return top_per_key(events, keys, [F.col(c).desc() for c in order], n, salt=F.struct(*order))


def latest_metrics(events: DataFrame, keys: list[str], n: int = 500, order: list[str] = ("ts", "pos")) -> DataFrame:
    """Latest step and eval figures among the last ``n`` events of each group."""
    at = F.struct(*order)
    step, ev = F.when(F.col("type") == "step", at), F.when(F.col("type") == "eval", at)
    start = F.when(F.col("type") == "train_start", at)
    first_step = F.min_by("run_id", step)
    tail = last_events(events, keys, n, order)
    return tail.groupBy(*keys).agg(
        F.max_by("step", step).alias("step"), F.max_by("loss", step).alias("train_loss"),
        F.max_by("lr", step).alias("lr"), F.max_by("grad_norm", step).alias("grad_norm"),
        F.max_by("eval_loss", ev).alias("val_loss"), F.max_by(F.col("wer")["overall"], ev).alias("wer"),
        F.coalesce(F.max_by("run_id", start), first_step).alias("current_run"))


def eta(latest: DataFrame, now: Column, started: Column, max_steps: int) -> DataFrame:
    """Adds steps per second and remaining hours; null while too early to say."""
    elapsed = now - started
    ready = (F.coalesce("step", F.lit(0)) >= 10) & (elapsed >= 120)
    rate = F.col("step") / elapsed
    return latest.withColumns({
        "rate": F.when(ready, rate), "remaining_hours": F.when(ready, (F.lit(max_steps) - F.col("step")) / rate / 3600),
        "eta": F.when(ready, F.format_string("%.1fh", (F.lit(max_steps) - F.col("step")) / rate / 3600))
        .otherwise("calculating...")})


def _signed(metric: Column, mode: str) -> Column:
    if mode not in ("min", "max"):
        raise ValueError(f"mode must be min or max, got {mode!r}")
    return nan_to_null(metric) if mode == "min" else -nan_to_null(metric)


def best_so_far(evals: DataFrame, metric: str, keys: list[str], order: list[str], mode: str = "min",
                bucket: Column | None = None, carry: list[str] = ()) -> DataFrame:
    """Adds is_best (strictly better than every earlier eval) and ``best``.

    ``best`` holds the order and ``carry`` columns of the best eval up to and
    including this one. ``bucket`` cuts a run into ranges along ``order``; see
    :func:`kalangu.operators.scale.running_min`.
    """
    m = _signed(F.col(metric), mode)
    fields = list(dict.fromkeys([*order, *carry]))
    mine = F.when(m.isNotNull(), F.struct(m.alias("m"), *fields))
    df = running_min(evals, keys, order, mine, _ten_minutes(order) if bucket is None else bucket, "_prev")
    is_best = m.isNotNull() & (F.col("_prev").isNull() | (m < F.col("_prev")["m"]))
    top = F.when(is_best, mine).otherwise(F.col("_prev"))
    return (df.withColumn("is_best", is_best)
            .withColumn("best", F.when(top.isNotNull(), F.struct(*[top[c].alias(c) for c in fields])))
            .drop("_prev"))


def _ten_minutes(order: list[str]) -> Column:
    return F.floor(F.col(order[0]) / 600)


def retained_after(evals: DataFrame, checkpoint: str, metric: str, keys: list[str], order: list[str],
                   keep: int = 2, mode: str = "min", bucket: Column | None = None) -> DataFrame:
    """After each eval: array of checkpoints kept, the newest ``keep`` and the best.

    Runs are scanned in buckets; each bucket receives the last ``keep``
    checkpoints before it from at most ``keep`` earlier buckets.
    """
    b = _ten_minutes(order) if bucket is None else bucket
    df = best_so_far(evals, metric, keys, order, mode, b, [checkpoint]).withColumn("_b", b)
    back = [F.col(c).desc() for c in order]
    tail = (df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys, "_b").orderBy(*back)))
            .filter(F.col("_rn") <= keep).groupBy(*keys, "_b")
            .agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(checkpoint).alias("c")))),
                             lambda s: s["c"]).alias("_t")))
    earlier = W.partitionBy(*keys).orderBy("_b").rowsBetween(-keep, -1)
    carried = tail.select(*keys, "_b", F.flatten(F.collect_list("_t").over(earlier)).alias("_carry"))
    near = W.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(-(keep - 1), W.currentRow)
    joined = equi_join(df.withColumn("_near", F.collect_list(checkpoint).over(near)), carried, [*keys, "_b"], "inner")
    both = F.concat("_carry", "_near")
    newest = F.slice(both, F.greatest(F.size(both) - keep + 1, F.lit(1)), keep)
    top = F.col("best")[checkpoint]
    kept = F.array_union("_newest", F.when(top.isNull(), F.slice(newest, 1, 0)).otherwise(F.array(top)))
    return (joined.withColumn("_newest", newest).withColumn("kept", kept)
            .drop("_b", "_near", "_carry", "_newest"))


def retained_now(evals: DataFrame, checkpoint: str, metric: str, keys: list[str], order: list[str],
                 keep: int = 4, mode: str = "min") -> DataFrame:
    """Checkpoints on disk after the last eval of each run, with is_best."""
    m = _signed(F.col(metric), mode)
    best = evals.filter(m.isNotNull()).groupBy(*keys).agg(
        F.min_by(checkpoint, F.struct(m, *order)).alias("_best"))
    newest = top_per_key(evals.select(*keys, *order, checkpoint), keys, [F.col(c).desc() for c in order], keep,
                         salt=F.struct(*order)).select(*keys, checkpoint)
    chosen = newest.unionByName(best.select(*keys, F.col("_best").alias(checkpoint))).distinct()
    return (equi_join(chosen, best, keys, "left")
            .withColumn("is_best", F.coalesce(F.col(checkpoint) == F.col("_best"), F.lit(False))).drop("_best"))


def workspace_stats(manifests: DataFrame, runs: DataFrame, files: DataFrame, secs_per_line: float = 5.0) -> DataFrame:
    """Estimated hours from manifest lines, number of runs and of files."""
    hours = manifests.agg(F.round(F.count("*") * secs_per_line / 3600, 1).alias("total_hours"))
    return hours.select("total_hours", runs.agg(F.count("*")).scalar().alias("runs_count"),
                        files.agg(F.count("*")).scalar().alias("checkpoints_count"))


def wer_display(events: DataFrame, fallback: str = "run_wer") -> DataFrame:
    return events.withColumn("wer_display", format_wer(F.col("wer"), F.col(fallback)))
