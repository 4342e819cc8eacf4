"""Queries: every scan and sink, by writing tables in its format and reading them back."""

from pyspark.sql import functions as F

from kalangu import schema as S
from kalangu.functions import text as X
from kalangu.functions.timing import epoch_seconds
from kalangu.operators import compare as K
from kalangu.operators import filters as P
from kalangu.operators import metrics as R
from kalangu.operators import splits as J
from kalangu.plans import views as V
from kalangu.plans.catalog import query
from kalangu.plans.comparison_queries import LEADERBOARD, reports
from kalangu.plans.curation_queries import after_pass1, passed
from kalangu.plans.split_queries import speaker_map
from kalangu.plans.views import with_views
from kalangu.session import fresh_path
from kalangu.sources import events as EV
from kalangu.sources import manifests as MF
from kalangu.sources import records, sinks

_MANIFEST_SQL = r"""SELECT audio_path, duration, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text, language, dialect, speaker_id, '' AS domain,
    FALSE AS is_code_switched, 16000 AS sample_rate, 'afrispeech-200' AS corpus FROM clips"""


def manifest(spark, sf):
    return P.to_manifest(V.clips(spark, sf).withColumnRenamed("audio_path", "raw_audio_path"))


@query("strict_manifest_scan", with_views("clips", body=_MANIFEST_SQL))
def _(spark, sf):
    path = fresh_path(spark, "manifest")
    MF.write_manifest(manifest(spark, sf), path)
    return MF.read_manifest(spark, path).drop("cs_spans")


@query("lenient_manifest_scan", with_views("clips", body=_MANIFEST_SQL))
def _(spark, sf):
    path = fresh_path(spark, "manifest")
    MF.write_manifest(manifest(spark, sf), path)
    out = MF.iter_manifest(spark, path)
    return out.select(*[f for f in S.MANIFEST.names if f != "cs_spans"])


@query("manifest_append_then_overwrite", with_views("clips", body="""SELECT 'appended' AS mode, language, 2 * count(*) AS n FROM clips GROUP BY ALL
    UNION ALL SELECT 'overwritten', language, count(*) FROM clips GROUP BY ALL"""))
def _(spark, sf):
    rows, parts = manifest(spark, sf), []
    for mode, label in (("append", "appended"), ("overwrite", "overwritten")):
        path = fresh_path(spark, "manifest")
        for _ in range(2):
            MF.write_manifest(rows, path, mode, "parquet")
        parts.append(spark.read.parquet(path).groupBy(F.lit(label).alias("mode"), "language").agg(F.count("*").alias("n")))
    return J.union_all(*parts)


@query("split_by_language", with_views("clips", body="SELECT language, count(*) AS n, round(sum(duration), 4) AS secs FROM clips GROUP BY ALL"))
def _(spark, sf):
    path = fresh_path(spark, "by_language")
    MF.write_by_language(manifest(spark, sf), path)
    out = spark.read.parquet(path)
    return out.groupBy("language").agg(F.count("*").alias("n"), F.round(F.sum("duration"), 4).alias("secs"))


@query("corpus_metadata_scan", """SELECT '/data/' || file AS raw_audio_path, CASE WHEN doc_id % 2 = 0 THEN 'spk' || (doc_id % 9) ELSE doc_id::VARCHAR END AS speaker_id,
    CASE WHEN doc_id % 6 = 0 THEN 'clinical' ELSE 'general' END AS domain, 'en' AS language, lower(source) AS accent,
    CASE WHEN doc_id % 5 = 0 THEN 0.0 ELSE n_chars::DOUBLE / 14.0::DOUBLE END AS duration FROM (SELECT *, source || '/' || doc_id ||
    CASE WHEN doc_id % 2 = 0 THEN '_spk' || (doc_id % 9) ELSE '' END || '.wav' AS file FROM documents)""")
def _(spark, sf):
    k = F.col("doc_id")
    path = fresh_path(spark, "metadata")
    V.table(spark, sf, "documents").select(
        F.concat("source", F.lit("/"), k.cast("string"), F.when(k % 2 == 0, F.concat(F.lit("_spk"), (k % 9).cast("string"))).otherwise(F.lit("")), F.lit(".wav")).alias("file"),
        F.concat("text", F.when(k % 6 == 0, F.lit(" patient nurse")).otherwise(F.lit(""))).alias("transcript"),
        F.concat(F.lit(" "), F.upper("source")).alias("accent"), F.lit("NG").alias("country"), F.lit("train").alias("split"),
        F.when(k % 5 != 0, F.col("n_chars") / 14.0).alias("duration")).write.json(path)
    return MF.read_corpus_metadata(spark, path, "/data").select(
        "raw_audio_path", "speaker_id", "domain", "language", "accent", "duration")


def _event_lines(spark, sf):
    k = F.col("event_id")
    e = V.table(spark, sf, "events")
    body = F.to_json(F.struct(epoch_seconds(F.col("ts")).alias("ts"), F.when(k % 4 != 0, F.concat(F.lit("run_"), F.col("user_id").cast("string"))).alias("run_id"),
                              F.col("event_type").alias("type"), F.get_json_object("props", "$.k").cast("long").alias("step"), F.col("value").alias("loss")))
    line = F.when(k % 10 == 3, F.expr("substring(body, 1, length(body) - 3)")).when(k % 10 == 7, "  ").otherwise(F.col("body"))
    return e.select("event_id", "user_id", body.alias("body")).withColumn("value", line)


@query("lenient_event_scan", """SELECT event_type AS type, count(*) AS n, sum((props::JSON ->> '$.k')::BIGINT)::BIGINT AS steps, round(sum(value), 4) AS loss
    FROM events WHERE event_id % 10 NOT IN (3, 7) GROUP BY ALL""")
def _(spark, sf):
    path = fresh_path(spark, "events")
    _event_lines(spark, sf).select("value").write.text(path)
    return EV.read_events(spark, path).groupBy("type").agg(
        F.count("*").alias("n"), F.sum("step").alias("steps"), F.round(F.sum("loss"), 4).alias("loss"))


@query("multi_file_event_scan", """SELECT 'stage' || (user_id % 3) AS stage_name, CASE WHEN event_id % 4 <> 0 THEN 'run_' || user_id ELSE 'stage' || (user_id % 3) || '_events' END AS run_id,
    count(*) AS n FROM events WHERE event_id % 10 NOT IN (3, 7) GROUP BY ALL""")
def _(spark, sf):
    folder = fresh_path(spark, "logs")
    lines = _event_lines(spark, sf)
    for stage in range(3):
        lines.filter(F.col("user_id") % 3 == stage).select("value").write.text(f"{folder}/stage{stage}_events.jsonl")
    return EV.read_all_events(spark, folder).groupBy("stage_name", "run_id").agg(F.count("*").alias("n"))


@query("event_append_sink", with_views("ev", body="""SELECT type, count(*) AS n, sum(step)::BIGINT AS steps, sum(total_steps)::BIGINT AS totals, round(sum(loss), 4) AS loss,
    round(sum(eval_loss), 4) AS eval_loss, round(sum(wer_en), 6) AS wer_en, count(*) FILTER (WHERE type = 'error') AS messages, 0 AS null_fields FROM ev GROUP BY type"""))
def _(spark, sf):
    path = fresh_path(spark, "events")
    e = V.run_events(spark, sf)
    fields = {"train_start": {"total_steps": F.col("total_steps"), "stage": F.lit(1)},
              "step": {"step": F.col("step"), "loss": F.col("loss"), "lr": F.col("lr")},
              "eval": {"step": F.col("step"), "wer": F.col("wer"), "eval_loss": F.col("eval_loss")},
              "error": {"step": F.col("step"), "message": F.lit("stopped")}, "train_end": {"total_steps": F.col("total_steps")}}
    for kind, given in fields.items():
        EV.emit(EV.event(e.filter(F.col("type") == kind), kind, F.col("ts"), F.col("run_id"), **given), path)
    nulls = spark.read.text(path).select(F.count_if(F.col("value").contains("null")).cast("int").alias("n"))
    return EV.read_events(spark, path).groupBy("type").agg(
        F.count("*").alias("n"), F.sum("step").alias("steps"), F.sum("total_steps").alias("totals"), F.round(F.sum("loss"), 4).alias("loss"),
        F.round(F.sum("eval_loss"), 4).alias("eval_loss"), F.round(F.sum(F.col("wer")["en"]), 6).alias("wer_en"),
        F.count("message").alias("messages")).withColumn("null_fields", nulls.scalar())


@query("report_scan_leaderboard", LEADERBOARD)
def _(spark, sf):
    folder = fresh_path(spark, "evals")
    # one JSON object per file, as evaluation reports are
    reports(spark, sf).write.option("maxRecordsPerFile", 1).json(folder)
    return K.leaderboard(records.read_reports(spark, folder), ("en", "fr", "de")).withColumn("overall", F.round("overall", 6))


@query("filter_cache_scan", """SELECT source || '/' || doc_id || '.flac' AS audio_path, toxic * 0.5::DOUBLE + CASE WHEN quality = 1 THEN 1 ELSE 0 END AS cer,
    'l' || quality AS detected_language FROM labels JOIN documents USING (doc_id)""")
def _(spark, sf):
    root = fresh_path(spark, "filter_cache")
    lab = V.clips(spark, sf).join(V.table(spark, sf, "labels"), "doc_id")
    cer, lang = F.col("toxic") * 0.5, F.concat(F.lit("l"), F.col("quality").cast("string"))
    # top level in one split, under details in the other; good ones are in both and the second counts
    lab.select("audio_path", cer.alias("cer"), lang.alias("detected_language")).write.json(f"{root}/dev/transcript_results.jsonl")
    lab.filter("quality = 1").select(F.lit(True).alias("keep"), F.struct("audio_path", (cer + 1).alias("cer"), lang.alias("detected_language")).alias(
        "details")).write.json(f"{root}/test/transcript_results.jsonl")
    return records.read_filter_cache(spark, f"{root}/*/transcript_results.jsonl").select("audio_path", "cer", "detected_language")


@query("speaker_map_scan", with_views("clips", body="""SELECT doc_id::VARCHAR AS stem, CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'spk' || (doc_id % 40) END AS speaker_id,
    CASE WHEN doc_id % 2 = 0 THEN '19-25' ELSE '26-40' END AS age_group, split AS split_origin FROM clips WHERE doc_id IN (SELECT doc_id FROM labels)"""))
def _(spark, sf):
    path = fresh_path(spark, "speaker_map")
    m = speaker_map(spark, sf)
    entry = F.to_json(F.struct("speaker_id", "age_group", "gender", "split_origin"))
    m.select(F.concat(F.lit('{"'), F.col("stem"), F.lit('.wav": '), entry, F.lit("}"))).write.text(path)
    return records.read_speaker_map(spark, path).select("stem", "speaker_id", "age_group", "split_origin")


@query("speaker_map_build", """SELECT name, arg_max(speaker_id, doc_id) AS speaker_id, arg_max(split, doc_id) AS split_origin FROM (SELECT doc_id,
    (doc_id // 2) || '.flac' AS name, source AS speaker_id, CASE WHEN doc_id % 10 < 8 THEN 'train' ELSE 'dev' END AS split FROM documents WHERE doc_id % 3 <> 0) GROUP BY name""")
def _(spark, sf):
    k = F.col("doc_id")
    rows = V.table(spark, sf, "documents").select(
        k.alias("order"), F.concat(F.lit("a/b/"), F.floor(k / 2).cast("string"), F.lit(".flac")).alias("path"),
        F.when(k % 3 == 0, "GH").otherwise(" ng").alias("country"), F.when(k % 10 < 8, "train").otherwise("dev").alias("split"),
        F.col("source").alias("speaker_id"), F.lit(None).cast("string").alias("age_group"), F.lit("f").alias("gender"))
    return records.build_speaker_map(rows, "order").select("name", "speaker_id", "split_origin")


@query("lab_label_scan", """SELECT '/s' || (doc_id % 3) || '/sentences/wav/utt_' || doc_id || '.wav' AS audio_path, CASE doc_id % 8 WHEN 0 THEN 'happy' WHEN 1 THEN 'happy' WHEN 2 THEN 'angry'
    WHEN 3 THEN 'sad' WHEN 4 THEN 'neutral' ELSE 'neutral' END AS label, 'iemocap' AS source FROM documents WHERE doc_id % 8 < 6 AND doc_id % 7 <> 0 AND doc_id IN (SELECT doc_id FROM labels)""")
def _(spark, sf):
    """Written as label files of three sessions, in folders with a blank and a diacritic, and read back."""
    k = F.col("doc_id")
    code = F.element_at(F.array(*map(F.lit, ("hap", "exc", "ang", "sad", "neu", "fru", "oth", "xxx"))), (k % 8 + 1).cast("int"))
    d, root = V.table(spark, sf, "documents"), f"{fresh_path(spark, 'labels')}/my corpus ẹ"
    lines = d.select((k % 3).alias("session"), F.when(k % 7 == 0, "short line").otherwise(
        F.concat(F.lit(" utt_"), k.cast("string"), F.lit("\t12.5 "), code, F.lit(" extra"))).alias("value"))
    for n in range(3):
        lines.filter(F.col("session") == n).select("value").write.text(f"{root}/s{n}/x.lab")
    folder = X.plain_path(F.lit(root))
    audio = V.table(spark, sf, "labels").select(F.concat(folder, F.lit("/s"), (k % 3).cast("string"), F.lit("/sentences/wav/utt_"), k.cast("string"), F.lit(".wav")).alias("audio_path"))
    found = records.read_lab_labels(spark, root, audio, pattern="*.txt")
    return found.withColumn("audio_path", F.replace("audio_path", folder, F.lit("")))


@query("stem_label_scan", """SELECT '03-01-0' || (doc_id % 10) || '-01-' || doc_id || '.wav' AS file, CASE doc_id % 10 WHEN 1 THEN 'neutral' WHEN 2 THEN 'neutral' WHEN 3 THEN 'happy' WHEN 4 THEN 'sad' WHEN 5 THEN 'angry' ELSE 'neutral' END AS label,
    'ravdess' AS source FROM documents WHERE doc_id % 10 BETWEEN 1 AND 8""")
def _(spark, sf):
    k = F.col("doc_id")
    files = V.table(spark, sf, "documents").select(F.concat(
        F.lit("Actor 1/03-01-0"), (k % 10).cast("string"), F.lit("-01-"), k.cast("string"), F.lit(".wav")).alias("audio_path"))
    return records.stem_labels(files).select(X.basename(F.col("audio_path")).alias("file"), "label", "source")


@query("sample_catalog_scan", "SELECT source AS id, min(lang) AS language, count(*)::DOUBLE AS duration FROM documents GROUP BY source")
def _(spark, sf):
    path = fresh_path(spark, "catalog")
    d = V.table(spark, sf, "documents").groupBy("source").agg(F.min("lang").alias("language"), F.count("*").alias("n"))
    entry = F.struct(F.col("source").alias("id"), F.col("source").alias("title"), "language", F.concat("source", F.lit(".flac")).alias("file"),
                     F.col("n").cast("double").alias("duration"))
    # a catalog has one entry per source: one array per language
    d.groupBy("language").agg(F.to_json(F.collect_list(entry)).alias("value")).select("value").write.option("maxRecordsPerFile", 1).text(path)
    return records.read_catalog(spark, path).select("id", "language", "duration")


@query("catalog_entry", "SELECT source AS id, count(*)::DOUBLE AS duration FROM documents WHERE source = 'src3' GROUP BY source")
def _(spark, sf):
    d = V.table(spark, sf, "documents").groupBy(F.col("source").alias("id")).agg(F.count("*").cast("double").alias("duration"))
    return records.catalog_entry(d, "src3")


def checkpoints(spark, sf):
    """A folder per source of the documents, in as many files as its size asks for."""
    path = fresh_path(spark, "checkpoints")
    V.table(spark, sf, "documents").select("doc_id", "source").hint("rebalance", "source").write.partitionBy("source").parquet(path)
    return path


@query("file_inventory", "SELECT DISTINCT 'source=' || source AS stage, TRUE AS filled FROM documents")
def _(spark, sf):
    return records.read_files(spark, checkpoints(spark, sf), "*.parquet").select("stage", (F.col("size_bytes") > 0).alias("filled")).distinct()


@query("newest_files")
def _(spark, sf):
    """File times are not known in SQL."""
    return records.newest_files(records.read_files(spark, checkpoints(spark, sf), "*.parquet"), 3)


@query("feedback_sink", """SELECT CASE WHEN event_type IN ('view', 'click') THEN 'transcribe' WHEN event_type = 'error' THEN 'analyze' ELSE 'other' END AS task,
    count(*) AS n, sum((props::JSON ->> '$.k')::BIGINT % 5 + 1)::BIGINT AS ratings FROM events GROUP BY 1""")
def _(spark, sf):
    path = fresh_path(spark, "feedback")
    e = V.table(spark, sf, "events")
    task = F.when(F.col("event_type").isin("view", "click"), "transcribe").when(F.col("event_type") == "error", "analyze").otherwise(F.col("event_type"))
    rows = e.select(epoch_seconds(F.col("ts")).alias("ts"), task.alias("task"), (F.get_json_object("props", "$.k").cast("int") % 5 + 1).alias("rating"),
                    F.lit("ok").alias("comment"), F.lit("v1").alias("model_version"))
    sinks.append_feedback(rows, path)
    return spark.read.json(path).groupBy("task").agg(F.count("*").alias("n"), F.sum("rating").alias("ratings"))


@query("reject_log_sink", after_pass1("SELECT 'pass1' AS pass, reason, count(*) AS n FROM capped WHERE reason <> 'pass' GROUP BY ALL"))
def _(spark, sf):
    path = fresh_path(spark, "rejects")
    sinks.write_rejects(passed(spark, sf), "audio_path", ["pass1"], path)
    return spark.read.schema("pass string, audio_path string, reason string, details string").json(path).groupBy("pass", "reason").agg(F.count("*").alias("n"))


@query("filter_report_sink", after_pass1("""SELECT 'metadata' AS filter_level, 'pass1' AS pass, count(*) AS total, count(*) FILTER (WHERE reason = 'pass') AS kept FROM capped"""))
def _(spark, sf):
    path = fresh_path(spark, "report")
    sinks.write_filter_report(P.pass_totals(passed(spark, sf), ["pass1"]), "metadata", path)
    rep = spark.read.schema("filter_level string, passes map<string,struct<total:bigint,kept:bigint>>").json(path)
    return rep.select("filter_level", F.explode("passes").alias("pass", "v")).select("filter_level", "pass", "v.total", "v.kept")


@query("analysis_result_sink", with_views("clips", body="""SELECT split, count(*) AS n, round(avg(duration), 1) AS mean_duration, count(*) FILTER (WHERE duration < 3) AS short,
    round(count(*) FILTER (WHERE duration < 3) * 100.0::DOUBLE / count(*), 1) AS short_pct FROM clips GROUP BY split"""))
def _(spark, sf):
    path = fresh_path(spark, "result")
    table = R.split_mismatch(V.clips(spark, sf))
    sinks.write_results(table, path)
    return spark.read.schema(table.schema).json(path)


@query("stored_stage", after_pass1("SELECT reason, count(*) AS n, 1 AS runs FROM p1 GROUP BY reason"))
def _(spark, sf):
    path, runs = fresh_path(spark, "stages"), []

    def compute(df):
        runs.append(1)
        return P.metadata_pass(df).select("audio_path", "pass1")

    rows = V.clips(spark, sf)
    for _ in range(2):  # the second time the stored result is read
        out = sinks.stage(rows, path, compute)
    return out.groupBy(F.col("pass1.reason").alias("reason")).agg(F.count("*").alias("n")).withColumn("runs", F.lit(len(runs)))
