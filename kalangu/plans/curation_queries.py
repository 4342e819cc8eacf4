"""Queries: filter passes, speaker cap, reports, manifest rows."""

from pyspark.sql import functions as F

from kalangu.operators import filters as P
from kalangu.operators import metrics as R
from kalangu.plans import views as V
from kalangu.plans.catalog import query
from kalangu.plans.curate import curate
from kalangu.plans.views import with_views

LANGS = ("en", "fr", "de")
KEYWORDS = ("the", "and", "de", "la", "der")
ACCENTS = ("src1", "src2", "src11")

_TRIM = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"
_N = r"len(list_filter(regexp_split_to_array(t, '\s+'), lambda x: x <> ''))"

P1 = rf"""p1 AS (SELECT *, CASE WHEN duration < 1.0 THEN 'too_short' WHEN duration > 30.0 THEN 'too_long'
    WHEN length(t) < 3 THEN 'empty_transcript' WHEN n / greatest(duration, 1e-6) < 0.5
      OR n / greatest(duration, 1e-6) > 6.0 THEN 'impossible_speech_rate'
    WHEN length(t) / greatest(duration, 1e-6) > 30.0 THEN 'transcript_too_long' ELSE 'pass' END AS reason
    FROM (SELECT *, {_N} AS n FROM (SELECT *, {_TRIM} AS t FROM clips)))"""
CAPPED = f""", capped AS (SELECT * REPLACE (CASE WHEN reason = 'pass' AND rk > {V.SPEAKER_CAP} THEN 'speaker_cap'
    ELSE reason END AS reason) FROM (SELECT *, row_number() OVER (PARTITION BY speaker_id, reason = 'pass'
    ORDER BY md5('42:' || audio_path), audio_path) AS rk FROM p1))"""


def after_pass1(body: str, *extra: str) -> str:
    head = with_views("clips", *extra, body="")
    return f"{head.rstrip()}, {P1}{CAPPED}\n{body}"


def passed(spark, sf):
    return P.cap_per_speaker(P.metadata_pass(V.clips(spark, sf)), "audio_path", cap=V.SPEAKER_CAP)


@query("metadata_filter", after_pass1("""SELECT audio_path, reason = 'pass' AS keep, reason,
    CASE WHEN reason IN ('pass', 'too_short', 'too_long', 'impossible_speech_rate') THEN round(duration, 6) END AS duration,
    CASE WHEN reason = 'pass' THEN n END AS words,
    CASE WHEN reason IN ('pass', 'impossible_speech_rate') THEN round(n / greatest(duration, 1e-6), 3) END AS words_per_sec,
    CASE WHEN reason = 'empty_transcript' THEN length(t) END AS chars FROM p1"""))
def _(spark, sf):
    df = P.metadata_pass(V.clips(spark, sf))
    d = F.col("pass1.details")
    return df.select("audio_path", "pass1.keep", "pass1.reason", F.round(d["duration"], 6).alias("duration"),
                     d["words"].alias("words"), d["words_per_sec"].alias("words_per_sec"), d["chars"].alias("chars"))


@query("reject_reasons_by_language", after_pass1(
    "SELECT language, reason, count(*) AS n, round(sum(duration), 4) AS secs FROM capped GROUP BY ALL"))
def reject_reasons(spark, sf):
    return passed(spark, sf).groupBy("language", F.col("pass1.reason").alias("reason")).agg(
        F.count("*").alias("n"), F.round(F.sum("duration"), 4).alias("secs"))


@query("accent_flag", with_views("clips", body="""SELECT audio_path, label,
    label IN ('src1', 'src2', 'src11') OR len(list_intersect(string_split(replace(label, '/', ' '), ' '),
      ['src1', 'src2', 'src11'])) > 0 AS listed
    FROM (SELECT *, CASE doc_id % 3 WHEN 0 THEN accent WHEN 1 THEN accent || '/other' ELSE 'x ' || accent END AS label
          FROM clips)"""))
def _(spark, sf):
    from kalangu.functions import text as X

    k = F.col("doc_id") % 3
    label = (F.when(k == 0, F.upper("accent")).when(k == 1, F.concat("accent", F.lit("/other")))
             .otherwise(F.concat(F.lit(" x "), F.col("accent"))))
    return V.clips(spark, sf).select("audio_path", F.lower(F.trim(label)).alias("label"),
                                     X.accent_listed(label, ACCENTS).alias("listed"))


@query("domain_inference", with_views("doc_words", body="""SELECT doc_id, CASE WHEN len(list_filter(ws, lambda x:
    lower(x) IN ('the', 'and', 'de', 'la', 'der'))) >= 2 THEN 'clinical' ELSE 'general' END AS domain FROM doc_words"""))
def _(spark, sf):
    from kalangu.functions import text as X

    return V.clips(spark, sf).select("doc_id", X.infer_domain(F.col("text"), KEYWORDS).alias("domain"))


@query("speaker_cap", after_pass1("SELECT audio_path, speaker_id, reason FROM capped"))
def _(spark, sf):
    return passed(spark, sf).select("audio_path", "speaker_id", F.col("pass1.reason").alias("reason"))


@query("pass_totals", after_pass1("""SELECT 'pass1' AS pass, count(*) AS total, count(*) FILTER (WHERE reason = 'pass') AS kept,
    round((count(*) - count(*) FILTER (WHERE reason = 'pass'))::DOUBLE / greatest(count(*), 1) * 100, 6) AS reject_pct FROM capped"""))
def _(spark, sf):
    return P.pass_totals(passed(spark, sf), ["pass1"]).withColumn("reject_pct", F.round("reject_pct", 6))


@query("guardrails", after_pass1("""SELECT 'pass1' AS pass, total, kept, CASE WHEN pct > 30 THEN 'fail' WHEN pct < 2 THEN 'warn'
    ELSE 'ok' END AS status FROM (SELECT count(*) AS total, count(*) FILTER (WHERE reason = 'pass') AS kept,
    (count(*) - count(*) FILTER (WHERE reason = 'pass'))::DOUBLE / count(*) * 100 AS pct FROM capped)"""))
def _(spark, sf):
    return P.guardrail_status(P.pass_totals(passed(spark, sf), ["pass1"])).drop("reject_pct")


@query("reject_log", after_pass1("SELECT 'pass1' AS pass, audio_path, reason FROM capped WHERE reason <> 'pass'"))
def _(spark, sf):
    return P.rejects(passed(spark, sf), "audio_path", ["pass1"]).drop("details")


# --- the whole run: embeddings as audio, perturbed text as hypotheses -----------

AUDIO = P.AudioLimits(min_samples=32, min_rms_dbfs=-20.0, max_clip_frac=0.02, min_snr_db=2.0)


def curated(spark, sf, level="full"):
    """Clips with audio from the embedding of the same number and one more hypothesis."""
    rows = V.clips(spark, sf)
    waves = V.waveforms(spark, sf).select(F.col("vec_id").alias("doc_id"), "samples", "sample_rate")
    audio = rows.select("doc_id", "audio_path").join(waves, "doc_id").drop("doc_id")
    pre = rows.select("audio_path", (F.col("doc_id") % 97 != 0).alias("ok"))
    hyp = rows.select(
        "audio_path",
        F.when(F.col("doc_id") % 11 == 0, F.lit(None).cast("string"))
        .when(F.col("doc_id") % 5 == 0, F.translate("text", "aeiou", "")).otherwise(F.col("text")).alias("hypothesis"),
        F.when(F.col("doc_id") % 4 == 0, "fr").otherwise("en").alias("detected_language"))
    return curate(rows, "audio_path", level, audio, pre, hyp, audio_limits=AUDIO, cap=V.SPEAKER_CAP)


def _quality(samples: str) -> str:
    return f"""SELECT *, CASE WHEN len(samples) < 32 THEN 'too_few_samples' WHEN rms_db < -20.0 THEN 'silent'
    WHEN clip_frac > 0.02 THEN 'clipped' WHEN snr_db < 2.0 THEN 'low_snr' WHEN silence_frac > 0.7 THEN 'mostly_silence'
    ELSE 'pass' END AS reason FROM (SELECT *, 20 * log10(greatest(rms, 1e-9)) AS rms_db,
      20 * log10(greatest(list_max(frames), 1e-9) / (list_min(frames) + 1e-9)) AS snr_db,
      len(list_filter(frames, lambda x: x < 10 ** (-2.5)))::DOUBLE / len(frames) AS silence_frac
      FROM (SELECT *, sqrt(list_sum(list_transform(samples, lambda x: x::DOUBLE * x::DOUBLE)) / len(samples)) AS rms,
        list_max(list_transform(samples, lambda x: abs(x::DOUBLE))) AS peak,
        len(list_filter(samples, lambda x: abs(x::DOUBLE) >= 0.999))::DOUBLE / len(samples) AS clip_frac,
        list_transform(range(0, len(samples) // 16), lambda i: sqrt(list_sum(list_transform(
          samples[i*16+1:i*16+16], lambda x: x::DOUBLE * x::DOUBLE)) / 16)) AS frames FROM {samples}))"""


QUALITY_SQL = _quality("wave")

@query("audio_curation", f"""{with_views("clips", "wave", body="").rstrip()}, {P1}{CAPPED},
    q AS ({QUALITY_SQL}),
    j AS (SELECT c.audio_path, c.reason AS r1, CASE WHEN c.reason <> 'pass' THEN NULL WHEN c.doc_id % 97 = 0
      THEN 'preprocess_failed' ELSE 'pass' END AS r0, q.reason AS rq FROM capped c LEFT JOIN q ON q.vec_id = c.doc_id)
    SELECT audio_path, r1 AS pass1, r0 AS preprocess, CASE WHEN r0 = 'pass' THEN coalesce(rq, 'corrupt_audio') END AS pass2 FROM j""")
def _(spark, sf):
    return curated(spark, sf, "audio").select("audio_path", *[
        F.col(p)["reason"].alias(p) for p in ("pass1", "preprocess", "pass2")])


_NORM = r"""trim(regexp_replace(regexp_replace(lower(nfc_normalize({0})), '[^\p{{L}}\p{{N}}_\s''\-]', ' ', 'g'),
    '\s+', ' ', 'g'))"""

# A hypothesis without its vowels is a subsequence of its reference, so their distance is the difference in length.
FULL = f"""{with_views("clips", "wave", body="").rstrip()}, {P1}{CAPPED},
    q AS ({QUALITY_SQL}),
    j AS (SELECT c.audio_path, c.doc_id, c.reason AS r1, CASE WHEN c.reason <> 'pass' THEN NULL WHEN c.doc_id % 97 = 0
      THEN 'preprocess_failed' ELSE 'pass' END AS r0, q.reason AS rq FROM capped c LEFT JOIN q ON q.vec_id = c.doc_id),
    k AS (SELECT j.*, CASE WHEN r0 = 'pass' THEN coalesce(rq, 'corrupt_audio') END AS r2, length(n) AS len, length(n) - length(h) AS lost
      FROM j JOIN (SELECT audio_path, {_NORM.format('text')} AS n, {_NORM.format("translate(text, 'aeiou', '')")} AS h FROM clips) USING (audio_path)),
    f AS (SELECT audio_path, r1 AS pass1, r0 AS preprocess, r2 AS pass2, CASE WHEN r2 <> 'pass' OR r2 IS NULL THEN NULL
      WHEN doc_id % 11 = 0 THEN 'asr_error' WHEN doc_id % 5 <> 0 OR len = 0 OR lost::DOUBLE / len <= 0.4::DOUBLE THEN 'pass'
      ELSE 'transcript_mismatch_cer_' || format('{{:.2f}}', lost::DOUBLE / len) END AS pass3 FROM k)"""


@query("full_curation", FULL + " SELECT * FROM f")
def _(spark, sf):
    return curated(spark, sf).select("audio_path", *[
        F.col(p)["reason"].alias(p) for p in ("pass1", "preprocess", "pass2", "pass3")])


@query("full_curation_totals", FULL + """, t AS (
    SELECT 'pass1' AS pass, count(pass1) AS total, count(*) FILTER (WHERE pass1 = 'pass') AS kept, 30 AS fail, 2 AS warn FROM f
    UNION ALL SELECT 'preprocess', count(preprocess), count(*) FILTER (WHERE preprocess = 'pass'), 2, NULL FROM f
    UNION ALL SELECT 'pass2', count(pass2), count(*) FILTER (WHERE pass2 = 'pass'), 20, 1 FROM f
    UNION ALL SELECT 'pass3', count(pass3), count(*) FILTER (WHERE pass3 = 'pass'), 25, 1 FROM f)
    SELECT pass, total, kept, round(pct, 6) AS reject_pct, CASE WHEN pct > fail THEN 'fail' WHEN pct < warn THEN 'warn' ELSE 'ok' END AS status
    FROM (SELECT *, (total - kept)::DOUBLE / greatest(total, 1) * 100 AS pct FROM t)""")
def _(spark, sf):
    totals = P.pass_totals(curated(spark, sf), ["pass1", "preprocess", "pass2", "pass3"])
    return P.guardrail_status(totals).withColumn("reject_pct", F.round("reject_pct", 6))


def _chars(text: str) -> str:
    return f"array_to_string(list_transform(string_split({text}, ''), lambda c: chr(list_position(v, c)::INT)), '')"


@query("transcript_quality", with_views("utt_text", body=f"""SELECT key, round(cer, 4) AS cer, CASE WHEN cer > 0.4
    THEN 'transcript_mismatch_cer_' || printf('%.2f', cer) ELSE 'pass' END AS reason
    FROM (SELECT key, CASE WHEN length(rn) = 0 THEN 1.0::DOUBLE
        ELSE levenshtein({_chars("rn")}, {_chars("hn")})::DOUBLE / length(rn) END AS cer
      FROM (SELECT *, list_distinct(string_split(rn || hn, '')) AS v FROM (SELECT key, {_NORM.format("ref")} AS rn,
        {_NORM.format("hyp_a")} AS hn FROM utt_text)))"""))
def _(spark, sf):
    u = V.utterances(spark, sf)
    out = P.transcript_pass(u, ref="ref", hyp="hyp_a", detected="language")
    return out.select("key", F.col("pass3.details.cer").alias("cer"), F.col("pass3.reason").alias("reason"))


# --- manifest rows -----------------------------------------------------------------

@query("manifest_validation", with_views("clips", body=r"""SELECT doc_id, array_to_string(list_filter([
    CASE WHEN path = '' THEN 'audio_path is empty' END,
    CASE WHEN secs <= 0 THEN 'duration must be positive' END,
    CASE WHEN regexp_replace(text, '\s+', '', 'g') = '' THEN 'text is empty' END,
    CASE WHEN language NOT IN ('en', 'fr', 'de') THEN 'unsupported language: ' || language END,
    CASE WHEN doc_id % 4 = 0 AND language NOT IN ('en', 'fr', 'de') THEN 'unsupported span language: ' || language END,
    CASE WHEN doc_id % 4 = 0 AND doc_id % 8 = 0 THEN 'span start 5 not before end 5' END],
    lambda x: x IS NOT NULL), '; ') AS errors
    FROM (SELECT *, CASE WHEN doc_id % 50 = 0 THEN '' ELSE audio_path END AS path,
      CASE WHEN doc_id % 20 = 0 THEN 0 ELSE duration END AS secs FROM clips)"""))
def _(spark, sf):
    df = manifest_like(spark, sf)
    return df.select("doc_id", F.regexp_replace(F.array_join(P.manifest_errors(LANGS), "; "),
                                                r", got [0-9.]+", "").alias("errors"))


def manifest_like(spark, sf):
    k = F.col("doc_id")
    span = F.array(F.struct(F.lit(0).alias("start"), F.lit(4).alias("end"), F.col("language").alias("language")),
                   F.struct(F.lit(5).alias("start"), F.when(k % 8 == 0, 5).otherwise(9).alias("end"), F.lit("en").alias("language")))
    return V.clips(spark, sf).withColumns({
        "audio_path": F.when(k % 50 == 0, "").otherwise(F.col("audio_path")),
        "duration": F.when(k % 20 == 0, 0.0).otherwise(F.col("duration")),
        "cs_spans": F.when(k % 4 == 0, span)})


@query("valid_manifest_rows", with_views("clips", body=r"""SELECT language, count(*) AS n FROM clips
    WHERE doc_id % 50 <> 0 AND doc_id % 20 <> 0 AND regexp_replace(text, '\s+', '', 'g') <> '' AND language IN ('en', 'fr', 'de')
      AND doc_id % 8 <> 0 GROUP BY ALL"""))
def _(spark, sf):
    return P.valid_rows(manifest_like(spark, sf), LANGS).groupBy("language").agg(F.count("*").alias("n"))


@query("manifest_projection", with_views("clips", body=rf"""SELECT 'raw/' || audio_path AS audio_path, duration, {_TRIM} AS text,
    language, dialect, speaker_id, '' AS domain, FALSE AS is_code_switched, 16000 AS sample_rate,
    'afrispeech-200' AS corpus FROM clips"""))
def _(spark, sf):
    rows = V.clips(spark, sf).withColumn("raw_audio_path", F.concat(F.lit("raw/"), "audio_path"))
    return P.to_manifest(rows).drop("cs_spans")


@query("duration_range", with_views("clips", body="SELECT audio_path, duration FROM clips WHERE duration BETWEEN 0.5 AND 30.0"))
def _(spark, sf):
    return P.duration_between(V.clips(spark, sf)).select("audio_path", "duration")


@query("country_filter", """SELECT c_custkey, nation FROM (SELECT c_custkey, '  ' || lower(n_name) || ' ' AS nation
    FROM customer JOIN nation ON c_nationkey = n_nationkey) WHERE upper(trim(nation)) IN ('NATION_3', 'NATION_14')""")
def _(spark, sf):
    c, n = V.table(spark, sf, "customer"), V.table(spark, sf, "nation")
    rows = c.join(n, c.c_nationkey == n.n_nationkey).select(
        "c_custkey", F.concat(F.lit("  "), F.lower("n_name"), F.lit(" ")).alias("country"))
    return P.from_countries(rows, ("NATION_3", "NATION_14")).withColumnRenamed("country", "nation")


@query("sample_rate_filter", """SELECT vec_id, rate AS sample_rate FROM (SELECT vec_id, CASE vec_id % 5 WHEN 0 THEN 8000
    WHEN 1 THEN 11025 WHEN 2 THEN 16000 WHEN 3 THEN 48000 ELSE 96000 END AS rate FROM embeddings)
    WHERE rate IN (8000, 16000, 22050, 24000, 44100, 48000)""")
def _(spark, sf):
    k = F.col("vec_id") % 5
    rate = F.when(k == 0, 8000).when(k == 1, 11025).when(k == 2, 16000).when(k == 3, 48000).otherwise(96000)
    return P.allowed_sample_rate(V.table(spark, sf, "embeddings").select("vec_id", rate.alias("sample_rate")))


@query("nfc_audit", """SELECT count(*) AS checked, count(*) FILTER (WHERE nfc_normalize(t) <> t) AS bad
    FROM (SELECT CASE WHEN doc_id % 3 = 0 THEN text || 'e' || chr(769) ELSE text END AS t FROM documents)""")
def _(spark, sf):
    t = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("e\u0301"))).otherwise(F.col("text"))
    return P.nfc_audit(V.table(spark, sf, "documents").select(t.alias("text")))


@query("not_composed_rows", """SELECT doc_id FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text || 'e' || chr(769)
    ELSE text END AS t FROM documents) WHERE nfc_normalize(t) <> t""")
def _(spark, sf):
    t = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("e\u0301"))).otherwise(F.col("text"))
    return P.not_nfc(V.table(spark, sf, "documents").select("doc_id", t.alias("text"))).select("doc_id")


@query("evaluation_selection", with_views("clips", body="""SELECT audio_path FROM clips WHERE duration >= 3.0
    ORDER BY md5('42:' || audio_path), audio_path LIMIT 100"""))
def _(spark, sf):
    from kalangu.plans.evaluate import select_clips

    return select_clips(V.clips(spark, sf), "audio_path", 3.0, 100).select("audio_path")


@query("cer_threshold", """SELECT d.doc_id, toxic * 0.5::DOUBLE AS cer FROM documents d LEFT JOIN labels l USING (doc_id)
    WHERE toxic IS NULL OR toxic * 0.5 <= 0.4""")
def _(spark, sf):
    d, lab = V.table(spark, sf, "documents"), V.table(spark, sf, "labels")
    return P.within_cer(d.select("doc_id").join(lab, "doc_id", "left").select(
        "doc_id", (F.col("toxic") * 0.5).alias("cer")))


@query("step_thinning", with_views("ev", body="""SELECT run_id, step, pos FROM ev WHERE type = 'step' AND (step % 10 = 0 OR step = 1)"""))
def _(spark, sf):
    return P.thin_steps(V.run_events(spark, sf).filter("type = 'step'"), 10).select("run_id", "step", "pos")


@query("step_thinning_adaptive", with_views("ev", body="""SELECT run_id, step, pos FROM (SELECT *, (pos % 7) * 100 AS tot FROM ev
    WHERE type = 'step') WHERE step % (CASE WHEN tot >= 10 THEN greatest(1, tot // 100) ELSE 1 END) = 0 OR step = 1"""))
def _(spark, sf):
    steps = V.run_events(spark, sf).filter("type = 'step'").withColumn("total_steps", F.col("pos") % 7 * 100)
    return P.thin_steps(steps).select("run_id", "step", "pos")


@query("manifest_stats", with_views("clips", body="""SELECT count(*) AS total_rows, round(sum(duration) / 3600, 6) AS total_hours,
    (SELECT string_agg(language || '=' || printf('%.4f', h), ',' ORDER BY language) FROM (SELECT language, sum(duration) / 3600 AS h
       FROM clips GROUP BY 1)) AS languages,
    count(*) FILTER (WHERE doc_id % 4 = 0) AS cs_count, round(avg(duration), 6) AS mean_duration, max(duration) AS max_duration
    FROM clips"""))
def _(spark, sf):
    s = R.manifest_stats(V.clips(spark, sf).withColumn("is_code_switched", F.col("doc_id") % 4 == 0))
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("languages")), lambda e: F.format_string(
        "%s=%.4f", e["key"], e["value"])), ",")
    return s.select("total_rows", F.round("total_hours", 6).alias("total_hours"), shown.alias("languages"), "cs_count",
                    F.round("mean_duration", 6).alias("mean_duration"), "max_duration")


@query("language_counts", "SELECT lang AS language, count(*) AS n FROM documents GROUP BY ALL")
def _(spark, sf):
    from kalangu.operators.mixing import language_counts

    return language_counts(V.clips(spark, sf))
