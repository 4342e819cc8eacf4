"""Queries: measures and transforms over sample arrays."""

from pyspark.sql import functions as F

from kalangu.functions import audio as A
from kalangu.functions import nested as N
from kalangu.functions import text as X
from kalangu.functions.hashing import seeded_uniform
from kalangu.functions.rounding import decimals
from kalangu.operators import arrays as B
from kalangu.operators import filters as P
from kalangu.plans import views as V
from kalangu.plans.catalog import query
from kalangu.plans.curation_queries import AUDIO, QUALITY_SQL
from kalangu.plans.views import with_views

_Q = f'{with_views("wave", body="").rstrip()}, q AS ({QUALITY_SQL}) '


def shown(c, places=6):
    """An array of doubles as text, so that engines compare it alike."""
    return F.array_join(F.transform(c, lambda x: decimals(x.cast("double") + F.lit(0.0), places)), " ")


def shown_sql(c, places=6):
    return f"array_to_string(list_transform({c}, lambda x: printf('%.{places}f', x::DOUBLE + 0.0::DOUBLE)), ' ')"


@query("audio_quality", _Q + """SELECT vec_id, reason, round(len(samples) / 640.0::DOUBLE, 4) AS duration_sec,
    CASE WHEN reason <> 'too_few_samples' THEN round(rms_db, 3) END AS rms_db,
    CASE WHEN reason <> 'too_few_samples' THEN round(20 * log10(greatest(peak, 1e-9)), 3) END AS peak_db,
    CASE WHEN reason NOT IN ('too_few_samples', 'silent', 'clipped') THEN round(snr_db, 3) END AS snr_db,
    CASE WHEN reason IN ('mostly_silence', 'pass') THEN round(silence_frac, 4) END AS silence_frac FROM q""")
def _(spark, sf):
    out = P.audio_pass(V.waveforms(spark, sf), AUDIO)
    d = F.col("pass2.details")
    return out.select("vec_id", "pass2.reason", *[d[c].alias(c) for c in ("duration_sec", "rms_db", "peak_db", "snr_db", "silence_frac")])


@query("audio_reject_reasons", _Q + "SELECT label, reason, count(*) AS n FROM q GROUP BY ALL")
def _(spark, sf):
    return P.audio_pass(V.waveforms(spark, sf), AUDIO).groupBy("label", F.col("pass2.reason").alias("reason")).agg(F.count("*").alias("n"))


@query("frame_levels", _Q + f"SELECT vec_id, {shown_sql('frames')} AS frames, round(snr_db, 6) AS snr_db, round(silence_frac, 6) AS silence_frac FROM q")
def _(spark, sf):
    frames = A.frame_rms(F.col("samples"), A.frame_size(F.col("sample_rate")))
    w = V.waveforms(spark, sf).select("vec_id", frames.alias("frames"))
    return w.select("vec_id", shown("frames").alias("frames"), F.round(A.snr_db(F.col("frames")), 6).alias("snr_db"),
                    F.round(A.silence_share(F.col("frames")), 6).alias("silence_frac"))


@query("levels", _Q + """SELECT vec_id, round(rms, 9) AS rms, round(peak, 9) AS peak, round(clip_frac, 9) AS clip_frac, round(rms_db, 6) AS rms_db,
    len(samples) / 640.0::DOUBLE AS seconds FROM q""")
def _(spark, sf):
    s = F.col("samples")
    return V.waveforms(spark, sf).select(
        "vec_id", F.round(A.rms(s), 9).alias("rms"), F.round(A.peak(s), 9).alias("peak"), F.round(A.clipped_share(s), 9).alias("clip_frac"),
        F.round(A.dbfs(A.rms(s)), 6).alias("rms_db"), A.duration_sec(s, F.col("sample_rate")).alias("seconds"))


@query("mono_mixdown", with_views("wave", body=f"""SELECT vec_id, {shown_sql("list_transform(range(1, 65), lambda i: ((samples[i]::DOUBLE + samples[65 - i]::DOUBLE) / 2)::FLOAT)")} AS samples FROM wave"""))
def _(spark, sf):
    two = F.array(F.col("samples"), F.reverse("samples"))
    w = V.waveforms(spark, sf).select("vec_id", A.mono(two).alias("m"))
    return w.select("vec_id", shown("m").alias("samples"))


@query("peak_ceiling", with_views("wave", body=f"""SELECT vec_id, {shown_sql("list_transform(samples, lambda x: (x::DOUBLE * f)::FLOAT)")} AS samples FROM
    (SELECT *, CASE WHEN pk > 0.99 THEN 0.99::DOUBLE / pk ELSE 1.0::DOUBLE END AS f FROM (SELECT *, list_max(list_transform(samples, lambda x: abs(x::DOUBLE))) AS pk FROM wave))"""))
def _(spark, sf):
    return V.waveforms(spark, sf).select("vec_id", shown(A.limit_peak(F.col("samples"))).alias("samples"))


@query("truncated_clips", with_views("wave", body=f"SELECT vec_id, {shown_sql('samples[1:32]')} AS samples FROM wave"))
def _(spark, sf):
    return V.waveforms(spark, sf).select("vec_id", shown(A.truncate(F.col("samples"), F.col("sample_rate"), 0.05)).alias("samples"))


@query("fixed_segments", with_views("wave", body=f"""SELECT vec_id, s AS segment, round(s * 20 / 640.0::DOUBLE, 2) AS start, round(least((s + 1) * 20 / 640.0::DOUBLE, 0.1::DOUBLE), 2) AS "end",
    {shown_sql("samples[s*20+1:s*20+20]")} AS samples FROM (SELECT *, unnest(range(0, 4))::INT AS s FROM wave)"""))
def _(spark, sf):
    out = B.segment_clips(V.waveforms(spark, sf), "vec_id", only_above_sec=0.09, segment_sec=20 / 640, min_samples=4)
    return out.withColumn("samples", shown("samples"))


@query("augmentation_plan", """SELECT vec_id, CASE WHEN u('speed') < 0.3 THEN [0.9, 1.0, 1.1][floor(u('speed_pick') * 3)::INT + 1]::DOUBLE END AS speed,
    u('telephony') < 0.5 AS telephony, CASE WHEN u('noise') < 0.3 THEN round(10 + u('snr') * 10, 6) END AS noise_snr_db FROM embeddings""".replace(
        "u('", "(('0x' || substr(md5('42:' || vec_id || ':").replace("')", "'), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"))
def _(spark, sf):
    w = V.waveforms(spark, sf).select("vec_id", A.augmentation_plan(F.col("vec_id")).alias("p")).select("vec_id", "p.*")
    return w.withColumn("noise_snr_db", F.round("noise_snr_db", 6))


_U = "(('0x' || substr(md5('{0}:' || vec_id || ':' || (i - 1)), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


@query("noise_at_snr", with_views("wave", body=f"""SELECT vec_id, {shown_sql("y", 5)} AS samples FROM (SELECT vec_id, list_transform(samples, lambda x, i: greatest(-1.0::DOUBLE, least(1.0::DOUBLE,
    x::DOUBLE + sg * sqrt(-2.0::DOUBLE * ln(greatest({_U.format(42)}, pow(2.0::DOUBLE, -33)))) * cos({_U.format(43)} * 6.283185307179586::DOUBLE)))) AS y
    FROM (SELECT *, sqrt(greatest(list_sum(list_transform(samples, lambda x: x::DOUBLE * x::DOUBLE)) / len(samples), 1e-9) / pow(10.0::DOUBLE, 1.5::DOUBLE)) AS sg FROM wave))"""))
def _(spark, sf):
    w = V.waveforms(spark, sf)
    return w.select("vec_id", shown(A.add_noise(F.col("samples"), F.col("vec_id"), F.lit(15.0)), 5).alias("samples"))


@query("mu_law_roundtrip", with_views("wave", body=f"""SELECT vec_id, {shown_sql("list_transform(q, lambda c: sign(c / 255.0::DOUBLE * 2 - 1) * (exp(abs(c / 255.0::DOUBLE * 2 - 1) * ln(256.0::DOUBLE)) - 1) / 255)", 5)} AS samples
    FROM (SELECT vec_id, list_transform(samples, lambda x: floor((sign(x::DOUBLE) * ln(1 + 255 * abs(x::DOUBLE)) / ln(256.0::DOUBLE) + 1) / 2 * 255 + 0.5)) AS q FROM wave)"""))
def _(spark, sf):
    return V.waveforms(spark, sf).select("vec_id", shown(A.mu_law_roundtrip(F.col("samples")), 5).alias("samples"))


@query("padded_batches", f"""SELECT doc_id, {shown_sql("list_concat(s, list_transform(range(0, mx - len(s)), lambda i: 0.0::FLOAT))", 1)} AS samples, len(s)::INT AS samples_length
    FROM (SELECT *, max(len(s)) OVER (PARTITION BY doc_id // 16) AS mx FROM (SELECT doc_id, list_transform(
      list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''), lambda x: length(x)::FLOAT) AS s FROM documents))""")
def _(spark, sf):
    """Word lengths of whole documents as samples: arrays of natural, very different lengths."""
    w = V.table(spark, sf, "documents").select(
        "doc_id", F.floor(F.col("doc_id") / 16).alias("batch"), F.transform(X.words(F.col("text")), lambda x: F.length(x).cast("float")).alias("samples"))
    return B.pad_batches(w, "batch", {"samples": 0.0}).select("doc_id", shown("samples", 1).alias("samples"), "samples_length")


@query("ranked_labels", """SELECT vec_id, array_to_string(list_transform(list_sort(list_transform(range(0, 64), lambda i: row(-(embedding[i + 1]::DOUBLE), 'label_' || i))), lambda r: r[2]), ',') AS ranking,
    (list_sort(list_transform(range(0, 64), lambda i: row(-(embedding[i + 1]::DOUBLE), 'label_' || i)))[1])[2] AS top FROM embeddings""")
def _(spark, sf):
    return V.score_maps(spark, sf).select("vec_id", F.array_join(F.transform(N.ranked_labels(F.col("scores")), lambda e: e["label"]), ",").alias("ranking"),
                                          N.top_label(F.col("scores")).alias("top"))


@query("span_texts", """SELECT doc_id, pos, CASE pos WHEN 0 THEN 'en' ELSE 'fr' END AS language,
    CASE pos WHEN 0 THEN substr(text, 1, length(text) // 3) ELSE substr(text, length(text) // 3 + 1) END AS text
    FROM (SELECT *, unnest([0, 1])::INT AS pos FROM documents)""")
def _(spark, sf):
    """Two spans that share each whole text."""
    d = V.table(spark, sf, "documents")
    cut = F.floor(F.length("text") / 3).cast("int")
    spans = N.parse_spans(F.format_string('[{"start":0,"end":%d,"language":"en"},{"start":%d,"end":%d,"language":"fr"}]', cut, cut, F.length("text")))
    return B.span_rows(d.withColumn("cs_spans", spans), "doc_id")


@query("decoded_payloads", "SELECT doc_id, md5(text) AS digest, octet_length(encode(text))::INT AS size FROM documents WHERE doc_id % 3 <> 0 UNION ALL SELECT doc_id, NULL, NULL FROM documents WHERE doc_id % 3 = 0")
def _(spark, sf):
    raw = F.base64(F.encode("text", "UTF-8"))
    payload = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("*"), raw)).otherwise(raw)
    b = N.try_decode_payload(payload)
    return V.table(spark, sf, "documents").select("doc_id", F.md5(b).alias("digest"), F.octet_length(b).alias("size"))


@query("user_transforms", with_views("wave", body=f"SELECT vec_id, {shown_sql('list_reverse(samples)', 4)} AS samples, 'LABEL ' || label AS text FROM wave"))
def _(spark, sf):
    w = V.waveforms(spark, sf).withColumn("text", F.concat(F.lit("label "), F.col("label").cast("string")))
    w = B.map_text(B.map_samples(w, F.reverse), F.upper)
    return w.select("vec_id", shown("samples", 4).alias("samples"), "text")


@query("model_scores", with_views("wave", body="""SELECT vec_id, CASE WHEN vec_id % 10 <> 0 THEN round(list_max(samples)::DOUBLE, 6) END AS loudest,
    CASE WHEN vec_id % 10 = 0 THEN 'cannot score' END AS error FROM wave"""))
def _(spark, sf):
    from kalangu.operators.hooks import score_with

    def load():
        import pandas as pd

        def run(frame):
            if (frame["vec_id"] % 10 == 0).any():
                raise ValueError("cannot score")
            return pd.DataFrame({"loudest": [float(max(s)) for s in frame["samples"]]})
        return run

    out = score_with(V.waveforms(spark, sf), load, "vec_id", "loudest double", ["samples"])
    return out.withColumn("loudest", F.round("loudest", 6))


@query("combined_analysis", """SELECT vec_id, CASE WHEN label < 5 THEN 'label_' || label END AS emotion, CASE WHEN label > 3 THEN label END AS gender FROM embeddings""")
def _(spark, sf):
    from kalangu.operators.hooks import combine_analyses

    w = V.table(spark, sf, "embeddings").select("vec_id", "label")
    emotion = w.filter("label < 5").select("vec_id", F.concat(F.lit("label_"), F.col("label").cast("string")).alias("top"))
    gender = w.filter("label > 3").select("vec_id", F.col("label").alias("top"))
    out = combine_analyses(w.select("vec_id"), "vec_id", emotion=emotion, gender=gender)
    return out.select("vec_id", F.col("emotion.top").alias("emotion"), F.col("gender.top").alias("gender"))


@query("seeded_uniforms", "SELECT doc_id, ('0x' || substr(md5('42:' || doc_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM documents")
def _(spark, sf):
    return V.table(spark, sf, "documents").select("doc_id", seeded_uniform(F.col("doc_id")).alias("u"))
