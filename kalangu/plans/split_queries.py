"""Queries: joins between tables, splits, set operations, top-k, mixing."""

from pyspark.sql import functions as F

from kalangu import constants as C
from kalangu.functions import text as X
from kalangu.operators import filters as P
from kalangu.operators import metrics as R
from kalangu.operators import mixing as M
from kalangu.operators import splits as J
from kalangu.plans import views as V
from kalangu.plans.catalog import query
from kalangu.plans.views import with_views
from kalangu.sources import ingest, records


def speaker_map(spark, sf):
    """Speaker attributes for the clips that have labels, some with an empty speaker."""
    k = F.col("doc_id")
    return V.clips(spark, sf).join(V.table(spark, sf, "labels"), "doc_id", "left_semi").select(
        k.cast("string").alias("stem"), F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("spk"), (k % 40).cast("string")))
        .alias("speaker_id"), F.when(k % 2 == 0, "19-25").otherwise("26-40").alias("age_group"),
        F.when(k % 4 == 0, "").otherwise("f").alias("gender"), F.col("split").alias("split_origin"))


_MAP = """m AS (SELECT doc_id::VARCHAR AS stem, CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'spk' || (doc_id % 40) END AS speaker_id,
    CASE WHEN doc_id % 2 = 0 THEN '19-25' ELSE '26-40' END AS age_group, CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'f' END AS gender,
    split AS split_origin FROM clips WHERE doc_id IN (SELECT doc_id FROM labels))"""


@query("speaker_merge", f"""{with_views("clips", body="").rstrip()}, {_MAP}
    SELECT audio_path, m.stem IS NOT NULL AS matched, CASE WHEN m.stem IS NULL OR m.speaker_id = '' THEN 'unknown'
    ELSE m.speaker_id END AS speaker_id, m.age_group, m.gender, m.split_origin AS hf_split_origin
    FROM clips LEFT JOIN m ON m.stem = clips.doc_id::VARCHAR""")
def _(spark, sf):
    return J.merge_speakers(V.clips(spark, sf), speaker_map(spark, sf)).select(
        "audio_path", "matched", "speaker_id", "age_group", "gender", "hf_split_origin")


@query("speaker_map_summary", f"""{with_views("clips", body="").rstrip()}, {_MAP} SELECT count(*) AS mapped,
    count(DISTINCT speaker_id) FILTER (WHERE speaker_id <> '') AS speakers, count(*) FILTER (WHERE speaker_id = '') AS empty FROM m""")
def _(spark, sf):
    return J.speaker_map_summary(speaker_map(spark, sf))


def scores(spark, sf):
    lab = V.table(spark, sf, "labels")
    return V.clips(spark, sf).select("doc_id", "audio_path").join(lab, "doc_id").select(
        "audio_path", (F.col("toxic") * 0.5).alias("cer"), (F.col("quality") == 0).alias("is_code_switched"),
        F.when(F.col("quality") == 0, "").otherwise("xx").alias("detected_language"))


@query("score_status_counts", with_views("clips", body="""SELECT CASE WHEN l.doc_id IS NULL THEN 'missing' WHEN toxic * 0.5 > 0.4
    THEN 'dropped' ELSE 'kept' END AS status, count(*) AS n FROM clips c LEFT JOIN labels l ON l.doc_id = c.doc_id GROUP BY ALL"""))
def _(spark, sf):
    return J.score_status(V.clips(spark, sf), scores(spark, sf)).groupBy("status").agg(F.count("*").alias("n"))


@query("score_merge", with_views("clips", body="""SELECT audio_path, toxic * 0.5::DOUBLE AS cer, quality = 0 AS is_code_switched,
    CASE WHEN quality = 0 THEN NULL ELSE 'xx' END AS detected_language FROM clips JOIN labels USING (doc_id)
    WHERE toxic * 0.5 <= 0.4"""))
def _(spark, sf):
    return J.apply_scores(V.clips(spark, sf), scores(spark, sf)).select(
        "audio_path", "cer", "is_code_switched", "detected_language")


def leaky(spark, sf):
    """Customers of a nation as speakers: some segments are train, others dev."""
    c = V.table(spark, sf, "orders").select(
        "o_orderkey", F.when(F.col("o_custkey") % 11 == 0, "unknown").when(F.col("o_custkey") % 13 == 0, F.lit(None))
        .otherwise(F.concat(F.lit("c"), F.col("o_custkey").cast("string"))).alias("speaker_id"),
        (F.col("o_orderstatus") == "F").alias("in_train"))
    return c.filter("in_train"), c.filter("not in_train")


_LEAKY = """o AS (SELECT o_orderkey, CASE WHEN o_custkey % 11 = 0 THEN 'unknown' WHEN o_custkey % 13 = 0 THEN NULL
    ELSE 'c' || o_custkey END AS speaker_id, o_orderstatus = 'F' AS in_train FROM orders),
    t AS (SELECT DISTINCT speaker_id FROM o WHERE in_train AND speaker_id <> 'unknown'),
    d AS (SELECT * FROM o WHERE NOT in_train)"""


@query("speaker_disjoint_split", f"""WITH {_LEAKY} SELECT o_orderkey, speaker_id FROM d
    WHERE speaker_id IS NULL OR speaker_id NOT IN (SELECT speaker_id FROM t)""")
def _(spark, sf):
    train, rest = leaky(spark, sf)
    return J.without_speakers(rest, train).select("o_orderkey", "speaker_id")


@query("leaked_speakers", f"WITH {_LEAKY} SELECT speaker_id FROM t INTERSECT SELECT speaker_id FROM d")
def _(spark, sf):
    return J.leaked_speakers(*leaky(spark, sf))


@query("known_speakers", f"WITH {_LEAKY} SELECT speaker_id FROM t")
def _(spark, sf):
    return J.known_speakers(leaky(spark, sf)[0])


@query("held_out_speakers", f"""WITH {_LEAKY} SELECT DISTINCT speaker_id FROM d WHERE speaker_id <> 'unknown'
    EXCEPT SELECT speaker_id FROM t""")
def _(spark, sf):
    return J.held_out_speakers(*leaky(spark, sf))


@query("split_leak_report", f"""WITH {_LEAKY}, j AS (SELECT d.speaker_id, t.speaker_id IS NOT NULL AS leak FROM d LEFT JOIN t USING (speaker_id))
    SELECT count(*) FILTER (WHERE leak) AS removed_clips, count(DISTINCT speaker_id) FILTER (WHERE leak) AS leaked_speakers,
    count(*) FILTER (WHERE NOT leak) AS kept_clips,
    count(DISTINCT speaker_id) FILTER (WHERE NOT leak AND speaker_id <> 'unknown') AS disjoint_speakers FROM j""")
def _(spark, sf):
    train, rest = leaky(spark, sf)
    return J.leak_report(rest, train)


@query("pass_results_by_key", with_views("clips", body="SELECT audio_path, doc_id % 3 = 0 AS keep FROM clips"))
def _(spark, sf):
    c = V.clips(spark, sf)
    return P.merge_results(c.select("audio_path"), c.select("audio_path", (F.col("doc_id") % 3 == 0).alias("keep")), "audio_path")


def per_clip(spark, sf):
    """One record per page, named as a clip of the same number."""
    return V.table(spark, sf, "pages").select(
        F.concat(F.col("page_id").cast("string"), F.lit(".flac")).alias("audio"), (F.col("page_id") % 7 / 10).alias("wer"))


@query("enrich_by_file_name", """SELECT p.page_id || '.flac' AS audio, p.page_id % 7 / 10.0::DOUBLE AS wer,
    coalesce(d.source, '') AS dialect, coalesce(d.lang, '') AS language FROM pages p LEFT JOIN documents d ON d.doc_id = p.page_id AND d.doc_id IN (SELECT doc_id FROM labels)""")
def _(spark, sf):
    side = V.clips(spark, sf).join(V.table(spark, sf, "labels"), "doc_id", "left_semi")
    return J.enrich_by_basename(per_clip(spark, sf), side, ["dialect", "language"], "doc_id")


@query("reused_clip_list", """SELECT d.doc_id::BIGINT AS idx, d.doc_id || '.flac' AS audio, lang AS language FROM pages p
    JOIN documents d ON d.doc_id = p.page_id WHERE d.doc_id IN (SELECT doc_id FROM labels)""")
def _(spark, sf):
    prev = V.table(spark, sf, "pages").select(
        F.col("page_id").alias("idx"), F.concat(F.col("page_id").cast("string"), F.lit(".flac")).alias("audio"))
    side = V.clips(spark, sf).join(V.table(spark, sf, "labels"), "doc_id", "left_semi")
    return J.reuse_clip_list(prev, side, "doc_id").select("idx", "audio", "language")


@query("not_yet_ingested", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(spark, sf):
    return J.not_yet_ingested(V.table(spark, sf, "documents").select("doc_id"), V.table(spark, sf, "labels"), "doc_id")


@query("label_map_lookup", """SELECT event_id, CASE event_type WHEN 'view' THEN 'neutral' WHEN 'click' THEN 'happy'
    WHEN 'error' THEN 'angry' END AS label FROM events WHERE event_type IN ('view', 'click', 'error')""")
def _(spark, sf):
    table = {"view": "neutral", "click": "happy", "error": "angry"}
    return V.table(spark, sf, "events").select(
        "event_id", records.map_label(F.col("event_type"), table).alias("label")).filter("label is not null")


@query("existing_files", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def _(spark, sf):
    return J.with_existing_files(V.table(spark, sf, "documents").select("doc_id"), V.table(spark, sf, "labels"), "doc_id")


# --- keep first / last --------------------------------------------------------------

@query("keep_first_path", """SELECT text AS audio_path, min(doc_id) AS doc_id FROM documents GROUP BY text""")
def _(spark, sf):
    d = V.table(spark, sf, "documents").select("doc_id", F.col("text").alias("audio_path"))
    return P.keep_first_path(d, [F.col("doc_id")])


@query("keep_last_entry", """SELECT user_id, arg_max(event_type, row(ts, event_id)) AS event_type,
    arg_max(event_id, row(ts, event_id)) AS event_id FROM events GROUP BY user_id""")
def _(spark, sf):
    e = V.table(spark, sf, "events").select("user_id", "event_type", "event_id", F.struct("ts", "event_id").alias("o"))
    return P.keep_last(e, ["user_id"], "o").drop("o")


# --- samples, splits, top-k ------------------------------------------------------------

@query("shuffled_split", """SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) <=
    floor((SELECT count(*) FROM documents) * 0.9::DOUBLE) AS is_train FROM documents""")
def _(spark, sf):
    return J.shuffled_split(V.table(spark, sf, "documents").select("doc_id"), "doc_id")


@query("seeded_sample", "SELECT doc_id, lang FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 100")
def _(spark, sf):
    return J.seeded_sample(V.table(spark, sf, "documents").select("doc_id", "lang"), "doc_id", 100)


@query("shortest_clips", with_views("clips", body="SELECT audio_path, duration FROM clips ORDER BY duration, audio_path LIMIT 50"))
def _(spark, sf):
    return J.first_n(V.clips(spark, sf), [F.col("duration"), F.col("audio_path")], 50).select("audio_path", "duration")


@query("first_rows", "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 20")
def _(spark, sf):
    return J.first_n(V.table(spark, sf, "documents").select("doc_id", "lang"), [F.col("doc_id")], 20)


@query("top_speakers", "SELECT source AS speaker_id, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, 1 LIMIT 5")
def _(spark, sf):
    return R.histogram(V.clips(spark, sf), "speaker_id", 5)


@query("dialect_histogram", "SELECT source AS dialect, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, 1 LIMIT 8")
def _(spark, sf):
    return R.histogram(V.clips(spark, sf), "dialect", 8)


@query("label_sources_union", """SELECT 'doc' AS source, doc_id AS id, NULL AS label FROM documents
    UNION ALL SELECT 'vec', vec_id, label FROM embeddings""")
def _(spark, sf):
    d = V.table(spark, sf, "documents").select(F.lit("doc").alias("source"), F.col("doc_id").alias("id"))
    e = V.table(spark, sf, "embeddings").select(F.lit("vec").alias("source"), F.col("vec_id").alias("id"), "label")
    return J.union_all(d, e)


@query("returned_not_accepted_orders", """SELECT l_orderkey AS speaker_id FROM lineitem WHERE l_returnflag = 'R'
    EXCEPT SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A'""")
def _(spark, sf):
    """Set difference of two key sets of one table."""
    rows = V.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("speaker_id"), "l_returnflag")
    return rows.filter("l_returnflag = 'R'").select("speaker_id").subtract(rows.filter("l_returnflag = 'A'").select("speaker_id"))


# --- ingest ----------------------------------------------------------------------------

def ingest_rows(spark, sf):
    k = F.col("doc_id")
    return V.table(spark, sf, "documents").select(
        F.concat(F.lit("f"), (k - k % 3).cast("string")).alias("file"), F.when(k % 4 == 0, " ng ").when(k % 4 == 1, "Nigeria")
        .otherwise("GH").alias("country"), (k % 5 != 0).alias("has_audio"),
        F.when(k % 7 == 0, 11025).otherwise(16000).alias("sample_rate"), k.alias("order"))


_INGEST = """r AS (SELECT 'f' || (doc_id - doc_id % 3) AS file, CASE doc_id % 4 WHEN 0 THEN ' ng ' WHEN 1 THEN 'Nigeria' ELSE 'GH' END AS country,
    doc_id % 5 <> 0 AS has_audio, CASE WHEN doc_id % 7 = 0 THEN 11025 ELSE 16000 END AS sample_rate, doc_id AS ord FROM documents),
    w AS (SELECT file, min(ord) AS "order" FROM r WHERE upper(trim(country)) IN ('NG', 'NIGERIA') AND has_audio AND sample_rate = 16000
      AND file NOT IN (SELECT 'f' || doc_id FROM labels) GROUP BY file)"""


@query("country_ingest", f'WITH {_INGEST} SELECT file, "order" FROM w')
def _(spark, sf):
    seen = V.table(spark, sf, "labels").select(F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("file"))
    return ingest.new_rows(ingest_rows(spark, sf), seen).select("file", "order")


@query("ingest_summary", f"""WITH {_INGEST} SELECT (SELECT count(*) FROM r) AS scanned, (SELECT count(*) FROM r
    WHERE upper(trim(country)) IN ('NG', 'NIGERIA')) AS matched, (SELECT count(*) FROM w) AS written""")
def _(spark, sf):
    seen = V.table(spark, sf, "labels").select(F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("file"))
    rows = ingest_rows(spark, sf)
    return ingest.ingest_summary(rows, ingest.new_rows(rows, seen))


@query("ingest_preview", """SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 5""")
def _(spark, sf):
    return ingest.preview(V.table(spark, sf, "documents").select("doc_id", "lang").orderBy("doc_id"), 5)


# --- mixing ------------------------------------------------------------------------------

_W = """c AS (SELECT lang AS language, count(*) AS n FROM documents GROUP BY 1),
    w AS (SELECT *, pow(n::DOUBLE, 0.3::DOUBLE) / sum(pow(n::DOUBLE, 0.3::DOUBLE)) OVER () AS weight FROM c)"""


@query("sampling_weights", f"WITH {_W} SELECT language, n, round(weight, 9) AS weight FROM w")
def _(spark, sf):
    w = M.sampling_weights(M.language_counts(V.clips(spark, sf)))
    return w.withColumn("weight", F.round("weight", 9))


@query("expected_shares", """WITH h AS (SELECT lang AS language, sum(n_chars) / 14.0::DOUBLE / 3600 AS hours FROM documents GROUP BY 1)
    SELECT language, round(pow(hours, 0.3::DOUBLE) / sum(pow(hours, 0.3::DOUBLE)) OVER (), 9) AS share FROM h""")
def _(spark, sf):
    h = V.clips(spark, sf).groupBy("language").agg((F.sum("duration") / 3600).alias("hours"))
    return M.expected_shares(h).select("language", F.round("share", 9).alias("share"))


def _plan_sql(total: str, extra: str = "") -> str:
    return f"""WITH {_W}, b AS (SELECT *, coalesce(sum(weight) OVER (ORDER BY language ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo,
      CASE WHEN row_number() OVER (ORDER BY language DESC) = 1 THEN 1.0 ELSE sum(weight) OVER (ORDER BY language ROWS UNBOUNDED PRECEDING) END AS hi FROM w),
    u AS (SELECT draw, ('0x' || substr(md5('42:' || draw), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u1,
      ('0x' || substr(md5('43:' || draw), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u2 FROM range(0, ({total})) t(draw)),
    p AS (SELECT draw, language, least(floor(u2 * n), n - 1)::BIGINT + 1 AS slot FROM u JOIN b ON u1 >= lo AND u1 < hi),
    r AS (SELECT lang AS language, doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) AS slot FROM documents)
    SELECT draw, language, doc_id{extra} FROM p JOIN r USING (language, slot)"""


@query("mixed_plan", _plan_sql("SELECT 5 * count(*) FROM documents"))
def _(spark, sf):
    pool = V.clips(spark, sf).select("doc_id", "language")
    return M.mixed_plan(pool, "doc_id", 5 * pool.count(), rows_per_copy=100)


@query("batched_plan", _plan_sql("SELECT 16 * (count(*) // 4) FROM documents", ", (draw // 16)::BIGINT AS batch_id"))
def _(spark, sf):
    pool = V.clips(spark, sf).select("doc_id", "language")
    return M.batched_plan(pool, "doc_id", pool.count() // 4, 16)


@query("rank_within_language", """SELECT doc_id, lang AS language, row_number() OVER (PARTITION BY lang
    ORDER BY md5('42:' || doc_id), doc_id) AS rank FROM documents""")
def _(spark, sf):
    from kalangu.operators.scale import hash_ranked

    return hash_ranked(V.clips(spark, sf).select("doc_id", "language"), ["language"], F.col("doc_id"))


@query("weighted_pick", f"""WITH {_W}, b AS (SELECT *, coalesce(sum(weight) OVER (ORDER BY language ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo,
      CASE WHEN row_number() OVER (ORDER BY language DESC) = 1 THEN 1.0 ELSE sum(weight) OVER (ORDER BY language ROWS UNBOUNDED PRECEDING) END AS hi FROM w)
    SELECT l_orderkey, l_linenumber, language FROM (SELECT l_orderkey, l_linenumber, ('0x' || substr(md5('42:' || l_orderkey || '-' || l_linenumber), 1, 8))::BIGINT
      / 4294967296.0::DOUBLE AS u FROM lineitem) JOIN b ON u >= lo AND u < hi""")
def _(spark, sf):
    from kalangu.functions.hashing import seeded_uniform

    bounds = M.weight_bounds(M.sampling_weights(M.language_counts(V.clips(spark, sf))))
    key = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    lines = V.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    return M.pick_group(lines, seeded_uniform(key), bounds).select(
        "l_orderkey", "l_linenumber", F.col("pick")["language"].alias("language"))


@query("control_tokens", """SELECT doc_id, '<|' || CASE doc_id % 5 WHEN 0 THEN 'en' WHEN 1 THEN 'ha' WHEN 2 THEN 'yo' WHEN 3 THEN 'ig' ELSE 'pcm' END || '|>' AS token FROM documents""")
def _(spark, sf):
    tag = F.element_at(F.array(*map(F.lit, ("en", "ha", "yo", "ig", "pcm"))), (F.col("doc_id") % 5 + 1).cast("int"))
    return V.table(spark, sf, "documents").select("doc_id", X.control_token(tag, C.LANGUAGE_TOKENS).alias("token"))
