"""Queries: two hypothesis sets compared clip by clip; the leaderboard."""

from pyspark.sql import functions as F

from kalangu.operators import compare as K
from kalangu.operators import metrics as R
from kalangu.operators import splits as J
from kalangu.plans import views as V
from kalangu.plans.catalog import query
from kalangu.plans.scoring_queries import RUN4, garbage
from kalangu.plans.views import with_views

_RATIO = r"length(regexp_replace(hyp_b, '[^\p{L}]|[\x{0}-\x{24F}]', '', 'g'))::DOUBLE / greatest(length(hyp_b), 1)"
_BASE = f"""base AS (SELECT *, da::DOUBLE / len(rw) AS xa, db::DOUBLE / len(rw) AS xb, {garbage("b")} AS g, {_RATIO} AS nl FROM utt_dist),
    ab AS (SELECT *, round(xa, 4) AS wer_a, round(xb, 4) AS wer_b, round(xb - xa, 4) AS delta FROM base)"""
_NARROW = f"""CASE WHEN nl > 0.1 OR len(bw) > greatest(len(rw) * 2, len(rw) + 5) OR regexp_matches(hyp_b, '{RUN4}|    ') THEN 'CATASTROPHIC'
    WHEN xb - xa > 0.05 THEN 'REGRESSED' WHEN xb - xa < -0.05 THEN 'IMPROVED' ELSE 'SAME' END"""
_WIDE = """CASE WHEN delta < -0.10 THEN 'IMPROVED' WHEN delta > 0.10 AND g THEN 'CATASTROPHIC' WHEN delta > 0.10 THEN 'REGRESSED' ELSE 'SAME' END"""
HEAD = f'{with_views("utt_dist", body="").rstrip()}, {_BASE}, sc AS (SELECT *, {_NARROW} AS verdict, {_WIDE} AS verdict_wide FROM ab) '


def pairs(spark, sf):
    return V.utterances(spark, sf).select("key", "speaker_id", "dialect", "duration", "ref", "hyp_a", "hyp_b")


def scored(spark, sf, variant="narrow"):
    return K.score_pairs(pairs(spark, sf), variant)


@query("paired_sides", with_views("utt_text", body="SELECT key, hyp_a, hyp_b FROM utt_text WHERE doc_id IN (SELECT doc_id FROM labels)"))
def _(spark, sf):
    u = V.utterances(spark, sf)
    return J.pair_sides(u.select("key", F.col("hyp_a").alias("hyp")),
                        u.join(V.table(spark, sf, "labels"), "doc_id", "left_semi").select("key", F.col("hyp_b").alias("hyp")), "key")


@query("narrow_verdicts", HEAD + "SELECT key, wer_a, wer_b, delta, g AS is_garbage, verdict FROM sc")
def _(spark, sf):
    return scored(spark, sf).select("key", "wer_a", "wer_b", "delta", "is_garbage", "verdict")


@query("wide_verdicts", HEAD + "SELECT key, delta, verdict_wide AS verdict FROM sc")
def _(spark, sf):
    return scored(spark, sf, "wide").select("key", "delta", "verdict")


@query("verdict_counts", HEAD + "SELECT verdict, count(*) AS n, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM sc), 2) AS pct FROM sc GROUP BY verdict")
def _(spark, sf):
    return K.verdict_counts(scored(spark, sf))


@query("side_averages", HEAD + """SELECT count(*) AS n, round(avg(wer_a), 6) AS mean_a, round(avg(wer_b), 6) AS mean_b,
    round((avg(wer_b) - avg(wer_a)) * 100, 4) AS delta_points FROM sc""")
def _(spark, sf):
    return K.side_averages(scored(spark, sf))


@query("overall_call", HEAD + """SELECT clips, regressed, round(regressed * 100.0::DOUBLE / clips, 4) AS regressed_pct, CASE WHEN regressed * 100.0 / clips >= 60 THEN 'BROAD'
    WHEN regressed * 100.0 / clips >= 30 THEN 'MIXED' ELSE 'NARROW' END AS call FROM (SELECT count(*) AS clips,
    count(*) FILTER (WHERE verdict IN ('REGRESSED', 'CATASTROPHIC')) AS regressed FROM sc)""")
def _(spark, sf):
    return K.overall_call(scored(spark, sf))


_BAD = "verdict IN ('REGRESSED', 'CATASTROPHIC')"


@query("regression_pattern", HEAD + f"""SELECT count(*) FILTER (WHERE {_BAD}) AS regressed, count(*) AS clips,
    round(avg(duration) FILTER (WHERE {_BAD}), 4) AS regressed_duration, round(avg(duration), 4) AS all_duration,
    round(avg(len(rw)) FILTER (WHERE {_BAD}), 4) AS regressed_words, round(avg(len(rw)), 4) AS all_words,
    count(*) FILTER (WHERE {_BAD} AND g) AS garbage FROM sc""")
def _(spark, sf):
    return K.regression_pattern(scored(spark, sf))


@query("regressed_by_dialect", HEAD + f"SELECT dialect, count(*) FILTER (WHERE {_BAD}) AS regressed, count(*) AS clips FROM sc GROUP BY dialect")
def _(spark, sf):
    return K.regressed_by(scored(spark, sf), "dialect")


@query("regressed_speakers", HEAD + f"SELECT speaker_id, count(*) FILTER (WHERE {_BAD}) AS regressed, count(*) AS clips FROM sc GROUP BY speaker_id ORDER BY regressed DESC, 1 LIMIT 5")
def _(spark, sf):
    return K.regressed_by(scored(spark, sf), "speaker_id", 5)


@query("failure_modes", HEAD + """SELECT CASE WHEN nl > 0.1 THEN 'wrong_lang' WHEN len(bw) < 0.5 * len(rw) THEN 'truncated'
    WHEN CASE WHEN hyp_a = '' THEN 1.0 ELSE len(bw)::DOUBLE / greatest(len(aw), 1) END > 1.4 THEN 'longer' ELSE 'other' END AS mode, count(*) AS n
    FROM sc WHERE delta > 0 GROUP BY 1""")
def _(spark, sf):
    return K.failure_modes(scored(spark, sf))


@query("ab_totals", HEAD + """SELECT count(*) AS analysed, round(avg(wer_a), 6) AS mean_a, round(avg(wer_b), 6) AS mean_b,
    count(*) FILTER (WHERE delta > 0) AS regressions, count(*) FILTER (WHERE delta < 0) AS improvements FROM sc""")
def _(spark, sf):
    return K.ab_totals(scored(spark, sf))


@query("top_regressions", HEAD + f"SELECT key, delta, verdict FROM sc WHERE {_BAD} ORDER BY delta DESC, key LIMIT 10")
def _(spark, sf):
    return K.top_by_delta(scored(spark, sf), "key", 10, verdicts=K.REGRESSED).select("key", "delta", "verdict")


@query("top_improvements", HEAD + "SELECT key, delta FROM sc WHERE verdict = 'IMPROVED' ORDER BY delta, key LIMIT 3")
def _(spark, sf):
    return K.top_by_delta(scored(spark, sf), "key", 3, worst=False, verdicts=("IMPROVED",)).select("key", "delta")


@query("worst_first_zero_as_missing", HEAD + """SELECT key, delta FROM sc ORDER BY CASE WHEN delta = 0 THEN -999 ELSE delta END DESC, key LIMIT 10""")
def _(spark, sf):
    return K.top_by_delta(scored(spark, sf), "key", 10, missing=-999).select("key", "delta")


@query("file_sizes_of_regressed", HEAD + f"""SELECT count(*) AS clips, round(avg(n_chars), 4) AS all_bytes,
    round(avg(n_chars) FILTER (WHERE {_BAD}), 4) AS regressed_bytes FROM sc JOIN documents d USING (doc_id)""")
def _(spark, sf):
    s = scored(spark, sf).withColumn("audio", F.substring_index("key", "-", 1))
    files = V.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("audio"), F.col("n_chars").alias("size_bytes"))
    return K.file_sizes_of_regressed(s, files)


def reports(spark, sf):
    """One report per source: the WER of side A by language, missing for every seventh."""
    u = R.error_rates(V.utterances(spark, sf), ["speaker_id", "language"], hyp="hyp_a")
    skip = F.substring("speaker_id", 4, 9).cast("int") % 7 == 0
    per = u.groupBy("speaker_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("language", F.round("wer", 4))))).alias("wer"))
    return per.select(F.col("speaker_id").alias("run_id"), F.lit("clean").alias("mode"), F.when(~skip, F.col("wer")).alias("wer"))


LEADERBOARD = with_views("utt_dist", body="""SELECT run_id, 'clean' AS mode, CASE WHEN NOT skip THEN round(avg(wer), 6) END AS overall,
    CASE WHEN NOT skip THEN max(wer) FILTER (WHERE language = 'en') END AS en, CASE WHEN NOT skip THEN max(wer) FILTER (WHERE language = 'fr') END AS fr,
    CASE WHEN NOT skip THEN max(wer) FILTER (WHERE language = 'de') END AS de FROM (SELECT speaker_id AS run_id, language, substr(speaker_id, 4)::INT % 7 = 0 AS skip,
    round(sum(da)::DOUBLE / sum(len(rw)), 4) AS wer FROM utt_dist GROUP BY ALL) GROUP BY run_id, skip""")


@query("leaderboard", LEADERBOARD)
def _(spark, sf):
    return K.leaderboard(reports(spark, sf), ("en", "fr", "de")).withColumn("overall", F.round("overall", 6))
