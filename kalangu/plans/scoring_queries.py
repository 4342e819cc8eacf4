"""Queries: error rates, alignments, tier statistics over all utterances."""

from pyspark.sql import functions as F

from kalangu.functions import scoring as M
from kalangu.functions import text as X
from kalangu.operators import metrics as R
from kalangu.plans import views as V
from kalangu.plans.catalog import query
from kalangu.plans.evaluate import evaluate
from kalangu.plans.views import with_views


def _chars(text: str, vocab: str = "v") -> str:
    return f"array_to_string(list_transform(string_split({text}, ''), lambda c: chr(list_position({vocab}, c)::INT)), '')"


def _symbols(words: str, vocab: str = "v") -> str:
    return f"array_to_string(list_transform({words}, lambda x: chr(list_position({vocab}, x)::INT)), '')"


@query("clip_wer", with_views("utt_dist", body="SELECT key, round(da::DOUBLE / len(rw), 4) AS wer FROM utt_dist"))
def _(spark, sf):
    # every text is split into words once
    u = V.utterances(spark, sf).select("key", X.words(F.col("ref")).alias("r"), X.words(F.col("hyp_a")).alias("h"))
    return u.select("key", F.round(M.words_wer(F.col("r"), F.col("h")), 4).alias("wer"))


_CHAR_DIST = f"""chars AS (SELECT *, levenshtein({_chars("ref", "cv")}, {_chars("hyp_a", "cv")}) AS cd
    FROM (SELECT *, list_distinct(string_split(ref || hyp_a, '')) AS cv FROM utt_dist))"""


@query("clip_cer", f"""{with_views("utt_dist", body="").rstrip()}, {_CHAR_DIST}
    SELECT key, round(cd::DOUBLE / length(ref), 4) AS cer FROM chars""")
def _(spark, sf):
    return V.utterances(spark, sf).select("key", F.round(M.clip_cer(F.col("ref"), F.col("hyp_a")), 4).alias("cer"))


# --- whole documents, up to tens of thousands of words each: too slow in SQL, tested against brute force -----------

@query("whole_text_wer")
def _(spark, sf):
    """Word errors of whole documents."""
    d = V.spread(V.clips(spark, sf)).select("doc_id", X.words(F.col("text")).alias("w"))
    d = d.select("doc_id", "w", V.hypothesis_a(F.col("w")).alias("a"))
    return d.filter(F.size("w") > 0).select("doc_id", M.word_distance(F.col("w"), F.col("a")).alias("errors"), F.size("w").alias("words"))


@query("whole_text_cer")
def _(spark, sf):
    """Character errors of whole documents."""
    return V.texts(spark, sf).select("doc_id", F.round(M.clip_cer(F.col("ref"), F.col("hyp")), 4).alias("cer"))


@query("whole_text_alignment")
def _(spark, sf):
    """Hits, substitutions, deletions and insertions of whole documents."""
    return M.with_alignment(V.texts(spark, sf), X.words(F.lower("ref")), X.words(F.lower("hyp")), "a").select("doc_id", "a.*")


@query("whole_corpus_wer")
def _(spark, sf):
    return _report(R.word_error_report(V.texts(spark, sf)))


@query("whole_wer_per_language")
def _(spark, sf):
    return _report(R.word_error_report(V.texts(spark, sf), ["language"]))


# alignment counts by dynamic programming over lists; a cell packs cost, substitutions, deletions
ALIGN_SQL = """pairs AS (SELECT key, list_transform(rw, lambda x: lower(x)) AS r, list_transform(aw, lambda x: lower(x)) AS h FROM utt),
    dp AS (SELECT key, r, h, list_reduce(list_prepend(
        list_transform(range(0, len(h) + 1), lambda j: j * 1000000000000),
        list_transform(range(1, len(r) + 1), lambda i: [i::BIGINT])),
      lambda prev, cur: list_reduce(
        list_prepend([prev[1] + 1000000000000 + 1000], list_transform(range(1, len(h) + 1), lambda j: [j::BIGINT])),
        lambda row, jj: list_append(row,
          CASE WHEN (prev[jj[1]] + CASE WHEN r[cur[1]] = h[jj[1]] THEN 0 ELSE 1000001000000 END) // 1000000000000
                 <= least(prev[jj[1] + 1] // 1000000000000, row[jj[1]] // 1000000000000) + 1
               THEN prev[jj[1]] + CASE WHEN r[cur[1]] = h[jj[1]] THEN 0 ELSE 1000001000000 END
               WHEN prev[jj[1] + 1] // 1000000000000 <= row[jj[1]] // 1000000000000 THEN prev[jj[1] + 1] + 1000000001000
               ELSE row[jj[1]] + 1000000000000 END))) AS fin FROM pairs),
    counts AS (SELECT key, len(r) AS n, len(h) AS m, fin[-1] // 1000000000000 AS cost, fin[-1] // 1000000 % 1000000 AS subs,
      fin[-1] // 1000 % 1000 AS dels FROM dp)"""


@query("word_alignment", f"""{with_views("utt", body="").rstrip()}, {ALIGN_SQL} SELECT key, (n - subs - dels)::INT AS hits,
    subs::INT AS substitutions, dels::INT AS deletions, (cost - subs - dels)::INT AS insertions FROM counts""")
def _(spark, sf):
    u = V.utterances(spark, sf)
    return M.with_alignment(u, X.words(F.lower("ref")), X.words(F.lower("hyp_a")), "a").select("key", "a.*")


_REPORT = """SELECT {0}round((sum(subs) + sum(dels) + sum(cost - subs - dels))::DOUBLE / sum(n), 6) AS wer,
    round(sum(cd)::DOUBLE / sum(cn), 6) AS cer, sum(n - subs - dels)::BIGINT AS hits, sum(subs)::BIGINT AS substitutions,
    sum(dels)::BIGINT AS deletions, sum(cost - subs - dels)::BIGINT AS insertions, sum(n)::BIGINT AS total_ref_words,
    sum(m)::BIGINT AS total_hyp_words FROM counts JOIN lc USING (key) {1}"""
_LOWER_CHARS = f"""lc AS (SELECT key, language, length(rl) AS cn, levenshtein({_chars("rl")}, {_chars("hl")}) AS cd
    FROM (SELECT *, list_distinct(string_split(rl || hl, '')) AS v FROM (SELECT key, language, lower(ref) AS rl, lower(hyp_a) AS hl FROM utt_text)))"""
_REPORT_HEAD = f'{with_views("utt_text", body="").rstrip()}, {ALIGN_SQL}, {_LOWER_CHARS} '


def _report(df):
    return df.withColumns({"wer": F.round("wer", 6), "cer": F.round("cer", 6)})


@query("corpus_wer", _REPORT_HEAD + _REPORT.format("", ""))
def _(spark, sf):
    return _report(R.word_error_report(V.utterances(spark, sf), hyp="hyp_a"))


@query("wer_per_language", _REPORT_HEAD + _REPORT.format("language, ", "GROUP BY language"))
def _(spark, sf):
    return _report(R.word_error_report(V.utterances(spark, sf), ["language"], hyp="hyp_a"))


@query("corpus_wer_tone_stripped", with_views("utt_dist", body=f"""SELECT sum(levenshtein({_symbols("r")}, {_symbols("h")}))::BIGINT AS errors,
    sum(len(r))::BIGINT AS words FROM (SELECT *, list_distinct(list_concat(r, h)) AS v FROM (SELECT
      list_transform(rw, lambda x: lower(strip_accents(x))) AS r, list_transform(aw, lambda x: lower(strip_accents(strip_accents(x)))) AS h FROM utt))"""))
def _(spark, sf):
    rep = R.word_error_report(V.utterances(spark, sf), hyp="hyp_a", mode="tone_stripped")
    return rep.select((F.col("substitutions") + F.col("deletions") + F.col("insertions")).alias("errors"),
                      F.col("total_ref_words").alias("words"))


@query("error_rates", f"""{with_views("utt_dist", body="").rstrip()}, {_CHAR_DIST} SELECT language, count(*) AS n, sum(da)::BIGINT AS word_errors,
    sum(len(rw))::BIGINT AS ref_words, sum(cd)::BIGINT AS char_errors, sum(length(ref))::BIGINT AS ref_chars,
    round(sum(da)::DOUBLE / sum(len(rw)), 6) AS wer, round(sum(cd)::DOUBLE / sum(length(ref)), 6) AS cer FROM chars GROUP BY language""")
def _(spark, sf):
    return _report(R.error_rates(V.utterances(spark, sf), ["language"], hyp="hyp_a"))


# --- code-switched WER ------------------------------------------------------------------

_TAGGED = r"""tw AS (SELECT conv_id, turn, role, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS ws FROM conversations),
    tc AS (SELECT conv_id, turn, role, ws AS w FROM tw WHERE len(ws) > 0),
    tp AS (SELECT *, list_transform(w, lambda x: lower(x)) AS r,
      list_transform(w, lambda x, i: CASE WHEN (i-1)%3=2 THEN 2 WHEN TRUE THEN 1 END) AS rt,
      list_transform(list_filter(list_transform(w, lambda x, i: CASE WHEN (i-1)%7=3 THEN NULL WHEN (i-1)%5=1 THEN 'x' ELSE x END), lambda x: x IS NOT NULL), lambda x: lower(x)) AS h,
      list_filter(list_transform(w, lambda x, i: CASE WHEN (i-1)%7=3 THEN NULL WHEN (i-1)%4=2 THEN 3 WHEN (i-1)%3=2 THEN 2 ELSE 1 END), lambda x: x IS NOT NULL) AS ht FROM tc),
    td AS (SELECT *, list_reduce(list_prepend(list_transform(range(0, len(h) + 1), lambda j: j * 1000000000000),
        list_transform(range(1, len(r) + 1), lambda i: [i::BIGINT])),
      lambda prev, cur: list_reduce(
        list_prepend([prev[1] + 1000000000000], list_transform(range(1, len(h) + 1), lambda j: [j::BIGINT])),
        lambda row, jj: list_append(row,
          CASE WHEN prev[jj[1]] // 1000000000000 + CASE WHEN r[cur[1]] = h[jj[1]] THEN 0 ELSE 1 END
                 <= least(prev[jj[1] + 1] // 1000000000000, row[jj[1]] // 1000000000000) + 1
               THEN prev[jj[1]] + CASE WHEN r[cur[1]] <> h[jj[1]] THEN 1000000000000 WHEN rt[cur[1]] <> ht[jj[1]] THEN 0
                 WHEN rt[cur[1]] = 2 THEN 1000 ELSE 1 END
               WHEN prev[jj[1] + 1] // 1000000000000 <= row[jj[1]] // 1000000000000 THEN prev[jj[1] + 1] + 1000000000000
               ELSE row[jj[1]] + 1000000000000 END))) AS fin FROM tp),
    ts AS (SELECT role, len(r) AS n, fin[-1] // 1000000000000 AS cost, fin[-1] % 1000 AS ok1, fin[-1] // 1000 % 1000 AS ok2,
      len(list_filter(rt, lambda x: x = 1)) AS n1, len(list_filter(rt, lambda x: x = 2)) AS n2 FROM td),
    tl AS (SELECT language, sum(words)::BIGINT AS words, sum(errors)::BIGINT AS tag_errors FROM (SELECT role AS language, n1 AS words, n1 - ok1 AS errors FROM ts
      UNION ALL SELECT 'mixed', n2, n2 - ok2 FROM ts) WHERE words > 0 GROUP BY language)"""


@query("code_switched_languages", f"WITH {_TAGGED} SELECT language, words, tag_errors, round(tag_errors::DOUBLE / words, 6) AS wer FROM tl")
def _(spark, sf):
    return R.code_switched_languages(V.tagged(spark, sf)).withColumn("wer", F.round("wer", 6))


@query("code_switched_wer", f"""WITH {_TAGGED}, s AS (SELECT sum(n) AS n, sum(cost) AS e FROM ts), t AS (SELECT sum(tag_errors) AS te, sum(words) AS tw FROM tl)
    SELECT round(least((e + te)::DOUBLE / n, 1.0::DOUBLE), 6) AS cs_wer, round(e::DOUBLE / n, 6) AS token_wer, round(1 - te::DOUBLE / tw, 6) AS tag_accuracy,
    (SELECT string_agg(language || '=' || printf('%.4f', tag_errors::DOUBLE / words), ',' ORDER BY language) FROM tl) AS per_language,
    n::BIGINT AS total_ref_words FROM s, t""")
def _(spark, sf):
    r = R.code_switched_wer(V.tagged(spark, sf))
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("per_language_wer")), lambda e: F.format_string(
        "%s=%.4f", e["key"], e["value"])), ",")
    return r.select(*[F.round(c, 6).alias(c) for c in ("cs_wer", "token_wer", "tag_accuracy")],
                    shown.alias("per_language"), "total_ref_words")


# --- per clip and tiers -------------------------------------------------------------------

GARBAGE = r"""(regexp_replace({h}, '\s+', '', 'g') <> '' AND (length(regexp_replace({h}, '[^\p{{L}}]|[\x{{0}}-\x{{24F}}]', '', 'g'))::DOUBLE / greatest(length({h}), 1) > 0.1
    OR regexp_matches({h}, '{run}') OR len({w}) > greatest(len(rw) * 3, len(rw) + 10)))"""
RUN4 = "|".join(c * 4 for c in "abcdefghijklmnopqrstuvwxyz")


def garbage(side: str) -> str:
    return GARBAGE.format(h=f"hyp_{side}", w=f"{side}w", run=RUN4)


@query("per_clip_scores", with_views("utt_dist", body=f"""SELECT key, round(db::DOUBLE / len(rw), 4) AS wer, {garbage("b")} AS is_garbage FROM utt_dist"""))
def _(spark, sf):
    return R.per_clip_scores(V.utterances(spark, sf), hyp="hyp_b").select("key", "wer", "is_garbage")


@query("tier_statistics", f"""{with_views("utt_dist", body="").rstrip()},
    s AS (SELECT duration, round(db::DOUBLE / len(rw), 4) AS w, regexp_replace(hyp_b, '\\s+', '', 'g') = '' AS blank, {garbage("b")} AS g FROM utt_dist WHERE duration >= 0.5),
    t AS (SELECT unnest(list_filter(['all', CASE WHEN duration < 3 THEN 'short_lt_3s' ELSE 'ge_3s' END, CASE WHEN duration >= 5 THEN 'ge_5s' END], lambda x: x IS NOT NULL)) AS tier, * FROM s),
    l AS (SELECT tier, list_sort(list(w)) AS ws, count(*) AS n, avg(w) AS mean, count(*) FILTER (WHERE blank) AS empty_hyps,
      count(*) FILTER (WHERE g) AS garbage_hyps, count(*) FILTER (WHERE w > 1) AS wer_over_100pct FROM t GROUP BY tier)
    SELECT tier, n, round(mean, 4) AS mean_wer, round((ws[((n - 1) // 2) + 1] + ws[(n // 2) + 1]) / 2, 4) AS median_wer,
      round(ws[floor(n * 0.25::DOUBLE)::INT + 1], 4) AS p25_wer, round(ws[floor(n * 0.75::DOUBLE)::INT + 1], 4) AS p75_wer,
      round(ws[floor(n * 0.95::DOUBLE)::INT + 1], 4) AS p95_wer, empty_hyps, garbage_hyps, wer_over_100pct FROM l""")
def _(spark, sf):
    clips = V.utterances(spark, sf).select("key", "duration", "ref", F.col("hyp_b").alias("hyp"))
    return evaluate(clips, "key")[1]


@query("duration_tiers", with_views("clips", body="""SELECT audio_path, array_to_string(list_filter(['all',
    CASE WHEN duration < 3 THEN 'short_lt_3s' END, CASE WHEN duration >= 3 THEN 'ge_3s' END, CASE WHEN duration >= 5 THEN 'ge_5s' END], lambda x: x IS NOT NULL), ',') AS tiers FROM clips"""))
def _(spark, sf):
    return V.clips(spark, sf).select("audio_path", F.array_join(R.duration_tiers(F.col("duration")), ",").alias("tiers"))


_STATS = """SELECT {0}n, round(mean, 1) AS mean, round(ws[n // 2 + 1], 1) AS median, round(ws[n // 4 + 1], 1) AS p25,
    round(ws[3 * n // 4 + 1], 1) AS p75, round(ws[floor(n * 0.95::DOUBLE)::INT + 1], 1) AS p95, round(ws[1], 1) AS min, round(ws[-1], 1) AS max
    FROM (SELECT {0}list_sort(list(duration)) AS ws, count(*) AS n, avg(duration) AS mean FROM clips {1})"""


@query("duration_distribution", with_views("clips", body=_STATS.format("", "")))
def _(spark, sf):
    return R.distribution_stats(V.clips(spark, sf), "duration")


@query("duration_distribution_by_split", with_views("clips", body=_STATS.format("split, ", "GROUP BY split")))
def _(spark, sf):
    return R.distribution_stats(V.clips(spark, sf), "duration", ["split"])


@query("text_statistics", with_views("doc_words", body="""SELECT split, n, round(mean, 1) AS mean, ws[n // 2 + 1] AS median, ws[3 * n // 4 + 1] AS p75,
    ws[floor(n * 0.95::DOUBLE)::INT + 1] AS p95 FROM (SELECT split, list_sort(list(len(ws))) AS ws, count(*) AS n, avg(len(ws)) AS mean FROM doc_words GROUP BY split)"""))
def _(spark, sf):
    return R.text_stats(V.spread(V.clips(spark, sf)), by=["split"])


@query("split_mismatch", with_views("clips", body="""SELECT split, count(*) AS n, round(avg(duration), 1) AS mean_duration,
    count(*) FILTER (WHERE duration < 10) AS short, round(count(*) FILTER (WHERE duration < 10) * 100.0::DOUBLE / count(*), 1) AS short_pct FROM clips GROUP BY split"""))
def _(spark, sf):
    return R.split_mismatch(V.clips(spark, sf), short=10.0)


@query("token_accuracy", """SELECT sum(len(c))::BIGINT AS tokens, sum(len(list_filter(c, lambda x: x[1] = x[2])))::BIGINT AS correct,
    round(sum(len(list_filter(c, lambda x: x[1] = x[2])))::DOUBLE / sum(len(c)), 6) AS accuracy FROM (SELECT list_filter(
      list_transform(range(1, 64), lambda i: [p[i], t[i + 1]]), lambda x: x[2] <> -100) AS c FROM (SELECT
      list_transform(embedding::FLOAT[], lambda x: floor(x::DOUBLE * 4)::INT) AS p,
      list_transform(embedding::FLOAT[], lambda x, i: CASE WHEN i % 5 = 0 THEN -100 ELSE floor(x::DOUBLE * 4)::INT END) AS t FROM embeddings))""")
def _(spark, sf):
    p = F.transform("embedding", lambda x: F.floor(x.cast("double") * 4).cast("int"))
    t = F.transform("embedding", lambda x, i: F.when((i + 1) % 5 == 0, -100).otherwise(F.floor(x.cast("double") * 4).cast("int")))
    out = R.token_accuracy(V.table(spark, sf, "embeddings").select(p.alias("pred_ids"), t.alias("label_ids")))
    return out.withColumn("accuracy", F.round("accuracy", 6))


_BASIC = r"trim(regexp_replace(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"


@query("dev_score", with_views("utt_text", body=f"""SELECT count(*) FILTER (WHERE len(r) > 0) AS scored, count(*) FILTER (WHERE len(r) = 0) AS skipped,
    round(sum(levenshtein({_symbols("r")}, {_symbols("h")})) FILTER (WHERE len(r) > 0)::DOUBLE / sum(len(r)), 6) AS wer
    FROM (SELECT r, h, list_distinct(list_concat(r, h)) AS v FROM (SELECT list_filter(string_split({_BASIC.format("ref")}, ' '), lambda x: x <> '') AS r,
      list_filter(string_split({_BASIC.format("hyp_a")}, ' '), lambda x: x <> '') AS h FROM utt_text))"""))
def _(spark, sf):
    return R.dev_score(V.utterances(spark, sf), hyp="hyp_a").withColumn("wer", F.round("wer", 6))


@query("skipped_references", with_views("utt_text", body=rf"""SELECT count(*) FILTER (WHERE {_BASIC.format("ref")} <> '') AS scored,
    count(*) FILTER (WHERE {_BASIC.format("ref")} = '') AS skipped FROM utt_text"""))
def _(spark, sf):
    return R.skipped_references(V.utterances(spark, sf).select(X.normalize_basic(F.col("ref")).alias("ref")))


@query("mean_loss", with_views("ev", body="SELECT round(avg(loss), 6) AS mean_loss FROM ev WHERE type = 'step'"))
def _(spark, sf):
    return R.mean_loss(V.run_events(spark, sf).filter("type = 'step'")).select(F.round("mean_loss", 6).alias("mean_loss"))
