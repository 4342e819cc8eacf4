"""Queries: Unicode forms, normalisers, counts and path helpers over whole texts."""

from pyspark.sql import functions as F

from kalangu.functions import text as X
from kalangu.functions.rounding import on_product
from kalangu.operators import metrics as R
from kalangu.plans import views as V
from kalangu.plans.catalog import query
from kalangu.session import spread

MARKS = {"fr": "éèêçÉÈÊÇ", "de": "äöüßÄÖÜ", "es": "ñóíÑÓÍ"}
# a third of the texts end in an uncomposed letter
_T = "(SELECT doc_id, lang, CASE WHEN doc_id % 3 = 0 THEN text || '  e' || chr(769) || chr(9) ELSE text END AS t FROM documents)"


def texts(spark, sf):
    t = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("  e\u0301\t"))).otherwise(F.col("text"))
    return spread(V.table(spark, sf, "documents").select("doc_id", "lang", t.alias("t")))


def simple(name, sql, fn, out):
    query(name, f"SELECT doc_id, {sql} AS {out} FROM {_T}")(
        lambda spark, sf: texts(spark, sf).select("doc_id", fn().alias(out)))


simple("nfc", "nfc_normalize(t)", lambda: X.nfc(F.col("t")), "nfc")
simple("normalize_text", r"trim(regexp_replace(nfc_normalize(t), '\s+', ' ', 'g'))", lambda: X.normalize_text(F.col("t")), "norm")
simple("strip_tone_marks", "strip_accents(nfc_normalize(t))", lambda: X.strip_tone_marks(F.col("t")), "bare")
simple("is_nfc", "nfc_normalize(t) = t", lambda: X.is_nfc(F.col("t")), "composed")
simple("nfc_roundtrip", "TRUE", lambda: X.nfc_roundtrips(F.col("t")), "same")
simple("diacritic_count", f"""CASE lang WHEN 'fr' THEN length(regexp_replace(nfc_normalize(t), '[^{MARKS["fr"]}]', '', 'g'))
    WHEN 'de' THEN length(regexp_replace(nfc_normalize(t), '[^{MARKS["de"]}]', '', 'g'))
    WHEN 'es' THEN length(regexp_replace(nfc_normalize(t), '[^{MARKS["es"]}]', '', 'g')) ELSE 0 END""",
       lambda: X.count_diacritics(F.col("t"), F.col("lang"), MARKS), "marks")
simple("normalize_transcript", r"""trim(regexp_replace(regexp_replace(CASE WHEN lang = 'en' THEN lower(nfc_normalize(t)) ELSE nfc_normalize(t) END,
    '[^\p{L}\p{N}_\s''\-]', ' ', 'g'), '\s+', ' ', 'g'))""", lambda: X.normalize_transcript(F.col("t"), F.col("lang")), "norm")
simple("normalize_basic", r"trim(regexp_replace(regexp_replace(lower(t), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g'))",
       lambda: X.normalize_basic(F.col("t")), "norm")
simple("scoring_tokens", r"len(list_filter(regexp_split_to_array(lower(strip_accents(nfc_normalize(t))), '\s+'), lambda x: x <> ''))",
       lambda: F.size(X.words(X.scoring_text(F.col("t"), "tone_stripped"))), "tokens")
_FOREIGN = "(t || repeat('ж', (doc_id % 90)::INT))"
simple("non_latin_ratio", rf"CASE WHEN length({_FOREIGN}) = 0 THEN 0.0 ELSE round(length(regexp_replace({_FOREIGN}, "
       rf"'[^\p{{L}}]|[\x{{0}}-\x{{24F}}]', '', 'g'))::DOUBLE / length({_FOREIGN}), 9) END",
       lambda: F.round(X.non_latin_ratio(F.concat("t", F.repeat(F.lit("ж"), (F.col("doc_id") % 90).cast("int")))), 9), "ratio")
simple("normalize_keep_marks", r"""trim(regexp_replace(regexp_replace(nfc_normalize(t), '[^\p{L}\p{N}_\p{M}\s''\-]', ' ', 'g'), '\s+', ' ', 'g'))""",
       lambda: X.normalize_transcript(F.col("t"), "yo", keep_marks=True), "norm")


@query("speech_rates", rf"""SELECT doc_id, n AS words, round(n / (length(t) / 14.0::DOUBLE), 6) AS wps,
    round(length(t) / greatest(doc_id % 50, 1e-6), 6) AS cps FROM (SELECT *, len(list_filter(regexp_split_to_array(t, '\s+'), lambda x: x <> '')) AS n FROM {_T})""")
def _(spark, sf):
    df = texts(spark, sf)
    n, wps, _ = X.speech_rates(F.col("t"), F.length("t") / 14.0)
    _, _, cps = X.speech_rates(F.col("t"), (F.col("doc_id") % 50).cast("double"))
    return df.select("doc_id", n.alias("words"), on_product(wps, 6).alias("wps"), on_product(cps, 6).alias("cps"))


@query("path_parts", r"""SELECT page_id, regexp_extract(url, '([^/]*)/*$', 1) AS base,
    regexp_replace(regexp_extract(url, '([^/]*)/*$', 1), '(.)\.[^.]+$', '\1') AS stem,
    string_split(url, '/')[-2] AS parent, regexp_replace(url, '([^/])\.[^./]+$', '\1') || '.flac' AS audio FROM pages""")
def _(spark, sf):
    u = F.col("url")
    return V.table(spark, sf, "pages").select(
        "page_id", X.basename(u).alias("base"), X.stem(u).alias("stem"), X.parent_name(u).alias("parent"),
        X.with_suffix(u, ".flac").alias("audio"))


@query("speaker_from_file", r"""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'spk' || (doc_id % 9) || '_x' ELSE doc_id::VARCHAR END AS speaker_id FROM documents""")
def _(spark, sf):
    k = F.col("doc_id")
    path = F.when(k % 2 == 0, F.concat(F.lit("a/b_c/"), k.cast("string"), F.lit("_spk"), (k % 9).cast("string"), F.lit("_x.wav"))).otherwise(
        F.concat(F.lit("a/b_c/"), k.cast("string"), F.lit(".wav")))
    return V.table(spark, sf, "documents").select("doc_id", X.speaker_from_file(path).alias("speaker_id"))


@query("media_paths", """SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '/abs/' || doc_id ELSE '/root/media/' || source || '/' || doc_id END AS audio_path FROM documents""")
def _(spark, sf):
    from kalangu.operators.arrays import absolute_paths

    k = F.col("doc_id").cast("string")
    path = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("/abs/"), k)).otherwise(F.concat("source", F.lit("/"), k))
    return absolute_paths(V.table(spark, sf, "documents").select("doc_id", path.alias("audio_path")), "/root/media/")


@query("character_inventory", r"""SELECT c AS char, count(*) AS n, c IN ('ä', 'ö', 'ü', 'ß', 'é') AS in_inventory FROM
    (SELECT unnest(string_split(regexp_replace(text, '[\x{0}-\x{7F}]|[^\p{L}]', '', 'g'), '')) AS c FROM documents) WHERE c <> '' GROUP BY ALL""")
def _(spark, sf):
    return R.character_inventory(spread(V.table(spark, sf, "documents")), known=["ä", "ö", "ü", "ß", "é"])


@query("alphabet_coverage", r"""SELECT count(*) AS letters, count(*) FILTER (WHERE c IN ('ɓ','ɗ','ƙ','ƴ','ẹ','Ẹ','ọ','Ọ','ṣ','Ṣ','ị','Ị','ụ','Ụ')) AS covered,
    23 AS inventory FROM (SELECT unnest(string_split(regexp_replace(text || CASE WHEN doc_id % 5 = 0 THEN 'ƙọ' ELSE '' END, '[\x{0}-\x{7F}]|[^\p{L}]', '', 'g'), '')) AS c FROM documents) WHERE c <> ''""")
def _(spark, sf):
    t = F.concat("text", F.when(F.col("doc_id") % 5 == 0, F.lit("ƙọ")).otherwise(F.lit("")))
    c = R.character_inventory(spread(V.table(spark, sf, "documents").select(t.alias("text"))))
    return c.agg(F.sum("n").alias("letters"), F.sum(F.when(F.col("in_inventory"), F.col("n")).otherwise(0)).alias("covered"),
                 F.lit(len(X.inventory())).alias("inventory"))


@query("top_words", r"""SELECT w AS word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents)
    WHERE length(w) > 2 AND w NOT IN ('the','and','was','were','been','being','have','has','had','does','did','will','would','could','should','may','might','for','with',
    'from','its','she','they','this','that','these','those','his','her','their','our','but','not','are','also') GROUP BY 1 ORDER BY n DESC, 1 LIMIT 30""")
def _(spark, sf):
    return R.word_frequencies(spread(V.table(spark, sf, "documents")))
