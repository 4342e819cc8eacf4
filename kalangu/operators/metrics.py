"""Corpus statistics and error-rate reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kalangu import constants as C
from kalangu.functions import edits as E
from kalangu.functions import scoring as M
from kalangu.functions import text as X
from kalangu.operators.scale import floor_percentiles


def manifest_stats(manifest: DataFrame) -> DataFrame:
    """One row: total_rows, total_hours, languages (map to hours), cs_count, mean and max duration.

    Summed per language first, so the last step sees one row per language.
    """
    per = manifest.groupBy("language").agg(
        F.count("*").alias("n"), F.sum("duration").alias("secs"),
        F.count_if(F.coalesce(F.col("is_code_switched"), F.lit(False))).alias("cs"),
        F.max("duration").alias("longest"))
    zero = F.lit(0.0)
    return per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"),
        (F.coalesce(F.sum("secs"), zero) / 3600.0).alias("total_hours"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct(
            "language", (F.col("secs") / 3600.0).alias("hours"))))).alias("languages"),
        F.coalesce(F.sum("cs"), F.lit(0)).alias("cs_count"),
        F.coalesce(F.try_divide(F.sum("secs"), F.sum("n")), zero).alias("mean_duration"),
        F.coalesce(F.max("longest"), zero).alias("max_duration"))


def histogram(df: DataFrame, column: str, k: int | None = None, missing: str = "unknown") -> DataFrame:
    """Counts per value, largest first; ``k`` keeps the top of the report."""
    value = F.coalesce(F.when(F.col(column).cast("string") != "", F.col(column).cast("string")), F.lit(missing))
    out = df.groupBy(value.alias(column)).agg(F.count("*").alias("n"))
    return out.orderBy(F.desc("n"), column).limit(k) if k else out


def word_error_report(pairs: DataFrame, by: list[str] = (), mode: str = "tone_sensitive",
                      ref: str = "ref", hyp: str = "hyp") -> DataFrame:
    """Micro-averaged WER and CER with alignment counts, overall or per group.

    Zeros for an empty input. Per-clip counts are summed with partial
    aggregation, so one language holding most clips is no bottleneck.
    """
    texts = pairs.select(*by, X.normalize_text(F.col(ref), once=True).alias("_r"),
                         X.normalize_text(F.coalesce(F.col(hyp), F.lit("")), once=True).alias("_h"))
    # in a step of their own: what folds a text mentions it several times
    texts = texts.withColumns({c: X.folded(F.col(c), mode) for c in ("_r", "_h")})
    scored = M.with_alignment(texts, X.words(F.col("_r")), X.words(F.col("_h")), "_a").select(
        *by, "_a", E.errors(F.col("_r"), F.col("_h")).alias("_ce"), F.length("_r").alias("_cn"))
    names = ["hits", "substitutions", "deletions", "insertions"]
    total = {n: F.coalesce(F.sum(F.col("_a")[n]), F.lit(0)) for n in names}
    sums = scored.groupBy(*by).agg(
        *[total[n].alias(n) for n in names],
        F.coalesce(F.sum("_ce"), F.lit(0)).alias("_ce"), F.coalesce(F.sum("_cn"), F.lit(0)).alias("_cn"))
    n_ref = F.col("hits") + F.col("substitutions") + F.col("deletions")
    errors = F.col("substitutions") + F.col("deletions") + F.col("insertions")
    return sums.select(
        *by, _ratio(errors, n_ref).alias("wer"), _ratio(F.col("_ce"), F.col("_cn")).alias("cer"),
        *names, n_ref.alias("total_ref_words"),
        (F.col("hits") + F.col("substitutions") + F.col("insertions")).alias("total_hyp_words"))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def error_rates(pairs: DataFrame, by: list[str] = (), ref: str = "ref", hyp: str = "hyp") -> DataFrame:
    """Micro WER and CER without the split into kinds."""
    # every text is split into words once
    split = pairs.select(*by, F.col(ref).alias("_r"), F.coalesce(F.col(hyp), F.lit("")).alias("_h")).withColumns(
        {"_rw": X.words(F.col("_r")), "_hw": X.words(F.col("_h"))})
    scored = split.select(
        *by, M.word_distance(F.col("_rw"), F.col("_hw")).alias("we"), F.coalesce(F.size("_rw"), F.lit(0)).alias("wn"),
        E.errors(F.col("_r"), F.col("_h")).alias("ce"), F.length("_r").alias("cn"))
    return scored.groupBy(*by).agg(
        F.count("*").alias("n"), F.sum("we").alias("word_errors"), F.sum("wn").alias("ref_words"),
        F.sum("ce").alias("char_errors"), F.sum("cn").alias("ref_chars")).withColumns({
            "wer": _ratio(F.col("word_errors"), F.col("ref_words")),
            "cer": _ratio(F.col("char_errors"), F.col("ref_chars"))})


def code_switched_languages(pairs: DataFrame, ref: str = "ref_tagged", hyp: str = "hyp_tagged") -> DataFrame:
    """Per reference language: words, tag_errors and their ratio."""
    per = M.with_tag_errors(pairs, ref, hyp).select(F.explode("tags").alias("e")).select("e.*")
    return per.groupBy("language").agg(
        F.sum("words").alias("words"), F.sum("tag_errors").alias("tag_errors")).withColumn(
        "wer", F.col("tag_errors") / F.col("words"))


def code_switched_wer(pairs: DataFrame, ref: str = "ref_tagged", hyp: str = "hyp_tagged") -> DataFrame:
    """One row: cs_wer, token_wer, tag_accuracy, per_language_wer, total_ref_words.

    A wrong word counts as a token error and as a tag error, by definition of
    the measure. Empty input gives 0, 0, 1. Each pair is aligned once. Token
    errors and the number of words are those of the utterance normalised as a
    whole, as for the plain error rate.
    """
    def utterance(col: str) -> Column:
        return X.scoring_text(F.array_join(F.transform(F.col(col), lambda w: w["word"]), " "), "tone_sensitive", once=True)

    texts = M.with_tag_errors(pairs, ref, hyp).withColumns({"_r": utterance(ref), "_h": utterance(hyp)})
    split = texts.select(X.words(F.col("_r")).alias("_rw"), X.words(F.coalesce("_h", F.lit(""))).alias("_hw"), "tags")
    scored = split.select(M.word_distance(F.col("_rw"), F.col("_hw")).alias("errors"), F.size("_rw").alias("n"), "tags")
    # one row per pair and language; the pair's own figures ride on the first
    per = scored.select("errors", "n", F.posexplode_outer("tags")).groupBy(F.col("col.language").alias("language")).agg(
        F.sum(F.when(F.coalesce("pos", F.lit(0)) == 0, F.col("errors"))).alias("errors"),
        F.sum(F.when(F.coalesce("pos", F.lit(0)) == 0, F.col("n"))).alias("n"),
        F.sum("col.words").alias("words"), F.sum("col.tag_errors").alias("tag_errors"))
    total = per.agg(
        F.coalesce(F.sum("errors"), F.lit(0)).alias("token_errors"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_ref_words"),
        F.coalesce(F.sum("tag_errors"), F.lit(0)).alias("tag_errors"),
        F.coalesce(F.sum("words"), F.lit(0)).alias("tagged"),
        F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("language").isNotNull(), F.struct(
            "language", (F.col("tag_errors") / F.col("words")).alias("wer")))))).alias("per_language_wer"))
    n = F.col("total_ref_words")
    return total.select(
        F.least(_ratio(F.col("token_errors") + F.col("tag_errors"), n), F.lit(1.0)).alias("cs_wer"),
        _ratio(F.col("token_errors"), n).alias("token_wer"),
        F.when(F.col("tagged") > 0, 1.0 - F.col("tag_errors") / F.col("tagged")).otherwise(1.0).alias("tag_accuracy"),
        "per_language_wer", n)


def per_clip_scores(clips: DataFrame, ref: str = "ref", hyp: str = "hyp") -> DataFrame:
    """Adds wer (4 places, null for an empty reference) and is_garbage."""
    h = F.coalesce(F.col(hyp), F.lit(""))
    split = clips.withColumns({"_rw": X.words(F.col(ref)), "_hw": X.words(h)})
    return split.withColumns({
        "wer": F.round(M.words_wer(F.col("_rw"), F.col("_hw")), 4),
        "is_garbage": M.is_garbage(h, F.col(ref), counts=(F.size("_rw"), F.size("_hw")))}).drop("_rw", "_hw")


def duration_tiers(duration: Column, min_duration: float = 0.0) -> Column:
    """array<string> of the overlapping tiers of a clip."""
    tiers = [F.lit("all"), F.when(duration < 3.0, "short_lt_3s")]
    if min_duration < 3.0:
        tiers.append(F.when(duration >= 3.0, "ge_3s"))
    tiers.append(F.when(duration >= 5.0, "ge_5s"))
    return F.array_compact(F.array(*tiers))


def tier_stats(clips: DataFrame, wer: str = "wer", hyp: str = "hyp", min_duration: float = 0.0) -> DataFrame:
    """Statistics per duration tier over clips with a score.

    Percentiles are order statistics at floor(n * p); the median averages the
    middle two.
    """
    tiered = clips.filter(F.col(wer).isNotNull()).select(
        F.explode(duration_tiers(F.coalesce(F.col("duration"), F.lit(0.0)), min_duration)).alias("tier"),
        F.col(wer).alias("w"), (X.strip(F.col(hyp)) == "").alias("blank"), "is_garbage")
    n = F.col("n")
    stats = floor_percentiles(tiered, ["tier"], "w", {
        "p25": _at(n, 0.25), "p75": _at(n, 0.75), "p95": _at(n, 0.95),
        "mid_lo": F.floor((n - 1) / 2), "mid_hi": F.floor(n / 2)},
        {"empty_hyps": F.col("blank"), "garbage_hyps": F.col("is_garbage"), "wer_over_100pct": F.col("w") > 1.0})
    return stats.select(
        "tier", "n", F.round("mean", 4).alias("mean_wer"),
        F.round((F.col("mid_lo") + F.col("mid_hi")) / 2, 4).alias("median_wer"),
        F.round("p25", 4).alias("p25_wer"), F.round("p75", 4).alias("p75_wer"),
        F.round("p95", 4).alias("p95_wer"), "empty_hyps", "garbage_hyps", "wer_over_100pct")


def _at(n: Column, p: float) -> Column:
    return F.floor(n * F.lit(p))


def distribution_stats(df: DataFrame, value: str, by: list[str] = ()) -> DataFrame:
    """n, mean, floor-index median and percentiles, min, max (1 place)."""
    n = F.col("n")
    stats = floor_percentiles(df, list(by), value, {
        "median": F.floor(n / 2), "p25": F.floor(n / 4), "p75": F.floor(n * 3 / 4), "p95": _at(n, 0.95)})
    return stats.select(*by, "n", *[F.round(c, 1).alias(c) for c in
                                    ("mean", "median", "p25", "p75", "p95", "min", "max")])


def word_frequencies(df: DataFrame, text: str = "text", stopwords=C.STOPWORDS, k: int | None = 30) -> DataFrame:
    """Most frequent a-z words longer than two letters that are not stopwords."""
    w = df.select(F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit("[a-z]+"), F.lit(0))).alias("word"))
    w = w.filter((F.length("word") > 2) & ~F.col("word").isin(*stopwords))
    out = w.groupBy("word").agg(F.count("*").alias("n"))
    return out.orderBy(F.desc("n"), "word").limit(k) if k else out


def text_stats(df: DataFrame, text: str = "text", by: list[str] = ()) -> DataFrame:
    """Words per text: mean (1 place) and floor-index median, p75, p95."""
    counted = df.select(*by, X.word_count(F.col(text)).alias("w"))
    n = F.col("n")
    stats = floor_percentiles(counted, list(by), "w", {
        "median": F.floor(n / 2), "p75": F.floor(n * 3 / 4), "p95": _at(n, 0.95)})
    return stats.select(*by, "n", F.round("mean", 1).alias("mean"), "median", "p75", "p95")


def split_mismatch(df: DataFrame, split: str = "split", short: float = 3.0) -> DataFrame:
    """Per split: clips, mean duration, number and percent of short clips (1 place)."""
    brief = F.col("duration") < short
    return df.groupBy(split).agg(
        F.count("*").alias("n"), F.round(F.avg("duration"), 1).alias("mean_duration"),
        F.count_if(brief).alias("short"),
        F.round(F.count_if(brief) * 100.0 / F.count("*"), 1).alias("short_pct"))


def token_accuracy(df: DataFrame, pred: str = "pred_ids", label: str = "label_ids", ignore: int = -100) -> DataFrame:
    """Share of right next tokens, predictions shifted against labels; 0.0 if none count."""
    n = F.size(label)
    # prediction i stands against label i + 1
    pairs = F.zip_with(F.slice(pred, F.lit(1), F.greatest(n - 1, F.lit(0))),
                       F.slice(label, F.lit(2), F.greatest(n - 1, F.lit(0))),
                       lambda p, t: F.struct(p.alias("p"), t.alias("t")))
    counted = F.filter(pairs, lambda x: x["t"] != ignore)
    right = F.filter(counted, lambda x: x["t"] == x["p"])
    s = df.agg(F.coalesce(F.sum(F.size(counted)), F.lit(0)).alias("tokens"),
               F.coalesce(F.sum(F.size(right)), F.lit(0)).alias("correct"))
    return s.withColumn("accuracy", _ratio(F.col("correct"), F.col("tokens")))


def dev_score(pairs: DataFrame, ref: str = "ref", hyp: str = "hyp") -> DataFrame:
    """Micro WER of basically normalised texts: n, skipped empty references, wer."""
    texts = pairs.select(X.normalize_basic(F.col(ref)).alias("ref"),
                         X.normalize_basic(F.coalesce(F.col(hyp), F.lit(""))).alias("hyp"))
    words = texts.select(X.words(F.col("ref")).alias("r"), X.words(F.col("hyp")).alias("h"))
    usable = F.size("r") > 0
    s = words.agg(F.count_if(usable).alias("scored"), F.count_if(~usable).alias("skipped"),
                  F.sum(F.when(usable, M.word_distance(F.col("r"), F.col("h")))).alias("e"), F.sum(F.size("r")).alias("n"))
    return s.select("scored", "skipped", _ratio(F.col("e"), F.col("n")).alias("wer"))


def mean_loss(df: DataFrame, loss: str = "loss") -> DataFrame:
    return df.agg(F.coalesce(F.avg(loss), F.lit(0.0)).alias("mean_loss"))


def skipped_references(pairs: DataFrame, ref: str = "ref") -> DataFrame:
    """Scored and skipped clips by a blank reference."""
    blank = X.strip(F.coalesce(F.col(ref), F.lit(""))) == ""
    return pairs.agg(F.count_if(~blank).alias("scored"), F.count_if(blank).alias("skipped"))


def character_inventory(df: DataFrame, text: str = "text", known: list[str] | None = None) -> DataFrame:
    """Counts of non-ASCII letters and of the inventory's bigrams, each flagged in or out of the inventory.

    Bigrams are looked for in lower case and may overlap.
    """
    known = X.inventory() if known is None else known
    pairs = sorted({k for k in known if len(k) == 2})
    letters = df.select(F.explode(F.split(F.regexp_replace(
        X.nfc(F.col(text)), r"[\x{0}-\x{7F}]|[^\p{L}]", ""), "")).alias("char")).filter("char <> ''")
    if pairs:
        # the pattern looks ahead for the second letter, so a letter may belong to two bigrams
        low = F.lower(X.nfc(F.col(text)))
        found = [F.array_repeat(F.lit(p), F.regexp_count(low, F.lit(f"{p[0]}(?={p[1]})"))) for p in pairs]
        letters = letters.union(df.select(F.explode(F.flatten(F.array(*found))).alias("char")))
    return letters.groupBy("char").agg(F.count("*").alias("n")).withColumn(
        "in_inventory", F.col("char").isin(*known))

