"""The three filter passes, the speaker cap, pass totals and guardrails.

A pass adds one struct column <keep, reason, details>; rows are never lost
between passes, so rejects and reports are projections of the same table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kalangu import constants as C
from kalangu.functions import audio as A
from kalangu.functions import scoring as M
from kalangu.functions import text as X
from kalangu.functions.hashing import seeded_hash
from kalangu.functions.rounding import two_places
from kalangu.operators.scale import first_per_key, top_per_key


@dataclass(frozen=True)
class MetadataLimits:
    min_duration: float = 1.0
    max_duration: float = 30.0
    min_chars: int = 3
    min_words_per_sec: float = 0.5
    max_words_per_sec: float = 6.0
    max_chars_per_sec: float = 30.0
    keywords: tuple = C.CLINICAL_KEYWORDS
    accents: tuple = C.ACCENT_ALLOW_LIST


@dataclass(frozen=True)
class AudioLimits:
    min_samples: int = 1000
    min_rms_dbfs: float = -45.0
    max_clip_frac: float = 0.02
    min_snr_db: float = 10.0
    max_silence_frac: float = 0.70
    frame_ms: float = 25.0


def _result(keep, reason: Column, **details: Column) -> Column:
    keep = F.lit(keep) if isinstance(keep, bool) else keep
    return F.struct(keep.alias("keep"), reason.alias("reason"),
                    F.struct(*[v.alias(k) for k, v in details.items()]).alias("details"))


def _first_failure(rules: list[tuple[str, Column]]) -> Column:
    out = None
    for name, cond in rules:
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out.otherwise("pass")


def metadata_pass(df: DataFrame, limits: MetadataLimits = MetadataLimits(), out: str = "pass1",
                  duration: str = "duration", transcript: str = "transcript",
                  accent: str = "accent") -> DataFrame:
    """Pass 1: the first failing rule on duration, transcript and speech rate.

    Detail fields that the deciding rule does not report are null. Shared
    figures are columns of their own, so each is computed once per row.
    """
    df = df.withColumns({"_secs": F.coalesce(F.col(duration), F.lit(0.0)),
                         "_text": X.strip(F.coalesce(F.col(transcript), F.lit("")))})
    df = df.withColumn("_words", X.word_count(F.col("_text")))
    secs, text = F.col("_secs"), F.col("_text")
    floor = F.greatest(secs, F.lit(1e-6))
    word_rate, char_rate = F.col("_words") / floor, F.length(text) / floor
    df = df.withColumn("_reason", _first_failure([
        ("too_short", secs < limits.min_duration),
        ("too_long", secs > limits.max_duration),
        ("empty_transcript", F.length(text) < limits.min_chars),
        ("impossible_speech_rate", (word_rate < limits.min_words_per_sec)
         | (word_rate > limits.max_words_per_sec)),
        ("transcript_too_long", char_rate > limits.max_chars_per_sec),
    ]))
    reason = F.col("_reason")

    def shown(value: Column, *reasons: str) -> Column:
        return F.when(reason.isin(*reasons), value)

    label = F.lower(X.strip(F.coalesce(F.col(accent), F.lit(""))))
    result = _result(
        reason == "pass", reason,
        duration=shown(secs, "pass", "too_short", "too_long", "impossible_speech_rate"),
        chars=shown(F.length(text), "empty_transcript"),
        words=shown(F.col("_words"), "pass"),
        words_per_sec=shown(F.round(word_rate, 3), "pass", "impossible_speech_rate"),
        chars_per_sec=shown(F.round(char_rate, 3), "transcript_too_long"),
        domain=shown(X.infer_domain(text, limits.keywords), "pass"),
        accent=shown(label, "pass"),
        accent_listed=shown(X.accent_listed(F.col(accent), limits.accents), "pass"),
        speaker_id=F.lit(None).cast("string"), kept=F.lit(None).cast("int"))
    return df.withColumn(out, result).drop("_secs", "_text", "_words", "_reason")


def cap_per_speaker(df: DataFrame, key: str, speaker: str = "speaker_id", cap: int = 200,
                    seed: int = 42, result: str = "pass1") -> DataFrame:
    """At most ``cap`` kept rows per speaker, chosen in seeded hash order.

    The others get reason 'speaker_cap'. A missing speaker counts as one
    speaker. Only the cap-th hash of a speaker is computed (salted first, so a
    speaker with a third of all rows spreads over tasks) and every row compares
    its own hash with it.
    """
    df = (df.withColumn("_spk", F.coalesce(F.col(speaker), F.lit("")))
          .withColumn("_h", seeded_hash(F.col(key), seed)))
    kept = df.filter(F.col(result)["keep"]).select("_spk", "_h", F.col(key).alias("_k"))
    first = top_per_key(kept, ["_spk"], [F.col("_h"), F.col("_k")], cap, salt=F.col("_k"))
    last = (first.groupBy("_spk")
            .agg(F.max(F.struct("_h", "_k")).alias("_last"), F.count("*").alias("_n"))
            .filter(F.col("_n") == cap).drop("_n"))
    joined = df.join(last, "_spk", "left")
    over = (F.col(result)["keep"] & F.col("_last").isNotNull()
            & (F.struct(F.col("_h"), F.col(key).alias("_k")) > F.col("_last")))
    known = {"speaker_id": F.col("_spk"), "kept": F.lit(cap)}
    capped = F.struct(
        F.lit(False).alias("keep"), F.lit("speaker_cap").alias("reason"),
        F.struct(*[known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
                   for f in df.schema[result].dataType["details"].dataType]).alias("details"))
    return (joined.withColumn(result, F.when(over, capped).otherwise(F.col(result)))
            .drop("_spk", "_h", "_last"))


def audio_pass(df: DataFrame, limits: AudioLimits = AudioLimits(), out: str = "pass2",
               samples: str = "samples", sample_rate: str = "sample_rate") -> DataFrame:
    """Pass 2: the first failing rule on level, clipping, SNR and silence.

    The measures are taken in one vectorised pass over the samples of a clip.
    """
    # not deterministic in name only: one call per clip, whatever is used of it
    df = df.withColumn("_m", A.quality_measures.asNondeterministic()(
        F.col(samples), A.frame_size(F.col(sample_rate), limits.frame_ms)))
    m, rate = F.col("_m"), F.col(sample_rate)
    n = F.coalesce(m["n_samples"], F.lit(0))
    df = df.withColumns({
        "_n": n, "_rms": A.dbfs(m["rms"]), "_peak": A.dbfs(m["peak"]),
        "_snr": F.when(m["n_frames"] > 1, 20.0 * F.log10(
            F.greatest(m["frame_max"], F.lit(1e-9)) / (m["frame_min"] + 1e-9))).otherwise(0.0)})
    n, snr = F.col("_n"), F.col("_snr")
    df = df.withColumn("_reason", _first_failure([
        ("corrupt_audio", n == 0),
        ("too_few_samples", n < limits.min_samples),
        ("silent", F.col("_rms") < limits.min_rms_dbfs),
        ("clipped", m["clip_frac"] > limits.max_clip_frac),
        ("low_snr", snr < limits.min_snr_db),
        ("mostly_silence", m["silence_frac"] > limits.max_silence_frac),
    ]))
    reason = F.col("_reason")
    levels = ["silent", "clipped", "low_snr", "mostly_silence", "pass"]

    def known_from(first: str, value: Column) -> Column:
        return F.when(reason.isin(*levels[levels.index(first):]), value)

    result = _result(
        reason == "pass", reason,
        sample_rate=F.when(n > 0, rate),
        duration_sec=F.when(n > 0, F.round(n / F.greatest(rate, F.lit(1)), 4)),
        n_samples=F.when(reason == "too_few_samples", n),
        rms_db=known_from("silent", F.round("_rms", 3)),
        peak_db=known_from("silent", F.round("_peak", 3)),
        clip_frac=known_from("clipped", F.round(m["clip_frac"], 6)),
        snr_db=known_from("low_snr", F.round(snr, 3)),
        silence_frac=known_from("mostly_silence", F.round(m["silence_frac"], 4)))
    return df.withColumn(out, result).drop("_m", "_n", "_rms", "_peak", "_snr", "_reason")


def transcript_pass(df: DataFrame, out: str = "pass3", ref: str = "transcript", hyp: str = "hypothesis",
                    detected: str = "detected_language", max_cer: float = 0.40, language: str = "en",
                    flag_language: bool = True, shown_chars: int | None = None) -> DataFrame:
    """Pass 3: character error rate of a given hypothesis against the transcript.

    A null hypothesis is 'asr_error'. A clip in another language than expected
    is flagged as code-switched, not rejected; ``flag_language=False`` is the
    batch form without that part. The hypothesis is scored and stored whole;
    ``shown_chars`` cuts the stored one for display.
    """
    df = df.withColumns({"_r": X.normalize_transcript(F.col(ref), language),
                         "_h": X.normalize_transcript(F.col(hyp), language)})
    df = df.withColumn("_cer", M.clip_cer(F.col("_r"), F.col("_h")))
    scored = F.col(hyp).isNotNull()
    df = df.withColumn("_reason", F.when(~scored, "asr_error")
                       .when(F.col("_cer") > max_cer, F.concat(
                           F.lit("transcript_mismatch_cer_"), two_places(F.col("_cer"))))
                       .otherwise("pass"))
    reason, lang = F.col("_reason"), F.coalesce(F.col(detected), F.lit(language))
    result = _result(
        reason == "pass", reason,
        cer=F.when(scored, F.round("_cer", 4)),
        hypothesis=F.col(hyp) if shown_chars is None else F.substring(F.col(hyp), 1, shown_chars),
        detected_language=F.when(scored, lang) if flag_language else F.lit(None).cast("string"),
        is_code_switched=(F.when((reason == "pass") & (lang != language), True)
                          if flag_language else F.lit(None).cast("boolean")),
        error=F.when(~scored, "no hypothesis"))
    return df.withColumn(out, result).drop("_r", "_h", "_cer", "_reason")


def merge_results(rows: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """Attach pass results to their clips by key (never by position)."""
    return rows.join(results, key, "left")


# --- reports -------------------------------------------------------------------

def _reached(passes: list[str], i: int) -> Column:
    ok = F.lit(True)
    for p in passes[:i]:
        ok = ok & F.col(p)["keep"]
    return ok & F.col(passes[i]).isNotNull()


def rejects(df: DataFrame, key: str, passes: list[str]) -> DataFrame:
    """One row per rejected clip and pass: pass, key, reason, details as JSON.

    A clip appears under the first pass that rejects it. One scan, whatever
    the number of passes.
    """
    tagged = F.array_compact(F.array(*[
        F.when(_reached(passes, i) & ~F.col(p)["keep"], F.struct(
            F.lit(p).alias("pass"), F.col(p)["reason"].alias("reason"),
            F.to_json(F.col(p)["details"]).alias("details")))
        for i, p in enumerate(passes)]))
    return df.select(key, F.explode(tagged).alias("r")).select("r.pass", key, "r.reason", "r.details")


def pass_totals(df: DataFrame, passes: list[str]) -> DataFrame:
    """pass, total, kept, reject_pct for every pass, in one aggregate."""
    aggs = []
    for i, p in enumerate(passes):
        aggs += [F.count_if(_reached(passes, i)).alias(f"t{i}"),
                 F.count_if(_reached(passes, i) & F.col(p)["keep"]).alias(f"k{i}")]
    rows = F.array(*[F.struct(F.lit(p).alias("pass"), F.col(f"t{i}").alias("total"),
                              F.col(f"k{i}").alias("kept")) for i, p in enumerate(passes)])
    return df.agg(*aggs).select(F.inline(rows)).withColumn("reject_pct", reject_percent("total", "kept"))


def reject_percent(total: str, kept: str) -> Column:
    return (F.col(total) - F.col(kept)) / F.greatest(F.col(total), F.lit(1)) * 100


def guardrail_status(totals: DataFrame, limits: dict = C.GUARDRAILS) -> DataFrame:
    """Adds status ok / warn / fail by the reject share of each pass."""
    status = F.lit("ok")
    for name, (fail, warn) in limits.items():
        here = F.when(F.col("reject_pct") > fail, "fail")
        if warn is not None:
            here = here.when(F.col("reject_pct") < warn, "warn")
        status = F.when(F.col("pass") == name, here.otherwise("ok")).otherwise(status)
    return totals.withColumn("status", status)


def require_guardrails(totals: DataFrame, limits: dict = C.GUARDRAILS) -> None:
    """Raise if a pass rejected too much. Reads one row per pass."""
    bad = guardrail_status(totals, limits).filter("status = 'fail'").collect()
    if bad:
        raise RuntimeError("; ".join(f"{r['pass']} rejected {r['reject_pct']:.1f}%" for r in bad))


def filter_report(totals: DataFrame, level: str) -> DataFrame:
    """One row <filter_level, passes: map<pass, struct<total,kept>>>."""
    entry = F.struct("pass", F.struct("total", "kept").alias("v"))
    return totals.agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("passes")).select(
        F.lit(level).alias("filter_level"), "passes")


# --- manifest rows ---------------------------------------------------------------

def manifest_errors(languages=C.SUPPORTED_LANGUAGES) -> Column:
    """array<string> of everything wrong with a manifest row."""
    row = F.array_compact(F.array(
        F.when(F.coalesce(F.col("audio_path"), F.lit("")) == "", "audio_path is empty"),
        F.when(F.coalesce(F.col("duration"), F.lit(0.0)) <= 0, F.concat(
            F.lit("duration must be positive, got "), F.coalesce(F.col("duration"), F.lit(0.0)).cast("string"))),
        F.when(X.strip(F.coalesce(F.col("text"), F.lit(""))) == "", "text is empty"),
        F.when(~F.coalesce(F.col("language"), F.lit("")).isin(*languages), F.concat(
            F.lit("unsupported language: "), F.coalesce(F.col("language"), F.lit(""))))))
    spans = F.flatten(F.transform(F.coalesce(F.col("cs_spans"), F.array()), lambda s: F.array_compact(F.array(
        F.when(~s["language"].isin(*languages), F.concat(F.lit("unsupported span language: "), s["language"])),
        F.when(s["start"] >= s["end"], F.concat_ws(
            " ", F.lit("span start"), s["start"].cast("string"), F.lit("not before end"),
            s["end"].cast("string")))))))
    return F.concat(row, spans)


def valid_rows(manifest: DataFrame, languages=C.SUPPORTED_LANGUAGES) -> DataFrame:
    return manifest.filter(F.size(manifest_errors(languages)) == 0)


def to_manifest(rows: DataFrame, corpus: str = "afrispeech-200") -> DataFrame:
    """Project curated rows to the manifest schema, with its defaults."""
    from kalangu.schema import CS_SPAN

    have = set(rows.columns)

    def text(name: str, default: str = "") -> Column:
        return F.coalesce(F.col(name), F.lit(default)) if name in have else F.lit(default)

    path = F.col("raw_audio_path")
    if "processed_audio_path" in have:
        path = F.coalesce(F.col("processed_audio_path"), path)
    return rows.select(
        path.alias("audio_path"), F.coalesce(F.col("duration"), F.lit(0.0)).alias("duration"),
        X.strip(text("transcript")).alias("text"), text("language", "en").alias("language"),
        text("accent").alias("dialect"), text("speaker_id").alias("speaker_id"),
        text("domain").alias("domain"), F.lit(False).alias("is_code_switched"),
        F.array().cast(f"array<{CS_SPAN.simpleString()}>").alias("cs_spans"),
        F.lit(16000).alias("sample_rate"), text("source_corpus", corpus).alias("corpus"))


def keep_first_path(rows: DataFrame, order: list[Column], path: str = "audio_path") -> DataFrame:
    """One row per audio path, the first in the given order."""
    return first_per_key(rows, [path], order)


def keep_last(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key, the last in the given order."""
    return first_per_key(rows, keys, [F.col(order).desc()])


def duration_between(df: DataFrame, low: float = 0.5, high: float = 30.0) -> DataFrame:
    return df.filter(F.col("duration").between(low, high))


def from_countries(df: DataFrame, countries=C.COUNTRIES) -> DataFrame:
    return df.filter(F.upper(X.strip(F.col("country"))).isin(*countries))


def allowed_sample_rate(df: DataFrame, rates=C.SAMPLE_RATES) -> DataFrame:
    return df.filter(F.col("sample_rate").isin(*rates))


def not_nfc(df: DataFrame, text: str = "text") -> DataFrame:
    return df.filter(~X.is_nfc(F.col(text)))


def nfc_audit(df: DataFrame, text: str = "text") -> DataFrame:
    """Totals checked and not composed."""
    return df.agg(F.count("*").alias("checked"), F.count_if(~X.is_nfc(F.col(text))).alias("bad"))


def within_cer(df: DataFrame, threshold: float = 0.40) -> DataFrame:
    """Drop rows above the threshold; a null score is kept."""
    return df.filter(F.col("cer").isNull() | (F.col("cer") <= threshold))


def scorable(df: DataFrame, ref: str = "ref") -> DataFrame:
    return df.filter(X.strip(F.coalesce(F.col(ref), F.lit(""))) != "")


def thin_steps(df: DataFrame, interval: int | None = None) -> DataFrame:
    """Keep step 1 and every N-th step.

    N is the interval, else a hundredth of ``total_steps`` (1 below 10 steps).
    """
    n = (F.lit(max(1, interval)) if interval is not None else
         F.when(F.col("total_steps") >= 10, F.greatest(F.lit(1), F.floor(F.col("total_steps") / 100)))
         .otherwise(1))
    return df.filter((F.col("step") % n == 0) | (F.col("step") == 1))
