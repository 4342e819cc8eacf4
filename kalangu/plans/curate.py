"""The curation run: three passes, guardrails, manifest, rejects, report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kalangu import constants as C
from kalangu.operators import filters as P
from kalangu.operators.scale import key_filter
from kalangu.session import fresh_path
from kalangu.sources import manifests as MF
from kalangu.sources import sinks

LEVELS = ("metadata", "audio", "full")


def curate(rows: DataFrame, key: str, level: str = "full", audio: DataFrame | None = None,
           preprocessed: DataFrame | None = None, transcripts: DataFrame | None = None,
           limits: P.MetadataLimits = P.MetadataLimits(), audio_limits: P.AudioLimits = P.AudioLimits(),
           cap: int = 200, seed: int = 42, max_cer: float = 0.40, guardrails: dict | None = None,
           stages: str | None = None, audio_version: str | None = None) -> DataFrame:
    """All rows with one result struct per pass that was asked for.

    A clip has a null result in the passes it did not reach, and a result in
    every one that it did: without media it is rejected as ``corrupt_audio``,
    without a preprocessing row as ``preprocess_failed``, without a hypothesis
    as ``asr_error``. So the totals of a pass are the kept rows of the one
    before.

    ``audio`` has key, samples, sample_rate; ``preprocessed`` key and ok;
    ``transcripts`` key, hypothesis and detected_language, each with one row
    per key. Samples are measured where they are scanned, and only those of
    clips that the passes before kept (a filter of their keys is applied to the
    scan): only the key and the result of a clip travel.

    Between passes results are tables, below ``stages`` if it is given: a later
    run on the same rows with the same limits starts from them. Samples are not
    read for that: give another ``audio_version`` when those of a key change.
    With ``guardrails`` (pass: fail and warn share) a pass that rejected too
    much, preprocessing included, raises before the next one starts.
    """
    if level not in LEVELS:
        raise ValueError(f"level must be one of {LEVELS}, got {level!r}")
    below = stages or fresh_path(rows.sparkSession, "stages")

    def stored(df: DataFrame, name: str, compute, *params: object, known: DataFrame | None = None) -> DataFrame:
        if stages is None:
            path = f"{below}/{name}"
            compute(df).write.parquet(path)
            return df.sparkSession.read.parquet(path)
        return sinks.stage(df, f"{below}/{name}", compute, params, known=known)

    def checked(df: DataFrame, passes: list[str]) -> DataFrame:
        if guardrails is not None:
            P.require_guardrails(P.pass_totals(df, passes), guardrails)
        return df

    passes = ["pass1"]
    out = stored(rows, "pass1", lambda df: P.cap_per_speaker(P.metadata_pass(df, limits), key, cap=cap, seed=seed), limits, cap, seed)
    out = checked(out, passes)
    if level == "metadata":
        return out
    if preprocessed is not None:
        ok = preprocessed.select(key, F.struct(
            F.col("ok").alias("keep"), F.when(F.col("ok"), "pass").otherwise("preprocess_failed").alias("reason"),
            F.struct(F.lit(None).cast("string").alias("error")).alias("details")).alias("preprocess"))
        out = _reached(out, ok, key, passes, "preprocess", "preprocess_failed")
        passes = [*passes, "preprocess"]
        out = checked(out, passes)
    wanted = kept_rows(out, passes).select(key)

    def measure(df: DataFrame) -> DataFrame:
        return P.audio_pass(df.filter(key_filter(wanted, key)(F.col(key))), audio_limits).select(key, "pass2")

    measured = stored(audio, "pass2", measure, audio_limits, audio_version, known=wanted)
    out = _reached(out, measured, key, passes, "pass2", "corrupt_audio")
    passes = [*passes, "pass2"]
    out = checked(out, passes)
    if level == "audio":
        return out
    # pass 3 in place: a clip that does not reach it shows the scoring neither text
    texts = out.join(transcripts.select(key, F.col("hypothesis").alias("_hyp"), F.col("detected_language").alias("_lang")), key, "left")
    reached = _kept(passes)
    texts = texts.withColumns({"_ref": F.when(reached, F.col("transcript")), "_hyp": F.when(reached, F.col("_hyp"))})

    def score(df: DataFrame) -> DataFrame:
        scored = P.transcript_pass(df, ref="_ref", hyp="_hyp", detected="_lang", max_cer=max_cer)
        return scored.withColumn("pass3", F.when(reached, F.col("pass3"))).drop("_ref", "_hyp", "_lang")

    return checked(stored(texts, "pass3", score, max_cer), [*passes, "pass3"])


def _kept(passes: list[str]):
    ok = F.lit(True)
    for p in passes:
        ok = ok & F.coalesce(F.col(p)["keep"], F.lit(False))
    return ok


def _reached(rows: DataFrame, results: DataFrame, key: str, before: list[str], name: str, missing: str) -> DataFrame:
    """``rows`` with the result ``name`` where the passes before kept them; without one they are rejected as ``missing``."""
    details = results.schema[name].dataType["details"].dataType
    lost = F.struct(F.lit(False).alias("keep"), F.lit(missing).alias("reason"), F.lit(None).cast(details).alias("details"))
    joined = rows.join(results, key, "left")
    return joined.withColumn(name, F.when(_kept(before), F.coalesce(F.col(name), lost)))


def kept_rows(curated: DataFrame, passes: list[str]) -> DataFrame:
    return curated.filter(_kept(passes))


def build_manifest(curated: DataFrame, passes: list[str], path: str, mode: str = "overwrite", fmt: str = "json") -> DataFrame:
    """Write the manifest of the kept rows: first by path, then valid, then written.

    Of rows with one audio path the first in the order of their other fields
    stays; rows that are not valid are left out. Returns what was written.
    """
    rows = P.to_manifest(kept_rows(curated, passes))
    rows = P.valid_rows(P.keep_first_path(rows, [F.struct(*[c for c in rows.columns if c != "cs_spans"])]))
    MF.write_manifest(rows, path, mode, fmt)
    return MF.iter_manifest(curated.sparkSession, path) if fmt == "json" else curated.sparkSession.read.format(fmt).load(path)


def run(rows: DataFrame, key: str, path: str, level: str = "full", guardrails: dict = C.GUARDRAILS, **given) -> DataFrame:
    """Curate, guard every pass, and write manifest, rejects and report below ``path``.

    Raises before anything is written if a pass rejected too much; the stages
    below ``path`` stay, so the next run resumes from them.
    """
    out = curate(rows, key, level, guardrails=guardrails, stages=f"{path}/stages", **given)
    passes = [p for p in ("pass1", "preprocess", "pass2", "pass3") if p in out.columns]
    totals = P.pass_totals(out, passes)
    sinks.write_rejects(out, key, passes, f"{path}/rejects")
    sinks.write_filter_report(totals, level, f"{path}/report")
    build_manifest(out, passes, f"{path}/manifest")
    return totals
