"""Joins between manifests, caches and speaker maps; splits and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kalangu.functions import text as X
from kalangu.functions.hashing import seeded_hash
from kalangu.operators.filters import keep_last
from kalangu.operators.scale import hash_cut


def known_speakers(df: DataFrame, speaker: str = "speaker_id") -> DataFrame:
    """Distinct speakers without empty and 'unknown' ones."""
    return df.select(speaker).filter(
        F.col(speaker).isNotNull() & ~F.col(speaker).isin("", "unknown")).distinct()


def merge_speakers(manifest: DataFrame, speaker_map: DataFrame) -> DataFrame:
    """Speaker attributes by file stem, with ``matched`` to count by.

    ``speaker_map`` has stem, speaker_id, age_group, gender, split_origin, one
    row per stem. Unmatched rows get speaker 'unknown' and keep the rest.
    """
    side = speaker_map.select(F.col("stem").alias("_stem"), F.struct(
        "speaker_id", "age_group", "gender", "split_origin").alias("_s"))
    joined = manifest.withColumn("_stem", X.stem(F.col("audio_path"))).join(side, "_stem", "left")
    hit = F.col("_s").isNotNull()

    def value(name: str, field: str) -> Column:
        old = F.col(name) if name in manifest.columns else F.lit(None).cast("string")
        return F.when(hit, F.coalesce(F.col("_s")[field], F.lit(""))).otherwise(old)

    spk = F.when(hit & (F.coalesce(F.col("_s")["speaker_id"], F.lit("")) != ""), F.col("_s")["speaker_id"])
    return (joined.withColumns({
        "matched": hit, "speaker_id": F.coalesce(spk, F.lit("unknown")),
        "age_group": value("age_group", "age_group"), "gender": value("gender", "gender"),
        "hf_split_origin": value("hf_split_origin", "split_origin")}).drop("_stem", "_s"))


def score_status(manifest: DataFrame, cache: DataFrame, threshold: float = 0.40) -> DataFrame:
    """Manifest with cached scores and ``status``: missing, dropped or kept.

    ``cache`` has one row per audio_path with cer, is_code_switched and
    detected_language (see :func:`keep_last`).
    """
    side = cache.select("audio_path", F.struct("cer", "is_code_switched", "detected_language").alias("_c"))
    joined = manifest.join(side, "audio_path", "left")
    c = F.col("_c")
    status = (F.when(c.isNull(), "missing").when(c["cer"] > threshold, "dropped").otherwise("kept"))
    old = F.col("detected_language") if "detected_language" in manifest.columns else F.lit(None).cast("string")
    return joined.withColumns({
        "status": status, "cer": c["cer"],
        "is_code_switched": F.coalesce(c["is_code_switched"], F.lit(False)),
        "detected_language": F.when(F.coalesce(c["detected_language"], F.lit("")) != "",
                                    c["detected_language"]).otherwise(old)}).drop("_c")


def apply_scores(manifest: DataFrame, cache: DataFrame, threshold: float = 0.40) -> DataFrame:
    return score_status(manifest, cache, threshold).filter("status = 'kept'").drop("status")


def last_by_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    return keep_last(df, keys, order)


def without_speakers(rows: DataFrame, train: DataFrame, speaker: str = "speaker_id") -> DataFrame:
    """Rows whose speaker is not a known speaker of ``train``; a null speaker stays."""
    return rows.join(known_speakers(train, speaker), speaker, "left_anti")


def leaked_speakers(train: DataFrame, rows: DataFrame, speaker: str = "speaker_id") -> DataFrame:
    return known_speakers(train, speaker).intersect(known_speakers(rows, speaker))


def held_out_speakers(train: DataFrame, rows: DataFrame, speaker: str = "speaker_id") -> DataFrame:
    return known_speakers(rows, speaker).subtract(known_speakers(train, speaker))


def leak_report(rows: DataFrame, train: DataFrame, speaker: str = "speaker_id") -> DataFrame:
    """One row: removed and kept clips, leaked and disjoint speakers.

    Clips are counted per speaker before the join, so a speaker with very many
    clips is one row there.
    """
    real = F.col(speaker).isNotNull() & ~F.col(speaker).isin("", "unknown")
    per = rows.groupBy(speaker).agg(F.count("*").alias("n")).withColumn("real", F.coalesce(real, F.lit(False)))
    seen = known_speakers(train, speaker).withColumn("in_train", F.lit(True))
    j = per.join(seen, speaker, "left").withColumn("in_train", F.coalesce("in_train", F.lit(False)))
    leak = F.col("in_train")
    return j.agg(
        F.coalesce(F.sum(F.when(leak, F.col("n"))), F.lit(0)).alias("removed_clips"),
        F.count_if(leak).alias("leaked_speakers"),
        F.coalesce(F.sum(F.when(~leak, F.col("n"))), F.lit(0)).alias("kept_clips"),
        F.count_if(~leak & F.col("real")).alias("disjoint_speakers"))


def speaker_map_summary(speaker_map: DataFrame) -> DataFrame:
    empty = F.coalesce(F.col("speaker_id"), F.lit("")) == ""
    return speaker_map.agg(
        F.count("*").alias("mapped"), F.countDistinct(F.when(~empty, F.col("speaker_id"))).alias("speakers"),
        F.count_if(empty).alias("empty"))


def not_yet_ingested(rows: DataFrame, existing: DataFrame, key: str = "file") -> DataFrame:
    return rows.join(existing.select(key), key, "left_anti")


def with_existing_files(rows: DataFrame, files: DataFrame, key: str = "audio_path") -> DataFrame:
    return rows.join(files.select(key), key, "left_semi")


def enrich_by_basename(results: DataFrame, manifest: DataFrame, columns: list[str], order: str) -> DataFrame:
    """Add manifest columns to per-clip results by file name; '' where missing.

    Of several manifest rows with one file name the last by ``order`` counts.
    """
    side = keep_last(manifest.select(X.basename(F.col("audio_path")).alias("audio"), order, *columns),
                     ["audio"], order).drop(order)
    joined = results.join(side, "audio", "left")
    return joined.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns})


def reuse_clip_list(previous: DataFrame, manifest: DataFrame, order: str) -> DataFrame:
    """Manifest rows of an earlier clip list (idx, audio); unknown names are dropped."""
    side = keep_last(manifest.withColumn("audio", X.basename(F.col("audio_path"))), ["audio"], order)
    return previous.select("idx", "audio").join(side, "audio")


def pair_sides(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Two hypothesis sets (key, hyp) of the same clips as hyp_a and hyp_b."""
    return (a.withColumnRenamed("hyp", "hyp_a")
            .join(b.select(key, F.col("hyp").alias("hyp_b")), key))


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows without replacement: the first in seeded hash order."""
    return df.orderBy(seeded_hash(F.col(key), seed), F.col(key)).limit(n)


def shuffled_split(df: DataFrame, key: str, share: float = 0.9, seed: int = 42) -> DataFrame:
    """Adds ``is_train``: exactly floor(n * share) rows, in seeded hash order."""
    need = F.floor(F.col("_total") * F.lit(share))
    cut = hash_cut(df, F.col(key), need, seed)
    mine = F.struct(seeded_hash(F.col(key), seed).alias("h"), F.col(key).alias("k"))
    return df.withColumn("is_train", F.coalesce(mine <= cut, F.lit(False)))


def first_n(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def union_all(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
