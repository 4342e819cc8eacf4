"""Error rates and per-clip verdicts.

Distances and alignments of any length come from the Arrow functions of
``edits``; pairs that are equal or have an empty side do not reach them.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kalangu.functions import text as X
from kalangu.functions.binding import let
from kalangu.functions.edits import align, batch_alignments, errors, pairs

COUNTS = ("hits", "substitutions", "deletions", "insertions")


def word_distance(ref: Column, hyp: Column) -> Column:
    """Levenshtein distance between two word arrays."""
    return errors(ref, hyp)


def clip_wer(ref: Column, hyp: Column) -> Column:
    """Word errors over reference words; null when the reference is empty."""
    return words_wer(X.words(ref), X.words(F.coalesce(hyp, F.lit(""))))


def words_wer(ref: Column, hyp: Column) -> Column:
    """:func:`clip_wer` of two word arrays."""
    return F.when(F.size(ref) > 0, word_distance(ref, hyp) / F.size(ref))


def clip_cer(ref: Column, hyp: Column) -> Column:
    """Character errors over reference characters; 1.0 for an empty reference, null for a null hypothesis."""
    return F.when(F.length(ref) > 0, F.when(hyp.isNotNull(), errors(ref, hyp) / F.length(ref))).otherwise(1.0)


@F.arrow_udf(T.StructType([T.StructField(c, T.IntegerType()) for c in COUNTS]))
def _align_udf(ref: pa.Array, hyp: pa.Array) -> pa.Array:
    return pa.StructArray.from_arrays(batch_alignments(ref, hyp), list(COUNTS))


def with_alignment(df: DataFrame, ref: Column, hyp: Column, out: str = "alignment") -> DataFrame:
    """Adds struct<hits, substitutions, deletions, insertions> of two word arrays.

    Declared not deterministic, although it is, so that the optimizer does
    not copy the call once per field that is used of its result. Pairs that
    are equal or have an empty side are settled without it.
    """
    df = df.withColumns({"_rw": ref, "_hw": hyp})
    n, m = F.size("_rw"), F.size("_hw")
    equal = F.col("_rw") == F.col("_hw")
    plain = equal | (n == 0) | (m == 0)
    counts = {"hits": F.when(equal, n).otherwise(0), "substitutions": F.lit(0),
              "deletions": F.when(m == 0, n).otherwise(0), "insertions": F.when(n == 0, m).otherwise(0)}
    settled = F.struct(*[counts[c].alias(c) for c in COUNTS])
    return (df.withColumn(out, _align_udf.asNondeterministic()(F.when(~plain, F.col("_rw")), F.when(~plain, F.col("_hw"))))
            .withColumn(out, F.when(plain, settled).otherwise(F.col(out))).drop("_rw", "_hw"))


@F.arrow_udf(T.ArrayType(T.StructType([
    T.StructField("language", T.StringType()), T.StructField("words", T.IntegerType()),
    T.StructField("tag_errors", T.IntegerType())])))
def _tag_errors_udf(ref: pa.Array, hyp: pa.Array, ref_tags: pa.Array, hyp_tags: pa.Array) -> pa.Array:
    out = []
    for (r, h), rt, ht in zip(pairs(ref, hyp), ref_tags, hyp_tags):
        rt, ht, matched = rt.as_py() or [], ht.as_py() or [], []
        align(r, h, matched)
        words, right = Counter(rt), Counter(rt[i] for i, j in matched if rt[i] == ht[j])
        out.append([{"language": t, "words": n, "tag_errors": n - right[t]} for t, n in words.items()])
    return pa.array(out, pa.list_(pa.struct([("language", pa.string()), ("words", pa.int32()), ("tag_errors", pa.int32())])))


def with_tag_errors(df: DataFrame, ref: str, hyp: str, out: str = "tags") -> DataFrame:
    """Adds, per language of the reference, words and words whose tag is lost.

    ``ref`` and ``hyp`` are array<struct<word,language>>. A deleted or
    substituted word counts as a tag error, as does a match with another tag.
    """
    r, h = (F.transform(F.col(s), lambda w: F.lower(w["word"])) for s in (ref, hyp))
    return df.withColumn(out, _tag_errors_udf.asNondeterministic()(r, h, F.col(ref)["language"], F.col(hyp)["language"]))


# --- verdicts ----------------------------------------------------------------

def is_garbage(hyp: Column, ref: Column, foreign_share: float = 0.1,
               counts: tuple[Column, Column] | None = None) -> Column:
    """Looks like a loop or another script. A blank hypothesis does not.

    ``counts`` are the words of ref and hyp where they are known already.
    """
    longer = let(lambda n_ref, n_hyp: n_hyp > F.greatest(n_ref * 3, n_ref + 10),
                 *(counts or (X.word_count(ref), X.word_count(hyp))))
    return (X.strip(hyp) != "") & (
        (X.non_latin_ratio(hyp) > foreign_share) | hyp.rlike(r"([a-z])\1{3}") | longer)


def delta_wer(wer_a: Column, wer_b: Column) -> Column:
    """B minus A; null where either is missing."""
    return F.nanvl(wer_b, F.lit(None).cast("double")) - F.nanvl(wer_a, F.lit(None).cast("double"))


def verdict_wide(delta: Column, garbage_b: Column, band: float = 0.10) -> Column:
    """Verdict with the wide band; garbage makes a regression catastrophic."""
    return (F.when(delta.isNull(), "UNKNOWN")
            .when(delta < -band, "IMPROVED")
            .when((delta > band) & garbage_b, "CATASTROPHIC")
            .when(delta > band, "REGRESSED")
            .otherwise("SAME"))


def verdict_narrow(wer_a: Column, wer_b: Column, hyp_b: Column, ref: Column,
                   band: float = 0.05, foreign_share: float = 0.1,
                   counts: tuple[Column, Column] | None = None) -> Column:
    """Verdict with the narrow band; a broken hypothesis decides first."""
    delta = delta_wer(wer_a, wer_b)
    longer = let(lambda n_ref, n_hyp: n_hyp > F.greatest(n_ref * 2, n_ref + 5),
                 *(counts or (X.word_count(ref), X.word_count(hyp_b))))
    broken = ((X.non_latin_ratio(hyp_b) > foreign_share) | longer
              | hyp_b.rlike(r"([a-z ])\1{3}"))
    return (F.when(delta.isNull(), "UNKNOWN")
            .when(broken, "CATASTROPHIC")
            .when(delta > band, "REGRESSED")
            .when(delta < -band, "IMPROVED")
            .otherwise("SAME"))


def failure_mode(ref: Column, hyp_a: Column, hyp_b: Column, foreign_share: float = 0.1) -> Column:
    """First matching mode of a regressed clip."""
    def by_length(n_a: Column, n_b: Column, n_ref: Column) -> Column:
        growth = F.when(hyp_a == "", 1.0).otherwise(n_b / F.greatest(n_a, F.lit(1)))
        return F.when(n_b < n_ref * 0.5, "truncated").when(growth > 1.4, "longer").otherwise("other")

    return F.when(X.non_latin_ratio(hyp_b) > foreign_share, "wrong_lang").otherwise(
        let(by_length, X.word_count(hyp_a), X.word_count(hyp_b), X.word_count(ref)))
