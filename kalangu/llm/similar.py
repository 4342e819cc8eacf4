"""Near-duplicates by the Jaccard similarity of word shingles: SimHash candidates first, then all others.

A text is the set of its five-word shingles; equal sets are one node. Texts
whose SimHash fingerprints of the same shingles differ in at most four bits are
the first candidates: the Golay keys find the close copies, which are most.
Pairs down to ``similarity`` differ in about ten bits, beyond the reach of
those keys; they come from the prefix join, which misses none. Every candidate
is compared by its whole sets, so no text is dropped that is not linked to
another by pairs of at least that similarity.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kalangu.llm import jaccard, simhash
from kalangu.session import small_batches, through_table

PERCENT = 80
SHINGLE = 5
#: texts and sets that go to Python at a time
BATCH = 1000


def candidates(prints: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): nodes whose fingerprints are equal or linked, enough of them to give all components of fingerprints."""
    held = sets.join(prints.select("k1", "k2", "fp").distinct(), ["k1", "k2"]).select("node", "fp")
    held = through_table(held, "fingerprints")
    least = through_table(held.groupBy("fp").agg(F.min("node").alias("first")), "least")
    equal = held.join(least, "fp").select(F.col("first").alias("a"), F.col("node").alias("b"))
    linked = simhash.links(least.select("fp"))
    x, y = least.select(F.col("fp").alias("a"), F.col("first").alias("x")), least.select(F.col("fp").alias("b"), F.col("first").alias("y"))
    return equal.union(linked.join(x, "a").join(y, "b").select("x", "y"))


def keep_one(df: DataFrame, id: str = "doc_id", text: str = "text", percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """``df`` with one row of each group of near-duplicates: that of the smallest id.

    Groups are the components over pairs whose intersection is at least
    ``percent`` % of their union; texts without words are equal. Rows without
    an id are kept and stand for no group; a repeated smallest id keeps each of
    its rows.
    """
    with small_batches(df.sparkSession, BATCH):
        docs = df.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text")).filter(F.col("id").isNotNull())
        prints = docs.select("id", jaccard.sketch(F.col("text"), size).alias("s"), simhash.fingerprint(F.col("text"), size).alias("fp"))
        prints = through_table(prints.select("id", "s.*", "fp"), "prints")
        sets = jaccard.sets_of(prints)
        found = jaccard.links(docs, sets, size, percent, candidates(prints, sets))
        named = jaccard.named_sets(sets, found).select("k1", "k2", F.col("component_id").alias("kept"))
        none = prints.filter("n = 0").groupBy("k1", "k2").agg(F.min("id").alias("kept"))
        gone = prints.select("id", "k1", "k2").join(named.union(none), ["k1", "k2"]).filter(F.col("id") != F.col("kept"))
    gone = gone.select(F.col("id").alias("__gone")).distinct()
    return df.join(gone, F.col(f"`{id}`") == F.col("__gone"), "left_anti")
