"""Mixing sources by temperature: an exponent over token shares, and budgets dealt out in permuted blocks.

Weights are w(s) ~ share(s) ** a. At a = 1 sources keep their shares, at 0 they
are equal. The exponent is bisected: with ``entropy`` to the largest a whose
weights have at least that share of the greatest possible entropy, with
``repeats`` to the smallest a at which no source is gone through more often
than that. The run is as long as it takes to read every source at least once,
so nothing is dropped.

Each source then gets its budget of tokens: its texts are dealt into blocks by
hash. Whole passes copy every text and have no order; the rest of the budget
goes to the first blocks, in a seeded order, of one more pass, and within the
last of those to the first texts. Only this partial pass is permuted: the mix
is a multiset of rows, whose copies may lie side by side. So a text
needs one number per source and one per block, and no source is sorted whole.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kalangu.functions.hashing import seeded_hash
from kalangu.session import through_table

REPEATS = 4.0
SEED = 42
STEPS = 50
#: hexadecimal digits of the hash that make a block: 4,096 blocks a source
DIGITS = 3


def weights(tokens: list[int], exponent: float) -> list[float]:
    """Normalised weights of sources by their tokens."""
    total = sum(tokens)
    raw = [(t / total) ** exponent for t in tokens]
    return [r / sum(raw) for r in raw]


def passes(tokens: list[int], exponent: float) -> list[float]:
    """How often each source is gone through when the least read source is read once."""
    rates = [w / t for w, t in zip(weights(tokens, exponent), tokens)]
    return [r / min(rates) for r in rates]


def solve(tokens: list[int], repeats: float | None = REPEATS, entropy: float | None = None) -> float:
    """The exponent in [0, 1] that meets the target, by bisection."""
    if (repeats is None) == (entropy is None):
        raise ValueError("give either repeats or entropy")
    if repeats is not None and repeats < 1:
        raise ValueError("repeats must be 1 or more")
    if entropy is not None and not 0 <= entropy <= 1:
        raise ValueError("entropy is a share of the greatest, 0 to 1")

    def flat_enough(a: float) -> bool:
        w = weights(tokens, a)
        return -sum(x * math.log(x) for x in w if x) >= entropy * math.log(max(2, len(w)))

    def within(a: float) -> bool:
        return max(passes(tokens, a)) <= repeats

    # within() holds from some exponent on, flat_enough() up to some exponent
    good, bad, test = (1.0, 0.0, within) if repeats is not None else (0.0, 1.0, flat_enough)
    if test(bad):
        return bad
    for _ in range(STEPS):
        middle = (good + bad) / 2
        good, bad = (middle, bad) if test(middle) else (good, middle)
    return good


def token_count(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))), F.lit(0)).cast("long")


def plan(docs: DataFrame, id: str = "doc_id", source: str = "source", text: str = "text", repeats: float | None = REPEATS,
         entropy: float | None = None, seed: int = SEED, max_sources: int = 100_000) -> DataFrame:
    """One row per row of ``docs``: ``id``, source, n_tokens, block, weight, copies.

    ``copies`` is 1 or more: how often the mix holds the text. Null sources
    make one source of their own; a source without tokens is read once. Rows
    with equal ids are equal in the order of their block, and the tie goes to
    the whole group: each is copied alike. An empty table gives an empty plan.
    One row per source reaches the driver; more than ``max_sources`` raise.
    """
    key = F.coalesce(F.col(f"`{id}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{source}`").alias("source"), token_count(F.col(f"`{text}`")).alias("n_tokens"),
                       seeded_hash(key, seed).alias("h"))
    rows = through_table(rows.withColumn("block", F.substring("h", 1, DIGITS)), "rows")
    blocks = through_table(rows.groupBy("source", "block").agg(F.sum("n_tokens").alias("held")), "blocks")
    sources = blocks.groupBy("source").agg(F.sum("held").alias("tokens")).limit(max_sources + 1).collect()
    if len(sources) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    full = sorted((r for r in sources if r.tokens), key=lambda r: (r.source is not None, r.source or ""))
    goal = []
    if full:
        tokens = [r.tokens for r in full]
        a = solve(tokens, repeats, entropy)
        goal = [(r.source, w, math.floor(r.tokens * p + 0.5)) for r, w, p in zip(full, weights(tokens, a), passes(tokens, a))]
    spark = docs.sparkSession
    goals = spark.createDataFrame(goal, "source string, weight double, budget long")
    # the blocks of a source in the order of its last, partial pass: at most 16 ** DIGITS rows a source
    order = Window.partitionBy("source").orderBy(seeded_hash(F.concat("source_key", F.lit("/"), "block"), seed), "block")
    cut = (blocks.join(goals, blocks["source"].eqNullSafe(goals["source"]), "left")
           .select(blocks["source"].alias("source"), "block", "held", F.coalesce("weight", F.lit(0.0)).alias("weight"),
                   F.coalesce(blocks["source"].cast("string"), F.lit("")).alias("source_key"), "budget")
           .withColumn("tokens", F.sum("held").over(Window.partitionBy("source")))
           .withColumn("whole", F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(F.lit(1)))
           .withColumn("left", F.coalesce(F.col("budget") - F.col("whole") * F.col("tokens"), F.lit(0)))
           .withColumn("room", F.col("left") - (F.sum("held").over(order) - F.col("held"))))
    # a block is read whole, not at all, or up to its room
    cut = cut.select(F.col("source").alias("s"), F.col("block").alias("b"), "weight", "whole", "room", "held")
    near = rows.join(cut, rows["source"].eqNullSafe(cut["s"]) & (rows["block"] == cut["b"])).drop("s", "b")
    inside = Window.partitionBy("source", "block").orderBy("h").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    split = near.filter((F.col("room") > 0) & (F.col("room") < F.col("held")))
    split = split.withColumn("more", (F.sum("n_tokens").over(inside) <= F.col("room")).cast("int"))
    plain = near.filter(~((F.col("room") > 0) & (F.col("room") < F.col("held")))).withColumn(
        "more", ((F.col("room") > 0) & (F.col("held") > 0)).cast("int"))
    return plain.union(split).select(F.col("id").alias(id), F.col("source").alias(source), "n_tokens", "block", "weight",
                                     (F.col("whole") + F.col("more")).cast("int").alias("copies"))


def mix(docs: DataFrame, id: str = "doc_id", source: str = "source", text: str = "text", repeats: float | None = REPEATS,
        entropy: float | None = None, seed: int = SEED) -> DataFrame:
    """``docs`` with each row as often as its plan says, columns unchanged.

    Rows without an id, and sources or tables without tokens, stay once.
    """
    copies = plan(docs, id, source, text, repeats, entropy, seed).filter(F.col(id).isNotNull() & (F.col("copies") > 1)).groupBy(
        F.col(id).alias("__id"), F.col(source).alias("__source")).agg(F.max("copies").alias("__copies"))
    joined = docs.join(copies, (F.col(f"`{id}`") == F.col("__id")) & F.col(f"`{source}`").eqNullSafe(F.col("__source")), "left")
    return (joined.withColumn("__pass", F.explode(F.sequence(F.lit(1), F.coalesce("__copies", F.lit(1)))))
            .drop("__id", "__source", "__copies", "__pass"))
