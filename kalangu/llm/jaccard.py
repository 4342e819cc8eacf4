"""N-gram Jaccard join by rare-first prefix filtering.

A text is the set of its word n-grams; equal sets are one node. The n-grams of
a set are put in one order for all sets, rare ones first. Two sets of
similarity s share an n-gram among their first n - ceil(s n) + 1, so prefixes
alone are joined, and most n-grams of most texts occur nowhere else.

- Order: half of all n-grams (by a bit of their hash) come before the others and
  go by document frequency; the prefix of a set lies within that half unless
  the set is tiny. Frequencies are counted over all sets; those above one go
  back to the sets by a join, before which a bitmap sifts n-grams that come
  once.
- Length filter: sizes that are too different. Positional filter: where the
  first shared n-gram stands leaves too few after it. Suffix filter: one bit for
  each of ``CELLS`` classes of the hash says whether a set has an odd number of
  n-grams there; sets differ in at least as many n-grams as bits.
- Each pair is verified once, by its whole sets.

A posting list may hold a large group of near copies. First all members of a
list are compared with one of them, that with most shared n-grams, and again
with others as long as that finds many links. Pairs of a list whose members are not
connected after that are compared all, behind the filters, so that no link
between components is lost and a group gives about as many links as members. A
pair leaves the list of the first n-gram that it shares, not those of others
whose last ``BEFORE`` n-grams tell that there was one.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from kalangu.llm.components import components
from kalangu.llm.phrases import Bitmap
from kalangu.llm.simhash import _LOWER, SEED
from kalangu.session import through_table

PERCENT = 85
SHINGLE = 4
#: classes of the suffix filter, a multiple of 64
CELLS = 2048
#: words of 64 bits of classes that a row of the lists brings
FOLDED = 8
#: n-grams before its own that a row of the last join carries
BEFORE = 8
#: bits of a hash that an n-gram has as a key; lists may hold others, sets are compared by whole hashes
KEY_BITS = 48
#: members of every list that the others are compared with in a turn, as long as that adds one link to so many
CENTRES, WORTH = 2, 20
#: the bitmap of n-grams that come more than once: 8 MB at most
BITS = 1 << 26
_SET = "n:int,k1:bigint,k2:bigint"


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """The different XXH64 values of the word n-grams, sorted; words as in ``simhash.fingerprint``."""
    from xxhash import xxh64_intdigest as digest

    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return np.zeros(0, "<u8")
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), "i8", len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - size + 1)
    return np.unique(np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts[:n].tolist(), ends[-n:].tolist())), "<u8", n))


def set_print(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a whole set."""
    from xxhash import xxh3_128_intdigest as digest

    halves = np.array(divmod(digest(hashes.tobytes(), SEED), 1 << 64), "u8").view("i8")
    return int(halves[0]), int(halves[1])


def odd_cells(hashes: np.ndarray) -> np.ndarray:
    """A bit for each class: whether the set has an odd number of n-grams of it."""
    counts = np.bincount((hashes >> np.uint64(1)).astype("i8") % CELLS, minlength=CELLS)
    return np.packbits((counts & 1).astype("u1"), bitorder="little").view("<i8")


def _lists(rows: list[np.ndarray], kind: str) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype("i4")
    return pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, kind), *rows]).astype(kind)))


def sketch(text: Column, size: int) -> Column:
    """Size of the n-gram set and the 128 bits that stand for it."""
    @F.arrow_udf(f"struct<{_SET}>")
    def run(texts: pa.Array) -> pa.Array:
        n, prints = [], []
        for t in texts:
            s = shingle_set(t.as_py(), size)
            n.append(len(s))
            prints.append(set_print(s))
        return pa.StructArray.from_arrays([pa.array(n, pa.int32()), *[pa.array([p[k] for p in prints], pa.int64()) for k in (0, 1)]],
                                          ["n", "k1", "k2"])

    return run(text)


def prefix_length(n, percent: int):
    """How many of ``n`` ordered n-grams two sets of the similarity must share one of."""
    return n - (percent * n + 99) // 100 + 1


def halves(hashes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the n-grams that come first, and of as many others as the prefix needs beyond them."""
    keys = (hashes >> np.uint64(64 - KEY_BITS)).view("i8")
    first = (hashes & np.uint64(1)) == 0
    more = max(0, prefix_length(len(hashes), percent) - int(first.sum()))
    return keys[first], np.sort(keys[~first])[:more]


def _halves(text: Column, size: int, percent: int) -> Column:
    @F.arrow_udf(f"struct<{_SET},early:array<bigint>,late:array<bigint>>")
    def run(texts: pa.Array) -> pa.Array:
        sets = [shingle_set(t.as_py(), size) for t in texts]
        prints = [set_print(s) for s in sets]
        split = [halves(s, percent) for s in sets]
        return pa.StructArray.from_arrays(
            [pa.array([len(s) for s in sets], pa.int32()), *[pa.array([p[k] for p in prints], pa.int64()) for k in (0, 1)],
             *[_lists([x[k] for x in split], "i8") for k in (0, 1)]], ["n", "k1", "k2", "early", "late"])

    return run.asNondeterministic()(text)


def _whole(text: Column, size: int) -> Column:
    @F.arrow_udf(f"struct<{_SET},hashes:array<bigint>,cells:array<bigint>>")
    def run(texts: pa.Array) -> pa.Array:
        sets = [shingle_set(t.as_py(), size) for t in texts]
        prints = [set_print(s) for s in sets]
        cells = [odd_cells(s) for s in sets]
        return pa.StructArray.from_arrays(
            [pa.array([len(s) for s in sets], pa.int32()), *[pa.array([p[k] for p in prints], pa.int64()) for k in (0, 1)],
             _lists([s.view("i8") for s in sets], "i8"), _lists(cells, "i8")], ["n", "k1", "k2", "hashes", "cells"])

    return run.asNondeterministic()(text)


def _of_sets(docs: DataFrame, sets: DataFrame, made: Column, fields: list[str]) -> DataFrame:
    """``fields`` of ``made`` for each of the sets, from the text of its smallest id; an id may have other texts besides.

    ``made`` says that it is not deterministic, though it is, so that it is not
    called a second time as a key of the join.
    """
    wanted = sets.select(F.col("least").alias("id"), "node", F.col("k1").alias("__k1"), F.col("k2").alias("__k2"))
    read = docs.join(wanted, "id").select("node", "__k1", "__k2", made.alias("s"))
    return read.filter((F.col("s.k1") == F.col("__k1")) & (F.col("s.k2") == F.col("__k2"))).select("node", "s.n", *[f"s.{f}" for f in fields])


def _overlap(a: Column, b: Column, percent: int) -> Column:
    """The least overlap of two sets of these sizes that have the similarity."""
    return F.ceil(percent * (a + b) / (100 + percent))


def _near(percent: int) -> Column:
    """Length filter of two sets x and y."""
    return F.least("xn", "yn") * 100 >= percent * F.greatest("xn", "yn")


def _fits(percent: int) -> Column:
    """Length and positional filters for the first shared n-gram of two sets x and y."""
    rest = F.least(F.col("xn") - F.col("xpos"), F.col("yn") - F.col("ypos"))
    return _near(percent) & (rest >= _overlap(F.col("xn"), F.col("yn"), percent))


def folded(cells: Column) -> Column:
    """Fewer classes, of several each: they differ in at most as many as ``cells``."""
    words = [[F.get(cells, F.lit(k)) for k in range(j, CELLS // 64, FOLDED)] for j in range(FOLDED)]
    return F.array(*[reduce(lambda a, b: a.bitwiseXOR(b), w) for w in words])


def _suffix(percent: int, classes: str = "cells") -> Column:
    """Suffix filter: the classes of two sets x and y tell how many n-grams only one of them has, at least."""
    differ = F.aggregate(F.zip_with(f"x{classes}", f"y{classes}", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, c: s + c)
    return differ <= F.col("xn") + F.col("yn") - 2 * _overlap(F.col("xn"), F.col("yn"), percent)


def _postings(docs: DataFrame, sets: DataFrame, size: int, percent: int) -> DataFrame:
    """(h, node, n, pos): the prefix n-grams that more than one set has in its prefix, with their place in the order."""
    members = through_table(_of_sets(docs, sets, _halves(F.col("text"), size, percent), ["early", "late"]), "members")
    often = through_table(members.select(F.explode("early").alias("h")).groupBy("h").agg(F.count("*").alias("df")).filter("df > 1"), "often")
    bitmap = Bitmap(often.select(F.col("h").alias("fp")), BITS)

    @F.arrow_udf("array<bigint>")
    def sifted(keys: pa.Array) -> pa.Array:
        flat = keys.flatten().to_numpy()
        there = bitmap.has(flat.view("u8"))
        ends = np.concatenate(([0], np.cumsum(there)))[np.concatenate(([0], np.cumsum(keys.value_lengths().to_numpy())))]
        return pa.ListArray.from_arrays(ends.astype("i4"), pa.array(flat[there]))

    place = members.select("node", "n", F.size("early").alias("early"), prefix_(F.col("n"), percent).alias("p"))
    common = members.select("node", F.explode(sifted("early")).alias("h")).join(often, "h")
    common = common.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("c")).join(place, "node")
    common = common.select("node", "n", "p", (F.col("early") - F.size("c")).alias("ones"), F.posexplode("c").alias("k", "c"))
    first = common.select(F.col("c.h").alias("h"), "node", "n", (F.col("ones") + F.col("k")).alias("pos"), "p").filter("pos < p").drop("p")
    last = members.select("node", "n", F.size("early").alias("early"), F.posexplode("late").alias("k", "h"))
    rows = through_table(first.union(last.select("h", "node", "n", F.col("early") + F.col("k"))), "prefixes")
    shared = rows.groupBy("h").agg(F.count("*").alias("held")).filter("held > 1")
    return through_table(rows.join(shared, "h"), "postings")


def prefix_(n: Column, percent: int) -> Column:
    return n - F.ceil(percent * n / 100).cast("int") + 1


def _centres(turn: int) -> list[Column]:
    member = [F.col("node").alias("ynode"), F.col("n").alias("yn"), F.col("root").alias("yroot")]
    ranks = [F.xxhash64("node", "h", F.lit(turn), F.lit(k)) for k in range(CENTRES)] if turn else [-F.col("weight")]
    return [F.min_by(F.struct(*member), F.struct(rank, "node")).alias(f"c{k}") for k, rank in enumerate(ranks)]


def _verified(pairs: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b: nodes) that have the similarity."""
    x, y = held.select(F.col("node").alias("a"), F.col("hashes").alias("x")), held.select(F.col("node").alias("b"), F.col("hashes").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    alike = 100 * both >= percent * (F.size("x") + F.size("y") - both)
    return through_table(pairs.join(x, "a").join(y, "b").filter(alike).select("a", "b"), "alike")


def _pair(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def starred(placed: DataFrame, open_: DataFrame, cells: DataFrame, percent: int) -> DataFrame:
    """(a, b): members of the lists of ``open_`` with the members chosen there, as far as they may be similar.

    Both sides bring their classes, folded, so that the join of the lists makes
    few rows for pairs that the suffix filter drops: a large group of near
    copies has about as many chosen members as lists, and each would meet each
    of its members. Where the n-gram stands plays no part: any member may do.
    """
    bits = cells.select("node", folded(F.col("cells")).alias("bits"))
    x = placed.join(open_.select("h").distinct(), "h", "left_semi").join(bits, "node")
    x = x.select("h", *[F.col(c).alias(f"x{c}") for c in ("node", "n", "root", "bits")])
    y = open_.join(bits.select(F.col("node").alias("ynode"), F.col("bits").alias("ybits")), "ynode")
    met = x.join(y, (x["h"] == y["h"]) & (F.col("xroot") != F.col("yroot")) & _near(percent) & _suffix(percent, "bits"))
    met = met.select("xnode", "xn", "ynode", "yn").distinct()
    for side in "xy":
        met = met.join(cells.select(F.col("node").alias(f"{side}node"), F.col("cells").alias(f"{side}cells")), f"{side}node")
    return met.filter(_suffix(percent)).select(*_pair("xnode", "ynode")).distinct()


def unconnected(rows: DataFrame, cells: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of different roots in ``rows`` (h, node, n, pos, root) that the filters let through, few of them twice.

    The order of n-grams is the same for all sets. If both have one in common
    among the last before this, the pair was in an earlier list already; its
    first list has none such, so no pair is lost.
    """
    last = W.partitionBy("node").orderBy("pos").rowsBetween(-BEFORE, -1)
    rows = rows.withColumn("before", F.collect_list("h").over(last)).join(cells, "node")
    x, y = (rows.select("h", *[F.col(c).alias(f"{s}{c}") for c in ("node", "n", "pos", "root", "cells", "before")]) for s in "xy")
    pairs = x.join(y, (x["h"] == y["h"]) & (F.col("xnode") < F.col("ynode")) & (F.col("xroot") != F.col("yroot"))
                   & _fits(percent) & _suffix(percent) & ~F.arrays_overlap("xbefore", "ybefore"))
    return pairs.select(*_pair("xnode", "ynode"))


def links(docs: DataFrame, sets: DataFrame, size: int, percent: int, hints: DataFrame | None = None) -> DataFrame:
    """(a, b): enough links between the nodes of ``sets`` to give all components.

    ``hints`` are pairs of nodes to be verified first.
    """
    spark = docs.sparkSession
    # a smaller set cannot be similar to a different one
    joined = sets.filter(F.col("n") * (100 - percent) >= percent)
    postings = _postings(docs, joined, size, percent)
    weights = postings.groupBy("node").agg(F.sum("held").alias("weight"))
    wanted = weights.select("node")
    tested = spark.createDataFrame([], "a bigint, b bigint")
    if hints is not None:
        tested = through_table(hints.select(*_pair("a", "b")).filter("a != b").distinct(), "hints")
        wanted = wanted.union(tested.select("a")).union(tested.select("b")).distinct()
    held = through_table(_of_sets(docs, sets.join(wanted, "node", "left_semi"), _whole(F.col("text"), size), ["hashes", "cells"])
                         .dropDuplicates(["node"]), "held")
    postings = through_table(postings.drop("held").join(weights, "node"), "weighted")
    cells = held.select("node", "cells")
    found, turn, more = _verified(tested, held, percent), 0, True
    known = found.count()
    while True:
        placed = postings.join(components(found), "node", "left").withColumn("root", F.coalesce("root", "node"))
        placed = through_table(placed, "placed")
        # first the member of most shared n-grams, then some others of every list
        open_ = placed.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high"), *_centres(turn)).filter("low != high")
        open_ = open_.select("h", F.explode(F.array_distinct(F.array([c for c in open_.columns if c[0] == "c"]))).alias("c"))
        open_ = through_table(open_.select("h", "c.ynode", "c.yn", "c.yroot"), "open")
        if not more:
            break
        stars = through_table(starred(placed, open_, cells, percent).join(tested, ["a", "b"], "left_anti"), "stars")
        new = _verified(stars, held, percent)
        tested, found, turn = tested.union(stars), found.union(new), turn + 1
        # what a turn finds: as long as it is much, the lists still hold large groups that belong together
        more = new.count() * WORTH > known
        known += new.count()
    rest = unconnected(placed.join(open_, "h", "left_semi"), cells, percent)
    rest = through_table(rest.distinct().join(tested, ["a", "b"], "left_anti"), "rest")
    return found.union(_verified(rest, held, percent))


def sets_of(prints: DataFrame) -> DataFrame:
    """(k1, k2, least, n, node): the different sets that have an id, numbered."""
    sets = prints.filter("n > 0").groupBy("k1", "k2").agg(F.min("id").alias("least"), F.first("n").alias("n")).filter("least IS NOT NULL")
    return through_table(sets.withColumn("node", F.monotonically_increasing_id()), "sets")


def classes(docs: DataFrame, id: str = "doc_id", text: str = "text", percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """One row per row of ``docs``: ``id``, ``n_shingles``, ``component_id``.

    ``component_id`` is the smallest id reachable over links between sets whose
    intersection is at least ``percent`` % of their union. A text of fewer words
    is one n-gram; one without words, or a null, has an empty set and only
    itself. A row without an id belongs to the rows of the same set, if one of
    these has an id, and to nothing otherwise (null). Repeated ids or rows give
    as many rows; an id with several texts stands for each of them. Other
    columns are not read; an empty table gives an empty result.
    """
    docs = docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    prints = through_table(docs.select("id", sketch(F.col("text"), size).alias("s")).select("id", "s.*"), "prints")
    sets = sets_of(prints)
    named = named_sets(sets, links(docs, sets, size, percent))
    out = prints.join(named.select("k1", "k2", "component_id"), ["k1", "k2"], "left")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id), F.col("n").cast("long").alias("n_shingles"), own.alias("component_id"))


def named_sets(sets: DataFrame, found: DataFrame) -> DataFrame:
    """``sets`` with the smallest id of their component."""
    placed = sets.join(components(found), "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return placed.join(smallest, "root").drop("root")
