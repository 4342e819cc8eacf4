"""Ranked lexical search by presence masks.

Every item has a mask of one bit per term. The documents of a batch are grouped,
for each item, by the mask of the terms they hold, with bitmap operations on a
terms x documents matrix; all documents of a mask share a maximum score, taken
from the most frequent and shortest document of the group. Masks are evaluated
by descending maximum until the next one cannot reach the lowest of the best
scores so far; those are carried from batch to batch of a partition, so later
batches look at few masks. A partition hands over at most ``top`` documents an
item, and one window ranks these.

Three steps: the texts become postings of the terms that items ask for (one
pass, written to a table); their counts give the weights; masks are grouped and
evaluated over the postings. Items come in blocks of about ``BLOCK_TERMS``
terms, each with passes of its own, so what a task holds of them is bounded
however many there are.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from kalangu.session import through_table

TOP = 10
#: terms of one block of items, which every task holds: some megabytes
BLOCK_TERMS = 200_000
#: cells of a presence matrix, and documents in it at most
CELLS, DOCUMENTS = 1 << 23, 2048
#: documents evaluated between two looks at the lowest of the best scores
STEP = 64
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """Maximal runs of ASCII letters and digits and of all characters beyond ASCII; only A-Z become lower case."""
    return (text or "").encode().translate(_TERMS).split(b" ")


def _counts(text: str | None) -> tuple[int, Counter]:
    held = Counter(terms_of(text))
    held.pop(b"", None)
    return sum(held.values()), held


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def lengths(n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """100 - 90 + 90 n N div L; beyond 64 bits in whole Python numbers."""
    if len(n) and 90 * int(n.max()) * documents >= 1 << 63:
        return np.array([10 + 90 * int(x) * documents // total for x in n], "i8")
    return 10 + 90 * n * documents // max(total, 1)


def part(w, tf, m):
    """What a term adds to a score."""
    return w * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


def _postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(id, n, terms, tfs) of every row: its length, and the wanted terms that it holds, ascending, with their counts."""
    kind = StructType([docs.schema["id"], StructField("n", LongType())])
    schema = pa.schema([("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ns, terms, tfs = [], [], []
            for text in batch.column("text"):
                n, held = _counts(text.as_py())
                pairs = sorted((vocabulary[t], held[t]) for t in held.keys() & vocabulary.keys())
                ns.append(n)
                terms.append([t for t, _ in pairs])
                tfs.append([c for _, c in pairs])
            columns = [pa.array(x, f.type) for x, f in zip((ns, terms, tfs), schema)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], ["id", *schema.names])

    return docs.mapInArrow(run, kind.add("terms", ArrayType(IntegerType())).add("tfs", ArrayType(LongType())))


def presence(present: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Groups the columns of a boolean terms x documents matrix by their bits: (order, start of each group, its mask)."""
    packed = np.packbits(present, axis=0, bitorder="little")
    wide = np.zeros((-(-packed.shape[0] // 8) * 8, packed.shape[1]), "u1")
    wide[:packed.shape[0]] = packed
    words = np.ascontiguousarray(wide.T).view("<u8")
    order = np.lexsort(words.T)
    fresh = np.ones(len(order), bool)
    fresh[1:] = (words[order[1:]] != words[order[:-1]]).any(axis=1)
    starts = np.flatnonzero(fresh)
    return order, starts, present[:, order[starts]]


class Search:
    """The best documents of each item so far, over batches of postings."""

    def __init__(self, items: list[np.ndarray], weights: np.ndarray, documents: int, total: int, top: int):
        self.items, self.weights, self.documents, self.total, self.top = items, weights, documents, total, top
        self.best: list[list[tuple[int, object]]] = [[] for _ in items]

    def _keep(self, item: int, found: list[tuple[int, object]]) -> None:
        """The highest scores; equal ones by ascending id, ids that are null last."""
        rows = self.best[item] + found
        rows.sort(key=lambda r: (-r[0], r[1] is None, r[1] if r[1] is not None else 0))
        self.best[item] = rows[:self.top]

    def add(self, ids: pa.Array, n: np.ndarray, held: np.ndarray, terms: np.ndarray, tfs: np.ndarray) -> None:
        m = lengths(n, self.documents, self.total)
        here, row = np.unique(terms, return_inverse=True)
        counts = np.zeros((len(here) + 1, len(n)), "i8")
        counts[row, np.repeat(np.arange(len(n)), held)] = tfs
        most = counts.max(axis=1, initial=0)
        for k, wanted in enumerate(self.items):
            at = np.searchsorted(here, wanted)
            at = at[(at < len(here)) & (here[np.minimum(at, max(len(here) - 1, 0))] == wanted)] if len(here) else at[:0]
            if not len(at):
                continue
            mine, w = counts[at], self.weights[here[at]]
            order, starts, masks = presence(mine > 0)
            shortest = np.minimum.reduceat(m[order], starts)
            ceiling = (masks * part(w[:, None], most[at][:, None], shortest[None, :])).sum(axis=0)
            ends = np.append(starts[1:], len(order))
            waiting, size = [], 0
            for g in np.argsort(-ceiling, kind="stable").tolist():
                # every document of this mask and of all later ones stays below the lowest of the best
                floor = self.best[k][-1][0] if len(self.best[k]) == self.top else 1
                if ceiling[g] < floor:
                    break
                waiting.append(order[starts[g]:ends[g]])
                size += len(waiting[-1])
                if size >= STEP:
                    self._evaluate(k, np.concatenate(waiting), mine, w, m, ids)
                    waiting, size = [], 0
            if waiting:
                self._evaluate(k, np.concatenate(waiting), mine, w, m, ids)

    def _evaluate(self, k: int, rows: np.ndarray, mine: np.ndarray, w: np.ndarray, m: np.ndarray, ids: pa.Array) -> None:
        score = part(w[:, None], mine[:, rows], m[rows][None, :]).sum(axis=0)
        floor = self.best[k][-1][0] if len(self.best[k]) == self.top else 1
        if len(rows) > self.top:
            floor = max(floor, int(np.partition(score, -self.top)[-self.top]))
        good = np.flatnonzero(score >= floor)
        self._keep(k, [(int(score[g]), ids[int(rows[g])].as_py()) for g in good.tolist()])


def _best(postings: DataFrame, items: list[np.ndarray], weights: np.ndarray, documents: int, total: int, top: int) -> DataFrame:
    """(item, id, score): at most ``top`` documents an item from each partition."""
    kind = StructType().add("item", IntegerType()).add(postings.schema["id"]).add("score", LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, id_type = Search(items, weights, documents, total, top), None
        step = min(DOCUMENTS, 1 + CELLS // (1 + len(weights)))
        for batch in batches:
            id_type = batch.column("id").type
            for at in range(0, batch.num_rows, step):
                b = batch.slice(at, step)
                terms, tfs = b.column("terms"), b.column("tfs")
                search.add(b.column("id"), b.column("n").to_numpy(), terms.value_lengths().to_numpy(), terms.flatten().to_numpy(),
                           tfs.flatten().to_numpy())
        rows = [(k, d, s) for k, best in enumerate(search.best) for s, d in best]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], id_type),
                                              pa.array([r[2] for r in rows], pa.int64())], ["item", "id", "score"])

    return postings.mapInArrow(run, kind)


def search(docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id",
           item_text: str = "text", top: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item, rank, id, score): the ``top`` documents of each item with a score above 0, best first.

    Equal scores go by ascending id, null ids last. Every row of ``docs`` is a
    document and every row of ``items`` an item, repeated rows and ids too
    (each repeated item is ranked on its own). Null and empty texts have no
    terms: such documents count for nothing, such items give no rows. Empty
    tables give an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    items = items.select(F.col(f"`{item}`").alias("item"), F.col(f"`{item_text}`").alias("text"))
    # an upper bound of the terms, by characters; a block holds about block_terms of them
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = 1 + size // (2 * block_terms)
    out = None
    for block in range(blocks):
        mine = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block)
        rows = sorted(mine.collect(), key=repr)  # bounded by the block
        wanted = [_counts(r.text)[1].keys() for r in rows]
        vocabulary = {t: k for k, t in enumerate(sorted(set().union(*wanted)))}
        postings = through_table(_postings(docs, vocabulary), "postings")
        totals = postings.agg(F.count(F.when(F.col("n") > 0, 1)), F.sum("n")).first()
        documents, total = totals[0], totals[1] or 0
        held = postings.select(F.explode("terms").alias("t")).groupBy("t").count().collect()  # one row per term of the block
        weights = np.zeros(len(vocabulary), "i8")
        for t, n in held:
            weights[t] = weight(documents, n)
        ids = [np.array(sorted(vocabulary[t] for t in w), "i4") for w in wanted]
        best = _best(postings, ids, weights, documents, total, top)
        kind = StructType([StructField("item_no", LongType()), items.schema["item"]])
        names = spark.createDataFrame([Row(k, r.item) for k, r in enumerate(rows)], kind)
        ranked = best.withColumn("rank", F.expr("row_number() OVER (PARTITION BY item ORDER BY score DESC, id ASC NULLS LAST)"))
        ranked = ranked.filter(F.col("rank") <= top).withColumnRenamed("item", "item_no").join(names, "item_no")
        ranked = ranked.select(F.col("item").alias(item), "rank", F.col("id").alias(id), "score")
        out = ranked if out is None else out.union(ranked)
    return out
