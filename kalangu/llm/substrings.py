"""Substring deduplication by difference-cover anchors.

A window of 13 words that also starts in a document of a smaller id is removed.
Positions p with p mod 7 in {0, 1, 3} are a difference cover: for any two
positions i and j there is a t in 0..6 such that i + t and j + t are both cover
positions. So two equal windows of 13 words hold an equal run of 7 words that
starts at a cover position in both (7 + 7 - 1 = 13): an aligned anchor. Only
anchors are hashed and compared over the corpus, three in seven positions.

1. Texts whose words equal those of a smaller id go as a whole (if they have a
   window); the first of them stands for all.
2. Anchors of the others meet by hash, each once per document; those found in
   more than one document stay.
3. They are extended: every window that holds such an anchor is hashed as a
   whole, to 128 bits, meets by that hash, and goes if a smaller id has it.
   Back to its document, where it is told from that document's other windows
   only, it goes by 64 of them.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from kalangu.session import through_table

SPAN = 13
PERIOD = 7
COVER = (0, 1, 3)
ANCHOR = SPAN - PERIOD + 1
#: bytes of a text that are hashed at a time
BLOCK = 1 << 22
#: anchors need to be found, not told apart for good: fewer bits to move
ANCHOR_BITS = 40
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SPACE_AT = re.compile(rb"[\x09-\x0D\x20]")


def words_of(text: str | None) -> list[bytes]:
    """Runs without ASCII white space."""
    return (text or "").encode().split()


_BASES = (0xD6E8FEB86659FD93, 0x9E3779B97F4A7C15)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse modulo 2 ** 64, from 0 to at least n."""
    if which not in _powers or len(_powers[which][0]) <= n:
        both = []
        for b in (_BASES[which], pow(_BASES[which], -1, 1 << 64)):
            steps = np.full(1 << (n + 1).bit_length(), b, "u8")
            steps[0] = 1
            both.append(np.multiply.accumulate(steps))
        _powers[which] = tuple(both)
    return _powers[which]


def _word_hashes(text: str | None) -> np.ndarray:
    """128 bits of XXH3 for each word, in two columns."""
    from xxhash import xxh3_128_digest as digest

    raw, out, at = (text or "").encode(), [], 0
    while at < len(raw):
        end = at + BLOCK
        if end < len(raw):  # a block ends where a word does
            later = _SPACE_AT.search(raw, end)
            end = later.start() if later else len(raw)
        out.append(np.frombuffer(b"".join(map(digest, raw[at:end].split())), "<u8").reshape(-1, 2))
        at = end
    return np.concatenate(out) if out else np.empty((0, 2), "u8")


def runs(words: np.ndarray, length: int, which: int = 0) -> np.ndarray:
    """64 bits for each run of ``length`` hashed words, by its start: differences of one running sum.

    The words are hashed well and the runs are short, so no text can be made
    whose runs collide. Both columns of the words together give 128 bits.
    """
    n = len(words) - length + 1
    if n <= 0:
        return np.empty(0, "u8")
    power, inverse = _power(len(words), which)
    total = np.concatenate((np.zeros(1, "u8"), np.cumsum(words[:, which] * power[:len(words)], dtype="u8")))
    h = (total[length:] - total[:-length]) * inverse[:n]
    h = (h ^ (h >> np.uint64(29))) * _ODD
    return h ^ (h >> np.uint64(31))


def _cover(n: int) -> np.ndarray:
    places = (np.arange(0, n, PERIOD)[:, None] + np.array(COVER)).ravel()
    return places[places < n]


def _lists(rows: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype("i4"),
                                    pa.array(np.concatenate(rows) if rows else np.empty(0), kind))


_WHOLE = StructType([StructField("n", IntegerType()), StructField("h1", LongType()), StructField("h2", LongType())])


@F.arrow_udf(_WHOLE)
def _whole(texts: pa.Array) -> pa.Array:
    """Number of words, and 128 bits of hash over all of them."""
    from xxhash import xxh3_128_intdigest

    n, digests = [], []
    for text in texts.to_pylist():
        words = words_of(text)
        n.append(len(words))
        digests.append(xxh3_128_intdigest(b" ".join(words)))
    halves = np.array([[d >> 64, d & 0xFFFFFFFFFFFFFFFF] for d in digests], "u8").reshape(-1, 2)
    return pa.StructArray.from_arrays([pa.array(n, pa.int32()), pa.array(halves[:, 0].view("i8") if halves.size else [], pa.int64()),
                                       pa.array(np.ascontiguousarray(halves[:, 1]).view("i8"), pa.int64())], ["n", "h1", "h2"])


def _anchor_hashes(words: np.ndarray) -> np.ndarray:
    """Hashes of the anchors of a text that has a window, in order of position."""
    found = runs(words, ANCHOR) if len(words) >= SPAN else np.empty(0, "u8")
    return (found[_cover(len(found))] >> np.uint64(64 - ANCHOR_BITS)).view("i8")


@F.arrow_udf(ArrayType(LongType()))
def _anchors(texts: pa.Array) -> pa.Array:
    """The different anchors of each text."""
    return _lists([np.unique(_anchor_hashes(_word_hashes(t.as_py()))) for t in texts], pa.int64())


_RUN = StructType([StructField("a", LongType()), StructField("b", LongType())])


@F.arrow_udf(ArrayType(_RUN))
def _windows(texts: pa.Array, anchors: pa.Array) -> pa.Array:
    """The different windows of each text that hold one of the given anchors, 128 bits each."""
    rows = []
    for text, some in zip(texts, anchors):
        words = _word_hashes(text.as_py()) if some.is_valid else np.empty((0, 2), "u8")
        n = len(words) - SPAN + 1
        if n < 1:
            rows.append(np.empty((0, 2), "i8"))
            continue
        places = _cover(len(words) - ANCHOR + 1)
        places = places[np.isin(_anchor_hashes(words), some.values.to_numpy())]
        wanted = np.zeros(n, bool)
        for t in range(PERIOD):
            at = places - t
            wanted[at[(at >= 0) & (at < n)]] = True
        found = np.stack([runs(words, SPAN, k)[wanted].view("i8") for k in (0, 1)], axis=1)
        found = found[np.lexsort(found.T)]
        rows.append(found[np.concatenate(([True], (found[1:] != found[:-1]).any(axis=1)))[:len(found)]])
    both = np.concatenate([np.empty((0, 2), "i8"), *rows])
    values = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(both[:, k])) for k in (0, 1)], ["a", "b"])
    return pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype("i4"), values)


def _removed(text: str | None, n: int, hashes: pa.Scalar, whole: bool) -> np.ndarray:
    """Which words go: all, or those in a window of one of the given hashes, by their first 64 bits."""
    gone = np.full(n, whole)
    if hashes.is_valid and not whole:
        found = runs(_word_hashes(text), SPAN).view("i8")
        for at in np.flatnonzero(np.isin(found, hashes.values.to_numpy())).tolist():
            gone[at:at + SPAN] = True
    return gone


def _met(rows: DataFrame) -> DataFrame:
    """(id, hash, low) of the rows whose hash comes more than once; ``low`` is the smallest id that has it.

    Count and smallest id are aggregated before and after the shuffle, and the
    join back is a plain equi-join of rows with one row per hash, so a hash
    that many documents share is split like any skewed join key.
    """
    often = rows.groupBy("hash").agg(F.min("id").alias("low"), F.count("*").alias("n")).filter("n > 1")
    return rows.join(often.drop("n"), "hash")


def covered(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, hashes, whole): documents that lose words, with the windows they lose, or all words."""
    rows = docs.filter(F.col(f"`{id}`").isNotNull()).select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    sizes = through_table(rows.select("id", _whole("text").alias("w")).select("id", "w.*").filter(F.col("n") >= SPAN), "sizes")
    first = sizes.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.count("*").alias("copies")).filter("copies > 1")
    copies = sizes.join(first, ["h1", "h2"]).filter(F.col("id") > F.col("first")).select("id")
    # rows that share an id may differ: they go by their windows
    copies = copies.join(rows.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1"), "id", "left_anti")
    copies = through_table(copies, "copies")
    single = rows.join(copies, "id", "left_anti")
    anchors = _met(single.select("id", F.explode(_anchors("text")).alias("hash")))
    shared = through_table(anchors.groupBy(F.col("id").alias("__id")).agg(F.collect_list("hash").alias("anchors")), "anchors")
    texts = single.join(shared, F.col("id") == F.col("__id"))
    found = texts.select("id", F.explode(_windows(F.col("text"), F.col("anchors"))).alias("hash"))
    gone = (_met(through_table(found, "windows")).filter(F.col("low") < F.col("id"))
            .groupBy("id").agg(F.collect_list("hash.a").alias("hashes")))
    return gone.select("id", "hashes", F.lit(False).alias("whole")).union(
        copies.select("id", F.lit(None).cast(ArrayType(LongType())), F.lit(True)))


def deduplicate(docs: DataFrame, id: str = "doc_id", text: str = "text", out: str = "deduplicated") -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed`` and ``out``, the kept words joined by one space.

    Documents are told apart by id: rows of one id are one document each, and
    none of them removes words of another; a null id neither removes nor loses
    words. Windows within one document never count. Null, empty and short texts
    lose nothing. Every row gives one row; other columns pass through, those
    named like an output are replaced; an empty table gives an empty result.
    """
    gone = covered(docs, id, text).select(F.col("id").alias("__id"), F.col("hashes").alias("__hashes"), F.col("whole").alias("__whole"))

    @F.arrow_udf("struct<n_words:bigint,n_removed:bigint,kept:string>")
    def keep(texts: pa.Array, hashes: pa.Array, whole: pa.Array) -> pa.Array:
        sizes, removed, kept = [], [], []
        for t, h, w in zip(texts.to_pylist(), hashes, whole.to_pylist()):
            words = words_of(t)
            lost = _removed(t, len(words), h, bool(w))
            sizes.append(len(words))
            removed.append(int(lost.sum()))
            kept.append((b" ".join(words[k] for k in np.flatnonzero(~lost)) if removed[-1] else b" ".join(words)).decode())
        return pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                                          ["n_words", "n_removed", "kept"])

    joined = docs.join(gone, F.col(f"`{id}`") == F.col("__id"), "left")
    return (joined.withColumn("__kept", keep(F.col(f"`{text}`"), "__hashes", "__whole"))
            .withColumns({"n_words": F.col("__kept.n_words"), "n_removed": F.col("__kept.n_removed"), out: F.col("__kept.kept")})
            .drop("__id", "__hashes", "__whole", "__kept"))
