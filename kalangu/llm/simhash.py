"""Near-duplicates by SimHash: fingerprints, fuzzy keys from a Golay code, links and their components.

A fingerprint of 64 bits is cut into segments of 22, 21 and 21 bits. If two
fingerprints differ in at most four bits, then by the pigeonhole principle
either a segment is equal, or at least two segments differ in exactly one bit.

- An equal segment is a key as it stands.
- For the other case every segment is read as a word of the perfect binary
  Golay code (23, 12). Each word lies within three bits of exactly one
  codeword, its own, and within four bits of one or six. The own codeword of x
  is within four bits of every word that differs from x in one bit. So one
  side is indexed by the own codewords of two segments (3 keys), the other
  looks up all near codewords of two segments (84 keys at most), and no pair
  is missed.

Candidates are compared bit by bit inside the join; only links leave it. Links
from the members of an equal-segment group to its smallest member come first,
and their components are known to the join, which passes over pairs that are
connected already: a large group of near copies gives few links, not all pairs.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from kalangu.llm.components import components
from kalangu.session import through_table

DISTANCE = 4
SHINGLE = 4
SEED = 42
WIDTHS = (22, 21, 21)
STARTS = (42, 21, 0)
#: generator polynomial of the binary Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
GOLAY = 0b110001110101
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _fingerprints(texts: list[str | None], size: int) -> np.ndarray:
    from xxhash import xxh64_intdigest as digest

    out = np.zeros(len(texts), "<u8")
    for row, text in enumerate(texts):
        words = (text or "").encode().translate(_LOWER).split()
        if not words:
            continue
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), "i8", len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        n = max(1, len(words) - size + 1)
        spans = zip(starts[:n].tolist(), ends[-n:].tolist())
        hashes = np.fromiter((digest(joined[s:e], SEED) for s, e in spans), "<u8", n)
        counts = np.zeros(64, "i8")
        for k in range(0, n, 1 << 18):
            part = hashes[k:k + (1 << 18)].view("u1").reshape(-1, 8)
            counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype="i4")
        out[row] = np.packbits((2 * counts > n).astype("u1"), bitorder="little").view("<u8")[0]
    return out


def fingerprint(text: Column, size: int = SHINGLE) -> Column:
    """64-bit SimHash over the XXH64 values of word shingles, as bigint.

    A-Z become lower case; words are runs without ASCII white space; repeated
    shingles count each time; a text of fewer words is one shingle; null or no
    word gives zero.
    """
    @F.arrow_udf("bigint")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(_fingerprints(texts.to_pylist(), size).view("i8"))

    return run(text)


@lru_cache(maxsize=1)
def _golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Remainders of the high 12 and the low 11 bits; per remainder the error patterns of weight <= 4, lightest first."""
    def remainder(word: int) -> int:
        for shift in range(11, -1, -1):
            if word >> (shift + 11) & 1:
                word ^= GOLAY << shift
        return word

    high = np.array([remainder(x << 11) for x in range(1 << 12)], "i4")
    patterns = np.full((1 << 11, 6), -1, "i4")
    held = [0] * (1 << 11)
    unit = [remainder(1 << k) for k in range(23)]
    for weight in range(5):
        for bits in combinations(range(23), weight):
            r = 0
            for k in bits:
                r ^= unit[k]
            if weight < 4 or held[r] == 0 or patterns[r, 0].bit_count() == 3:
                patterns[r, held[r]] = sum(1 << k for k in bits)
                held[r] += 1
    return high, np.arange(1 << 11, dtype="i4"), patterns


def near_codewords(words: np.ndarray) -> np.ndarray:
    """Indices (12 bits) of the codewords within four bits of each 23-bit word, its own first; -1 where there is none."""
    high, low, patterns = _golay()
    errors = patterns[high[words >> 11] ^ low[words & 0x7FF]]
    return np.where(errors < 0, -1, (words[:, None] ^ errors) >> 11)


def _keys(prints: np.ndarray, probe: bool) -> pa.Array:
    segments = [((prints >> np.uint64(s)) & np.uint64((1 << w) - 1)).astype("i4") for s, w in zip(STARTS, WIDTHS)]
    near = [near_codewords(x) if probe else near_codewords(x)[:, :1] for x in segments]
    columns = [((np.int64(k) << 40) | x)[:, None] for k, x in enumerate(segments)]
    for k, (i, j) in enumerate(combinations(range(3), 2)):
        a, b = near[i][:, :, None].astype("i8"), near[j][:, None, :].astype("i8")
        columns.append(np.where((a < 0) | (b < 0), -1, (np.int64(3 + k) << 40) | (a << 12) | b).reshape(len(prints), -1))
    table = np.concatenate(columns, axis=1)
    there = table >= 0
    return pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(there.sum(axis=1)))).astype("i4"), pa.array(table[there]))


@F.arrow_udf(ArrayType(LongType()))
def index_keys(prints: pa.Array) -> pa.Array:
    return _keys(prints.to_numpy(zero_copy_only=False).view("u8"), False)


@F.arrow_udf(ArrayType(LongType()))
def probe_keys(prints: pa.Array) -> pa.Array:
    return _keys(prints.to_numpy(zero_copy_only=False).view("u8"), True)


def _differ(a: str, b: str, segment: int | None = None) -> Column:
    x = F.col(a).bitwiseXOR(F.col(b))
    if segment is not None:
        x = x.bitwiseAND(F.lit(((1 << WIDTHS[segment]) - 1) << STARTS[segment] if STARTS[segment] + WIDTHS[segment] < 64
                               else -(1 << STARTS[segment])))
    return F.bit_count(x)


def links(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(a, b): enough of the links among the distinct values of ``fp`` to give all components.

    Spark sizes a table of exploded keys as if every row had one of them, up to
    87 times too low, so these joins say that they are no broadcast joins.
    """
    if not 0 <= distance <= 4:
        raise ValueError("the keys hold for distances of 0 to 4 bits")
    exact = prints.select("fp", F.explode(F.slice(index_keys("fp"), 1, 3)).alias("key"))
    least = exact.groupBy("key").agg(F.min("fp").alias("least"))
    stars = exact.join(least.hint("merge"), "key").filter((F.col("fp") != F.col("least")) & (_differ("fp", "least") <= distance))
    stars = through_table(stars.select(F.col("fp").alias("a"), F.col("least").alias("b")).distinct(), "stars")
    known = prints.join(components(stars), F.col("fp") == F.col("node"), "left").select(
        "fp", F.coalesce("root", "fp").alias("root"))
    known = through_table(known, "known")
    x = known.select(F.col("fp").alias("a"), F.col("root").alias("ra"), F.explode(index_keys("fp")).alias("key"))
    y = known.select(F.col("fp").alias("b"), F.col("root").alias("rb"), F.explode(probe_keys("fp")).alias("kb"))
    cross = x.join(y.hint("merge"), (F.col("key") == F.col("kb")) & (F.col("ra") != F.col("rb")) & (F.col("a") < F.col("b"))
                   & (_differ("a", "b") <= distance))
    return stars.union(cross.select("a", "b"))


def near_duplicates(df: DataFrame, id: str = "doc_id", text: str = "text", distance: int = DISTANCE,
                    size: int = SHINGLE) -> DataFrame:
    """One row per row of ``df``: ``id``, ``fingerprint`` (16 hex digits), ``component_id``.

    ``component_id`` is the smallest id reachable over links between
    fingerprints that differ in at most ``distance`` bits; equal fingerprints
    are linked, those of empty and null texts (zero) among them. Null ids keep
    their row and never count as smallest; a component of null ids only has a
    null component_id. Repeated ids or rows give as many rows. Other columns of
    ``df`` are not read. An empty table gives an empty result.
    """
    docs = through_table(df.select(F.col(f"`{id}`").alias("id"), fingerprint(F.col(f"`{text}`"), size).alias("fp")), "prints")
    least = through_table(docs.groupBy("fp").agg(F.min("id").alias("least")), "least")
    roots = components(links(least.select("fp"), distance))
    placed = least.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = placed.join(smallest, "root").select("fp", "component_id")
    return docs.join(named, "fp").select(F.col("id").alias(id), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                                         "component_id")


def keep_one(df: DataFrame, id: str = "doc_id", text: str = "text", distance: int = DISTANCE) -> DataFrame:
    """``df`` with one row of each near-duplicate group: that of the smallest id.

    Rows without an id are kept if their group has no id at all; a repeated
    smallest id keeps each of its rows.
    """
    groups = near_duplicates(df, id, text, distance)
    gone = groups.filter(F.col(id) != F.col("component_id")).select(F.col(id).alias("__gone")).distinct()
    return df.join(gone, F.col(f"`{id}`") == F.col("__gone"), "left_anti")
