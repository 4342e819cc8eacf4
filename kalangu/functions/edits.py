"""Edit distances and alignments of long sequences, for batches of pairs.

One column of the distance table is one number: a bit per row says whether the
value grows or shrinks by one, and a column follows from the last by a dozen
operations on whole numbers. Only a band around the diagonals that join both
ends is kept; what it holds beyond them doubles until it holds the distance. An alignment sweeps the band once more,
keeps the columns of one stretch at a time, and walks back through them, so its
memory grows with the root of the length, not with the table.

A batch goes to ``blocks``, which takes many pairs at once; what is here is for
the pairs that are too long for it.
"""

from __future__ import annotations

import math
from collections.abc import Hashable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from kalangu.functions import blocks

#: rows of the first band beyond the diagonals that join both ends, at least
BAND = 64
#: symbols of pairs that are aligned without knowing their distance
SHORT = 256
#: bits of columns that are kept at once; longer pairs are swept in stretches
KEPT = 1 << 28


def _masks(ref: Sequence[Hashable]) -> dict[Hashable, int]:
    """The places of each symbol, as bits."""
    at: dict[Hashable, list[int]] = {}
    for i, x in enumerate(ref):
        at.setdefault(x, []).append(i)
    out = {}
    for x, places in at.items():
        bits = np.zeros(places[-1] // 8 + 1, "u1")
        np.bitwise_or.at(bits, np.array(places) >> 3, (1 << (np.array(places) & 7)).astype("u1"))
        out[x] = int.from_bytes(bits.tobytes(), "little")
    return out


def _first(low: int, width: int) -> tuple[int, int]:
    """Rows that grow and rows that shrink before the first column; bit t of column j is row j - low + t."""
    return (1 << width) - (1 << (low + 1)), 0


def _sweep(masks: dict, hyp: Sequence[Hashable], low: int, width: int, state: tuple[int, int], first: int, last: int) -> Iterator[tuple[int, int, int]]:
    """(diagonal steps that cost nothing, rows that grow, rows that shrink) after each column from ``first`` on."""
    full, top = (1 << width) - 1, 1 << (width - 1)
    up, down = state
    for j in range(first, last):
        up, down = (up >> 1) | top, down >> 1
        here = masks.get(hyp[j], 0)
        here = (here >> (j - low) if j >= low else here << (low - j)) & full
        equal = here | down
        free = (((up + (equal & up)) ^ up) | equal) & full
        right = ((down | (full & ~(up | free))) << 1) | 1
        down, up = right & free, (((up & free) << 1) | ~(right | free)) & full
        yield free, up, down


def _within(ref: Sequence, hyp: Sequence, masks: dict, spare: int) -> int:
    """The distance, or more than the difference of lengths and ``2 * spare``; ``ref`` is not the shorter one.

    A path that is more than ``spare`` beyond the diagonals of both ends costs more than that.
    """
    total = more = len(ref) - len(hyp)
    bit, width = 1 << (spare + more), 2 * spare + more + 1
    for free, _, _ in _sweep(masks, hyp, spare, width, _first(spare, width), 0, len(hyp)):
        if not free & bit:
            total += 1
            if total > more + 2 * spare:
                break
    return total


def distance(ref: Sequence[Hashable], hyp: Sequence[Hashable], limit: int | None = None) -> int:
    """Levenshtein distance; with ``limit``, any number above it for a larger one."""
    # equal ends cost nothing
    n, m = len(ref), len(hyp)
    first = next((k for k in range(min(n, m)) if ref[k] != hyp[k]), min(n, m))
    last = next((k for k in range(min(n, m) - first) if ref[n - 1 - k] != hyp[m - 1 - k]), min(n, m) - first)
    ref, hyp = ref[first:n - last], hyp[first:m - last]
    if len(ref) < len(hyp):
        ref, hyp = hyp, ref
    longest, more = len(ref), len(ref) - len(hyp)
    if not hyp or more > (longest if limit is None else limit):
        return longest
    limit = longest if limit is None else min(limit, longest)
    masks, spare = _masks(ref), max(BAND, longest // 32)
    while True:
        spare = min(spare, max((limit - more + 1) // 2, 1))
        found = _within(ref, hyp, masks, spare)
        if found <= more + 2 * spare or more + 2 * spare >= limit:
            return found
        spare *= 2


def align(ref: Sequence[Hashable], hyp: Sequence[Hashable], matched: list[tuple[int, int]] | None = None) -> tuple[int, int, int, int]:
    """Hits, substitutions, deletions and insertions of the chosen alignment.

    Among equal distances a match or substitution is preferred to a deletion
    and a deletion to an insertion, from the end backwards. ``matched`` takes
    the places of the hits.
    """
    i, j, hits, subs = len(ref), len(hyp), 0, 0
    # the end of both always matches
    while i and j and ref[i - 1] == hyp[j - 1]:
        i, j, hits = i - 1, j - 1, hits + 1
        if matched is not None:
            matched.append((i, j))
    rows, columns, dels, adds = i, j, 0, 0
    if i and j:
        masks = _masks(ref[:i])
        # every cell of a best path lies within
        spare = min(i, j) if max(i, j) <= SHORT else (distance(ref[:i], hyp[:j]) - abs(i - j)) // 2 + 1
        low = spare + max(0, j - i)
        wide = low + max(0, i - j) + spare + 1
        stretch = columns if 2 * wide * j <= KEPT else max(1, math.isqrt(columns))
        starts = [_first(low, wide)]
        if stretch < columns:
            for n, (_, up, down) in enumerate(_sweep(masks, hyp, low, wide, starts[0], 0, columns), 1):
                if n % stretch == 0:
                    starts.append((up, down))
        held, base = [], columns
        while i and j:
            if j <= base:
                base = (j - 1) // stretch * stretch
                held = list(_sweep(masks, hyp, low, wide, starts[base // stretch], base, j))
            if ref[i - 1] == hyp[j - 1]:
                i, j, hits = i - 1, j - 1, hits + 1
                if matched is not None:
                    matched.append((i, j))
                continue
            free, up, _ = held[j - base - 1]
            bit = 1 << (i - j + low)
            if not free & bit:
                i, j, subs = i - 1, j - 1, subs + 1
            elif up & bit:
                i, dels = i - 1, dels + 1
            else:
                j, adds = j - 1, adds + 1
    return hits, subs, dels + i, adds + j


def pairs(ref: pa.Array, hyp: pa.Array) -> Iterator[tuple[Sequence, Sequence]]:
    """A pair at a time, so that one long pair is in memory, not a batch of them; null is empty."""
    for r, h in zip(ref, hyp):
        yield r.as_py() or "", h.as_py() or ""


def batch_distances(ref: pa.Array, hyp: pa.Array, limit: pa.Array | None = None) -> pa.Array:
    """Distances of all pairs of a batch; only very long ones are computed one at a time, up to ``limit``."""
    found, long = blocks.distances(ref, hyp)
    for k in long:
        found[k] = distance(ref[int(k)].as_py(), hyp[int(k)].as_py(), None if limit is None else limit[int(k)].as_py())
    return pa.array(found, pa.int32())


def batch_alignments(ref: pa.Array, hyp: pa.Array) -> list[pa.Array]:
    """Hits, substitutions, deletions and insertions of all pairs of a batch, as :func:`align` counts them."""
    found, long = blocks.alignments(ref, hyp)
    for k in long:
        found[k] = align(ref[int(k)].as_py(), hyp[int(k)].as_py())
    return [pa.array(found[:, k], pa.int32()) for k in range(4)]


@F.arrow_udf(IntegerType())
def _errors(ref: pa.Array, hyp: pa.Array) -> pa.Array:
    return batch_distances(ref, hyp)


@F.arrow_udf(IntegerType())
def _errors_up_to(ref: pa.Array, hyp: pa.Array, limit: pa.Array) -> pa.Array:
    return batch_distances(ref, hyp, limit)


def errors(ref: Column, hyp: Column, limit: Column | None = None) -> Column:
    """Edit distance of two texts or two arrays, null as empty; one above ``limit`` is any number above it.

    Equal pairs are not sent to Python.
    """
    differ = ~ref.eqNullSafe(hyp)
    sides = F.when(differ, ref), F.when(differ, hyp)
    return _errors(*sides) if limit is None else _errors_up_to(*sides, limit.cast("int"))
