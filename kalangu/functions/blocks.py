"""Edit distances and alignments of many pairs at once.

The columns of ``edits`` in words of 64 bits, for a group of pairs side by
side. Block b of a pair is at column t - b in step t, so all blocks of all
pairs of a group move together and take what the block above carried out in
the step before. Groups hold pairs of like numbers of blocks and lengths; longer
pairs are left to ``edits``, whose band follows the distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: symbols that are coded at a time, words of 64 bits a step, bytes of kept columns of a group
SYMBOLS, CELLS, KEPT = 1 << 22, 1 << 13, 1 << 26
#: blocks of the longest texts that are compared and aligned here
COMPARED, ALIGNED = 16, 32
_ONE, _TOP = np.uint64(1), np.uint64(63)


def _lengths(a: pa.Array) -> np.ndarray:
    size = pc.list_value_length(a) if pa.types.is_list(a.type) else pc.utf8_length(a)
    return pc.fill_null(size, 0).to_numpy(zero_copy_only=False).astype("i8")


def _codes(ref: pa.Array, hyp: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers for the symbols of both, all rows in one."""
    if pa.types.is_list(ref.type):
        both = pa.concat_arrays([ref.flatten(), hyp.flatten()]).dictionary_encode("encode").indices
        both, split = both.to_numpy(zero_copy_only=False).astype("i8"), len(ref.flatten())
    else:
        points = [np.frombuffer("".join(pc.fill_null(a, "").to_pylist()).encode("utf-32-le"), "u4") for a in (ref, hyp)]
        both, split = np.concatenate(points), len(points[0])
        seen = np.zeros(int(both.max()) + 1 if len(both) else 1, "i8")
        seen[both] = 1
        both = (np.cumsum(seen) - 1)[both]
    return both[:split], both[split:]


def _table(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, width: int, fill: int) -> np.ndarray:
    """One row of ``width`` symbols for each pair."""
    at = np.arange(width)
    return np.where(at < sizes[:, None], codes[np.minimum(starts[:, None] + at, max(len(codes) - 1, 0))], fill)


def _groups(n: np.ndarray, m: np.ndarray, most: int, kept: bool) -> Iterator[np.ndarray]:
    """Rows that go side by side: like numbers of blocks, like lengths."""
    blocks = (n + 63) // 64
    # the same number up to four, then steps of a quarter
    like = np.where(blocks < 5, blocks, 4 + np.log(np.maximum(blocks, 4) / 4) / np.log(1.25)).astype("i8")
    rows = np.flatnonzero((n > 0) & (m > 0) & (blocks <= most))
    rows = rows[np.lexsort((m[rows], like[rows]))]
    first = 0
    while first < len(rows):
        last = first + int(np.searchsorted(like[rows[first:]], like[rows[first]], "right"))
        last = first + int(np.searchsorted(m[rows[first:last]], m[rows[first]] * 5 // 4 + 8, "right"))
        w = int(blocks[rows[first:last]].max())
        last = min(last, first + max(1, CELLS // w))
        if kept:
            last = min(last, first + max(1, KEPT // (16 * w * (int(m[rows[last - 1]]) + w))))
        yield rows[first:last]
        first = last


def _places(r: np.ndarray, h: np.ndarray, n: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Bits of the places of each symbol in each block, and which of them a column of ``h`` asks for."""
    pairs, most = len(r), int(max(r.max(), h.max())) + 1
    row = np.arange(pairs)[:, None]
    at = np.broadcast_to(np.arange(r.shape[1]), r.shape)
    real = at < n[:, None]
    asked, held = row * most + np.maximum(h, 0), (row * most + np.maximum(r, 0))[real]
    if pairs * most * w > 1 << 20:
        known, held = np.unique(held, return_inverse=True)
        found = np.minimum(np.searchsorted(known, asked), len(known) - 1)
        asked, size = np.where(known[found] == asked, found, len(known)), len(known) + 1
    else:
        size = pairs * most + 1
    asked = np.where(h < 0, size - 1, asked)
    bits = np.zeros(w * size, "u8")
    np.bitwise_or.at(bits, (at[real] >> 6) * size + held, _ONE << (at[real] & 63).astype("u8"))
    return bits, asked.astype("i8"), size


def _sweep(r: np.ndarray, h: np.ndarray, n: np.ndarray, m: np.ndarray, keep: bool) -> tuple[np.ndarray, np.ndarray | None, np.ndarray | None]:
    """Distances of the pairs of a group; with ``keep`` also (free, up) of step, block and pair."""
    pairs, longest, w = len(r), h.shape[1], int(n.max() + 63) // 64
    bits, asked, size = _places(r, h, n, w)
    # columns backwards, so that the blocks of a step ask for a slice
    columns = np.full((longest + 2 * (w - 1), pairs), size - 1)
    columns[w - 1:w - 1 + longest] = asked.T[::-1]
    block = (np.arange(w) * size)[:, None]
    steps = longest + w - 1
    up, down = np.full((w, pairs), ~np.uint64(0)), np.zeros((w, pairs), "u8")
    # what a block takes from the one above it
    more, less = np.zeros((w + 1, pairs), "u8"), np.zeros((w + 1, pairs), "u8")
    more[0] = 1
    total, end, final, pair = n.copy(), ((n - 1) & 63).astype("u8"), (n - 1) >> 6, np.arange(pairs)
    soonest = int(final.min())
    kept = [np.zeros((steps, w, pairs), "u8") for _ in range(2)] if keep else [None, None]
    for t in range(steps):
        b = min(w, t + 1)  # blocks that have begun
        first = longest + w - 2 - t
        x = bits[columns[first:first + b] + block[:b]]
        u, d, p, q = up[:b], down[:b], more[:b], less[:b]
        x |= q
        free = x & u
        free += u
        free ^= u
        free |= x
        free |= d
        grows = free | u
        np.invert(grows, out=grows)
        grows |= d
        shrinks = free & u
        if t >= soonest:
            counted = (final <= t) & (t - final < m)
            at = np.minimum(final, b - 1), pair
            total += np.where(counted, ((grows[at] >> end) & _ONE).astype("i8") - ((shrinks[at] >> end) & _ONE).astype("i8"), 0)
        out_more, out_less = grows >> _TOP, shrinks >> _TOP
        grows <<= _ONE
        grows |= p
        shrinks <<= _ONE
        shrinks |= q
        np.bitwise_and(grows, free, out=d)
        np.bitwise_or(free, grows, out=u)
        np.invert(u, out=u)
        u |= shrinks
        more[1:b + 1], less[1:b + 1] = out_more, out_less
        if keep:
            kept[0][t, :b], kept[1][t, :b] = free, u
    return total, *kept


def _walk(r: np.ndarray, h: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Hits, substitutions, deletions, insertions of the alignment that ``edits.align`` chooses."""
    _, free, up = _sweep(r, h, n, m, True)
    counts, row, i, j = np.zeros((len(r), 4), "i4"), np.arange(len(r)), n - 1, m - 1
    while len(row):
        step, block, bit = j + (i >> 6), i >> 6, (i & 63).astype("u8")
        hit = r[row, i] == h[row, j]
        costs = (free[step, block, row] >> bit) & _ONE == 0
        drop = (up[step, block, row] >> bit) & _ONE == 1
        move = np.where(hit, 0, np.where(costs, 1, np.where(drop, 2, 3)))
        counts[row, move] += 1
        i, j = i - (move != 3), j - (move != 2)
        done = (i < 0) | (j < 0)
        counts[row[done], 2] += (i[done] + 1).astype("i4")
        counts[row[done], 3] += (j[done] + 1).astype("i4")
        row, i, j = row[~done], i[~done], j[~done]
    return counts


def _solve(ref: pa.Array, hyp: pa.Array, most: int, kept: bool, run) -> tuple[np.ndarray, np.ndarray, list]:
    """(lengths of ref, of hyp, [(rows, result)]) with ``run`` over the groups."""
    n, m, results = _lengths(ref), _lengths(hyp), []
    ends = np.cumsum(n + m)
    first = 0
    while first < len(n):
        # rows whose symbols are coded together, at least one
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + SYMBOLS, "right")))
        a, b = n[first:last], m[first:last]
        if ((a > 0) & (b > 0) & (a <= 64 * most)).any():
            codes = _codes(ref.slice(first, last - first), hyp.slice(first, last - first))
            starts = np.cumsum(a) - a, np.cumsum(b) - b
            for rows in _groups(a, b, most, kept):
                x, y = a[rows], b[rows]
                r = _table(codes[0], starts[0][rows], x, int(x.max()), -1)
                h = _table(codes[1], starts[1][rows], y, int(y.max()), -1)
                results.append((rows + first, run(r, h, x, y)))
        first = last
    return n, m, results


def distances(ref: pa.Array, hyp: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Levenshtein distances of two arrays of texts or lists, null as empty, and the rows that are too long for it."""
    n, m, results = _solve(ref, hyp, COMPARED, False, lambda *group: _sweep(*group, False)[0])
    out = np.maximum(n, m)
    for rows, found in results:
        out[rows] = found
    return out, np.flatnonzero((m > 0) & (n > 64 * COMPARED))


def alignments(ref: pa.Array, hyp: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hits, substitutions, deletions, insertions of each pair, and the rows that are too long for it."""
    n, m, results = _solve(ref, hyp, ALIGNED, True, _walk)
    out = np.stack([np.zeros(len(n), "i8"), np.zeros(len(n), "i8"), np.where(m == 0, n, 0), np.where(n == 0, m, 0)], 1)
    for rows, found in results:
        out[rows] = found
    return out, np.flatnonzero((m > 0) & (n > 64 * ALIGNED))
