"""Document fingerprints as invertible Bloom lookup sketches of paragraph digests.

A text is cut into paragraphs (lines, and within them sentences of at most
``PIECE`` bytes, so that long paragraphs differ in part only). Each piece has a
64-bit digest; equal pieces of one text count as different ones by number. A
sketch adds every digest into one cell of each of three groups: a count, a sum
of digests and a sum of check values. Two sketches of a size subtract cell by
cell; then cells that hold a single digest are peeled until none is left, which
recovers the digests that only one text has. If peeling stops early, the pair
is sketched again with four times as many cells. With the numbers of pieces
known, the likeness of two texts is shared / all pieces.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECE = 32
CELLS = 12
GROUPS = 3
_PIECES = re.compile(rb"[^.!?\n]{1,%d}[.!?]*|[.!?]+" % PIECE)
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], "u8")
#: pairs that are sketched side by side
TOGETHER = 512
#: documents to a bucket of neighbours, and the most buckets
BUCKET, MOST_BUCKETS = 2_000, 50_000


def digests(text: str | None) -> np.ndarray:
    """Distinct 64-bit digests of the pieces of a text; null has none."""
    from xxhash import xxh64_intdigest as digest

    pieces = [p for p in map(bytes.strip, _PIECES.findall((text or "").encode())) if p]
    if len(set(pieces)) < len(pieces):
        seen: dict[bytes, int] = {}
        values = []
        for p in pieces:
            k = seen[p] = seen.get(p, -1) + 1
            values.append(digest(p, k))
        return np.array(values, "u8")
    return np.fromiter(map(digest, pieces), "u8", len(pieces))


def _mixed(x: np.ndarray, k: int) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX[k]
    return x ^ (x >> np.uint64(29))


def _cells(values: np.ndarray, cells: int) -> list[np.ndarray]:
    """The cell of each value in each group."""
    part = cells // GROUPS
    return [(_mixed(values, k) >> np.uint64(20)) % np.uint64(part) + np.uint64(k * part) for k in range(GROUPS)]


def sketch(values: list[np.ndarray], cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, digest sums and check sums, one row of cells per set of digests."""
    owner = np.repeat(np.arange(len(values), dtype="u8"), [len(v) for v in values])
    flat = np.concatenate(values) if values else np.empty(0, "u8")
    count, total, check = np.zeros(len(values) * cells, "i8"), np.zeros(len(values) * cells, "u8"), np.zeros(len(values) * cells, "u8")
    for cell in _cells(flat, cells):
        at = (owner * np.uint64(cells) + cell).astype("i8")
        count += np.bincount(at, minlength=len(count))
        np.add.at(total, at, flat)
        np.add.at(check, at, _mixed(flat, 3))
    return tuple(x.reshape(len(values), cells) for x in (count, total, check))


def peel(count: np.ndarray, total: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row of subtracted sketches: digests on the left only, on the right only, and whether all was recovered."""
    rows, cells = count.shape
    left, right = np.zeros(rows, "i8"), np.zeros(rows, "i8")
    count, total, check = count.ravel().copy(), total.ravel().copy(), check.ravel().copy()
    todo = np.flatnonzero(np.abs(count) == 1)
    while todo.size:
        sign = count[todo]
        value = np.where(sign > 0, total[todo], np.uint64(0) - total[todo])
        pure = (np.abs(sign) == 1) & (np.where(sign > 0, check[todo], np.uint64(0) - check[todo]) == _mixed(value, 3))
        todo, sign, value = todo[pure], sign[pure], value[pure]
        if not todo.size:
            break
        row = todo // cells
        # one digest may be alone in several of its cells
        _, first = np.unique(np.stack([row.astype("u8"), value]), axis=1, return_index=True)
        row, sign, value = row[first], sign[first], value[first]
        left += np.bincount(row[sign > 0], minlength=rows)
        right += np.bincount(row[sign < 0], minlength=rows)
        touched = []
        for cell in _cells(value, cells):
            at = row * cells + cell.astype("i8")
            np.subtract.at(count, at, sign)
            np.subtract.at(total, at, np.where(sign > 0, value, np.uint64(0) - value))
            np.subtract.at(check, at, np.where(sign > 0, _mixed(value, 3), np.uint64(0) - _mixed(value, 3)))
            touched.append(at)
        todo = np.unique(np.concatenate(touched))
        todo = todo[np.abs(count[todo]) == 1]
    empty = ((count == 0) & (total == 0) & (check == 0)).reshape(rows, cells).all(axis=1)
    return left, right, empty


def likeness(a: list[np.ndarray], b: list[np.ndarray], cells: int = CELLS) -> np.ndarray:
    """Shared / all pieces of each pair, 1 for two texts without pieces; sketches grow where peeling fails."""
    out, todo = np.ones(len(a)), np.arange(len(a))
    while todo.size:
        x, y = (sketch([s[i] for i in todo], cells) for s in (a, b))
        left, right, done = peel(*(p - q for p, q in zip(x, y)))
        sizes = np.array([[len(a[i]), len(b[i])] for i in todo])
        every = sizes[:, 0] + right
        # what was peeled must fit the sizes, or it was no true recovery
        done &= (sizes[:, 0] - left == sizes[:, 1] - right) & (left <= sizes[:, 0])
        out[todo[done]] = np.where(every > 0, (sizes[:, 0] - left) / np.maximum(1, every), 1.0)[done]
        todo, cells = todo[~done], cells * 4
    return out


def printed(values: list[np.ndarray], cells: int = CELLS) -> list[str]:
    """A sketch as text: the number of pieces, then counts, sums and checks in base64."""
    count, total, check = sketch(values, cells)
    packed = np.concatenate([count.astype("<i4").view("u1").reshape(len(values), -1), total.astype("<u8").view("u1").reshape(len(values), -1),
                             (check >> np.uint64(32)).astype("<u4").view("u1").reshape(len(values), -1)], axis=1)
    return [f"{len(v)}:{base64.b64encode(row.tobytes()).decode()}" for v, row in zip(values, packed)]


def edited(text: str, after: str) -> str:
    """The last third of a text replaced by as much of the next."""
    k = len(text) // 3
    return text[:len(text) - k] + after[:k]


_OUT = ("id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def _compare(batches: Iterator[pa.RecordBatch], id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket, own rows by falling id before the one lent by the bucket below."""
    waiting: tuple | None = None  # an own row whose next row has not come yet
    pairs: list[tuple] = []

    def flush() -> pa.RecordBatch:
        ids, texts, own, nexts = zip(*pairs)
        changed = [edited(t, n) for t, n in zip(texts, nexts)]
        turned = [digests(c) for c in changed]
        following = [own[i + 1] if i + 1 < len(own) and texts[i + 1] is nexts[i] else digests(nexts[i]) for i in range(len(own))]
        columns = [pa.array(ids, id_type), pa.array(map(len, texts), pa.int64()),
                   pa.array([hashlib.sha256(c.encode()).hexdigest() for c in changed]), pa.array(printed(own)), pa.array(printed(turned)),
                   pa.array(likeness(own, turned)), pa.array(likeness(own, following))]
        pairs.clear()
        return pa.RecordBatch.from_arrays(columns, list(_OUT))

    held = 0
    for batch in batches:
        for bucket, lent, id, text in zip(*(batch[c].to_pylist() for c in ("bucket", "lent", "id", "text"))):
            if waiting and waiting[0] == bucket:
                pairs.append((*waiting[1:], text))
                held += len(text)
                waiting = None
                if len(pairs) >= TOGETHER or held > 1 << 23:
                    yield flush()
                    held = 0
            if not lent:
                waiting = (bucket, id, text, digests(text))
    if waiting:
        raise AssertionError("a bucket has no row to follow its last")
    if pairs:
        yield flush()


def compare(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: ``id``, n_chars, edited_sha256, both fingerprints, near_edited, near_next.

    The next row is the one with the next smaller id; after the last comes the
    first. Rows of one id follow by falling text, rows without an id come last.
    Null texts count as empty; a single row is followed by itself; an empty
    table gives an empty result; other columns are not read.

    Ids are dealt into ranges of about equally many rows. Each range borrows
    the first row of the range below, so texts are exchanged once and every
    range is its own task's work. Only the edges of the ranges and one id per
    range reach the driver.
    """
    rows = docs.select(F.col(f"`{id}`").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    n = rows.count()
    if not n:
        return rows.select(F.col("id").alias(id), F.lit(0).cast("long").alias("n_chars"), *[F.lit("").alias(c) for c in _OUT[2:5]],
                           *[F.lit(0.0).alias(c) for c in _OUT[5:]])
    buckets = min(MOST_BUCKETS, max(1, n // BUCKET))
    shares = F.array(*[F.lit(k / buckets) for k in range(1, buckets)]) if buckets > 1 else None
    edges = rows.agg(F.percentile_approx("id", shares, F.lit(max(10_000, 5 * buckets)))).first()[0] if shares is not None else []
    edges = np.array(sorted(set(edges or [])), "i8")

    @F.arrow_udf("int")
    def bucket_of(ids: pa.Array) -> pa.Array:
        # rows without an id come last of all: in the lowest range
        known = np.array([x if x is not None else -(1 << 63) for x in ids.to_pylist()], "i8")
        return pa.array(np.where(known == -(1 << 63), 0, np.searchsorted(edges, known, side="right")).astype("i4"))

    tops = {r.b: r.top for r in rows.select("id", bucket_of("id").alias("b")).groupBy("b").agg(F.max("id").alias("top")).collect()}
    order = sorted(tops)
    lends: dict = {}
    for k, b in enumerate(order):
        lends.setdefault(tops[order[k - 1]], []).append(b)  # the lowest range borrows from the highest

    @F.arrow_udf("array<int>")
    def borrowers(ids: pa.Array) -> pa.Array:
        return pa.array([lends.get(x) for x in ids.to_pylist()], pa.list_(pa.int32()))

    own = F.array(F.struct(bucket_of("id").alias("bucket"), F.lit(False).alias("lent")))
    lent = F.transform(F.coalesce(borrowers("id"), F.expr("cast(array() as array<int>)")), lambda b: F.struct(b.alias("bucket"), F.lit(True).alias("lent")))
    dealt = rows.select("id", "text", F.explode(F.concat(own, lent)).alias("t")).select("t.bucket", "t.lent", "id", "text")
    sorted_ = dealt.repartition("bucket").sortWithinPartitions("bucket", "lent", F.col("id").desc_nulls_last(), F.col("text").desc())
    kind = rows.schema["id"].dataType.simpleString()
    arrow = pa.int32() if kind == "int" else pa.int64()
    out = sorted_.mapInArrow(lambda batches: _compare(batches, arrow), f"id {kind}, n_chars long, edited_sha256 string, fingerprint string, "
                             "edited_fingerprint string, near_edited double, near_next double")
    return out.withColumnRenamed("id", id)
