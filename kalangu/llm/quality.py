"""Quality rules: an isolation forest on rule statistics, with a threshold from labelled rows.

Each text gives a few counts (``STATS``), and those give rates. Labelled rows
say which rates tell good from bad, and on which side the bad lie; of a rate
only what exceeds the median of the good rows on that side is looked at, so a
text is never odd for being better than most. An isolation forest, grown on
good rows in the box that holds the bad ones too, splits those excesses at
random; a text that few splits set apart is anomalous: 2 ** (-mean path length / expected path length). The threshold is
the score that best separates good from bad labelled rows. Only labelled rows
whose crc32(id) mod 5 is not 0 are learned from, at most ``train_rows`` for
sides and trees; the threshold uses all of them, as a histogram of scores.
Every text is judged whole.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kalangu.session import through_table

TRAIN_ROWS = 20_000
TREES = 200
SAMPLE = 256
SEED = 42
MIN_WORDS = 50
#: bars of the histogram that the threshold is chosen from
BARS = 1_000
#: where there are no labels of both kinds
DEFAULT_THRESHOLD = 0.62
#: a rate whose area under the curve is nearer to 0.5 than this says nothing about quality
LEAST_AREA = 0.1
#: a good row rejected weighs as much as so many bad rows kept
GOOD_WEIGHT = 10.0

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks",
         "n_distinct")
_SCHEMA = ", ".join(f"{s} bigint" for s in STATS)
_SYMBOLS, _MARKS = b"#*$%&|<>", b"!?.,;:-_=+~^/\\()[]{}\"'`@"
_WHITE = "\t\n\x0b\x0c\r "


def counts(text: str | None) -> tuple[int, ...]:
    """The statistics of a text, in the order of ``STATS``; null counts as empty."""
    raw = (text or "").encode()
    words = raw.split()
    n = len(words)
    if not n:
        symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
        return (0, 0, symbols, *[0] * (len(STATS) - 3))
    chars = len(text) - sum(map(text.count, _WHITE))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        often = Counter(windows)
        end = 0
        for i, w in enumerate(windows):
            if often[w] > 1:
                repeated += i + 3 - max(end, i)
                end = i + 3
    upper = sum(map(str.isupper, text)) if not text.islower() else 0
    return (n, chars, len(raw) - len(raw.translate(None, _SYMBOLS)), len(lines) - len(set(lines)), repeated, len(lines),
            upper, len(raw) - len(raw.translate(None, b"0123456789")), len(raw) - len(raw.translate(None, _MARKS)), len(set(words)))


def statistics(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id`` and the statistics of every row."""
    @F.arrow_udf(f"struct<{_SCHEMA.replace(' ', ':').replace(',:', ',')}>")
    def run(texts: pa.Array) -> pa.Array:
        rows = np.array([counts(t.as_py()) for t in texts], "i8").reshape(-1, len(STATS))
        return pa.StructArray.from_arrays([pa.array(c) for c in rows.T], list(STATS))

    return docs.select(F.col(f"`{id}`").alias("id"), run(F.col(f"`{text}`")).alias("s")).select("id", "s.*")


def shares(stats: dict[str, np.ndarray]) -> np.ndarray:
    """What the trees split: rates, so that long texts are like short ones."""
    n = np.maximum(1, stats["n_words"]).astype(float)
    chars = np.maximum(1, stats["word_chars"]).astype(float)
    lines = np.maximum(1, stats["n_lines"]).astype(float)
    return np.column_stack([
        chars / n, stats["n_symbols"] / n, stats["n_dup_lines"] / lines, stats["n_repeat_words"] / n,
        stats["n_upper"] / chars, stats["n_digits"] / chars, stats["n_marks"] / n])


def _expected(n: int) -> float:
    """Mean path length of an unsuccessful search in a random tree of n points."""
    return 0.0 if n < 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0


@dataclass
class Forest:
    """Trees as arrays: per node the feature (-1: leaf), the split, the left child (the right one follows), the depth held."""

    feature: list[np.ndarray]
    split: list[np.ndarray]
    left: list[np.ndarray]
    path: list[np.ndarray]
    sample: int

    @classmethod
    def grow(cls, x: np.ndarray, low: np.ndarray, high: np.ndarray, trees: int = TREES, sample: int = SAMPLE,
             seed: int = SEED) -> Forest:
        """Trees over samples of ``x``, cut at random in the box from ``low`` to ``high`` that holds bad rows as well."""
        rng = np.random.default_rng(seed)
        size = min(sample, len(x))
        deepest = max(1, math.ceil(math.log2(max(2, size))))
        forest = cls([], [], [], [], size)
        for _ in range(trees):
            feature, split, left, path = [0], [0.0], [0], [0.0]
            todo = [(x[rng.choice(len(x), size, replace=False)], 0, 0, low, high)]
            while todo:
                points, depth, at, lo, hi = todo.pop()
                open_ = np.flatnonzero(hi > lo)
                if depth >= deepest or len(points) < 2 or not open_.size:
                    feature[at], left[at], path[at] = -1, at, depth + _expected(len(points))
                    continue
                f = int(rng.choice(open_))
                cut = rng.uniform(lo[f], hi[f])
                feature[at], split[at], left[at] = f, cut, len(feature)
                for column in (feature, split, left, path):
                    column.extend([0, 0])
                under, over = hi.copy(), lo.copy()
                under[f] = over[f] = cut
                todo += [(points[points[:, f] <= cut], depth + 1, left[at], lo, under),
                         (points[points[:, f] > cut], depth + 1, left[at] + 1, over, hi)]
            for held, column, kind in ((forest.feature, feature, "i4"), (forest.split, split, "f8"),
                                       (forest.left, left, "i4"), (forest.path, path, "f8")):
                held.append(np.array(column, kind))
        return forest

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly scores, 0 to 1."""
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for feature, split, left, path in zip(self.feature, self.split, self.left, self.path):
            at = np.zeros(len(x), "i4")
            while True:
                f = feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                right = x[rows, np.maximum(f, 0)] > split[at]
                at = np.where(inner, left[at] + right, at)
            total += path[at]
        return 2.0 ** (-(total / len(self.path)) / max(1e-9, _expected(self.sample)))


@dataclass
class Model:
    forest: Forest | None
    threshold: float = DEFAULT_THRESHOLD
    columns: tuple[int, ...] = ()
    sides: tuple[float, ...] = ()
    middles: tuple[float, ...] = ()

    def excess(self, rates: np.ndarray) -> np.ndarray:
        """How far each informative rate lies on its bad side."""
        return np.maximum(0.0, (rates[:, list(self.columns)] - np.array(self.middles)) * np.array(self.sides))


def _area(x: np.ndarray, bad: np.ndarray) -> float:
    """Probability that a bad row has the higher value, ties half."""
    values, place, many = np.unique(x, return_inverse=True, return_counts=True)
    ranks = (np.cumsum(many) - (many - 1) / 2)[place]
    n = int(bad.sum())
    return float((ranks[bad].sum() - n * (n + 1) / 2) / (n * (len(x) - n)))


def grow(rates: np.ndarray, good: np.ndarray) -> Model:
    """Sides and trees from labelled rows; all rates, both ways alike, where no bad row is known or none tells."""
    middles, columns, sides = np.median(rates[good], axis=0), [], []
    if not good.all():
        areas = [_area(rates[:, k], ~good) for k in range(rates.shape[1])]
        columns = [k for k, a in enumerate(areas) if abs(a - 0.5) >= LEAST_AREA]
        sides = [1.0 if areas[k] > 0.5 else -1.0 for k in columns]
    if not columns:
        columns, sides = list(range(rates.shape[1])), [1.0] * rates.shape[1]
    model = Model(None, DEFAULT_THRESHOLD, tuple(columns), tuple(sides), tuple(float(middles[k]) for k in columns))
    excess = model.excess(rates)
    model.forest = Forest.grow(excess[good], excess.min(axis=0), excess.max(axis=0))
    return model


def learned_from(id: Column) -> Column:
    return F.crc32(id.cast("string").cast("binary")) % 5 != 0


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > 50 * n_words)


def _scores(model: Model) -> Column:
    @F.arrow_udf("double")
    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for columns in batches:
            x = shares({s: c.to_numpy(zero_copy_only=False) for s, c in zip(STATS, columns)})
            yield pa.array(model.forest.score(model.excess(x)))

    return run(*STATS) if model.forest else F.lit(0.0)


def fit(stats: DataFrame, labels: DataFrame, id: str = "doc_id", label: str = "quality", train_rows: int = TRAIN_ROWS) -> Model:
    """Forest and threshold from labelled rows; without good rows nothing is anomalous.

    Null labels and ids are left out; of several labels of one id the lowest counts.
    """
    marks = (labels.filter(F.col(f"`{label}`").isNotNull() & learned_from(F.col(f"`{id}`")))
             .groupBy(F.col(f"`{id}`").alias("lid")).agg(F.min(F.col(f"`{label}`").cast("int")).alias("good")))
    known = through_table(stats.join(marks, F.col("id") == F.col("lid")).filter(
        ~base_failed(F.col("n_words"), F.col("n_repeat_words"))).select("id", "good", *STATS), "labelled")
    # through a table: collecting a sorted limit would send the first rows of every task to the driver
    first = known.orderBy(F.xxhash64("id"), "id", *STATS).limit(train_rows).select("good", *STATS)
    rows = through_table(first, "sample").toPandas()
    good = rows["good"].to_numpy() > 0
    if good.sum() < 2:
        return Model(None)
    model = grow(shares({s: rows[s].to_numpy() for s in STATS}), good)
    bars = known.withColumn("bar", F.floor(_scores(model) * BARS)).groupBy("bar", "good").count().collect()
    table = np.zeros((BARS + 1, 2))
    for r in bars:
        table[min(BARS, max(0, r["bar"])), int(r["good"] > 0)] += r["count"]
    if (table.sum(axis=0) == 0).any():
        return model
    # rejected from a bar on: of equals the highest bar
    above = table[::-1].cumsum(axis=0)[::-1] / table.sum(axis=0)
    gain = above[:, 0] - GOOD_WEIGHT * above[:, 1]
    model.threshold = float(len(gain) - 1 - int(gain[::-1].argmax())) / BARS
    return model


def judge(stats: DataFrame, model: Model) -> DataFrame:
    """``stats`` with base_failed, anomaly and kept."""
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    return (stats.withColumn("anomaly", _scores(model)).withColumn("base_failed", failed)
            .withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") < model.threshold)))


def rate(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """One row per row of ``docs``: ``id``, the statistics, anomaly, base_failed, kept.

    Null and empty texts have no words and fail. Repeated ids or rows give as
    many rows, judged alike; an empty table gives an empty result; other
    columns are not read.
    """
    stats = through_table(statistics(docs, id, text), "statistics")
    return judge(stats, fit(stats, labels, id, label)).withColumnRenamed("id", id)
