"""Toxicity: a learned lexicon, Levenshtein automata over its trie, and context windows.

1. The lexicon is learned from labelled rows: a word enters if the places where
   it stands in toxic texts outnumber chance (binomial test over all words).
   Places are counted once per (word before, word after), so copies of one
   text add nothing.
2. All terms form a trie. Its product with the Levenshtein automata of the
   terms (one error from five letters on, two from ten) is determinised while
   words are read, so a word costs one lookup per letter until no term is near.
   Misspellings that clean labelled texts use as words of their own are let go.
3. Each match gets a score from the words around it: inside quotation marks or
   beside words of reporting it counts less, beside words of address,
   exclamations or other matches it counts more.
4. A logistic model over six numbers made of those scores gives the probability.

The lexicon and the model are fitted on a bounded number of labelled rows
(``train_rows``); every text is scored whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kalangu.session import through_table

TRAIN_ROWS = 16_000
MAX_TERMS = 5_000
WINDOW = 6
#: words remembered per worker; the memory is emptied when it is full
REMEMBERED = 150_000
EDGE = "".join(map(chr, range(33, 48))) + ":;<=>?@[\\]^_`{|}~¡¿…“”„‘’‚«»‹›–—"
QUOTES = "\"“”„«»"
REPORTING = frozenset("said says say wrote writes called calls quote quoted quotes quoting word words term terms phrase".split())
ADDRESS = frozenset("you your you're youre u ur yourself tu te vous toi du dich dir ihr usted ustedes eres".split())
#: used where there are no labelled rows to learn from
SEED_TERMS = ("idiot", "moron", "stupid", "scum", "worthless", "pathetic", "disgusting", "loser")
SEED_WEIGHTS = (-3.0, 1.5, 0.8, 0.5, 0.0, 0.5, 0.5)
_DIGITS = str.maketrans("013457@$", "oieastas")


def bare(token: str) -> str:
    """A token in lower case without punctuation at its ends, its runs of three or more letters cut to one,
    digits between letters read as the letters they look like."""
    w = token.lower().strip(EDGE)
    if not w.isalpha() and any(map(str.isalpha, w)):
        w = w.translate(_DIGITS)
    if len(w) > 4:
        for c in {a for a, b, d in zip(w, w[1:], w[2:]) if a == b == d}:
            while c * 3 in w:
                w = w.replace(c * 3, c)
    return w


def errors_allowed(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 10 else 2


class Automaton:
    """The Levenshtein automata of all terms, intersected with their trie, determinised on the way."""

    def __init__(self, terms: list[str], most_states: int = 20_000) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.ends: dict[int, tuple[int, int]] = {}
        reach = [0]
        for k, term in enumerate(terms):
            node, allowed = 0, errors_allowed(term)
            reach[0] = max(reach[0], allowed)
            for c in term:
                step = self.children[node].get(c)
                if step is None:
                    step = self.children[node][c] = len(self.children)
                    self.children.append({})
                    reach.append(0)
                node = step
                reach[node] = max(reach[node], allowed)
            self.ends[node] = (k, allowed)
        self.reach = reach  # most errors that any term below a node allows
        self.most_states = most_states
        self._restart()

    def _restart(self) -> None:
        self.numbers: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self._number(self._closed({(0, 0)}))

    def _closed(self, pairs: set) -> frozenset:
        """With the letters of terms that the word may lack; of one node only the fewest errors."""
        best: dict[int, int] = {}
        todo = list(pairs)
        while todo:
            node, e = todo.pop()
            if e > self.reach[node] or best.get(node, 9) <= e:
                continue
            best[node] = e
            todo += [(child, e + 1) for child in self.children[node].values()]
        return frozenset(best.items())

    def _number(self, state: frozenset) -> int:
        known = self.numbers.get(state)
        if known is None:
            known = self.numbers[state] = len(self.states)
            self.states.append(state)
            self.steps.append({})
        return known

    def match(self, word: str) -> tuple[int, int] | None:
        """(term, errors) of the nearest term within its allowed errors, the first of equals."""
        if len(self.states) > self.most_states:
            self._restart()
        at = 0
        for c in word:
            step = self.steps[at].get(c)
            if step is None:
                pairs = set()
                for node, e in self.states[at]:
                    for letter, child in self.children[node].items():
                        pairs.add((child, e if letter == c else e + 1))
                    pairs.add((node, e + 1))
                closed = self._closed(pairs)
                step = self.steps[at][c] = self._number(closed) if closed else -1
            if step < 0:
                return None
            at = step
        found = [(e, self.ends[n][0]) for n, e in self.states[at] if n in self.ends and e <= self.ends[n][1]]
        return min(found)[::-1] if found else None


@dataclass
class Model:
    """What is fitted: terms, near words that are clean, and the weights of the logistic model."""

    terms: list[str] = field(default_factory=lambda: list(SEED_TERMS))
    #: 0 to 1 per term: how rarely it stands in clean texts
    trust: list[float] = field(default_factory=lambda: [1.0] * len(SEED_TERMS))
    clean: frozenset[str] = frozenset()
    weights: tuple[float, ...] = SEED_WEIGHTS


class Reader:
    """Finds the matches of a model in texts and sums their window scores."""

    def __init__(self, model: Model) -> None:
        self.automaton, self.clean, self.trust = Automaton(model.terms), model.clean, model.trust
        self.memory: dict[str, int] = {}

    def code(self, token: str) -> int:
        """0 without a match, else 1 + 3 * term + errors."""
        w = bare(token)
        found = self.automaton.match(w)
        return 0 if found is None or found[1] and w in self.clean else 1 + 3 * found[0] + found[1]

    def features(self, text: str | None) -> tuple[list[float], int]:
        """Exact, misspelt, best window, quoted, different terms and density, as logarithms; the number of matches."""
        memory, tokens = self.memory, (text or "").split()
        codes = list(map(memory.get, tokens))
        if None in codes:
            if len(memory) > REMEMBERED:
                memory.clear()
            fresh = {t: self.code(t) for t, c in zip(tokens, codes) if c is None}
            memory.update(fresh)
            codes = [fresh[t] if c is None else c for t, c in zip(tokens, codes)]
        hits = [i for i, c in enumerate(codes) if c] if any(codes) else []
        exact = near = best = quoted = 0.0
        different: dict[int, float] = {}
        for i in hits:
            lo, hi = max(0, i - WINDOW), i + WINDOW + 1
            term, errors = divmod(codes[i] - 1, 3)
            words = {bare(t) for t in tokens[lo:i] + tokens[i + 1:hi]}
            before = sum(t.count(q) for t in tokens[lo:i] for q in QUOTES)
            own = tokens[i]
            in_quotes = before % 2 == 1 or own[0] in QUOTES or own.rstrip(".,;:!?")[-1:] in QUOTES
            value = self.trust[term]
            if in_quotes or words & REPORTING:
                quoted += value
                value *= 0.35
            if words & ADDRESS:
                value *= 1.5
            if own.endswith("!") or any(t.endswith("!") for t in tokens[i + 1:i + 3]):
                value *= 1.2
            others = len({codes[j] for j in range(lo, min(hi, len(codes))) if codes[j]} - {codes[i]})
            best = max(best, value * (1 + 0.5 * others))
            if errors:
                value *= 0.7 if errors == 1 else 0.4
                near += value
            else:
                exact += value
            different[term] = max(different.get(term, 0.0), value)
        sums = (exact, near, best, quoted, sum(different.values()), 100 * (exact + near) / max(20, len(tokens)))
        return [math.log1p(v) for v in sums], len(hits)


def held_out(id: Column) -> Column:
    """True where crc32 of the id as text is a multiple of five; such labels are never learned from."""
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each (word, place) of a text once; a place is the word before and the word after."""
    from xxhash import xxh64_intdigest as digest

    for batch in batches:
        words, places, marks = [], [], []
        for text, toxic in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist()):
            w = [x for x in map(bare, (text or "").split()) if x]
            seen = {(b, f"{a} {c}") for a, b, c in zip(["", *w], w, [*w[1:], ""])}
            words += [b for b, _ in seen]
            places += [digest(p) - (1 << 63) for _, p in seen]
            marks += [toxic] * len(seen)
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(places, pa.int64()), pa.array(marks, pa.int32())],
                                         ["word", "place", "toxic"])


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 1.0) -> tuple[float, ...]:
    """Weights of a ridge-penalised logistic regression over counted rows (Newton steps)."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    penalty = np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (n * p * (1 - p))[:, None]) + penalty, x.T @ (n * (y - p)) - penalty @ w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def fit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic",
        train_rows: int = TRAIN_ROWS, max_terms: int = MAX_TERMS) -> Model:
    """A model from at most ``train_rows`` labelled rows, the first in hash order of their ids.

    Rows held out (see ``held_out``) and null labels are left out; of several
    labels of one id the highest counts. Without a toxic and a clean row the
    seed terms and weights stand.
    """
    chosen = (labels.filter(F.col(f"`{label}`").isNotNull() & F.col(f"`{id}`").isNotNull() & ~held_out(F.col(f"`{id}`")))
              .groupBy(F.col(f"`{id}`").alias("id")).agg(F.max(F.col(f"`{label}`").cast("int")).alias("toxic"))
              .orderBy(F.xxhash64("id"), "id").limit(train_rows))
    # at most train_rows pairs of an id and a label: safe to send everywhere
    rows = docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    rows = through_table(rows.join(F.broadcast(chosen), "id").select("text", "toxic"), "labelled")
    places = rows.mapInArrow(_places, "word string, place bigint, toxic int").distinct()
    counts = through_table(places.groupBy("word").agg(F.sum("toxic").alias("t"), F.count("*").alias("n")), "terms")
    t, n, words = counts.agg(F.sum("t"), F.sum("n"), F.count("*")).first()
    if not n or not t or t == n:
        return Model()
    base, share = t / n, F.col("t") / F.col("n")
    excess = F.col("n") * (share * F.log(share / base) + F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - base))).otherwise(0.0))
    found = (counts.filter((F.length("word") > 2) & (F.col("t") >= 3) & (share > max(0.5, 3 * base / (1 + 2 * base))) & (excess > math.log(words / 0.05)))
             .orderBy(excess.desc(), "word").limit(max_terms).select("word", "t", "n").collect())
    terms = [r.word for r in found]
    if not terms:
        return Model()
    trust = [min(1.0, max(0.05, math.log((r.t + 0.5) / (r.n - r.t + 0.5)) / 4)) for r in found]

    @F.arrow_udf("boolean")
    def near(words: pa.Array) -> pa.Array:
        automaton = Automaton(terms)
        return pa.array([bool(m := automaton.match(w)) and m[1] > 0 for w in words.to_pylist()], pa.bool_())

    # words of the bounded training texts near a term and at home in clean texts
    clean = frozenset(r.word for r in counts.filter((F.col("n") - F.col("t") >= 2) & near("word")).select("word").collect())
    model = Model(terms, trust, clean)
    cells = (rows.withColumn("f", _features(model, "text")).groupBy("f.x", "toxic").count().collect())
    x, y, m = (np.array(v, float) for v in ([r.x for r in cells], [r.toxic for r in cells], [r["count"] for r in cells]))
    model.weights = _logistic(x, y, m)
    return model


def _features(model: Model, text: str) -> Column:
    """struct<x array<double>, n int>: the six features, rounded, and the number of matches."""
    @F.arrow_udf("struct<x array<double>, n int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        reader = Reader(model)
        for texts in batches:
            pairs = [reader.features(t.as_py()) for t in texts]
            yield pa.StructArray.from_arrays(
                [pa.array([[round(v, 2) for v in x] for x, _ in pairs], pa.list_(pa.float64())),
                 pa.array([n for _, n in pairs], pa.int32())], ["x", "n"])

    return run(F.col(f"`{text}`"))


def score(docs: DataFrame, model: Model, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id``, held_out, score (0 to 1), predicted, n_matches.

    Null and empty texts score as texts without a match. Repeated ids or rows
    give as many rows; an empty table gives an empty result; other columns are
    not read. A null id is not held out.
    """
    f = docs.select(F.col(f"`{id}`").alias("id"), _features(model, text).alias("f"))
    line = sum((F.lit(w) * F.get("f.x", F.lit(k)) for k, w in enumerate(model.weights[1:])), F.lit(model.weights[0]))
    p = f.select("id", (1 / (1 + F.exp(-line))).alias("score"), F.col("f.n").alias("n_matches"))
    return p.select(F.col("id").alias(id), held_out(F.col("id")).alias("held_out"), "score",
                    (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_matches")


def reject(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` without the rows predicted toxic, all columns as they were."""
    line = sum((F.lit(w) * F.get("__f.x", F.lit(k)) for k, w in enumerate(model.weights[1:])), F.lit(model.weights[0]))
    return docs.withColumn("__f", _features(model, text)).filter(line < 0).drop("__f")
