"""Phrase collocations by Rabin-Karp fingerprints.

Words are numbered, hashed and laid out as one sequence; prefix polynomials
over it give the fingerprint of every n-gram as a difference, in numpy. The
shuffle sees fingerprints and counts, with occurrence pointers where they are
frequent; only those become text, read from the document pointed at.

A phrase can be frequent only if all its parts are. So words are counted first,
then pairs of frequent words, then longer runs of frequent pairs, each by
``CELL_BITS`` bits of the fingerprint alone. What is frequent goes to the tasks
as a bitmap of at most ``BITS`` bits; an n-gram that passes without being
frequent is dropped by the exact count later, so cells and bitmap save work and
decide nothing. A last pass counts what passes by whole fingerprints, with a
second hash and a pointer.

A fingerprint whose occurrences differ in the second hash stands for several
phrases: its occurrences are read again and counted by their text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kalangu.session import through_table

LONGEST = 5
LEAST = 100
FIRST = 2000
#: size of a bitmap of frequent fingerprints: 16 MB at most
BITS = 1 << 27
#: bits of a fingerprint that are counted before it is known to be frequent
CELL_BITS = 40
#: words that are laid out together
CHUNK = 400_000
#: bytes of a text that are split at once
WHOLE = 1 << 20
#: the end of a piece, a byte that no text holds
END = b"\xff"
#: A-Z in lower case, tabs as spaces, the characters that end a piece as one
_FORM = bytes(b + 32 if 65 <= b <= 90 else 32 if b == 9 else 255 if chr(b) in ".,;:!?\n\v\f\r" else b for b in range(256))
_TOKEN = re.compile(rb"[^ \xff]+|\xff")
_BASES = (0xD6E8FEB86659FD93, 0x9E3779B97F4A7C15)
_SEED = 42


@lru_cache(maxsize=1)
def _powers() -> list[tuple[np.ndarray, np.ndarray]]:
    """Powers of both bases and of their inverses modulo 2 ** 64, for every place of a chunk."""
    out = []
    for base in _BASES:
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            steps = np.full(CHUNK + LONGEST, b, "u8")
            steps[0] = 1
            both.append(np.multiply.accumulate(steps))
        out.append(tuple(both))
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def prefixes(words: np.ndarray, which: int) -> np.ndarray:
    """Prefix polynomials of hashed words."""
    total = np.zeros(len(words) + 1, "u8")
    np.cumsum(words * _powers()[which][0][:len(words)], out=total[1:])
    return total


def fingerprints(total: np.ndarray, at: np.ndarray, length: int, which: int, salt: np.ndarray | np.uint64) -> np.ndarray:
    """64 bits for each run of ``length`` words that starts ``at``: differences of prefixes, moved to the start.

    ``salt`` tells languages apart.
    """
    return _mixed((total[at + length] - total[at]) * _powers()[which][1][at] + salt + np.uint64(length))


@lru_cache(maxsize=1024)
def salt_of(lang: str) -> int:
    from xxhash import xxh64_intdigest as digest

    return digest(lang.encode(), _SEED)


class Chunk:
    """Consecutive words of some texts, piece ends between them."""

    def __init__(self, tokens: list[bytes], doc: np.ndarray, fresh: int):
        from xxhash import xxh3_128_digest as digest

        different = dict.fromkeys(tokens)
        self.words = list(different)
        different = dict(zip(self.words, range(len(self.words))))
        self.ids = np.fromiter(map(different.__getitem__, tokens), "i4", len(tokens))
        parts = np.frombuffer(b"".join(map(partial(digest, seed=_SEED), self.words)), "u8").reshape(-1, 2)
        self.totals = [prefixes(np.ascontiguousarray(parts[:, k])[self.ids], k) for k in (0, 1)]
        self.ends = np.concatenate(([0], np.cumsum(self.ids == different.get(END, -1))))
        self.doc, self.fresh = doc, fresh

    def starts(self, length: int) -> np.ndarray:
        """Starts of the runs that hold no piece end and were not in the chunk before."""
        whole = self.ends[length:] == self.ends[:-length]
        whole[:max(0, self.fresh - length + 1)] = False
        return np.flatnonzero(whole)

    def prints(self, at: np.ndarray, length: int, salts: np.ndarray, which: int = 0) -> np.ndarray:
        return fingerprints(self.totals[which], at, length, which, salts[self.doc[at]])

    def text(self, start: int, length: int) -> bytes:
        return b" ".join(self.words[k] for k in self.ids[start:start + length].tolist())


def tokens_of(text: str) -> Iterator[list[bytes]]:
    """Words and piece ends of a text, in lists of bounded size."""
    raw = text.encode().translate(_FORM)
    if len(raw) <= WHOLE:
        yield raw.replace(END, b" \xff ").split()
        return
    stream = _TOKEN.finditer(raw)
    while some := [m.group() for _, m in zip(range(CHUNK // 4), stream)]:
        yield some


def chunks(texts: list[str | None]) -> Iterator[Chunk]:
    """The tokens of the texts in chunks; a chunk begins with the last words of the one before, ``fresh`` in number."""
    tokens: list[bytes] = []
    docs: list[int] = []
    sizes: list[int] = []
    fresh = 0
    for k, text in enumerate(texts):
        for new in tokens_of(text or ""):
            while new:
                room = CHUNK - len(tokens)
                tokens += new[:room]
                docs.append(k)
                sizes.append(min(room, len(new)))
                new = new[room:]
                if len(tokens) == CHUNK:
                    yield Chunk(tokens, np.repeat(np.array(docs), np.array(sizes)), fresh)
                    fresh = LONGEST - 1
                    tokens, kept = tokens[-fresh:], np.repeat(np.array(docs), np.array(sizes))[-fresh:]
                    docs, sizes = kept.tolist(), [1] * fresh
        if tokens and len(tokens) < CHUNK:
            tokens.append(END)
            docs.append(k)
            sizes.append(1)
    if len(tokens) > fresh:
        yield Chunk(tokens, np.repeat(np.array(docs), np.array(sizes)), fresh)


class Bitmap:
    """Fingerprints as two bits each, by their low ``CELL_BITS``; may say yes for others."""

    def __init__(self, frequent: DataFrame, most: int = BITS):
        n = frequent.count()
        self.size = min(most, max(1 << 16, 1 << (16 * n).bit_length()))
        self.shift = CELL_BITS - self.size.bit_length() + 1
        self.bits = np.zeros(self.size // 8, "u1")
        # the second probe takes the high digits of the low ones
        cells = frequent.selectExpr(f"explode(array(fp & {self.size - 1}L, shiftright(fp & {(1 << CELL_BITS) - 1}L, {self.shift}))) AS cell")
        rows = cells.selectExpr("shiftright(cell, 6) AS at", "shiftleft(1L, cast(cell & 63 AS int)) AS bit")
        rows = rows.groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()  # size / 64 rows at most
        self.bits.view("u8")[rows.column("at").to_numpy()] = rows.column("bits").to_numpy().view("u8")

    def has(self, fp: np.ndarray) -> np.ndarray:
        found = np.ones(len(fp), bool)
        for cell in (fp & np.uint64(self.size - 1), (fp & np.uint64((1 << CELL_BITS) - 1)) >> np.uint64(self.shift)):
            cell = cell.astype("i8")
            found &= (self.bits[cell >> 3] >> (cell & 7).astype("u1")) & 1 == 1
        return found


def _langs(batch: pa.RecordBatch) -> tuple[list[str], np.ndarray]:
    names = [x if x is not None else "und" for x in batch.column("lang").to_pylist()]
    return names, np.array([salt_of(x) for x in names], "u8")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str], np.ndarray, Chunk]]:
    for batch in batches:
        langs, salts = _langs(batch)
        for c in chunks(batch.column("text").to_pylist()):
            yield batch, langs, salts, c


def _sound(c: Chunk, lengths: tuple[int, ...], salts: np.ndarray, parts: Bitmap | None, bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """(length, starts) of the runs all of whose parts, one word shorter than the least length, are in ``parts``."""
    missed, of = None, min(lengths) - 1
    if parts is not None:
        at = c.starts(of) if not c.fresh else np.arange(len(c.ids) - of + 1)
        known = np.zeros(max(0, len(c.ids) - of + 1), bool)
        known[at] = parts.has(c.prints(at, of, salts) & np.uint64((1 << bits) - 1))
        missed = np.concatenate(([0], np.cumsum(~known)))
    for length in lengths:
        at = c.starts(length)
        yield length, at if missed is None else at[missed[at + length - of + 1] == missed[at]]


def cells(docs: DataFrame, lengths: tuple[int, ...], parts: Bitmap | None, least: int, bits: int = 64) -> DataFrame:
    """(fp): the low ``CELL_BITS`` of the fingerprints of n-grams, where they come ``least`` times."""
    mask = np.uint64((1 << min(bits, CELL_BITS)) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, salts, c in _chunks(batches):
            for length, at in _sound(c, lengths, salts, parts, bits):
                fp, n = np.unique(c.prints(at, length, salts) & mask, return_counts=True)
                if len(fp):
                    yield pa.RecordBatch.from_arrays([pa.array(fp.view("i8")), pa.array(n)], ["fp", "n"])

    return docs.mapInArrow(run, "fp bigint, n bigint").groupBy("fp").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select("fp")


def occurrences(docs: DataFrame, frequent: Bitmap, bits: int = 64) -> DataFrame:
    """(lang, words, fp, n, low, high, id): count, range of the second hash and a document, of n-grams that may be ``frequent``.

    Rows of no words count all words of a language.
    """
    fields = f"lang string, words int, fp bigint, n bigint, low bigint, high bigint, id {docs.schema['id'].dataType.simpleString()}"
    names, mask = [f.split()[0] for f in fields.split(", ")], np.uint64((1 << bits) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, langs, salts, c in _chunks(batches):
            lang_column, known = pa.array(langs, pa.string()), None
            words = np.bincount(c.doc[c.starts(1)], minlength=len(langs))
            here = np.flatnonzero(words)
            yield pa.RecordBatch.from_arrays([
                lang_column.take(pa.array(here)), pa.array(np.zeros(len(here), "i4")), pa.array(np.zeros(len(here), "i8")), pa.array(words[here]),
                pa.array(np.zeros(len(here), "i8")), pa.array(np.zeros(len(here), "i8")), batch.column("id").take(pa.array(here))], names)
            for length in range(1, LONGEST + 1):
                # a run may be frequent if what it begins and ends with may; those within the overlap were counted before
                within = c.ends[length:] == c.ends[:-length]
                at = np.flatnonzero(within if known is None else within & known[:-1] & known[1:])
                fp = c.prints(at, length, salts) & mask
                passed = frequent.has(fp)
                at, fp = at[passed], fp[passed]
                known = np.zeros(max(0, len(c.ids) - length + 1), bool)
                known[at] = True
                new = at >= c.fresh - length + 1
                at, fp = at[new], fp[new]
                if not len(at):
                    continue
                check = c.prints(at, length, salts, 1).view("i8")
                own = salts[c.doc[at]]  # languages are told apart even where fingerprints meet
                order = np.lexsort((own, fp))
                fp, check, at, own = fp[order], check[order], at[order], own[order]
                first = np.flatnonzero(np.concatenate(([True], (fp[1:] != fp[:-1]) | (own[1:] != own[:-1]))))
                doc = pa.array(c.doc[at[first]])
                yield pa.RecordBatch.from_arrays([
                    lang_column.take(doc), pa.array(np.full(len(first), length, "i4")), pa.array(fp[first].view("i8")),
                    pa.array(np.diff(np.append(first, len(fp)))), pa.array(np.minimum.reduceat(check, first)),
                    pa.array(np.maximum.reduceat(check, first)), batch.column("id").take(doc)], names)

    found = docs.mapInArrow(run, fields).groupBy("lang", "words", "fp")
    return found.agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.min("id").alias("id"))


def _spelled(c: Chunk, langs: list[str], salts: np.ndarray, bits: int, wanted, out: list[tuple]) -> None:
    """Adds (lang, words, fp, phrase) of the runs whose fingerprint is ``wanted``."""
    mask = np.uint64((1 << bits) - 1)
    for length in range(1, LONGEST + 1):
        at = c.starts(length)
        fp = c.prints(at, length, salts) & mask
        here = wanted(fp)
        out += [(langs[c.doc[s]], length, f, c.text(s, length).decode()) for s, f in zip(at[here].tolist(), fp[here].view("i8").tolist())]


_PHRASE = pa.schema([("lang", pa.string()), ("words", pa.int32()), ("fp", pa.int64()), ("phrase", pa.string())])


def texts_of(docs: DataFrame, wanted: DataFrame, bits: int = 64) -> DataFrame:
    """(lang, words, fp, phrase) of ``wanted``, read from the texts of the documents that it points at."""
    asked = wanted.groupBy("id").agg(F.collect_list("fp").alias("asked"))  # no more than the runs of one document

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, salts = _langs(batch)
            out: list[tuple] = []
            for k, (text, some) in enumerate(zip(batch.column("text"), batch.column("asked"))):
                some = some.values.to_numpy().view("u8")
                for c in chunks([text.as_py()]):
                    _spelled(c, langs[k:k + 1], salts[k:k + 1], bits, lambda fp: np.isin(fp, some), out)  # noqa: B023
            yield pa.RecordBatch.from_pylist([dict(zip(_PHRASE.names, r)) for r in dict.fromkeys(out)], _PHRASE)

    # a null id is a pointer like any other
    read = docs.alias("d").join(asked.alias("a"), F.col("d.id").eqNullSafe(F.col("a.id"))).select("d.text", "d.lang", "a.asked")
    return read.mapInArrow(run, "lang string, words int, fp bigint, phrase string").distinct()


def by_text(docs: DataFrame, clashes: Bitmap, bits: int = 64) -> DataFrame:
    """(lang, words, fp, phrase, n) of all n-grams whose fingerprint may be in ``clashes``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, langs, salts, c in _chunks(batches):
            out: list[tuple] = []
            _spelled(c, langs, salts, bits, clashes.has, out)
            yield pa.RecordBatch.from_pylist([dict(zip(_PHRASE.names, r)) for r in out], _PHRASE)

    found = docs.mapInArrow(run, "lang string, words int, fp bigint, phrase string")
    return found.groupBy("lang", "words", "fp", "phrase").agg(F.count("*").alias("n"))


def frequencies(docs: DataFrame, least: int, bits: int = 64, most: int = BITS) -> tuple[DataFrame, DataFrame]:
    """(lang, words, phrase, n) of all phrases of 1 to five words with ``n`` >= ``least``, and (lang, total): all words of a language."""
    words = through_table(cells(docs, (1,), None, least, bits), "words")
    pairs = through_table(cells(docs, (2,), Bitmap(words, most), least, bits), "pairs")
    longer = through_table(cells(docs, tuple(range(3, LONGEST + 1)), Bitmap(pairs, most), least, bits), "longer")
    found = through_table(occurrences(docs, Bitmap(words.union(pairs).union(longer), most), bits), "found")
    totals = found.filter("words = 0").groupBy("lang").agg(F.sum("n").alias("total"))
    found = found.filter((F.col("words") > 0) & (F.col("n") >= least))
    sound = found.filter("low = high")
    phrases = sound.join(texts_of(docs, sound, bits), ["lang", "words", "fp"]).select("lang", "words", "phrase", "n")
    clashes = found.filter("low != high").select("lang", "words", "fp")
    if not clashes.isEmpty():
        told = by_text(docs, Bitmap(clashes, most), bits).filter(F.col("n") >= least)
        phrases = phrases.union(told.join(clashes, ["lang", "words", "fp"], "left_semi").select("lang", "words", "phrase", "n"))
    return through_table(phrases, "phrases"), totals


def _part(first: Column, last: Column) -> Column:
    return F.array_join(F.slice("tokens", first, last - first + 1), " ")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", id: str = "doc_id", least: int = LEAST,
                 first: int = FIRST, bits: int = 64, most: int = BITS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``first`` phrases of 2 to 5 words of every language by score.

    ``a`` is the phrase's count, ``l`` and ``r`` those of its parts at the cut of
    the lowest score floor(1000 a n / (l r)), the first such cut on ties; ``n``
    counts all words of the language. Phrases that only occur inside a longer
    one of the same count are left out. A null language is ``und`` and joins the
    rows that say so; null and empty texts have no words; rows of one id, with
    or without an id, all count. Empty tables give an empty result; other
    columns are not read. Products are decimals of 38 digits.
    """
    docs = docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text"), F.coalesce(F.col(f"`{lang}`"), F.lit("und")).alias("lang"))
    found, totals = frequencies(docs, least, bits, most)
    candidates = found.filter("words > 1").withColumn("tokens", F.split("phrase", " "))
    cuts = candidates.select("lang", "phrase", "words", F.col("n").alias("a"), "tokens", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _part(F.lit(1), F.col("k")).alias("left"), _part(F.col("k") + 1, F.col("words")).alias("right"))
    counts = found.select("lang", "phrase", "n")
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")), ["lang", "left"])
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r")), ["lang", "right"])
    cuts = cuts.join(totals.withColumnRenamed("total", "n"), "lang")
    d = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.withColumns({"__top": d("a") * d("n") * 1000, "__low": d("l") * d("r")})
    cuts = cuts.withColumn("score", F.expr("__top div __low"))
    scored = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("best"))
    # phrases that stand inside a longer candidate of the same count
    inner = candidates.filter("words > 2").select("lang", F.col("n").alias("a"), "tokens", "words", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("size"))
    inner = inner.select("lang", "a", "tokens", "size", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)).alias("at"))
    inner = inner.select("lang", "a", _part(F.col("at"), F.col("at") + F.col("size") - 1).alias("phrase"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = scored.join(inner, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (F.col("longer") < F.col("best.a")))
    kept = kept.select("lang", "phrase", "best.a", "best.l", "best.r", "best.n", "best.score")
    ranked = kept.withColumn("rank", F.expr("row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase ASC)"))
    return ranked.filter(F.col("rank") <= first).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
