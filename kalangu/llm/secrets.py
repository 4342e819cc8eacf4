"""Secrets: three patterns, and values in credential contexts that would be costly to guess.

The cost of a value is the cheapest way to put it together (dynamic programming
over its positions) from words of the corpus, dates, repeats, keyboard walks,
sequences and spans that need brute force, in bits; every further part costs
two bits more. A value after a credential word is a secret from ``least_bits`` on,
and a short one, which cannot have so many, if it costs ``share`` of what brute
force costs for all its characters: then no cheaper way to it is known. So
"password: summer2019" is none and "pwd: x9$Lq2!v" is one.

Ranks of words come from counting all texts; the ``words`` most frequent are
sent to the workers, a bounded number.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kalangu.session import through_table

KINDS = ("assign", "access", "hex", "guess")
WORDS = 20_000
LEAST_BITS = 45.0
#: of the brute-force cost, for values that cannot reach the bits
SHARE = 0.7
#: a repeat, walk or sequence may stop after so many blocks or characters, or where it ends of itself
SHORT = 24

_KEYS = ("password", "passwd", "secret", "token", "api_?key")
_either = lambda word: re.sub("[a-z]", lambda m: f"[{m[0]}{m[0].upper()}]", word)
ASSIGN = re.compile(rf"(?:{'|'.join(map(_either, _KEYS))})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
# the run that matches is the longest there is, so asking for its least length finds the same
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
_NAMES = ("password", "passwd", "passphrase", "passcode", "pass", "pwd", "secret", "token", "apikey", "api_key", "api-key",
          "private_key", "private-key", "access_key", "access-key", "client_secret", "signing_key", "credential",
          "credentials", "bearer", "authorization")
CONTEXT = re.compile(rf"(?<![A-Za-z])(?:{'|'.join(sorted(_NAMES, key=len, reverse=True))})"
                     r"(?:[\"']?[ \t]*(?:=>|:=|[:=])[ \t]*|[ \t]+is[ \t]+|(?<=bearer)[ \t]+)[\"'`]?([^\s\"'`<>]{8,})")
LINK = re.compile(r"://[^\s:/@]+:([^\s/@]{8,})@")
_HINT = ("pass", "pwd", "secret", "token", "key", "credential", "bearer", "authorization")

_ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
_SHIFT = str.maketrans('~!@#$%^&*()_+{}:"<>?|', "`1234567890-=[];',./\\")


def _neighbours() -> dict[str, frozenset[str]]:
    """Keys that touch on a keyboard whose rows are each shifted by half a key."""
    place = {c: (r, x) for r, row in enumerate(_ROWS) for x, c in enumerate(row)}
    def touch(a: tuple[int, int], b: tuple[int, int]) -> bool:
        rows, keys = b[0] - a[0], a[1] - b[1]
        return abs(keys) == 1 if not rows else abs(rows) == 1 and 0 <= keys * rows <= 1

    return {a: frozenset(b for b in place if touch(place[a], place[b])) for a in place}


NEAR = _neighbours()
_DATE = re.compile(r"(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|"
                   r"(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d|(?:19|20)\d\d")


def _lower(text: str) -> str:
    """Lower case, place by place: U+0130 is the one character that becomes two."""
    return text.replace("\u0130", "i").lower()


def char_bits(c: str) -> float:
    return log2(10 if c.isdigit() else 26 if c.isascii() and c.isalpha() else 33 if c.isascii() else 1000)


def _repeats(value: str) -> list[list[tuple[int, int]]]:
    """For each place the blocks that stand there twice or more: (size, times), each block no repeat itself."""
    codes, n = np.array(list(map(ord, value))), len(value)
    out: list[list[tuple[int, int]]] = [[] for _ in value]
    least, reach = np.full(n, n + 1), np.zeros(n, int)  # the smallest block of a place, and how far it goes on
    for size in range(1, n // 2 + 1):
        differ = np.flatnonzero(codes[:-size] != codes[size:])
        if len(differ) == n - size:
            continue
        at = np.arange(n - size)
        further = np.append(differ, n - size)[np.searchsorted(differ, at)] - at
        found = (further >= size) & ~((size % least[:n - size] == 0) & (reach[:n - size] >= size))
        for i in np.flatnonzero(found).tolist():
            if not any(size % q == 0 and q * t >= size for q, t in out[i]):
                out[i].append((size, 1 + int(further[i]) // size))
        new = found & (least[:n - size] > n)
        least[:n - size][new] = size
        reach[:n - size][new] = further[new] + size
    return out


def _ends(start: int, last: int, least: int, step: int = 1) -> list[int]:
    """Where a span that could go on to ``last`` may end: after a few steps, or there."""
    ends = list(range(start + step * -(-least // step), min(last, start + step * SHORT) + 1, step))
    return ends if not ends or ends[-1] == last else [*ends, last]


def guess_bits(value: str, ranks: dict[str, int]) -> float:
    """The least number of bits that the value takes to guess, over all ways to cut it into parts."""
    n, low = len(value), _lower(value)
    plain = low.translate(_SHIFT)
    best = [0.0] + [float("inf")] * n
    dates = {m.start(): m.end() for m in _DATE.finditer(value)}
    repeats = _repeats(value)
    # where a walk over touching keys, and a sequence in steps of one or minus one, that starts at a place must end
    walk, rise, fall = ([*range(1, n + 1)] for _ in range(3))
    for i in range(n - 2, -1, -1):
        if plain[i + 1] in NEAR.get(plain[i], ()):
            walk[i] = walk[i + 1]
        step = ord(low[i + 1]) - ord(low[i])
        if low[i + 1].isalnum() and step == 1:
            rise[i] = rise[i + 1]
        elif low[i + 1].isalnum() and step == -1:
            fall[i] = fall[i + 1]
    for i in range(n):
        here = best[i] + (2.0 if i else 0.0)

        def reach(j: int, bits: float, here: float = here) -> None:
            best[j] = min(best[j], here + bits)

        # brute force, one more character; going on costs no new part
        best[i + 1] = min(best[i + 1], best[i] + char_bits(value[i]))
        for j in range(i + 3, min(n, i + 24) + 1):
            rank = ranks.get(low[i:j])
            if rank:
                upper = sum(map(str.isupper, value[i:j]))
                reach(j, log2(rank + 1) + (0 if not upper else 1 if upper in (1, j - i) else j - i))
        if i in dates:
            reach(dates[i], log2(366 * 120) if dates[i] - i > 4 else log2(150))
        # the same character or block again
        for size, times in repeats[i]:
            bits = sum(map(char_bits, value[i:i + size]))
            for j in _ends(i, i + size * times, max(3, 2 * size), size):
                reach(j, bits + log2((j - i) // size))
        # a walk: each step one of about four, after the first in the same direction mostly
        for j in _ends(i, walk[i], 3):
            reach(j, log2(94) + log2(j - i) + 2.0 * _turns(plain[i:j]))
        for last in (rise[i], fall[i]):
            for j in _ends(i, last, 3):
                reach(j, log2(26) + log2(j - i) + 1)
    return best[n]


def _turns(walk: str) -> int:
    row = len(walk) <= max(map(len, _ROWS)) and any(walk in r or walk[::-1] in r for r in _ROWS)
    return 0 if row else (len(walk) - 1) // 2 + 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the three patterns; a match that fails its length uses up its characters."""
    low = text.lower()
    out = []
    if any(k in low for k in ("passw", "secret", "token", "key")):
        out += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text)]
    out += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], s[2]))


def is_secret(value: str, bits: float, least_bits: float = LEAST_BITS, share: float = SHARE) -> bool:
    return bits >= min(least_bits, share * sum(map(char_bits, value)))


def spans(text: str | None, ranks: dict[str, int], least_bits: float = LEAST_BITS, share: float = SHARE) -> list[dict]:
    """All spans of a text by start, then kind; null counts as empty."""
    text = text or ""
    base = base_spans(text)
    out = [{"kind": k, "start": a, "end": b, "bits": None} for a, b, k in base]
    low = _lower(text)
    found = []
    if any(h in low for h in _HINT):
        found += [m.span(1) for m in CONTEXT.finditer(low)]
    if "://" in text:
        found += [m.span(1) for m in LINK.finditer(text)]
    for a, b in sorted(set(found)):
        b = a + len(text[a:b].rstrip(".,;:!?)]}"))
        if b - a < 8 or any(s <= a and b <= e for s, e, _ in base):
            continue
        bits = guess_bits(text[a:b], ranks)
        if is_secret(text[a:b], bits, least_bits, share):
            out.append({"kind": 3, "start": a, "end": b, "bits": bits})
    return sorted(out, key=lambda s: (s["start"], s["kind"]))


def word_ranks(docs: DataFrame, text: str = "text", words: int = WORDS) -> dict[str, int]:
    """Ranks of the ``words`` most frequent words of all texts, of any script, ties by the word."""
    found = F.regexp_extract_all(F.lower(F.col(f"`{text}`")), F.lit(r"\p{L}{3,24}"), F.lit(0))
    top = (docs.select(F.explode(found).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
           .orderBy(F.desc("n"), "w").limit(words))
    # through a table: collecting a sorted limit would send the first rows of every task to the driver
    rows = sorted(through_table(top, "ranks").collect(), key=lambda r: (-r.n, r.w))
    return {r.w: k for k, r in enumerate(rows, 1)}


def find(docs: DataFrame, text: str = "text", out: str = "spans", words: int = WORDS, least_bits: float = LEAST_BITS,
         share: float = SHARE) -> DataFrame:
    """``docs`` with ``out``: array<struct<kind, start, end, bits>> by start, then kind.

    ``kind`` counts in the order of ``KINDS``; places are code points, end
    exclusive; ``bits`` is set for guessed values only. A value that lies within
    a pattern's span is not named twice; one that goes beyond it is judged and
    named as a whole. Null and empty texts have no span. Every row
    gives one row, other columns pass through, one named like ``out`` is
    replaced; an empty table gives an empty result.
    """
    ranks = word_ranks(docs, text, words)

    @F.arrow_udf("array<struct<kind:int,start:int,end:int,bits:double>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("bits", pa.float64())]))
        for texts in batches:
            yield pa.array([spans(t.as_py(), ranks, least_bits, share) for t in texts], kind)

    return docs.withColumn(out, run(F.col(f"`{text}`")))


def listed(found: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"),
                                                                 s["end"].cast("string"))), ",")
