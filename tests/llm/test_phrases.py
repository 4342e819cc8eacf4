import random
import re
from collections import Counter

import numpy as np
import pytest

from kalangu.llm import phrases

PIECE, WORD = re.compile(r"[.,;:!?\x0A-\x0D]"), re.compile(r"[^\x20\x09]+")
LOWER = {k: k + 32 for k in range(65, 91)}


def brute(rows, least, first=2000):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = lang if lang is not None else "und"
        for piece in PIECE.split((text or "").translate(LOWER)):
            w = WORD.findall(piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i:i + k])) for k in range(1, 6) for i in range(len(w) - k + 1))
    held = {(lang, p): a for (lang, p), a in f.items() if len(p) > 1 and a >= least}
    out = []
    for (lang, p), a in held.items():
        if any(g == lang and len(q) > len(p) and b * 100 >= 100 * a and any(q[i:i + len(p)] == p for i in range(len(q)))
               for (g, q), b in held.items()):
            continue
        s, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        out.append((lang, -s, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]], n[lang]))
    rows, rank = [], Counter()
    for lang, s, a, p, left, right, all_ in sorted(out):
        rank[lang] += 1
        if rank[lang] <= first:
            rows.append((lang, rank[lang], p.decode(), -a, left, right, all_, -s))
    return sorted(rows)


def made(rng, n):
    words = [f"w{k}" for k in range(30)] + ["É", "é", "A", "a", "x-y", "\x00"]
    weights = [1 / (k + 1) for k in range(len(words))]
    rows = []
    for _ in range(n):
        text = "".join(rng.choices(words, weights)[0] + rng.choices([" ", "\t ", ". ", "\n", " kind of thing "], [9, 2, 1, 1, 1])[0]
                       for _ in range(rng.randrange(80)))
        rows.append((text, rng.choice(["en", "fr", None, "und"])))
    return rows + [("", "en"), (None, "en"), (" . ", None), ("kind of " * 3_000, "fr")]


def table(spark, rows):
    return spark.createDataFrame([(k if k % 9 else None, t, g) for k, (t, g) in enumerate(rows)],
                                 "doc_id bigint, text string, lang string").repartition(4)


@pytest.mark.parametrize("least, first", [(20, 2000), (8, 30)])
def test_equals_brute_force(spark, least, first):
    rows = made(random.Random(least), 300)
    got = phrases.collocations(table(spark, rows), least=least, first=first)
    assert sorted(map(tuple, got.collect())) == brute(rows, least, first)


def test_colliding_fingerprints_are_counted_by_text(spark):
    """Nine bits of fingerprint: nearly every frequent one stands for several phrases."""
    rows = made(random.Random(5), 120)
    got = phrases.collocations(table(spark, rows), least=10, bits=9)
    assert sorted(map(tuple, got.collect())) == brute(rows, 10)


def test_full_bitmap_changes_nothing(spark):
    rows = made(random.Random(6), 120)
    got = phrases.collocations(table(spark, rows), least=10, most=64)
    assert sorted(map(tuple, got.collect())) == brute(rows, 10)


def test_chunks_count_every_run_once(monkeypatch):
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abcdefg") + rng.choice(["", ".", "\n"]) for _ in range(rng.randrange(90))) for _ in range(60)] + ["", None, " ", "."]
    want = Counter()
    for d, t in enumerate(texts):
        for piece in PIECE.split(t or ""):
            w = WORD.findall(piece)
            want.update((d, " ".join(w[i:i + k]).encode()) for k in range(1, 6) for i in range(len(w) - k + 1))
    for size, whole in ((37, 1 << 20), (41, 10), (1000, 10), (10_000, 1 << 20)):
        monkeypatch.setattr(phrases, "CHUNK", size)
        monkeypatch.setattr(phrases, "WHOLE", whole)
        phrases._powers.cache_clear()
        got = Counter()
        for c in phrases.chunks(texts):
            assert len(c.ids) <= size
            for k in range(1, 6):
                got.update((int(c.doc[s]), c.text(s, k)) for s in c.starts(k).tolist())
        assert got == want
    phrases._powers.cache_clear()


def test_fingerprint_does_not_depend_on_place():
    rng = np.random.default_rng(3)
    words = rng.integers(0, 1 << 64, 500, dtype="u8")
    moved = np.concatenate((rng.integers(0, 1 << 64, 77, dtype="u8"), words))
    for k in range(1, 6):
        at, salt = np.arange(500 - k + 1), np.uint64(5)
        one, two = (phrases.fingerprints(phrases.prefixes(w, 0), a, k, 0, salt) for w, a in ((words, at), (moved, at + 77)))
        assert (one == two).all() and len(set(one.tolist())) == len(one)


def test_edges(edge, nothing):
    rows = phrases.collocations(edge, least=2).collect()
    assert {r.lang for r in rows} == {"en"}  # the rows without language have no phrase twice
    assert phrases.collocations(nothing).count() == 0
