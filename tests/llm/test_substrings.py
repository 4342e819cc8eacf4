import random
import re


import numpy as np

from kalangu.llm import substrings


def brute(rows):
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, w in words:
        for k in range(len(w) - 12):
            if i is not None:
                key = tuple(w[k:k + 13])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if i is not None and first[tuple(w[k:k + 13])] < i:
                gone[k:k + 13] = [True] * 13
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.deduplicated) for r in substrings.deduplicate(df).collect()), key=str)


def test_cover_meets_every_shift():
    pairs = {(a - b) % substrings.PERIOD for a in substrings.COVER for b in substrings.COVER}
    assert pairs == set(range(substrings.PERIOD)) and substrings.ANCHOR + substrings.PERIOD - 1 == substrings.SPAN


def test_runs_tell_order():
    h = substrings._word_hashes("a b a b b a")
    r = substrings.runs(h, 2)
    assert r[0] == r[2] and len(set(r.tolist())) == 3 and len(substrings.runs(h, 9)) == 0
    assert isinstance(r, np.ndarray)


def test_word_hashes_do_not_depend_on_place_or_block(monkeypatch):
    rng = random.Random(2)
    words = ["".join(rng.choice("abé中") for _ in range(rng.randint(1, 6))) for _ in range(2_000)]
    text = "".join(rng.choice([" ", "\n\t ", "  "]) + w for w in words)
    whole = substrings._word_hashes(text)
    assert len(whole) == len(words) and len(set(map(tuple, whole.tolist()))) == len(set(words))
    assert {w: tuple(h) for w, h in zip(words, whole.tolist())} == {w: tuple(substrings._word_hashes(w)[0].tolist()) for w in words}
    monkeypatch.setattr(substrings, "BLOCK", 50)
    assert (substrings._word_hashes(text) == whole).all()
    assert len(substrings._word_hashes(None)) == len(substrings._word_hashes(" \n ")) == 0


def test_every_alignment(spark):
    """Passages of 12 to 15 words at every pair of positions modulo the period."""
    rows, i = [], 0
    for n in (12, 13, 14, 15):
        for a in range(7):
            for b in range(7):
                p = " ".join(f"p{n}_{a}_{b}_{k}" for k in range(n))
                for at in (a, b):
                    rows.append((i, " ".join(f"u{i}_{k}" for k in range(at)) + f" {p} " + f"end{i} tail{i}"))
                    i += 1
    random.Random(1).shuffle(rows)
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_random_repeats(spark):
    rng = random.Random(5)
    passages = [[rng.choice("abcd") for _ in range(rng.randint(5, 40))] for _ in range(12)]
    rows = []
    for i in range(300):
        w = []
        for _ in range(rng.randint(0, 4)):
            w += rng.choice(passages) if rng.random() < 0.7 else [f"n{rng.randrange(9)}" for _ in range(rng.randrange(20))]
        rows.append((rng.randrange(250) - 20, " ".join(w)))
    rows += rows[:40] + [(None, rows[3][1]), (None, None)]
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_edges(edge, nothing):
    rows = [(r.doc_id, r.text) for r in edge.select("doc_id", "text").collect()]
    assert got(edge) == brute(rows)
    out = substrings.deduplicate(edge, out="spans")
    assert out.columns == [*edge.columns, "n_words", "n_removed"]
    assert substrings.deduplicate(nothing).count() == 0


def test_words_of_equal_structure_are_told_apart(spark):
    """Thue-Morse words collide under every polynomial of their bytes modulo a power of two."""
    word = "a"
    while len(word) < 1024:
        word += word.translate({97: 98, 98: 97})
    other = word.translate({97: 98, 98: 97})
    twelve = " ".join(f"w{k}" for k in range(12))
    df = spark.createDataFrame([(1, f"{twelve} {word}"), (2, f"{twelve} {other} tail"), (3, f"x {twelve} {other}")], "doc_id bigint, text string")
    got = {r.doc_id: r.n_removed for r in substrings.deduplicate(df).collect()}
    assert got == {1: 0, 2: 0, 3: 13}


def test_windows_go_back_by_eight_bytes(spark):
    """A window travels to its document as one number; rows of one id with other texts lose their own windows only."""
    same, other = " ".join(f"w{k}" for k in range(20)), " ".join(f"v{k}" for k in range(20))
    rows = [(1, same + " a b"), (2, "c " + same), (3, other), (3, "d e " + same + " " + other)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert dict(substrings.covered(df).dtypes)["hashes"] == "array<bigint>"
    assert got(df) == brute(rows)
