import hashlib

import numpy as np

from kalangu.llm import versions


def brute(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), [-ord(c) for c in r[1] or ""] + [1]))
    out = []
    for k, (i, t) in enumerate(order):
        t, n = t or "", order[(k + 1) % len(order)][1] or ""
        cut = len(t) // 3
        e = t[:len(t) - cut] + n[:cut]
        a, b, c = (set(versions.digests(x).tolist()) for x in (t, e, n))
        like = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), round(like(a, b), 9), round(like(a, c), 9)))
    return sorted(out, key=str)


def got(df):
    rows = versions.compare(df).collect()
    return sorted(((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in rows), key=str), rows


def test_peeling_recovers_the_difference():
    rng = np.random.default_rng(0)
    shared = rng.integers(0, 1 << 63, 300).astype("u8")
    for extra_left, extra_right in ((0, 0), (3, 2), (0, 7), (40, 60)):
        left = np.concatenate([shared, rng.integers(0, 1 << 63, extra_left).astype("u8")])
        right = np.concatenate([shared, rng.integers(0, 1 << 63, extra_right).astype("u8")])
        x, y = versions.sketch([left], 384), versions.sketch([right], 384)
        l, r, done = versions.peel(*(p - q for p, q in zip(x, y)))
        assert (l[0], r[0], done[0]) == (extra_left, extra_right, True)
        assert versions.likeness([left], [right])[0] == 300 / (300 + extra_left + extra_right)


def test_too_small_a_sketch_is_noticed():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 1 << 63, 500).astype("u8"), rng.integers(0, 1 << 63, 500).astype("u8")
    x, y = versions.sketch([a], 12), versions.sketch([b], 12)
    assert not versions.peel(*(p - q for p, q in zip(x, y)))[2][0]
    assert versions.likeness([a], [b])[0] == 0


def test_query(spark, docs):
    values, rows = got(docs)
    assert values == brute([(r.doc_id, r.text) for r in docs.collect()])
    text = {r.doc_id: r.text for r in docs.collect()}
    prints = {}
    for r in rows:
        assert prints.setdefault(text[r.doc_id], r.fingerprint) == r.fingerprint
    assert sum(r.near_edited > r.near_next for r in rows) > 0.95 * len(rows)


def test_ranges_borrow_from_each_other(spark, monkeypatch):
    monkeypatch.setattr(versions, "BUCKET", 3)
    rows = [(i * i * 7 - 50, f"text {i}. and more of {i % 4}. " * (i % 5)) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(df)[0] == brute(rows)


def test_edges(spark, edge, nothing, monkeypatch):
    rows = [(r.doc_id, r.text) for r in edge.select("doc_id", "text").collect()]
    assert got(edge)[0] == brute(rows)
    monkeypatch.setattr(versions, "BUCKET", 2)
    assert got(edge)[0] == brute(rows)
    assert versions.compare(nothing).count() == 0
    assert versions.compare(nothing).columns == versions.compare(edge).columns
    one = spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")
    assert got(one)[0] == brute([(1, "abcdef")])
