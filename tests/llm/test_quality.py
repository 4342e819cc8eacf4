import re
from collections import Counter

import numpy as np

from kalangu.llm import quality, queries


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    often, hit = Counter(windows), set()
    for i, w in enumerate(windows):
        if often[w] > 1:
            hit |= {i, i + 1, i + 2}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def test_counts():
    for t in (None, "", " \n ", "a b a b a b", "x y z x y z x", "a\na\n \n\na", "| # é 中 b *", "a\r\na\r\nb", "\n".join(["q w e"] * 9)):
        assert quality.counts(t)[:5] == brute(t), t


def test_query(spark, docs, labels):
    text = {r.doc_id: r.text for r in docs.collect()}
    rows = queries.op2_quality(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(text)
    for r in rows:
        assert tuple(r)[1:6] == brute(text[r.doc_id])
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_keeps_good_and_drops_bad(spark):
    sf = "/root/testdata/sf0.1"
    rows = [r for r in queries.op2_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
            if not r.base_failed and __import__("zlib").crc32(str(r.doc_id).encode()) % 5 == 0]
    good, bad = [r.kept for r in rows if r.quality], [r.kept for r in rows if not r.quality]
    assert sum(good) / len(good) > 0.96 and sum(bad) / len(bad) < 0.2


def test_forest_isolates_what_is_far():
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, (2_000, 3))
    forest = quality.Forest.grow(x, x.min(axis=0), np.array([20.0, 20.0, 20.0]))
    near, far = forest.score(np.zeros((1, 3)))[0], forest.score(np.full((1, 3), 15.0))[0]
    assert near < 0.6 < far
    again = quality.Forest.grow(x, x.min(axis=0), np.array([20.0, 20.0, 20.0]))
    assert again.score(x[:9]).tolist() == forest.score(x[:9]).tolist()


def test_edges(spark, edge, nothing):
    odd = spark.createDataFrame([(4, 1), (7, 0), (5, None), (None, 1), (5, 1)], "doc_id long, quality int")
    for labels in (odd, odd.limit(0)):
        rows = quality.rate(edge, labels).collect()
        assert len(rows) == edge.count() and all(r.kept is not None for r in rows)
        assert all(r.base_failed and not r.kept for r in rows if r.n_words == 0)
    assert quality.rate(nothing, odd).count() == 0
