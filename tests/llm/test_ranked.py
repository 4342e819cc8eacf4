import math
import random
import re

import numpy as np
import pytest

from kalangu.llm import ranked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {k: k + 32 for k in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, top=10):
    held = [(i, terms(t)) for i, t in docs]
    N, L = sum(1 for _, w in held if w), sum(len(w) for _, w in held)
    out = []
    for item, text in items:
        scores = []
        for i, w in held:
            m = 100 - 90 + (90 * len(w) * N) // L if L else 0
            s = 0
            for t in set(terms(text)) & set(w):
                df = sum(1 for _, x in held if t in x)
                tf = w.count(t)
                s += math.floor(1000 * math.log((2 * N + 2) / (2 * df + 1))) * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, k + 1, i, -s) for k, (s, _, _, i) in enumerate(sorted(scores)[:top])]
    return sorted(out, key=repr)


def got(spark, docs, items, **kw):
    d = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)
    q = spark.createDataFrame(items, "item_id bigint, text string")
    return sorted((tuple(r) for r in ranked.search(d, q, **kw).collect()), key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)] + ["Été", "ete", "A1", "a1", "中文"]
    weights = [1 / (k + 1) for k in range(len(words))]
    text = lambda n: rng.choice(" -_\n").join(rng.choices(words, weights, k=n))
    docs = [(k, text(rng.randrange(1, 40))) for k in range(250)]
    docs += [(1000 + k, docs[3][1]) for k in range(60)] + [(None, docs[7][1]), (5, docs[5][1]), (2000, None), (2001, ""), (2002, " -- ")]
    items = [(k, text(rng.randrange(1, 90))) for k in range(25)] + [(3, "w1 w2"), (3, "w1 w2"), (90, None), (91, "nowhere"), (None, "w3 w4 A1")]
    assert got(spark, docs, items) == brute(docs, items)
    if not seed:  # items in blocks
        assert got(spark, docs, items, block_terms=100) == brute(docs, items)


def test_more_than_64_terms_and_ties_by_id(spark):
    many = " ".join(f"t{k}" for k in range(200))
    docs = [(k, many) for k in range(40)] + [(100, many + " t7")]
    assert got(spark, docs, [(1, many)]) == brute(docs, [(1, many)])


def test_presence_groups_equal_columns():
    rng = np.random.default_rng(1)
    bits = rng.random((70, 300)) < 0.02
    order, starts, masks = ranked.presence(bits)
    groups = np.split(order, starts[1:])
    assert sorted(order.tolist()) == list(range(300)) and len({m.tobytes() for m in masks.T}) == len(starts)
    assert all((bits[:, g] == masks[:, [k]]).all() for k, g in enumerate(groups))


def test_long_texts_do_not_overflow():
    n = np.array([3, 10 ** 12])
    assert ranked.lengths(n, 10 ** 9, 10 ** 13).tolist() == [10 + 90 * x * 10 ** 9 // 10 ** 13 for x in (3, 10 ** 12)]


def test_edges(edge, nothing, spark):
    items = spark.createDataFrame([(1, "alpha one", 0), (2, None, 0)], "item_id bigint, text string, doc_id int")
    rows = ranked.search(edge, items).collect()
    # the long text holds alpha, a row without id too; three rows of id 5, two of them with the term "one"
    assert {r.doc_id for r in rows} == {4, None, 5} and [r["rank"] for r in sorted(rows, key=lambda r: r["rank"])] == [1, 2, 3, 4, 5][:len(rows)]
    assert ranked.search(nothing, items).count() == 0 and ranked.search(edge, items.limit(0)).count() == 0
