import math
from collections import Counter, defaultdict

import pytest

from kalangu.llm import mixing


def test_exponent_meets_its_target():
    tokens = [1_000_000, 50_000, 20_000, 10_000]
    a = mixing.solve(tokens, repeats=4)
    assert max(mixing.passes(tokens, a)) == pytest.approx(4, abs=1e-9) and min(mixing.passes(tokens, a)) == 1
    assert mixing.solve([5, 5, 6], repeats=4) == 0 and mixing.solve(tokens, repeats=1) == 1
    a = mixing.solve(tokens, repeats=None, entropy=0.8)
    w = mixing.weights(tokens, a)
    assert -sum(x * math.log(x) for x in w) == pytest.approx(0.8 * math.log(4), abs=1e-9)
    assert mixing.solve(tokens, repeats=None, entropy=0.0) == 1
    for bad in ({"repeats": 0.5}, {"repeats": None}, {"repeats": 2, "entropy": 0.5}, {"repeats": None, "entropy": 2}):
        with pytest.raises(ValueError):
            mixing.solve(tokens, **bad)


def test_budgets(spark):
    rows = [(i, "hot" if i % 3 else f"s{i % 7}", "w " * (i % 40)) for i in range(3_000)]
    plan = mixing.plan(spark.createDataFrame(rows, "doc_id long, source string, text string"), repeats=3).collect()
    assert len(plan) == len(rows) and all(r.copies >= 1 for r in plan)
    held, got, weight = Counter(), Counter(), {}
    for r in plan:
        held[r.source] += r.n_tokens
        got[r.source] += r.n_tokens * r.copies
        weight[r.source] = r.weight
    assert sum(weight.values()) == pytest.approx(1)
    most = held["hot"]
    for s in held:
        budget = got["hot"] * weight[s] / weight["hot"]
        assert got["hot"] == most and budget - 400 < got[s] <= budget + 1  # short of its budget by less than a block's last text


def test_mix_copies_rows(spark):
    rows = [(i, "a" if i else "b", "one two three") for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    plan = {r.doc_id: r.copies for r in mixing.plan(df).collect()}
    assert plan[0] == 4 and all(plan[i] == 1 for i in range(1, 9))
    assert Counter(r.doc_id for r in mixing.mix(df).collect()) == plan
    assert sorted(mixing.mix(df).collect()) == sorted(mixing.mix(df.repartition(5)).collect())


def test_edges(edge, nothing):
    plan = mixing.plan(edge).collect()
    assert len(plan) == edge.count() and all(r.copies >= 1 for r in plan)
    copies = defaultdict(set)
    for r in plan:
        copies[(r.doc_id, r.source)].add(r.copies)
    assert all(len(c) == 1 for c in copies.values())
    mixed = mixing.mix(edge)
    assert mixed.columns == edge.columns and mixed.count() >= edge.count()
    assert mixing.plan(nothing).count() == 0 and mixing.mix(nothing).count() == 0
    assert mixing.mix(edge.filter("trim(text) = ''")).count() == edge.filter("trim(text) = ''").count()
    with pytest.raises(ValueError):
        mixing.plan(edge, max_sources=1)
