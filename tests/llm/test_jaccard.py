import random

import numpy as np
import pytest

from kalangu.llm import jaccard


def brute(texts, percent=85, size=4):
    """(size of the set, smallest id reachable) by all pairs."""
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k:k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset()
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in sets.items():
        for j, b in sets.items():
            if j < i and a and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in texts}


def got(spark, texts, **kw):
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(5)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.classes(df, **kw).collect()}


@pytest.mark.parametrize("percent, size, seed", [(85, 4, 1), (80, 5, 2), (50, 1, 3)])
def test_equals_all_pairs(spark, percent, size, seed):
    rng = random.Random(seed)
    texts = {}
    common = [f"the{k}" for k in range(60)]
    for k in range(40):  # edited copies and copies of those, of many sizes, with passages that many share
        words = [f"w{rng.randrange(3_000)}" for _ in range(rng.choice([1, 3, 6, 9, 14, 40, 120, 200]))]
        if k % 3 == 0:
            words += common
        for c in range(5):
            texts[100 * k + c] = rng.choice(" \n").join(words)
            for _ in range(rng.randrange(1 + len(words) // 12 + 1)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(9_000)}"
            if rng.random() < 0.3:
                words.append(f"y{rng.randrange(9)}")
    texts |= {9_000: "", 9_001: None, 9_002: " \t", 9_003: "One", 9_004: "one", 9_005: "two", 9_006: texts[0], 9_007: texts[0].upper()}
    assert got(spark, texts, percent=percent, size=size) == brute(texts, percent, size)


def test_a_chain_is_one_component(spark):
    """Each text is close to the next one only; no single centre holds the list together."""
    rng = random.Random(4)
    words = [f"w{k}" for k in range(100)]
    texts = {}
    for k in range(60):
        texts[k] = " ".join(words)
        words[rng.randrange(100)] = f"x{k}"
    want = brute(texts)
    assert len({c for _, c in want.values()}) < 5 and got(spark, texts) == want


def test_prefix_holds_a_common_gram_of_every_similar_pair():
    rng = np.random.default_rng(5)
    for n in range(6, 400, 7):
        a = np.unique(rng.integers(0, 1 << 64, n, dtype="u8"))
        lost = int(0.08 * len(a))
        b = np.unique(np.concatenate((a[lost:], rng.integers(0, 1 << 64, lost, dtype="u8"))))
        both = len(np.intersect1d(a, b))
        if 100 * both < 85 * (len(a) + len(b) - both):
            continue
        cut = []
        for s in (a, b):
            early, late = jaccard.halves(s, 85)
            cut.append({*np.concatenate((np.sort(early), late))[:jaccard.prefix_length(len(s), 85)].tolist()})
        assert cut[0] & cut[1]


def test_edges(edge, nothing):
    rows = jaccard.classes(edge).collect()
    assert len(rows) == edge.count() and jaccard.classes(nothing).count() == 0
    own = sorted((r.doc_id, r.component_id) for r in rows if r.doc_id is not None)
    assert own == [(i, i) for i in (1, 2, 3, 4, 5, 5, 5, 6, 7)]
    assert [r.component_id for r in rows if r.doc_id is None] == [None, None]


def test_a_row_without_id_goes_with_its_equals(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (3, "A b c d e"), (None, "f")], "doc_id bigint, text string")
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.classes(df).collect()), key=repr) == [(3, 2, 3), (None, 1, None), (None, 2, 3)]


def far_from_each_other(k, n=390, swapped=0.017, seed=6):
    """``k`` edited copies of one text whose sets of four-word shingles are about 0.75 alike."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(n)]
    return {i: " ".join(f"x{rng.randrange(10**9)}" if rng.random() < swapped else w for w in base) for i in range(k)}


def test_a_group_without_links_gives_few_pairs(spark, monkeypatch):
    """Its members share n-grams of their prefixes; the filters tell them apart before the pairs leave the join."""
    texts, made = far_from_each_other(60), []
    write, joined = jaccard.through_table, jaccard.unconnected
    monkeypatch.setattr(jaccard, "unconnected", lambda *a: (made.append(write(joined(*a), "made")), made[0])[1])
    result = got(spark, texts)
    assert result == brute(texts)
    assert made[0].count() < 300 < 60 * 59 / 2


def test_a_pair_leaves_one_list(spark):
    """Two sets of one order of n-grams, ten of them in common: the first list alone makes the pair."""
    rows = spark.createDataFrame([(h, node, 40, h, node) for node in (1, 2) for h in range(10)], "h bigint, node bigint, n int, pos int, root bigint")
    cells = spark.createDataFrame([(1, [0] * 32), (2, [0] * 32)], "node bigint, cells array<bigint>")
    assert [tuple(r) for r in jaccard.unconnected(rows, cells, 50).collect()] == [(1, 2)]


def test_odd_classes_never_pass_the_difference():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = (np.unique(rng.integers(0, 3_000, rng.integers(0, 3_000)).astype("u8")) for _ in "ab")
        differ = int(np.unpackbits((jaccard.odd_cells(a) ^ jaccard.odd_cells(b)).view("u1")).sum())
        assert differ <= len(np.setxor1d(a, b))


def test_members_meet_the_chosen_ones_behind_the_suffix_filter(spark):
    """8 members in 8 lists, another one chosen in each: only the pair that may be similar leaves the join, once a list at most."""
    many, members = 2 ** 63 - 1, range(8)
    placed = spark.createDataFrame([(h, x, 100, h, x) for h in members for x in members], "h bigint, node bigint, n int, pos int, root bigint")
    open_ = spark.createDataFrame([(h, h, 100, h) for h in members], "h bigint, ynode bigint, yn int, yroot bigint")
    # a word of classes of its own each, but for 0 and 1
    own = {x: max(x, 1) for x in members}
    cells = spark.createDataFrame([(x, [many if k == own[x] else 0 for k in range(32)]) for x in members], "node bigint, cells array<bigint>")
    done = lambda: spark._jsparkSession.sharedState().statusStore().executionsCount()
    before = done()
    near = {tuple(r) for r in jaccard.starred(placed, open_, cells, 85).collect()}
    assert near == {(0, 1)}
    store = spark._jsparkSession.sharedState().statusStore()
    made = []
    for run in range(before, done()):
        values, nodes = store.executionMetrics(run), store.planGraph(run).allNodes()
        for k in range(nodes.size()):
            node = nodes.apply(k)
            if "Join" in node.name() and "xroot" in node.desc():
                made += [values.get(node.metrics().apply(m).accumulatorId()).get() for m in range(node.metrics().size())
                         if node.metrics().apply(m).name() == "number of output rows"]
    assert made and all(int(n.replace(",", "")) <= 2 for n in made)
