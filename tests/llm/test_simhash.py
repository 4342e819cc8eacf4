import re

import numpy as np
import xxhash

from kalangu.llm import components, queries, simhash


def brute_print(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i:i + 4]).encode(), seed=42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(prints):
    values = sorted(set(prints))
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= 4:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {v: find(v) for v in values}


def check(rows, got):
    groups = brute_groups([brute_print(t) for _, t in rows])
    least = {}
    for i, t in rows:
        r = groups[brute_print(t)]
        least[r] = min((x for x in (i, least.get(r)) if x is not None), default=None)
    want = sorted(((i, f"{brute_print(t):016x}", least[groups[brute_print(t)]]) for i, t in rows), key=str)
    assert sorted((tuple(r) for r in got), key=str) == want


def test_codewords():
    _, _, patterns = simhash._golay()
    assert sorted(set((patterns >= 0).sum(axis=1))) == [1, 6]
    rng = np.random.default_rng(0)
    words = rng.integers(0, 1 << 23, 3_000).astype("i4")
    own = simhash.near_codewords(words)[:, :1]
    for bit in range(23):
        assert (simhash.near_codewords(words ^ np.int32(1 << bit)) == own).any(axis=1).all()


def test_keys_miss_no_pair_of_four_bits():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 63, 3_000).astype("u8")
    y = x.copy()
    for _ in range(4):
        y ^= np.uint64(1) << rng.integers(0, 64, len(x)).astype("u8")
    index, probe = simhash._keys(x, False).to_pylist(), simhash._keys(y, True).to_pylist()
    assert all(set(a) & set(b) for a, b in zip(index, probe))


def test_links_of_dense_and_chained_prints(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 62, 30)
    values = set(base.tolist())
    for b in base[:10].tolist():  # chains, each step within four bits
        for _ in range(12):
            for bit in rng.integers(0, 62, 4).tolist():
                b ^= 1 << bit
            values.add(b)
    values |= {int(base[11]) ^ 1 << i ^ 1 << j for i in range(12) for j in range(12)}  # a dense group
    prints = spark.createDataFrame([(v,) for v in values], "fp bigint")
    found = {r.node: r.root for r in components.components(simhash.links(prints)).collect()}
    assert {v: found.get(v, v) for v in values} == brute_groups(values)


def test_joins_of_exploded_keys_are_not_broadcast(spark, monkeypatch):
    plans, write = {}, simhash.through_table

    def kept(df, label="cut"):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, label)

    monkeypatch.setattr(simhash, "through_table", kept)
    found = simhash.links(spark.range(50).selectExpr("xxhash64(id) AS fp"))
    for plan in (plans["stars"], found._jdf.queryExecution().executedPlan().toString()):
        assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan


def test_query(spark, docs):
    check([(r.doc_id, r.text) for r in docs.collect()], queries.op3_simhash(spark, "/root/testdata/sf0.001").collect())


def test_edges(edge, nothing):
    check([(r.doc_id, r.text) for r in edge.select("doc_id", "text").collect()], simhash.near_duplicates(edge).collect())
    assert simhash.near_duplicates(nothing).count() == 0
    assert simhash.keep_one(nothing).count() == 0
    kept = simhash.keep_one(edge)
    assert kept.columns == edge.columns
    assert sorted(r.doc_id for r in kept.filter("doc_id is not null").collect()) == [1, 4, 5, 5, 5, 6, 7]


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 1), (9, 8), (8, 9), (5, 5), (None, 4), (20, 21), (21, 22), (22, 23), (23, 24), (24, 25)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a int, b int")).collect()}
    assert {k: v for k, v in got.items() if k != v} == {2: 1, 3: 1, 9: 8, 21: 20, 22: 20, 23: 20, 24: 20, 25: 20}
    assert components.components(spark.createDataFrame([], "a int, b int")).count() == 0
