import random

import corpus_pipeline
from kalangu.llm import similar
from tests_llm_brute import similar_groups


def kept(texts):
    """Ids that all pairs of similarity 0.8 leave."""
    return sorted(i for i, k in similar_groups(texts).items() if i == k)


def test_stage_drops_all_near_copies_and_nothing_else(spark, docs):
    rng = random.Random(3)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for k in range(60):  # edited copies, of similarity 0.6 to 1, and copies of copies
        words = [f"w{rng.randrange(9_000)}" for _ in range(200)]
        for c in range(4):
            texts[100_000 + 10 * k + c] = " ".join(words)
            for _ in range(1 + k % 6):
                words[rng.randrange(200)] = f"x{rng.randrange(9_000)}"
    texts |= {200_000: "", 200_001: None, 200_002: " \t"}
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = corpus_pipeline.one_of_each_group(spark, df, "")
    assert sorted(r.doc_id for r in got.collect()) == kept(texts)


def test_edges(edge, nothing):
    got = similar.keep_one(edge)
    assert got.columns == edge.columns
    assert sorted(r.doc_id for r in got.filter("doc_id is not null").collect()) == [1, 4, 5, 5, 5, 6, 7]
    assert got.filter("doc_id is null").count() == 2 and similar.keep_one(nothing).count() == 0


def test_texts_go_to_python_in_small_batches(spark, monkeypatch):
    """Every table of the operator is written under the bound; the session's setting comes back."""
    from kalangu.llm import jaccard, simhash

    name, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before = spark.conf.get(name)
    for module in (similar, jaccard, simhash):
        write = module.through_table
        monkeypatch.setattr(module, "through_table", lambda df, label="cut", w=write: (seen.append(int(spark.conf.get(name))), w(df, label))[1])
    df = spark.createDataFrame([(1, "a b c d e f g"), (2, "a b c d e f g"), (3, "q r s t u v w")], "doc_id long, text string")
    assert sorted(r.doc_id for r in similar.keep_one(df).collect()) == [1, 3]
    assert seen and max(seen) <= similar.BATCH and spark.conf.get(name) == before
