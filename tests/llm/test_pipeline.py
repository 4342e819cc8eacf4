from collections import Counter


import corpus_pipeline
from kalangu.llm import mixing, pieces, toxicity
from tests_llm_brute import similar_groups, sanitised

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def brute(spark):
    """The stages one after the other in plain Python; the fitted model is the only part taken over."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    reader = toxicity.Reader(model)
    rows = [r.asDict() for r in docs.collect()]

    def line(text):
        return model.weights[0] + sum(w * round(x, 2) for w, x in zip(model.weights[1:], reader.features(text)[0]))

    rows = [r for r in rows if line(r["text"]) < 0]
    groups = similar_groups({r["doc_id"]: r["text"] for r in rows})
    rows = [r for r in rows if groups[r["doc_id"]] == r["doc_id"]]
    for r in rows:
        r["text"] = sanitised(r["text"])
    plan = {r.doc_id: r.copies for r in mixing.plan(spark.createDataFrame(rows, docs.schema)).collect()}
    lib = pieces.Pieces(pieces.default_model()).library
    out = Counter()
    for r in rows:
        ids = lib.encode(r["text"], add_bos=True, add_eos=True)
        out[(r["doc_id"], r["text"], tuple(ids), lib.decode(ids))] += plan[r["doc_id"]]
    return out


def test_run_equals_brute_force(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == [*COLUMNS, "ids", "decoded"]
    assert Counter((r.doc_id, r.text, tuple(r.ids), r.decoded) for r in got.collect()) == brute(spark)


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == COLUMNS and docs.count() > 0


def test_stages_take_an_empty_table_and_odd_rows(spark, edge):
    odd = edge.select(*COLUMNS)
    for docs in (odd.limit(0), odd):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
            docs.count()
