from kalangu.llm import queries, toxicity


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_equals_edit_distance():
    import random

    rng = random.Random(4)
    terms = ["idiot", "idiom", "moron", "worthless", "disgusting", "pathetically", "abc"]
    machine = toxicity.Automaton(terms, most_states=50)
    words = {"".join(rng.choice(t[:k] + "xyz" + t[k:]) for _ in range(rng.randint(3, 12))) for t in terms for k in range(3) for _ in range(40)}
    for t in terms:
        for _ in range(60):
            w = list(t)
            for _ in range(rng.randint(0, 3)):
                k = rng.randrange(len(w) + 1)
                w[k:k + rng.randint(0, 1)] = rng.choice(["", "q", "e", "t"])
            words.add("".join(w))
    for w in words:
        near = [(distance(w, t), k) for k, t in enumerate(terms) if distance(w, t) <= toxicity.errors_allowed(t)]
        assert machine.match(w) == (min(near)[::-1] if near else None), w


def test_words_are_read_as_meant():
    assert [toxicity.bare(w) for w in ("IDIOT!!", "id1ot", "idiooooot,", "$$$", "“moron”", "12345")] == [
        "idiot", "idiot", "idiot", "", "moron", "12345"]


def test_quotation_counts_less_than_abuse():
    reader = toxicity.Reader(toxicity.Model())
    value = lambda t: reader.features(t)[0][0]
    assert value("he wrote \"idiot\" on the board and left it there") < value("the idiot left it there") < value("you idiot leave it there")
    assert reader.features("nothing here") == ([0.0] * 6, 0)


def test_held_out_rows_teach_nothing(spark):
    import zlib

    rows = [(i, f"some clean w{i} here" if i % 2 else f"some blorgth w{i} here and blorgth x{i}") for i in range(400)]
    labels = [(i, 1 - i % 2 if zlib.crc32(str(i).encode()) % 5 else i % 2) for i in range(400)]  # held-out labels are wrong
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.fit(docs, marks)).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert all(r.predicted == 1 - r.doc_id % 2 for r in got)


def test_accuracy_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    rows = queries.op1_toxicity(spark, sf).filter("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    toxic, clean = [r.score for r in rows if r.toxic], [r.score for r in rows if not r.toxic]
    assert sum(s >= 0.5 for s in toxic) / len(toxic) > 0.85
    assert sum(s >= 0.5 for s in clean) / len(clean) < 0.01


def test_edges(spark, edge, nothing):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    odd = spark.createDataFrame([(5, 1), (5, 0), (None, 1), (4, None), (1, 0)], "doc_id long, toxic int")
    for labels in (none, odd):
        got = toxicity.score(edge, toxicity.fit(edge, labels))
        rows = got.collect()
        assert len(rows) == edge.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
        assert all(r.held_out is False for r in rows if r.doc_id is None)
    assert toxicity.score(nothing, toxicity.fit(nothing, odd)).count() == 0
    kept = toxicity.reject(edge, toxicity.Model())
    assert kept.columns == edge.columns and kept.count() == edge.count()
