import hashlib
import re

from pyspark.sql import functions as F

from kalangu.llm import privacy, queries

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def holds(kind, m):
    d = re.sub("[^0-9]", "", m)
    return {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m.split(".")),
            "card": lambda: 16 <= len(d) <= 19 and luhn(d), "phone": lambda: 8 <= len(d) <= 15}[kind]()


def brute(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if holds(k, m[0])]


HARD = ["", None, "a@b.c", "a@b", "x+a@b.c.d.e..f a@b.c+d@e.f", "@@a@b.c@d.e", "1.2.3.4.5.6.7.8", "256.1.1.1 0255.1.1.1 00000001.2.3.4 1.2.3",
        "4111 1111 1111 1111", "4111-1111-1111-1111x4111111111111112", "41111111111111110000 4111111111111111 1", "+1 (377) 555-0271.",
        "+1 2 3 +12345678 +1234567 +1234567890123456", "é😀 a@b.c 😀 10.0.0.1", "9" * 5_000, "1 " * 5_000, "a" * 20_000 + "@", "a." * 9_000,
        "+1" + "(" * 4_000, "1.1." * 3_000, "mail me@x.y.\nnext 1.1.1.1", "+5-(5) 5.5-5555 5"]


def test_base_spans_equal_python(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(HARD)], "i int, text string")
    text = F.coalesce("text", F.lit(""))
    rows = df.select("i", privacy.listed(F.concat(*privacy.base_spans(text).values())).alias("s")).collect()
    for r in rows:
        assert r.s == ",".join(brute(HARD[r.i])), HARD[r.i]


def test_query(spark, docs):
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in queries.op7_privacy(spark, "/root/testdata/sf0.001").collect():
        want = brute(text[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w.startswith(k) for w in want) for k in PATTERNS]
        assert r.spans.startswith(",".join(want))


def corpus(spark):
    """Zeppelinfan stands only beside one address, in five different windows; house stands everywhere."""
    rows = [(i, f"number{i} house Zeppelinfan wrote from ann@mail.example number{i}{i} in spring") for i in range(5)]
    rows += [(5 + i, f"the house wrote letter{i} number{i} from spring to autumn") for i in range(200)]
    return spark.createDataFrame(rows + [(300 + i, "copied Hapaxword near bob@mail.example only") for i in range(9)], "doc_id long, text string")


def test_terms_that_give_an_entity_away(spark):
    docs = corpus(spark)
    terms = {r.id: r.terms for r in privacy.disclosing_terms(docs).collect()}
    assert terms == {i: ["zeppelinfan"] for i in range(5)}  # copies are one piece of evidence
    found = {r.doc_id: r for r in privacy.find(docs).collect()}
    assert [(s.kind, s.value) for s in found[0].spans] == [(0, "ann@mail.example"), (4, "Zeppelinfan")]
    clean = {r.doc_id: r.text for r in privacy.sanitise(docs).collect()}
    assert clean[0] == "number0 house [TERM] wrote from [EMAIL] number00 in spring"
    assert clean[9] == "the house wrote letter4 number4 from spring to autumn"
    assert clean[300] == "copied Hapaxword near [EMAIL] only"


def test_overlaps_are_covered(spark):
    df = spark.createDataFrame([("write a@10.0.0.1 or a@10.0.0.1.x now",)], "text string")
    spans = F.concat(*privacy.base_spans(F.col("text")).values())
    assert df.select(privacy.sanitised(F.col("text"), spans).alias("t")).first().t == "write [EMAIL] or [EMAIL] now"


def test_edges(edge, nothing):
    rows = privacy.find(edge).collect()
    assert len(rows) == edge.count() and all(r.spans == [] for r in rows)
    kept = privacy.sanitise(edge)
    assert kept.columns == edge.columns and sorted(map(str, kept.collect())) == sorted(map(str, edge.collect()))
    assert privacy.sanitise(nothing).count() == 0


def test_no_python_in_the_plan(spark, docs):
    plan = privacy.sanitise(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_a_proven_term_counts_far_from_the_mention(spark):
    far = "the house wrote from spring to autumn " * 8
    rows = [(900, f"Zeppelinfan {far} ann@mail.example {far} zeppelinfan"), (901, f"Zeppelinfan {far} bob@mail.example"),
            (902, f"Zeppelinfan {far}"), (903, f"ann@mail.example {far} zeppelinfans"), (None, f"Zeppelinfan {far} ann@mail.example")]
    docs = corpus(spark).union(spark.createDataFrame(rows, "doc_id long, text string"))
    terms = {r.id: r.terms for r in privacy.disclosing_terms(docs, threshold=0.7).collect()}
    assert terms == {i: ["zeppelinfan"] for i in [*range(5), 900]}
    clean = {r.doc_id: r.text for r in privacy.sanitise(docs, threshold=0.7).collect()}
    assert clean[900] == f"[TERM] {far} [EMAIL] {far} [TERM]"
    assert clean[901] == f"Zeppelinfan {far} [EMAIL]"
