import random

import pytest
from pyspark.sql import functions as F

from kalangu.functions import scoring as M
from kalangu.functions import text as X
from kalangu.functions.rounding import two_places
from kalangu.operators import compare as K
from kalangu.operators import filters as P
from kalangu.operators import metrics as R
from kalangu.plans import views as V
from kalangu.plans.curation_queries import curated

PAIR = "ref string, hyp string"


def distance(r, h):
    row = list(range(len(h) + 1))
    for i, a in enumerate(r, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(h, 1):
            last, row[j] = row[j], min(last + (a != b), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def alignment(r, h):
    """Hits, substitutions, deletions, insertions by an explicit backtrace."""
    d = [[i + j if i * j == 0 else 0 for j in range(len(h) + 1)] for i in range(len(r) + 1)]
    for i in range(1, len(r) + 1):
        for j in range(1, len(h) + 1):
            d[i][j] = min(d[i - 1][j - 1] + (r[i - 1] != h[j - 1]), d[i - 1][j] + 1, d[i][j - 1] + 1)
    i, j, out = len(r), len(h), [0, 0, 0, 0]
    while i or j:
        if i and j and d[i][j] == d[i - 1][j - 1] + (r[i - 1] != h[j - 1]):
            out[0 if r[i - 1] == h[j - 1] else 1] += 1
            i, j = i - 1, j - 1
        elif i and d[i][j] == d[i - 1][j] + 1:
            out[2] += 1
            i -= 1
        else:
            out[3] += 1
            j -= 1
    return tuple(out)


def random_pairs(n=300, longest=40):
    rng = random.Random(7)
    words = ["a", "b", "c", "ẹ", "dd", "ж", "e"]
    return [(" ".join(rng.choices(words, k=rng.randint(0, longest))), " ".join(rng.choices(words, k=rng.randint(0, longest))))
            for _ in range(n)]


def test_word_distance_equals_brute_force(one):
    pairs = random_pairs()
    got = one(PAIR, pairs, M.word_distance(X.words(F.col("ref")), X.words(F.col("hyp"))))
    assert got == [distance(r.split(), h.split()) for r, h in pairs]


def test_alignment_equals_brute_force(spark):
    pairs = [(i, *p) for i, p in enumerate(random_pairs(200) + random_pairs(5, 400))]
    df = spark.createDataFrame(pairs, "i int, " + PAIR)
    got = M.with_alignment(df, X.words(F.col("ref")), X.words(F.col("hyp"))).orderBy("i").select("alignment").collect()
    assert [tuple(r[0]) for r in got] == [alignment(r.split(), h.split()) for _, r, h in pairs]


def test_thousands_of_distinct_words(one):
    r = [f"w{i}" for i in range(3000)]
    h = r[5:1000] + ["x"] + r[1001:]
    assert one(PAIR, [(" ".join(r), " ".join(h))], M.word_distance(X.words(F.col("ref")), X.words(F.col("hyp")))) == [6]


@pytest.mark.parametrize("ref,hyp,wer,counts", [
    ("hello world", "hello world", 0.0, (2, 0, 0, 0)), ("hello world", "foo bar", 1.0, (0, 2, 0, 0)),
    ("hello world", "hello there", 0.5, (1, 1, 0, 0)), ("hello world", "hello big world", 0.5, (2, 0, 0, 1)),
    ("hello world", "hello", 0.5, (1, 0, 1, 0)), ("Hello World", "hello world", 0.0, (2, 0, 0, 0)),
    ("ƙasar Najeriya", "kasar Najeriya", 0.5, (1, 1, 0, 0))])
def test_corpus_wer(spark, ref, hyp, wer, counts):
    r = R.word_error_report(spark.createDataFrame([(ref, hyp)], PAIR)).first()
    assert r["wer"] == wer and (r["hits"], r["substitutions"], r["deletions"], r["insertions"]) == counts


def test_tone_modes(spark):
    df = spark.createDataFrame([("jẹ́ èdè", "je ede")], PAIR)
    assert R.word_error_report(df).first()["wer"] == 1.0
    assert R.word_error_report(df, mode="tone_stripped").first()["wer"] == 0.0


def test_empty_corpus_and_unknown_mode(spark):
    df = spark.createDataFrame([], PAIR)
    assert R.word_error_report(df).first()["wer"] == 0.0
    with pytest.raises(ValueError):
        R.word_error_report(df, mode="x")


TAGGED = "ref_tagged array<struct<word:string,language:string>>, hyp_tagged array<struct<word:string,language:string>>"


def test_code_switched(spark):
    def run(ref, hyp):
        return R.code_switched_wer(spark.createDataFrame([(ref, hyp)] if ref is not None else [], TAGGED)).first()

    same = run([("hello", "en"), ("sannu", "ha")], [("hello", "en"), ("sannu", "ha")])
    assert (same["cs_wer"], same["token_wer"], same["tag_accuracy"]) == (0.0, 0.0, 1.0)
    tag = run([("hello", "en"), ("sannu", "ha")], [("hello", "en"), ("sannu", "en")])
    assert (tag["cs_wer"], tag["tag_accuracy"], tag["per_language_wer"]) == (0.5, 0.5, {"en": 0.0, "ha": 1.0})
    bad = run([("a", "en"), ("b", "ha"), ("c", "yo")], [("x", "ig"), ("y", "pcm"), ("z", "en")])
    assert bad["cs_wer"] == 1.0 and bad["total_ref_words"] == 3
    none = run(None, None)
    assert (none["cs_wer"], none["token_wer"], none["tag_accuracy"]) == (0.0, 0.0, 1.0)
    twice = run([("a", "en"), ("b", "en"), ("c", "en"), ("d", "en")], [("a", "en"), ("b", "en"), ("c", "en"), ("x", "en")])
    assert twice["cs_wer"] == 0.5 and twice["token_wer"] == 0.25


def test_clip_scores_of_empty_sides(one):
    rows = [("", "a"), ("a b", ""), ("a b", None)]
    assert one(PAIR, rows, M.clip_wer(F.col("ref"), F.col("hyp"))) == [None, 1.0, 1.0]
    assert one(PAIR, rows[:2], M.clip_cer(F.col("ref"), F.col("hyp"))) == [1.0, 1.0]


def test_garbage_bounds(one):
    ref5, n = "a b c d e", lambda k: " ".join(["w"] * k)
    rows = [(ref5, "  "), (ref5, "xaaaay"), (ref5, "xaaay"), (ref5, n(15)), (ref5, n(16)), (ref5, "abcdefghiж"), (ref5, "abcdefghж"), (ref5, "AAAA")]
    assert one(PAIR, rows, M.is_garbage(F.col("hyp"), F.col("ref"))) == [False, True, False, False, True, False, True, False]


def test_verdict_bands(one):
    col = M.verdict_wide(F.col("d"), F.col("g"))
    rows = [(None, False), (-0.1, False), (-0.11, False), (0.1, True), (0.11, True), (0.11, False)]
    assert one("d double, g boolean", rows, col) == ["UNKNOWN", "SAME", "IMPROVED", "SAME", "CATASTROPHIC", "REGRESSED"]
    col = M.verdict_narrow(F.col("a"), F.col("b"), F.col("h"), F.lit("one two"))
    rows = [(0.0, float("nan"), "x"), (0.25, 0.25, "x"), (0.0, 0.0625, "x"), (0.0625, 0.0, "x"), (0.0, 0.0, "a    b"), (0.5, 0.5, "a b c d e f g"),
            (0.5, 0.5, "a b c d e f g h")]
    assert one("a double, b double, h string", rows, col) == [
        "UNKNOWN", "SAME", "REGRESSED", "IMPROVED", "CATASTROPHIC", "SAME", "CATASTROPHIC"]


def test_two_places_equals_python(one):
    values = [k / 1000 for k in range(0, 3000)] + [k / n for n in range(1, 130) for k in range(0, n, 7)] + [8.005, 100.125, 0.125, 0.375]
    assert one("x double", [(float(v),) for v in values], two_places(F.col("x"))) == [f"{v:.2f}" for v in values]


def test_transcript_pass(spark):
    rows = [("a" * 10, "a" * 6 + "b" * 4, "en"), ("a" * 100, "a" * 59 + "b" * 41, "en"), ("abc", None, None), ("", "abc", "en"), ("Abc.", "abc", "ha")]
    out = P.transcript_pass(spark.createDataFrame(rows, "transcript string, hypothesis string, detected_language string").coalesce(1)).collect()
    assert [r.pass3.reason for r in out] == ["pass", "transcript_mismatch_cer_0.41", "asr_error", "transcript_mismatch_cer_1.00", "pass"]
    assert [r.pass3.details.is_code_switched for r in out] == [None, None, None, None, True]


def test_two_places_of_large_values(one):
    values = [2048.125, 2049.125, 2049.135, 16384.375, 99999.995, 1e6 + 0.125, 3e7 + 0.625, 5e9 + 0.5]
    assert one("x double", [(v,) for v in values], two_places(F.col("x"))) == [f"{v:.2f}" for v in values]


def test_a_looping_hypothesis_does_not_fail_the_pass(spark):
    from kalangu.operators.filters import transcript_pass

    df = spark.createDataFrame([("k", "abcdefgh", "x" * 16401, "en")], "key string, transcript string, hypothesis string, detected_language string")
    r = transcript_pass(df).first().pass3
    assert r.reason == "transcript_mismatch_cer_2050.12" and len(r.details.hypothesis) == 16401


def test_full_curation_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.audio_path: r.pass3 for r in curated(spark, sf).select("audio_path", "pass3").collect() if r.pass3 is not None}
    assert got
    texts = {r.audio_path: (r.doc_id, r.text) for r in V.clips(spark, sf).collect()}
    import re
    import unicodedata

    def norm(t):
        return re.sub(r"\s+", " ", re.sub(r"[^\w\s'\-]", " ", unicodedata.normalize("NFC", t).lower())).strip()

    for path, result in got.items():
        doc, text = texts[path]
        if doc % 11 == 0:
            assert result.reason == "asr_error"
            continue
        hyp = text.translate({ord(c): None for c in "aeiou"}) if doc % 5 == 0 else text
        cer = distance(norm(text), norm(hyp)) / len(norm(text))
        assert result.keep == (cer <= 0.40) and result.details.cer == pytest.approx(round(cer, 4), abs=1.01e-4)


def test_whole_text_wer_equals_brute_force(spark):
    from kalangu.plans.catalog import QUERIES, load

    load()
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text.split() for r in V.clips(spark, sf).collect()}
    for r in QUERIES["whole_text_wer"](spark, sf).collect():
        w = texts[r.doc_id]
        hyp = [("x" if i % 5 == 1 else x) for i, x in enumerate(w) if i % 7 != 3]
        if len(w) < 700:
            assert r.errors == distance(w, hyp)
        assert r.words == len(w)


def test_top_by_delta_orders(spark):
    df = spark.createDataFrame([("a", 0.3, "REGRESSED"), ("b", None, "UNKNOWN"), ("c", 0.0, "SAME"), ("d", -0.2, "IMPROVED")],
                               "key string, delta double, verdict string")
    keys = lambda d: [r.key for r in d.collect()]
    assert keys(K.top_by_delta(df, "key", 3)) == ["a", "c", "d"]
    assert keys(K.top_by_delta(df, "key", 3, missing=-999)) == ["a", "d", "b"]
    assert keys(K.top_by_delta(df, "key", 3, verdicts=K.REGRESSED)) == ["a"]


def test_overall_call_bounds(spark):
    for bad, call in ((29, "NARROW"), (30, "MIXED"), (59, "MIXED"), (60, "BROAD")):
        df = spark.createDataFrame([("REGRESSED",)] * bad + [("SAME",)] * (100 - bad), "verdict string")
        assert K.overall_call(df).first()["call"] == call


def test_token_accuracy(spark):
    df = spark.createDataFrame([([1, 2, 3, 4], [0, 1, -100, 3]), ([5], [5])], "pred_ids array<int>, label_ids array<int>")
    assert tuple(R.token_accuracy(df).first()) == (2, 2, 1.0)
    assert R.token_accuracy(df.filter("size(pred_ids) = 1")).first()["accuracy"] == 0.0


def test_code_switched_scores_compose_and_count_normalised_words(spark):
    import unicodedata

    kind = "array<struct<word string, language string>>"
    word = lambda t: [(unicodedata.normalize("NFC", t), "yo")]
    rows = [(word("ọlọ́rọ̀"), [(unicodedata.normalize("NFD", "ọlọ́rọ̀"), "yo")]), ([("a", "en"), (" ", "en")], [("a", "en")])]
    r = R.code_switched_wer(spark.createDataFrame(rows, f"ref_tagged {kind}, hyp_tagged {kind}")).first()
    assert (r.token_wer, r.total_ref_words) == (0.0, 2)


def test_alignment_of_settled_pairs(one):
    rows = [("a b c", "a b c"), ("", "a b"), ("a b", ""), ("", ""), ("a b c", "a x c d")]
    df_rows = [tuple(r) for r in rows]
    spark = __import__("pyspark.sql").sql.SparkSession.getActiveSession()
    df = spark.createDataFrame(df_rows, "r string, h string")
    got = M.with_alignment(df, X.words(F.col("r")), X.words(F.col("h"))).select("r", "h", "alignment.*").collect()
    want = {("a b c", "a b c"): (3, 0, 0, 0), ("", "a b"): (0, 0, 0, 2), ("a b", ""): (0, 0, 2, 0), ("", ""): (0, 0, 0, 0), ("a b c", "a x c d"): (2, 1, 0, 1)}
    assert {(r.r, r.h): tuple(r)[2:] for r in got} == want


def test_inventory_counts_bigrams(spark):
    df = spark.createDataFrame([("Shasha tsuntsu ɗan",)], "text string")
    got = {r.char: (r.n, r.in_inventory) for r in R.character_inventory(df, known=["sh", "ts", "ɗ"]).collect()}
    assert got == {"sh": (2, True), "ts": (2, True), "ɗ": (1, True)}


def test_bands_and_stretches_change_nothing(monkeypatch):
    """Distances, early stops and alignments with every size of band and stretch equal the whole table."""
    from kalangu.functions import edits

    rng = random.Random(3)
    for _ in range(1500):
        monkeypatch.setattr(edits, "BAND", rng.choice([1, 2, 5, 64]))
        monkeypatch.setattr(edits, "KEPT", rng.choice([1, 50, 1 << 28]))
        words = "abcdef"[:rng.choice([2, 3, 6])]
        r = rng.choices(words, k=rng.randrange(25))
        h = list(r) if rng.random() < 0.6 else rng.choices(words, k=rng.randrange(30))
        for _ in range(rng.randrange(6)):
            at = rng.randrange(len(h) + 1)
            h[at:at + rng.randrange(2)] = rng.choices(words, k=rng.randrange(2))
        want, matched = distance(r, h), []
        assert edits.distance(r, h) == want and edits.align(r, h, matched) == alignment(r, h)
        assert len(matched) == alignment(r, h)[0] and all(r[i] == h[j] for i, j in matched)
        for limit in (0, 1, 3, 8):
            got = edits.distance(r, h, limit)
            assert got == want if want <= limit else got > limit


def test_long_texts_equal_brute_force(spark):
    rng = random.Random(9)
    rows = []
    for n in (1, 30, 700, 1500):
        r = [f"w{rng.randrange(200)}" for _ in range(n)]
        h = [rng.choice(["x", w]) if rng.random() < 0.2 else w for w in r if rng.random() > 0.1] + ["y"] * (n % 7)
        rows.append((n, " ".join(r), " ".join(h)))
    df = spark.createDataFrame(rows, "i int, " + PAIR)
    got = M.with_alignment(df, X.words(F.col("ref")), X.words(F.col("hyp")))
    got = got.select("i", "alignment", M.word_distance(X.words(F.col("ref")), X.words(F.col("hyp"))).alias("d"),
                     (M.clip_cer(F.substring("ref", 1, 900), F.substring("hyp", 1, 900)) * F.length(F.substring("ref", 1, 900))).alias("c"))
    for r in got.collect():
        ref, hyp = next((a, b) for i, a, b in rows if i == r.i)
        assert tuple(r.alignment) == alignment(ref.split(), hyp.split()) and r.d == distance(ref.split(), hyp.split())
        assert round(r.c) == distance(ref[:900], hyp[:900])


def test_whole_corpus_report_equals_brute_force(spark):
    from kalangu.plans import catalog, views

    catalog.load()
    sf = "/root/testdata/sf0.001"
    texts = [r for r in views.texts(spark, sf).collect() if len(r.ref.split()) <= 250]
    small = spark.createDataFrame([(r.language, r.ref, r.hyp) for r in texts], "language string, " + PAIR)
    got = {r.language: (r.hits, r.substitutions, r.deletions, r.insertions) for r in R.word_error_report(small, ["language"], mode="tone_sensitive").collect()}
    want = {}
    for r in texts:
        a = alignment(r.ref.lower().split(), r.hyp.lower().split())
        want[r.language] = tuple(map(sum, zip(want.get(r.language, (0,) * 4), a)))
    assert got == want
    whole = catalog.QUERIES["whole_text_alignment"](spark, sf).collect()
    errors = {r.doc_id: r.errors for r in catalog.QUERIES["whole_text_wer"](spark, sf).collect()}
    assert len(whole) == 200 and all(r.substitutions + r.deletions + r.insertions <= errors.get(r.doc_id, 0) for r in whole)


def test_tone_stripping_normalises_each_text_once(spark, capsys):
    """The steps after normalisation name its result; they do not repeat it."""
    df = spark.createDataFrame([("Ọ́ bá  dé", "o ba de")], "ref string, hyp string")
    R.word_error_report(df, mode="tone_stripped").select("substitutions", "deletions", "insertions").explain()
    plan = capsys.readouterr().out
    assert plan.count(X.WS + "+,  , 1") == 2


def test_each_text_is_split_into_words_once(spark, capsys):
    """Distances and counts name the words of a step before; no lambda runs over them."""
    from kalangu.plans import catalog

    catalog.load()
    blank = "　a \x1c b\n\nc "
    df = spark.createDataFrame([(blank, "a b"), (None, "x"), ("", None), ("a", None)], "ref string, hyp string")
    rates = R.error_rates(df).select("n", "word_errors", "ref_words")
    assert tuple(rates.first()) == (4, 3, 4)
    assert [r.w for r in df.select(X.words(F.col("ref")).alias("w")).collect()] == [["a", "b", "c"], None, [], ["a"]]
    rates.explain()
    plan = capsys.readouterr().out
    assert plan.count("split(") == 2 and "lambda" not in plan
    catalog.QUERIES["clip_wer"](spark, "/root/testdata/sf0.001").explain()
    # the documents, the reference and the hypothesis
    assert capsys.readouterr().out.count("split(") == 3
