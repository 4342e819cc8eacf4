import unicodedata

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kalangu import constants as C
from kalangu.functions import text as X

SAMPLES = ["", "abc", "é", "é", "jẹ́", "Yorùbá", "ɗan ƙaura ɓangare ƴar",
           "ịụọṅ", "가가", "ÅΩ", "a b\tc\nd", "̈́x", "ẛ̣", "क़"]


def test_forms_equal_unicodedata(one):
    rows = [(s,) for s in SAMPLES]
    assert one("t string", rows, X.nfc(F.col("t"))) == [unicodedata.normalize("NFC", s) for s in SAMPLES]
    assert one("t string", rows, X.is_nfc(F.col("t"))) == [unicodedata.is_normalized("NFC", s) for s in SAMPLES]
    bare = [unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", s) if unicodedata.category(c) != "Mn"))
            for s in SAMPLES]
    assert one("t string", rows, X.strip_tone_marks(F.col("t"))) == bare


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(texts=st.lists(st.text(st.characters(codec="utf-8", exclude_characters="\x00"), max_size=12), min_size=1, max_size=40))
def test_native_shortcuts_are_exact(one, texts):
    rows = [(s,) for s in texts]
    assert one("t string", rows, X.nfc(F.col("t"))) == [unicodedata.normalize("NFC", s) for s in texts]
    assert one("t string", rows, X.strip_tone_marks(F.col("t"))) == [X._without_marks(s) for s in texts]
    assert one("t string", rows, X.words(F.col("t"))) == [s.split() for s in texts]
    assert one("t string", rows, X.strip(F.col("t"))) == [s.strip() for s in texts]


def test_null_stays_null(one):
    for fn in (X.nfc, X.is_nfc, X.strip_tone_marks, X.nfc_roundtrips):
        assert one("t string", [(None,)], fn(F.col("t"))) == [None]


def test_hooked_letters_survive_stripping(one):
    assert one("t string", [("ƙasar",), ("ẹ̀kọ́",)], X.strip_tone_marks(F.col("t"))) == ["ƙasar", "eko"]


def test_diacritic_counts(one):
    rows = [("ɗan ƙaura ɓangare ƴar", "ha"), ("ẹọṣ", "yo"), ("ịụọṅ", "ig"),
            ("ẹ", "en"), ("ẹ", "pcm"), ("ẹ", "xx"), ("ṅ", "yo")]
    assert one("t string, l string", rows, X.count_diacritics(F.col("t"), F.col("l"))) == [4, 3, 4, 0, 0, 0, 1]


def test_normalize_text_only_composes_and_collapses(one):
    assert one("t string", [("  A b,\tC é ",)], X.normalize_text(F.col("t"))) == ["A b, C é"]


def test_normalize_transcript(one):
    rows = [("It's  A-B, c_d!", "en"), ("Ina SON", "ha"), ("jẹ́ x", "yo"), (None, "en")]
    col = X.normalize_transcript(F.col("t"), F.col("l"))
    assert one("t string, l string", rows, col) == ["it's a-b c_d", "Ina SON", "jẹ x", ""]
    keep = X.normalize_transcript(F.col("t"), F.col("l"), keep_marks=True)
    assert one("t string, l string", rows[2:3], keep) == ["jẹ́ x"]


def test_domain_counts_tokens_not_words(one):
    rows = [("the patient patient",), ("patient, nurse",), ("nurse doctor",), ("",)]
    assert one("t string", rows, X.infer_domain(F.col("t"))) == ["clinical", "general", "clinical", "general"]


def test_accents(one):
    rows = [("Hausa/Fulani",), (" YORUBA ",), ("igbo/x",), ("x y",), (None,), ("nigerian pidgin",)]
    assert one("t string", rows, X.accent_listed(F.col("t"))) == [True, True, True, False, False, True]


def test_paths(one):
    rows = [("a/b/c.tar.gz",), ("c",), (".hidden",), ("a/b.d/c",)]
    assert one("t string", rows, X.stem(F.col("t"))) == ["c.tar", "c", ".hidden", "c"]
    assert one("t string", rows, X.parent_name(F.col("t"))) == ["b", "", "", "b.d"]
    assert one("t string", rows, X.with_suffix(F.col("t"), ".flac")) == ["a/b/c.tar.flac", "c.flac", ".hidden.flac", "a/b.d/c.flac"]
    assert one("t string", [("n/000001_abc_d.flac",), ("n/abc.flac",)], X.speaker_from_file(F.col("t"))) == ["abc_d", "abc"]
    assert one("t string", [("/x/y",), ("y",)], X.under_root(F.col("t"), "/r/")) == ["/x/y", "/r/y"]


def test_non_latin_ratio(one):
    rows = [("",), ("abcd",), ("abжж",), ("ẹọ",)]
    assert one("t string", rows, X.non_latin_ratio(F.col("t"))) == [0.0, 0.0, 0.5, 1.0]


def test_control_tokens(one):
    assert one("t string", [("ha",)], X.control_token(F.col("t"), C.LANGUAGE_TOKENS)) == ["<|ha|>"]
    try:
        one("t string", [("zz",)], X.control_token(F.col("t"), C.LANGUAGE_TOKENS))
    except Exception as exc:
        assert "no control token" in str(exc)
    else:
        raise AssertionError("an unknown language must fail")


def test_inventory_is_sorted_and_complete():
    inv = X.inventory()
    assert inv == sorted(inv) and len(inv) == 23 and "ƙu" in inv
