"""Text functions: Unicode forms, normalisers, tokens, paths.

Everything runs as native expressions. Only rows holding characters that a
native expression cannot settle are handed, through Arrow, to ``unicodedata``;
the others pass null across and stay in the JVM.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from kalangu import constants as C

# The characters Python's str.split() and str.strip() take as blank.
BLANKS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
          "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
# The same as a regex class. One Unicode class is faster than a list of ranges.
WS = r"(?U)[\s\x1c-\x1f]"
# Python's \w, in a form Java and RE2 read alike (no combining marks).
WORD_CHAR = r"\p{L}\p{N}_"

# Code points below U+0300 and in Latin Extended Additional never change
# under NFC. Text made of those only is already composed.
_NEEDS_COMPOSING = r"[^\x{0}-\x{2FF}\x{1E00}-\x{1EFF}]"
# For tone stripping the combining block is settled natively as well.
_NEEDS_PYTHON_STRIP = r"[^\x{0}-\x{24F}\x{300}-\x{36F}\x{1E00}-\x{1EFF}]"


def _each(s: pd.Series, fn) -> pd.Series:
    return pd.Series([None if t is None or t is pd.NA or t != t else fn(t) for t in s], dtype=object)


@pandas_udf(T.StringType())
def _nfc_udf(s: pd.Series) -> pd.Series:
    return _each(s, lambda t: unicodedata.normalize("NFC", t))


@pandas_udf(T.BooleanType())
def _is_nfc_udf(s: pd.Series) -> pd.Series:
    return _each(s, lambda t: unicodedata.is_normalized("NFC", t))


@pandas_udf(T.BooleanType())
def _roundtrip_udf(s: pd.Series) -> pd.Series:
    form = unicodedata.normalize
    return _each(s, lambda t: form("NFC", form("NFD", t)) == form("NFC", t))


def _without_marks(text: str) -> str:
    kept = [c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn"]
    return unicodedata.normalize("NFC", "".join(kept))


@pandas_udf(T.StringType())
def _strip_udf(s: pd.Series) -> pd.Series:
    return _each(s, _without_marks)


def is_ascii(text: Column) -> Column:
    """Byte length equals length: a test that reads no character."""
    return F.octet_length(text) == F.length(text)


def _only_if(text: Column, pattern: str) -> Column:
    return F.when(~is_ascii(text) & text.rlike(pattern), text)


def nfc(text: Column, once: bool = False) -> Column:
    """Unicode NFC.

    ``once`` keeps the optimizer from merging the expression into later ones
    (it is declared not deterministic, although it is). Use it in a select of
    its own when another Arrow function follows.
    """
    fn = _nfc_udf.asNondeterministic() if once else _nfc_udf
    return F.coalesce(fn(_only_if(text, _NEEDS_COMPOSING)), text)


def is_nfc(text: Column) -> Column:
    return F.when(text.isNotNull(),
                  F.coalesce(_is_nfc_udf(_only_if(text, _NEEDS_COMPOSING)), F.lit(True)))


def nfc_roundtrips(text: Column) -> Column:
    """Whether NFD followed by NFC gives the NFC form back."""
    return F.when(text.isNotNull(),
                  F.coalesce(_roundtrip_udf(_only_if(text, _NEEDS_COMPOSING)), F.lit(True)))


@lru_cache
def _latin_bases() -> tuple[str, str]:
    """Latin letters that lose a mark, and the letters they become (a rule, not a list)."""
    src, dst = [], []
    for cp in (*range(0x80, 0x250), *range(0x1E00, 0x1F00)):
        bare = _without_marks(chr(cp))
        if bare != chr(cp) and len(bare) == 1:
            src.append(chr(cp))
            dst.append(bare)
    return "".join(src), "".join(dst)


def strip_tone_marks(text: Column) -> Column:
    """Drop every non-spacing mark. Sub-dots go too; hooked letters stay."""
    native = F.when(is_ascii(text), text).otherwise(
        F.regexp_replace(F.translate(text, *_latin_bases()), r"\p{Mn}+", ""))
    return F.coalesce(_strip_udf(_only_if(text, _NEEDS_PYTHON_STRIP)), native)


def strip(text: Column) -> Column:
    """Python's str.strip()."""
    return F.trim(text, F.lit(BLANKS))


def collapse(text: Column) -> Column:
    """Single spaces between words, none at the ends."""
    return F.trim(F.regexp_replace(text, WS + "+", " "))


def words(text: Column) -> Column:
    """Python's str.split(): never an empty word."""
    return F.array_remove(F.split(text, WS + "+"), "")


def word_count(text: Column) -> Column:
    return F.size(words(F.coalesce(text, F.lit(""))))


def normalize_text(text: Column, once: bool = False) -> Column:
    """NFC and collapsed whitespace; case, marks and punctuation stay."""
    return collapse(nfc(text, once))


def normalize_words(word: Column) -> Column:
    """A single word as scored by the corpus scores: trimmed, lower case."""
    return F.lower(collapse(word))


def count_diacritics(text: Column, language: Column, sets: dict[str, str] = C.DIACRITIC_SETS) -> Column:
    """Language-specific letters in the NFC form; 0 for other languages."""
    composed = nfc(text)
    out = F.lit(0)
    for lang, letters in sets.items():
        hits = F.length(composed) - F.length(F.translate(composed, letters, ""))
        out = F.when(language == lang, hits).otherwise(out)
    return out


def normalize_transcript(text: Column, language: Column | str = "en", keep_marks: bool = False) -> Column:
    """Transcript form for scoring.

    Lower case only for English; anything but word characters, blank, ' and -
    becomes a blank. ``keep_marks`` also keeps uncomposed combining marks.
    """
    lang = F.lit(language) if isinstance(language, str) else language
    composed = nfc(F.coalesce(text, F.lit("")))
    cased = F.when(lang == "en", F.lower(composed)).otherwise(composed)
    marks = r"\p{M}" if keep_marks else ""
    return collapse(F.regexp_replace(cased, rf"(?U)[^{WORD_CHAR}{marks}\s'\-]", " "))


def normalize_basic(text: Column) -> Column:
    """Lower case, punctuation to blanks, collapsed."""
    return collapse(F.regexp_replace(F.lower(text), rf"(?U)[^{WORD_CHAR}\s]", " "))


def scoring_text(text: Column, mode: str = "tone_sensitive", once: bool = False) -> Column:
    """Form compared by the corpus scores: normalised, lower case. For ``once`` see :func:`nfc`."""
    return folded(normalize_text(text, once), mode)


def folded(base: Column, mode: str = "tone_sensitive") -> Column:
    """:func:`scoring_text` of a text that is normalised already."""
    if mode not in ("tone_sensitive", "tone_stripped"):
        raise ValueError(f"unknown mode {mode!r}")
    return F.lower(strip_tone_marks(base) if mode == "tone_stripped" else base)


def speech_rates(text: Column, duration: Column) -> tuple[Column, Column, Column]:
    """Word count, words per second, characters per second."""
    n = word_count(text)
    secs = F.greatest(duration, F.lit(1e-6))
    return n, n / secs, F.length(text) / secs


def non_latin_ratio(text: Column) -> Column:
    """Share of letters above U+024F. Sub-dotted vowels and hooked letters count."""
    foreign = F.length(F.regexp_replace(text, r"[^\p{L}]|[\x{0}-\x{24F}]", ""))
    return F.when(is_ascii(text), 0.0).otherwise(foreign / F.length(text))


def infer_domain(text: Column, keywords=C.CLINICAL_KEYWORDS) -> Column:
    """'clinical' when two or more whitespace tokens are keywords."""
    hits = F.filter(words(F.lower(text)), lambda w: w.isin(*keywords))
    return F.when(F.size(hits) >= 2, "clinical").otherwise("general")


def accent_listed(accent: Column, allowed=C.ACCENT_ALLOW_LIST) -> Column:
    """Whether the accent, or a part of it split at / and blanks, is listed."""
    a = F.lower(strip(F.coalesce(accent, F.lit(""))))
    return a.isin(*allowed) | F.exists(words(F.translate(a, "/", " ")), lambda p: p.isin(*allowed))


# --- paths -----------------------------------------------------------------

def basename(path: Column) -> Column:
    return F.substring_index(F.rtrim(path, F.lit("/")), "/", -1)


def stem(path: Column) -> Column:
    """File name without its last suffix; a leading dot starts no suffix."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]+$", "")


def parent_name(path: Column) -> Column:
    """Name of the enclosing folder, '' when there is none."""
    return F.coalesce(F.try_element_at(F.split(path, "/"), F.lit(-2)), F.lit(""))


def with_suffix(path: Column, suffix: str) -> Column:
    return F.concat(F.regexp_replace(path, r"(?<=[^/])\.[^./]+$", ""), F.lit(suffix))


def speaker_from_file(file: Column) -> Column:
    """Text after the first _ of the stem, else the whole stem."""
    return F.regexp_replace(stem(file), r"^[^_]*_", "")


def under_root(path: Column, root: str) -> Column:
    """Prefix a relative path with ``root``; leave an absolute one alone."""
    return F.when(path.startswith("/"), path).otherwise(
        F.concat(F.lit(root.rstrip("/") + "/"), path))


def control_token(tag: Column, tokens: dict[str, str]) -> Column:
    """Token of a language or task; an unknown tag fails the query."""
    table = F.create_map(*[F.lit(x) for kv in tokens.items() for x in kv])
    return F.coalesce(table[tag], F.raise_error(
        F.concat(F.lit("no control token for "), F.coalesce(tag, F.lit("null")))).cast("string"))


def inventory(extras: dict[str, str] = C.ALPHABET_EXTRAS, bigrams=C.HAUSA_BIGRAMS) -> list[str]:
    """Sorted non-ASCII letters and bigrams of the supported alphabets."""
    letters = {unicodedata.normalize("NFC", c) for s in extras.values() for c in s}
    return sorted(letters | set(bigrams))


def plain_path(uri: Column) -> Column:
    """A file's URI as its path: without a local scheme, percent-encoding undone."""
    return F.url_decode(F.replace(F.regexp_replace(uri, r"^file:/+", "/"), F.lit("+"), F.lit("%2B")))
