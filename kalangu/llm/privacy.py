"""Personal data: fixed patterns, and terms that give away whom they stand beside.

All of it is DataFrame functions. Four patterns find e-mail addresses, IP
addresses, card and phone numbers. Each different value found is a protected
entity. The words around its mentions are candidate terms; over the corpus

    disclosure(term, entity) = PMI(term; entity) / IC(entity)
                             = log(n(e,t) N / (n(e) n(t))) / log(N / n(e))

says which part of the information in the entity a term gives away: 1 if it
stands nowhere else, 0 if it is independent. A term from ``threshold`` on is a
span too, wherever a text with the entity holds it. n(e,t) counts different
windows, so copies of one text are one piece of evidence; a term needs
``support`` of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kalangu.session import through_table

THRESHOLD = 0.8
SUPPORT = 3
WINDOW_CHARS = 80
KINDS = ("email", "ip", "card", "phone", "term")
TAGS = ("[EMAIL]", "[IP]", "[CARD]", "[PHONE]", "[TERM]")

# Possessive forms: what they match is the same, in linear time. A mail address starts where a run of its characters
# starts, or right after the one before it.
_LOCAL = r"[A-Za-z0-9._%+-]"
_PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: a text without this has no match that counts
_HINTS = {"email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9]"}
#: terms: four or more of ASCII letters and digits and whatever is not ASCII
_TERM_CHAR = r"[^\x00-/:-@\[-`{-\x7F]"
_SPAN = "struct<kind:int,start:int,end:int,value:string>"


def located(text: Column, regex: Column | str, kind: int) -> Column:
    """Every match of ``regex`` as struct<kind, start, end, value>, in code points, end exclusive.

    The gaps between matches come from a split by the same pattern, and the
    places from the running sum of gaps and matches.
    """
    regex = F.lit(regex) if isinstance(regex, str) else regex
    pairs = F.zip_with(F.regexp_extract_all(text, regex, F.lit(0)), F.call_function("split", text, regex, F.lit(-1)),
                       lambda m, gap: F.struct(m.alias("m"), F.length(gap).alias("gap")))
    start = F.expr(f"struct(0 as at, cast(array() as array<{_SPAN}>) as out)")

    def add(acc: Column, x: Column) -> Column:
        a = acc["at"] + x["gap"]
        b = a + F.length(x["m"])
        span = F.struct(F.lit(kind).alias("kind"), a.alias("start"), b.alias("end"), x["m"].alias("value"))
        return F.struct(F.coalesce(b, a).alias("at"),
                        F.when(x["m"].isNull(), acc["out"]).otherwise(F.array_append(acc["out"], span)).alias("out"))

    return F.aggregate(pairs, start, add, lambda acc: acc["out"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _holds(kind: str, value: Column) -> Column:
    """Whether a match counts."""
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3) & F.forall(
            F.split(value, r"\."), lambda p: F.coalesce(F.right(p, F.lit(3)).cast("int") <= 255, F.lit(False)))
    if kind == "card":
        return F.length(_digits(value)).between(16, 19) & F.call_function("luhn_check", _digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def base_spans(text: Column) -> dict[str, Column]:
    """The spans of each pattern, in order of their start."""
    none = F.expr(f"cast(array() as array<{_SPAN}>)")

    def spans(k: int, kind: str) -> Column:
        found = F.filter(located(text, _PATTERNS[kind], k), lambda s: _holds(kind, s["value"]))
        return F.when(text.rlike(_HINTS[kind]), found).otherwise(none)

    return {kind: spans(k, kind) for k, kind in enumerate(_PATTERNS)}


def _entity(span: Column) -> Column:
    """What mentions of one entity have in common: its kind and the value without case and marks."""
    value = F.when(span["kind"] == 0, F.lower(span["value"])).when(span["kind"] == 1, span["value"]).otherwise(_digits(span["value"]))
    return F.concat(span["kind"].cast("string"), F.lit(":"), value)


def terms_of(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(f"{_TERM_CHAR}{{4,}}"), F.lit(0)))


def disclosing_terms(docs: DataFrame, id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD,
                     support: int = SUPPORT, window: int = WINDOW_CHARS) -> DataFrame:
    """(id, terms): for texts that mention an entity, the terms anywhere in them that give it away.

    Windows around the mentions prove a term; a proven one counts wherever the text holds it.
    """
    docs = docs.select(F.col(f"`{id}`").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    mentions = docs.select("id", "text", F.posexplode(F.concat(*base_spans(F.col("text")).values())).alias("k", "s"))
    left = F.substring("text", F.greatest(F.lit(1), F.col("s.start") + 1 - window), F.least(F.lit(window), F.col("s.start")))
    right = F.substring("text", F.col("s.end") + 1, F.lit(window))
    # a word that the window cuts is no term
    left = F.when(F.col("s.start") > window, F.regexp_replace(left, f"^{_TERM_CHAR}+", "")).otherwise(left)
    right = F.when(F.length(right) == window, F.regexp_replace(right, f"{_TERM_CHAR}+$", "")).otherwise(right)
    # and neither is what touches the span itself
    around = F.concat(F.regexp_replace(left, f"{_TERM_CHAR}+$", ""), F.lit(" "), F.regexp_replace(right, f"^{_TERM_CHAR}+", ""))
    # the terms of the whole text once a text, beside its first mention
    mentions = through_table(mentions.select("id", _entity(F.col("s")).alias("entity"), F.lower(around).alias("around"), F.when(
        (F.col("k") == 0) & F.col("id").isNotNull(), terms_of(F.col("text"))).alias("terms")), "mentions")
    seen = mentions.select("entity", "around").distinct()
    entities = seen.groupBy("entity").agg(F.count("*").alias("n_e")).filter(F.col("n_e") >= support)
    together = (seen.join(entities, "entity").select("entity", "n_e", F.explode(terms_of(F.col("around"))).alias("term"))
                .groupBy("entity", "n_e", "term").agg(F.count("*").alias("n_et")).filter(F.col("n_et") >= support))
    together = through_table(together, "together")
    everywhere = docs.select(F.explode(terms_of(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n_t"))
    total = docs.select(F.count("*").alias("n")).scalar()
    rated = together.join(everywhere, "term").withColumn("n", total.cast("double"))
    pmi = F.log(F.col("n_et") * F.col("n") / (F.col("n_e") * F.greatest("n_t", "n_et")))
    strong = rated.filter((F.col("n_e") < F.col("n")) & (pmi >= threshold * F.log(F.col("n") / F.col("n_e")))).select("entity", "term")
    strong = through_table(strong, "strong")
    held = mentions.select("id", F.explode("terms").alias("term")).join(strong, "term")
    named = mentions.filter(F.col("id").isNotNull()).select("id", "entity").distinct()
    return held.join(named, ["id", "entity"], "left_semi").groupBy("id").agg(F.sort_array(F.collect_set("term")).alias("terms"))


def find(docs: DataFrame, id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, support: int = SUPPORT,
         out: str = "spans") -> DataFrame:
    """``docs`` with ``out``: array<struct<kind, start, end, value>> of all spans, by kind, then start.

    ``kind`` counts in the order of ``KINDS``; places are code points, end
    exclusive; spans of different kinds may overlap. Null texts have no span;
    neither has an empty table any row. Rows with equal ids share their terms;
    a null id has pattern spans only. Every row gives one row, columns of
    ``docs`` pass through, one named like ``out`` is replaced.
    """
    terms = disclosing_terms(docs, id, text, threshold, support).select(F.col("id").alias("__id"), F.col("terms").alias("__terms"))
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    word = F.concat(F.lit(f"(?iu)(?<!{_TERM_CHAR})(?:"), F.array_join("__terms", "|"), F.lit(f")(?!{_TERM_CHAR})"))
    none = F.expr(f"cast(array() as array<{_SPAN}>)")
    extra = F.when(F.col("__terms").isNotNull(), located(body, word, 4)).otherwise(none)
    return (docs.join(terms, F.col(f"`{id}`") == F.col("__id"), "left")
            .withColumn(out, F.concat(*base_spans(body).values(), extra)).drop("__id", "__terms"))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"),
                                                                 s["end"].cast("string"))), ",")


def sanitised(text: Column, spans: Column) -> Column:
    """The text with a tag in place of each span; of spans that overlap the first (then longest) is named, all are covered."""
    tag = F.array(*map(F.lit, TAGS))
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], (-s["end"]).alias("back"), s["kind"])))
    start = F.expr("struct(0 as at, cast(array() as array<string>) as out)")

    def add(acc: Column, s: Column) -> Column:
        end = -s["back"]
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(F.greatest(acc["at"], end).alias("at"), F.when(s["start"] >= acc["at"], F.concat(
            acc["out"], F.array(gap, F.get(tag, s["kind"])))).otherwise(acc["out"]).alias("out"))

    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(order, start, add, lambda acc: F.concat(
        F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text)))))


def sanitise(docs: DataFrame, id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD,
             support: int = SUPPORT) -> DataFrame:
    """``docs`` with ``text`` sanitised; a null text stays null, all rows and other columns stay as they are."""
    found = find(docs, id, text, threshold, support, out="__spans")
    return found.withColumn(text, sanitised(F.col(f"`{text}`"), F.col("__spans"))).drop("__spans")
