"""One named query per operator, over its whole table, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kalangu.llm import jaccard, mixing, phrases, pieces, privacy, quality, ranked, secrets, simhash, substrings, toxicity, versions, warc
from kalangu.session import fresh_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query
def op1_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    """Probability that each document is toxic, learned from labels that are not held out."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf, "labels")))


@query
def op2_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Rule statistics of every document and whether it is kept."""
    rated = quality.rate(table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "labels"))
    return rated.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "anomaly")


@query
def op3_simhash(spark: SparkSession, sf: str) -> DataFrame:
    """SimHash fingerprint of every document and its near-duplicate group at four bits."""
    return simhash.near_duplicates(table(spark, sf, "documents"))


@query
def op4_secrets(spark: SparkSession, sf: str) -> DataFrame:
    """Secrets in every document: pattern spans, and values that are costly to guess."""
    found = secrets.find(table(spark, sf, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < 3)
    return found.select("doc_id", *[count(k).alias(f"n_{name}") for k, name in enumerate(secrets.KINDS[:3])],
                        F.sha2(secrets.listed(base), 256).alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans"))


@query
def op5_substrings(spark: SparkSession, sf: str) -> DataFrame:
    """Every document without the 13-word windows that a smaller id has too."""
    kept = substrings.deduplicate(table(spark, sf, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("deduplicated", 256).alias("kept_sha256"))


@query
def op6_archives(spark: SparkSession, sf: str) -> DataFrame:
    """Every page written to archives and read back: size and digest of its payload, and what it revisits."""
    path = fresh_path(spark, "archives")
    warc.write(table(spark, sf, "pages"), path)
    return warc.read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "status")


@query
def op7_privacy(spark: SparkSession, sf: str) -> DataFrame:
    """Personal data in every document: pattern spans, and terms that give their entities away."""
    found = privacy.find(table(spark, sf, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < 4)
    return found.select("doc_id", *[count(k).alias(f"n_{name}") for k, name in enumerate(privacy.KINDS[:4])],
                        F.sha2(privacy.listed(base), 256).alias("base_sha256"), privacy.listed(F.col("spans")).alias("spans"))


@query
def op8_versions(spark: SparkSession, sf: str) -> DataFrame:
    """Sketches of every document and its edited text, and the likeness of both pairs."""
    return versions.compare(table(spark, sf, "documents"))


@query
def op9_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """Ids of every document by the merge agenda, and the digests of ids and decoded text."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    coded = pieces.encode_and_decode(docs, packed=True)
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op10_mixing(spark: SparkSession, sf: str) -> DataFrame:
    """How often the mix of sources holds each document, at most four passes over any source."""
    return mixing.plan(table(spark, sf, "documents")).withColumn("weight", F.round("weight", 9))


@query
def op11_ranked(spark: SparkSession, sf: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return ranked.search(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query
def op12_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    """Size of every document's set of four-word shingles and its component over links of similarity 0.85."""
    return jaccard.classes(table(spark, sf, "documents"))


@query
def op13_phrases(spark: SparkSession, sf: str) -> DataFrame:
    """The first 2,000 collocations of every language."""
    return phrases.collocations(table(spark, sf, "documents"))


ORACLE["op10_mixing"] = r"""
WITH RECURSIVE r AS MATERIALIZED (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens,
         md5('42:' || doc_id) AS h, substr(md5('42:' || doc_id), 1, 3) AS block FROM documents),
b AS MATERIALIZED (SELECT source, block, sum(n_tokens)::BIGINT AS held FROM r GROUP BY ALL),
s AS MATERIALIZED (SELECT source, sum(held)::BIGINT AS t FROM b GROUP BY ALL),
m AS MATERIALIZED (SELECT max(t)::DOUBLE AS most, max(t)::DOUBLE / min(t)::DOUBLE AS spread FROM s WHERE t > 0),
bisect(i, good, bad) AS (
  SELECT 0, 1.0::DOUBLE, 0.0::DOUBLE
  UNION ALL
  SELECT i + 1, CASE WHEN pow(spread, 1 - (good + bad) / 2) <= 4 THEN (good + bad) / 2 ELSE good END,
         CASE WHEN pow(spread, 1 - (good + bad) / 2) <= 4 THEN bad ELSE (good + bad) / 2 END
  FROM bisect, m WHERE i < 50),
a AS MATERIALIZED (SELECT CASE WHEN spread <= 4 THEN 0.0::DOUBLE ELSE good END AS a FROM bisect, m WHERE i = 50),
goal AS MATERIALIZED (
  SELECT source, t, pow(t::DOUBLE / most, a) / sum(pow(t::DOUBLE / most, a)) OVER () AS weight,
         floor(t * pow(most / t, 1 - a) + 0.5)::BIGINT AS budget FROM s, m, a WHERE t > 0),
cut AS MATERIALIZED (
  SELECT b.*, coalesce(weight, 0) AS weight, coalesce(budget // t, 1) AS whole, coalesce(budget % t, 0)
    - (sum(held) OVER (PARTITION BY source ORDER BY md5('42:' || coalesce(source, '') || '/' || block), block) - held) AS room
  FROM b LEFT JOIN goal USING (source))
SELECT doc_id, r.source, n_tokens, r.block, round(weight, 9) AS weight, (whole + CASE
    WHEN room <= 0 THEN 0 WHEN room >= held THEN (held > 0)::INT
    WHEN sum(n_tokens) OVER (PARTITION BY r.source, r.block ORDER BY h RANGE UNBOUNDED PRECEDING) <= room THEN 1
    ELSE 0 END)::INT AS copies
FROM r JOIN cut ON r.source IS NOT DISTINCT FROM cut.source AND r.block = cut.block"""


ORACLE["op5_substrings"] = r"""
WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS MATERIALIZED (SELECT doc_id, i, array_to_string(w[i:i+12], ' ') AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
c AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i
  FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS low FROM p) WHERE low < doc_id),
k AS MATERIALIZED (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d) ANTI JOIN c USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)"""

ORACLE["op6_archives"] = """
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, array_to_string(list_transform(range(32), lambda k:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      ((('0x' || substr(h, (k // 4 * 5 + 1)::INT, 5))::BIGINT >> (15 - k % 4 * 5)::INT) & 31)::INT + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> f THEN f END AS refers_to, 'ok' AS status
FROM (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h,
        min(page_id) OVER (PARTITION BY coalesce(html, '')) AS f FROM pages)"""

ORACLE["op11_ranked"] = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
s AS MATERIALIZED (SELECT count(*)::BIGINT AS nn, sum(len(w))::BIGINT AS ll FROM d WHERE len(w) > 0),
i AS MATERIALIZED (SELECT DISTINCT item_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
p AS MATERIALIZED (SELECT r, doc_id, n, t, count(*)::BIGINT AS tf
  FROM (SELECT r, doc_id, len(w)::BIGINT AS n, unnest(w) AS t FROM d) SEMI JOIN i USING (t) GROUP BY ALL),
f AS MATERIALIZED (SELECT t, floor(1000 * ln((2 * any_value(nn) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight
  FROM p, s GROUP BY t),
c AS (SELECT item_id, r, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * nn) // ll))))::BIGINT AS score
  FROM p JOIN f USING (t) JOIN i USING (t), s GROUP BY ALL)
SELECT item_id, (row_number() OVER best)::INT AS rank, doc_id, score FROM c WHERE score > 0
WINDOW best AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER best <= 10"""

ORACLE["op12_jaccard"] = r"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, list_distinct(list_transform(range(1, greatest(1, len(w) - 3) + 1),
    lambda i: array_to_string(w[i:i + 3], ' '))) AS g FROM d WHERE len(w) > 0),
k AS MATERIALIZED (SELECT list_sort(g) AS g, min(doc_id) AS node FROM s GROUP BY 1),
p AS MATERIALIZED (SELECT node, len(g) AS n, unnest(g) AS x FROM k),
links AS MATERIALIZED (SELECT a.node AS a, b.node AS b FROM p a JOIN p b ON a.x = b.x AND a.node < b.node
  GROUP BY a.node, b.node HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
reach(node, r) AS (SELECT node, node FROM k UNION
  SELECT l.b, r FROM reach JOIN (SELECT a, b FROM links UNION ALL SELECT b, a FROM links) l ON l.a = reach.node),
c AS MATERIALIZED (SELECT node, min(r) AS component_id FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(len(s.g), 0)::BIGINT AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id
FROM d LEFT JOIN s USING (doc_id) LEFT JOIN k ON k.g = list_sort(s.g) LEFT JOIN c USING (node)"""

ORACLE["op13_phrases"] = r"""
WITH q AS MATERIALIZED (SELECT row_number() OVER () AS piece, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents)),
t AS MATERIALIZED (SELECT lang, sum(len(w))::HUGEINT AS n FROM q GROUP BY lang),
g AS MATERIALIZED (SELECT lang, k, phrase, count(*)::HUGEINT AS f
  FROM (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
    FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM q, (SELECT unnest(range(1, 6)) AS k) WHERE len(w) >= k))
  GROUP BY ALL HAVING count(*) >= 100),
c AS MATERIALIZED (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, f FROM g WHERE k > 1),
u AS MATERIALIZED (SELECT c.lang, c.phrase, c.f AS a, x.f AS l, y.f AS r, t.n, cut, (1000 * c.f * t.n) // (x.f * y.f) AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM c) AS c
  JOIN g AS x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:cut], ' ')
  JOIN g AS y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[cut + 1:], ' ')
  JOIN t ON t.lang = c.lang),
b AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inner_ AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(f) AS f
  FROM (SELECT lang, w, f, m, unnest(range(1, k - m + 2)) AS i FROM c, (SELECT unnest(range(2, 5)) AS m) WHERE m < k) GROUP BY ALL),
e AS (SELECT b.* FROM b LEFT JOIN inner_ USING (lang, phrase) WHERE inner_.f IS NULL OR 100 * inner_.f < 100 * b.a)
SELECT lang, row_number() OVER best AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n,
  score::BIGINT AS score FROM e
WINDOW best AS (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) QUALIFY row_number() OVER best <= 2000"""
