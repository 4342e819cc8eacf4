"""Scans of caches, speaker maps, reports, label files, catalogs and file inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kalangu import constants as C
from kalangu import schema as S
from kalangu.functions import text as X
from kalangu.operators.filters import keep_last


def read_filter_cache(spark: SparkSession, pattern: str) -> DataFrame:
    """Cached pass-3 scores of all splits, the last entry per audio path.

    Key and fields may stand at the top of a line or under ``details``. Files
    count in name order.
    """
    raw = spark.read.schema(S.FILTER_CACHE).json(pattern)
    return keep_last(cache_entries(raw.withColumn("_order", F.struct(
        F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()))),
        ["audio_path"], "_order").drop("_order")


def cache_entries(raw: DataFrame) -> DataFrame:
    d = F.col("details")

    def field(name: str) -> Column:
        return F.when(d.isNotNull(), d[name]).otherwise(F.col(name)).alias(name)

    path = F.coalesce(F.when(F.col("audio_path") != "", F.col("audio_path")), d["audio_path"])
    return raw.select(path.alias("audio_path"), field("cer"), field("is_code_switched"),
                      field("detected_language"), "_order").filter(F.coalesce("audio_path", F.lit("")) != "")


_STRING = r'"(?:[^"\\]++|\\.)*+"'
_SPEAKER_ENTRY = rf'{_STRING}\s*+:\s*+\{{(?:[^{{}}"]++|{_STRING})*+\}}'


def read_speaker_map(spark: SparkSession, path: str) -> DataFrame:
    """Speaker map keyed by file stem, from one or more JSON objects.

    Entries are found by a pattern that knows strings, so braces in a value do
    no harm. A file is read by one task; a large map comes as many files. What
    is no entry fails the query. Entries of one stem: the last in file order
    counts.
    """
    files = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("f"))
    rest = F.trim(F.regexp_replace(F.regexp_replace("value", _SPEAKER_ENTRY, ""), r"[\s,{}]+", " "))
    text = F.when(rest == "", F.col("value")).otherwise(F.raise_error(F.concat(F.lit("bad speaker entry: "), rest)).cast("string"))
    found = files.select("f", F.posexplode(F.regexp_extract_all(text, F.lit(_SPEAKER_ENTRY), F.lit(0))).alias("i", "entry"))
    kind = f"map<string,{S.SPEAKER_ENTRY.simpleString()}>"
    as_map = F.from_json(F.concat(F.lit("{"), F.col("entry"), F.lit("}")), kind)
    checked = F.coalesce(as_map, F.raise_error(F.concat(F.lit("bad speaker entry: "), F.col("entry"))).cast(kind))
    rows = found.select("f", "i", F.explode(checked).alias("name", "e"))
    rows = rows.select(X.stem(F.col("name")).alias("stem"), "e.*", F.struct("f", "i").alias("_order"))
    return keep_last(rows, ["stem"], "_order").drop("_order")


def build_speaker_map(rows: DataFrame, order: str) -> DataFrame:
    """Speaker map from corpus rows (path, country, split, speaker columns), last row per file name."""
    named = rows.filter(F.upper(X.strip(F.col("country"))).isin(*C.COUNTRIES)
                        & (F.coalesce("path", F.lit("")) != ""))
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    entries = named.select(X.basename(F.col("path")).alias("name"), text("speaker_id"), text("age_group"),
                           text("gender"), F.col("split").alias("split_origin"), order)
    return keep_last(entries, ["name"], order).drop(order)


def read_reports(spark: SparkSession, folder: str) -> DataFrame:
    """Evaluation reports: every ``*.json`` but the leaderboard; malformed ones are skipped."""
    return (spark.read.schema(S.EVAL_REPORT).option("multiLine", True).option("mode", "DROPMALFORMED")
            .json(f"{folder.rstrip('/')}/*.json")
            .filter(F.col("_metadata.file_name") != "leaderboard.json"))


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of sample entries."""
    return spark.read.schema(S.SAMPLE_CATALOG).option("multiLine", True).json(path)


def catalog_entry(catalog: DataFrame, sample_id: str) -> DataFrame:
    return catalog.filter(F.col("id") == sample_id)


def read_files(spark: SparkSession, folder: str, pattern: str = "*.pt") -> DataFrame:
    """File inventory below a folder: id, stage, created_at, size_bytes, path.

    Only the listing is used; file contents are never read.
    """
    root = folder.rstrip("/")
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
             .option("pathGlobFilter", pattern).load(root).select("path", "modificationTime", "length"))
    uri = F.regexp_replace("path", r"^[a-z0-9]+:/*", "/")
    rel = F.substring_index(uri, root.split(":")[-1].replace("//", "/") + "/", -1)
    return files.select(
        X.stem(F.col("path")).alias("id"),
        F.when(F.instr(rel, "/") > 0, X.parent_name(rel)).otherwise("unknown").alias("stage"),
        F.col("modificationTime").alias("created_at"), F.col("length").alias("size_bytes"), rel.alias("path"))


def newest_files(files: DataFrame, k: int | None = None) -> DataFrame:
    out = files.orderBy(F.desc("created_at"), "path")
    return out.limit(k) if k else out


def map_label(code: Column, labels: dict[str, str]) -> Column:
    """Label of a code, null when unmapped."""
    return F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])[code]


def lab_labels(lines: DataFrame, source: str = "iemocap", labels: dict[str, str] = C.LAB_LABELS) -> DataFrame:
    """Labels from lines ``id time label ...``; short and unmapped lines are dropped.

    ``lines`` has value and folder, the folder two above the label file.
    """
    parts = X.words(F.col("value"))
    return (lines.select("folder", parts.alias("p")).filter(F.size("p") >= 3)
            .select(F.concat(F.col("folder"), F.lit("/sentences/wav/"), F.col("p")[0], F.lit(".wav")).alias("audio_path"),
                    map_label(F.col("p")[2], labels).alias("label"), F.lit(source).alias("source"))
            .filter(F.col("label").isNotNull()))


def read_lab_labels(spark: SparkSession, root: str, audio: DataFrame | None = None, pattern: str = "*.lab") -> DataFrame:
    """Labels of all label files below ``root`` whose audio file exists."""
    lines = (spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(root)
             .select("value", F.regexp_replace(X.plain_path(F.col("_metadata.file_path")), r"/[^/]+/[^/]+$", "").alias("folder")))
    if audio is None:
        audio = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
                 .option("pathGlobFilter", "*.wav").load(root)
                 .select(_plain("path").alias("audio_path")))
    return lab_labels(lines).join(audio, "audio_path", "left_semi")


def _plain(column: str) -> Column:
    """Path of a binaryFile row, which is not percent-encoded, without its local scheme."""
    return F.regexp_replace(column, r"^file:/+", "/")


def stem_labels(files: DataFrame, source: str = "ravdess", labels: dict[str, str] = C.STEM_LABELS) -> DataFrame:
    """Labels from the third dash-separated token of the file stem."""
    parts = F.split(X.stem(F.col("audio_path")), "-")
    return (files.select("audio_path", map_label(F.get(parts, F.lit(2)), labels).alias("label"),
                         F.lit(source).alias("source"))
            .filter(F.col("label").isNotNull()))


def read_stem_labels(spark: SparkSession, root: str) -> DataFrame:
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
             .option("pathGlobFilter", "*.wav").load(root).select(_plain("path").alias("audio_path")))
    return stem_labels(files)
