"""Views of the given tables in the shapes of this library, in Spark and in SQL.

Nothing is sampled or cut: every document, every word, every event is used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kalangu.functions import text as X
from kalangu.functions.binding import let
from kalangu.functions.timing import epoch_seconds
from kalangu.session import spread

UTTERANCE_WORDS = 24
SPEAKER_CAP = 30
FRAME_RATE = 640  # 16-sample frames at 25 ms


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def clips(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as clips: 14 characters per second, source as speaker."""
    d = table(spark, sf, "documents")
    ten = F.col("doc_id") % 10
    return d.select(
        "doc_id", F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".flac")).alias("audio_path"),
        (F.col("n_chars") / 14.0).alias("duration"), "text", F.col("text").alias("transcript"),
        F.col("lang").alias("language"), F.col("source").alias("speaker_id"), F.col("source").alias("dialect"),
        F.col("source").alias("accent"),
        F.when(ten == 8, "dev").when(ten == 9, "test").otherwise("train").alias("split"))


def cut_words(words: Column, size: int = UTTERANCE_WORDS) -> Column:
    """All words in consecutive runs of ``size``."""
    def runs(w: Column, n: Column) -> Column:
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(w, i * size + 1, size)))

    return let(lambda w: let(runs, w, F.ceil(F.size(w) / size).cast("int")), words)


def hypothesis_a(w: Column) -> Column:
    changed = F.transform(w, lambda x, i: F.when(i % 7 == 3, F.lit(None).cast("string"))
                          .when(i % 5 == 1, F.lit("x")).otherwise(x))
    return F.filter(changed, lambda x: x.isNotNull())


def hypothesis_b(w: Column, mode: Column) -> Column:
    nothing = F.slice(w, 1, 0)
    return (F.when(mode == 0, w)
            .when(mode == 1, F.filter(w, lambda x, i: i % 3 == 0))
            .when(mode == 2, F.transform(w, lambda x, i: F.when(i % 2 == 0, F.lit("ждать")).otherwise(x)))
            .when(mode == 3, F.flatten(F.transform(w, lambda x: F.array(x, x))))
            .when(mode == 4, hypothesis_a(w))
            .otherwise(nothing))


def utterances(spark: SparkSession, sf: str) -> DataFrame:
    """Whole documents cut into 24-word utterances, with two hypothesis sets."""
    c = spread(clips(spark, sf)).select("doc_id", "audio_path", "language", "speaker_id", "dialect",
                                F.posexplode(cut_words(X.words(F.col("text")))).alias("u", "w"))
    mode = (F.col("doc_id") + F.col("u")) % 6
    return c.select(
        F.concat_ws("-", F.col("doc_id").cast("string"), F.col("u").cast("string")).alias("key"),
        "doc_id", "u", "audio_path", "language", "speaker_id", "dialect", (F.size("w") / 2.5).alias("duration"),
        F.array_join("w", " ").alias("ref"), F.array_join(hypothesis_a(F.col("w")), " ").alias("hyp_a"),
        F.array_join(hypothesis_b(F.col("w"), mode), " ").alias("hyp_b"))


def texts(spark: SparkSession, sf: str) -> DataFrame:
    """Whole documents as one clip each, with a hypothesis of every document."""
    c = spread(clips(spark, sf)).select("doc_id", "language", X.words(F.col("text")).alias("w"))
    return c.select("doc_id", "language", F.array_join("w", " ").alias("ref"), F.array_join(hypothesis_a(F.col("w")), " ").alias("hyp"))


def tagged(spark: SparkSession, sf: str) -> DataFrame:
    """Whole conversation turns as tagged words: language alternates between role and 'mixed'."""
    c = spread(table(spark, sf, "conversations")).select("conv_id", "turn", "role", X.words(F.col("text")).alias("w"))

    def tag(i: Column) -> Column:
        return F.when(i % 3 == 2, F.lit("mixed")).otherwise(F.col("role"))

    ref = F.transform("w", lambda x, i: F.struct(x.alias("word"), tag(i).alias("language")))
    changed = F.transform("w", lambda x, i: F.when(i % 7 != 3, F.struct(
        F.when(i % 5 == 1, F.lit("x")).otherwise(x).alias("word"),
        F.when(i % 4 == 2, F.lit("other")).otherwise(tag(i)).alias("language"))))
    return c.filter(F.size("w") > 0).select("conv_id", "turn", ref.alias("ref_tagged"),
                    F.filter(changed, lambda x: x.isNotNull()).alias("hyp_tagged"))


def run_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events as training events: user as run, event kinds as event types."""
    e = table(spark, sf, "events")
    kinds = {"signup": "train_start", "view": "step", "click": "eval", "purchase": "train_end", "error": "error"}
    kind = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])[F.col("event_type")]
    k = F.get_json_object("props", "$.k").cast("long")
    e = e.select("event_id", epoch_seconds(F.col("ts")).alias("ts"), "user_id", kind.alias("type"), "value", k.alias("k"))

    def only(value: Column, *types: str) -> Column:
        return F.when(F.col("type").isin(*types), value)

    return e.select(
        "ts", F.concat(F.lit("run_"), F.col("user_id").cast("string")).alias("run_id"), "type",
        only(F.col("k") * 10, "train_start", "train_end").alias("total_steps"),
        only(F.col("k"), "step", "eval", "error").alias("step"), only(F.col("value"), "step").alias("loss"),
        only(F.col("value") / 1000, "step").alias("lr"), only(F.col("value") / 10, "step").alias("grad_norm"),
        F.when((F.col("type") == "eval") & (F.col("k") % 5 != 0), F.create_map(
            F.lit("en"), F.col("value") / 1000, F.lit("ha"), F.col("value") / 500)).alias("wer"),
        only(F.col("value"), "eval").alias("eval_loss"), F.col("event_id").alias("pos"),
        F.concat(F.lit("stage"), (F.col("user_id") % 4).cast("string")).alias("stage_name"))


def evals(spark: SparkSession, sf: str) -> DataFrame:
    """Evaluations of a run with a metric that may be NaN."""
    e = run_events(spark, sf).filter("type = 'eval'")
    return e.select("run_id", "ts", "pos", F.col("pos").alias("checkpoint"),
                    F.when(F.col("step") % 7 == 0, F.lit(float("nan"))).otherwise(F.round("eval_loss", 0)).alias("metric"))


def waveforms(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings as short clips, louder with the label."""
    e = table(spark, sf, "embeddings")
    gain = (F.col("label") + 1) * F.lit(0.5)
    return e.select("vec_id", "label", F.transform(
        "embedding", lambda x: (x.cast("double") * gain).cast("float")).alias("samples"),
        F.lit(FRAME_RATE).alias("sample_rate"))


def score_maps(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", F.create_map(*[x for i in range(64) for x in (
        F.lit(f"label_{i}"), F.get("embedding", F.lit(i)).cast("double"))]).alias("scores"))


# --- the same views in SQL ---------------------------------------------------

_WORDS = r"list_filter(regexp_split_to_array({0}, '\s+'), lambda x: x <> '')"
_HYP_A = ("list_filter(list_transform(w, lambda x, i: CASE WHEN (i-1)%7=3 THEN NULL "
          "WHEN (i-1)%5=1 THEN 'x' ELSE x END), lambda x: x IS NOT NULL)")

SQL_VIEWS = {
    "clips": """SELECT doc_id, source || '/' || doc_id || '.flac' AS audio_path,
        n_chars::DOUBLE / 14.0::DOUBLE AS duration, text, text AS transcript, lang AS language,
        source AS speaker_id, source AS dialect, source AS accent,
        CASE doc_id % 10 WHEN 8 THEN 'dev' WHEN 9 THEN 'test' ELSE 'train' END AS split FROM documents""",
    "doc_words": f"SELECT *, {_WORDS.format('text')} AS ws FROM clips",
    "cut": """SELECT doc_id, audio_path, language, speaker_id, dialect, u, ws[u*24+1:u*24+24] AS w
        FROM (SELECT *, unnest(range(0, (len(ws)+23)//24)) AS u FROM doc_words)""",
    "utt": f"""SELECT doc_id || '-' || u AS key, doc_id, u, audio_path, language, speaker_id, dialect,
        len(w)::DOUBLE / 2.5::DOUBLE AS duration, w AS rw, {_HYP_A} AS aw,
        CASE (doc_id + u) % 6 WHEN 0 THEN w
          WHEN 1 THEN list_filter(w, lambda x, i: (i-1)%3=0)
          WHEN 2 THEN list_transform(w, lambda x, i: CASE WHEN (i-1)%2=0 THEN 'ждать' ELSE x END)
          WHEN 3 THEN flatten(list_transform(w, lambda x: [x, x]))
          WHEN 4 THEN {_HYP_A}
          ELSE w[1:0] END AS bw FROM cut""",
    "utt_text": """SELECT *, array_to_string(rw, ' ') AS ref, array_to_string(aw, ' ') AS hyp_a,
        array_to_string(bw, ' ') AS hyp_b FROM utt""",
    # every distinct word of a pair as one byte, so that byte-wise levenshtein counts words
    "utt_dist": """SELECT *,
        levenshtein(array_to_string(list_transform(rw, lambda x: chr(list_position(va, x)::INT)), ''),
                    array_to_string(list_transform(aw, lambda x: chr(list_position(va, x)::INT)), '')) AS da,
        levenshtein(array_to_string(list_transform(rw, lambda x: chr(list_position(vb, x)::INT)), ''),
                    array_to_string(list_transform(bw, lambda x: chr(list_position(vb, x)::INT)), '')) AS db
        FROM (SELECT *, list_distinct(list_concat(rw, aw)) AS va, list_distinct(list_concat(rw, bw)) AS vb
              FROM utt_text)""",
    "ev": """SELECT epoch_us(ts) / 1000000.0::DOUBLE AS ts, 'run_' || user_id AS run_id, t AS type,
        CASE WHEN t IN ('train_start', 'train_end') THEN k * 10 END AS total_steps,
        CASE WHEN t IN ('step', 'eval', 'error') THEN k END AS step,
        CASE WHEN t = 'step' THEN value END AS loss,
        CASE WHEN t = 'step' THEN value / 1000 END AS lr,
        CASE WHEN t = 'step' THEN value / 10 END AS grad_norm,
        CASE WHEN t = 'eval' AND k % 5 <> 0 THEN value / 1000 END AS wer_en,
        CASE WHEN t = 'eval' AND k % 5 <> 0 THEN value / 500 END AS wer_ha,
        CASE WHEN t = 'eval' THEN value END AS eval_loss, event_id AS pos, 'stage' || (user_id % 4) AS stage_name
        FROM (SELECT *, (props::JSON ->> '$.k')::BIGINT AS k, CASE event_type WHEN 'signup' THEN 'train_start'
          WHEN 'view' THEN 'step' WHEN 'click' THEN 'eval' WHEN 'purchase' THEN 'train_end' ELSE 'error' END AS t
          FROM events)""",
    "runs": """SELECT stage_name, run_id,
        coalesce(arg_max(CASE type WHEN 'train_end' THEN 'completed' ELSE 'error' END, pos_key)
                 FILTER (WHERE type IN ('train_end', 'error')), 'running') AS status,
        coalesce(max(step) FILTER (WHERE type = 'step'), 0) AS step,
        coalesce(arg_max(total_steps, pos_key) FILTER (WHERE type = 'train_start'), 0) AS total_steps,
        arg_max(loss, pos_key) FILTER (WHERE type = 'step') AS train_loss,
        arg_max(eval_loss, pos_key) FILTER (WHERE type = 'eval') AS val_loss,
        arg_max((wer_en + wer_ha) / 2, pos_key) FILTER (WHERE wer_en IS NOT NULL) AS wer,
        arg_min(ts, pos_key) AS created_at, arg_max(ts, pos_key) AS updated_at
        FROM (SELECT *, row(ts, pos) AS pos_key FROM ev) GROUP BY ALL""",
    "evals": """SELECT run_id, ts, pos, pos AS checkpoint,
        CASE WHEN step % 7 = 0 THEN NULL ELSE round(eval_loss, 0) END AS metric FROM ev WHERE type = 'eval'""",
    "wave": f"""SELECT vec_id, label, list_transform(embedding::FLOAT[], lambda x:
        (x::DOUBLE * ((label + 1) * 0.5::DOUBLE))::FLOAT) AS samples, {FRAME_RATE} AS sample_rate FROM embeddings""",
}

_NEEDS = {"doc_words": ["clips"], "cut": ["doc_words"], "utt": ["cut"], "utt_text": ["utt"],
          "utt_dist": ["utt_text"], "runs": ["ev"], "evals": ["ev"]}


def with_views(*names: str, body: str) -> str:
    """``body`` after the WITH clause of the named views and those they need."""
    order: list[str] = []

    def visit(name: str) -> None:
        for need in _NEEDS.get(name, ()):
            visit(need)
        if name not in order:
            order.append(name)

    for name in names:
        visit(name)
    head = ",\n".join(f"{n} AS MATERIALIZED ({SQL_VIEWS[n]})" for n in order)
    return f"WITH {head}\n{body}" if order else body
