"""Row shapes of the tables this library reads and writes."""

from pyspark.sql import types as T

CS_SPAN = T.StructType([
    T.StructField("start", T.IntegerType()),
    T.StructField("end", T.IntegerType()),
    T.StructField("language", T.StringType()),
])

MANIFEST_REQUIRED = ("audio_path", "duration", "text", "language")

MANIFEST = T.StructType([
    T.StructField("audio_path", T.StringType()),
    T.StructField("duration", T.DoubleType()),
    T.StructField("text", T.StringType()),
    T.StructField("language", T.StringType()),
    T.StructField("dialect", T.StringType()),
    T.StructField("speaker_id", T.StringType()),
    T.StructField("domain", T.StringType()),
    T.StructField("is_code_switched", T.BooleanType()),
    T.StructField("cs_spans", T.ArrayType(CS_SPAN)),
    T.StructField("sample_rate", T.IntegerType()),
    T.StructField("corpus", T.StringType()),
])

MANIFEST_EXTENDED = T.StructType(MANIFEST.fields + [
    T.StructField("cer", T.DoubleType()),
    T.StructField("detected_language", T.StringType()),
    T.StructField("age_group", T.StringType()),
    T.StructField("gender", T.StringType()),
    T.StructField("hf_split_origin", T.StringType()),
])

CORPUS_METADATA = T.StructType([
    T.StructField("file", T.StringType()),
    T.StructField("transcript", T.StringType()),
    T.StructField("accent", T.StringType()),
    T.StructField("country", T.StringType()),
    T.StructField("split", T.StringType()),
    T.StructField("duration", T.DoubleType()),
    T.StructField("speaker_id", T.StringType()),
    T.StructField("age_group", T.StringType()),
    T.StructField("gender", T.StringType()),
])

EVENT = T.StructType([
    T.StructField("ts", T.DoubleType()),
    T.StructField("run_id", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("stage", T.IntegerType()),
    T.StructField("run_name", T.StringType()),
    T.StructField("config_yaml", T.StringType()),
    T.StructField("total_steps", T.LongType()),
    T.StructField("augmentation", T.StringType()),
    T.StructField("step", T.LongType()),
    T.StructField("loss", T.DoubleType()),
    T.StructField("lr", T.DoubleType()),
    T.StructField("grad_norm", T.DoubleType()),
    T.StructField("epoch", T.IntegerType()),
    T.StructField("wer", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("cs_wer", T.DoubleType()),
    T.StructField("eval_loss", T.DoubleType()),
    T.StructField("path", T.StringType()),
    T.StructField("is_best", T.BooleanType()),
    T.StructField("avg_loss", T.DoubleType()),
    T.StructField("message", T.StringType()),
    T.StructField("best_step", T.LongType()),
    T.StructField("best_eval_loss", T.DoubleType()),
])

SPEAKER_ENTRY = T.StructType([
    T.StructField("speaker_id", T.StringType()),
    T.StructField("age_group", T.StringType()),
    T.StructField("gender", T.StringType()),
    T.StructField("split_origin", T.StringType()),
])

CACHE_DETAILS = T.StructType([
    T.StructField("audio_path", T.StringType()),
    T.StructField("cer", T.DoubleType()),
    T.StructField("hypothesis", T.StringType()),
    T.StructField("detected_language", T.StringType()),
    T.StructField("is_code_switched", T.BooleanType()),
    T.StructField("error", T.StringType()),
])

FILTER_CACHE = T.StructType([
    T.StructField("keep", T.BooleanType()),
    T.StructField("reason", T.StringType()),
    T.StructField("details", CACHE_DETAILS),
] + CACHE_DETAILS.fields)

EVAL_REPORT = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("mode", T.StringType()),
    T.StructField("checkpoint", T.StringType()),
    T.StructField("manifest", T.StringType()),
    T.StructField("wer", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("cs_wer", T.DoubleType()),
])

SAMPLE_CATALOG = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("language", T.StringType()),
    T.StructField("file", T.StringType()),
    T.StructField("duration", T.DoubleType()),
])

FEEDBACK = T.StructType([
    T.StructField("ts", T.DoubleType()),
    T.StructField("task", T.StringType()),
    T.StructField("rating", T.IntegerType()),
    T.StructField("comment", T.StringType()),
    T.StructField("model_version", T.StringType()),
])
