"""Functions over maps, structs and JSON text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kalangu import schema as S
from kalangu.functions.binding import let
from kalangu.functions.rounding import decimals, two_places


def ranked_labels(scores: Column) -> Column:
    """Map entries from best to worst as array<struct<label,score>>; ties by label."""
    keyed = F.transform(F.map_entries(scores), lambda e: F.struct(
        (-e["value"]).alias("order"), e["key"].alias("label"), e["value"].alias("score")))
    return F.transform(F.array_sort(keyed), lambda e: F.struct(e["label"], e["score"]))


def top_label(scores: Column) -> Column:
    """Label with the highest score, the first in label order on a tie."""
    return F.get(ranked_labels(scores), F.lit(0))["label"]


def map_mean(values: Column) -> Column:
    """Mean of the non-null values of a map; null when there are none."""
    present = F.filter(F.map_values(values), lambda v: v.isNotNull())
    return let(lambda p: F.when(F.size(p) > 0, F.aggregate(
        p, F.lit(0.0), lambda a, v: a + v.cast("double")) / F.size(p)), present)


def nan_to_null(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def format_wer(wer: Column, fallback: Column) -> Column:
    """'EN: 0.09 | HA: 0.14', else the fallback to 3 places, else a dash; halves go to the even digit."""
    entries = F.filter(F.map_entries(wer), lambda e: e["value"].isNotNull())
    shown = F.array_join(F.transform(entries, lambda e: F.concat(
        F.upper(e["key"]), F.lit(": "), two_places(e["value"].cast("double")))), " | ")
    plain = F.when(fallback.isNotNull(), decimals(fallback.cast("double"), 3))
    return F.coalesce(F.when(F.size(entries) > 0, shown), plain, F.lit("—"))


def wer_value(event_json: Column) -> Column:
    """A WER field that may be a map (its 'overall') or a plain number."""
    return F.coalesce(
        F.get_json_object(event_json, "$.wer.overall").try_cast("double"),
        F.get_json_object(event_json, "$.wer").try_cast("double"))


def envelope(event_json: Column) -> Column:
    """struct<ts, run_id, type, data>, data holding all other keys."""
    fields = F.from_json(event_json, "map<string,string>")
    return F.struct(
        fields["ts"].try_cast("double").alias("ts"), fields["run_id"].alias("run_id"),
        fields["type"].alias("type"),
        F.map_filter(fields, lambda k, _: ~k.isin("ts", "run_id", "type")).alias("data"))


def parse_spans(spans_json: Column) -> Column:
    return F.from_json(spans_json, f"array<{S.CS_SPAN.simpleString()}>")


def span_texts(text: Column, spans: Column) -> Column:
    """Text of each span; a span past the end gives what there is."""
    return F.transform(spans, lambda s: F.struct(
        s["language"].alias("language"),
        F.substring(text, s["start"] + 1, F.greatest(s["end"] - s["start"], F.lit(0))).alias("text")))


def decode_payload(payload: Column) -> Column:
    """Bytes of a base64 payload; bad input fails the query."""
    return F.coalesce(
        try_decode_payload(payload),
        F.when(payload.isNotNull(), F.raise_error(F.lit("payload is not base64")).cast("binary")))


def try_decode_payload(payload: Column) -> Column:
    """As ``decode_payload``, with null for bad input."""
    return F.try_to_binary(payload, F.lit("base64"))
