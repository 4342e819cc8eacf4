"""Hooks for caller-supplied models. No model ships with this library."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def score_with(df: DataFrame, load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]],
               key: str, output: str, columns: list[str] | None = None,
               batch_rows: int = 16) -> DataFrame:
    """Score rows with a model loaded once per task.

    ``load()`` returns a function from a small frame to a frame of the
    ``output`` columns, row for row. When a batch fails its rows are tried one
    by one; a row that fails alone has nulls and the message in ``error``.
    """
    out = T._parse_datatype_string(output)
    names = [f.name for f in out.fields]
    key_type = df.schema[key]
    schema = T.StructType([key_type, *out.fields, T.StructField("error", T.StringType())])

    def attempt(fn, frame: pd.DataFrame) -> pd.DataFrame:
        scored = fn(frame)
        return pd.DataFrame({key: frame[key].to_numpy(), **{n: list(scored[n]) for n in names},
                             "error": [None] * len(frame)})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fn = load()
        for frame in frames:
            for at in range(0, len(frame), batch_rows):
                part = frame.iloc[at:at + batch_rows]
                try:
                    yield attempt(fn, part)
                except Exception:  # noqa: BLE001 - one bad clip must not fail the job
                    for i in range(len(part)):
                        one = part.iloc[i:i + 1]
                        try:
                            yield attempt(fn, one)
                        except Exception as exc:  # noqa: BLE001
                            yield pd.DataFrame({key: one[key].to_numpy(), **{n: [None] for n in names},
                                                "error": [str(exc)]})

    return df.select(key, *(columns or [c for c in df.columns if c != key])).mapInPandas(run, schema)


def combine_analyses(clips: DataFrame, key: str, **parts: DataFrame) -> DataFrame:
    """Left-join the outputs of several hooks as one struct column each; null where absent."""
    out = clips
    for name, part in parts.items():
        body = F.struct(*[c for c in part.columns if c != key]).alias(name)
        out = out.join(part.select(key, body), key, "left")
    return out
