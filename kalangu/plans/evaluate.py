"""The evaluation run: select clips, score them, report by duration tier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kalangu.operators import metrics as R
from kalangu.operators import splits as J
from kalangu.session import through_table


def select_clips(clips: DataFrame, key: str, min_duration: float = 0.5, max_clips: int = 0,
                 seed: int = 42) -> DataFrame:
    """Clips of at least the duration; ``max_clips`` > 0 asks for a seeded sample of that size."""
    chosen = clips.filter(F.coalesce("duration", F.lit(0.0)) >= min_duration)
    return J.seeded_sample(chosen, key, max_clips, seed) if max_clips > 0 else chosen


def evaluate(clips: DataFrame, key: str, min_duration: float = 0.5, max_clips: int = 0,
             seed: int = 42, store: bool = True) -> tuple[DataFrame, DataFrame]:
    """(per-clip scores, tier statistics) of clips with ref and hyp.

    Scores are computed once: both results read the stored table.
    """
    scored = R.per_clip_scores(select_clips(clips, key, min_duration, max_clips, seed))
    scored = through_table(scored, "scores") if store else scored
    return scored, R.tier_stats(scored, min_duration=min_duration)
