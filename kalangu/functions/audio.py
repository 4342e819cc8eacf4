"""Measures and transforms of decoded sample arrays (array<float> columns)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from kalangu.functions.binding import let
from kalangu.functions.hashing import hash_to_unit, seeded_hash, seeded_uniform


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def mono(channels: Column) -> Column:
    """Mean over channels of an array<array<float>>."""
    def mean(ch: Column) -> Column:
        total = F.aggregate(
            F.slice(ch, F.lit(2), F.greatest(F.size(ch) - 1, F.lit(0))),
            F.transform(F.get(ch, F.lit(0)), lambda x: x.cast("double")),
            lambda acc, one: F.zip_with(acc, one, lambda a, b: a + b.cast("double")))
        return F.transform(total, lambda x: (x / F.size(ch)).cast("float"))

    return let(mean, channels)


def duration_sec(samples: Column, sample_rate: Column) -> Column:
    return F.size(samples) / sample_rate


def dbfs(level: Column) -> Column:
    """Level relative to full scale in dB, floored at 1e-9."""
    return F.lit(20.0) * F.log10(F.greatest(level.cast("double"), F.lit(1e-9)))


def rms(samples: Column) -> Column:
    squares = F.transform(samples, lambda x: x.cast("double") * x.cast("double"))
    return F.sqrt(_sum(squares) / F.size(samples))


def peak(samples: Column) -> Column:
    return F.array_max(F.transform(samples, lambda x: F.abs(x.cast("double"))))


def clipped_share(samples: Column, level: float = 0.999) -> Column:
    return F.size(F.filter(samples, lambda x: F.abs(x.cast("double")) >= level)) / F.size(samples)


def frame_size(sample_rate: Column, frame_ms: float = 25.0) -> Column:
    return F.greatest(F.lit(1), F.floor(sample_rate * frame_ms / 1000.0).cast("int"))


def frame_rms(samples: Column, frame: Column) -> Column:
    """RMS of each whole frame; the trailing remainder is dropped."""
    n = F.floor(F.size(samples) / frame).cast("int")
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: rms(F.slice(samples, i * frame + 1, frame)))


def snr_db(frames: Column) -> Column:
    """Loudest over quietest frame in dB; 0 for a single frame."""
    def ratio(x: Column) -> Column:
        return F.greatest(F.array_max(x), F.lit(1e-9)) / (F.array_min(x) + 1e-9)

    return let(lambda x: F.when(F.size(x) > 1, 20.0 * F.log10(ratio(x))).otherwise(0.0), frames)


def silence_share(frames: Column, floor_db: float = -50.0) -> Column:
    def share(all_frames: Column) -> Column:
        quiet = F.filter(all_frames, lambda x: x < F.lit(10 ** (floor_db / 20.0)))
        return F.when(F.size(all_frames) > 0, F.size(quiet) / F.size(all_frames)).otherwise(1.0)

    return let(share, frames)


QUALITY_TYPE = T.StructType([
    T.StructField(c, T.IntegerType() if c.startswith("n_") else T.DoubleType())
    for c in ("n_samples", "rms", "peak", "clip_frac", "n_frames", "frame_max", "frame_min",
              "silence_frac")])


@pandas_udf(QUALITY_TYPE)
def quality_measures(samples: pd.Series, frame: pd.Series) -> pd.DataFrame:
    """All quality measures of a clip in one pass over its samples.

    Native array functions box every sample; for clips of half a million
    samples one vectorised pass per Arrow batch is the cheaper way.
    """
    quiet = 10 ** (-50.0 / 20.0)
    rows = []
    for x, size in zip(samples, frame):
        if x is None or len(x) == 0:
            rows.append((0, None, None, None, 0, None, None, None))
            continue
        x = np.asarray(x, dtype=np.float64)
        size = int(size)
        n = len(x) // size
        levels = np.sqrt(np.mean(x[:n * size].reshape(n, size) ** 2, axis=1)) if n else np.array([])
        rows.append((
            len(x), float(np.sqrt(np.mean(x ** 2))), float(np.abs(x).max()),
            float(np.mean(np.abs(x) >= 0.999)), n,
            float(levels.max()) if n else None, float(levels.min()) if n else None,
            float(np.mean(levels < quiet)) if n else 1.0))
    return pd.DataFrame(rows, columns=QUALITY_TYPE.names)


def limit_peak(samples: Column, ceiling: float = 0.99) -> Column:
    """Scale down so that the peak does not exceed the ceiling."""
    def scale(top: Column) -> Column:
        return F.when(top > ceiling, F.lit(ceiling) / top).otherwise(1.0)

    return let(lambda factor: F.transform(samples, lambda x: (x.cast("double") * factor).cast("float")),
               let(scale, peak(samples)))


def truncate(samples: Column, sample_rate: Column, max_sec: float) -> Column:
    return F.slice(samples, F.lit(1), F.floor(sample_rate * max_sec).cast("int"))


def fixed_segments(samples: Column, sample_rate: Column, only_above_sec: float = 30.0,
                   segment_sec: float = 3.0, min_samples: int = 1600) -> Column:
    """Consecutive segments of a long clip as array<struct<start,end,samples>>.

    Null for clips not longer than the threshold; the list stops at the first
    segment that is too short.
    """
    n = F.size(samples)
    length = F.floor(sample_rate * segment_sec).cast("int")
    full = F.floor(n / length).cast("int")
    count = full + F.when(n - full * length >= min_samples, 1).otherwise(0)
    index = F.when((count > 0) & (length >= min_samples), F.sequence(F.lit(0), count - 1)).otherwise(
        F.array().cast("array<int>"))
    secs = n / sample_rate
    return F.when(secs > only_above_sec, F.transform(index, lambda i: F.struct(
        F.round(i * length / sample_rate, 2).alias("start"),
        F.round(F.least((i + 1) * length / sample_rate, secs), 2).alias("end"),
        F.slice(samples, i * length + 1, length).alias("samples"))))


def mu_law_roundtrip(samples: Column, levels: int = 256) -> Column:
    """Encode to mu-law levels and decode again."""
    mu = float(levels - 1)

    def one(x: Column) -> Column:
        x = x.cast("double")
        packed = F.signum(x) * F.log1p(mu * F.abs(x)) / F.log1p(F.lit(mu))
        code = F.floor((packed + 1.0) / 2.0 * mu + 0.5)
        y = code / mu * 2.0 - 1.0
        return F.signum(y) * (F.exp(F.abs(y) * F.log1p(F.lit(mu))) - 1.0) / mu

    return F.transform(samples, one)


def _gaussian(key: Column, seed: int) -> Column:
    """Standard normal draw by Box-Muller from two seeded uniforms."""
    u1 = F.greatest(seeded_uniform(key, seed), F.lit(2.0 ** -33))
    u2 = seeded_uniform(key, seed + 1)
    return F.sqrt(-2.0 * F.log(u1)) * F.cos(u2 * 6.283185307179586)


def add_noise(samples: Column, key: Column, snr: Column, seed: int = 42) -> Column:
    """White noise at the given SNR in dB, clamped to [-1, 1].

    The noise of sample i is drawn from (seed, key, i): the same on every run.
    """
    power = F.greatest(F.pow(rms(samples), 2), F.lit(1e-9)) / F.pow(F.lit(10.0), snr / 10.0)

    def noisy(sigma: Column) -> Column:
        return F.transform(samples, lambda x, i: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x.cast("double")
                           + sigma * _gaussian(F.concat_ws(":", key.cast("string"), i.cast("string")), seed))))

    return let(noisy, F.sqrt(power))


def augmentation_plan(key: Column, seed: int = 42, p_speed: float = 0.3, p_telephony: float = 0.5,
                      p_noise: float = 0.3, speeds=(0.9, 1.0, 1.1),
                      snr_range=(10.0, 20.0)) -> Column:
    """Independent draws for one clip: speed factor, telephony, noise SNR.

    Fields are null (false for telephony) where the step is not applied.
    """
    def u(name):
        return hash_to_unit(seeded_hash(F.concat_ws(":", key.cast("string"), F.lit(name)), seed))

    pick = F.floor(u("speed_pick") * len(speeds)).cast("int")
    return F.struct(
        F.when(u("speed") < p_speed, F.array(*[F.lit(float(s)) for s in speeds])[pick]).alias("speed"),
        (u("telephony") < p_telephony).alias("telephony"),
        F.when(u("noise") < p_noise, F.lit(snr_range[0]) + u("snr") * (snr_range[1] - snr_range[0]))
        .alias("noise_snr_db"))
