"""Waveform metrics and gains over array<float> columns, in higher-order functions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FLOOR = 1e-12


def doubles(wave: Column) -> Column:
    return F.transform(wave, lambda x: x.cast("double"))


def peak(wave: Column) -> Column:
    return F.array_max(F.transform(wave, lambda x: F.abs(x.cast("double"))))


def mean_square(wave: Column) -> Column:
    return F.aggregate(wave, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")) / F.size(wave)


def dbfs(level: Column) -> Column:
    return 20 * F.log10(F.greatest(level, F.lit(FLOOR)))


def clipping(wave: Column, level: float = 0.999) -> Column:
    return F.size(F.filter(wave, lambda x: F.abs(x.cast("double")) >= level)) / F.size(wave)


def frame_active(wave: Column, frame: int, threshold: float = 1e-5) -> Column:
    """array<boolean>: mean square of each frame above the threshold (strictly); the last is padded."""
    n = F.ceil(F.size(wave) / frame).cast("int")
    return F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda k: F.aggregate(F.slice(wave, k * frame + 1, F.lit(frame)), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")) / frame > threshold,
    )


def gain_to(wave: Column, rms_db: float = -23.0, peak_db: float = -1.0) -> Column:
    """Factor to an RMS level, capped so that the peak stays below a level; null for silence."""
    p, r = peak(wave), F.sqrt(mean_square(wave))
    g = F.lit(10 ** (rms_db / 20)) / r
    return F.when(r > 0, F.least(g, F.lit(10 ** (peak_db / 20)) / p))


def pcm_faults(wave: Column, rate: Column, channels: Column, encoding: Column, samples: int = 1920, hertz: int = 24_000) -> Column:
    """Faults of a PCM unit: 24 kHz mono in a known encoding, of the fixed length, finite and within [-1, 1]."""
    from cuewright.functions.checks import failed

    whole = F.forall(wave, lambda a: ~F.isnan(a) & (F.abs(a) <= 1))
    return failed(rate=rate == hertz, channels=channels == 1, encoding=encoding.isin("f32", "s16"), length=F.size(wave) == samples, range=whole)


def from_s16(wave: Column) -> Column:
    """16-bit samples as floats in [-1, 1)."""
    return F.transform(wave, lambda a: a / 32768.0)


def resampled(wave: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Linear interpolation at another rate; past the last sample the last value holds."""
    if rate == to:
        return wave
    n = round(len(wave) * to / rate)
    return np.interp(np.arange(n) * (rate / to), np.arange(len(wave)), wave)


def normalise(df: DataFrame, wave: str, rate: str, channels: str, out: str = "normal", to: int = 24_000, seconds: float = 15.0, rms_db: float = -23.0, peak_db: float = -1.0, kind: str = "float") -> tuple[DataFrame, DataFrame]:
    """(rows with ``out``, rejects with ``reason``): mono waves at rate ``to``, cut to ``seconds``, at one level.

    ``wave`` has interleaved samples, ``rate`` and ``channels`` say how; channels are averaged. The level is that of the RMS,
    lower where the peak would pass ``peak_db``. Silent, empty, non-finite waves and impossible rates or channels are rejects.
    Waves travel as Arrow batches, one numpy pass each; both results read the same expression.
    """
    top, goal, high = int(seconds * to), 10 ** (rms_db / 20), 10 ** (peak_db / 20)

    def one(w, r, c):
        if w is None or not len(w):
            return None, "empty"
        if r is None or r <= 0 or c is None or c <= 0 or len(w) % int(c):
            return None, "rate or channels"
        x = np.asarray(w, float).reshape(-1, int(c)).mean(axis=1)
        if not np.isfinite(x).all():
            return None, "not finite"
        x = resampled(x, int(r), to)[:top]
        level = float(np.sqrt(np.mean(np.square(x)))) if len(x) else 0.0
        if level <= 1e-7:
            return None, "silent"
        x = x * (goal / level)
        most = float(np.abs(x).max())
        return x * min(1.0, high / most), None

    @F.pandas_udf(f"struct<wave: array<{kind}>, reason: string>")
    def run(w: pd.Series, r: pd.Series, c: pd.Series) -> pd.DataFrame:
        got = [one(*x) for x in zip(w, r, c)]
        return pd.DataFrame({"wave": pd.Series([a for a, _ in got], dtype=object), "reason": pd.Series([b for _, b in got], dtype=object)})

    x = df.withColumn("__n", run(F.col(wave), F.col(rate).cast("double"), F.col(channels).cast("double")))
    good = x.where("__n.reason is null").withColumn(out, F.col("__n.wave")).drop("__n")
    return good, x.where("__n.reason is not null").withColumn("reason", F.col("__n.reason")).drop("__n")
