"""Sample, tick and codec clocks. A frame is 1,920 samples at 24 kHz: 80 ms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RATE = 24_000
FRAME = 1_920


def align_up(samples: Column, frame: int = FRAME) -> Column:
    return F.floor((samples + (frame - 1)) / frame) * frame


def codec_frame(ms: Column, rate: int = 75) -> Column:
    """Frames up to a time: floors of absolute time, so that counts alternate and never drift."""
    return F.floor(ms * rate / 1000)


def speech_samples(chars: Column) -> Column:
    """Length of a stand-in utterance: 35 ms a character within 0.32 and 1.2 s, at least 7,200 samples."""
    s = F.least(F.lit(1.2), F.greatest(F.lit(0.32), chars * F.lit(0.035)))
    return F.greatest((s * RATE).cast("long"), F.lit(7200).cast("long"))


def duration_bounds(name: Column) -> tuple[Column, Column]:
    """Lower and upper seconds of short, medium and long plans."""
    low = F.when(name == "short", 4.0).when(name == "medium", 16.0).when(name == "long", 32.0)
    return low, F.when(name == "short", 16.0).when(name == "medium", 32.0).when(name == "long", 60.0)
