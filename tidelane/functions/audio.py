"""What an audio conversion will give, and how a stream's rate is described; all as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mixdown(asked: str, channels: Column) -> Column:
    """The mixdown that takes effect: mono and stereo as asked, others follow a source of one or two channels."""
    if asked in ("mono", "stereo"):
        return F.lit(asked)
    return F.when(channels == 1, "mono").when(channels == 2, "stereo").otherwise(asked)


def aac_channels(asked: str, channels: Column) -> Column:
    many = F.when(channels <= 0, 2).otherwise(F.least(channels, F.lit(8)))
    kind = mixdown(asked, channels)
    return F.when(kind == "mono", 1).when(kind == "multichannel", many).otherwise(2)


def ac3_channels(channels: Column) -> Column:
    return F.when(channels <= 0, 2).otherwise(F.least(channels, F.lit(6)))


def ac3_bitrate(channels: Column) -> Column:
    """Kilobits a second."""
    return F.when(channels >= 5, 640).when(channels >= 3, 448).when(channels == 2, 192).otherwise(96)


def aac_rate(rate: Column) -> Column:
    """The source's sample rate, at most 48 kHz; unknown is 48 kHz."""
    return F.when(rate <= 0, 48000).when(rate <= 48000, rate).when(rate % 44100 == 0, 44100).otherwise(48000)


def ac3_rate(rate: Column) -> Column:
    return F.when(rate.isin(32000, 44100, 48000), rate).when((rate > 0) & (rate % 44100 == 0), 44100).otherwise(48000)


def lossless_bits(bits: Column) -> Column:
    return F.when(bits <= 0, 24).when(bits <= 16, 16).when(bits <= 24, 24).otherwise(32)


def rate_mode(rate: Column, order: Column) -> Column:
    """An aggregate: "VBR" and the mean of the rates, rounded half to even, where they differ; else "CBR" and the rate; empty without any."""
    mean = F.bround(F.avg(rate)).cast("long").cast("string")
    text = F.when(F.count_distinct(rate) > 1, F.concat(F.lit("VBR "), mean, F.lit(" kbps"))).otherwise(F.concat(F.lit("CBR "), F.min_by(rate, order).cast("string"), F.lit(" kbps")))
    return F.coalesce(text, F.lit(""))


def mean_confidence(confidence: Column) -> Column:
    """An aggregate: the mean, 0 without rows."""
    return F.coalesce(F.avg(confidence), F.lit(0.0))
