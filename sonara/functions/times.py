"""Times: nanoseconds as bigint, seconds as double, samples as bigint."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sonara.schema import SAMPLE_RATE


def seconds_to_ns(seconds: Column) -> Column:
    """Towards zero."""
    return (seconds * 1e9).cast("bigint")


def samples_to_ns(samples: Column) -> Column:
    return seconds_to_ns(samples / float(SAMPLE_RATE))


def round_half_away(x: Column, places: int = 0) -> Column:
    """Rounds the product in floating point, as the published figures do; round() would go by the decimal digits."""
    power = float(10**places)
    return F.signum(x) * F.floor(F.abs(x) * power + 0.5) / power


def region_of(start_s: Column, end_s: Column, n: Column) -> Column:
    """struct(start, end) in samples inside [0, n]; null where nothing is left."""
    inside = lambda s: F.greatest(F.lit(0), F.least(round_half_away(s * SAMPLE_RATE).cast("bigint"), n))
    start, end = inside(start_s), inside(end_s)
    return F.when(end > start, F.struct(start.alias("start"), end.alias("end")))


def nearest_frame(t: Column, step: float, duration: float) -> Column:
    """The frame whose middle is nearest, half to even."""
    return F.rint((t - 0.5 * duration) / step).cast("bigint")
