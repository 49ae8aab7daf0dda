"""Score curves: histograms, coverage, overlap-add and smoothing."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def score_histogram(df: DataFrame, score: Column, bins: int = 10, onset: float = 0.5) -> DataFrame:
    """(bin, n, n_on) of scores in [0, 1]; the last bin has 1 too. Partial counts are made before rows move."""
    return df.groupBy(F.least(F.floor(score * bins), F.lit(bins - 1)).cast("bigint").alias("bin")).agg(F.count("*").alias("n"), F.count_if(score >= onset).alias("n_on"))


def coverage(regions: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """(key, regions, covered) in the regions' unit."""
    return regions.groupBy(key).agg(F.count("*").alias("regions"), F.sum(F.col(end) - F.col(start)).alias("covered"))


def hamming(n: int) -> list[float]:
    return [0.54 - 0.46 * math.cos(2 * math.pi * i / (n - 1)) for i in range(n)] if n > 1 else [1.0] * n


def overlap_add(windows: DataFrame, key: str, window: str, scores: str, frames: int, hop_s: float, frame_s: float) -> DataFrame:
    """(key, frame, score): the mean of all windows that cover a frame, by Hamming weights.

    window counts from 0 and begins hop_s seconds after the one before; scores is its array of `frames` values.
    """
    weights = F.array(*(F.lit(w) for w in hamming(frames)))
    begin = F.rint((F.col(window) * hop_s - F.lit(0.5 * frame_s) + F.lit(0.5 * frame_s)) / frame_s).cast("bigint")
    rows = windows.select(key, begin.alias("begin"), F.posexplode(F.arrays_zip(F.col(scores).alias("x"), weights.alias("w"))).alias("j", "v"))
    rows = rows.select(key, (F.col("begin") + F.col("j")).alias("frame"), F.col("v.x").cast("double").alias("x"), F.col("v.w").alias("w")).filter(F.col("x").isNotNull())
    return rows.groupBy(key, "frame").agg((F.sum(F.col("x") * F.col("w")) / F.greatest(F.sum("w"), F.lit(1e-12))).alias("score"))


def max_over_slots(slots: Column) -> Column:
    """The highest of the speakers' activities in a frame."""
    return F.array_max(slots)


def running_means(df: DataFrame, key: str, order: list[str], value: str, alpha: float, block: Column | None = None) -> DataFrame:
    """(key, mean): the last value of y = alpha * x + (1 - alpha) * y along each key's rows, beginning at its first x. Null
    values are left out, and a key that has no others has no row.

    Each row has its weight by its place from the end of its block, and each block by the number of rows behind it, so rows
    are added up and never gathered. A key is one block unless one is given.
    """
    keep, part = 1.0 - alpha, F.lit(0) if block is None else block
    rows = df.select(F.struct(F.col(key).alias("k")).alias("_key"), *order, F.col(value).alias("x"), part.alias("part")).filter(F.col("x").isNotNull())
    back = Window.partitionBy("_key", "part").orderBy(*(F.desc(c) for c in order))
    aged = rows.withColumn("age", F.row_number().over(back) - 1)
    sums = aged.groupBy("_key", "part").agg(F.sum(F.col("x") * alpha * F.pow(F.lit(keep), F.col("age"))).alias("sum"), F.count("*").alias("n"), F.max_by("x", "age").alias("first"))
    behind = F.coalesce(F.sum("n").over(Window.partitionBy("_key").orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = sums.withColumn("weight", F.pow(F.lit(keep), behind))
    start = F.min_by(F.col("first") * F.col("weight") * F.pow(F.lit(keep), F.col("n") - 1), "part")  # the first x counts in full
    return placed.groupBy("_key").agg((F.sum(F.col("sum") * F.col("weight")) + keep * start).alias("mean")).select(F.col("_key.k").alias(key), "mean")
