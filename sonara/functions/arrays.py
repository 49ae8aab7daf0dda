"""Array expressions over samples and tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pad_or_trim(x: Column, n: int) -> Column:
    """x cut to n elements, or followed by zeros up to n."""
    return F.slice(F.concat(x, F.array_repeat(F.lit(0).cast("float"), n)), 1, n)


def clamp_range(start: Column, end: Column, n: Column) -> tuple[Column, Column]:
    """Both ends no later than n; a negative start stays."""
    return F.least(start, n), F.least(end, n)


def cut(x: Column, start: Column, end: Column) -> Column:
    """x[start:end] by zero-based positions; nothing where end is not behind start."""
    length = F.greatest(F.least(end, F.size(x).cast("bigint")) - start, F.lit(0))
    return F.slice(x, (start + 1).cast("int"), length.cast("int"))


def collect_regions(x: Column, regions: Column) -> Column:
    """The samples of all regions one after another."""
    return F.flatten(F.transform(regions, lambda r: cut(x, r["start"], r["end"])))


def tail(x: Column, n: int) -> Column:
    return F.slice(x, F.greatest(F.size(x) - n + 1, F.lit(1)), n)


def head(x: Column, n: int) -> Column:
    return F.slice(x, 1, n)


def running_mean(scores: Column, alpha: float) -> Column:
    """y = alpha * x + (1 - alpha) * y over an array, beginning at its first element; the last value."""
    if alpha <= 0:
        return F.element_at(scores, -1).cast("double")
    first = F.element_at(scores, 1).cast("double")
    return F.aggregate(F.slice(scores, 2, F.size(scores)), first, lambda y, x: F.lit(alpha) * x + F.lit(1 - alpha) * y)


def text_tokens(tokens: Column, eot: int) -> Column:
    """Ids of text: all below the end-of-text id."""
    return F.filter(tokens, lambda t: t < eot)


def replace_language(prompt: Column, old: Column, new: Column) -> Column:
    """The prompt with its first language token replaced."""
    at = F.array_position(prompt, old)
    return F.transform(prompt, lambda t, i: F.when(i + 1 == at, new).otherwise(t))
