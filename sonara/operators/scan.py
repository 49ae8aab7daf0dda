"""Running values along a key's rows, by blocks, so that one key is many tasks.

A window over a whole key is one task. A value that runs along the rows (a sum, the last value that is not null, a
neighbour) is a monoid: rows of a block are summed up apart, the blocks' sums run along the key, and each block begins with
what the blocks before it carry over. The rows move once, dealt by (key, block), and are sorted inside their block. The
blocks' sums are a row for each block; they are what one task sees of a key.

A block is a column that does not fall along a key's order: `places` for positions, `even_blocks` for anything else.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Rows of a block that a task sorts and scans.
ROWS = 1_000_000
#: Blocks that a key may have, by even_blocks.
MOST_BLOCKS = 4096
_FIRST, _LAST = Window.unboundedPreceding, Window.unboundedFollowing


@dataclass(frozen=True)
class Step:
    """total: a block's sum, given the order; local: the value inside a block; carried: that of the blocks before, from their
    sums; joined: both in one."""

    total: Callable[[Column], Column]
    local: Callable[[WindowSpec], Column]
    carried: Callable[[Column, WindowSpec], Column]
    joined: Callable[[Column, Column], Column]


def running_sum(x: Column) -> Step:
    """The sum up to and with a row; nulls add nothing."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    return Step(lambda order: F.sum(x), lambda w: F.sum(x).over(w.rowsBetween(_FIRST, 0)), lambda t, w: F.sum(t).over(w.rowsBetween(_FIRST, -1)), lambda carry, here: zero(carry) + zero(here))


def last_value(x: Column, before: bool = False) -> Step:
    """The last value that is not null up to a row, or before it."""
    return Step(lambda order: F.max_by(x, F.when(x.isNotNull(), order)), lambda w: F.last(x, ignorenulls=True).over(w.rowsBetween(_FIRST, -1 if before else 0)), lambda t, w: F.last(t, ignorenulls=True).over(w.rowsBetween(_FIRST, -1)), lambda carry, here: F.coalesce(here, carry))


def next_value(x: Column) -> Step:
    """The first value that is not null from a row on."""
    return Step(lambda order: F.min_by(x, F.when(x.isNotNull(), order)), lambda w: F.first(x, ignorenulls=True).over(w.rowsBetween(0, _LAST)), lambda t, w: F.first(t, ignorenulls=True).over(w.rowsBetween(1, _LAST)), lambda carry, here: F.coalesce(here, carry))


def highest_ahead(x: Column) -> Step:
    """The highest value from a row on."""
    return Step(lambda order: F.max(x), lambda w: F.max(x).over(w.rowsBetween(0, _LAST)), lambda t, w: F.max(t).over(w.rowsBetween(1, _LAST)), lambda carry, here: F.coalesce(F.greatest(carry, here), here, carry))


def previous(x: Column) -> Step:
    """The row's before, null included; null for a key's first row."""
    held = F.struct(x.alias("x"))
    return Step(lambda order: F.max_by(held, order), lambda w: F.lag(held).over(w), lambda t, w: F.lag(t).over(w), lambda carry, here: F.coalesce(here, carry)["x"])


def following(x: Column) -> Step:
    """The row's after, null included; null for a key's last row."""
    held = F.struct(x.alias("x"))
    return Step(lambda order: F.min_by(held, order), lambda w: F.lead(held).over(w), lambda t, w: F.lead(t).over(w), lambda carry, here: F.coalesce(here, carry)["x"])


def places(place: Column, rows: int = ROWS) -> Column:
    """Blocks of so many places each, for positions that lie close."""
    return F.floor(place / F.lit(rows)).cast("bigint")


def scanned(df: DataFrame, key: str, order: list[str], block: Column | None, **steps: Step) -> DataFrame:
    """df with a column for each step, along each key's rows in order; ties are for the caller's order to break. Null keys
    are a key; nulls in the order come first. Without a block a key is one task, which is right for many small keys."""
    if block is None:
        w = Window.partitionBy(key).orderBy(*order)
        nothing = F.lit(None)
        return df.select("*", *(s.joined(nothing, s.local(w)).alias(n) for n, s in steps.items()))
    held = dealt(df, key, block)
    w = Window.partitionBy("_key", "_block").orderBy(*order)
    along = Window.partitionBy("_key").orderBy("_block")
    rank = F.struct(*order)
    here = held.select("*", *(s.local(w).alias(f"_here_{n}") for n, s in steps.items()))
    sums = held.groupBy("_key", "_block").agg(*(s.total(rank).alias(f"_sum_{n}") for n, s in steps.items()), read(df)).filter(F.col("_read").isNotNull())
    carried = sums.select("_key", "_block", *(s.carried(F.col(f"_sum_{n}"), along).alias(f"_carry_{n}") for n, s in steps.items()))
    both = here.join(carried, ["_key", "_block"])
    return both.select(*(F.col(f"`{c}`") for c in df.columns), *(s.joined(F.col(f"_carry_{n}"), F.col(f"_here_{n}")).alias(n) for n, s in steps.items()))


def dealt(df: DataFrame, key: str, block: Column) -> DataFrame:
    """df with _key and _block, dealt out by both. Sums and rows read this one exchange, so what df takes is done once."""
    held = df.withColumns({"_key": F.struct(F.col(key).alias("k")), "_block": F.coalesce(block, F.lit(-1))})  # in a struct null equals null
    return held.repartition("_key", "_block")


def read(df: DataFrame) -> Column:
    """An aggregate that needs all of df's columns: were they pruned where blocks are summed up, that would be an exchange of its
    own, and what df takes would be done twice."""
    return F.max(F.hash(*(F.col(f"`{n}`") for n, kind in df.dtypes if "map<" not in kind))).alias("_read")


def runs(df: DataFrame, key: str, at: str, gap: Column, block: Column | None, heard: Column | None = None, name: str = "run") -> DataFrame:
    """df with `name`: the `at` of the first row of a row's run, and `silent`: how far behind the heard row before it a row lies.

    A run begins at a heard row that lies `gap` or more behind the heard row before it; rows that aren't heard belong to the
    run that goes on, to none (null) if there was none. A key's first heard row begins a run and has a null `silent`. All
    rows are heard unless `heard` says otherwise. Rows with null `at` are heard by none.

    One scan: inside a block all is known but what lies before its first heard row, and that is settled between the blocks.
    """
    far = lambda here, before: F.coalesce(here - before >= gap, F.lit(True))
    place = F.col(at) if heard is None else F.when(heard, F.col(at))
    alone = block is None
    held = df.withColumn("_key", F.struct(F.col(key).alias("k"))).withColumn("_block", F.lit(0)) if alone else dealt(df, key, block)
    w = Window.partitionBy("_key", "_block").orderBy(at)
    ahead = w.rowsBetween(_FIRST, -1)
    rows = held.withColumn("_place", place)
    rows = rows.select("*", F.last("_place", ignorenulls=True).over(ahead).alias("_before"), F.first("_place", ignorenulls=True).over(w.rowsBetween(_FIRST, 0)).alias("_opening"))
    fresh = F.when(F.col("_before").isNotNull() & far(F.col("_place"), F.col("_before")), F.col("_place"))
    rows = rows.withColumn("_fresh", F.when(F.col("_place").isNotNull(), fresh))
    rows = rows.withColumn("_run", F.last("_fresh", ignorenulls=True).over(w.rowsBetween(_FIRST, 0)))
    if alone:
        return rows.select(*(F.col(f"`{c}`") for c in df.columns), F.coalesce("_run", "_opening").alias(name), (F.col(at) - F.col("_before")).alias("silent"))
    along = Window.partitionBy("_key").orderBy("_block").rowsBetween(_FIRST, -1)
    sums = rows.groupBy("_key", "_block").agg(F.min("_place").alias("_first"), F.max("_place").alias("_last"), F.max("_run").alias("_latest"), read(df)).filter(F.col("_read").isNotNull())
    known = sums.withColumn("_heard", F.last("_last", ignorenulls=True).over(along))
    known = known.withColumn("_own", F.when(F.col("_first").isNotNull() & far(F.col("_first"), F.col("_heard")), F.col("_first")))
    known = known.withColumn("_going", F.last(F.coalesce("_latest", "_own"), ignorenulls=True).over(along)).select("_key", "_block", "_heard", "_own", "_going")
    both = rows.join(known, ["_key", "_block"])
    run = F.coalesce("_run", F.when(F.col("_opening").isNotNull(), F.col("_own")), "_going")
    return both.select(*(F.col(f"`{c}`") for c in df.columns), run.alias(name), (F.col(at) - F.coalesce("_before", "_heard")).alias("silent"))


def even_blocks(df: DataFrame, key: str, at: str, rows: int = ROWS, name: str = "block") -> DataFrame:
    """df with a block by `at` (a number or a time), of about so many rows for keys that have more, else 0.

    Bounds are approximate quantiles of the large keys, partial sketches of which are made before rows move; there are
    fewer such keys than rows / ROWS, and Spark broadcasts their bounds if they are small and splits hot keys otherwise.
    Rows with equal `at` share a block, so blocks never part ties. Null keys and null times are in block 0.
    """
    value = F.unix_micros(at) if dict(df.dtypes)[at].startswith("timestamp") else F.col(at)
    sizes = df.groupBy(key).agg(F.count("*").alias("n")).filter((F.col("n") > rows) & F.col(key).isNotNull())
    largest = sizes.agg(F.max("n")).first()[0]
    if largest is None:
        return df.withColumn(name, F.lit(0).cast("bigint"))
    parts = 1 << min(MOST_BLOCKS, -(-largest // rows)).bit_length()
    large = df.select(F.col(key).alias("_key"), value.alias("_at")).join(sizes.select(F.col(key).alias("_key")), "_key", "left_semi")
    cuts = F.percentile_approx("_at", [k / parts for k in range(1, parts)], 8 * parts)
    bounds = large.groupBy("_key").agg(cuts.alias("_cuts"))
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(parts.bit_length() - 1))))
    found = F.aggregate(steps, F.lit(0), lambda i, s: i + F.when(F.get("_cuts", i + s - 1) < value, s).otherwise(0))  # cuts below the value, by halving
    joined = df.join(bounds, df[key] == bounds["_key"], "left").withColumn(name, F.coalesce(F.when(F.col("_cuts").isNotNull(), found), F.lit(0)).cast("bigint"))
    return joined.drop("_key", "_cuts")
