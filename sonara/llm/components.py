"""Connected components by alternating large-star and small-star steps, all in joins and partial aggregates.

A large-star step links each node's larger neighbours to the smallest node of its neighbourhood; a small-star step does so
with its smaller ones. Both keep the components, and their alternation leaves stars around each component's smallest node
after O(log^2 n) rounds. A node with very many neighbours is one row on the aggregated side of a join whose other side may
be split, so no task gathers its neighbours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonara.llm.common import remove, written


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """One step over edges (a, b) with a > b; the result has that form too."""
    if larger:
        ways = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        ways = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    least = ways.groupBy("u").agg(F.min("v").alias("least")).withColumn("least", F.least("u", "least"))
    joined = ways.join(least, "u")
    if larger:
        out = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("least").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("least").alias("b")).union(least.select(F.col("u").alias("a"), F.col("least").alias("b")))
    return out.filter(F.col("a") > F.col("b")).distinct()


def _sums(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.hash("a", "b").cast("bigint")), F.sum(F.xxhash64("a", "b") % 1_000_003)).first())


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of every node of the edges: component is the smallest node that it can reach.

    Edges in either direction, repeated ones and loops are fine; those with a null end are left out. No edges give no rows.
    Each round is a table of the shared folder, so a lost executor costs a stage and not the rounds before.
    """
    spark = edges.sparkSession
    ends = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).filter(F.col("x").isNotNull() & F.col("y").isNotNull())
    kept = ends.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()
    now, at = written(kept, "edges")
    loops = now.filter(F.col("a") == F.col("b")).select(F.col("a").alias("node"), F.col("a").alias("component"))
    first = at
    links, state = now.filter(F.col("a") > F.col("b")), None
    if links.isEmpty():
        return loops
    while True:
        following, path = written(_star(_star(links, larger=True), larger=False), "stars")
        sums = _sums(following)
        if at != first:
            remove(spark, at)
        links, at = following, path
        if sums == state:
            break
        state = sums
    stars = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.union(stars.select(F.col("component").alias("node"), "component")).union(loops).groupBy("node").agg(F.min("component").alias("component"))
