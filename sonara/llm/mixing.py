"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

A source's target is its share of the budget by weight, at most `most` times its size; what it can't use goes to the
others by weight. Each source's documents are shuffled by a hash and served one after another, pass after pass. A
document's virtual finish time is what its source has served by then divided by the source's target. The documents of all
sources are range-sorted by it into one queue, words are summed up along the queue, and the queue is cut where the sum
reaches the budget. A document on which its source's target falls stands in the queue in two parts, before and behind the
target, so at the cut each source has served its target and not a document more or less.

No sum goes through one task: a source's rows are dealt to BUCKETS ranges of the hash, summed inside each, and the ranges'
own sums (BUCKETS rows a source) give where each range begins. The queue is summed by its sorted ranges in the same way; only
the range in which the budget runs out is summed row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from sonara.llm.common import WORD, text_of, written

WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
#: Hexadecimal digits of the hash that name a bucket: 4096 buckets a source.
DIGITS = 3
SEED = "mix"
#: The order of the queue. What lies behind a source's target comes last among equal times; the rest only parts ties.
ORDER = ("finish", "behind", "s", "key", "pass")


def shuffle_key(id_col: str, text_col: str) -> Column:
    """A fixed random order, by id and text: the same in every run and on every engine that has MD5."""
    return F.md5(F.concat(F.lit(SEED + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit(":"), F.md5(text_of(text_col).cast("binary"))))


def words_in(text_col: str) -> Column:
    return F.regexp_count(text_of(text_col), F.lit(WORD)).cast("bigint")


def source_targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, target) of (source, source_size); one row a source, so the windows over all are small.

    Sources weigh `weights` in turn by code point, null last. In ascending order of limit over weight a source is held at
    its limit if what is left of the budget would give it that much or more; the others divide what then is left.
    """
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    named = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(named) - 1) % len(weights) + 1).cast("double")
    rows = totals.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * most).cast("double").alias("limit"))
    by_level = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").isNull(), "source")
    rows = rows.select(
        "*",
        (F.sum("source_size").over(everything) * share).alias("budget"),
        (F.sum("limit").over(by_level.rowsBetween(Window.unboundedPreceding, 0)) - F.col("limit")).alias("before"),
        F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing)).alias("after"),
    )
    held = F.col("limit") * F.col("after") <= (F.col("budget") - F.col("before")) * F.col("weight")
    rows = rows.withColumn("level", F.when(~held, (F.col("budget") - F.col("before")) / F.col("after")))
    open_level = F.max("level").over(everything)  # of the first source that isn't held; later ones compute less
    return rows.select("source", "source_size", F.when(F.col("level").isNull(), F.col("limit")).otherwise(F.col("weight") * open_level).alias("target"))


def _rows(df: DataFrame, id_col: str, text_col: str, source_col: str, keep_row: bool = False) -> DataFrame:
    """(doc_id, source, s, size, key, bucket[, row]); s is the source with null told apart, so that joins need no null-safety."""
    source = df[source_col].cast("string")
    rows = df.select(
        df[id_col].cast("bigint").alias("doc_id"),
        source.alias("source"),
        F.coalesce(F.concat(F.lit("="), source), F.lit("null")).alias("s"),
        words_in(text_col).alias("size"),
        shuffle_key(id_col, text_col).alias("key"),
        *([F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row")] if keep_row else []),
    )
    return rows.withColumn("bucket", F.substring("key", 1, DIGITS))


def _begins(rows: DataFrame, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    """(s, bucket, begin, source_size, target): what a source serves before each of its buckets; 4096 rows a source at most."""
    sums = rows.groupBy("source", "s", "bucket").agg(F.sum("size").alias("bucket_size"))
    inside = Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    begins = sums.select("s", "bucket", F.coalesce(F.sum("bucket_size").over(inside), F.lit(0)).alias("begin"))
    targets = source_targets(sums.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, share, most)
    named = targets.select(F.coalesce(F.concat(F.lit("="), "source"), F.lit("null")).alias("s"), "source_size", "target")
    return written(begins.join(named, "s"), "begins")[0]


def _with_copies(rows: DataFrame, begins: DataFrame, most: int) -> DataFrame:
    """rows with source_size, target and copies: for each pass the document, in two parts if the target falls on it, with
    virtual finish time and words. A document without words has a part in the first pass."""
    order = Window.partitionBy("s", "bucket").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("upto", F.sum("size").over(order)).join(begins, ["s", "bucket"]).withColumn("upto", F.col("upto") + F.col("begin"))

    def part(k: int, behind: bool) -> Column:
        before = F.col("source_size") * k + F.col("upto") - F.col("size")
        first = F.greatest(F.lit(0), F.least(F.col("size"), F.floor("target") - before))
        finish = F.when(F.col("target") > 0, (before + (F.col("size") if behind else first)) / F.col("target")).otherwise(F.lit(0.0))
        words = (F.col("size") - first if behind else first).cast("bigint")
        return F.struct(finish.alias("finish"), F.lit(behind).alias("behind"), F.col("s"), F.col("key"), F.lit(k).alias("pass"), words.alias("words"))

    parts = F.array(*(part(k, behind) for k in range(most) for behind in (False, True)))
    copies = F.filter(parts, lambda c: (c["words"] > 0) | ((F.col("size") == 0) & (c["pass"] == 0) & ~c["behind"] & (c["finish"] <= 1)))
    return rows.withColumn("copies", copies).drop("upto", "begin")


def range_sorted(copied: DataFrame) -> DataFrame:
    """The queue: a row for each part, dealt to tasks by ranges of ORDER and sorted there."""
    queue = copied.select(F.explode("copies").alias("c")).select("c.*")
    return queue.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)


def queue_cut(copied: DataFrame, begins: DataFrame) -> Row | None:
    """The row of the queue on which the budget (the sum of the targets in whole words) runs out, with `kept`, the words that
    it still gets; None if there is nothing to serve. One row comes to the driver."""
    budget = begins.select("s", "target").distinct().agg(F.sum(F.floor("target"))).first()[0] or 0
    if not budget:
        return None
    queue, _ = written(range_sorted(copied).withColumn("range", F.spark_partition_id()), "queue")
    totals = queue.groupBy("range").agg(F.sum("words").alias("total"))
    upto = F.sum("total").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, 0))  # a row for each range
    last = totals.withColumn("upto", upto).filter((F.col("upto") >= budget) & (F.col("upto") - F.col("total") < budget))
    rows = queue.join(last.select("range", (F.col("upto") - F.col("total")).alias("before")), "range")
    served = F.col("before") + F.sum("words").over(Window.partitionBy("range").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("served", served).filter(F.col("served") >= budget)
    return rows.select(*ORDER, (F.col("words") - F.col("served") + budget).alias("kept")).orderBy("served", *ORDER).first()


def _kept(cut: Row | None) -> Column:
    """The copies up to the cut, the one on it with the words that it still gets."""
    if cut is None:
        return F.filter("copies", lambda c: ~c["behind"])
    place = lambda c: F.struct(*(c[k].alias(k) for k in ORDER))
    kinds = {"finish": "double", "behind": "boolean", "s": "string", "key": "string", "pass": "int"}
    at = F.struct(*(F.lit(cut[k]).cast(kinds[k]).alias(k) for k in ORDER))
    within = F.filter("copies", lambda c: place(c) <= at)
    return F.transform(within, lambda c: c.withField("words", F.when(place(c) == at, F.lit(cut["kept"]).cast("bigint")).otherwise(c["words"])))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies) of each row of df.

    taken is the sum of the words of copies, the document's parts of the queue up to its cut. A null text has size 0 and is
    taken with no words, null is a source of its own, repeated rows are documents of their own, which stand one behind
    another in the shuffle. No rows give no rows. Texts are read once.
    """
    rows, _ = written(_rows(df, id_col, text_col, source_col), "sizes")
    begins = _begins(rows, weights, share, most)
    copied = _with_copies(rows, begins, most)
    kept = copied.withColumn("copies", _kept(queue_cut(copied, begins)))
    taken = F.aggregate("copies", F.lit(0).cast("bigint"), lambda n, c: n + c["words"])
    return kept.select("doc_id", "size", "source_size", "target", taken.alias("taken"), "copies")


def fair_queue(mixed: DataFrame) -> DataFrame:
    """The parts that mix() keeps in the order in which they are served, one row for each, sorted over all tasks."""
    rest = [c for c in mixed.columns if c != "copies"]
    return mixed.select(*rest, F.explode("copies").alias("c")).select(*rest, "c.*").orderBy(*ORDER)


def mixed_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """df's rows as often as the mix takes them, in the queue's order: texts stay whole, so a document is there once for each
    pass in which the mix takes half its words or more. Nulls, ties, repeated rows and empty tables are as in mix()."""
    light, _ = written(_rows(df, id_col, text_col, source_col), "sizes")
    begins = _begins(light, WEIGHTS, SHARE, MOST)
    cut = queue_cut(_with_copies(light, begins, MOST), begins)
    whole = _with_copies(_rows(df, id_col, text_col, source_col, keep_row=True), begins, MOST)
    copies = whole.select("row", "size", F.explode(_kept(cut)).alias("c")).filter(~F.col("c.behind") & (F.col("c.words") * 2 >= F.col("size")))
    return copies.select("row", "c.*").orderBy(*ORDER).select(*(F.col(f"row.`{c}`").alias(c) for c in df.columns))
