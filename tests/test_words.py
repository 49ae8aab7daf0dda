"""Marks joined to words over tables, against the loop over a list."""

import random

import pytest
from pyspark.sql import functions as F

from sonara.operators import scan, words

OPEN, CLOSE = "\"'“¿([{-", "\"'.。,，!！?？:：”)]}、"
PIECES = [" a", "b", " (", " \"", "\"", ".", ",", ")", "", " ", " x ", " -", "(", "\t(", " ( ", "'", " '"]


@pytest.mark.parametrize("rows", [None, 1, 4, 1000])
def test_marks_join_as_in_the_loop(spark, rows):
    rng = random.Random(9)
    said = {k: [rng.choice(PIECES) for _ in range(rng.choice([1, 2, 3, 9, 25]))] for k in [None, *range(120)]}
    said |= {500: [" ("] * 6, 501: ["."] * 6, 502: [" (", "."], 503: [" ", "."], 504: ["", ".", "."]}
    data = [(k, i, w or None, list(range(10 * i, 10 * i + len(w))) or None, "x") for k, ws in said.items() for i, w in enumerate(ws)]
    df = spark.createDataFrame(data, "k int, i int, word string, tokens array<int>, start string").repartition(5)
    block = None if rows is None else scan.places(F.col("i"), rows)
    found = {(r.k, r.i): (r.word, r.tokens, r.start) for r in words.merge_marks(df, "k", "i", OPEN, CLOSE, block).collect()}
    want = {}
    for k, ws in said.items():
        loop = [words.Aligned(w, list(range(10 * i, 10 * i + len(w))), 0.0, 0.0) for i, w in enumerate(ws)]
        words.merge_punctuation(loop, OPEN, CLOSE)
        want |= {(k, i): (w.word, w.tokens, "x") for i, w in enumerate(loop)}
    assert found == want


def test_no_words(spark):
    df = spark.createDataFrame([], "k int, i int, word string, tokens array<int>")
    assert words.merge_marks(df, "k", "i", OPEN, CLOSE).columns == df.columns and words.merge_marks(df, "k", "i", OPEN, CLOSE).count() == 0


def test_merge_marks_equals_its_sql(spark, sf):
    duckdb = pytest.importorskip("duckdb")
    from sonara.catalogue import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    want = sorted(con.sql(ORACLE_SQL["merge_marks"]).fetchall())
    found = QUERIES["merge_marks"](spark, sf)
    assert want and sorted(map(tuple, found.collect())) == want
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
