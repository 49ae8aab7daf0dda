"""The phrase filter over tables: neighbours, nulls, long recordings, and its SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from sonara.catalogue import ORACLE_SQL, QUERIES
from sonara.operators import phrases

ROWS = f"rec_id bigint, id int, start_ns bigint, end_ns bigint, text string, words array<{phrases.WORD}>, language string"
LIST = {"en": ["thank you", "thanks for watching", "thank you for watching", "bye", "♪"], "de": ["Vielen Dank"]}


def texts(spark, *rows):
    df = spark.createDataFrame([(1, k, 0, 9, text, None, lang) for k, (text, lang) in enumerate(rows)], ROWS)
    return [(r.text, r.dropped) for r in phrases.clean_phrases(df, LIST).orderBy("id").collect()]


@pytest.mark.parametrize(
    ("said", "left"),
    [
        ("thank you for watching , we start", "we start"),  # a mark that is a unit goes with the unit before
        ("so thank-you all", "so thank-you all"),  # inside one unit, and nothing sets it apart
        ("It rained. Thank-you! We left", "It rained. We left"),
        ("now ... thank you ... We left", "now ... We left"),  # a sentence's end may be a unit of its own
        ("now - thank you - we left", "now - thank you - we left"),
        ("we Thank you - Peter", "we Peter"),
        ("we say thank you, thank you, thank you and go", "we say and go"),
        ("thanks for watching bye", None),
        ("- bye -", None),
        ("one bye two bye", "one bye two bye"),
    ],
)
def test_neighbours(spark, said, left):
    text, dropped = texts(spark, (said, "en"))[0]
    assert dropped == (left is None) and (dropped or text == left)


def test_nulls_empties_and_other_languages(spark):
    found = texts(spark, (None, "en"), ("", "en"), ("  ♪ ", "en"), ("♪", "de"), ("thank you", None), ("thank you", "xx"), ("VIELEN  DANK!", "de"), ("a  b", "en"))
    assert found == [(None, False), ("", False), ("  ♪ ", True), ("♪", False), ("thank you", False), ("thank you", False), ("", True), ("a  b", False)]  # of a row that goes, what is left
    assert texts(spark, ("x thanks for watching " * 20_000, "en"))[0] == (" ".join(["x"] * 20_000), False)
    assert phrases.filter_phrases(spark.createDataFrame([], ROWS), LIST).count() == 0


def test_words_that_are_null_are_empty_and_extra_columns_stay(spark):
    ws = [(0, 1, None, 1.0), (1, 2, "Thank", 1.0), (2, 3, "you.", 1.0), (3, 4, "Rain", 1.0)]
    r = phrases.clean_phrases(spark.createDataFrame([(1, 1, 0, 4, "x", ws, "en")], ROWS).withColumn("pattern", F.lit(7)), LIST).first()
    assert (r.text, [w.word for w in r.words], r.start_ns, r.end_ns, r.pattern) == (" Rain", [None, "Rain"], 0, 4, 7)


def test_one_long_recording_is_many_tasks(spark):
    said = F.when(F.col("id") % 3 == 0, "Thank you.").otherwise(F.concat(F.lit("row "), F.col("id").cast("string")))
    df = spark.range(300).select(F.lit(1).cast("bigint").alias("rec_id"), "id", F.col("id").alias("start_ns"), F.col("id").alias("end_ns"), said.alias("text"), F.lit(None).cast(f"array<{phrases.WORD}>").alias("words"), F.lit("en").alias("language"))
    whole, parts = (sorted((r.id, r.text) for r in phrases.filter_phrases(df, LIST, block=b).collect()) for b in (None, F.floor(F.col("id") / 20)))
    assert whole == parts == [(k + 1, f"row {n}") for k, n in enumerate(n for n in range(300) if n % 3)]


def test_a_list_has_a_bound(spark, monkeypatch):
    monkeypatch.setattr(phrases, "LIST_MOST", 2)
    with pytest.raises(ValueError):
        phrases.patterns(spark, LIST)


def test_query_equals_its_sql_without_python(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    found = QUERIES["phrase_filter"](spark, sf)
    assert not any(n in found._jdf.queryExecution().executedPlan().toString() for n in ("Python", "InPandas", "Arrow"))
    assert sorted(map(tuple, found.collect())) == sorted(con.execute(ORACLE_SQL["phrase_filter"]).fetchall())
