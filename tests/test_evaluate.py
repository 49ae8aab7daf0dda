"""Error rates by column functions against the ones by dynamic programming."""

import random
import time

import pytest
from pyspark.sql import functions as F

from sonara.operators import evaluate


def test_plain_error_rates_equal_those_by_dynamic_programming(spark):
    rng = random.Random(11)
    word = lambda: rng.choice(["a", "b", "don't", "Élan", "x_1", "日本", "é", "to-day", "zz"])
    texts = ["", None, " ", "!?", "A b", *(" ".join(word() for _ in range(rng.randrange(1, 40))) for _ in range(60))]
    pairs = spark.createDataFrame([(k, rng.choice(texts), rng.choice(texts), "y") for k in range(150)], "id int, r string, h string, wer_x string")
    key = lambda r: r.id
    got, want = (sorted(f(pairs, "r", "h").collect(), key=key) for f in (evaluate.plain_error_rates, evaluate.error_rates))
    assert [r.asDict() for r in got] == [r.asDict() for r in want]


def test_error_rates_need_no_python(spark):
    pairs = spark.createDataFrame([("a b", "a c")], "r string, h string")
    plan = evaluate.plain_error_rates(pairs, "r", "h")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("size", [3, 60_000])
def test_each_word_has_a_character_of_its_own(spark, size):
    words = F.transform(F.sequence(F.lit(1), F.lit(size)), lambda k: F.concat(F.lit("w"), k.cast("string")))
    some = F.transform(F.array(*(F.lit(k) for k in (1, 2, size - 1, size))), lambda k: F.concat(F.lit("w"), k.cast("string")))
    coded = spark.range(1).select(evaluate.coded_words(some, words).alias("c"), F.length(evaluate.coded_words(some, words)).alias("n")).first()
    assert coded.n == 4 and len(set(coded.c)) == 4 - (size == 3)
    assert ord(coded.c[-1]) == (0xFF + size + (0x800 if 0xFF + size >= 0xD800 else 0))


def test_edit_distance_is_that_of_the_table_of_distances():
    rng = random.Random(4)
    for _ in range(1500):
        n = rng.choice([1, 2, 4, 30])
        a, b = ([rng.randrange(n) for _ in range(rng.choice([0, 1, 2, 7, 63, 64, 65, 90]))] for _ in range(2))
        b = a[: rng.randrange(len(a) + 1)] + [9] + a[rng.randrange(len(a) + 1) :] if rng.random() < 0.4 else b
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            after = [i]
            for j, y in enumerate(b, 1):
                after.append(min(row[j] + 1, after[-1] + 1, row[j - 1] + (x != y)))
            row = after
        assert evaluate.edit_distance(a, b) == row[-1]


def test_distance_of_long_texts_takes_no_row_of_numbers_each():
    rng = random.Random(5)
    a, b = ([rng.choice("etaoins hr") for _ in range(20_000)] for _ in range(2))
    began = time.process_time()
    assert 0 < evaluate.edit_distance(a, b) < 20_000
    assert time.process_time() - began < 4
