import pytest

#: Columns that clash with names that operators use inside.
EXTRA = "id string, size string, h string, row string, key string, text2 string, fingerprint string, kind string, bucket string, part string"
DOCS = f"doc_id bigint, text string, lang string, source string, n_chars bigint, {EXTRA}"


def doc(doc_id, text, source="a"):
    return (doc_id, text, "en", source, None if text is None else len(text), *["x"] * 10)


LONG = "the quick brown fox jumps over the lazy dog and runs away from here. " * 3000
PLAIN = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen."


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in any column, empty and very long texts, ties, repeated rows."""
    return [
        doc(1, PLAIN),
        doc(1, PLAIN),
        doc(2, None),
        doc(3, ""),
        doc(4, LONG, None),
        doc(5, "   \n\t \n"),
        doc(None, "an id that is null, with some words that make a text of its own kind", None),
        doc(6, "é ß 日本語 👍 İstanbul\u0000 <|endoftext|> x  y\r\n\r\nz", "b"),
        doc(7, PLAIN, "b"),
        doc(7, "another text of an id that came before, so the two tie in the order of ids", "b"),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def tokenizer_json():
    from sonara.llm.queries import tokenizer_json

    return tokenizer_json()
