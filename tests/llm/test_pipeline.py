import corpus_pipeline
import pytest

from sonara.deploy import ship
from sonara.llm import bpe, quality
from sonara.llm.queries import ORACLE_SQL, QUERIES


def test_stages_on_the_small_tables(spark, sf):
    ship(spark)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, docs
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, sf)
        assert out.columns == columns, name
        path = f"{spark.conf.get('spark.checkpoint.dir')}/test-{len(counts)}"
        out.write.parquet(path)
        kept = spark.read.parquet(path)
        counts.append(kept.count())
    assert counts[1] <= counts[0] and counts[2] <= counts[1] and counts[3] <= counts[2]
    texts = [r.text for r in kept.collect()]
    assert all(quality.cascade(quality.Document(t), list(quality.RULES)) for t in texts)
    last = corpus_pipeline.STAGES[-1][1](spark, kept, sf)
    encoder = bpe.Encoder(bpe.read_tokenizer(__import__("public_tokenizers").path("byte_bpe_50k.json")))
    assert sorted(bytes(r.ids) for r in last.collect()) == sorted(encoder.encode(texts))


def by_hand(spark, docs, sf, name):
    """The stages one after another, each result written and read again."""
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"{spark.conf.get('spark.checkpoint.dir')}/{name}-{n}"
        stage(spark, docs, sf).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


def test_run_equals_the_stages_by_hand(spark, sf):
    ship(spark)
    found = corpus_pipeline.run(spark, sf)
    assert found.columns == ["doc_id", "ids", "n_tokens"]
    want = by_hand(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf, "hand")
    rows = lambda df: sorted((r.doc_id, bytes(r.ids), r.n_tokens) for r in df.collect())
    assert rows(found) == rows(want) and rows(want)


def test_stages_take_odd_and_empty_tables(spark, sf, odd, odd_rows, empty):
    encoder = bpe.Encoder(bpe.read_tokenizer(__import__("public_tokenizers").path("byte_bpe_50k.json")))
    known = {(r[0], encoder.encode([r[1] or ""])[0]) for r in odd_rows}
    last = by_hand(spark, odd, sf, "odd").collect()
    assert last and {(r.doc_id, bytes(r.ids)) for r in last} <= known
    assert all(4 * r.n_tokens == len(r.ids) for r in last)
    assert not {r.doc_id for r in last} & {2, 3, 5}  # texts without words are rejected
    assert by_hand(spark, empty, sf, "none").count() == 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_have_a_row_for_each_input(spark, sf, name):
    ship(spark)
    source = {"op5": "pages", "op8": "pages", "op10": "conversations", "op12": "embeddings"}.get(name.split("_")[0], "documents")
    rows = spark.read.parquet(f"{sf}/{source}.parquet")
    want = rows.select("conv_id").distinct().count() + 1 if source == "conversations" else rows.count() * (32 if source == "embeddings" else 1)
    assert QUERIES[name](spark, sf).count() == want


def test_sql_names_are_queries():
    assert set(ORACLE_SQL) <= set(QUERIES)
