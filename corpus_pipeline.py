"""A training corpus in five stages: quality rules, toxicity, SimHash near-dedup, source mixing, BPE.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept; its result is written as Parquet in
the shared folder and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sonara.llm import bpe, mixing, quality, simhash, toxicity
from sonara.llm.common import new_path, prepare, remove, table
from sonara.llm.queries import tokenizer_json


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    prepare(spark)
    return quality.quality_filter(docs)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not called toxic, by a model of the labelled documents that are left."""
    prepare(spark)
    return toxicity.toxicity_filter(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity of 0.8 or more."""
    prepare(spark)
    return simhash.keep_one(docs, width=5, similarity=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in the order in which it serves them."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's ids and their number."""
    prepare(spark)
    return bpe.bpe_encode(docs, tokenizer_json())


STAGES = [("quality rules", quality_rules), ("toxicity", toxicity_filter), ("SimHash near-dedup", near_dedup), ("mixing sources", mix_sources), ("BPE encoding", encode)]

#: The stages learn, hash and encode, which SQL does not express; tests hold the stages' operators against brute force and run()
#: against the stages one by one.
#: Nulls, repeated rows and ties are as each stage's operator says; an empty table stays empty through all stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows (doc_id, ids, n_tokens) for the documents of sf_dir."""
    docs, before = table(spark, sf_dir, "documents"), None
    for n, (_, stage) in enumerate(STAGES[:-1]):
        path = new_path(spark, f"stage{n}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
