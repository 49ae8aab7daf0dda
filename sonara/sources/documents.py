"""Tokenizer files, phrase lists, benchmark results, and names of published models."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonara.functions.text import is_language_token, language_code, normal_words

WORD = "struct<start: double, `end`: double, word: string, probability: double>"
SEGMENT = f"struct<id: int, start: double, `end`: double, text: string, words: array<{WORD}>>"
FILE_RESULT = f"struct<file: string, language_requested: string, language_detected: string, language_probability: double, audio_duration_sec: double, transcribe_time_sec: double, rtf: double, speedup_vs_realtime: double, num_segments: int, num_words: int, text: string, segments: array<{SEGMENT}>>"
RESULTS = f"implementation string, mode string, model string, device string, device_index int, compute_type string, batch_size int, word_timestamps boolean, vad_filter boolean, model_load_sec double, results array<{FILE_RESULT}>"

#: Names under which models are known, and where each is published (fixed values: the public registry's entries).
MODELS = {
    "tiny.en": "Systran/faster-whisper-tiny.en",
    "tiny": "Systran/faster-whisper-tiny",
    "base.en": "Systran/faster-whisper-base.en",
    "base": "Systran/faster-whisper-base",
    "small.en": "Systran/faster-whisper-small.en",
    "small": "Systran/faster-whisper-small",
    "medium.en": "Systran/faster-whisper-medium.en",
    "medium": "Systran/faster-whisper-medium",
    "large-v1": "Systran/faster-whisper-large-v1",
    "large-v2": "Systran/faster-whisper-large-v2",
    "large-v3": "Systran/faster-whisper-large-v3",
    "large": "Systran/faster-whisper-large-v3",
    "distil-large-v2": "Systran/faster-distil-whisper-large-v2",
    "distil-medium.en": "Systran/faster-distil-whisper-medium.en",
    "distil-small.en": "Systran/faster-distil-whisper-small.en",
    "distil-large-v3": "Systran/faster-distil-whisper-large-v3",
    "large-v3-turbo": "mobiuslabsgmbh/faster-whisper-large-v3-turbo",
    "turbo": "mobiuslabsgmbh/faster-whisper-large-v3-turbo",
}
MODEL_FILES = ("model.bin", "config.json", "tokenizer.json")
VOCABULARY_FILES = ("vocabulary.json", "vocabulary.txt")


def read_vocabulary(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(vocab (token, id), merges (pair, rank), languages (language, token)) of a tokenizer file. The first rank of a
    repeated merge holds."""
    schema = "model struct<vocab: map<string, int>, merges: array<string>>, added_tokens array<struct<id: int, content: string>>"
    data = spark.read.schema(schema).option("multiLine", "true").json(path)
    vocab = data.select(F.explode("model.vocab").alias("token", "id")).union(data.select(F.explode("added_tokens").alias("t")).select("t.content", "t.id"))
    merges = data.select(F.posexplode("model.merges").alias("rank", "pair")).groupBy("pair").agg(F.min("rank").alias("rank"))
    languages = vocab.filter(is_language_token(F.col("token"))).select(language_code(F.col("token")).alias("language"), F.col("id").alias("token"))
    return vocab, merges, languages


def read_phrases(spark: SparkSession, path: str) -> DataFrame:
    """(language, phrase, ordinal, words, first_word, n_words) of a file {language: [phrase, ...]}."""
    whole = spark.read.text(path, wholetext=True)
    listed = whole.select(F.explode(F.from_json("value", "map<string, array<string>>")).alias("language", "phrases"))
    rows = listed.select("language", F.posexplode("phrases").alias("ordinal", "phrase")).withColumn("words", normal_words(F.col("phrase")))
    return rows.withColumns({"first_word": F.try_element_at("words", F.lit(1)), "n_words": F.size("words")})


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """A row for each file of a benchmark result; no rows where there is no such document."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    data = spark.read.schema(RESULTS).option("multiLine", "true").json(path) if there else spark.createDataFrame([], RESULTS)
    return data.select("implementation", "mode", F.explode("results").alias("r")).select("implementation", "mode", "r.*")


def write_results(results: DataFrame, path: str, **header: object) -> None:
    """One benchmark document of all files' rows, as JSON; a benchmark has a handful of files."""
    columns = [F.lit(v).alias(k) for k, v in header.items()]
    results.agg(F.sort_array(F.collect_list(F.struct("*"))).alias("results")).select(*columns, "results").coalesce(1).write.mode("overwrite").json(path)


def model_names() -> list[str]:
    return sorted(MODELS)


def cache_dir(given: str | None = None) -> Path:
    if given:
        return Path(given)
    return Path(os.environ.get("XDG_CACHE_HOME") or Path.home() / ".cache") / "sonara"


def has_model(folder: Path) -> bool:
    return all((folder / f).is_file() for f in MODEL_FILES) and any((folder / f).is_file() for f in VOCABULARY_FILES)


def resolve_model(name: str, cache: str | None = None) -> Path:
    """A local folder first, then the cache under the registered name. Nothing is downloaded: a model that isn't there is an
    error that says where it is published."""
    folder = Path(name)
    if folder.is_dir():
        return folder
    published = MODELS.get(name, name if "/" in name else None)
    if published is None:
        raise ValueError(f"unknown model {name}; known are {', '.join(model_names())}")
    cached = cache_dir(cache) / ("models--" + published.replace("/", "--"))
    if has_model(cached):
        return cached
    raise FileNotFoundError(f"{name} is not in {cached}; it is published as {published}")


def named_files(files: DataFrame, path: str, names: list[str]) -> DataFrame:
    """Files whose whole path or last part is among the names; all without names."""
    return files.filter(F.col(path).isin(names) | F.element_at(F.split(path, "/"), -1).isin(names)) if names else files
