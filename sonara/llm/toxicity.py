"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct unigrams, bigrams and skip-grams (one word left out) of a text's words, hashed to 2^BITS places.
FTRL-proximal keeps for each coordinate a sum of gradients and of their squares, so frequent coordinates learn slowly and
rare ones fast, and its L1 term keeps a weight at zero until the evidence for it is large. What is left is some hundred
weights: they travel with the tasks, and scoring stays where the texts lie.

Training takes labelled rows only, TRAIN_ROWS of them at most, chosen by a hash of the id, with all their features. These
are a table of the shared folder, which each epoch streams to the driver part by part. Scoring takes all rows and whole
texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonara.llm.common import map_arrow, map_batches, pieces, remove, text_of, written

BITS = 20
TRAIN_ROWS = 20_000
EPOCHS = 5
ALPHA, BETA, L1, L2 = 2.0, 1.0, 10.0, 0.1
#: A document is called toxic from this score on.
THRESHOLD = 0.7
_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_word = re.compile(r"\w+").findall


class Hasher:
    """The features of texts. Word hashes are kept from text to text, as most words come again."""

    def __init__(self, bits: int = BITS, most: int = 500_000):
        self.shift, self.most, self.known = np.uint64(64 - bits), most, {}

    def features(self, text: str) -> np.ndarray:
        """The distinct places of the text's unigrams, bigrams and skip-grams."""
        return np.unique(self.places(text))

    def places(self, text: str) -> np.ndarray:
        """The same with repeats, in no order."""
        words = _word(text.lower())
        known = self.known
        if len(known) > self.most:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), 3)
        h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
        parts = [h * _K[0]]
        for gap, k in ((1, _K[1]), (2, _K[2])):
            pair = (h[:-gap] * k) ^ (h[gap:] + (h[gap:] << np.uint64(7)))
            parts.append((pair ^ (pair >> np.uint64(31))) * _K[0])
        return (np.concatenate(parts) >> self.shift).astype(np.int64)


@dataclass(frozen=True)
class Model:
    """Non-zero weights by place (ascending) and the bias: all that scoring needs."""

    bits: int
    places: np.ndarray
    weights: np.ndarray
    bias: float

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << self.bits)
        out[self.places] = self.weights
        return out


def ftrl(rows: Iterable[tuple[np.ndarray, int]], bits: int = BITS, epochs: int = EPOCHS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2) -> Model:
    """Fits rows of (places, label) in the order given, which are gone through once more than there are epochs. Both labels
    together weigh the same."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    zb = nb = 0.0
    counts = Counter(y for _, y in rows)
    share = {y: counts.total() / (2 * max(1, counts[y])) for y in (0, 1)}
    for _ in range(epochs):
        for places, y in rows:
            zi, ni = z[places], n[places]
            w = np.where(np.abs(zi) > l1, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2), 0.0)
            b = -zb / ((beta + nb**0.5) / alpha + l2)
            g = (1 / (1 + np.exp(-np.clip(w.sum() + b, -30, 30))) - y) * share[y]
            z[places] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * w
            n[places] = ni + g * g
            zb += g - ((nb + g * g) ** 0.5 - nb**0.5) / alpha * b
            nb += g * g
    weights = np.where(np.abs(z) > l1, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2), 0.0)
    places = np.flatnonzero(weights)
    return Model(bits, places, weights[places], -zb / ((beta + nb**0.5) / alpha + l2))


class Stored:
    """Rows (id, y, places) of a table as (places, label) in an order of their hashes, each time anew; the driver holds a
    part of the table at a time."""

    def __init__(self, table: DataFrame):
        self.ordered = table.orderBy(F.xxhash64("id"), "id", F.xxhash64("places"), "y").select("y", "places")

    def __iter__(self) -> Iterator[tuple[np.ndarray, int]]:
        for row in self.ordered.toLocalIterator():
            yield np.frombuffer(row["places"], dtype="<i4"), row["y"]


def in_training(id_col: str) -> F.Column:
    """Rows whose crc32(id as text) mod 3 is not 1 may be learned from; a null id is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 != 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = TRAIN_ROWS) -> Model | None:
    """The model of the labelled training rows; None if they don't have both labels.

    The sample is of labelled ids only, so its texts are found by a join with at most `rows` ids. Null labels and ids are
    left out; an id that is labelled more than once counts by its highest label; of repeated documents each is a row, and
    where they make more than `rows` rows those of least hash are taken, so what the driver is sent has that bound.
    """
    known = labels.select(labels[id_col].cast("bigint").alias("id"), labels[label_col].cast("int").alias("y")).filter(in_training("id") & F.col("y").isin(0, 1))
    known = known.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(rows)
    texts = docs.select(docs[id_col].cast("bigint").alias("id"), text_of(text_col).alias("text"))
    # `rows` ids of 12 bytes at most: a bound that does not grow with the data
    found = texts.join(F.broadcast(known), "id").select("id", "y", "text")

    def start() -> Callable[[pa.RecordBatch], Iterator[dict]]:
        hasher = Hasher()

        def each(batch: pa.RecordBatch) -> Iterator[dict]:
            for part, of in pieces(batch, 2):
                yield {"id": part.column(0), "y": part.column(1), "places": pa.array([hasher.features(t).astype("<i4").tobytes() for t in of], pa.binary())}

        return each

    stored, path = written(map_arrow(found, start, "id bigint, y int, places binary"), "features")
    found_rows, classes = stored.agg(F.count("*"), F.countDistinct("y")).first()
    if found_rows > rows:
        stored = stored.orderBy(F.xxhash64("id", "places"), "id", "places").limit(rows)
        classes = stored.select("y").distinct().count()
    model = ftrl(Stored(stored)) if classes == 2 else None
    remove(docs.sparkSession, path)
    return model


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score) of every row: 0 to 1, of the text alone. Without a model every score is 0.5."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(docs[id_col].cast("bigint").alias("id"), text_of(text_col).alias("text"))

    def start() -> Callable[[pa.RecordBatch], Iterator[dict]]:
        of = scorer(shared.value)

        def each(batch: pa.RecordBatch) -> Iterator[dict]:
            for part, texts in pieces(batch):
                yield {"id": part.column(0), "score": pa.array(map(of, texts), pa.float64())}

        return each

    return map_arrow(rows, start, "id bigint, score double").withColumnRenamed("id", id_col)


def scorer(model: Model | None) -> Callable[[str], float]:
    if model is None:
        return lambda text: 0.5
    weights, hasher = model.dense(), Hasher(model.bits)

    def of(text: str) -> float:
        places = hasher.places(text)
        places = np.unique(places[weights[places] != 0])  # few have a weight, so few are sorted
        return float(1 / (1 + np.exp(-np.clip(weights[places].sum() + model.bias, -700, 700))))

    return of


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs. A null text is scored as the empty one."""
    scored = score(docs, train(docs, labels))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def toxicity_filter(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that are not called toxic, with all their columns; rows don't move. A null text is scored as the empty
    one, repeated rows alike; without labels of both kinds every row stays."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col, text_col))
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = scorer(shared.value)
        for batch in batches:
            for part, texts in pieces(batch, place):
                yield part.filter(pa.array([of(t) < THRESHOLD for t in texts], pa.bool_()))

    return map_batches(docs, run, docs.schema)
