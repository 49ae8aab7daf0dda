"""Lempel-Ziv phrase fingerprints.

A text is parsed into dictionary phrases: each is the shortest run of characters from here on that was no phrase before. The
set of phrases says what a compressor would have learned from the text, and the share of common phrases of two texts is a
likeness as compression gives it. A fingerprint is the minimum-hash sketch of the set: its SIZE smallest 32-bit hashes.

A dictionary of phrases holds each phrase's beginnings, so the next phrase's length is found by going up or down from the
last one's, not by trying every length. Phrases are hashed all at once from running sums over the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sonara.llm.common import map_arrow, map_batches, pieces, text_of, written

#: Hashes of a sketch: likeness has a standard error of 1 / (2 sqrt(SIZE)) at most.
SIZE = 64
_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)
_powers = {"up": np.ones(1, dtype=np.uint64), "down": np.ones(1, dtype=np.uint64)}


def _power(name: str, base: int, count: int) -> np.ndarray:
    """base to the power of 0, 1, ... count - 1 modulo 2^64."""
    held = _powers[name]
    while len(held) < count:
        held = np.concatenate([held, held * np.uint64(pow(base, len(held), 1 << 64))])
    _powers[name] = held
    return held[:count]


#: Stands behind a text while it is parsed (a value that is no character), so a run that reaches it is no phrase yet.
END = "\udfff"


def parse(text: str, seen: set[str], start: int, stop: int) -> tuple[list[int], int]:
    """Ends of the phrases that end at or before stop, and where the one in progress begins. seen gets the phrases.
    END has to stand in the text at stop or later."""
    ends: list[int] = []
    add, note, size = seen.add, ends.append, 1
    while start < stop:
        end = start + size
        run = text[start:end]
        if run in seen:
            while run in seen:
                end += 1
                run = text[start:end]
        else:
            while size > 1:
                shorter = text[start : end - 1]
                if shorter in seen:
                    break
                run = shorter
                end -= 1
                size -= 1
        if end > stop:
            break
        add(run)
        note(end)
        size = end - start
        start = end
    return ends, start


def phrase_hashes(text: str, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 32-bit hash of each text[start:end], the same for the same characters anywhere."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64) + np.uint64(1)
    sums = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum(codes * _power("up", _ODD, len(codes)), out=sums[1:])
    h = (sums[ends] - sums[starts]) * _power("down", _INVERSE, len(codes) + 1)[starts]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (h >> np.uint64(32)).astype(np.uint32)


def sketch(hashes: np.ndarray) -> np.ndarray:
    if len(hashes) > 4 * SIZE:  # enough of the smallest, repeats counted, and all if those repeat too much
        for count in (2 * SIZE, len(hashes)):
            least = np.unique(np.partition(hashes, count - 1)[:count])
            if len(least) >= SIZE:
                break
        return least[:SIZE]
    return np.unique(hashes)[:SIZE]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The estimated share of common phrases: of the SIZE smallest hashes of both together, those that both have. Two
    texts without phrases are alike, one with and one without are not."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.union1d(a, b)[:SIZE]
    return float((np.isin(both, a) & np.isin(both, b)).sum() / len(both))


def to_text(hashes: np.ndarray) -> str:
    return hashes.astype(">u4").tobytes().hex()


def from_text(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), dtype=">u4").astype(np.uint32)


def fingerprint(text: str) -> np.ndarray:
    """The sketch of a text. A phrase that the text's end cuts short counts too."""
    ends, start = parse(text + END, set(), 0, len(text))
    return _sketched(text, ends, start)


def _sketched(text: str, ends: list[int], rest: int) -> np.ndarray:
    stops = np.array(ends if rest == len(text) else [*ends, len(text)], dtype=np.int64)
    return sketch(phrase_hashes(text, np.r_[0, stops[:-1]], stops)) if len(stops) else np.zeros(0, dtype=np.uint32)


def edited_text(text: str, following: str) -> str:
    """The last half of the characters (rounded down) replaced by as many of the following text's first, or all of them."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def both_fingerprints(text: str, following: str) -> tuple[np.ndarray, str, np.ndarray]:
    """The text's sketch, its edited text and that one's sketch. Up to the cut both are parsed once."""
    cut = len(text) - len(text) // 2
    seen: set[str] = set()
    ends, start = parse(text + END, seen, 0, cut)
    edited = edited_text(text, following)
    more, rest = parse(edited + END, set(seen), start, len(edited))
    of_edited = _sketched(edited, ends + more, rest)
    more, rest = parse(text + END, seen, start, len(text))
    return _sketched(text, ends + more, rest), edited, of_edited


_COLUMNS = "kind int, part int, id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, text string"
_KINDS = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "double": pa.float64()}
DONE, LAST, HEAD = 0, 1, 2


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [c.split() for c in _COLUMNS.split(", ")]
    return pa.RecordBatch.from_pydict({n: pa.array([r[i] for r in rows], _KINDS[t]) for i, (n, t) in enumerate(names)})


def edit_likeness(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    The next row is that of the next id (null ids first, repeated ids by text), after the last the first; a single row is
    its own next. A null text is empty. Rows are dealt by ranges of the id and stay there; only the first and last text of
    each range are kept aside and paired afterwards.
    """
    rows = df.select(df[id_col].cast("bigint").alias("id"), text_of(text_col).alias("text")).withColumn("h", F.xxhash64("text"))
    rows = rows.repartitionByRange("id", "h").sortWithinPartitions("id", "h").select("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: tuple[int | None, str] | None = None  # the row whose next is still to come
        waiting: tuple | None = None  # the one before, which lacks the likeness to held
        out: list[tuple] = []

        def own(found: np.ndarray) -> None:
            """held's own sketch is known: the row before it is done, or held is the task's first."""
            if waiting is None:
                out.append((HEAD, part, held[0], None, None, to_text(found), None, None, None, held[1]))
            else:
                out.append((*waiting[:8], likeness(waiting[9], found), None))

        for batch in batches:
            for key, text in ((k, t) for part, texts in pieces(batch) for k, t in zip(part.column(0).to_pylist(), texts, strict=True)):
                if held is not None:
                    found, edited, of_edited = both_fingerprints(held[1], text)
                    own(found)
                    waiting = (DONE, part, held[0], len(held[1]), hashlib.sha256(edited.encode()).hexdigest(), to_text(found), to_text(of_edited), likeness(found, of_edited), None, found)
                held = (key, text)
                if len(out) >= 500:
                    yield _batch(out)
                    out.clear()
        if held is not None:
            found = fingerprint(held[1])
            own(found)
            out.append((LAST, part, held[0], None, None, to_text(found), None, None, None, held[1]))
            yield _batch(out)

    found, _ = written(map_batches(rows, run, _COLUMNS), "lz")
    # a row for each task says which task's first text follows its last one
    heads = found.filter(F.col("kind") == HEAD)
    around = heads.select("part", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy(F.lit(0)))).alias("to"))
    lasts = found.filter(F.col("kind") == LAST).select("part", "id", "text", "fingerprint").join(around, "part")
    pairs = lasts.join(heads.select(F.col("part").alias("to"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_print")), "to")

    def start():
        def each(batch: pa.RecordBatch) -> Iterator[dict]:
            done = []
            for key, text, following, next_print in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                sketched, edited, of_edited = both_fingerprints(text, following)
                done.append((DONE, 0, key, len(text), hashlib.sha256(edited.encode()).hexdigest(), to_text(sketched), to_text(of_edited), likeness(sketched, of_edited), likeness(sketched, from_text(next_print)), None))
            made = _batch(done)
            yield dict(zip(made.schema.names, made.columns, strict=True))

        return each

    ends = map_arrow(pairs.select("id", "text", "next_text", "next_print"), start, _COLUMNS)
    both = found.filter(F.col("kind") == DONE).unionByName(ends)
    return both.select(F.col("id").alias(id_col), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
