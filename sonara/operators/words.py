"""Words with times: from alignments, repaired and handed to segments."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field
from statistics import median

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonara.functions.text import SENTENCE_MARKS
from sonara.operators import scan
from sonara.operators.tokens import Tokenizer
from sonara.schema import WORD

ALIGN_RATE, FRAME_RATE = 50.0, 100.0
MEDIAN_CAP_S = 0.7


@dataclass
class Aligned:
    word: str
    tokens: list[int]
    start: float
    end: float
    probability: float = 0.0

    @property
    def length(self) -> float:
        return self.end - self.start


@dataclass
class Spoken:
    """A segment: times in nanoseconds, words as (start, end, word, probability)."""

    start: int
    end: int
    tokens: list[int]
    words: list[list] = field(default_factory=list)


def ns(seconds: float) -> int:
    return int(seconds * 1e9)


def aligned_words(text_index: Sequence[int], time_index: Sequence[int], probabilities: Sequence[float], tokens: list[int], tokenizer: Tokenizer, language: str | None) -> list[Aligned]:
    """Words of a path through (text, time): a token begins where the path first reaches it."""
    if not len(text_index):
        return []
    words, groups = tokenizer.words([*tokens, tokenizer.eot], language)
    if len(groups) <= 1:
        return []
    times = [t / ALIGN_RATE for k, t in enumerate(time_index) if k == 0 or text_index[k] != text_index[k - 1]]
    out, at = [], 0
    for word, group in zip(words[:-1], groups[:-1], strict=True):
        to = at + len(group)
        p = probabilities[at:to]
        out.append(Aligned(word, group, times[at] if at < len(times) else 0.0, times[min(to, len(times) - 1)], sum(p) / len(p) if len(p) else 0.0))
        at = to
    return out


def typical_length(words: list[Aligned]) -> float:
    """The median of positive lengths, 0.7 s at most, 0 without any."""
    lengths = [w.length for w in words if w.length > 0]
    return min(MEDIAN_CAP_S, median(lengths)) if lengths else 0.0


def has_mark(word: str) -> bool:
    return any(m in word.strip() for m in SENTENCE_MARKS)


def shorten_at_sentences(words: list[Aligned], most: float) -> None:
    """Words over `most` at a sentence's end lose their tail, those after one their head; the first word stays."""
    if not any(w.length > 0 for w in words):
        return
    for before, w in zip(words, words[1:], strict=False):
        if w.length > most:
            if has_mark(w.word):
                w.end = w.start + most
            elif has_mark(before.word):
                w.start = w.end - most


def merge_punctuation(words: list[Aligned], prepend: str, append: str) -> None:
    """Opening marks join the word after them, closing ones the word before. A word that joined is left empty and without
    tokens; its times stay with it."""
    one = lambda text, marks: len(text) == 1 and text in marks
    target = len(words) - 1
    for k in range(len(words) - 2, -1, -1):
        w = words[k]
        if w.word.startswith(" ") and one(w.word.strip(), prepend):
            words[target].word, words[target].tokens = w.word + words[target].word, w.tokens + words[target].tokens
            w.word, w.tokens = "", []
        else:
            target = k
    target = 0
    for k in range(1, len(words)):
        w, into = words[k], words[target]
        if into.word and not into.word.endswith(" ") and one(w.word, append):
            into.word, into.tokens = into.word + w.word, into.tokens + w.tokens
            w.word, w.tokens = "", []
        else:
            target = k


def _gathered(rows: DataFrame, key: str, at: str, leader: Column) -> DataFrame:
    """Words and tokens of the rows with one leader (a place), in order, at the leader's row; the others' are empty."""
    rows = rows.withColumn("_leader", leader)
    group = Window.partitionBy(key, "_leader").orderBy(at).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    leads = F.col(at) == F.col("_leader")
    none = F.array().cast(dict(rows.dtypes)["tokens"])
    word = F.when(leads, F.array_join(F.collect_list("word").over(group), "")).otherwise("")
    return rows.withColumns({"word": word, "tokens": F.when(leads, F.flatten(F.collect_list("tokens").over(group))).otherwise(none)}).drop("_leader")


def merge_marks(words: DataFrame, key: str, at: str, prepend: str, append: str, block: Column | None = None) -> DataFrame:
    """Rows (key, at, word, tokens, ...) after opening marks joined the word after them and closing ones the word before: a table's
    merge_punctuation, along each key's rows by place.

    A word that joined another is left empty and without tokens; all other columns stay. Rows are grouped by the place of the
    word that they join: the next that is no opening mark (else the key's last word), then the last that is no closing mark
    or stands behind an empty word or a blank. Only a word's own marks come together in one place. Null words and tokens are
    empty, a null key is a key, places are unique and not null within a key, and marks are not blanks. Large keys take a
    block, as scans do.
    """
    words = words.withColumns({"word": F.coalesce("word", F.lit("")), "tokens": F.coalesce("tokens", F.array().cast(dict(words.dtypes)["tokens"]))})
    word = F.col("word")
    bare = F.regexp_replace(word, r"(?U)^\s+|\s+$", "")
    one = lambda c, marks: (F.length(c) == 1) & F.lit(marks).contains(c)
    opens = F.startswith(word, F.lit(" ")) & one(bare, prepend)
    rows = scan.scanned(words, key, [at], block, _next=scan.next_value(F.when(~opens, F.col(at))), _end=scan.highest_ahead(F.col(at)))
    rows = _gathered(rows, key, at, F.coalesce("_next", "_end")).drop("_next", "_end")
    rows = scan.scanned(rows, key, [at], block, _before=scan.previous(word))
    stays = ~one(word, append) | F.col("_before").isNull() | (F.col("_before") == "") | F.endswith("_before", F.lit(" "))
    rows = scan.scanned(rows.withColumn("_stays", F.when(stays, F.col(at))), key, [at], block, _last=scan.last_value(F.col("_stays")))
    return _gathered(rows, key, at, F.col("_last")).drop("_before", "_stays", "_last")


def hand_out(segments: list[Spoken], words: list[Aligned], eot: int, seek: int, prepend: str, append: str, last_speech: float) -> float:
    """Gives each segment the words that its text tokens pay for, repairs first and last words and the segment's bounds;
    returns where speech last ended (s)."""
    typical = typical_length(words)
    most = 2 * typical
    shorten_at_sentences(words, most)
    merge_punctuation(words, prepend, append)
    offset, queue = seek / FRAME_RATE, iter(words)
    cents = lambda t: ns(math.floor(t * 100 + 0.5) / 100 if t >= 0 else math.ceil(t * 100 - 0.5) / 100)
    for segment in segments:
        due = sum(t < eot for t in segment.tokens)
        mine: list[list] = []
        while due > 0 and (w := next(queue, None)) is not None:
            if w.word:
                mine.append([cents(offset + w.start), cents(offset + w.end), w.word.strip(), w.probability])
            due -= len(w.tokens)
        segment.words = mine
        if mine:
            _repair(segment, typical, most, last_speech)
            last_speech = segment.end / 1e9
    return last_speech


def _repair(segment: Spoken, typical: float, most: float, last_speech: float) -> None:
    words = segment.words
    first = words[0]
    start, end = (lambda w: w[0] / 1e9), (lambda w: w[1] / 1e9)
    long_pause = end(first) - last_speech > 4 * typical
    too_long = end(first) - start(first) > most or (len(words) > 1 and end(words[1]) - start(first) > 2 * most)
    if long_pause and too_long:
        if len(words) > 1 and end(words[1]) - start(words[1]) > most:
            border = ns(max(end(words[1]) / 2, end(words[1]) - most))
            first[1] = words[1][0] = border
        first[0] = ns(max(0.0, end(first) - most))
    begin, stop = segment.start / 1e9, segment.end / 1e9
    if begin < end(first) and begin - 0.5 > start(first):
        first[0] = ns(max(0.0, min(end(first) - typical, begin)))
    else:
        segment.start = first[0]
    last = words[-1]
    if stop > start(last) and stop + 0.5 < end(last):
        last[1] = ns(max(start(last) + typical, stop))
    else:
        segment.end = last[1]


def distribute_words(df: DataFrame, eot: int, prepend: str, append: str) -> DataFrame:
    """(rec_id, win, segments array<struct<start_ns, end_ns, words>>) of rows (rec_id, win, seek, segments, alignment) whose
    segments hold (start_ns, end_ns, tokens) and alignment (word, tokens, start, end, probability).

    Where speech last ended is carried from window to window, so a recording's windows are walked in order in one task.
    """
    schema = f"rec_id bigint, win bigint, segments array<struct<start_ns: bigint, end_ns: bigint, words: array<{WORD}>>>"

    def run(group: pd.DataFrame) -> pd.DataFrame:
        last, rows = 0.0, []
        for r in group.sort_values("win").itertuples():
            segments = [Spoken(int(s["start_ns"]), int(s["end_ns"]), [int(t) for t in s["tokens"]]) for s in r.segments]
            words = [Aligned(w["word"], [int(t) for t in w["tokens"]], w["start"], w["end"], w["probability"]) for w in r.alignment]
            last = hand_out(segments, words, eot, int(r.seek), prepend, append, last)
            named = [{"start_ns": s.start, "end_ns": s.end, "words": [dict(zip(("start_ns", "end_ns", "word", "probability"), w, strict=True)) for w in s.words]} for s in segments]
            rows.append((r.rec_id, r.win, named))
        return pd.DataFrame(rows, columns=["rec_id", "win", "segments"])

    return df.select("rec_id", "win", "seek", "segments", "alignment").groupBy("rec_id").applyInPandas(run, schema)


def typical_lengths(words: DataFrame, key: str, length: str) -> DataFrame:
    """(key, typical): the same median in SQL, over (key, length) in seconds."""
    return words.groupBy(key).agg(F.least(F.lit(MEDIAN_CAP_S), F.coalesce(F.median(F.when(F.col(length) > 0, F.col(length))), F.lit(0.0))).alias("typical"))
