"""Decoding attempts: choosing one, skipping silent windows, and controlling segments made up in silence."""

from __future__ import annotations

import zlib
from collections.abc import Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonara.functions.scores import FIRST_WORDS, LONG_S, LOW_PROBABILITY, PUNCTUATION, SEGMENT_SCORE, SHORT_S, SHORT_SCALE

EDGE_S = 2.0


def compression_ratio(text: str) -> float:
    """Bytes of the text over bytes of its zlib stream; 0 if empty."""
    raw = text.encode()
    return len(raw) / len(zlib.compress(raw)) if raw else 0.0


@F.pandas_udf(T.DoubleType())
def compression_ratios(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: compression_ratio(t or ""))


def choose_attempts(df: DataFrame, key: list[str], order: str, logprob: str, ratio: str, no_speech: str, ratio_threshold: float = 2.4, logprob_threshold: float = -1.0, no_speech_threshold: float = 0.6) -> DataFrame:
    """(key..., chosen, reported, accepted): the attempt to use for each key, and the one whose temperature is reported.

    The first acceptable attempt is used: ratio not over and log probability not under its threshold, or likely silence with
    a low log probability, which overrides both. If none is acceptable: the highest log probability among those whose ratio
    is in bounds, else among all, the earliest of equals; the last attempt's temperature is reported then. One partial
    aggregate; a key's attempts never need to be in order in one place.
    """
    lp, at = F.col(logprob), F.col(order)
    repetitive = F.lit(False) if ratio_threshold <= 0 else F.col(ratio) > ratio_threshold
    silent = F.lit(False) if no_speech_threshold <= 0 else (F.col(no_speech) > no_speech_threshold) & (lp < logprob_threshold)
    good = silent | (~repetitive & ~(lp < logprob_threshold))
    best = F.struct(lp.alias("lp"), (-at).alias("n"))
    found = df.groupBy(*key).agg(
        F.min(F.when(good, at)).alias("accepted"),
        F.max(F.when(~repetitive, best)).alias("plain"),
        F.max(best).alias("any"),
        F.max(at).alias("last"),
    )
    fallback = -F.coalesce(F.col("plain.n"), F.col("any.n"))
    return found.select(*key, F.coalesce("accepted", fallback).alias("chosen"), F.coalesce("accepted", "last").alias("reported"), F.col("accepted").isNotNull().alias("accepted"))


def acceptable(logprob: float, ratio: float, no_speech: float, ratio_threshold: float = 2.4, logprob_threshold: float = -1.0, no_speech_threshold: float = 0.6) -> bool:
    """The same test for one attempt."""
    if 0 < no_speech_threshold < no_speech and logprob < logprob_threshold:
        return True
    return not (0 < ratio_threshold < ratio) and not logprob < logprob_threshold


@dataclass
class Heard:
    """A segment with words in seconds: (start, end, word, probability)."""

    start: float
    end: float
    words: list[tuple[float, float, str, float]] = field(default_factory=list)


def word_score(start: float, end: float, probability: float) -> float:
    length = end - start
    return (probability < LOW_PROBABILITY) + max(0.0, SHORT_S - length) * SHORT_SCALE + max(0.0, length - LONG_S)


def is_anomaly(segment: Heard) -> bool:
    spoken = [w for w in segment.words if w[2].strip() and w[2].strip() not in set(PUNCTUATION)][:FIRST_WORDS]
    score = sum(word_score(s, e, p) for s, e, _, p in spoken)
    return bool(spoken) and (score >= SEGMENT_SCORE or score + 0.01 >= len(spoken))


def control_silence(segments: Sequence[Heard], threshold: float, seek: int, next_seek: int, window_s: float, content_frames: int, last_speech: float) -> tuple[list[Heard], int, bool]:
    """(segments that stay, where to go on (frames), whether the whole window is left out).

    An anomalous first segment after a long silence makes the window begin there anew. Any later anomalous segment with
    silence on both sides ends the window's result before it.
    """
    offset = seek / 100
    worded = [s for s in segments if s.words]
    if worded and is_anomaly(worded[0]) and worded[0].start - offset > threshold:
        return list(segments), seek + round_half_up((worded[0].start - offset) * 100), True
    before = last_speech
    for k, s in enumerate(segments):
        if not s.words:
            continue
        if is_anomaly(s):
            following = next((x.words[0][0] for x in segments[k + 1 :] if x.words), offset + window_s)
            quiet_before = s.start - before > threshold or s.start < threshold or s.start - offset < EDGE_S
            quiet_after = following - s.end > threshold or (k + 1 < len(segments) and is_anomaly(segments[k + 1])) or offset + 30 - s.end < EDGE_S
            if quiet_before and quiet_after:
                onward = content_frames if content_frames / 100 - s.end < threshold else round_half_up(max(offset + 1, s.start) * 100)
                return list(segments[:k]), onward, False
        before = s.end
    return list(segments), next_seek, False


def round_half_up(x: float) -> int:
    return int(x + 0.5) if x >= 0 else -int(0.5 - x)


def silence_flags(segments: DataFrame, key: str, order: str, anomaly: Column, threshold: float) -> DataFrame:
    """segments with `surrounded`: anomalous, and more than threshold (ns) from the neighbours' speech on both sides."""
    w = Window.partitionBy(key).orderBy(order)
    before = F.col("start_ns") - F.coalesce(F.lag("end_ns").over(w), F.lit(0))
    after = F.lead("start_ns").over(w) - F.col("end_ns")
    return segments.withColumn("surrounded", anomaly & (before > threshold) & F.coalesce(after > threshold, F.lit(True)))
