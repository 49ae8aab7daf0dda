"""Score expressions for words, segments and decoding attempts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the anomaly score.
LOW_PROBABILITY, SHORT_S, SHORT_SCALE, LONG_S, FIRST_WORDS, SEGMENT_SCORE = 0.15, 0.133, 15.0, 2.0, 8, 3.0
PUNCTUATION = "\"'“¿([{-\"'.。,，!！?？:：”)]}、"


def word_anomaly(probability: Column, duration_s: Column) -> Column:
    """1 for a probability under 0.15, 15 for each second under 0.133, 1 for each second over 2."""
    return (
        F.when(probability < LOW_PROBABILITY, 1.0).otherwise(0.0)
        + F.when(duration_s < SHORT_S, (F.lit(SHORT_S) - duration_s) * SHORT_SCALE).otherwise(0.0)
        + F.when(duration_s > LONG_S, duration_s - LONG_S).otherwise(0.0)
    )


def is_punctuation_word(word: Column) -> Column:
    """No word but one mark, or none, white space aside."""
    mark = F.regexp_replace(word, r"^\s+|\s+$", "")
    return (mark == "") | F.array_contains(F.array(*map(F.lit, sorted(set(PUNCTUATION)))), mark)


def segment_anomaly(words: Column) -> Column:
    """True if the first eight words that are no punctuation score 3 in all, or about 1 each."""
    spoken = F.slice(F.filter(words, lambda w: ~is_punctuation_word(w["word"])), 1, FIRST_WORDS)
    seconds = lambda w: w["end_ns"] / 1e9 - w["start_ns"] / 1e9
    score = F.aggregate(spoken, F.lit(0.0), lambda s, w: s + word_anomaly(w["probability"].cast("double"), seconds(w)))
    return F.coalesce((F.size(spoken) > 0) & ((score >= SEGMENT_SCORE) | (score + 0.01 >= F.size(spoken))), F.lit(False))


def recovered_logprob(score: Column, length: Column, length_penalty: float = 1.0) -> Column:
    """The mean log probability of a sequence (its end included) from a score under a length penalty; 0 if it is empty."""
    return F.when(length == 0, F.lit(0.0)).otherwise(score * F.pow(length.cast("double"), F.lit(length_penalty)) / (length + 1))


def is_silent(no_speech: Column, logprob: Column, no_speech_threshold: float = 0.6, logprob_threshold: float = -1.0) -> Column:
    """A window to skip: likely silence, and not decoded with confidence. A threshold of 0 or less turns it off."""
    if no_speech_threshold <= 0:
        return F.lit(False)
    return (no_speech > no_speech_threshold) & ~(logprob > logprob_threshold)


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is not above 0."""
    return F.when(b > 0, a / b).otherwise(0.0)


def error_rate(distance: Column, length: Column, other: Column) -> Column:
    """distance / length; against an empty reference 0 if the other is empty too, else 1."""
    return F.when(length > 0, distance / length).when(other == 0, 0.0).otherwise(1.0)
