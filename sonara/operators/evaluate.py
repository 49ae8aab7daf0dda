"""Comparison of transcripts: error rates, speed and reports."""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonara.functions.scores import ratio
from sonara.functions.text import plain_text
from sonara.functions.times import round_half_away, samples_to_ns

COUNTS = ["wer_distance", "ref_words", "hyp_words", "cer_distance", "ref_chars", "hyp_chars"]
_OTHER = regex.compile(r"[^\w]+")


def normal_form(text: str) -> str:
    """Compatibility forms composed, lower case, runs of other than word characters as one space."""
    return _OTHER.sub(" ", unicodedata.normalize("NFKC", text).lower()).strip()


def edit_distance(a: list, b: list) -> int:
    """Insertions, deletions and replacements. A column of the table of distances is two numbers of a bit for each row (Myers,
    Hyyrö): where it rises and where it falls by one."""
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return len(a)
    places: dict = {}
    for k, v in enumerate(a):
        places.setdefault(v, []).append(k)
    masks = {v: _bits(places[v], len(a)) for v in set(b) & places.keys()}
    every = (1 << len(a)) - 1
    last = 1 << (len(a) - 1)
    rises, falls, found = every, 0, len(a)
    for v in b:
        same = masks.get(v, 0)
        carried = (((same & rises) + rises) ^ rises) | same
        up = falls | ~(carried | rises) & every
        down = rises & carried
        if up & last:
            found += 1
        elif down & last:
            found -= 1
        up = up << 1 & every | 1
        same |= falls
        rises = (down << 1 & every) | ~(same | up) & every
        falls = up & same
    return found


def _bits(places: list[int], n: int) -> int:
    """The number with a bit at each place."""
    held = np.zeros(n, dtype=np.uint8)
    held[places] = 1
    return int.from_bytes(np.packbits(held, bitorder="little").tobytes(), "little")


@F.pandas_udf(T.StructType([T.StructField(n, T.LongType()) for n in COUNTS]))
def distances(reference: pd.Series, hypothesis: pd.Series) -> pd.DataFrame:
    """Word and character distances of normal forms; characters without spaces."""
    rows = []
    for r, h in zip(reference, hypothesis, strict=True):
        r, h = normal_form(r or ""), normal_form(h or "")
        rw, hw, rc, hc = r.split(), h.split(), list(r.replace(" ", "")), list(h.replace(" ", ""))
        rows.append((edit_distance(rw, hw), len(rw), len(hw), edit_distance(rc, hc), len(rc), len(hc)))
    return pd.DataFrame(rows, columns=COUNTS)


def rate(distance: Column, reference: Column, hypothesis: Column) -> Column:
    return F.when(reference > 0, distance / reference).when(hypothesis == 0, F.lit(0.0)).otherwise(F.lit(1.0))


def error_rates(pairs: DataFrame, reference: str, hypothesis: str) -> DataFrame:
    """pairs with wer, cer and their counts. Null texts are empty."""
    d = pairs.withColumn("d", distances(reference, hypothesis))
    return d.withColumns({"wer": rate(F.col("d.wer_distance"), F.col("d.ref_words"), F.col("d.hyp_words")), "cer": rate(F.col("d.cer_distance"), F.col("d.ref_chars"), F.col("d.hyp_chars"))}).select(*pairs.columns, "wer", "cer", "d.*")


def char_error_rate(reference: Column, hypothesis: Column) -> Column:
    """The character error rate of texts that are in normal form already, without a Python step."""
    bare = lambda t: F.replace(t, F.lit(" "), F.lit(""))
    r, h = bare(reference), bare(hypothesis)
    return rate(F.levenshtein(r, h).cast("double"), F.length(r), F.length(h))


def coded_words(words: Column, vocabulary: Column) -> Column:
    """A text with one character for each word: the k-th word of the vocabulary is the k-th character from U+0100 on, surrogates
    left out. That is a code for a million distinct words."""
    place = lambda w: F.array_position(vocabulary, w) + F.lit(0xFF)
    point = lambda n: n + F.when(n >= 0xD800, 0x800).otherwise(0)
    character = lambda w: F.decode(F.unhex(F.lpad(F.hex(point(place(w))), 8, "0")), "UTF-32")
    return F.array_join(F.transform(words, character), "")


def plain_error_rates(pairs: DataFrame, reference: str, hypothesis: str) -> DataFrame:
    """error_rates by column functions alone: pairs with wer, cer and their counts, of texts in plain form (lower case, word
    characters; compatibility forms stay as they are). Each pair's distinct words become characters, so both distances are
    the built-in one. Null texts are empty."""
    plain = lambda c: plain_text(F.coalesce(F.col(c), F.lit("")))
    words = lambda c: F.filter(F.split(c, " "), lambda w: w != "")
    rows = pairs.select("*", plain(reference).alias("_r"), plain(hypothesis).alias("_h"))
    rows = rows.withColumns({"_rw": words("_r"), "_hw": words("_h"), "_rc": F.replace("_r", F.lit(" "), F.lit("")), "_hc": F.replace("_h", F.lit(" "), F.lit(""))})
    rows = rows.withColumn("_v", F.array_distinct(F.concat("_rw", "_hw")))
    long = lambda c: c.cast("bigint")
    counts = {
        "wer_distance": F.levenshtein(coded_words(F.col("_rw"), F.col("_v")), coded_words(F.col("_hw"), F.col("_v"))),
        "ref_words": F.size("_rw"),
        "hyp_words": F.size("_hw"),
        "cer_distance": F.levenshtein("_rc", "_hc"),
        "ref_chars": F.length("_rc"),
        "hyp_chars": F.length("_hc"),
    }
    rows = rows.withColumns({n: long(c) for n, c in counts.items()})
    rows = rows.withColumns({"wer": rate(F.col("wer_distance"), F.col("ref_words"), F.col("hyp_words")), "cer": rate(F.col("cer_distance"), F.col("ref_chars"), F.col("hyp_chars"))})
    return rows.select(*(F.col(f"`{c}`") for c in pairs.columns), "wer", "cer", *COUNTS)


def speeds(df: DataFrame, audio_s: str, taken_s: str) -> DataFrame:
    """df with rtf (time over audio) and speedup (audio over time), 0 where undefined, to four and two places."""
    return df.withColumns({"rtf": round_half_away(ratio(F.col(taken_s), F.col(audio_s)), 4), "speedup": round_half_away(ratio(F.col(audio_s), F.col(taken_s)), 2)})


def compare_runs(reference: DataFrame, other: DataFrame) -> DataFrame:
    """One row for each file that both runs (file, text, language_detected, transcribe_time_sec, num_segments, num_words) have."""
    names = ["text", "language_detected", "transcribe_time_sec", "num_segments", "num_words"]
    left = reference.select("file", *(F.col(n).alias(f"ref_{n}") for n in names))
    right = other.select("file", *(F.col(n).alias(f"hyp_{n}") for n in names))
    both = error_rates(left.join(right, "file"), "ref_text", "hyp_text")
    return both.withColumns({"time_ratio": ratio(F.col("hyp_transcribe_time_sec"), F.col("ref_transcribe_time_sec")), "same_language": F.col("ref_language_detected").eqNullSafe(F.col("hyp_language_detected"))})


def joined_text(segments: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """(key, text, segments): texts joined by a space in order. The key's texts become one row, as the result is one text."""
    ordered = F.array_sort(F.collect_list(F.struct(order, F.trim(F.col(text)).alias("t"))))
    return segments.filter(F.trim(F.col(text)) != "").groupBy(key).agg(F.array_join(F.transform(ordered, lambda s: s["t"]), " ").alias("text"), F.count("*").alias("segments"))


def regions_duration(regions: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """(key, duration_ns) of regions in samples; each region's length is cut to whole nanoseconds before they are added."""
    return regions.groupBy(key).agg(F.sum(samples_to_ns((F.col(end) - F.col(start)).cast("double"))).alias("duration_ns"))


def best_of(runs: DataFrame, keys: list[str], seconds: str) -> DataFrame:
    """(keys, best, runs): of repeated runs the fastest, and how many there were."""
    return runs.groupBy(*keys).agg(F.min(seconds).alias("best"), F.count(seconds).alias("runs"))


def stage_totals(timings: DataFrame, stage: str, seconds: str) -> DataFrame:
    """(stage, total, batches): a stage's seconds over all batches."""
    return timings.groupBy(stage).agg(F.sum(seconds).alias("total"), F.count(seconds).alias("batches"))


def kept_segments(segments: DataFrame, text: str, start: str, end: str) -> DataFrame:
    """Segments that have a text and a length."""
    return segments.filter((F.trim(text) != "") & (F.col(start) != F.col(end)))


def spoken_edges(segments: DataFrame, key: str, order: str, start: Column, end: Column) -> DataFrame:
    """(key, first_start, last_end) of the first and last segment that have words: start and end are null where none are."""
    place = F.when(start.isNotNull(), F.col(order))
    return segments.groupBy(key).agg(F.min_by(start, place).alias("first_start"), F.max_by(end, F.when(end.isNotNull(), F.col(order))).alias("last_end"))


def mean_probability(tokens: DataFrame, keys: list[str], probability: str) -> DataFrame:
    """(keys, probability): the mean over a word's tokens, 0 if none has one."""
    return tokens.groupBy(*keys).agg(F.coalesce(F.avg(probability), F.lit(0.0)).alias("probability"))
