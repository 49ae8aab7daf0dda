"""Row types of the tables that operators exchange."""

from __future__ import annotations

from pyspark.sql import types as T

SAMPLE_RATE = 16_000
WORD = "struct<start_ns: bigint, end_ns: bigint, word: string, probability: float>"
REGION = "struct<start: bigint, `end`: bigint>"
RAW_SEGMENT = "struct<start: double, `end`: double, tokens: array<int>>"
ALIGNED_WORD = "struct<word: string, tokens: array<int>, start: double, `end`: double, probability: float>"

#: A recording, or a part of one: part 0 begins at sample 0.
RECORDINGS = "rec_id bigint, part int, start_sample bigint, pcm array<float>"
SCORES = "rec_id bigint, idx bigint, score float"
REGIONS = "rec_id bigint, idx bigint, start bigint, `end` bigint"
SEGMENTS = f"rec_id bigint, id int, start_ns bigint, end_ns bigint, text string, words array<{WORD}>, temperature float, avg_logprob float, compression_ratio float, no_speech_prob float"
EVENTS = "source_id string, type string, start_ns bigint, end_ns bigint, prob float, truncated boolean"
TRANSCRIPTS = f"rec_id bigint, language string, language_probability float, duration_ns bigint, duration_after_vad_ns bigint, text string, segments array<struct<{', '.join(f'`{c.split()[0]}`: {c.split(maxsplit=1)[1]}' for c in ('id int', 'start_ns bigint', 'end_ns bigint', 'text string'))}>>"


def struct(ddl: str) -> T.StructType:
    return T._parse_datatype_string(ddl)
