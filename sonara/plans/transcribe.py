"""Batched and sequential transcription around a plug-in model.

Batched: windows of a recording are independent, so batches of the model are windows of any recordings. Sequential:
where the next window begins depends on what this one said, so a recording is one task's loop, and recordings run in
parallel.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonara.config import TranscribeConfig, batched_vad
from sonara.operators.attempts import Heard, acceptable, compression_ratio, control_silence
from sonara.operators.phrases import clean_phrases
from sonara.operators.regions import batch_windows, frame_regions, overlap_regions, pad_list
from sonara.operators.spectral import CHUNK_FRAMES, chunk_mel, log_mel, mel_window
from sonara.operators.tokens import MAX_TOKENS, Tokenizer, split_segments
from sonara.operators.words import Spoken, aligned_words, hand_out, ns
from sonara.plans.scoring import FrameScorer, SpeechModel, frame_rows, slide_scores, stepped
from sonara.schema import SAMPLE_RATE, WORD

SEGMENT = f"rec_id bigint, win bigint, seg int, language string, language_probability float, start_ns bigint, end_ns bigint, text string, tokens array<int>, words array<{WORD}>, temperature float, avg_logprob float, compression_ratio float, no_speech_prob float"
NAMES = [c.split()[0] for c in SEGMENT.split(", ")[:9]] + ["words", "temperature", "avg_logprob", "compression_ratio", "no_speech_prob"]
#: Segments that a task hands on at a time.
OUT_SEGMENTS = 200


def voice_scores(samples: np.ndarray, scorer: FrameScorer) -> list[float]:
    return stepped(scorer, scorer.start(), frame_rows(samples))[0]


def speech_windows(samples: np.ndarray, scorer, config: TranscribeConfig, backend: str) -> list[tuple[int, int]]:
    """Windows to decode: the clips, if given, else speech merged up to the chunk length."""
    if config.clips:
        return [(int(a * SAMPLE_RATE), int(b * SAMPLE_RATE)) for a, b in config.clips]
    vad = batched_vad(backend, config.chunk_length_s)
    found = frame_regions(voice_scores(samples, scorer), len(samples), vad) if backend == "frames" else overlap_regions(slide_scores(samples, scorer), len(samples), vad)
    return batch_windows(pad_list(found, int(vad.pad_ms * SAMPLE_RATE / 1000), len(samples)), len(samples), config.chunk_length_s)


def batched_plan(recordings: DataFrame, scorer: Callable[[], object], model: Callable[[], SpeechModel], tokenizer_json: str, config: TranscribeConfig = TranscribeConfig(), backend: str = "frames") -> DataFrame:
    """SEGMENT rows of rows (rec_id, pcm): voice activity, windows, features and decoding, in one pass; the samples go to Python once.

    The first temperature only, no context, no timestamps from the model and no silence gate, as in the published batched
    mode. The language is that of a recording's first window if it isn't given. A recording without windows has no rows.
    """
    rows = recordings.select(F.col("rec_id").cast("bigint").alias("rec_id"), F.col("pcm").cast("array<float>").alias("pcm"))

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        plug = scorer()
        for batch in batches:
            for rec, pcm in zip(batch["rec_id"], batch["pcm"], strict=True):
                samples = np.asarray(pcm if pcm is not None else [], dtype=np.float32)
                for k, (a, b) in enumerate(speech_windows(samples, plug, config, backend)):
                    stop = min(b, len(samples))
                    length = stop - a if config.clips else b - a
                    yield rec, k, a / SAMPLE_RATE, length / SAMPLE_RATE, samples[a : max(a, stop)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        plug, tokenizer = model(), Tokenizer.from_json(tokenizer_json)
        progress, found = None, []  # windows of a recording come one after another
        cut = windows(batches)
        while held := list(islice(cut, config.batch_size)):
            rows, progress = _decode_windows(pd.DataFrame(held, columns=["rec_id", "win", "offset", "duration", "pcm"]), plug, tokenizer, config, progress)
            found += rows
            if len(found) >= OUT_SEGMENTS:
                yield pd.DataFrame(found, columns=NAMES)
                found = []
        if found:
            yield pd.DataFrame(found, columns=NAMES)

    return rows.mapInPandas(run, SEGMENT)


@dataclass
class Progress:
    """What a recording's later windows need of the ones before."""

    language: tuple[str, float] | None = None
    last_speech: float = 0.0


def _decode_batch(batch: pd.DataFrame, model: SpeechModel, tokenizer: Tokenizer, config: TranscribeConfig, progress: Progress | None) -> tuple[pd.DataFrame, Progress]:
    """The batch's segments, and what the windows after it need."""
    rows, progress = _decode_windows(batch, model, tokenizer, config, progress)
    return pd.DataFrame(rows, columns=NAMES), progress


def _decode_windows(batch: pd.DataFrame, model: SpeechModel, tokenizer: Tokenizer, config: TranscribeConfig, progress: Progress | None) -> tuple[list[tuple], Progress]:
    """_decode_batch with rows as tuples."""
    mels = [chunk_mel(np.asarray(p, dtype=np.float32), model.n_mels) for p in batch["pcm"]]
    of, first = [], []
    for k, win in enumerate(batch["win"]):
        if win == 0 or progress is None:
            progress = Progress((config.language, 1.0) if config.language else None)
            first.append(k)
        of.append(progress)
    if first and not config.language:
        for k, language in zip(first, model.detect([mels[k] for k in first]), strict=True):
            of[k].language = language
    languages = [x.language for x in of]
    previous = tokenizer.encode(" " + config.initial_prompt.strip()) if config.initial_prompt else []
    prompts = [tokenizer.prompt(lang, config.task, previous, config.hotwords, None, False) for lang, _ in languages]
    temperature = config.temperatures[0]
    found = model.decode(mels, prompts, temperature, options(config, tokenizer, prompts[0]))
    rows = []
    for r, mel, (lang, probability), d, heard in zip(batch.itertuples(), mels, languages, found, of, strict=True):
        segments, _, _ = split_segments(d.tokens, tokenizer.time_begin, r.offset, math.ceil(r.duration) * 100, r.duration, 0)
        spoken = [Spoken(ns(a), ns(b), t) for a, b, t in segments]
        if config.word_timestamps:
            tokens = [t for s in spoken for t in s.tokens if t < tokenizer.eot]
            path = model.align([mel], tokenizer.start_sequence(lang, config.task), [tokens], [math.ceil(r.duration) * 100])[0]
            words = aligned_words(path.text_index, path.time_index, path.probabilities, tokens, tokenizer, lang)
            heard.last_speech = hand_out(spoken, words, tokenizer.eot, int(r.offset * 100), config.prepend_punctuations, config.append_punctuations, heard.last_speech)
        logprob = d.score * len(d.tokens) ** config.length_penalty / (len(d.tokens) + 1) if d.tokens else 0.0
        rows += _rows(r.rec_id, r.win, spoken, tokenizer, (lang, probability), temperature, logprob, d.no_speech)
    return rows, progress


def _rows(rec: int, win: int, spoken: list[Spoken], tokenizer: Tokenizer, language: tuple, temperature: float, logprob: float, no_speech: float) -> list[tuple]:
    """Segments with text and length, as rows."""
    out = []
    for k, s in enumerate(spoken):
        text = tokenizer.decode(s.tokens).strip()
        if text and s.start != s.end:
            words = [dict(zip(("start_ns", "end_ns", "word", "probability"), w, strict=True)) for w in s.words]
            out.append((rec, win, k, *language, s.start, s.end, text, s.tokens, words, temperature, logprob, compression_ratio(text), no_speech))
    return out


def options(config: TranscribeConfig, tokenizer: Tokenizer, prompt: list[int]) -> dict:
    """What a decoder is told besides its prompt."""
    room = MAX_TOKENS if config.max_new_tokens is None else min(MAX_TOKENS, len(prompt) + config.max_new_tokens)
    return {"max_length": room, "suppress": tokenizer.suppressed(config.suppress_tokens), "suppress_blank": config.suppress_blank, "beam_size": config.beam_size, "best_of": config.best_of, "patience": config.patience, "length_penalty": config.length_penalty, "repetition_penalty": config.repetition_penalty, "no_repeat_ngram_size": config.no_repeat_ngram_size, "max_initial_timestamp": 0 if config.without_timestamps else round(config.max_initial_timestamp / 0.02)}


def sequential_plan(recordings: DataFrame, scorer: Callable[[], object], model: Callable[[], SpeechModel], tokenizer_json: str, config: TranscribeConfig = TranscribeConfig()) -> DataFrame:
    """SEGMENT rows of rows (rec_id, pcm), each recording by one loop over its windows."""
    rows = recordings.select(F.col("rec_id").cast("bigint").alias("rec_id"), F.col("pcm").cast("array<float>").alias("pcm"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        voice, plug, tokenizer = scorer(), model(), Tokenizer.from_json(tokenizer_json)
        for batch in batches:
            for rec, pcm in zip(batch["rec_id"], batch["pcm"], strict=True):
                samples = np.asarray(pcm if pcm is not None else [], dtype=np.float32)
                found = transcribe(rec, samples, voice, plug, tokenizer, config)
                yield pd.DataFrame(found, columns=NAMES)

    return rows.mapInPandas(run, SEGMENT)


def transcribe(rec: int, samples: np.ndarray, voice: FrameScorer, model: SpeechModel, tokenizer: Tokenizer, config: TranscribeConfig) -> list[tuple]:
    """One recording: cut to speech if wanted, decoded window by window, and put back on its own time line."""
    regions = [(0, len(samples))]
    if config.vad_filter:
        found = frame_regions(voice_scores(samples, voice), len(samples), config.vad)
        regions = pad_list(found, int(config.vad.pad_ms * SAMPLE_RATE / 1000), len(samples))
        samples = np.concatenate([np.zeros(0, dtype=np.float32), *(samples[a:b] for a, b in regions)])
    if not len(samples):
        return []
    mel = log_mel(samples, model.n_mels, extra=160)
    content = len(samples) // 160
    language = (config.language, 1.0) if config.language else model.detect([mel_window(mel, 0)])[0]
    context = tokenizer.encode(" " + config.initial_prompt.strip()) if config.initial_prompt else []
    seek, win, last, out = 0, 0, 0.0, []
    while seek < content:
        size = min(CHUNK_FRAMES, content - seek)
        window = mel_window(mel[: seek + size], seek)
        spoken, onward, temperature, logprob, no_speech = _window(window, seek, size, content, context, last, language[0], model, tokenizer, config)
        out += _rows(rec, win, spoken, tokenizer, language, temperature, logprob, no_speech)
        last = spoken[-1].end / 1e9 if spoken else last
        context = context + [t for s in spoken for t in s.tokens]
        reset = config.prompt_reset_on_temperature
        if not config.condition_on_previous_text or (reset is not None and temperature > reset):
            context = []
        seek, win = max(onward, seek + 1), win + 1
    return [_restored(r, regions) for r in out] if config.vad_filter else out


def _window(mel: np.ndarray, seek: int, size: int, content: int, context: list[int], last: float, language: str | None, model: SpeechModel, tokenizer: Tokenizer, config: TranscribeConfig) -> tuple[list[Spoken], int, float, float, float]:
    """(segments, where to go on, temperature, mean log probability, no-speech probability) of one window."""
    prefix = config.prefix if seek == 0 else None
    prompt = tokenizer.prompt(language, config.task, context, config.hotwords, prefix, not config.without_timestamps)
    tried = []
    for temperature in config.temperatures:
        d = model.decode([mel], [prompt], temperature, options(config, tokenizer, prompt))[0]
        logprob = d.score * len(d.tokens) ** config.length_penalty / (len(d.tokens) + 1) if d.tokens else 0.0
        ratio = compression_ratio(tokenizer.decode(d.tokens).strip())
        tried.append((d, logprob, ratio, temperature))
        if acceptable(logprob, ratio, d.no_speech, config.compression_ratio_threshold, config.logprob_threshold, config.no_speech_threshold):
            chosen = tried[-1]
            break
    else:
        plain = [t for t in tried if not 0 < config.compression_ratio_threshold < t[2]]
        chosen = max(plain or tried, key=lambda t: t[1])
        chosen = (*chosen[:3], config.temperatures[-1])
    d, logprob, _, temperature = chosen
    if 0 < config.no_speech_threshold < d.no_speech and not logprob > config.logprob_threshold:
        return [], seek + size, temperature, logprob, d.no_speech
    segments, onward, lone = split_segments(d.tokens, tokenizer.time_begin, seek / 100, size, size / 100, seek)
    spoken = [Spoken(ns(a), ns(b), t) for a, b, t in segments]
    if config.word_timestamps:
        tokens = [t for s in spoken for t in s.tokens if t < tokenizer.eot]
        path = model.align([mel], tokenizer.start_sequence(language, config.task), [tokens], [size])[0]
        words = aligned_words(path.text_index, path.time_index, path.probabilities, tokens, tokenizer, language)
        hand_out(spoken, words, tokenizer.eot, seek, config.prepend_punctuations, config.append_punctuations, last)
        ends = [w[1] / 1e9 for s in spoken for w in s.words]
        if not lone and ends and ends[-1] > seek / 100:
            onward = int(ends[-1] * 100 + 0.5)
        if config.hallucination_silence_threshold:
            heard = [Heard(s.start / 1e9, s.end / 1e9, [(a / 1e9, b / 1e9, w, p) for a, b, w, p in s.words]) for s in spoken]
            stay, onward, skip = control_silence(heard, config.hallucination_silence_threshold, seek, onward, size / 100, content, last)
            spoken = [] if skip else spoken[: len(stay)]
    return spoken, onward, temperature, logprob, d.no_speech


def original_time(seconds: float, regions: list[tuple[int, int]]) -> float:
    """A time in the cut recording, on the recording's own line: the silence before the region it falls into is added."""
    at, cut = int(seconds * SAMPLE_RATE), 0
    for a, b in regions:
        cut += b - a
        if cut > at:
            break
    return seconds + (b - cut) / SAMPLE_RATE if regions else seconds


def _restored(row: tuple, regions: list[tuple[int, int]]) -> tuple:
    """Start and end go by themselves; a word's both ends go by its middle."""
    values = dict(zip(NAMES, row, strict=True))
    move = lambda t: ns(original_time(t / 1e9, regions))
    values["start_ns"], values["end_ns"] = move(row[5]), move(row[6])
    for w in values["words"]:
        middle = (w["start_ns"] + w["end_ns"]) / 2e9
        shift = original_time(middle, regions) - middle
        w["start_ns"], w["end_ns"] = ns(w["start_ns"] / 1e9 + shift), ns(w["end_ns"] / 1e9 + shift)
    return tuple(values[n] for n in NAMES)


def finish(segments: DataFrame, phrases: dict[str, list[str]] | None = None) -> DataFrame:
    """(rec_id, language, language_probability, text, segments) of SEGMENT rows: phrases out, numbered from 1, in order.

    A recording's segments meet in one row, which is what a transcript is.
    """
    segments = clean_phrases(segments, phrases or {})
    ordered = F.array_sort(F.collect_list(F.when(~F.col("dropped"), F.struct("win", "seg", "start_ns", "end_ns", "text", "words", "temperature", "avg_logprob", "compression_ratio", "no_speech_prob", "language", "language_probability"))))
    grouped = segments.groupBy("rec_id").agg(ordered.alias("s")).filter(F.size("s") > 0)
    numbered = F.transform("s", lambda x, i: F.struct((i + 1).alias("id"), x["start_ns"].alias("start_ns"), x["end_ns"].alias("end_ns"), x["text"].alias("text"), x["words"].alias("words"), x["temperature"].alias("temperature"), x["avg_logprob"].alias("avg_logprob"), x["compression_ratio"].alias("compression_ratio"), x["no_speech_prob"].alias("no_speech_prob")))
    first = F.element_at("s", 1)
    return grouped.select("rec_id", first["language"].alias("language"), first["language_probability"].alias("language_probability"), F.array_join(F.transform("s", lambda x: F.trim(x["text"])), " ").alias("text"), numbered.alias("segments"))
