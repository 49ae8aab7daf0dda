"""Plug-in points: voice scores, and the model that encodes, detects the language, decodes and aligns.

No weights come with this package. A plug-in is made once in each Python worker by a factory that travels with the plan;
the stubs here are deterministic and stand in for models in tests and examples.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonara.config import VadConfig
from sonara.operators.curves import hamming
from sonara.operators.regions import FRAME_STEP, WINDOW, greedy_windows, speech_regions
from sonara.schema import SAMPLE_RATE, SCORES

CONTEXT = 64
SLIDE, SLIDE_HOP, SLIDE_FRAMES = 80_000, 8_000, 293
#: Windows that are scored at a time, and rows of scores that a task hands on at a time.
STEPS, OUT_ROWS = 1000, 10_000


class FrameScorer(Protocol):
    """Scores windows of WINDOW samples one after another, with state of its own."""

    def start(self) -> object:
        """A fresh state."""

    def step(self, state: object, row: np.ndarray) -> tuple[float, object]:
        """The score of a row of CONTEXT + WINDOW samples, and the next state.

        A scorer may also have `steps(state, rows)`: the scores of many rows in order, and the state behind them."""


class SlideScorer(Protocol):
    """Scores windows of SLIDE samples, each by itself."""

    def scores(self, windows: np.ndarray) -> np.ndarray:
        """(windows, SLIDE_FRAMES, speakers) of (windows, SLIDE)."""


@dataclass
class Decoded:
    tokens: list[int]
    score: float = 0.0
    no_speech: float = 0.0


@dataclass
class Alignment:
    text_index: list[int] = field(default_factory=list)
    time_index: list[int] = field(default_factory=list)
    probabilities: list[float] = field(default_factory=list)


class SpeechModel(Protocol):
    """Everything neural about decoding. Batches are lists of (3000, n_mels) windows."""

    n_mels: int

    def detect(self, mels: list[np.ndarray]) -> list[tuple[str, float]]: ...

    def decode(self, mels: list[np.ndarray], prompts: list[list[int]], temperature: float, options: dict) -> list[Decoded]: ...

    def align(self, mels: list[np.ndarray], start: list[int], tokens: list[list[int]], frames: list[int]) -> list[Alignment]: ...


class EnergyScorer:
    """Stub: the root mean square of the window, as a score."""

    def __init__(self, full: float = 0.1):
        self.full = full

    def start(self) -> float:
        return 0.0

    def step(self, state: float, row: np.ndarray) -> tuple[float, float]:
        return min(1.0, float(np.sqrt(np.mean(np.square(row[CONTEXT:], dtype=np.float64)))) / self.full), state

    def steps(self, state: float, rows: np.ndarray) -> tuple[list[float], float]:
        level = np.sqrt(np.mean(np.square(rows[:, CONTEXT:], dtype=np.float64), axis=1)) / self.full
        return np.where(level < 1.0, level, 1.0).tolist(), state

    def scores(self, windows: np.ndarray) -> np.ndarray:
        edges = np.linspace(0, windows.shape[1], SLIDE_FRAMES + 1).astype(int)
        sums = np.concatenate([np.zeros((len(windows), 1)), np.cumsum(np.square(windows, dtype=np.float64), axis=1)], axis=1)
        mean = (sums[:, edges[1:]] - sums[:, edges[:-1]]) / np.diff(edges)
        level = np.minimum(1.0, np.sqrt(mean) / self.full)
        return np.stack([level, np.zeros_like(level), np.zeros_like(level)], axis=2)


def frame_rows(samples: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """(windows, CONTEXT + WINDOW): each window behind the end of the one before; the last is filled with zeros."""
    count = -(-len(samples) // WINDOW)
    if not count:
        return np.zeros((0, CONTEXT + WINDOW), dtype=np.float32)
    padded = np.zeros(CONTEXT + count * WINDOW, dtype=np.float32)
    if before is not None:
        padded[:CONTEXT] = before
    padded[CONTEXT : CONTEXT + len(samples)] = samples
    return np.lib.stride_tricks.sliding_window_view(padded, CONTEXT + WINDOW)[::WINDOW][:count]


def stepped(scorer: FrameScorer, state: object, rows: np.ndarray) -> tuple[list[float], object]:
    """The scores of rows in order and the state behind them, many rows at a time if the scorer can."""
    out: list[float] = []
    if not hasattr(scorer, "steps"):
        for row in rows:
            score, state = scorer.step(state, row)
            out.append(score)
        return out, state
    for at in range(0, len(rows), STEPS):
        found, state = scorer.steps(state, rows[at : at + STEPS])
        out += found
    return out, state


def _whole_scores(recordings: DataFrame, factory: Callable[[], FrameScorer]) -> DataFrame:
    """SCORES of rows (rec_id, pcm) that are recordings of their own, where they lie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = factory()
        for batch in batches:
            ids, counts, held = [], [], []
            for k in range(batch.num_rows):
                pcm = batch.column(1)[k]
                if pcm.is_valid and len(pcm.values):
                    found, _ = stepped(scorer, scorer.start(), frame_rows(pcm.values.to_numpy(zero_copy_only=False)))
                    ids.append(batch.column(0)[k].as_py())
                    counts.append(len(found))
                    held += found
                if held and (len(held) >= OUT_ROWS or k + 1 == batch.num_rows):
                    rec = pa.array(ids, pa.int64()).take(pa.array(np.repeat(np.arange(len(ids)), counts)))
                    idx = np.concatenate([np.arange(n) for n in counts])
                    yield pa.RecordBatch.from_pydict({"rec_id": rec, "idx": pa.array(idx, pa.int64()), "score": pa.array(np.array(held, dtype=np.float32))})
                    ids, counts, held = [], [], []

    return recordings.select(F.col("rec_id").cast("bigint"), F.col("pcm").cast("array<float>")).mapInArrow(run, SCORES)


def frame_scores(recordings: DataFrame, factory: Callable[[], FrameScorer]) -> DataFrame:
    """SCORES of RECORDINGS: one for each WINDOW samples, the state carried through each recording's parts in order. Without a column
    start_sample each row is a recording of its own, and nothing moves."""
    if "start_sample" not in recordings.columns:
        return _whole_scores(recordings, factory)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        scorer = factory()
        state, rest, context, out = scorer.start(), np.zeros(0, dtype=np.float32), np.zeros(CONTEXT, dtype=np.float32), []

        def take(samples: np.ndarray) -> None:
            nonlocal state, context
            found, state = stepped(scorer, state, frame_rows(samples, context))
            out.extend(found)
            if len(samples) >= WINDOW:
                context = samples[-CONTEXT:].copy()

        for pcm in group.sort_values("start_sample")["pcm"]:
            samples = np.concatenate([rest, np.asarray(pcm, dtype=np.float32)])
            whole = len(samples) // WINDOW * WINDOW
            take(samples[:whole])
            rest = samples[whole:]
        take(rest)
        return pd.DataFrame({"rec_id": group["rec_id"].iloc[0], "idx": range(len(out)), "score": np.array(out, dtype=np.float32)})

    return recordings.select("rec_id", "start_sample", "pcm").groupBy("rec_id").applyInPandas(run, SCORES)


def slide_scores(samples: np.ndarray, scorer: SlideScorer, batch: int = 32) -> np.ndarray:
    """One score for each FRAME_STEP seconds: windows SLIDE_HOP apart, the most active speaker's, averaged by Hamming
    weights. Full windows, and one that is filled with zeros if samples are left. A batch of windows is made at a time."""
    starts = list(range(0, max(0, len(samples) - SLIDE) + 1, SLIDE_HOP)) if len(samples) >= SLIDE else []
    if not len(samples):
        return np.zeros(0, dtype=np.float32)
    if not starts or starts[-1] + SLIDE < len(samples):
        starts.append(starts[-1] + SLIDE_HOP if starts else 0)
    weight = np.array(hamming(SLIDE_FRAMES))
    size = round(starts[-1] / SAMPLE_RATE / FRAME_STEP) + SLIDE_FRAMES + 1
    sums, weights = np.zeros(size), np.zeros(size)
    for at in range(0, len(starts), batch):
        part = starts[at : at + batch]
        windows = np.zeros((len(part), SLIDE), dtype=np.float32)
        for row, s in zip(windows, part, strict=True):
            row[: len(samples[s : s + SLIDE])] = samples[s : s + SLIDE]
        for s, active in zip(part, scorer.scores(windows).max(axis=2), strict=True):
            first = int(np.rint(s / SAMPLE_RATE / FRAME_STEP))
            sums[first : first + SLIDE_FRAMES] += active * weight
            weights[first : first + SLIDE_FRAMES] += weight
    frames = min(size, int(np.ceil(len(samples) / SAMPLE_RATE / FRAME_STEP)))
    return (sums / np.maximum(weights, 1e-12))[:frames].astype(np.float32)


def overlap_scores(recordings: DataFrame, factory: Callable[[], SlideScorer]) -> DataFrame:
    """SCORES of rows (rec_id, pcm), whole recordings; rows stay where they are."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = factory()
        for batch in batches:
            for rec, pcm in zip(batch["rec_id"], batch["pcm"], strict=True):
                scores = slide_scores(np.asarray(pcm if pcm is not None else [], dtype=np.float32), scorer)
                yield pd.DataFrame({"rec_id": rec, "idx": range(len(scores)), "score": scores})

    return recordings.select(F.col("rec_id").cast("bigint"), "pcm").mapInPandas(run, SCORES)


def recording_regions(recordings: DataFrame, factory: Callable[[], object], config: VadConfig = VadConfig(), backend: str = "frames") -> DataFrame:
    """REGIONS of RECORDINGS (rec_id, start_sample, pcm), for the overlapping backend of whole ones (rec_id, pcm): scored by the
    plug-in, then cut to regions. Recordings without samples have no rows."""
    part = F.col("start_sample") if "start_sample" in recordings.columns else F.lit(0)
    lengths = recordings.groupBy(F.col("rec_id").cast("bigint").alias("rec_id")).agg(F.max(part + F.coalesce(F.size("pcm"), F.lit(0))).cast("bigint").alias("n_samples"))
    scores = frame_scores(recordings.withColumn("start_sample", part.cast("bigint")), factory) if backend == "frames" else overlap_scores(recordings, factory)
    return speech_regions(scores, lengths, config, backend)


def recording_windows(recordings: DataFrame, factory: Callable[[], object], config: VadConfig = VadConfig(), backend: str = "frames", chunk_s: float = 30.0) -> DataFrame:
    """(rec_id, window, start, end): the regions merged into windows of up to chunk_s seconds. Unlike a plan's windows, a
    recording without speech has none, however short."""
    return greedy_windows(recording_regions(recordings, factory, config, backend), "rec_id", "start", "end", int(chunk_s * SAMPLE_RATE))
