"""Short-time spectra and mel features, of recordings in blocks of any size."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonara.operators.scan import read
from sonara.schema import SAMPLE_RATE

FFT, HOP, BINS = 400, 160, 201
CHUNK_FRAMES = 3000
#: Frames that are transformed at a time.
SLAB = 64


@cache
def hann(n: int = FFT) -> np.ndarray:
    """0.5 (1 - cos(2 pi i / n)): periodic."""
    return 0.5 * (1 - np.cos(2 * np.pi * np.arange(n) / n))


def framed(samples: np.ndarray, extra: int = 0) -> np.ndarray:
    """Frames of FFT samples, HOP apart, of the samples mirrored by half a frame at both ends; extra zeros come first on
    the right. n samples give n // HOP + 1 frames."""
    x = np.concatenate([np.asarray(samples, dtype=np.float64), np.zeros(extra)])
    if len(x) == 0:
        return np.zeros((0, FFT))
    half = FFT // 2
    x = np.pad(x, half, mode="reflect") if len(x) > 1 else np.pad(x, half, mode="edge")
    return np.lib.stride_tricks.sliding_window_view(x, FFT)[::HOP]


def _slabs(frames: np.ndarray, shape: Callable[[np.ndarray], np.ndarray]) -> list[np.ndarray]:
    """shape(power) of SLAB frames at a time, so that what lies between stays in the cache; zeros need no transform."""
    out = []
    for at in range(0, len(frames), SLAB):
        part = frames[at : at + SLAB] * hann()
        silent = shape(np.zeros((1, BINS))).repeat(len(part), axis=0) if not part.any() else None
        out.append(shape(np.abs(np.fft.rfft(part, axis=1)) ** 2) if silent is None else silent)
    return out


def power_spectrum(samples: np.ndarray, extra: int = 0) -> np.ndarray:
    """(frames, BINS): squared magnitudes."""
    return np.concatenate([np.zeros((0, BINS)), *_slabs(framed(samples, extra), lambda power: power)])


def hz_to_mel(hz: np.ndarray) -> np.ndarray:
    """Slaney's scale: linear below 1000 Hz, logarithmic above."""
    hz = np.asarray(hz, dtype=np.float64)
    return np.where(hz < 1000, hz * 3 / 200, 15 + np.log(np.maximum(hz, 1e-9) / 1000) * 27 / np.log(6.4))


def mel_to_hz(mel: np.ndarray) -> np.ndarray:
    mel = np.asarray(mel, dtype=np.float64)
    return np.where(mel < 15, mel * 200 / 3, 1000 * np.exp((mel - 15) * np.log(6.4) / 27))


@cache
def mel_filters(n_mels: int = 80) -> np.ndarray:
    """(n_mels, BINS) triangles of equal area between points evenly spaced on the mel scale."""
    points = mel_to_hz(np.linspace(0, hz_to_mel(SAMPLE_RATE / 2), n_mels + 2))
    bins = np.linspace(0, SAMPLE_RATE / 2, BINS)
    width = np.diff(points)
    rise = (bins[None, :] - points[:-2, None]) / width[:-1, None]
    fall = (points[2:, None] - bins[None, :]) / width[1:, None]
    return np.maximum(0, np.minimum(rise, fall)) * (2 / (points[2:] - points[:-2]))[:, None]


def log_mel(samples: np.ndarray, n_mels: int = 80, extra: int = 0) -> np.ndarray:
    """(frames, n_mels): log10, no more than 8 under the highest value, then (v + 4) / 4. The last frame is left out."""
    filters = mel_filters(n_mels).T
    frames = framed(samples, extra)[:-1] if len(samples) else ()
    mel = np.concatenate([np.zeros((0, n_mels)), *_slabs(frames, lambda power: np.log10(np.maximum(power @ filters, 1e-10)))])
    return ((np.maximum(mel, mel.max() - 8) + 4) / 4).astype(np.float32) if len(mel) else mel.astype(np.float32)


def mel_window(mel: np.ndarray, seek: int, frames: int = CHUNK_FRAMES) -> np.ndarray:
    """Frames from seek on, zeros behind the last, always so many."""
    out = np.zeros((frames, mel.shape[1]), dtype=np.float32)
    part = mel[seek : seek + frames]
    out[: len(part)] = part
    return out


def chunk_mel(samples: np.ndarray, n_mels: int = 80) -> np.ndarray:
    return mel_window(log_mel(samples, n_mels, extra=HOP), 0)


#: Frames that a task transforms at a time: a minute of sound.
GROUP = 6000
#: Samples that a group of frames needs of its neighbours: half a frame, and what is mirrored at the end.
HALO = 240


def _grouped(recordings: DataFrame, group: int, extra: int) -> DataFrame:
    """(rec_id, group, start, pcm, n): each group of frames with all samples that its frames see, in pieces, and a row with its
    recording's length n. Blocks are cut where they lie, so each sample moves once, those of a halo twice."""
    if group * HOP < FFT + HALO:
        raise ValueError("a group is too short for its halo")
    rows = recordings.select("rec_id", F.col("start_sample").cast("bigint").alias("s"), F.col("pcm").cast("array<float>").alias("pcm")).filter(F.size("pcm") > 0).withColumn("e", F.col("s") + F.size("pcm"))
    span = group * HOP
    which = lambda sample: F.floor(F.greatest(sample, F.lit(0)) / F.lit(span)).cast("bigint")
    pieces = rows.select("*", F.explode(F.sequence(which(F.col("s") - HALO), which(F.col("e") - 1 + HALO))).alias("group"))
    first, after = F.greatest("s", F.col("group") * span - HALO), F.least("e", (F.col("group") + 1) * span + HALO)
    cut = F.slice("pcm", (first - F.col("s") + 1).cast("int"), (after - first).cast("int"))
    pieces = pieces.select("rec_id", "group", first.alias("start"), cut.alias("pcm"), F.lit(None).cast("bigint").alias("n"))
    sizes = rows.groupBy("rec_id").agg(F.max("e").alias("n"))
    groups = F.explode(F.sequence(F.lit(0).cast("bigint"), which(F.col("n") + extra)))
    return pieces.unionByName(sizes.select("rec_id", groups.alias("group"), F.lit(0).cast("bigint").alias("start"), F.lit(None).cast("array<float>").alias("pcm"), "n"))


def spectral_frames(recordings: DataFrame, shape: Callable[[np.ndarray], np.ndarray], group: int = GROUP, extra: int = 0, last: bool = True) -> DataFrame:
    """(rec_id, frame, values): shape(power spectra), frame by frame, of recordings in rows (rec_id, start_sample, pcm).

    Frames are those of the whole recording with `extra` zeros behind it, mirrored at both ends, however it is cut in blocks;
    `last` says whether the last frame counts. A task holds one group's samples. Samples that no row has are silence, of
    rows that overlap the one that starts later holds (of equal starts the longer, then the greater one), null and empty
    rows count for nothing, and a null key is a key.
    """
    kind = dict(recordings.dtypes)["rec_id"]

    def run(key: tuple, pieces: pd.DataFrame) -> pd.DataFrame:
        named = pieces["n"].dropna()
        total = int(named.iloc[0]) + extra if len(named) else 0
        lo = int(key[1]) * group
        hi = min(lo + group, total // HOP + last)
        if hi <= lo or not total:
            return pd.DataFrame([], columns=["rec_id", "frame", "values"])
        base, stop = max(0, lo * HOP - HALO), min(total, hi * HOP + HALO)
        held = np.zeros(stop - base)
        parts = [(int(s), len(x), x) for s, x in zip(pieces["start"], pieces["pcm"], strict=True) if x is not None]
        for start, n, x in sorted(parts, key=lambda p: (p[0], p[1], p[2].tobytes())):
            a, b = max(start, base), min(start + n, stop)
            if a < b:
                held[a - base : b - base] = x[a - start : b - start]
        at, period = np.abs(np.arange(lo * HOP - FFT // 2, (hi - 1) * HOP + FFT // 2)), max(1, 2 * (total - 1))
        at %= period
        at = np.where(at >= total, period - at, at)
        frames = np.lib.stride_tricks.sliding_window_view(held[at - base], FFT)[::HOP]
        values = shape(np.abs(np.fft.rfft(frames * hann(), axis=1)) ** 2)
        return pd.DataFrame({"rec_id": [None if pd.isna(key[0]) else key[0]] * len(values), "frame": range(lo, hi), "values": list(values)})

    return _grouped(recordings, group, extra).groupBy("rec_id", "group").applyInPandas(run, f"rec_id {kind}, frame bigint, values array<double>")


def _rows_frames(recordings: DataFrame, shape: Callable[[np.ndarray], np.ndarray], kind: str = "double") -> DataFrame:
    """(rec_id, frame, values): shape(samples) of rows (rec_id, pcm), where they lie; kind is that of the values."""
    of = np.float32 if kind == "float" else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                pcm = batch.column(1)[k]
                values = shape(pcm.values.to_numpy(zero_copy_only=False)) if pcm.is_valid and len(pcm.values) else ()
                for at in range(0, len(values), 1000):
                    part = values[at : at + 1000].astype(of)
                    lists = pa.ListArray.from_arrays(pa.array(range(0, part.size + 1, part.shape[1]), pa.int32()), pa.array(part.ravel()))
                    rec = batch.column(0).take(pa.array(np.full(len(part), k)))
                    yield pa.RecordBatch.from_pydict({"rec_id": rec, "frame": pa.array(range(at, at + len(part)), pa.int64()), "values": lists})

    return recordings.select("rec_id", F.col("pcm").cast("array<float>")).mapInArrow(run, f"rec_id {dict(recordings.dtypes)['rec_id']}, frame bigint, values array<{kind}>")


def mel_frames(recordings: DataFrame, n_mels: int = 80, group: int = GROUP, extra: int = 0, values: str = "float") -> DataFrame:
    """(rec_id, frame, mel) of rows as spectral_frames takes them: log10 of the energies in n_mels bands, no more than 8 under the
    recording's highest, then (v + 4) / 4. The last frame is left out.

    Each group's levels move once; the highest, a row for each recording, is taken from the same exchange. Without a column
    start_sample each row is a recording of its own, and nothing moves.
    """
    if "start_sample" not in recordings.columns:
        whole = _rows_frames(recordings, lambda x: log_mel(x, n_mels, extra), "float")  # as log_mel gives them
        return whole.select("rec_id", "frame", F.col("values").cast(f"array<{values}>").alias("mel"))

    def bands(power: np.ndarray) -> np.ndarray:
        return np.log10(np.maximum(power @ mel_filters(n_mels).T, 1e-10))

    levels = spectral_frames(recordings, bands, group, extra, last=False).repartition("rec_id", "frame")
    tops = levels.groupBy(F.col("rec_id").alias("_rec")).agg(F.max(F.array_max("values")).alias("top"), read(levels)).filter(F.col("_read").isNotNull())
    scaled = F.transform("values", lambda v: (F.greatest(v, F.col("top") - 8) + 4) / 4)
    return levels.join(tops, levels["rec_id"].eqNullSafe(tops["_rec"])).select("rec_id", "frame", scaled.cast(f"array<{values}>").alias("mel"))


def power_frames(recordings: DataFrame, group: int = GROUP, extra: int = 0) -> DataFrame:
    """(rec_id, frame, power) of rows as spectral_frames takes them, or of rows that are recordings of their own; the last frame is
    included."""
    if "start_sample" not in recordings.columns:
        return _rows_frames(recordings, lambda x: power_spectrum(x, extra)).withColumnRenamed("values", "power")
    return spectral_frames(recordings, lambda power: power, group, extra).withColumnRenamed("values", "power")


def dft_power(df: DataFrame, key: str, signal: str, n: int, windowed: bool = False) -> DataFrame:
    """(key, bin, power) of short signals of n values: one transform for each Arrow batch. A signal of another length is cut
    or filled with zeros; a null one has no rows."""
    shape = hann(n) if windowed else np.ones(n)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch[batch["signal"].notna()]
            if len(batch):
                rows = np.stack([np.pad(np.asarray(x, dtype=np.float64)[:n], (0, max(0, n - len(x)))) for x in batch["signal"]])
                power = np.abs(np.fft.rfft(rows * shape, axis=1)) ** 2
                yield pd.DataFrame({"key": np.repeat(batch["key"].to_numpy(), power.shape[1]), "bin": np.tile(np.arange(power.shape[1]), len(batch)), "power": power.ravel()})

    rows = df.select(F.col(key).alias("key"), F.col(signal).alias("signal"))
    return rows.mapInPandas(run, f"key {dict(rows.dtypes)['key']}, bin bigint, power double").withColumnRenamed("key", key)


def project_bands(power: DataFrame, key: str, filters: DataFrame) -> DataFrame:
    """(key, band, energy) of (key, bin, power) and a sparse filter table (band, bin, weight) of fixed size."""
    return power.join(F.broadcast(filters), "bin").groupBy(key, "band").agg(F.sum(F.col("power") * F.col("weight")).alias("energy"))


def log_floor(df: DataFrame, key: str, energy: str, least: float = 1e-10, room: float = 8.0) -> DataFrame:
    """energy as log10, no more than `room` under the key's highest, then (v + 4) / 4."""
    logged = df.withColumn("level", F.log10(F.greatest(F.col(energy), F.lit(least))))
    top = logged.groupBy(key).agg(F.max("level").alias("top"))
    return logged.join(top, key).withColumn("level", (F.greatest("level", F.col("top") - room) + 4) / 4).drop("top")
