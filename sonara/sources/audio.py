"""WAV and raw float audio. Spark lists files, tasks read byte ranges of them through Arrow's file systems, and write them."""

from __future__ import annotations

import io
import struct
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from sonara.schema import SAMPLE_RATE

#: Samples of one row: long recordings become several rows of 4 MB, never one huge one.
BLOCK = 1_000_000
#: Bytes of audio that a reading task goes through.
SPLIT = 128 << 20
#: Bytes of samples that a WAV file's 32-bit sizes allow.
WAV_MOST = (1 << 32) - 1 - 36


class WavError(ValueError):
    """The file is no 16 kHz mono 16-bit PCM WAV."""


def wav_layout(file: BinaryIO, length: int, permissive: bool = False) -> tuple[int, int]:
    """(place, bytes) of the samples of a WAV file of `length` bytes, of which only chunk headers are read. Strict: format fields
    must fit, chunks follow each other without padding, and the data must be whole. Permissive: formats aren't checked, odd
    chunks are padded, and a cut data chunk gives what is there."""
    head = file.read(12)
    if len(head) < 12 or head[:4] != b"RIFF" or head[8:] != b"WAVE":
        raise WavError("no RIFF/WAVE header")
    at, known = 12, permissive
    while at + 8 <= length:
        file.seek(at)
        name, size = struct.unpack("<4sI", file.read(8))
        at += 8
        if name == b"fmt " and not permissive:
            if size < 16 or at + 16 > length:
                raise WavError("short format chunk")
            kind, channels, rate, _, _, bits = struct.unpack("<HHIIHH", file.read(16))
            if (kind, channels, rate, bits) != (1, 1, SAMPLE_RATE, 16):
                raise WavError(f"PCM 1, mono, {SAMPLE_RATE} Hz, 16 bits wanted; found {kind}, {channels}, {rate}, {bits}")
            known = True
        elif name == b"data":
            if not known:
                raise WavError("data before format")
            if at + size > length and not permissive:
                raise WavError("data chunk is cut")
            return at, min(size, length - at)
        at += size + (size & 1 if permissive else 0)
    raise WavError("no data chunk")


def from_pcm16(body: bytes) -> np.ndarray:
    """Samples in [-1, 1); half a sample at the end is left out."""
    return np.frombuffer(body[: len(body) // 2 * 2], dtype="<i2").astype(np.float32) / np.float32(32768)


def to_pcm16(samples: np.ndarray) -> bytes:
    return (np.clip(np.asarray(samples, dtype=np.float64), -1, 32767 / 32768) * 32768).round().astype("<i2").tobytes()


def parse_wav(data: bytes, permissive: bool = False) -> np.ndarray:
    """Samples of a WAV file in memory; wav_layout has the rules."""
    at, size = wav_layout(io.BytesIO(data), len(data), permissive)
    return from_pcm16(data[at : at + size])


def wav_header(n_samples: int) -> bytes:
    size = 2 * n_samples
    if size > WAV_MOST:
        raise WavError(f"a WAV file holds {WAV_MOST // 2} samples at most")
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + size, b"WAVE", b"fmt ", 16, 1, 1, SAMPLE_RATE, 2 * SAMPLE_RATE, 2, 16, b"data", size)


def wav_bytes(samples: np.ndarray) -> bytes:
    """A WAV file of samples in [-1, 1]."""
    return wav_header(len(samples)) + to_pcm16(samples)


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path as Spark names it, and the path on it."""
    scheme, rest = path.split(":", 1) if "://" in path or path.startswith("file:") else ("file", path)
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    host, _, inner = rest.lstrip("/").partition("/")
    found, base = fs.FileSystem.from_uri(f"{ {'s3a': 's3', 's3n': 's3'}.get(scheme, scheme)}://{host}/")
    return found, f"{base.rstrip('/')}/{inner}"


@dataclass(frozen=True)
class Format:
    """How files of one kind hold samples: their names, the bytes of a sample, where samples lie, and samples from bytes."""

    pattern: str
    width: int
    layout: Callable[[BinaryIO, int], tuple[int, int]]
    decode: Callable[[bytes], np.ndarray]


def _f32_layout(file: BinaryIO, length: int) -> tuple[int, int]:
    if length % 4:
        raise ValueError("not a whole number of float values")
    return 0, length


def wav_format(mode: str) -> Format:
    if mode not in ("strict", "permissive"):
        raise ValueError("mode is strict or permissive")
    return Format("*.wav", 2, lambda file, length: wav_layout(file, length, mode == "permissive"), from_pcm16)


F32 = Format("*.f32", 4, _f32_layout, lambda body: np.frombuffer(body, dtype="<f4"))


def audio_files(spark: SparkSession, path: str, kind: Format, where: Column | None = None) -> DataFrame:
    """(path, length, data_at, n_samples, error) of the files under path. Spark lists them, tasks read the headers; `where`, on
    path, length or modificationTime, leaves files out before they are opened. A file that can't be read has its error; files of no bytes are left out, as Spark
    lists none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, length in zip(batch["path"], batch["length"], strict=True):
                system, inner = filesystem(name)
                with system.open_input_file(inner) as file:
                    try:
                        at, size = kind.layout(file, length)
                        rows.append((name, length, at, size // kind.width, None))
                    except ValueError as e:
                        rows.append((name, length, 0, 0, str(e)))
            yield pd.DataFrame(rows, columns=["path", "length", "data_at", "n_samples", "error"])

    return _listed(spark, path, kind, where).select("path", "length").mapInPandas(run, "path string, length bigint, data_at bigint, n_samples bigint, error string")


def _listed(spark: SparkSession, path: str, kind: Format, where: Column | None) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", kind.pattern).option("recursiveFileLookup", "true").load(path)
    return files if where is None else files.filter(where)


def _read(spark: SparkSession, path: str, kind: Format, block: int, where: Column | None) -> DataFrame:
    """Blocks are byte ranges, dealt out over all tasks, so a file of any size is read by many, a block at a time. The listing
    says how many tasks there are: one for SPLIT bytes."""
    total = _listed(spark, path, kind, where).agg(F.sum("length")).first()[0] or 0
    parts = F.sequence(F.lit(0).cast("bigint"), F.floor(F.greatest(F.col("n_samples") - 1, F.lit(0)) / block).cast("bigint"))
    ranges = audio_files(spark, path, kind, where).withColumn("part", F.explode(parts)).repartition(max(1, -(-total // SPLIT)), "path", "part")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, rows in batch.groupby("path", sort=False):
                system, inner = filesystem(name)
                with system.open_input_file(inner) as file:
                    for r in rows.sort_values("part").itertuples(index=False):
                        start = r.part * block
                        here = min(block, r.n_samples - start)
                        file.seek(r.data_at + start * kind.width)
                        body = file.read(here * kind.width)
                        if len(body) < here * kind.width:
                            raise OSError(f"{name} is shorter than when its header was read")
                        yield pd.DataFrame({"path": [name], "part": [r.part], "start_sample": [start], "n_samples": [r.n_samples], "pcm": [kind.decode(body)], "error": [r.error]})

    return ranges.mapInPandas(run, "path string, part int, start_sample bigint, n_samples bigint, pcm array<float>, error string")


def read_wav(spark: SparkSession, path: str, mode: str = "strict", block: int = BLOCK, where: Column | None = None) -> DataFrame:
    """(path, part, start_sample, n_samples, pcm, error) of the WAV files under path; a file that can't be read has one row
    with its error and no samples."""
    return _read(spark, path, wav_format(mode), block, where)


def read_f32(spark: SparkSession, path: str, block: int = BLOCK, where: Column | None = None) -> DataFrame:
    """The same of raw little-endian float files; a trailing part of a value is an error."""
    return _read(spark, path, F32, block, where)


@dataclass
class Written(WriterCommitMessage):
    """Files of one task: names while they are written, and those they get once all tasks are done."""

    files: list[tuple[str, str]]


class RecordingWriter(DataSourceArrowWriter):
    """Streams rows sorted by (name, start) into a file for each name. What an attempt wrote is seen only after the commit."""

    def __init__(self, path: str, kind: str):
        self.path, self.kind = path, kind

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, folder = filesystem(self.path)
        system.create_dir(folder, recursive=True)
        done, out, name, at, total = [], None, None, 0, 0
        for batch in iterator:
            for k in range(batch.num_rows):
                called, start, n, pcm = (batch.column(i)[k] for i in range(4))
                if n.is_valid:
                    if out is not None:
                        self._close(out, total - at)
                    name, at, total = called.as_py(), 0, n.as_py()
                    head = wav_header(total) if self.kind == "wav" else b""
                    hidden = f"{folder}/.{name}.{uuid.uuid4().hex}"
                    done.append((hidden, f"{folder}/{name}.{self.kind}"))
                    out = system.open_output_stream(hidden)
                    out.write(head)
                elif pcm.is_valid and len(pcm.values):
                    self._silence(out, start.as_py() - at)
                    at = max(at, start.as_py())
                    fresh = pcm.values.to_numpy(zero_copy_only=False)[at - start.as_py() :]
                    out.write(self._encoded(fresh))
                    at += len(fresh)
        if out is not None:
            self._close(out, total - at)
        return Written(done)

    def _encoded(self, samples: np.ndarray) -> bytes:
        return to_pcm16(samples) if self.kind == "wav" else samples.astype("<f4").tobytes()

    def _silence(self, out: pa.NativeFile, n: int) -> None:
        for at in range(0, n, BLOCK):
            out.write(self._encoded(np.zeros(min(BLOCK, n - at), dtype=np.float32)))

    def _close(self, out: pa.NativeFile, missing: int) -> None:
        self._silence(out, missing)
        out.close()

    def commit(self, messages: list[Written | None]) -> None:
        system = filesystem(self.path)[0]
        for hidden, name in (f for m in messages if m for f in m.files):
            system.move(hidden, name)

    def abort(self, messages: list[Written | None]) -> None:
        system = filesystem(self.path)[0]
        for hidden, _ in (f for m in messages if m for f in m.files):
            system.delete_file(hidden)


class RecordingSink(DataSource):
    """Sink `recordings` with the options path and kind."""

    @classmethod
    def name(cls) -> str:
        return "recordings"

    def writer(self, schema: StructType, overwrite: bool) -> RecordingWriter:
        return RecordingWriter(self.options["path"], self.options["kind"])


def write_recordings(blocks: DataFrame, path: str, key: str = "rec_id", kind: str = "wav") -> None:
    """A file for each recording of rows (key, start_sample, pcm), named by its key; kind is wav (16 bits, 4 GB at most) or f32.

    Blocks of a file move to one task, which streams through them in order and holds one Arrow batch. Gaps are silence; where
    rows overlap, the first by place holds, so repeated rows change nothing. Null keys and null or empty samples write
    nothing; a key's bytes that a file name can't have are written as in a URL. Files of the same name are replaced. Files get
    their names when all tasks are done; what a lost task began keeps a hidden name.
    """
    if kind not in ("wav", "f32"):
        raise ValueError("kind is wav or f32")
    rows = blocks.filter(F.col(key).isNotNull() & (F.size("pcm") > 0)).select(F.url_encode(F.col(key).cast("string")).alias("name"), F.col("start_sample").cast("bigint").alias("start"), F.lit(None).cast("bigint").alias("n"), F.col("pcm").cast("array<float>").alias("pcm"))
    sizes = rows.groupBy("name").agg(F.max(F.col("start") + F.size("pcm")).alias("n")).select("name", F.lit(-1).cast("bigint").alias("start"), "n", F.lit(None).cast("array<float>").alias("pcm"))
    spark = blocks.sparkSession
    spark.dataSource.register(RecordingSink)
    ordered = rows.unionByName(sizes).repartition("name").sortWithinPartitions("name", F.col("n").isNull(), "start", "pcm")
    ordered.write.format("recordings").option("path", path).option("kind", kind).mode("append").save()


def whole_recordings(parts: DataFrame, key: str = "path") -> DataFrame:
    """(key, pcm): a recording's parts joined in order, for steps that need all of a short recording at once."""
    ordered = F.array_sort(F.collect_list(F.struct("part", "pcm")))
    return parts.groupBy(key).agg(F.flatten(F.transform(ordered, lambda p: p["pcm"])).alias("pcm"))
