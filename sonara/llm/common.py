"""What the operators share: the shared folder, cut lineage, Arrow iteration and a word pattern."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonara.deploy import ship

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Texts become Python strings in slices of about this many bytes.
CHUNK_BYTES = 8_000_000
#: Rows and bytes of an Arrow batch: whichever is reached first, so a batch of long texts stays small in memory too.
ARROW_ROWS, ARROW_BYTES = "2000", "16m"


def prepare(spark: SparkSession) -> None:
    """Sends the package to the executors and sets the size of Arrow batches, which bounds a Python worker's memory;
    queries and the pipeline's stages call this."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where that is unset a new one on this machine, for
    a local master (tests) only: on a cluster executors would not see each other's files there."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = getattr(shared_dir, "own", None)
        if folder is None:
            folder = shared_dir.own = "file://" + tempfile.mkdtemp(prefix="shared-")
    return f"{folder.rstrip('/')}/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table of the shared folder, whatever file system holds it."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def tidy(spark: SparkSession, *paths: str) -> None:
    """Deletes tables of finished steps, and has the driver drop what it keeps of these steps, upon which Spark deletes their
    shuffle files; without that both lie on disk until the application happens to collect its garbage."""
    for path in paths:
        remove(spark, path)
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def clear(spark: SparkSession) -> None:
    """Deletes all tables that this application has left in the shared folder; results that read them have to be read before."""
    remove(spark, shared_dir(spark))


def written(df: DataFrame, label: str, codec: str = "zstd") -> tuple[DataFrame, str]:
    """df as a table of the shared folder, read again: no lineage that a lost executor could make run anew."""
    spark, path = df.sparkSession, new_path(df.sparkSession, label)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def map_arrow(df: DataFrame, start: Callable[[], Callable[[pa.RecordBatch], Iterator[dict]]], schema: str) -> DataFrame:
    """mapInArrow where start() makes, once in each task, the function from a batch to dicts of columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = start()
        for batch in batches:
            for columns in each(batch):
                yield pa.RecordBatch.from_pydict(columns)

    return map_batches(df, run, schema)


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow of a task's batches, after which the worker hands its freed memory back."""

    def run_and_give_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return df.mapInArrow(run_and_give_back, schema)


def give_back() -> None:
    """Hands memory that a task has freed back to the system; a worker lives on for other tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def slices(batch: pa.RecordBatch, text: int = 1, size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about so many bytes of text each; a longer text is a slice of its own."""
    held = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        before = held[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(held, before + size, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def pieces(batch: pa.RecordBatch, text: int = 1, size: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """The same with the texts of each slice, of which no more are Python strings at a time; null is the empty text."""
    for part in slices(batch, text, size):
        yield part, [t or "" for t in part.column(text).to_pylist()]


def text_of(column: str) -> F.Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))
