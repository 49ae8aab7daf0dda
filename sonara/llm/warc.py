"""WARC archives: writing with revisit records, reading with boundary-chain verification.

Writing: a record is a header, an empty line, the payload and two line ends, so a text table whose row separator is the
closing line ends is an archive, on any file system that Spark writes to. Records of equal payloads point to the first.

Reading: the archives are split anywhere. Each task cuts its split at the magic line and takes every occurrence as a
candidate record, whose header says where the next record must begin. Magic inside a payload makes false candidates. Inside
a split the candidates are followed from record to successor; what leaves the split is an edge between splits. Pointer
jumping over these edges (each round doubles the steps) from the start of each file tells which candidate each split is
entered at. From there the chain is followed again, and what it does not reach is payload.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sonara.llm.common import map_arrow, map_batches, new_path, remove, text_of, written

MAGIC = "WARC/1.0\r\n"
SEPARATOR = "\r\n\r\n"
#: Payloads of fewer bytes are always written in full.
LEAST_REVISIT_BYTES = 100
_CONTENT_LENGTH = re.compile(rb"\r\nContent-Length: (\d{1,15})\r\n", re.I)
#: Records of a file at most: about 1 GB of pages of 30 kB.
FILE_RECORDS = 32_768
#: The date of records whose rows have none, and the profile of revisits (fixed values).
DATE, PROFILE = "1970-01-01T00:00:00Z", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bits of the bitmap of shared payloads, as a power of two: 8 million bits.
FILTER_BITS = 23
#: Offsets are joined to records by ranges of so many bytes.
BIN_BYTES = 1 << 20


def revisits(rows: DataFrame, least: int = LEAST_REVISIT_BYTES) -> DataFrame:
    """(id, digest, refers_to) of the rows (id, digest, bytes) whose payload a row of a smaller id has too.

    Only ids and digests move. A payload that a third of all rows share is one row on the right of the join, so that
    join's left side may be split anywhere.
    """
    large = rows.filter((F.col("bytes") >= least) & F.col("id").isNotNull()).select("id", "digest")
    first = large.groupBy("digest").agg(F.min("id").alias("refers_to"), F.max("id").alias("last")).filter(F.col("refers_to") < F.col("last"))
    return large.join(first.drop("last"), "digest").filter(F.col("id") > F.col("refers_to")).select("id", "digest", "refers_to").distinct()


def shared_payloads(rows: DataFrame) -> DataFrame:
    """(bucket, bits): a bitmap of 2^FILTER_BITS bits over the hashes of the digests of rows (digest), in 4 kB buckets; so it
    has 1 MB at most, whatever the rows. A payload without its bit is shared by nobody."""
    slot = F.pmod(F.xxhash64("digest"), F.lit(1 << FILTER_BITS))
    bits = rows.select((slot / 32768).cast("int").alias("bucket"), (slot % 32768).alias("bit")).groupBy("bucket")
    return bits.agg(F.bitmap_construct_agg("bit").alias("bits"))


def _bit_of(digest: str) -> tuple[Column, Column]:
    """The bucket of a digest, and whether its bit is set in the column bits."""
    slot = F.pmod(F.xxhash64(digest), F.lit(1 << FILTER_BITS))
    byte = F.conv(F.hex(F.substr("bits", (F.floor((slot % 32768) / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return (slot / 32768).cast("int"), F.coalesce(F.getbit(byte, (slot % 8).cast("int")), F.lit(0)) == 1


def write_warc(df: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", compression: str = "none", file_records: int = FILE_RECORDS, date: str = DATE) -> None:
    """Writes a record for each row: response with the payload, or revisit of the smallest id with an equal payload.

    A null payload is empty; of a null url or id the record has no such field. Repeated rows make repeated records, whose
    record id is one, as it is made of page id and digest. Line ends in a url are percent-encoded. Columns besides the three
    are not read. Files hold `file_records` records at most. Without compression a reader may split them
    anywhere; with it ("gzip") each file is one split.

    Payloads that no other row may share, by a bitmap of bounded size, are written where they lie; only the others are dealt
    out to be joined with what they revisit.
    """
    rows = df.select(df[id_col].cast("bigint").alias("id"), df[url_col].cast("string").alias("url"), text_of(payload_col).alias("payload"))
    rows = rows.withColumns({"digest": F.sha2(F.col("payload").cast("binary"), 256), "bytes": F.octet_length("payload").cast("bigint")})
    again, _ = written(revisits(rows), "revisits")
    bits, _ = written(shared_payloads(again), "revisit-bits")
    bucket, is_set = _bit_of("digest")
    # bits has 256 rows of 4 kB at most, so its broadcast is bounded
    marked = rows.withColumn("bucket", bucket).join(F.broadcast(bits), "bucket", "left").withColumn("maybe", (F.col("bytes") >= LEAST_REVISIT_BYTES) & is_set).drop("bits", "bucket")
    alone = marked.filter(~F.col("maybe")).withColumn("refers_to", F.lit(None).cast("bigint"))
    joined = marked.filter("maybe").join(again, ["id", "digest"], "left").select(alone.columns)
    rows = alone.unionByName(joined)
    revisit = F.col("refers_to").isNotNull()
    body = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(name + ": "), value.cast("string"), F.lit("\r\n"))).otherwise(F.lit(""))
    of = lambda id_: F.md5(F.concat_ws("|", id_.cast("string"), "digest").cast("binary"))
    uuid = lambda h: F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-"), F.lit(">"))
    header = F.concat(
        F.lit(MAGIC),
        F.when(revisit, F.lit("WARC-Type: revisit\r\n")).otherwise(F.lit("WARC-Type: response\r\n")),
        line("WARC-Record-ID", uuid(of(F.col("id")))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")),
        line("WARC-Page-ID", F.col("id")),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", uuid(of(F.col("refers_to")))), line("WARC-Refers-To-Page-ID", F.col("refers_to")))).otherwise(F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        line("WARC-Payload-Length", F.col("bytes")),
        line("Content-Type", F.lit("text/html")),
        line("Content-Length", F.octet_length(body)),
        F.lit("\r\n"),
    )
    out = rows.select(F.concat(header, body).alias("value")).write.option("lineSep", SEPARATOR)
    out.option("maxRecordsPerFile", file_records).option("compression", compression).text(path)


def _candidate(chunk: bytes) -> tuple[int, int] | None:
    """(header bytes after the magic, content length) if the chunk begins like a record."""
    end = chunk.find(b"\r\n\r\n")
    length = _CONTENT_LENGTH.search(b"\r\n" + chunk[: end + 2]) if end >= 0 else None
    return (end + 4, int(length[1])) if length else None


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[str, int, int, bytes]]]:
    """(file, block, at, value) of the rows of each batch: at is the offset from where the split's first chunk begins."""
    at, key = 0, None
    for batch in batches:
        rows = []
        for file, block, value in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if (file, block) != key:
                key, at = (file, block), 0
            rows.append((file, block, at, value))
            at += len(value) + len(MAGIC)
        yield rows


def _scan(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, value): what lies between occurrences of the magic line, in order within each split."""
    return spark.read.option("lineSep", MAGIC).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, at, next, size, header, content_sha256): each chunk's place in its split.

    at and next are offsets from the split's first chunk; next is null where the chunk does not begin like a record.
    content_sha256 is set where the whole record lies in the chunk.
    """
    kinds = {"file": pa.string(), "block": pa.int64(), "at": pa.int64(), "next": pa.int64(), "size": pa.int64(), "header": pa.binary(), "content_sha256": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _placed(batches):
            rows = []
            for file, block, at, value in batch:
                found = _candidate(value) if block or at else None  # before the first magic line of a file is no record
                if found is None:
                    rows.append((file, block, at, None, len(value), None, None))
                else:
                    head, length = found
                    content = value[head : head + length]
                    whole = hashlib.sha256(content).hexdigest() if len(content) == length else None
                    rows.append((file, block, at, at + head + length + len(SEPARATOR) + len(MAGIC), len(value), value[:head], whole))
            yield pa.RecordBatch.from_pydict({k: pa.array([r[i] for r in rows], t) for i, (k, t) in enumerate(kinds.items())})

    return map_batches(_scan(spark, path), run, "file string, block bigint, at bigint, next bigint, size bigint, header binary, content_sha256 string")


def _leave(split: pd.DataFrame) -> pd.DataFrame:
    """Where the chain from each candidate leaves the split: successors lie behind, so one walk from the back will do."""
    split = split.sort_values("at")
    leave: dict[int, int] = {}
    for at, following in zip(split["at"].tolist()[::-1], split["next"].tolist()[::-1], strict=True):
        leave[at] = leave.get(following, following)
    return pd.DataFrame({"file": split["file"], "at": split["at"], "leave": split["at"].map(leave)})


def _walk(split: pd.DataFrame) -> pd.DataFrame:
    """The candidates that the chains from the split's entries reach."""
    split = split.sort_values("at")
    reached = set(split.loc[split["entry"], "at"].tolist())
    marks = []
    for at, following in zip(split["at"].tolist(), split["next"].tolist(), strict=True):
        marks.append(at in reached)
        if marks[-1]:
            reached.add(following)
    return split.loc[marks, ["file", "at"]]


def reachable(chain: DataFrame) -> DataFrame:
    """(file, at) of the candidates (file, block, at, next) on the chain from their file's start.

    A split's candidates are walked in one task; splits are bounded by Spark's reader. Between splits there is one edge
    for each place at which a chain may leave one, and each round of pointer jumping doubles the splits that are passed.
    """
    left = chain.groupBy("file", "block").applyInPandas(_leave, "file string, at bigint, leave bigint")
    edges, edges_at = written(left, "warc-edges")
    start = edges.filter(F.col("at") == len(MAGIC)).select("file", "at")
    doors = edges.select("file", F.col("leave").alias("at")).union(start).distinct()
    nodes, nodes_at = written(edges.join(doors, ["file", "at"]), "warc-jump")
    jump, jump_at = nodes, nodes_at
    reach, reach_at = written(start, "warc-reach")
    size = reach.count()
    while True:  # reach holds the first 2^k nodes of each file's chain, jump leads 2^k nodes on
        step = reach.join(jump, ["file", "at"]).select("file", F.col("leave").alias("at")).join(nodes.select("file", "at"), ["file", "at"], "left_semi")
        more, more_at = written(reach.union(step).distinct(), "warc-reach")
        further, further_at = written(jump.join(jump.select("file", F.col("at").alias("leave"), F.col("leave").alias("end")), ["file", "leave"]).select("file", "at", F.col("end").alias("leave")), "warc-jump")
        for old in (reach_at, jump_at):
            if old != nodes_at:
                remove(chain.sparkSession, old)
        grown = more.count()
        reach, reach_at, jump, jump_at = more, more_at, further, further_at
        if grown == size:
            break
        size = grown
    remove(chain.sparkSession, edges_at)
    marked = chain.join(reach.withColumn("entry", F.lit(True)), ["file", "at"], "left").select("file", "block", "at", "next", F.coalesce("entry", F.lit(False)).alias("entry"))
    return marked.groupBy("file", "block").applyInPandas(_walk, "file string, at bigint")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(file, offset, page_id, record_type, refers_to, payload_digest, payload_bytes, content_bytes, content_sha256) of the
    records on the chain from the start of each archive file at path.

    content_* are of the bytes that the record holds; the full payload's digest and length come from its header, and for
    a response they equal the content's. Where a chain breaks, the file's later records aren't returned; a file that does
    not begin with a record gives none.
    """
    chunks, _ = written(candidates(spark, path), "warc-chunks")
    # where each split's first chunk begins in its file: what the splits before hold (a row for each split)
    sizes = chunks.groupBy("file", "block").agg((F.sum("size") + len(MAGIC) * F.count("*")).alias("bytes"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases, _ = written(sizes.select("file", "block", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("base")), "warc-bases")
    place = lambda c: (F.col("base") + F.col(c)).alias(c)
    placed = chunks.filter(F.col("next").isNotNull()).join(bases, ["file", "block"]).select("file", "block", place("at"), place("next"), "header", "content_sha256")
    reached, _ = written(reachable(placed.select("file", "block", "at", "next")), "warc-reached")
    records = placed.join(reached, ["file", "at"])
    whole = records.filter(F.col("content_sha256").isNotNull()).select("file", "at", "header", "content_sha256")
    broken, broken_at = written(records.filter(F.col("content_sha256").isNull()).select("file", F.col("at").alias("start"), F.col("next").alias("stop")), "warc-broken")
    if broken.isEmpty():
        remove(spark, broken_at)
    else:
        whole = whole.unionByName(mended(spark, path, bases, broken))
    return whole.select("file", (F.col("at") - len(MAGIC)).alias("offset"), *_header_fields(), "content_sha256")


def mended(spark: SparkSession, path: str, bases: DataFrame, broken: DataFrame) -> DataFrame:
    """(file, at, header, content_sha256) of the records (file, start, stop) whose payload holds magic lines: their chunks
    are read again, found by ranges of the offset and joined in order."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _placed(batches):
            names = {"file": pa.string(), "block": pa.int64(), "at": pa.int64(), "value": pa.binary()}
            yield pa.RecordBatch.from_pydict({k: pa.array([r[i] for r in batch], t) for i, (k, t) in enumerate(names.items())})

    parts = map_batches(_scan(spark, path), places, "file string, block bigint, at bigint, value binary").join(bases, ["file", "block"])
    parts = parts.select("file", (F.col("base") + F.col("at")).alias("at"), "value").withColumn("bin", F.floor(F.col("at") / BIN_BYTES))
    bins = broken.withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / BIN_BYTES), F.floor(F.col("stop") / BIN_BYTES))))
    parts = parts.join(bins, ["file", "bin"]).filter((F.col("at") >= F.col("start")) & (F.col("at") < F.col("stop") - len(MAGIC)))
    joined = parts.groupBy("file", F.col("start").alias("at")).agg(F.array_sort(F.collect_list(F.struct(F.col("at").alias("k"), "value"))).alias("pieces"))

    def start() -> Callable[[pa.RecordBatch], Iterator[dict]]:
        def each(batch: pa.RecordBatch) -> Iterator[dict]:
            headers, digests = [], []
            for found in batch.column(2).to_pylist():
                record = MAGIC.encode().join(p["value"] for p in found)
                head, length = _candidate(record)
                headers.append(record[:head])
                digests.append(hashlib.sha256(record[head : head + length]).hexdigest())
            yield {"file": batch.column(0), "at": batch.column(1), "header": pa.array(headers, pa.binary()), "content_sha256": digests}

        return each

    return map_arrow(joined.select("file", "at", "pieces"), start, "file string, at bigint, header binary, content_sha256 string")


def _header_fields() -> list:
    text = F.concat(F.lit("\r\n"), F.col("header").cast("string"))

    def value(pattern: str) -> F.Column:
        found = F.regexp_extract(text, pattern, 1)
        return F.when(found != "", found)

    return [
        value(r"(?i)\r\nWARC-Page-ID: (-?\d+)\r\n").cast("bigint").alias("page_id"),
        value(r"(?i)\r\nWARC-Type: (\w+)\r\n").alias("record_type"),
        value(r"(?i)\r\nWARC-Refers-To-Page-ID: (-?\d+)\r\n").cast("bigint").alias("refers_to"),
        value(r"(?i)\r\nWARC-Payload-Digest: sha256:([0-9a-f]{64})\r\n").alias("payload_digest"),
        value(r"(?i)\r\nWARC-Payload-Length: (\d+)\r\n").cast("bigint").alias("payload_bytes"),
        value(r"(?i)\r\nContent-Length: (\d+)\r\n").cast("bigint").alias("content_bytes"),
    ]


def archive_digest(df: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to): df written as archives and read back.

    Of a response, bytes and digest are those of the content read; of a revisit, whose record has no content, those that
    its header gives for the full payload.
    """
    spark = df.sparkSession
    path = new_path(spark, "warc")
    write_warc(df, path)
    response = F.col("record_type") == "response"
    return read_warc(spark, path).select(
        "page_id",
        F.when(response, F.col("content_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(response, F.col("content_sha256")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )
