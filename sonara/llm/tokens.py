"""Token ids in binary shards compressed by a Re-Pair grammar, with random access by expansion lengths.

Rows are dealt by ranges of (id, hash of the text) and sorted, so shards follow one another in ascending id. Each task
encodes its rows, appends the end id to each and cuts shards at document ends. In a shard, frequent pairs of adjacent ids
are replaced by new ids (nonterminals) round by round until no pair occurs often. A shard stores the rules, each rule's
expansion length, the reduced sequence and the documents' lengths; a range of tokens is found by a search in the running
sum of expansion lengths and only its own symbols are expanded.

A round takes pairs by falling count, leaving out a pair whose first id is second in a pair taken before or the reverse.
Pairs of one round then never overlap, so each one's count is what it replaces, and all are replaced in one sweep. A pair
of two equal ids overlaps with itself: of a run of equal ids every other pair is replaced, in the same round as other pairs.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sonara.llm.bpe import PieceTable, gather, splits_at_spaces
from sonara.llm.common import map_arrow, map_batches, new_path, slices, text_of

MAGIC = b"RPG1"
#: Tokens of a shard, about; a longer document makes a shard of its own.
SHARD_TOKENS = 1 << 20
#: A pair is replaced while it occurs so often, and rounds go on while they shorten the sequence by this share.
LEAST_COUNT, LEAST_GAIN = 24, 0.01
#: ASCII bytes that are no white space, nor one of the separators that some libraries count as such.
_SOLID = np.isin(np.arange(256), [b for b in range(128) if b not in (*range(9, 14), *range(28, 33))])


def _round(seq: np.ndarray, least: int, made: int) -> tuple[np.ndarray, np.ndarray, int] | None:
    """The pairs to replace in this round, as packed keys in ascending order, the keys of all places, and the bits of a key's
    right half; None where no pair occurs often. All symbols are below `made`."""
    half = 16 if made <= 1 << 16 else 32
    kind = np.uint32 if half == 16 else np.uint64
    keys = seq[:-1].astype(kind) << kind(half) | seq[1:]
    ordered = np.sort(keys)
    starts = np.r_[0, np.flatnonzero(ordered[1:] != ordered[:-1]) + 1]
    counts = np.diff(np.r_[starts, len(ordered)])
    frequent = counts >= least
    if not frequent.any():
        return None
    pairs, counts = ordered[starts[frequent]], counts[frequent]
    order = np.lexsort((pairs, -counts))
    first, second, taken, low = set(), set(), [], (1 << half) - 1
    for key in pairs[order].tolist():
        a, b = key >> half, key & low
        if a in second or b in first:  # a pair of equal ids keeps other pairs with its id out, both ways
            continue
        first.add(a)
        second.add(b)
        taken.append(key)
    return np.sort(np.array(taken, dtype=kind)), keys, half


def repair(ids: np.ndarray, least: int = LEAST_COUNT, gain: float = LEAST_GAIN) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(first nonterminal, left and right of each rule, reduced sequence) of an array of ids."""
    base = int(ids.max()) + 1 if len(ids) else 0
    seq, left, right, made = ids.astype(np.uint32), [], [], base
    while len(seq) > 1:
        found = _round(seq, least, made)
        if found is None:
            break
        pairs, keys, half = found
        firsts, seconds = pairs >> pairs.dtype.type(half), pairs & pairs.dtype.type((1 << half) - 1)
        begins, ends = np.zeros(made, dtype=bool), np.zeros(made, dtype=bool)
        begins[firsts] = ends[seconds] = True  # few places of other pairs pass it, and they are sorted out next
        at = np.flatnonzero(begins.take(seq[:-1]) & ends.take(seq[1:]))
        keys = keys.take(at)
        rule = np.minimum(np.searchsorted(pairs, keys), len(pairs) - 1)
        hit = pairs[rule] == keys
        at, rule = at[hit], rule[hit]
        # only pairs of equal ids meet themselves: of a run every second one
        place = np.arange(len(at))
        start = np.maximum.accumulate(np.where(np.r_[False, at[1:] == at[:-1] + 1], 0, place))
        at, rule = at[(place - start) % 2 == 0], rule[(place - start) % 2 == 0]
        seq[at] = (made + rule).astype(np.uint32)
        keep = np.ones(len(seq), dtype=bool)
        keep[at + 1] = False
        left.append(firsts.astype(np.uint32))
        right.append(seconds.astype(np.uint32))
        made += len(pairs)
        before, seq = len(seq), seq.take(np.flatnonzero(keep))
        if before - len(seq) < gain * before:
            break
    empty = np.zeros(0, dtype=np.uint32)
    return base, np.concatenate([empty, *left]), np.concatenate([empty, *right]), seq


def expansion_lengths(base: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Of each rule. Rules name older ones only."""
    lengths = np.zeros(len(left), dtype=np.int64)
    known = 0
    while known < len(left):  # as many rules at once as rest on known ones
        ready = np.flatnonzero((left[known:] >= base + known) | (right[known:] >= base + known))
        end = known + int(ready[0]) if len(ready) else len(left)
        for side in (left, right):
            part = side[known:end].astype(np.int64) - base
            lengths[known:end] += np.where(part < 0, 1, lengths[np.maximum(part, 0)])
        known = end
    return lengths


class TokenShard:
    """A shard in memory: random access to its tokens."""

    def __init__(self, payload: bytes):
        if payload[:4] != MAGIC:
            raise ValueError("not a token shard")
        base, rules, symbols, docs = np.frombuffer(payload, dtype="<u8", count=4, offset=4).tolist()
        at, arrays = 36, []
        for count in (rules, rules, rules, symbols, docs):
            arrays.append(np.frombuffer(payload, dtype="<u4", count=count, offset=at))
            at += 4 * count
        self.base, self.expanded = base, None
        self.left, self.right, self.lengths, self.sequence, self.doc_lengths = arrays
        spans = np.ones(len(self.sequence), dtype=np.int64)
        rule = self.sequence >= base
        spans[rule] = self.lengths[self.sequence[rule] - base]
        self.ends = np.cumsum(spans)
        self.doc_ends = np.cumsum(self.doc_lengths, dtype=np.int64)

    def __len__(self) -> int:
        return int(self.ends[-1]) if len(self.ends) else 0

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """The ids that the symbols stand for. Many symbols go through the rules' own expansions, which are made once; of few
        the nonterminals are replaced by their pairs until none is left."""
        if len(symbols) > 4 * len(self.left) + 1000:
            rule = symbols >= self.base
            of = symbols[rule] - self.base
            spans = np.ones(len(symbols), dtype=np.int64)
            spans[rule] = self.lengths[of]
            start = np.empty(len(symbols), dtype=np.int64)
            if self.expanded is None:
                self.expanded = self._replace(np.arange(self.base, self.base + len(self.left), dtype=np.uint32))
            start[rule] = (np.cumsum(self.lengths, dtype=np.int64) - self.lengths)[of]
            plain = symbols[~rule]
            start[~rule] = len(self.expanded) + np.arange(len(plain))
            return gather(np.concatenate([self.expanded, plain]), start, spans)
        return self._replace(symbols)

    def _replace(self, symbols: np.ndarray) -> np.ndarray:
        while True:
            rule = symbols >= self.base
            if not rule.any():
                return symbols
            starts = np.cumsum(np.where(rule, 2, 1)) - np.where(rule, 2, 1)
            out = np.empty(int(starts[-1]) + (2 if rule[-1] else 1), dtype=np.uint32)
            out[starts[~rule]] = symbols[~rule]
            of = symbols[rule] - self.base
            out[starts[rule]], out[starts[rule] + 1] = self.left[of], self.right[of]
            symbols = out

    def tokens(self, start: int, stop: int) -> np.ndarray:
        """The ids at [start, stop); only the symbols that cover them are expanded."""
        start, stop = max(0, start), min(stop, len(self))
        if start >= stop:
            return np.zeros(0, dtype=np.uint32)
        first, last = np.searchsorted(self.ends, start, side="right"), np.searchsorted(self.ends, stop - 1, side="right")
        before = int(self.ends[first - 1]) if first else 0
        return self.expand(self.sequence[first : last + 1])[start - before : stop - before]

    def document(self, n: int) -> np.ndarray:
        """The ids of the shard's n-th document, with its end id."""
        end = int(self.doc_ends[n])
        return self.tokens(end - int(self.doc_lengths[n]), end)


def pack_shard(ids: np.ndarray, doc_lengths: list[int]) -> bytes:
    base, left, right, seq = repair(ids)
    lengths = expansion_lengths(base, left, right)
    head = np.array([base, len(left), len(seq), len(doc_lengths)], dtype="<u8").tobytes()
    return b"".join([MAGIC, head, *(np.asarray(x, dtype="<u4").tobytes() for x in (left, right, lengths, seq, doc_lengths))])


class LibraryEncoder:
    """Encodes with the tokenizers library. It gets each piece of text (see bpe.piece_starts) that is not known yet once.
    Pieces that begin with a single white space and end without one are parted from any neighbours there, others without
    white space at their ends are so after a line end; so many go in one string, whose ids are dealt to the pieces by their
    lengths in bytes."""

    def __init__(self, tokenizer_json: str):
        # a task has one core: threads of the library's own would only wait for each other
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.splits = splits_at_spaces(tokenizer_json)
        vocab = self.tokenizer.get_vocab()
        self.bytes = np.zeros(max(vocab.values()) + 1, dtype=np.int64)
        for token, i in vocab.items():  # a character of a token stands for a byte
            self.bytes[i] = len(token)
        for i, token in self.tokenizer.get_added_tokens_decoder().items():
            self.bytes[i] = len(token.content.encode())
        self.table = PieceTable(self._new, whole=not self.splits, specials=[t.content for t in self.tokenizer.get_added_tokens_decoder().values()])
        self.encode, self.encode_array = self.table.encode, self.table.encode_array

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _parted(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Of each piece, which isn't empty: whether it may be joined to others, and whether it begins with white space."""
        offsets, data = (np.frombuffer(x, dtype=t) for x, t in zip(texts.buffers()[1:], (np.int32, np.uint8), strict=True))
        starts, ends = offsets[texts.offset : texts.offset + len(texts)], offsets[texts.offset + 1 : texts.offset + len(texts) + 1]
        first, last = data[starts], data[ends - 1]
        spaced = (first == 32) | (first == 10)
        head = np.where(spaced, data.take(starts + 1, mode="clip"), first)
        # of characters of several bytes those that begin with C3 are no white space; others are left alone
        ended = _SOLID[last] | ((last >= 0x80) & (data.take(ends - 2, mode="clip") == 0xC3))
        return (_SOLID[head] | (head == 0xC3)) & ended & (ends - starts > spaced), spaced

    def _new(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        joins, spaced = self._parted(texts) if self.splits else (np.zeros(len(texts), dtype=bool), np.zeros(len(texts), dtype=bool))
        parts, lengths = [], np.zeros(len(texts), dtype=np.int64)
        alone = np.flatnonzero(~joins)
        for ids in self._ids(texts.take(pa.array(alone)).to_pylist()):
            parts.append(ids)
        lengths[alone] = np.fromiter(map(len, parts), dtype=np.int64, count=len(alone))
        joined = np.flatnonzero(joins)
        prefix = pa.array(["\n", ""], pa.string()).take(pa.array(spaced[joined].astype(np.int8)))
        lines = pc.binary_join_element_wise(prefix, texts.take(pa.array(joined)), "")
        _, offsets, data = lines.buffers()
        edges = np.frombuffer(offsets, dtype=np.int32, count=len(lines) + 1).astype(np.int64)
        cuts = [*range(0, len(joined), 2000), len(joined)] if len(joined) else [0]
        pages = [data[edges[a] : edges[b]].to_pybytes().decode() for a, b in itertools.pairwise(cuts)]
        for a, b, ids in zip(cuts[:-1], cuts[1:], self._ids(pages), strict=True):
            ends = np.searchsorted(np.cumsum(self.bytes[ids]), edges[a + 1 : b + 1] - edges[a]) + 1
            own = np.ones(len(ids), dtype=bool)
            own[np.r_[0, ends[:-1]][~spaced[joined[a:b]]]] = False  # the line end that was put before a piece
            lengths[joined[a:b]] = np.diff(np.r_[0, ends]) - ~spaced[joined[a:b]]
            parts.append(ids[own])
        order = np.argsort(np.r_[alone, joined])
        of = lengths[np.r_[alone, joined]]
        return gather(np.concatenate([np.zeros(0, dtype="<u4"), *parts]), (np.cumsum(of) - of)[order], lengths), lengths


_library: dict[str, LibraryEncoder] = {}


def library_encoder(tokenizer_json: str) -> LibraryEncoder:
    """One for each tokenizer in a Python worker, for all its tasks."""
    key = hashlib.sha256(tokenizer_json.encode()).hexdigest()
    if key not in _library:
        _library[key] = LibraryEncoder(tokenizer_json)
    return _library[key]


def write_shards(df: DataFrame, tokenizer_json: str, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, shard_tokens: int = SHARD_TOKENS) -> None:
    """Writes the shards of all rows, in ascending id (null first, then by the text's hash), as a table at path.

    One row holds one shard: part and seq (its place), ids (the documents' ids), n_tokens and payload. A null text is
    empty and has the end id only. Repeated rows are written as often as they come. No rows make an empty table. Columns
    besides the two are not read.
    """
    shared = df.sparkSession.sparkContext.broadcast(tokenizer_json)
    rows = df.select(df[id_col].cast("bigint").alias("id"), text_of(text_col).alias("text")).withColumn("h", F.xxhash64("text"))
    rows = rows.repartitionByRange("id", "h").sortWithinPartitions("id", "h").select("id", "text")
    end = np.array([end_id], dtype="<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = library_encoder(shared.value)
        part, seq, ids, held, size = TaskContext.get().partitionId(), 0, [], [], 0

        def shard() -> pa.RecordBatch:
            payload = pack_shard(np.concatenate(held), [len(x) + 1 for x in held[::2]])
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "ids": pa.array([ids], pa.list_(pa.int64())), "n_tokens": pa.array([size], pa.int64()), "payload": pa.array([payload], pa.binary())})

        for batch in batches:
            for piece in slices(batch):
                tokens, begins = coder.encode_array(piece.column(1))
                for i, a, b in zip(piece.column(0).to_pylist(), begins[:-1].tolist(), begins[1:].tolist(), strict=True):
                    n = b - a + 1
                    if held and size + n > shard_tokens:
                        yield shard()
                        ids, held, size, seq = [], [], 0, seq + 1
                    ids.append(i)
                    held += (tokens[a:b], end)
                    size += n
        if held:
            yield shard()

    out = map_batches(rows, run, "part int, seq int, ids array<bigint>, n_tokens bigint, payload binary")
    out.write.option("compression", "zstd").parquet(path)


def shard_starts(shards: DataFrame) -> DataFrame:
    """(part, seq, shard_start): ids in all shards before. Running sums in each part, and over one total for each part."""
    totals = shards.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    own = shards.select("part", "seq", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("within"))
    return own.join(totals, "part").select("part", "seq", (F.col("part_start") + F.col("within")).alias("shard_start"))


def read_shards(df: DataFrame, path: str, each: Callable[[np.ndarray], object], name: str, kind: pa.DataType, sql: str, id_col: str = "doc_id") -> DataFrame:
    """(id_col, start, n_tokens, name) per document of the shards at path, in which name is each(the document's ids)."""
    shards = df.sparkSession.read.schema("part int, seq int, ids array<bigint>, n_tokens bigint, payload binary").parquet(path)

    def start() -> Callable[[pa.RecordBatch], Iterator[dict]]:
        def read(batch: pa.RecordBatch) -> Iterator[dict]:
            for n in range(batch.num_rows):
                row = batch.slice(n, 1)
                shard = TokenShard(row.column(3)[0].as_py())
                tokens, ends = shard.tokens(0, len(shard)), shard.doc_ends
                starts = ends - shard.doc_lengths
                yield {
                    "part": pa.array([row.column(0)[0].as_py()] * len(ends), pa.int32()),
                    "seq": pa.array([row.column(1)[0].as_py()] * len(ends), pa.int32()),
                    "id": row.column(2)[0].values,
                    "within": pa.array(starts, pa.int64()),
                    "n_tokens": pa.array(shard.doc_lengths.astype(np.int64), pa.int64()),
                    name: pa.array([each(tokens[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], kind),
                }

        return read

    rows = map_arrow(shards.select("part", "seq", "ids", "payload"), start, f"part int, seq int, id bigint, within bigint, n_tokens bigint, {name} {sql}")
    joined = rows.join(shard_starts(shards.select("part", "seq", "n_tokens")), ["part", "seq"])
    return joined.select(F.col("id").alias(id_col), (F.col("shard_start") + F.col("within")).alias("start"), "n_tokens", name)


def token_digest(df: DataFrame, tokenizer_json: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): documents written as shards to the shared folder and read back."""
    path = new_path(df.sparkSession, "tokens")
    write_shards(df, tokenizer_json, path)
    return read_shards(df, path, lambda ids: zlib.crc32(ids.astype("<u4").tobytes()), "ids_crc32", pa.int64(), "bigint")
