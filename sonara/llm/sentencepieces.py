"""SentencePiece BPE that keeps each piece's place in the original bytes.

Texts are normalised by the longest rule of the model's compiled character map that fits at each place; every normalised
byte records the original byte at which its source begins. Pieces are runs of normalised bytes, so their places in the
original text are read off that record.

Two characters that stand side by side in no piece are never merged, so the normalised text falls into chunks there, which
are encoded apart. Known chunks are looked up in Arrow's memory, only unknown ones are merged pair by pair, best score
first.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sonara.llm.bpe import Entries, gather
from sonara.llm.common import give_back, map_arrow, slices, text_of

#: The character that stands for a space in pieces (fixed value).
SPACE = "▁"
_SPACE = SPACE.encode()
#: Known chunks are forgotten when there are so many; bytes of text that are encoded at a time; bits of the table of pairs.
KNOWN, SLICE_BYTES, PAIR_BITS = 1_000_000, 2_000_000, 22
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _one_by_one(error: UnicodeError) -> tuple[str, int]:
    return "�", error.start + 1


codecs.register_error("sonara-each-byte", _one_by_one)


class CharacterMap:
    """A compiled character map: the size of a double array, its units (32 bits each: a label, an offset, a leaf bit), and
    replacements that end with a zero byte. A key is the path of its bytes from unit to unit."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob, dtype="<u4", count=size // 4, offset=4).tolist() if size else []
        self.replacements = blob[4 + size :]
        self.begins = self._beginnings()

    def _follow(self, node: int, byte: int) -> int:
        """The unit reached from a node's children by a byte, -1 if there is none."""
        at = node ^ byte
        return at if at < len(self.units) and self.units[at] & 0x800000FF == byte else -1

    @staticmethod
    def _children(at: int, unit: int) -> int:
        return at ^ ((unit >> 10) << ((unit & 0x200) >> 6))

    def _beginnings(self) -> np.ndarray | None:
        """(256, 256) flags of the two bytes with which a rule may begin; those of one byte fit any second."""
        if not self.units:
            return None
        flags = np.zeros((256, 256), dtype=bool)
        root = self._children(0, self.units[0])
        for a in range(1, 256):
            at = self._follow(root, a)
            if at >= 0:
                below = self._children(at, self.units[at])
                flags[a] = True if self.units[at] & 0x100 else [b > 0 and self._follow(below, b) >= 0 for b in range(256)]
        return flags

    def longest(self, data: bytes, at: int, end: int) -> tuple[int, bytes]:
        """(bytes of the longest rule's key that stands at this place, its replacement); 0 bytes if there is none."""
        if not self.units:
            return 0, b""
        length, value, place = 0, 0, self._children(0, self.units[0])
        for k in range(at, end):
            node = self._follow(place, data[k]) if data[k] else -1
            if node < 0:
                break
            unit = self.units[node]
            place = self._children(node, unit)
            if unit & 0x100:
                length, value = k + 1 - at, self.units[place] & 0x7FFFFFFF
        return length, self.replacements[value : self.replacements.index(b"\0", value)] if length else b""


@dataclass
class Normalised:
    """Texts one behind another. data: normalised bytes; source: for each of them the original byte at which its source
    begins; edges, ends: where each text's bytes begin, and the original byte at which its last source ends."""

    data: np.ndarray
    source: np.ndarray
    edges: np.ndarray
    ends: np.ndarray


class PieceModel:
    """A SentencePiece BPE model with byte fallback, as read from its file."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2  # the file's format, as its library publishes it

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        trainer, normalizer = proto.trainer_spec, proto.normalizer_spec
        kinds = [p.type for p in proto.pieces]
        if trainer.model_type != trainer.BPE or not trainer.byte_fallback or kinds.count(BYTE) != 256:
            raise ValueError("only BPE models with byte fallback are supported")
        if USER_DEFINED in kinds or UNUSED in kinds or trainer.treat_whitespace_as_suffix or not normalizer.escape_whitespaces:
            raise ValueError("user-defined and unused pieces, spaces as suffixes and plain spaces are not supported")
        self.kinds = np.array(kinds, dtype=np.int8)
        self.score = {p.piece: p.score for p in proto.pieces if p.type == NORMAL}
        self.id_of = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        self.byte_ids = [0] * 256
        for i, p in enumerate(proto.pieces):
            if p.type == BYTE:
                self.byte_ids[int(p.piece[1:-1], 16)] = i
        self.bos, self.eos = trainer.bos_id, trainer.eos_id
        self.prefix, self.squeeze = normalizer.add_dummy_prefix, normalizer.remove_extra_whitespaces
        self.map = CharacterMap(normalizer.precompiled_charsmap)
        self._decoding(proto, trainer.unk_surface)
        self._pairs()
        self.known = Entries(self._new, KNOWN)

    def _decoding(self, proto, unknown: str) -> None:
        """Bytes that each id stands for in a text, and how many normalised bytes it covers."""
        of_byte = {i: bytes([b]) for b, i in enumerate(self.byte_ids)}
        bytes_of, self.leading = [], np.zeros(len(proto.pieces), dtype=np.int64)
        for i, p in enumerate(proto.pieces):
            text = {NORMAL: p.piece.replace(SPACE, " "), UNKNOWN: unknown}.get(p.type, "").encode()
            bytes_of.append(of_byte.get(i, text))
            self.leading[i] = p.type == NORMAL and p.piece.startswith(SPACE)
        self.covers = np.array([len(p.piece.encode()) if p.type == NORMAL else int(p.type == BYTE) for p in proto.pieces])
        self.pool = np.frombuffer(b"".join(bytes_of), dtype=np.uint8)
        self.length = np.array([len(b) for b in bytes_of])
        self.start = np.cumsum(self.length) - self.length

    def _pairs(self) -> None:
        """A table of hashed pairs of characters that stand side by side in a piece. Pairs that only share a slot with one
        make chunks longer, which changes no result."""
        pairs = {(a, b) for piece in self.score for a, b in zip(piece, piece[1:], strict=False)}
        self.joined = np.zeros(1 << PAIR_BITS, dtype=bool)
        if pairs:
            a, b = (np.array([ord(p[k]) for p in pairs], dtype=np.uint32) for k in (0, 1))
            self.joined[self._slot(a, b)] = True

    @staticmethod
    def _slot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return ((a * np.uint32(0x9E3779B1)) ^ (b * np.uint32(0x85EBCA77))) >> np.uint32(32 - PAIR_BITS)

    def _matches(self, raw: bytes, view: np.ndarray, edges: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
        """(place, length, replacement) of the rules that apply, from left to right, each the longest that fits."""
        if self.map.begins is None:
            return
        second = np.append(view[1:], 0)
        at, done = np.flatnonzero(self.map.begins[view, second] & ((view & 0xC0) != 0x80)), 0
        ends = edges[np.searchsorted(edges, at, side="right")] if len(at) else at
        for place, end in zip(at.tolist(), ends.tolist(), strict=True):
            if place >= done:
                length, value = self.map.longest(raw, place, end)
                if length:
                    yield place, length, value
                    done = place + length

    def normalise(self, view: np.ndarray, edges: np.ndarray) -> Normalised:
        """The texts view[edges[k]:edges[k + 1]], UTF-8 bytes, normalised."""
        raw = view.tobytes()
        lead = (view & 0xC0) != 0x80
        leads = np.append(np.flatnonzero(lead), len(view))
        number = np.cumsum(lead)
        columns = [view, leads[number - 1], leads[np.minimum(number, len(leads) - 1)], np.repeat(np.arange(len(edges) - 1), np.diff(edges))]
        parts: list[list[np.ndarray]] = [[] for _ in columns]
        done = 0
        for place, length, value in self._matches(raw, view, edges):
            made = [np.frombuffer(value, dtype=np.uint8), *(np.full(len(value), x) for x in (place, place + length, columns[3][place]))]
            for part, column, new in zip(parts, columns, made, strict=True):
                part += [column[done:place], new]
            done = place + length
        view, source, until, owner = (np.concatenate([*part, column[done:]]) for part, column in zip(parts, columns, strict=True)) if done else columns
        begins, ends = edges[:-1].copy(), edges[1:].copy()
        if self.squeeze and len(view):
            view, source, owner = self._squeezed(view, source, until, owner, begins, ends)
        sizes = np.bincount(owner, minlength=len(edges) - 1)
        return self._escaped(view, source, owner, sizes, begins, ends, (sizes if self.squeeze else np.diff(edges)) > 0)

    @staticmethod
    def _squeezed(view: np.ndarray, source: np.ndarray, until: np.ndarray, owner: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Without spaces at a text's start and end and behind other spaces; begins are moved behind the first ones, ends before
        the last, among which SPACE itself counts."""
        blank, place = view == 32, np.arange(len(view))
        fresh = np.append(True, owner[1:] != owner[:-1])
        alone = np.append((source[1:] != source[:-1]) | fresh[1:], True)  # the only byte that its source gives
        leading = blank & alone & np.where(fresh, source == begins[owner], np.append(False, until[:-1] == source[1:]))
        stop = np.flatnonzero(~leading)
        reach = np.append(stop, len(view))[np.searchsorted(stop, place[fresh])]  # where the run from a text's start ends
        reach = np.minimum(reach, np.append(place[fresh], len(view))[1:])
        some = reach > place[fresh]
        begins[owner[fresh][some]] = until[reach[some] - 1]
        hollow = blank.copy()
        mark = np.flatnonzero((view[:-2] == _SPACE[0]) & (view[1:-1] == _SPACE[1]) & (view[2:] == _SPACE[2]))
        hollow[(mark[:, None] + np.arange(3)).ravel()] = True
        last = np.full(len(begins), -1)
        full = np.flatnonzero(~hollow)
        last[owner[full]] = full
        tail = place > last[owner]
        first_of_tail = np.flatnonzero(tail & ~np.append(False, tail[:-1] & ~fresh[1:]))
        ends[owner[first_of_tail]] = source[first_of_tail]
        keep = ~(tail | (blank & (fresh | np.append(False, blank[:-1]))))
        return view[keep], source[keep], owner[keep]

    def _escaped(self, view: np.ndarray, source: np.ndarray, owner: np.ndarray, sizes: np.ndarray, begins: np.ndarray, ends: np.ndarray, some: np.ndarray) -> Normalised:
        """With SPACE in place of spaces, and one before each text that isn't empty."""
        blank = view == 32
        width = np.where(blank, 3, 1)
        ahead = (3 if self.prefix else 0) * some
        edges = np.append(0, np.cumsum(sizes + 2 * np.bincount(owner[blank], minlength=len(sizes)) + ahead))
        at = np.cumsum(width) - width + np.repeat(np.cumsum(ahead), sizes)
        data, origin = np.zeros(edges[-1], dtype=np.uint8), np.zeros(edges[-1], dtype=np.int64)
        data[at], origin[at] = view, source
        first = edges[:-1][ahead > 0]
        origin[first] = begins[ahead > 0]
        place = np.append(at[blank], first)
        for k, byte in enumerate(_SPACE):
            data[place + k], origin[place + k] = byte, origin[place]
        return Normalised(data, origin, edges, ends)

    def chunks(self, found: Normalised) -> np.ndarray:
        """Where chunks begin: at each text's start and between characters that stand side by side in no piece."""
        if not len(found.data):
            return np.zeros(0, dtype=np.int64)
        points = np.frombuffer(found.data.tobytes().decode().encode("utf-32-le"), dtype="<u4").astype(np.uint32)
        leads = np.flatnonzero((found.data & 0xC0) != 0x80)
        begins = np.zeros(len(found.data) + 1, dtype=bool)
        begins[leads[1:][~self.joined[self._slot(points[:-1], points[1:])]]] = True
        begins[found.edges[:-1]] = True
        return np.flatnonzero(begins[:-1])

    def _new(self, chunks: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        ids = [self.merged(c) for c in chunks.to_pylist()]
        return np.array([i for of in ids for i in of], dtype="<u4"), np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))

    def merged(self, text: str) -> list[int]:
        """Ids of a normalised text: neighbours whose union is a piece are joined, the best score first, of equal ones the
        leftmost. Characters that are no piece become bytes."""
        parts: list[str] = list(text)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        score = self.score

        def offer(a: int, b: int) -> None:
            union = parts[a] + parts[b]
            if union in score:
                heapq.heappush(heap, (-score[union], a, b, len(union)))

        heap = [(-score[u], k, k + 1, 2) for k in range(len(parts) - 1) if (u := text[k : k + 2]) in score]
        heapq.heapify(heap)
        while heap:
            _, a, b, size = heapq.heappop(heap)
            if not parts[a] or not parts[b] or len(parts[a]) + len(parts[b]) != size:
                continue
            parts[a], parts[b] = parts[a] + parts[b], ""
            after[a] = after[b]
            if after[b] < len(parts):
                before[after[b]] = a
                offer(a, after[a])
            if before[a] >= 0:
                offer(before[a], a)
        ids: list[int] = []
        for part in filter(None, parts):
            found = self.id_of.get(part)
            ids.extend([found] if found is not None else [self.byte_ids[b] for b in part.encode()])
        return ids

    def encode(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids, begins, spans, ends) of texts without begin and end ids: text k has ids[begins[k]:begins[k + 1]], and each of
        them the bytes spans[i]:ends[i] of the original text. Bytes of one character have an empty span but for the last."""
        view, edges = utf8(texts)
        found = self.normalise(view, edges)
        starts = self.chunks(found)
        bounds = np.append(starts, len(found.data)).astype(np.int32)
        entry = self.known.of(pa.StringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(found.data)))
        length = self.known.length[entry]
        ids = gather(self.known.pool, self.known.start[entry], length)
        begins = np.append(np.cumsum(length) - length, length.sum())[np.searchsorted(starts, found.edges)]
        stop = np.cumsum(self.covers[ids])
        begin = found.source[stop - self.covers[ids]]
        end = np.append(found.source, 0)[stop]
        last = begins[1:][np.diff(begins) > 0] - 1
        end[last] = found.ends[np.diff(begins) > 0]
        base = np.repeat(edges[:-1], np.diff(begins))
        return ids, begins, begin - base, end - base

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: control ids stand for nothing, the space that was put before the text is taken off, and a byte
        that belongs to no character becomes U+FFFD. Ids outside the vocabulary are left out."""
        ids = ids[ids < len(self.kinds)]
        ids = ids[self.kinds[ids] != CONTROL]
        data = gather(self.pool, self.start[ids], self.length[ids]).tobytes()
        if self.prefix or self.squeeze:
            bare = int(self.leading[ids[0]]) if len(ids) else 0
            while self.squeeze and bare and bare < len(ids) and self.length[ids[:bare]].sum() == bare and self.leading[ids[bare]]:
                bare += 1
            data = data[bare:]
        return data.decode("utf-8", errors="sonara-each-byte")


def utf8(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, where each begins, and at last their number); null is empty."""
    texts = texts.cast(pa.string()).fill_null("")
    if not len(texts):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, offsets, data = texts.buffers()
    edges = np.frombuffer(offsets, dtype=np.int32, count=len(texts) + 1, offset=4 * texts.offset).astype(np.int64)
    view = np.frombuffer(data, dtype=np.uint8)[edges[0] : edges[-1]] if data is not None and edges[-1] > edges[0] else np.zeros(0, dtype=np.uint8)
    return view, edges - edges[0]


_models: dict[str, PieceModel] = {}


def model_of(model: bytes) -> PieceModel:
    """One model in a Python worker, for all its tasks."""
    key = hashlib.sha256(model).hexdigest()
    if key not in _models:
        _models[key] = PieceModel(model)
    return _models[key]


def read_model(path: str) -> bytes:
    """The model file: some MB at most, so it travels with the tasks."""
    with open(path, "rb") as f:
        return f.read()


def _lists(values: np.ndarray, begins: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), pa.array(values.astype(np.int32)))


def _coded(df: DataFrame, model: bytes, id_col: str, text_col: str, columns: Callable, schema: str) -> DataFrame:
    """Rows of columns(model, texts, ids, begins, span begins, span ends) beside the id; one for each row, no shuffle."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    rows = df.select(df[id_col].cast("bigint").alias("id"), text_of(text_col).alias("text"))

    def start() -> Callable[[pa.RecordBatch], Iterator[dict]]:
        coder = model_of(shared.value)

        def each(batch: pa.RecordBatch) -> Iterator[dict]:
            for part in slices(batch, size=SLICE_BYTES):
                give_back()
                yield {"id": part.column(0), **columns(coder, part.column(1), *coder.encode(part.column(1)))}

        return each

    return map_arrow(rows, start, f"id bigint, {schema}").withColumnRenamed("id", id_col)


def piece_encode(df: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids array<int>, begins array<int>, ends array<int>) of each row, without begin and end ids.

    begins and ends are the bytes of the original text (UTF-8) that a piece comes from. The space put before a text has an
    empty place; of a character that became several bytes the last one has its place. A null text is empty and has no
    pieces; rows with null or repeated ids are encoded like any other; columns besides the two are not read.
    """

    def columns(coder, texts, ids, begins, begin, end) -> dict:
        return {"ids": _lists(ids, begins), "begins": _lists(begin, begins), "ends": _lists(end, begins)}

    return _coded(df, model, id_col, text_col, columns, "ids array<int>, begins array<int>, ends array<int>")


def piece_decode(df: DataFrame, model: bytes, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id_col, text) of lists of ids; a null list gives the empty text, null ids in it are left out."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    rows = df.select(df[id_col].cast("bigint").alias("id"), df[ids_col].cast("array<bigint>").alias("ids"))

    def start() -> Callable[[pa.RecordBatch], Iterator[dict]]:
        coder = model_of(shared.value)

        def each(batch: pa.RecordBatch) -> Iterator[dict]:
            lists = (np.array([i for i in of or () if i is not None and i >= 0], dtype=np.int64) for of in batch.column(1).to_pylist())
            yield {"id": batch.column(0), "text": pa.array(map(coder.decode, lists), pa.string())}

        return each

    return map_arrow(rows, start, "id bigint, text string").withColumnRenamed("id", id_col)


def piece_round_trip(df: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256, spans_sha256, spans_tile) of each row's ids with begin and end id, and of
    what they are decoded to; spans_sha256 is of the pieces' begins and ends as little-endian 32-bit integers, and spans_tile
    says that they follow one another from the text's first byte to its last. Rows as in piece_encode."""

    def columns(coder, texts, ids, begins, begin, end) -> dict:
        of = list(zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True))
        each = [np.concatenate([[coder.bos], ids[a:b], [coder.eos]]).astype("<u4") for a, b in of]
        spans = np.stack([begin, end], axis=1).astype("<i4")
        sha = lambda data: hashlib.sha256(data).hexdigest()
        sizes = np.diff(utf8(texts)[1])
        gap = np.append(0, end)[:-1] != begin
        gap[begins[:-1][np.diff(begins) > 0]] = False
        gaps = np.append(0, np.cumsum(gap))
        tiles = [size == 0 if a == b else bool(begin[a] == 0 and end[b - 1] == size and gaps[b] == gaps[a]) for (a, b), size in zip(of, sizes.tolist(), strict=True)]
        return {
            "n_tokens": pa.array([len(x) for x in each], pa.int64()),
            "ids_sha256": pa.array(map(sha, each), pa.string()),
            "decoded_sha256": pa.array([sha(coder.decode(x).encode()) for x in each], pa.string()),
            "spans_sha256": pa.array([sha(spans[a:b].tobytes()) for a, b in of], pa.string()),
            "spans_tile": pa.array(tiles, pa.bool_()),
        }

    return _coded(df, model, id_col, text_col, columns, "n_tokens bigint, ids_sha256 string, decoded_sha256 string, spans_sha256 string, spans_tile boolean")
