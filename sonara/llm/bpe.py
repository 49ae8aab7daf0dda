"""Byte-level BPE encoding and decoding by a pair occurrence index.

A text falls into pieces at single spaces and line ends between other characters and where letters, digits and marks
meet; no pre-token crosses such a place, so pieces are encoded apart and kept in a table of known pieces. Finding pieces and telling them apart goes by whole arrays. The unknown pieces of a batch are laid out in one array of
symbols. The index maps each pair that has a rank to all its positions in that array. The lowest active rank is applied
at all its positions at once, the pairs that this makes are added to the lists of their own ranks, and so on until no
rank is active. A pair's parts are made by lower ranks only (checked on loading), so the order over all pieces is the
order within each.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from sonara.llm.common import give_back, map_arrow, slices, text_of

#: The pre-token pattern of byte-level BPE (fixed value, as in public_tokenizers.PATTERN).
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Known pieces are forgotten when there are so many, and words. The own encoder knows less than one of the library: it runs
#: last in the pipeline, where executors hold most.
KNOWN_PIECES, KNOWN_OWN, KNOWN_WORDS = 1_000_000, 300_000, 100_000
#: Bytes of text that the own encoder takes at a time.
SLICE_BYTES = 4_000_000

#: Bytes by which a piece may begin, and bytes next to which no piece begins: ASCII white space and the four separators
#: that some libraries count as such.
_BREAK, _WHITE = (np.isin(np.arange(256), x) for x in ([10, 32], [*range(9, 14), *range(28, 33)]))
#: A character of several bytes may be white space if its first byte is among FIRST and the others among LATER.
_FIRST = np.isin(np.arange(256), [0xC2, 0xE1, 0xE2, 0xE3])
_LATER = np.isin(np.arange(256), [*range(0x80, 0x8B), 0x8E, 0x85, 0x9A, 0x9F, 0xA0, 0xA8, 0xA9, 0xAF])
_KIND = np.zeros(256, dtype=np.uint8)
for _kind, _bytes in ((1, b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"), (2, b"0123456789"), (3, b'!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~')):
    _KIND[list(_bytes)] = _kind
#: All pre-tokens of a text, in order.
pretokens = regex.compile(PRETOKEN).findall


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in the vocabulary."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def _kinds(data: np.ndarray) -> np.ndarray:
    """1 for bytes of letters, 2 of digits, 3 of marks, 0 where none of these is certain (or an apostrophe, as contractions
    are pre-tokens). Letters are those of ASCII and of the Latin-1 supplement, whose first byte is C3."""
    kind = _KIND[data]
    latin = np.flatnonzero(data[:-1] == 0xC3)
    latin = latin[(data[latin + 1] != 0x97) & (data[latin + 1] != 0xB7)]  # the signs of multiplication and division
    kind[latin] = kind[latin + 1] = 1
    return kind


def piece_starts(data: np.ndarray, ends: np.ndarray, specials: list[bytes]) -> np.ndarray:
    """Where the pieces of texts begin that lie one behind another in data (bytes of UTF-8) and end at `ends`.

    A piece begins at each text's start, at a single space or line end between two characters that are no white space, and
    where a letter, a digit and a mark meet. Where a neighbour may be white space of several bytes none begins, nor inside
    a special token, so pieces there are longer, which is as right.
    """
    begins = np.zeros(len(data) + 1, dtype=bool)
    at = np.flatnonzero(_BREAK[data])
    before, after = data.take(at - 1, mode="clip"), data.take(at + 1, mode="clip")
    open_ = ~(_WHITE[before] | _WHITE[after])
    far = np.flatnonzero(open_ & ((before >= 0x80) | (after >= 0x80)))
    if len(far):
        place, b, a = at[far], before[far], after[far]
        left = _LATER[b] & ((data.take(place - 2, mode="clip") == 0xC2) | (_LATER[data.take(place - 2, mode="clip")] & _FIRST[data.take(place - 3, mode="clip")]))
        open_[far] = ~(left | (_FIRST[a] & _LATER[data.take(place + 2, mode="clip")]))
    begins[at[open_]] = True
    last = ends[ends > 0] - 1
    begins[last[_BREAK[data[last]]]] = False  # a text's last character
    kind = _kinds(data)
    begins[1:-1] |= (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)
    raw = data.tobytes() if specials else b""
    for special in specials:
        found = raw.find(special)
        while found >= 0:
            begins[found + 1 : found + len(special)] = False
            found = raw.find(special, found + 1)
    begins[np.r_[0, ends[:-1]]] = True
    begins[len(data)] = False
    return np.flatnonzero(begins)


class Known:
    """A table of what was encoded before. When it is full, entries that one batch only has asked for are forgotten."""

    def __init__(self, encode_new: Callable[[list[str]], list[bytes]], most: int = KNOWN_WORDS):
        self.encode_new, self.most = encode_new, most
        self.ids: dict[str, bytes] = {}
        self.again: set[str] = set()

    def learn(self, keys: set[str]) -> Callable[[str], bytes]:
        if len(self.ids) > self.most:
            kept = self.again if len(self.again) <= self.most // 2 else ()
            self.ids = {k: self.ids[k] for k in kept}
            self.again = set()
        new = list(keys.difference(self.ids))
        self.again |= keys.intersection(self.ids)
        self.ids.update(zip(new, self.encode_new(new), strict=True))
        return self.ids.__getitem__


#: From an array of distinct pieces to (the ids of all, one behind another; the number of each one's ids).
EncodeNew = Callable[[pa.StringArray], tuple[np.ndarray, np.ndarray]]


class Entries:
    """Ids of known pieces: the k-th key has pool[start[k]:start[k] + length[k]]. When there are over `most` keys, or their
    ids are over POOL times that, those that were seen once only are forgotten. Keys lie in Arrow's memory, about 15 bytes
    each; a table to look them up is made for each batch, and a small one of the HOT most frequent keys, which is asked
    first."""

    POOL, HOT = 12, 8192

    def __init__(self, encode_new: EncodeNew, most: int):
        self.encode_new, self.most = encode_new, most
        none = np.zeros(0, dtype=np.int64)
        self._keep(none, pa.array([], pa.string()), none.astype("<u4"), none, none, none)

    def _keep(self, keep: np.ndarray, keys: pa.StringArray, pool: np.ndarray, start: np.ndarray, length: np.ndarray, used: np.ndarray) -> None:
        self.keys, self.pool, self.length, self.used = keys.take(pa.array(keep)), gather(pool, start[keep], length[keep]), length[keep], used[keep]
        self.start = np.cumsum(self.length) - self.length
        self._heat()

    def _heat(self) -> None:
        self.hot = np.argsort(-self.used, kind="stable")[: self.HOT] if len(self.used) <= self.HOT else np.argpartition(-self.used, self.HOT)[: self.HOT]
        self.hot_keys, self.heated = self.keys.take(pa.array(self.hot)), len(self.keys)

    def _forget(self) -> None:
        keep = np.flatnonzero(self.used > 1)
        if len(keep) > self.most // 2 or self.length[keep].sum() > self.POOL * self.most // 2:
            keep = self.hot[self.length[self.hot] < 16]
        self._keep(keep, self.keys, self.pool, self.start, self.length, self.used)

    def of(self, pieces_: pa.StringArray) -> np.ndarray:
        """The number of each piece's key; unknown pieces are encoded first."""
        if len(self.keys) > self.most or len(self.pool) > self.POOL * self.most:
            self._forget()
        elif len(self.keys) > 2 * self.heated:
            self._heat()
        place = pc.fill_null(pc.index_in(pieces_, value_set=self.hot_keys), -1).to_numpy()
        found = self.hot[place] if len(self.hot) else place.astype(np.int64)
        cold = np.flatnonzero(place < 0)
        if len(cold):
            rest = pieces_.take(pa.array(cold))
            found[cold] = pc.fill_null(pc.index_in(rest, value_set=self.keys), -1).to_numpy()
            missing = np.flatnonzero(found[cold] < 0)
            if len(missing):
                coded = rest.take(pa.array(missing)).dictionary_encode()
                found[cold[missing]] = coded.indices.to_numpy() + len(self.keys)
                ids, lengths = self.encode_new(coded.dictionary)
                self.keys = pa.concat_arrays([self.keys, coded.dictionary])
                self.start = np.concatenate([self.start, len(self.pool) + np.cumsum(lengths) - lengths])
                self.length, self.pool = np.concatenate([self.length, lengths]), np.concatenate([self.pool, ids])
                self.used = np.concatenate([self.used, np.zeros(len(lengths), dtype=np.int64)])
        self.used += np.bincount(found, minlength=len(self.used))
        return found


def gather(pool: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The runs pool[start:start + length], one behind another."""
    ends = np.cumsum(length)
    return pool[np.repeat(start - ends + length, length) + np.arange(ends[-1] if len(ends) else 0)]


class PieceTable:
    """Encodes texts piece by piece. Pieces are found and told apart in Arrow's memory, so only distinct ones become Python
    strings; encode_new gets the unknown ones. With whole=True a text is one piece."""

    def __init__(self, encode_new: EncodeNew, most: int = KNOWN_PIECES, whole: bool = False, specials: Iterable[str] = ()):
        self.known, self.whole, self.specials = Entries(encode_new, most), whole, [t.encode() for t in specials]

    def encode_array(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's ids begin, and at last their number)."""
        texts = texts.cast(pa.string()).fill_null("")
        if not len(texts):
            return np.zeros(0, dtype="<u4"), np.zeros(1, dtype=np.int64)
        _, offsets, data = texts.buffers()
        edges = np.frombuffer(offsets, dtype=np.int32, count=len(texts) + 1, offset=4 * texts.offset).astype(np.int64)
        if edges[-1] == edges[0]:
            return np.zeros(0, dtype="<u4"), np.zeros(len(texts) + 1, dtype=np.int64)
        data = data.slice(edges[0], edges[-1] - edges[0])
        edges -= edges[0]
        view = np.frombuffer(data, dtype=np.uint8)
        starts = np.unique(edges[:-1][np.diff(edges) > 0]) if self.whole else piece_starts(view, edges[1:], self.specials)
        bounds = np.append(starts, len(view)).astype(np.int32)
        entry = self.known.of(pa.StringArray.from_buffers(len(starts), pa.py_buffer(bounds), data))
        length = self.known.length[entry]
        begins = np.append(np.cumsum(length) - length, length.sum())
        return gather(self.known.pool, self.known.start[entry], length), begins[np.searchsorted(starts, edges)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        ids, begins = self.encode_array(pa.array(texts, pa.string()))
        return [ids[a:b].tobytes() for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True)]


def splits_at_spaces(tokenizer_json: str) -> bool:
    """Whether a tokenizer is byte-level BPE, whose pre-tokens cross no start of a piece, and its special tokens neither."""
    data = json.loads(tokenizer_json)
    model, pre = data["model"], data.get("pre_tokenizer") or {}
    plain = model["type"] == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not (pre.get("add_prefix_space") or data.get("normalizer") or data.get("post_processor"))
    odd = any(t.get(k) for t in data["added_tokens"] for k in ("single_word", "lstrip", "rstrip")) or any(re.search(r"\s", t["content"]) for t in data["added_tokens"])
    return plain and not odd


class Vocabulary:
    """The tables of a byte-level BPE tokenizer file."""

    def __init__(self, tokenizer_json: str):
        data = json.loads(tokenizer_json)
        model, pre = data["model"], data["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre.get("add_prefix_space") or data.get("normalizer") or data.get("post_processor"):
            raise ValueError("only byte-level BPE without normalizer, prefix space and post-processor is supported")
        vocab: dict[str, int] = model["vocab"]
        chars = byte_characters()
        self.byte_ids = np.array([vocab[c] for c in chars], dtype=np.int64)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        made = {a + b: r for r, (a, b) in reversed(list(enumerate(merges)))}
        if any(made.get(part, -1) >= r for r, pair in enumerate(merges) for part in pair):
            raise ValueError("a pair's parts must be made by lower ranks")
        self.left = np.array([vocab[a] for a, _ in merges], dtype=np.int64)
        self.right = np.array([vocab[b] for _, b in merges], dtype=np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        self._enter(self.left << 32 | self.right)
        self.specials = {t["content"]: t["id"] for t in data["added_tokens"]}
        back = {c: b for b, c in enumerate(chars)}
        size = max([*vocab.values(), *self.specials.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(back[c] for c in token)
        for token, i in self.specials.items():
            self.bytes_of[i] = token.encode()
        self.byte_pool = np.frombuffer(b"".join(self.bytes_of), dtype=np.uint8)
        self.byte_length = np.fromiter(map(len, self.bytes_of), dtype=np.int64, count=size)
        self.byte_start = np.cumsum(self.byte_length) - self.byte_length

    def _enter(self, keys: np.ndarray) -> None:
        """An open-addressing table from a pair to its rank: a pair lies at its slot or among the few that follow."""
        bits = max(10, int(len(keys)).bit_length() + 4)
        self.shift = np.uint64(64 - bits)
        self.slot_key = np.full((1 << bits) + 64, -1, dtype=np.int64)
        self.slot_rank = np.full((1 << bits) + 64, -1, dtype=np.int64)
        self.probes = 1
        for rank, (slot, key) in enumerate(zip(self._slots(keys).tolist(), keys.tolist(), strict=True)):
            probe = 0
            while self.slot_key[slot + probe] not in (-1, key):
                probe += 1
            if self.slot_key[slot + probe] == -1:
                self.slot_key[slot + probe], self.slot_rank[slot + probe] = key, rank
            self.probes = max(self.probes, probe + 1)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 where it has none or touches a border (a negative symbol)."""
        keys = left << 32 | right & 0xFFFFFFFF
        slots = self._slots(keys)
        found = self.slot_key[slots]
        ranks = np.where(found == keys, self.slot_rank[slots], -1)
        more = np.flatnonzero((found != keys) & (found != -1))
        for probe in range(1, self.probes):
            if not len(more):
                break
            found = self.slot_key[slots[more] + probe]
            hit = found == keys[more]
            ranks[more[hit]] = self.slot_rank[slots[more[hit]] + probe]
            more = more[~hit & (found != -1)]
        ranks[(left < 0) | (right < 0)] = -1
        return ranks

    def decode(self, ids: np.ndarray) -> str:
        return gather(self.byte_pool, self.byte_start[ids], self.byte_length[ids]).tobytes().decode("utf-8", errors="replace")


class PairIndex:
    """Positions of each ranked pair in an array of symbols; words are parted by -1."""

    def __init__(self, vocabulary: Vocabulary, symbols: np.ndarray):
        self.v, self.symbol = vocabulary, symbols
        n = len(symbols)
        self.next, self.before = np.arange(1, n + 1), np.arange(-1, n - 1)
        self.positions: dict[int, list[np.ndarray]] = {}
        self.active: list[int] = []
        self.add(np.arange(n - 1))

    def add(self, at: np.ndarray) -> None:
        """Enters the pairs that begin at these positions into the lists of their ranks."""
        ranks = self.v.ranks(self.symbol[at], self.symbol[self.next[at]])
        at, ranks = at[ranks >= 0], ranks[ranks >= 0]
        if not len(at):
            return
        order = np.argsort(ranks, kind="stable")
        at, ranks = at[order], ranks[order]
        starts = np.flatnonzero(np.r_[True, ranks[1:] != ranks[:-1]])
        for rank, part in zip(ranks[starts].tolist(), np.split(at, starts[1:]), strict=True):
            if rank in self.positions:
                self.positions[rank].append(part)
            else:
                self.positions[rank] = [part]
                heapq.heappush(self.active, rank)

    def run(self) -> np.ndarray:
        """Applies the active ranks in ascending order and returns the symbols that are left, borders included."""
        symbol, following, before = self.symbol, self.next, self.before
        alive = np.ones(len(symbol), dtype=bool)
        while self.active:
            rank = heapq.heappop(self.active)
            lists = self.positions.pop(rank)
            at = lists[0] if len(lists) == 1 else np.concatenate(lists)  # a position may be there twice
            left, right, made = self.v.left[rank], self.v.right[rank], self.v.made[rank]
            at = at[alive[at] & (symbol[at] == left)]
            at = at[symbol[following[at]] == right]
            if left == right and len(at) > 1:  # of a run of equal symbols, every other pair from its start
                at = np.unique(at)
                linked = np.r_[False, following[at[:-1]] == at[1:]]
                place = np.arange(len(at))
                start = np.maximum.accumulate(np.where(linked, 0, place))
                at = at[(place - start) % 2 == 0]
            if not len(at):
                continue
            gone = following[at]
            symbol[at], alive[gone] = made, False
            symbol[gone] = -2
            after = following[gone]
            following[at] = after
            before[after] = at
            self.add(np.concatenate([before[at], at]))
        return symbol[alive]


def encode_words(vocabulary: Vocabulary, words: list[bytes]) -> list[np.ndarray]:
    """The ids of each word (a pre-token's bytes), through one pair index over all of them."""
    if not words:
        return []
    data = np.frombuffer(b"\0" + b"\0".join(words) + b"\0", dtype=np.uint8)
    symbols = vocabulary.byte_ids[data]
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    borders = np.r_[0, np.cumsum(lengths + 1)]
    symbols[borders] = -1
    left = PairIndex(vocabulary, symbols).run()
    borders = np.flatnonzero(left == -1)
    ids = left.astype("<u4")
    return [ids[a + 1 : b] for a, b in zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True)]


class Encoder:
    """encode() for lists of texts; keeps the pieces and pre-tokens it knows from one batch to the next."""

    def __init__(self, tokenizer_json: str):
        self.vocabulary = Vocabulary(tokenizer_json)
        specials = sorted(self.vocabulary.specials, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, specials)) + ")") if specials else None
        self.words = Known(lambda words: [x.tobytes() for x in encode_words(self.vocabulary, [w.encode() for w in words])])
        self.table = PieceTable(self._new, KNOWN_OWN, whole=not splits_at_spaces(tokenizer_json), specials=specials)
        self.encode, self.encode_array = self.table.encode, self.table.encode_array

    def _new(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        split = (self.special.split(t) if self.special and self.special.search(t) else [t] for t in texts.to_pylist())
        parts = [[pretokens(p) if k % 2 == 0 else p for k, p in enumerate(of)] for of in split]  # special tokens at odd places
        get = self.words.learn({t for of in parts for found in of[::2] for t in found})
        out = [b"".join(b"".join(map(get, p)) if k % 2 == 0 else np.uint32(self.vocabulary.specials[p]).tobytes() for k, p in enumerate(of)) for of in parts]
        return np.frombuffer(b"".join(out), dtype="<u4"), np.fromiter(map(len, out), dtype=np.int64, count=len(out)) // 4


_encoders: dict[str, Encoder] = {}


def encoder(tokenizer_json: str) -> Encoder:
    """One encoder for each tokenizer in a Python worker, for all its tasks."""
    key = hashlib.sha256(tokenizer_json.encode()).hexdigest()
    if key not in _encoders:
        _encoders[key] = Encoder(tokenizer_json)
    return _encoders[key]


def read_tokenizer(path: str) -> str:
    """The tokenizer file: a few MB at most, so it travels with the tasks."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def bpe_encode(df: DataFrame, tokenizer_json: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids binary, n_tokens): each row's ids as little-endian unsigned 32-bit integers.

    A null text is empty and has no ids; rows with a null or repeated id are encoded like any other; columns besides the
    two are not read. One result row for each row.
    """
    shared = df.sparkSession.sparkContext.broadcast(tokenizer_json)
    rows = df.select(df[id_col].cast("bigint").alias("id"), text_of(text_col).alias("text"))

    def start() -> Callable[[pa.RecordBatch], Iterator[dict]]:
        coder = encoder(shared.value)

        def each(batch: pa.RecordBatch) -> Iterator[dict]:
            for part in slices(batch, size=SLICE_BYTES):
                give_back()
                ids, begins = coder.encode_array(part.column(1))
                binary = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer((begins * 4).astype(np.int32)), pa.py_buffer(ids)])
                yield {"id": part.column(0), "ids": binary, "n_tokens": pa.array(np.diff(begins))}

        return each

    return map_arrow(rows, start, "id bigint, ids binary, n_tokens bigint").withColumnRenamed("id", id_col)


def bpe_decode(df: DataFrame, tokenizer_json: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id_col, text): the texts of rows of bpe_encode; a null list of ids gives the empty text, bytes that are no UTF-8
    give U+FFFD, and ids outside the vocabulary give nothing."""
    shared = df.sparkSession.sparkContext.broadcast(tokenizer_json)
    rows = df.select(df[id_col].cast("bigint").alias("id"), df[ids_col].cast("binary").alias("ids"))

    def start() -> Callable[[pa.RecordBatch], Iterator[dict]]:
        vocabulary = encoder(shared.value).vocabulary

        def each(batch: pa.RecordBatch) -> Iterator[dict]:
            texts = []
            for ids in batch.column(1).to_pylist():
                array = np.frombuffer(ids or b"", dtype="<u4")
                texts.append(vocabulary.decode(array[array < len(vocabulary.bytes_of)]))
            yield {"id": batch.column(0), "text": pa.array(texts, pa.string())}

        return each

    return map_arrow(rows, start, "id bigint, text string").withColumnRenamed("id", id_col)


def bpe_round_trip(df: DataFrame, tokenizer_json: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256, decoded_chars, same_text) of each row, encoded and decoded in one pass."""
    shared = df.sparkSession.sparkContext.broadcast(tokenizer_json)
    rows = df.select(df[id_col].cast("bigint").alias("id"), text_of(text_col).alias("text"))

    def start() -> Callable[[pa.RecordBatch], Iterator[dict]]:
        coder = encoder(shared.value)

        def each(batch: pa.RecordBatch) -> Iterator[dict]:
            for part in slices(batch, size=SLICE_BYTES):
                give_back()
                ids, begins = coder.encode_array(part.column(1))
                each_ids = [ids[a:b] for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True)]
                decoded = pa.array(map(coder.vocabulary.decode, each_ids), pa.string())
                yield {
                    "id": part.column(0),
                    "n_tokens": pa.array(np.diff(begins)),
                    "ids_sha256": [hashlib.sha256(x).hexdigest() for x in each_ids],
                    "decoded_sha256": [hashlib.sha256(t.as_buffer()).hexdigest() for t in decoded],
                    "decoded_chars": pc.utf8_length(decoded).cast(pa.int64()),
                    "same_text": pc.equal(decoded, part.column(1)),
                }

        return each

    return map_arrow(rows, start, "id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, decoded_chars bigint, same_text boolean").withColumnRenamed("id", id_col)
