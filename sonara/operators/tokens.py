"""Token sequences: encoding, decoding, special ids, prompts, words and timestamp segments."""

from __future__ import annotations

import json
import re
import string
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonara.functions.text import LANGUAGE_TOKEN, PRETOKEN
from sonara.schema import RAW_SEGMENT

TIME_STEP = 0.02
MAX_TOKENS, CONTEXT_TOKENS = 448, 224
FRAMES_PER_TIME = 2
#: Languages written without spaces between words (fixed values).
UNSPACED = frozenset({"zh", "ja", "th", "lo", "my", "yue"})
#: Symbols that are no speech (fixed values): plain ones, and musical ones of which the first token counts.
SYMBOLS = ['"', "#", "(", ")", "*", "+", "/", ":", ";", "<", "=", ">", "@", "[", "\\", "]", "^", "_", "`", "{", "|", "}", "~", "「", "」", "『", "』", "<<", ">>", "<<<", ">>>", "--", "---", "-(", "-[", "('", '("', "((", "))", "(((", ")))", "[[", "]]", "{{", "}}", "♪♪", "♪♪♪"]
MUSIC = ["♩", "♪", "♫", "♬", "♭", "♮", "♯"]
_LANGUAGE = re.compile(LANGUAGE_TOKEN)
_PRETOKEN = regex.compile(PRETOKEN)


def byte_table() -> list[str]:
    """The character of each byte: printable Latin-1 stands for itself, the others for U+0100 onwards in order."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    table, spare = [], 0x100
    for b in range(256):
        table.append(chr(b if b in own else spare))
        spare += b not in own
    return table


_CHAR = byte_table()
_BYTE = {c: b for b, c in enumerate(_CHAR)}


@dataclass
class Tokenizer:
    """Vocabulary, merge ranks and special ids. Special ids go by name; the first rank of a repeated merge holds."""

    vocab: dict[str, int]
    merges: list[str]
    added: dict[str, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.ids = self.vocab | self.added
        self.text_of = {i: t for t, i in self.ids.items()}
        self.rank: dict[tuple[str, str], int] = {}
        for n, pair in enumerate(self.merges):
            self.rank.setdefault(tuple(pair.split(" ", 1)), n)
        self.languages = {t[2:-2]: i for t, i in self.ids.items() if _LANGUAGE.match(t)}
        names = {"eot": ["<|endoftext|>"], "sot": ["<|startoftranscript|>"], "translate": ["<|translate|>"], "transcribe": ["<|transcribe|>"], "sot_lm": ["<|startoflm|>"], "sot_prev": ["<|startofprev|>"], "no_speech": ["<|nospeech|>", "<|nocaptions|>"], "no_timestamps": ["<|notimestamps|>"]}
        found = {k: next((self.ids[t] for t in v if t in self.ids), None) for k, v in names.items()}
        if missing := [names[k][0] for k, v in found.items() if v is None]:
            raise ValueError("special tokens are missing: " + ", ".join(missing))
        self.special: dict[str, int] = found
        self.eot = found["eot"]
        self.time_begin = found["no_timestamps"] + 1

    @classmethod
    def from_json(cls, text: str) -> Tokenizer:
        data = json.loads(text)
        return cls(data["model"]["vocab"], [m if isinstance(m, str) else " ".join(m) for m in data["model"]["merges"]], {t["content"]: t["id"] for t in data.get("added_tokens", [])})

    def language(self, code: str) -> int:
        return self.languages.get(code, -1)

    def merge(self, word: str) -> list[str]:
        """Pairs joined by lowest rank, leftmost first, until no pair has a rank."""
        parts = list(word)
        while len(parts) > 1:
            best, at = min((self.rank.get(pair, len(self.rank)), k) for k, pair in enumerate(zip(parts, parts[1:], strict=False)))
            if best == len(self.rank):
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def encode(self, text: str) -> list[int]:
        """Ids of the text; parts that the vocabulary lacks are left out."""
        words = ("".join(_CHAR[b] for b in w.encode()) for w in _PRETOKEN.findall(text))
        return [self.vocab[p] for w in words for p in self.merge(w) if p in self.vocab]

    def bytes_of(self, token: int) -> bytes:
        return b"".join(bytes([_BYTE[c]]) if c in _BYTE else c.encode() for c in self.text_of.get(token, ""))

    def decode(self, tokens: Iterable[int]) -> str:
        """Special and unknown ids are skipped."""
        return b"".join(self.bytes_of(t) for t in tokens if t < self.eot).decode("utf-8", "replace")

    def decode_with_times(self, tokens: Iterable[int]) -> str:
        """Timestamps as <|0.00|>, other specials skipped."""
        out, held = [], []
        for t in tokens:
            if t >= self.time_begin:
                out += [self.decode(held), f"<|{(t - self.time_begin) * TIME_STEP:.2f}|>"]
                held = []
            else:
                held.append(t)
        return "".join([*out, self.decode(held)])

    def non_speech(self) -> list[int]:
        """Ids of symbols that are one token, with or without a space before them, of music and of a leading dash or quote."""
        found = {self.encode(" -")[:1][0] if self.encode(" -") else None, self.encode(" '")[:1][0] if self.encode(" '") else None}
        for symbol in [*SYMBOLS, *MUSIC]:
            for ids in (self.encode(symbol), self.encode(" " + symbol)):
                if ids and (len(ids) == 1 or symbol in MUSIC):
                    found.add(ids[0])
        return sorted(found - {None})

    def suppressed(self, wanted: Iterable[int]) -> list[int]:
        """The wanted ids; -1 stands for all that are no speech; always the special ids that start a context."""
        wanted = set(wanted)
        out = {t for t in wanted if t >= 0} | (set(self.non_speech()) if -1 in wanted else set())
        return sorted(out | {self.special[k] for k in ("transcribe", "translate", "sot", "sot_prev", "sot_lm", "no_speech")})

    def start_sequence(self, language: str | None, task: str) -> list[int]:
        if not language:
            return [self.special["sot"]]
        code = self.language(language)
        return [self.special["sot"], *([code] if code >= 0 else []), self.special[task]]

    def prompt(self, language: str | None, task: str, previous: list[int] = (), hotwords: str | None = None, prefix: str | None = None, timestamps: bool = True) -> list[int]:
        """Context (hot words' head or previous tokens' tail, half the room each), start, and the forced beginning."""
        room = CONTEXT_TOKENS - 1
        hot = self.encode(" " + hotwords.strip()) if hotwords and not prefix else []
        begin = self.encode(" " + prefix.strip()) if prefix else []
        hot, begin = (x[:room] if len(x) > room else x for x in (hot, begin))
        context = [*hot, *list(previous)[-room:]]
        out = [self.special["sot_prev"], *context] if context else []
        out += self.start_sequence(language, task)
        if not timestamps:
            out.append(self.special["no_timestamps"])
        elif begin:
            out.append(self.time_begin)
        return out + begin

    def words(self, tokens: list[int], language: str | None) -> tuple[list[str], list[list[int]]]:
        """Words and their tokens: by complete characters, and for spaced scripts joined up to the next space, special
        token or ASCII punctuation. Tokens whose last character is incomplete at the end are left out."""
        pieces: list[tuple[str, list[int]]] = []
        held: list[int] = []
        for t in tokens:
            held.append(t)
            text = self.text_of.get(t, "") if t >= self.eot else b"".join(map(self.bytes_of, held)).decode("utf-8", "replace")
            if "�" not in text or self._whole(tokens, text):
                pieces.append((text, held))
                held = []
        if language in UNSPACED:
            return [p[0] for p in pieces], [p[1] for p in pieces]
        words: list[str] = []
        groups: list[list[int]] = []
        for text, ids in pieces:
            alone = ids[0] >= self.eot or text.startswith(" ") or (len(text) == 1 and text in string.punctuation)
            if alone or not words:
                words.append(text)
                groups.append(list(ids))
            else:
                words[-1] += text
                groups[-1] += ids
        return words, groups

    def _whole(self, tokens: list[int], text: str) -> bool:
        """A replacement character that the text itself has is no cut."""
        return text.replace("�", "") == "" and "�" in self.decode(tokens) and text.encode() in b"".join(map(self.bytes_of, tokens))


def split_segments(tokens: list[int], time_begin: int, offset: float, size: int, duration: float, seek: int) -> tuple[list[tuple[float, float, list[int]]], int, bool]:
    """(segments (start, end, tokens), next seek, whether one lone timestamp ends the sequence).

    Two timestamps in a row part segments. What follows the last such place belongs to the next window, unless a lone
    timestamp closes it. Without such places everything is one segment, up to the last timestamp that is not the first.
    """
    stamp = lambda t: (t - time_begin) * TIME_STEP
    marks = [t >= time_begin for t in tokens]
    lone = len(tokens) >= 2 and marks[-1] and not marks[-2]
    cuts = [i for i in range(1, len(tokens)) if marks[i] and marks[i - 1]]
    if not cuts:
        times = [t for t in tokens if t >= time_begin]
        end = stamp(times[-1]) if times and times[-1] != time_begin else duration
        return [(offset, offset + end, list(tokens))], seek + size, lone
    if lone:
        cuts.append(len(tokens))
    parts = [tokens[a:b] for a, b in zip([0, *cuts[:-1]], cuts, strict=True)]
    segments = [(offset + stamp(p[0]), offset + stamp(p[-1]), list(p)) for p in parts]
    return segments, seek + (size if lone else (tokens[cuts[-1] - 1] - time_begin) * FRAMES_PER_TIME), lone


def timestamp_segments(df: DataFrame, time_begin: int, tokens: str = "tokens", offset: str = "offset", size: str = "size", duration: str = "duration", seek: str = "seek") -> DataFrame:
    """df with struct split(segments, seek, lone) of each row's tokens; a null sequence is empty."""

    @F.pandas_udf(f"struct<segments: array<{RAW_SEGMENT}>, seek: bigint, lone: boolean>")
    def split(t: pd.Series, o: pd.Series, z: pd.Series, d: pd.Series, k: pd.Series) -> pd.DataFrame:
        rows = [split_segments([] if x is None else [int(v) for v in x], time_begin, a, int(b), c, int(e)) for x, a, b, c, e in zip(t, o, z, d, k, strict=True)]
        return pd.DataFrame({"segments": [[{"start": s, "end": e, "tokens": x} for s, e, x in r[0]] for r in rows], "seek": [r[1] for r in rows], "lone": [r[2] for r in rows]})

    return df.withColumn("split", split(tokens, F.col(offset).cast("double"), size, F.col(duration).cast("double"), seek))


def look_up(tokens: DataFrame, vocab: DataFrame, key: list[str], eot: int) -> DataFrame:
    """(key..., text): the texts of each row's ids joined in order; special and unknown ids are left out.

    vocab (id, token) is a tokenizer's, a few MB whatever the data's size, and so is broadcast.
    """
    rows = tokens.select(*key, F.posexplode("tokens").alias("pos", "id")).filter(F.col("id") < eot)
    joined = rows.join(F.broadcast(vocab.select("id", "token")), "id")
    ordered = F.array_sort(F.collect_list(F.struct("pos", "token")))
    return joined.groupBy(*key).agg(F.array_join(F.transform(ordered, lambda x: x["token"]), "").alias("text"))


def language_token(codes: DataFrame, languages: DataFrame, code: str = "code") -> DataFrame:
    """codes with token, -1 where the language is unknown; languages (language, token) has a row for each, about a hundred."""
    named = F.broadcast(languages.select(F.col("language").alias(code), "token"))
    return codes.join(named, code, "left").withColumn("token", F.coalesce("token", F.lit(-1)))


def union_ids(*ids: Column) -> Column:
    out = ids[0]
    for x in ids[1:]:
        out = F.array_union(out, x)
    return F.array_sort(F.array_distinct(out))


def encode_udf(tokenizer_json: str):
    """A column function from text to array<int>."""

    @F.pandas_udf("array<int>")
    def encode(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenizer = Tokenizer.from_json(tokenizer_json)
        for t in texts:
            # ids as numbers of four bytes: a batch's lists of Python's own would be the most that a worker holds
            yield t.map(lambda x: None if x is None else np.array(tokenizer.encode(x), dtype=np.int32))

    return encode


def decode_udf(tokenizer_json: str, times: bool = False):
    """A column function from array<int> to text."""

    @F.pandas_udf("string")
    def decode(ids: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenizer = Tokenizer.from_json(tokenizer_json)
        read = tokenizer.decode_with_times if times else tokenizer.decode
        for t in ids:
            yield t.map(lambda x: None if x is None else read([int(v) for v in x]))

    return decode
