"""Quality rules as a short-circuit cascade.

Every rule is a test on one document that needs some measures of it. On a sample the cascade times each rule's measures and
counts what it rejects, then puts the rules in falling order of rejections per cost; what an earlier rule has rejected is
never measured for later ones. The order changes the time only: a document is kept if no rule rejects it.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonara.llm.common import map_arrow, map_batches, pieces, text_of

#: Symbols that mark junk (fixed value).
SYMBOLS = "#*$%&|<>"
#: Rows and characters at most that the cascade is ordered by; the verdict does not depend on them.
SAMPLE_ROWS, SAMPLE_CHARS = 200, 2_000_000
_WHITE = b" \t\n\x0b\x0c\r"


class Document:
    """A text and the measures taken of it so far."""

    def __init__(self, text: str):
        self.text, self._taken = text, {}

    def get(self, name: str) -> float:
        if name not in self._taken:
            self._taken[name] = getattr(self, name)()
        return self._taken[name]

    def words(self) -> list[bytes]:
        return self.text.encode().split()  # of bytes: at ASCII white space only

    def n_words(self) -> int:
        return len(self.get("words"))

    def word_chars(self) -> int:
        return len(self.text) - sum(self.text.count(chr(c)) for c in _WHITE)

    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    def lines(self) -> list[str]:
        return [x for x in self.text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]

    def n_dup_lines(self) -> int:
        lines = self.get("lines")
        return len(lines) - len(set(lines))

    def codes(self) -> np.ndarray:
        place: dict[bytes, int] = {}
        return np.array([place.setdefault(w, len(place)) for w in self.get("words")], dtype=np.int64)

    def n_adjacent(self) -> int:
        """Words that equal the word before."""
        codes = self.get("codes")
        return int((codes[1:] == codes[:-1]).sum())

    def n_repeat_words(self, width: int = 5) -> int:
        """Words inside a window of five words that the text holds twice or more, the first included."""
        codes = self.get("codes")
        count = len(codes) - width + 1
        if count < 2:
            return 0
        window = codes[:count]
        for k in range(1, width):  # exact: each step numbers the distinct (prefix, word) pairs
            keys = window * (int(codes.max()) + 1) + codes[k : k + count]
            if k < width - 1 and int(window.max()) < 2**31:
                window = np.unique(keys, return_inverse=True)[1]
            else:
                window = keys
            if k == 1:
                repeats = np.bincount(window)
                if len(repeats) == count:  # no two words come twice in a row, so no five do
                    return 0
        _, inverse, counts = np.unique(window, return_inverse=True, return_counts=True)
        found = np.flatnonzero(counts[inverse] > 1)
        edges = np.zeros(len(codes) + 1, dtype=np.int64)
        np.add.at(edges, found, 1)
        np.add.at(edges, found + width, -1)
        return int((np.cumsum(edges)[:-1] > 0).sum())


@dataclass(frozen=True)
class Rule:
    """Rejects a document if test(document) holds; base rules are told apart in the result."""

    name: str
    test: Callable[[Document], bool] = field(compare=False)
    base: bool = False


#: In the order in which a rejection is named. A text has to fail clearly: sound prose stays far from these bounds.
RULES = (
    Rule("too_few_words", lambda d: d.get("n_words") < 10, base=True),
    Rule("repeated_windows", lambda d: 100 * d.get("n_repeat_words") > 20 * d.get("n_words"), base=True),
    Rule("symbols", lambda d: 10 * d.get("n_symbols") > d.get("n_words")),
    Rule("adjacent_repeats", lambda d: 5 * d.get("n_adjacent") > d.get("n_words")),
    Rule("duplicate_lines", lambda d: 2 * d.get("n_dup_lines") > len(d.get("lines"))),
    Rule("word_length", lambda d: not 2 * d.get("n_words") <= d.get("word_chars") <= 20 * d.get("n_words")),
)
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def order_rules(texts: list[str], rules: tuple[Rule, ...] = RULES) -> list[Rule]:
    """The rules by falling (rejected share + a little) / seconds on these texts; without texts as they are given."""
    if not texts:
        return list(rules)
    scores = []
    for place, rule in enumerate(rules):
        documents = [Document(t) for t in texts]
        began = time.perf_counter()
        rejected = sum(map(rule.test, documents))
        cost = time.perf_counter() - began
        scores.append((-(rejected / len(texts) + 1e-3) / max(cost, 1e-9), place))
    return [rules[place] for _, place in sorted(scores)]


def cascade(document: Document, ordered: list[Rule]) -> bool:
    """True if no rule rejects the document; stops at the first that does."""
    return not any(rule.test(document) for rule in ordered)


def sample_texts(df: DataFrame, text_col: str = "text", rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> list[str]:
    """Some texts to time the rules on, each cut short; only the cascade's order rests on them."""
    each = max(1, chars // rows)
    return [r[0] for r in df.select(F.substring(text_of(text_col), 1, each).alias("t")).limit(rows).collect()]


def quality_verdicts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, measures: tuple[str, ...] = MEASURES) -> DataFrame:
    """(id_col, measures..., base_failed, kept) of every row.

    A null text has no words and is rejected, as the empty text is. Repeated rows each get their verdict. Columns besides
    the two are not read.
    """
    ordered = order_rules(sample_texts(df, text_col), rules)
    base = [r for r in ordered if r.base]
    rest = [r for r in ordered if not r.base]
    rows = df.select(df[id_col].cast("bigint").alias("id"), text_of(text_col).alias("text"))

    def start() -> Callable[[pa.RecordBatch], Iterator[dict]]:
        def each(batch: pa.RecordBatch) -> Iterator[dict]:
            for part, texts in pieces(batch):
                out: dict = {"id": part.column(0)} | {m: [] for m in measures} | {"base_failed": [], "kept": []}
                for text in texts:
                    document = Document(text)
                    failed = not cascade(document, base)
                    out["base_failed"].append(failed)
                    out["kept"].append(not failed and cascade(document, rest))
                    for m in measures:
                        out[m].append(document.get(m))
                yield out | {m: pa.array(out[m], pa.int64()) for m in measures} | {k: pa.array(out[k], pa.bool_()) for k in ("base_failed", "kept")}

        return each

    schema = "id bigint, " + "".join(f"{m} bigint, " for m in measures) + "base_failed boolean, kept boolean"
    return map_arrow(rows, start, schema).withColumnRenamed("id", id_col)


def quality_filter(df: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows that no rule rejects, with all their columns; every row passes the cascade where it lies, nothing moves."""
    ordered = order_rules(sample_texts(df, text_col), rules)
    place = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in pieces(batch, place):
                yield part.filter(pa.array([cascade(Document(t), ordered) for t in texts], pa.bool_()))

    return map_batches(df, run, df.schema)
