"""Fill-in-middle: a text is cut at two places between its units, and its parts are put in another order between sentinels.

A text is an array of code points (UTF-32). Each code point has a class, neighbouring classes say where units end, the two
chosen units index these ends, and the parts are slices that are encoded again. Which units are chosen and which form a
text takes is decided by a hash of its id, so reruns and lost tasks give the same rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonara.llm.common import map_arrow, pieces, text_of

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_SPACE = np.array([9, 10, 11, 12, 13, 32], dtype=np.uint32)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def text_from(points: np.ndarray) -> str:
    return points.tobytes().decode("utf-32-le", "surrogatepass")


def unit_ends(points: np.ndarray, unit: str = "lines") -> np.ndarray:
    """Where the units end of which a text consists, from left to right. Lines keep their line end. A word is a run of other
    than ASCII white space with the white space before it; white space at the text's end is a unit too."""
    if not len(points):
        return np.zeros(0, dtype=np.int64)
    if unit == "lines":
        ends = points[:-1] == 10  # behind a line end begins a unit, whatever the class of the next
    elif unit == "words":
        space = np.isin(points, _SPACE)
        ends = ~space[:-1] & space[1:]
    else:
        raise ValueError(f"no such unit: {unit}")
    return np.append(np.flatnonzero(ends) + 1, len(points))


def draws(seed: int, doc_id: int | None) -> list[int]:
    """Four numbers of 32 bits from the sha256 of "seed:id" (a null id: "null")."""
    digest = hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]


def check_sentinels(sentinels: tuple[str, str, str]) -> None:
    """Sentinels have to be found again wherever they stand: none may begin as another one ends, nor hold another one."""
    for k, a in enumerate(sentinels):
        for j, b in enumerate(sentinels):
            if not a or (k != j and a in b) or any(a[-n:] == b[:n] for n in range(1, min(len(a), len(b)))):
                raise ValueError(f"sentinels {a!r} and {b!r} could be taken for each other")


def rearranged(text: str, h: list[int], sentinels: tuple[str, str, str], unit: str, rate: int, spm: int) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, code points of the prefix and of the middle, output)."""
    points = code_points(text)
    ends = unit_ends(points, unit)
    n = len(ends)
    if not n or any(s in text for s in sentinels) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    bounds = np.append(0, ends)
    a, b = bounds[sorted((h[0] % (n + 1), h[1] % (n + 1)))].tolist()
    prefix, middle, suffix = (text_from(p) for p in (points[:a], points[a:b], points[b:]))
    p, s, m = sentinels
    if h[3] % 100 < spm:
        return n, "spm", a, b - a, f"{s}{suffix}{p}{prefix}{m}{middle}"
    return n, "psm", a, b - a, f"{p}{prefix}{s}{suffix}{m}{middle}"


def fill_in_middle(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentinels: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE), unit: str = "lines", rate: int = 100, spm: int = 50, seed: int = 7) -> DataFrame:
    """(id_col, n, form, prefix_chars, middle_chars, output) of each row.

    n is the number of units; form is psm (prefix, suffix, middle), spm (suffix, prefix, middle) or plain; `rate` texts in a
    hundred are rearranged, `spm` in a hundred of these as spm. Plain are empty texts, too, and those that hold a sentinel.
    A null text is empty; rows with a null id are hashed alike and rows with equal ids cut alike; a table without rows gives
    none. Columns besides the two are not read. One result row for each row, no shuffle; a worker holds one slice of a batch.
    """
    check_sentinels(sentinels)
    rows = df.select(df[id_col].cast("bigint").alias("id"), text_of(text_col).alias("text"))

    def start() -> Callable[[pa.RecordBatch], Iterator[dict]]:
        def each(batch: pa.RecordBatch) -> Iterator[dict]:
            for part, texts in pieces(batch):
                made = [rearranged(t, draws(seed, i), sentinels, unit, rate, spm) for i, t in zip(part.column(0).to_pylist(), texts, strict=True)]
                n, form, prefix, middle, output = zip(*made, strict=True)
                yield {"id": part.column(0), "n": pa.array(n, pa.int64()), "form": pa.array(form, pa.string()), "prefix_chars": pa.array(prefix, pa.int64()), "middle_chars": pa.array(middle, pa.int64()), "output": pa.array(output, pa.string())}

        return each

    return map_arrow(rows, start, "id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string").withColumnRenamed("id", id_col)


def fim_restore(df: DataFrame, sentinels: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> DataFrame:
    """df with `restored`: the text that each row's output and form were made from, by column functions alone, as no sentinel
    stands in a rearranged text. A null output or form gives null; rows stay one for one."""
    p, s, m = map(F.lit, sentinels)
    out, spm = F.col("output"), F.col("form") == "spm"
    first, second = F.when(spm, s).otherwise(p), F.when(spm, p).otherwise(s)
    at_second, at_middle = F.position(second, out), F.position(m, out)
    between = lambda a, b: F.substr(out, a, b - a)
    ahead = between(F.length(first) + 1, at_second)
    behind = between(at_second + F.length(second), at_middle)
    middle = F.substr(out, at_middle + F.length(m))
    whole = F.when(spm, F.concat(behind, middle, ahead)).when(F.col("form") == "psm", F.concat(ahead, middle, behind)).when(F.col("form") == "plain", out)
    return df.withColumn("restored", whole)


def fim_digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) of fill_in_middle's rows, the restored
    text read from output and form."""
    made = fim_restore(fill_in_middle(df, id_col, text_col))
    return made.select(id_col, "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))
