"""SimHash near-duplicates by pigeonhole blocks.

Rows of equal fingerprints are one class from the start, so groups of copies cost nothing later. Distinct fingerprints are
split into blocks; near pairs agree in some blocks, so keys made of blocks bring them together, and the Hamming distance
of each pair that met is verified. Two ways to make keys:

* `exact_keys` for short distances: with k + c blocks, two fingerprints that differ in k bits agree in c blocks at least, and
  each choice of c blocks is a key. No pair within k bits is lost.
* `wide_links` for a similarity of shingle sets: so many bits belong to it that no few blocks are sure to agree. Wide
  fingerprints have many blocks; a block's width follows the number of fingerprints (log2), so the pairs that meet by chance
  stay a constant number a row. These pairs are candidates: each is judged by its shingle sets. What the blocks miss is
  found by `rest_links`: two sets of a similarity share one of their first few shingles, in any fixed order of shingles.

A key that many fingerprints share would make pairs as the square of their number. Such keys go another way, which links the
same fingerprints: for a distance of up to 2 through the points between (two fingerprints are within 2 bits if and only
if some point is within one bit of both: 65 rows a fingerprint). Candidates of a crowded block are looked for in parts of its
rows, each with the same hub of them, which is in proportion to the rows; what that misses is among the rest. On a crowded
shingle, texts that can't reach the similarity with another's there drop out by their sizes and the shingle's place in their
orders, and so do shingles on which all that stay are connected. What is left is compared part by part, the rows of the
component that most are in only with those of others.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonara.llm.common import map_arrow, map_batches, pieces, text_of, tidy, written
from sonara.llm.components import components

SEED = 42
#: Fingerprints on one key of which all pairs are joined; 64 is about what the other way takes for each.
PAIRS_MOST = 64
#: The same for wide fingerprints, where a block's chance matches are one or two.
WIDE_PAIRS_MOST = 8
#: 64-bit lanes of a wide fingerprint, at any number of texts.
WIDE_LANES = 10
#: Shingles are counted by the texts that have them, all texts' shingles in buckets of their hashes. Of this many slots of hashes
#: each knows the count of its most frequent shingle, if over RARE texts have that; the table's size (16 MB) and the bound bear
#: on speed only.
SLOT_BITS, RARE = 24, 4
#: Sets of so many shingles at most are compared themselves. A larger pair of the similarity lies within FAR standard
#: deviations of the bits in which it is expected to differ: of a thousand million such pairs one might not.
SMALL, FAR = 40, 6
#: Rows of a part where a large key is compared part by part.
PART_ROWS = 512
_LOWER = {c: c + 32 for c in range(65, 91)}
_MIX = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)


def shingle_hashes(text: str, width: int) -> np.ndarray:
    """XXH64 of each run of so many words, repeats included; of all words if there are fewer; none without words."""
    words = text.translate(_LOWER).encode().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    shingles = map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
    return np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), dtype=np.uint64)


def _counts(bits: np.ndarray) -> np.ndarray:
    """How often each column of a 0/1 byte matrix is set: sums of 255 rows still fit in bytes."""
    full = len(bits) // 255 * 255
    parts = bits[:full].reshape(-1, 255, bits.shape[1]).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return parts + bits[full:].sum(axis=0, dtype=np.uint8)


def fingerprint(hashes: np.ndarray, lanes: int = 1) -> np.ndarray:
    """64 * lanes bits as unsigned integers, lowest bit first: set where over half the hashes have it. Zero without hashes.
    Lane 0 has the hashes' own bits, the others those of hashes mixed with a constant each."""
    out = np.zeros(lanes, dtype=np.uint64)
    if not len(hashes):
        return out
    for lane in range(lanes):
        h = hashes
        if lane:
            h = (h ^ (h >> np.uint64(29))) * _MIX[lane]
            h = (h ^ (h >> np.uint64(32))) * _MIX[-lane]
            h ^= h >> np.uint64(29)
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        out[lane] = np.packbits(_counts(bits) * 2 > len(h), bitorder="little").view("<u8")[0]
    return out


def fingerprints(df: DataFrame, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint bigint) of every row; a null text is empty and has fingerprint zero."""
    rows = df.select(df[id_col].cast("bigint").alias("id"), text_of(text_col).alias("text"))

    def start() -> Callable[[pa.RecordBatch], Iterator[dict]]:
        def each(batch: pa.RecordBatch) -> Iterator[dict]:
            for part, texts in pieces(batch):
                found = np.array([fingerprint(shingle_hashes(t, width))[0] for t in texts], dtype=np.uint64)
                yield {"id": part.column(0), "fingerprint": pa.array(found.view(np.int64), pa.int64())}

        return each

    return map_arrow(rows, start, "id bigint, fingerprint bigint")


def exact_keys(distance: int, extra: int = 2) -> Column:
    """Keys of a 64-bit fingerprint: each choice of `extra` of distance + extra blocks, with their bits."""
    count = distance + extra
    edges = [round(64 * i / count) for i in range(count + 1)]
    masks = [(1 << b) - (1 << a) for a, b in itertools.pairwise(edges)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    keys = [F.struct(F.lit(i).alias("k"), F.col("fingerprint").bitwiseAND(F.lit(signed(sum(chosen))).cast("bigint")).alias("v")) for i, chosen in enumerate(itertools.combinations(masks, extra))]
    return F.explode(F.array(*keys))


def _links_of_small(rows: DataFrame, near: Callable[[Column, Column], Column]) -> DataFrame:
    """(a, b) of near pairs with a common key, among rows (key, id, fingerprint) of keys that few share."""
    left = rows.select("key", F.col("id").alias("a"), F.col("fingerprint").alias("fa"))
    right = rows.select("key", F.col("id").alias("b"), F.col("fingerprint").alias("fb"))
    return left.join(right, "key").filter((F.col("a") < F.col("b")) & near(F.col("fa"), F.col("fb"))).select("a", "b")


def _by_key_size(keyed: DataFrame, most: int) -> tuple[DataFrame, DataFrame, str]:
    """Rows (key, ...) of keys that 2 to `most` share, those of keys that more share, with their number n, and where both
    are written: few keys are shared, so the rest isn't dealt out again for each."""
    counts = keyed.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > 1)
    rows, at = written(keyed.join(counts, "key"), "shared")
    return rows.filter(F.col("n") <= most), rows.filter(F.col("n") > most), at


def near_fingerprints(prints: DataFrame, distance: int = 2) -> DataFrame:
    """(a, b) links between distinct fingerprints (column fingerprint) of up to 2 differing bits. The links connect just
    the pairs in range, though a pair on a crowded key may be linked through others in range of both."""
    if not 1 <= distance <= 2:
        raise ValueError("the way for crowded keys is for distances 1 and 2")
    keyed, _ = written(prints.select(F.col("fingerprint").alias("id"), "fingerprint", exact_keys(distance).alias("key")), "blocks")
    few, many, _ = _by_key_size(keyed, PAIRS_MOST)
    links = _links_of_small(few, lambda x, y: F.bit_count(x.bitwiseXOR(y)) <= distance)
    crowded = many.select("fingerprint").distinct()
    flips = F.array(F.lit(0).cast("bigint"), *(F.lit(1 << i if i < 63 else -(1 << 63)).cast("bigint") for i in range(64)))
    if distance == 2:
        points = crowded.select("fingerprint", F.explode(flips).alias("flip")).select("fingerprint", F.col("fingerprint").bitwiseXOR(F.col("flip")).alias("point"))
    else:  # a pair one bit apart is alike but for that bit: two fingerprints at most for each bit and rest
        rests = F.transform(flips, lambda x: F.struct(x.alias("bit"), F.col("fingerprint").bitwiseAND(F.bitwise_not(x)).alias("rest")))
        points = crowded.select("fingerprint", F.explode(F.filter(rests, lambda r: r["bit"] != 0)).alias("point"))
    least = points.groupBy("point").agg(F.min("fingerprint").alias("a"), F.max("fingerprint").alias("z")).filter(F.col("a") < F.col("z"))
    through = points.join(least, "point").select("a", F.col("fingerprint").alias("b")).filter(F.col("a") < F.col("b"))
    return links.union(through).distinct()


#: A fingerprint with over this share of all rows is joined by broadcast: fewer than 1 / HOT_SHARE can be.
HOT_SHARE = 0.001


def _named(rows: DataFrame, of: DataFrame) -> DataFrame:
    """rows (id, fingerprint) with the component_id of `of` (fingerprint, component_id, n rows). Fingerprints of very many
    rows (copies, or zero for all empty texts) would each be one task of a join, so their rows stay where they lie."""
    total = of.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") > F.lit(total * HOT_SHARE)
    heavy = F.broadcast(of.filter(hot).select("fingerprint", "component_id"))
    light = rows.join(heavy, "fingerprint", "left_anti").join(of.filter(~hot).select("fingerprint", "component_id"), "fingerprint")
    return rows.join(heavy, "fingerprint").unionByName(light)


def near_duplicates(df: DataFrame, width: int = 3, distance: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fingerprint, component_id) of every row: the fingerprint as 16 hexadecimal digits, and the smallest id that
    links of up to `distance` bits lead to.

    Null and empty texts have fingerprint zero and are linked like others. Rows with a null id get the component of their
    fingerprint and never name one, so that is null where all ids are. Repeated rows each get a result.
    """
    rows, _ = written(fingerprints(df, width, id_col, text_col), "fingerprints")
    classes, _ = written(rows.groupBy("fingerprint").agg(F.min("id").alias("least"), F.count("*").alias("n")), "classes")
    links, _ = written(near_fingerprints(classes, distance), "links")
    joined = components(links, "a", "b")
    of = classes.join(joined.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").withColumn("component", F.coalesce("component", "fingerprint"))
    least = of.groupBy("component").agg(F.min("least").alias("component_id"))
    of, _ = written(of.join(least, "component").select("fingerprint", "component_id", "n"), "components")
    named = _named(rows, of)
    return named.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def differing_share(similarity: float) -> float:
    """The share of SimHash bits in which two equally large shingle sets of this Jaccard similarity differ."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def wide_plan(count: int, similarity: float, recall: float) -> tuple[int, int]:
    """(bits of a block, blocks) for so many fingerprints: a block holds log2 of their number in bits, 16 at least, and
    there are enough blocks for a pair of the similarity to share one with probability `recall`."""
    bits = min(62, max(16, math.ceil(math.log2(max(2, count)))))
    share = (1 - differing_share(similarity)) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - share))


def bits_apart(similarity: float, deviations: float) -> int:
    """Bits of a wide fingerprint in which two sets of the similarity differ at most, up to so many standard deviations."""
    count, share = 64 * WIDE_LANES, differing_share(similarity)
    return math.floor(count * share + deviations * math.sqrt(count * share * (1 - share)))


def _unpack(fingerprint: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(fingerprint).astype("<i8").view(np.uint8), axis=1, bitorder="little")


def _differ(x: str, y: str) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, n: s + n)


def _with_prints(pairs: DataFrame, shapes: DataFrame) -> DataFrame:
    """Pairs (a, b) with their fingerprints and numbers of shingles, fa and fb, na and nb."""
    side = lambda k: shapes.select(F.col("id").alias(k), F.col("fingerprint").alias(f"f{k}"), F.col("n").alias(f"n{k}"))
    return pairs.join(side("a"), "a").join(side("b"), "b")


def wide_links(shapes: DataFrame, bits: int, blocks: int, most: int) -> tuple[DataFrame, str]:
    """(a, b) near pairs of (id, fingerprint array<bigint>, n), written: they share a block of `bits` bits and differ in
    `most` bits."""
    weights = 1 << np.arange(bits, dtype=np.int64)

    def start() -> Callable[[pa.RecordBatch], Iterator[dict]]:
        def each(batch: pa.RecordBatch) -> Iterator[dict]:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                matrix = np.stack(part.column(1).to_numpy(zero_copy_only=False))
                values = _unpack(matrix)[:, : bits * blocks].reshape(len(matrix), blocks, bits).astype(np.int64) @ weights
                rows = pa.array(np.repeat(np.arange(len(matrix)), blocks))
                yield {"block": pa.array(np.tile(np.arange(blocks, dtype=np.int32), len(matrix))), "v": pa.array(values.ravel()), "id": part.column(0).take(rows)}

        return each

    keyed, keyed_at = written(map_arrow(shapes.select("id", "fingerprint"), start, "block int, v bigint, id bigint").select(F.struct("block", "v").alias("key"), "id"), "blocks")
    few, many, shared_at = _by_key_size(keyed, WIDE_PAIRS_MOST)
    tidy(shapes.sparkSession, keyed_at)
    left, right = few.select("key", F.col("id").alias("a")), few.select("key", F.col("id").alias("b"))
    met, met_at = written(left.join(right, "key").filter(F.col("a") < F.col("b")).select("a", "b").distinct(), "met")
    near = _with_prints(met, shapes).filter(_differ("fa", "fb") <= most).select("a", "b")
    found = written(near.union(_links_of_large(many, shapes, most)).distinct(), "near")
    tidy(shapes.sparkSession, shared_at, met_at)
    return found


def _links_of_large(many: DataFrame, shapes: DataFrame, most: int) -> DataFrame:
    """(a, b) among rows (key, id, n) of crowded keys: each key's rows are dealt to parts, and each part is compared by itself.
    Of each class of linked rows all are named with the least id, so a group that shares many keys gives about one row for
    each member and not one for each link. Pairs of different parts that the hub does not connect are left to other keys,
    where they are dealt otherwise, and to rest_links."""
    rows = _in_parts(many, "id").join(shapes.select("id", "fingerprint"), "id")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id")
        ids = group["id"].to_numpy()
        bits = _unpack(np.stack(group["fingerprint"].to_numpy())).astype(np.float32) * 2 - 1
        near = bits @ bits.T >= bits.shape[1] - 2 * most
        label = np.arange(len(ids))
        while True:  # each row takes the least label among those near it, until classes are closed
            least = np.where(near, label, len(ids)).min(axis=1)
            least = np.minimum(least, least[least])
            if (least == label).all():
                break
            label = least
        other = np.flatnonzero(label != np.arange(len(ids)))
        return pd.DataFrame({"a": ids[label[other]], "b": ids[other]})

    return rows.groupBy("key", "part").applyInPandas(compare, "a bigint, b bigint")


def _in_parts(many: DataFrame, *columns: str) -> DataFrame:
    """Rows (key, columns, part): each key's rows are dealt to parts, of which the first, the hub, goes with each other one: so
    there are about two rows for each at most."""
    parts = F.ceil(F.col("n") / PART_ROWS).cast("int")
    rows = many.select("key", *columns, parts.alias("parts"), F.pmod(F.xxhash64("id", "key"), parts).cast("int").alias("own"))
    hub = (F.col("own") == 0) & (F.col("parts") > 1)
    return rows.select("key", *columns, F.explode(F.when(hub, F.sequence(F.lit(1), F.greatest(F.col("parts") - 1, F.lit(1)))).otherwise(F.array("own"))).alias("part"))


def shingle_set(text: str, width: int) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted; a single zero without words, so that such texts are alike."""
    found = np.unique(shingle_hashes(text, width))
    return found if len(found) else np.zeros(1, dtype=np.uint64)


def _alike(common: np.ndarray, n: np.ndarray, m: np.ndarray, similarity: float) -> np.ndarray:
    return common >= similarity * (n + m - common) - 1e-9


def _largest_fit(n: Column, at: Column, similarity: float) -> Column:
    """The largest size of a set that can have the similarity with one of n shingles, if the first that they have in common is
    at this place (from 0) in its order: n - at of them at most are in both."""
    return (n - at) * ((1 + similarity) / similarity) - n + 1e-6


def _fit(n: Column, i: Column, m: Column, j: Column, similarity: float) -> Column:
    """Whether sets of n and m shingles can have the similarity, if the first common one is at the places i and j."""
    return (_largest_fit(n, i, similarity) >= m) & (_largest_fit(m, j, similarity) >= n)


def verified(pairs: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of ids whose texts' shingle sets have this Jaccard similarity at least; texts are (id, text)."""
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("y")), "b").select("a", "b", "x", "y")

    def start() -> Callable[[pa.RecordBatch], Iterator[dict]]:
        def each(batch: pa.RecordBatch) -> Iterator[dict]:
            near = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = shingle_set(x.as_py(), width), shingle_set(y.as_py(), width)
                near.append(bool(_alike(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), similarity)))
            kept = batch.filter(pa.array(near, pa.bool_()))
            yield {"a": kept.column(0), "b": kept.column(1)}

        return each

    return map_arrow(both, start, "a bigint, b bigint")


def shingle_levels(texts: DataFrame, count: int, width: int) -> np.ndarray:
    """How frequent the shingles of each slot (a hash's first SLOT_BITS bits) are among all texts (id, text): twice the binary
    logarithm of the count of texts of the slot's most frequent shingle, 0 if RARE texts at most have each of its shingles.

    Frequent shingles go last in the order of shingles. A rare one that shares its slot with a frequent one goes there too,
    which takes no link. Hashes are dealt out by their first bits, in as many buckets as keep one small at any number of
    texts; a batch's repeats are added up before. A bucket is a run of slots, so what comes to the driver is the table.
    """
    bits = min(SLOT_BITS, max(6, math.ceil(math.log2(max(2, count))) - 8))
    shift, low = np.uint64(64 - bits), np.uint64(64 - SLOT_BITS)

    def start() -> Callable[[pa.RecordBatch], Iterator[dict]]:
        def each(batch: pa.RecordBatch) -> Iterator[dict]:
            for _, part in pieces(batch):
                hashes, counts = np.unique(np.concatenate([np.zeros(0, dtype=np.uint64), *(shingle_set(t, width) for t in part)]), return_counts=True)
                buckets = (hashes >> shift).astype(np.int64)
                edges = np.flatnonzero(np.diff(buckets, prepend=-1))
                offsets = pa.py_buffer((np.append(edges, len(hashes)) * 8).astype(np.int32))
                binary = lambda values: pa.Array.from_buffers(pa.binary(), len(edges), [None, offsets, pa.py_buffer(values)])  # noqa: B023, E731
                yield {"bucket": pa.array(buckets[edges]), "hashes": binary(hashes), "counts": binary(counts.astype(np.int64))}

        return each

    def levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = 1 << (SLOT_BITS - bits)
        bucket, hashes, counts = None, [], []

        def done() -> pa.RecordBatch:
            values, at = np.unique(np.concatenate(hashes), return_inverse=True)
            n = np.bincount(at, weights=np.concatenate(counts)).astype(np.int64)
            often = np.flatnonzero(n > RARE)
            table = np.zeros(size, dtype=np.uint8)
            np.maximum.at(table, ((values[often] >> low) & np.uint64(size - 1)).astype(np.int64), (2 * np.log2(n[often])).astype(np.uint8))
            return pa.RecordBatch.from_pydict({"bucket": [bucket], "levels": [zlib.compress(table.tobytes(), 1)]})

        for batch in batches:
            for b, h, c in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if bucket is not None and b != bucket:
                    yield done()
                    hashes, counts = [], []
                bucket = b
                hashes.append(np.frombuffer(h, dtype=np.uint64))
                counts.append(np.frombuffer(c, dtype=np.int64))
        if bucket is not None:
            yield done()

    counted = map_arrow(texts.select("id", "text"), start, "bucket bigint, hashes binary, counts binary")
    found = map_batches(counted.repartition("bucket").sortWithinPartitions("bucket"), levels, "bucket bigint, levels binary")
    table = np.zeros((1 << bits, 1 << (SLOT_BITS - bits)), dtype=np.uint8)
    for r in found.toLocalIterator():
        table[r.bucket] = np.frombuffer(zlib.decompress(r.levels), dtype=np.uint8)
    return table.ravel()


def shapes_of(texts: DataFrame, width: int, similarity: float, levels: np.ndarray) -> DataFrame:
    """(id, n, fingerprint, prefix, small) of texts (id, text): the number of a text's distinct shingles, their wide
    fingerprint, the first n - ceil(similarity * n) + 1 of them, rare ones first, and all of them if they are few.

    Two sets of the similarity have at least ceil(similarity * n) shingles in common, so the first of these in the order is
    in the prefixes of both.
    """
    shared = texts.sparkSession.sparkContext.broadcast(levels)
    longs = lambda found: pa.array([x.view(np.int64) for x in found], pa.list_(pa.int64()))

    def start() -> Callable[[pa.RecordBatch], Iterator[dict]]:
        def each(batch: pa.RecordBatch) -> Iterator[dict]:
            for part, texts_ in pieces(batch):
                sets = [shingle_set(t, width) for t in texts_]
                prefixes = []
                for found in sets:
                    rank = shared.value[found >> np.uint64(64 - SLOT_BITS)]
                    first = len(found) - math.ceil(similarity * len(found) - 1e-9) + 1
                    prefixes.append(found[np.lexsort((found, rank))[:first]])
                yield {
                    "id": part.column(0),
                    "n": pa.array(map(len, sets), pa.int32()),
                    "fingerprint": longs([fingerprint(x, WIDE_LANES) for x in sets]),
                    "prefix": longs(prefixes),
                    "small": longs([x if len(x) <= SMALL else x[:0] for x in sets]),
                }

        return each

    return map_arrow(texts.select("id", "text"), start, "id bigint, n int, fingerprint array<bigint>, prefix array<bigint>, small array<bigint>")


def rest_links(texts: DataFrame, shapes: DataFrame, names: DataFrame, width: int, similarity: float) -> tuple[DataFrame, str]:
    """(a, b) links of the similarity, written, that join the components (node, component) found so far: with them, any two
    texts (id, text) of the similarity are connected. Only pairs from different components are looked at, and of sets that
    are not small only those whose fingerprints are no further apart than FAR standard deviations allow for the similarity."""
    spark, far = texts.sparkSession, bits_apart(similarity, FAR)
    keyed = shapes.select(F.posexplode("prefix").alias("at", "key"), "id", F.col("n").alias("size"))
    few, many, shared_at = _by_key_size(keyed, WIDE_PAIRS_MOST)
    tidy(spark)
    left, right = few.select("key", F.col("id").alias("a"), F.col("size").alias("n"), F.col("at").alias("i")), few.select("key", F.col("id").alias("b"), F.col("size").alias("m"), F.col("at").alias("j"))
    met = left.join(right, "key").filter((F.col("a") < F.col("b")) & _fit(F.col("n"), F.col("i"), F.col("m"), F.col("j"), similarity)).select("a", "b").distinct()
    of = lambda side: names.select(F.col("node").alias(side), F.col("component").alias(f"of_{side}"))
    apart = F.coalesce("of_a", "a") != F.coalesce("of_b", "b")
    open_, open_at = written(met.join(of("a"), "a", "left").join(of("b"), "b", "left").filter(apart).select("a", "b"), "open")
    fitting, fitting_at = written(_fitting(many, similarity), "crowded")
    tidy(spark, shared_at)
    placed, placed_at = written(fitting.join(names.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("component", F.coalesce("component", "id")), "placed")
    tidy(spark, fitting_at)
    sizes = placed.groupBy("key", "span", "component").agg(F.count("*").alias("n")).groupBy("key", "span")
    mixed = sizes.agg(F.sum("n").alias("n"), F.max(F.struct("n", "component")).alias("main")).filter(F.col("n") > F.col("main.n"))
    mixed = mixed.select("key", "span", F.col("main.component").alias("main"), F.col("main.n").alias("n_main"), (F.col("n") - F.col("main.n")).alias("n_other"))
    crowded, crowded_at = written(placed.join(mixed, ["key", "span"]), "mixed")
    tidy(spark, placed_at)
    still = F.col("n_main") + F.col("n_other") > WIDE_PAIRS_MOST
    met = open_.union(_pairs_of_span(crowded.filter(~still), similarity)).distinct()
    looked, looked_at = written(_near_of_crowded(crowded.filter(still), shapes, similarity, far), "looked")
    sure = looked.filter(F.col("b").isNotNull()).select("a", "b")
    sure = sure.union(_links_of_crowded(looked.filter(F.col("b").isNull()), texts, shapes, width, similarity, far))
    near = _with_prints(met, shapes).filter((F.greatest("na", "nb") <= SMALL) | (_differ("fa", "fb") <= far)).select("a", "b")
    found = written(verified(near, texts, width, similarity).union(sure).distinct(), "rest")
    tidy(spark, open_at, crowded_at, looked_at)
    return found


def _fitting(many: DataFrame, similarity: float) -> DataFrame:
    """Rows (key, span, id, size, at, home) of those rows (key, id, size, at) that can have the similarity with another text of
    their key, by the sizes and the key's places in the orders.

    A span holds sizes that differ by 1 / similarity at most. Each row is at home in its own span and a guest in the one
    below, so each pair that can have the similarity meets in the shorter one's span, where that one is at home.
    """
    step = math.log(1 / similarity) * (1 + 1e-9)
    own = F.floor(F.log(F.col("size").cast("double")) / step).cast("int")
    spans = F.explode(F.array(F.struct(own.alias("span"), F.lit(True).alias("home")), F.struct((own - 1).alias("span"), F.lit(False).alias("home"))))
    rows = many.select("key", "id", "size", "at", spans.alias("s")).select("key", "s.span", "id", "size", "at", "s.home")
    largest = _largest_fit(F.col("size"), F.col("at"), similarity)
    shorter = F.col("home") & (largest >= F.col("size"))  # may be the shorter of two
    least = rows.filter(shorter).groupBy("key", "span").agg(F.min("size").alias("least"))
    return rows.join(least, ["key", "span"]).filter(shorter | (largest >= F.col("least"))).drop("least")


def _pairs_of_span(rows: DataFrame, similarity: float) -> DataFrame:
    """(a, b) that fit and are in components of their own, of keys and spans where few rows are left."""
    side = lambda k: rows.select("key", "span", *(F.col(c).alias(f"{c}_{k}") for c in ("id", "size", "at", "component", "home")))
    fit = _fit(F.col("size_a"), F.col("at_a"), F.col("size_b"), F.col("at_b"), similarity) & (F.col("home_a") | F.col("home_b"))
    pairs = side("a").join(side("b"), ["key", "span"]).filter((F.col("id_a") < F.col("id_b")) & (F.col("component_a") != F.col("component_b")) & fit)
    return pairs.select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))


def _in_pairs_of_parts(crowded: DataFrame) -> DataFrame:
    """The rows with parts i and j: of each key and span, the rows of the main component and the others are dealt to parts, and
    each pair of parts has the rows of both, but for two parts of the main component. Up to PART_ROWS rows are one part."""
    alone = F.col("n_main") + F.col("n_other") <= PART_ROWS
    others = F.when(alone, 1).otherwise(F.ceil(F.col("n_other") / PART_ROWS)).cast("int")
    mains = F.when(alone, 0).otherwise(F.ceil(F.col("n_main") / PART_ROWS)).cast("int")
    is_main, code = ~alone & (F.col("component") == F.col("main")), F.xxhash64("id")
    own = F.when(is_main, F.col("others") + F.pmod(code, F.greatest("mains", F.lit(1)))).otherwise(F.pmod(code, F.col("others"))).cast("int")
    rows = crowded.select("*", others.alias("others"), mains.alias("mains")).withColumn("own", own)
    with_ = F.sequence(F.lit(0), F.when(is_main, F.col("others") - 1).otherwise(F.col("others") + F.col("mains") - 1))
    with_ = F.when(alone, F.array(F.lit(0))).otherwise(F.filter(with_, lambda other: other != F.col("own")))
    pairs = F.explode(F.transform(with_, lambda other: F.struct(F.least("own", other).alias("i"), F.greatest("own", other).alias("j"))))
    return rows.select("key", "span", "id", "component", "at", "home", pairs.alias("pair")).select("key", "span", "id", "component", "at", "home", "pair.i", "pair.j")


def _fit_matrix(group: pd.DataFrame, similarity: float) -> np.ndarray:
    """Which rows' sets may have the similarity, by their sizes and the key's places, if they are in different components."""
    sizes, root = group["size"].to_numpy().astype(np.int64), group["component"].to_numpy()
    left = sizes - group["at"].to_numpy()
    return (np.minimum.outer(left, left) >= similarity / (1 + similarity) * np.add.outer(sizes, sizes) - 1e-6) & (root[:, None] != root)


def _near_matrix(group: pd.DataFrame, similarity: float, far: int) -> np.ndarray:
    """Of these, those whose fingerprints are near enough."""
    bits = _unpack(np.stack(group["fingerprint"].to_numpy())).astype(np.float32) * 2 - 1
    return (bits @ bits.T >= bits.shape[1] - 2 * far) & _fit_matrix(group, similarity)


def _met_before(key: int, keys: list[np.ndarray]) -> np.ndarray:
    """Which rows have an earlier key in common too, by each row's crowded keys in their order: the group of the first such key
    compares them. On a later one they may not fit, so it has to be the first."""
    earlier = [k[: np.flatnonzero(k == key)[0]] for k in keys]
    values, codes = np.unique(np.concatenate(earlier), return_inverse=True)
    has = np.zeros((len(keys), len(values)), dtype=np.float32)
    has[np.repeat(np.arange(len(keys)), [len(k) for k in earlier]), codes] = 1
    return has @ has.T > 0


def _near_of_crowded(crowded: DataFrame, shapes: DataFrame, similarity: float, far: int) -> DataFrame:
    """(key, span, i, j, a, b, component, at) of rows of crowded keys that fit and are in components of their own: either a link
    between two small sets, or, with b null, a row of the parts i and j whose fingerprint is near enough to another's there.
    There are fewer of both than rows."""
    mine = crowded.groupBy("id", "span").agg(F.array_sort(F.collect_list(F.struct("at", "key"))).alias("keys"))  # of one text: no more than its prefix
    mine = mine.withColumn("keys", F.transform("keys", lambda k: k["key"]))
    mine = mine.join(shapes.select("id", F.col("n").alias("size"), "fingerprint", "small"), "id")
    rows = _in_pairs_of_parts(crowded).join(mine, ["id", "span"])

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id")
        ids, root, is_small = group["id"].to_numpy(), group["component"].to_numpy().copy(), (group["size"] <= SMALL).to_numpy()
        out = {"a": [], "b": [], "component": [], "at": []}
        if (root != root[0]).any():
            home = group["home"].to_numpy().astype(bool)  # two guests meet in the span where the shorter is at home
            near = _near_matrix(group, similarity, far) & ~(is_small[:, None] & is_small) & (home[:, None] | home)
            if near.any():
                near &= ~_met_before(int(group["key"].iloc[0]), list(group["keys"]))
            at = np.flatnonzero(near.any(axis=1))
            small = np.flatnonzero(is_small)
            links = _small_links(small, list(group["small"]), root, similarity, _fit_matrix(group.iloc[small], similarity))
            out = {
                "a": [*(ids[i] for i, _ in links), *ids[at]],
                "b": [*(ids[j] for _, j in links), *[None] * len(at)],
                "component": [*[None] * len(links), *group["component"].to_numpy()[at]],
                "at": [*[None] * len(links), *group["at"].to_numpy()[at]],
            }
        made = pd.DataFrame({k: pd.array(v, dtype="Int64") for k, v in out.items()})
        return made.assign(**{k: group[k].iloc[0] for k in ("key", "span", "i", "j")})[["key", "span", "i", "j", "a", "b", "component", "at"]]

    return rows.groupBy("key", "span", "i", "j").applyInPandas(compare, "key bigint, span int, i int, j int, a bigint, b bigint, component bigint, at bigint")


def _links_of_crowded(rows: DataFrame, texts: DataFrame, shapes: DataFrame, width: int, similarity: float, far: int) -> DataFrame:
    """(a, b) of the similarity among rows (key, span, i, j, a, component, at), by their texts' sets. Rows that links already
    connect aren't compared, so there are fewer links than rows."""
    rows = rows.select("key", "span", "i", "j", F.col("a").alias("id"), "component", "at").join(shapes.select("id", F.col("n").alias("size"), "fingerprint"), "id").join(texts.select("id", "text"), "id")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id")
        sets = [shingle_set(t, width) for t in group["text"]]
        links = _small_links(np.arange(len(sets)), sets, group["component"].to_numpy().copy(), similarity, _near_matrix(group, similarity, far))
        ids = group["id"].to_numpy()
        return pd.DataFrame([(ids[i], ids[j]) for i, j in links], columns=["a", "b"], dtype="int64")

    return rows.groupBy("key", "span", "i", "j").applyInPandas(compare, "a bigint, b bigint")


def _small_links(at: np.ndarray, sets: list[np.ndarray], root: np.ndarray, similarity: float, near: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Pairs of the rows `at` whose sets have the similarity and whose roots differ, of those that are near if that is given;
    root is joined as they are found."""
    links: list[tuple[int, int]] = []
    if len(at) < 2:
        return links
    sizes = np.array([len(sets[i]) for i in at])
    starts = np.r_[0, np.cumsum(sizes)]
    values, codes = np.unique(np.concatenate([sets[i] for i in at]), return_inverse=True)
    mark = np.zeros(len(values), dtype=np.int64)
    for i in range(1, len(at)):
        open_ = root[at[:i]] != root[at[i]]
        if near is not None:
            open_ &= near[i, :i]
        others = np.flatnonzero(open_)
        if not len(others):
            continue
        own = codes[starts[i] : starts[i + 1]]
        mark[own] = 1
        if len(others) > i // 8:
            common = np.add.reduceat(mark[codes[: starts[i]]], starts[:i])[others]
        else:
            common = np.array([mark[codes[starts[j] : starts[j + 1]]].sum() for j in others])
        mark[own] = 0
        for j in others[_alike(common, sizes[others], sizes[i], similarity)]:
            if root[at[j]] != root[at[i]]:
                links.append((at[j], at[i]))
                root[root == root[at[j]]] = root[at[i]]
    return links


def keep_one(df: DataFrame, width: int = 5, similarity: float = 0.8, recall: float = 0.95, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df that are first (by id, null last, then text) among those linked to them as near-duplicates, with all
    their columns.

    Texts of fewer words than a shingle are compared by all their words; texts without words are all alike, as equal texts
    are. Texts are linked if their shingle sets have the Jaccard similarity, at any number of texts, and all such pairs are
    connected; `recall` is the share of them that the fingerprints' blocks bring together up to 65,536 texts, and the rest is
    found by shingles. Links are transitive.
    """
    # rows of equal text are one class from the start; h stands for the text, its 128 bits make chance matches no concern
    text = text_of(text_col)
    h = F.struct(F.xxhash64(text).alias("x"), F.substring(F.md5(text), 1, 16).alias("y"))
    order = lambda c: F.struct(c.isNull().alias("n"), c.alias("i"))
    first = df.select(h.alias("h"), order(F.col(id_col).cast("bigint")).alias("o"), text.alias("text")).groupBy("h").agg(F.min_by("text", "o").alias("text"), F.min("o").alias("o"))
    classes, classes_at = written(first.select(F.monotonically_increasing_id().alias("id"), "h", "o", "text"), "texts")
    count = classes.count()
    bits, blocks = wide_plan(count, similarity, recall)
    blocks = min(blocks, 64 * WIDE_LANES // bits)
    shapes, shapes_at = written(shapes_of(classes, width, similarity, shingle_levels(classes, count, width)), "shapes")
    near, near_at = wide_links(shapes, bits, blocks, bits_apart(similarity, 2))
    links, links_at = written(verified(near, classes, width, similarity), "links")
    known, known_at = written(components(links, "a", "b"), "known")
    tidy(df.sparkSession, near_at, links_at)
    rest, rest_at = rest_links(classes, shapes, known, width, similarity)
    names, names_at = written(components(known.select(F.col("node").alias("a"), F.col("component").alias("b")).union(rest), "a", "b").withColumnsRenamed({"node": "id"}), "names")
    tidy(df.sparkSession, known_at, rest_at, shapes_at)
    named = classes.select("id", "h", "o").join(names, "id", "left").withColumn("component", F.coalesce("component", "id"))
    best = named.groupBy("component").agg(F.min(F.struct("o", "h")).alias("best")).select("best.o", "best.h")
    kept, _ = written(best.select(F.col("h").alias("kept_h"), F.col("o").alias("kept_o")), "kept")
    tidy(df.sparkSession, classes_at, names_at)
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), h.alias("h"), order(F.col(id_col).cast("bigint")).alias("o"))
    chosen = rows.join(kept, (F.col("h") == F.col("kept_h")) & (F.col("o") == F.col("kept_o"))).select("row", "h", "o")
    # rows repeated whole, id and all: one of them stays
    single = chosen.dropDuplicates(["h", "o"])
    return single.select(*(F.col(f"row.`{c}`").alias(c) for c in df.columns))
