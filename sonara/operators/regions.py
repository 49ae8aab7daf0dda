"""Regions of activity: hysteresis, gaps, padding, merging, and times restored from cut recordings.

Wherever a rule only looks at neighbours it is a window expression. Rules whose state can't be written so (a limit on
length, greedy merging) are step functions over one key's rows in order; batch and streaming plans call the same ones.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonara.config import VadConfig
from sonara.operators.scan import following, last_value, next_value, places, previous, running_sum, runs, scanned
from sonara.schema import SAMPLE_RATE

#: Samples for each score of the frame-wise backend, and seconds for each score of the overlapping one.
WINDOW = 512
FRAME_STEP = 0.017064846


def hysteresis_regions(df: DataFrame, key: str, order: list[str], score: str, on: float, off: float, strict_on: bool = False, off_includes: bool = False, block: Column | None = None) -> DataFrame:
    """(key, region, first, last, n, peak) of runs of rows in an active state.

    A row at `on` (above it if strict_on) turns the state on, one below `off` (at it too if off_includes) off; others keep
    it. first and last are the rows' positions from 0. Null scores keep the state; ties in the order have to be broken by
    the caller's columns. The rows move once, by key, or by key and block where a block is given.
    """
    x = F.col(score)
    turn = F.when((x > on) if strict_on else (x >= on), 1).when((x <= off) if off_includes else (x < off), 0)
    one = F.lit(1).cast("bigint")
    rows = df.select(key, *order, score, turn.alias("turn"), (F.lit(0) if block is None else block).alias("part"))
    part = None if block is None else F.col("part")
    rows = scanned(rows, key, order, part, place=running_sum(one), active=last_value(F.col("turn")), before=last_value(F.col("turn"), before=True))
    rise = F.when((F.col("active") == 1) & (F.coalesce("before", F.lit(0)) == 0), one).otherwise(F.lit(0).cast("bigint"))
    rows = scanned(rows.withColumn("rise", rise), key, order, part, region=running_sum(F.col("rise"))).withColumn("pos", F.col("place") - 1)
    return rows.filter(F.col("active") == 1).groupBy(key, "region").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.count("*").alias("n"), F.max(score).alias("peak"))


def merge_short_gaps(regions: DataFrame, key: str, start: str, end: str, least_gap: int, least_length: int = 0, block: Column | None = None) -> DataFrame:
    """(key, start, end, parts): regions joined over gaps shorter than least_gap, then those longer than least_length."""
    rows = regions.select(key, start, end)
    rows = scanned(rows, key, [start], block, before=previous(F.col(end)))
    fresh = F.when(F.coalesce(F.col(start) - F.col("before") < least_gap, F.lit(False)), 0).otherwise(1)
    rows = scanned(rows.withColumn("fresh", fresh), key, [start], block, group=running_sum(F.col("fresh")))
    merged = rows.groupBy(key, "group").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("parts"))
    return merged.filter(F.col(end) - F.col(start) > least_length).drop("group")


def gap_sessions(df: DataFrame, key: str, at: Column, gap: float | int, block: Column | None = None) -> DataFrame:
    """(key, session, n, start, end): runs of rows no more than gap apart. block is by a column of df, or by `at`. Rows whose
    `at` is null belong to a key's session 0, without start and end."""
    rows = df.withColumn("at", at).select(key, "at", (F.lit(0) if block is None else block).alias("part"))
    part = None if block is None else F.col("part")
    found = runs(rows, key, "at", F.lit(gap) + F.lit(1) if isinstance(gap, int) else F.lit(math.nextafter(gap, math.inf)), part)
    first = F.min("part").alias("part")
    sessions = found.groupBy(key, "run").agg(F.count("*").alias("n"), F.min("at").alias("start"), F.max("at").alias("end"), first)
    numbered = scanned(sessions, key, ["run"], part, session=running_sum(F.when(F.col("run").isNotNull(), 1).otherwise(0)))
    return numbered.select(key, F.col("session").cast("bigint").alias("session"), "n", "start", "end")


def padded_bounds(start: Column, end: Column, last_end: Column, next_start: Column, pad: int, n: Column) -> tuple[Column, Column]:
    before, after = start - last_end, next_start - end
    half = lambda gap: F.when(gap < 0, -F.floor(-gap / 2)).otherwise(F.floor(gap / 2))  # noqa: E731  towards zero
    share = lambda gap: F.when(gap < 2 * pad, half(gap)).otherwise(pad)
    new_start = F.greatest(F.lit(0), start - F.coalesce(share(before), F.lit(pad)))
    new_end = F.when(after < 2 * pad, end + half(after)).otherwise(F.least(n, end + pad))
    return new_start.cast("bigint"), new_end.cast("bigint")


def pad_regions(regions: DataFrame, key: str, start: str, end: str, pad: int, n: Column, block: Column | None = None) -> DataFrame:
    """Each region widened by pad on both sides inside [0, n]; a gap under 2 * pad is shared out in halves, rounded down.

    Every gap is measured between the bounds as given, so this is a lag and a lead.
    """
    rows = scanned(regions, key, [start], block, _before=previous(F.col(end)), _after=following(F.col(start)))
    new_start, new_end = padded_bounds(F.col(start), F.col(end), F.col("_before"), F.col("_after"), pad, n)
    return rows.withColumns({start: new_start, end: new_end}).drop("_before", "_after")


def merge_greedily(regions: Column, most: Column) -> Column:
    """array<struct<start, end>> joined, in order, into spans of up to `most`; a region is never cut."""

    def step(state: Column, r: Column) -> Column:
        full = (r["end"] - state["start"] > most) & (state["end"] - state["start"] > 0)
        done = F.when(full, F.concat(state["done"], F.array(F.struct(state["start"].alias("start"), state["end"].alias("end"))))).otherwise(state["done"])
        return F.struct(done.alias("done"), F.when(full, r["start"]).otherwise(state["start"]).alias("start"), r["end"].alias("end"))

    first = F.element_at(regions, 1)["start"]
    begin = F.struct(F.slice(F.transform(regions, lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"))), 1, 0).alias("done"), first.alias("start"), F.lit(0).cast("bigint").alias("end"))
    finish = lambda s: F.concat(s["done"], F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    return F.when(F.size(regions) > 0, F.aggregate(regions, begin, step, finish)).otherwise(F.slice(regions, 1, 0))


def merge_spans(regions: Iterable[tuple[int, int]], most: int) -> Iterator[tuple[int, int]]:
    """The same over an iterator, for keys with too many regions for one array."""
    held: tuple[int, int] | None = None
    for start, end in regions:
        if held is None:
            held = (start, end)
        elif end - held[0] > most and held[1] > held[0]:
            yield held
            held = (start, end)
        else:
            held = (held[0], end)
    if held is not None:
        yield held


def greedy_windows(regions: DataFrame, key: str, start: str, end: str, most: int) -> DataFrame:
    """(key, window, start, end) of every key's regions merged in order of their start.

    Each task streams through its keys in order with one span in hand, so neither many small keys nor a large one cost memory.
    """
    rows = regions.select(F.col(key).alias("key"), F.col(start).cast("bigint").alias("start"), F.col(end).cast("bigint").alias("end"))
    kind = dict(rows.dtypes)["key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, window, held = None, 0, None
        done: list[tuple] = []
        schema = None

        def out() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True)) or [[], [], [], []]
            made = pa.RecordBatch.from_arrays([pa.array(columns[0], schema), *(pa.array(c, pa.int64()) for c in columns[1:])], names=["key", "window", "start", "end"])
            done.clear()
            return made

        for batch in batches:
            schema = batch.schema.field(0).type
            for k, a, b in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if held is None or k != of:
                    if held is not None:
                        done.append((of, window, *held))
                    of, window, held = k, 1, (a, b)
                elif b - held[0] > most and held[1] > held[0]:
                    done.append((of, window, *held))
                    window, held = window + 1, (a, b)
                else:
                    held = (held[0], b)
            if done:
                yield out()
        if held is not None:
            done.append((of, window, *held))
            yield out()

    ordered = rows.repartition("key").sortWithinPartitions("key", "start", "end")
    return ordered.mapInArrow(run, f"key {kind}, window bigint, start bigint, `end` bigint").withColumnRenamed("key", key)


@dataclass
class Silence:
    at: int
    length: int


class FrameMachine:
    """Speech regions of scores that come one for each WINDOW samples, by hysteresis with limits on lengths.

    A region begins at a score of at least `threshold`. It ends where scores stay under `off` for min_silence samples; the
    end is the first of them. When it grows over max_speech it is cut: at the longest silence inside it (if the settings
    say so), else at the last silence long enough for a cut, else right there. An infinite limit means none.
    """

    def __init__(self, config: VadConfig):
        per_ms = SAMPLE_RATE / 1000
        self.on, self.off = np.float32(config.threshold), np.float32(config.off)
        self.longest = config.split_at_longest_silence
        self.least_speech = config.min_speech_ms * per_ms
        self.least_silence = config.min_silence_ms * per_ms
        self.cut_silence = int(config.min_silence_at_max_ms * per_ms)
        self.pad = int(config.pad_ms * per_ms)
        room = config.max_speech_s * SAMPLE_RATE - WINDOW - 2 * self.pad
        self.most = room if math.isinf(room) else int(room)
        self.start: int | None = None
        self.quiet = 0  # where the silence that is going on began; 0: none
        self.cut_at = self.resume_at = 0  # the last silence long enough for a cut, and where speech came back after it
        self.silences: list[Silence] = []

    def _clear(self, start: int | None) -> None:
        self.start, self.quiet, self.cut_at, self.resume_at, self.silences = start, 0, 0, 0, []

    def _cut(self, now: int) -> tuple[tuple[int, int], bool]:
        """The part of an over-long region that is done, and whether the machine is through with this score."""
        if self.longest and self.silences:
            best = max(self.silences, key=lambda s: s.length)  # the first of equally long ones
            done = (self.start, best.at)
            self._clear(best.at + best.length)
            return done, False
        if self.cut_at:
            done = (self.start, self.cut_at)
            self._clear(None if self.resume_at < self.cut_at else self.resume_at)
            return done, False
        done = (self.start, now)
        self._clear(None)
        return done, True

    def step(self, index: int, score: float) -> Iterator[tuple[int, int]]:
        now, score = WINDOW * index, np.float32(score)
        if score >= self.on and self.quiet:
            length = now - self.quiet
            if length > self.cut_silence:
                self.silences.append(Silence(self.quiet, length))
            self.quiet = 0
            if self.resume_at < self.cut_at:
                self.resume_at = now
        if score >= self.on and self.start is None:
            self.start = now
            return
        if self.start is not None and now - self.start > self.most:
            done, through = self._cut(now)
            yield done
            if through:
                return
        if score < self.off and self.start is not None:
            self.quiet = self.quiet or now
            length = now - self.quiet
            if not self.longest and length > self.cut_silence:
                self.cut_at = self.quiet
            if length >= self.least_silence:
                done = (self.start, self.quiet)
                self._clear(None)
                if done[1] - done[0] > self.least_speech:
                    yield done

    def finish(self, samples: int) -> Iterator[tuple[int, int]]:
        if self.start is not None and samples - self.start > self.least_speech:
            yield self.start, samples
        self._clear(None)

    def open(self) -> tuple[int, None] | None:
        """The region that goes on when scores end: its end is the recording's, which the caller knows."""
        return None if self.start is None else (self.start, None)

    @staticmethod
    def quiet_rows(config: VadConfig) -> int | None:
        """After so many scores in a row under `off` no region goes on, whatever went before. The silence that ends a region is
        counted anew when a cut falls into it, and a second cut there ends it: hence twice min_silence."""
        return 2 * math.ceil(config.min_silence_ms * SAMPLE_RATE / 1000 / WINDOW) + 1


def frame_regions(scores: Iterable[float], samples: int, config: VadConfig) -> list[tuple[int, int]]:
    """Regions in samples, before padding."""
    machine, found = FrameMachine(config), []
    for i, s in enumerate(scores):
        found.extend(machine.step(i, s))
    return [*found, *machine.finish(samples)]


class OverlapMachine:
    """Speech regions in seconds of scores whose middles lie `step` apart: on above `onset`, off below `offset`. One longer than
    max_speech_s is cut where its second half's score is lowest, and a frame that cuts doesn't end the region.

    The frames in memory at a cut are those since the last one; a stale frame from before the region stays among them, and
    the frame that begins a region does not join, as in the published curves.
    """

    def __init__(self, config: VadConfig, width: float = FRAME_STEP):
        self.on, self.off, self.most, self.width = np.float32(config.onset), np.float32(config.offset), config.max_speech_s, width
        self.active, self.start, self.last = False, 0.0, 0
        self.frames: list[tuple[int, np.float32]] = [(-1, np.float32(0))]

    def middle(self, i: int) -> float:
        return (i + 0.5) * self.width

    def step(self, i: int, score: float) -> Iterator[tuple[float, float]]:
        value, now, self.last = np.float32(score), self.middle(i), i
        if i == 0:
            self.active, self.start, self.frames = bool(value > self.on), now, [(0, value)]
            return
        if not self.active:
            if value > self.on:
                self.active, self.start = True, now
            return
        if now - self.start > self.most:
            half = len(self.frames) // 2
            lowest = half + int(np.argmin([v for _, v in self.frames[half:]]))
            at = self.middle(self.frames[lowest][0])
            yield self.start, at
            self.start, self.frames = at, self.frames[lowest + 1 :]
        elif value < self.off:
            yield self.start, now
            self.active, self.start, self.frames = False, now, []
        self.frames.append((i, value))

    def open(self) -> tuple[float, float] | None:
        return (self.start, self.middle(self.last)) if self.active else None

    @staticmethod
    def quiet_rows(config: VadConfig) -> int | None:
        """As for FrameMachine: the first score under `offset` ends a region unless it cuts it, and the second one does then, as
        the part that is left is shorter than a limit of some frames. A shorter limit cuts at every frame: no rows will do."""
        return 2 if config.max_speech_s >= 8 * FRAME_STEP else None


def overlap_regions(scores: Iterable[float], samples: int, config: VadConfig, step: float = FRAME_STEP) -> list[tuple[int, int]]:
    """Regions in samples, before padding."""
    machine, found = OverlapMachine(config, step), []
    for i, s in enumerate(scores):
        found.extend(machine.step(i, s))
    if (last := machine.open()) is not None:
        found.append(last)
    bounds = ((min(max(math.floor(t * SAMPLE_RATE + 0.5), 0), samples) for t in span) for span in found)
    return [(a, b) for a, b in bounds if b > a]


def pad_list(regions: list[tuple[int, int]], pad: int, samples: int) -> list[tuple[int, int]]:
    """pad_regions for a list."""
    out = []
    for i, (start, end) in enumerate(regions):
        before = start - regions[i - 1][1] if i else None
        after = regions[i + 1][0] - end if i + 1 < len(regions) else None
        share = lambda gap: pad if gap is None or gap >= 2 * pad else int(gap / 2)
        new_end = end + share(after)
        out.append((max(0, start - share(before)), new_end if after is not None and after < 2 * pad else min(samples, new_end)))
    return out


def quiet_segments(scores: DataFrame, low: float, quiet: int | None, block: int) -> DataFrame:
    """scores (rec_id, idx, score) with `segment`, less the rows that no machine heeds.

    A segment, named by its first place, begins where a score of `low` or more follows at least `quiet` scores under it:
    there every machine is at rest, so segments can be gone through apart. Scores from the quiet-th on in such a silence change nothing and are left
    out. Null scores and those that are no numbers are not under `low`. quiet None: a recording is one segment.
    """
    rows = scores.select("rec_id", F.col("idx").cast("bigint").alias("idx"), "score")
    if quiet is None:
        return rows.withColumn("segment", F.lit(0).cast("bigint"))
    loud = F.coalesce(~(F.col("score") < F.lit(low).cast("float")), F.lit(True))
    rows = runs(rows.withColumn("loud", loud), "rec_id", "idx", F.lit(quiet + 1), places(F.col("idx"), block), F.col("loud"), "segment")
    silent = F.coalesce("silent", F.col("idx") + 1) - 1  # scores under low right before this one
    return rows.filter(F.col("loud") | (silent < quiet)).select("rec_id", "idx", "score", F.coalesce("segment", F.lit(-1)).alias("segment"))


def speech_regions(scores: DataFrame, lengths: DataFrame, config: VadConfig, backend: str = "frames", padded: bool = True, block: int = 1 << 20) -> DataFrame:
    """REGIONS of SCORES (rec_id, idx, score; idx counts from 0) and lengths (rec_id, n_samples).

    What a machine does depends on all that went before, but a silence long enough puts it to rest whatever went before. So
    a recording falls apart at such silences, found by an ordered scan over blocks of its scores, and each segment is one
    machine's run: a long recording is many tasks, each of which streams through its segments with one machine in hand.
    Only speech without such a silence is a single run, however long. The result depends neither on blocks nor on tasks.
    Null scores keep the state; a recording without scores or without a length has no rows.
    """
    kind = {"frames": FrameMachine, "overlap": OverlapMachine}[backend]
    low = min(config.threshold, config.off) if backend == "frames" else min(config.onset, config.offset)
    seconds = backend == "overlap"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, machine, out = None, None, []
        for batch in batches:
            for rec, segment, idx, score in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if machine is None or of != (rec, segment):
                    if machine is not None and (last := machine.open()) is not None:
                        out.append((of[0], *last))
                    of, machine = (rec, segment), kind(config)
                out.extend((rec, *span) for span in machine.step(idx, math.nan if score is None else score))
            if out:
                yield spans(out)
                out = []
        if machine is not None and (last := machine.open()) is not None:
            yield spans([(of[0], *last)])

    def spans(rows: list[tuple]) -> pa.RecordBatch:
        recs, starts, ends = zip(*rows, strict=True)
        return pa.RecordBatch.from_pydict({"rec_id": pa.array(recs, pa.int64()), "a": pa.array(starts, pa.float64()), "b": pa.array(ends, pa.float64())})

    rows = quiet_segments(scores, low, kind.quiet_rows(config), block)
    dealt = rows.select(F.col("rec_id").cast("bigint").alias("rec_id"), "segment", "idx", F.col("score").cast("float").alias("score")).repartition("rec_id", "segment").sortWithinPartitions("rec_id", "segment", "idx")
    found = dealt.mapInArrow(run, "rec_id bigint, a double, b double").join(lengths.select(F.col("rec_id").cast("bigint").alias("rec_id"), F.col("n_samples").cast("bigint").alias("n")), "rec_id")
    if seconds:
        samples = lambda t: F.least(F.greatest(F.floor(t * SAMPLE_RATE + 0.5), F.lit(0)), F.col("n"))
        found = found.select("rec_id", samples(F.col("a")).alias("start"), samples(F.col("b")).alias("end"), "n").filter(F.col("end") > F.col("start"))
    else:
        least = config.min_speech_ms * SAMPLE_RATE / 1000
        found = found.filter(F.col("b").isNotNull() | (F.col("n") - F.col("a") > least)).select("rec_id", F.col("a").cast("bigint").alias("start"), F.coalesce(F.col("b").cast("bigint"), "n").alias("end"), "n")
    at = places(F.col("start"), block * WINDOW)
    rows = scanned(found, "rec_id", ["start"], at, idx=running_sum(F.lit(1).cast("bigint")), before=previous(F.col("end")), after=following(F.col("start")))
    start, end = F.col("start"), F.col("end")
    if padded:
        start, end = padded_bounds(start, end, F.col("before"), F.col("after"), int(config.pad_ms * SAMPLE_RATE / 1000), F.col("n"))
    return rows.select("rec_id", (F.col("idx") - 1).alias("idx"), start.alias("start"), end.alias("end"))


def batch_windows(regions: list[tuple[int, int]], samples: int, chunk_s: float = 30.0) -> list[tuple[int, int]]:
    """Windows to decode together: regions merged up to the chunk length; a short recording without any is one window."""
    chunk = int(chunk_s * SAMPLE_RATE)
    if not regions:
        return [(0, samples)] if 0 < samples <= chunk else []
    return list(merge_spans(regions, chunk))


def silence_map(regions: DataFrame, key: str, start: str, end: str, block: Column | None = None) -> DataFrame:
    """(key, idx, start, end, cum_start, cum_end, silence): each region's place in the recording cut to its regions, and the
    silence cut away before it: what lies before its start, less what was kept of it. Null bounds add nothing."""
    rows = regions.select(key, start, end, (F.col(end) - F.col(start)).alias("length"))
    rows = scanned(rows, key, [start, end], block, idx=running_sum(F.lit(1)), cum_end=running_sum(F.col("length")))
    rows = rows.withColumn("cum_start", F.col("cum_end") - F.col("length"))
    return rows.select(key, (F.col("idx") - 1).cast("int").alias("idx"), start, end, "cum_start", "cum_end", (F.col(start) - F.col("cum_start")).alias("silence"))


def restore_times(times: DataFrame, silence: DataFrame, key: str, at: str, block_places: int | None = None) -> DataFrame:
    """times with `original`: a position in the cut recording plus the silence before the region it falls into (the last
    one for positions behind all). Without regions the position stays. With block_places a key is dealt out in blocks of so
    many places."""
    rows = times.select(key, F.struct(*(F.col(f"`{c}`") for c in times.columns)).alias("row"), F.floor(at).alias("place"), F.lit(None).cast("bigint").alias("step"))
    steps = silence.select(key, F.lit(None).cast(rows.schema["row"].dataType).alias("row"), F.col("cum_end").cast("bigint").alias("place"), F.col("silence").cast("bigint").alias("step"))
    # what follows a position first is the region that ends behind it; at a region's end the position comes after
    both = rows.unionByName(steps).withColumn("late", F.col("step").isNull())
    block = None if block_places is None else places(F.col("place"), block_places)
    found = scanned(both, key, ["place", "late"], block, ahead=next_value(F.col("step")), behind=last_value(F.col("step")))
    found = found.filter(F.col("row").isNotNull()).withColumn("silence", F.coalesce("ahead", "behind", F.lit(0)))
    return found.select(*(F.col(f"row.`{c}`").alias(c) for c in times.columns), (F.col(f"row.`{at}`") + F.col("silence")).alias("original"))


def restore_segments(segments: DataFrame, silence: DataFrame, key: str = "rec_id", block_places: int | None = None) -> DataFrame:
    """segments (key, id, start_ns, end_ns, words, ...) of cut recordings, with their times on the recordings' own lines.

    silence is silence_map's, in samples. A segment's start and end are moved by the silence before the region they fall
    into, each by itself; a word's both ends by that of its middle, so words stay whole. Null words stay null, null times
    null; a recording without regions keeps its times. id names a segment within its recording.

    Starts, ends and middles become one table of places, restored in one pass over it, and are put together again by their
    number in the segment. A segment travels with its start only.
    """
    names = segments.columns
    sample = lambda ns: (ns / 1e9 * SAMPLE_RATE).cast("bigint")  # noqa: E731  cut, not rounded
    middles = F.coalesce(F.transform("words", lambda w: ((w["start_ns"] + w["end_ns"]) / 2e9 * SAMPLE_RATE).cast("bigint")), F.array().cast("array<bigint>"))
    probes = F.concat(F.array(sample(F.col("start_ns")), sample(F.col("end_ns"))), middles)
    whole = F.struct(*(F.col(f"`{c}`") for c in names))
    rows = segments.select(key, F.col("id").alias("_id"), whole.alias("_segment"), F.posexplode(probes).alias("_n", "place"))
    rows = rows.withColumn("_segment", F.when(F.col("_n") == 0, F.col("_segment")))
    moved = restore_times(rows, silence.select(F.col(silence.columns[0]).alias(key), "cum_end", "silence"), key, "place", block_places)
    shift = F.struct("_n", ((F.col("original") - F.col("place")) / SAMPLE_RATE).alias("s"))
    grouped = moved.groupBy(key, "_id").agg(F.first("_segment", ignorenulls=True).alias("_segment"), F.array_sort(F.collect_list(shift)).alias("_shifts"))
    by = lambda n: F.get("_shifts", n)["s"]
    nanos = lambda s: (s * 1e9).cast("bigint")
    field = lambda c: F.col(f"_segment.`{c}`")

    def word(w: Column, i: Column) -> Column:
        middle = (w["start_ns"] + w["end_ns"]) / 2e9
        more = (middle + by(i + 2)) - middle  # what is left of the shift where it is added to a time
        return w.withField("start_ns", nanos(w["start_ns"] / 1e9 + more)).withField("end_ns", nanos(w["end_ns"] / 1e9 + more))

    new = {"start_ns": nanos(field("start_ns") / 1e9 + by(F.lit(0))), "end_ns": nanos(field("end_ns") / 1e9 + by(F.lit(1))), "words": F.transform(field("words"), word)}
    return grouped.select(*(new.get(c, field(c)).alias(c) for c in names))
