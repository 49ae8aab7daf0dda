"""Ordered scans over blocks, and the operators that run on them, against plain loops and plain windows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sonara.config import VadConfig
from sonara.operators import curves, regions, scan


def rows_of(df):
    return sorted(map(str, df.collect()))


@pytest.fixture(scope="module")
def walk(spark):
    rng = random.Random(3)
    data = [(k, i, rng.choice([None, rng.randrange(9)])) for k in (None, 1, 2) for i in rng.sample(range(100), 40)]
    return spark.createDataFrame(data, "k int, i int, v int").repartition(5)


@pytest.mark.parametrize("rows", [1, 3, 1000])
def test_scans_equal_windows(walk, rows):
    v = F.col("v")
    steps = {"s": scan.running_sum(v), "l": scan.last_value(v), "b": scan.last_value(v, before=True), "n": scan.next_value(v), "p": scan.previous(v), "f": scan.following(v)}
    w = Window.partitionBy("k").orderBy("i")
    up, down = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    want = walk.select("*", F.coalesce(F.sum("v").over(up), F.lit(0)).alias("s"), F.last("v", True).over(up).alias("l"), F.last("v", True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("b"), F.first("v", True).over(down).alias("n"), F.lag("v").over(w).alias("p"), F.lead("v").over(w).alias("f"))
    assert rows_of(scan.scanned(walk, "k", ["i"], scan.places(F.col("i"), rows), **steps)) == rows_of(want)
    assert rows_of(scan.scanned(walk, "k", ["i"], None, **steps)) == rows_of(want)


def test_even_blocks_keep_order_and_size(spark):
    rng = random.Random(4)
    data = [(1, rng.random() ** 6 * 1e6) for _ in range(4000)] + [(2, 5.0)] * 900 + [(3, float(i)) for i in range(50)] + [(None, 1.0), (1, None)]
    df = scan.even_blocks(spark.createDataFrame(data, "k int, at double").repartition(4), "k", "at", rows=300)
    found = df.collect()
    assert len(found) == len(data)
    hot = sorted((r.at, r.block) for r in found if r.k == 1 and r.at is not None)
    assert [b for _, b in hot] == sorted(b for _, b in hot) and hot[-1][1] > 10
    sizes = [sum(b == k for _, b in hot) for k in range(hot[-1][1] + 1)]
    assert max(sizes) <= 600
    assert len({r.block for r in found if r.k == 2}) == 1 and {r.block for r in found if r.k in (3, None)} == {0}


def longest_task(df):
    """Rows of the largest partition."""
    held = df.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.max(F.hash(*df.columns)).alias("read"))
    return max(r.n for r in held.collect())


def test_one_key_is_many_tasks(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = spark.range(20_000).select(F.lit(7).alias("k"), F.col("id").alias("at"))
        kept = scan.scanned(rows, "k", ["at"], scan.places(F.col("at"), 500), n=scan.running_sum(F.lit(1)))
        assert longest_task(kept) < 10_000 and kept.agg(F.max("n")).first()[0] == 20_000
        assert longest_task(scan.scanned(rows, "k", ["at"], None, n=scan.running_sum(F.lit(1)))) == 20_000
        scores = rows.select(F.col("k").alias("rec_id"), F.col("at").alias("idx"), F.when(F.col("at") % 100 < 60, 0.9).otherwise(0.1).cast("float").alias("score"))
        dealt = regions.quiet_segments(scores, 0.35, 9, 500).repartition("rec_id", "segment")
        assert longest_task(dealt) < 10_000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_operators_do_not_depend_on_blocks(spark):
    rng = random.Random(5)
    data = [(k, i, rng.random()) for k in (1, 2, None) for i in range(120)]
    df = spark.createDataFrame(data, "k int, i int, v double").repartition(3)
    for size in (1, 7, 500):
        block = scan.places(F.col("i"), size)
        assert rows_of(regions.hysteresis_regions(df, "k", ["i"], "v", 0.7, 0.3, block=block)) == rows_of(regions.hysteresis_regions(df, "k", ["i"], "v", 0.7, 0.3))
        assert rows_of(regions.gap_sessions(df.filter("v < 0.5"), "k", F.col("i"), 2, block)) == rows_of(regions.gap_sessions(df.filter("v < 0.5"), "k", F.col("i"), 2))
        means = [{r.k: r["mean"] for r in curves.running_means(df, "k", ["i"], "v", 0.35, b).collect()} for b in (None, block)]
        assert means[0].keys() == means[1].keys() and all(math.isclose(means[0][k], means[1][k]) for k in means[0])
        spans = regions.hysteresis_regions(df, "k", ["i"], "v", 0.7, 0.3).select("k", F.col("first").alias("a"), (F.col("last") + 1).alias("b"))
        by_start = scan.places(F.col("a"), size)
        for f in (lambda b: regions.silence_map(spans, "k", "a", "b", b), lambda b: regions.pad_regions(spans, "k", "a", "b", 2, F.lit(120), b), lambda b: regions.merge_short_gaps(spans, "k", "a", "b", 3, 1, b)):
            assert rows_of(f(by_start)) == rows_of(f(None))
        silence = regions.silence_map(spans, "k", "a", "b")
        assert rows_of(regions.restore_times(df, silence, "k", "i", size)) == rows_of(regions.restore_times(df, silence, "k", "i"))


def test_running_means_leave_nulls_out(spark):
    df = spark.createDataFrame([(1, 0, None), (1, 1, 4.0), (1, 2, None), (1, 3, 8.0), (2, 0, None)], "k int, i int, v double")
    assert {(r.k, r["mean"]) for r in curves.running_means(df, "k", ["i"], "v", 0.25).collect()} == {(1, 0.75 * 4 + 0.25 * 8)}


def curve(rng, n):
    """Speech, silence and what lies between, in stretches of very different lengths."""
    out = []
    while len(out) < n:
        level, spread = rng.choice([(0.9, 0.1), (0.1, 0.1), (0.5, 0.5), (0.42, 0.1), (0.2, 0.4)])
        out += [min(1.0, max(0.0, level + rng.uniform(-spread, spread))) for _ in range(rng.choice([1, 2, 5, 12, 40]))]
    return [float(np.float32(x)) for x in out[:n]]


CONFIGS = {
    "frames": [VadConfig(), VadConfig(max_speech_s=1.2, min_silence_ms=64, pad_ms=32), VadConfig(max_speech_s=1.2, min_silence_ms=160, min_speech_ms=100, split_at_longest_silence=True, pad_ms=10), VadConfig(max_speech_s=0.4, min_silence_ms=0, pad_ms=0, min_silence_at_max_ms=30), VadConfig(threshold=0.3, neg_threshold=0.6, min_silence_ms=90, max_speech_s=1.0), VadConfig(max_speech_s=0.8, min_silence_ms=300, min_silence_at_max_ms=0, split_at_longest_silence=True)],
    "overlap": [VadConfig(), VadConfig(max_speech_s=0.2, pad_ms=10), VadConfig(max_speech_s=0.14, pad_ms=0), VadConfig(max_speech_s=0.05, pad_ms=5), VadConfig(onset=0.3, offset=0.6, max_speech_s=0.5)],
}


@pytest.mark.parametrize("backend", CONFIGS)
def test_speech_regions_equal_one_run_over_the_recording(spark, backend):
    rng = random.Random(6)
    data = {k: curve(rng, rng.choice([1, 50, 400, 700])) for k in range(40)}
    step, fold = (512, regions.frame_regions) if backend == "frames" else (273, regions.overlap_regions)
    scores = spark.createDataFrame([(k, i, v) for k, vs in data.items() for i, v in enumerate(vs)], "rec_id bigint, idx bigint, score float").repartition(6).cache()
    lengths = spark.createDataFrame([(k, len(vs) * step) for k, vs in data.items()], "rec_id bigint, n_samples bigint")
    for config in CONFIGS[backend]:
        pad = int(config.pad_ms * 16)
        want = {(k, i, a, b) for k, vs in data.items() for i, (a, b) in enumerate(regions.pad_list(fold(vs, len(vs) * step, config), pad, len(vs) * step))}
        assert {tuple(r) for r in regions.speech_regions(scores, lengths, config, backend, block=rng.choice([16, 100, 5000])).collect()} == want
    scores.unpersist()


def test_segments_are_cut_in_long_silences_only(spark):
    values = [0.9, 0.1, 0.1, 0.9] + [0.1] * 12 + [0.9, None, 0.1] + [0.1] * 20
    scores = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "rec_id bigint, idx bigint, score float")
    found = sorted((r.idx, r.segment) for r in regions.quiet_segments(scores, 0.35, 5, 4).collect())
    assert [i for i, _ in found] == [*range(9), 16, 17, 18, 19, 20, 21, 22]
    assert {s for i, s in found if i < 9} == {0} and {s for i, s in found if i >= 16} == {16}


@pytest.mark.parametrize("size", [None, 1, 5, 400])
def test_runs_equal_a_loop(spark, size):
    rng = random.Random(8)
    data = [(k, i, rng.random() < 0.4) for k in (None, 1, 2) for i in sorted(rng.sample(range(300), 90))]
    want = []
    for key in (None, 1, 2):
        heard = run = None
        for k, i, loud in data:
            if k == key:
                silent = None if heard is None else i - heard
                run = i if loud and (heard is None or i - heard >= 9) else run
                heard = i if loud else heard
                want.append((k, i, loud, run, silent))
    df = spark.createDataFrame(data, "k int, i int, loud boolean").repartition(3)
    block = None if size is None else scan.places(F.col("i"), size)
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in scan.runs(df, "k", "i", F.lit(9), block, F.col("loud")).collect())


def test_restored_segments_equal_those_of_the_plan(spark):
    from sonara.plans import transcribe

    rng = random.Random(12)
    spans = {k: sorted({(a * 4000, a * 4000 + rng.randrange(500, 4000)) for a in rng.sample(range(60), n)}) for k, n in ((1, 12), (2, 1), (3, 0))}
    rows = []
    for rec in spans:
        for seg in range(8):
            cuts = sorted(rng.randrange(0, 4 * 10**9) for _ in range(2 + 2 * rng.randrange(4)))
            words = [{"start_ns": a, "end_ns": b, "word": "w", "probability": 0.5} for a, b in zip(cuts[2::2], cuts[3::2], strict=False)]
            rows.append((rec, seg, cuts[0], cuts[-1], words if seg else None, "x"))
    word = "struct<start_ns: bigint, end_ns: bigint, word: string, probability: double>"
    df = spark.createDataFrame(rows, f"rec_id bigint, id int, start_ns bigint, end_ns bigint, words array<{word}>, place string")
    silence = regions.silence_map(spark.createDataFrame([(k, a, b) for k, s in spans.items() for a, b in s], "rec_id bigint, a bigint, b bigint"), "rec_id", "a", "b")
    move = lambda t, rec: transcribe.ns(transcribe.original_time(t / 1e9, spans[rec]))
    want = {}
    for rec, seg, start, end, words, _ in rows:
        moved = []
        for w in words or []:
            middle = (w["start_ns"] + w["end_ns"]) / 2e9
            shift = transcribe.original_time(middle, spans[rec]) - middle
            moved.append((transcribe.ns(w["start_ns"] / 1e9 + shift), transcribe.ns(w["end_ns"] / 1e9 + shift)))
        want[rec, seg] = (move(start, rec), move(end, rec), None if words is None else moved)
    for size in (None, 700):
        found = regions.restore_segments(df, silence, "rec_id", size)
        assert found.columns == df.columns
        assert {(r.rec_id, r.id): (r.start_ns, r.end_ns, None if r.words is None else [(w.start_ns, w.end_ns) for w in r.words]) for r in found.collect()} == want


@pytest.mark.parametrize("backend", ["frames", "overlap"])
def test_regions_and_windows_of_recordings(spark, backend):
    from sonara.plans import scoring, transcribe

    rng = np.random.default_rng(13)
    recordings = {k: np.concatenate([np.concatenate([np.zeros(rng.integers(3000, 30000)), rng.standard_normal(rng.integers(8000, 40000))]) for _ in range(n)] or [np.zeros(0)]).astype(np.float32) for k, n in ((1, 4), (2, 2), (3, 1))}
    df = spark.createDataFrame([(k, x.tolist()) for k, x in recordings.items()], "rec_id bigint, pcm array<float>")
    config = VadConfig(min_silence_ms=300, pad_ms=100, max_speech_s=5.0)
    want = {}
    for k, x in recordings.items():
        scorer = scoring.EnergyScorer()
        found = regions.frame_regions(transcribe.voice_scores(x, scorer), len(x), config) if backend == "frames" else regions.overlap_regions(scoring.slide_scores(x, scorer), len(x), config)
        want[k] = regions.pad_list(found, 1600, len(x))
    got = scoring.recording_regions(df, scoring.EnergyScorer, config, backend).collect()
    assert sorted((r.rec_id, r.start, r.end) for r in got) == sorted((k, a, b) for k, s in want.items() for a, b in s) and got
    windows = scoring.recording_windows(df, scoring.EnergyScorer, config, backend, chunk_s=4.0).collect()
    assert sorted((r.rec_id, r.start, r.end) for r in windows) == sorted((k, a, b) for k, s in want.items() for a, b in regions.merge_spans(s, 64_000))


def test_phrases_come_from_a_file(spark, tmp_path):
    from sonara.operators import phrases
    from sonara.sources import documents

    (tmp_path / "p.json").write_text('{"en": ["please do subscribe", "thank you"], "de": ["vielen dank"]}')
    listed = documents.read_phrases(spark, f"file://{tmp_path}/p.json")
    assert phrases.phrase_lists(listed) == {"en": ["please do subscribe", "thank you"], "de": ["vielen dank"]}
    rows = spark.createDataFrame([(1, 1, 0, 9, "Now, please do subscribe soon.", None, "en"), (1, 2, 0, 9, "Vielen Dank", None, "de"), (1, 3, 0, 9, "Vielen Dank", None, "en")], f"rec_id bigint, id int, start_ns bigint, end_ns bigint, text string, words array<{phrases.WORD}>, language string")
    assert [(r.id, r.text) for r in phrases.filter_phrases(rows, listed).orderBy("id").collect()] == [(1, "Now, soon."), (2, "Vielen Dank")]
