"""Audio by byte ranges, written and read back, and frames over blocks, against whole signals."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonara.operators import spectral
from sonara.sources import audio

RNG = np.random.default_rng(5)


def pieces(x, sizes):
    """(start, samples) of x cut at random."""
    out, at, rng = [], 0, random.Random(len(x))
    while at < len(x):
        n = rng.choice(sizes)
        out.append((at, x[at : at + n].tolist()))
        at += n
    return out


@pytest.fixture(scope="module")
def signals():
    return {k: RNG.normal(0, 0.2, n).astype(np.float32) for k, n in enumerate([1, 2, 100, 159, 160, 201, 399, 640, 1599, 1600, 1601, 5000])}


def recordings(spark, signals, sizes):
    rows = [(k, s, p) for k, x in signals.items() for s, p in pieces(x, sizes)]
    return spark.createDataFrame([*rows, *rows[:3], (None, 0, [0.25] * 700), (77, 0, None), (78, 5, [])], "rec_id bigint, start_sample bigint, pcm array<float>").withColumn("key", F.lit("x")).repartition(5)


@pytest.mark.parametrize("group,sizes,extra", [(4, [1, 50, 333], 0), (5, [999], 160), (6000, [700], 160), (7, [10_000], 0)])
def test_frames_over_blocks_equal_those_of_the_whole(spark, signals, group, sizes, extra):
    df = recordings(spark, signals, sizes)
    power = {(r.rec_id, r.frame): r.power for r in spectral.power_frames(df, group, extra).collect()}
    mel = {(r.rec_id, r.frame): r.mel for r in spectral.mel_frames(df, group=group, extra=extra, values="double").collect()}
    known = signals | {None: np.full(700, 0.25, dtype=np.float32)}
    want_power = {(k, f): row for k, x in known.items() for f, row in enumerate(spectral.power_spectrum(x, extra))}
    want_mel = {(k, f): row for k, x in known.items() for f, row in enumerate(spectral.log_mel(x, extra=extra))}
    assert power.keys() == want_power.keys() and mel.keys() == want_mel.keys()
    assert all(np.allclose(power[k], want_power[k], atol=1e-9) for k in power)
    assert all(np.allclose(mel[k], want_mel[k], atol=1e-6) for k in mel)


def test_frames_read_missing_blocks_as_silence(spark):
    x = RNG.normal(0, 0.2, 3000).astype(np.float32)
    df = spark.createDataFrame([(1, 0, x[:800].tolist()), (1, 2000, x[2000:].tolist())], "rec_id string, start_sample bigint, pcm array<float>")
    quiet = x.copy()
    quiet[800:2000] = 0
    found = {r.frame: r.power for r in spectral.power_frames(df, 4).collect()}
    assert np.allclose([found[k] for k in sorted(found)], spectral.power_spectrum(quiet), atol=1e-9)
    assert spectral.mel_frames(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        spectral.mel_frames(df, group=3)


def test_rows_that_are_recordings_of_their_own(spark, signals):
    df = spark.createDataFrame([(k, x.tolist(), "x") for k, x in signals.items()] + [(None, [0.25] * 700, "x"), (77, None, "x"), (78, [], "x")], "rec_id int, pcm array<float>, frame string")
    known = signals | {None: np.full(700, 0.25, dtype=np.float32)}
    power, mel = spectral.power_frames(df), spectral.mel_frames(df)
    assert "Exchange" not in mel._jdf.queryExecution().executedPlan().toString()
    found = {(r.rec_id, r.frame): r.power for r in power.collect()}
    want = {(k, f): row for k, x in known.items() for f, row in enumerate(spectral.power_spectrum(x))}
    assert found.keys() == want.keys() and all(np.allclose(found[k], want[k]) for k in found)
    found = {(r.rec_id, r.frame): r.mel for r in mel.collect()}
    want = {(k, f): row for k, x in known.items() for f, row in enumerate(spectral.log_mel(x))}
    assert found.keys() == want.keys() and all(np.allclose(found[k], want[k]) for k in found)


def test_one_recording_is_many_tasks(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = spark.range(400).select(F.lit(1).alias("rec_id"), (F.col("id") * 160).alias("start_sample"), F.array_repeat(F.lit(0.1).cast("float"), 160).alias("pcm"))
        sizes = spectral._grouped(df, 10, 0).repartition("rec_id", "group").groupBy(F.spark_partition_id()).agg(F.sum(F.size("pcm")).alias("n")).collect()
        assert len(sizes) == 4 and max(r.n for r in sizes) < 0.6 * sum(r.n for r in sizes)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_byte_ranges(spark, tmp_path):
    x = RNG.uniform(-1, 1, 10_007).astype(np.float32)
    good = audio.wav_bytes(x)
    odd = good[:36] + b"note\x03\x00\x00\x00abc\x00" + good[36:]
    for name, data in {"a b": good, "cut": good[:-101], "odd": odd, "none": audio.wav_bytes(x[:0]), "bad": b"RIFF", "nothing": b""}.items():
        (tmp_path / f"{name}.wav").write_bytes(data)
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "f.f32").write_bytes(x.tobytes())
    (tmp_path / "g.f32").write_bytes(x.tobytes()[:-1])

    def whole(df):
        parts = {}
        for r in df.orderBy("path", "part").collect():
            parts.setdefault(r.path.rsplit("/", 1)[1], []).append(r)
        for rows in parts.values():
            assert [r.part for r in rows] == list(range(len(rows))) and [r.start_sample for r in rows] == [1000 * k for k in range(len(rows))]
            assert sum(len(r.pcm) for r in rows) == rows[0].n_samples
        return {k: (np.array([v for r in rows for v in r.pcm], dtype=np.float32), rows[0].error) for k, rows in parts.items()}

    where = f"file://{tmp_path}"
    strict, easy = whole(audio.read_wav(spark, where, block=1000)), whole(audio.read_wav(spark, where, "permissive", 1000))
    assert {k for k, (_, e) in strict.items() if e} == {"cut.wav", "odd.wav", "bad.wav"} and {k for k, (_, e) in easy.items() if e} == {"bad.wav"}
    want = audio.parse_wav(good)
    assert np.array_equal(strict["a b.wav"][0], want) and np.array_equal(easy["odd.wav"][0], want) and len(strict["none.wav"][0]) == 0
    assert np.array_equal(easy["cut.wav"][0], want[: len(want) - 51])
    raw = whole(audio.read_f32(spark, where, 1000))
    assert np.array_equal(raw["f.f32"][0], x) and raw["g.f32"][1]
    few = audio.read_wav(spark, where, where=F.col("length") < 100)
    assert {r.path.rsplit("/", 1)[1] for r in few.collect()} == {"none.wav", "bad.wav"}
    assert audio.read_wav(spark, where, where=F.col("path").endswith("nothing.wav")).count() == 0


def test_one_file_is_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(audio, "SPLIT", 1 << 20)
    with open(tmp_path / "long.wav", "wb") as f:  # sparse
        f.write(audio.wav_header(10_000_000))
        f.seek(44 + 2 * 9_034_567)
        f.write(b"\x00\x40")
        f.truncate(44 + 20_000_000)
    df = audio.read_wav(spark, f"file://{tmp_path}", block=100_000).withColumn("task", F.spark_partition_id())
    assert df.rdd.getNumPartitions() == math.ceil((44 + 20_000_000) / audio.SPLIT)
    found = df.select("part", F.size("pcm").alias("n"), "task", F.array_position("pcm", F.lit(0.5)).alias("at")).collect()
    assert sum(r.n for r in found) == 10_000_000 and len(found) == 100 and len({r.task for r in found}) > 10
    assert [(r.part, r.at) for r in found if r.at] == [(90, 34_568)]
    files = audio.audio_files(spark, f"file://{tmp_path}", audio.wav_format("strict")).first()
    assert (files.data_at, files.n_samples, files.error) == (44, 10_000_000, None)


@pytest.mark.parametrize("kind,read", [("wav", audio.read_wav), ("f32", audio.read_f32)])
def test_written_recordings_come_back(spark, tmp_path, signals, kind, read):
    df = recordings(spark, signals, [1, 50, 333]).unionByName(spark.createDataFrame([(90, 100, [0.5] * 10)], "rec_id bigint, start_sample bigint, pcm array<float>"), allowMissingColumns=True)
    target = f"file://{tmp_path}/out"
    audio.write_recordings(df.withColumn("rec_id", F.concat(F.lit("a/b "), F.col("rec_id"))), target, kind=kind)
    found = {r.path.rsplit("/", 1)[1]: np.array(r.pcm, dtype=np.float32) for r in read(spark, target).collect()}
    want = signals | {90: np.concatenate([np.zeros(100), np.full(10, 0.5)]).astype(np.float32)}
    assert found.keys() == {f"a%2Fb+{k}.{kind}" for k in want}
    for k, x in want.items():
        y = found[f"a%2Fb+{k}.{kind}"]
        assert np.array_equal(x, y) if kind == "f32" else np.array_equal(audio.parse_wav(audio.wav_bytes(x)), y)
    assert not [p for p in (tmp_path / "out").iterdir() if p.name.startswith(".")]
    audio.write_recordings(df.filter("rec_id = 90"), target, kind=kind)
    assert read(spark, target, where=F.col("path").endswith(f"/90.{kind}")).first().n_samples == 110


def test_mel_of_events_equals_its_sql(spark, sf):
    duckdb = pytest.importorskip("duckdb")
    from sonara.catalogue import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{sf}/events.parquet'")
    want = sorted(con.sql(ORACLE_SQL["mel_of_events"]).fetchall())
    assert want and sorted(tuple(r) for r in QUERIES["mel_of_events"](spark, sf).collect()) == want


def test_silence_is_not_transformed(monkeypatch):
    loud = RNG.normal(0, 0.2, 8000).astype(np.float32)
    x = np.concatenate([np.zeros(60_000, dtype=np.float32), loud, np.zeros(60_000, dtype=np.float32)])
    power = np.abs(np.fft.rfft(spectral.framed(x) * spectral.hann(), axis=1)) ** 2
    levels = np.log10(np.maximum(power[:-1] @ spectral.mel_filters().T, 1e-10))
    seen, rfft = [], np.fft.rfft
    monkeypatch.setattr(np.fft, "rfft", lambda a, axis: seen.append(len(a)) or rfft(a, axis=axis))
    assert np.array_equal(spectral.power_spectrum(x), power)
    assert np.allclose(spectral.log_mel(x), (np.maximum(levels, levels.max() - 8) + 4) / 4, atol=1e-6)
    assert 0 < sum(seen) < len(power) / 2
