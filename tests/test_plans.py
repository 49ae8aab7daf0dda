"""Sources, plug-ins, transcription plans, streaming, the query contract."""

import json

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from sonara.catalogue import ORACLE_SQL, QUERIES, burst_recordings, toy_tokenizer
from sonara.config import StreamConfig, TranscribeConfig, VadConfig
from sonara.plans import scoring, stub, transcribe
from sonara.sources import audio, documents
from sonara.streaming import endpoint

S = 16_000


def bursts(*spans, seconds):
    x = np.zeros(int(S * seconds), dtype=np.float32)
    for a, b in spans:
        n = np.arange(int(a * S), int(b * S))
        x[n] = 0.5 * np.sin(2 * np.pi * 220 * n / S)
    return x


def test_wav_round_trip(spark, tmp_path):
    x = bursts((0.1, 0.4), seconds=0.6)
    (tmp_path / "a.wav").write_bytes(audio.wav_bytes(x))
    (tmp_path / "bad.wav").write_bytes(b"RIFFxxxxWAVE")
    (tmp_path / "c.f32").write_bytes(x.astype("<f4").tobytes())
    rows = {r.path.rsplit("/", 1)[1]: r for r in audio.read_wav(spark, f"file://{tmp_path}").collect()}
    assert np.abs(np.array(rows["a.wav"].pcm) - x).max() < 1e-4 and rows["a.wav"].error is None
    assert rows["bad.wav"].error and not rows["bad.wav"].pcm
    assert np.array_equal(np.array(audio.read_f32(spark, f"file://{tmp_path}").first().pcm, dtype=np.float32), x)
    parts = audio.read_wav(spark, f"file://{tmp_path}", block=1000).filter("error is null")
    assert parts.count() == 10 and len(audio.whole_recordings(parts).first().pcm) == len(x)


def test_wav_modes():
    good = audio.wav_bytes(np.zeros(4))
    stereo = good[:22] + b"\x02\x00" + good[24:]
    with pytest.raises(audio.WavError):
        audio.parse_wav(stereo)
    assert len(audio.parse_wav(stereo, permissive=True)) == 4
    with pytest.raises(audio.WavError):
        audio.parse_wav(good[:-2])
    assert len(audio.parse_wav(good[:-2], permissive=True)) == 3
    odd = good[:36] + b"note\x03\x00\x00\x00abc\x00" + good[36:]
    assert len(audio.parse_wav(odd, permissive=True)) == 4
    with pytest.raises(audio.WavError):
        audio.parse_wav(odd)


def test_documents(spark, tmp_path):
    (tmp_path / "t.json").write_text(toy_tokenizer())
    vocab, merges, languages = documents.read_vocabulary(spark, f"file://{tmp_path}/t.json")
    assert vocab.count() > 256 and merges.filter("rank = 0").count() == 1 and {r.language for r in languages.collect()} == {"en", "fr"}
    (tmp_path / "p.json").write_text(json.dumps({"en": ["Thank you!", "..."]}))
    found = documents.read_phrases(spark, f"file://{tmp_path}/p.json").orderBy("ordinal").collect()
    assert found[0].words == ["thank", "you"] and found[1].n_words == 0
    assert documents.read_results(spark, f"file://{tmp_path}/none.json").count() == 0
    rows = spark.createDataFrame([("a", "x"), ("b", "y")], "file string, text string")
    documents.write_results(rows, f"file://{tmp_path}/out", implementation="own", mode="batched")
    assert {r.file for r in documents.read_results(spark, f"file://{tmp_path}/out").collect()} == {"a", "b"}
    with pytest.raises(ValueError, match="unknown"):
        documents.resolve_model("nothing")
    with pytest.raises(FileNotFoundError):
        documents.resolve_model("tiny", str(tmp_path))
    assert documents.resolve_model(str(tmp_path)) == tmp_path and documents.model_names() == sorted(documents.MODELS)


def test_frame_scores_do_not_depend_on_parts(spark):
    x = bursts((0.2, 0.5), seconds=1.01)

    def parts(size):
        rows = [(1, k, x[k : k + size].tolist()) for k in range(0, len(x), size)]
        return scoring.frame_scores(spark.createDataFrame(rows, "rec_id bigint, start_sample bigint, pcm array<float>"), scoring.EnergyScorer).orderBy("idx").collect()

    whole = parts(len(x))
    assert len(whole) == 32 and all(0 <= r.score <= 1 for r in whole)
    assert parts(777) == whole and parts(5000) == whole


def test_frame_scores_of_whole_rows_stay_where_they_lie(spark):
    rows = spark.createDataFrame([(1, bursts((0.2, 0.5), seconds=1.01).tolist()), (None, [0.5] * 700), (3, []), (4, None)], "rec_id bigint, pcm array<float>")
    found = scoring.frame_scores(rows, scoring.EnergyScorer)
    parts = scoring.frame_scores(rows.filter("size(pcm) > 0").withColumn("start_sample", F.lit(0).cast("bigint")), scoring.EnergyScorer)
    key = lambda r: (r.rec_id or 0, r.idx)
    assert sorted(found.collect(), key=key) == sorted(parts.collect(), key=key) and found.count() == 34
    assert "Exchange" not in QUERIES["frame_scores"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


def test_many_rows_score_as_one_by_one():
    rng = np.random.default_rng(3)
    rows = (rng.normal(size=(2500, scoring.CONTEXT + scoring.WINDOW)) * rng.choice([0.01, 0.05, 1], (2500, 1))).astype(np.float32)
    rows[7, 100] = np.nan
    scorer = scoring.EnergyScorer()
    assert scoring.stepped(scorer, 0.0, rows)[0] == [scorer.step(0.0, r)[0] for r in rows]


def test_slide_scores():
    x = bursts((3, 6), seconds=12)
    found = scoring.slide_scores(x, scoring.EnergyScorer())
    at = lambda s: found[int(s / scoring.FRAME_STEP)]
    assert at(4.5) > 0.9 and at(1) < 0.1 and at(10) < 0.1 and len(scoring.slide_scores(np.zeros(0), scoring.EnergyScorer())) == 0
    assert np.allclose(found, scoring.slide_scores(x, scoring.EnergyScorer(), batch=1))


def recordings(spark):
    rows = [(1, bursts((0.5, 2), (5, 6), seconds=8).tolist()), (2, bursts(seconds=3).tolist()), (3, []), (4, None)]
    return spark.createDataFrame(rows, "rec_id bigint, pcm array<float>")


def test_batched_plan(spark):
    config = TranscribeConfig(word_timestamps=True)
    found = transcribe.batched_plan(recordings(spark), scoring.EnergyScorer, stub.StubModel, toy_tokenizer(), config)
    rows = found.collect()
    assert any(r.rec_id == 1 for r in rows) and all(r.text and r.start_ns != r.end_ns for r in rows)
    assert all(w["start_ns"] <= w["end_ns"] for r in rows for w in r.words)
    done = transcribe.finish(found).collect()
    assert all([s.id for s in r.segments] == list(range(1, len(r.segments) + 1)) for r in done)


def test_sequential_plan_restores_times(spark):
    config = TranscribeConfig(vad_filter=True, vad=VadConfig(min_silence_ms=500, pad_ms=0))
    rows = transcribe.sequential_plan(recordings(spark), scoring.EnergyScorer, stub.StubModel, toy_tokenizer(), config).collect()
    assert {r.rec_id for r in rows} == {1} and rows[0].start_ns >= 400_000_000
    plain = transcribe.sequential_plan(recordings(spark), scoring.EnergyScorer, stub.StubModel, toy_tokenizer()).collect()
    assert 1 in {r.rec_id for r in plain} and 2 not in {r.rec_id for r in plain}


def test_original_time():
    spans = [(0, S), (3 * S, 4 * S)]
    assert transcribe.original_time(0.5, spans) == 0.5 and transcribe.original_time(1.5, spans) == 3.5 and transcribe.original_time(1.5, []) == 1.5


CONFIG = StreamConfig(min_silence_ms=300, alpha=0)


def events_of(x, size, config=CONFIG):
    scorer = scoring.EnergyScorer()
    machine, out = endpoint.Endpointer(config, scorer.start()), []
    for k in range(0, len(x), size):
        out += machine.push(x[k : k + size], scorer)
    return out, machine


def test_endpoints_do_not_depend_on_chunks():
    x = bursts((0.5, 2), (2.6, 3.4), seconds=5)
    want, _ = events_of(x, 1536)
    assert [e[0] for e in want] == ["start_of_speech", "end_of_speech"] * 2
    for size in (100, 512, 999, 4096):
        assert events_of(x, size)[0] == want
    assert want[1][2] - want[1][1] == endpoint.ns_of(want[1][4]) or abs(want[1][2] - want[1][1] - endpoint.ns_of(want[1][4])) <= 1


def test_flush_closes_once():
    _, machine = events_of(bursts((0.5, 2), seconds=2), 512)
    assert [e[0] for e in machine.flush()] == ["end_of_speech"] and machine.flush() == []


def test_buffer_cap_is_told():
    out, _ = events_of(bursts((0.5, 4), seconds=6), 512, StreamConfig(min_silence_ms=300, alpha=0, buffer_s=1))
    assert out[-1][5] and out[-1][4] == S + S // 2


def test_early_rows_wait_and_late_rows_are_counted():
    x = bursts((0.5, 2), seconds=3)
    scorer = scoring.EnergyScorer()
    source = endpoint.Source(endpoint.Endpointer(CONFIG, scorer.start()))
    cuts = list(range(0, len(x), 4000))
    order = [cuts[1], cuts[0], cuts[3], cuts[2], *cuts[4:]]
    out = [e for k in order for e in source.take(k, x[k : k + 4000], False, scorer)]
    assert out == events_of(x, 4000)[0]
    source.take(0, x[:4000], False, scorer)
    assert source.late == 1


def test_rows_that_carry_on_are_taken_as_one():
    x = bursts((0.5, 2), (2.6, 3.4), seconds=5)
    for cuts in ([0, 900, 4000, 4000, 30_000, len(x)], list(range(0, len(x) + 1, 1000))):
        rows = [(a, b, b == len(x)) for a, b in zip(cuts, cuts[1:], strict=False)]
        for extra in ([], [(100, 500, False)], [(30_000, 60_000, True)], [(70_000, len(x), False)]):
            both = sorted(rows + extra, key=lambda r: r[0])
            scorer = scoring.EnergyScorer()
            one, all_ = (endpoint.Source(endpoint.Endpointer(CONFIG, scorer.start())) for _ in range(2))
            want = [e for a, b, last in both for e in one.take(a, x[a:b], last, scorer)] + one.give_up(scorer)
            got = all_.take_all([r[0] for r in both], [r[1] - r[0] for r in both], [r[2] for r in both], np.concatenate([x[a:b] for a, b, _ in both]), scorer)
            assert got + all_.give_up(scorer) == want and all_.late == one.late and want


def chunks_of(spark):
    rows = []
    for name, x in (("a", bursts((0.5, 2), seconds=3)), ("b", bursts((0.2, 1), seconds=1))):
        rows += [(name, k, x[k : k + 3000].tolist(), k + 3000 >= len(x)) for k in range(0, len(x), 3000)]
    return spark.createDataFrame(rows, endpoint.CHUNKS)


def test_stream_equals_batch(spark, tmp_path):
    chunks = chunks_of(spark)
    want = endpoint.endpoints(chunks.repartition(3), scoring.EnergyScorer, CONFIG).drop("late_rows").collect()
    chunks.filter("start_sample < 9000").coalesce(1).write.parquet(f"{tmp_path}/in/1")
    chunks.filter("start_sample >= 9000").coalesce(1).write.parquet(f"{tmp_path}/in/2")
    stream = spark.readStream.schema(endpoint.CHUNKS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    out = endpoint.stream_endpoints(stream, scoring.EnergyScorer, CONFIG)
    query = out.writeStream.format("memory").queryName("endpoints").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = spark.table("endpoints").drop("late_rows").collect()
    key = lambda r: (r.source_id, r.start_ns, r.type)
    assert sorted(got, key=key) == sorted(want, key=key) and len(want) == 4


def test_endpoints_of_whole_rows_equal_those_of_chunks(spark):
    chunks = chunks_of(spark)
    want = endpoint.endpoints(chunks, scoring.EnergyScorer, CONFIG).collect()
    held = {}
    for r in sorted(chunks.collect(), key=lambda r: (r.source_id, -r.start_sample)):  # the last chunk first
        held.setdefault(r.source_id, []).append(r)
    rows = [(s, [(r.start_sample, len(r.pcm), r.last) for r in rs], [v for r in rs for v in r.pcm]) for s, rs in held.items()] + [("c", [], []), ("d", None, None)]
    whole = spark.createDataFrame(rows, "source_id string, chunks array<struct<start_sample: bigint, n_samples: int, last: boolean>>, pcm array<float>")
    assert sorted(endpoint.endpoints(whole, scoring.EnergyScorer, CONFIG).collect()) == sorted(want) and len(want) == 4
    assert "Exchange" not in QUERIES["live_endpoints"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


def test_contract(spark):
    names = contract.queries()
    assert set(contract.oracle_sql()) <= set(names) and set(QUERIES) <= set(names)
    assert contract.entry(spark).count() > 0


def plain(value):
    return round(value, 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, sf, name):
    db = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "orders", "lineitem", "events", "documents", "embeddings", "conversations"):
        db.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    found = contract.queries()[name](spark, sf)
    cursor = db.execute(ORACLE_SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(found.columns)
    key = lambda r: tuple((v is not None, str(v)) for v in r)
    got = sorted((tuple(map(plain, r)) for r in found.select(*columns).collect()), key=key)
    assert got == sorted((tuple(map(plain, r)) for r in cursor.fetchall()), key=key)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_other_queries_run(spark, sf, name):
    assert contract.queries()[name](spark, sf).agg(F.count("*")).first()[0] > 0


def test_all_embeddings_are_recordings(spark, sf):
    ids = {r.vec_id for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id").collect()}
    assert len(ids) > 40 and {r.rec_id for r in burst_recordings(spark, sf).select("rec_id").collect()} == ids
    assert {r.rec_id for r in QUERIES["mel_features"](spark, sf).collect()} == ids
