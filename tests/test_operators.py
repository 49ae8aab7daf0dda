"""Regions, curves, spectra, tokens, words, phrases, attempts and error rates."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sonara.catalogue import toy_tokenizer
from sonara.config import StreamConfig, TranscribeConfig, VadConfig, batched_vad
from sonara.functions import arrays, scores, text, times
from sonara.operators import attempts, curves, evaluate, phrases, regions, spectral, tokens, words

S = 16_000


def one(spark, column, **values):
    df = spark.range(1).select(*(F.lit(v).alias(k) if not isinstance(v, list) else F.array(*(F.lit(x) for x in v)).alias(k) for k, v in values.items()))
    return df.select(column.alias("x")).first().x


# --- functions ---


def test_pad_and_trim(spark):
    assert one(spark, arrays.pad_or_trim(F.col("a"), 5), a=[1.0, 2.0, 3.0]) == [1, 2, 3, 0, 0]
    assert one(spark, arrays.pad_or_trim(F.col("a"), 3), a=[1.0, 2.0, 3.0, 4.0, 5.0]) == [1, 2, 3]


def test_collect_regions(spark):
    spans = F.array(*(F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in ((1, 3), (7, 9))))
    assert one(spark, arrays.collect_regions(F.col("a"), spans), a=list(range(10))) == [1, 2, 7, 8]


def test_times(spark):
    assert one(spark, times.round_half_away(F.lit(1.005), 2)) == 1.0
    assert one(spark, times.round_half_away(F.lit(-2.5))) == -3
    assert one(spark, times.seconds_to_ns(F.lit(1.9999999999))) == 1_999_999_999
    assert one(spark, times.samples_to_ns(F.lit(512.0))) == 32_000_000
    assert tuple(one(spark, times.region_of(F.lit(-1.0), F.lit(0.5), F.lit(4000)))) == (0, 4000)
    assert one(spark, times.region_of(F.lit(0.5), F.lit(0.5), F.lit(40000))) is None
    assert one(spark, times.nearest_frame(F.lit(2.5), 1.0, 0.0)) == 2


def test_text_marks(spark):
    assert one(spark, text.normal_words(F.lit("Ёлка, don't İ ΣΑΣ"))) == ["елка", "don", "t", "i", "σασ"]
    assert one(spark, text.pretokens(F.lit("I'm  a b 12!"))) == ["I", "'m", "  ", "a", " ", "b", " 12", "!"]
    assert one(spark, text.ends_sentence(F.lit(' he said.")'))) and not one(spark, text.ends_sentence(F.lit("a,")))
    assert one(spark, text.starts_upper(F.lit("«Ábc"))) and not one(spark, text.starts_upper(F.lit("12 a")))
    assert one(spark, text.is_punctuation_byte(F.lit("!"))) and not one(spark, text.is_punctuation_byte(F.lit("¿")))
    assert one(spark, text.language_code(F.lit("<|haw|>"))) == "haw" and not one(spark, text.is_language_token(F.lit("<|transcribe|>")))


def test_config_defaults():
    c = VadConfig()
    assert (c.threshold, c.off, c.min_speech_ms, c.min_silence_ms, c.pad_ms, c.min_silence_at_max_ms) == (0.5, 0.35, 0, 2000, 400, 98)
    assert math.isinf(c.max_speech_s) and VadConfig(threshold=0.1).off == 0.01 and VadConfig(pad_ms=0).pad_ms == 0
    assert batched_vad("frames", 30).max_speech_s == 30 and batched_vad("frames", 30).threshold == 0.2
    assert TranscribeConfig().temperatures == (0.0, 0.2, 0.4, 0.6, 0.8, 1.0) and StreamConfig().alpha == 0.35


# --- regions ---


def curve(rng, n):
    out = []
    while len(out) < n:
        level = 0.9 if len(out) // 40 % 2 == 0 else 0.1
        out += [min(1, max(0, level + rng.uniform(-0.6, 0.6))) for _ in range(rng.randrange(5, 60))]
    return [float(np.float32(x)) for x in out[:n]]


def slow_regions(values, on, off):
    """Hysteresis without limits, from run lengths."""
    found, start = [], None
    for i, v in enumerate(values):
        if start is None and v >= on:
            start = i
        elif start is not None and v < off:
            found.append((start, i - 1))
            start = None
    return found + ([(start, len(values) - 1)] if start is not None else [])


def test_hysteresis_equals_a_loop(spark):
    rng = random.Random(1)
    data = {k: curve(rng, 300) for k in range(4)}
    df = spark.createDataFrame([(k, i, v) for k, vs in data.items() for i, v in enumerate(vs)], "k int, i int, v double").repartition(7)
    found = regions.hysteresis_regions(df, "k", ["i"], "v", 0.6, 0.3).collect()
    for k, vs in data.items():
        assert sorted((r["first"], r["last"]) for r in found if r.k == k) == slow_regions(vs, 0.6, 0.3)


def test_frame_machine_without_limits_is_hysteresis():
    rng = random.Random(2)
    for _ in range(30):
        values = curve(rng, 200)
        config = VadConfig(threshold=0.6, neg_threshold=0.3, min_silence_ms=0, pad_ms=0)
        want = [(a * 512, (b + 1) * 512 if b < 199 else 200 * 512) for a, b in slow_regions([float(np.float32(v)) for v in values], np.float32(0.6), np.float32(0.3))]
        assert regions.frame_regions(values, 200 * 512, config) == want


def test_frame_machine_golden():
    speech = [0.9] * 10 + [0.1] * 3 + [0.9] * 5 + [0.1] * 70 + [0.9] * 4
    n = len(speech) * 512
    assert regions.frame_regions(speech, n, VadConfig()) == [(0, 18 * 512), (88 * 512, n)]
    assert regions.frame_regions(speech, n, VadConfig(min_speech_ms=200)) == [(0, 18 * 512)]
    assert regions.frame_regions([0.1] * 50, 50 * 512, VadConfig()) == []
    assert regions.frame_regions([], 0, VadConfig()) == []


def test_frame_machine_cuts_long_speech():
    limit = VadConfig(max_speech_s=1.0, pad_ms=0, min_silence_ms=5000)
    flat = regions.frame_regions([0.9] * 100, 100 * 512, limit)
    assert flat[0] == (0, 31 * 512) and all(b - a <= 31 * 512 for a, b in flat)
    gap = [0.9] * 12 + [0.1] * 5 + [0.9] * 60
    last = regions.frame_regions(gap, len(gap) * 512, limit)
    assert last[0] == (0, 12 * 512) and last[1][0] == 17 * 512
    two = [0.9] * 8 + [0.1] * 8 + [0.9] * 4 + [0.1] * 5 + [0.9] * 40
    longest = regions.frame_regions(two, len(two) * 512, VadConfig(max_speech_s=1.0, pad_ms=0, min_silence_ms=5000, split_at_longest_silence=True))
    assert longest[0] == (0, 8 * 512) and longest[1][0] == 16 * 512


def test_overlap_machine():
    step = regions.FRAME_STEP
    values = [0.1] * 10 + [0.9] * 20 + [0.1] * 10
    at = lambda i: math.floor((i + 0.5) * step * S + 0.5)
    assert regions.overlap_regions(values, 10**7, VadConfig()) == [(at(10), at(30))]
    assert regions.overlap_regions([0.9] * 5, 10**7, VadConfig()) == [(at(0), at(4))]
    assert regions.overlap_regions([], 10, VadConfig()) == []
    dip = [0.9] * 30 + [0.5] + [0.9] * 40
    cut = regions.overlap_regions(dip, 10**7, VadConfig(max_speech_s=45 * step))
    assert cut[0] == (at(0), at(30)) and cut[1][0] == at(30) and cut[-1][1] == at(70)


def test_padding(spark):
    rng = random.Random(3)
    spans, t = [], 0
    for _ in range(60):
        t += rng.randrange(1, 9)
        spans.append((t, t := t + rng.randrange(1, 6)))
    n = t + 1
    df = spark.createDataFrame([(1, a, b) for a, b in spans], "k int, a bigint, b bigint")
    got = [(r.a, r.b) for r in regions.pad_regions(df, "k", "a", "b", 2, F.lit(n)).orderBy("a").collect()]
    assert got == regions.pad_list(spans, 2, n)
    assert regions.pad_list([(10, 20), (23, 30)], 5, 33) == [(5, 21), (22, 33)]


def test_greedy_merge(spark):
    spans = [(0, 5), (6, 10), (12, 31), (32, 38)]
    assert list(regions.merge_spans(spans, 30)) == [(0, 10), (12, 38)]
    rng = random.Random(4)
    for _ in range(5):
        t, more = 0, []
        for _ in range(40):
            t += rng.randrange(3)
            more.append((t, t := t + rng.randrange(1, 20)))
        df = spark.createDataFrame([([{"start": a, "end": b} for a, b in more],)], "r array<struct<start: bigint, end: bigint>>")
        folded = df.select(regions.merge_greedily(F.col("r"), F.lit(25)).alias("m")).first().m
        assert [(m["start"], m["end"]) for m in folded] == list(regions.merge_spans(more, 25))
    assert regions.batch_windows([], 10 * S) == [(0, 10 * S)] and regions.batch_windows([], 40 * S) == []


def test_restored_times(spark):
    spans = spark.createDataFrame([(1, 0, S), (1, 2 * S, 3 * S)], "k int, a bigint, b bigint")
    silence = regions.silence_map(spans, "k", "a", "b")
    at = spark.createDataFrame([(1, S // 2), (1, 3 * S // 2), (1, 5 * S), (2, 7)], "k int, t bigint")
    found = {r.t: r.original for r in regions.restore_times(at, silence, "k", "t").collect()}
    assert found == {S // 2: S // 2, 3 * S // 2: 5 * S // 2, 5 * S: 6 * S, 7: 7}


def test_speech_regions_do_not_depend_on_partitions(spark):
    rng = random.Random(5)
    rows = [(k, i, v) for k in range(3) for i, v in enumerate(curve(rng, 150))]
    df = spark.createDataFrame(rows, "rec_id bigint, idx bigint, score float")
    lengths = spark.createDataFrame([(k, 150 * 512) for k in range(3)], "rec_id bigint, n_samples bigint")
    config = VadConfig(min_silence_ms=100, max_speech_s=1)
    a = regions.speech_regions(df, lengths, config).orderBy("rec_id", "idx").collect()
    assert a == regions.speech_regions(df.repartition(9), lengths, config).orderBy("rec_id", "idx").collect() and a


# --- spectra ---


def sine(hz, seconds):
    return np.sin(2 * np.pi * hz * np.arange(int(S * seconds)) / S).astype(np.float32)


def test_spectra():
    assert np.allclose(spectral.hann(4), [0, 0.5, 1, 0.5])
    power = spectral.power_spectrum(sine(1000, 1))
    assert len(power) == 101 and abs(int(power[50].argmax()) - 25) <= 1
    assert len(spectral.power_spectrum(np.zeros(30 * S))) == 3001
    filters = spectral.mel_filters(80)
    assert (filters >= 0).all() and (filters.sum(axis=1) > 0).all()
    mel = spectral.log_mel(sine(440, 1))
    assert mel.min() >= -2 and mel.max() <= 2 and mel.shape == (100, 80)
    assert np.allclose(spectral.mel_to_hz(spectral.hz_to_mel(np.array([0.0, 500, 1000, 7000]))), [0, 500, 1000, 7000])
    grid = np.array([[b * 100 + f for b in range(2)] for f in range(10)], dtype=np.float32)
    assert spectral.mel_window(grid, 8, 4).tolist() == [[8, 108], [9, 109], [0, 0], [0, 0]]
    assert spectral.chunk_mel(sine(440, 2)).shape == (3000, 80) and len(spectral.log_mel(np.zeros(0))) == 0


def test_mel_frames(spark):
    df = spark.createDataFrame([(1, sine(440, 0.5).tolist()), (2, None), (3, [])], "rec_id bigint, pcm array<float>")
    rows = spectral.mel_frames(df).collect()
    assert {r.rec_id for r in rows} == {1} and len(rows) == 50 and len(rows[0].mel) == 80


def test_overlap_add_of_a_constant(spark):
    df = spark.createDataFrame([(1, w, [0.5] * 8) for w in range(3)], "k int, w int, s array<double>")
    found = curves.overlap_add(df, "k", "w", "s", 8, 4.0, 1.0).collect()
    assert len(found) == 16 and all(abs(r.score - 0.5) < 1e-9 for r in found)


# --- tokens ---


@pytest.fixture(scope="module")
def toy():
    return tokens.Tokenizer.from_json(toy_tokenizer())


def test_tokens_round_trip(toy):
    for t in ("the rain, and then it's here", "é 日本 x", "", "  two  spaces\n"):
        assert toy.decode(toy.encode(t)) == t
    assert toy.decode([*toy.encode("a"), toy.eot, toy.time_begin, 10**6, *toy.encode("b")]) == "ab"
    assert toy.decode_with_times([toy.time_begin, *toy.encode("hi"), toy.time_begin + 50]) == "<|0.00|>hi<|1.00|>"
    assert toy.language("fr") > 0 and toy.language("xx") == -1
    with pytest.raises(ValueError, match="missing"):
        tokens.Tokenizer({"a": 0}, [])


def test_merge_takes_the_lowest_rank(toy):
    assert toy.merge("the") == ["the"] if "the" in toy.vocab and ("th", "e") in toy.rank else toy.merge("the")
    t = tokens.Tokenizer(toy.vocab | {"ab": 9000, "bc": 9001}, ["b c", "a b"], toy.added)
    assert t.merge("abc") == ["a", "bc"]


def test_segments_by_timestamps():
    b, eot = 1000, 999
    T = lambda k: b + k
    split = lambda ts, o=0.0, seek=0: tokens.split_segments(ts, b, o, 3000, 30.0, seek)
    assert split([T(0), 1, 2, T(50), T(50), 3, 4, T(150), eot])[0] == [(0, 1, [T(0), 1, 2, T(50)])]
    found, seek, lone = split([T(0), 1, 2, T(50), T(50), 3, 4, T(150)])
    assert [(s, e) for s, e, _ in found] == [(0, 1), (1, 3)] and seek == 3000 and lone
    assert split([1, 2, T(50)])[0][0][:2] == (0, 1)
    found, seek, _ = split([1, 2], 5.0, 500)
    assert found[0][:2] == (5, 35) and seek == 3500
    assert split([T(0), 1, T(50)], 10.0)[0][0][:2] == (10, 11)
    assert split([])[0] == [(0.0, 30.0, [])]


def test_prompts(toy):
    sp = toy.special
    assert toy.prompt("en", "transcribe") == [sp["sot"], toy.language("en"), sp["transcribe"]]
    long = list(range(400))
    made = toy.prompt(None, "transcribe", long)
    assert made == [sp["sot_prev"], *long[-223:], sp["sot"]]
    assert toy.prompt("xx", "translate", timestamps=False) == [sp["sot"], sp["translate"], sp["no_timestamps"]]
    assert toy.prompt("en", "transcribe", prefix="the")[-2 - 0 :][0] in (toy.time_begin, *toy.encode(" the"))
    banned = toy.suppressed([-1, 5])
    assert banned == sorted(set(banned)) and sp["sot"] in banned and 5 in banned


def test_words_of_tokens(toy):
    ids = [*toy.encode("the rain, é"), toy.eot]
    said, groups = toy.words(ids, "en")
    assert "".join(said[:-1]) == "the rain, é" and [t for g in groups for t in g] == ids and "," in said
    chars, _ = toy.words([*toy.encode("日本"), toy.eot], "ja")
    assert chars[:2] == ["日", "本"]


def test_vocabulary_join(spark):
    vocab = spark.createDataFrame([(0, "Hello"), (1, " world"), (50, "<x>")], "id int, token string")
    rows = spark.createDataFrame([(1, [0, 1, 50, 7])], "k int, tokens array<int>")
    assert tokens.look_up(rows, vocab, ["k"], eot=50).first().text == "Hello world"


# --- words ---


def test_aligned_words(toy):
    ids = toy.encode(" the rain")
    n = len(ids)
    path = list(range(n + 1))
    found = words.aligned_words(path, [10 * k for k in path], [0.5] * n, ids, toy, "en")
    assert [w.word for w in found] == [" the", " rain"] and found[0].start == 0 and found[0].end == found[1].start
    assert found[1].end == pytest.approx(n * 0.2) and found[0].probability == 0.5
    assert words.aligned_words([], [], [], ids, toy, "en") == []


def word(w, a, b, p=1.0, n=1):
    return words.Aligned(w, [1] * n, a, b, p)


def test_punctuation_merges():
    ws = [word(" (", 0, 1), word("a", 1, 2), word(",", 2, 3), word(" b", 3, 4)]
    words.merge_punctuation(ws, "(", ",")
    assert [w.word for w in ws] == ["", " (a,", "", " b"] and [len(w.tokens) for w in ws] == [0, 3, 0, 1]


def test_long_words_at_sentence_ends():
    ws = [word("a.", 0, 5), word("b", 5, 9), word("c.", 9, 13), word("d", 13, 13.2), word("e", 14, 14.2), word("f", 15, 15.2)]
    words.shorten_at_sentences(ws, 1.0)
    assert (ws[0].start, ws[0].end) == (0, 5) and (ws[1].start, ws[1].end) == (8, 9) and (ws[2].start, ws[2].end) == (9, 10)
    assert words.typical_length([word("a", 0, 0.2), word("b", 0, 0.4), word("c", 1, 1)]) == pytest.approx(0.3)
    assert words.typical_length([word("a", 0, 9)]) == 0.7 and words.typical_length([]) == 0


def test_words_are_handed_out():
    segments = [words.Spoken(0, words.ns(2), [1, 1, 100]), words.Spoken(words.ns(2), words.ns(4), [1])]
    last = words.hand_out(segments, [word(" a", 0.1, 0.4), word(" b", 0.5, 0.9), word(" c", 2.2, 2.5)], 50, 100, "", "", 0.0)
    assert [[w[2] for w in s.words] for s in segments] == [["a", "b"], ["c"]]
    assert segments[0].start == words.ns(1.1) and last == pytest.approx(3.5)


# --- phrases ---

LIST = {"en": ["thanks for watching", "thank you", "bye", "subtitles by the community", "!.."]}
SPOKEN = f"start_ns bigint, end_ns bigint, text string, words array<{phrases.WORD}>, language string"


def cleaned(spark, text, ws=None, start=0, end=0):
    """(text, words, start, end), None if the segment goes."""
    r = phrases.clean_phrases(spark.createDataFrame([(start, end, text, ws, "en")], SPOKEN), LIST).first()
    return None if r.dropped else (r.text, r.words, r.start_ns, r.end_ns)


@pytest.mark.parametrize(
    ("said", "left"),
    [
        ("Thanks for watching!", None),
        ("thank you thank you", None),
        ("It rained, thanks for watching today", "It rained, today"),
        ("I want to thank you for this", "I want to thank you for this"),
        ("It ended. Thank you.", "It ended."),
        ("so we said Thank you Peter", "so we said Peter"),
        ("and thank you thank you all", "and all"),
        ("he said bye to us", "he said bye to us"),
        ("Bye!", None),
        ("!..", None),
        ("...", "..."),
        ("a subtitles by the community b", "a b"),
    ],
)
def test_phrases_in_text(spark, said, left):
    found = cleaned(spark, said)
    assert (found and found[0]) == left


def test_phrases_with_words_move_bounds(spark):
    units = "thanks for watching the rain".split()
    ws = [{"word": u, "start_ns": k, "end_ns": k + 1, "probability": 1.0} for k, u in enumerate(units)]
    assert cleaned(spark, "", ws, 0, 5)[2:] == (3, 5)
    assert cleaned(spark, "", ws[3:] + ws[:3], 3, 3)[0] == "the rain"
    assert cleaned(spark, "", ws[3:] + ws[:3], 3, 3)[3] == 5


def test_filter_numbers_anew(spark):
    rows = [(1, 1, 0, 1, "Thank you.", None, "en"), (1, 2, 1, 2, "real text", None, "en"), (1, 3, 2, 3, "Thank you.", None, "xx")]
    df = spark.createDataFrame(rows, f"rec_id bigint, id int, start_ns bigint, end_ns bigint, text string, words array<{phrases.WORD}>, language string")
    assert [(r.id, r.text) for r in phrases.filter_phrases(df, {"en": ["thank you"]}).orderBy("id").collect()] == [(1, "real text"), (2, "Thank you.")]


# --- attempts ---


def test_attempt_choice(spark):
    rows = [("first", 0, -0.5, 1.0, 0.0), ("first", 1, -0.1, 1.0, 0.0), ("second", 0, -0.5, 3.0, 0.0), ("second", 1, -0.9, 1.0, 0.0), ("silent", 0, -2.0, 9.0, 0.9)]
    rows += [("none", 0, -3.0, 1.0, 0.0), ("none", 1, -2.0, 5.0, 0.0), ("none", 2, -2.5, 1.0, 0.0), ("edge", 0, -1.0, 2.4, 0.9)]
    df = spark.createDataFrame(rows, "k string, n int, lp double, ratio double, ns double")
    found = {r.k: (r.chosen, r.reported) for r in attempts.choose_attempts(df, ["k"], "n", "lp", "ratio", "ns").collect()}
    assert found == {"first": (0, 0), "second": (1, 1), "silent": (0, 0), "none": (2, 2), "edge": (0, 0)}
    assert one(spark, scores.is_silent(F.lit(0.9), F.lit(-1.0))) and not one(spark, scores.is_silent(F.lit(0.6), F.lit(-5.0)))
    assert attempts.compression_ratio("") == 0 and attempts.compression_ratio("ab" * 500) > attempts.compression_ratio("a normal text")


def heard(start, end, p=0.05):
    return attempts.Heard(start, end, [(start, end, "w", p)])


def test_silence_control():
    stay, seek, skip = attempts.control_silence([heard(5, 5.05)], 2.0, 0, 3000, 30, 9000, 0.0)
    assert skip and seek == 500
    good = attempts.Heard(0.1, 1, [(0.1, 1, "w", 0.9)])
    stay, seek, skip = attempts.control_silence([good, heard(10, 10.01), attempts.Heard(20, 21, [(20, 21, "x", 0.9)])], 2.0, 0, 3000, 30, 9000, 0.0)
    assert stay == [good] and seek == 1000 and not skip
    assert attempts.control_silence([good], 2.0, 0, 3000, 30, 9000, 0.0) == ([good], 3000, False)


# --- error rates ---


def slow_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_edit_distance_equals_brute_force():
    rng = random.Random(6)
    for _ in range(150):
        a = [rng.choice("abc") for _ in range(rng.randrange(60))]
        b = [rng.choice("abc") for _ in range(rng.randrange(60))]
        assert evaluate.edit_distance(a, b) == slow_distance(a, b)


def test_error_rates(spark):
    df = spark.createDataFrame([("A b, c", "a b d"), ("", ""), ("", "x"), (None, None)], "r string, h string")
    found = [(r.wer, r.cer) for r in evaluate.error_rates(df, "r", "h").collect()]
    assert found == [(pytest.approx(1 / 3), pytest.approx(1 / 3)), (0, 0), (1, 1), (0, 0)]
    assert evaluate.normal_form("Ａ  B—c") == "a b c"


def test_a_batch_of_ids_takes_few_bytes_a_token(spark):
    import tracemalloc

    encode = tokens.encode_udf(toy_tokenizer()).func
    texts = pd.Series(["the rain is here and the others are on the train again " * 20, "", None] * 500)
    tracemalloc.start()
    (found,) = encode(iter([texts]))
    held, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    n = sum(len(x) for x in found if x is not None)
    assert n > 100_000 and held < 7 * n
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(texts[:3])], "k int, text string").select("k", tokens.encode_udf(toy_tokenizer())("text").alias("t")).orderBy("k").collect()
    assert [r.t for r in rows] == [found[0].tolist(), [], None]
