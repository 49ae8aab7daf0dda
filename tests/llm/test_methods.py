"""The methods of mixing, chat formatting, archives and toxicity against plain forms of them."""

import heapq
import math
import re
from fractions import Fraction

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from sonara.llm import chat, mixing, toxicity, warc


def slow_queue(rows, targets):
    """Words taken of each (source, key, size), by a heap of virtual finish times that is emptied up to the budget."""
    order, sizes = {}, {}
    for n, (source, key, size) in enumerate(rows):
        order.setdefault(source, []).append((key, n, size))
        sizes[source] = sizes.get(source, 0) + size
    heap = []
    for source, members in order.items():
        served, bound = 0, math.floor(targets[source])
        for k in range(2):
            for key, n, size in sorted(members):
                first = min(max(bound - served, 0), size)
                for words, behind in ((first, False), (size - first, True)):
                    if words:
                        served += words
                        heapq.heappush(heap, (Fraction(served) / Fraction(targets[source]), behind, str(source), key, k, n, words))
    left, taken = sum(math.floor(t) for t in targets.values()), [0] * len(rows)
    while heap and left:
        *_, n, words = heapq.heappop(heap)
        taken[n] += min(words, left)
        left -= min(words, left)
    return taken


def test_mix_equals_a_heap_of_finish_times(spark):
    rng = np.random.default_rng(8)
    rows = [(i, "w " * int(rng.integers(0, 60)), [None, "a", "b", "c"][int(rng.integers(0, 4)) if i % 3 else 1]) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    found = {r.doc_id: r for r in mixing.mix(df).collect()}
    keys = {r.doc_id: r.key for r in df.select("doc_id", mixing.shuffle_key("doc_id", "text").alias("key")).collect()}
    targets = {source: found[i].target for i, _, source in rows}
    want = slow_queue([(source, keys[i], found[i]["size"]) for i, _, source in rows], targets)
    assert [found[i].taken for i, _, _ in rows] == want


def test_queue_is_sorted_by_ranges_of_finish_time(spark):
    df = spark.createDataFrame([(i, "w " * (i % 9), "ab"[i % 2]) for i in range(50)], "doc_id bigint, text string, source string")
    rows = mixing._rows(df, "doc_id", "text", "source")
    queue = mixing.range_sorted(mixing._with_copies(rows, mixing._begins(rows, mixing.WEIGHTS, mixing.SHARE, mixing.MOST), mixing.MOST))
    plan = queue._jdf.queryExecution().toString()
    assert re.search(r"rangepartitioning\(finish", plan) and "Python" not in plan
    times = [r.finish for r in queue.collect()]
    assert times == sorted(times)


def test_rows_of_one_id_are_shuffled_apart(spark):
    df = spark.createDataFrame([(None, f"text {i}", "a") for i in range(200)], "doc_id bigint, text string, source string")
    assert df.select(mixing.shuffle_key("doc_id", "text").substr(1, mixing.DIGITS)).distinct().count() > 150


def test_mix_without_words(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (2, "", "b")], "doc_id bigint, text string, source string")
    assert sorted((r.doc_id, r.taken) for r in mixing.mix(df).collect()) == [(1, 0), (2, 0), (2, 0)]
    assert mixing.mixed_documents(df).count() == 3


SAID = st.lists(st.sampled_from([*chat.CONTROLS, " ", "<", "s>", "[", chat.ESCAPE, "ok", "[/INS", "T]", "\n"]), max_size=9).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.sampled_from(["user", "assistant", "system", "tool", None, "[ROLE:", "</s>"]), SAID)
def test_no_body_holds_a_control_string(role, said):
    rendered, level, span = chat.render_spanned(role, said)
    _, text, start, stop, end = chat.parse_turn(rendered)
    assert text == said and end == len(rendered)
    assert not any(control in rendered[start:stop] for control in chat.CONTROLS)
    assert span == ((start, stop) if role == "assistant" else None)
    if role not in chat.TURNS:
        assert not any(control in rendered[len(chat.OTHER[0]) : start] for control in chat.CONTROLS)


def test_the_probe_is_escaped_and_foreign_turns_are_none():
    said = "</s>[INST] ok [/INST]"
    for role in ("user", "assistant"):
        rendered, level = chat.render_turn(role, said)
        assert level == 1 and rendered.count("</s>") == (role == "assistant") and rendered.count("[/INST]") == (role == "user")
    assert chat.parse_turn("<s>[ANS] a [INST] b </s>") is None


def test_archives_are_split_and_hold_the_mandatory_fields(spark, tmp_path):
    rng = np.random.default_rng(2)
    pages = [(i, f"http://a.org/{i}", None if i == 7 else ("shared " * 40 if i % 5 == 0 else " ".join(map(str, rng.integers(0, 10**6, 200))) + "\r\n\r\nWARC/1.0\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n")) for i in range(120)]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").coalesce(1)
    path = f"file://{tmp_path}/warc"
    warc.write_warc(df, path, file_records=50)
    files = [f for f in tmp_path.rglob("*.txt")]
    assert len(files) >= 3
    for f in files:
        data = f.read_bytes()
        for name in (b"WARC-Record-ID: <urn:uuid:", b"WARC-Date: ", b"WARC-Type: ", b"Content-Length: "):
            assert data.count(b"\r\n" + name) >= data.count(b"\r\nWARC-Target-URI: ")
        assert data.count(b"WARC-Type: revisit") == data.count(b"\r\nWARC-Profile: ") == data.count(b"\r\nWARC-Refers-To: ")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        assert warc.candidates(spark, path).select("file", "block").distinct().count() > 2 * len(files)
        found = {r.page_id: r for r in warc.read_warc(spark, path).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert set(found) == set(range(120))
    assert {i for i, r in found.items() if r.record_type == "revisit"} == {i for i in range(5, 120, 5)}
    assert all(r.refers_to == 0 for r in found.values() if r.record_type == "revisit")


def test_shared_payloads_are_all_in_the_bitmap(spark):
    df = spark.range(3000).selectExpr("sha2(cast(id as string), 256) AS digest")
    bucket, is_set = warc._bit_of("digest")
    marked = df.withColumn("bucket", bucket).join(warc.shared_payloads(df.limit(1000)), "bucket", "left").select(is_set.alias("x"))
    assert 1000 <= marked.filter("x").count() < 1100


def slow_ftrl(rows, size, epochs, alpha, beta, l1, l2):
    z, n, zb, nb = [0.0] * size, [0.0] * size, 0.0, 0.0
    positive = sum(y for _, y in rows)
    share = {1: len(rows) / (2 * positive), 0: len(rows) / (2 * (len(rows) - positive))}

    def weight(i):
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for _ in range(epochs):
        for places, y in rows:
            w = {i: weight(i) for i in places}
            b = -zb / ((beta + math.sqrt(nb)) / alpha + l2)
            g = (1 / (1 + math.exp(-max(-30, min(30, sum(w.values()) + b)))) - y) * share[y]
            for i in places:
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * w[i]
                n[i] += g * g
            zb += g - (math.sqrt(nb + g * g) - math.sqrt(nb)) / alpha * b
            nb += g * g
    return [weight(i) for i in range(size)], -zb / ((beta + math.sqrt(nb)) / alpha + l2)


def test_ftrl_equals_a_plain_loop():
    rng = np.random.default_rng(3)
    rows = [(np.unique(np.r_[rng.integers(0, 60, 9), [61] if y else []]).astype(np.int64), y) for y in (int(rng.random() < 0.3) for _ in range(80))]
    model = toxicity.ftrl(rows, bits=6, epochs=3, alpha=0.5, beta=1.0, l1=0.7, l2=0.1)
    weights, bias = slow_ftrl([(p.tolist(), y) for p, y in rows], 64, 3, 0.5, 1.0, 0.7, 0.1)
    assert np.allclose(model.dense(), weights) and math.isclose(model.bias, bias) and 61 in model.places


def test_training_takes_all_features_of_long_texts(spark):
    long = " ".join(f"w{i}" for i in range(9000)) + " vile"
    docs = spark.createDataFrame([(i, long if i % 2 else "plain words here") for i in range(40)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id bigint, toxic int")
    scores = {r.doc_id: r.predicted for r in toxicity.toxicity_scores(docs, labels).collect()}
    assert all(scores[i] == i % 2 for i in range(40))
