"""Quality, toxicity, LZ fingerprints and mixing."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sonara.llm import lzprint, mixing, quality, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measures(text):
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = {k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab #\n\t\x0b\x1c é", max_size=120))
def test_measures_equal_brute_force(text):
    d = quality.Document(text)
    assert tuple(d.get(m) for m in quality.MEASURES) == measures(text)


def test_verdicts_of_odd_rows(odd, odd_rows):
    found = quality.quality_verdicts(odd).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in found) == sorted((r[0] or 0, *measures(r[1] or "")) for r in odd_rows)
    for r in found:
        failed = r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words
        assert r.base_failed == failed and not (failed and r.kept)


def test_order_changes_no_verdict():
    texts = ["word " * 50, "# $ % * a b c d e f g h", " ".join(f"w{i}" for i in range(40)), "x", ""]
    for rules in (quality.RULES, quality.RULES[::-1]):
        ordered = quality.order_rules(texts, rules)
        assert [quality.cascade(quality.Document(t), ordered) for t in texts] == [False, False, True, False, False]


def test_cascade_stops_at_the_first_rejection():
    seen = []
    rules = [quality.Rule(n, lambda d, n=n: seen.append(n) or n == "b") for n in "abc"]
    assert not quality.cascade(quality.Document("x"), rules) and seen == ["a", "b"]


def test_cheap_rejecting_rules_come_first():
    slow = quality.Rule("slow", lambda d: sum(range(200_000)) < 0)
    cheap = quality.Rule("cheap", lambda d: True)
    assert [r.name for r in quality.order_rules(["a"] * 5, (slow, cheap))] == ["cheap", "slow"]


def test_quality_filter_keeps_columns(odd, empty):
    kept = quality.quality_filter(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} >= {1, 7}
    assert quality.quality_filter(empty).count() == 0 and quality.quality_verdicts(empty).count() == 0


def test_toxicity_learns_and_ignores_held_out_labels(spark):
    rng = np.random.default_rng(0)
    plain = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(600):
        toxic = int(i % 4 == 0)
        said = list(rng.choice(plain, 30)) + (["vile", "awful"] * 2 if toxic else [])
        rows.append((i, " ".join(rng.permutation(said))))
        labels.append((i, toxic))
    docs, named = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    found = toxicity.toxicity_scores(docs, named).toPandas().set_index("doc_id").sort_index()
    truth = np.array([t for _, t in labels])
    held = found.held_out.to_numpy()
    assert ((found.predicted.to_numpy() == truth)[held]).mean() > 0.97
    assert found.score.between(0, 1).all() and (found.predicted == (found.score >= 0.7)).all()
    turned = spark.createDataFrame([(i, 1 - t if h else t) for (i, t), h in zip(labels, held, strict=True)], "doc_id bigint, toxic int")
    again = toxicity.toxicity_scores(docs, turned).toPandas().set_index("doc_id").sort_index()
    assert np.allclose(found.score, again.score)
    kept = toxicity.toxicity_filter(docs, named)
    assert kept.count() < 500 and kept.columns == docs.columns


def test_toxicity_of_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (2, 1, None), (3, 0, 1), (4, 1, 0), (None, 1, 1), (6, 0, 0)], "doc_id bigint, quality int, toxic int")
    found = toxicity.toxicity_scores(odd, labels).collect()
    assert len(found) == 10 and all(0 <= r.score <= 1 for r in found)
    assert toxicity.toxicity_scores(empty, labels).count() == 0
    assert {r.score for r in toxicity.toxicity_scores(odd, labels.limit(0)).collect()} == {0.5}


def test_model_is_sparse():
    rng = np.random.default_rng(1)
    data = [(np.unique(np.r_[rng.integers(100, 5000, 40), [7] if i % 3 == 0 else []]).astype(np.int64), int(i % 3 == 0)) for i in range(500)]
    model = toxicity.ftrl(data, bits=13)
    assert 7 in model.places and len(model.places) < 60


def slow_phrases(text):
    seen, out, start = set(), [], 0
    for end in range(1, len(text) + 1):
        if text[start:end] not in seen:
            seen.add(text[start:end])
            out.append(text[start:end])
            start = end
    return out + ([text[start:]] if start < len(text) else [])


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab c", max_size=90), st.text(alphabet="ab d", max_size=90))
def test_phrases_equal_brute_force(text, following):
    ends, rest = lzprint.parse(text + lzprint.END, set(), 0, len(text))
    assert [text[a:b] for a, b in zip([0, *ends], [*ends, len(text)], strict=True) if b > a] == slow_phrases(text)
    own, edited, of_edited = lzprint.both_fingerprints(text, following)
    assert edited == text[: len(text) - len(text) // 2] + following[: len(text) // 2]
    assert (own == lzprint.fingerprint(text)).all() and (of_edited == lzprint.fingerprint(edited)).all()


def test_likeness_estimates_the_common_share():
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(3000)]
    a, b = " ".join(words[:2000]), " ".join(words[1000:])
    exact = len(set(slow_phrases(a)) & set(slow_phrases(b))) / len(set(slow_phrases(a)) | set(slow_phrases(b)))
    assert abs(lzprint.likeness(lzprint.fingerprint(a), lzprint.fingerprint(b)) - exact) < 0.2
    assert lzprint.likeness(lzprint.fingerprint(a), lzprint.fingerprint(a)) == 1
    assert lzprint.likeness(lzprint.fingerprint(""), lzprint.fingerprint("")) == 1
    assert lzprint.likeness(lzprint.fingerprint("x"), lzprint.fingerprint("")) == 0


def test_edit_likeness_of_odd_rows(odd, odd_rows, empty):
    found = lzprint.edit_likeness(odd).collect()
    assert len(found) == len(odd_rows)
    texts = {}
    for r in odd_rows:
        texts.setdefault(r[0], []).append(r[1] or "")
    single = [k for k in (2, 3, 4, 5, 6)]
    order = [*single, 7]
    for r in found:
        if r.doc_id in single and r.doc_id < 6:
            text, following = texts[r.doc_id][0], texts[order[order.index(r.doc_id) + 1]][0]
            _, edited, of_edited = lzprint.both_fingerprints(text, following)
            assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
            assert r.edited_fingerprint == lzprint.to_text(of_edited) and r.fingerprint == lzprint.to_text(lzprint.fingerprint(text))
            assert r.near_next == lzprint.likeness(lzprint.fingerprint(text), lzprint.fingerprint(following))
    assert len({r.fingerprint for r in found if r.doc_id == 1}) == 1
    assert lzprint.edit_likeness(empty).count() == 0


def test_last_document_is_followed_by_the_first(spark):
    rows = [(i, f"text number {i} " * (i + 2)) for i in range(40)]
    found = {r.doc_id: r for r in lzprint.edit_likeness(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)).collect()}
    for i, text in rows:
        edited = lzprint.edited_text(text, rows[(i + 1) % 40][1])
        assert found[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    one = lzprint.edit_likeness(spark.createDataFrame(rows[:1], "doc_id bigint, text string")).collect()
    assert len(one) == 1 and one[0].near_next == 1


def slow_targets(sizes, weights=(5, 2, 1)):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    left, open_, target = 1.5 * sum(sizes.values()), set(sizes), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if weight[s] * level >= 2 * sizes[s]]
        if not over:
            return target | {s: weight[s] * level for s in open_}
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
            open_.remove(s)
    return target


def test_mix_meets_its_targets(spark):
    rng = np.random.default_rng(5)
    rows = [(i, "w " * int(rng.integers(0, 300)), str(rng.choice(["a", "b", "c", "d", "e"], p=[0.5, 0.2, 0.1, 0.1, 0.1])) if i % 17 else None) for i in range(800)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    found = mixing.mix(df).join(df.select("doc_id", "source"), "doc_id").toPandas()
    sizes = found.groupby("source", dropna=False)["size"].sum()
    sizes = {None if isinstance(k, float) else k: int(v) for k, v in sizes.items()}
    want = slow_targets(sizes)
    for source, g in found.groupby("source", dropna=False):
        source = None if isinstance(source, float) else source
        assert g.target.iloc[0] == pytest.approx(want[source]) and abs(g.taken.sum() - want[source]) <= 1
    assert (found.taken <= 2 * found["size"]).all() and len(found) == 800
    again = mixing.mix(df.repartition(7)).select("doc_id", "taken").orderBy("doc_id").toPandas()
    assert again.equals(found[["doc_id", "taken"]].sort_values("doc_id").reset_index(drop=True))
    queue = mixing.fair_queue(mixing.mix(df)).toPandas()
    assert queue.finish.is_monotonic_increasing and queue.words.sum() == found.taken.sum()


def test_mix_of_odd_rows(odd, odd_rows, empty):
    found = mixing.mix(odd).collect()
    assert sorted((r.doc_id or 0, r["size"]) for r in found) == sorted((r[0] or 0, len(WORD.findall(r[1] or ""))) for r in odd_rows)
    mixed = mixing.mixed_documents(odd)
    assert mixed.columns == odd.columns and mixed.count() > 0
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0


def test_mix_runs_without_python(odd):
    plan = mixing.mix(odd)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
