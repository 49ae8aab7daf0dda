"""Whole operators against plain forms: hashes and sketches, features and scores, hot fingerprints, planted aliases."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from sonara.llm import lzprint, simhash, toxicity, urls

MASK = (1 << 64) - 1


def slow_hash(phrase):
    h = sum((ord(c) + 1) * pow(lzprint._ODD, k, 1 << 64) for k, c in enumerate(phrase)) & MASK
    for _ in range(2):
        h = ((h ^ h >> 32) * 0xD6E8FEB86659FD93) & MASK
    return h >> 32


def slow_print(text):
    seen, own, run = set(), [], ""
    for c in text:
        run += c
        if run not in seen:
            seen.add(run)
            own.append(run)
            run = ""
    return sorted({slow_hash(p) for p in [*own, *([run] if run else [])]})[: lzprint.SIZE]


def slow_likeness(a, b):
    if not a or not b:
        return float(len(a) == len(b))
    least = sorted({*a, *b})[: lzprint.SIZE]
    return sum(h in a and h in b for h in least) / len(least)


def hexed(hashes):
    return "".join(f"{h:08x}" for h in hashes)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abcdé 👍", max_size=600), st.text(max_size=60))
def test_fingerprints_equal_plain_ones(a, b):
    for text in (a, b, a + b, "".join(random.Random(len(a)).choices("abcdefgh", k=3000)) + b):
        assert lzprint.to_text(lzprint.fingerprint(text)) == hexed(slow_print(text))
    assert lzprint.likeness(lzprint.fingerprint(a), lzprint.fingerprint(a + b)) == slow_likeness(slow_print(a), slow_print(a + b))


def test_edit_likeness_of_all_odd_texts(spark, odd_rows):
    texts = [(i, r[1]) for i, r in enumerate(odd_rows)]
    found = lzprint.edit_likeness(spark.createDataFrame(texts, "doc_id bigint, text string").repartition(4)).collect()
    assert len(found) == len(texts)
    for r in found:
        own, following = (texts[i % len(texts)][1] or "" for i in (r.doc_id, r.doc_id + 1))
        half = len(own) // 2
        edited = own[: len(own) - half] + following[:half]
        prints = [slow_print(t) for t in (own, edited, following)]
        assert (r.n_chars, r.edited_sha256) == (len(own), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (hexed(prints[0]), hexed(prints[1]))
        assert (r.near_edited, r.near_next) == (slow_likeness(*prints[:2]), slow_likeness(prints[0], prints[2]))


def slow_places(text, bits):
    k = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9]
    h = [xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"), 3) for w in re.findall(r"\w+", text.lower())]
    found = {(x * k[0] & MASK) >> 64 - bits for x in h}
    for gap in (1, 2):
        for x, y in zip(h, h[gap:], strict=False):
            pair = (x * k[gap] & MASK) ^ (y + (y << 7) & MASK)
            found.add(((pair ^ pair >> 31) * k[0] & MASK) >> 64 - bits)
    return sorted(found)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "İ", "ß-x", "vile", "1_2", "日本", "\ud800", "", "."]), max_size=12).map(" ".join), st.sampled_from([4, 20]))
def test_features_and_scores_equal_plain_ones(text, bits):
    places = slow_places(text, bits)
    assert toxicity.Hasher(bits).features(text).tolist() == places
    rng = np.random.default_rng(5)
    held = sorted({*places[::2], 1, 5})
    model = toxicity.Model(bits, np.array(held), rng.normal(size=len(held)), -0.3)
    weights = dict(zip(held, model.weights, strict=True))
    assert math.isclose(toxicity.scorer(model)(text), 1 / (1 + math.exp(0.3 - sum(weights.get(p, 0) for p in places))), rel_tol=1e-9)


@pytest.mark.parametrize("share", [0.0, 0.1, 1.0])
def test_hot_fingerprints_are_named_alike(spark, monkeypatch, share):
    monkeypatch.setattr(simhash, "HOT_SHARE", share)
    texts = [None, "", " "] * 40 + ["one text that many rows repeat word by word"] * 80 + [f"a text of number {i} alone" for i in range(30)]
    rows = [(None if i == 5 else i, t) for i, t in enumerate(texts)] + [(None, "a text whose rows have no id at all")] * 50
    found = Counter(map(tuple, simhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)).collect()))
    assert found.total() == len(rows) and {i for i, _, _ in found} == {i for i, _ in rows}
    of = {i: (p, c) for i, p, c in found if i is not None}
    assert all(of[i] == ("0" * 16, 0) for i in range(120) if i != 5) and all(of[i] == (of[120][0], 120) for i in range(120, 200))
    assert sorted((n, c) for (i, _, c), n in found.items() if i is None) == sorted([(1, 0), (50, None)], key=lambda x: x[0])


def slow_verdicts(pages):
    """Verdicts of (url, target) by rules and a walk over links."""

    def address(url):
        host, slash, path = url.split("://")[1].partition("/")
        return host + "/" + path

    def rule(node):
        host, _, path = node.partition("/")
        path = "/" + path.split("?")[0]
        fits = [(len(h + p), v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits)[1] if fits else None

    beside = {}
    for url, to in pages:
        if url and to:
            beside.setdefault(address(url), set()).add(address(to))
            beside.setdefault(address(to), set()).add(address(url))
    out = []
    for url, _ in pages:
        if not url:
            out.append("allow")
            continue
        seen, todo = {address(url)}, [address(url)]
        while todo:
            for node in beside.get(todo.pop(), set()) - seen:
                seen.add(node)
                todo.append(node)
        decisions = {rule(n) for n in seen}
        out.append(rule(address(url)) or ("allow" if "allow" in decisions else "block" if "block" in decisions else "allow"))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_planted_aliases_equal_a_walk(spark, seed):
    rng = random.Random(seed)
    hosts = [f"h{i}.net" for i in range(25)] + ["b.com", "x.org", "example.org"]
    known = [f"http://{h}{p}" for h in hosts for p in ("/", "/de/1", "/es/2", "/k?id=1", "/k?id=2")]
    link = ['<link rel="canonical" href="{}">', '<meta http-equiv="refresh" content="0; url={}">']
    pages = [(rng.choice(known), rng.choice(known) if rng.random() < 0.3 else None) for _ in range(150)]
    pages += [(None, "http://b.com/de/1")] * 60 + [(known[0], "http://b.com/de/1")] * 60 + [(known[1], None)] * 60
    long = "<p>" + "words without a link " * 20_000
    rows = [(i, u, (long if i == 7 else "") + (rng.choice(link).format(t) if t else "")) for i, (u, t) in enumerate(pages)]
    found = urls.judge_urls(spark.createDataFrame([*rows, rows[3], rows[-1]], "page_id bigint, url string, html string").repartition(5)).collect()
    want = slow_verdicts(pages)
    assert len(found) == len(rows) + 2
    assert {(r.page_id, r.verdict) for r in found} == set(enumerate(want)) and {"allow", "block"} <= set(want)
