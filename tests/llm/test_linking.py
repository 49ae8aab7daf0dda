"""Components, SimHash, WARC, URL rules and chat formatting."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from sonara.llm import chat, simhash, urls, warc
from sonara.llm.components import components


def classes(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_equal_union_find(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2000 + i) for i in range(1, 90)] + [(7, 7)]
    df = spark.createDataFrame([*edges, (None, 5), (5, None)], "a bigint, b bigint")
    found = {r.node: r.component for r in components(df, "a", "b").collect()}
    assert found == classes({n for e in edges for n in e}, edges)
    assert components(df.limit(0), "a", "b").count() == 0


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_fingerprint(text, width=3):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="AbÉ \n\t\x1cz", max_size=60))
def test_fingerprint_equals_brute_force(text):
    assert int(simhash.fingerprint(simhash.shingle_hashes(text, 3))[0]) == slow_fingerprint(text)


def test_many_hashes_are_counted_right():
    h = np.random.default_rng(0).integers(0, 2**64, 3000, dtype=np.uint64)
    assert int(simhash.fingerprint(h)[0]) == sum((2 * sum(int(x) >> b & 1 for x in h) > len(h)) << b for b in range(64))


@pytest.mark.parametrize("distance", [1, 2])
@pytest.mark.parametrize("most", [2, 64])
def test_near_fingerprints_connect_all_in_range(spark, monkeypatch, distance, most):
    monkeypatch.setattr(simhash, "PAIRS_MOST", most)
    rng = random.Random(distance)
    prints = {rng.getrandbits(64) for _ in range(150)}
    for p in list(prints)[:60]:
        for _ in range(rng.randrange(4)):
            for b in rng.sample(range(64), rng.randrange(1, 5)):
                p ^= 1 << b
            prints.add(p)
    centre = rng.getrandbits(64)
    prints |= {centre ^ (1 << a) ^ (1 << b) for a, b in itertools.combinations(range(12), 2)} | {0, (1 << 64) - 1, 1 << 63}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = [(r.a, r.b) for r in simhash.near_fingerprints(spark.createDataFrame([(p,) for p in signed], "fingerprint bigint"), distance).collect()]
    near = lambda x, y: bin((x ^ y) & (1 << 64) - 1).count("1") <= distance
    want = [(x, y) for x, y in itertools.combinations(signed, 2) if near(x, y)]
    assert all(near(x, y) for x, y in links)
    assert classes(signed, links) == classes(signed, want)


def test_near_duplicates_of_odd_rows(odd, odd_rows, empty):
    found = simhash.near_duplicates(odd).collect()
    prints = [(r[0], slow_fingerprint(r[1] or "")) for r in odd_rows]
    assert sorted((r.doc_id or 0, r.fingerprint) for r in found) == sorted((i or 0, f"{p:016x}") for i, p in prints)
    groups = classes({p for _, p in prints}, [(a, b) for a, b in itertools.combinations({p for _, p in prints}, 2) if bin(a ^ b).count("1") <= 2])
    least = {}
    for i, p in prints:
        least[groups[p]] = min([x for x in (least.get(groups[p]), i) if x is not None], default=None)
    assert {(r.fingerprint, r.component_id) for r in found} == {(f"{p:016x}", least[groups[p]]) for _, p in prints}
    assert simhash.near_duplicates(empty).count() == 0


def near_copies(rng, vocabulary, words, changes, copies):
    base = [str(rng.choice(vocabulary)) for _ in range(words)]
    out = [" ".join(base)]
    for _ in range(copies):
        other = list(base)
        for at in rng.choice(words, changes, replace=False):
            other[at] = str(rng.choice(vocabulary))
        out.append(" ".join(other))
    return out


@pytest.mark.parametrize("most", [1, 3, 64])
def test_keep_one_finds_near_copies_and_leaves_others(spark, monkeypatch, most):
    monkeypatch.setattr(simhash, "WIDE_PAIRS_MOST", most)
    monkeypatch.setattr(simhash, "PART_ROWS", 4)
    rng = np.random.default_rng(8)
    vocabulary = ["".join(rng.choice(list("abcdefghijklmnop"), 7)) for _ in range(4000)]
    groups = [near_copies(rng, vocabulary, 400, 4, 1) for _ in range(60)] + [near_copies(rng, vocabulary, 400, 3, 20)]
    clean = [" ".join(map(str, rng.choice(vocabulary, 300))) for _ in range(150)]
    rows = [(g, t) for g, texts in enumerate(groups) for t in texts] + [(1000 + i, t) for i, t in enumerate(clean)]
    df = spark.createDataFrame([(i, t, g) for i, (g, t) in enumerate(rows)], "doc_id bigint, text string, g int").repartition(5)
    kept = simhash.keep_one(df).collect()
    by_group = {}
    for r in kept:
        by_group.setdefault(r.g, []).append(r.doc_id)
    assert all(len(by_group[1000 + i]) == 1 for i in range(150))
    caught = sum(len(by_group[g]) == 1 for g in range(61))
    assert caught >= 58 and all(min(i for i, (h, _) in enumerate(rows) if h == g) in by_group[g] for g in range(61))


def near_pair(rng, low, high):
    """Two texts of 400 words whose five-word shingle sets have a similarity from low to high."""
    sets = lambda words: set(zip(*(words[k:] for k in range(5)), strict=False))
    for _ in range(1000):
        a = [f"w{x}" for x in rng.integers(0, 4000, 400)]
        b = list(a)
        for at in rng.choice(400, int(rng.integers(6, 15)), replace=False):
            b[at] = f"w{rng.integers(0, 4000)}"
        x, y = sets(a), sets(b)
        if low <= len(x & y) / len(x | y) < high:
            return [" ".join(a), " ".join(b)]
    raise AssertionError("no such pair")


def test_keep_one_links_all_pairs_of_the_similarity(spark):
    rng = np.random.default_rng(12)
    pairs = [near_pair(rng, 0.8, 0.82) for _ in range(120)]
    df = spark.createDataFrame([(2 * g + k, t) for g, texts in enumerate(pairs) for k, t in enumerate(texts)], "doc_id bigint, text string").repartition(5)
    assert {r.doc_id for r in simhash.keep_one(df).collect()} == set(range(0, 240, 2))


def test_keep_one_leaves_pairs_under_the_similarity(spark):
    rng = np.random.default_rng(14)
    pairs = [near_pair(rng, 0.72, 0.8) for _ in range(120)]
    df = spark.createDataFrame([(2 * g + k, t) for g, texts in enumerate(pairs) for k, t in enumerate(texts)], "doc_id bigint, text string").repartition(5)
    assert {r.doc_id for r in simhash.keep_one(df).collect()} == set(range(240))


def test_keep_one_does_not_depend_on_the_number_of_texts(spark, monkeypatch):
    rng = np.random.default_rng(13)
    pairs = [near_pair(rng, 0.7, 0.86) for _ in range(40)]
    df = spark.createDataFrame([(2 * g + k, t) for g, texts in enumerate(pairs) for k, t in enumerate(texts)], "doc_id bigint, text string")
    few = {r.doc_id for r in simhash.keep_one(df).collect()}
    plan = simhash.wide_plan
    monkeypatch.setattr(simhash, "wide_plan", lambda count, *rest: plan(6_000_000, *rest))
    assert {r.doc_id for r in simhash.keep_one(df).collect()} == few


def edited(rng, base, changes, name):
    out = list(base)
    for k, at in enumerate(rng.choice(len(base) // 5, changes, replace=False)):
        out[5 * at + 2] = f"{name}x{k}"  # edits lie five words apart, so each changes five shingles
    return " ".join(out)


def test_parts_of_a_block_grow_with_its_rows(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PART_ROWS", 16)
    rows = spark.range(400).selectExpr("cast(id % 2 as bigint) as key", "id", "cast(200 as bigint) as n")
    dealt = simhash._in_parts(rows, "id")
    assert dealt.select("id").distinct().count() == 400 and dealt.count() <= 1000


def test_copies_that_nothing_can_reach_are_not_compared(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PART_ROWS", 4)
    compared = []
    way = simhash._near_of_crowded
    monkeypatch.setattr(simhash, "_near_of_crowded", lambda crowded, *rest: (compared.append(crowded.count()), way(crowded, *rest))[1])
    rng = np.random.default_rng(15)
    base = [f"w{x}" for x in range(150)]
    texts = [" ".join(base), *(edited(rng, base, 1, f"a{i}") for i in range(40)), *(edited(rng, base, 5, f"b{i}") for i in range(60))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5)
    assert {r.doc_id for r in simhash.keep_one(df).collect()} == {0, *range(41, 101)}
    assert compared == [0]


@pytest.mark.parametrize(("part", "most"), [(4, 1), (32, 8)])
def test_keep_one_equals_brute_force_on_crowded_shingles(spark, monkeypatch, part, most):
    monkeypatch.setattr(simhash, "PART_ROWS", part)
    monkeypatch.setattr(simhash, "WIDE_PAIRS_MOST", most)
    no_links = lambda shapes, *_: simhash.written(shapes.selectExpr("id as a", "id as b").limit(0), "near")
    monkeypatch.setattr(simhash, "wide_links", no_links)  # so all is left to the shingles
    rng = np.random.default_rng(16)
    texts = set()
    for group, length in enumerate((30, 60, 160)):
        base = [f"g{group}w{x}" for x in range(length)]
        chain = base
        for i in range(50):
            chain = edited(rng, chain if i % 7 else base, int(rng.integers(0, 4)), f"g{group}i{i % 3}").split()
            cut = int(rng.integers(0, length // 6))
            texts.add(" ".join(chain[: length - cut] if i % 2 else chain[cut:]))
    texts = sorted(texts)
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in map(str.split, texts)]
    near = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9]
    want = set(classes(range(len(texts)), near).values())
    assert 10 < len(want) < len(texts) - 10
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5)
    assert {r.doc_id for r in simhash.keep_one(df).collect()} == want


def test_keep_one_of_odd_rows(odd, empty):
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    rows = kept.collect()
    texts = [r.text for r in rows]
    assert len(texts) == len(set(texts)) and sum(1 for r in rows if not (r.text or "").strip()) == 1
    assert [r.doc_id for r in rows if (r.text or "").startswith("one two")] == [1]
    assert simhash.keep_one(empty).count() == 0


PAGES = "page_id bigint, url string, html string, id string, file string, at string, block string, host string"


@pytest.fixture(scope="module")
def pages(spark):
    magic = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Page-ID: 99\r\nContent-Length: 5\r\n\r\nfalse\r\n\r\n"
    long = "<p>é</p>" * 40
    rows = [(5, "http://a.org/x", long), (2, "http://a.org/y", long), (2, "http://a.org/y", long), (9, None, long), (None, "http://n/", long), (1, "u", None), (3, "v\r\nw", ""), (4, "w", "short"), (6, "w", "short")]
    rows += [(10 + i, f"http://h/{i}", f"{i} " + magic * 3 + "x" * i + magic) for i in range(40)]
    rows += [(100, "big", (magic + "y" * 4000) * 60), (101, "tail", "ends in WARC/1.0\r\n"), (102, "sep", "\r\n\r\n" * 30)]
    return [(*r, "x", "x", "x", "x", "x") for r in rows]


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_archives_read_back_in_any_splits(spark, pages, tmp_path, compression):
    path = f"file://{tmp_path}/warc"
    warc.write_warc(spark.createDataFrame(pages, PAGES).coalesce(2), path, compression=compression)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
        spark.conf.set("spark.sql.files.openCostInBytes", "10")
        found = warc.read_warc(spark, path).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    payload = lambda r: (r[2] or "").encode()
    least = {}
    for r in pages:
        if r[0] is not None and len(payload(r)) >= 100:
            least[payload(r)] = min(least.get(payload(r), r[0]), r[0])
    want = []
    for r in pages:
        first = least.get(payload(r))
        refers = first if r[0] is not None and first is not None and first < r[0] else None
        content = b"" if refers is not None else payload(r)
        want.append((r[0], "response" if refers is None else "revisit", refers, hashlib.sha256(payload(r)).hexdigest(), len(payload(r)), len(content), hashlib.sha256(content).hexdigest()))
    key = lambda x: [(v is not None, v or 0) if not isinstance(v, str) else (True, v) for v in x]
    got = [(r.page_id, r.record_type, r.refers_to, r.payload_digest, r.payload_bytes, r.content_bytes, r.content_sha256) for r in found]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert not any(r.page_id == 99 for r in found)


def test_archive_digest_and_empty_table(spark, pages):
    df = spark.createDataFrame(pages, PAGES)
    found = warc.archive_digest(df).collect()
    assert len(found) == len(pages)
    assert all(r.payload_digest for r in found) and {r.record_type for r in found} == {"response", "revisit"}
    assert warc.archive_digest(df.limit(0)).count() == 0


def slow_rule(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


URLS = ["http://example.org/es/1", "https://a.EXAMPLE.org/en/12?x#y", "http://example.org/en/2", "http://org", "http://x.org?a=/es/", "http://b.com/de/x", "http://com/fr/", "no scheme", None, "", "a://b://c/d", "http://notexample.org/es/", "HTTP://Ünï.com/de/", "http://net/x", "http://x.com:80/de/"]


def test_rules_equal_brute_force(spark):
    df = spark.createDataFrame([(i, u, "<html>", "x", "x", "x", "x", "x") for i, u in enumerate(URLS)], PAGES)
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(df).collect()}
    for i, u in enumerate(URLS):
        host, path, rule, verdict = slow_rule(u)
        assert found[i] == (host, path, rule, verdict or "allow"), u
    assert urls.judge_urls(df.limit(0)).count() == 0


def test_decisions_reach_aliases(spark):
    link = '<link rel="canonical" href="{}">'
    refresh = "<META http-equiv='refresh' content='0; URL=http://c.net/3'>"
    rows = [
        (1, "http://a.net/1", link.format("http://b.com/de/1")),
        (2, "http://b.net/2", refresh),
        (3, "http://c.net/3", link.format("http://x.com/de/9")),
        (4, "http://d.net/4", link.format("http://a.net/1")),
        (5, "http://e.net/5", link.format("/6")),
        (6, "http://e.net/6", link.format("http://y.org/ok")),
        (7, "http://z.net/7", "<p>canonical</p>"),
        (8, "http://y.org/ok", link.format("http://b.com/de/77")),
        (9, "http://b.com/de/77", ""),
        (10, "http://log.net/", ""),
        (11, None, link.format("http://b.com/de/1")),
    ]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    log = spark.createDataFrame([("http://log.net", "http://q.com/de/1"), (None, "http://q.com/de/2")], "from_url string, to_url string")
    found = {r.page_id: (r.rule, r.verdict) for r in urls.judge_urls(df, redirects=log).collect()}
    assert [found[i][1] for i in (1, 2, 3, 4, 10)] == ["block"] * 5
    assert found[5] == (None, "allow") and found[6] == (None, "allow") and found[8] == ("org/", "allow") and found[9] == ("com/de/", "block")
    assert found[7] == (None, "allow") and found[11] == (None, "allow")


def test_all_links_of_a_page_count(spark):
    blocked = "http://b.com/de/1"
    rows = [
        (1, "http://a.net/d/1", '<link rel="canonical" href="http://q.net/x"><link rel=canonical href="http://b.com/de/1">'),
        (2, "http://a.net/d/2", '<link rel="canonical" href="1">'),
        (3, "http://a.net/d/e/3", "<link href='../1' rel='canonical'>"),
        (4, "http://a.net/d/4", """<meta http-equiv="refresh" content="0; url='http://b.com/de/1'">"""),
        (5, "http://a.net/d/5", "<meta http-equiv=refresh content=0;url=http://b.com/de/1>"),
        (6, "http://a.net/d/6?id=1", f'<link rel="canonical" href="{blocked}">'),
        (7, "http://a.net/d/6?id=2", ""),
        (8, "http://a.net/d/6", '<link rel="canonical" href="?id=1">'),
        (9, "http://a.net/d/9", '<meta http-equiv="refresh" content="5"><meta http-equiv="refresh" content="0;url=6?id=1">'),
        (11, "http://a.net/d/11", '<link rel="canonical" href="/k?a=1&amp;b=2">'),
        (12, "http://a.net/k?a=1&b=2", f'<link rel="canonical" href="{blocked}">'),
        (10, "http://a.net/d/10?u=/de/", '<link rel="canonical" href="http://c.net/?v=/de/">'),
    ]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    found = {r.page_id: r.verdict for r in urls.judge_urls(df).collect()}
    assert found == {i: "allow" if i in (7, 10) else "block" for i in range(1, 13)}


ROLES = st.one_of(st.sampled_from(["user", "assistant", "system", "tool", "", None]), st.text(max_size=4))
SAID = st.lists(st.sampled_from([*chat.CONTROLS, " ", "[/INST]", "\n<</SYS>>\n", chat.ESCAPE, "ok", "[/INS", "] ", " </s", "é"]), max_size=8).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(ROLES, SAID), max_size=5))
def test_any_turns_come_back(turns):
    text = "".join(chat.render_turn(r, t)[0] for r, t in turns)
    assert [(r, t) for r, t, _, _ in chat.parse(text)] == turns


def test_plain_text_is_not_escaped():
    assert chat.render_turn("user", "hello [INST") == ("<s>[INST] hello [INST [/INST]", 0)
    rendered, level = chat.render_turn("user", "a [/INST] b")
    assert level == 1 and chat.ESCAPE in rendered


def test_chat_digest(spark):
    rows = [(1, 1, "assistant", "yes </s> no"), (1, 0, "user", None), (2, 0, None, "x"), (2, 1, "tool", ""), (None, 0, "user", "lost"), (1, 1, "assistant", "yes </s> no"), (3, 0, "assistant", "long " * 30000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, rendered string")
    found = {r.conv_id: r for r in chat.chat_digest(chat.with_probe(df)).collect()}
    said = "</s>[INST] ok [/INST]"
    want = {-1: [("user", said), ("assistant", said)], 1: [("user", ""), ("assistant", "yes </s> no"), ("assistant", "yes </s> no")], 2: [("", "x"), ("tool", "")], None: [("user", "lost")], 3: [("assistant", "long " * 30000)]}
    assert set(found) == set(want)
    for conv, turns in want.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        r = found[conv]
        assert r.n_turns == len(turns) and r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r.loss_chars == len(loss) and r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest() and r.formatted_chars > 0
    assert chat.chat_digest(df.limit(0)).count() == 0


def test_shingle_levels_count_all_texts(spark):
    from collections import Counter

    rng = random.Random(9)
    texts = [" ".join(rng.choice("abcdef") for _ in range(rng.randrange(0, 30))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string").repartition(5)
    counts = Counter(h for t in texts for h in simhash.shingle_set(t, 3).tolist())
    want = np.zeros(1 << simhash.SLOT_BITS, dtype=np.uint8)
    for h, n in counts.items():
        if n > simhash.RARE:
            want[h >> (64 - simhash.SLOT_BITS)] = max(want[h >> (64 - simhash.SLOT_BITS)], int(2 * np.log2(n)))
    for count in (2, 300, 1 << 20):
        assert (simhash.shingle_levels(df, count, 3) == want).all()
    assert not simhash.shingle_levels(df.limit(0), 0, 3).any()
