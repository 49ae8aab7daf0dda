import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sonara.llm import fim

SENTINELS = (fim.PREFIX, fim.SUFFIX, fim.MIDDLE)


def plain(doc_id, text):
    """The contract, written out with a regular expression and strings."""
    digest = hashlib.sha256(f"7:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    if not text or any(s in text for s in SENTINELS):
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 50:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@settings(max_examples=200, deadline=None)
@given(st.integers(-5, 10**12), st.text(alphabet=st.one_of(st.sampled_from("\n\n\r ab<P>SM"), st.characters(exclude_categories=["Cs"])), max_size=80))
def test_rearranged_equals_the_contract(doc_id, text):
    assert fim.rearranged(text, fim.draws(7, doc_id), SENTINELS, "lines", 100, 50) == plain(doc_id, text)


@pytest.mark.parametrize(("text", "ends"), [("", []), ("a", [1]), ("\n\n", [1, 2]), ("a\nb", [2, 3]), ("a\n", [2]), ("👍\n日", [2, 3])])
def test_lines(text, ends):
    assert fim.unit_ends(fim.code_points(text)).tolist() == ends


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab \n\té日", max_size=40))
def test_words_are_cut_before_white_space(text):
    found = [0, *fim.unit_ends(fim.code_points(text), "words").tolist()]
    assert [text[a:b] for a, b in zip(found, found[1:], strict=False)] == re.findall(r"[ \n\t]*[^ \n\t]+|[ \n\t]+$", text)


def test_sentinels_that_overlap_are_refused(odd):
    for bad in (("<P>", "<S>", "><"), ("", "<S>", "<M>"), ("<P>", "x<P>y", "<M>"), ("aba", "<S>", "<M>")):
        with pytest.raises(ValueError, match="taken for each other"):
            fim.fill_in_middle(odd, sentinels=bad)
    with pytest.raises(ValueError, match="no such unit"):
        fim.unit_ends(fim.code_points("a"), "verses")


def test_odd_rows_and_the_way_back(spark, odd, odd_rows):
    more = [(20, "a<S>b\nc", *odd_rows[0][2:]), (21, "<\n>\n<P\n>M>\n<S", *odd_rows[0][2:]), (22, "\n" * 5000, *odd_rows[0][2:])]
    rows = [*odd_rows, *more]
    df = odd.union(spark.createDataFrame(more, odd.schema))
    made = fim.fim_restore(fim.fill_in_middle(df))
    found = [(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in made.collect()]
    assert sorted(map(str, found)) == sorted(str((r[0], *plain(r[0], r[1] or ""))) for r in rows)
    assert sorted(r.restored for r in made.collect()) == sorted(r[1] or "" for r in rows)
    digest = {(r.doc_id, r.output_sha256, r.restored_sha256) for r in fim.fim_digest(df).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert digest == {(r[0], sha(plain(r[0], r[1] or "")[4]), sha(r[1] or "")) for r in rows}


def test_other_sentinels_rates_and_units(odd, odd_rows):
    own = ("[[p]]", "[[s]]", "[[m]]")
    made = fim.fim_restore(fim.fill_in_middle(odd, sentinels=own, unit="words", rate=60, spm=0, seed=3), own).collect()
    assert sorted(r.restored for r in made) == sorted(r[1] or "" for r in odd_rows)
    assert {r.form for r in made} <= {"psm", "plain"}


def test_empty_table(empty):
    assert fim.fim_digest(empty).count() == 0
