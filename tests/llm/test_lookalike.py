from __future__ import annotations

import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strataflow.llm import lookalike as L


@pytest.fixture(scope="module")
def form(spark):
    return L.transducer(L.letters(spark))


SAME = [("ｶﾞ", "ガ"), ("한글", unicodedata.normalize("NFD", "한글")), ("é", "é"), ("é", "e​́"), ("ó", "о́"), ("fi", "ﬁ"), ("A", "Α"), ("A", "А"), ("K", "K"), ("a b", "a b"), ("a b", "a　b"), ("a-b", "a‑b"), (";", ";"), ("µ", "μ"), ("IV", "Ⅳ"), ("ab", "a­b"), ("１２", "12")]
APART = [("x2", "x²"), ("A", "a"), ("e", "é"), ("–", "-"), ("“", '"'), ("1/2", "½"), ("a\tb", "a b"), ("ﬁ", "f i"), ("и", "n"), ("…", "."), ("o", "0"), ("①", "1")]


@pytest.mark.parametrize("a,b", SAME)
def test_same(form, a, b):
    assert form(a) == form(b)


@pytest.mark.parametrize("a,b", APART)
def test_apart(form, a, b):
    assert form(a) != form(b)


@settings(max_examples=400, deadline=None)
@given(text=st.text(max_size=30) | st.text(alphabet="aа é​ｆﬁéの゙", max_size=20))
def test_form_is_a_fixed_point_and_ignores_composition(form, text):
    once = form(text)
    assert form(once) == once
    assert form(unicodedata.normalize("NFD", text)) == once == form(unicodedata.normalize("NFC", text))


def test_conflicts_are_refused():
    with pytest.raises(ValueError):
        L.compile_entries({"a": "b", "b": "a"})


def test_pairs_against_all_pairs(spark, form):
    texts = ["one fi", "one ﬁ", "one fi", "оne fi", None, "", "", "​", "two", "two", "One fi", "t​wo", "x" * 500_000 + "é", "x" * 500_000 + "é"]
    rows = [(k, t, "r") for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows + rows[:3] + [(None, None, None)], "doc_id long, text string, look string")
    want = {(a, b) for a, x in enumerate(texts) for b, y in enumerate(texts) if a < b and x and y and x != y and form(x) == form(y)}
    assert {tuple(r) for r in L.equal_looks(df).collect()} == want and want
    assert L.equal_looks(df.limit(0)).count() == 0
    assert {r.doc_id: r.form for r in L.consistent(df.dropDuplicates(["doc_id"])).collect()}[4] is None


def test_public_letters(form):
    """Letters of the public confusables table, with their accents; those of the other case are no targets."""
    for a, b in [("α", "a"), ("ρ", "p"), ("Ꭺ", "A"), ("ꓮ", "A"), ("Ѵ", "V"), ("ά", "á"), ("ό", "ó"), ("І", "I"), ("Ӏ", "I"), ("ё", "ë")]:
        assert form(a) == form(b), (a, b)
    for a, b in [("І", "l"), ("ı", "i"), ("𝐚", "a"), ("ℓ", "l")]:
        assert form(a) != form(b), (a, b)


def test_joiners_that_show_stay(form):
    for a, b in [("می‌خواهم", "میخواهم"), ("👩‍💻", "👩💻"), ("क्‍ष", "क्ष")]:
        assert form(a) == a != form(b)
    assert form("می‌‌خواهم") == form("می​‌خواهم") == "می‌خواهم"
    for a in ("co‌op", "co‍op", " ‌co‍op‌"):
        assert form(a).strip() == "coop"


def test_compiled_clusters_agree_with_composition(form):
    """Rewriting by the compiled tables equals decomposing, replacing and composing, for every composed letter and look-alike base."""
    for whole, want in list(form.whole.items())[::7]:
        assert form(whole) == form(unicodedata.normalize("NFC", whole)) == want == unicodedata.normalize("NFC", want)


def test_classes_against_all_pairs(spark, form):
    """A row per document with its class, variant and number of links; copies are not expanded."""
    texts = ["one fi", "one ﬁ", "one fi", "оne fi", None, "", "two", "two", "t​wo", "three", "three"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(0, "one fi"), (None, "two")], "doc_id long, text string")
    same = lambda a, b: a and b and form(a) == form(b)
    want = set()
    for k, t in enumerate(texts):
        links = [j for j, u in enumerate(texts) if same(t, u) and u != t]
        if links:
            group = [j for j, u in enumerate(texts) if same(t, u)]
            want.add((k, min(group), min(j for j in group if texts[j] == t), len(links)))
    assert {tuple(r) for r in L.classes(df).collect()} == want and want
    assert L.classes(df.limit(0)).count() == 0
