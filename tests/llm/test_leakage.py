from __future__ import annotations

import os
import random

import pytest
from tests.oracle import compare, connect

from strataflow.llm import leakage as L
from strataflow.llm.queries import ORACLE, QUERIES

FOLDER = "/root/testdata/sf0.001"


def slow(docs, items):
    out = set()
    for i, p in items:
        w = L.words_of(p or "")
        keys = {tuple(w[k : k + 12]) for k in range(len(w) - 11)}
        for d, t in docs:
            v = L.words_of(t or "")
            if any(tuple(v[k : k + 12]) in keys for k in range(len(v) - 11)):
                out.add((d, i))
    return out


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, passage string")


PASSAGE = "How long will it take Croewick to carry 666 crates past the landlocked harbour in July"
OTHER = "How long will it take Wexford to carry 17 crates past the landlocked harbour in March"


def test_marks_case_and_parts(spark):
    docs = [
        (1, "x " + PASSAGE + " y"), (2, PASSAGE.upper()), (3, "'''How''' [[long|will]]\n* it | take <br /> Croewick, to carry <i>666</i> crates past the land"), (4, " ".join(PASSAGE.split()[:11]) + " nothing"),
        (5, " ".join(PASSAGE.split()[4:])), (6, PASSAGE.replace("666", "667")), (7, None), (8, ""), (9, "w " * 50_000 + PASSAGE), (1, "x " + PASSAGE + " y"),
    ]
    items = [(10, PASSAGE), (11, None), (12, "too short"), (13, OTHER), (10, PASSAGE)]
    got = {tuple(r) for r in L.leaked(*frames(spark, docs, items)).collect()}
    assert got == slow(docs, items) and {(1, 10), (2, 10), (3, 10), (5, 10), (9, 10)} <= got and not any(d in (4, 6, 7, 8) for d, _ in got)


def test_reparameterised(spark):
    items = [(10, PASSAGE), (13, OTHER)]
    docs = [(1, PASSAGE.replace("Croewick", "Lonwick").replace("666", "12")), (2, PASSAGE), (3, "nothing like it at all"), (4, None)]
    got = {(r.doc_id, r.item_id) for r in L.reparameterised(*frames(spark, docs, items)).collect()}
    assert got == {(1, 10)}


def test_every_item_and_every_copy(spark, monkeypatch):
    """All items of a template are reported, each copy is checked by itself, and the blocks of items change nothing."""
    copies = [PASSAGE.replace("Croewick", a).replace("666", b) for a, b in (("Lonwick", "12"), ("Farwick", "99"))]
    items = [(10, PASSAGE), (13, OTHER), (14, OTHER.replace("Wexford", "Oxley"))]
    docs = [(1, copies[0]), (2, " nothing much ".join(copies)), (3, copies[0] + " nothing much " + PASSAGE), (4, "nothing like it")]
    want = {(d, i) for d in (1, 2, 3) for i in (10, 13, 14)}
    for block in (L.BLOCK, 1):
        monkeypatch.setattr(L, "BLOCK", block)
        got = [(r.doc_id, r.item_id) for r in L.reparameterised_pairs(*frames(spark, docs, items)).collect()]
        assert set(got) == want and len(got) == len(want)


PROSE = "It follows that if a < b then every sample of the first run and c > d holds for all samples of the last one"


def test_prose_between_comparison_signs_stays(spark):
    """Only what is written like a tag is one; words between signs are words."""
    assert L.words_of("if a < b then c > d <br /> <i>x</i> <ref name=\"q r\"/> <!-- no --> a<b>c 1<2>3") == "if a b then c d x a c 1 2 3".split()
    docs = [(1, "so " + PROSE), (2, PROSE.replace("every sample", "each <b>sample</b>")), (3, " ".join(PROSE.split()[3:16]))]
    items = [(10, PROSE)]
    assert {tuple(r) for r in L.leaked(*frames(spark, docs, items)).collect()} == slow(docs, items) == {(1, 10), (3, 10)} | slow(docs[1:2], items)


def test_types(spark):
    """Names by their use in the items, words that no item has by their own writing."""
    codes = L._Codes({"mill": 1})
    assert [codes[w] for w in ("mill", "Mill", "Oxley", "17", "km", "grain", "検体")] == [1, 1, -L.NAME, L.NUMBER, -L.UNIT, -L.OTHER, -L.NAME]
    (templates, windows), *more = L._blocks(frames(spark, [], [(1, PASSAGE), (2, OTHER), (3, "The mill of the town may be the mill where May came in May")])[1])
    kind = {w: min(int(templates.symbol[k]), L.OTHER) for w, k in templates.own.items()}
    assert not more and {w for w, k in kind.items() if k == L.NAME} == {"croewick", "wexford", "july", "march"}
    assert kind["666"] == L.NUMBER and kind["crates"] == kind["how"] == kind["may"] == L.OTHER


def test_lower_case_words_are_no_names(spark):
    docs = [(1, PASSAGE.replace("Croewick", "somebody")), (2, PASSAGE.replace("Croewick", "Lonwick"))]
    assert [tuple(r)[:2] for r in L.reparameterised_pairs(*frames(spark, docs, [(10, PASSAGE), (13, OTHER)])).collect() if r.item_id == 10] == [(2, 10)]


def test_long_passages_are_cut_with_overlap(spark, monkeypatch):
    """A passage beyond the bound of a piece loses no window."""
    monkeypatch.setattr(L, "PIECE", 20)
    monkeypatch.setattr(L, "BLOCK", 3)
    rng = random.Random(5)
    words = [f"w{rng.randint(1, 60)}" for _ in range(300)]
    items = [(1, " ".join(words)), (2, " ".join(words[:11]))]
    docs = [(k, "zz " + " ".join(words[k : k + 12]) + " zz") for k in range(289)]
    assert {tuple(r) for r in L.leaked(*frames(spark, docs, items)).collect()} == slow(docs, items) == {(k, 1) for k in range(289)}


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_recall_of_planted_questions(spark):
    """Items of the tables with other names and numbers, hidden in documents: recall, and verbatim copies are not reported."""
    items = [(r.item_id, r.passage) for r in spark.read.parquet(f"{FOLDER}/eval_items.parquet").collect() if r.passage]
    rng, docs, truth = random.Random(11), [], set()
    for k, (item, passage) in enumerate(items):
        swap: dict[str, str] = {}

        def other(m):
            w = m[0]
            if w.isdigit():
                return swap.setdefault(w, str(rng.randint(1000, 9999)))
            return swap.setdefault(w, f"Zz{rng.randint(10**6, 10**7)}")

        first, _, rest = passage.partition(" ")
        changed = first + " " + L.re.sub(r"\d+|(?<=[^.] )[A-ZÀ-Þ]\w+", other, rest)
        if len(L.words_of(passage)) >= 12 and len(swap) >= 2:
            truth.add((k, item))
            docs.append((k, "Before it. " + changed + " And after it."))
        docs.append((10_000 + k, passage))
    got = {(r.doc_id, r.item_id) for r in L.reparameterised_pairs(*frames(spark, docs, items)).collect()}
    assert len(truth) > 100 and len(got & truth) >= 0.9 * len(truth)
    assert not {(d, i) for d, i in got if d >= 10_000 and items[d - 10_000][0] == i and len(set(items[d - 10_000][1].split(". "))) == 1}


def test_empty_tables(spark):
    docs, items = frames(spark, [(1, PASSAGE)], [(10, PASSAGE)])
    assert L.leaked(docs.limit(0), items).count() == 0
    assert L.leaked(docs, items.limit(0)).count() == 0
    assert L.reparameterised(docs, items.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_random_words_against_all_windows(spark, seed, monkeypatch):
    monkeypatch.setattr(L, "BLOCK", 4)  # several blocks
    rng = random.Random(seed)
    words = ["the", "mill", "of", "7", "12", "km", "Ada", "Bob", "and", "ran"]
    items = [(k, " ".join(rng.choices(words, k=rng.randint(8, 30)))) for k in range(10)]
    docs = []
    for k in range(40):
        w = rng.choices(words, k=20)
        if rng.random() < 0.6:
            p = rng.choice(items)[1].split()
            a = rng.randrange(len(p))
            w[5:5] = p[a : a + rng.randint(9, 15)]
        docs.append((k, " ".join(w)))
    assert {tuple(r) for r in L.leaked(*frames(spark, docs, items)).collect()} == slow(docs, items)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, name):
    assert compare(QUERIES[name](spark, FOLDER), connect(FOLDER), ORACLE[name]) is None


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() >= 0
