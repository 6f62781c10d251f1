from __future__ import annotations

import datetime as dt
import itertools
import json
import random

import pandas as pd
import pytest

from strataflow.operators import drift as P

SCHEMA = "file_id long, series string, file_date timestamp, content string"
DAY = dt.datetime(2020, 1, 1)


def files(*runs, series="s"):
    return [(k + 1, series, DAY + dt.timedelta(days=k), json.dumps({"runs": r}) if not isinstance(r, (str, type(None))) else r) for k, r in enumerate(runs)]


def found(spark, rows):
    return {tuple(r) for r in P.changes(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_kinds_of_change(spark):
    rows = files([{"a": 1, "b": "x", "c": []}], [{"a": 1, "bb": "x", "c": None}], [{"a": "1", "bb": "y", "c": [1]}, {"new": 1, "a": "2"}], [{"a": "1", "c": [2, None], "new": 1}], [{"a": "1", "b": 1, "c": ["z"], "new": 2}])
    assert found(spark, rows) == {(2, "renamed", "bb", "b"), (3, "retyped", "a", "a"), (3, "added", "new", "new"), (4, "removed", "bb", "bb"), (5, "added", "b", "b"), (5, "retyped", "c", "c")}


def test_type_is_kept_through_renaming_and_nulls_but_not_removal(spark):
    rows = files([{"a": 1, "b": 1}], [{"a": 1, "x": None}], [{"a": 1, "y": "t"}], [{"a": 1}], [{"a": 1, "y": 5}])
    assert found(spark, rows) == {(2, "renamed", "x", "b"), (3, "renamed", "y", "x"), (3, "retyped", "y", "y"), (4, "removed", "y", "y"), (5, "added", "y", "y")}


def test_defined_cases(spark):
    rows = files([{"a": 1}], None, "no json", "[1]", [{"a": 1}, None, 3], [], [{"b": 1}])
    rows += [(90, None, DAY, json.dumps({"runs": [{"z": 1}]})), (91, "s", None, json.dumps({"runs": [{"z": 1}]})), rows[0]]
    assert found(spark, rows) == {(6, "removed", "a", "a"), (7, "added", "b", "b")}
    assert {r.file_id for r in P.unreadable(spark.createDataFrame(rows, SCHEMA)).collect()} == {2, 3, 4, 90, 91}
    assert found(spark, []) == set()


def test_values_of_any_depth(spark):
    """A field nested deeper than the standard reader goes has a type like any other."""
    nest = lambda n, x: "[" * n + x + "]" * n
    content = lambda a: '{"runs": [{"a": ' + a + ', "b": 1}]}'
    rows = files(content(nest(1500, "1")), content(nest(1500, "1")), content(nest(12_000, "1")), content(nest(12_000, "")), content('{"x":' * 5000 + "1" + "}" * 5000))
    assert found(spark, rows) == {(3, "retyped", "a", "a"), (5, "retyped", "a", "a")}
    assert P.unified(spark.createDataFrame(rows, SCHEMA)).where("field = 'a'").count() == 5


def test_unified_table_uses_first_names(spark):
    rows = files([{"a": 1, "b": "x"}], [{"a": 2, "c": "y"}], [{"a": [3], "d": "z"}])
    got = {(r.file_id, r.record, r.field, r.source_field, r.type, r.value) for r in P.unified(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(1, 0, "a", "a", "number", "1"), (1, 0, "b", "b", "string", "x"), (2, 0, "a", "a", "number", "2"), (2, 0, "b", "c", "string", "y"), (3, 0, "a", "a", "array<number>", "[3]"), (3, 0, "b", "d", "string", "z")}


@pytest.mark.parametrize("seed", range(6))
def test_matching_is_cheapest(seed):
    rng = random.Random(seed)
    n, m = rng.randint(1, 5), rng.randint(1, 5)
    costs = [[rng.random() for _ in range(m)] for _ in range(n)]
    got = P.matching(costs)
    best = min(sum(costs[i][j] for i, j in zip(range(n), p)) for p in itertools.permutations(range(m), n)) if n <= m else min(sum(costs[i][j] for j, i in zip(range(m), p)) for p in itertools.permutations(range(n), m))
    assert len(got) == min(n, m) and abs(sum(costs[i][j] for i, j in got) - best) < 1e-12
    assert P.matching([]) == [] and P.matching([[]]) == []


def test_two_changes_in_one_place_follow_similarity():
    old = [["a", "number", 0.0, [1]], ["tool_count", "number", 0.0, [5, 6]], ["z", "number", 0.0, [9]]]
    new = [["a", "number", 0.0, [1]], ["fresh", "string", 0.0, [70]], ["toolCount", "number", 0.0, [5, 7]], ["z", "number", 0.0, [9]]]
    assert P.compare(old, new) == ([("tool_count", "toolCount")], ["fresh"], [])


@pytest.mark.parametrize("seed", range(4))
def test_chunks_compose_to_one_walk(seed, monkeypatch):
    monkeypatch.setattr(P, "CHUNK", 3)
    rng = random.Random(seed)
    names = ["a", "b", "c", "d", "e"]
    content = []
    for _ in range(23):
        keep = [n if rng.random() < 0.85 else n + "x" for n in names if rng.random() < 0.9]
        content.append([{n: rng.choice([1, "t", None, [], [1], True]) for n in keep}])
    profiles = [json.dumps(P.profile(json.dumps({"runs": r}))) for r in content]

    def walk(size):
        monkeypatch.setattr(P, "CHUNK", size)
        parts = []
        for c in range((len(profiles) - 1) // size + 1):
            rows = [(k, k, profiles[k]) for k in range(max(0, c * size - 1), min(len(profiles), (c + 1) * size))]
            parts.append(pd.DataFrame(P._chunk("s", c, rows), columns=[x.split()[0] for x in P.EVENTS.split(", ")]))
        every = pd.concat(parts)
        carried = P._carry(("s",), every[every.kind.isin(["first", "end"])])
        return {(int(r.file_id), r.change, r.field, r.previous_field) for f in (every, carried) for r in f[f.kind == "event"].itertuples()}

    assert walk(3) == walk(1000) == walk(7)
