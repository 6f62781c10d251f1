from __future__ import annotations

import json

from hypothesis import given, settings
from hypothesis import strategies as st

from strataflow.functions import deep
from strataflow.operators import nested as N

PARTS = "array<struct<name: string, weight: double, score: double, detail: string, checks: array<struct<name: string, passed: boolean, evidence: array<struct<gate: string, sample: string, count: long>>>>>>"
SCHEMA = f"run_id long, parts {PARTS}, answer string"


def slow(value, path):
    pairs = value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ()
    for k, v in pairs:
        if v is not None:
            yield f"{path}/{k}", path
            yield from slow(v, f"{path}/{k}")


def test_items(spark):
    parts = [("a", 1.0, 1.0, None, [("c", True, [("g", None, 1), None]), None, ("d", None, None)]), None, ("b", None, None, None, None)]
    answers = {
        1: '{"a": [1, null, {"b": null, "c": []}], "d": {}}', 2: '"[1, [2]]"', 3: '"\\"{\\\\\\"x\\\\\\": 1}\\""', 4: "7", 5: "{'a': 1}", 6: None, 7: "", 8: '"text"', 9: "[NaN]",
        10: "[" * 100_000, 11: '{"\\ud800": 1}',
    }
    rows = [(k, parts if k == 1 else [] if k == 2 else None, v) for k, v in answers.items()]
    got = {(r.run_id, r.path, r.parent_path) for r in N.items(spark.createDataFrame(rows + rows[:1], SCHEMA)).collect()}
    assert got == {
        (1, "parts/0", ""), (1, "parts/0/checks/0", "parts/0"), (1, "parts/0/checks/0/evidence/0", "parts/0/checks/0"), (1, "parts/0/checks/2", "parts/0"), (1, "parts/2", ""),
        (1, "answer/a", "answer"), (1, "answer/a/0", "answer/a"), (1, "answer/a/2", "answer/a"), (1, "answer/a/2/c", "answer/a/2"), (1, "answer/d", "answer"),
        (2, "answer/0", "answer"), (2, "answer/1", "answer"), (2, "answer/1/0", "answer/1"), (3, "answer/x", "answer"), (11, "answer/?", "answer"),
    }


def test_typed_tables_link_by_key(spark):
    rows = [(1, [("a", 1.0, 0.5, "t", [("c", True, [("g", "s", 3)])])], "[1]")]
    tables = N.typed_tables(spark.createDataFrame(rows, SCHEMA))
    part, check, evidence = (tables[k].collect()[0] for k in ("part", "check", "evidence"))
    assert check.parent_pre == part.pre and evidence.parent_pre == check.pre and part.parent_pre is None
    assert part.pre < check.pre < evidence.pre <= check.post <= part.post
    assert (part.name, part.weight, check.passed, evidence["count"]) == ("a", 1.0, True, 3)
    assert tables["answer"].collect()[0].value == "1"


def test_empty_and_nulls(spark):
    assert N.items(spark.createDataFrame([], SCHEMA)).count() == 0
    assert N.items(spark.createDataFrame([(None, None, None)], SCHEMA)).count() == 0


JSON = st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=3), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(alphabet="abc", min_size=1, max_size=2), x, max_size=4), max_leaves=25)


@settings(max_examples=200, deadline=None)
@given(st.lists(JSON, max_size=4))
def test_containment_against_recursion(values):
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"run_id": pa.array(range(len(values)), pa.int64()), "parts": pa.array([None] * len(values)), "answer": pa.array([json.dumps(v) for v in values], pa.string())})
    (out,) = N._nodes(iter([batch]))
    got = list(zip(out.column("run_id").to_pylist(), out.column("path").to_pylist(), out.column("parent_path").to_pylist()))
    want = [(k, *pair) for k, v in enumerate(values) if not isinstance(v, str) for pair in slow(v, "answer")]
    assert [g for g in got if not isinstance(values[g[0]], str)] == want


def test_documents_of_any_depth(spark):
    """Deeper than the standard reader goes: every level is an item; what is broken far inside is no JSON."""
    rows = [(1, None, "[" * 12_000 + "7" + "]" * 12_000), (2, None, '{"a":' * 3000 + "[]" + "}" * 3000), (3, None, "[" * 12_000 + "7" + "]" * 11_999), (4, None, "[" * 12_000 + "NaN" + "]" * 12_000)]
    got = N.node_table(spark.createDataFrame(rows, SCHEMA)).groupBy("run_id").agg({"depth": "max", "pre": "count"}).collect()
    assert {(r.run_id, r["max(depth)"], r["count(pre)"]) for r in got} == {(1, 12_000, 12_000), (2, 3000, 3000)}


@settings(max_examples=300, deadline=None)
@given(JSON, st.integers(0, 1), st.text(alphabet='[]{},:"1e.-tn ', max_size=12))
def test_reader_and_writer_with_an_own_stack(value, keys, text):
    """The same values and texts as the standard ones, and the same refusals."""
    assert deep._loads(json.dumps(value, indent=keys or None), float) == value
    try:
        want = json.loads(text)
    except ValueError:
        want = ValueError
    try:
        got = deep._loads(text, float)
    except ValueError:
        got = ValueError
    assert got == want


def test_writer_of_any_depth():
    value: list | dict = []
    for k in range(20_000):
        value = [1, value] if k % 2 else {"b": value, "a": None}
    assert deep.dumps(deep.loads(deep.dumps(value))) == deep.dumps(value)
    assert deep.dumps(value, sort_keys=True).startswith('[1, {"a": null, "b": [1, ')
