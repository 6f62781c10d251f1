"""Deeply nested records as flat node tables, labelled by intervals.

Every record is read as a tree. A depth-first traversal gives each node its pre-order number and, on the
way back (in post-order), the interval's end: `post` is the largest pre-order number below it. So a node
contains another exactly if its interval [pre, post] encloses the other's; the node tables of each type
are linked by that containment alone (see `link`).

Defined cases: a null record has no nodes; null members are no nodes but keep their index; empty arrays
and objects are nodes without children; text that is no JSON, or a scalar, has no nodes; text that holds
JSON inside a JSON string is read as the inner JSON, however often it is wrapped; NaN and Infinity are
no JSON; documents of any depth are read; a repeated member keeps its last
value; lone surrogates in names become "?"; repeated rows give repeated nodes until the caller keeps one
row per id.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataflow.functions import deep

SCHEMA = "run_id long, tree string, pre int, post int, depth int, kind string, step string, path string, value string"
LINKED = SCHEMA + ", parent_pre int, parent_path string"
#: Characters of paths that are put out at a time.
PATHS = 1 << 24
#: The arrays of each typed element that hold further elements: type -> (member, type of its elements).
PARTS = {"root": ("parts", "part"), "part": ("checks", "check"), "check": ("evidence", "evidence"), "evidence": None}


def _refuse(word: str):
    raise ValueError(word)


def read_json(text: str | None):
    """The JSON value of a text, unwrapped while it is a string that holds JSON; None when there is none."""
    value = text
    while isinstance(value, str):
        try:
            value = deep.loads(value, parse_constant=_refuse)
        except ValueError:
            return None
    return value


def _clean(text: str) -> str:
    try:
        text.encode()
        return text
    except UnicodeEncodeError:
        return text.encode("utf-8", "replace").decode()


def _scalar(value) -> str | None:
    if isinstance(value, (dict, list)):
        return None
    return _clean(value) if isinstance(value, str) else json.dumps(value)


def _json_children(node):
    value = node[0]
    if isinstance(value, dict):
        return [(v, "member", _clean(k)) for k, v in value.items() if v is not None]
    if isinstance(value, list):
        return [(v, "element", str(i)) for i, v in enumerate(value) if v is not None]
    return []


def _part_children(node):
    below = PARTS[node[1]]
    if below is None:
        return []
    member, kind = below
    # The steps of the outer arrays stay in the path: parts/0/checks/1.
    return [(v, kind, f"{member}/{i}") for i, v in enumerate(node[0].get(member) or []) if v is not None]


class Labels:
    """The nodes of some runs in depth-first order, as parallel lists."""

    def __init__(self) -> None:
        self.run: list[int] = []  # which run of the batch
        self.tree: list[int] = []  # 0 parts, 1 answer
        self.pre: list[int] = []
        self.post: list[int] = []
        self.depth: list[int] = []
        self.path: list[str] = []
        self.node: list[tuple] = []


def label(run: int, tree: int, root, children, out: Labels, base: str) -> None:
    """Append the nodes below `root` in depth-first order with their interval labels (root itself is none)."""
    pre, first = 0, len(out.pre)
    pres, posts, depths, paths, nodes = out.pre, out.post, out.depth, out.path, out.node
    stack = [(iter(children(root)), -1, base)]
    while stack:
        rest, at, path = stack[-1]
        for node in rest:
            pre += 1
            below = f"{path}/{node[2]}" if path else node[2]
            pres.append(pre)
            posts.append(pre)
            depths.append(len(stack))
            paths.append(below)
            nodes.append(node)
            inner = children(node)
            if inner:
                stack.append((iter(inner), len(posts) - 1, below))
                break
        else:
            stack.pop()
            if at >= 0:
                posts[at] = pre  # the largest pre-order number below: the interval's end
    out.run += [run] * (len(pres) - first)
    out.tree += [tree] * (len(pres) - first)


def link(run: np.ndarray, tree: np.ndarray, pre: np.ndarray, post: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """For each node the place of its parent, found by interval containment: the last node one level up that begins before it and encloses it; -1 at the top."""
    parent = np.full(len(pre), -1)
    if not len(pre):
        return parent
    key = (run.astype(np.int64) * 2 + tree) * (int(post.max()) + 2) + pre  # run, tree and pre-order number as one sortable number
    ends = key - pre + post
    for level in range(2, int(depth.max()) + 1):
        lower, upper = np.flatnonzero(depth == level), np.flatnonzero(depth == level - 1)
        upper = upper[np.argsort(key[upper], kind="stable")]
        at = np.searchsorted(key[upper], key[lower], side="right") - 1
        found = upper[np.maximum(at, 0)]
        inside = (at >= 0) & (ends[lower] <= ends[found])
        parent[lower[inside]] = found[inside]
    return parent


def _labelled(batches: Iterator[pa.RecordBatch], trees: tuple[str, ...]) -> Iterator[tuple[list, Labels, np.ndarray]]:
    """The ids of a batch's runs, their labelled nodes and the place of each node's parent."""
    for batch in batches:
        ids, out, size = batch.column("run_id").to_pylist(), Labels(), 0
        parts, answers = (batch.column(t).to_pylist() if t in trees else [None] * len(ids) for t in ("parts", "answer"))
        for k, (part, answer) in enumerate(zip(parts, answers)):
            before = len(out.path)
            if part is not None:
                label(k, 0, ({"parts": part}, "root", ""), _part_children, out, "")
            if answer is not None:
                label(k, 1, (read_json(answer), "root", ""), _json_children, out, "answer")
            size += sum(map(len, out.path[before:]))
            if size > PATHS:  # paths of deep documents are long
                yield ids, out, _parents(out)
                out, size = Labels(), 0
        yield ids, out, _parents(out)


def _parents(x: Labels) -> np.ndarray:
    return link(*(np.array(v, np.int64) for v in (x.run, x.tree, x.pre, x.post, x.depth)))


TOP = ("", "answer")


def _nodes(batches: Iterator[pa.RecordBatch], trees: tuple[str, ...] = ("parts", "answer")) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in LINKED.split(", ")]
    types = {"run_id": pa.int64(), "pre": pa.int32(), "post": pa.int32(), "depth": pa.int32(), "parent_pre": pa.int32()}
    for ids, x, parent in _labelled(batches, trees):
        values = [json.dumps({k: v for k, v in n[0].items() if not isinstance(v, list)}) if n[1] in PARTS else _scalar(n[0]) for n in x.node]
        above = parent.tolist()
        columns = [
            [ids[k] for k in x.run], ["answer" if t else "parts" for t in x.tree], x.pre, x.post, x.depth, [n[1] for n in x.node], [n[2] for n in x.node], x.path, values,
            [x.pre[p] if p >= 0 else None for p in above], [x.path[p] if p >= 0 else TOP[t] for p, t in zip(above, x.tree)],
        ]
        yield pa.RecordBatch.from_arrays([pa.array(c, types.get(n, pa.string())) for n, c in zip(names, columns)], names=names)


def node_table(runs: DataFrame, *trees: str) -> DataFrame:
    """All nodes of the runs' `parts` and `answer` (or of the `trees` asked for) with labels, parent and scalar value, one row per node."""
    wanted = trees or ("parts", "answer")
    return runs.select("run_id", *wanted).mapInArrow(lambda batches: _nodes(batches, wanted), LINKED)


def _run_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per run: the paths of its items and of their parents."""
    for ids, x, parent in _labelled(batches, ("parts", "answer")):
        if not x.path:
            continue
        runs, above = np.array(x.run), [x.path[p] if p >= 0 else TOP[t] for p, t in zip(parent.tolist(), x.tree)]
        paths = x.path
        if any("?" in p for p in paths):  # names that differ in lone surrogates only have become one
            once = {(k, p): i for i, (k, p) in reversed(list(enumerate(zip(x.run, paths))))}
            keep = sorted(once.values())
            runs, above, paths = runs[keep], [above[i] for i in keep], [paths[i] for i in keep]
        first = np.flatnonzero(np.r_[True, runs[1:] != runs[:-1]])
        ends = pa.array(np.r_[first, len(runs)], pa.int32())
        lists = [pa.ListArray.from_arrays(ends, pa.array(v, pa.string())) for v in (paths, above)]
        yield pa.RecordBatch.from_arrays([pa.array([ids[k] for k in runs[first].tolist()], pa.int64()), *lists], names=["run_id", "path", "parent_path"])


def items(runs: DataFrame) -> DataFrame:
    """One row per item and its parent's path. Redelivered runs carry the same items: one row per run is kept before the items are unfolded."""
    own = runs.select("run_id", "parts", "answer").mapInArrow(_run_items, "run_id long, path array<string>, parent_path array<string>").dropDuplicates(["run_id"])
    return own.select("run_id", F.inline(F.arrays_zip("path", "parent_path")))


def typed_tables(runs: DataFrame) -> dict[str, DataFrame]:
    """The flat tables part, check, evidence and answer, each with its key (run_id, pre) and its parent's key."""
    head = ["run_id", "pre", "post", "parent_pre", "path"]
    json_of = {
        "part": "name string, weight double, score double, detail string",
        "check": "name string, passed boolean",
        "evidence": "gate string, sample string, count long",
    }
    # One tree each: a table of parts parses no answers. Redelivered runs carry the same nodes.
    nodes = {t: node_table(runs, t).dropDuplicates(["run_id", "pre"]) for t in ("parts", "answer")}
    out = {kind: nodes["parts"].where(F.col("kind") == kind).select(*head, F.from_json("value", shape).alias("v")).select(*head, "v.*") for kind, shape in json_of.items()}
    out["answer"] = nodes["answer"].select(*head, "kind", "step", "value")
    return out
