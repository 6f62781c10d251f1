"""Files of one series whose record fields drift: report every change, read everything into one table.

Each file is profiled by itself: the order of its record fields, their types and a sketch of their values
(the smallest hashes of the distinct values, and the share of nulls). Successive files of a series are
compared by solving a bipartite matching between the fields that vanish and those that appear; a pair is
eligible where both stand in the same place among the fields that stay, and its cost weighs name
similarity, types, value sketches and order. Matched pairs are renames, the rest is added or removed.

A series may hold any share of the files. Files are numbered within a series by day, so that no window
holds a whole series, and compared in chunks of CHUNK files that overlap by one. What a chunk needs from
before it, the last known type and the first name of each field, is composed afterwards from one short
summary per chunk.

Defined cases: files without a series or date, and contents that are no JSON object with an array `runs`,
are left out of the comparison (`unreadable` lists them); records that are no objects and nulls have no
fields; an empty array of records has no fields; several types in one file make one joined type; equal
dates are ordered by id; redelivered files count once; an empty table gives an empty result.
"""

from __future__ import annotations

import difflib
import functools
import json
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataflow.common import cut
from strataflow.functions import deep

#: Files compared by one task at a time.
CHUNK = 1024
#: Hashes kept of a field's distinct values.
SKETCH = 16
#: Weights of the matching's cost.
NAME, TYPE, VALUES, ORDER = 1.0, 0.6, 0.6, 0.4

PROFILE = "file_id long, series string, file_date timestamp, fields string"
EVENTS = "series string, chunk long, seq long, file_id long, kind string, change string, field string, previous_field string, type string"


SCALARS = {str: "string", bool: "boolean", int: "number", float: "number"}


def type_of(value) -> str | None:
    """string, number, boolean, object or array<...>; None for what tells no type. Arrays of any depth are walked without recursion."""
    if value is None:
        return None
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float)):
        return "number"
    if isinstance(value, str):
        return "string"
    if isinstance(value, dict):
        return "object"
    found: list[set[str]] = [set()]  # the types inside each open array
    open_arrays = [iter(value)]
    while True:
        for x in open_arrays[-1]:
            if isinstance(x, list):
                open_arrays.append(iter(x))
                found.append(set())
                break
            if t := type_of(x):
                found[-1].add(t)
        else:
            open_arrays.pop()
            inner = sorted(found.pop())
            own = f"array<{'|'.join(inner)}>" if inner else None
            if not open_arrays:
                return own
            if own:
                found[-1].add(own)


def records_of(content: str | None) -> list[dict] | None:
    """The records of one file; None when it can't be read."""
    try:
        runs = deep.loads(content).get("runs")
    except (TypeError, ValueError, AttributeError):
        return None
    return [r for r in runs if isinstance(r, dict)] if isinstance(runs, list) else None


def field_order(records: list[dict]) -> list[str]:
    """The fields of all records in an order that agrees with each record's own wherever they agree with each other."""
    order = list(max(records, key=len, default={}))
    known = set(order)
    for record in records:
        after = None
        for name in record:
            if name not in known:
                known.add(name)
                order.insert(order.index(after) + 1 if after is not None else 0, name)
            after = name
    return order


def _mark(value) -> int:
    """Hash of a value, the same for equal values of a type."""
    if isinstance(value, str):
        return zlib.crc32(value.encode("utf-8", "surrogatepass"))
    if isinstance(value, (dict, list)):
        return zlib.crc32(deep.dumps(value, sort_keys=True).encode())
    return zlib.crc32(repr(value).encode())


def profile(content: str | None) -> list[list] | None:
    """[name, type or None, share of nulls, sketch] of each field in order."""
    records = records_of(content)
    if records is None:
        return None
    out = []
    for name in field_order(records):
        values = [r[name] for r in records if name in r]
        kinds = {type(v) for v in values}
        if not kinds & {dict, list}:  # plain values: their types and distinct values tell all
            types = sorted({t for t in (SCALARS.get(k) for k in kinds) if t})
            hashes = sorted({_mark(v) for v in set(values) if v is not None})[:SKETCH]
        else:
            types = sorted({t for t in map(type_of, values) if t})
            hashes = sorted({_mark(v) for v in values if v is not None})[:SKETCH]
        out.append([name, "|".join(types) or None, sum(v is None for v in values) / len(values), hashes])
    return out


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fields = [json.dumps(p) if (p := profile(c)) is not None else None for c in batch.column("content").to_pylist()]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("file_id", "series", "file_date")), pa.array(fields, pa.string())], names=["file_id", "series", "file_date", "fields"])


def profiles(files: DataFrame) -> DataFrame:
    """One row per file: its fields as JSON, null where it can't be read."""
    # A file is a few kilobytes, its profile a fraction of that: redelivered files are profiled again rather than shuffled whole.
    return files.select("file_id", "series", "file_date", "content").mapInArrow(_profiles, PROFILE).dropDuplicates(["file_id"])


def unreadable(files: DataFrame) -> DataFrame:
    return profiles(files).where("fields IS NULL OR series IS NULL OR file_date IS NULL").select("file_id")


@functools.lru_cache(maxsize=100_000)
def name_similarity(a: str, b: str) -> float:
    a, b = (x.replace("_", "").lower() for x in (a, b))
    return difflib.SequenceMatcher(None, *sorted((a, b)), autojunk=False).ratio()


def cost(old: list, new: list, apart: int) -> float:
    """How unlikely it is that the field `old` goes on as `new`."""
    joint, either = len(set(old[3]) & set(new[3])), len(set(old[3]) | set(new[3]))
    values = joint / either if either else abs(old[2] - new[2]) < 0.5
    types = 0.5 if old[1] is None or new[1] is None else float(old[1] != new[1])
    return NAME * (1 - name_similarity(old[0], new[0])) + TYPE * types + VALUES * (1 - values) + ORDER * apart


def matching(costs: list[list[float]]) -> list[tuple[int, int]]:
    """The cheapest complete bipartite matching of the smaller side (successive shortest augmenting paths with potentials)."""
    if not costs or not costs[0]:
        return []
    if len(costs) > len(costs[0]):
        return [(j, i) for i, j in matching([list(c) for c in zip(*costs)])]
    rows, columns = len(costs), len(costs[0])
    up, down, mate = [0.0] * (rows + 1), [0.0] * (columns + 1), [0] * (columns + 1)
    for row in range(1, rows + 1):
        mate[0], at = row, 0
        slack, back, seen = [float("inf")] * (columns + 1), [0] * (columns + 1), [False] * (columns + 1)
        while mate[at]:
            seen[at], least, after = True, float("inf"), 0
            for j in range(1, columns + 1):
                if not seen[j]:
                    now = costs[mate[at] - 1][j - 1] - up[mate[at]] - down[j]
                    if now < slack[j]:
                        slack[j], back[j] = now, at
                    if slack[j] < least:
                        least, after = slack[j], j
            for j in range(columns + 1):
                if seen[j]:
                    up[mate[j]] += least
                    down[j] -= least
                else:
                    slack[j] -= least
            at = after
        while at:
            mate[at], at = mate[back[at]], back[at]
    return [(mate[j] - 1, j - 1) for j in range(1, columns + 1) if mate[j]]


def _places(fields: list[list], stay: set[str]) -> dict[tuple, list[list]]:
    """The fields that do not stay, by the staying fields on either side."""
    out: dict[tuple, list[list]] = {}
    left, waiting = None, []
    for field in [*fields, None]:
        if field is None or field[0] in stay:
            if waiting:
                out[left, field and field[0]] = waiting
            left, waiting = field and field[0], []
        else:
            waiting.append(field)
    return out


def compare(old: list[list], new: list[list]) -> tuple[list[tuple[str, str]], list[str], list[str]]:
    """Renames (old name, new name), added and removed names between two files."""
    if [f[0] for f in old] == [f[0] for f in new]:
        return [], [], []
    stay = {f[0] for f in old} & {f[0] for f in new}
    gone, came = _places(old, stay), _places(new, stay)
    renamed = []
    for place in gone.keys() & came.keys():
        a, b = gone[place], came[place]
        renamed += [(a[i][0], b[j][0]) for i, j in matching([[cost(x, y, abs(i - j)) for j, y in enumerate(b)] for i, x in enumerate(a)])]
    was, now = {a for a, _ in renamed}, {b for _, b in renamed}
    return renamed, [f[0] for f in new if f[0] not in stay | now], [f[0] for f in old if f[0] not in stay | was]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of files, sorted by series, chunk and place, one after the other."""
    names = [c.split()[0] for c in EVENTS.split(", ")]
    types = [pa.int64() if n in ("chunk", "seq", "file_id") else pa.string() for n in names]

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    key, files, out = None, [], []
    for batch in batches:
        for series, chunk, seq, file_id, fields in zip(*(batch.column(c).to_pylist() for c in ("series", "chunk", "seq", "file_id", "fields"))):
            if key != (series, chunk):
                if files:
                    out += _chunk(*key, files)
                key, files = (series, chunk), []
            files.append((file_id, seq, fields))
        if len(out) > 10_000:
            yield batch_of(out)
            out = []
    if files:
        out += _chunk(*key, files)
    if out:
        yield batch_of(out)


def _chunk(series: str, chunk: int, files: list[tuple[int, int, str]]) -> list[tuple]:
    """Changes within a chunk of files (id, place, fields), and what is needed to join it to the chunks before it.

    State of a field: [type told in this chunk, its name at the chunk's start (None if it was born here), its first name here].
    Rows `first`: the first type told for a field that was there at the start; rows `end`: the state after the last file.
    """
    out: list[tuple] = []
    state: dict[str, list] = {}
    before: list[list] | None = None
    for file_id, seq, text in files:
        fields = json.loads(text)
        row = lambda kind, change, field, previous, type_=None: out.append((series, chunk, seq, file_id, kind, change, field, previous, type_))  # noqa: B023, E731
        if before is None and seq < chunk * CHUNK:  # the last file of the chunk before
            state = {f[0]: [None, f[0], f[0]] for f in fields}
            before = fields
            continue
        if before is not None:
            renamed, added, removed = compare(before, fields)
            came_from = {b: a for a, b in renamed}
            for a, b in renamed:
                row("event", "renamed", b, a)
            for name in added:
                row("event", "added", name, name)
            for name in removed:
                row("event", "removed", name, name)
        else:
            came_from = {}
        after: dict[str, list] = {}
        for name, type_, *_ in fields:
            told, start, root = state.get(came_from.get(name, name)) or [None, None, name]
            if type_ is not None:
                if told is None and start is not None:
                    row("first", None, name, start, type_)
                elif told is not None and told != type_:
                    row("event", "retyped", name, name)
                told = type_
            after[name] = [told, start, root]
        state, before = after, fields
        row("names", None, json.dumps({n: [s[1] is not None, s[2]] for n, s in state.items()}), None)
    out += [(series, chunk, files[-1][1], None, "end", root, name, start, told) for name, (told, start, root) in state.items()]
    return out


def _carry(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Walk a series' chunk summaries: types that differ from the last known type before the chunk, and each start name's first name."""
    out: list[tuple] = []
    types: dict[str, str | None] = {}
    roots: dict[str, str] = {}
    none = lambda x: None if x is None or x != x else x
    for chunk, part in pdf.sort_values("chunk").groupby("chunk"):
        rows = [tuple(map(none, r)) for r in part[["kind", "seq", "file_id", "change", "field", "previous_field", "type"]].itertuples(index=False, name=None)]
        for kind, seq, file_id, _, field, start, type_ in rows:
            if kind == "first" and types.get(start) not in (None, type_):
                out.append((key[0], int(chunk), int(seq), int(file_id), "event", "retyped", field, field, None))
        out.append((key[0], int(chunk), 0, None, "roots", None, json.dumps(roots), None, None))
        ends = [r for r in rows if r[0] == "end"]
        types, roots = (
            {f: t if t is not None else types.get(s) for _, _, _, _, f, s, t in ends},
            {f: roots.get(s, s) if s is not None else root for _, _, _, root, f, s, _ in ends},
        )
    frame = pd.DataFrame(out, columns=[c.split()[0] for c in EVENTS.split(", ")])
    frame["file_id"] = frame["file_id"].astype("Int64")
    return frame


def _numbered(known: DataFrame) -> DataFrame:
    """`file_id`, `series`, `seq` (from 0, by date and id), without a window over a whole series."""
    index = known.select("file_id", "series", "file_date", F.to_date("file_date").alias("day"))
    days = index.groupBy("series", "day").count()
    before = Window.partitionBy("series").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select("series", "day", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("series", "day").orderBy("file_date", "file_id")
    return index.withColumn("rank", F.row_number().over(within)).join(days, ["series", "day"]).select("file_id", "series", (F.col("offset") + F.col("rank") - 1).alias("seq"))


def history(files: DataFrame) -> DataFrame:
    """All rows of the comparison (see EVENTS): events, names per file and first names per chunk."""
    known = cut(profiles(files).where("fields IS NOT NULL AND series IS NOT NULL AND file_date IS NOT NULL"))
    numbered = known.select("file_id", "fields").join(_numbered(known), "file_id")
    chunk = F.floor(F.col("seq") / CHUNK)
    chunks = F.when(F.col("seq") % CHUNK == CHUNK - 1, F.array(chunk, chunk + 1)).otherwise(F.array(chunk))
    placed = numbered.select("file_id", "series", "seq", "fields", F.explode(chunks).alias("chunk"))
    # Series are many and short as a rule, so a task walks all its chunks in one go.
    rows = cut(placed.repartition("series", "chunk").sortWithinPartitions("series", "chunk", "seq").mapInArrow(_chunks, EVENTS))
    long = rows.where("chunk > 0").select("series").distinct()
    carried = rows.where("kind IN ('first', 'end')").join(long, "series", "left_semi").groupBy("series").applyInPandas(_carry, EVENTS)
    return rows.where("kind IN ('event', 'names')").unionByName(carried)


def changes(files: DataFrame) -> DataFrame:
    """Every change of a file against the file before it in its series."""
    return history(files).where("kind = 'event'").select("file_id", "change", "field", "previous_field").distinct()


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["file_id", "record", "field", "source_field", "type", "value"]
    for batch in batches:
        rows = []
        for file_id, content, own, roots in zip(*(batch.column(c).to_pylist() for c in ("file_id", "content", "names", "roots"))):
            own, roots = json.loads(own), json.loads(roots or "{}")
            first = {n: roots.get(root, root) if start else root for n, (start, root) in own.items()}
            for k, record in enumerate(records_of(content) or []):
                rows += [(file_id, k, first.get(n, n), n, type_of(v), v if isinstance(v, str) else deep.dumps(v)) for n, v in record.items() if v is not None]
        columns = list(zip(*rows)) if rows else [()] * 6
        types = [pa.int64(), pa.int32(), *[pa.string()] * 4]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def unified(files: DataFrame) -> DataFrame:
    """One consistent table of all records' values: a row per non-null value under the field's first name in its series."""
    all_rows = cut(history(files).where("kind IN ('names', 'roots')"))
    names = all_rows.where("kind = 'names'").select("file_id", "series", "chunk", F.col("field").alias("names"))
    roots = all_rows.where("kind = 'roots'").select("series", "chunk", F.col("field").alias("roots"))
    known = names.join(roots, ["series", "chunk"], "left").select("file_id", "names", "roots").dropDuplicates(["file_id"])
    own = files.select("file_id", "content").dropDuplicates(["file_id"])
    return own.join(known, "file_id").mapInArrow(_records, "file_id long, record int, field string, source_field string, type string, value string")
