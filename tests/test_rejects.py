from __future__ import annotations

import csv
import io
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strataflow.operators import rejects as R

SCHEMA = "line_id long, file_name string, line_no int, raw string"


def run(spark, lines, sep=",", extra=False):
    rows = [(0, "f", 1, sep.join(R.FIELDS))] + [(k + 1, "f", k + 2, x) for k, x in enumerate(lines)]
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:
        df = df.selectExpr("*", "1 AS reason", "'x' AS separator")
    return {r.line_id: r.reason for r in R.rejects(df).collect()}


CASES = [
    ('p,A1,96,s,c,1,nM', None),
    ('"p","A1","96","s","c","1","nM"', None),
    ('p,A1,96,"a ""b"" c",c,,', None),
    ('"p, q",A1,96,s,c,1,nM', None),
    ('p,A1,96,"s\nt",c,1,nM', None),
    ('p,A1,96,s,"c,1,nM', "quoting"),
    ('p,A1,96,s,c"d,1,nM', "quoting"),
    ('p,A1,96,"s" x,c,1,nM', "quoting"),
    ('p,A1,96,s,c,1,nM"', "quoting"),
    ('p,A1,96,"s"t",c,1,nM', "quoting"),
    ('p,A1,96,s,c,1', "columns"),
    ('p,A1,96,s,c,1,nM,x', "columns"),
    ('p', "columns"),
    (' ,A1,96,s,c,1,nM', "value"),
    ('p,A1,97,s,c,1,nM', "value"),
    ('p,A1,96-well,s,c,1,nM', "value"),
    ('p, H12 , 96 ,s,c, 1 ,nM', None),
    ('p,I1,96,s,c,1,nM', "value"),
    ('p,A13,96,s,c,1,nM', "value"),
    ('p,A0,96,s,c,1,nM', "value"),
    ('p,af48,1536,s,c,1,nM', None),
    ('p,AG1,1536,s,c,1,nM', "value"),
    ('p,R08C012,96,s,c,1,nM', None),
    ('p,a-01,96,s,c,1,nM', None),
    ('p,a_1,96,s,c,1,nM', None),
    ('p,a--1,96,s,c,1,nM', "value"),
    ('p,A1,96,s,c,1.5e-3,nM', None),
    ('p,A1,96,s,c,-1,nM', "value"),
    ('p,A1,96,s,c,NaN,nM', "value"),
    ('p,A1,96,s,c,inf,nM', "value"),
    ('p,A1,96,s,c,"0,5",nM', "value"),
    ('', None),
    ('   ', None),
    (None, None),
    ('plate,well,format,sample,compound,dose,unit', None),
]


def test_reasons(spark):
    got = run(spark, [x for x, _ in CASES])
    assert {k + 1: want for k, (_, want) in enumerate(CASES) if want} == got


def test_semicolon_takes_decimal_commas(spark):
    assert run(spark, ["p;A1;96;s;c;0,5;nM", "p;A1;96;s;c;1.000,5;nM", "p,A1,96,s,c,1,nM"], ";") == {2: "value", 3: "columns"}


def test_repeated_rows_extra_columns_and_long_texts(spark):
    long = "x" * 2_000_000
    assert run(spark, [f'p,A1,96,{long},c,1,nM', f'p,A1,96,"{long},c,1,nM'], extra=True) == {2: "quoting"}
    df = spark.createDataFrame([(1, "f", 2, "p,A1"), (1, "f", 2, "p,A1"), (None, None, None, "a,b")], SCHEMA)
    assert sorted(((r.line_id, r.reason) for r in R.rejects(df).collect()), key=str) == [(1, "columns"), (None, "columns")]


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert R.rejects(df).count() == 0 and R.valid_rows(df).count() == 0


def test_typed_values(spark):
    df = spark.createDataFrame([(0, "f", 1, "plate;well;format;sample;compound;dose;unit"), (1, "f", 2, ' p ;"ab-07";1536;;"x;y";1,5;')], SCHEMA)
    (row,) = R.valid_rows(df).collect()
    assert (row.plate, row.well_row, row.well_column, row.format, row["sample"], row.compound, row.dose, row.unit) == ("p", 28, 7, 1536, None, "x;y", 1.5, None)


def slow(raw: str, sep: str):
    """The definition, character by character: fields or None for broken quoting."""
    fields, i = [], 0
    while True:
        if raw[i : i + 1] == '"':
            m = re.compile(r'"((?:[^"]|"")*)"').match(raw, i)
            if not m or (m.end() < len(raw) and raw[m.end()] != sep):
                return None
            fields.append(m[1].replace('""', '"'))
            i = m.end()
        else:
            end = raw.find(sep, i)
            end = len(raw) if end < 0 else end
            if '"' in raw[i:end]:
                return None
            fields.append(raw[i:end])
            i = end
        if i >= len(raw):
            return fields
        i += 1


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet='ab,"\n é', max_size=14), min_size=1, max_size=6))
def test_index_against_definition(texts):
    data = "".join(texts).encode() or b"\0"
    lengths = np.array([len(t.encode()) for t in texts])
    starts = np.cumsum(lengths) - lengths
    owner, place, broken = R.structural_index(np.frombuffer(data, np.uint8), starts, starts + lengths, np.full(len(texts), ord(","), np.uint8))
    for k, t in enumerate(texts):
        want = slow(t, ",")
        assert bool(broken[k]) == (want is None)
        if want is not None:
            cuts = [starts[k] - 1, *place[owner == k], starts[k] + lengths[k]]
            got = [data[a + 1 : b].decode() for a, b in zip(cuts, cuts[1:])]
            got = [x[1:-1].replace('""', '"') if x.startswith('"') else x for x in got]
            assert got == want


@pytest.mark.parametrize("text,want", [("A1", (1, 1)), ("z9", (26, 9)), ("AA 10", (27, 10)), ("R2C03", (2, 3)), ("AAA1", None), ("1A", None), ("", None)])
def test_wells(text, want):
    assert R.read_well(text) == want


def test_csv_reader_agrees_on_valid_records():
    raw = 'a,"b ""c""","d,e"'
    assert slow(raw, ",") == next(csv.reader(io.StringIO(raw)))
