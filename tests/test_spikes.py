from __future__ import annotations

import datetime as dt

import numpy as np
import pytest

from strataflow.operators import spikes as K

SCHEMA = "reading_id long, instrument_id string, model string, channel string, bin_start timestamp, value double, event_count long"
BOUNDS = "model string, channel string, range_min double, range_max double, max_event_count long"
START = dt.datetime(2020, 1, 1)


def series(values, counts=None, instrument="i", first=0):
    counts = counts if counts is not None else [100 + (k * 7) % 5 for k in range(len(values))]
    return [(first + k, instrument, "m", "c", START + dt.timedelta(seconds=10 * k), None if v is None else float(v), n) for k, (v, n) in enumerate(zip(values, counts))]


def found(spark, rows, bounds=(("m", "c", -1e6, 1e6, 1000),)):
    return {tuple(r) for r in K.faults(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(list(bounds), BOUNDS)).collect()}


def noise(n, seed=1, level=500.0, scatter=3.0):
    return np.random.default_rng(seed).normal(level, scatter, n)


def test_kinds(spark):
    x = noise(400)
    x[50] += 90
    x[100:103] -= 120
    x[150:154] += 90  # too long for a spike
    x[200:212] = 512.25  # stuck
    x[250:259] = 511.5  # nine equal values are no run
    x[300:] += 200  # lasting change
    x[20] = 5e6
    rows = series(x.tolist())
    rows[30] = (*rows[30][:6], -1)
    rows[31] = (*rows[31][:6], 1001)
    got = found(spark, rows + rows[:60])  # redelivered
    want = {(50, "value", "spike"), *((k, "value", "spike") for k in (100, 101, 102)), *((k, "value", "stuck") for k in range(200, 212)), (20, "value", "impossible"), (30, "event_count", "impossible"), (31, "event_count", "impossible")}
    assert got == want


def test_bounds_are_possible_and_missing_detectors_have_none(spark):
    rows = series([-1e6, 1e6, 2e6])
    assert {g for g in found(spark, rows) if g[2] == "impossible"} == {(2, "value", "impossible")}
    assert found(spark, rows, bounds=[("other", "c", 0.0, 1.0, 1)]) == set()


def test_nulls_break_no_run(spark):
    x = noise(60).tolist()
    x[20:32] = [501.0, None, 501.0, None, None, 501.0, 501.0, 501.0, 501.0, 501.0, 501.0, 501.0]
    x[33] = 501.0
    assert found(spark, series(x)) == set()
    x[32] = 501.0
    x[34] = None
    assert {k for k, _, kind in found(spark, series(x)) if kind == "stuck"} == {20, 22, 25, 26, 27, 28, 29, 30, 31, 32, 33}


def test_drift_steps_and_short_sources_stay_unflagged(spark):
    drift = (noise(500, 2) + np.linspace(0, 400, 500)).tolist()
    step = noise(300, 3)
    step[150:] += 400
    rows = series(drift) + series(step.tolist(), instrument="j", first=1000) + series([1.0, 900.0], instrument="k", first=2000)
    assert found(spark, rows) == set()


def test_nulls_anywhere_and_empty_tables(spark):
    rows = [(1, None, "m", "c", START, 2e6, None), (2, "i", None, "c", START, 1.0, -5), (3, "i", "m", None, None, float("nan"), 2), (None, None, None, None, None, None, None)]
    assert found(spark, rows) == {(1, "value", "impossible"), (2, "event_count", "impossible")}
    assert found(spark, []) == set()
    assert found(spark, series([1.0]), bounds=[]) == set()


@pytest.mark.parametrize("seed", range(3))
def test_split_walk_equals_one_piece(spark, seed, monkeypatch):
    """Ranges of any size decide as if each source were walked whole."""
    import pyarrow as pa

    rng = np.random.default_rng(seed)
    lengths = [3000, 40, 700, 5, 1200]
    source = np.repeat(np.arange(len(lengths)), lengths)
    number = np.round(rng.normal(100 * (source + 1), 1 + source), 1)
    hit = rng.choice(len(number), 60, replace=False)
    number[hit] += rng.choice([-1, 1], 60) * rng.uniform(30, 300, 60)
    for a in rng.choice(len(number) - 400, 12):
        number[a : a + rng.integers(5, 330)] = number[a]
    impossible = number > 700
    field = np.zeros(len(number), np.int64)
    whole = K.decide(source, field, number, impossible)
    cuts = [0, *sorted(rng.choice(len(number), 9, replace=False).tolist()), len(number)]
    monkeypatch.setattr(K, "BLOCK", 600)
    sure, edges = {}, []
    for a, b in zip(cuts, cuts[1:]):
        columns = {"source": source, "field": field, "at": np.arange(len(number)), "reading_id": np.arange(len(number)), "number": number, "impossible": impossible}
        batches = [pa.RecordBatch.from_pydict({c: v[k : min(k + 250, b)] for c, v in columns.items()}) for k in range(a, b, 250)]
        for out in K._walk(iter(batches)):
            for row in out.to_pylist():
                if row["kind"] is None:
                    edges.append(row)
                else:
                    sure[row["reading_id"]] = row["kind"]
    import pandas as pd

    frame = pd.DataFrame(edges)
    for _, part in frame.groupby("source"):
        for row in K._edges(part).itertuples():
            assert row.reading_id not in sure
            sure[row.reading_id] = row.kind
    assert sure == {int(k): K.KINDS[whole[k]] for k in np.flatnonzero(whole > 1)}
