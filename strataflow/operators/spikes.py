"""Implausible readings of measurement series: spikes, stuck values and impossible readings, each relative to its source.

The readings are spread over the tasks by ranges of (source, field, time), so that a source of any share
of the rows is split and every task walks sorted rows in blocks. The decision about a candidate depends on
at most CONTEXT readings on either side. Which readings become candidates depends on the stretch of FIT to
twice FIT readings that the ellipsoid is fitted to, and stretches begin where a task's rows of a source do;
the decision that follows is far stricter than the ellipsoid. The few readings nearer than that to the edge of a range are
written out with their neighbours and decided in a second, small step.

impossible: outside the detector's bounds. stuck: part of a run of RUN or more equal numbers. spike, by
phase-space thresholding: each reading is a point of its deviation from the running median and of the
first and second differences. Points outside an ellipsoid with robust axes are candidates; they are
replaced by the running median and the axes found again until no candidate is added. A candidate is a
spike if it and at most MOST - 1 neighbours lie more than TIMES the usual scatter around them away from
the level before and from the level after, on the same side. So drift and lasting changes stay unflagged.

Defined cases: null and NaN numbers are skipped and break no run; readings without instrument, channel or
time belong to no source and are only held against the bounds; without a detector there are no bounds;
redelivered readings count once; equal times are ordered by id; sources with too few readings to tell a
level (fewer than three on a side that has any) get no spikes; extra columns are ignored; empty tables
give an empty result. Sources are told apart by a 64-bit hash of instrument and channel.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataflow.common import bounded, cut

RUN = 10  # equal readings that make a stuck run
MOST = 3  # readings of one spike at most
TIMES = 10.0  # deviation of a spike in units of the usual scatter
SIDE = 7  # readings that tell the level on either side
HALF = 7  # half width of the running median
WIDE = 50  # readings on either side that tell the usual scatter
NEAR, FAR = 30, 100  # readings (also unusable ones) within which the running median and the scatter look for them
CONTEXT = NEAR + FAR + MOST + 10
BLOCK = 1 << 16
#: Axes of the ellipsoid in robust standard deviations, and readings per fit.
AXIS, FIT = 4.0, 128

STREAM = "source long, field int, at long, reading_id long, number double, impossible boolean"
OUT = STREAM + ", kind string, open boolean, part int"


def _window_sorted(x: np.ndarray, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted with unusable entries last, and the number of usable ones."""
    return np.sort(np.where(ok, x, np.inf), axis=1), ok.sum(axis=1)


def _quantile(rows: np.ndarray, count: np.ndarray, q: float) -> np.ndarray:
    """Quantile of each sorted row's first `count` entries; NaN for none."""
    at = (np.maximum(count, 1) - 1) * q
    low = np.floor(at).astype(np.int64)
    high = np.minimum(low + 1, np.maximum(count, 1) - 1)
    line = np.arange(len(rows))
    with np.errstate(invalid="ignore"):
        a, b = rows[line, low], rows[line, high]
        return np.where(count > 0, np.where(a == b, a, a + (b - a) * (at - low)), np.nan)


def _neighbours(rows: np.ndarray, offsets: np.ndarray, seg: np.ndarray, raw: np.ndarray, reach: int):
    """Places of the neighbours of `rows` at `offsets`, and whether they are of the same source and near enough."""
    place = rows[:, None] + offsets
    inside = (place >= 0) & (place < len(seg))
    place = np.clip(place, 0, len(seg) - 1)
    return place, inside & (seg[place] == seg[rows][:, None]) & (np.abs(raw[place] - raw[rows][:, None]) <= reach)


def _block_scale(x: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """1.4826 times the median of |x| of each stretch of fewer than 2 * FIT readings."""
    out = np.empty(len(starts))
    wide = counts > FIT
    for rows, width in ((np.flatnonzero(~wide), FIT), (np.flatnonzero(wide), 2 * FIT)):
        place = starts[rows, None] + np.arange(width)
        inside = np.arange(width) < counts[rows, None]
        size = np.sort(np.where(inside, np.abs(x[np.minimum(place, len(x) - 1)]), np.inf), axis=1)
        out[rows] = 1.4826 * size[np.arange(len(rows)), counts[rows] // 2]
    return out


def _levels(x: np.ndarray, seg: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Running median over HALF usable readings on either side."""
    n, width = len(x), 2 * HALF + 1
    level = np.empty(n)
    full = np.zeros(n, bool)
    if n >= width:
        low, high = slice(0, n - 2 * HALF), slice(2 * HALF, n)
        mid = raw[HALF : n - HALF]
        full[HALF : n - HALF] = (seg[low] == seg[high]) & (mid - raw[low] <= NEAR) & (raw[high] - mid <= NEAR)
        windows = np.lib.stride_tricks.sliding_window_view(x, width)
        inner = np.flatnonzero(full)
        for a in range(0, len(inner), BLOCK):
            rows = inner[a : a + BLOCK]
            level[rows] = np.sort(windows[rows - HALF], axis=1)[:, HALF]
    rest = np.flatnonzero(~full)
    for a in range(0, len(rest), BLOCK):
        rows = rest[a : a + BLOCK]
        place, ok = _neighbours(rows, np.arange(-HALF, HALF + 1), seg, raw, NEAR)
        level[rows] = _quantile(*_window_sorted(x[place], ok), 0.5)
    return level


def _candidates(x: np.ndarray, level: np.ndarray, seg: np.ndarray) -> np.ndarray:
    """Points outside the phase-space ellipsoid of their stretch of the source."""
    n = len(x)
    start = np.r_[True, seg[1:] != seg[:-1]]
    first = np.flatnonzero(start)
    length = np.diff(np.r_[first, n])
    pieces = np.maximum(length // FIT, 1)  # the last stretch of a source takes the remainder
    starts = np.repeat(first, pieces) + FIT * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    counts = np.diff(np.r_[starts, n])
    out = np.zeros(n, bool)
    y = x.copy()
    stretch = np.repeat(np.arange(len(starts)), counts)
    active, rows = np.arange(len(starts)), np.arange(n)  # only stretches whose readings changed, or their neighbours', need another look
    while len(active):  # each round adds a candidate or is the last
        u = y - level
        d = np.r_[0.0, np.diff(u)]
        d[start] = 0
        d2 = np.r_[np.diff(d), 0.0]
        d2[np.r_[start[1:], True]] = 0
        total = np.zeros(len(rows))
        for axis in (u, d, d2):
            scale, own = np.repeat(AXIS * _block_scale(axis, starts[active], counts[active]), counts[active]), axis[rows]
            with np.errstate(divide="ignore", invalid="ignore"):
                total += np.where(scale > 0, (own / scale) ** 2, np.where(own != 0, np.inf, 0.0))
        new = rows[(total > 1) & ~out[rows]]
        out[new] = True
        y[new] = level[new]
        touched = np.unique(stretch[new])
        active = np.unique(np.clip(np.r_[touched - 1, touched, touched + 1], 0, len(starts) - 1)) if len(touched) else touched
        rows = np.repeat(starts[active] - np.r_[0, np.cumsum(counts[active])[:-1]], counts[active]) + np.arange(counts[active].sum()) if len(active) else active
    return out


def decide(source: np.ndarray, field: np.ndarray, number: np.ndarray, impossible: np.ndarray) -> np.ndarray:
    """0 plausible, 1 impossible, 2 stuck, 3 spike, for readings sorted by source, field and time."""
    n = len(number)
    kind = np.zeros(n, np.int8)
    if not n:
        return kind
    start = np.r_[True, (source[1:] != source[:-1]) | (field[1:] != field[:-1])]
    segment = np.cumsum(start)
    run = np.cumsum(start | np.r_[True, number[1:] != number[:-1]]) - 1
    kind[np.bincount(run)[run] >= RUN] = 2
    kind[impossible] = 1

    raw = np.flatnonzero(kind == 0)
    if not len(raw):
        return kind
    x, seg = number[raw], segment[raw]
    level = _levels(x, seg, raw)
    u = np.abs(x - level)

    candidates = np.flatnonzero(_candidates(x, level, seg))
    spike = np.zeros(len(raw), bool)
    for a in range(0, len(candidates), BLOCK // 8):
        rows = candidates[a : a + BLOCK // 8]
        place, ok = _neighbours(rows, np.r_[-WIDE:0, 1 : WIDE + 1], seg, raw, FAR)
        ordered, count = _window_sorted(u[place], ok)
        scatter = np.fmax(1.4826 * _quantile(ordered, count, 0.5), _quantile(ordered, count, 0.8) / 1.2816)
        # The running median lies between the levels on either side, so what is near it is near one of them.
        rows, scatter = (v[u[rows] > 0.6 * TIMES * scatter] for v in (rows, scatter))
        for size in range(1, MOST + 1):
            for shift in range(size):  # the candidate is the reading `shift` of a spike of `size`
                low, high = rows - shift, rows - shift + size - 1
                whole = (low >= 0) & (high < len(raw))
                low, high = np.clip(low, 0, len(raw) - 1), np.clip(high, 0, len(raw) - 1)
                whole &= (seg[low] == seg[rows]) & (seg[high] == seg[rows]) & (raw[high] - raw[low] < NEAR)
                before, ok_before = _neighbours(low, np.arange(-SIDE, 0), seg, raw, FAR)
                after, ok_after = _neighbours(high, np.arange(1, SIDE + 1), seg, raw, FAR)
                left_rows, left_count = _window_sorted(x[before], ok_before)
                right_rows, right_count = _window_sorted(x[after], ok_after)
                left, right = _quantile(left_rows, left_count, 0.5), _quantile(right_rows, right_count, 0.5)
                left, right = np.where(left_count, left, right), np.where(right_count, right, left)
                whole &= np.maximum(left_count, right_count) >= 3
                inner = x[np.minimum(low[:, None] + np.arange(size), high[:, None])]
                limit = TIMES * scatter
                with np.errstate(invalid="ignore"):
                    up, down = inner.min(axis=1) - np.maximum(left, right), np.minimum(left, right) - inner.max(axis=1)
                    # It returns: the readings next to the spike are not off on the same side.
                    beside = np.column_stack([before[:, -1], after[:, 0]])
                    there = np.column_stack([ok_before[:, -1], ok_after[:, 0]])
                    above = (there & (x[beside] - np.maximum(left, right)[:, None] > limit[:, None])).any(axis=1)
                    below = (there & (np.minimum(left, right)[:, None] - x[beside] > limit[:, None])).any(axis=1)
                    spike[rows] |= whole & ((up > limit) & (up > 0) & ~above | (down > limit) & (down > 0) & ~below)
    kind[raw[spike]] = 3
    return kind


KINDS = np.array([None, "impossible", "stuck", "spike"], object)
_NAMES = [c.split()[0] for c in OUT.split(", ")]


def _batch(rows: dict, keep: np.ndarray, kind: np.ndarray, open_: np.ndarray, part: np.ndarray) -> pa.RecordBatch:
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.bool_(), pa.string(), pa.bool_(), pa.int32()]
    columns = [rows[c][keep] for c in _NAMES[:6]] + [KINDS[kind[keep]], open_[keep], part[keep]]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=_NAMES)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Decide one sorted range. Out go flagged readings (`open` false) and the readings about the range's edges.

    Edge readings have `kind` null; `open` marks those to decide, `part` tells the range's head (0) and tail (1) apart.
    """
    names = _NAMES[:6]
    carry: dict | None = None
    done = 0  # leading readings of the carry that are decided or open
    head_left = None  # readings of the head still to write while the first segment lasts
    pending, size = [], 0

    def blocks():
        nonlocal pending, size
        for batch in batches:
            if batch.num_rows:
                pending.append(batch)
                size += batch.num_rows
                if size >= BLOCK:
                    yield pending, False
                    pending, size = [], 0
        yield pending, True

    first = True
    for group, last in blocks():
        fresh = {c: np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in group]) for c in names} if group else None
        if carry is not None and fresh is not None:
            rows = {c: np.concatenate([carry[c], fresh[c]]) for c in names}
        else:
            rows = carry if fresh is None else fresh
        if rows is None or not len(rows["number"]):
            return
        if len(rows["number"]) > 1:  # redelivered readings are neighbours here
            same = (rows["reading_id"][1:] == rows["reading_id"][:-1]) & (rows["source"][1:] == rows["source"][:-1]) & (rows["field"][1:] == rows["field"][:-1])
            if same.any():
                rows = {c: v[np.r_[True, ~same]] for c, v in rows.items()}
        n = len(rows["number"])
        if not last and n < 4 * CONTEXT:
            carry = rows
            continue
        kind = decide(*(rows[c] for c in ("source", "field", "number", "impossible")))
        change = np.flatnonzero((rows["source"][1:] != rows["source"][:-1]) | (rows["field"][1:] != rows["field"][:-1])) + 1
        end = n if last else n - CONTEXT
        decided = np.zeros(n, bool)
        decided[done:end] = True
        false, part = np.zeros(n, bool), np.zeros(n, np.int32)
        if first:
            first_end = int(change[0]) if len(change) else n
            head = min(first_end, 2 * CONTEXT)
            opened = np.arange(n) < min(first_end, CONTEXT)
            decided &= ~opened
            yield _batch(rows, np.flatnonzero(np.arange(n) < head), np.zeros(n, np.int8), opened, part)
        else:
            opened = false
        if last:
            last_start = int(change[-1]) if len(change) else 0
            whole = first and not len(change)  # the range is one segment: its head may hold rows of the tail
            tail = max(last_start, n - 2 * CONTEXT)
            late = np.arange(n) >= max(last_start, n - CONTEXT)
            decided &= ~late
            if whole and n <= 2 * CONTEXT:
                # every row is out already as head; those not open there are open on the other side
                more = np.flatnonzero(late & ~opened)
                yield _batch(rows, more, np.zeros(n, np.int8), late, part + 1)
            else:
                yield _batch(rows, np.flatnonzero(np.arange(n) >= tail), np.zeros(n, np.int8), late & ~opened, part + 1)
        yield _batch(rows, np.flatnonzero(decided & (kind > 1)), kind, false, part)
        first = False
        keep = max(0, end - CONTEXT)
        carry = {c: v[keep:] for c, v in rows.items()}
        done = end - keep


def _edges(pdf: pd.DataFrame) -> pd.DataFrame:
    """Decide the open readings of one source's edges. Heads and tails of one range may lie apart; then a new stretch begins."""
    pdf = pdf.sort_values(["at", "reading_id", "open"], ascending=[True, True, False]).drop_duplicates(["at", "reading_id"])
    # A tail that follows its own head without touching it: the head's last row and the tail's first row are both not open.
    closed = ~pdf["open"].to_numpy()
    part = pdf["part"].to_numpy()
    apart = np.r_[False, closed[1:] & closed[:-1] & (part[1:] == 1) & (part[:-1] == 0)]
    stretch = np.cumsum(apart)
    kind = decide(stretch, np.zeros(len(pdf), np.int64), pdf["number"].to_numpy(float), pdf["impossible"].to_numpy(bool))
    keep = pdf["open"].to_numpy() & (kind > 1)
    return pd.DataFrame({"reading_id": pdf["reading_id"].to_numpy()[keep], "field": pdf["field"].to_numpy()[keep], "kind": KINDS[kind[keep]]})


def readings_of(readings: DataFrame, detectors: DataFrame) -> DataFrame:
    """One row per reading and field with a number: source, time and whether the detector could report it."""
    own = readings.select("reading_id", "instrument_id", "model", "channel", "bin_start", "value", F.col("event_count").cast("double").alias("event_count"))
    bounds = detectors.select("model", "channel", "range_min", "range_max", "max_event_count").dropDuplicates(["model", "channel"])
    joined = own.join(bounded(bounds), ["model", "channel"], "left")
    out = lambda c, low, high: F.coalesce((F.col(c) < low) | (F.col(c) > high), F.lit(False))
    fields = F.array(
        F.struct(F.lit(0).alias("field"), F.col("value").alias("number"), out("value", F.col("range_min"), F.col("range_max")).alias("impossible")),
        F.struct(F.lit(1).alias("field"), F.col("event_count").alias("number"), (out("event_count", F.lit(0.0), F.col("max_event_count")) | F.coalesce(F.col("event_count") < 0, F.lit(False))).alias("impossible")),
    )
    placed = F.col("instrument_id").isNotNull() & F.col("channel").isNotNull() & F.col("bin_start").isNotNull()
    return (
        joined.select("reading_id", F.when(placed, F.xxhash64("instrument_id", "channel")).alias("source"), F.unix_micros(F.col("bin_start").cast("timestamp")).alias("at"), F.explode(fields).alias("f"))
        .select("source", "f.field", "at", "reading_id", "f.number", "f.impossible")
        .where("number IS NOT NULL AND NOT isnan(number)")
    )


def faults(readings: DataFrame, detectors: DataFrame) -> DataFrame:
    """`reading_id`, `field` (value or event_count) and `kind` of every implausible reading."""
    rows = readings_of(readings, detectors)
    impossible = rows.where("impossible").select("reading_id", "field", F.lit("impossible").alias("kind"))
    order = ["source", "field", "at", "reading_id"]
    walked = cut(rows.where("source IS NOT NULL").repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_walk, OUT))
    sure = walked.where("kind IS NOT NULL").select("reading_id", "field", "kind")
    edge = walked.where("kind IS NULL").groupBy("source", "field").applyInPandas(_edges, "reading_id long, field int, kind string")
    found = impossible.unionByName(sure).unionByName(edge).distinct()
    return found.select("reading_id", F.when(F.col("field") == 0, "value").otherwise("event_count").alias("field"), "kind")
