"""Rows that fail to parse: load the valid records of delimited files, set the others apart with a reason.

Structural indexing: the bytes of an Arrow batch of records are one numpy array. A running parity of
its quote marks tells which separators and line ends lie inside quotes, so all delimiters and record
ends of the batch are found without looping over characters; counts and type checks then make valid or
rejected rows. The separator of a file is read from its header record and joined to its other records.

Defined cases: null and blank records and headers are neither valid nor rejected; null or missing
headers fall back to the separator that is most frequent in the record; repeated records give repeated
rows until `rejects`/`valid_rows` keep one per id; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataflow.common import bounded

QUOTE, NEWLINE, RETURN = 34, 10, 13
FIELDS = ("plate", "well", "format", "sample", "compound", "dose", "unit")
SEPARATORS = (",", ";", "\t")
# Plate formats and their rows and columns.
PLATES = {"96": (8, 12), "384": (16, 24), "1536": (32, 48)}

SCHEMA = (
    "line_id long, file_name string, line_no int, reason string, plate string, well string, well_row int, well_column int, "
    "format int, sample string, compound string, dose double, unit string"
)

_LETTERED = re.compile(r"([A-Za-z]{1,2})[ \-_]?([0-9]+)")
_NUMBERED = re.compile(r"[Rr]([0-9]+)[Cc]([0-9]+)")
_POINT = re.compile(r"\+?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?")
_COMMA = re.compile(r"\+?([0-9]+[.,]?[0-9]*|[.,][0-9]+)([eE][+-]?[0-9]+)?")


@functools.lru_cache(maxsize=200_000)
def read_well(text: str) -> tuple[int, int] | None:
    """1-based row and column of a well name such as A1, a-01, AF_48 or R01C08; None when it is none."""
    if m := _LETTERED.fullmatch(text):
        row = functools.reduce(lambda n, c: n * 26 + ord(c) - 64, m[1].upper(), 0)
        return row, int(m[2])
    if m := _NUMBERED.fullmatch(text):
        return int(m[1]), int(m[2])
    return None


def read_dose(text: str, comma: bool) -> float | None:
    """A plain or exponent number of 0 or more; NaN for other texts, None for a blank."""
    if not text:
        return None
    if not (_COMMA if comma else _POINT).fullmatch(text):
        return float("nan")
    return float(text.replace(",", "."))


def structural_index(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, separators: np.ndarray):
    """Delimiters of all records of a byte buffer at once.

    `starts`/`ends` bound each record and `separators` holds its separator byte. Returns the record
    number and place of every delimiter outside quotes and a flag per record: its quoting is broken.
    """
    n = len(starts)
    lengths = ends - starts
    record = np.repeat(np.arange(n), lengths)
    place = np.arange(len(record)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + starts[record]
    byte = data[place]
    quote = byte == QUOTE
    before = np.cumsum(quote) - quote  # quotes before this byte, counted over the batch
    first = np.cumsum(lengths) - lengths
    base = np.zeros(n, np.int64)
    full = lengths > 0
    base[full] = before[first[full]]
    inside = ((before - base[record]) & 1) == 1  # odd parity: between an opening and a closing quote
    delimiter = (byte == separators[record]) & ~inside & ~quote

    broken = np.zeros(n, bool)
    at = np.flatnonzero(quote)
    if len(at):
        owner = record[at]
        head = at == first[owner]
        tail = at == first[owner] + lengths[owner] - 1
        left = np.where(head, 0, at - 1)
        right = np.where(tail, 0, at + 1)
        opens = ~inside[at]
        # An opening quote follows the record's start, a delimiter, or the quote it doubles; a closing one precedes the end, a delimiter or its double.
        good_open = head | delimiter[left] | (quote[left] & inside[left])
        good_close = tail | delimiter[right] | quote[right]
        broken[owner[np.where(opens, ~good_open, ~good_close)]] = True
        broken |= (np.bincount(owner, minlength=n) & 1) == 1
    return record[delimiter], place[delimiter], broken


def _unquote(field: bytes) -> str:
    text = field.decode("utf-8", "replace")
    if len(text) >= 2 and text[0] == '"':
        text = text[1:-1].replace('""', '"')
    return text.strip()


def _check(fields: list[str], comma: bool) -> tuple | None:
    """The typed columns of seven fields, or None when a value is impossible."""
    plate, well, form, sample, compound, dose, unit = fields
    if not plate or form not in PLATES or (at := read_well(well)) is None:
        return None
    rows, columns = PLATES[form]
    amount = read_dose(dose, comma)
    if not (1 <= at[0] <= rows and 1 <= at[1] <= columns) or amount != amount:
        return None
    return plate, well, at[0], at[1], int(form), sample or None, compound or None, amount, unit or None


def _bytes_of(column: pa.ChunkedArray | pa.Array):
    """Data, starts and ends of a string column's rows as numpy arrays, without copying the bytes."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    array = array.cast(pa.large_string()).fill_null("")
    _, offsets, data = array.buffers()
    where = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1]
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(1, np.uint8)
    return body, where[:-1].copy(), where[1:].copy()


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    types = {"line_id": pa.int64(), "line_no": pa.int32(), "well_row": pa.int32(), "well_column": pa.int32(), "format": pa.int32(), "dose": pa.float64()}
    for batch in batches:
        if not batch.num_rows:
            continue
        data, starts, ends = _bytes_of(batch.column("raw"))
        for end in (NEWLINE, RETURN):  # a record's own line end is no part of it
            ends = ends - ((ends > starts) & (data[np.maximum(ends - 1, 0)] == end))
        seps = batch.column("separator").to_pylist()
        raws = batch.column("raw").to_pylist()
        for i, s in enumerate(seps):
            if s is None:
                text = raws[i] or ""
                seps[i] = max(SEPARATORS, key=text.count)
        codes = np.fromiter((ord(s) for s in seps), np.uint8, len(seps))
        owner, place, broken = structural_index(data, starts, ends, codes)
        counts = np.bincount(owner, minlength=len(starts)) + 1
        first = np.concatenate([[0], np.cumsum(counts - 1)])
        ids, files, numbers = (batch.column(c).to_pylist() for c in ("line_id", "file_name", "line_no"))
        place_list, first_list, start_list, end_list = place.tolist(), first.tolist(), starts.tolist(), ends.tolist()
        broken_list, count_list = broken.tolist(), counts.tolist()
        buffer = data.tobytes()
        rows = []
        for i in range(len(start_list)):
            a, b = start_list[i], end_list[i]
            if not buffer[a:b].strip():
                continue
            if broken_list[i]:
                rows.append((ids[i], files[i], numbers[i], "quoting", *[None] * 9))
                continue
            if count_list[i] != len(FIELDS):
                if not _is_header(buffer[a:b].decode("utf-8", "replace")):
                    rows.append((ids[i], files[i], numbers[i], "columns", *[None] * 9))
                continue
            cuts = [a - 1, *place_list[first_list[i] : first_list[i + 1]], b]
            fields = [_unquote(buffer[p + 1 : q]) for p, q in zip(cuts, cuts[1:])]
            if tuple(x.lower() for x in fields) == FIELDS:
                continue
            typed = _check(fields, seps[i] == ";")
            rows.append((ids[i], files[i], numbers[i], None, *typed) if typed else (ids[i], files[i], numbers[i], "value", *[None] * 9))
        columns = list(zip(*rows)) if rows else [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, types.get(n, pa.string())) for n, c in zip(names, columns)], names=names)


def _is_header(text: str) -> bool:
    return any(tuple(x.strip().strip('"').strip().lower() for x in text.split(s)) == FIELDS for s in SEPARATORS)


def parse_layouts(lines: DataFrame) -> DataFrame:
    """Every record but headers and blanks of `lines`(line_id, file_name, line_no, raw), typed or with its reason.

    The separators are one short row per file, joined by a join that Spark may split when a file is hot.
    """
    lines = lines.select("line_id", "file_name", "line_no", "raw")
    header = F.regexp_replace(F.trim("raw"), '^﻿?"?plate"?', "")
    separators = (
        lines.where((F.col("line_no") == 1) & F.lower("raw").contains("plate"))
        .select("file_name", F.substring(header, 1, 1).alias("separator"))
        .where(F.col("separator").isin(*SEPARATORS))
        .groupBy("file_name")
        .agg(F.min("separator").alias("separator"))
    )
    return lines.join(bounded(separators), "file_name", "left").select("line_id", "file_name", "line_no", "raw", "separator").mapInArrow(_parse, SCHEMA)


def rejects(lines: DataFrame) -> DataFrame:
    """One row per rejected id with the first reason that applies."""
    return parse_layouts(lines).where("reason IS NOT NULL").groupBy("line_id").agg(F.min("reason").alias("reason"))


def valid_rows(lines: DataFrame) -> DataFrame:
    """One typed row per valid id."""
    return parse_layouts(lines).where("reason IS NULL").drop("reason").dropDuplicates(["line_id"])
