"""FCS event files as Spark data sources.

`spark.read.format("fcs").load(folder)`: the events. A file's header and text segment give its schema (the
channels that all data sets of the path share, `channels` to choose some; `sample` is the file name, with
"#2", "#3", ... for the further data sets of a file, `event` the number in its data set). Every data set is
split into row ranges that are read by themselves. Float, double and integer data of any width (packed to
bits where that is no whole byte) and ASCII data are read, in either byte order; bits above an integer's
range are masked; log amplification and gains are undone, also of floats that hold decades.

`spark.read.format("fcs_keywords").load(folder)`: `sample`, `keyword`, `value` of all text segments.

`df.write.format("fcs").save(folder)`: FCS 3.1 files of little-endian floats, one or more per task.

Files are opened through pyarrow's file systems, so a path may be of any store that these know; a path
without a scheme is a folder that all executors share. Correlated histograms are refused with an error.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

#: Events in one input partition and in one written file.
RANGE = 1 << 20
# The keywords that hold a spillover matrix, in the order they are looked for.
SPILLOVER = ("$SPILLOVER", "SPILL", "$SPILL", "SPILLOVER", "$COMP", "COMP")


def opened(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path and not path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), os.path.abspath(unquote(urlparse(path).path) if path.startswith("file:") else path)


def _tokens(text: str, escapes: bool) -> list[str]:
    """The parts between delimiters. With `escapes` two delimiters in a row are one character of the part, from the left; else they enclose an empty part."""
    delimiter, parts, current = text[0], [], ""
    for run in re.finditer(f"({re.escape(delimiter)}+)|([^{re.escape(delimiter)}]+)", text[1:]):
        if run[2] is not None:
            current += run[2]
            continue
        many, end = len(run[1]), run.end() == len(text) - 1
        if escapes:
            kept = (many - 1) // 2 if many % 2 or end else many // 2
            current += delimiter * kept
            if many % 2 or end:
                parts.append(current)
                current = ""
        else:
            parts += [current, *[""] * (many - 1)]
            current = ""
    return [*parts, current] if current else parts


def read_text(data: bytes) -> dict[str, str]:
    """Keywords of a text segment; its first character is the delimiter, doubled inside values.

    Some writers leave values empty instead; that reading is taken if it finds more of the parameters' keywords.
    """
    text = data.decode("utf-8", "replace").rstrip("\0 \r\n")
    if not text:
        return {}

    def pairs(escapes: bool) -> dict[str, str]:
        parts = [p.strip() for p in _tokens(text, escapes)]
        return {k.upper(): v for k, v in zip(parts[::2], [*parts[1::2], ""]) if k}

    def quality(words: dict[str, str]) -> int:
        count = int(words["$PAR"]) if words.get("$PAR", "").isdigit() else 0
        return sum(f"$P{k}{c}" in words for k in range(1, count + 1) for c in "BNR")

    return max((pairs(True), pairs(False)), key=quality)  # the first of equal ones


@dataclass(frozen=True)
class Layout:
    """What is needed to read the events of one data set."""

    path: str
    sample: str
    names: tuple[str, ...]
    kinds: tuple[str, ...]  # numpy types, or the widths of packed ("b12") and ASCII ("a5", "a*") values
    log: tuple[tuple[float, float], ...]
    decades: tuple[bool, ...]  # floats that hold log10
    gain: tuple[float, ...]
    top: tuple[float, ...]
    start: int
    end: int
    events: int

    @property
    def form(self) -> str:
        return "binary" if self.kinds and self.kinds[0][0] in "<>" else "packed" if self.kinds and self.kinds[0][0] == "b" else "ascii"

    def width(self) -> int:
        """Bits of an event; 0 where values have no fixed width."""
        if self.form == "binary":
            return 8 * np.dtype(",".join(self.kinds)).itemsize if len(self.kinds) > 1 else 8 * np.dtype(self.kinds[0]).itemsize
        return 0 if "a*" in self.kinds else sum(int(k[1:]) for k in self.kinds) * (8 if self.form == "ascii" else 1)

    def raw(self, first: int, last: int) -> list[np.ndarray]:
        """The stored values of events first..last - 1, an array per channel."""
        store, path = opened(self.path)
        bits, n, size = self.width(), last - first, len(self.names)
        with store.open_input_file(path) as f:
            if not bits:
                f.seek(self.start)
                words = re.split(r"[\s,]+", f.read(self.end - self.start + 1).decode("latin-1").strip())
                return list(np.array(words[first * size : last * size], float).reshape(n, size).T)
            begin, stop = first * bits // 8, -(-last * bits // 8)
            f.seek(self.start + begin)
            data = np.frombuffer(f.read(stop - begin), np.uint8)
        if self.form == "binary":
            table = np.frombuffer(data.tobytes(), np.dtype([(f"p{k}", t) for k, t in enumerate(self.kinds)]), n)
            return [table[f"p{k}"] for k in range(size)]
        widths = [int(k[1:]) for k in self.kinds]
        ends = np.cumsum(widths)
        if self.form == "ascii":
            text = data[: n * ends[-1]].reshape(n, ends[-1])
            return [np.array([bytes(r).decode("latin-1").strip() or "nan" for r in text[:, e - w : e]], float) for w, e in zip(widths, ends)]
        stream = np.unpackbits(data)[: n * ends[-1]].reshape(n, ends[-1])
        return [stream[:, e - w : e] @ (2.0 ** np.arange(w - 1, -1, -1)) for w, e in zip(widths, ends)]

    def values(self, first: int, last: int, wanted: list[str]) -> dict[str, np.ndarray]:
        """Linear values of the wanted channels."""
        raw, out = self.raw(first, last), {}
        for name in wanted:
            k = self.names.index(name)
            integer = self.kinds[k][0] == "b" or self.kinds[k][1:2] == "u"
            x = raw[k]
            if integer and self.top[k] > 1:
                mask = (1 << int(self.top[k] - 1).bit_length()) - 1
                x = x.astype(np.uint64) & np.uint64(mask)
            x = x.astype(float)
            decades, offset = self.log[k]
            if self.decades[k]:
                x = offset / self.gain[k] * 10**x
            elif decades:
                x = offset * 10 ** (decades * x / self.top[k])
            else:
                x = x / self.gain[k]
            out[name] = x
        return out


def _segments(f) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Start, keywords and header of each data set of a file; $NEXTDATA leads from one to the next."""
    base = 0
    while True:
        f.seek(base)
        header = f.read(58)
        if not header.startswith(b"FCS"):
            raise ValueError("no FCS data set")
        begin, end = (int(header[a : a + 8]) for a in (10, 18))
        f.seek(base + begin)
        text = f.read(end - begin + 1)
        words = read_text(text)
        more, last = (int(words.get(k) or 0) for k in ("$BEGINSTEXT", "$ENDSTEXT"))
        if last > more > 0 and (more, last) != (begin, end):
            f.seek(base + more)
            extra = f.read(last - more + 1)
            extra = extra if extra[:1] == text[:1] else text[:1] + extra
            own = read_text(extra)
            if all(re.fullmatch(r"[\x20-\x7e]{1,128}", k) for k in own):
                words = own | words
        yield base, words, header
        step = int(words.get("$NEXTDATA") or 0)
        if step <= 0:
            return
        base += step


def _sample(path: str, number: int) -> str:
    return path.rsplit("/", 1)[-1] + (f"#{number + 1}" if number else "")


def read_layouts(path: str) -> list[Layout]:
    """The data sets of one file."""
    store, inner = opened(path)
    with store.open_input_file(inner) as f:
        return [_layout(path, number, base, words, header) for number, (base, words, header) in enumerate(_segments(f))]


def _layout(path: str, number: int, base: int, words: dict[str, str], header: bytes) -> Layout:
    if words.get("$MODE", "L") != "L":
        raise ValueError(f"{path}: only list mode data can be read")
    order = ">" if words.get("$BYTEORD", "1,2,3,4").replace(" ", "").startswith("4") or words.get("$BYTEORD", "") == "2,1" else "<"
    count = int(words["$PAR"])
    bits = [words[f"$P{k}B"].strip() for k in range(1, count + 1)]
    types = [words.get(f"$P{k}DATATYPE", words["$DATATYPE"]).strip().upper() for k in range(1, count + 1)]
    whole = {"8": "u1", "16": "u2", "32": "u4", "64": "u8"}
    if "A" in types:
        kinds = [f"a{b}" for b in bits]
    elif any(t == "I" and b not in whole for t, b in zip(types, bits)):
        kinds = [f"b{b}" for b in bits]
    else:
        kinds = [order + ({"F": "f4", "D": "f8"}.get(t) or whole[b]) for t, b in zip(types, bits)]
    log, gain, top = [], [], []
    for k in range(1, count + 1):
        decades, offset = (float(x) for x in words.get(f"$P{k}E", "0,0").split(","))
        log.append((decades, offset or 1.0) if decades else (0.0, 0.0))
        gain.append(float(words.get(f"$P{k}G", "1") or 1) or 1.0 if words[f"$P{k}N"].upper() != "TIME" else 1.0)
        top.append(float(words.get(f"$P{k}R", "0") or 0) or 2.0 ** int(bits[k - 1] if bits[k - 1] != "*" else 10))
    start, end = (base + int(words.get(k) or header[a : a + 8]) for k, a in (("$BEGINDATA", 26), ("$ENDDATA", 34)))
    names = tuple(words[f"$P{k}N"] for k in range(1, count + 1))
    made = Layout(path, _sample(path, number), names, tuple(kinds), tuple(log), (False,) * count, tuple(gain), tuple(top), start, end, int(words["$TOT"]))
    odd = [k for k in range(count) if log[k][0] and types[k] in "FD"]
    if not odd:
        return made
    # Rare: floats with decades in their header hold log10 if none lies above the decades, else they are linear. This needs the whole column.
    high = {k: -np.inf for k in odd}
    for a in range(0, made.events, RANGE):
        raw = made.raw(a, min(a + RANGE, made.events))
        high = {k: max(h, np.nanmax(raw[k], initial=-np.inf)) for k, h in high.items()}
    held = {k: high[k] <= log[k][0] for k in odd}
    log = [(0.0, 0.0) if k in held and not held[k] else v for k, v in enumerate(log)]
    return Layout(path, made.sample, names, made.kinds, tuple(log), tuple(held.get(k, False) for k in range(count)), made.gain, made.top, start, end, made.events)


def files_of(path: str) -> list[str]:
    store, inner = opened(path)
    if store.get_file_info(inner).is_file:
        return [path]
    found = store.get_file_info(fs.FileSelector(inner, recursive=True))
    scheme = re.match(r"[a-z0-9+]+://[^/]*|file:", path)
    front = scheme[0] if scheme and not path.startswith("file:") else ""
    return sorted(front + i.path for i in found if i.is_file and i.path.lower().endswith(".fcs"))


@dataclass
class Rows(InputPartition):
    layout: Layout
    first: int
    last: int


class FcsReader(DataSourceReader):
    def __init__(self, schema: StructType, layouts: list[Layout], rows: int):
        self.fields, self.layouts, self.rows = schema.fieldNames(), layouts, rows

    def partitions(self) -> list[Rows]:
        # Values without a fixed width are read at once; packed ranges begin at whole bytes.
        step = lambda x: max(x.events, 1) if not x.width() else self.rows if x.width() % 8 == 0 else max(self.rows // 8, 1) * 8
        return [Rows(x, a, min(a + step(x), x.events)) for x in self.layouts for a in range(0, x.events, step(x))]

    def read(self, part: Rows) -> Iterator[pa.RecordBatch]:
        x, n = part.layout, part.last - part.first
        values = x.values(part.first, part.last, [f for f in self.fields if f not in ("sample", "event")])
        values |= {"event": np.arange(part.first, part.last)}
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([x.sample] * n) if f == "sample" else pa.array(values[f]) for f in self.fields], names=self.fields)


@dataclass
class Written(WriterCommitMessage):
    paths: list[str]


class FcsWriter(DataSourceWriter):
    def __init__(self, folder: str, schema: StructType):
        self.folder, self.names = folder, [f.name for f in schema.fields]

    def write(self, rows: Iterator) -> Written:
        from pyspark import TaskContext

        store, folder = opened(self.folder)
        task, paths, block = TaskContext.get(), [], []

        def put() -> None:
            data = np.array(block, "<f4").reshape(-1, len(self.names))
            store.create_dir(folder)
            path = f"{folder}/part-{task.partitionId():05d}-{task.taskAttemptId()}-{len(paths)}.fcs"
            with store.open_output_stream(path + ".tmp") as f:
                f.write(fcs_bytes(self.names, data))
            store.move(path + ".tmp", path)
            paths.append(path)
            block.clear()

        for r in rows:
            block.append([np.nan if v is None else v for v in r])
            if len(block) == RANGE:
                put()
        if block:
            put()
        return Written(paths)

    def abort(self, messages: list) -> None:
        store, _ = opened(self.folder)
        for m in messages:
            for p in m.paths if m else []:
                if store.get_file_info(p).is_file:
                    store.delete_file(p)


def fcs_bytes(names: list[str], data: np.ndarray, more: dict[str, str] | None = None) -> bytes:
    """An FCS 3.1 file of float data, with further keywords."""
    words = {"$MODE": "L", "$DATATYPE": "F", "$BYTEORD": "1,2,3,4", "$NEXTDATA": "0", "$PAR": len(names), "$TOT": len(data), "$BEGINSTEXT": 0, "$ENDSTEXT": 0, "$BEGINANALYSIS": 0, "$ENDANALYSIS": 0}
    for k, name in enumerate(names, 1):
        top = np.nanmax(data[:, k - 1], initial=0.0) if len(data) else 0.0
        words |= {f"$P{k}N": name, f"$P{k}B": 32, f"$P{k}E": "0,0", f"$P{k}R": int(np.ceil(float(top))) + 1}
    words |= more or {}
    body = data.tobytes()
    start = 0
    for _ in range(3):  # the places depend on their own digits
        words |= {"$BEGINDATA": start, "$ENDDATA": start + len(body) - 1}
        text = ("/" + "/".join(f"{k}/{str(v).replace('/', '//')}" for k, v in words.items()) + "/").encode()
        start = 256 + len(text)
    ends = [256, 256 + len(text) - 1, start, start + len(body) - 1]
    head = "FCS3.1    " + "".join(f"{e if e < 10**8 else 0:>8}" for e in ends) + f"{0:>8}{0:>8}"
    return head.encode().ljust(256) + text + body


class FcsSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fcs"

    def _layouts(self) -> list[Layout]:
        return [x for f in files_of(self.options["path"]) for x in read_layouts(f)]

    def schema(self) -> StructType:
        layouts = self._layouts()
        names = [n for n in layouts[0].names if all(n in x.names for x in layouts)] if layouts else []
        if wanted := self.options.get("channels"):
            names = [n for n in wanted.split(",") if n in names]
        return StructType([StructField("sample", StringType()), StructField("event", LongType()), *[StructField(n, DoubleType()) for n in names]])

    def reader(self, schema: StructType) -> FcsReader:
        return FcsReader(schema, self._layouts(), int(self.options.get("rows", RANGE)))

    def writer(self, schema: StructType, overwrite: bool) -> FcsWriter:
        return FcsWriter(self.options["path"], schema)


@dataclass
class File(InputPartition):
    path: str


class KeywordReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[File]:
        return [File(f) for f in files_of(self.path)]

    def read(self, part: File) -> Iterator[tuple]:
        store, inner = opened(part.path)
        with store.open_input_file(inner) as f:
            for number, (_, words, _) in enumerate(_segments(f)):
                yield from ((_sample(part.path, number), k, v) for k, v in words.items())


class KeywordSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fcs_keywords"

    def schema(self) -> str:
        return "sample string, keyword string, value string"

    def reader(self, schema: StructType) -> KeywordReader:
        return KeywordReader(self.options["path"])


def spillover(keywords: DataFrame, sample: str = "sample") -> DataFrame:
    """The spillover matrix of each sample of a keyword table, from the first of SPILLOVER that holds one: `from_channel`, `to_channel`, `value`. Texts that are no matrix are left out."""
    rank = F.array_position(F.array(*[F.lit(k) for k in SPILLOVER]), F.upper("keyword"))
    parts = keywords.where(rank > 0).select(sample, rank.alias("_rank"), F.transform(F.split("value", ","), lambda p: F.trim(p)).alias("_p"))
    n = F.col("_p")[0].try_cast("int")
    parts = parts.withColumn("_n", n).where((F.col("_n") > 0) & (F.size("_p") >= 1 + F.col("_n") + F.col("_n") * F.col("_n")))
    numbers = F.transform(F.slice("_p", F.col("_n") + 2, F.col("_n") * F.col("_n")), lambda p: p.try_cast("double"))
    parts = parts.select(sample, "_rank", "_n", F.slice("_p", F.lit(2), F.col("_n")).alias("_c"), numbers.alias("_v")).where(F.forall("_v", lambda v: v.isNotNull()))
    best = parts.groupBy(sample).agg(F.min_by(F.struct("_n", "_c", "_v"), "_rank").alias("_b")).select(sample, "_b.*")
    cells = best.select(sample, "_n", "_c", F.posexplode("_v").alias("_k", "value"))
    return cells.select(sample, F.get("_c", F.floor(F.col("_k") / F.col("_n")).cast("int")).alias("from_channel"), F.get("_c", (F.col("_k") % F.col("_n")).cast("int")).alias("to_channel"), "value")


def acquisition(keywords: DataFrame, sample: str = "sample") -> DataFrame:
    """One row per sample of a keyword table: instrument, date, operator, events, channels, and the technology guessed from the instrument and the channels' names."""
    pick = lambda *names: F.coalesce(*[F.max(F.when(F.upper("keyword") == k, F.nullif(F.trim("value"), F.lit("")))) for k in names])
    name = F.col("keyword").rlike(r"^\$P[0-9]+N$")
    wide = keywords.groupBy(sample).agg(
        pick("$CYT").alias("instrument"), pick("$DATE").alias("date"), pick("$OP", "OPERATOR").alias("operator"), pick("$TOT").try_cast("long").alias("events"), pick("$PAR").try_cast("int").alias("channels"),
        F.count_if(name & F.col("value").rlike(r"(?i)^[A-Z]{1,2}[0-9]{2,3}Di$")).alias("_mass"), F.count_if(name & F.col("value").rlike("^(UV|IR|YG|V|B|R)[0-9]{1,2}(-[AHW])?$")).alias("_spectral"),
    )
    kind = F.when((F.col("_mass") > 0) | F.lower("instrument").rlike("cytof|helios|dvs"), "mass").when((F.col("_spectral") >= 20) | F.lower("instrument").rlike("aurora|northern lights|id7000|spectral"), "spectral").otherwise("conventional")
    return wide.withColumn("technology", kind).drop("_mass", "_spectral")
