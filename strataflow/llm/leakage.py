"""Evaluation passages that occur, fully or partly, in a corpus.

Template canonicalisation: every word of the items and of the corpus gets a type. Numbers, units and names
become typed placeholders, all other words of the items stay as they are. A name is a word that the items
write with a capital inside a sentence and never without; a word of the corpus that no item has counts as
a name if it has a capital or its script knows none, and else fits no template. Windows of twelve
successive template words are hashed and joined with the windows of the items; then the slots are
checked. If every slot holds the item's own value, the window is verbatim; if each value of the item is
replaced by one and the same other value throughout, the question was re-parameterised.

The items are a stated query set. Their passages are cut into overlapping pieces of bounded length and
taken in blocks of a bounded number of pieces. Only a block's vocabulary and the sorted hashes of its
windows are sent to the tasks, so only windows of the corpus that match some template are joined and
shuffled; the items' windows themselves are made by Spark.

Words are runs of letters and digits; case, punctuation, white space, wiki marks, tags and comments are
ignored. What stands between "<" and ">" is a tag only if it is written like one, so prose with
comparison signs stays whole.

Defined cases: a null text or passage and one of fewer than twelve words hold no window; repeated rows
give one result; windows with fewer than three literal words are hashed with their slots, so that a run
of names matches only itself; extra columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WINDOW = 12
#: Literal words that a template window needs; below this its slots count as part of the template.
LITERALS = 3
#: Words of a piece of a passage and pieces of a block; they bound what is sent to the tasks.
PIECE, BLOCK = 4096, 2000
# Units of measurement.
UNITS = frozenset("km m cm mm l ml µl kg g mg µg h min s nm µm mm mol °c percent litres liter litros metres mètres minuten minutes minutos".split())
NUMBER, UNIT, NAME, OTHER = 0, 1, 2, 3

_TAG = re.compile(r"""</?[^\W\d_][\w:.-]*(?:\s+[\w:.-]+\s*=\s*(?:"[^"<>]*"|'[^'<>]*'|[^\s"'<>=]+))*\s*/?>|<!--[^<>]*-->""")
_WORD = re.compile(r"[^\W_]+")
_ENDS = re.compile(r"[.!?:;…。！？][^\w]*$")
_POWERS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(WINDOW)], np.uint64)


def raw_words(text: str) -> list[str]:
    """The words as they are written."""
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "İ" in text:
        text = text.replace("İ", "İ".lower())  # its lower case holds a mark, which is no letter
    return _WORD.findall(text)


def words_of(text: str) -> list[str]:
    return [w.lower() for w in raw_words(text)]


def kind_of(word: str) -> int | None:
    """NUMBER or UNIT, None for what only its use can tell."""
    return NUMBER if word[0].isdigit() or word.isnumeric() else UNIT if word in UNITS else None


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread small numbers over 64 bits."""
    x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _roll(x: np.ndarray) -> np.ndarray:
    n = len(x) - WINDOW + 1
    out = np.zeros(max(n, 0), np.uint64)
    for k in range(WINDOW if n > 0 else 0):
        out += x[k : k + n] * _POWERS[k]
    return out


class _Codes(dict):
    """Written word -> its number among the items' words (from 1), or minus its kind; worked out once a word."""

    def __init__(self, own: dict[str, int]):
        super().__init__()
        self.own = own

    def __missing__(self, raw: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        word = raw.lower()
        code = self.own.get(word)
        if code is None:
            kind = kind_of(word)
            code = -(kind if kind is not None else NAME if raw != word or word == raw.upper() else OTHER)
        self[raw] = code
        return code


class Templates:
    """The typed vocabulary of one block of items (word -> kind, OTHER for literals) and, once known, its windows' hashes."""

    def __init__(self, vocabulary: dict[str, int]):
        self.own = {w: k + 1 for k, w in enumerate(sorted(vocabulary))}
        self.symbol = np.array([0, *[k + 10 if vocabulary[w] == OTHER else vocabulary[w] for w, k in self.own.items()]], np.int64)
        self.hashes = self.slot_hashes = np.zeros(0, np.int64)
        self.codes = _Codes(self.own)

    def __getstate__(self):
        return {**self.__dict__, "codes": _Codes(self.own)}

    def hashed(self, texts: list[list[str]]):
        """Place in the text, template hash, slot hash and number of the text of all windows; slot hash 0 where a word is none of the items'.

        Also all words in one list, the place of each window in it, and whether each word is a slot.
        """
        flat = [w for ws in texts for w in ws]
        if len(flat) < WINDOW:
            return (np.zeros(0, np.int64),) * 4 + (flat, np.zeros(0, np.int64), np.zeros(0, bool))
        own = np.fromiter(map(self.codes.__getitem__, flat), np.int64, len(flat))
        known = own > 0
        symbol = np.where(known, self.symbol[np.maximum(own, 0)], -own)
        template, slots = _roll(_mix(symbol)), _roll(_mix(own + (1 << 40)))
        ahead = lambda x: np.concatenate([[0], np.cumsum(x)])
        literals, unknown = ahead(symbol > OTHER), ahead(~known)
        n = len(template)
        few = literals[WINDOW:] - literals[:n] < LITERALS
        template = np.where(few, template ^ (slots * np.uint64(3)), template).view(np.int64)
        slots = np.where(unknown[WINDOW:] - unknown[:n] > 0, np.uint64(0), slots).view(np.int64)
        lengths = np.array([len(ws) for ws in texts])
        owner = np.repeat(np.arange(len(texts)), lengths)
        at = np.flatnonzero(owner[:n] == owner[WINDOW - 1 :])
        return at - (np.cumsum(lengths) - lengths)[owner[at]], template[at], slots[at], owner[at], flat, at, symbol <= OTHER

    def rows(self, texts: list[list[str]], keep) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[list[str]]]:
        """Place, template, slot hash, number of the text and slots of the windows that `keep(template, slot hash)` takes."""
        place, template, slots, owner, flat, at, slot = self.hashed(texts)
        hit = keep(template, slots)
        place, template, slots, owner, at = place[hit], template[hit], slots[hit], owner[hit], at[hit]
        values = [[flat[i].lower() for i in range(k, k + WINDOW) if slot[i]] for k in at.tolist()]
        return place, template, slots, owner, values


def _in(hashes: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(hashes):
        return np.zeros(len(values), bool)
    return hashes[np.minimum(np.searchsorted(hashes, values), len(hashes) - 1)] == values


PIECES = "item_id long, part long, start long, words array<string>"
WINDOWS = "template long, slot_hash long, slots array<string>"


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Passages of any length as pieces of at most PIECE words that overlap by a window less one word."""
    for batch in batches:
        rows = []
        for item, part, passage in zip(*(c.to_pylist() for c in batch.columns)):
            words = raw_words(passage)
            rows += [(item, part, k, words[k : k + PIECE]) for k in range(0, max(len(words) - WINDOW + 1, 1), PIECE - WINDOW + 1)]
        columns = list(zip(*rows)) if rows else [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string())])], names=["item_id", "part", "start", "words"])


def _uses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each word of the passages is written with a capital inside a sentence, and how often without one."""
    for batch in batches:
        rows: dict[str, list[int]] = {}
        for passage in batch.column(0).to_pylist():
            text = _TAG.sub(" ", passage)
            for m in _WORD.finditer(text):
                raw = m[0]
                use = rows.setdefault(raw.lower(), [0, 0])
                if raw == raw.lower():
                    use[1] += raw != raw.upper()
                elif m.start() and not _ENDS.search(text[max(m.start() - 8, 0) : m.start()]):
                    use[0] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(rows)), *[pa.array([u[k] for u in rows.values()], pa.int64()) for k in (0, 1)]], names=["word", "capital", "small"])


def _blocks(items: DataFrame) -> Iterator[tuple[Templates, DataFrame]]:
    """Each block's vocabulary with the hashes of its windows, and the windows: `item_id`, `part`, `item_place` and WINDOWS."""
    kept = items.where("item_id IS NOT NULL AND passage IS NOT NULL").select("item_id", F.xxhash64("passage").alias("part"), "passage").distinct()
    names = kept.select("passage").mapInArrow(_uses, "word string, capital long, small long").groupBy("word").agg(F.sum("capital").alias("capital"), F.sum("small").alias("small")).where("capital > 0 AND small = 0")
    pieces = kept.mapInArrow(_pieces, PIECES)
    number = -(-pieces.count() // BLOCK)
    for k in range(number):
        block = pieces if number == 1 else pieces.where(F.pmod(F.xxhash64("item_id", "part", "start"), F.lit(number)) == k)
        words = block.select(F.explode("words").alias("raw")).select(F.lower("raw").alias("word"), "raw").distinct().join(names, "word", "left").select("raw", F.col("capital").isNotNull().alias("name"))
        vocabulary = {}
        for r in words.toLocalIterator():  # bounded by PIECE and BLOCK
            word = r.raw.lower()
            kind = kind_of(word)
            vocabulary[word] = kind if kind is not None else NAME if r.name else OTHER
        templates = Templates(vocabulary)
        windows = block.mapInArrow(_windows_of(items.sparkSession.sparkContext.broadcast(templates)), f"item_id long, part long, item_place long, {WINDOWS}")
        hashes = windows.select("template", "slot_hash").distinct().toArrow()  # as many as a block has words at most
        templates.hashes, templates.slot_hashes = (np.unique(hashes.column(c).to_numpy()) for c in ("template", "slot_hash"))
        yield templates, windows


def _windows_of(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            item, part, start = (batch.column(c).to_numpy() for c in (0, 1, 2))
            place, template, slot_hash, owner, slots = model.rows(batch.column(3).to_pylist(), lambda t, _: np.ones(len(t), bool))
            arrays = [pa.array(item[owner]), pa.array(part[owner]), pa.array(start[owner] + place), pa.array(template), pa.array(slot_hash), pa.array(slots, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["item_id", "part", "item_place", "template", "slot_hash", "slots"])

    return run


def _matches(documents: DataFrame, templates: Templates, verbatim: bool) -> DataFrame:
    """Windows of the documents whose template occurs in the items; with `verbatim` only those whose slots also occur in the items."""
    shared = documents.sparkSession.sparkContext.broadcast(templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from strataflow.llm.leakage import _in as within
        from strataflow.llm.leakage import raw_words as words

        model = shared.value
        keep = lambda t, s: within(model.hashes, t) & (within(model.slot_hashes, s) if verbatim else True)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            place, template, slot_hash, owner, slots = model.rows([words(t) if t else [] for t in batch.column(1).to_pylist()], keep)
            arrays = [pa.array([ids[k] for k in owner.tolist()], pa.int64()), pa.array(place), pa.array(template), pa.array(slot_hash), pa.array(slots, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "place", "template", "slot_hash", "slots"])

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id long, place long, {WINDOWS}")


def _union(parts: list[DataFrame], spark, schema: str) -> DataFrame:
    return reduce(DataFrame.unionByName, parts).distinct() if parts else spark.createDataFrame([], schema)


def leaked(documents: DataFrame, items: DataFrame) -> DataFrame:
    """`doc_id` and `item_id` of every document that holds at least twelve successive words of an item's passage.

    A window of the document is one of the item's if it has the item's template and the check of the slots finds the item's own values in all of them.
    """
    parts = []
    for templates, windows in _blocks(items):
        found = _matches(documents, templates, verbatim=True).select("doc_id", "template", "slot_hash", F.col("slots").alias("new")).distinct()
        own = windows.select("item_id", "template", "slot_hash", F.col("slots").alias("old")).distinct()
        parts.append(found.join(own, ["template", "slot_hash"]).where("new = old").select("doc_id", "item_id"))
    return _union(parts, documents.sparkSession, "doc_id long, item_id long")


def _copies(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Runs of successive windows that an item's template matches and in which each value of the item stands for one value: `doc_id`, `start`, `item_id`, `changed`.

    A run has one offset between its places and the item's, so it is no longer than the passage; 0 `changed` slots are a verbatim run.
    """
    run = ["doc_id", "item_id", "part", "offset"]
    parts = []
    for templates, windows in _blocks(items):
        found = _matches(documents, templates, verbatim=False).select("doc_id", "place", "template", F.col("slots").alias("new"))
        own = windows.select("item_id", "part", "item_place", "template", F.col("slots").alias("old")).distinct()
        pairs = found.join(own, "template").select("doc_id", "item_id", "part", (F.col("place") - F.col("item_place")).alias("offset"), "place", F.arrays_zip("new", "old").alias("slots"))
        # Rows of one run are no more than the windows of one passage; redelivered documents share their rank.
        at = F.dense_rank().over(Window.partitionBy(*run).orderBy("place"))
        placed = pairs.withColumn("start", F.col("place") - at).select(*run, "start", "place", F.explode_outer("slots").alias("s"))
        values = placed.groupBy(*run, "start", F.col("s.old").alias("old")).agg(F.min("s.new").alias("low"), F.max("s.new").alias("high"), F.min("place").alias("place"))
        parts.append(
            values.groupBy(*run, "start")
            .agg(F.count_if(F.col("low") != F.col("high")).alias("mixed"), F.count_if((F.col("low") == F.col("high")) & (F.col("low") != F.col("old"))).alias("changed"), F.min("place").alias("place"))
            .where("mixed = 0")
            .select("doc_id", F.col("place").alias("start"), "item_id", "changed")
        )
    return _union(parts, documents.sparkSession, "doc_id long, start long, item_id long, changed long")


def reparameterised_pairs(documents: DataFrame, items: DataFrame) -> DataFrame:
    """`doc_id` and each `item_id` whose question the document holds with other values, and the most `changed` slots of one copy."""
    return _copies(documents, items).where("changed > 0").groupBy("doc_id", "item_id").agg(F.max("changed").alias("changed"))


def reparameterised(documents: DataFrame, items: DataFrame) -> DataFrame:
    """As `reparameterised_pairs`, but each copy is held against the smallest item that it fits only, and none if that is verbatim."""
    smallest = _copies(documents, items).groupBy("doc_id", "start").agg(F.min(F.struct("item_id", "changed")).alias("i")).select("doc_id", "i.*")
    return smallest.where("changed > 0").groupBy("doc_id", "item_id").agg(F.max("changed").alias("changed"))
