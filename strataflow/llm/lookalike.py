"""One consistent form for texts that look the same but differ in their characters.

A transducer over grapheme clusters (a base character with its marks) is compiled once from public
Unicode data. Single characters map to what they look like: full-width and half-width forms, kinds of
space and hyphen, ligatures, and letters of other alphabets by the public confusables table that comes
with Spark's own ICU library; invisible characters map to nothing. From these entries and the canonical
compositions all clusters that change are worked out at compile time, look-alike bases with their accents
included. Compilation checks for conflicts: no source has two targets and no target is itself a source,
so one pass reaches the fixed point. The pass copies stretches without any source and rewrites clusters by
longest match in the compiled table.

Case, superscripts, subscripts, fractions, circled and styled letters, missing accents, dashes and
quotation marks are differences a reader can see and stay, as do joiners inside scripts that join their
letters and between emoji.

Defined cases: null and empty texts have no form and are never equal to another; texts equal in every
character are one variant; a text of any length is rewritten whole; rows repeated under one id count
once; extra columns are ignored and an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataflow.common import cut

# Look-alikes beside the confusables table, letters of the Latin alphabet's own extensions and a sign.
MORE = {"ɑ": "a", "ɡ": "g", "Ԛ": "Q", "ӏ": "l", "µ": "μ"}
# Hyphens that look like the hyphen-minus.
HYPHENS = "‐‑﹣"
# Characters without a width of their own.
INVISIBLE = "­͏؜ᅟᅠ឴឵᠋᠌᠍᠎​‌‍‎‏‪‫‬‭‮⁠⁡⁢⁣⁤⁦⁧⁨⁩⁪⁫⁬⁭⁮⁯﻿"
#: Kinds of compatibility decomposition that change the width or the joining of characters but not their look.
SAME_LOOK = ("<wide>", "<narrow>", "<noBreak>", "<compat>")
#: Blocks whose <compat> decompositions are ligatures, digraphs or letters used as numerals.
LAST = 0x30000  # no later code point has a decomposition or a combining class
COMPAT = ((0x0132, 0x0133), (0x01C4, 0x01CC), (0x01F1, 0x01F3), (0x2160, 0x217F), (0xFB00, 0xFB17))


#: What stands on both sides of a joiner that can be seen: letters of scripts that join them, and emoji.
_JOINED = "\u0620-\u08ff\u0900-\u0dff\u1000-\u109f\u1780-\u17ff\u1800-\u18af"
_JOINER = regex.compile(f"(?<=[{_JOINED}])[{INVISIBLE}]*?([\u200c\u200d])[{INVISIBLE}]*(?=[{_JOINED}])|(?<=[\\p{{Extended_Pictographic}}\\p{{Emoji_Modifier}}\ufe0f])(\u200d)(?=\\p{{Extended_Pictographic}})")


def letters(spark: SparkSession) -> dict[str, str]:
    """Letters of other alphabets and the Latin letters they look like, of the same case, from the confusables table of Spark's ICU library."""
    latin = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    others = [
        c
        for c in map(chr, range(0x250, LAST))
        if (unicodedata.category(c) in ("Lu", "Ll") or "\ua4d0" <= c <= "\ua4ff") and not unicodedata.name(c, "LATIN").startswith(("LATIN", "MATHEMATICAL")) and not unicodedata.decomposition(c)
    ]
    skeletons = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build().getSkeleton("\n".join([*latin, *others])).split("\n")
    looks: dict[tuple[str, bool], str] = {}
    for c, look in zip(latin, skeletons):
        looks.setdefault((look, c.isupper()), c)
    found = {c: looks.get((look, not c.islower())) for c, look in zip(others, skeletons[len(latin) :])}
    return {c: t for c, t in found.items() if t} | MORE


def entries(lookalikes: dict[str, str]) -> dict[str, str]:
    """Single characters and what they look like, in decomposed form."""
    out: dict[str, str] = {c: "" for c in INVISIBLE}
    out |= {c: "-" for c in HYPHENS} | lookalikes
    for code in range(0x80, LAST):
        char = chr(code)
        if 0xD800 <= code < 0xE000 or char in out:
            continue
        if unicodedata.category(char) == "Zs":
            out[char] = " "
            continue
        kind = unicodedata.decomposition(char).partition(" ")[0]
        if kind in SAME_LOOK[:3] or kind == SAME_LOOK[3] and any(a <= code <= b for a, b in COMPAT):
            out[char] = unicodedata.normalize("NFKD", char)
    return out


def compile_entries(single: dict[str, str]) -> dict[str, str]:
    """Close the entries under each other and refuse conflicts."""
    closed = {}
    for source, target in single.items():
        for _ in range(4):
            step = "".join(single.get(c, c) for c in unicodedata.normalize("NFD", target))
            if step == target:
                break
            target = step
        closed[source] = target
    for source, target in closed.items():
        if any(c in closed and closed[c] != c for c in target):
            raise ValueError(f"conflict: {source!r} maps to {target!r}, which is mapped itself")
    return closed


class Transducer:
    """One pass over the grapheme clusters of a text."""

    def __init__(self, lookalikes: dict[str, str]) -> None:
        single = compile_entries(entries(lookalikes))
        fixed = {c: t for c, t in single.items() if t != c}
        down = {c: unicodedata.normalize("NFD", c) for code in range(0x80, LAST) if not 0xD800 <= code < 0xE000 for c in [chr(code)]}
        #: Every character whose full decomposition, with its parts replaced, differs from it.
        self.parts = {c: t for c, d in down.items() if (t := "".join(single.get(x, x) for x in d)) != c}
        self.order = {c: k for code in range(0x300, LAST) if (k := unicodedata.combining(chr(code))) for c in [chr(code)]}
        # Marks join the cluster of the character before them, also half-width voicing marks and vowels and finals of Hangul.
        self.marks = {c for c in down if c >= "\u0300" and unicodedata.combining(single.get(c, c)[:1] or "a")} | {chr(c) for c in range(0x1161, 0x1200)}
        #: Compiled: decomposed clusters and their composed form; no source of an entry is among the parts.
        self.clusters = {d: c for c, d in down.items() if d != c and unicodedata.normalize("NFC", d) == c and not any(x in fixed for x in d)}
        self.longest = max(map(len, self.clusters))
        self.marks |= {x for d in self.clusters for x in d[1:]}
        # Characters that alone already change: entries, and letters whose decomposition holds one or has no stable form.
        changing = set(fixed)
        changing |= {c for c, d in down.items() if d != c and not "\uac00" <= c < "\ud7a4" and (unicodedata.normalize("NFC", c) != c or any(x in fixed for x in d))}
        self.changing = frozenset(changing | self.marks)
        self.table = {ord(c): self._compose(c) for c in changing}
        # Look-alike bases with the marks that the base they look like composes with.
        sources: dict[str, list[str]] = {}
        for c, t in fixed.items():
            sources.setdefault(t, []).append(c)
        self.whole = {c + d[1:]: form for d, form in self.clusters.items() for c in [d[0], *sources.get(d[0], [])]}
        marks = self._ranges("".join(self.marks))
        starts = self._ranges("".join(sorted(changing)))
        hidden = self._ranges("".join(sorted(c for c, t in single.items() if not t)))
        # A cluster to rewrite: any base with marks (invisible characters between them drop out), or a changing character.
        self.find = regex.compile(f"[^{marks}{hidden}](?:[{hidden}]*[{marks}])+|[{starts}]|[{marks}](?:[{hidden}]*[{marks}])*")
        self.memo = functools.lru_cache(maxsize=100_000)(self.cluster)

    @staticmethod
    def _ranges(chars: str) -> str:
        out, codes = [], sorted(map(ord, set(chars)))
        start = last = None
        for code in [*codes, None]:
            if start is not None and code != last + 1:
                out.append(f"\\U{start:08x}-\\U{last:08x}")
                start = None
            if start is None:
                start = code
            last = code
        return "".join(out)

    def _compose(self, text: str) -> str:
        """Replace the parts, put runs of marks in canonical order and take the longest compiled clusters."""
        flat = "".join([self.parts.get(c, c) for c in text])
        ordered, run = [], []
        for c in [*flat, ""]:
            if c in self.order:
                run.append(c)
                continue
            ordered += sorted(run, key=self.order.__getitem__)
            run = []
            ordered.append(c)
        flat, out, i = "".join(ordered), [], 0
        while i < len(flat):
            size = next((k for k in range(min(self.longest, len(flat) - i), 1, -1) if flat[i : i + k] in self.clusters), 1)
            out.append(self.clusters.get(flat[i : i + size], flat[i]))
            i += size
        return "".join(out)

    def cluster(self, text: str) -> str:
        """The consistent form of one cluster: by the compiled table, else by its compiled parts."""
        form = self.whole.get(text)
        return self._compose(text) if form is None else form

    def __call__(self, text: str) -> str:
        if text.isascii():
            return text
        present = self.changing.intersection(text)
        if not present:
            return text
        if "\u200c" in present or "\u200d" in present:
            pieces = [p for p in _JOINER.split(text) if p is not None]
            return "".join([p if p in ("\u200c", "\u200d") else self._rewrite(p, present) for p in pieces])
        return self._rewrite(text, present)

    def _rewrite(self, text: str, present: frozenset) -> str:
        if present.isdisjoint(self.marks):
            return text.translate(self.table)
        return self.find.sub(lambda m: self.memo(m[0]), text)


@functools.lru_cache(maxsize=2)
def _compiled(pairs: tuple[tuple[str, str], ...]) -> Transducer:
    return Transducer(dict(pairs))


def transducer(lookalikes: dict[str, str]) -> Transducer:
    """The compiled transducer, kept between the tasks of a worker."""
    return _compiled(tuple(sorted(lookalikes.items())))


def consistent(documents: DataFrame) -> DataFrame:
    """`doc_id` and the text's consistent form (null for null)."""
    lookalikes = letters(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from strataflow.llm.lookalike import transducer as shared  # the module's own state

        form = shared(lookalikes)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([form(t) if t is not None else None for t in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "form"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, form string")


def fingerprints(documents: DataFrame) -> DataFrame:
    """Per non-empty text the 128-bit digests of its consistent form (`look`) and of its characters (`raw`)."""
    lookalikes = letters(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from strataflow.llm.lookalike import transducer as shared

        form = shared(lookalikes)
        digest = lambda t: hashlib.blake2b(t.encode(), digest_size=16).digest()
        for batch in batches:
            ids, looks, raws = [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not text:
                    continue
                look = form(text)
                raw = digest(text)
                ids.append(doc_id)
                raws.append(raw)
                looks.append(raw if look is text or look == text else digest(look))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(looks, pa.binary()), pa.array(raws, pa.binary())], names=["doc_id", "look", "raw"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, look binary, raw binary")


def _mixed(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The digests of the documents whose form has several variants, and those forms' variants with their counts."""
    marks = cut(fingerprints(documents))  # one pass over the corpus
    variants = marks.where("doc_id IS NOT NULL").distinct().groupBy("look", "raw").agg(F.count("*").alias("n"), F.min("doc_id").alias("variant"))
    several = variants.groupBy("look").agg(F.count("*").alias("variants"), F.sum("n").alias("documents"), F.min("variant").alias("class")).where("variants > 1")
    return marks.join(several.select("look"), "look", "left_semi").where("doc_id IS NOT NULL").distinct(), variants.join(several, "look")


def equal_looks(documents: DataFrame) -> DataFrame:
    """Pairs of documents (smaller id first) whose texts look the same and differ in characters.

    Only digests are shuffled. Forms with a single variant are dropped by a pre-aggregated count before any
    pair is made, and pairs join the members of one variant with the other variants only. Where variants
    have many copies, `classes` holds the same links in one row a document.
    """
    members = _mixed(documents)[0]
    a, b = members.alias("a"), members.alias("b")
    pairs = a.join(b, (F.col("a.look") == F.col("b.look")) & (F.col("a.raw") != F.col("b.raw")) & (F.col("a.doc_id") < F.col("b.doc_id")))
    return pairs.select(F.col("a.doc_id").alias("doc_id_a"), F.col("b.doc_id").alias("doc_id_b"))


def classes(documents: DataFrame) -> DataFrame:
    """One row per document of a form with several variants: `doc_id`, its `class` (the form's smallest id), its `variant` (the smallest id with the same characters), and its `links` to documents of other variants."""
    members, variants = _mixed(documents)
    return members.join(variants, ["look", "raw"]).select("doc_id", "class", "variant", (F.col("documents") - F.col("n")).alias("links"))
