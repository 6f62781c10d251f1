"""Text that was decoded with the wrong character encoding: find it and restore the original where it still can be.

Adjacent character pairs are counted over the distinct values of the whole corpus, so a value that many rows
share or that is delivered again counts once. A pair's mutual information is that of its joint share and
the shares of its two characters. Systematic garbling is regular in itself, so pairs that a wrong decoding
explains are left out of the joint counts: those that are bytes of one UTF-8 character under a wrong
decoder, and those that an inverse mapping turns into a pair or character more than IMAGE times as frequent.
Garbled pairs then share no information, and maximum-scoring segments of such pairs isolate the improbable
runs of each word. Inverse mappings (encode with a wrong decoder, decode with a likely original encoding,
twice if need be) are tested inside those runs only; most words hold none and are left alone. A word is
garbled if an inverse of its runs reads as clearly more probable text of this corpus.

Characters that only a wrong decoding leaves behind (the replacement character, C1 controls) mark a
value as garbled too, also where the original is lost.

Exact pair counts stay in Spark, where the images are joined; only tables hashed to a fixed size are sent
to the tasks.

Defined cases: null maps, null and empty values hold nothing; values of ASCII alone are never garbled;
redelivered rows give one result; values of any length are searched whole; empty tables give an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import codecs
import functools
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataflow.common import cut

# Encodings that texts are wrongly read in, and those they may really have.
DECODERS = ("cp1252", "latin-1", "cp1250", "cp1251", "koi8-r", "mac_roman", "cp437", "cp850", "cp866", "cp1253", "iso8859-2", "iso8859-5", "iso8859-7", "shift_jis", "euc_jp")
ORIGINALS = ("utf-8", "cp1252", "cp1250", "cp1251", "koi8-r", "cp1253", "shift_jis", "euc_jp")
MULTIBYTE = {"utf-8", "shift_jis", "euc_jp"}
TWO_BYTES = {"shift_jis"}
#: Buckets of the pair and character tables (4 bytes each).
PAIR_BUCKETS, CHAR_BUCKETS = 1 << 20, 1 << 16
#: A pair is improbable below this mutual information (nats).
INFORMATION = -1.0
#: Shares added to a pair's and to a character's, so that what occurs nowhere is improbable at every size of corpus.
PAIR_SHARE, CHAR_SHARE = 1e-7, 1e-3
#: An inverse mapping explains a pair if its image is more than this many times as frequent.
IMAGE = 3
#: Gain in log probability that an inverse needs: strict multi-byte decodings, single-byte ones, and words without a letter.
GAIN_STRICT, GAIN, GAIN_SYMBOL = 0.5, 3.0, 8.0
#: What a second mapping must gain beyond the best single one, unless the text was read wrongly as UTF-8 twice.
GAIN_SECOND = 4.0
#: What a word may lose by the mapping of its garbled neighbours.
FOLLOWED = 3.0
#: The gain that a text with lost bytes needs.
GAIN_LOST = 5.0
#: What each of up to two complete multi-byte characters beside the lost ones counts.
COMPLETE = 6.0

_LEFT_BEHIND = regex.compile("[\u0080-\u009f�]").search
_LETTER = regex.compile(r"[^\W\d_]").search
_MULTIPLIER, _WORD = np.uint64(0x9E3779B97F4A7C15), (1 << 64) - 1


def _buckets(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    mixed = ((left.astype(np.uint64) << np.uint64(21)) + right.astype(np.uint64)) * _MULTIPLIER
    return ((mixed ^ mixed >> np.uint64(32)) * _MULTIPLIER >> np.uint64(44)).astype(np.int64) & (PAIR_BUCKETS - 1)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pair and character counts of a batch of values; characters have negative keys."""
    for batch in batches:
        codes = _codes(" " + "  ".join(batch.column(0).to_pylist()) + " ").astype(np.int64)
        pairs, n = np.unique((codes[:-1] << 21) + codes[1:], return_counts=True)
        chars, m = np.unique(codes[:-1], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[pairs, -1 - chars]), pa.array(np.r_[n, m].astype(np.int64))], names=["key", "n"])


def pair_counts(samples: DataFrame) -> DataFrame:
    """`key`, `n` of each adjacent pair and of each character over all distinct keyword values; it grows with the alphabet only."""
    values = samples.select(F.explode(F.map_values("keywords")).alias("value")).where("value <> ''").distinct()
    return values.mapInArrow(_count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _key(text: str) -> int | None:
    """Key of a pair or of a single character."""
    return -1 - ord(text) if len(text) == 1 else (ord(text[0]) << 21) + ord(text[1]) if len(text) == 2 else None


def _images(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per pair beyond ASCII the keys that inverse mappings turn it into; null where it is bytes of one UTF-8 character."""
    encoders = [(name, _codec(name)) for name in DECODERS]
    for batch in batches:
        keys, images = [], []
        for key in batch.column(0).to_pylist():
            pair = chr(key >> 21) + chr(key & (1 << 21) - 1)
            found: set[int | None] = set()
            for wrong, encode in encoders if not pair.isascii() else ():
                try:
                    raw = encode(pair)
                except (UnicodeEncodeError, KeyError):
                    continue
                if len(raw) == 2 and 0x80 <= raw[1] < 0xC0 and (0xC2 <= raw[0] < 0xF5 or raw[0] < 0xC0 and raw[0] >= 0x80 and wrong in ("cp1252", "latin-1")):
                    found.add(None)
                for original in ORIGINALS if " " not in pair else ():
                    if original != wrong:
                        try:
                            image = _key(raw.decode(original))
                        except UnicodeDecodeError:
                            continue
                        if image not in (None, key):
                            found.add(image)
            keys += [key] * len(found)
            images += found
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(images, pa.int64())], names=["key", "image"])


def corpus_tables(samples: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of pairs, of characters, and of pairs that no wrong decoding explains, hashed to PAIR_BUCKETS and CHAR_BUCKETS."""
    counts = cut(pair_counts(samples))
    images = counts.where("key >= 0").select("key").mapInArrow(_images, "key long, image long")
    found = images.join(counts.select(F.col("key").alias("image"), F.col("n").alias("other")), "image", "left")
    best = found.groupBy("key").agg(F.max("other").alias("other"), F.max(F.col("image").isNull()).alias("bytes"))
    explained = F.coalesce(F.col("bytes"), F.lit(False)) | F.coalesce(F.col("other") > IMAGE * F.col("n"), F.lit(False))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column(0).to_numpy()
            bucket = np.where(key >= 0, _buckets(key >> 21, key & (1 << 21) - 1), -1 - (-1 - key) % CHAR_BUCKETS)
            yield pa.RecordBatch.from_arrays([pa.array(bucket), batch.column(1), batch.column(2)], names=["bucket", "n", "kept"])

    rows = counts.join(best, "key", "left").select("key", "n", F.when(explained, 0).otherwise(F.col("n")).alias("kept"))
    table = rows.mapInArrow(hashed, "bucket long, n long, kept long").groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("kept").alias("kept")).toArrow()  # at most PAIR_BUCKETS + CHAR_BUCKETS rows
    bucket, n, unexplained = (table.column(c).to_numpy() for c in ("bucket", "n", "kept"))
    pairs, kept, chars = np.zeros(PAIR_BUCKETS, np.float32), np.zeros(PAIR_BUCKETS, np.float32), np.zeros(CHAR_BUCKETS, np.float32)
    own = bucket >= 0
    pairs[bucket[own]], kept[bucket[own]] = n[own], unexplained[own]
    chars[-1 - bucket[~own]] = n[~own]
    return pairs, chars, kept


def _codec(name: str):
    """Encoder of a wrong decoder: bytes that it leaves undefined stand for themselves, as in practice."""
    if name in MULTIBYTE:
        return lambda text: text.encode(name)
    table = "".join(_decoded(name, b) for b in range(256))
    mapping = codecs.charmap_build(table)
    return lambda text: codecs.charmap_encode(text, "strict", mapping)[0]


def _decoded(name: str, byte: int) -> str:
    try:
        return bytes([byte]).decode(name)
    except UnicodeDecodeError:
        return chr(byte)


class _Pairs(dict):
    """A number per pair, worked out once."""

    def __init__(self, of):
        super().__init__()
        self.of = of

    def __missing__(self, pair: str) -> float:
        if len(self) > 500_000:
            self.clear()
        a, b = ord(pair[0]), ord(pair[1])
        mixed = ((a << 21) + b) * int(_MULTIPLIER) & _WORD
        bucket = ((mixed ^ mixed >> 32) * int(_MULTIPLIER) & _WORD) >> 44 & (PAIR_BUCKETS - 1)
        value = self[pair] = float(self.of(bucket, a % CHAR_BUCKETS, b % CHAR_BUCKETS))
        return value


class Mender:
    """Scores and inverse mappings under one corpus' counts; `kept` are the pair counts that no wrong decoding explains."""

    def __init__(self, pairs: np.ndarray, chars: np.ndarray, kept: np.ndarray | None = None):
        self.pairs, self.chars, self.kept = pairs, chars, pairs if kept is None else kept
        self.total = float(max(pairs.sum(), 1))
        kinds = float(max((chars > 0).sum(), 1))
        self.encoders = [(name, _codec(name)) for name in DECODERS]
        self.by_name = dict(self.encoders)
        # log p(b|a): the pair's mutual information and its second character's log frequency.
        self.known = _Pairs(lambda pair, a, b: math.log(self.pairs[pair] + 0.05) - math.log(self.chars[a] + 0.2 * kinds))
        self.information = _Pairs(self._information)
        self.word = functools.lru_cache(maxsize=200_000)(self._word)
        self.inverses = functools.lru_cache(maxsize=50_000)(self._inverses)

    def _information(self, pair: int, a: int, b: int) -> float:
        share = lambda c: float(self.chars[c]) / self.total + CHAR_SHARE
        return math.log((float(self.kept[pair]) / self.total + PAIR_SHARE) / (share(a) * share(b)))

    def score(self, text: str) -> float:
        """Log probability: the sum of each pair's mutual information and its second character's log frequency."""
        padded, known = f" {text} ", self.known
        return sum([known[padded[i : i + 2]] for i in range(len(padded) - 1)])

    def above(self, text: str, least: float) -> float | None:
        """The score if it is above `least`. No pair adds to it, so the rest need not be read once it falls below."""
        before, known, total = " ", self.known, 0.0
        for c in text:
            total += known[before + c]
            if total <= least:
                return None
            before = c
        total += known[before + " "]
        return total if total > least else None

    def improbable(self, text: str) -> list[float]:
        """How far the mutual information of each adjacent pair (with a space at either end) lies below INFORMATION."""
        padded, information = f" {text} ", self.information
        return [INFORMATION - information[padded[i : i + 2]] for i in range(len(padded) - 1)]

    def runs(self, text: str) -> list[tuple[int, int]]:
        """Maximum-scoring segments of improbable pairs, as places of the text."""
        # All maximal segments: each keeps the sums before and behind it; a new one swallows those it can extend.
        kept: list[tuple[int, int, float, float]] = []
        total = 0.0
        for i, s in enumerate(self.improbable(text)):
            before, total = total, total + s
            if s <= 0:
                continue
            start, end, low, high = i, i + 1, before, total
            while True:
                j = next((j for j in range(len(kept) - 1, -1, -1) if kept[j][2] < low), None)
                if j is None or kept[j][3] >= high:
                    break
                start, low = kept[j][0], kept[j][2]
                del kept[j:]
            kept.append((start, end, low, high))
        return [(max(a - 1, 0), min(b, len(text))) for a, b, _, _ in kept]

    def piece(self, word: str) -> tuple[int, int] | None:
        """From the first to the last run beyond ASCII, each widened to the whole stretch that it touches: bytes of one character cannot be parted."""
        runs = [(a, b) for a, b in self.runs(word) if not word[a:b].isascii()]
        if not runs:
            return None
        a, b = runs[0][0], runs[-1][1]
        while word[a].isascii():
            a += 1
        while word[b - 1].isascii():
            b -= 1
        while a and not word[a - 1].isascii():
            a -= 1
        while b < len(word) and not word[b].isascii():
            b += 1
        return a, b

    def _inverses(self, piece: str) -> list[tuple[str, str, str]]:
        """(wrong decoder, original encoding, text) of each inverse mapping that exists. Many words share a run, so they are kept."""
        found = []
        for wrong, encode in self.encoders:
            try:
                raw = encode(piece)
            except (UnicodeEncodeError, KeyError):
                continue
            for original in ORIGINALS:
                if original != wrong:
                    try:
                        back = raw.decode(original)
                    except UnicodeDecodeError:
                        continue
                    if back != piece:
                        found.append((wrong, original, back))
        return found

    def _word(self, word: str) -> tuple[str, list[tuple[str, str]]] | None:
        """The original of a garbled word and the mappings that lead to it, None for any other."""
        place = self.piece(word)
        if place is None:
            return None
        base, best, found = self.score(word), 0.0, None
        # The last byte of a two-byte character may be an ASCII letter behind the run.
        for a, b in {place, (place[0], min(place[1] + 1, len(word)))}:
            head, tail, whole = word[:a], word[b:], (a, b) == place
            tried = {word[a:b]}
            level: list[tuple[str, list]] = [(word[a:b], [])]
            for depth in (1, 2):
                after = []
                for text, path in level:
                    for wrong, original, back in self.inverses(text):
                        if back in tried or not whole and original not in TWO_BYTES:
                            continue
                        tried.add(back)
                        step = [*path, (wrong, original)]
                        mended = head + back + tail
                        score = self.above(mended, base)
                        gain = 0.0 if score is None else score - base
                        # A second mapping has more to undo after UTF-8, or where the first already made the text more probable.
                        if depth == 1 and not back.isascii() and (original == "utf-8" or gain > 0):
                            after.append((back, step))
                        if not gain or _LEFT_BEHIND(back):
                            continue
                        need = GAIN_STRICT if original in MULTIBYTE else GAIN if _LETTER(word) and _LETTER(mended) else GAIN_SYMBOL
                        if gain > need and gain > best + (GAIN_SECOND if found and len(step) > len(found[1]) and {o for _, o in step} != {"utf-8"} else 0.0):
                            best, found = gain, (mended, step)
                level = after
        if self.score_lost(word) - base > best + GAIN_LOST:
            return word, []
        return found

    def score_lost(self, word: str) -> float:
        """Score of the most probable text whose UTF-8 bytes were read in a single-byte encoding and lost some of 0x80 to 0x9F."""
        best = -math.inf
        for name, encode in self.encoders:
            if name in MULTIBYTE:
                continue
            try:
                raw = encode(word)
            except UnicodeEncodeError:
                continue
            text, i, lost, complete = "", 0, 0, 0
            while i < len(raw):
                lead = raw[i]
                size = 1 if lead < 0x80 else 2 if 0xC2 <= lead < 0xE0 else 3 if 0xE0 <= lead < 0xF0 else 0
                have = 1
                while have < size and i + have < len(raw) and 0x80 <= raw[i + have] < 0xC0:
                    have += 1
                if not size or have < size - 1 and not complete:
                    break
                body = raw[i : i + have]
                if have < size - 1:  # all but the lead is lost
                    lost += 1
                elif have < size:
                    lost += 1
                    options = {body[:k] + bytes([c]) + body[k:] for k in range(1, have + 1) for c in range(0x80, 0xA0)}
                    following = raw[i + have : i + have + 1]
                    ahead = following.decode("latin-1") if following < b"\x80" else ""
                    text = max((text + o.decode("utf-8", "ignore") for o in sorted(options)), key=lambda t: (len(t), self.score(t[-2:] + ahead)))  # noqa: B023
                else:
                    text += body.decode("utf-8", "replace")
                    complete += size > 1
                i += have
            else:
                if lost:
                    best = max(best, self.score(text) + COMPLETE * min(complete, 2))
        return best

    def follow(self, word: str, path: list[tuple[str, str]], now: str) -> str:
        """The word under the mappings of its neighbours, if that reads hardly worse than what it is `now` taken for."""
        text = word
        try:
            for wrong, original in path:
                text = self.by_name[wrong](text).decode(original)
        except (UnicodeError, KeyError):
            return now
        return text if not _LEFT_BEHIND(text) and self.score(text) > self.score(now) - FOLLOWED else now

    def mend(self, text: str | None) -> tuple[bool, str | None]:
        """Whether a value is garbled, and its original if it can be restored."""
        if not text or text.isascii():
            return False, None
        before = text.split(" ")
        found = [None if w.isascii() else self.word(w) if len(w) <= 256 else self._word(w) for w in before]
        out = [f[0] if f else w for w, f in zip(before, found)]
        hit = any(found)
        whole = all(f[1] for f in found if f)
        left = any(_LEFT_BEHIND(w) for w in out)
        if hit and whole and not left:
            # The words of a value were most likely read by one mapping: that which most of its garbled words show.
            votes = Counter(tuple(f[1]) for f in found if f)
            path = list(max(votes, key=lambda p: (votes[p], -len(p), p)))
            out = [w if b.isascii() or f and f[1] == path else self.follow(b, path, w) for b, f, w in zip(before, found, out)]
        return hit or left, " ".join(out) if hit and whole and not left else None


def garbled(samples: DataFrame) -> DataFrame:
    """`sample_id`, `keyword`, `value` and `restored` (null where the original is lost) of each garbled value, once per id."""
    shared = samples.sparkSession.sparkContext.broadcast(corpus_tables(samples))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from strataflow.llm.garbled import Mender as mender_of

        mender = mender_of(*shared.value)
        for batch in batches:
            rows = []
            for sample_id, keywords in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for keyword, value in keywords or ():
                    hit, restored = mender.mend(value)
                    if hit:
                        rows.append((sample_id, keyword, value, restored))
            columns = list(zip(*rows)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64(), *[pa.string()] * 3])], names=["sample_id", "keyword", "value", "restored"])

    return samples.select("sample_id", "keywords").mapInArrow(run, "sample_id long, keyword string, value string, restored string").dropDuplicates(["sample_id", "keyword"])
