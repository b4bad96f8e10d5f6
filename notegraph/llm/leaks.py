"""Evaluation texts leaking into training text: q-gram lemma filter and banded alignment.

Texts are folded to bare letters and digits. Character q-grams shared with a test passage are
counted in overlapping bands of diagonals; a band is kept if it reaches the number of q-grams that
a stretch of `least` words must still share when its edit budget is spent (q-gram lemma). Kept
bands are verified by local alignment of words within the band.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words a leaked stretch has at least, and the share of them that may be changed, added or missing.
LEAST, EDITS = 20, 0.1
#: Characters of a q-gram; width of a band of diagonals and distance of neighbouring bands.
Q, BAND, STRIDE = 12, 64, 32
#: What a changed, added or missing word costs in the alignment, where an equal word gives 1.
COST = 2
#: Pairs of texts and items in a batch up to which their q-grams are counted in a full table.
DENSE = 4_000_000
#: Bytes of all passages together for which the index of q-grams is sent to every executor.
MAX_ITEMS_BYTES = 16 << 20

_LINK = re.compile(r"\[\[[^\[\]|]*\|")
_TARGET = re.compile(r"\]\([^()\s]*\)")
_BLOCK = re.compile(r"</?(?:br|p|div|li|ul|ol|tr|td|th|h[1-6]|hr|pre|table|section|blockquote)\b[^<>]{0,200}>", re.I)
_TAG = re.compile(r"</?[a-zA-Z][^<>]{0,200}>|<!--.*?-->", re.S)
_BROKEN = re.compile(r"(?<=[^\W\d_])[-‐¬]\r?\n[ \t]*(?=[^\W\d_])")


class _Fold(dict):
    """Code points to their letters and digits in lower case without accents; the rest to a space, invisible ones to nothing."""

    def __missing__(self, code: int) -> str:
        out = []
        for c in unicodedata.normalize("NFKD", chr(code).casefold()):
            kind = unicodedata.category(c)
            if kind[0] in "LN":
                out.append(c)
            elif not (kind[0] == "M" or kind == "Cf" or (kind == "Cc" and not c.isspace())):
                out.append(" ")
        self[code] = folded = "".join(out)
        return folded


_FOLD = _Fold()


def fold(text: str) -> str:
    """Bare words of a text, split by spaces: markup, entities, link targets, accents and case removed."""
    if "&" in text:
        text = html.unescape(text)
    if "[" in text:
        text = _TARGET.sub(" ", _LINK.sub(" ", text))
    if "<" in text:
        text = _TAG.sub("", _BLOCK.sub(" ", text))
    if "-\n" in text or "-\r\n" in text or "¬" in text or "‐" in text:
        text = _BROKEN.sub("", text)
    return text.translate(_FOLD)


def grams(data: np.ndarray, q: int = Q) -> np.ndarray:
    """A 64-bit hash of each q-gram of bytes, by doubling: O(log q) passes over the data."""
    if len(data) < q:
        return np.empty(0, np.uint64)
    h, width, base = data.astype(np.uint64) + np.uint64(1), 1, np.uint64(0x9E3779B97F4A7C15)
    power = {1: h}
    with np.errstate(over="ignore"):
        while width * 2 <= q:
            h = (h[:-width] * base) ^ (h[width:] + (h[:-width] >> np.uint64(29)))
            width *= 2
            base = base * np.uint64(0xBF58476D1CE4E5B9) | np.uint64(1)
            power[width] = h
        if width < q:  # two overlapping halves cover the rest
            n = len(data) - q + 1
            h = (h[:n] * base) ^ (h[q - width : q - width + n] + (h[:n] >> np.uint64(31)))
    return h


def lemma_bound(lengths: list[int], least: int = LEAST, edits: float = EDITS, q: int = Q) -> int:
    """q-grams that any `least` words in a row still share after their budget of edits.

    A changed or missing word takes the q-grams over its letters and q - 1 more; the longest words
    are assumed to be the changed ones.
    """
    budget = max(1, int(least * edits))
    bounds = []
    for i in range(max(1, len(lengths) - least + 1)):
        part = lengths[i : i + least]
        lost = sum(n + q - 1 for n in sorted(part)[-budget:])
        bounds.append(sum(part) - q + 1 - lost)
    return max(q // 2, min(bounds))


class Passages:
    """Test passages as words and an index of their q-grams."""

    def __init__(self, items: list[tuple[int, str | None]], least: int = LEAST, edits: float = EDITS) -> None:
        self.least, self.edits = least, edits
        kept = [(i, fold(p).split()) for i, p in items if p]
        kept = [(i, w) for i, w in kept if len(w) >= least]
        self.ids = [i for i, _ in kept]
        self.words = [w for _, w in kept]
        self.bounds = np.array([lemma_bound([len(x.encode()) for x in w], least, edits) for w in self.words] or [0])
        self.starts = [np.concatenate([[0], np.cumsum([len(x.encode()) for x in w])]) for w in self.words]
        parts = [grams(np.frombuffer("".join(w).encode(), np.uint8)) for w in self.words]
        self.length = max((len(p) for p in parts), default=0) + Q
        h = np.concatenate(parts) if parts else np.empty(0, np.uint64)
        item = np.repeat(np.arange(len(parts), dtype=np.int32), [len(p) for p in parts]) if parts else np.empty(0, np.int32)
        at = np.concatenate([np.arange(len(p), dtype=np.int32) for p in parts]) if parts else np.empty(0, np.int32)
        order = np.argsort(h, kind="stable")
        self.item, self.at = item[order], at[order]
        self.hash, self.first, self.count = np.unique(h[order], return_index=True, return_counts=True)
        self.bits = 24
        self.seen = np.zeros(1 << self.bits, bool)
        self.seen[self.hash >> np.uint64(64 - self.bits)] = True

    def candidates(self, texts: list[bytes]) -> list[tuple[int, int, int]]:
        """(text, item, lowest diagonal of the band) where the q-gram lemma allows a leaked stretch."""
        sizes = np.array([len(t) for t in texts])
        ends = np.cumsum(sizes)
        h = grams(np.frombuffer(b"".join(texts), np.uint8))
        pos = np.flatnonzero(self.seen[h >> np.uint64(64 - self.bits)])
        if not len(pos) or not len(self.hash):
            return []
        slot = np.minimum(np.searchsorted(self.hash, h[pos]), len(self.hash) - 1)
        real = self.hash[slot] == h[pos]
        pos, slot = pos[real], slot[real]
        doc = np.searchsorted(ends, pos, side="right")
        inside = pos + Q <= ends[doc]
        pos, slot, doc = pos[inside], slot[inside], doc[inside]
        n = self.count[slot]
        total, items = int(n.sum()), len(self.ids)
        if not total:
            return []
        back = np.repeat(np.cumsum(n) - n, n)
        entry = np.repeat(self.first[slot], n) + (np.arange(total) - back)
        item = self.item[entry]
        pair = np.repeat(doc, n) * items + item
        if len(texts) * items <= DENSE:
            keep = np.bincount(pair, minlength=len(texts) * items)[pair] >= self.bounds[item]
        else:
            _, place, counts = np.unique(pair, return_inverse=True, return_counts=True)
            keep = counts[place] >= self.bounds[item]
        if not keep.any():
            return []
        entry, pair = entry[keep], pair[keep]
        diagonal = np.repeat(pos - (ends - sizes)[doc], n)[keep] - self.at[entry] + self.length
        stripe = diagonal // STRIDE
        reach = int(sizes.max() + 2 * self.length) // STRIDE + 3
        cells, counts = np.unique(pair * reach + stripe, return_counts=True)
        following = np.searchsorted(cells, cells + 1)
        following = np.minimum(following, len(cells) - 1)
        band = counts + np.where(cells[following] == cells + 1, counts[following], 0)  # stripes s and s + 1; below an empty stripe nothing is added
        hit = band >= self.bounds[(cells // reach) % items]
        out = []
        for c in cells[hit]:
            p, s = divmod(int(c), reach)
            out.append((p // items, p % items, s * STRIDE - self.length))
        return out

    def verify(self, words: list[str], starts: np.ndarray, item: int, diagonal: int) -> bool:
        """Local alignment of the passage with the words around a band of diagonals."""
        passage, own = self.words[item], self.starts[item]
        lo = np.searchsorted(starts, own[:-1] + diagonal - STRIDE // 2, side="right") - 2
        hi = np.searchsorted(starts, own[:-1] + diagonal + BAND + STRIDE // 2, side="right")
        budget = int(self.least * self.edits)
        goal = self.least - budget - COST * budget
        before: dict[int, tuple[int, int]] = {}
        for i, word in enumerate(passage):
            row: dict[int, tuple[int, int]] = {}
            left = (0, i)
            for j in range(max(0, int(lo[i])), min(len(words), int(hi[i]))):
                if words[j] == word:
                    score, began = before.get(j - 1, (0, i))
                    best = (score + 1, began if score > 0 else i)
                else:
                    diag, up = before.get(j - 1, (0, i)), before.get(j, (0, i))
                    best = max(diag, up, left, key=lambda x: x[0])
                    best = (best[0] - COST, best[1])
                if best[0] <= 0:
                    best = (0, i + 1)
                elif best[0] >= goal and i + 1 - best[1] >= self.least and words[j] == word:
                    return True
                row[j] = left = best
            before = row
        return False

    def leaks(self, texts: list[str | None]) -> list[tuple[int, int]]:
        """(text, item) pairs that hold a leaked stretch."""
        folded = [fold(t) if t else "" for t in texts]
        found: set[tuple[int, int]] = set()
        split: dict[int, tuple[list[str], np.ndarray]] = {}
        for doc, item, diagonal in self.candidates([f.replace(" ", "").encode() for f in folded]):
            if (doc, item) in found:
                continue
            if doc not in split:
                words = folded[doc].split()
                split[doc] = words, np.cumsum([0, *(len(w.encode()) for w in words)])[:-1]
            if self.verify(*split[doc], item, diagonal):
                found.add((doc, item))
        return sorted(found)


def leaked_items(documents: DataFrame, items: DataFrame, text: str = "text", passage: str = "passage") -> DataFrame:
    """(doc_id, item_id): each test item of which a document holds a stretch of at least 20 words.

    About one word in ten may be changed, added or missing. Null and empty texts and passages, and
    passages under 20 words, give no rows; copies of a leaking document are reported each. The test
    set doesn't grow with the corpus: its size is checked, and beyond MAX_ITEMS_BYTES it is searched
    in several passes over the corpus.
    """
    spark = documents.sparkSession
    rows = items.where(F.col(passage).isNotNull() & F.col("item_id").isNotNull()).select("item_id", F.col(passage).alias("passage"))
    size = rows.agg(F.sum(F.octet_length("passage"))).first()[0] or 0
    passes = max(1, -(-size // MAX_ITEMS_BYTES))
    out = None
    for i in range(passes):
        part = rows if passes == 1 else rows.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == i)
        found = _search(spark, documents, [(r["item_id"], r["passage"]) for r in part.distinct().toLocalIterator()], text)
        out = found if out is None else out.unionByName(found)
    return out.distinct() if passes > 1 else out


@lru_cache(maxsize=2)
def _indexed(items: tuple[tuple[int, str], ...]) -> Passages:
    """The index of the passages, built once in a worker that runs many tasks."""
    return Passages(list(items))


def _search(spark: SparkSession, documents: DataFrame, items: list[tuple[int, str]], text: str) -> DataFrame:
    shared = spark.sparkContext.broadcast(tuple(sorted(items)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passages = _indexed(shared.value)
        for b in batches:
            ids, texts = b.column(0), b.column(1)
            at = 0
            while at < len(b):  # about 2 MB of text at a time
                end, size = at, 0
                while end < len(b) and (end == at or size < 2_000_000):
                    size += len(texts[end].as_py() or "")
                    end += 1
                found = passages.leaks(texts.slice(at, end - at).to_pylist())
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [ids.slice(at, end - at).take(pa.array([d for d, _ in found])), pa.array([passages.ids[i] for _, i in found], pa.int64())],
                        names=["doc_id", "item_id"],
                    )
                at = end

    return documents.select("doc_id", F.col(text).alias("text")).mapInArrow(run, "doc_id bigint, item_id bigint")
