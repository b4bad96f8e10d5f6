"""Token ids of a corpus by a public byte-level BPE, with prefix dynamic programming.

For each prefix of a piece of bytes there is exactly one token that can be the last of its
encoding. `PrefixEncoder` stores it per prefix: the ids are read off backwards, appending bytes
only extends the table, and an edit re-encodes from the edit on. Pieces come from the tokenizer's
own splitting pattern; white space that stands alone between two words always starts a piece, so
texts are first cut there and the ids of such stretches are kept per worker.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: Fixed value: the splitting pattern of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Stretches whose ids a worker keeps; beyond that it starts anew, which changes no result.
KEPT = 400_000


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: printable ones stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """Tokens by their bytes, the pair each token is merged from, and the order of merges."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters = byte_letters()
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        ids = model["vocab"]
        merged = [(ids[a], ids[b], ids[a + b]) for a, b in pairs]
        self.halves = {c: (a, b) for a, b, c in merged}
        self.rank = {c: i for i, (_, _, c) in enumerate(merged)}
        self.pair = {(a, b): c for a, b, c in merged}
        single = {i for t, i in ids.items() if len(t) == 1}
        self.by_bytes = {bytes(letters[ch] for ch in t): i for t, i in ids.items() if i in self.halves or i in single}
        self.length = {i: len(t) for t, i in self.by_bytes.items()}
        self.longest = max(self.length.values())
        self.known: dict[int, bool] = {}

    def compatible(self, left: int, right: int, before: int | None = None) -> bool:
        """Whether `left` directly before `right` stay apart until the merge of rank `before`.

        The merges inside both tokens are undone from the last on; the pair is impossible if at
        some step the two facing parts would have been merged before the step that was undone.
        Of equal merges the one on the left comes first.
        """
        a, b, before = left, right, len(self.rank) if before is None else before
        while True:
            c = self.pair.get((a, b))
            if c is not None and self.rank[c] < before:
                return False
            ra, rb = self.rank.get(a, -1), self.rank.get(b, -1)
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                before, a = ra, self.halves[a][1]
            else:
                before, b = rb + 1, self.halves[b][0]

    def whole(self, token: int) -> bool:
        """Whether the token's own bytes are encoded as that token alone."""
        if token not in self.halves:
            return True
        if token not in self.known:
            a, b = self.halves[token]
            self.known[token] = self.whole(a) and self.whole(b) and self.compatible(a, b, self.rank[token])
        return self.known[token]


class PrefixEncoder:
    """The encoding of one piece of bytes, kept as the last token of each of its prefixes."""

    def __init__(self, vocabulary: Vocabulary, piece: bytes = b"") -> None:
        self.v, self.bytes, self.last = vocabulary, b"", [-1]
        self.append(piece)

    def append(self, more: bytes) -> None:
        """Lengthens the piece; what is stored for the prefixes so far stays as it is."""
        start, self.bytes = len(self.bytes), self.bytes + more
        for end in range(start + 1, len(self.bytes) + 1):
            self.last.append(self._last_of(end))

    def _last_of(self, end: int) -> int:
        """The last token of the prefix that ends at a byte, from those of shorter prefixes."""
        v, last, data = self.v, self.last, self.bytes
        for begin in range(max(0, end - v.longest), end):
            token = v.by_bytes.get(data[begin:end])
            if token is not None and (begin == 0 or v.compatible(last[begin], token)) and v.whole(token):
                return token
        raise ValueError(f"no token ends at byte {end}")

    def edit(self, start: int, end: int, new: bytes) -> int:
        """Replaces bytes start..end; gives the number of prefixes that were worked out again.

        Prefixes before the edit keep their tokens. Behind it the old ones hold again as soon as
        they agree with the new ones over a stretch as long as the longest token, because a prefix's
        token depends on no others.
        """
        old, kept = self.last, self.bytes[end:]
        self.bytes, self.last = self.bytes[:start], self.last[: start + 1]
        self.append(new)
        at, self.bytes = len(self.bytes), self.bytes + kept
        done, agreed = len(new), 0
        while len(self.last) <= len(self.bytes):
            here = len(self.last)
            self.last.append(self._last_of(here))
            done += 1
            agreed = agreed + 1 if self.last[here] == old[here - at + end] else 0
            if agreed >= self.v.longest and here - at >= self.v.longest:
                self.last += old[here - at + end + 1 :]
        return done

    def ids(self) -> list[int]:
        out, end = [], len(self.bytes)
        while end:
            out.append(self.last[end])
            end -= self.v.length[self.last[end]]
        return out[::-1]


class Encoder:
    """Texts to ids; one per worker process and vocabulary file."""

    def __init__(self, path: str = VOCABULARY) -> None:
        self.v = Vocabulary(path)
        self.pieces = regex.compile(PATTERN)
        self.runs = regex.compile(r"\s | \s|^ | $")
        self.kept: dict[str, list[int]] = {}

    def piece(self, text: str) -> list[int]:
        return PrefixEncoder(self.v, text.encode("utf-8", "replace")).ids()

    def stretch(self, text: str) -> list[int]:
        """Ids of a text in full, through its pieces."""
        out: list[int] = []
        kept = self.kept
        for p in self.pieces.findall(text):
            ids = kept.get(p)
            if ids is None:
                ids = kept[p] = self.piece(p)
            out += ids
        return out

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        kept = self.kept
        if len(kept) > KEPT:
            kept.clear()
        words = text.split(" ")
        if self.runs.search(text):
            words = _rejoined(words)
        out: list[int] = []
        first = True
        for w in words:
            w = w if first else " " + w
            first = False
            ids = kept.get(w)
            if ids is None:
                ids = kept[w] = self.stretch(w)
            out += ids
        return out


def _rejoined(words: list[str]) -> list[str]:
    """Words whose separating space touches other white space, or an end of the text, put together again."""
    out = [words[0]]
    for w in words[1:]:
        before = out[-1]
        if before and w and not before[-1].isspace() and not w[0].isspace():
            out.append(w)
        else:
            out[-1] = before + " " + w
    return out


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode_corpus(documents: DataFrame, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids): the ids of each whole text, without special tokens.

    Null and empty texts give an empty list. Strings that look like special tokens are ordinary
    text. Each document is one row whatever its id, and long texts are never cut. The vocabulary
    file is read by each worker from `vocabulary`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(vocabulary)
        for batch in batches:
            ids = pa.array([e.encode(t) for t in batch.column(1).to_pylist()], type=pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["doc_id", "ids"])

    return documents.select("doc_id", F.col(text).alias("text")).mapInArrow(run, "doc_id bigint, ids array<int>")
