"""Splitting oversized items at natural boundaries by recursive bisection."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 2400
OVERLAP = 240

#: Kinds of boundaries, strongest first; a cut goes behind the match. Strength falls by one a line.
BOUNDARIES = (
    r"\n(?=#{1,6}[ \t])",
    r"\n[ \t]*\r?\n[ \t\r\n]*",
    r"\r?\n(?=[ \t]*(?:[-*+|>]|\d+[.)])\s)",
    r"\r?\n|\r",
    r"[.!?…。！？]+[\"'”’»)\]]*\s+|[。！？]",
    r"[;:,，、；：]\s+|[，、；：]",
    r"\s+",
)
_PATTERNS = [re.compile(p) for p in BOUNDARIES]
_FENCE = re.compile(r"^[ \t]*(?:```|~~~).*?(?:^[ \t]*(?:```|~~~)[ \t]*\r?$|\Z)", re.M | re.S)


def boundaries(text: str) -> tuple[list[int], list[int]]:
    """Places where `text` may be cut and their strengths; inside fenced code only line ends count, weakly."""
    strength: dict[int, int] = {}
    for rank, pattern in enumerate(_PATTERNS):
        for m in pattern.finditer(text):
            if 0 < m.end() < len(text):
                strength.setdefault(m.end(), len(_PATTERNS) - rank)
    for m in _FENCE.finditer(text):
        for at in [p for p in strength if m.start() < p < m.end()]:
            strength[at] = 2 if text[at - 1] in "\r\n" else 1
    places = sorted(strength)
    return places, [strength[p] for p in places]


def _joined(text: str, at: int) -> bool:
    """Whether a cut at `at` would part what belongs to one visible character or line end."""
    c = text[at]
    return (text[at - 1] == "\r" and c == "\n") or c == "‍" or text[at - 1] == "‍" or "̀" <= c <= "ͯ" or "︀" <= c <= "️" or "\U0001f3fb" <= c <= "\U0001f3ff"


def bisect_text(text: str, most: int) -> list[tuple[int, int]]:
    """Spans that cover `text`, each of at most `most` characters.

    A span that is too long is cut at the strongest boundary within its middle half, the one
    nearest the midpoint among equals; where there is none, at the midpoint itself.
    """
    places, strengths = boundaries(text)
    done, todo = [], [(0, len(text))]
    while todo:
        start, end = todo.pop()
        n = end - start
        if n <= most:
            done.append((start, end))
            continue
        middle = (start + end) // 2
        lo, hi = bisect_left(places, start + max(1, n // 4)), bisect_right(places, end - max(1, n // 4))
        if lo < hi:
            cut = min(range(lo, hi), key=lambda i: (-strengths[i], abs(places[i] - middle)))
            at = places[cut]
        else:
            at = middle
            while at < end - 1 and at < middle + 16 and _joined(text, at):
                at += 1
        todo += [(at, end), (start, at)]
    return done


def overlap_start(text: str, start: int, end: int, overlap: int) -> int:
    """Where the overlap taken from the end of text[start:end] begins: behind white space if there is some."""
    first = max(start, end - overlap)
    if first == start or text[first - 1].isspace():
        return first
    gap = re.compile(r"\s+").search(text, first, end)
    return gap.end() if gap and gap.end() < end else first


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[str, int]]:
    """Pieces of at most `limit` characters, each with the length of the overlap it begins with.

    Without their overlaps the pieces give `text` again, white space included.
    """
    spans = bisect_text(text, limit - overlap)
    pieces, before = [], None
    for start, end in spans:
        at = start if before is None else overlap_start(text, before, start, overlap)
        pieces.append((text[at:end], start - at))
        before = start
    return pieces


def split_oversized(chunks: DataFrame, content: str = "content", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of every chunk whose content has more than `limit` characters inside its outer white space.

    Result: path, seq, heading, piece (from 0), overlap (characters), text. Rows repeated whole
    count once. Null and empty contents, and those within the limit, give no rows; only the long
    ones leave the JVM. Spaces, tabs and line ends at the two ends do not count towards the limit
    but stay in the pieces.
    """
    size = F.length(F.regexp_replace(F.col(content), r"^[ \t\r\n]+|[ \t\r\n]+$", ""))
    long = chunks.where((F.length(content) > limit) & (size > limit)).select("path", "seq", "heading", F.col(content).alias("content")).distinct()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (path, seq, heading, i, over, text)
                for path, seq, heading, whole in zip(batch["path"], batch["seq"], batch["heading"], batch["content"])
                for i, (text, over) in enumerate(split_text(whole, limit, overlap))
            ]
            yield pd.DataFrame(rows, columns=["path", "seq", "heading", "piece", "overlap", "text"])

    return long.mapInPandas(cut, "path string, seq int, heading string, piece int, overlap int, text string")
