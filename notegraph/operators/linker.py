"""Placing wikilinks into page bodies, and repairing damaged brackets."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notegraph.functions import text as T

#: Spans in which no link is placed (frontmatter, fences, code, math, headings, links).
PROTECTED = r"\A---\n.*?\n---|```.*?```|`[^`\n]+`|\$\$[^$]*\$\$|\$[^$\n]+\$|^#{1,6}[^\n]*$|\[\[[^\]]*\]\]|\[[^\]\n]*\]\([^)\n]*\)"
#: Spans in which brackets are left as they are.
VERBATIM = r"```(?s:.*?)```|`[^`\n]+`|\$\$[^$]*\$\$|\$[^$\n]+\$"
#: A link of two or more brackets a side as the two that should be there and what stands between them.
BRACKETS = r"\[*(\[\[)([^\[\]]+)(\]\])\]*"
#: A link of more than two brackets on some side.
DAMAGED = r"\[{3,}[^\[\]]+\]{2,}|\[\[[^\[\]]+\]{3,}"

_PROTECTED = re.compile(PROTECTED, re.S | re.M)
_SHAPE, _LABEL, _COUNTED = re.compile(T.SHAPE), re.compile(T.ORDINAL_LABEL), re.compile(T.COUNTED_NOUN)
_LINK = re.compile(T.LINK)
#: What may become of a mention: it gets a link to a page or to a name without one; or it stays, because its name is linked
#: already, it stands in a protected span, or it has no shape of a concept.
OUTCOMES = ("to_page", "to_name", "again", "inside", "misshapen")


def key_of(name: str) -> str:
    """The key of a name, as notegraph.functions.text.normalize."""
    k = re.sub("[^a-z0-9]", "", name.lower())
    if k.endswith("ies") and len(k) > 4:
        return k[:-3] + "y"
    return k[:-1] if k.endswith("s") and not k.endswith("ss") and len(k) > 3 else k


def _shaped(name: str) -> bool:
    return bool(_SHAPE.match(name)) and len(name.split()) <= 6 and not _LABEL.match(name) and not _COUNTED.match(name)


def mentions(body: str, names: list[str]) -> list[tuple[int, int]]:
    """Where names stand as words, the longest at each place; white space and case are free."""
    wanted = sorted({" ".join(n.split()) for n in names if n and n.strip()}, key=lambda n: (-len(n), n))
    if not wanted:
        return []
    choice = "|".join(r"\s+".join(map(re.escape, n.split(" "))) for n in wanted)
    return [m.span() for m in re.finditer(rf"(?<![\[\w])(?:{choice})(?![\w\]])", body, re.I)]


def outcomes(body: str, spots: list[tuple[int, int]], index: dict[str, str]) -> list[str]:
    """The outcome of each mention, in order: of those that may carry a link, the first of each key does."""
    spans = [m.span() for m in _PROTECTED.finditer(body)]
    begins = [s for s, _ in spans]
    shown = [body[s:e] for s, e in spots]
    inside = [(i := bisect_right(begins, s) - 1) >= 0 and s < spans[i][1] for s, _ in spots]
    shaped = [_shaped(" ".join(x.split())) for x in shown]
    keys = [key_of(x) for x in shown]
    linked = {key_of(x.split("|")[0]) for x in _LINK.findall(body)}
    first: dict[str, int] = {}
    for i, k in enumerate(keys):
        if shaped[i] and not inside[i] and k not in linked:
            first.setdefault(k, i)
    fate = lambda i: "inside" if inside[i] else "misshapen" if not shaped[i] else "again" if first.get(keys[i]) != i else "to_page" if keys[i] in index else "to_name"
    return [fate(i) for i in range(len(spots))]


def place_links(body: str, names: list[str], index: dict[str, str]) -> tuple[str, dict[str, int]]:
    """The body with the first mention of each name linked, and how many mentions came to which outcome.

    A name with a page is linked to it, in pipe form where the text differs; others as they stand.
    Protected spans stay untouched and no bracket is ever removed.
    """
    spots = mentions(body, names)
    what = outcomes(body, spots, index)
    pieces, at = [], 0
    for (start, end), outcome in zip(spots, what):
        if outcome in ("to_page", "to_name"):
            shown = body[start:end]
            page = index.get(key_of(shown), shown)
            pieces += [body[at:start], "[[", shown if page == shown else f"{page}|{shown}", "]]"]
            at = end
    counts = Counter(what)
    return "".join(pieces) + body[at:], {o: counts[o] for o in OUTCOMES}


def repair_brackets(body: Column) -> Column:
    """The body with links of two or more brackets a side set to two, outside code and math."""
    return F.regexp_replace(body, f"({VERBATIM})|{BRACKETS}", "$1$2$3$4")


def damaged_links(body: Column) -> Column:
    """The number of links outside code and math that repair_brackets changes."""
    return F.regexp_count(F.regexp_replace(body, VERBATIM, " "), F.lit(DAMAGED))


def link_pages(pages: DataFrame, concepts: str, index: DataFrame, path: str = "path", body: str = "body") -> DataFrame:
    """(path, linked, and a count for each of OUTCOMES) of pages with an array of concepts.

    index: (key, canonical). Each page is given only the entries of its own concepts, by a join, so
    the index may be of any size. Null bodies give null; repeated paths are placed each alone.
    """
    numbered = pages.select(path, body, concepts, F.xxhash64(path, body).alias("__id"))
    asked = numbered.select("__id", F.explode(concepts).alias("c")).select("__id", T.normalize("c").alias("k")).distinct()
    found = asked.join(index.select(F.col("key").alias("ik"), "canonical"), F.col("k") == F.col("ik"))
    maps = found.groupBy(F.col("__id").alias("__of")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "canonical")))).alias("entries"))
    ready = numbered.join(maps, F.col("__id") == F.col("__of"), "left").select(path, body, concepts, "entries")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, names, entries in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                new, n = place_links(text, names or [], dict(entries or [])) if text is not None else (None, {})
                rows.append((new, *[n.get(f) for f in OUTCOMES]))
            cols = list(zip(*rows)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cols[0], pa.string()), *[pa.array(c, pa.int32()) for c in cols[1:]]], names=[path, "linked", *OUTCOMES])

    return ready.mapInArrow(run, f"{path} string, linked string, " + ", ".join(f"{f} int" for f in OUTCOMES))


def repair_pages(pages: DataFrame, path: str = "path", body: str = "body") -> DataFrame:
    """(path, repaired, fixed) of the pages that the repair changes; null bodies are none."""
    some = pages.where(F.col(body).contains("[[")).select(F.col(path).alias("path"), F.col(body).alias("__was"), repair_brackets(F.col(body)).alias("repaired"))
    return some.where("repaired <> __was").select("path", "repaired", damaged_links(F.col("__was")).alias("fixed"))
