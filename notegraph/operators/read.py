"""Reading pages as a job over a table of requests: names lead to pages, pages to the part that was asked for."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notegraph.functions import text as T
from notegraph.operators import graph as G
from notegraph.operators.parse import _ANY_HEADING, BUDGET, _per_row, parts_of
from notegraph.operators.skew import salted_join
from notegraph.session import written

#: What of a page's text can be asked for.
DEPTHS = ("outline", "part", "window", "full")
_FIELDS = [("status", "string"), ("note", "string"), ("part", "int"), ("parts", "int"), ("content", "string"), ("hard", "boolean")]


def located(names: DataFrame, pages: DataFrame, aliases: DataFrame, resolved: DataFrame) -> DataFrame:
    """(name, status, note, path, hits, citing): for each different name (column `name`) the one page it leads to.

    A name is a path or, failing that, leads by its key, also through one step of an alias. OK if
    it leads to one page; RETRY without a path if several share the key; STOP if there is none,
    with the number of pages that cite it all the same. Null names give no rows.
    """
    asked = names.where("name is not null").select("name").distinct()
    paths = pages.where("path is not null").select(F.col("path").alias("own")).distinct()
    keyed = asked.join(paths, F.col("name") == F.col("own"), "left").withColumn("lookup", F.when(F.col("own").isNull(), T.normalize("name")))
    one = aliases.where("alias_key is not null").groupBy("alias_key").agg(F.min("canonical_key").alias("canonical_key"))
    wanted = keyed.where("lookup is not null").select(F.col("lookup").alias("key"))
    there = G.resolve_names(wanted, pages, one).select(F.col("key").alias("k"), "n_pages", F.col("path").alias("at"))
    cited = G.unresolved_counts(resolved).select(F.col("target_key").alias("c"), F.col("n").alias("citing"))
    both = keyed.join(there, F.col("lookup") == F.col("k"), "left").join(cited, F.col("lookup") == F.col("c"), "left")
    hits = F.when(F.col("own").isNotNull(), F.lit(1)).otherwise(F.coalesce("n_pages", F.lit(0))).cast("bigint")
    out = both.select("name", hits.alias("hits"), F.coalesce("own", "at").alias("at"), F.coalesce("citing", F.lit(0)).alias("citing"))
    status = F.when(F.col("hits") == 1, "OK").when(F.col("hits") > 1, "RETRY").otherwise("STOP")
    note = (
        F.when(F.col("hits") > 1, F.concat(F.col("hits").cast("string"), F.lit(" pages have that name")))
        .when((F.col("hits") == 0) & (F.col("citing") > 0), F.concat(F.lit("no page yet; cited by "), F.col("citing").cast("string")))
        .when(F.col("hits") == 0, "no such page")
    )
    return out.select("name", status.alias("status"), note.alias("note"), F.when(F.col("hits") == 1, F.col("at")).alias("path"), "hits", "citing")


def page_meta(pages: DataFrame, e: DataFrame) -> DataFrame:
    """(path, type, origin, summary, provisional, expect, links_out, linked_from): what is known of each page without its text.

    `expect` is the beginning of the hash that a writer has to show.
    """
    out = e.groupBy(F.col("source").alias("s")).agg(F.count(F.lit(1)).alias("out"))
    cited = e.groupBy(F.col("target_key").alias("t")).agg(F.count(F.lit(1)).alias("cited"))
    both = pages.join(out, F.col("path") == F.col("s"), "left").join(cited, F.col("page_key") == F.col("t"), "left")
    return both.select(
        "path", "type", "origin", "summary", F.coalesce("summary_provisional", F.lit(True)).alias("provisional"), F.substring("content_hash", 1, 8).alias("expect"),
        F.coalesce("out", F.lit(0)).alias("links_out"), F.coalesce("cited", F.lit(0)).alias("linked_from"),
    )


def key_of(name: str) -> str:
    """T.normalize for one name inside a task."""
    k = re.sub("[^a-z0-9]", "", name.lower())
    if k.endswith("ies") and len(k) > 4:
        return k[:-3] + "y"
    return k[:-1] if k.endswith("s") and not k.endswith("ss") and len(k) > 3 else k


def headings(body: str) -> list[tuple[int, int, int, str]]:
    """(start, end, level, heading) of the sections of a body, the heading's line included."""
    found, at = [], 0
    for line in body.split("\n"):
        m = _ANY_HEADING.match(line)
        if m:
            found.append((at, len(m[1]), m[2].strip()))
        at += len(line) + 1
    ends = [start for start, _, _ in found[1:]] + [len(body)]
    return [(start, end, level, h) for (start, level, h), end in zip(found, ends)]


def _slice(body: str, depth: str, target: str | None, from_part: int) -> list[tuple]:
    def none(status: str, note: str) -> list[tuple]:
        return [(status, note, None, None, None, None)]

    if depth == "outline":
        text = "\n".join("  " * (level - 1) + f"{h} ({end - start})" for start, end, level, h in headings(body))
    elif depth == "part":
        text = next((body[start:end] for start, end, _, h in headings(body) if key_of(h) == key_of(target)), None)
        if text is None:
            return none("RETRY", "no such heading")
    elif depth == "window":
        m = re.search(re.escape(target), body, re.IGNORECASE)
        if not m:
            return none("STOP", "not in the page")
        text = body[max(0, m.start() - BUDGET // 2) : m.start() + BUDGET // 2]
    else:
        text = body
    parts = parts_of(text)
    at = max(1, min(from_part, len(parts)))
    return [("OK", None, at, len(parts), *parts[at - 1][1:])]


def read_texts(requests: DataFrame, places: DataFrame, texts: DataFrame) -> DataFrame:
    """(request, path, status, note, part, parts, content, hard): one row for each request.

    requests: (request, name, depth, target, from_part); places: that of `located`; texts: (path,
    body), one row a path. Depths: the outline, the section under a heading (target), the text
    around a phrase (target), or all. What is longer than the budget comes in parts; from_part
    chooses one, the first and the last standing for numbers beyond. A null name, an unknown depth,
    a missing target, heading or phrase, and a page without a text are answered with RETRY or STOP.
    Names asked for very often are split over tasks, as are pages.
    """
    lower = F.lower(T.strip_space(F.coalesce("depth", F.lit("full"))))
    r = requests.select("request", F.col("name").alias("asked"), lower.alias("depth"), F.nullif(T.strip_space("target"), F.lit("")).alias("target"), F.coalesce("from_part", F.lit(1)).cast("int").alias("from_part"))
    found = salted_join(r.where("asked is not null"), places.select("name", F.col("status").alias("s"), F.col("note").alias("n"), "path"), "asked", "name", salt_by="request")
    wrong = F.when(F.col("s") != "OK", F.col("n")).when(~F.col("depth").isin(*DEPTHS), "unknown depth").when(F.col("depth").isin("part", "window") & F.col("target").isNull(), "needs a target")
    found = written(found.withColumn("wrong", wrong).withColumn("s", F.when(F.col("wrong").isNotNull() & (F.col("s") == "OK"), "RETRY").otherwise(F.col("s"))), "found")
    blank = [F.lit(None).cast(t).alias(c) for c, t in _FIELDS[2:]]
    refused = found.where("wrong is not null").select("request", "path", F.col("s").alias("status"), F.col("wrong").alias("note"), *blank)
    unnamed = r.where("asked is null").select("request", F.lit(None).cast("string").alias("path"), F.lit("STOP").alias("status"), F.lit("no name").alias("note"), *blank)
    ready = found.where("wrong is null").select("request", "path", "depth", "target", "from_part")
    full = written(salted_join(ready, texts.select(F.col("path").alias("p"), "body"), "path", "p", "left", salt_by="request"), "asked")
    empty = full.where("body is null").select("request", "path", F.lit("STOP").alias("status"), F.lit("no text").alias("note"), *blank)
    cut = _per_row(full.where("body is not null"), ["request", "path"], ["body", "depth", "target", "from_part"], _slice, _FIELDS)
    return cut.unionByName(refused).unionByName(unnamed).unionByName(empty)
