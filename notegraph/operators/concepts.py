"""Concept pages: which names deserve one, what defines them, and which pages lack what was written since."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notegraph.functions import text as T
from notegraph.operators.analysis import Answer, ask, repair_json
from notegraph.operators.graph import unresolved_counts
from notegraph.operators.skew import salted_join

#: Defining sentences, verified word for word, that a page needs.
MIN_SENTENCES = 2


def wanted(resolved: DataFrame) -> DataFrame:
    """(target_key, display, n): unresolved names that look like concepts, with the number of pages citing them."""
    return unresolved_counts(resolved).where(T.shape_ok("display"))


def passages(names: DataFrame, e: DataFrame, chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """(key, name, path, seq, content): for each of many names (target_key, display), the passages of citing pages that hold it, derived pages and summaries aside."""
    n = names.select(F.col("target_key").alias("key"), F.col("display").alias("name")).where("name is not null")
    citing = salted_join(e.select("source", "target_key"), n, "target_key", "key", salt_by="source").select("key", "name", "source")
    own = pages.where(F.coalesce("origin", F.lit("")) != "derived").select(F.col("path").alias("__p"))
    citing = citing.join(own, F.col("source") == F.col("__p"), "left_semi")
    body = chunks.where(~F.coalesce("is_summary", F.lit(False)) & F.col("content").isNotNull()).select("path", "seq", "content").distinct()
    return salted_join(citing, body, "source", "path", salt_by="key").where(F.lower("content").contains(F.lower("name"))).select("key", "name", "path", "seq", "content")


def definitions(found: DataFrame, complete: Callable[[str], Answer]) -> DataFrame:
    """(key, name, path, sentence): what a model quotes from each passage as defining the name, if it stands there word for word.

    The prompt is the name, a line end and the passage; the answer has a list `sentences`.
    """
    asked = found.select(F.concat_ws("\n", "key", "path", F.col("seq").cast("string")).alias("id"), "key", "name", "path", "content", F.concat_ws("\n", "name", "content").alias("prompt"))
    said = ask(asked, complete, "prompt", "id").select(F.col("id").alias("i"), F.from_json(repair_json(F.col("answer"))["json"], "sentences array<string>").alias("a"))
    each = asked.join(said, F.col("id") == F.col("i")).select("key", "name", "path", "content", F.explode("a.sentences").alias("sentence"))
    flat = each.withColumn("sentence", T.squeeze(T.strip_links("sentence"))).where((F.col("sentence") != "") & T.squeeze(T.strip_links("content")).contains(F.col("sentence")))
    return flat.select("key", "name", "path", "sentence").distinct()


def concept_pages(defining: DataFrame, least: int = MIN_SENTENCES) -> DataFrame:
    """(key, name, sentences, sources, text): a page for each name with enough different defining sentences; it names the pages they come from."""
    distinct = defining.groupBy("key", "name", "sentence").agg(F.min("path").alias("path"))
    g = distinct.groupBy("key").agg(F.min("name").alias("name"), F.count(F.lit(1)).alias("sentences"), F.array_sort(F.collect_set("path")).alias("sources"), F.array_sort(F.collect_list("sentence")).alias("s")).where(F.col("sentences") >= least)
    head = F.concat(F.lit("---\ntype: concept\norigin: derived\nsources: "), F.array_join("sources", "; "), F.lit("\n---\n\n# "), F.col("name"), F.lit("\n\n"))
    return g.select("key", "name", "sentences", "sources", F.concat(head, F.array_join("s", "\n\n"), F.lit("\n")).alias("text"))


def stale(pages: DataFrame, found: DataFrame) -> DataFrame:
    """(key, path): passages' pages that a concept page (key, sources array) doesn't name among its sources."""
    known = pages.select(F.col("key").alias("k"), F.explode("sources").alias("p"))
    have = pages.select(F.col("key").alias("has")).distinct()
    fresh = found.select("key", "path").distinct().join(have, F.col("key") == F.col("has"), "left_semi")
    return fresh.join(known, (F.col("key") == F.col("k")) & (F.col("path") == F.col("p")), "left_anti")
