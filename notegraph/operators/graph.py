"""Link graph: edges, resolution through aliases, growth queue, orphans and enumeration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notegraph.functions import text as T
from notegraph.operators.skew import salted_join
from notegraph.session import written

GROWTH_LIMIT, GRAPH_LIMIT, LISTING_LIMIT, TAG_LIMIT = 8, 10, 20, 50
#: References from which an unwritten page is called a gap, among the first GAP_TOP of the growth queue.
GAP_REFERENCES, GAP_TOP = 4, 3
BLOAT_SECTIONS = 12


def current_pages(files: DataFrame) -> DataFrame:
    """One row per path: repeated rows count once, of different ones the latest by mtime (then by hash) holds."""
    cols = files.columns
    last = F.max_by(F.struct(*cols), F.struct(F.col("mtime"), F.coalesce("content_hash", F.lit(""))))
    return files.where("path is not null").groupBy(F.col("path").alias("__path")).agg(last.alias("row")).select("row.*")


def edges(links: DataFrame) -> DataFrame:
    """(source, target_key, display): one row per pair, with the display first indexed (the smallest among equals).

    Null targets are no links; the empty key, which stands for names without ASCII letters, is kept.
    """
    first = F.min(F.when(F.col("display").isNotNull(), F.struct("indexed_at", "display")))
    return links.where("target_key is not null").groupBy("source", "target_key").agg(first["display"].alias("display"))


def page_names(pages: DataFrame, aliases: DataFrame) -> DataFrame:
    """(name): every key that leads to a page, directly or by one step through an alias."""
    keys = pages.where("page_key is not null").select(F.col("page_key").alias("name")).distinct()
    led = aliases.where("alias_key is not null").join(keys.withColumnRenamed("name", "canonical"), F.col("canonical_key") == F.col("canonical"), "left_semi")
    return keys.unionByName(led.select(F.col("alias_key").alias("name"))).distinct()


def resolved_edges(e: DataFrame, names: DataFrame) -> DataFrame:
    """Edges with `resolved`: whether the target leads to a page. Hot targets are split over tasks."""
    known = names.select(F.col("name").alias("__name"), F.lit(True).alias("__known"))
    return salted_join(e, known, "target_key", "__name", "left", salt_by="source").withColumn("resolved", F.coalesce("__known", F.lit(False))).drop("__name", "__known")


def unresolved_counts(resolved: DataFrame) -> DataFrame:
    """(target_key, display, n): unresolved names with their smallest display and number of citing pages."""
    return resolved.where("not resolved").groupBy("target_key").agg(F.min("display").alias("display"), F.count(F.lit(1)).alias("n"))


def growth_queue(resolved: DataFrame, limit: int = GROWTH_LIMIT) -> DataFrame:
    """The unresolved names that most pages cite."""
    return unresolved_counts(resolved).orderBy(F.desc("n"), "target_key").limit(limit)


def gaps(resolved: DataFrame) -> DataFrame:
    """Names at the top of the growth queue cited often enough to be called gaps."""
    return growth_queue(resolved, GAP_TOP).where(F.col("n") >= GAP_REFERENCES)


def links_in(e: DataFrame, pages: DataFrame, key: str, limit: int = GRAPH_LIMIT) -> DataFrame:
    """The pages that cite a key, latest first (then by path), with the number of all of them."""
    citing = e.where(F.col("target_key") == key).join(pages.select("path", "summary", "mtime"), F.col("source") == F.col("path"))
    return _with_total(citing, [F.desc_nulls_last("mtime"), F.col("source")], limit).select("source", "display", "summary", "mtime", "total")


def in_degrees(e: DataFrame, pages: DataFrame) -> DataFrame:
    """(path, page_key, n_in): number of links to each page's own key, 0 where there are none."""
    counts = e.groupBy(F.col("target_key").alias("cited")).agg(F.count(F.lit(1)).alias("n"))
    return pages.select("path", "page_key").join(counts, F.col("page_key") == F.col("cited"), "left").select("path", "page_key", F.coalesce("n", F.lit(0)).alias("n_in"))


def orphans(e: DataFrame, pages: DataFrame) -> DataFrame:
    """(path): pages that neither cite nor are cited."""
    citing = e.select(F.col("source").alias("__s")).distinct()
    cited = e.select(F.col("target_key").alias("__t")).distinct()
    return pages.select("path", "page_key").join(citing, F.col("path") == F.col("__s"), "left_anti").join(cited, F.col("page_key") == F.col("__t"), "left_anti").select("path")


def ambiguous_keys(pages: DataFrame) -> DataFrame:
    """(page_key, n, first, last): keys that several pages share, with the first and last of their paths."""
    return pages.groupBy("page_key").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("first"), F.max("path").alias("last")).where("n > 1")


def resolve_names(names: DataFrame, pages: DataFrame, aliases: DataFrame, column: str = "key") -> DataFrame:
    """(key, canonical, n_pages, path): keys followed one step through aliases to their pages, which may be several or none."""
    step = aliases.select("alias_key", "canonical_key")
    via = names.select(F.col(column).alias("key")).distinct().join(step, F.col("key") == F.col("alias_key"), "left").withColumn("canonical", F.coalesce("canonical_key", "key"))
    there = pages.groupBy("page_key").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("path"))
    return via.join(there, F.col("canonical") == F.col("page_key"), "left").select("key", "canonical", F.coalesce("n", F.lit(0)).alias("n_pages"), "path")


def known_keys(e: DataFrame, pages: DataFrame) -> DataFrame:
    """(key): page keys and the keys cited by pages that are not derived."""
    own = pages.where(F.coalesce("origin", F.lit("")) != "derived").select(F.col("path").alias("__p"))
    cited = e.join(own, F.col("source") == F.col("__p"), "left_semi").select(F.col("target_key").alias("key"))
    return pages.select(F.col("page_key").alias("key")).where("key is not null").unionByName(cited).distinct()


def resolution_index(pages: DataFrame, aliases: DataFrame) -> DataFrame:
    """(key, canonical): the file name each key leads to; concept pages go first, then the first path; aliases extend it."""
    stem = F.regexp_replace(F.substring_index("path", "/", -1), r"\.md$", "")
    concept = F.coalesce(F.lower(F.trim("type")) == "concept", F.lit(False))
    own = pages.where("page_key is not null").groupBy(F.col("page_key").alias("key")).agg(F.min_by(stem, F.struct((~concept).alias("later"), F.col("path"))).alias("canonical"))
    led = aliases.select("alias_key", "canonical_key").join(own, F.col("canonical_key") == F.col("key")).select(F.col("alias_key").alias("key"), "canonical")
    fresh = led.join(own.select(F.col("key").alias("__k")), F.col("key") == F.col("__k"), "left_anti")
    return own.unionByName(fresh)


def folder(pages: DataFrame, prefix: str, limit: int = LISTING_LIMIT) -> DataFrame:
    """The first pages of a folder by path, with the number of all of them. The prefix is compared exactly."""
    inside = pages.where(F.col("path").startswith(prefix.rstrip("/") + "/"))
    return _with_total(inside, ["path"], limit).select("path", "summary", "total")


def recent(pages: DataFrame, limit: int = LISTING_LIMIT) -> DataFrame:
    """The pages changed last, with the number of all pages."""
    return _with_total(pages, [F.desc_nulls_last("mtime"), F.col("path")], limit).select("path", "mtime", "total")


def by_tag(pages: DataFrame, tags: DataFrame, tag: str, limit: int = LISTING_LIMIT) -> DataFrame:
    """The latest pages under a tag, with the number of all of them."""
    tagged = tags.where(F.col("tag") == tag).select(F.col("path").alias("__p")).distinct()
    found = written(pages.select("path", "mtime").join(tagged, F.col("path") == F.col("__p")), "tagged")
    return _with_total(found, [F.desc_nulls_last("mtime"), F.col("path")], limit).select("path", "mtime", "total")


def _with_total(df: DataFrame, order: list, limit: int) -> DataFrame:
    return df.orderBy(*order).limit(limit).crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias("total"))))


def tag_histogram(tags: DataFrame, limit: int = TAG_LIMIT) -> DataFrame:
    """(tag, n): the tags of most pages."""
    return tags.groupBy("tag").agg(F.count_distinct("path").alias("n")).orderBy(F.desc("n"), "tag").limit(limit)


def vault_shape(e: DataFrame, pages: DataFrame, names: DataFrame) -> DataFrame:
    """One row: pages, links, resolved and unresolved names, orphans, ambiguous keys."""
    r = resolved_edges(e, names)
    links = r.agg(F.count(F.lit(1)).alias("links"), F.count_if("resolved").alias("resolved_links"), F.count_distinct(F.when(~F.col("resolved"), F.col("target_key"))).alias("unresolved_names"))
    p = pages.agg(F.count(F.lit(1)).alias("pages"), F.count_distinct("page_key").alias("page_keys"))
    o = orphans(e, pages).agg(F.count(F.lit(1)).alias("orphans"))
    a = ambiguous_keys(pages).agg(F.count(F.lit(1)).alias("ambiguous"))
    return p.crossJoin(F.broadcast(links)).crossJoin(F.broadcast(o)).crossJoin(F.broadcast(a))


def bloated(parsed: DataFrame, most: int = BLOAT_SECTIONS) -> DataFrame:
    """(path, sections, bloated): concept pages with their second-level sections, and whether those are more than `most`."""
    concept = parsed.where("type = 'concept' and body is not null")
    n = F.regexp_count("body", F.lit("(?m)^## "))
    return concept.select("path", n.alias("sections"), (n > most).alias("bloated"))


def isolation(e: DataFrame, pages: DataFrame) -> DataFrame:
    """(path, cites, cited): whether each page cites others and is cited; orphans do neither."""
    citing = e.select(F.col("source").alias("__s")).distinct()
    cited = e.select(F.col("target_key").alias("__t")).distinct()
    both = pages.select("path", "page_key").join(citing, F.col("path") == F.col("__s"), "left").join(cited, F.col("page_key") == F.col("__t"), "left")
    return both.select("path", F.col("__s").isNotNull().alias("cites"), F.col("__t").isNotNull().alias("cited"))


def page_created(e: DataFrame, key: str) -> DataFrame:
    """The links that come to life when a page of that key is made."""
    return e.where(F.col("target_key") == key)


def mention_counts(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """(pair_key, mentions): how often either key of a pair is linked."""
    counts = links.where("target_key is not null").groupBy(F.col("target_key").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    a, b = counts.select(F.col("k").alias("ka"), F.col("n").alias("na")), counts.select(F.col("k").alias("kb"), F.col("n").alias("nb"))
    p = pairs.where("key_a is not null and key_b is not null").select("pair_key", "key_a", "key_b").distinct()
    both = p.join(a, F.col("key_a") == F.col("ka"), "left").join(b, F.col("key_b") == F.col("kb"), "left")
    nb = F.when(F.col("key_a") == F.col("key_b"), F.lit(0)).otherwise(F.coalesce("nb", F.lit(0)))
    return both.groupBy("pair_key").agg(F.max(F.coalesce("na", F.lit(0)) + nb).alias("mentions"))


def material(chunks: DataFrame, e: DataFrame, pages: DataFrame, key: str, name: str) -> DataFrame:
    """(path, seq, content): passages of pages citing a key that hold its name, derived pages and summaries aside."""
    citing = e.where(F.col("target_key") == key).select(F.col("source").alias("__s"))
    own = pages.where(F.coalesce("origin", F.lit("")) != "derived").select(F.col("path").alias("__p"))
    inside = chunks.where(~F.coalesce("is_summary", F.lit(False)) & F.lower("content").contains(name.lower()))
    return inside.join(citing, F.col("path") == F.col("__s"), "left_semi").join(own, F.col("path") == F.col("__p"), "left_semi").select("path", "seq", "content").distinct()
