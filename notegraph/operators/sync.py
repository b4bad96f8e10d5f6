"""Incremental ingest: difference of stored and present pages, and the tables that follow from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: With more known pages than this, the disappearance of all of them is refused.
FEW = 2


def visible(path: Column, exclude: tuple[str, ...] = ()) -> Column:
    """Whether a path is part of the vault: no part begins with a dot, and it is not in an excluded folder."""
    ok = ~path.rlike(r"(^|/)\.")
    for e in (x.strip("/") for x in exclude):
        ok = ok & (path != e) & ~path.startswith(e + "/")
    return F.coalesce(ok, F.lit(False))


def difference(known: DataFrame, present: DataFrame, full: bool = False) -> DataFrame:
    """(path, change): new, changed, same or gone, by path and mtime; `full` takes every present page as changed.

    Both sides need path and mtime, each path once. A null mtime equals a null one only.
    """
    k = known.select(F.col("path").alias("known_path"), F.col("mtime").alias("known_mtime"))
    p = present.select("path", "mtime")
    both = p.join(k, F.col("path") == F.col("known_path"), "full_outer")
    same = F.col("mtime").eqNullSafe(F.col("known_mtime")) & F.lit(not full)
    change = F.when(F.col("path").isNull(), "gone").when(F.col("known_path").isNull(), "new").when(same, "same").otherwise("changed")
    return both.select(F.coalesce("path", "known_path").alias("path"), change.alias("change"))


def classify(known: DataFrame, parsed: DataFrame) -> DataFrame:
    """(path, change): relinked where the content hash is as stored, else reindexed."""
    k = known.select(F.col("path").alias("known_path"), F.col("content_hash").alias("known_hash"))
    both = parsed.select("path", "content_hash").join(k, F.col("path") == F.col("known_path"), "left")
    return both.select("path", F.when(F.col("known_hash").eqNullSafe(F.col("content_hash")) & F.col("known_path").isNotNull(), "relinked").otherwise("reindexed").alias("change"))


def deletable(diff: DataFrame) -> bool:
    """Whether the pages that are gone may be deleted: not if all known ones vanished at once, which is a lost drive."""
    row = diff.agg(F.count_if(F.col("change") == "gone").alias("gone"), F.count_if(F.col("change").isin("gone", "same", "changed")).alias("known")).first()
    return not (row["gone"] == row["known"] and row["known"] > FEW)


def upsert(stored: DataFrame, fresh: DataFrame, gone: DataFrame | None = None, keep: tuple[str, ...] = ("analyzed_hash",)) -> DataFrame:
    """The page table after a change: fresh rows replace stored ones of their path, but keep the columns in `keep`."""
    old = stored.select(F.col("path").alias("old_path"), *[F.col(c).alias(f"old_{c}") for c in keep])
    joined = fresh.drop(*keep).join(old, F.col("path") == F.col("old_path"), "left")
    new = joined.select(*[F.col(f"old_{c}").alias(c) if c in keep else F.col(c) for c in stored.columns])
    rest = replace(stored, fresh, "path")
    if gone is not None:
        rest = rest.join(gone.select(F.col("path").alias("gone_path")), F.col("path") == F.col("gone_path"), "left_anti")
    return rest.unionByName(new)


def replace(stored: DataFrame, fresh: DataFrame, path: str) -> DataFrame:
    """Rows of a derived table whose page is not among the fresh ones."""
    changed = fresh.select(F.col("path").alias("fresh_path")).distinct()
    return stored.join(changed, F.col(path) == F.col("fresh_path"), "left_anti")


def carry_forward(pages: DataFrame) -> DataFrame:
    """Pages with analyzed_hash brought to content_hash where the summary is not provisional, after a change of the hash."""
    done = ~F.coalesce("summary_provisional", F.lit(True)) & ~F.col("analyzed_hash").eqNullSafe(F.col("content_hash"))
    return pages.withColumn("analyzed_hash", F.when(done, F.col("content_hash")).otherwise(F.col("analyzed_hash")))


def pending_embed(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """(stripped_hash): texts without a vector, each once."""
    have = vectors.select(F.col("stripped_hash").alias("have")).distinct()
    return chunks.where("stripped_hash is not null").select("stripped_hash").distinct().join(have, F.col("stripped_hash") == F.col("have"), "left_anti")


def prune_vectors(vectors: DataFrame, chunks: DataFrame) -> DataFrame:
    """The vectors that some chunk still uses."""
    used = chunks.where("stripped_hash is not null").select(F.col("stripped_hash").alias("used")).distinct()
    return vectors.join(used, F.col("stripped_hash") == F.col("used"), "left_semi")


def survey(pages: DataFrame, links: DataFrame, queue: DataFrame, chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row of counters: pages, provisional, pending analysis, null types, open pairs, texts without a vector."""
    p = pages.agg(
        F.count(F.lit(1)).alias("pages"),
        F.count_if(F.coalesce("summary_provisional", F.lit(True))).alias("provisional"),
        F.count_if(~F.col("analyzed_hash").eqNullSafe(F.col("content_hash"))).alias("pending_analysis"),
        F.count_if(F.col("type").isNull()).alias("untyped"),
    )
    q = queue.agg(F.count_distinct(F.when(F.lower(F.trim("status")) == "open", F.col("pair_key"))).alias("open_pairs"))
    e = pending_embed(chunks, vectors).agg(F.count(F.lit(1)).alias("pending_embed"))
    n = links.agg(F.count_distinct("source").alias("citing_pages"))
    return p.crossJoin(F.broadcast(q)).crossJoin(F.broadcast(e)).crossJoin(F.broadcast(n))


#: The folders of a collection that its tools have to agree on.
LAYOUT = ("pages", "concepts", "records", "sources")


def layout_drift(recorded: DataFrame, layout: dict[str, str]) -> DataFrame:
    """(folder, was, now): folders that differ from the recorded ones (folder, path); a folder that was never recorded is no drift.

    Of several records of one folder the smallest path counts; null ones don't.
    """
    now = recorded.sparkSession.createDataFrame([(k, layout[k]) for k in LAYOUT if k in layout], "now_folder string, now string")
    was = recorded.where("folder is not null and path is not null").groupBy("folder").agg(F.min("path").alias("was"))
    return was.join(F.broadcast(now), (F.col("folder") == F.col("now_folder")) & (F.col("was") != F.col("now"))).select("folder", "was", "now")


def health(pages: DataFrame, recorded: DataFrame, gaps: DataFrame, bloated: DataFrame, drift: DataFrame) -> DataFrame:
    """One row: pages pending analysis, failed ones, folders that drifted, gaps with the names most cited, and bloated concept pages.

    recorded: (path, status) of the last attempts; gaps: (target_key, display, n), a few rows;
    bloated: (path, sections, bloated). Empty tables count as 0 and give null where nothing can be named.
    """
    p = pages.agg(F.count_if(~F.col("analyzed_hash").eqNullSafe(F.col("content_hash"))).alias("pending"))
    r = recorded.agg(F.count_if(F.col("status") == "failed").alias("failed"))
    d = drift.agg(F.count(F.lit(1)).alias("drifted"))
    named = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "target_key", F.coalesce("display", "target_key").alias("shown"), "n")))
    shown = F.transform(named, lambda x: F.concat(x["shown"], F.lit(" ("), x["n"].cast("string"), F.lit(")")))
    g = gaps.agg(F.count(F.lit(1)).alias("gaps"), F.nullif(F.array_join(shown, ", "), F.lit("")).alias("undefined"))
    b = bloated.where("bloated").agg(F.count(F.lit(1)).alias("bloated"), F.max("sections").alias("most_sections"))
    return p.crossJoin(F.broadcast(r)).crossJoin(F.broadcast(d)).crossJoin(F.broadcast(g)).crossJoin(F.broadcast(b))
