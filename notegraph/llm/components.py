"""Consolidating pairwise matches into groups by a hierarchy of spanning forests.

Union-find runs inside each partition of the edges and keeps only a spanning forest of stars
(node, smallest node of its local group). Forests are merged in ever fewer partitions. A merge is
done in one task only if the forest is counted to hold at most `max_task_edges` edges; larger
forests stay spread over partitions and are contracted round by round until every node has one
root. No edge is dropped at any size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notegraph.operators.skew import salted_join
from notegraph.session import written

#: Edges of stars that one task may merge (about 100 bytes each in Python).
MAX_TASK_EDGES = 2_000_000
FAN_IN = 8


def local_forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Union-find over the edges of one partition; a star (child, parent) for each local group.

    Edges are folded batch by batch, so a task holds the nodes it has seen and not its edges.
    """
    number: dict[str, int] = {}
    names: list[str] = []
    parent: list[int] = []

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def known(name: str) -> int:
        i = number.get(name)
        if i is None:
            i = number[name] = len(names)
            names.append(name)
            parent.append(i)
        return i

    for batch in batches:
        for a, b in zip(batch["child"].tolist(), batch["parent"].tolist()):
            i, j = find(known(a)), find(known(b))
            if i != j:  # the smaller name becomes the root
                if names[i] < names[j]:
                    parent[j] = i
                else:
                    parent[i] = j
    roots = np.fromiter((find(i) for i in range(len(names))), dtype=np.int64, count=len(names))
    for at in range(0, len(names), 50_000):
        part = range(at, min(at + 50_000, len(names)))
        rows = [(names[i], names[roots[i]]) for i in part if roots[i] != i]
        if rows:
            yield pd.DataFrame(rows, columns=["child", "parent"])


def _forest(edges: DataFrame, label: str) -> DataFrame:
    return written(edges.mapInPandas(local_forest, "child string, parent string"), label)


def _contract(stars: DataFrame) -> DataFrame:
    """One round: every node points to its smallest parent, its other parents do too, and pointers
    are followed one step. A node has at most one parent per partition, so its window is small."""
    w = Window.partitionBy("child")
    low = stars.withColumn("least", F.min("parent").over(w))
    direct = low.select("child", F.col("least").alias("parent")).distinct()
    linked = low.where(F.col("parent") != F.col("least")).select(F.col("parent").alias("child"), F.col("least").alias("parent"))
    edges = direct.unionByName(linked).groupBy("child", "parent").agg(F.lit(1).alias("one")).drop("one")
    up = direct.select(F.col("child").alias("node"), F.col("parent").alias("above"))
    # the root of a giant component is the parent of very many nodes
    return salted_join(edges, up, "parent", "node", "left", salt_by="child").select("child", F.coalesce("above", "parent").alias("parent")).where("child <> parent").distinct()


def _settled(stars: DataFrame) -> bool:
    """Whether each child has one parent and no parent is a child."""
    parents = stars.groupBy("child").agg(F.countDistinct("parent").alias("n"))
    roots = stars.select(F.col("parent").alias("root")).distinct()
    return parents.where("n > 1").isEmpty() and parents.join(roots, parents["child"] == roots["root"], "left_semi").isEmpty()


def components(edges: DataFrame, a: str, b: str, max_task_edges: int = MAX_TASK_EDGES) -> DataFrame:
    """(node, component): every node of an edge, with the smallest node of its component.

    Edges with a null end are ignored; an edge from a node to itself makes it a component of its
    own. Repeated edges change nothing. No edges give an empty result. Order is that of UTF-8
    binary comparison, which is also that of Python's strings by code point.
    """
    pairs = edges.select(F.col(a).cast("string").alias("child"), F.col(b).cast("string").alias("parent")).where("child is not null and parent is not null")
    alone = pairs.where("child = parent").select(F.col("child").alias("node"))
    forest = _forest(pairs.where("child <> parent"), "forest")
    parts = max(1, forest.rdd.getNumPartitions())
    size = forest.count()
    while parts > 1:
        least = -(-size // max_task_edges)
        following = max(1, least, -(-parts // FAN_IN))
        if following >= parts:
            break
        forest = _forest(forest.repartition(following, "child"), "forest")
        parts, size = following, forest.count()
    if parts > 1 and size > 0:  # too large for one task: contract where it lies
        spread = max(parts, -(-size // max_task_edges))
        while not _settled(forest):
            merged = _forest(_contract(forest).repartition(spread, "child"), "forest")
            forest = written(_contract(merged), "contracted")
    roots = forest.select(F.col("parent").alias("node")).distinct()
    grouped = forest.select(F.col("child").alias("node"), F.col("parent").alias("component"))
    rest = roots.unionByName(alone).distinct().join(grouped.select(F.col("node").alias("has")), F.col("node") == F.col("has"), "left_anti")
    return grouped.unionByName(rest.select("node", F.col("node").alias("component")))


def decided_pairs(queue: DataFrame) -> DataFrame:
    """(a, b, status): the standing decision on each unordered pair of different keys.

    Rows with a null key or equal keys are left out. The latest `decided_at` as an instant holds;
    null and unreadable instants come before any other; at one instant the greater status holds.
    The status is trimmed and lower case; null status loses to any other at the same instant.
    """
    q = queue.where("key_a is not null and key_b is not null and key_a <> key_b")
    status = F.lower(F.regexp_replace("status", r"^\s+|\s+$", ""))
    latest = F.max(F.struct(F.expr("try_cast(decided_at as timestamp)").alias("at"), status.alias("status")))
    return q.groupBy(F.least("key_a", "key_b").alias("a"), F.greatest("key_a", "key_b").alias("b")).agg(latest.alias("last")).select("a", "b", F.col("last.status").alias("status"))


def groups_from_queue(queue: DataFrame, max_task_edges: int = MAX_TASK_EDGES) -> DataFrame:
    """(group_key, name_key): every key tied by decisions `same`, under its group's smallest key."""
    same = decided_pairs(queue).where("status = 'same'")
    return components(same, "a", "b", max_task_edges).select(F.col("component").alias("group_key"), F.col("node").alias("name_key"))
