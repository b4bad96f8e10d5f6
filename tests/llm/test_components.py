"""Groups from pairs against a plain union-find, merged in one task and by contraction."""

import random

import pytest
from pyspark.sql import functions as F

from notegraph.llm import components as C


def plain(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("bound", [10**6, 40, 5])
def test_random_graphs(spark, bound):
    rng = random.Random(bound)
    edges = [(f"n{rng.randrange(400)}", f"n{rng.randrange(400)}") for _ in range(250)]
    edges += [(f"c{i}", f"c{i + 1}") for i in range(60)] + [("hub", f"h{i}") for i in range(80)] + [("x", "x"), (None, "y"), ("z", None)] + edges[:20]
    df = spark.createDataFrame(edges, "a string, b string").repartition(12)
    got = {r.node: r.component for r in C.components(df, "a", "b", bound).collect()}
    want = plain(edges)
    assert got == {n: min(x for x in want if want[x] == want[n]) for n in want}


def test_no_edges(spark):
    assert C.components(spark.createDataFrame([], "a string, b string"), "a", "b").count() == 0


QUEUE = "pair_key string, key_a string, key_b string, status string, decided_at string, a string, node string"


def test_latest_decision_holds(spark):
    rows = [
        ("b", "a", " Same ", "2024-01-01T10:00:00+02:00"), ("a", "b", "different", "2024-01-01T07:59:59Z"),  # the first is the later instant
        ("c", "d", "same", None), ("d", "c", "different", "2020-01-01T00:00:00+00:00"), ("e", "f", "SAME", "2024-01-01T00:00:00+00:00"), ("e", "f", "SAME", "2024-01-01T00:00:00+00:00"),
        ("f", "b", "same", None), ("g", "g", "same", None), (None, "a", "same", None), ("h", "i", None, None), ("j", "k", "same", "no date"),
    ]
    df = spark.createDataFrame([("p", a, b, s, d, "x", "y") for a, b, s, d in rows], QUEUE)
    got = {(r.group_key, r.name_key) for r in C.groups_from_queue(df).collect()}
    assert got == {("a", "a"), ("a", "b"), ("a", "e"), ("a", "f"), ("j", "j"), ("j", "k")}
    assert C.groups_from_queue(df.where(F.lit(False))).count() == 0
