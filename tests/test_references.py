"""References to missing records against a plain loop, and the split of hot keys."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from notegraph.operators import references as R
from notegraph.operators import skew

T0 = datetime(2023, 1, 1)
LINKS = "source string, target_key string, display string, resolved boolean, indexed_at timestamp, name string, month string"
FILES = "path string, page_key string, created timestamp, name string, delta int"
REMOVALS = "path string, page_key string, created timestamp, removed_at timestamp"
ALIASES = "alias_key string, canonical_key string, kind string, added string"


def tables(spark, links, files, removals, aliases):
    return (
        spark.createDataFrame([(*x[:2], None, None, x[2], "n", "m") for x in links], LINKS), spark.createDataFrame([(*x, "n", 1) for x in files], FILES),
        spark.createDataFrame(removals, REMOVALS), spark.createDataFrame([(*x, None, None) for x in aliases], ALIASES),
    )


def report(links, files, removals, aliases, before=None):
    return R.missing_references(R.advance(links, files, removals, before), aliases)


def expected(links, files, removals, aliases):
    first = {}
    for s, t, at in links:
        if t:
            first[s, t] = min(x for x in (first.get((s, t)), at) if x is not None) if (first.get((s, t)) or at) else None
    step = dict(aliases)
    out = set()
    for (s, t), at in first.items():
        keys = {t, step.get(t)} - {None}
        now = any(k in keys for _, k, _ in files)
        then = any(k in keys and (c is None or c <= at) for _, k, c in files) or any(k in keys and r is not None and (c is None or c <= at) and at < r for _, k, c, r in removals)
        if not (then and now):
            out.add(("target_key", s, t))
        if s not in {p for p, _, _ in files}:
            out.add(("source", s, t))
    return out


def case(seed):
    rng = random.Random(seed)
    day = lambda: T0 + timedelta(hours=rng.randrange(9000))
    keys = [f"k{i}" for i in range(25)]
    files = [(f"p{i}", rng.choice(keys[:18]), None if rng.random() < 0.2 else day()) for i in range(30)] * 2
    removals = []
    for i in range(30):
        c = None if rng.random() < 0.2 else day()
        removals.append((f"r{i}", rng.choice(keys), c, (c or T0) + timedelta(hours=rng.randrange(0, 3000))))
    aliases = [("k20", "k3"), ("k21", "k20"), ("k22", "none"), ("k4", "k5")]
    links = [(rng.choice([f"p{i}" for i in range(35)] + [None]), rng.choice(keys + ["", None, "k1", "k1", "k1"]), day()) for _ in range(1500)]
    return links, files, removals, aliases


def test_against_loop(spark):
    data = case(5)
    assert {(r.field_name, r.source, r.target_key) for r in report(*tables(spark, *data)).collect()} == expected(*data)


def test_state_fed_in_batches(spark):
    links, files, removals, aliases = case(6)
    extra = ("p3", "k9", T0)  # a page that is there at first, withdrawn with the last batch and known as removed from then on
    state = None
    for i in range(3):  # later batches repeat rows, and bring references at earlier instants
        some = (links[i * 500 : i * 500 + 600], [*files[i * 20 : i * 20 + 25], *([extra] if i == 0 else [])], removals[i * 10 : i * 10 + 12], aliases)
        l, f, r, a = tables(spark, *some)
        state = R.advance(l, f, r, state)
    l, f, r, a = tables(spark, [], [extra], [("p3", "k9", T0, T0 + timedelta(hours=700))], aliases)
    state = R.advance(l, f.limit(0), r, state, withdrawn=f)
    whole = (links, [x for x in files if x in set(files[:65])], [*removals, ("p3", "k9", T0, T0 + timedelta(hours=700))], aliases)
    assert {(r.field_name, r.source, r.target_key) for r in R.missing_references(state, a).collect()} == expected(*whole)
    direct = R.advance(*tables(spark, *whole)[:3])
    assert sorted(map(tuple, state.counts.collect()), key=repr) == sorted(map(tuple, direct.counts.collect()), key=repr)
    assert sorted(map(tuple, R.orphan_keys(state, a).collect())) == sorted(map(tuple, R.orphan_keys(direct, a).collect()))


def test_empty_tables(spark):
    link = [("p", "k", T0)]
    assert report(*tables(spark, [], [], [], [])).count() == 0
    assert {r.field_name for r in report(*tables(spark, link, [], [], [])).collect()} == {"target_key", "source"}
    assert report(*tables(spark, link, [("p", "k", None)], [], [])).count() == 0
    assert {r.field_name for r in report(*tables(spark, [(None, "k", None)], [("p", "k", None)], [], [])).collect()} == {"source"}


def test_orphan_keys_follow_the_counts(spark):
    links, files, removals, aliases = tables(spark, [("x", "a", T0), ("y", "a", T0), ("x", "b", T0), ("x", "c", T0)], [("b", "b", T0)], [], [("c", "b")])
    state = R.advance(links, files, removals)
    assert {tuple(r) for r in R.orphan_keys(state, aliases).collect()} == {("a", 2)}
    later = R.advance(links.limit(0), files.limit(0), removals, state, withdrawn=files)
    assert {tuple(r) for r in R.orphan_keys(later, aliases).collect()} == {("a", 2), ("b", 1), ("c", 1)}


def test_salted_join_equals_plain_join(spark, monkeypatch):
    left = spark.range(40_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 500).cast("string"))).alias("k"), F.col("id").alias("n"))
    right = spark.createDataFrame([("hot", 1), ("k7", 2), ("k8", 3), (None, 4)], "rk string, v int")
    assert [r[0] for r in skew.hot_keys(left, "k").collect()] == ["hot"]
    for how in ("inner", "left_semi", "left_anti", "left"):
        mine, plain = skew.salted_join(left, right, "k", "rk", how), left.join(right, F.col("k") == F.col("rk"), how)
        assert mine.count() == plain.count() and mine.exceptAll(plain.select(mine.columns)).count() == 0
