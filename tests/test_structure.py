"""Pairs of names are judged where they meet: none is shuffled or written, and each comes once."""

import random

from pyspark.sql import functions as F

from notegraph.functions import names as N
from notegraph.operators import resolve as R


def named(spark, n=150, seed=5):
    rng = random.Random(seed)
    words = ["Nipum", "Kettle", "Lantern", "Drift", "Tezur", "Archive", "Mast", "Orrery", "12", "2015", "7b"]
    names = sorted({" ".join(rng.sample(words, rng.randrange(1, 4))) for _ in range(n)} | {"NLD", "KLT", "Nipum Lantern Drift"} | {"Nip", "Ket", "Ab 1"})
    return spark.createDataFrame([("".join(x.lower().split()), x) for x in dict((("".join(x.lower().split()), x) for x in names)).values()], "key string, name string")


def above_the_join(df):
    """The plan's lines above the join by words."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [token" in plan
    return plan[: plan.index("SortMergeJoin [token")]


def by_hand(names, share):
    """All pairs, judged one by one."""
    words = R.token_df(names).where((F.col("df") <= share) & ~F.col("token").rlike("^[0-9]+$")).agg(F.collect_set("token")).first()[0]
    a, b = (names.select(F.col("key").alias(f"key_{s}"), F.col("name").alias(f"name_{s}"), R.T.tokens("name").alias(f"t{s}")) for s in "ab")
    few = F.array(*[F.lit(w) for w in words])
    shared = F.size(F.array_intersect(F.array_intersect("ta", "tb"), few)) > 0
    inside = F.col("key_a").contains(F.col("key_b")) | F.col("key_b").contains(F.col("key_a"))
    both = a.crossJoin(b).where("key_a < key_b").where((shared | inside) & (N.resolve_pair(F.col("name_a"), F.col("name_b")) == "defer"))
    return sorted((r.key_a, r.key_b) for r in both.collect())


def test_structural_pairs_come_once_and_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(R, "POSTINGS", 7)
    monkeypatch.setattr(R, "DF_SHARE", 0.3)
    names = named(spark)
    d = R.described(names, share=0.3)
    want = by_hand(names, max(3, int(names.count() * 0.3)))
    found = R.structural_pairs(d)
    assert sorted((r.key_a, r.key_b) for r in found.collect()) == want and len(want) > 100
    assert "Exchange" not in above_the_join(found)
    some = [(b, a) if i % 2 else (a, b) for i, (a, b) in enumerate(want) if i % 3 == 0] + [("nip", "zzz"), ("nip", "nip")]
    without = spark.createDataFrame(some, "key_a string, key_b string")
    left = {tuple(sorted(p)) for p in some}
    assert sorted((r.key_a, r.key_b) for r in R.structural_pairs(d, without).collect()) == [p for p in want if p not in left]
    assert sorted((r.key_a, r.key_b) for r in R.structural_among(d, without).collect()) == [p for p in want if p in left]
    assert R.structural_pairs(names.limit(0)).count() == 0


def test_partners_are_counted_where_they_meet(spark, tmp_path):
    from notegraph.plans import search as S

    spark.createDataFrame([("s", f"k{i}", f"Kettle n{i}", None) for i in range(40)], "source string, target_key string, display string, indexed_at timestamp").write.parquet(f"{tmp_path}/links.parquet")
    spark.createDataFrame([], "path string, page_key string, mtime timestamp, content_hash string").write.parquet(f"{tmp_path}/files.parquet")
    report = S.structural_report(spark, str(tmp_path))
    assert above_the_join(report).count("Exchange") == 1  # of the counts
    assert report.collect() == []  # a word of all names is not rare


def test_the_queue_takes_in_pairs_where_they_meet(spark, monkeypatch):
    from notegraph.operators import review as V
    from notegraph.operators.graph import mention_counts

    monkeypatch.setattr(R, "DF_SHARE", 0.3)
    names = named(spark, 60)
    keys = sorted(r.key for r in names.collect())
    rows = [(f"{a}|{b}", b, a, "unclear" if i % 2 else "same", i % 3) for i, (a, b) in enumerate(zip(keys, keys[3:])) if i % 4 == 0] + [(f"{keys[0]}|{keys[5]}", None, None, "open", 1)]
    queue = spark.createDataFrame([(p, a, b, a, b, "structure", s, 1, n, "2024-01-01T00:00:00Z", None) for p, a, b, s, n in rows], "pair_key string, key_a string, key_b string, display_a string, display_b string, source string, status string, weight int, mentions_at_ask int, asked_at string, decided_at string")
    aliases = spark.createDataFrame([(k,) for k in keys[::9]], "alias_key string")
    links = spark.createDataFrame([(k,) for i, k in enumerate(keys) for _ in range(i % 4)], "target_key string")
    proximity = spark.createDataFrame([(a, b) for a, b in zip(keys, keys[1:]) if len(a) % 2], "key_a string, key_b string")
    every = R.structural_pairs(names).select("key_a", "key_b")
    tidy = lambda df, *c: sorted(map(tuple, df.select(*c).collect()), key=repr)

    pairs = every.unionByName(queue.where("key_a is not null").select(F.least("key_a", "key_b").alias("key_a"), F.greatest("key_a", "key_b").alias("key_b"))).distinct()
    counts = mention_counts(pairs.select(N.pair_key(F.col("key_a"), F.col("key_b")).alias("pair_key"), "key_a", "key_b"), links)
    got = R.intake(names, queue, aliases, links)
    assert "Exchange" not in above_the_join(got)
    assert tidy(got, "pair_key", "action") == tidy(R.plan_queue(pairs, queue, aliases, counts), "pair_key", "action")

    d = R.described(R.with_mentions(names, aliases, links))
    want = V.candidate_pairs(every, proximity)
    got = V.all_candidates(d, proximity)
    assert "Exchange" not in above_the_join(got)
    assert tidy(got, "pair_key", "key_a", "key_b", "source") == tidy(want, "pair_key", "key_a", "key_b", "source")
    counts = mention_counts(want.select("pair_key", "key_a", "key_b").unionByName(queue.select("pair_key", "key_a", "key_b")), links)
    got = V.queue_after_all(queue, d, proximity, aliases, links)
    assert "Exchange" not in above_the_join(got)
    assert tidy(got, *V.COLUMNS) == tidy(V.queue_after(queue, want, aliases, counts), *V.COLUMNS)


def test_only_nearest_names_are_written(spark, monkeypatch):
    from notegraph.operators import review as V

    kept, plain = {}, V.written
    monkeypatch.setattr(V, "LISTED", 7)
    monkeypatch.setattr(V, "written", lambda df, label: kept.setdefault(label, plain(df, label)))
    names = spark.createDataFrame([(f"lantern drift {i}", f"lantern drift {i}") for i in range(10, 40)], "key string, name string")
    found = V.mutual_nearest(names).collect()
    assert found and kept["near"].count() <= 30 * V.NEAREST


def test_names_are_compared_within_tasks(spark, monkeypatch):
    from notegraph.operators import review as V

    plans, plain = {}, V.written

    def spy(df, label):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        return plain(df, label)

    monkeypatch.setattr(V, "written", spy)
    monkeypatch.setattr(V, "LISTED", 40)
    monkeypatch.setattr(V, "AT_ONCE", 64)
    rng = random.Random(8)
    stems = ["Lantern", "drift", "Ünü", "ßa", "\U0001d4b3y", "12", "x" * 300, "kettle kettle"]
    long = "".join(rng.choices("abcdefgh", k=200))
    names = ["", long, f"{long} 1", long[:150]] + sorted({" ".join(rng.choices(stems, k=rng.randrange(1, 4))) + str(rng.randrange(30)) for _ in range(150)})
    keys = [f"{rng.randrange(1000):03d}{i}" for i in range(len(names))]
    grams = {k: {f" {n.lower()} "[i : i + 3] for i in range(max(1, len(n)))} for k, n in zip(keys, names)}
    cos = lambda a, b: round(len(grams[a] & grams[b]) / (len(grams[a]) * len(grams[b])) ** 0.5, 6)
    best = {a: [b for _, b in sorted((-cos(a, b), b) for b in keys if b != a and cos(a, b) >= 0.6)[:3]] for a in keys}
    want = sorted((a, b, cos(a, b)) for a in keys for b in best[a] if a < b and a in best[b])
    df = spark.createDataFrame([*zip(keys, names), ("none", None), (None, "lantern12")], "key string, name string")
    assert sorted(map(tuple, V.mutual_nearest(df).collect())) == want and len(want) > 30
    assert "Join" not in plans["near"]  # no row for each meeting under a group


def test_seeds_are_found_without_the_links_displays(spark, monkeypatch):
    from notegraph.operators import review as V
    from notegraph.plans import review as PV
    from notegraph.plans.common import resolved

    d, got = "/root/testdata/sf0.001", {}
    monkeypatch.setattr(V, "proximity_pairs", lambda names, seeds: got.setdefault("seeds", seeds).sparkSession.createDataFrame([], "key_a string, key_b string"))
    PV._candidates(spark, d)
    want = {r[0] for r in resolved(spark, d).where("not resolved").select("target_key").collect()}
    found = [r.key for r in got["seeds"].collect()]
    assert set(found) == want and len(found) == len(want) > 5
    assert "display" not in got["seeds"]._jdf.queryExecution().executedPlan().toString()


def test_the_queue_meets_no_names_by_join(spark, monkeypatch):
    from notegraph.operators import review as V
    from notegraph.plans import review as PV

    plans, plain = {}, V.written

    def spy(df, label):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        return plain(df, label)

    monkeypatch.setattr(V, "written", spy)
    after = PV.queue_after(spark, "/root/testdata/sf0.001")
    assert "FlatMapGroupsInArrow" in plans["near"] and "Join" not in plans["near"] and after.columns == ["pair_key", "status", "weight"]
