"""The review queue, the encoder and concept pages."""

import random

import numpy as np
from pyspark.sql import functions as F

from notegraph.operators import concepts as C
from notegraph.operators import embed as E
from notegraph.operators import resolve as R
from notegraph.operators import review as V
from notegraph.operators import sync as Y

QUEUE = "pair_key string, key_a string, key_b string, display_a string, display_b string, source string, status string, weight int, mentions_at_ask int, asked_at string, decided_at string"


def queue(spark, *rows):
    return spark.createDataFrame([(f"{a}|{b}", a, b, a, b, "structure", s, w, n, "2024-01-01T00:00:00Z", None) for a, b, s, w, n in rows], QUEUE)


def test_mutual_nearest_against_brute_force(spark):
    rng = random.Random(3)
    names = sorted({"".join(rng.choice("abc ") for _ in range(rng.randrange(1, 9))) for _ in range(80)}) + ["lantern drift", "lantern drifts", "lantern draft"]
    grams = {n: {(" " + n + " ")[i : i + 3] for i in range(max(1, len(n)))} for n in names}
    cos = lambda a, b: round(len(grams[a] & grams[b]) / (len(grams[a]) * len(grams[b])) ** 0.5, 6)
    best = {a: [b for _, b in sorted((-cos(a, b), b) for b in names if b != a and cos(a, b) >= 0.6)[:3]] for a in names}
    want = {(a, b) for a in names for b in best[a] if a < b and a in best[b]}
    df = spark.createDataFrame([(n, n) for n in names], "key string, name string")
    assert {(r.key_a, r.key_b) for r in V.mutual_nearest(df).collect()} == want and want
    assert V.mutual_nearest(df.limit(0)).count() == 0


def test_queue_takes_candidates_and_answers(spark):
    q = queue(spark, ("a", "b", " Open ", 3, 3), ("a", "c", "unclear", 2, 2), ("b", "c", "unclear", 2, 9), ("c", "d", "same", 1, 1))
    pairs = V.candidate_pairs(spark.createDataFrame([("x", "y"), ("c", "a")], "key_a string, key_b string"), spark.createDataFrame([("y", "x"), ("z", "y")], "key_a string, key_b string"))
    assert {(r.pair_key, r.source) for r in pairs.collect()} == {("x|y", "structure"), ("a|c", "structure"), ("y|z", "proximity")}
    aliases = spark.createDataFrame([("z",)], "alias_key string")
    mentions = spark.createDataFrame([("x|y", 4), ("a|c", 5)], "pair_key string, mentions long")
    after = V.queue_after(q, pairs, aliases, mentions)
    assert {(r.pair_key, r.status, r.weight) for r in after.collect()} == {("a|b", "open", 3), ("a|c", "open", 2), ("b|c", "unclear", 2), ("c|d", "same", 1), ("x|y", "open", 4)}
    said = V.answered(q, spark.createDataFrame([("a|b", "same"), ("c|d", "different")], "pair_key string, answer string"))
    assert {r.pair_key: r.status for r in said.collect()} == {"a|b": "same", "a|c": "unclear", "b|c": "unclear", "c|d": "same"}
    assert [(r.pair_key, r["rank"]) for r in V.decided(q).where("status = 'unclear'").orderBy("rank").collect()] == [("a|c", 1), ("b|c", 2)]


def test_same_is_confirmed_the_other_way_round(spark):
    def judge(prompt):
        a, b = prompt.split("\n")
        if "boom" in prompt:
            raise RuntimeError("down")
        return '{"answer": "Same "}' if a.lower() == b.lower() or a < b else '{"answer": "different"}'

    pairs = spark.createDataFrame([("1", "a", "A"), ("2", "a", "b"), ("3", "b", "a"), ("4", "boom", "x")], "pair_key string, display_a string, display_b string")
    assert {tuple(r) for r in V.confirmed(pairs, judge).collect()} == {("1", "same"), ("2", "unclear"), ("3", "different"), ("4", "unclear")}


def test_lists_of_answers(spark):
    raw = ['[{"n": 1, "answer": "same"}]', 'Sure: {"answers": [{"n": 2, "answer": "unclear"}]}', "none", None]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(raw)], "i int, x string").orderBy("i").select(V.read_answers(F.col("x")).alias("a")).collect()
    assert [[tuple(x) for x in r.a] if r.a else r.a for r in got] == [[(1, "same")], [(2, "unclear")], None, None]


def test_missing_texts_are_encoded_once(spark):
    chunks = spark.createDataFrame([("p", 0, "jet break", "h1"), ("q", 0, "jet break", "h1"), ("p", 1, None, "h2"), ("p", 2, "x", "h3"), ("p", 3, "y", None)], "path string, seq int, text string, stripped_hash string")
    vectors = spark.createDataFrame([("h3", [1.0])], "stripped_hash string, vec array<float>")
    got = {r.stripped_hash: r.vec for r in E.encode_missing(chunks, vectors).collect()}
    assert set(got) == {"h1", "h2"} and len(got["h1"]) == E.DIM and abs(np.linalg.norm(got["h1"]) - 1) < 1e-6 and not any(got["h2"])


def test_concept_pages_need_two_verified_sentences(spark):
    found = spark.createDataFrame([("jet", "Jet", "a.md", 1, "A [[Jet]] is fast.  More."), ("jet", "Jet", "b.md", 1, "Jet is thin."), ("ink", "Ink", "a.md", 1, "Ink is dark.")], "key string, name string, path string, seq int, content string")

    def model(prompt):
        name = prompt.split("\n")[0]
        return '{"sentences": ["%s is made up.", "A Jet is fast.", "Jet is thin.", "Ink is dark."]}' % name

    defining = C.definitions(found, model)
    pages = C.concept_pages(defining)
    assert [(r.key, r.sentences, r.sources) for r in pages.collect()] == [("jet", 2, ["a.md", "b.md"])] and "origin: derived" in pages.first().text
    more = found.unionByName(spark.createDataFrame([("jet", "Jet", "c.md", 2, "Jet again.")], found.schema))
    assert [tuple(r) for r in C.stale(pages, more).collect()] == [("jet", "c.md")]


def test_pages_created(spark):
    new = spark.createDataFrame([("gammarayburst", "Gamma-ray burst"), ("jetbreak", "Jet break"), (None, "x"), ("nothing", None), ("jetbreak", "Jet break")], "key string, name string")
    unresolved = spark.createDataFrame([("grb", "GRB", 5), ("gr", "grb", 2), ("jetengine", "jet engine", 3), ("jetlag", "Jet lag", 3), ("jet", "jet", 1), ("breaknote", "break note", 9), ("jetbreak", "jet break", 8), ("known", "Jet known", 7), ("null", None, 9), ("abc", "abc", 4), ("jetbreak2", "Jet break 2", 6)], "target_key string, display string, n bigint")
    aliases = spark.createDataFrame([("known", "x"), (None, "y")], "alias_key string, canonical_key string")
    got = R.pages_created(new, unresolved, aliases)
    assert sorted((r.key, r.target_key, r.verdict) for r in got.collect()) == [("gammarayburst", "gr", "defer"), ("gammarayburst", "grb", "same"), ("jetbreak", "breaknote", "defer"), ("jetbreak", "jetengine", "defer"), ("jetbreak", "jetlag", "defer")]
    assert [tuple(r) for r in R.created_aliases(got).collect()] == [("grb", "gammarayburst", "acronym")]
    assert R.pages_created(new.limit(0), unresolved, aliases).count() == 0 and R.pages_created(new, unresolved.limit(0), aliases.limit(0)).count() == 0


def test_layout_drift_and_health(spark):
    recorded = spark.createDataFrame([("pages", "notes"), ("records", "log"), ("records", "talk"), (None, "x"), ("sources", None)], "folder string, path string")
    drift = Y.layout_drift(recorded, {"pages": "notes", "records": "talks", "concepts": "wiki", "sources": "src"})
    assert [tuple(r) for r in drift.collect()] == [("records", "log", "talks")]
    pages = spark.createDataFrame([("a", None), ("a", "a")], "content_hash string, analyzed_hash string")
    tried = spark.createDataFrame([("p", "failed"), ("q", None)], "path string, status string")
    gaps = spark.createDataFrame([("b", None, 4), ("a", "A", 9)], "target_key string, display string, n bigint")
    big = spark.createDataFrame([("p", 13, True), ("q", 2, False)], "path string, sections int, bloated boolean")
    assert tuple(Y.health(pages, tried, gaps, big, drift).first()) == (1, 1, 1, 2, "A (9), b (4)", 1, 13)
    assert tuple(Y.health(*(t.limit(0) for t in (pages, tried, gaps, big, drift))).first()) == (0, 0, 0, 0, None, 0, None)
