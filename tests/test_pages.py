"""Parsing, chunking, linking, repair, answers and page changes."""

import random

import pytest
from pyspark.sql import functions as F

from notegraph.operators import analysis as A
from notegraph.operators import linker as L
from notegraph.operators import pages as V
from notegraph.operators import parse as P
from notegraph.operators import resolve as R
from notegraph.operators import search as S
from notegraph.operators import sync as Y

PAGE = """---
type: concept
tags: [a, #b, , c]
summary: "Say: it \\"now\\"."
sources:
  - https://example.com
origin: user
origin: derived
---

# Title

Text with [[Jet break|the break]], [[jet breaks]] and [[Other
name]].

## Next
more
"""


def pages(spark, *texts):
    return spark.createDataFrame([(f"notes/p{i}.md", t) for i, t in enumerate(texts)], "path string, text string")


def test_parse(spark):
    r = P.parse_pages(pages(spark, PAGE, "no frontmatter. At all.", None, "---\nsummary: x\nsummary_provisional: 0\n---\nb")).orderBy("path").collect()
    assert (r[0].type, r[0].origin, r[0].summary, r[0].summary_provisional, r[0].tags) == ("concept", "derived", 'Say: it "now".', True, ["a", "b", "c"])
    assert (r[1].summary, r[1].summary_provisional, r[1].body) == ("no frontmatter.", True, "no frontmatter. At all.")
    assert r[2].body is None and r[3].summary_provisional is False
    links = P.extract_links(P.parse_pages(pages(spark, PAGE))).collect()
    assert {(x.target_key, x.display) for x in links} == {("jetbreak", "the break"), ("othername", "Other name")}


def test_chunks_and_outline(spark):
    long = "# H\n" + "\n\n".join(" ".join(["word"] * 150) for _ in range(5))
    rows = P.chunk_pages(P.parse_pages(pages(spark, PAGE, long, "", None))).orderBy("path", "seq").collect()
    assert [(r.seq, r.heading, r.is_summary) for r in rows if r.path.endswith("p0.md")] == [(0, None, True), (1, "Title", False), (2, "Next", False)]
    assert [len(r.content.split()) for r in rows if r.path.endswith("p1.md") and r.seq] == [300, 300, 150]
    assert [(r.level, r.heading) for r in P.outline(P.parse_pages(pages(spark, PAGE))).collect()] == [(1, "Title"), (2, "Next")]
    assert P.section(P.parse_pages(pages(spark, PAGE)), "next").first().content.strip() == "more"


def test_windows_and_parts(spark):
    df = pages(spark, "x" * 1000, "short", "")
    assert [len(r[0]) for r in df.select(P.windows(F.col("text"), 300)).collect()] == [4, 1, 0]
    rng = random.Random(3)
    for _ in range(50):
        text = "".join(rng.choice(["word ", "End. ", "\n\n", "\n# H\n", "xxxxxxxxxx"]) for _ in range(rng.randrange(400)))
        parts = P.parts_of(text, 300)
        assert "".join(t for _, t, _ in parts) == text and all(len(t) <= 300 for _, t, _ in parts)
    assert P.parts_of("a" * 100, 60)[0] == (0, "a" * 60, True)


def test_linker_invariants():
    body = "---\ntype: note\n---\n# jet engine\nThe jet\nengine and `jet engine` in $jet engine$, [[shock]] and a Shock. jet engine again. ```\njet engine\n``` [n_0]"
    linked, n = L.place_links(body, ["jet engine", "shock", "engine", "[n_0]"], {"jetengine": "Jet engine"})
    assert "[[Jet engine|jet\nengine]]" in linked and n["to_page"] == 1 and n["again"] >= 2 and n["inside"] >= 3
    assert L.place_links(linked, ["jet engine", "shock", "engine"], {"jetengine": "Jet engine"})[0] == linked
    strip = lambda t: L.re.sub(r"\[\[([^\]]+)\]\]", r"\1", L.re.sub(r"\[\[[^\]|]+\|([^\]]+)\]\]", r"\1", t))
    assert strip(linked) == strip(body) and L.place_links(body, [], {}) == (body, dict.fromkeys(n, 0))


def test_repair_is_idempotent(spark):
    body = "[[[a]]] [[b]] [c] [[[[d|e]]] `[[[x]]]` $[[[y]]]$ [t](u) ```\n[[[z]]]\n```"
    once = "[[a]] [[b]] [c] [[d|e]] `[[[x]]]` $[[[y]]]$ [t](u) ```\n[[[z]]]\n```"
    got = L.repair_pages(spark.createDataFrame([("p", body), ("q", once), ("r", None), ("s", "")], "path string, body string")).collect()
    assert [tuple(r) for r in got] == [("p", once, 2)]


def test_json_repair_and_gates(spark):
    raw = ['```json\n{"a": 1}\n```', 'Sure: {"a": 1} bye', "<think>{x}</think>{\"a\": 1,}", "garbage", None, '{"a": 1}']
    got = spark.createDataFrame([(i, x) for i, x in enumerate(raw)], "i int, x string").orderBy("i").select(A.repair_json(F.col("x")).alias("r")).collect()
    assert [r.r.repairs for r in got] == [["code fence"], ["preamble", "trailing text"], ["trailing comma"], ["unparseable"], [], []]
    assert [r.r.json is not None for r in got] == [True, True, True, False, False, True]
    df = spark.createDataFrame([("p", "A jet break and [[GRB]] here. " + "w " * 500, ["jet break", "Jet Break", "[[GRB]]", "absent", None])], "path string, body string, c array<string>")
    row = A.gate_concepts(df, "c").first()
    assert row.survivors == ["jet break", "GRB"] and row.low is False


def test_rare_words_reach_the_share_of_the_names(spark, monkeypatch):
    monkeypatch.setattr(R, "POSTINGS", 10)
    names = [(f"k{i}", f"alone{i} {'lantern' if i < 104 else 'drift' if i < 209 else 'x' + str(i)}") for i in range(5200)]
    got = R.rare_token_pairs(spark.createDataFrame(names, "key string, name string")).collect()
    keys = [f"k{i}" for i in range(104)]
    assert len(got) == 104 * 103 // 2 and {tuple(r) for r in got} == {(a, b) for a in keys for b in keys if a < b}


def test_intake_plans_pairs_that_the_queue_does_not_know(spark):
    names = spark.createDataFrame([("jetbreak", "jet break"), ("jetstop", "jet stop"), ("jetcut", "jet cut"), ("amber", "amber")], "key string, name string")
    row = lambda a, b, status, asked: ("|".join(sorted((a, b))), a, b, status, asked, None, None)
    queue = spark.createDataFrame([row("jetstop", "jetbreak", "unclear", 1), row("amber", "old", "open", 0)], "pair_key string, key_a string, key_b string, status string, mentions_at_ask int, asked_at string, decided_at string")
    aliases = spark.createDataFrame([("jetcut",)], "alias_key string")
    links = spark.createDataFrame([("jetbreak",), ("jetstop",)], "target_key string")
    got = {tuple(r) for r in R.intake(names, queue, aliases.where("alias_key = 'none'"), links).collect()}
    assert got == {("jetbreak|jetstop", "reopen"), ("amber|old", "skip"), ("jetbreak|jetcut", "insert"), ("jetcut|jetstop", "insert")}
    assert {r.action for r in R.intake(names, queue, aliases, links).collect() if "jetcut" in r.pair_key} == {"skip"}


def counting(folder, answer):
    """A model that leaves a file for each call, so that calls in any process are counted."""
    import uuid

    def model(prompt):
        (folder / uuid.uuid4().hex).write_text(prompt)
        return answer(prompt)

    return model, lambda: sorted(x.read_text() for x in folder.iterdir())


def test_analysis_isolates_failures(spark, tmp_path):
    def answer(prompt):
        if "boom" in prompt:
            raise RuntimeError("down")
        if "full" in prompt:
            return '{"summary": "One thing.", "concepts": []}', 7900
        return '{"summary": "One thing.", "concepts": ["jet"]}' if "jet" in prompt else "nonsense"

    model, calls = counting(tmp_path, answer)
    df = spark.createDataFrame([("a", "a jet here"), ("b", "boom"), ("c", "other"), ("d", "x" * 40_000), ("e", None), ("f", "full")], "path string, body string")
    got = A.analyse(df, model)
    rows = {r.path: (r.status, r.note) for r in got.collect()}
    assert rows == {"a": ("ok", None), "b": ("failed", "RuntimeError: down"), "c": ("failed", "unparseable"), "d": ("failed", "larger than the context"), "f": ("failed", A.TRUNCATED)}
    got.count()
    assert [c for c in calls() if len(c) < 50] == sorted(["a jet here", "boom", "boom", "full", "other", "other"])  # each answer once, however often it is read


def test_commit_and_record(spark):
    pages = spark.createDataFrame([
        ("notes/a.md", "A jet here and a shock.", "note", None), ("notes/b.md", "A jet here and a shock.", "note", "derived"),
        ("sources/c.md", "A jet.", "source", None), ("notes/d.md", "A jet.", "note", None),
    ], "path string, body string, type string, origin string")
    pages = pages.withColumn("content_hash", A.T.content_hash("body"))
    analysed = pages.select("path", F.when(F.col("path") == "notes/d.md", "failed").otherwise("ok").alias("status"), F.lit(None).cast("string").alias("note"), F.array(F.lit("jet"), F.lit("shock")).alias("concepts"))
    index, known = spark.createDataFrame([("jet", "Jet")], "key string, canonical string"), spark.createDataFrame([("shock",)], "key string")
    got = {r.path: (r.linked, r.status) for r in A.commit(pages, analysed, index, known).collect()}
    assert got == {
        "notes/a.md": ("A [[Jet|jet]] here and a [[shock]].", "ok"), "notes/b.md": ("A jet here and a [[shock]].", "ok"), "sources/c.md": ("A jet.", "ok"), "notes/d.md": (None, "failed"),
    }
    moved = A.commit(pages.withColumn("content_hash", F.lit("other")), analysed, index, known).where("path = 'notes/a.md'").first()
    assert (moved.linked, moved.status, moved.note) == (None, "failed", "the hash moved")
    tried = analysed.join(pages.select("path", "content_hash"), "path").select("path", "content_hash", "status", "note")
    first = A.record(tried.withColumn("at", F.lit("")).limit(0), tried, F.lit("2024-01-01"))
    again = A.record(first, tried.where("path = 'notes/d.md'").withColumn("status", F.lit("ok")), F.lit("2024-01-02"))
    assert A.pass_counts(first).first().asDict() == {"ok": 3, "low_yield": 0, "failed": 1} and A.pass_counts(again).first().ok == 4
    left = A.attempted(pages.withColumn("analyzed_hash", F.lit(None).cast("string")), first).where("not (analyzed_hash <=> content_hash)")
    assert left.count() == 0


def test_long_pages_and_transcripts_are_read_in_windows(spark):
    import json
    import re

    def model(prompt):
        if len(prompt) > A.room(8192):
            raise RuntimeError("too long")
        return "nonsense" if "garble" in prompt else json.dumps({"summary": "New.", "concepts": re.findall(r"early jet|late jet", prompt)})

    long = "early jet " + "y" * 35_000 + " late jet"
    rows = [("a", long, "concept", "Kept."), ("b", "early jet", "transcript", "Said."), ("c", "garble", "transcript", "Said."), ("d", long + " garble", "concept", "Kept."), ("e", "early jet", None, "Old.")]
    df = spark.createDataFrame(rows, "path string, body string, type string, summary string")
    got = {r.path: (r.status, r.note, r.summary, r.concepts) for r in A.analyse(df, model).collect()}
    assert got == {
        "a": ("ok", "read in windows", "Kept.", ["early jet", "late jet"]), "b": ("ok", None, "Said.", ["early jet"]), "c": ("failed", "every window failed", None, []),
        "d": ("ok", "read in windows; 1 of 2 windows failed", "Kept.", ["early jet"]), "e": ("ok", None, "New.", ["early jet"]),
    }


def versions(spark, *rows):
    return spark.createDataFrame([(p, 1, t, None, False) for p, t in rows], V.SCHEMA)


def test_write_guards(spark):
    v = versions(spark, ("notes/a.md", "# A\nold\n## B\nx"), ("conversations/c.md", "said"))
    seen = V.write(v, "notes/a.md", "new", "00000000").note.rsplit(" ", 1)[1]
    assert V.write(v, "notes/a.md", "new", seen[:4]).status == "RETRY"
    done = V.write(v, "notes/a.md", "more", seen, "section", "b")
    assert done.status == "DONE"
    text = {r.path: r.text for r in V.current(v.unionByName(done.versions)).collect()}["notes/a.md"]
    assert "more" in text and "\nx" not in text and "old" in text
    assert V.write(v, "conversations/c.md", "x", seen).status == "STOP" and V.write(v, "wiki/x.md", "x", "new").status == "STOP"
    assert V.write(v, "notes/a.md", "old", "new").note == f"the page exists: {seen}" and V.write(v, "notes/zz.md", "x", seen).status == "RETRY"
    assert V.write(v, "notes/n.md", "---\nsummary: mine\n---\nx", "new").status == "STOP"


def test_relocate_and_remove(spark):
    v = versions(spark, ("notes/jet break.md", "self [[jet break]]"), ("notes/b.md", "see [[Jet breaks]] and [[jet break|it]] [[other]]"), ("notes/c.md", "none"))
    moved = V.relocate(v, "notes/jet break.md", "wiki/Jet stop.md")
    now = {r.path: r.text for r in V.current(v.unionByName(moved.versions)).collect()}
    assert set(now) == {"wiki/Jet stop.md", "notes/b.md", "notes/c.md"}
    assert now["notes/b.md"] == "see [[Jet stop|Jet breaks]] and [[Jet stop|it]] [[other]]"
    assert V.relocate(v, "notes/b.md", "notes/c.md").status == "STOP" and V.relocate(v, "nope.md", "x.md").status == "RETRY"
    gone = V.remove(v, "notes/c.md")
    assert "notes/c.md" not in {r.path for r in V.current(v.unionByName(gone.versions)).collect()}


def test_sync(spark):
    known = spark.createDataFrame([("a", 1), ("b", 2), ("c", None), ("d", 4)], "path string, mtime int")
    disk = spark.createDataFrame([("a", 1), ("b", 3), ("c", None), ("e", 5)], "path string, mtime int")
    assert {r.path: r.change for r in Y.difference(known, disk).collect()} == {"a": "same", "b": "changed", "c": "same", "d": "gone", "e": "new"}
    assert not Y.deletable(Y.difference(known, disk.limit(0))) and Y.deletable(Y.difference(known, disk))
    stored = spark.createDataFrame([("a", "h1", "done"), ("b", "h2", "old")], "path string, content_hash string, analyzed_hash string")
    fresh = spark.createDataFrame([("b", "h3", None), ("z", "h4", None)], stored.schema)
    assert {tuple(r) for r in Y.upsert(stored, fresh, spark.createDataFrame([("a",)], "path string")).collect()} == {("b", "h3", "old"), ("z", "h4", None)}


BM25 = ["jet break appears", "jet engine", "the break is mentioned jet break twice break", "sonlanma koşulu Döngü", "notes-tr title", "filler words only here and more"]


HITS = {
    "jet break": {2: 0.771558, 0: 0.663826, 1: 0.000001}, "kosulu": {3: 1.467363}, "DONGU": {3: 1.467363}, "notes-tr": {4: 1.467363}, "tr": {4: 1.467363},
    'a"b jet': {}, '"jet': {}, "++": {}, "C++": {}, "": {}, "jet-break": {2: 0.894462, 0: 1.133334}, "break-jet": {},
}


def test_bm25(spark):
    chunks = spark.createDataFrame([(f"p{i}", 0, t) for i, t in enumerate(BM25)], "path string, seq int, text string")
    queries = spark.createDataFrame([*HITS.items(), ("none", None)], "query_id string, text string").withColumn("text", F.when(F.col("query_id") != "none", F.col("query_id")))
    got = {q: {} for q in HITS}
    for r in S.bm25(S.build_index(chunks), queries).collect():
        got[r.query_id][int(r.path[1:])] = r.score
    wrong = {q: (got[q], HITS[q]) for q in HITS if got[q] != HITS[q] and q != "jet-break"}
    assert not wrong and set(got["jet-break"]) == {0, 2} and set(got) == set(HITS)
    empty = S.build_index(chunks.limit(0))
    assert S.bm25(empty, queries).count() == 0 == S.bm25(S.build_index(chunks), queries.limit(0)).count()


def test_dense_against_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    vec = lambda: [rng.gauss(0, 1) for _ in range(8)]
    rows = [(f"h{i}", vec()) for i in range(60)] + [("h3", [0.0] * 8), ("h4", None), ("h5", [1.0]), ("h6", [float("nan")] * 8), ("unused", vec())]
    vectors = spark.createDataFrame(rows, "stripped_hash string, vec array<float>")
    chunks = spark.createDataFrame([(f"p{i}", 0, f"h{i}") for i in range(60)] + [("x", 1, "h7"), ("y", 1, None)], "path string, seq int, stripped_hash string")
    queries = spark.createDataFrame([(i, vec()) for i in range(7)] + [(9, None)], "query_id int, vec array<float>")
    monkeypatch.setattr(S, "SENT", 3)
    got = {(r.query_id, r.rank): r.path for r in S.top(S.dense(chunks, vectors, queries, 8, 5), 5).collect()}
    for q, v in [(r.query_id, list(r.vec)) for r in queries.where("vec is not null").collect()]:
        cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5
        best = sorted([(-round(cos(v, x), 6), f"p{h[1:]}") for h, x in rows[:60]] + [(-round(cos(v, rows[7][1]), 6), "x")])[:5]
        assert [got[q, i] for i in range(5)] == [p for _, p in best]
    assert S.dense(chunks.limit(0), vectors, queries, 8).count() == 0


def test_fold_order(spark):
    lists = [spark.createDataFrame([("q", p, 0, i) for i, p in enumerate(x)], "query_id string, path string, seq int, rank int") for x in ("xbc", "ybc")]
    assert [r.path for r in S.fold(S.fuse(*lists)).orderBy("rank").collect()][0] == "b"


def test_transcript(spark):
    t = spark.createDataFrame([(1, 2, "assistant", " ok "), (1, 1, "user", "hi"), (1, 3, "system", "x"), (1, 4, "user", " ")], "conv_id int, turn int, role string, text string")
    assert A.transcript(t).first().text == "## user\n\nhi\n\n## assistant\n\nok"
