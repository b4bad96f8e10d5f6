"""Leaked passages against word-by-word search, and stuffed pages on held-out made-up ones."""

import random

import pytest

from notegraph.llm import leaks as L
from notegraph.llm import pages as P

rng = random.Random(11)
VOCAB = ["".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(rng.randrange(1, 5))) for _ in range(900)]
DOCS = "doc_id bigint, text string, source string, passage string, item_id string"


def words(n):
    return [rng.choice(VOCAB) for _ in range(n)]


PASSAGE = words(60)
FILL = " ".join(words(300))


def changed(part, every):
    return [("qqq" + w if i % every == every // 2 else w) for i, w in enumerate(part)]


CASES = {
    "whole": (" ".join(PASSAGE), True), "twenty words": (" ".join(PASSAGE[17:37]), True), "one in ten changed": (" ".join(changed(PASSAGE[:40], 10)), True),
    "marked up": (" ".join(f"<b>{w.upper()}</b>," if i % 3 else f"[[page|{w}]]\n" for i, w in enumerate(PASSAGE[:30])), True), "entities": ("&nbsp;".join(PASSAGE[5:35]), True),
    "accents and soft hyphens": (" ".join(w.replace("a", "á")[:2] + "­" + w.replace("a", "á")[2:] for w in PASSAGE[:30]), True),
    "two stretches": (" ".join(PASSAGE[:22]) + " " + " ".join(words(40)) + " " + " ".join(PASSAGE[30:52]), True),
    "short quote": (" ".join(PASSAGE[:12]), False), "other order": (" ".join(w for i in range(0, 60, 3) for w in PASSAGE[57 - i : 60 - i]), False),
    "one in three changed": (" ".join(changed(PASSAGE, 3)), False), "nothing": ("", False),
}


@pytest.mark.parametrize("name", CASES)
def test_leak(name):
    text, leaks = CASES[name]
    p = L.Passages([(7, " ".join(PASSAGE)), (8, None), (9, ""), (10, "too short")])
    assert p.leaks([FILL + " " + text + " " + FILL, FILL]) == ([(0, 0)] if leaks else []), name


def test_leak_rows(spark):
    docs = [(1, FILL + " ".join(PASSAGE), "s", "p", "i"), (2, None, "s", "p", "i"), (3, "", None, None, None), (4, FILL * 40 + " ".join(PASSAGE), "s", "p", "i"), (5, FILL + " ".join(PASSAGE), "s", "p", "i")]
    df = spark.createDataFrame(docs, DOCS)
    items = spark.createDataFrame([(7, " ".join(PASSAGE), "t"), (8, None, "t"), (9, " ".join(words(50)), "t")], "item_id bigint, passage string, text string")
    assert {tuple(r) for r in L.leaked_items(df, items).collect()} == {(1, 7), (4, 7), (5, 7)}
    assert L.leaked_items(df.limit(0), items).count() == 0 and L.leaked_items(df, items.limit(0)).count() == 0


def test_passes_over_large_item_sets(spark, monkeypatch):
    monkeypatch.setattr(L, "MAX_ITEMS_BYTES", 400)
    items = spark.createDataFrame([(i, " ".join(PASSAGE)) for i in range(5)], "item_id bigint, passage string")
    docs = spark.createDataFrame([(1, " ".join(PASSAGE), "s", "p", "i")], DOCS)
    assert L.leaked_items(docs, items).count() == 5


def prose(n):
    return " ".join(" ".join(words(rng.randrange(6, 14))).capitalize() + "." for _ in range(n))


def stuffed(kind):
    goods = [" ".join(words(2)) for _ in range(4)]
    many = [rng.choice(goods) for _ in range(60)]
    return {
        "commas": ", ".join(many), "lines": "\n".join(many), "links": "\n".join(f"- [{x}](https://x.example/{i})" for i, x in enumerate(many)),
        "wiki": " ".join(f"[[{x}|buy]]" for x in many), "tags": " ".join("#" + x.replace(" ", "_") for x in many), "html": "".join(f'<li><a href="https://x.test/{i}">{x}</a></li>' for i, x in enumerate(many)),
    }[kind]


KINDS = ("commas", "lines", "links", "wiki", "tags", "html")


def honest(i):
    return [
        lambda: prose(12), lambda: "# Log\n" + "\n".join(f"2024-01-{d:02d} 10:00 sync ok pages={d} a.md" for d in range(1, 25)),
        lambda: "```\n" + "x = f(1)\n" * 30 + "```", lambda: "\n".join(f"| {a} | {i}.5 | ok |" for i, a in enumerate(words(25))),
        lambda: "\n".join(f"- [[{w}]] {prose(1)}" for w in words(10)), lambda: "[[stub]]", lambda: prose(10) + "\n\n- [[a]]\n- [[b]]\n- [[c]]",
        lambda: (prose(1) + "\n" + prose(1) + "\n") * 8, lambda: "---\ntags: [a, b]\n---\n" + prose(8),
    ][i % 9]()


def test_stuffed_pages(spark):
    docs = [(i, stuffed(KINDS[i % 6]) if i % 4 == 0 else honest(i), "host", "p", "x") for i in range(400)]
    docs += [(1000, None, None, "p", "x"), (1001, "", "h", "p", "x"), (1002, stuffed("commas") + "\n\n" + prose(2), None, "p", "x"), (1003, prose(60) + "\n\n" + stuffed("tags")[:200], "host", "p", "x")]
    df = spark.createDataFrame(docs, DOCS)
    got = {r.doc_id for r in P.stuffed_pages(df).collect()}
    assert got == {i for i in range(0, 400, 4)} | {1002}


def test_stuffed_pages_without_examples(spark):
    df = spark.createDataFrame([(i, prose(5), "h", "p", "x") for i in range(5)], DOCS)
    assert P.stuffed_pages(df).count() == 0 and P.stuffed_pages(df.limit(0)).count() == 0
    assert {tuple(map(len, P.measures(x))) for x in ("x" * 200_000, " ", "", "---\n---\n")} == {(len(P.SIGNS), len(P.FEATURES))}


def test_counting_without_a_full_table(monkeypatch):
    monkeypatch.setattr(L, "DENSE", 0)
    p = L.Passages([(7, " ".join(PASSAGE)), (9, " ".join(words(50)))])
    assert p.leaks([FILL + " " + " ".join(PASSAGE[10:40]), FILL]) == [(0, 0)]


@pytest.mark.parametrize("end", ["\r\n", "\r"])
def test_line_ends_make_no_difference(end):
    for text in (stuffed("lines"), stuffed("links"), honest(1), "---\ntype: x\n---\n\n# H\n\n" + stuffed("tags")):
        mine, plain = P.measures(text.replace("\n", end)), P.measures(text)
        assert mine[0] == plain[0] and mine[1][:14] == plain[1][:14]


def test_trees_do_not_see_the_rules():
    assert not set(P.SIGNS) & set(P.FEATURES)
    signs, x = P.measures("ink refill Nr. 823994 45.16 free shipping\n" * 30)
    assert signs == [1.0, 0.0, 0.0] and x[P.FEATURES.index("endless")] == 1.0
