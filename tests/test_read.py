"""Reading by name: paths, keys, aliases, shared names, missing pages, and the depths."""

import pytest
from pyspark.sql import functions as F

from notegraph.operators import parse as P
from notegraph.operators import read as R

BODY = "intro\n# Top\nalpha\n## Small Steps\n" + "word. " * 1500 + "\n## small step\nlast needle"


@pytest.fixture(scope="module")
def vault(spark):
    pages = spark.createDataFrame([("a/One.md", "one"), ("b/One.md", "one"), ("c/Two.md", "two"), ("d/Bare.md", "bare")], "path string, page_key string")
    aliases = spark.createDataFrame([("deux", "two"), ("lost", "nowhere"), (None, "two")], "alias_key string, canonical_key string")
    links = spark.createDataFrame([("x", "three", "Three", False), ("y", "three", "three", False), ("y", "two", "Two", True)], "source string, target_key string, display string, resolved boolean")
    texts = spark.createDataFrame([("c/Two.md", BODY), ("d/Bare.md", None)], "path string, body string")
    return pages, aliases, links, texts


def _ask(spark, vault, rows):
    pages, aliases, links, texts = vault
    requests = spark.createDataFrame(rows, "request int, name string, depth string, target string, from_part int").withColumn("path", F.lit("clash")).withColumn("body", F.lit(1))
    places = R.located(requests.select("name"), pages, aliases, links)
    return {r["request"]: r for r in R.read_texts(requests, places, texts).collect()}


def test_names_lead_to_pages(spark, vault):
    pages, aliases, links, _ = vault
    names = spark.createDataFrame([(n,) for n in ["a/One.md", "One", "ones", "Deux", "Two", "two", "Three", "Four", "lost", "", None, "Two"]], "name string")
    got = {r["name"]: (r["status"], r["path"], r["hits"], r["citing"]) for r in R.located(names, pages, aliases, links).collect()}
    assert got["a/One.md"] == ("OK", "a/One.md", 1, 0)
    assert got["One"] == got["ones"] == ("RETRY", None, 2, 0)
    assert got["Deux"] == got["Two"] == got["two"] == ("OK", "c/Two.md", 1, 0)
    assert got["Three"] == ("STOP", None, 0, 2)
    assert got["Four"] == got["lost"] == got[""] == ("STOP", None, 0, 0)
    assert len(got) == 10 and None not in got


def test_depths(spark, vault):
    asked = [
        (1, "Two", "outline", None, None), (2, "Two", "part", "SMALL-step", 1), (3, "Two", "part", "small step", 9), (4, "Two", "part", "none", 1), (5, "Two", "window", "NEEDLE", 1),
        (6, "Two", "window", "absent", 1), (7, "Two", None, None, -3), (8, "Two", "body", None, 1), (9, "Two", "part", "  ", 1), (10, None, "full", None, 1), (11, "Bare", "full", None, 1), (12, "One", "full", None, 1), (13, "Three", "body", None, 1),
    ]
    got = _ask(spark, vault, asked)
    assert sorted(got) == list(range(1, 14))
    assert got[1]["content"].split("\n")[0] == "Top (12)" and got[1]["content"].split("\n")[1].startswith("  Small Steps (")
    assert got[2]["content"].startswith("## Small Steps\n") and (got[2]["part"], got[2]["parts"]) == (1, 2)
    assert got[3]["part"] == 2 and got[2]["content"] + got[3]["content"] == BODY[BODY.index("## Small") : BODY.index("## small")]
    assert got[5]["content"].endswith("last needle") and got[7]["part"] == 1
    assert {i: got[i]["status"] for i in (4, 6, 8, 9, 10, 11, 12, 13)} == {4: "RETRY", 6: "STOP", 8: "RETRY", 9: "RETRY", 10: "STOP", 11: "STOP", 12: "RETRY", 13: "STOP"}
    assert got[13]["note"] == "no page yet; cited by 2" and got[10]["note"] == "no name" and got[11]["note"] == "no text"
    assert "".join(x for _, x, _ in P.parts_of(BODY)) == BODY


def test_empty_tables(spark, vault):
    pages, aliases, links, texts = (t.limit(0) for t in vault)
    assert _ask(spark, (pages, aliases, links, texts), [(1, "Two", "full", None, 1)])[1]["status"] == "STOP"
    none = spark.createDataFrame([], "request int, name string, depth string, target string, from_part int")
    assert R.read_texts(none, R.located(none, *vault[:3]), vault[3]).count() == 0


def test_meta(spark, vault):
    pages = spark.createDataFrame([("a.md", "a", None, None, None, None, None), ("b.md", "b", "note", "user", "S.", False, "0123456789")], "path string, page_key string, type string, origin string, summary string, summary_provisional boolean, content_hash string")
    e = spark.createDataFrame([("a.md", "b"), ("a.md", "c"), ("b.md", "b")], "source string, target_key string")
    got = {r["path"]: tuple(r)[4:] for r in R.page_meta(pages, e).collect()}
    assert got == {"a.md": (True, None, 2, 0), "b.md": (False, "01234567", 1, 2)}
