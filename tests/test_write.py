"""Writing many pages at once: the rules in their order, and the texts that come out."""

import hashlib

import pytest
from pyspark.sql import functions as F

from notegraph.operators import pages as V

TALK = "---\ntype: note\norigin: conversation\nsummary: Kept.\n---\n\n# T\n\nWe found  it.\n"
PLAIN = "---\ntags: [a]\nsources:\n  - x\n---\n\n# A\nold\n\n## Part ones\nx\n\n## Next\ny\n"
REQUEST = "request int, path string, content string, where string, target string, expect string"
DAY = "2024-05-06"
SEEN = hashlib.sha1(PLAIN.split("---\n\n", 1)[1].strip().encode()).hexdigest()[:8]
NOTHING = hashlib.sha1(b"").hexdigest()[:8]
#: path, content, where, target, expect; what comes out: status and note (None: any)
CASES = [
    (("notes/a1.md", "x", "end", None, None), "RETRY", "no hash was given"),
    (("notes/a2.md", "x", "top", None, SEEN), "RETRY", None),
    (("log/new.md", "x", None, None, "new"), "STOP", "records can't be written"),
    (("log/1.md", "x", "end", None, SEEN), "STOP", "records can't be written"),
    (("conversations/n.md", "x", None, None, "new"), "STOP", "records can't be written"),
    (("wiki/n.md", "x", None, None, "new"), "STOP", None),
    (("notes/a3.md", "x", "end", None, "new"), "RETRY", f"the page exists: {SEEN}"),
    (("notes/none.md", "x", "end", None, SEEN), "RETRY", "there is no such page"),
    (("notes/a4.md", "x", "end", None, SEEN[:4]), "RETRY", f"the page has changed: {SEEN}"),
    (("n.md", "---\norigin: me\n---\nx", None, None, "new"), "STOP", "fields of the system can't be set"),
    ((None, "x", None, None, "new"), "RETRY", "no path was given"),
    (("notes/a5.md", None, "end", None, SEEN), "RETRY", "no content was given"),
    (("notes/t2.md", "We found it.", None, None, "new"), "DONE", "the page says so already"),
    (("notes/a6.md", "x", "frontmatter", "summary", SEEN), "STOP", "fields of the system can't be set"),
    (("notes/a7.md", "x", "frontmatter", "created", SEEN), "STOP", "fields of the system can't be set"),
    (("notes/a8.md", "x", "frontmatter", "a b", SEEN), "RETRY", "there is no such field"),
    (("notes/a9.md", "x", "frontmatter", None, SEEN), "RETRY", "there is no such field"),
    (("notes/b1.md", "x", "section", "none", SEEN), "RETRY", "there is no such heading"),
    (("notes/b2.md", "x", "section", None, SEEN), "RETRY", "there is no such heading"),
    (("notes/b3.md", " new ", "section", "part-one", SEEN), "DONE", "written"),
    (("notes/b3.md", "late", "end", None, SEEN), "RETRY", "another request came first"),
    (("notes/t.md", "More.", None, None, "new"), "DONE", "written"),
    (("fresh.md", "---\ntype: concept\n---\nBody here. Second.", "section", "ignored", "new"), "DONE", "written"),
    (("notes/gone.md", "Back.", "end", None, "new"), "DONE", "written"),
    (("notes/null.md", "Now.", "whole", None, NOTHING), "DONE", "written"),
    (("notes/b4.md", "seen: once", "frontmatter", "tags", SEEN), "DONE", "written"),
    (("notes/b5.md", "end.", "section", "NEXT", SEEN), "DONE", "written"),
]


@pytest.fixture(scope="module")
def versions(spark):
    rows = [("notes/b3.md", 1, "older", False), ("notes/t.md", 1, TALK, False), ("notes/t2.md", 1, TALK, False), ("notes/gone.md", 3, "was", True), ("log/1.md", 1, "---\ntype: transcript\n---\nhi", False), ("notes/null.md", 1, None, False)]
    rows += [(f"notes/{x}{i}.md", 2, PLAIN, False) for x in "ab" for i in range(1, 10)]
    return spark.createDataFrame(rows, "path string, version bigint, text string, removed boolean").withColumn("mtime", F.lit(None).cast("timestamp"))


@pytest.fixture(scope="module")
def said(spark, versions):
    requests = spark.createDataFrame([(i, *r) for i, (r, _, _) in enumerate(CASES)], REQUEST).withColumn("text", F.lit("clash"))
    out = V.write_pages(versions, requests, F.lit(DAY)).collect()
    assert sorted(r["request"] for r in out) == list(range(len(CASES)))
    return sorted(out, key=lambda r: r["request"])


def test_rules(said):
    for (request, status, note), r in zip(CASES, said):
        assert r["status"] == status and note in (None, r["note"]), request
        assert (r["text"] is not None) == (r["note"] == "written") == (r["version"] is not None), request


def test_texts(said):
    by = {r["path"]: r for r in said if r["text"]}
    head = "---\ntags: [a]\nsources:\n  - x\ncreated: 2024-05-06\nupdated: 2024-05-06\norigin: conversation\nsummary: old new y\nsummary_provisional: 1\n---\n\n"
    assert by["notes/b3.md"]["text"] == head + "# A\nold\n\nnew\n\n## Next\ny\n" and by["notes/b3.md"]["version"] == 3
    assert by["notes/t.md"]["text"] == "---\ntype: note\norigin: conversation\nsummary: Kept.\ncreated: 2024-05-06\nupdated: 2024-05-06\n---\n\n# T\n\nWe found  it.\n\n## 2024-05-06\n\nMore.\n"
    fresh = by["notes/fresh.md"]["text"]
    assert fresh.startswith("---\ntype: concept\ncreated: 2024-05-06\n") and fresh.endswith("summary: Body here.\nsummary_provisional: 1\n---\n\nBody here. Second.\n")
    assert by["notes/gone.md"]["version"] == 4 and "type: note" in by["notes/gone.md"]["text"]
    assert by["notes/null.md"]["version"] == 2 and by["notes/null.md"]["text"].endswith("\n\nNow.\n")
    assert 'tags: "seen: once"\n' in by["notes/b4.md"]["text"] and by["notes/b4.md"]["text"].endswith(PLAIN.split("---\n\n", 1)[1])
    assert by["notes/b5.md"]["text"].endswith("## Part ones\nx\n\nend.\n\n")


def test_one_heading_a_day_and_no_rows(spark, versions, said):
    text = next(r["text"] for r in said if r["path"] == "notes/t.md" and r["text"])
    now = spark.createDataFrame([("notes/t.md", 2, text, False)], "path string, version bigint, text string, removed boolean").withColumn("mtime", F.lit(None).cast("timestamp"))
    again = spark.createDataFrame([(1, "notes/t.md", "Again.", None, None, "new")], REQUEST)
    grown = V.write_pages(now, again, F.lit(DAY)).first()["text"]
    assert grown.count("## 2024-05-06") == 1 and grown.endswith("More.\n\nAgain.\n")
    assert V.write_pages(versions.limit(0), again.limit(0)).count() == 0
