"""Logical tables of the queries, in Spark and as SQL."""

from notegraph.operators import graph as G
from notegraph.operators import parse as P
from notegraph.session import table


def pages(spark, d):
    return G.current_pages(table(spark, d, "files"))


def edges(spark, d):
    return G.edges(table(spark, d, "links"))


def names(spark, d):
    return G.page_names(pages(spark, d), table(spark, d, "aliases"))


def resolved(spark, d):
    return G.resolved_edges(edges(spark, d), names(spark, d))


def parsed(spark, d):
    """Documents as pages; the path of a copied page is told apart by its id."""
    from pyspark.sql import functions as F

    docs = table(spark, d, "documents").select("doc_id", "text", "mtime", F.col("path").alias("page"))
    return P.parse_pages(docs.withColumn("path", F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".md"))))


#: White space in SQL's regex engine, the same set as notegraph.functions.text.WS.
WS = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"

PAGES = "pages AS (SELECT path, max_by(f, (mtime, coalesce(content_hash, ''))) AS r FROM (SELECT f AS f, f.path AS path, f.mtime AS mtime, f.content_hash AS content_hash FROM files f) WHERE path IS NOT NULL GROUP BY path), page AS (SELECT unnest(r) FROM pages)"
EDGES = """edge AS (SELECT source, target_key, min_by(display, (indexed_at, display)) FILTER (display IS NOT NULL) AS display
FROM links WHERE target_key IS NOT NULL GROUP BY source, target_key)"""
NAMES = """name AS (SELECT page_key AS name FROM page WHERE page_key IS NOT NULL
UNION SELECT alias_key FROM aliases WHERE alias_key IS NOT NULL AND canonical_key IN (SELECT page_key FROM page))"""
RESOLVED = f"{PAGES}, {EDGES}, {NAMES}, res AS (SELECT e.*, e.target_key IN (SELECT name FROM name) AS resolved FROM edge e)"


def norm(x: str) -> str:
    """SQL of notegraph.functions.text.normalize."""
    return fold(f"regexp_replace(lower({x}), '[^a-z0-9]', '', 'g')")


def fold(k: str) -> str:
    return f"CASE WHEN {k} LIKE '%ies' AND length({k}) > 4 THEN left({k}, -3) || 'y' WHEN {k} LIKE '%s' AND {k} NOT LIKE '%ss' AND length({k}) > 3 THEN left({k}, -1) ELSE {k} END"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def unlink(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '\[\[[^\]|]+\|([^\]]+)\]\]', '\1', 'g'), '\[\[([^\]]+)\]\]', '\1', 'g')"


BODY = r"regexp_replace(text, '^---\n((?s:.*?))\n---\n?', '')"
#: Documents with their body and frontmatter lines.
DOC = rf"""doc AS (SELECT doc_id, 'doc-' || doc_id || '.md' AS path, mtime, {BODY} AS body,
  list_filter(string_split(regexp_extract(coalesce(text, ''), '^---\n((?s:.*?))\n---\n?', 1), chr(10)), lambda l: contains(l, ':') AND NOT regexp_matches(l, '^(\s|-|#)')) AS fm FROM documents)"""


def field(name: str) -> str:
    """SQL for the last value of a frontmatter key."""
    raw = rf"list_filter(fm, lambda l: {strip("split_part(l, ':', 1)")} = '{name}')[-1]"
    value = strip(rf"substr({raw}, instr({raw}, ':') + 1)")
    inner = rf"""regexp_replace(regexp_extract({value}, '^"((?s:.*))"$', 1), '\\(["\\])', '\1', 'g')"""
    return rf"""CASE WHEN regexp_matches({value}, '^"(?s:.*)"$') AND length({value}) >= 2 THEN {inner} ELSE regexp_replace({value}, '^[''"]+|[''"]+$', '', 'g') END"""
