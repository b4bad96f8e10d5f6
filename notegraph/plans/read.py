"""Queries on reading pages by name, with their SQL."""

from pyspark.sql import functions as F

from notegraph.operators import read as R
from notegraph.plans.common import DOC, RESOLVED, edges, norm, pages, parsed, resolved, strip
from notegraph.plans.text import _LINES, _cut
from notegraph.session import table, written

#: What is asked of every document: depth, target and part.
ASKED = (("part", "See also", 1), ("window", "lantern drift", 1), ("full", None, 2), ("outline", None, 1), ("part", None, 1))


def read_names(spark, d):
    """Every name under which a page is linked, and every path, looked up."""
    p = pages(spark, d)
    names = table(spark, d, "links").select(F.col("display").alias("name")).unionByName(p.select(F.col("path").alias("name")))
    return R.located(names, p, table(spark, d, "aliases"), resolved(spark, d))


def read_parts(spark, d):
    """Parts of every document, each asked for by its bare name."""
    p = written(parsed(spark, d).select("doc_id", "path", "page_key", "body"), "parsed")
    none = resolved(spark, d).limit(0)
    asked = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(a).alias("depth"), F.lit(b).cast("string").alias("target"), F.lit(c).alias("from_part")) for i, (a, b, c) in enumerate(ASKED)]))
    requests = p.select("doc_id", asked.alias("a")).select(F.concat_ws("-", F.col("doc_id").cast("string"), "a.i").alias("request"), F.concat(F.lit("Doc "), F.col("doc_id").cast("string")).alias("name"), "a.depth", "a.target", "a.from_part")
    places = written(R.located(requests, p, table(spark, d, "aliases").limit(0), none), "places")
    return R.read_texts(requests, places, p).select("request", "status", "note", "part", "parts", F.sha1("content").alias("sha1"), "hard")


QUERIES = {
    "read_names": read_names,
    "read_meta": lambda s, d: R.page_meta(pages(s, d), edges(s, d)),
    "read_parts": read_parts,
}

_HIT = r"regexp_extract(body, '^((?s:.*?))(?i:lantern drift)', 1)"
ORACLES = {
    "read_names": f"""WITH {RESOLVED}, asked AS (SELECT display AS name FROM links WHERE display IS NOT NULL UNION SELECT path FROM page),
        k AS (SELECT name, name IN (SELECT path FROM page) AS exact, {norm('name')} AS key FROM asked), c AS (SELECT k.*, coalesce(canonical_key, key) AS canonical FROM k LEFT JOIN aliases ON alias_key = key),
        h AS (SELECT c.*, CASE WHEN exact THEN 1 ELSE (SELECT count(*) FROM page WHERE page_key = canonical) END AS hits, CASE WHEN exact THEN name ELSE (SELECT min(path) FROM page WHERE page_key = canonical) END AS there,
          CASE WHEN exact THEN 0 ELSE (SELECT count(*) FROM res WHERE NOT resolved AND target_key = key) END AS citing FROM c)
        SELECT name, CASE hits WHEN 1 THEN 'OK' WHEN 0 THEN 'STOP' ELSE 'RETRY' END AS status, CASE WHEN hits > 1 THEN hits || ' pages have that name' WHEN hits = 0 AND citing > 0 THEN 'no page yet; cited by ' || citing WHEN hits = 0 THEN 'no such page' END AS note,
        CASE WHEN hits = 1 THEN there END AS path, hits, citing FROM h""",
    "read_meta": f"""WITH {RESOLVED} SELECT path, type, origin, summary, coalesce(summary_provisional, true) AS provisional, left(content_hash, 8) AS expect, (SELECT count(*) FROM edge WHERE source = path) AS links_out, (SELECT count(*) FROM edge WHERE target_key = page_key) AS linked_from FROM page""",
    "read_parts": rf"""WITH RECURSIVE {DOC}, {_LINES}, sec AS (SELECT path, sec, max({strip("regexp_extract(l, '^#{1,6}((?s:.*))$', 1)")}) FILTER (l LIKE '#%') AS heading, max(length(regexp_extract(l, '^(#{{1,6}})', 1))) FILTER (l LIKE '#%') AS level, string_agg(l, chr(10) ORDER BY i) AS text, min(start) AS start, max(total) AS total FROM line GROUP BY path, sec),
        whole AS (SELECT *, lead(start, 1, total) OVER (PARTITION BY path ORDER BY sec) - start AS size FROM sec), see AS (SELECT path, min_by(text || CASE WHEN size > length(text) THEN chr(10) ELSE '' END, sec) AS text FROM whole WHERE sec > 0 AND {norm('heading')} = 'seealso' GROUP BY path),
        tree AS (SELECT path, string_agg(repeat('  ', level - 1) || heading || ' (' || size || ')', chr(10) ORDER BY sec) AS text FROM whole WHERE sec > 0 GROUP BY path),
        asked AS (SELECT doc_id, d.path AS path, 0 AS i, 1 AS want, 'RETRY' AS no, 'no such heading' AS why, body IS NULL AS bare, s.text AS text FROM doc d LEFT JOIN see s ON s.path = d.path
          UNION ALL SELECT doc_id, path, 1, 1, 'STOP', 'not in the page', body IS NULL, CASE WHEN regexp_matches(body, '(?i)lantern drift') THEN substr(body, greatest(length({_HIT}) - 3200, 0) + 1, least(length({_HIT}), 3200) + 3200) END FROM doc
          UNION ALL SELECT doc_id, path, 2, 2, NULL, NULL, body IS NULL, body FROM doc
          UNION ALL SELECT doc_id, d.path, 3, 1, NULL, NULL, body IS NULL, CASE WHEN body IS NOT NULL THEN coalesce(t.text, '') END FROM doc d LEFT JOIN tree t ON t.path = d.path
          UNION ALL SELECT doc_id, path, 4, 1, 'RETRY', 'needs a target', false, NULL FROM doc),
        cut AS (SELECT doc_id, i, 1 AS part, text AS rest, {_cut('text')} AS pos FROM asked WHERE text IS NOT NULL
          UNION ALL SELECT doc_id, i, part + 1, r, {_cut('r')} FROM (SELECT doc_id, i, part, substr(rest, abs(pos) + 1) AS r FROM cut WHERE pos <> 0) WHERE r <> ''),
        n AS (SELECT doc_id, i, max(part) AS parts FROM cut GROUP BY doc_id, i)
        SELECT a.doc_id || '-' || a.i AS request, CASE WHEN a.bare THEN 'STOP' WHEN text IS NULL THEN no ELSE 'OK' END AS status, CASE WHEN a.bare THEN 'no text' WHEN text IS NULL THEN why END AS note,
        c.part AS part, n.parts AS parts, sha1(CASE WHEN pos = 0 THEN rest ELSE left(rest, abs(pos)) END) AS sha1, pos < 0 AS hard
        FROM asked a LEFT JOIN n ON n.doc_id = a.doc_id AND n.i = a.i LEFT JOIN cut c ON c.doc_id = a.doc_id AND c.i = a.i AND c.part = least(want, n.parts)""",
}
