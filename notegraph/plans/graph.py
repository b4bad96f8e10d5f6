"""Queries on the link graph, with their SQL."""

from pyspark.sql import functions as F

from notegraph.operators import graph as G
from notegraph.plans.common import EDGES, PAGES, RESOLVED, edges, names, pages, parsed, resolved
from notegraph.session import table, written

HUB, HUB_NAME, TAG, FOLDER = "lanterndrift", "Lantern Drift", "kiln", "wiki"


def _tags(spark, d):
    return parsed(spark, d).select("path", F.explode("tags").alias("tag"))


def _micros(df):
    """Instants as microseconds, which both engines write alike."""
    return df.withColumn("mtime", F.unix_micros(F.col("mtime").cast("timestamp")))


def by_tag(spark, d):
    """The documents are parsed once, into their path, mtime and tags."""
    p = written(parsed(spark, d).select("path", "mtime", "tags"), "tags")
    return _micros(G.by_tag(p, p.select("path", F.explode("tags").alias("tag")), TAG))


def _cite(spark, d):
    return edges(spark, d), pages(spark, d)


def links_in_topk(spark, d):
    return _micros(G.links_in(*_cite(spark, d), HUB))


def vault_shape(spark, d):
    return G.vault_shape(edges(spark, d), pages(spark, d), names(spark, d))


def link_counts(spark, d):
    """Per page: links that lead to a page, and links that don't."""
    return resolved(spark, d).groupBy("source").agg(F.count_if("resolved").alias("existing"), F.count_if(~F.col("resolved")).alias("missing"))


def growth_stats(spark, d):
    """Spread of the number of links per page."""
    n = edges(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.min("n").alias("least"), F.max("n").alias("most"), F.round(F.avg("n"), 6).alias("mean"), F.median("n").alias("median"))


def folded_names(spark, d):
    """Keys under which several spellings fall together."""
    e = table(spark, d, "links").where("display is not null and target_key <> ''")
    return e.groupBy("target_key").agg(F.count_distinct("display").alias("spellings")).where("spellings > 1")


def queue_mentions(spark, d):
    return G.mention_counts(table(spark, d, "queue"), table(spark, d, "links"))


QUERIES = {
    "growth_queue": lambda s, d: G.growth_queue(resolved(s, d)),
    "growth_all": lambda s, d: G.unresolved_counts(resolved(s, d)),
    "growth_total": lambda s, d: G.unresolved_counts(resolved(s, d)).agg(F.count(F.lit(1)).alias("total")),
    "gap_alert": lambda s, d: G.gaps(resolved(s, d)),
    "resolved_links": resolved,
    "links_out": lambda s, d: edges(s, d),
    "link_counts": link_counts,
    "links_in_topk": links_in_topk,
    "in_degrees": lambda s, d: G.in_degrees(*_cite(s, d)),
    "no_inlinks": lambda s, d: G.in_degrees(*_cite(s, d)).where("n_in = 0").select("path"),
    "orphans": lambda s, d: G.orphans(*_cite(s, d)),
    "isolation": lambda s, d: G.isolation(*_cite(s, d)),
    "ambiguous_keys": lambda s, d: G.ambiguous_keys(pages(s, d)),
    "alias_resolve": lambda s, d: G.resolve_names(table(s, d, "aliases").select(F.col("alias_key").alias("key")).unionByName(edges(s, d).select(F.col("target_key").alias("key"))), pages(s, d), table(s, d, "aliases")),
    "known_keys": lambda s, d: G.known_keys(*_cite(s, d)),
    "resolution_index": lambda s, d: G.resolution_index(pages(s, d), table(s, d, "aliases")),
    "by_path": lambda s, d: G.folder(pages(s, d), FOLDER),
    "recent": lambda s, d: _micros(G.recent(pages(s, d))),
    "by_tag": by_tag,
    "all_tags": lambda s, d: G.tag_histogram(_tags(s, d)),
    "vault_shape": vault_shape,
    "page_created": lambda s, d: G.page_created(edges(s, d), HUB).select("source", "display"),
    "mention_counts": queue_mentions,
    "material": lambda s, d: G.material(table(s, d, "chunks"), edges(s, d), pages(s, d), HUB, HUB_NAME),
    "growth_stats": growth_stats,
    "folded_names": folded_names,
}

_UNRES = "SELECT target_key, min(display) AS display, count(*) AS n FROM res WHERE NOT resolved GROUP BY target_key"
_TAGS = "tag AS (SELECT DISTINCT path, tag FROM (SELECT path, unnest(tags) AS tag FROM parsed))"


def _parsed_sql() -> str:
    from notegraph.plans.text import PARSED

    return PARSED


ORACLES = {
    "growth_queue": f"WITH {RESOLVED} {_UNRES} ORDER BY n DESC, target_key LIMIT 8",
    "growth_all": f"WITH {RESOLVED} {_UNRES}",
    "growth_total": f"WITH {RESOLVED} SELECT count(DISTINCT target_key) AS total FROM res WHERE NOT resolved",
    "gap_alert": f"WITH {RESOLVED} SELECT * FROM ({_UNRES} ORDER BY n DESC, target_key LIMIT 3) WHERE n >= 4",
    "resolved_links": f"WITH {RESOLVED} SELECT * FROM res",
    "links_out": f"WITH {EDGES} SELECT * FROM edge",
    "link_counts": f"WITH {RESOLVED} SELECT source, count(*) FILTER (resolved) AS existing, count(*) FILTER (NOT resolved) AS missing FROM res GROUP BY source",
    "links_in_topk": f"WITH {PAGES}, {EDGES} SELECT source, display, summary, epoch_us(mtime) AS mtime, count(*) OVER () AS total FROM edge JOIN page ON path = source WHERE target_key = '{HUB}' ORDER BY page.mtime DESC NULLS LAST, source LIMIT 10",
    "in_degrees": f"WITH {PAGES}, {EDGES} SELECT path, page_key, (SELECT count(*) FROM edge WHERE target_key = page_key) AS n_in FROM page",
    "no_inlinks": f"WITH {PAGES}, {EDGES} SELECT path FROM page WHERE NOT EXISTS (SELECT 1 FROM edge WHERE target_key = page_key)",
    "orphans": f"WITH {PAGES}, {EDGES} SELECT path FROM page WHERE NOT EXISTS (SELECT 1 FROM edge WHERE target_key = page_key) AND NOT EXISTS (SELECT 1 FROM edge WHERE source = path)",
    "isolation": f"WITH {PAGES}, {EDGES} SELECT path, path IN (SELECT source FROM edge WHERE source IS NOT NULL) AS cites, page_key IS NOT NULL AND page_key IN (SELECT target_key FROM edge) AS cited FROM page",
    "ambiguous_keys": f"WITH {PAGES} SELECT page_key, count(*) AS n, min(path) AS first, max(path) AS last FROM page GROUP BY page_key HAVING count(*) > 1",
    "alias_resolve": f"""WITH {PAGES}, {EDGES}, k AS (SELECT alias_key AS key FROM aliases UNION SELECT target_key FROM edge),
        c AS (SELECT key, coalesce(canonical_key, key) AS canonical FROM k LEFT JOIN aliases ON alias_key = key)
        SELECT key, canonical, count(path) AS n_pages, min(path) AS path FROM c LEFT JOIN page ON page_key = canonical GROUP BY key, canonical""",
    "known_keys": f"WITH {PAGES}, {EDGES} SELECT page_key AS key FROM page WHERE page_key IS NOT NULL UNION SELECT target_key FROM edge JOIN page ON path = source WHERE coalesce(origin, '') <> 'derived'",
    "resolution_index": rf"""WITH {PAGES}, own AS (SELECT page_key AS key, min_by(regexp_replace(split_part(path, '/', -1), '\.md$', ''), (NOT coalesce(lower(trim(type)) = 'concept', false), path)) AS canonical FROM page WHERE page_key IS NOT NULL GROUP BY page_key)
        SELECT * FROM own UNION ALL SELECT alias_key, canonical FROM aliases JOIN own ON key = canonical_key WHERE alias_key NOT IN (SELECT key FROM own)""",
    "by_path": f"WITH {PAGES} SELECT path, summary, count(*) OVER () AS total FROM page WHERE starts_with(path, '{FOLDER}/') ORDER BY path LIMIT 20",
    "recent": f"WITH {PAGES} SELECT path, epoch_us(mtime) AS mtime, count(*) OVER () AS total FROM page ORDER BY page.mtime DESC NULLS LAST, path LIMIT 20",
    "by_tag": f"WITH {_parsed_sql()}, {_TAGS} SELECT p.path, epoch_us(p.mtime) AS mtime, count(*) OVER () AS total FROM parsed p JOIN tag t ON t.path = p.path AND t.tag = '{TAG}' ORDER BY p.mtime DESC NULLS LAST, p.path LIMIT 20",
    "all_tags": f"WITH {_parsed_sql()}, {_TAGS} SELECT tag, count(*) AS n FROM tag GROUP BY tag ORDER BY n DESC, tag LIMIT 50",
    "vault_shape": f"""WITH {RESOLVED} SELECT (SELECT count(*) FROM page) AS pages, (SELECT count(DISTINCT page_key) FROM page) AS page_keys, count(*) AS links,
        count(*) FILTER (resolved) AS resolved_links, count(DISTINCT target_key) FILTER (NOT resolved) AS unresolved_names,
        (SELECT count(*) FROM page p WHERE NOT EXISTS (SELECT 1 FROM edge WHERE target_key = p.page_key) AND NOT EXISTS (SELECT 1 FROM edge WHERE source = p.path)) AS orphans,
        (SELECT count(*) FROM (SELECT page_key FROM page GROUP BY page_key HAVING count(*) > 1)) AS ambiguous FROM res""",
    "page_created": f"WITH {EDGES} SELECT source, display FROM edge WHERE target_key = '{HUB}'",
    "mention_counts": "SELECT q.pair_key, (SELECT count(*) FROM links WHERE target_key IN (q.key_a, q.key_b)) AS mentions FROM (SELECT DISTINCT pair_key, least(key_a, key_b) AS key_a, greatest(key_a, key_b) AS key_b FROM queue WHERE key_a IS NOT NULL AND key_b IS NOT NULL) q",
    "material": f"""WITH {PAGES}, {EDGES} SELECT DISTINCT path, seq, content FROM chunks WHERE NOT coalesce(is_summary, false) AND contains(lower(content), lower('{HUB_NAME}'))
        AND path IN (SELECT source FROM edge WHERE target_key = '{HUB}') AND path IN (SELECT path FROM page WHERE coalesce(origin, '') <> 'derived')""",
    "growth_stats": f"WITH {EDGES} SELECT min(n) AS least, max(n) AS most, round(avg(n), 6) AS mean, median(n) AS median FROM (SELECT count(*) AS n FROM edge GROUP BY source)",
    "folded_names": "SELECT target_key, count(DISTINCT display) AS spellings FROM links WHERE display IS NOT NULL AND target_key <> '' GROUP BY target_key HAVING count(DISTINCT display) > 1",
}
