"""Queries on references to missing records, with their SQL."""

from notegraph.operators import references as R
from notegraph.session import table


def _state(spark, d):
    return R.advance(*(table(spark, d, t) for t in ("links", "files", "removals")))


def p2_found(spark, d):
    return R.missing_references(_state(spark, d), table(spark, d, "aliases")).select("field_name", "source", "target_key")


def p2_report(spark, d):
    return R.report_by_month(R.missing_references(_state(spark, d), table(spark, d, "aliases")))


def p2_orphan_keys(spark, d):
    return R.orphan_keys(_state(spark, d), table(spark, d, "aliases"))


_FOUND = """
refs AS (SELECT source, target_key, min(indexed_at) AS first_at FROM links
         WHERE target_key IS NOT NULL AND target_key <> '' GROUP BY ALL),
pages AS (SELECT page_key, created AS since, NULL::TIMESTAMPTZ AS until, true AS now FROM files
          UNION ALL SELECT page_key, created, removed_at, false FROM removals WHERE removed_at IS NOT NULL),
named AS (SELECT page_key AS name, since, until, now FROM pages WHERE page_key IS NOT NULL
          UNION ALL SELECT a.alias_key, p.since, p.until, p.now FROM pages p JOIN aliases a ON a.canonical_key = p.page_key),
found AS (
  SELECT 'target_key' AS field_name, source, target_key, first_at FROM refs r
  WHERE NOT EXISTS (SELECT 1 FROM named n WHERE n.name = r.target_key AND (n.since IS NULL OR n.since <= r.first_at)
                    AND (n.until IS NULL OR r.first_at < n.until))
     OR NOT EXISTS (SELECT 1 FROM named n WHERE n.name = r.target_key AND n.now)
  UNION ALL
  SELECT 'source', source, target_key, first_at FROM refs r WHERE NOT EXISTS (SELECT 1 FROM files f WHERE f.path = r.source))
"""

QUERIES = {"p2_found": p2_found, "p2_report": p2_report, "p2_orphan_keys": p2_orphan_keys}
ORACLES = {
    "p2_found": f"WITH {_FOUND} SELECT field_name, source, target_key FROM found",
    "p2_report": f"WITH {_FOUND} SELECT field_name, strftime(first_at AT TIME ZONE 'UTC', '%Y-%m') AS month, count(*) AS n FROM found GROUP BY ALL",
    "p2_orphan_keys": f"""WITH {_FOUND}
        SELECT r.target_key AS name, count(*) AS refs FROM refs r
        WHERE NOT EXISTS (SELECT 1 FROM named n WHERE n.name = r.target_key AND n.now) GROUP BY ALL""",
}
