"""Groups from pairwise decisions."""

from notegraph.llm import components as C
from notegraph.session import table


def p4_found(spark, d):
    return C.groups_from_queue(table(spark, d, "queue"))


def p4_decisions(spark, d):
    return C.decided_pairs(table(spark, d, "queue"))


_DECIDED = """
decided AS (SELECT least(key_a, key_b) AS a, greatest(key_a, key_b) AS b,
                   max_by(lower(trim(status, E' \\t\\r\\n')), (coalesce(epoch_us(TRY_CAST(decided_at AS TIMESTAMPTZ)), -9000000000000000000), lower(trim(status, E' \\t\\r\\n')))) AS status
            FROM queue WHERE key_a IS NOT NULL AND key_b IS NOT NULL AND key_a <> key_b GROUP BY 1, 2)
"""

QUERIES = {"p4_found": p4_found, "p4_decisions": p4_decisions}
ORACLES = {
    "p4_found": f"""WITH RECURSIVE {_DECIDED},
        edge AS (SELECT a AS x, b AS y FROM decided WHERE status = 'same' UNION SELECT b, a FROM decided WHERE status = 'same'),
        reach AS (SELECT x, x AS y FROM edge UNION SELECT r.x, e.y FROM reach r JOIN edge e ON r.y = e.x)
        SELECT min(y) AS group_key, x AS name_key FROM reach GROUP BY x""",
    "p4_decisions": f"WITH {_DECIDED} SELECT a, b, status FROM decided",
}
