"""Queries of the review queue, the encoder and concept pages, with their SQL."""

import json
import re

from pyspark.sql import functions as F

from notegraph.functions import text as T
from notegraph.operators import concepts as C
from notegraph.operators import embed as E
from notegraph.operators import graph as G
from notegraph.operators import resolve as R
from notegraph.operators import review as V
from notegraph.plans import search as S
from notegraph.plans.common import EDGES, PAGES, RESOLVED, WS, edges, pages, resolved, unlink
from notegraph.plans.common import names as page_names
from notegraph.session import table, written


def _candidates(spark, d):
    """Described names with their mentions, and the pairs by proximity."""
    names = written(R.candidate_names(edges(spark, d), pages(spark, d)), "names")
    # of the keys alone, each once: links need not be shuffled again for it
    linked = table(spark, d, "links").where("target_key is not null").select(F.col("target_key").alias("key")).distinct()
    seeds = linked.join(page_names(spark, d), F.col("key") == F.col("name"), "left_anti")
    known = R.described(R.with_mentions(names, table(spark, d, "aliases"), table(spark, d, "links")))
    return known, written(V.proximity_pairs(names, seeds), "proximity")


def queue_after(spark, d):
    return V.queue_after_all(table(spark, d, "queue"), *_candidates(spark, d), table(spark, d, "aliases"), table(spark, d, "links")).select("pair_key", "status", "weight")


def stub_judge(prompt):
    """A stand-in: names whose letters are equal are the same, those of one first letter are said to be so in one order only."""
    a, b = (re.sub("[^a-z]", "", x.lower()) for x in [*prompt.split("\n"), ""][:2])
    return json.dumps({"answer": "same" if a == b or (a[:1] == b[:1] and a < b) else "different"})


def _answers(spark, d):
    q = R.latest(table(spark, d, "queue")).where("display_a is not null and display_b is not null")
    return V.confirmed(q.select("pair_key", "display_a", "display_b"), stub_judge)


def encoded(spark, d):
    text = S._text(spark, d)
    v = E.encode_missing(text, table(spark, d, "vectors"))
    peak = F.when(F.array_max("vec") > 0, F.array_position("vec", F.array_max("vec"))).cast("int")
    return v.select("stripped_hash", F.size(F.filter("vec", lambda x: x > 0)).alias("slots"), peak.alias("peak"))


def stub_definer(prompt):
    """A stand-in: the sentences of five words or more that stand in the passage."""
    content = prompt.partition("\n")[2]
    flat = " ".join(re.sub(r"\[\[([^\]]+)\]\]", r"\1", re.sub(r"\[\[[^\]|]+\|([^\]]+)\]\]", r"\1", content)).split())
    return json.dumps({"sentences": [s for s in re.split(r"(?<=[.!?]) ", flat) if s.count(" ") >= 4]})


def _passages(spark, d):
    """For every cited name that looks like a concept, whether it has a page, which may grow, or not."""
    e = edges(spark, d)
    names = e.groupBy("target_key").agg(F.min("display").alias("display")).where(T.shape_ok("display"))
    return written(C.passages(names, edges(spark, d), table(spark, d, "chunks"), pages(spark, d)), "passages")


def concept_stale(spark, d):
    """Pages made from the first sections of notes, and the notes with other passages that they don't name yet."""
    found = _passages(spark, d)
    made = C.concept_pages(C.definitions(found.where("seq = 1"), stub_definer), 1)
    return C.stale(made, found)


def concept_pages(spark, d):
    return C.concept_pages(C.definitions(_passages(spark, d), stub_definer)).select("key", "sentences", F.size("sources").alias("n_sources"))


QUERIES = {
    "mutual_knn": lambda s, d: V.mutual_nearest(R.candidate_names(edges(s, d), pages(s, d))),
    "candidate_sources": lambda s, d: V.all_candidates(*_candidates(s, d)).groupBy("source").agg(F.count(F.lit(1)).alias("n")),
    "queue_after": queue_after,
    "decided": lambda s, d: V.decided(table(s, d, "queue")),
    "confirmed_answers": _answers,
    "encode_pending": encoded,
    "concept_candidates": lambda s, d: C.wanted(resolved(s, d)),
    "concept_passages": lambda s, d: _passages(s, d).select("key", "path", "seq"),
    "concept_pages": concept_pages,
    "concept_stale": concept_stale,
}

_LETTERS = lambda x: f"regexp_replace(lower({x}), '[^a-z]', '', 'g')"
_GRAMS = """gr AS (SELECT key, list_distinct([substr(' ' || lower(name) || ' ', i, 3) FOR i IN range(1, greatest(length(name) + 2 - 2, 1) + 1)]) AS g FROM cand),
sim AS (SELECT a.key AS key, b.key AS other, round(len(list_intersect(a.g, b.g)) / sqrt(len(a.g) * len(b.g)), 6) AS cosine FROM gr a JOIN gr b ON a.key <> b.key),
top AS (SELECT * FROM sim WHERE cosine >= 0.6 QUALIFY row_number() OVER (PARTITION BY key ORDER BY cosine DESC, other) <= 3),
mut AS (SELECT a.key AS key_a, a.other AS key_b, a.cosine AS cosine FROM top a JOIN top b ON a.key = b.other AND a.other = b.key WHERE a.key < a.other)"""
_PAIRS = S.ORACLES["structural_partners"].split(" SELECT key, count(*) AS partners")[0].replace(f"WITH {PAGES}, {EDGES}", f"WITH {RESOLVED}")
_SOURCES = f"""{_PAIRS}, {_GRAMS}, seed AS (SELECT target_key AS key FROM res WHERE NOT resolved), prox AS (SELECT key_a, key_b FROM mut WHERE key_a IN (SELECT key FROM seed) OR key_b IN (SELECT key FROM seed)),
cnd AS (SELECT ka || '|' || kb AS pair_key, ka AS key_a, kb AS key_b, 'structure' AS source FROM d UNION ALL SELECT key_a || '|' || key_b, key_a, key_b, 'proximity' FROM prox WHERE (key_a, key_b) NOT IN (SELECT (ka, kb) FROM d))"""
_FLAT = f"trim(regexp_replace({unlink('content')}, '{WS}+', ' ', 'g'))"
_PASSAGES = f"""want AS (SELECT * FROM (SELECT target_key AS key, min(display) AS name, count(*) AS n FROM edge GROUP BY 1) WHERE {{shape}}),
pas AS (SELECT DISTINCT w.key AS key, name, c.path AS path, seq, content FROM want w JOIN edge e ON e.target_key = w.key JOIN page p ON p.path = e.source AND coalesce(p.origin, '') <> 'derived' JOIN chunks c ON c.path = e.source
  WHERE NOT coalesce(is_summary, false) AND content IS NOT NULL AND contains(lower(content), lower(name)))"""
_SHAPE = S._CAND[S._CAND.index("regexp_matches(c,") : S._CAND.index("),\ncand AS")]
_WANTED = "want AS (SELECT * FROM (SELECT target_key AS key, min(display) AS name, count(*) AS n FROM res WHERE NOT resolved GROUP BY 1) WHERE {shape})"
_FIT = _SHAPE.replace("regexp_matches(c,", "regexp_matches(trim(name),").replace("string_split_regex(c,", "string_split_regex(trim(name),")
_WANTED, _PASSAGES = _WANTED.format(shape=_FIT), _PASSAGES.format(shape=_FIT)

ORACLES = {
    "mutual_knn": f"WITH {PAGES}, {EDGES}, {S._CAND}, {_GRAMS} SELECT * FROM mut",
    "candidate_sources": f"{_SOURCES} SELECT source, count(*) AS n FROM cnd GROUP BY source",
    "queue_after": f"""{_SOURCES}, {S._LATEST}, men AS (SELECT target_key AS k, count(*) AS n FROM links GROUP BY 1), al AS (SELECT alias_key FROM aliases WHERE alias_key IS NOT NULL),
        c2 AS (SELECT c.*, coalesce(a.n, 0) + coalesce(b.n, 0) AS mentions, key_a IN (SELECT alias_key FROM al) OR key_b IN (SELECT alias_key FROM al) AS aliased FROM cnd c LEFT JOIN men a ON a.k = key_a LEFT JOIN men b ON b.k = key_b)
        SELECT l.pair_key AS pair_key, CASE WHEN s = 'unclear' AND NOT c2.aliased AND c2.mentions > coalesce(mentions_at_ask, 0) THEN 'open' ELSE s END AS status, weight FROM last l LEFT JOIN c2 ON c2.pair_key = l.pair_key
        UNION ALL SELECT pair_key, 'open', mentions::INT FROM c2 WHERE NOT aliased AND pair_key NOT IN (SELECT pair_key FROM last)""",
    "decided": f"WITH {S._LATEST} SELECT pair_key, s AS status, weight, row_number() OVER (PARTITION BY s ORDER BY weight DESC NULLS LAST, pair_key) AS rank FROM last WHERE s IN ('same', 'different', 'unclear')",
    "confirmed_answers": f"""WITH {S._LATEST}, x AS (SELECT pair_key, {_LETTERS('display_a')} AS a, {_LETTERS('display_b')} AS b FROM last WHERE display_a IS NOT NULL AND display_b IS NOT NULL),
        y AS (SELECT pair_key, a = b OR (left(a, 1) = left(b, 1) AND a < b) AS one, a = b OR (left(a, 1) = left(b, 1) AND b < a) AS two FROM x) SELECT pair_key, CASE WHEN NOT one THEN 'different' WHEN two THEN 'same' ELSE 'unclear' END AS answer FROM y""",
    "encode_pending": f"""WITH {S._CHUNK}, t AS (SELECT stripped_hash, min(text) AS text FROM chunk WHERE stripped_hash IS NOT NULL AND stripped_hash NOT IN (SELECT stripped_hash FROM vectors WHERE stripped_hash IS NOT NULL) GROUP BY 1),
        w AS (SELECT stripped_hash, ('0x' || left(md5(w), 6))::BIGINT % 384 AS slot, count(*) AS n FROM (SELECT stripped_hash, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM t) GROUP BY 1, 2),
        p AS (SELECT stripped_hash, count(*) AS slots, min_by(slot, (-n, slot)) + 1 AS peak FROM w GROUP BY 1) SELECT t.stripped_hash AS stripped_hash, coalesce(slots, 0)::INT AS slots, peak::INT AS peak FROM t LEFT JOIN p ON p.stripped_hash = t.stripped_hash""",
    "concept_candidates": f"WITH {RESOLVED}, {_WANTED} SELECT key AS target_key, name AS display, n FROM want",
    "concept_passages": f"WITH {RESOLVED}, {_PASSAGES} SELECT key, path, seq FROM pas",
    "concept_stale": rf"""WITH {RESOLVED}, {_PASSAGES}, st AS (SELECT key, name, path, unnest(string_split_regex(regexp_replace({_FLAT}, '([.!?]) ', '\1' || chr(1), 'g'), chr(1))) AS sentence FROM pas WHERE seq = 1),
        ok AS (SELECT key, sentence, min(path) AS path FROM st WHERE length(sentence) - length(replace(sentence, ' ', '')) >= 4 GROUP BY key, sentence)
        SELECT DISTINCT key, path FROM pas WHERE key IN (SELECT key FROM ok) AND (key, path) NOT IN (SELECT (key, path) FROM ok)""",
    "concept_pages": rf"""WITH {RESOLVED}, {_PASSAGES}, st AS (SELECT key, name, path, unnest(string_split_regex(regexp_replace({_FLAT}, '([.!?]) ', '\1' || chr(1), 'g'), chr(1))) AS sentence FROM pas),
        ok AS (SELECT key, sentence, min(path) AS path FROM st WHERE length(sentence) - length(replace(sentence, ' ', '')) >= 4 GROUP BY key, sentence)
        SELECT key, count(*) AS sentences, count(DISTINCT path)::INT AS n_sources FROM ok GROUP BY key HAVING count(*) >= 2""",
}
