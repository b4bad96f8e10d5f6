"""Queries of linking, repair, model answers, page changes and streams, with their SQL."""

import json

from pyspark.sql import functions as F

from notegraph.functions import text as T
from notegraph.operators import analysis as A
from notegraph.operators import graph as G
from notegraph.operators import linker as L
from notegraph.operators import pages as V
from notegraph.operators import parse as P
from notegraph.operators import sync as Y
from notegraph.plans.common import BODY, DOC, PAGES, RESOLVED, WS, edges, field, norm, pages, parsed, strip, unlink
from notegraph.plans.search import ORACLES as _SEARCH
from notegraph.plans.text import PARSED
from notegraph.session import scratch, table, written
from notegraph.streaming import ingest as I


def link_bodies(spark, d):
    """Every page with its own tags and the hub's name placed as links; placing must not move the hash."""
    index = G.resolution_index(pages(spark, d), table(spark, d, "aliases"))
    p = parsed(spark, d).withColumn("concepts", F.concat("tags", F.array(F.lit("lantern drift"), F.lit("harbour"))))
    out = L.link_pages(p, "concepts", index)
    same = p.select(F.col("path").alias("p"), "content_hash")
    return out.join(same, F.col("path") == F.col("p")).select("path", *L.OUTCOMES, T.content_hash("linked").eqNullSafe(F.col("content_hash")).alias("same_hash"))


def repair_brackets(spark, d):
    """Links damaged on purpose by a third bracket on each side are set right again."""
    damaged = F.regexp_replace("body", r"\[\[([^\[\]|]+)\]\]", "[[[$1]]]")
    return L.repair_pages(parsed(spark, d).withColumn("body", damaged)).select("path", "fixed", F.sha1("repaired").alias("sha1"))


def json_repair(spark, d):
    """The properties of every event, wrapped as a model would, read again."""
    wraps = [F.col("props"), F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```")), F.concat(F.lit("Here it is: "), F.col("props"), F.lit(" Done.")), F.regexp_replace("props", r"\}$", ",}")]
    raw = F.element_at(F.array(*wraps), (F.pmod("event_id", F.lit(4)) + 1).cast("int"))
    r = A.repair_json(raw)
    return table(spark, d, "events").select("event_id", F.get_json_object(r["json"], "$.k").cast("int").alias("k"), F.size(r["repairs"]).alias("repairs"))


def stub_model(prompt: str) -> str:
    """A stand-in for a model: the first sentence and the words of the links, as JSON."""
    import re

    first = re.split(r"(?<=[.!?])\s", " ".join(re.sub(r"(?m)^#{1,6}.*$", "", prompt).split()), maxsplit=1)[0]
    return "```json\n" + json.dumps({"summary": first, "concepts": [x.split("|")[-1] for x in re.findall(T.LINK, prompt)]}) + "\n```"


#: A context so small that many pages have to be read in windows.
CONTEXT = 2048


def _analysed(spark, d):
    p = written(parsed(spark, d), "parsed")
    return p, A.analyse(p, stub_model, CONTEXT)


def analyse_pages(spark, d):
    return _analysed(spark, d)[1].select("path", "status", F.size("concepts").alias("n"))


def commit_pages(spark, d):
    """Analysis, links and the check of the hash; a page whose hash moved would come out as failed."""
    p, a = _analysed(spark, d)
    known = G.known_keys(edges(spark, d), pages(spark, d))
    return A.commit(p, a, G.resolution_index(pages(spark, d), table(spark, d, "aliases")), known).select("path", "status", T.content_hash("linked").alias("hash"))


def analysis_counts(spark, d):
    p, a = _analysed(spark, d)
    tried = a.join(p.select(F.col("path").alias("p"), "content_hash"), F.col("path") == F.col("p")).select("path", "content_hash", "status", "note")
    none = tried.withColumn("at", F.lit("")).limit(0)
    return A.pass_counts(A.record(none, tried, F.lit("2024-01-01")))


def _layout(spark, d):
    """The folder in which most pages of each kind lie, as the recorded layout."""
    kinds = {"concept": "concepts", "transcript": "records", "note": "pages", "source": "sources"}
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv]), F.lower(T.strip_space("type")))
    n = pages(spark, d).select(kind.alias("folder"), F.substring_index("path", "/", 1).alias("path")).where("folder is not null").groupBy("folder", "path").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("folder").agg(F.min_by("path", F.struct((-F.col("n")).alias("o"), "path")).alias("path"))


#: Folders as a tool might have them, one of them elsewhere.
FOLDERS = {"pages": "notes", "concepts": "wiki", "records": "talks", "sources": "sources"}


def health(spark, d):
    p, a = _analysed(spark, d)
    tried = a.select("path", "status")
    drift = Y.layout_drift(_layout(spark, d), FOLDERS)
    gaps = G.gaps(G.resolved_edges(edges(spark, d), G.page_names(pages(spark, d), table(spark, d, "aliases"))))
    return Y.health(pages(spark, d), tried, gaps, G.bloated(p), drift)


def first_calls(spark, d):
    """Of events of one user with equal type and properties the first, and how many there are."""
    return I.first_calls(table(spark, d, "events"), "user_id", "event_type", "props", "event_id").select("event_id", "calls")


def _versions(spark, d):
    docs = table(spark, d, "documents").where("path is not null")
    return docs.select("path", F.lit(1).cast("bigint").alias("version"), "text", "mtime", F.lit(False).alias("removed"))


def relocate_hub(spark, d):
    """The version rows made when the hub's page is moved: the page itself and every citing page."""
    v = _versions(spark, d)
    hub = v.select(F.lit("wiki/Lantern Drift.md").alias("path"), F.lit(1).cast("bigint").alias("version"), F.lit("# Lantern Drift").alias("text"), F.lit(None).cast("timestamp").alias("mtime"), F.lit(False).alias("removed")).limit(1)
    rest = v.where("path <> 'wiki/Lantern Drift.md'")
    moved = V.relocate(rest.unionByName(hub), "wiki/Lantern Drift.md", "wiki/Drift of Lanterns.md").versions
    return moved.select("path", "removed", F.regexp_count("text", F.lit(r"\[\[Drift of Lanterns\|")).alias("links"))


def write_all(spark, d):
    """A line added to every document by one job: the answers, and the hash and day of the pages that come out."""
    v = written(_versions(spark, d), "versions")
    seen = V.current(v).select(F.col("path").alias("p"), F.substring(T.content_hash(P.body_of(F.coalesce("text", F.lit("")))), 1, V.EXPECT).alias("expect"))
    asked = table(spark, d, "documents").select(F.col("doc_id").alias("request"), "path").join(seen, F.col("path") == F.col("p"), "left")
    requests = asked.select("request", "path", F.lit("Seen again.").alias("content"), F.lit("end").alias("where"), F.lit(None).cast("string").alias("target"), "expect")
    out = V.write_pages(v, requests, F.lit("2024-05-06"))
    return out.select("request", "status", "note", "version", T.content_hash(P.body_of(F.col("text"))).alias("hash"), P.field(P.block_of(F.col("text")), "updated").alias("updated"))


def transcript_turns(spark, d):
    """Transcript pages cut into turns and rendered again: number of turns and their text's hash."""
    t = parsed(spark, d).where("type = 'transcript'")
    turns = t.select(F.col("doc_id").alias("conv_id"), F.posexplode(F.split("body", r"(?m)^## (?=user$|assistant$)")).alias("turn", "part"))
    turns = turns.where("turn > 0").select("conv_id", "turn", F.substring_index("part", "\n", 1).alias("role"), F.expr("substr(part, instr(part, '\n') + 1)").alias("text"))
    return A.transcript(turns).select(F.col("conv_id").alias("doc_id"), F.length("text").alias("size"))


def stream_repeats(spark, d):
    """The repeat guard as a stream over the events, read from files and run until nothing is left.

    All files are one batch: files need not be in order of time, and in a later batch their events would be late.
    """
    at = scratch(spark, "stream")
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events.parquet*")
    q = I.repeats(source).writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema("event_id bigint, before bigint").parquet(f"{at}/out")


def stream_ingest(spark, d):
    """Documents arriving as a stream, turned into pages; as many as there are paths."""
    at = scratch(spark, "ingest")
    schema = spark.read.parquet(f"{d}/documents.parquet").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/documents.parquet*").where("path is not null").select("path", "text", "mtime")
    I.ingest(source, at, f"{at}/state").awaitTermination()
    return I.latest_pages(spark, at).select("path", "page_key", "content_hash")


def link_hashes(spark, d):
    """Pages whose content hash is the same after links were placed: all that have a body."""
    return link_bodies(spark, d).where("same_hash and to_page is not null").select("path")


QUERIES = {
    "link_bodies": link_bodies,
    "link_hashes": link_hashes,
    "repair_brackets": repair_brackets,
    "json_repair": json_repair,
    "analyse_pages": analyse_pages,
    "summarise_pages": lambda s, d: A.summarise(parsed(s, d), stub_model).select("path", "status", "summary"),
    "commit_pages": commit_pages,
    "analysis_counts": analysis_counts,
    "first_calls": first_calls,
    "relocate_hub": relocate_hub,
    "health": health,
    "layout_drift": lambda s, d: Y.layout_drift(_layout(s, d), FOLDERS),
    "write_all": write_all,
    "transcript_turns": transcript_turns,
    "stream_repeats": stream_repeats,
    "stream_ingest": stream_ingest,
}

_SAID = rf"trim(regexp_replace(regexp_replace(body, '(?m)^#{{1,6}}[^\n]*$', '', 'g'), '{WS}+', ' ', 'g'))"
_STUB = rf"""stub AS (SELECT path, body, type, coalesce(nullif(regexp_extract({_SAID}, '^((?s:.*?)[.!?]) ', 1), ''), {_SAID}) AS said FROM parsed WHERE body IS NOT NULL)"""
_PASSES = r"said <> '' AND length(said) <= 300 AND len(regexp_extract_all(said, '[.!?](?:\s|$)')) <= 1"
_SHAPED = rf"""(regexp_matches(c, '^[A-Za-z][A-Za-z0-9\-'' ]{{2,49}}$') AND len(list_filter(string_split_regex(c, '\s+'), lambda w: w <> '')) <= 6
  AND NOT regexp_matches(c, '(?i)^(Tier|Cycle|Phase|Stage|Level|Step|Figure|Table|Section)\s*[\dIVX]+$') AND NOT regexp_matches(c, '(?i)^(one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve)\s+\w+s?$'))"""
#: Pages as the stand-in analyses them: whole, or window by window where they are transcripts or have no room.
_ROOM = A.room(CONTEXT)
_ANALYSED = rf"""{PARSED}, {_STUB}, cut AS (SELECT path, body, said, length(body) > {_ROOM} OR coalesce(type = 'transcript', false) AS windowed, CASE WHEN length(body) > {_ROOM} THEN range(0, length(body), {int(_ROOM * 0.9)}) ELSE [0] END AS starts FROM stub),
win AS (SELECT path, body, said, windowed, CASE WHEN windowed THEN substr(body, unnest(starts) + 1, {_ROOM}) ELSE body END AS w FROM cut WHERE windowed UNION ALL SELECT path, body, said, windowed, body FROM cut WHERE NOT windowed),
raw AS (SELECT path, body, windowed, unnest([split_part(x, '|', -1) FOR x IN regexp_extract_all(w, '\[\[([^\]]+)\]\]', 1)]) AS shown FROM win),
con AS (SELECT DISTINCT path, body, windowed, {strip(unlink("shown"))} AS c FROM raw),
good AS (SELECT path, count(DISTINCT {norm("c")}) AS n FROM con WHERE {norm("c")} <> '' AND (NOT windowed OR {_SHAPED})
  AND regexp_matches({unlink("body")}, '(?i)(?:^|[^\[\p{{L}}\p{{M}}\p{{N}}_])' || regexp_replace(regexp_escape(c), '(\\?\s)+', '\\s+', 'g') || '(?:$|[^\p{{L}}\p{{M}}\p{{N}}_\]])') GROUP BY path),
live AS (SELECT path, count(*) FILTER (NOT regexp_matches(w, '^{WS}*$')) AS windows FROM win GROUP BY path),
analysed AS (SELECT c.path AS path, coalesce(n, 0) AS n, CASE WHEN windowed AND windows = 0 THEN 'failed' WHEN NOT windowed AND NOT ({_PASSES}) THEN 'failed'
  WHEN coalesce(n, 0) / greatest(len(list_filter(string_split_regex({unlink("body")}, '{WS}+'), lambda t: t <> '')), 1) < 0.0025 THEN 'low_yield' ELSE 'ok' END AS status FROM cut c LEFT JOIN good g ON g.path = c.path LEFT JOIN live l ON l.path = c.path)"""

_LAYOUT = f"""kind AS (SELECT CASE lower({strip("type")}) WHEN 'concept' THEN 'concepts' WHEN 'transcript' THEN 'records' WHEN 'note' THEN 'pages' WHEN 'source' THEN 'sources' END AS folder, split_part(path, '/', 1) AS path FROM page),
mostly AS (SELECT folder, path AS was FROM (SELECT folder, path, count(*) AS n FROM kind WHERE folder IS NOT NULL GROUP BY folder, path) QUALIFY row_number() OVER (PARTITION BY folder ORDER BY n DESC, path) = 1),
drift AS (SELECT m.folder AS folder, was, now FROM mostly m JOIN (VALUES ('pages', 'notes'), ('concepts', 'wiki'), ('records', 'talks'), ('sources', 'sources')) f(folder, now) ON f.folder = m.folder WHERE was <> now)"""

ORACLES = {
    "link_hashes": f"WITH {DOC} SELECT path FROM doc WHERE body IS NOT NULL",
    "repair_brackets": rf"""WITH {DOC}, d AS (SELECT path, regexp_replace(body, '\[\[([^\[\]|]+)\]\]', '[[[\1]]]', 'g') AS body FROM doc), r AS (SELECT *, regexp_replace(body, '({L.VERBATIM})|{L.BRACKETS}', '\1\2\3\4', 'g') AS repaired FROM d)
        SELECT path, len(regexp_extract_all(regexp_replace(body, '{L.VERBATIM}', ' ', 'g'), '{L.DAMAGED}')) AS fixed, sha1(repaired) AS sha1 FROM r WHERE repaired <> body""",
    "analyse_pages": f"WITH {_ANALYSED} SELECT path, status, n FROM analysed",
    "commit_pages": f"WITH {_ANALYSED} SELECT a.path AS path, status, CASE WHEN status <> 'failed' THEN sha1({strip(unlink('body'))}) END AS hash FROM analysed a JOIN parsed p ON p.path = a.path",
    "analysis_counts": f"WITH {_ANALYSED} SELECT count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'low_yield') AS low_yield, count(*) FILTER (status = 'failed') AS failed FROM analysed",
    "summarise_pages": f"WITH {PARSED}, {_STUB} SELECT path, CASE WHEN {_PASSES} THEN 'ok' ELSE 'failed' END AS status, CASE WHEN {_PASSES} THEN said END AS summary FROM stub",
    "first_calls": "SELECT min(event_id) AS event_id, count(*) AS calls FROM events GROUP BY user_id, event_type, props",
    "json_repair": "SELECT event_id, (props::JSON ->> 'k')::INT AS k, CASE event_id % 4 WHEN 0 THEN 0 WHEN 2 THEN 2 ELSE 1 END AS repairs FROM events",
    "layout_drift": f"WITH {PAGES}, {_LAYOUT} SELECT folder, was, now FROM drift",
    "health": rf"""WITH {_ANALYSED}, {RESOLVED}, {_LAYOUT}, gap AS (SELECT * FROM (SELECT target_key, min(display) AS display, count(*) AS n FROM res WHERE NOT resolved GROUP BY target_key ORDER BY n DESC, target_key LIMIT 3) WHERE n >= 4),
        big AS (SELECT len(regexp_extract_all(body, '(?m)^## '))::INT AS n FROM parsed WHERE type = 'concept' AND body IS NOT NULL)
        SELECT (SELECT count(*) FROM page WHERE analyzed_hash IS DISTINCT FROM content_hash) AS pending, (SELECT count(*) FROM analysed WHERE status = 'failed') AS failed, (SELECT count(*) FROM drift) AS drifted, (SELECT count(*) FROM gap) AS gaps,
        (SELECT string_agg(coalesce(display, target_key) || ' (' || n || ')', ', ' ORDER BY n DESC, target_key) FROM gap) AS undefined, (SELECT count(*) FROM big WHERE n > 12) AS bloated, (SELECT max(n) FROM big WHERE n > 12) AS most_sections""",
    "write_all": rf"""WITH v AS (SELECT path, max({{'m': mtime, 't': text}}) AS r FROM documents WHERE path IS NOT NULL GROUP BY path), b AS (SELECT path, coalesce(r.t, '') AS text FROM v),
        f AS (SELECT path, {BODY} AS body, list_filter(string_split(regexp_extract(text, '^---\n((?s:.*?))\n---\n?', 1), chr(10)), lambda l: contains(l, ':') AND NOT regexp_matches(l, '^(\s|-|#)')) AS fm FROM b),
        t AS (SELECT path, body, {field("type")} AS type, regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder FROM f), q AS (SELECT DISTINCT folder FROM t WHERE type = 'transcript' AND folder <> ''),
        a AS (SELECT doc_id, d.path AS path, body, d.path IS NULL AS lost, coalesce(type = 'transcript', false) OR d.path LIKE 'conversations/%' OR folder IN (SELECT folder FROM q) AS rec, doc_id > min(doc_id) OVER (PARTITION BY d.path) AS late FROM documents d LEFT JOIN t ON t.path = CASE WHEN contains(d.path, '/') THEN d.path ELSE 'notes/' || d.path END)
        SELECT doc_id AS request, CASE WHEN lost THEN 'RETRY' WHEN rec THEN 'STOP' WHEN late OR body IS NULL THEN 'RETRY' ELSE 'DONE' END AS status,
        CASE WHEN lost THEN 'no path was given' WHEN rec THEN 'records can''t be written' WHEN body IS NULL THEN 'there is no such page' WHEN late THEN 'another request came first' ELSE 'written' END AS note,
        CASE WHEN NOT (lost OR rec OR late OR body IS NULL) THEN 2 END AS version, CASE WHEN NOT (lost OR rec OR late OR body IS NULL) THEN sha1({strip(unlink(f"regexp_replace(body, '{WS}+$', '') || chr(10) || chr(10) || 'Seen again.'"))}) END AS hash,
        CASE WHEN NOT (lost OR rec OR late OR body IS NULL) THEN '2024-05-06' END AS updated FROM a""",
    "stream_repeats": _SEARCH["repeat_guard"],
    "stream_ingest": rf"""WITH p AS (SELECT path, max({{'m': mtime, 't': text}}) AS r FROM documents WHERE path IS NOT NULL GROUP BY path)
        SELECT path, {norm(r"regexp_replace(split_part(path, '/', -1), '\.md$', '')")} AS page_key, sha1({strip(unlink(BODY.replace("text", "r.t")))}) AS content_hash FROM p""",
}
