"""Queries on texts: keys, hashes, summaries, parsing and windows, with their SQL."""

from pyspark.sql import functions as F

from notegraph.functions import text as T
from notegraph.operators import graph as G
from notegraph.operators import parse as P
from notegraph.plans.common import DOC, PAGES, WS, field, fold, norm, pages, parsed, strip, unlink
from notegraph.session import table


def _displays(spark, d):
    return table(spark, d, "links").select("display").distinct().where("display is not null")


def norm_keys(spark, d):
    return _displays(spark, d).select("display", T.normalize("display").alias("key"))


def plural_fold(spark, d):
    words = _displays(spark, d).select(F.explode(T.tokens("display")).alias("token"))
    return words.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def summaries(spark, d):
    p = pages(spark, d)
    return p.select("path", T.short("summary").alias("shown"), T.gate_summary("summary").alias("reason"))


def pending_analysis(spark, d):
    return pages(spark, d).where(~F.col("analyzed_hash").eqNullSafe(F.col("content_hash"))).select("path")


def link_forms(spark, d):
    return P.extract_links(parsed(spark, d))


def window_counts(spark, d):
    w = P.windows(F.col("body"), 1000)
    return parsed(spark, d).where("body is not null").select("path", F.size(w).alias("n"), F.sha1(F.array_join(w, "|")).alias("sha1"))


def tag_presence(spark, d):
    """Per page: its tags that stand in its text as words, and whether they are too few for its length."""
    p = parsed(spark, d).select("path", "body", "tags")
    kept = p.select("path", "body", F.posexplode("tags").alias("pos", "tag")).where(T.concept_present("body", F.col("tag")) & (T.normalize("tag") != ""))
    first = kept.groupBy("path", T.normalize("tag").alias("key")).agg(F.min("pos").alias("pos"))
    counts = first.groupBy(F.col("path").alias("at")).agg(F.count(F.lit(1)).alias("n"))
    words = F.size(F.filter(F.split(T.squeeze(T.strip_links("body")), " "), lambda w: w != ""))
    out = p.where("body is not null").join(counts, F.col("path") == F.col("at"), "left")
    n = F.coalesce("n", F.lit(0))
    return out.select("path", n.alias("survivors"), (n / F.greatest(words, F.lit(1)) < 0.0025).alias("low"))


def split_lossless(spark, d):
    """Per page: its body put together again from its parts, and whether all fit the budget."""
    parts = P.split_parts(parsed(spark, d)).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("part", "text"))).alias("p"))
    joined = F.array_join(F.transform("p", lambda x: x["text"]), "")
    return parts.select("path", F.sha1(joined).alias("sha1"), F.forall("p", lambda x: F.length(x["text"]) <= P.BUDGET).alias("all_fit"))


def heading_counts(spark, d):
    return P.outline(parsed(spark, d)).groupBy("path", "level").agg(F.count(F.lit(1)).alias("n"))


def chunk_sizes(spark, d):
    """Per page: whether its chunks hold all of its words outside headings, the summary aside."""
    def words(c):
        return F.size(F.filter(F.split(F.trim(F.regexp_replace(c, r"[ \t\n\r\f]+", " ")), " "), lambda w: w != ""))

    chunks = P.chunk_pages(parsed(spark, d)).where("not is_summary")
    return chunks.groupBy("path").agg(F.sum(words(F.col("content"))).alias("words"))


QUERIES = {
    "split_lossless": split_lossless,
    "heading_counts": heading_counts,
    "chunk_words": chunk_sizes,
    "norm_keys": norm_keys,
    "plural_fold": plural_fold,
    "shape_filter": lambda s, d: _displays(s, d).select("display", T.shape_ok("display").alias("ok")),
    "content_hash": lambda s, d: parsed(s, d).select("doc_id", "content_hash"),
    "first_sentence": lambda s, d: parsed(s, d).select("doc_id", T.first_sentence("body").alias("sentence")),
    "summary_cap": summaries,
    "parse_pages": lambda s, d: parsed(s, d).select("doc_id", "page_key", "summary", "summary_provisional", "type", "origin", F.size("tags").alias("n_tags")),
    "extract_links": link_forms,
    "chunk_pages": lambda s, d: P.chunk_pages(parsed(s, d)),
    "outline": lambda s, d: P.outline(parsed(s, d)),
    "bloat": lambda s, d: G.bloated(parsed(s, d)),
    "section_part": lambda s, d: P.section(parsed(s, d), "Background"),
    "text_window": lambda s, d: parsed(s, d).select("path", P.around(F.col("body"), "lantern drift").alias("around")).where("around is not null"),
    "text_windows": window_counts,
    "split_parts": lambda s, d: P.split_parts(parsed(s, d)),
    "token_counts": lambda s, d: table(s, d, "documents").select("doc_id", T.count_tokens("text").alias("tokens")),
    "yaml_values": lambda s, d: pages(s, d).where("summary is not null").select("path", T.yaml_value("summary").alias("value")),
    "tag_presence": tag_presence,
    "rendered_pages": lambda s, d: pages(s, d).select("path", F.sha1(T.render_page({"origin": F.col("origin"), "page_key": F.col("page_key"), "summary": F.col("summary"), "type": F.col("type")}, F.coalesce("summary", F.lit("")))).alias("sha1")),
    "name_signs": lambda s, d: _displays(s, d).select("display", T.write_path("display").alias("path"), T.opaque("display").alias("opaque"), F.array_join(T.query_words("display"), " ").alias("words")),
    "leading_sentences": lambda s, d: parsed(s, d).select("doc_id", T.leading_sentence("body").alias("sentence")),
    "pending_analysis": pending_analysis,
}

_DISPLAYS = "(SELECT DISTINCT display FROM links WHERE display IS NOT NULL)"
_SQUEEZED = f"trim(regexp_replace(summary, '{WS}+', ' ', 'g'))"
_FLAT = "trim(regexp_replace(regexp_replace(" + unlink("body") + rf", '(?m)^#{{1,6}}[^\n]*$', '', 'g'), '{WS}+', ' ', 'g'))"
_FIRST = rf"coalesce(nullif(trim(left(coalesce(nullif(regexp_extract({_FLAT}, '^((?s:.*?)[.!?]) ', 1), ''), {_FLAT}), 300)), ''), '(no text yet)')"
_TAGLIST = rf"""list_filter([regexp_replace({strip("t")}, '^#+', '') FOR t IN string_split(regexp_replace(coalesce({field("tags")}, ''), '^\[|\]$', '', 'g'), ',')], lambda t: t <> '')"""
PARSED = f"""{DOC}, parsed AS (SELECT doc_id, path, mtime, body, nullif({field("summary")}, '') AS named, {field("summary_provisional")} AS flag, {field("type")} AS type, {field("origin")} AS origin,
  list_distinct({_TAGLIST}) AS tags, CASE WHEN body IS NOT NULL THEN {_FIRST} END AS sentence FROM doc)"""
_INNER = r"regexp_extract_all(body, '\[\[([^\]]+)\]\]', 1)"

def _yaml(x: str) -> str:
    return rf"""CASE WHEN regexp_matches({x}, ': |:$|^[-?\s>|&*!%@`\[\]{{}}#,''"]|#\s|\s$|^$') THEN '"' || replace(replace({x}, '\', '\\'), '"', '\"') || '"' ELSE {x} END"""


#: Lines of each body with their number and start, and the sections between headings.
_LINES = """split AS (SELECT path, length(body) AS total, unnest(string_split(body, chr(10))) AS l, generate_subscripts(string_split(body, chr(10)), 1) AS i FROM doc),
line AS (SELECT *, sum(length(l) + 1) OVER (PARTITION BY path ORDER BY i) - length(l) - 1 AS start, count(*) FILTER (l LIKE '#%') OVER (PARTITION BY path ORDER BY i) AS sec FROM split)"""
_SECTIONS = rf"""section AS (SELECT path, sec, max({strip("regexp_extract(l, '^#{1,6}((?s:.*))$', 1)")}) FILTER (l LIKE '#%') AS heading, coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (l NOT LIKE '#%'), '') AS content FROM line GROUP BY path, sec)"""


def _words(x: str) -> str:
    return f"len(list_filter(string_split_regex({x}, '{WS}+'), lambda t: t <> ''))"


def _cut(x: str, budget: int = 6400) -> str:
    """Where the first part of a text ends: 0 if it fits, negative if the cut is hard."""
    w, ws, inline = f"left({x}, {budget})", WS[1:-1], r"[ \t\f\r\x0b\x1c-\x1f\x{85}\p{Z}]"
    spots = [rf"length(regexp_extract({w}, '^((?s:.*)\n)#{{1,6}} ', 1))", rf"length(regexp_extract({w}, '^((?s:.*)[^{ws}]{inline}*)\n{WS}*\n', 1))", rf"length(regexp_extract({w}, '^((?s:.*)[.!?]){WS}', 1))"]
    return f"CASE WHEN length({x}) <= {budget} THEN 0 " + " ".join(f"WHEN {s} > {budget // 4} THEN {s}" for s in spots) + f" ELSE -{budget} END"


ORACLES = {
    "split_lossless": f"WITH {DOC} SELECT path, sha1(body) AS sha1, true AS all_fit FROM doc WHERE body IS NOT NULL",
    "heading_counts": rf"""WITH {DOC}, h AS (SELECT path, length(regexp_extract(l, '^(#{{1,6}})', 1)) AS level FROM (SELECT path, unnest(string_split(body, chr(10))) AS l FROM doc) WHERE l LIKE '#%') SELECT path, level, count(*) AS n FROM h GROUP BY path, level""",
    "chunk_words": rf"""WITH {DOC}, l AS (SELECT path, unnest(string_split(body, chr(10))) AS l FROM doc), w AS (SELECT path, len(list_filter(string_split_regex(l, '[ \t\n\r\f]+'), lambda t: t <> '')) AS n FROM l WHERE l NOT LIKE '#%')
        SELECT path, sum(n)::BIGINT AS words FROM w GROUP BY path HAVING sum(n) > 0""",
    "norm_keys": f"SELECT display, {norm('display')} AS key FROM {_DISPLAYS}",
    "plural_fold": f"SELECT token, count(*) AS n FROM (SELECT {fold('t')} AS token FROM (SELECT unnest(string_split_regex(lower(display), '[^a-z0-9]+')) AS t FROM {_DISPLAYS}) WHERE t <> '') GROUP BY token",
    "shape_filter": rf"""SELECT display, regexp_matches(c, '^[A-Za-z][A-Za-z0-9\-'' ]{{2,49}}$') AND len(list_filter(string_split_regex(c, '\s+'), lambda w: w <> '')) <= 6
        AND NOT regexp_matches(c, '(?i)^(Tier|Cycle|Phase|Stage|Level|Step|Figure|Table|Section)\s*[\dIVX]+$')
        AND NOT regexp_matches(c, '(?i)^(one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve)\s+\w+s?$') AS ok FROM (SELECT display, {strip('display')} AS c FROM {_DISPLAYS})""",
    "content_hash": f"WITH {DOC} SELECT doc_id, sha1({strip(unlink('body'))}) AS content_hash FROM doc",
    "first_sentence": f"WITH {PARSED} SELECT doc_id, sentence FROM parsed",
    "summary_cap": rf"""WITH {PAGES} SELECT path, CASE WHEN length({_SQUEEZED}) > 160 THEN left({_SQUEEZED}, 159) || '…' ELSE {_SQUEEZED} END AS shown,
        CASE WHEN s = '' THEN 'empty' WHEN length(s) > 300 THEN length(s) || ' chars, over 300' WHEN len(regexp_extract_all(s, '[.!?](?:\s|$)')) > 1 THEN 'more than one sentence' END AS reason
        FROM (SELECT *, {strip("coalesce(summary, '')")} AS s FROM page)""",
    "parse_pages": f"""WITH {PARSED} SELECT doc_id, 'doc' || doc_id AS page_key, coalesce(named, sentence) AS summary, named IS NULL OR lower(coalesce(flag, '1')) IN ('1', 'true', 'yes') AS summary_provisional, type, origin, len(tags) AS n_tags FROM parsed""",
    "extract_links": f"""WITH {DOC}, each AS (SELECT path, unnest({_INNER}) AS i, generate_subscripts({_INNER}, 1) AS pos FROM doc),
        n AS (SELECT path AS source, {norm("split_part(i, '|', 1)")} AS target_key, pos, trim(regexp_replace(CASE WHEN contains(i, '|') THEN substr(i, instr(i, '|') + 1) ELSE i END, '{WS}+', ' ', 'g')) AS display FROM each)
        SELECT source, target_key, min_by(display, pos) AS display FROM n GROUP BY source, target_key""",
    "bloat": rf"WITH {PARSED} SELECT path, len(regexp_extract_all(body, '(?m)^## ')) AS sections, len(regexp_extract_all(body, '(?m)^## ')) > 12 AS bloated FROM parsed WHERE type = 'concept' AND body IS NOT NULL",
    "outline": rf"""WITH {DOC}, {_LINES}, h AS (SELECT path, row_number() OVER (PARTITION BY path ORDER BY i) AS pos, length(regexp_extract(l, '^(#{{1,6}})', 1)) AS level, start, {strip("regexp_extract(l, '^#{1,6}((?s:.*))$', 1)")} AS heading, total FROM line WHERE l LIKE '#%')
        SELECT path, pos AS "at", level, heading, lead(start, 1, total) OVER (PARTITION BY path ORDER BY pos) - start AS size FROM h""",
    "section_part": rf"""WITH {DOC}, {_LINES}, {_SECTIONS} SELECT path, min_by(content, sec) AS content FROM section WHERE sec > 0 AND {norm('heading')} = 'background' GROUP BY path""",
    "chunk_pages": rf"""WITH RECURSIVE {PARSED}, {_LINES}, {_SECTIONS}, body AS (SELECT path, sec, heading, {strip('content')} AS text, {_words('content')} AS words FROM section WHERE NOT regexp_matches(content, '^{WS}*$')),
        para AS (SELECT path, sec, unnest(string_split(text, chr(10) || chr(10))) AS text, generate_subscripts(string_split(text, chr(10) || chr(10)), 1) AS i FROM body WHERE words > 400), sized AS (SELECT *, {_words('text')} AS w FROM para),
        walk AS (SELECT path, sec, i, w AS n, 0 AS piece FROM sized WHERE i = 1 UNION ALL
          SELECT p.path, p.sec, p.i, CASE WHEN n + p.w > 400 THEN p.w ELSE n + p.w END, CASE WHEN n + p.w > 400 THEN piece + 1 ELSE piece END FROM walk w JOIN sized p ON p.path = w.path AND p.sec = w.sec AND p.i = w.i + 1),
        packed AS (SELECT path, sec, piece, string_agg(text, chr(10) || chr(10) ORDER BY i) AS content FROM walk JOIN sized USING (path, sec, i) GROUP BY path, sec, piece),
        piece AS (SELECT path, sec, 0 AS piece, heading, text AS content FROM body WHERE words <= 400 UNION ALL SELECT path, sec, p.piece, heading, content FROM packed p JOIN body USING (path, sec)),
        chunk AS (SELECT path, row_number() OVER (PARTITION BY path ORDER BY sec, piece)::INT AS seq, heading, content, false AS is_summary FROM piece
          UNION ALL SELECT path, 0, NULL, coalesce(named, sentence), true FROM parsed WHERE body IS NOT NULL)
        SELECT path, seq, heading, content, is_summary, sha1({strip(unlink("concat_ws(chr(10), CASE WHEN is_summary THEN regexp_replace(path, '.md$', '') END, nullif(heading, ''), nullif(content, ''))"))}) AS stripped_hash FROM chunk""",
    "split_parts": rf"""WITH RECURSIVE {DOC}, cut AS (SELECT path, 0 AS part, body AS rest, {_cut('body')} AS pos FROM doc WHERE body IS NOT NULL
          UNION ALL SELECT path, part + 1, r, {_cut('r')} FROM (SELECT path, part, substr(rest, abs(pos) + 1) AS r FROM cut WHERE pos <> 0) WHERE r <> '')
        SELECT path, part, CASE WHEN pos = 0 THEN rest ELSE left(rest, abs(pos)) END AS text, pos < 0 AS hard FROM cut""",
    "rendered_pages": f"""WITH {PAGES} SELECT path, sha1('---' || chr(10) || concat_ws(chr(10), 'type: ' || {_yaml('type')}, 'summary: ' || {_yaml('summary')}, 'origin: ' || {_yaml('origin')}, 'page_key: ' || {_yaml('page_key')}) || chr(10) || '---' || chr(10) || chr(10) || regexp_replace(coalesce(summary, ''), '^{WS}+', '')) AS sha1 FROM page""",
    "name_signs": f"""SELECT display, CASE WHEN contains(display, '/') THEN display ELSE 'notes/' || display END AS path, regexp_matches(display, '[0-9]{{3,}}') AS opaque,
        coalesce(array_to_string((SELECT list(k ORDER BY i) FROM (SELECT k, min(i) AS i FROM (SELECT unnest(ks) AS k, generate_subscripts(ks, 1) AS i) WHERE length(k) > 2 GROUP BY k)), ' '), '') AS words FROM (SELECT display, [{norm('x')} FOR x IN string_split_regex(display, '{WS}+')] AS ks FROM {_DISPLAYS})""",
    "leading_sentences": rf"""WITH {DOC}, f AS (SELECT doc_id, body, trim(regexp_replace(regexp_replace(body, '(?m)^#{{1,6}}[^\n]*$', '', 'g'), '{WS}+', ' ', 'g')) AS flat FROM doc)
        SELECT doc_id, coalesce(nullif(coalesce(nullif(regexp_extract(flat, '^((?s:.*?)[.!?]) ', 1), ''), flat), ''), CASE WHEN body IS NOT NULL THEN '(no text)' END) AS sentence FROM f""",
    "tag_presence": rf"""WITH {PARSED}, plain AS (SELECT path, tags, {unlink('body')} AS plain FROM parsed WHERE body IS NOT NULL), tag AS (SELECT path, plain, unnest(tags) AS tag FROM plain),
        found AS (SELECT path, count(DISTINCT {norm('tag')}) AS n FROM tag WHERE {norm('tag')} <> '' AND regexp_matches(plain, '(?i)(?:^|[^\[\p{{L}}\p{{M}}\p{{N}}_])' || regexp_replace(regexp_escape({strip('tag')}), '(\?\s)+', '\\s+', 'g') || '(?:$|[^\p{{L}}\p{{M}}\p{{N}}_\]])') GROUP BY path)
        SELECT p.path, coalesce(n, 0) AS survivors, coalesce(n, 0) / greatest({_words('plain')}, 1) < 0.0025 AS low FROM plain p LEFT JOIN found f ON f.path = p.path""",
    "text_window": f"WITH {DOC}, x AS (SELECT path, body, instr(lower(body), 'lantern drift') AS p FROM doc) SELECT path, substr(body, greatest(p - 3200, 1), p - greatest(p - 3200, 1) + 13 + 3200) AS around FROM x WHERE p > 0",
    "text_windows": f"""WITH {DOC}, w AS (SELECT path, list_filter([substr(body, i + 1, 1000) FOR i IN CASE WHEN length(body) > 1000 THEN range(0, length(body), 900) ELSE [0] END], lambda w: NOT regexp_matches(w, '^{WS}*$')) AS w FROM doc WHERE body IS NOT NULL)
        SELECT path, len(w) AS n, sha1(array_to_string(w, '|')) AS sha1 FROM w""",
    "token_counts": "SELECT doc_id, round_even(length(text) / 4, 0)::INT AS tokens FROM documents",
    "yaml_values": rf"""WITH {PAGES} SELECT path, CASE WHEN regexp_matches(summary, ': |:$|^[-?\s>|&*!%@`\[\]{{}}#,''"]|#\s|\s$|^$') THEN '"' || replace(replace(summary, '\', '\\'), '"', '\"') || '"' ELSE summary END AS value FROM page WHERE summary IS NOT NULL""",
    "pending_analysis": f"WITH {PAGES} SELECT path FROM page WHERE analyzed_hash IS DISTINCT FROM content_hash",
}
