"""Writing, moving and removing pages on an append-only table of page versions.

versions: (path, version, text, mtime, removed). A change is a set of new version rows; the table
of current pages is the latest version of each path. Nothing is rewritten in place, so a job that
dies leaves no half-changed page.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notegraph.functions import text as T
from notegraph.operators.parse import block_of, body_of, extract_links, field
from notegraph.operators.skew import salted_join
from notegraph.session import written

SCHEMA = "path string, version bigint, text string, mtime timestamp, removed boolean"
OWNED = ("summary", "summary_provisional", "origin", "created", "updated")
#: Characters of the hash that a writer must show at least.
EXPECT = 8


def current(versions: DataFrame) -> DataFrame:
    """(path, version, text, mtime) of the pages that exist; of equal versions the later by mtime holds."""
    last = F.max(F.struct("version", "mtime", "text", "removed")).alias("v")
    return versions.groupBy("path").agg(last).where(~F.coalesce("v.removed", F.lit(False))).select("path", "v.version", "v.text", "v.mtime")


@dataclass
class Outcome:
    """What became of a request: DONE with the versions to append, or RETRY or STOP with the reason."""

    status: str
    note: str
    versions: DataFrame | None = None


def _put(lines: Column, key: Column | str, value: Column, keep: bool = False) -> Column:
    """Frontmatter lines with one field set (or, with `keep`, set only if it isn't there)."""
    key = F.lit(key) if isinstance(key, str) else key
    own = lambda line: T.strip_space(F.substring_index(line, ":", 1)).eqNullSafe(key) & line.contains(":") & ~line.rlike(r"^[\s#-]")
    line = F.concat(key, F.lit(": "), value)
    there = F.exists(lines, own)
    set_to = lines if keep else F.transform(lines, lambda x: F.when(own(x), line).otherwise(x))
    return F.when(there, set_to).otherwise(F.concat(lines, F.array(line)))


def _section_at(lines: Column, key: Column) -> Column:
    """The number (from 1) of the first heading line of that key, 0 if there is none."""
    keys = F.transform(lines, lambda x: F.when(x.startswith("#"), T.normalize(F.regexp_replace(x, r"^#{1,6}", ""))))
    return F.coalesce(F.array_position(keys, key), F.lit(0)).cast("int")


def write_pages(versions: DataFrame, requests: DataFrame, today: Column | None = None, origin: str = "conversation", folder: str = "notes", concepts: str = "wiki", records: str = "conversations") -> DataFrame:
    """(request, path, status, note, version, text): what became of each request to change a page; DONE rows with a text are new versions.

    requests: (request, path, content, where, target, expect). A path without a folder goes to
    `folder`. where: section (the default; target is its heading, which is replaced too), whole, end
    or frontmatter (target is the field). expect is the beginning of the hash that the writer last
    saw, or `new`. On a page that came from a conversation `new` appends under the day's heading,
    unless the page says so already. Records (transcripts, and what lies beside them) can't be
    written, concept pages not be made, fields of the system not be set. Of several requests for one
    page the first goes; the others have to look again. Every version is stamped with its day and has a summary, if need
    be its first sentence. Null paths, contents and hashes are answered with RETRY.
    """
    today = F.date_format(F.current_timestamp(), "yyyy-MM-dd") if today is None else today
    r = requests.select("request", T.write_path("path", folder).alias("path"), "content", F.coalesce("where", F.lit("section")).alias("where"), T.strip_space("target").alias("target"), F.nullif("expect", F.lit("")).alias("expect"))
    first = r.where("path is not null").groupBy(F.col("path").alias("p")).agg(F.min("request").alias("first"))
    state = versions.join(first.select(F.col("p").alias("asked")), F.col("path") == F.col("asked"), "left_semi").groupBy(F.col("path").alias("v_path")).agg(F.max(F.struct("version", "mtime", "text", "removed")).alias("v"))
    whole = F.when(~F.coalesce("v.removed", F.lit(False)), F.coalesce("v.text", F.lit("")))
    state = state.select("v_path", F.col("v.version").alias("last"), whole.alias("old")).withColumns({"block": block_of(F.col("old")), "body": body_of(F.col("old"))})
    state = state.withColumns({"hash": T.content_hash("body"), "type": field(F.col("block"), "type"), "origin": field(F.col("block"), "origin")})
    quiet = current(versions).where(field(block_of(F.col("text")), "type") == "transcript").select(_folder("path").alias("quiet")).where("quiet <> ''").distinct()
    known = first.join(state, F.col("p") == F.col("v_path"), "left").withColumn("folder", _folder("p")).join(quiet, F.col("folder") == F.col("quiet"), "left")
    j = salted_join(r.where("path is not null"), written(known, "known"), "path", "p", salt_by="request")

    exists, content = F.col("old").isNotNull(), T.strip_space("content")
    is_new = F.col("expect") == "new"
    grows = exists & is_new & F.coalesce(F.col("origin") == "conversation", F.lit(False))
    said = T.squeeze("body").contains(T.squeeze("content"))
    where = F.when(grows, "end").otherwise(F.col("where"))
    given, lines = block_of(F.col("content")), F.split("body", "\n")
    j = j.withColumns({"lines": lines, "at": _section_at(lines, T.normalize("target")), "given": given})
    owned = lambda x: F.exists(F.split(x, "\n"), lambda line: T.strip_space(F.substring_index(line, ":", 1)).isin(*OWNED) & line.contains(":"))
    shown = F.substring("hash", 1, EXPECT)
    record = F.coalesce(F.col("type") == "transcript", F.lit(False)) | F.col("path").startswith(records + "/") | F.col("quiet").isNotNull()
    # the order of the rules is the order in which a request is refused
    verdict = (
        F.when(F.col("expect").isNull(), _say("RETRY", "no hash was given"))
        .when(F.col("content").isNull(), _say("RETRY", "no content was given"))
        .when(~F.col("where").isin("section", "whole", "end", "frontmatter"), _say("RETRY", "where is one of section, whole, end, frontmatter"))
        .when(record, _say("STOP", "records can't be written"))
        .when(~exists & F.col("path").startswith(concepts + "/"), _say("STOP", "concept pages are made by the nightly run"))
        .when(grows & said, _say("DONE", "the page says so already"))
        .when(exists & is_new & ~grows, _say("RETRY", F.concat(F.lit("the page exists: "), shown)))
        .when(~exists & ~is_new, _say("RETRY", "there is no such page"))
        .when(exists & ~grows & ((F.length("expect") < EXPECT) | ~F.col("hash").startswith(F.col("expect"))), _say("RETRY", F.concat(F.lit("the page has changed: "), shown)))
        .when(F.col("request") != F.col("first"), _say("RETRY", "another request came first"))
        .when(~exists & owned(F.col("given")), _say("STOP", "fields of the system can't be set"))
        .when(exists & (where == "frontmatter") & ~F.coalesce(F.col("target").rlike("^[A-Za-z_][A-Za-z0-9_-]*$"), F.lit(False)), _say("RETRY", "there is no such field"))
        .when(exists & (where == "frontmatter") & F.col("target").isin(*OWNED), _say("STOP", "fields of the system can't be set"))
        .when(exists & (where == "section") & (F.col("at") == 0), _say("RETRY", "there is no such heading"))
        .otherwise(_say("DONE", "written"))
    )
    heads = F.regexp_extract_all("body", F.lit(r"(?m)^##[^\S\n]+([^\n]+?)[^\S\n]*$"), 1)
    dated = F.when(content.startswith("#") | F.coalesce(F.try_element_at(heads, F.lit(-1)) == today, F.lit(False)), content).otherwise(F.concat(F.lit("## "), today, F.lit("\n\n"), content))
    rest = F.slice("lines", F.col("at") + 1, F.size("lines"))
    ahead = F.array_position(F.transform(rest, lambda x: x.startswith("#")), F.lit(True)).cast("int")
    behind = F.when(ahead > 0, F.array_join(F.slice(rest, ahead, F.size("lines")), "\n")).otherwise(F.lit(""))
    before = F.array_join(F.slice("lines", 1, F.greatest(F.col("at") - 1, F.lit(0))), "\n")
    body = (
        F.when(~exists, F.concat(T.strip_space(body_of(F.col("content"))), F.lit("\n")))
        .when(where == "whole", F.concat(content, F.lit("\n")))
        .when(where == "end", F.concat(F.regexp_replace("body", rf"{T.WS}+$", ""), F.lit("\n\n"), F.when(grows, dated).otherwise(content), F.lit("\n")))
        .when(where == "section", F.concat(before, F.when(F.col("at") > 1, "\n").otherwise(""), content, F.lit("\n\n"), behind))
        .otherwise(F.col("body"))
    )
    j = j.withColumns({"verdict": verdict, "new_body": body, "dating": today, "where": where})
    done = F.col("verdict.note") == "written"
    fields = F.filter(F.split(F.when(exists, F.col("block")).otherwise(F.col("given")), "\n"), lambda x: x != "")
    fields = F.when(exists, F.when(F.col("where") == "frontmatter", _put(fields, F.col("target"), T.yaml_value(T.squeeze("content")))).otherwise(fields)).otherwise(_put(fields, "type", F.lit("note"), keep=True))
    j = j.withColumn("fields", F.when(done, fields))
    for name, value, keep in (("created", F.col("dating"), True), ("updated", F.col("dating"), False), ("origin", F.lit(origin), True)):
        j = j.withColumn("fields", _put(F.col("fields"), name, value, keep))
    unsummed = F.coalesce(field(F.array_join("fields", "\n"), "summary"), F.lit("")) == ""
    summed = _put(_put(F.col("fields"), "summary", T.yaml_value(T.first_sentence("new_body"))), "summary_provisional", F.lit("1"))
    j = j.withColumn("fields", F.when(unsummed, summed).otherwise(F.col("fields")))
    text = F.concat(F.lit("---\n"), F.array_join("fields", "\n"), F.lit("\n---\n\n"), F.regexp_replace("new_body", rf"^{T.WS}+", ""))
    out = j.select("request", "path", "verdict.status", "verdict.note", F.when(done, F.coalesce("last", F.lit(0)) + 1).cast("bigint").alias("version"), F.when(done, text).alias("text"))
    none = r.where("path is null").select("request", "path", F.lit("RETRY").alias("status"), F.lit("no path was given").alias("note"), F.lit(None).cast("bigint").alias("version"), F.lit(None).cast("string").alias("text"))
    return out.unionByName(none)


def _folder(path: str) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def _say(status: str, note: Column | str) -> Column:
    return F.struct(F.lit(status).alias("status"), (F.lit(note) if isinstance(note, str) else note).alias("note"))


def new_versions(answers: DataFrame) -> DataFrame:
    """The versions to append of what `write_pages` answered."""
    return answers.where("text is not null").select("path", "version", "text", F.current_timestamp().alias("mtime"), F.lit(False).alias("removed"))


def write(versions: DataFrame, path: str, content: str, expect: str, where: str = "end", target: str | None = None, **layout: str) -> Outcome:
    """One change of one page by the rules of `write_pages`."""
    row = versions.sparkSession.createDataFrame([(1, path, content, where, target, expect)], "request int, path string, content string, where string, target string, expect string")
    answers = written(write_pages(versions, row, **layout), "write")
    said = answers.first()
    return Outcome(said["status"], said["note"], new_versions(answers) if said["text"] is not None else None)


def _relinked(body: Column, old_key: str, new_name: str) -> Column:
    """A text in which links to a key point to another name, keeping what they show."""
    inner = F.array_distinct(F.regexp_extract_all(body, F.lit(T.LINK), 1))
    to_old = F.filter(inner, lambda x: T.normalize(F.substring_index(x, "|", 1)) == old_key)

    def moved(acc: Column, x: Column) -> Column:
        shown = F.when(x.contains("|"), F.substring(x, F.instr(x, "|") + 1, F.length(x))).otherwise(x)
        return F.replace(acc, F.concat(F.lit("[["), x, F.lit("]]")), F.concat(F.lit(f"[[{new_name}|"), shown, F.lit("]]")))

    return F.aggregate(to_old, body, moved)


def relocate(versions: DataFrame, path: str, to: str) -> Outcome:
    """Moves a page and rewrites the links of all citing pages to its new name, showing what they showed."""
    pages = current(versions)
    stem = lambda p: p.rsplit("/", 1)[-1].removesuffix(".md")
    if pages.where(F.col("path") == to).count():
        return Outcome("STOP", "there is a page at the new place")
    if not pages.where(F.col("path") == path).count():
        return Outcome("RETRY", "there is no such page")
    key = versions.sparkSession.range(1).select(T.normalize(F.lit(stem(path)))).first()[0]
    now = F.current_timestamp().alias("mtime")
    own = pages.where(F.col("path") == path)
    gone = own.select("path", (F.col("version") + 1).alias("version"), "text", now, F.lit(True).alias("removed"))
    here = own.select(F.lit(to).alias("path"), F.lit(1).cast("bigint").alias("version"), _relinked(F.col("text"), key, stem(to)).alias("text"), now, F.lit(False).alias("removed"))
    if versions.where(F.col("path") == to).count():
        last = versions.where(F.col("path") == to).agg(F.max("version")).first()[0]
        here = here.withColumn("version", F.lit(last + 1).cast("bigint"))
    out = gone.unionByName(here)
    new_key = versions.sparkSession.range(1).select(T.normalize(F.lit(stem(to)))).first()[0]
    if new_key != key:
        new = _relinked(F.col("text"), key, stem(to))
        citing = pages.where((F.col("path") != path) & F.col("text").contains("[[")).withColumn("new", new).where(F.col("new") != F.col("text"))
        out = out.unionByName(citing.select("path", (F.col("version") + 1).alias("version"), F.col("new").alias("text"), now, F.lit(False).alias("removed")))
    return Outcome("DONE", "moved", out)


def remove(versions: DataFrame, path: str) -> Outcome:
    """Removes a page; links to it become unresolved by themselves."""
    own = current(versions).where(F.col("path") == path)
    if not own.count():
        return Outcome("RETRY", "there is no such page")
    return Outcome("DONE", "removed", own.select("path", (F.col("version") + 1).alias("version"), "text", F.current_timestamp().alias("mtime"), F.lit(True).alias("removed")))


def citing(pages: DataFrame, key: str) -> DataFrame:
    """(source, display) of the pages whose text links a key."""
    return extract_links(pages.withColumn("body", body_of(F.col("text")))).where(F.col("target_key") == key).select("source", "display")
