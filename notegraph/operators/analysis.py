"""Model answers on pages: repair of JSON, gates, retries and status rows. The model is a plain function."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notegraph.functions import text as T
from notegraph.operators.linker import link_pages
from notegraph.operators.parse import windows
from notegraph.operators.skew import salted_join
from notegraph.session import written

#: Concepts a word that a page should yield, and characters that a context of n tokens has room for.
CONCEPT_FLOOR = 0.0025
CHARS_PER_TOKEN, OVERHEAD, RESERVE = 4, 200, 600
#: A prompt of so many tokens less than the context was cut short.
MARGIN, TRUNCATED = 300, "the prompt filled the context"
#: What a model gives: its answer, or that and the tokens of the prompt.
Answer = str | tuple[str, int]


def repair_json(x: Column) -> Column:
    """struct(json, repairs): an answer cut to its JSON object, null if it can't be read, and what was mended.

    Thoughts are dropped; a code fence, text before and behind the object and commas before closing
    brackets are mended and named. Null answers give null and no repairs.
    """
    # each step reads the one before once, so that the expression doesn't grow with every step
    told = T.strip_space(F.regexp_replace(T.strip_space(x), r"(?s)<think>.*?</think>", ""))
    bare = T.strip_space(F.regexp_replace(told, r"(?s)^```[a-z]*\n?(.*?)(?:```)?$", "$1"))
    led = F.regexp_replace(bare, r"(?s)^[^{]+(?=\{)", "")
    t = F.regexp_replace(led, r"(?s)(?<=\})[^}]+$", "")
    fence, before, behind = told.startswith("```"), bare != led, led != t
    patched = F.regexp_replace(t, r",(\s*[}\]])", "$1")
    whole, mended = F.try_parse_json(t).isNotNull(), F.try_parse_json(patched).isNotNull()
    json = F.when(whole, t).when(mended, patched)
    marks = [F.when(fence, F.lit("code fence")), F.when(before, F.lit("preamble")), F.when(behind, F.lit("trailing text")), F.when(~whole & mended, F.lit("trailing comma")), F.when(x.isNotNull() & ~whole & ~mended, F.lit("unparseable"))]
    return F.struct(json.alias("json"), F.filter(F.array(*marks), lambda m: m.isNotNull()).alias("repairs"))


def gate_concepts(pages: DataFrame, concepts: str, path: str = "path", body: str = "body") -> DataFrame:
    """(path, survivors, low): the concepts that stand word for word in the body, each key once in order, and whether they are few."""
    each = pages.select(path, body, F.posexplode_outer(concepts).alias("pos", "c")).withColumn("c", T.strip_space(T.strip_links("c")))
    key = T.normalize("c")
    good = each.where((key != "") & T.concept_present(body, F.col("c"))).groupBy(F.col(path).alias("at"), key.alias("key")).agg(F.min(F.struct("pos", "c")).alias("f"))
    lists = good.groupBy("at").agg(F.transform(F.array_sort(F.collect_list("f")), lambda s: s["c"]).alias("survivors"))
    words = F.greatest(F.size(F.filter(F.split(T.squeeze(T.strip_links(body)), " "), lambda w: w != "")), F.lit(1))
    out = pages.select(path, words.alias("words")).join(lists, F.col(path) == F.col("at"), "left")
    kept = F.coalesce("survivors", F.array().cast("array<string>"))
    return out.select(path, kept.alias("survivors"), (F.size(kept) / F.col("words") < CONCEPT_FLOOR).alias("low"))


def room(context: int) -> int:
    """Characters of text for which a context of that many tokens has room."""
    return max(0, (context - OVERHEAD - RESERVE) * CHARS_PER_TOKEN)


def ask(df: DataFrame, complete: Callable[[str], Answer], prompt: str, key: str = "path") -> DataFrame:
    """(key, answer, tokens, error): the model's answer to each prompt, and the tokens it counted in the prompt if it says so.

    A failing call is its row's error, never the job's. The answers are written once, so that every
    later step sees the same ones and no prompt is asked again.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, p in zip(b[key], b[prompt]):
                try:
                    said = complete(p)
                    answer, tokens = said if isinstance(said, tuple) else (said, None)
                    rows.append((k, answer, tokens, None))
                except Exception as e:  # noqa: BLE001
                    rows.append((k, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=[key, "answer", "tokens", "error"]).astype({"tokens": "Int64"})

    return written(df.select(key, prompt).mapInPandas(run, f"{key} string, answer string, tokens bigint, error string"), "answers")


def analyse(pages: DataFrame, complete: Callable[[str], Answer], context: int = 8192) -> DataFrame:
    """(path, status, note, summary, concepts): ok, low_yield or failed for each page, after at most two answers.

    An answer that can't be read or whose summary doesn't pass is asked for once more, as is one of
    too few concepts, which is then accepted; a prompt that filled the context is not. A body beyond the context's room and a transcript
    (column `type`) are read window by window; they keep the summary of the column of that name and
    fail only if no window can be read.
    """
    optional = [F.col(c) if c in pages.columns else F.lit(None).cast("string").alias(c) for c in ("type", "summary")]
    ready = pages.where("body is not null").select("path", "body", *optional)
    large = F.length("body") > room(context)
    windowed = large | F.coalesce(F.col("type") == "transcript", F.lit(False))
    fits = ready.where(~windowed).select("path", "body")
    first = written(_attempt(fits, complete, context), "attempt")
    again = first.where(F.col("status").isin("failed", "low_yield") & ~F.col("note").eqNullSafe(TRUNCATED)).select(F.col("path").alias("p"))
    second = _attempt(fits.join(again, F.col("path") == F.col("p"), "left_semi"), complete, context)
    done = first.join(again, F.col("path") == F.col("p"), "left_anti").unionByName(second)
    return done.unionByName(_windowed(ready.where(windowed).withColumn("large", large), complete, room(context)))


def _windowed(pages: DataFrame, complete: Callable[[str], Answer], size: int) -> DataFrame:
    found = written(window_concepts(pages, complete, size), "windows").withColumnRenamed("path", "f")
    joined = pages.join(found, F.col("path") == F.col("f"), "left").withColumn("c", F.coalesce("concepts", F.array().cast("array<string>"))).drop("concepts")
    gated = gate_concepts(joined, "c").select(F.col("path").alias("g"), "survivors", "low")
    out = joined.join(gated, F.col("path") == F.col("g"))
    none = F.coalesce("failed", F.lit(0)) == F.coalesce("windows", F.lit(0))
    some = F.when(F.col("failed") > 0, F.concat(F.col("failed").cast("string"), F.lit(" of "), F.col("windows").cast("string"), F.lit(" windows failed")))
    note = F.when(none, F.when(F.col("large"), "larger than the context").otherwise("every window failed")).otherwise(F.nullif(F.concat_ws("; ", F.when(F.col("large"), "read in windows"), some), F.lit("")))
    status = F.when(none, "failed").when(F.col("low"), "low_yield").otherwise("ok")
    return out.select("path", status.alias("status"), note.alias("note"), F.when(~none, F.col("summary")).alias("summary"), F.col("survivors").alias("concepts"))


def _attempt(pages: DataFrame, complete: Callable[[str], Answer], context: int) -> DataFrame:
    answers = ask(pages, complete, "body").withColumn("r", repair_json(F.col("answer")))
    full = F.coalesce(F.col("tokens") >= context - MARGIN, F.lit(False))
    read = answers.select(F.col("path").alias("p"), F.when(full, TRUNCATED).otherwise(F.col("error")).alias("error"), F.from_json("r.json", "summary string, concepts array<string>").alias("a"))
    joined = pages.join(read, F.col("path") == F.col("p")).select("path", "body", "error", F.col("a.summary").alias("summary"), F.coalesce("a.concepts", F.array().cast("array<string>")).alias("c"), F.col("a").isNull().alias("bad"))
    gated = gate_concepts(joined, "c").select(F.col("path").alias("g"), "survivors", "low")
    reason = F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("bad"), "unparseable").otherwise(T.gate_summary("summary"))
    out = joined.join(gated, F.col("path") == F.col("g")).withColumn("note", reason)
    status = F.when(F.col("note").isNotNull(), "failed").when(F.col("low"), "low_yield").otherwise("ok")
    return out.select("path", status.alias("status"), "note", F.when(status != "failed", F.col("summary")).alias("summary"), F.col("survivors").alias("concepts"))


def window_concepts(pages: DataFrame, complete: Callable[[str], Answer], size: int = 4000) -> DataFrame:
    """(path, concepts, windows, failed): concepts of large pages, asked window by window, and how many windows gave none that can be read.

    Of equal keys the first window's holds; names that no concept can have are dropped.
    """
    parts = pages.where("body is not null").select("path", F.posexplode(windows(F.col("body"), size)).alias("at", "window"))
    asked = ask(parts.select(F.concat_ws("\n", F.col("at").cast("string"), "path").alias("id"), "window"), complete, "window", "id")
    cut = F.expr("substr(id, instr(id, '\n') + 1)")
    read = asked.select(cut.alias("path"), F.substring_index("id", "\n", 1).cast("int").alias("at"), F.from_json(repair_json(F.col("answer"))["json"], "concepts array<string>").alias("a"))
    counted = read.groupBy("path").agg(F.count(F.lit(1)).alias("windows"), F.count_if(F.col("a").isNull()).alias("failed"))
    each = read.select(F.col("path").alias("p"), "at", F.posexplode("a.concepts").alias("pos", "concept")).withColumn("concept", T.strip_space(T.strip_links("concept"))).where((T.normalize("concept") != "") & T.shape_ok("concept"))
    first = each.groupBy("p", T.normalize("concept").alias("key")).agg(F.min(F.struct("at", "pos", "concept")).alias("f"))
    lists = first.groupBy("p").agg(F.transform(F.array_sort(F.collect_list("f")), lambda s: s["concept"]).alias("concepts"))
    return counted.join(lists, F.col("path") == F.col("p"), "left").select("path", F.coalesce("concepts", F.array().cast("array<string>")).alias("concepts"), "windows", "failed")


def summarise(pages: DataFrame, complete: Callable[[str], Answer]) -> DataFrame:
    """(path, status, note, summary): one-sentence summaries by a model of large context, each page asked at most twice."""

    def attempt(some: DataFrame) -> DataFrame:
        read = ask(some, complete, "body").select("path", "error", F.from_json(repair_json(F.col("answer"))["json"], "summary string").alias("a"))
        note = F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("a").isNull(), "unparseable").otherwise(T.gate_summary("a.summary"))
        return read.withColumn("note", note).select("path", F.when(F.col("note").isNull(), "ok").otherwise("failed").alias("status"), "note", F.when(F.col("note").isNull(), T.strip_space("a.summary")).alias("summary"))

    ready = pages.where("body is not null").select("path", "body")
    first = attempt(ready)
    again = first.where("status <> 'ok'").select(F.col("path").alias("p"))
    return first.where("status = 'ok'").unionByName(attempt(ready.join(again, F.col("path") == F.col("p"), "left_semi")))


def commit(pages: DataFrame, analysed: DataFrame, index: DataFrame, known: DataFrame) -> DataFrame:
    """(path, linked, status, note): bodies with their concepts linked, for pages whose analysis went well.

    pages: (path, body, type, origin, content_hash); analysed: that of `analyse`; index: (key,
    canonical); known: (key). Transcripts and pages under `sources/` get no links. Derived pages
    keep concepts that are known already, so that what is derived adds none. A page whose hash would
    change is not committed but failed. Failed pages keep their note and have no body here.
    """
    a = analysed.select(F.col("path").alias("p"), "status", "note", "concepts")
    both = written(pages.select("path", "body", "type", "origin", "content_hash").join(a, F.col("path") == F.col("p")).drop("p"), "commit")
    quiet = F.col("path").startswith("sources/") | F.coalesce(F.col("type") == "transcript", F.lit(False))
    derived = F.coalesce(F.col("origin") == "derived", F.lit(False))
    each = both.where(derived & ~quiet).select(F.col("path").alias("p"), F.posexplode("concepts").alias("pos", "c")).withColumn("k", T.normalize("c"))
    kept = salted_join(each, known.select(F.col("key").alias("known")).distinct(), "k", "known", "left_semi", salt_by="p").groupBy("p").agg(F.array_sort(F.collect_list(F.struct("pos", "c"))).alias("kept"))
    gated = both.join(kept, F.col("path") == F.col("p"), "left")
    none = F.array().cast("array<string>")
    chosen = F.when(quiet | (F.col("status") == "failed"), none).when(derived, F.coalesce(F.transform("kept", lambda x: x["c"]), none)).otherwise(F.col("concepts"))
    linked = link_pages(gated.withColumn("chosen", chosen), "chosen", index).select(F.col("path").alias("l"), "linked")
    out = both.join(linked, F.col("path") == F.col("l"))
    moved = ~T.content_hash("linked").eqNullSafe(F.col("content_hash"))
    status = F.when((F.col("status") != "failed") & moved, "failed").otherwise(F.col("status"))
    note = F.when((F.col("status") != "failed") & moved, "the hash moved").otherwise(F.col("note"))
    return out.select("path", F.when(status != "failed", F.col("linked")).alias("linked"), status.alias("status"), note.alias("note"))


def record(before: DataFrame, attempts: DataFrame, now: Column) -> DataFrame:
    """(path, content_hash, status, note, at): the last attempt on each page, `attempts` (path, content_hash, status, note) going before what was recorded."""
    new = attempts.withColumn("at", now)
    old = before.join(new.select(F.col("path").alias("p")).distinct(), F.col("path") == F.col("p"), "left_anti")
    return old.unionByName(new.groupBy("path").agg(F.max(F.struct("at", "content_hash", "status", "note")).alias("r")).select("path", "r.content_hash", "r.status", "r.note", "r.at"))


def attempted(pages: DataFrame, recorded: DataFrame) -> DataFrame:
    """Pages with analyzed_hash brought to the hash of their recorded attempt: also a failed page leaves the queue until it changes."""
    r = recorded.select(F.col("path").alias("p"), F.col("content_hash").alias("tried"))
    both = pages.join(r, F.col("path") == F.col("p"), "left")
    return both.withColumn("analyzed_hash", F.coalesce("tried", "analyzed_hash")).drop("p", "tried")


def pass_counts(recorded: DataFrame) -> DataFrame:
    """One row: pages that went well, gave little, or failed."""
    return recorded.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("ok", "low_yield", "failed")])


def transcript(turns: DataFrame, conversation: str = "conv_id", order: str = "turn") -> DataFrame:
    """(conversation, text): the turns of user and assistant in order under role headings; empty turns and other roles are dropped."""
    kept = turns.where(F.col("role").isin("user", "assistant") & (T.strip_space("text") != ""))
    part = F.concat(F.lit("## "), F.col("role"), F.lit("\n\n"), T.strip_space("text"))
    lists = kept.groupBy(conversation).agg(F.array_sort(F.collect_list(F.struct(F.col(order), part.alias("part")))).alias("parts"))
    return lists.select(conversation, F.array_join(F.transform("parts", lambda p: p["part"]), "\n\n").alias("text"))
