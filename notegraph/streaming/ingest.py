"""Structured Streaming: pages that arrive, and the guard against repeated requests."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from notegraph.operators.parse import extract_links, parse_pages

WINDOW_US = 120_000_000
#: Stretch of time, and parts into which users and types fall, whose events are one group of a task.
STRETCH_US, PARTS = 86_400_000_000, 256
#: How late an event may be.
LATE = "10 minutes"
PAGE_COLUMNS = ("path", "page_key", "mtime", "summary", "summary_provisional", "type", "origin", "content_hash")


def ingest(arriving: DataFrame, folder: str, checkpoint: str):
    """A query that turns arriving (path, text, mtime) into versions of pages and links under `folder`.

    Each micro-batch adds its parsed rows with its number, so a batch that is run again after a
    failure replaces its own rows only; latest_pages reads the newest version of each path.
    """

    def add(batch: DataFrame, number: int) -> None:
        last = batch.groupBy("path").agg(F.max(F.struct("mtime", "text")).alias("r")).select("path", "r.mtime", "r.text")
        parsed = parse_pages(last)
        parsed.select(*PAGE_COLUMNS).write.mode("overwrite").parquet(f"{folder}/pages/batch={number}")
        extract_links(parsed).write.mode("overwrite").parquet(f"{folder}/links/batch={number}")

    return arriving.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_pages(spark: SparkSession, folder: str) -> DataFrame:
    """The newest version of every page that was ingested, by mtime; of equal ones that of the later batch. A null mtime is older than any."""
    rows = spark.read.parquet(f"{folder}/pages")
    cols = [c for c in rows.columns if c not in ("path", "batch")]
    order = F.struct(F.col("mtime").isNotNull(), "mtime", "batch")
    return rows.groupBy("path").agg(F.max_by(F.struct(*cols), order).alias("r")).select("path", "r.*")


def _guard(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    rows = pd.concat(list(frames)).sort_values(["at", "event_id"])
    who, at = (rows[c].to_numpy(np.int64) for c in ("who", "at"))
    if state.exists:
        who, at = (np.concatenate([np.array(old, np.int64), new]) for old, new in zip(state.get, (who, at)))
    # one number for who and when, in the order of both: a stretch and two windows are less than 2**37 microseconds
    codes = np.unique(who, return_inverse=True)[1].astype(np.int64)
    place = (codes << 37) + at - (int(key[1]) * STRETCH_US - 2 * WINDOW_US)
    known, asked = np.sort(place), place[len(place) - len(rows) :]
    before = np.searchsorted(known, asked) - np.searchsorted(known, asked - WINDOW_US)
    state.update((who.tolist(), at.tolist()))
    state.setTimeoutTimestamp(max((int(key[1]) + 1) * STRETCH_US // 1000, state.getCurrentWatermarkMs() + 1))
    out = pd.DataFrame({"event_id": rows["event_id"].to_numpy(np.int64), "before": before.astype(np.int64)})
    yield out[rows["asks"].to_numpy(bool) & (before > 0)]


def repeats(events: DataFrame) -> DataFrame:
    """(event_id, before): events of a stream that repeat one of their user and type within 120 seconds.

    The state is kept per day for each of PARTS parts of users and types (told apart by a 64-bit hash), as a
    group for each of them would cost far more than its few events: an event is put to its own day and, in its last
    120 seconds, as a past to the following one, so a user of very many events is spread over time. A
    day's state goes once the watermark has passed it, so an event that is late, but not later
    than the watermark allows, still finds its past. Each event counts those that had arrived with
    or before it; later ones are left out.
    """
    timed = events.where("ts is not null").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", LATE)
    at = timed.select("event_id", F.xxhash64("user_id", "event_type").alias("who"), "ts", F.unix_micros("ts").alias("at")).withColumn("part", F.pmod("who", F.lit(PARTS)))
    stretch, next_one = F.floor(F.col("at") / STRETCH_US), F.floor((F.col("at") + WINDOW_US) / STRETCH_US)
    own, later = F.struct(stretch.alias("stretch"), F.lit(True).alias("asks")), F.struct(next_one.alias("stretch"), F.lit(False).alias("asks"))
    roles = F.when(stretch == next_one, F.array(own)).otherwise(F.array(own, later))
    placed = at.withColumn("r", F.explode(roles)).select("event_id", "who", "ts", "at", "part", "r.stretch", "r.asks")
    return placed.groupBy("part", "stretch").applyInPandasWithState(_guard, "event_id bigint, before bigint", "who array<bigint>, seen array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)


def first_calls(calls: DataFrame, generation: str, name: str, arguments: str, order: str) -> DataFrame:
    """Of calls of one generation with equal names and arguments the first, with the number of all of them as `calls`. Null arguments equal each other."""
    return calls.groupBy(generation, name, arguments).agg(F.min(order).alias(order), F.count(F.lit(1)).alias("calls"))
