"""Directories of markdown files as tables of pages, and back."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from notegraph.operators.sync import visible


class VaultUnreachable(Exception):
    """The folder isn't there; nothing may be concluded from its emptiness."""


def scan(spark: SparkSession, folder: str, exclude: tuple[str, ...] = (), since: str | None = None) -> DataFrame:
    """(path, mtime, text, readable) of the markdown files under a folder, dot folders and excluded ones aside.

    Files that aren't UTF-8 come with null text and readable = false, so that they can be reported.
    `since` leaves out files last changed before it already when listing.
    """
    if "://" not in folder and not os.path.isdir(folder):
        raise VaultUnreachable(folder)
    base = folder if "://" in folder else "file:" + os.path.abspath(folder)
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md")
    files = (reader.option("modifiedAfter", since) if since else reader).load(folder)
    clean = F.regexp_replace("path", r"^file:/+", "file:/")
    relative = F.substring(clean, len(base.rstrip("/")) + 2, 1_000_000)
    text = F.col("content").cast("string")
    ok = F.is_valid_utf8(text)
    return files.select(relative.alias("path"), F.col("modificationTime").alias("mtime"), F.when(ok, text).alias("text"), ok.alias("readable")).where(visible(F.col("path"), exclude))


def export(pages: DataFrame, folder: str) -> None:
    """Writes each page's text to its path under a folder that all executors share; a file is replaced at once or not at all."""

    def put(rows: Iterator[Row]) -> None:
        for r in rows:
            if r["text"] is None or r["path"] is None or ".." in r["path"].split("/"):
                continue
            at = os.path.join(folder, r["path"])
            os.makedirs(os.path.dirname(at), exist_ok=True)
            with open(at + ".part", "w", encoding="utf-8", newline="") as f:
                f.write(r["text"])
            os.replace(at + ".part", at)

    pages.select("path", "text").foreachPartition(put)


def eval_queries(spark: SparkSession, path: str) -> DataFrame:
    """(query, expect) pairs of a JSON list."""
    return spark.read.schema("query string, expect string").option("multiLine", True).json(path)
