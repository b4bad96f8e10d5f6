"""Vault folders and streams."""

import os

import pytest

from notegraph.sources import vault
from notegraph.streaming import ingest


def test_scan_and_export(spark, tmp_path):
    for name, data in {"notes/a b.md": b"# A", ".trash/x.md": b"x", "skip/y.md": b"y", "notes/bad.md": b"\xff\xfe", "notes/z.txt": b"z"}.items():
        at = tmp_path / "v" / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(data)
    rows = {r.path: (r.text, r.readable) for r in vault.scan(spark, str(tmp_path / "v"), ("skip/",)).collect()}
    assert rows == {"notes/a b.md": ("# A", True), "notes/bad.md": (None, False)}
    with pytest.raises(vault.VaultUnreachable):
        vault.scan(spark, str(tmp_path / "nowhere"))
    vault.export(vault.scan(spark, str(tmp_path / "v")), str(tmp_path / "out"))
    assert (tmp_path / "out/notes/a b.md").read_text() == "# A" and not os.path.exists(tmp_path / "out/notes/bad.md")


def test_stream_ingest_twice(spark, tmp_path):
    from datetime import datetime

    schema = "path string, text string, mtime timestamp"
    for i, rows in enumerate([[("a.md", "one", datetime(2024, 1, 1)), ("b.md", "see [[a]]", datetime(2024, 1, 1))], [("a.md", "two", datetime(2024, 1, 2))]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        ingest.ingest(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
        now = {r.path: r.summary for r in ingest.latest_pages(spark, str(tmp_path / "out")).collect()}
        assert now == {"a.md": ["one", "two"][i], "b.md": "see a"}


def test_late_versions_and_late_events(spark, tmp_path):
    from datetime import datetime, timedelta

    schema = "path string, text string, mtime timestamp"
    for rows in ([("a.md", "new text.", datetime(2024, 2, 1))], [("a.md", "old text.", datetime(2024, 1, 1)), ("b.md", "b.", None)], [("b.md", "later b.", datetime(2023, 1, 1))]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        ingest.ingest(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert {r.path: r.summary for r in ingest.latest_pages(spark, str(tmp_path / "out")).collect()} == {"a.md": "new text.", "b.md": "later b."}

    events, t = "event_id long, user_id long, event_type string, ts timestamp", datetime(2024, 1, 1)
    at = lambda s: t + timedelta(seconds=s)
    batches = [[(1, 1, "x", at(0)), (2, 1, "x", at(50)), (3, 1, "y", at(60))], [(4, 1, "x", at(500)), (5, 2, "x", at(500))], [(6, 1, "x", at(100)), (7, 1, "x", at(560))], [(8, 1, "x", at(5000))], [(9, 1, "x", at(0))]]
    for rows in batches:
        spark.createDataFrame(rows, events).coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
        source = spark.readStream.schema(events).parquet(str(tmp_path / "events"))
        ingest.repeats(source).writeStream.format("parquet").option("path", str(tmp_path / "repeats")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(60)
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "repeats")).collect()} == {(2, 1), (6, 2), (7, 1)}
