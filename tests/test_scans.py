"""Lists of many queries: what leaves a task stays near what is asked for, however many chunks are hit."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from notegraph.operators import resolve as R
from notegraph.operators import search as S
from notegraph.plans.pages import stream_repeats


def chunked(spark, texts):
    rows = [(f"p{i:04d}", i % 3, f"h{i:04d}", t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "path string, seq int, stripped_hash string, text string")


def ranked(df):
    return sorted(map(tuple, df.select("query_id", "rank", "path", "seq", "score").collect()))


def test_scan_gives_the_lists_of_the_index(spark, monkeypatch):
    rng = random.Random(4)
    words = [f"w{int(rng.paretovariate(0.7)) % 40}" for _ in range(4000)]
    texts = [" ".join(rng.choices(words, k=rng.randrange(0, 12))) for _ in range(600)] + ["w1 w2", "Notes-TR w1", None, ""] * 20
    queries = [(f"q{i}", " ".join(rng.choices(words, k=3))) for i in range(30)] + [("two", "notes-tr w1-w2"), ("none", "zzz"), ("void", 'a"b'), ("null", None), ("bare", "++")]
    chunks, asked = chunked(spark, texts).repartition(5), spark.createDataFrame(queries, "query_id string, text string")
    want = ranked(S.top(S.bm25(S.build_index(chunks), asked), 7))
    assert ranked(S.top(S.bm25_scan(chunks, asked, 7), 7)) == want and len(want) > 200
    monkeypatch.setattr(S, "SENT", 4)
    monkeypatch.setattr(S, "SCORED", 16)
    assert ranked(S.top(S.bm25_scan(chunks, asked, 7), 7)) == want
    assert S.bm25_scan(chunks.limit(0), asked).count() == 0 == S.bm25_scan(chunks, asked.limit(0)).count()


def test_few_rows_leave_a_task(spark):
    chunks = chunked(spark, [("same word" if i % 3 == 0 else "") + " more" * (i % 500) for i in range(3000)]).coalesce(1)
    asked = spark.createDataFrame([(i, "same word") for i in range(20)], "query_id int, text string")
    assert 20 * 10 <= S.bm25_scan(chunks, asked, 10).count() <= 20 * 300


def test_copies_of_one_passage_are_not_all_joined(spark):
    chunks = spark.createDataFrame([(f"p{i:04d}", 0, "stock") for i in range(900)] + [("q", 0, "own")], "path string, seq int, stripped_hash string")
    vectors = spark.createDataFrame([("stock", [1.0, 0.1]), ("own", [1.0, 0.0]), ("unused", [1.0, 0.0])], "stripped_hash string, vec array<float>")
    asked = spark.createDataFrame([("a", [1.0, 0.0])], "query_id string, vec array<float>")
    got = S.dense(chunks, vectors, asked, 2, 5).collect()
    assert sorted((r.path, r.score) for r in got) == [*((f"p{i:04d}", 0.995037) for i in range(5)), ("q", 1.0)]


def test_best_keeps_ties_and_rounds():
    best = S.Best(1, 2)
    assert best.add(np.array([[0.5, 0.1, 0.5, 0.4]]))[1].tolist() == [0, 2]
    q, at, score = best.add(np.array([[0.4, 0.5000000001, -0.7]]))
    assert (q.tolist(), at.tolist(), score.tolist()) == ([0], [1], [0.5])


def test_a_task_gives_on_no_more_than_the_best(spark):
    texts = [("same word" if i % 3 == 0 else "") + " more" * (500 - i // 6) for i in range(3000)]
    chunks = chunked(spark, texts).coalesce(1)
    asked = spark.createDataFrame([(i, "same word") for i in range(20)], "query_id int, text string")
    found = S.bm25_scan(chunks, asked, 10)
    assert found.count() == 20 * 10 and sorted(found.where("query_id = 0").select("path").toPandas()["path"]) == [f"p{i:04d}" for i in range(2970, 3000, 3)]


def test_texts_of_single_rows_are_not_shuffled(spark, monkeypatch):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    rows = [(f"p{i}", i % 2, "h", f"text {i}", False, f"s{i}") for i in range(9)] + [(None, 1, "a", "x", True, None), (None, 1, "b", None, None, "s"), ("p3", 1, "h", "text 4", None, "s"), ("p3", None, None, None, None, None)]
    chunks = spark.createDataFrame(rows, "path string, seq int, heading string, content string, is_summary boolean, stripped_hash string")
    whole = chunks.groupBy("path", "seq").agg(F.max(F.struct("heading", "content", "is_summary", "stripped_hash")).alias("c")).select("path", "seq", "c.*")
    got = S.once(chunks)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, whole.collect())) and got.count() == 11
    assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(S, "ODD", 0)
    assert sorted(map(repr, S.once(chunks).collect())) == sorted(map(repr, whole.collect()))
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_held_rows_are_those_of_a_full_sort():
    rng = np.random.default_rng(3)
    scores, paths = np.round(rng.random((4, 3000)), 2), [None if i % 97 == 0 else f"p{i % 50:02d}" for i in range(3000)]
    for ordered in (True, False):
        held = S.Held(S.Best(4, 5, 0.0), ["path", "seq"], ordered)
        held.most = 40
        for lo in range(0, 3000, 100):
            held.add(scores[:, lo : lo + 100], [pa.array(paths[lo : lo + 100]), pa.array(range(lo, lo + 100))])
        got = [(r["q"], r["path"], r["seq"], r["score"]) for b in held.end() for r in b.to_pylist()]
        for q in range(4):
            full = sorted(range(3000), key=lambda i: (-scores[q, i], paths[i] or "", i))
            want = full[:5] if ordered else [i for i in full if scores[q, i] >= scores[q, full[4]]]
            assert sorted(r[2] for r in got if r[0] == q) == sorted(want)


def test_pages_created_tries_few_names_under_a_word(spark, monkeypatch):
    rng = random.Random(9)
    stock = ["jet", "break", "of", "drift", "GRB", "note 2", "note 3", "lamp"]
    new = [(f"k{i % 40}", " ".join(rng.sample(stock, rng.randrange(1, 4)))) for i in range(60)] + [("gammarayburst", "gamma ray burst")]
    names = [(f"u{i:03d}", " ".join(rng.sample(stock, rng.randrange(1, 4))), rng.randrange(1, 6)) for i in range(150)] + [("k1", "jet of", 9)]
    created, unresolved = spark.createDataFrame(new, "key string, name string"), spark.createDataFrame(names, "target_key string, display string, n bigint")
    aliases = spark.createDataFrame([], "alias_key string, canonical_key string")
    kept, write = {}, R.written

    def spy(df, label):
        kept[label] = write(df, label)
        return kept[label]

    monkeypatch.setattr(R, "written", spy)
    got = {}
    for first in (1, 2, 8, 1000):
        monkeypatch.setattr(R, "FIRST", first)
        got[first] = sorted(map(tuple, R.pages_created(created, unresolved, aliases).collect()))
        got[first, "met"] = kept["met"].count()
        got[first, "again"] = kept["again"].count()
    assert got[1] == got[2] == got[8] == got[1000] and {r[4] for r in got[1]} == {"same", "defer"}
    assert got[1, "met"] < got[8, "met"] < got[1000, "met"] and got[1, "again"] > got[1000, "again"] == 0
    same = sorted(map(tuple, R.pages_created(created, unresolved, aliases, 0).collect()))
    assert same == [r for r in got[1] if r[4] == "same"]


def test_streamed_files_need_no_order(spark, tmp_path):
    at = str(tmp_path / "events.parquet")
    for day in range(20, 0, -1):
        times = [(day * 100 + i, user, kind, f"2024-01-{day:02d} 23:59:{s:02d}") for i, (user, kind, s) in enumerate([(1, "a", 1), (1, "a", 9), (1, "b", 9), (None, "a", 9), (None, "a", 10), (-2, None, 5), (-2, None, 6)])]
        rows = spark.createDataFrame([*times, (day * 100 + 50, 1, "a", f"2024-01-{day + 1:02d} 00:01:05")], "event_id bigint, user_id bigint, event_type string, ts string")
        rows.withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(at)
    got = sorted(map(tuple, stream_repeats(spark, str(tmp_path)).collect()))
    assert got == sorted((day * 100 + i, n) for day in range(1, 21) for i, n in ((1, 1), (4, 1), (6, 1), (50, 1)))
