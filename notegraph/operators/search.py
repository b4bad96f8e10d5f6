"""Hybrid retrieval for a table of queries: BM25 over an inverted index, cosine, rank fusion and the fold to pages.

queries: (query_id, text[, vec]). Every list is ranked per query; no query's work passes one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notegraph.functions import text as T
from notegraph.functions.names import overlap
from notegraph.session import written

K1, B = 1.2, 0.75
TOP, RRF_K, PER_PAGE, LIMIT = 50, 60, 2, 5
#: What stands in for the weight of a term found in half the chunks or more.
LEAST_IDF = 1e-6
#: Query vectors sent to all tasks at once (3 kB each at 384 dimensions); more are asked in several passes.
SENT = 4000
#: Keys of repeated chunks sent to all tasks, at most (60 bytes each); more are joined by a shuffle.
ODD = 200_000
#: Chunks or vectors that a task scores at once.
SCORED = 1024


def once(chunks: DataFrame) -> DataFrame:
    """Chunks, each (path, seq) once. Those with one row, which are most, pass without a shuffle of their texts if there are few others."""
    columns = ["path", "seq", "heading", "content", "is_summary", "stripped_hash"]
    odd = chunks.groupBy(F.col("path").alias("p"), F.col("seq").alias("s")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    odd = written(odd, "odd")
    odd = F.broadcast(odd) if odd.count() <= ODD else odd
    here = F.col("path").eqNullSafe(F.col("p")) & F.col("seq").eqNullSafe(F.col("s"))
    several = chunks.join(odd, here, "left_semi").groupBy("path", "seq").agg(F.max(F.struct(*columns[2:])).alias("c")).select("path", "seq", "c.*")
    return chunks.join(odd, here, "left_anti").select(columns).unionByName(several)


def indexed_text(chunks: DataFrame) -> DataFrame:
    """Chunks, each (path, seq) once, with `text`: heading and content without link marks."""
    return once(chunks).withColumn("text", T.strip_links(F.concat_ws("\n", F.nullif("heading", F.lit("")), F.nullif("content", F.lit("")))))


def terms(x: Column) -> Column:
    """array<string>: words of letters and digits, lower case, without accents."""
    return F.filter(F.split(T.fold_accents(x), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def phrases(query: Column) -> Column:
    """array<array<string>>: the phrases of a query, one for each word between white space, of several terms if it has marks inside.

    A word holding a quotation mark makes the whole query void, as it would end its own quotation.
    """
    words = F.filter(F.split(query, rf"{T.WS}+"), lambda w: w != "")
    void = F.exists(words, lambda w: w.contains('"') & (F.replace(w, F.lit('"'), F.lit("")) != ""))
    found = F.array_distinct(F.filter(F.transform(words, terms), lambda p: F.size(p) > 0))
    return F.when(~void, found)


@dataclass
class Index:
    """postings: (term, path, seq, places, dl), in order of terms, so that a few terms are read from few files. size: one row (N, avgdl)."""

    postings: DataFrame
    size: DataFrame


def build_index(chunks: DataFrame) -> Index:
    """The inverted index of (path, seq, text), written once."""
    words = chunks.select("path", "seq", terms(F.coalesce("text", F.lit(""))).alias("words")).withColumn("dl", F.size("words"))
    each = words.select("path", "seq", "dl", F.posexplode("words").alias("at", "term"))
    postings = each.groupBy("term", "path", "seq", "dl").agg(F.array_sort(F.collect_list("at")).alias("places"))
    ordered = postings.repartitionByRange("term", "path").sortWithinPartitions("term")
    size = words.agg(F.count(F.lit(1)).alias("N"), F.avg("dl").alias("avgdl"))
    return Index(written(ordered.select("term", "path", "seq", "places", "dl"), "postings"), written(size, "size"))


def document_frequency(index: Index) -> DataFrame:
    """(term, df, tf): chunks that hold each term, and its occurrences."""
    return index.postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum(F.size("places")).alias("tf"))


def bm25(index: Index, queries: DataFrame) -> DataFrame:
    """(query_id, path, seq, score) of the chunks that hold a phrase of the query; higher is better.

    Only postings of the queries' terms are read. A phrase counts once for each place from which its
    terms stand side by side. Queries without phrases, void or null ones give no rows.
    """
    asked = queries.select("query_id", F.posexplode(phrases(F.col("text"))).alias("phrase", "words"))
    asked = asked.select("query_id", "phrase", F.size("words").alias("n"), F.posexplode("words").alias("k", "wanted"))
    met = index.postings.join(asked, F.col("term") == F.col("wanted")).select("query_id", "phrase", "n", "k", "path", "seq", "dl", "places")
    key = ["query_id", "phrase", "path", "seq", "dl"]
    single = met.where("n = 1").select(*key, F.size("places").alias("f"))
    starts = F.collect_list(F.transform("places", lambda x: x - F.col("k")))
    several = met.where("n > 1").groupBy(*key, "n").agg(starts.alias("starts")).where(F.size("starts") == F.col("n"))
    common = F.size(F.aggregate("starts", F.col("starts")[0], lambda a, x: F.array_intersect(a, x)))
    hits = written(single.unionByName(several.select(*key, common.alias("f")).where("f > 0")), "hits")
    counts = hits.groupBy(F.col("query_id").alias("q"), F.col("phrase").alias("p")).agg(F.count(F.lit(1)).alias("df"))
    both = hits.join(counts, (F.col("query_id") == F.col("q")) & (F.col("phrase") == F.col("p"))).crossJoin(F.broadcast(index.size))
    idf = F.log((F.col("N") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.when(idf <= 0, LEAST_IDF).otherwise(idf) * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return both.groupBy("query_id", "path", "seq").agg(F.round(F.sum(part), 6).alias("score"))


def top(scored: DataFrame, limit: int = TOP) -> DataFrame:
    """(query_id, path, seq, score, rank) of the best of each query; equal scores are ordered by path and seq; rank begins at 0."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "path", "seq"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= limit).withColumn("rank", F.col("rank") - 1)


class Best:
    """The `limit` best scores of each query that a task has met, so that it gives on only what may be among the best of all.

    Scores, rounded to six places, of `least` or below are none.
    """

    def __init__(self, queries: int, limit: int, least: float = -np.inf):
        self.least, self.scores, self.bound = least, np.full((queries, limit), -np.inf), np.full(queries, -np.inf)

    def add(self, block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, column, score) of a block of scores (queries x columns) not below the best so far; equal ones stay."""
        q, at = np.nonzero((block >= (self.bound - 1e-6)[:, None]) & (block > self.least))
        raw = block[q, at]
        score = np.trunc(raw * 1e6 + np.copysign(0.5, raw)) / 1e6
        rows, mine = np.unique(q, return_inverse=True)
        both = np.full((len(rows), block.shape[1] + self.scores.shape[1]), -np.inf)
        both[mine, at] = score
        both[:, block.shape[1] :] = self.scores[rows]
        self.scores[rows] = np.partition(both, block.shape[1], axis=1)[:, block.shape[1] :]
        self.bound[rows] = self.scores[rows].min(axis=1)
        kept = score >= self.bound[q]
        return q[kept], at[kept], score[kept]


class Held:
    """What `Best` lets through, held in its task until the end: only the best of all that the task met leave it.

    Rows are (q, columns, score); of equal scores all stay, or at most `limit` rows a query, ordered by the columns.
    """

    def __init__(self, best: Best, names: list[str], ordered: bool):
        self.best, self.names, self.ordered = best, names, ordered
        self.limit, self.most, self.rows, self.n = best.scores.shape[1], 2 * best.scores.size + 100_000, [], 0

    def add(self, block: np.ndarray, columns: list[pa.Array]) -> None:
        q, at, score = self.best.add(block)
        if len(q):
            self._put(pa.table([pa.array(q, pa.int32()), *[c.take(pa.array(at)) for c in columns], pa.array(score)], names=["q", *self.names, "score"]))
        if self.n > self.most:
            self._put(self._above(), anew=True)
            if self.ordered and 2 * self.n > self.most:
                self._put(self._first(), anew=True)

    def end(self) -> Iterator[pa.RecordBatch]:
        if self.n:
            self._put(self._above(), anew=True)
            yield from (self._first() if self.ordered else self.rows[0]).to_batches(max_chunksize=16_384)

    def _put(self, t: pa.Table, anew: bool = False) -> None:
        self.rows, self.n = ([t], len(t)) if anew else ([*self.rows, t], self.n + len(t))

    def _above(self) -> pa.Table:
        t = pa.concat_tables(self.rows).combine_chunks()
        return t.filter(pa.array(t.column("score").to_numpy() >= self.best.bound[t.column("q").to_numpy()]))

    def _first(self) -> pa.Table:
        t = self.rows[0]
        keys = [("q", "ascending"), ("score", "descending"), *[(c, "ascending") for c in self.names]]
        t = t.take(pc.sort_indices(t, sort_keys=keys, null_placement="at_start"))
        q = t.column("q").to_numpy()
        return t.filter(pa.array(np.arange(len(q)) - np.searchsorted(q, q) < self.limit)).combine_chunks()


def _named(found: DataFrame, ids: pa.Array, limit: int, place: Column) -> DataFrame:
    """The best of each query by `place`, under its id instead of its number; numbers keep the shuffle small."""
    few = found.withColumn("at", place.over(Window.partitionBy("q").orderBy(F.desc("score"), *[c for c in ("path", "seq") if c in found.columns]))).where(F.col("at") <= limit)
    names = found.sparkSession.createDataFrame(pa.table([pa.array(np.arange(len(ids)), pa.int32()), ids], names=["number", "query_id"]))
    return few.join(F.broadcast(names), F.col("q") == F.col("number")).select("query_id", *[c for c in found.columns if c != "q"])


def _few_tasks(df: DataFrame) -> DataFrame:
    """Two tasks a core at most: each gives on the best of every query."""
    return df.coalesce(2 * df.sparkSession.sparkContext.defaultParallelism)


def _passes(asked: DataFrame) -> list[DataFrame]:
    """The queries in parts of about SENT."""
    n = max(1, -(-asked.count() // SENT))
    return [asked.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == i) if n > 1 else asked for i in range(n)]


def _occurrences(words: pa.Array, vocabulary: pa.Array, alone: np.ndarray, several: list[tuple[int, list[int]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(phrase, row, f), in order of phrases: how often each phrase stands in each row of a column of words.

    alone: the phrase that each word of the vocabulary makes by itself, or -1; several: phrases of more words.
    """
    row = np.repeat(np.arange(len(words)), pc.list_value_length(words).to_numpy(zero_copy_only=False))
    ids = pc.fill_null(pc.index_in(words.flatten(), value_set=vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    one = np.where(ids >= 0, alone[ids], -1)
    keys = [one[one >= 0] * len(words) + row[one >= 0]]
    for phrase, parts in several:
        at = np.nonzero(ids[: len(ids) - len(parts) + 1] == parts[0])[0]
        for i, part in enumerate(parts[1:], 1):
            at = at[(ids[at + i] == part) & (row[at + i] == row[at])]
        keys.append(phrase * len(words) + row[at])
    key, f = np.unique(np.concatenate(keys), return_counts=True)
    return key // max(1, len(words)), key % max(1, len(words)), f


def bm25_scan(chunks: DataFrame, queries: DataFrame, limit: int = TOP) -> DataFrame:
    """(query_id, path, seq, score): what `bm25` gives, of each query at least the `limit` best, without an index.

    For tables of queries that grow with the chunks: every chunk is scored against all queries where it
    lies, so that hits, which grow with the square, are never written. Chunks are read twice, for the phrases'
    frequencies and for the scores.
    """
    spark = chunks.sparkSession
    asked = queries.select("query_id", phrases(F.col("text")).alias("phrases")).where(F.size("phrases") > 0)
    words = _few_tasks(chunks.select("path", "seq", terms(F.coalesce("text", F.lit(""))).alias("words")))

    def search(part: DataFrame) -> DataFrame:
        rows = part.toArrow()  # at most about SENT rows
        number: dict[tuple[str, ...], int] = {}
        asking: list[list[int]] = []
        for q, found in enumerate(rows.column("phrases").to_pylist()):
            for p in map(tuple, found):
                if number.setdefault(p, len(number)) == len(asking):
                    asking.append([])
                asking[number[p]].append(q)
        place = {w: i for i, w in enumerate(dict.fromkeys(w for p in number for w in p))}
        alone = np.array([number.get((w,), -1) for w in place], np.int64)
        several = [(n, [place[w] for w in p]) for p, n in number.items() if len(p) > 1]
        ids = rows.column("query_id").combine_chunks()
        n = len(ids)
        shared = spark.sparkContext.broadcast((list(place), alone, several, [np.array(x) for x in asking]))

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            vocabulary, alone, several, asking = shared.value
            total, length, df = 0, 0, np.zeros(len(asking), np.int64)
            for b in batches:
                phrase, _, _ = _occurrences(b.column(2), pa.array(vocabulary, pa.string()), alone, several)
                df += np.bincount(phrase, minlength=len(df))
                total, length = total + len(b), length + len(b.column(2).flatten())
            yield pa.RecordBatch.from_arrays([pa.array([total]), pa.array([length]), pa.array([df.tobytes()])], names=["total", "length", "df"])

        parts = words.mapInArrow(count, "total bigint, length bigint, df binary").collect() if len(ids) else []
        total, df = sum(r["total"] for r in parts), sum((np.frombuffer(r["df"], np.int64) for r in parts), np.zeros(len(asking), np.int64))
        idf = np.log((total - df + 0.5) / (df + 0.5))
        weight, mean = np.where(idf <= 0, LEAST_IDF, idf), sum(r["length"] for r in parts) / max(1, total)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            vocabulary, alone, several, asking = shared.value
            held = Held(Best(n, limit, 0.0), ["path", "seq"], True)
            for big in batches if n else ():
                for lo in range(0, len(big), SCORED):
                    b = big.slice(lo, SCORED)
                    phrase, row, f = _occurrences(b.column(2), pa.array(vocabulary, pa.string()), alone, several)
                    dl = pc.list_value_length(b.column(2)).to_numpy(zero_copy_only=False)
                    part = weight[phrase] * f * (K1 + 1) / (f + K1 * (1 - B + B * dl[row] / (mean or 1)))
                    scores, (met, starts) = np.zeros((n, len(b))), np.unique(phrase, return_index=True)
                    for p, i, j in zip(met, starts, [*starts[1:], len(phrase)]):
                        scores[asking[p][:, None], row[i:j]] += part[i:j]
                    held.add(scores, [b.column(0), b.column(1)])
            yield from held.end()

        found = words.mapInArrow(run, f"q int, path string, seq {chunks.schema['seq'].dataType.simpleString()}, score double")
        return _named(found, ids, limit, F.row_number())

    return reduce(lambda a, b: a.unionByName(b), [search(part) for part in _passes(asked)])


def usable(vec: Column, dim: int) -> Column:
    """Exactly `dim` numbers, all finite, not all zero."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vec) == dim) & finite & F.exists(vec, lambda x: x != 0), F.lit(False))


def _unit(column: pa.Array, dim: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def dense(chunks: DataFrame, vectors: DataFrame, queries: DataFrame, dim: int = 384, limit: int = TOP) -> DataFrame:
    """(query_id, path, seq, score): cosine of chunks that have a usable vector with the query's, at least the `limit` best of each query.

    All vectors are compared, block by block as matrix products; a task gives on what may be among the
    best. Only the best hashes, and the first chunks of each, are joined. Vectors of another length, with nulls or
    not finite, are skipped; each hash counts once.
    """
    spark = vectors.sparkSession
    here = chunks.where("stripped_hash is not null").select("path", "seq", "stripped_hash")
    used = here.select(F.col("stripped_hash").alias("used")).distinct()
    one = vectors.where(usable(F.col("vec"), dim)).join(used, F.col("stripped_hash") == F.col("used"), "left_semi").groupBy("stripped_hash").agg(F.max("vec").alias("vec"))
    asked = queries.where(usable(F.col("vec"), dim)).select("query_id", "vec")

    def search(part: DataFrame) -> DataFrame:
        rows = part.toArrow()  # at most about SENT rows
        ids = rows.column("query_id").combine_chunks()
        n = len(ids)
        shared = spark.sparkContext.broadcast(_unit(rows.column("vec").combine_chunks(), dim) if len(rows) else np.zeros((0, dim)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = Held(Best(n, limit), ["hash"], False)
            for big in batches if n else ():
                for lo in range(0, len(big), SCORED):
                    b = big.slice(lo, SCORED)
                    held.add(shared.value @ _unit(b.column(1), dim).T, [b.column(0)])
            yield from held.end()

        return _named(_few_tasks(one.select("stripped_hash", "vec")).mapInArrow(run, "q int, hash string, score double"), ids, limit, F.rank())

    found = reduce(lambda a, b: a.unionByName(b), [search(part) for part in _passes(asked)])
    first = F.row_number().over(Window.partitionBy("stripped_hash").orderBy("path", "seq"))
    here = here.withColumn("at", first).where(F.col("at") <= limit)
    return found.join(here, F.col("hash") == F.col("stripped_hash")).select("query_id", "path", "seq", "score")


def fuse(*rankings: DataFrame) -> DataFrame:
    """(query_id, path, seq, score, first): reciprocal rank fusion of (query_id, path, seq, rank) lists.

    `first` orders equal scores: the smallest list and rank at which the chunk appears.
    """
    parts = [r.select("query_id", "path", "seq", (1.0 / (RRF_K + F.col("rank") + 1)).alias("part"), (F.lit(i) * 1_000_000 + F.col("rank")).alias("at")) for i, r in enumerate(rankings)]
    return reduce(lambda a, b: a.unionByName(b), parts).groupBy("query_id", "path", "seq").agg(F.round(F.sum("part"), 9).alias("score"), F.min("at").alias("first"))


def fold(fused: DataFrame, limit: int = LIMIT, per_page: int = PER_PAGE) -> DataFrame:
    """(query_id, rank, path, seqs): the pages of each query's best chunks, each with its first chunks in fused order."""
    at = fused.withColumn("at", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "first")))
    kept = at.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "path").orderBy("at"))).where(F.col("n") <= per_page)
    pages = kept.groupBy("query_id", "path").agg(F.min("at").alias("best"), F.array_sort(F.collect_list(F.struct("at", "seq"))).alias("chunks"))
    ranked = pages.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("best"))).where(F.col("rank") <= limit)
    return ranked.select("query_id", "rank", "path", F.transform("chunks", lambda c: c["seq"]).alias("seqs"))


def quiet_paths(pages: DataFrame, folders: tuple[str, ...] = ("sources", "conversations")) -> DataFrame:
    """(path) of pages kept out of the first rung: transcripts and those under quiet folders."""
    under = reduce(lambda a, b: a | b, [F.col("path").startswith(f + "/") for f in folders], F.lit(False))
    return pages.where(under | F.coalesce(F.lower(F.trim("type")) == "transcript", F.lit(False))).select(F.col("path").alias("quiet"))


def without_quiet(ranked: DataFrame, pages: DataFrame) -> DataFrame:
    """A ranked list without chunks of quiet pages, ranked anew: they have used up places already."""
    kept = ranked.join(quiet_paths(pages), F.col("path") == F.col("quiet"), "left_anti")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")) - 1)


def search(text: DataFrame, index: Index | None, pages: DataFrame, queries: DataFrame, vectors: DataFrame | None = None, depth: str = "summary", limit: int = LIMIT, chunks: DataFrame | None = None) -> DataFrame:
    """(query_id, rank, path, summary, provisional, from_conversation, literal, seqs[, chunks]): the pages found for each query.

    Both lists are cut to their best chunks first. At depth `summary` quiet pages are taken out
    afterwards, so they use up places; at depth `body` they stay, and `chunks` has heading and
    content of what was found. Without vectors the literal list stands alone. Pages without a row
    count as provisional. Scores are not shown. Without an index all chunks are read: for many queries.
    If `text` has no heading and content, they are taken from `chunks`, as stored, for what was found only.
    """
    if depth not in ("summary", "body"):
        raise ValueError("depth is one of summary, body")
    lists = [written(top(bm25(index, queries) if index else bm25_scan(text, queries)), "literal")]
    if vectors is not None:
        lists.append(written(top(dense(text, vectors, queries)), "dense"))
    literal = lists[0].select(F.col("query_id").alias("lq"), F.col("path").alias("hit")).distinct()
    if depth == "summary":
        lists = [without_quiet(x, pages) for x in lists]
    found = written(fold(fuse(*lists), limit), "found")
    meta = pages.select(F.col("path").alias("page"), "summary", "summary_provisional", "origin")
    out = found.join(meta, F.col("path") == F.col("page"), "left").join(literal, (F.col("path") == F.col("hit")) & (F.col("query_id") == F.col("lq")), "left")
    shown = out.select(
        "query_id", "rank", "path", T.short("summary").alias("summary"), F.coalesce("summary_provisional", F.lit(True)).alias("provisional"),
        F.coalesce(F.col("origin") == "conversation", F.lit(False)).alias("from_conversation"), F.col("hit").isNotNull().alias("literal"), "seqs",
    )
    if depth == "summary":
        return shown
    each = shown.select(F.col("query_id").alias("q"), F.col("path").alias("p"), F.posexplode("seqs").alias("at", "s"))
    if chunks is not None:
        wanted = found.select(F.col("path").alias("p"), F.explode("seqs").alias("s")).distinct()
        text = once(chunks.join(wanted, (F.col("path") == F.col("p")) & (F.col("seq") == F.col("s")), "left_semi"))
    bodies = each.join(text.select("path", "seq", "heading", "content"), (F.col("p") == F.col("path")) & (F.col("s") == F.col("seq")))
    lists = bodies.groupBy("q", "p").agg(F.array_sort(F.collect_list(F.struct("at", "heading", "content"))).alias("c"))
    chunks = F.transform("c", lambda x: F.struct(x["heading"].alias("heading"), x["content"].alias("content")))
    return shown.join(lists.select("q", "p", chunks.alias("chunks")), (F.col("query_id") == F.col("q")) & (F.col("path") == F.col("p")), "left").drop("q", "p")


def retrieval_metrics(expected: DataFrame, found: dict[str, DataFrame], k: int = LIMIT) -> DataFrame:
    """(config, queries, top1, topk, mrr): how high the expected page of each query stands in each configuration's pages.

    expected: (query_id, page), one a query; found: (query_id, rank, path) by name. A page that is not found counts 0.
    """
    out = None
    for name, pages in found.items():
        hit = pages.select(F.col("query_id").alias("q"), F.col("path").alias("p"), "rank").where(F.col("rank") <= k)
        both = expected.join(hit, (F.col("query_id") == F.col("q")) & (F.col("page") == F.col("p")), "left")
        row = both.agg(
            F.count(F.lit(1)).alias("queries"), F.count_if(F.col("rank") == 1).alias("top1"), F.count_if(F.col("rank").isNotNull()).alias("topk"),
            F.round(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"),
        ).select(F.lit(name).alias("config"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def disagreements(a: DataFrame, b: DataFrame) -> DataFrame:
    """(query_id, page_a, page_b): queries whose first page differs between two configurations; null where there is none."""
    first = lambda x, n: x.where("rank = 1").select(F.col("query_id").alias(f"q{n}"), F.col("path").alias(f"page_{n}"))
    both = first(a, "a").join(first(b, "b"), F.col("qa") == F.col("qb"), "full_outer")
    return both.where(~F.col("page_a").eqNullSafe(F.col("page_b"))).select(F.coalesce("qa", "qb").alias("query_id"), "page_a", "page_b")


def near_repeats(searches: DataFrame, seconds: int = 120, alike: float = 0.6, most: int = 5) -> DataFrame:
    """(search_id, before, stop): earlier searches of the same scope within so many seconds whose words overlap, and whether they are too many.

    searches: (search_id, scope, at, text). The overlap is that of the smaller set of words; searches
    without words repeat nothing. Pairs meet in stretches of that length, own and preceding, so a
    scope of very many searches is spread over time.
    """
    micros = F.unix_micros(F.col("at").cast("timestamp"))
    s = searches.where("scope is not null and at is not null").select("search_id", "scope", micros.alias("t"), T.query_words("text").alias("words")).where(F.size("words") > 0)
    s = s.withColumn("stretch", F.floor(F.col("t") / (seconds * 1_000_000)))
    past = s.select(F.col("scope").alias("s2"), F.col("t").alias("t2"), F.col("words").alias("w2"), F.explode(F.array(F.col("stretch"), F.col("stretch") + 1)).alias("b2"))
    on = (F.col("scope") == F.col("s2")) & (F.col("stretch") == F.col("b2")) & (F.col("t2") < F.col("t")) & (F.col("t2") >= F.col("t") - seconds * 1_000_000)
    near = s.hint("merge").join(past, on).where(overlap(F.col("words"), F.col("w2")) >= alike)
    return near.groupBy("search_id").agg(F.count(F.lit(1)).alias("before")).withColumn("stop", F.col("before") >= most)


def mean_vectors(chunks: DataFrame, vectors: DataFrame, dim: int = 384) -> DataFrame:
    """(path, n, mean): the mean of the usable vectors of each page's chunks.

    Sums are made in Arrow batches, so that a page of very many chunks reaches its last step as a few sums.
    """
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    one = vectors.where((F.size("vec") == dim) & finite).groupBy("stripped_hash").agg(F.max("vec").alias("vec"))
    each = chunks.select("path", "stripped_hash").join(one, "stripped_hash").select("path", "vec")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            paths, at = np.unique(np.array(b.column(0).to_pylist(), object), return_inverse=True)
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)
            order = np.argsort(at, kind="stable")
            starts = np.searchsorted(at[order], np.arange(len(paths)))
            total = np.add.reduceat(x[order], starts, axis=0) if len(paths) else x
            yield pa.RecordBatch.from_arrays([pa.array(paths.tolist(), pa.string()), pa.array(np.bincount(at, minlength=len(paths)), pa.int64()), pa.array([t.tobytes() for t in total], pa.binary())], names=["path", "n", "total"])

    def means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.column(1).to_pylist()
            out = [(sum(np.frombuffer(t) for t in ts) / k).tolist() for ts, k in zip(b.column(2).to_pylist(), n)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.list_(pa.float64()))], names=["path", "n", "mean"])

    part = each.mapInArrow(sums, "path string, n bigint, total binary").groupBy("path").agg(F.sum("n").alias("n"), F.collect_list("total").alias("totals"))
    return part.mapInArrow(means, "path string, n bigint, mean array<double>").select("path", "n", F.transform("mean", lambda x: F.round(x, 6)).alias("mean"))
