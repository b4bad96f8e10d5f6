"""The review queue as a table: what comes in, what is asked, and what the answers change."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notegraph.functions import names as N
from notegraph.functions import text as T
from notegraph.operators.analysis import Answer, ask, repair_json
from notegraph.operators.graph import mention_counts
from notegraph.operators.resolve import latest, plan_queue, queued_pairs, structural_among, structural_pairs
from notegraph.session import written

COLUMNS = ("pair_key", "key_a", "key_b", "status", "source", "weight", "mentions_at_ask")
#: Neighbours of a name, and the least cosine of their letter groups for which neighbours are looked for.
NEAREST, ALIKE = 3, 0.6
#: Names that a task compares with as many others, and meetings that it judges at once.
LISTED, AT_ONCE = 32_768, 1 << 17
#: Bits to which the letter groups of a name are spread, in words of 64, and groups of a name up to which many pairs are counted at once.
WORDS, WIDE = 4, 64


def _once(x: np.ndarray) -> np.ndarray:
    """The different numbers in order."""
    x = np.sort(x)
    return x[np.diff(x, prepend=-1) > 0]


def _groups(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The different groups of three letters of names in lower case, between blanks: the names' places and numbers of the groups, the rarest first."""
    padded = [f" {x} " if x else "  \0" for x in names]
    size = np.array([len(x) for x in padded])
    ends, rows = np.cumsum(size), np.repeat(np.arange(len(padded)), size)
    text = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    starts = np.ones(len(text), bool)
    starts[ends - 1] = starts[ends - 2] = False
    at = np.flatnonzero(starts)
    codes, number = np.unique(text[at] << 42 | text[at + 1] << 21 | text[at + 2], return_inverse=True)
    row, number = np.divmod(_once(rows[at] * len(codes) + number), len(codes))
    rank = np.empty(len(codes), np.int64)
    rank[np.argsort(np.bincount(number), kind="stable")] = np.arange(len(codes))
    row, number = np.divmod(np.sort(row * len(codes) + rank[number]), len(codes))
    return row, number


class Block:
    """Names that meet in one task, in order of their numbers of letter groups, and the k nearest of each so far."""

    def __init__(self, names: list[str], k: int, least: float):
        row, group = _groups(names)
        n = np.bincount(row)
        self.order = np.argsort(n, kind="stable")
        place = np.empty(len(n), np.int64)
        place[self.order] = np.arange(len(n))
        both = np.sort(place[row] * (group.max() + 1) + group)
        self.row, self.group = np.divmod(both, group.max() + 1)
        self.n, self.k, self.least, self.t = n[self.order], k, least, max(least - 1e-6, 1e-6)
        # groups are numbered by frequency, so the most frequent ones have a bit of their own
        self.bits = np.zeros((WORDS, len(n)), np.uint64)
        np.bitwise_or.at(self.bits, (self.group // 64 % WORDS, self.row), np.uint64(1) << (self.group % 64).astype(np.uint64))
        self.spare = (self.n - np.bitwise_count(self.bits).sum(0, dtype=np.int64)).astype(np.float32)
        self.root = np.sqrt(self.t * self.n).astype(np.float32)
        self.begin = np.cumsum(self.n) - self.n
        self.at = np.arange(len(both)) - self.begin[self.row]
        low = self.at < WIDE
        self.padded = np.full((min(WIDE, self.n.max()), len(n)), -1, np.int32)
        self.padded[self.at[low], self.row[low]] = self.group[low]
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0
        self.best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))

    def listed(self, share: float, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Names under the rarest of their groups, of which one must be shared, by group: the names, how many of their groups are left from there on, and where each group's names begin and how many they are."""
        kept = of[self.row] & (self.at <= (self.n - np.ceil(share * self.n))[self.row])
        o = np.flatnonzero(kept)[np.argsort(self.group[kept], kind="stable")]
        many = np.bincount(self.group[o], minlength=self.group.max() + 1)
        return self.row[o], (self.n[self.row[o]] - self.at[o]).astype(np.float32), np.cumsum(many) - many, many

    def meet(self, smaller: np.ndarray, larger: np.ndarray) -> None:
        """Compares the names `smaller` with those `larger` (both masks) that come later and may be near."""
        a, rest_a, from_a, many_a = self.listed(self.t, smaller)
        b, rest_b, from_b, many_b = self.listed(self.t * self.t, larger)
        # of groups with few meetings many at once
        few = many_a * many_b <= AT_ONCE // 32
        group = np.repeat(np.arange(len(many_a)), many_a)
        mine = np.flatnonzero(few[group] & (many_b[group] > 0))
        met = many_b[group[mine]]
        ends = np.cumsum(met)
        cuts = np.searchsorted(ends, np.arange(AT_ONCE, ends[-1] if len(ends) else 0, AT_ONCE))
        for part in np.split(np.arange(len(mine)), cuts):
            n = met[part]
            at = np.arange(n.sum()) + np.repeat(from_b[group[mine[part]]] - np.cumsum(n) + n, n)
            x = np.repeat(mine[part], n)
            later = a[x] < b[at]
            x, at = x[later], at[later]
            self.judge(a[x], rest_a[x], b[at], rest_b[at])
        for g in np.flatnonzero(~few):
            y, rest_y = b[from_b[g] : from_b[g] + many_b[g]], rest_b[from_b[g] : from_b[g] + many_b[g]]
            step = max(1, AT_ONCE // many_b[g])
            for i in range(from_a[g], from_a[g] + many_a[g], step):
                x = a[i : min(i + step, from_a[g] + many_a[g])]
                # names come in order of their sizes, and those that are too large can't be near
                lo, hi = np.searchsorted(y, x[0], "right"), np.searchsorted(self.n[y], self.n[x[-1]] / self.t**2 + 1e-6, "right")
                for j in range(lo, hi, AT_ONCE):
                    part = slice(j, min(j + AT_ONCE, hi))
                    self.judge(x[:, None], rest_a[i : i + len(x), None], y[part], rest_y[part])
        self.settle()

    def judge(self, x: np.ndarray, rest_x: np.ndarray, y: np.ndarray, rest_y: np.ndarray) -> None:
        """Puts by those of the pairs that may be near by the groups that are left and by the bits that both have."""
        need = self.root[x] * self.root[y] - np.float32(1e-3)
        ok = np.minimum(rest_x, rest_y) >= need
        ok &= x < y
        need -= np.minimum(self.spare[x], self.spare[y])
        shared = np.zeros(need.shape, np.uint16)
        for word in self.bits:
            shared += np.bitwise_count(word[x] & word[y])
        ok &= shared >= need
        at = np.nonzero(ok)
        self.waiting.append((x[at[0]].ravel(), y[at[-1]]))
        self.held += len(at[0])
        if self.held > 8 * AT_ONCE:
            self.settle()

    def settle(self) -> None:
        """Counts what the waiting pairs share and keeps the k nearest of each name, of equal ones those that came first."""
        if not self.waiting:
            return
        a, b = np.divmod(_once(np.concatenate([x * len(self.n) + y for x, y in self.waiting])), len(self.n))
        self.waiting, self.held = [], 0
        shared = np.zeros(len(a), np.int64)
        for i in range(0, len(a), AT_ONCE // 8):
            part = slice(i, i + AT_ONCE // 8)
            x, y = self.padded[: self.n[a[part]].max(), a[part]], self.padded[: self.n[b[part]].max(), b[part]]
            for group in x:
                shared[part] += ((y == group) & (group >= 0)).sum(0, dtype=np.uint8)
        for i in np.flatnonzero(np.maximum(self.n[a], self.n[b]) > WIDE):
            x, y = (self.group[self.begin[r] : self.begin[r] + self.n[r]] for r in (a[i], b[i]))
            shared[i] = len(np.intersect1d(x, y, assume_unique=True))
        cosine = np.floor(shared / np.sqrt(self.n[a] * self.n[b]) * 1e6 + 0.5) / 1e6
        near = cosine >= self.least
        a, b, cosine = a[near], b[near], cosine[near]
        key, other = np.concatenate([self.best[0], a, b]), np.concatenate([self.best[1], b, a])
        cosine = np.concatenate([self.best[2], cosine, cosine])
        _, once = np.unique(key * len(self.n) + other, return_index=True)
        key, other, cosine = key[once], other[once], cosine[once]
        o = np.lexsort((self.order[other], -cosine, key))
        key, other, cosine = key[o], other[o], cosine[o]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        kept = np.arange(len(key)) - np.repeat(first, np.diff(first, append=len(key))) < self.k
        self.best = (key[kept], other[kept], cosine[kept])


def mutual_nearest(names: DataFrame, k: int = NEAREST, least: float = ALIKE) -> DataFrame:
    """(key_a, key_b, cosine): pairs each of which is among the k nearest of the other, by cosine of their letter groups.

    Names are dealt to blocks of about LISTED; a task compares two blocks, or one with itself, and gives on the k nearest
    of each name there. Only pairs of at least `least` are looked for: of two names of m <= n groups that reach it at least
    least * m are shared, so they share one of the m - ceil(least * m) + 1 rarest of the smaller and of the
    n - ceil(least^2 * n) + 1 rarest of the larger name, and are met under one of these. Equal cosines are ordered by key.
    """
    lowered = written(names.where("key is not null and name is not null").select("key", F.lower("name").alias("name")), "lowered")
    blocks = max(1, -(-lowered.count() // LISTED))
    mine = lowered.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int"))
    cells = mine.withColumn("with", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    cells = cells.select(F.least("block", "with").alias("lo"), F.greatest("block", "with").alias("hi"), "block", "key", "name")

    def compared(cell: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        lo, hi = (x.as_py() for x in cell)
        t = t.sort_by("key")
        found = Block(t["name"].to_pylist(), k, least)
        first = (t["block"].to_numpy() == lo)[found.order]
        found.meet(first, first if lo == hi else ~first)
        if lo != hi:
            found.meet(~first, first)
        key, other, cosine = found.best
        return pa.table({"key": t["key"].take(found.order[key]), "other": t["key"].take(found.order[other]), "cosine": cosine})

    # more partitions than cells: few cells fall on one another
    spread = cells.repartition(blocks * (blocks + 1), "lo", "hi").groupBy("lo", "hi")
    both = spread.applyInArrow(compared, "key string, other string, cosine double")
    best = written(both.withColumn("at", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("cosine"), "other"))).where(F.col("at") <= k), "near")
    back = best.select(F.col("key").alias("k2"), F.col("other").alias("o2"))
    mutual = best.where("key < other").join(back, (F.col("key") == F.col("o2")) & (F.col("other") == F.col("k2")), "left_semi")
    return mutual.select(F.col("key").alias("key_a"), F.col("other").alias("key_b"), "cosine")


def proximity_pairs(names: DataFrame, seeds: DataFrame) -> DataFrame:
    """(key_a, key_b): mutual nearest names of which one is a seed (key): a name that leads to no page."""
    s = seeds.select(F.col("key").alias("seed")).distinct()
    pairs = mutual_nearest(names).select("key_a", "key_b")
    return pairs.join(s, F.col("key_a") == F.col("seed"), "left_semi").unionByName(pairs.join(s, F.col("key_b") == F.col("seed"), "left_semi")).distinct()


def candidate_pairs(structure: DataFrame, proximity: DataFrame) -> DataFrame:
    """(pair_key, key_a, key_b, source): both kinds of candidates, each pair once; what structure finds goes before proximity."""
    rows = structure.select("key_a", "key_b", F.lit("structure").alias("source")).unionByName(proximity.select("key_a", "key_b", F.lit("proximity").alias("source")))
    keyed = rows.select(N.pair_key(F.col("key_a"), F.col("key_b")).alias("pair_key"), F.least("key_a", "key_b").alias("key_a"), F.greatest("key_a", "key_b").alias("key_b"), "source")
    return keyed.groupBy("pair_key", "key_a", "key_b").agg(F.max("source").alias("source"))


def queue_after(queue: DataFrame, candidates: DataFrame, aliases: DataFrame, mentions: DataFrame) -> DataFrame:
    """The queue, one row a pair, after candidates came in: new pairs open with their mentions as weight, unclear ones with more mentions open again."""
    now = latest(queue).select(*COLUMNS)
    plan = written(plan_queue(candidates, queue, aliases, mentions), "plan")
    again = plan.where("action = 'reopen'").select(F.col("pair_key").alias("again"))
    kept = now.join(again, F.col("pair_key") == F.col("again"), "left").withColumn("status", F.when(F.col("again").isNotNull(), "open").otherwise(F.col("status"))).drop("again")
    new = candidates.join(plan.where("action = 'insert'").select(F.col("pair_key").alias("p")), F.col("pair_key") == F.col("p"), "left_semi")
    n = mentions.select(F.col("pair_key").alias("m"), "mentions")
    weight = F.coalesce("mentions", F.lit(0)).cast("int")
    added = new.join(n, F.col("pair_key") == F.col("m"), "left").select("pair_key", "key_a", "key_b", F.lit("open").alias("status"), "source", weight.alias("weight"), weight.alias("mentions_at_ask"))
    return kept.unionByName(added)


def all_candidates(names: DataFrame, proximity: DataFrame) -> DataFrame:
    """candidate_pairs of all structural pairs of described names and of proximity; those of structure alone are given on where they are met."""
    alone = structural_pairs(names, proximity).select(N.pair_key(F.col("key_a"), F.col("key_b")).alias("pair_key"), "key_a", "key_b", F.lit("structure").alias("source"))
    return alone.unionByName(candidate_pairs(structural_among(names, proximity), proximity))


def queue_after_all(queue: DataFrame, names: DataFrame, proximity: DataFrame, aliases: DataFrame, links: DataFrame) -> DataFrame:
    """queue_after with all_candidates. names: described, with their mentions (`with_mentions`). Pairs that the queue can't know are decided where they are met."""
    apart = written(proximity.select("key_a", "key_b").unionByName(queued_pairs(queue)), "apart")
    few = written(candidate_pairs(structural_among(names, apart), proximity), "candidates")
    keyed = few.select("pair_key", "key_a", "key_b").unionByName(queue.select("pair_key", "key_a", "key_b"))
    weight = (F.col("n_a") + F.col("n_b")).cast("int")
    new = structural_pairs(names, apart).where(~(F.col("aliased_a") | F.col("aliased_b"))).select(
        N.pair_key(F.col("key_a"), F.col("key_b")).alias("pair_key"), "key_a", "key_b", F.lit("open").alias("status"), F.lit("structure").alias("source"), weight.alias("weight"), weight.alias("mentions_at_ask")
    )
    return new.unionByName(queue_after(queue, few, aliases, mention_counts(keyed, links)))


def decided(queue: DataFrame) -> DataFrame:
    """(pair_key, status, weight, rank): the pairs that are decided, by status and then weight, the heaviest first."""
    rank = F.row_number().over(Window.partitionBy("status").orderBy(F.desc_nulls_last("weight"), "pair_key"))
    return latest(queue).where(F.col("status").isin("same", "different", "unclear")).select("pair_key", "status", "weight").withColumn("rank", rank)


def read_answers(raw: Column) -> Column:
    """array<struct<n,answer>>: a model's list of answers, whether it stands alone or in an object under `answers`."""
    bare = F.regexp_extract(raw, r"(?s)(\[.*\])", 1)
    alone = F.from_json(bare, "array<struct<n:int,answer:string>>")
    return F.coalesce(F.from_json(repair_json(raw)["json"], "answers array<struct<n:int,answer:string>>")["answers"], alone)


def confirmed(pairs: DataFrame, judge: Callable[[str], Answer]) -> DataFrame:
    """(pair_key, answer): each pair is asked once; one called the same is asked again with its names swapped, and unless that says the same too it is unclear.

    pairs: (pair_key, display_a, display_b). Answers that can't be read, or are none of same,
    different and unclear, count as unclear.
    """

    def asked(p: DataFrame, a: str, b: str) -> DataFrame:
        said = ask(p.select("pair_key", F.concat_ws("\n", a, b).alias("prompt")), judge, "prompt", "pair_key")
        word = F.lower(T.strip_space(F.get_json_object(repair_json(F.col("answer"))["json"], "$.answer")))
        return said.select("pair_key", F.when(word.isin("same", "different"), word).otherwise("unclear").alias("answer"))

    first = asked(pairs, "display_a", "display_b")
    same = first.where("answer = 'same'").select(F.col("pair_key").alias("p"))
    again = asked(pairs.join(same, F.col("pair_key") == F.col("p"), "left_semi"), "display_b", "display_a")
    sure = again.select("pair_key", F.when(F.col("answer") == "same", "same").otherwise("unclear").alias("answer"))
    return first.where("answer <> 'same'").unionByName(sure)


def answered(queue: DataFrame, answers: DataFrame) -> DataFrame:
    """The queue, one row a pair, with the answers (pair_key, answer) as status; answers on pairs that aren't open are ignored."""
    a = answers.select(F.col("pair_key").alias("p"), "answer")
    both = latest(queue).select(*COLUMNS).join(a, F.col("pair_key") == F.col("p"), "left")
    return both.withColumn("status", F.when(F.col("status") == "open", F.coalesce("answer", "status")).otherwise(F.col("status"))).drop("p", "answer")
