"""Entity resolution: candidate pairs, the review queue and its decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notegraph.functions import names as N
from notegraph.functions import text as T
from notegraph.operators.graph import mention_counts
from notegraph.operators.skew import salted_join
from notegraph.session import written

#: A word is rare in at most DF_FLOOR names or DF_SHARE of them.
DF_FLOOR, DF_SHARE = 3, 0.02
#: Names of one word that a task pairs with others; a longer list is split, which changes no result.
POSTINGS = 500
GRAM = 4
BATCH, PARAGRAPH = 10, 350
#: Classes in which grams are counted, and short keys that are sent to all tasks, at most.
BUCKETS, SENT = 2048, 50_000


def candidate_names(e: DataFrame, pages: DataFrame) -> DataFrame:
    """(key, name): concept-shaped names, the smallest display of a link going before the file name of a page."""
    linked = e.where("target_key <> ''").groupBy(F.col("target_key").alias("key")).agg(F.min("display").alias("name")).withColumn("at", F.lit(0))
    stem = F.regexp_replace(F.substring_index("path", "/", -1), r"\.md$", "")
    paged = pages.where("page_key <> ''").groupBy(F.col("page_key").alias("key")).agg(F.min(F.when(T.shape_ok(stem), stem)).alias("name")).withColumn("at", F.lit(1))
    both = linked.unionByName(paged).where(T.shape_ok("name"))
    return both.groupBy("key").agg(F.min_by("name", "at").alias("name"))


def token_df(names: DataFrame) -> DataFrame:
    """(token, df): in how many names each word is."""
    return names.select("key", F.explode(F.array_distinct(T.tokens("name"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def described(names: DataFrame, floor: int = DF_FLOOR, share: float = DF_SHARE) -> DataFrame:
    """The names (key, name and any other columns), written once, with the parts of their verdicts and `rare`.

    `rare`: the words, not mere numbers, that few names have, the most frequent first. So a pair is judged where
    it is met, and pairs, whose number grows with the square of the names, are neither written nor shuffled.
    """
    names = written(names, "names")
    total = names.agg(F.greatest(F.floor(F.count(F.lit(1)) * share), F.lit(floor)).alias("cap"))
    rare = token_df(names).join(F.broadcast(total), F.col("df") <= F.col("cap")).where(~F.col("token").rlike("^[0-9]+$"))
    rare = rare.select(F.col("token").alias("t"), "df")
    posting = names.select(F.col("key").alias("k"), F.explode(F.array_distinct(T.tokens("name"))).alias("token")).join(rare, F.col("token") == F.col("t"))
    lists = posting.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("df", "token")), asc=False).alias("rare"))
    parts = [v.alias(f"v_{n}") for n, v in N.verdict_parts(F.col("name")).items()]
    empty = F.array().cast("array<struct<df:bigint,token:string>>")
    return written(names.join(lists, F.col("key") == F.col("k"), "left").select(*names.columns, F.coalesce("rare", empty).alias("rare"), *parts), "described")


def _side(names: DataFrame, side: str) -> DataFrame:
    return names.select(*[F.col(c).alias(f"{c}_{side}") for c in names.columns])


def _undecided() -> Column:
    a, b = ({n: F.col(f"v_{n}_{side}") for n in ("norm", "numbers", "words", "capitals", "initials")} for side in "ab")
    return N.verdict(a, b) == "defer"


def _word_pairs(names: DataFrame, without: DataFrame | None = None) -> DataFrame:
    """Both sides of each pair of described names, key_a < key_b, that share a rare word, once: under the first word that they share.

    An inverted index of the rare words joined with itself. Of a word in more than POSTINGS names
    each name is looked up in one part and listed in all.
    """
    each = names.select("*", F.posexplode("rare").alias("at", "r")).withColumn("before", F.slice(F.col("rare.token"), F.lit(1), F.col("at"))).drop("rare", "at")
    parts = F.ceil(F.col("r.df") / POSTINGS).cast("int")
    a = _side(each.drop("r"), "a").columns
    a = each.select(F.col("r.token").alias("token"), F.pmod(F.xxhash64("key"), parts).cast("int").alias("part"), *[F.col(c[:-2]).alias(c) for c in a])
    b = each.select(F.col("r.token").alias("token"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), *[F.col(c).alias(f"{c}_b") for c in each.columns if c != "r"])
    once = (F.size("before_a") == 0) | (F.size("before_b") == 0) | ~F.arrays_overlap("before_a", "before_b")
    if without is not None:
        met = _met(names, without).select("key_a", "key_b", F.get(F.array_intersect("rare_a.token", "rare_b.token"), F.lit(0)).alias("under"))
        left_out = met.where("under is not null").groupBy(F.col("key_a").alias("k"), "under").agg(F.collect_set("key_b").alias("left_out"))
        a = a.join(left_out, (F.col("key_a") == F.col("k")) & (F.col("token") == F.col("under")), "left").drop("k", "under")
        once = once & ~F.coalesce(F.array_contains("left_out", F.col("key_b")), F.lit(False))
    # estimates leave out the explosion: without the hint a side might be broadcast
    return a.hint("merge").join(b, ["token", "part"]).where((F.col("key_a") < F.col("key_b")) & once)


def _met(names: DataFrame, pairs: DataFrame) -> DataFrame:
    """Both sides of those of the pairs (key_a, key_b; each once, in order) whose keys are described names."""
    p = pairs.select(F.least("key_a", "key_b").alias("p"), F.greatest("key_a", "key_b").alias("q")).where("p <> q").distinct()
    return p.join(_side(names, "a"), F.col("p") == F.col("key_a")).join(_side(names, "b"), F.col("q") == F.col("key_b")).drop("p", "q")


def rare_token_pairs(names: DataFrame, floor: int = DF_FLOOR, share: float = DF_SHARE) -> DataFrame:
    """(key_a, key_b): names that share a word, not a mere number, which few names have."""
    return _word_pairs(described(names, floor, share)).select("key_a", "key_b")


def _grams(key: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(key) - n + 1, F.lit(1))), lambda i: F.substring(key, i, F.lit(n)))


def containment_pairs(names: DataFrame, n: int = GRAM) -> DataFrame:
    """(key_a, key_b): keys of which one is part of the other.

    A key can be part of another only if any n-gram of it is, so the key is looked up by one alone, of
    those that fall among the fewest (grams are counted in BUCKETS classes, so that they need no shuffle for that);
    keys shorter than n are looked up among all grams of their own length.
    """
    keys, bucket = names.select("key"), lambda g: F.pmod(F.xxhash64(g), F.lit(BUCKETS)).cast("int")
    posting = keys.where(F.length("key") > n).select("key", F.explode(F.array_distinct(_grams(F.col("key"), n))).alias("gram"))
    counted = posting.groupBy(bucket(F.col("gram")).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    dense = names.sparkSession.range(BUCKETS).join(counted, F.col("id") == F.col("b"), "left")
    load = dense.agg(F.array_sort(F.collect_list(F.struct("id", F.coalesce("n", F.lit(0)).alias("n"))))["n"].alias("load"))
    of = keys.where(F.length("key") >= n).crossJoin(F.broadcast(load))
    least = F.array_min(F.transform(_grams(F.col("key"), n), lambda g: F.struct(F.element_at("load", bucket(g) + 1).alias("n"), g.alias("gram"))))
    found = of.select(F.col("key").alias("small"), least["gram"].alias("gram")).hint("merge").join(posting, "gram")
    short = written(keys.where((F.length("key") < n) & (F.length("key") > 0)).select(F.col("key").alias("small")), "short")
    few = F.broadcast(short) if short.count() <= SENT else short.hint("merge")
    grams = F.array_distinct(F.concat(*[_grams(F.col("key"), size) for size in range(1, n)]))
    under = keys.select("key", F.explode(grams).alias("gram")).join(few, F.col("gram") == F.col("small"))
    pairs = found.select("key", "small").unionByName(under.select("key", "small")).where((F.col("key") != F.col("small")) & F.col("key").contains(F.col("small")))
    return pairs.select(F.least("key", "small").alias("key_a"), F.greatest("key", "small").alias("key_b")).distinct()


def structural_pairs(names: DataFrame, without: DataFrame | None = None) -> DataFrame:
    """(key_a, key_b, name_a, name_b; of other columns of the names too): pairs that share structure and that the rules can't decide, each once.

    names: (key, name), or what `described` gave. The pairs `without` (key_a, key_b) are left out.
    """
    d = names if "rare" in names.columns else described(names)
    inner = _met(d, containment_pairs(d)).where(~F.arrays_overlap("rare_a.token", "rare_b.token"))
    if without is not None:
        w = without.select(F.least("key_a", "key_b").alias("wa"), F.greatest("key_a", "key_b").alias("wb"))
        inner = inner.join(w, (F.col("key_a") == F.col("wa")) & (F.col("key_b") == F.col("wb")), "left_anti")
    shown = [f"{c}_{side}" for c in d.columns if c != "rare" and not c.startswith("v_") for side in "ab"]
    return _word_pairs(d, without).where(_undecided()).select(*shown).unionByName(inner.where(_undecided()).select(*shown))


def structural_among(described: DataFrame, pairs: DataFrame) -> DataFrame:
    """(key_a, key_b): those of some pairs that `structural_pairs` gives."""
    inside = F.col("key_a").contains(F.col("key_b")) | F.col("key_b").contains(F.col("key_a"))
    return _met(described, pairs).where((F.arrays_overlap("rare_a.token", "rare_b.token") | inside) & _undecided()).select("key_a", "key_b")


def latest(queue: DataFrame) -> DataFrame:
    """One row per pair_key of the history: the latest decision, else the latest question; status trimmed and in lower case."""
    at = lambda c: F.expr(f"try_cast({c} as timestamp)")
    cols = [c for c in queue.columns if c not in ("pair_key", "status")]
    status = F.lower(T.strip_space("status")).alias("status")
    last = F.max(F.struct(at("decided_at").alias("d"), at("asked_at").alias("q"), status, *[F.col(c) for c in cols]))
    return queue.where("pair_key is not null").groupBy("pair_key").agg(last.alias("r")).select("pair_key", "r.status", *[f"r.{c}" for c in cols])


def next_batch(queue: DataFrame, limit: int = BATCH) -> DataFrame:
    """The open pairs of most weight (then by source and key): what is to be asked next."""
    return latest(queue).where("status = 'open'").orderBy(F.desc_nulls_last("weight"), F.asc_nulls_last("source"), "pair_key").limit(limit).select("pair_key", "key_a", "key_b", "weight", "source")


def status_totals(queue: DataFrame) -> DataFrame:
    """(status, n) over the pairs."""
    return latest(queue).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def plan_queue(candidates: DataFrame, queue: DataFrame, aliases: DataFrame, mentions: DataFrame) -> DataFrame:
    """(pair_key, action): insert, reopen or skip for each candidate pair (key_a, key_b).

    Decided and open pairs are left alone, an unclear one is opened again once it has more mentions
    than when it was asked, and a pair of which a key is an alias is skipped.
    """
    c = candidates.select(N.pair_key(F.col("key_a"), F.col("key_b")).alias("pair_key"), "key_a", "key_b").distinct()
    known = latest(queue).select(F.col("pair_key").alias("known"), "status", "mentions_at_ask")
    aliased = aliases.select(F.col("alias_key").alias("aliased")).distinct()
    hit = c.join(aliased, (F.col("key_a") == F.col("aliased")), "left_semi").unionByName(c.join(aliased, F.col("key_b") == F.col("aliased"), "left_semi")).select(F.col("pair_key").alias("hit")).distinct()
    n = mentions.select(F.col("pair_key").alias("counted"), "mentions")
    j = c.join(known, F.col("pair_key") == F.col("known"), "left").join(hit, F.col("pair_key") == F.col("hit"), "left").join(n, F.col("pair_key") == F.col("counted"), "left")
    more = (F.col("status") == "unclear") & (F.coalesce("mentions", F.lit(0)) > F.coalesce("mentions_at_ask", F.lit(0)))
    return j.select("pair_key", F.when(F.col("hit").isNotNull(), "skip").when(F.col("known").isNull(), "insert").when(more, "reopen").otherwise("skip").alias("action"))


def queued_pairs(queue: DataFrame) -> DataFrame:
    """(key_a, key_b) that the queue may know, by its keys or by its pair_key, whatever bar parts that."""
    own = queue.where("key_a is not null and key_b is not null and key_a <> key_b").select("key_a", "key_b")
    words = F.split("pair_key", r"\|")
    cut = lambda i: F.struct(F.array_join(F.slice(words, F.lit(1), i), "|").alias("key_a"), F.array_join(F.slice(words, i + 1, F.size(words)), "|").alias("key_b"))
    named = queue.where(F.col("pair_key").contains("|")).select("pair_key").distinct()
    named = named.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(words) - 1), cut)).alias("p")).select("p.*")
    both = own.unionByName(named)
    return both.select(F.least("key_a", "key_b").alias("key_a"), F.greatest("key_a", "key_b").alias("key_b")).distinct()


def with_mentions(names: DataFrame, aliases: DataFrame, links: DataFrame) -> DataFrame:
    """The names with `aliased`, whether the key is an alias, and `n`, how often it is linked."""
    taken = aliases.where("alias_key is not null").select(F.col("alias_key").alias("t")).distinct()
    counts = links.where("target_key is not null").groupBy(F.col("target_key").alias("c")).agg(F.count(F.lit(1)).alias("n"))
    both = names.join(taken, F.col("key") == F.col("t"), "left").join(counts, F.col("key") == F.col("c"), "left")
    return both.select(*names.columns, F.col("t").isNotNull().alias("aliased"), F.coalesce("n", F.lit(0)).alias("n"))


def intake(names: DataFrame, queue: DataFrame, aliases: DataFrame, links: DataFrame) -> DataFrame:
    """(pair_key, action): plan_queue over the pairs that the names' structure gives and those of the queue, each once.

    Pairs that the queue can't know, which are most, are decided where they are met.
    """
    d = described(with_mentions(names, aliases, links))
    own = queue.where("key_a is not null and key_b is not null and key_a <> key_b").select("key_a", "key_b")
    queued = written(queued_pairs(queue), "queued")
    both = structural_among(d, queued).unionByName(own)
    pairs = both.select(F.least("key_a", "key_b").alias("key_a"), F.greatest("key_a", "key_b").alias("key_b")).distinct()
    keyed = pairs.select(N.pair_key(F.col("key_a"), F.col("key_b")).alias("pair_key"), "key_a", "key_b")
    new = structural_pairs(d, queued).select(
        N.pair_key(F.col("key_a"), F.col("key_b")).alias("pair_key"), F.when(F.col("aliased_a") | F.col("aliased_b"), "skip").otherwise("insert").alias("action")
    )
    return new.unionByName(plan_queue(pairs, queue, aliases, mention_counts(keyed, links)))


def judged_aliases(queue: DataFrame, pages: DataFrame, links: DataFrame) -> DataFrame:
    """(alias_key, canonical_key) for pairs decided to be the same: the side with a page is canonical, else that with more mentions.

    Equal mentions make the greater key the alias. Pairs with a null key or equal keys are left out.
    """
    same = latest(queue).where("status = 'same' and key_a is not null and key_b is not null and key_a <> key_b").select("pair_key", F.least("key_a", "key_b").alias("a"), F.greatest("key_a", "key_b").alias("b"))
    has = pages.where("page_key is not null").select(F.col("page_key").alias("p")).distinct()
    counts = links.where("target_key is not null").groupBy(F.col("target_key").alias("t")).agg(F.count(F.lit(1)).alias("n"))
    for side in ("a", "b"):
        same = same.join(has.withColumnRenamed("p", f"p{side}"), F.col(side) == F.col(f"p{side}"), "left")
        same = same.join(counts.select(F.col("t").alias(f"t{side}"), F.col("n").alias(f"n{side}")), F.col(side) == F.col(f"t{side}"), "left")
    pa, pb = F.col("pa").isNotNull(), F.col("pb").isNotNull()
    na, nb = F.coalesce("na", F.lit(0)), F.coalesce("nb", F.lit(0))
    a_rules = F.when(pa & ~pb, True).when(pb & ~pa, False).otherwise(na >= nb)
    return same.select(F.when(a_rules, F.col("b")).otherwise(F.col("a")).alias("alias_key"), F.when(a_rules, F.col("a")).otherwise(F.col("b")).alias("canonical_key"))


def revise(aliases: DataFrame, queue: DataFrame, key_a: str, key_b: str, answer: str) -> tuple[DataFrame, DataFrame]:
    """(aliases, queue) after a person's answer on a pair: aliases either way go, `same` writes b -> a anew."""
    either = ((F.col("alias_key") == key_a) & (F.col("canonical_key") == key_b)) | ((F.col("alias_key") == key_b) & (F.col("canonical_key") == key_a))
    kept = aliases.where(~F.coalesce(either, F.lit(False)))
    if answer == "same":
        kept = kept.where(F.col("alias_key") != key_b)
        row = aliases.sparkSession.createDataFrame([(key_b, key_a, "user", None)], "alias_key string, canonical_key string, kind string, added string")
        kept = kept.unionByName(row.withColumn("added", F.date_format(F.current_date(), "yyyy-MM-dd")))
    pair = "|".join(sorted((key_a, key_b)))
    return kept, queue.withColumn("status", F.when(F.col("pair_key") == pair, answer).otherwise(F.col("status")))


#: Names that are pointed out when a page is made, at most, and names of most mentions under a word that are tried first.
NEAR, FIRST = 3, 8


def _marks(x: Column, mine: str, theirs: str) -> Column:
    """What two names must share to be the same: a key, or initials on one side that the other's words have."""
    marks = [F.concat(F.lit("key "), T.normalize(x)), F.concat(F.lit(mine), N.loose_acronym(x)), F.concat(F.lit(theirs), N.loose_initials(x))]
    return F.array_distinct(F.array_compact(F.array(*marks)))


def pages_created(created: DataFrame, unresolved: DataFrame, aliases: DataFrame, most: int = NEAR) -> DataFrame:
    """(key, target_key, display, n, verdict): what the making of pages (key, name) means for unresolved names.

    `same` names become aliases of the page; up to `most` undecided ones a page that stand for it
    as initials, or it for them, or share a word are pointed out as `defer`, those of most mentions first (then
    by key). Names that are aliases already and the page's own key are left out, as are null names. Names meet
    in an index of what they have in common, whose hot entries are split over tasks. The FIRST names of
    most mentions, under a word and of a page, are tried first; pages for which an untried one might still be among the `most` are looked
    up again under all names of their words, so the result is the same. With `most` 0 words are not looked up.
    """
    taken = aliases.where("alias_key is not null").select(F.col("alias_key").alias("taken")).distinct()
    open_names = written(unresolved.where("display is not null").join(taken, F.col("target_key") == F.col("taken"), "left_anti").select("target_key", "display", "n"), "unresolved")
    new = written(created.where("key is not null and name is not null").select("key", "name").distinct(), "created")
    theirs = open_names.select("target_key", F.explode(_marks(F.col("display"), "short ", "long ")).alias("handle"))
    mine = new.select("key", "name", F.explode(_marks(F.col("name"), "long ", "short ")).alias("h"))
    met = salted_join(theirs, mine, "handle", "h", salt_by="target_key").select("key", "name", "target_key")

    def judged(pairs: DataFrame) -> DataFrame:
        each = pairs.where("key <> target_key").select("key", "name", "target_key").distinct()
        both = each.join(open_names.withColumnRenamed("target_key", "t"), F.col("target_key") == F.col("t")).drop("t")
        return both.withColumn("verdict", N.resolve_pair(F.col("name"), F.col("display"))).where("verdict <> 'different'").select("key", "target_key", "display", "n", "verdict").distinct()

    if not most:
        return judged(met).where("verdict = 'same'")
    order = F.struct((-F.col("n")).alias("n"), F.col("target_key").alias("t"))
    theirs = open_names.select("target_key", "n", F.explode(F.array_distinct(T.tokens("display"))).alias("word"))
    place = F.row_number().over(Window.partitionBy("word").orderBy(F.desc("n"), "target_key"))
    tried = written(theirs.withColumn("at", place).where(F.col("at") <= FIRST + 1).select("word", "target_key", "at", order.alias("order")), "tried")
    mine = written(new.select("key", "name", F.explode(F.array_distinct(T.tokens("name"))).alias("w")), "words")
    first = salted_join(mine, tried.where(F.col("at") <= FIRST), "w", "word", salt_by="key").where("key <> target_key").select("key", "name", "target_key", "order")
    first = first.withColumn("at", F.dense_rank().over(Window.partitionBy("key").orderBy("order"))).where(F.col("at") <= FIRST + 1)
    first = written(first, "first")
    ranked = written(judged(met.unionByName(first.where(F.col("at") <= FIRST).select("key", "name", "target_key"))), "met")
    at = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("n"), "target_key"))
    near = written(ranked.where("verdict = 'defer'").withColumn("at", at).where(F.col("at") <= most), "near")
    cut = tried.where(F.col("at") == FIRST + 1).select(F.col("word").alias("cut"), "order")
    left = salted_join(mine.select("key", "w").distinct(), cut, "w", "cut", salt_by="key").select("key", "order").unionByName(first.where(F.col("at") == FIRST + 1).select("key", "order"))
    untried = left.groupBy("key").agg(F.min("order").alias("untried"))
    last = near.where(F.col("at") == most).select(F.col("key").alias("k"), order.alias("last"))
    again = untried.join(last, F.col("key") == F.col("k"), "left").where("last is null or untried < last").select(F.col("key").alias("again"))
    again = written(again, "again")
    words = mine.join(again, F.col("key") == F.col("again"), "left_semi")
    wide = salted_join(theirs.select("target_key", "word"), words, "word", "w", salt_by="target_key").select("key", "name", "target_key")
    rest = judged(wide).unionByName(ranked.join(again, F.col("key") == F.col("again"), "left_semi")).where("verdict = 'defer'").distinct()
    rest = rest.withColumn("at", at).where(F.col("at") <= most).drop("at")
    settled = near.drop("at").join(again, F.col("key") == F.col("again"), "left_anti")
    return ranked.where("verdict = 'same'").unionByName(settled).unionByName(rest)


def created_aliases(found: DataFrame) -> DataFrame:
    """(alias_key, canonical_key, kind): the aliases that `pages_created` decided; a name that is the same as several pages goes to the smallest key."""
    same = found.where("verdict = 'same'").groupBy(F.col("target_key").alias("alias_key")).agg(F.min("key").alias("canonical_key"))
    return same.withColumn("kind", F.lit("acronym"))


def evidence(pairs: DataFrame, e: DataFrame, chunks: DataFrame) -> DataFrame:
    """(key, content): for each key, the shortest passage of a citing page that holds its display; at most 350 characters."""
    keys = pairs.select(F.col("key_a").alias("key"), F.col("display_a").alias("shown")).unionByName(pairs.select(F.col("key_b").alias("key"), F.col("display_b").alias("shown"))).where("key is not null and shown is not null").groupBy("key").agg(F.min("shown").alias("shown"))
    citing = e.join(keys, F.col("target_key") == F.col("key")).select("key", "shown", F.col("source").alias("citing"))
    body = chunks.where(~F.coalesce("is_summary", F.lit(False)) & F.col("content").isNotNull()).select("path", "seq", "content").distinct()
    hits = citing.join(body, F.col("citing") == F.col("path")).where(F.lower("content").contains(F.lower("shown")))
    best = hits.groupBy("key").agg(F.min(F.struct(F.length("content").alias("n"), "path", "seq", "content")).alias("b"))
    return best.select("key", F.substring(T.squeeze("b.content"), 1, PARAGRAPH).alias("content"))
