"""References to records that do not exist, from signed counts per key and period.

The state is three tables: the references known so far, the pages known so far, and the counts per
field, key and month that follow from them. Every batch of changes is turned into signed deltas,
which are added to the counts. Keys with positive references and zero existence are the current
orphans; months in which a key's count is zero throughout are reported from the counts alone, and
only references of months in which it changes are compared with the instants of its changes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notegraph.operators.skew import salted_join
from notegraph.session import written

#: The instant before all others: where a page with null `created` starts to exist.
ALWAYS = "0001-01-01 00:00:00"
NEVER = "9999-12-31 00:00:00"
TARGET, SOURCE = "target_key", "source"


@dataclass
class State:
    """What is maintained from batch to batch.

    refs: (source, target_key, first_at). pages: (path, name, since, until, current). counts:
    (field_name, name, month, refs, existing, current, changes), where `existing` is the month's
    net change of existence, `current` its part that belongs to pages existing at the end, and
    `changes` the number of instants' deltas. Months are `yyyy-MM`, empty where there is no instant.
    """

    refs: DataFrame
    pages: DataFrame
    counts: DataFrame


def month_of(at: Column) -> Column:
    return F.coalesce(F.date_format(at, "yyyy-MM"), F.lit(""))


def first_references(links: DataFrame) -> DataFrame:
    """Each distinct (source, target_key) with a target, at its earliest `indexed_at`.

    Null and empty targets are no references. A null source is kept. Rows without any
    `indexed_at` get null, which counts as no instant at all (see missing_references).
    """
    return (
        links.where(F.col("target_key").isNotNull() & (F.col("target_key") != ""))
        .groupBy("source", "target_key")
        .agg(F.min("indexed_at").alias("first_at"))
    )


def page_rows(files: DataFrame, removals: DataFrame) -> DataFrame:
    """(path, name, since, until, current): the spans in which pages exist, each once.

    A removal without `removed_at`, or not after `created`, never existed.
    """
    since = F.coalesce("created", F.lit(ALWAYS).cast("timestamp")).alias("since")
    now = files.select("path", F.col("page_key").alias("name"), since, F.lit(None).cast("timestamp").alias("until"), F.lit(1).alias("current"))
    gone = removals.select("path", F.col("page_key").alias("name"), since, F.col("removed_at").alias("until"), F.lit(0).alias("current")).where("since < until")
    return now.unionByName(gone).distinct()


def page_deltas(pages: DataFrame) -> DataFrame:
    """(name, at, delta, current): +1 where a page comes to exist, -1 where it is removed. Pages without a key have none."""
    named = pages.where("name is not null")
    came = named.select("name", F.col("since").alias("at"), F.lit(1).alias("delta"), "current")
    return came.unionByName(named.where("until is not null").select("name", F.col("until").alias("at"), F.lit(-1).alias("delta"), F.lit(0).alias("current")))


_ZERO = {"refs": 0, "existing": 0, "current": 0, "changes": 0}


def _deltas(df: DataFrame, field: str, name: str, month: Column, **counts: Column) -> DataFrame:
    cols = [counts.get(c, F.lit(0)).cast("long").alias(c) for c in _ZERO]
    return df.select(F.lit(field).alias("field_name"), F.col(name).alias("name"), month.alias("month"), *cols)


def reference_counts(refs: DataFrame, sign: int = 1) -> DataFrame:
    """Signed deltas of references, to their target and to their source."""
    month = month_of(F.col("first_at"))
    return _deltas(refs, TARGET, "target_key", month, refs=F.lit(sign)).unionByName(_deltas(refs, SOURCE, "source", month, refs=F.lit(sign)))


def existence_counts(pages: DataFrame, sign: int = 1) -> DataFrame:
    """Signed deltas of existence: page keys by month, and paths that exist at the end."""
    sign_col = F.lit(sign)
    named = _deltas(page_deltas(pages), TARGET, "name", month_of(F.col("at")), existing=F.col("delta") * sign_col, current=F.col("current") * sign_col, changes=sign_col)
    paths = pages.where("current = 1 and path is not null").select("path").distinct()
    return named.unionByName(_deltas(paths, SOURCE, "path", F.lit(""), current=sign_col))


def added(counts: DataFrame) -> DataFrame:
    """Counts summed per field, key and month, combined before the shuffle; rows of nothing but zeros go."""
    sums = counts.groupBy("field_name", "name", "month").agg(*[F.sum(c).alias(c) for c in _ZERO])
    return sums.where(" or ".join(f"{c} <> 0" for c in _ZERO))


def advance(links: DataFrame, files: DataFrame, removals: DataFrame, before: State | None = None, withdrawn: DataFrame | None = None) -> State:
    """The state after a batch of rows of the three tables; rows known already change nothing.

    A pair that is met again earlier than before moves to that instant's month: -1 where it was
    counted and +1 where it belongs. `withdrawn` has rows of `files` that are no longer in it.
    """
    refs, pages = first_references(links), page_rows(files, removals)
    if before is None:
        refs, pages = written(refs, "references"), written(pages, "pages")
        return State(refs, pages, written(added(reference_counts(refs).unionByName(existence_counts(pages))), "counts"))
    refs = before.refs.unionByName(refs).groupBy("source", "target_key").agg(F.min("first_at").alias("first_at"))
    pages = before.pages.unionByName(pages).distinct()
    if withdrawn is not None:
        pages = pages.subtract(page_rows(withdrawn, removals.limit(0)))
    refs, pages = written(refs, "references"), written(pages, "pages")
    new, old = refs.subtract(before.refs), before.refs.subtract(refs)
    came, went = pages.subtract(before.pages), before.pages.subtract(pages)
    # a path may be in several rows: its existence is the difference of the paths, not of the rows
    paths = lambda p: p.where("current = 1 and path is not null").select("path").distinct()
    deltas = [reference_counts(new), reference_counts(old, -1)]
    deltas += [existence_counts(p, s).where(F.col("field_name") == TARGET) for p, s in ((came, 1), (went, -1))]
    deltas += [_deltas(a.subtract(b), SOURCE, "path", F.lit(""), current=F.lit(s)) for a, b, s in ((paths(pages), paths(before.pages), 1), (paths(before.pages), paths(pages), -1))]
    counts = before.counts
    for d in deltas:
        counts = counts.unionByName(d)
    return State(refs, pages, written(added(counts), "counts"))


def _steps(aliases: DataFrame) -> DataFrame:
    """(alias_key, canonical_key): one step; several canonical keys of one alias all count."""
    return aliases.select("alias_key", "canonical_key").where("alias_key is not null and canonical_key is not null and alias_key <> canonical_key").distinct()


def with_aliases(rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """Rows under a `name`, and once more under each alias that leads to it. Hot canonical keys are split."""
    cols = rows.columns
    led = salted_join(_steps(aliases), rows, "canonical_key", "name", salt_by="alias_key")
    return rows.unionByName(led.select(*[F.col("alias_key").alias("name") if c == "name" else F.col(c) for c in cols]))


def balance(state: State, aliases: DataFrame) -> DataFrame:
    """The counts with those of existence under aliases as well."""
    mine = state.counts.where((F.col("field_name") == TARGET) & ((F.col("existing") != 0) | (F.col("current") != 0) | (F.col("changes") != 0)))
    existing = mine.where("name is not null").withColumn("refs", F.lit(0).cast("long"))
    under = salted_join(_steps(aliases), existing, "canonical_key", "name", salt_by="alias_key")
    under = under.select("field_name", F.col("alias_key").alias("name"), "month", *_ZERO)
    return added(state.counts.unionByName(under))


def orphan_keys(state: State, aliases: DataFrame) -> DataFrame:
    """(name, refs): the current orphan report of targets: positive references and zero existence at the end."""
    sums = balance(state, aliases).where(F.col("field_name") == TARGET).groupBy("name").agg(F.sum("refs").alias("refs"), F.sum("current").alias("current"))
    return sums.where("refs > 0 and current <= 0").select("name", "refs")


def orphan_periods(state: State, aliases: DataFrame) -> DataFrame:
    """(field_name, name, month, all): key and months with references of which some or all are at fault.

    All are if the key has no page at the end, or none throughout the month. Months in which its
    existence changes are undecided. A source need only exist at the end; references without an
    instant are at fault only if their target has no page at the end.
    """
    by_name = Window.partitionBy("field_name", "name")
    before = by_name.orderBy("month").rowsBetween(Window.unboundedPreceding, -1)
    c = balance(state, aliases).withColumns({"base": F.coalesce(F.sum("existing").over(before), F.lit(0)), "at_end": F.sum("current").over(by_name)})
    gone = F.col("at_end") <= 0
    timed = (F.col("field_name") == TARGET) & (F.col("month") != "")
    verdict = F.when(gone, True).when(~timed, None).when(F.col("changes") > 0, False).when(F.col("base") <= 0, True)
    return c.where("refs > 0").select("field_name", "name", "month", verdict.alias("all")).where(F.col("all").isNotNull())


def existing_spans(deltas: DataFrame) -> DataFrame:
    """(name, since, until): the longest spans in which a name has a page, by running sums of (name, at, delta).

    Running sums go in two steps, by name and month and then within the month, so that a name of
    very many pages is spread over its months; only the instants at which a count leaves or
    reaches zero are then put in order per name.
    """
    d = deltas.groupBy("name", "at").agg(F.sum("delta").alias("delta")).withColumn("month", F.trunc("at", "month"))
    by_month = Window.partitionBy("name").orderBy("month").rowsBetween(Window.unboundedPreceding, -1)
    base = d.groupBy("name", "month").agg(F.sum("delta").alias("net")).select("name", "month", F.coalesce(F.sum("net").over(by_month), F.lit(0)).alias("base"))
    inside = Window.partitionBy("name", "month").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    counted = d.join(base, ["name", "month"]).select("name", "at", "delta", (F.col("base") + F.sum("delta").over(inside)).alias("n"))
    turns = counted.where(((F.col("n") > 0) & (F.col("n") - F.col("delta") <= 0)) | ((F.col("n") <= 0) & (F.col("n") - F.col("delta") > 0)))
    after = F.lead("at").over(Window.partitionBy("name").orderBy("at"))
    return (
        turns.withColumn("until", F.coalesce(after, F.lit(NEVER).cast("timestamp")))
        .where(F.col("n") > 0)
        .select("name", F.col("at").alias("since"), "until")
    )


def _slot(field: Column, name: Column, month: Column) -> Column:
    """Field, month and key as one string that is never null; a null key differs from all others."""
    return F.concat(field, F.lit("|"), month, F.lit("|"), F.coalesce(F.concat(F.lit("="), name), F.lit("")))


def missing_references(state: State, aliases: DataFrame) -> DataFrame:
    """(field_name, source, target_key, month): one row for each reference and each field at fault.

    Empty tables give an empty result (without `files`, every reference is at fault twice).
    Further columns of the tables are ignored. `month` is that of the earliest `indexed_at`. Keys
    holding a large share of the references are split over several tasks.
    """
    periods = written(orphan_periods(state, aliases), "periods")
    faults = periods.select(_slot(F.col("field_name"), F.col("name"), F.col("month")).alias("slot"), "all")
    month = month_of(F.col("first_at"))
    both = F.array(F.struct(F.lit(TARGET).alias("field_name"), F.col("target_key").alias("name")), F.struct(F.lit(SOURCE).alias("field_name"), F.col("source").alias("name")))
    fields = state.refs.select("source", "target_key", "first_at", F.explode(both).alias("f")).select("source", "target_key", "first_at", "f.field_name", "f.name")
    asked = fields.select("source", "target_key", "first_at", "field_name", _slot(F.col("field_name"), F.col("name"), month).alias("asked"))
    met = written(salted_join(asked, faults, "asked", "slot", salt_by="source").select("field_name", "source", "target_key", "first_at", "all"), "met")
    unsure = met.where("not all")
    names = periods.where("not all").select(F.col("name").alias("turning")).distinct()
    deltas = with_aliases(page_deltas(state.pages).select("name", "at", "delta"), aliases)
    spans = existing_spans(deltas.join(names, F.col("name") == F.col("turning"), "left_semi"))
    inside = (F.col("since") <= F.col("first_at")) & (F.col("first_at") < F.col("until"))
    late = salted_join(unsure, spans, "target_key", "name", "left_anti", inside, salt_by="source")
    out = met.where("all").unionByName(late)
    return out.select("field_name", "source", "target_key", F.date_format("first_at", "yyyy-MM").alias("month"))


def report_by_month(missing: DataFrame) -> DataFrame:
    """Number of references at fault per field and month of their earliest `indexed_at`."""
    return missing.groupBy("field_name", "month").agg(F.count(F.lit(1)).alias("n"))


__all__ = ["State", "advance", "existing_spans", "first_references", "missing_references", "orphan_keys", "orphan_periods", "page_rows", "report_by_month"]
