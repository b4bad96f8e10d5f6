"""Rules that decide whether two names are the same, as Catalyst columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from notegraph.functions.text import normalize, strip_space, tokens


def initials(x: Column) -> Column:
    """First letters of the words, in lower case."""
    parts = F.filter(F.split(F.lower(x), "[^a-z0-9]+"), lambda t: t != "")
    return F.array_join(F.transform(parts, lambda t: F.substring(t, 1, 1)), "")


def _singular(x: Column) -> Column:
    return F.regexp_replace(x, "s+$", "")


def loose_initials(x: Column) -> Column:
    """The initials of a name, a final s aside."""
    return _singular(initials(x))


def _capitals(x: Column) -> Column:
    """A name of 3 to 6 capitals, a plural s aside, in lower case; null for other names."""
    s = strip_space(x)
    s = F.when(s.rlike("^[A-Z]{2,6}s$"), F.substring(s, 1, F.length(s) - 1)).otherwise(s)
    return F.when(s.rlike("^[A-Z]{3,6}$"), F.lower(s))


def acronym_match(short: Column, long: Column) -> Column:
    """Whether `short` is 3 to 6 capitals (a plural s aside) that are the initials of `long`."""
    return F.coalesce(_capitals(short) == initials(long), F.lit(False))


def _numbered(t: Column) -> Column:
    return t.rlike("[0-9]")


def verdict_parts(x: Column) -> dict[str, Column]:
    """What verdicts on a name are made from, so that it is worked out once for a name and not for each of its pairs."""
    t = tokens(x)
    return {"norm": normalize(x), "numbers": F.filter(t, _numbered), "words": F.filter(t, lambda w: ~_numbered(w)), "capitals": _capitals(x), "initials": initials(x)}


def verdict(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """same, different or defer, from the parts of two names; the rule on numbers goes before the one on acronyms. Null if a name is null.

    A number tells two names apart that have other numbers on equal words, or a number on one side only.
    """
    in_a, in_b = F.size(a["numbers"]) > 0, F.size(b["numbers"]) > 0
    split = (
        F.when(in_a & in_b, (a["words"] == b["words"]) & (a["numbers"] != b["numbers"]))
        .when(in_a, F.size(F.array_except(b["words"], a["words"])) == 0)
        .when(in_b, F.size(F.array_except(a["words"], b["words"])) == 0)
        .otherwise(F.lit(False))
    )
    acronym = F.coalesce(a["capitals"] == b["initials"], F.lit(False)) | F.coalesce(b["capitals"] == a["initials"], F.lit(False))
    known = a["norm"].isNotNull() & b["norm"].isNotNull()
    return F.when(known, F.when(a["norm"] == b["norm"], F.lit("same")).when(split, F.lit("different")).when(acronym, F.lit("same")).otherwise(F.lit("defer")))


def resolve_pair(a: Column, b: Column) -> Column:
    """same, different or defer for two names, as `verdict` says. Null if a side is null."""
    return verdict(verdict_parts(a), verdict_parts(b))


def pair_key(a: Column, b: Column) -> Column:
    """The two keys in order, joined by a bar; null if one is null."""
    return F.concat(F.least(a, b), F.lit("|"), F.greatest(a, b))


def loose_acronym(x: Column) -> Column:
    """What a name stands for if it is read as initials: two to six letters in any case, a plural s aside; null for other names."""
    s = F.lower(strip_space(x))
    return F.when(s.rlike("^[a-z]{2,6}s?$"), _singular(s))


def looks_like_acronym(short: Column, long: Column) -> Column:
    """Whether `short` read as initials stands for the words of `long`, a final s aside."""
    return F.coalesce(loose_acronym(short) == loose_initials(long), F.lit(False))


def overlap(a: Column, b: Column) -> Column:
    """Shared words as a part of the smaller set; 0 if one is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(F.lit(0.0))
