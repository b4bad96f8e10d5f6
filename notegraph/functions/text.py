"""Scalar text functions as Catalyst columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SUMMARY_CAP = 300
SUMMARY_DISPLAY = 160
NO_TEXT = "(no text yet)"
LINK = r"\[\[([^\]]+)\]\]"
PIPED = r"\[\[[^\]|]+\|([^\]]+)\]\]"
#: White space as text editors mean it, the same in every regex engine.
WS = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip_space(x: Column | str) -> Column:
    """White space removed at both ends (Spark's trim removes spaces only)."""
    return F.regexp_replace(_c(x), rf"^{WS}+|{WS}+$", "")


def squeeze(x: Column | str) -> Column:
    """White space folded to single spaces and removed at both ends."""
    return F.trim(F.regexp_replace(_c(x), rf"{WS}+", " "))


def fold_plural(x: Column | str) -> Column:
    """A final `ies` becomes `y` in words of more than four letters; else a final `s` goes, but not of `ss` or up to three letters."""
    x = _c(x)
    n = F.length(x)
    return (
        F.when(x.endswith("ies") & (n > 4), F.concat(F.substring(x, 1, n - 3), F.lit("y")))
        .when(x.endswith("s") & ~x.endswith("ss") & (n > 3), F.substring(x, 1, n - 1))
        .otherwise(x)
    )


def normalize(x: Column | str) -> Column:
    """The key of a name: lower case, ASCII letters and digits only, plural folded. Null stays null."""
    return fold_plural(F.regexp_replace(F.lower(_c(x)), "[^a-z0-9]", ""))


def tokens(x: Column | str) -> Column:
    """The words of a name: lower case, split at all but ASCII letters and digits, plurals folded."""
    parts = F.filter(F.split(F.lower(_c(x)), "[^a-z0-9]+"), lambda t: t != "")
    return F.transform(parts, fold_plural)


def strip_links(x: Column | str) -> Column:
    """`[[target|shown]]` becomes `shown` and `[[name]]` becomes `name`, one pass each, over line ends too."""
    return F.regexp_replace(F.regexp_replace(_c(x), PIPED, "$1"), LINK, "$1")


def content_hash(x: Column | str) -> Column:
    """sha1 of the text without link marks and outer white space: placing links doesn't move it."""
    return hash_plain(strip_links(x))


def hash_plain(x: Column | str) -> Column:
    """content_hash of a text that has no link marks any more."""
    return F.sha1(F.encode(strip_space(x), "utf-8"))


def first_sentence(x: Column | str, cap: int = SUMMARY_CAP) -> Column:
    """The first sentence of a body without heading lines, at most `cap` characters; never empty, null stays null."""
    return first_sentence_plain(strip_links(x), cap)


def first_sentence_plain(x: Column | str, cap: int = SUMMARY_CAP) -> Column:
    """first_sentence of a text that has no link marks any more."""
    body = squeeze(F.regexp_replace(_c(x), r"(?m)^#{1,6}[^\n]*$", ""))
    # each step uses the one before once, so that nothing is worked out twice
    first = F.trim(F.substring(F.regexp_replace(body, r"(?s)^(.*?[.!?]) .*$", "$1"), 1, cap))
    return F.regexp_replace(first, "^$", NO_TEXT)


def short(x: Column | str, cap: int = SUMMARY_DISPLAY) -> Column:
    """White space folded; more than `cap` characters end in an ellipsis."""
    s = squeeze(x)
    return F.when(F.length(s) > cap, F.concat(F.substring(s, 1, cap - 1), F.lit("…"))).otherwise(s)


#: What a concept looks like, labels that only number something, and counted nouns.
SHAPE = r"^[A-Za-z][A-Za-z0-9\-' ]{2,49}$"
ORDINAL_LABEL = r"(?i)^(Tier|Cycle|Phase|Stage|Level|Step|Figure|Table|Section)\s*[\dIVX]+$"
COUNTED_NOUN = r"(?i)^(one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve)\s+\w+s?$"
#: Fixed value: characters that make an unquoted frontmatter value ambiguous.
NEEDS_QUOTES = r": |:$|^[-?\s>|&*!%@`\[\]{}#,'\"]|#\s|\s$|^$"


def shape_ok(x: Column | str) -> Column:
    """Whether a name looks like a concept: 3 to 50 plain characters, at most six words, no mere label or count."""
    c = strip_space(x)
    n_words = F.size(F.filter(F.split(c, r"\s+"), lambda w: w != ""))
    return F.coalesce(c.rlike(SHAPE) & (n_words <= 6) & ~c.rlike(ORDINAL_LABEL) & ~c.rlike(COUNTED_NOUN), F.lit(False))


def gate_summary(x: Column | str) -> Column:
    """Null if a summary passes, else the reason: empty, too long, or more than one sentence."""
    s = strip_space(F.coalesce(_c(x), F.lit("")))
    return (
        F.when(s == "", F.lit("empty"))
        .when(F.length(s) > SUMMARY_CAP, F.concat(F.length(s).cast("string"), F.lit(f" chars, over {SUMMARY_CAP}")))
        .when(F.regexp_count(s, F.lit(r"[.!?](?:\s|$)")) > 1, F.lit("more than one sentence"))
    )


def yaml_value(x: Column | str) -> Column:
    """A frontmatter value, quoted where it would be ambiguous."""
    x = _c(x)
    quoted = F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(x, r"\\", r"\\\\"), '"', r'\\"'), F.lit('"'))
    return F.when(x.rlike(NEEDS_QUOTES), quoted).otherwise(x)


def yaml_read(x: Column | str) -> Column:
    """What yaml_value wrote: quotes removed and escapes undone, so that rewriting a page is stable."""
    x = _c(x)
    inner = F.regexp_replace(F.regexp_extract(x, r'(?s)^"(.*)"$', 1), r'\\(["\\])', "$1")
    return F.when(x.rlike(r'(?s)^".*"$') & (F.length(x) >= 2), inner).otherwise(F.regexp_replace(x, "^['\"]+|['\"]+$", ""))


def concept_present(body: Column | str, concept: Column | str) -> Column:
    """Whether a concept stands word for word in a body without link marks; white space and case are free."""
    words = F.filter(F.split(strip_space(concept), r"\s+"), lambda w: w != "")
    quoted = F.array_join(F.transform(words, lambda w: F.concat(F.lit("\\Q"), w, F.lit("\\E"))), "\\s+")
    pattern = F.concat(F.lit("(?iuU)(?<![\\[\\w])"), quoted, F.lit("(?![\\w\\]])"))
    return F.coalesce((F.size(words) > 0) & F.regexp_like(strip_links(body), pattern), F.lit(False))


#: Fixed value: the order in which known frontmatter fields are written.
FIELD_ORDER = ("type", "tags", "summary", "summary_provisional", "origin", "created", "updated")


def render_page(fields: dict[str, Column], body: Column | str) -> Column:
    """Frontmatter and body as a text: known fields in their order, then the others as given; null ones are left out."""
    names = [f for f in FIELD_ORDER if f in fields] + [f for f in fields if f not in FIELD_ORDER]
    lines = [F.when(fields[n].isNotNull(), F.concat(F.lit(f"{n}: "), yaml_value(fields[n]))) for n in names]
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---\n\n"), F.regexp_replace(_c(body), rf"^{WS}+", ""))


def write_path(x: Column | str, folder: str = "notes") -> Column:
    """Where a page of that name is written: names without a folder go to the folder of pages."""
    x = _c(x)
    return F.when(x.contains("/"), x).otherwise(F.concat(F.lit(folder + "/"), x))


def opaque(x: Column | str) -> Column:
    """Whether a name says little to a reader: three or more figures in a row."""
    return F.coalesce(_c(x).rlike("[0-9]{3,}"), F.lit(False))


def query_words(x: Column | str) -> Column:
    """array<string>: the different keys of the words of a query, those of more than two characters."""
    words = F.transform(F.split(F.coalesce(_c(x), F.lit("")), rf"{WS}+"), normalize)
    return F.array_distinct(F.filter(words, lambda w: F.length(w) > 2))


def leading_sentence(x: Column | str) -> Column:
    """The first sentence of a passage as it stands, link marks included; `(no text)` if there is none, null stays null."""
    flat = squeeze(F.regexp_replace(_c(x), r"(?m)^#{1,6}[^\n]*$", ""))
    return F.regexp_replace(F.regexp_replace(flat, r"(?s)^(.*?[.!?]) .*$", "$1"), "^$", "(no text)")


def count_tokens(x: Column | str) -> Column:
    """A token estimate: characters by four, halves to the even number."""
    return F.bround(F.length(_c(x)) / 4).cast("int")


def fold_accents(x: Column | str) -> Column:
    """Lower case without the accents of Latin letters."""
    return F.translate(F.lower(_c(x)), ACCENTED, PLAIN)


def _latin() -> tuple[str, str]:
    import unicodedata

    pairs = []
    for code in range(0xC0, 0x250):
        c = chr(code).lower()
        base = unicodedata.normalize("NFD", c)
        if len(c) == 1 and len(base) > 1 and base[0].isascii():
            pairs.append((c, base[0]))
    pairs = sorted(set(pairs))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _latin()
