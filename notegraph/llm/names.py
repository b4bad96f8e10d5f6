"""Variant spellings of names typed by people: a pigeonhole segment join over whole names.

Each key is read through its most frequent fitting display and brought to a form: words without
accents, titles and fillers, in any order, with nicknames and kinds of bodies written out. A form
is cut into two segments a word, its beginning and its end, with a letter or two between them. Of
two spellings with one edit (or swap of neighbours) a word, one segment of each word is found in
the other, at the same end but shifted by a letter where the lengths differ. An inverted index
holds each form under the segments of its two rarest words taken together (one segment of either);
every form is looked up by the segments of all pairs of its words, cut for words of a letter less
and more. Words that stand for others (initials, cut words, acronyms) have segments of their own.
A banded edit distance on both words verifies the candidates, then all words are compared.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notegraph.functions.text import normalize
from notegraph.llm.components import components
from notegraph.operators.skew import salted_join
from notegraph.session import written

#: Given names and their common short forms.
SHORT_FORMS = """
abigail: abby, abbie, gail; alexander: alex, sandy, sasha; andrew: andy, drew; anthony: tony, ant; benjamin: ben, benny;
catherine: cathy, cate; charles: charlie, chuck, chas; christopher: chris, kit; daniel: dan, danny; david: dave, davy;
deborah: debbie, deb, debby; dorothy: dot, dottie, dolly; edward: ed, eddie, ned, ted, teddy; elizabeth: liz, lizzie, beth, betty, eliza;
eleanor: ellie, nell; florence: flo, flossie; francis: frank, frankie; frederick: fred, freddy, freddie; gabriel: gabe; geoffrey: geoff; gregory: greg;
guadalupe: lupe, lupita; harold: hal; henry: hank, harry, hal; hildegard: hilde, hilda; ignacio: nacho; isabella: izzy, bella, isa;
jacob: jake; james: jim, jimmy, jamie; jennifer: jen, jenny; jessica: jess, jessie; john: jack, johnny; jonathan: jon, jonny;
joseph: joe, joey; josephine: jo, josie; katherine: kate, kathy, katie, kit, kay; kenneth: ken, kenny; lawrence: larry, laurie; leonard: len, lenny, leo;
louisa: lou, lulu; margaret: maggie, meg, peggy, greta, marge; matthew: matt; michael: mike, mick, mickey; nathaniel: nate, nat; nicholas: nick, nicky;
oliver: ollie, olly; patricia: pat, patty, tricia; penelope: penny, nell; peter: pete; philippa: pippa, pip; quentin: quent; rebecca: becky, becca;
richard: rick, dick, rich, ricky, richie; robert: rob, bob, bobby, robbie; ronald: ron, ronnie; samuel: sam, sammy; stephen: steve; susanna: sue, susie, suzy;
theodore: theo, ted, teddy; thomas: tom, tommy; timothy: tim, timmy; ulrich: uli, ulli; victoria: vicky, tori, vic, vickie; vincent: vince, vinny;
virginia: ginny; walter: walt, wally; william: will, bill, billy, willy; wolfgang: wolf; yvonne: evie; zachary: zack, zac
"""
#: Given names without a usual short form.
OTHER_GIVEN = "soren ozlem yvonne quentin maria anna peter paul helen alice arthur martin simon laura julia emma"
#: Ways to write the kinds of bodies and the qualities of concepts.
WRITTEN_OUT = {
    "center": "centre", "ctr": "centre", "cent": "centre", "inst": "institute", "instit": "institute", "institut": "institute",
    "soc": "society", "fdn": "foundation", "found": "foundation", "lab": "laboratory", "labs": "laboratory", "univ": "university",
    "dept": "department", "dep": "department", "cpl": "coupled", "assoc": "association", "acad": "academy", "coll": "college",
}
KINDS = frozenset(WRITTEN_OUT.values())
FILLERS = frozenset("the of for and de la der von di du des le".split())
BEFORE_CODES = frozenset("object source target model type no nr".split())
TITLES = frozenset("dr prof mr mrs ms sir dame".split())

#: Edits, or swaps of neighbours, within a word.
WORD_EDITS = 1
#: Forms under one key of the index that a task joins; a longer list is split over tasks, which changes no result.
CROWD = 1000
#: Words of a form up to which two of them together make a key; names of more words have one word and their number.
PAIRED = 8


def _short_forms() -> dict[str, frozenset[str]]:
    out: dict[str, set[str]] = {}
    for entry in SHORT_FORMS.replace("\n", " ").split(";"):
        full, _, shorts = entry.partition(":")
        for s in shorts.split(","):
            out.setdefault(s.strip(), set()).add(full.strip())
        out.setdefault(full.strip(), set()).add(full.strip())
    for name in OTHER_GIVEN.split():
        out.setdefault(name, set()).add(name)
    return {k: frozenset(v) for k, v in out.items()}


GIVEN = _short_forms()
_FULL = frozenset(x for v in GIVEN.values() for x in v)


def plain(text: str) -> str:
    """Lower case without accents; letters that don't decompose are written out."""
    text = text.casefold().replace("ø", "o").replace("ł", "l").replace("đ", "d").replace("ı", "i").replace("æ", "ae").replace("œ", "oe")
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


_WORD = re.compile(r"[^\W_]+")
_POSSESSIVE = re.compile(r"['’`´]s\b")
_CODE = re.compile(r"\d+[a-z]|[a-z]\d+")
_TITLE = re.compile(r"[_/\\]|\d{3,}|\d$|^\d+[-. ]\d|v\d+\b")
_INVERTED = re.compile(r"\s*[^\W\d_]+,[\s-]*[^\W\d_]+(?:\s+[^\W\d_]\.?)?\s*")


def words(display: str) -> list[str] | None:
    """The words of a name in canonical spelling, sorted; None for what is a page title or a number.

    Page titles are names with figures at the end, long figures, dates or file marks; a figure
    elsewhere is a word that must be equal. A letter standing between full words is dropped (a
    middle initial); figures within a longer word are read as the letters they look like; a nickname
    of one given name is written out. All scripts are read.
    """
    text = _POSSESSIVE.sub("", plain(display))
    found = [w for w in _WORD.findall(text) if w not in TITLES]
    bare = [w for w in found if w not in FILLERS]
    found = bare if len(bare) > 1 else found
    if _TITLE.search(text.strip()) or all(w.isdigit() for w in found):
        return None
    out = []
    for w in found:
        if len(w) >= 4 and not w[0].isdigit() and any(c.isdigit() for c in w):
            w = w.replace("0", "o").replace("1", "l").replace("5", "s")
        w = WRITTEN_OUT.get(w, w)
        full = GIVEN.get(w)
        out.append(next(iter(full)) if full and len(full) == 1 else w)
    if any(len(w) >= 8 and near(w, "department") for w in out):  # of a university, whether it says so or not
        out = [w for w in out if w not in ("u", "university")] if len(out) > 2 else out
    if len(out) > 2 and any(_CODE.fullmatch(w) for w in out):
        out = [w for w in out if w not in BEFORE_CODES]
    long = [w for w in out if len(w) > 1]
    if len(long) >= 2:
        out = long
    elif len(out) > 2:
        out = long + [w for w in out if len(w) == 1][:1]
    if len(out) == 2:  # two initials before or after one long word: the first is that of the given name
        for i, w in enumerate(out):
            if len(w) == 2 and w.isalpha() and len(out[1 - i]) >= 4 and w not in GIVEN:
                out[i] = w[0]
    return sorted(out)


def personal(display: str) -> bool:
    """Whether a display is written as people are: with a title, or as a family name, a comma and a given name."""
    first = _WORD.search(plain(display))
    return (first is not None and first.group() in TITLES and len(_WORD.findall(display)) > 2) or bool(_INVERTED.fullmatch(display))


def near(a: str, b: str, most: int = WORD_EDITS) -> bool:
    """Edit distance, a swap of neighbours counting once, of at most `most`, in a band of that width."""
    if a == b:
        return True
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return False
    far = most + 1
    before2: list[int] = []
    before = [j if j <= most else far for j in range(m + 1)]
    for i in range(1, n + 1):
        row = [far] * (m + 1)
        if i <= most:
            row[0] = i
        best = far
        for j in range(max(1, i - most), min(m, i + most) + 1):
            d = min(before[j - 1] + (a[i - 1] != b[j - 1]), before[j] + 1, row[j - 1] + 1)
            if before2 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d = min(d, before2[j - 2] + 1)
            row[j] = d
            best = min(best, d)
        if best > most and (not before2 or min(before) > most):
            return False
        before2, before = before, row
    return before[m] <= most


def given(w: str) -> bool:
    """Whether a word is a given name, perhaps with a misspelling."""
    return w in GIVEN or (len(w) >= 5 and _near_given(w))


@lru_cache(maxsize=100_000)
def _near_given(w: str) -> bool:
    return any(abs(len(g) - len(w)) <= 1 and near(g, w) for g in _FULL)


SAME, A_SHORT, B_SHORT = 0, 1, 2


@lru_cache(maxsize=200_000)
def relation(a: str, b: str, person_a: bool = False, person_b: bool = False) -> tuple[int, int] | None:
    """How two words may stand for one: the same, or one a shortening of the other; and the misspellings (0 or 1) in that.

    An initial stands for a given name: one that is known, or any word of a personal name.
    """
    if a == b:
        return SAME, 0
    if any(c.isdigit() for c in a + b):
        return None
    if a in GIVEN and b in GIVEN:
        if GIVEN[a] & GIVEN[b]:
            return A_SHORT if len(GIVEN[a]) > 1 else B_SHORT if len(GIVEN[b]) > 1 else SAME, 0
        if min(len(a), len(b)) > 4 or not (GIVEN[b].issubset({b}) and b.startswith(a) or GIVEN[a].issubset({a}) and a.startswith(b)):
            return None
    if min(len(a), len(b)) >= 3 and max(len(a), len(b)) >= 4 and near(a, b):
        return SAME, 1
    for x, y, how, person in ((a, b, A_SHORT, person_b), (b, a, B_SHORT, person_a)):
        if (len(x) == 1 or (len(x) == 2 and x in GIVEN)) and y[0] == x[0] and (given(y) or (person and len(y) > 2)):
            return how, 0
        if 3 <= len(x) <= 6 and len(y) - len(x) >= 1 and x not in KINDS and (y.startswith(x) or (len(x) >= 4 and any(near(x, y[:n]) for n in (len(x) - 1, len(x), len(x) + 1)))):
            return how, int(not y.startswith(x))
        if x in GIVEN and len(y) >= 5 and any(near(f, y) for f in GIVEN[x]):  # a short form against a misspelled full name
            return how if len(GIVEN[x]) > 1 else SAME, 1
    return None


def compare(a: list[str], b: list[str], person_a: bool = False, person_b: bool = False) -> str | None:
    """The first of `judged`."""
    said = judged(a, b, person_a, person_b)
    return said and said[0]


def judged(a: list[str], b: list[str], person_a: bool = False, person_b: bool = False) -> tuple[str, int] | None:
    """"full" if the words of two forms are the same up to misspellings, "a" or "b" if that one is a shortening; and the misspellings.

    Each word of one must stand for exactly one of the other, at most two of them misspelled; an
    acronym stands for all words but one.
    """
    if len(a) != len(b):
        if len(a) == 2 and len(b) >= 3:
            return ("a", 0) if _acronym(a, b) else None
        if len(b) == 2 and len(a) >= 3:
            return ("b", 0) if _acronym(b, a) else None
        return None
    if len(a) == 2 and any(max(len(x), len(y)) <= 4 and x not in GIVEN and y not in GIVEN for x in set(a) - set(b) for y in set(b) - set(a)):
        return None  # other acronyms, not misspellings
    best = _match(tuple(a), tuple(b), person_a, person_b)
    if best is None:
        return None
    typos, short_a, short_b = best
    if typos > 2 or (short_a and short_b):
        return None
    return "a" if short_a else "b" if short_b else "full", typos


def _match(a: tuple[str, ...], b: tuple[str, ...], person_a: bool = False, person_b: bool = False) -> tuple[int, int, int] | None:
    """Fewest (misspellings, shortenings in a, in b) over the ways to pair all words."""
    if not a:
        return 0, 0, 0
    best = None
    for j, w in enumerate(b):
        r = relation(a[0], w, person_a, person_b)
        if r is None:
            continue
        rest = _match(a[1:], b[:j] + b[j + 1 :], person_a, person_b)
        if rest is None:
            continue
        this = (rest[0] + r[1], rest[1] + (r[0] == A_SHORT), rest[2] + (r[0] == B_SHORT))
        if best is None or (this[1] + this[2], this[0]) < (best[1] + best[2], best[0]):
            best = this
        if r == (SAME, 0):
            break
    return best


def _acronym(short: list[str], long: list[str]) -> bool:
    for name, letters in (short, short[::-1]):
        if letters[0] == "u" and "department" in long and len(letters) == len(long):
            letters = letters[1:]
        if 3 <= len(letters) <= 6 and len(letters) == len(long) - 1 and letters.isalpha():
            for i, w in enumerate(long):
                if (w == name or (len(name) >= 5 and near(w, name))) and sorted(x[0] for x in long[:i] + long[i + 1 :]) == sorted(letters):
                    return True
    return False


def _ends(word: str, size: int) -> list[str]:
    return ["<" + word[:size], ">" + word[-size:]] if size else []


def cut(word: str, paired: bool) -> list[tuple[str, str]]:
    """(segment, word) under which the index holds a word: its two ends, or what a shortening shows of the word it stands for.

    The ends leave a letter or two between them, so that one edit or swap spares an end. Words with
    figures, and short words beside several others, must be equal. Given names of several short
    forms are held under each full name as well.
    """
    n = len(word)
    if any(c.isdigit() for c in word) or not word.isascii() and n < 3:
        return [("=" + word, word)]
    out = [(s, x) for x in sorted({word, *GIVEN.get(word, ())}) if len(x) > 2 for s in _ends(x, (len(x) - 1) // 2)]
    if n <= 2:
        out.append(("." + word[0], word) if paired else ("=" + word, word))
    elif n <= 6 and word not in KINDS:
        out.append(("~" + word[:2], word))
        if n == 4:  # an edit spares one half, a swap in the middle the outer letters
            out += [("^" + word[2:], word), ("-" + word[0] + word[3], word)]
        elif n >= 5:
            out.append(("^" + word[3:5], word))
    return out


def lookups(word: str, paired: bool) -> list[tuple[str, str]]:
    """(segment, word) by which a word is looked up: those that `cut` gives for any word that `relation` ties to it, if that is the shorter one or equally long in kind."""
    n = len(word)
    if any(c.isdigit() for c in word) or not word.isascii() and n < 3:
        return [("=" + word, word)]
    out = [(s, x) for x in sorted({word, *GIVEN.get(word, ())}) if len(x) > 2 for size in sorted({(len(x) + d) // 2 for d in (-2, -1, 0)}) for s in _ends(x, size)]
    if n >= 2 and paired:
        out.append(("." + word[0], word))
    if n <= 2:
        out.append(("." + word[0], word) if paired else ("=" + word, word))
    if n >= 4:
        out += [("~" + word[:2], word), ("-" + word[0] + word[3], word), *(("^" + word[i : i + 2], word) for i in (1, 2, 3, 4) if i + 2 <= n)]
    return out


def _key(a: tuple[str, str], b: tuple[str, str]) -> tuple[str, str, str]:
    """Two segments in order as one key, and the words they are of."""
    (s, x), (t, y) = (a, b) if a <= b else (b, a)
    return f"{s} {t}", x, y


def index_keys(form: list[str], rare: list[str]) -> set[tuple[str, str, str]]:
    """(key, word, word) under which the index holds a form whose two rarest words are `rare`."""
    n = len(form)
    if n == 1 or n > PAIRED:
        return {(f"{n} {s}", x, "") for s, x in cut(rare[0], False)}
    pairs = n == 2
    first, second = cut(rare[0], pairs), cut(rare[1], pairs)
    out = {_key(a, b) for a in first for b in second}
    for name, letters in (rare, rare[::-1]) if pairs else ():
        if 3 <= len(letters) <= 6 and letters.isalpha():
            options = {letters, letters[1:]} if letters[0] == "u" else {letters}  # a university's department
            out |= {_key(a, ("!" + "".join(sorted(x)), "")) for a in cut(name, False) for x in options}
    return out


def probe_keys(form: list[str]) -> set[tuple[str, str, str]]:
    """(key, word, word) by which a form is looked up: for any form it may be a spelling of, or that may be a shortening of it, one is in index_keys."""
    n = len(form)
    found = [lookups(w, n == 2) for w in form]
    if n == 1 or n > PAIRED:
        return {(f"{n} {s}", x, "") for w in found for s, x in w}
    out = {_key(a, b) for i in range(n) for j in range(i + 1, n) for a in found[i] for b in found[j]}
    if n >= 3:
        for i, w in enumerate(form):
            letters = "!" + "".join(sorted(x[0] for j, x in enumerate(form) if j != i))
            out |= {_key(a, (letters, "")) for a in lookups(w, False)}
    return out


def read_names(links: DataFrame, queue: DataFrame) -> DataFrame:
    """(key, display): every key with the most frequent display that its key can come from.

    Equal numbers are ordered by display. Keys whose displays are all null or something else are
    read from the key itself. Null and empty keys are left out.
    """
    typed = (
        links.select(F.col("target_key").alias("key"), "display")
        .unionByName(queue.select(F.col("key_a").alias("key"), F.col("display_a").alias("display")))
        .unionByName(queue.select(F.col("key_b").alias("key"), F.col("display_b").alias("display")))
        .where("key is not null and key <> ''")
    )
    counted = typed.groupBy("key", "display").agg(F.count(F.lit(1)).alias("n"))
    fits = F.coalesce(normalize("display") == F.col("key"), F.lit(False))
    best = F.max(F.when(fits, F.struct("n", "display")))
    return counted.groupBy("key").agg(best["display"].alias("display")).select("key", F.coalesce("display", "key").alias("display"))


def _spread_distinct(pairs: DataFrame) -> DataFrame:
    """Different rows, in partitions for all cores: they are few bytes but much work, so their number is set here."""
    spark = pairs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return pairs.repartition(parts, *pairs.columns).distinct()


def _forms(names: DataFrame) -> DataFrame:
    """(key, form, person): the form of each name that is none of a page, and whether it is written as people are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            displays = b.column(1).to_pylist()
            read = [words(d) for d in displays]
            forms = pa.array([" ".join(w) if w else None for w in read], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), forms, pa.array([personal(d) for d in displays], pa.bool_())], names=["key", "form", "person"])

    return names.mapInArrow(run, "key string, form string, person boolean").where("form is not null")


def rarest_words(forms: DataFrame, n: int = 2) -> DataFrame:
    """(form, person, rare): the n words of each form that the fewest forms have; equal ones in order."""
    each = forms.select("form", "person", F.posexplode(F.split("form", " ")).alias("at", "word"))
    counts = each.groupBy(F.col("word").alias("counted")).agg(F.count(F.lit(1)).alias("df"))
    known = salted_join(each, counts, "word", "counted", salt_by="form")
    lists = known.groupBy("form", "person").agg(F.array_sort(F.collect_list(F.struct("df", "at", "word"))).alias("all"))
    return lists.select("form", "person", F.transform(F.slice("all", 1, n), lambda x: x["word"]).alias("rare"))


_KEYED = "form string, person boolean, key string, x string, y string"


def _keyed(forms: DataFrame, keys: Callable[[list[str], list[str]], set[tuple[str, str, str]]]) -> DataFrame:
    """(form, person, key, x, y) of forms with their rarest words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for start in range(0, len(big), 2000):
                b = big.slice(start, 2000)
                at, rows = [], []
                for i, (form, rare) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist())):
                    found = keys(form.split(" "), rare)
                    at += [i] * len(found)
                    rows += found
                take, cols = pa.array(at, pa.int64()), list(zip(*rows)) if rows else [[], [], []]
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), *(pa.array(c, pa.string()) for c in cols)], names=["form", "person", "key", "x", "y"])

    return forms.mapInArrow(run, _KEYED)


def _close(tag: Column, x: Column, other: Column) -> Column:
    """Whether two words that share an end are within the edits, a swap counting as two; other segments are verified later."""
    return ~tag.isin("<", ">") | (F.levenshtein(x, other, 2) >= 0)


def candidates(ranked: DataFrame) -> DataFrame:
    """(form_a, form_b, person_a, person_b), form_a < form_b: forms that share a key of the index and whose two words there are close.

    Keys of more than CROWD forms are split: each form is listed in one part and looked up in all.
    """
    index = written(_keyed(ranked, index_keys), "index")
    crowds = index.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(f"n > {CROWD}")
    crowds = written(crowds.select(F.col("key").alias("crowd"), F.ceil(F.col("n") / CROWD).cast("int").alias("parts")), "crowds")
    parts = F.coalesce("parts", F.lit(1))
    held = index.join(crowds, F.col("key") == F.col("crowd"), "left").select("form", "person", "key", "x", "y", F.pmod(F.xxhash64("form"), parts).cast("int").alias("part"))
    asked = _keyed(ranked, lambda form, rare: probe_keys(form)).join(crowds, F.col("key") == F.col("crowd"), "left")
    asked = asked.select(F.col("form").alias("form2"), F.col("person").alias("person2"), F.col("key").alias("key2"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part2"))
    on = (F.col("key") == F.col("key2")) & (F.col("part") == F.col("part2")) & (F.col("form") != F.col("form2"))
    first = F.when(F.col("key").rlike("^[0-9]"), F.substring(F.substring_index("key", " ", -1), 1, 1)).otherwise(F.substring("key", 1, 1))
    second = F.substring(F.substring_index("key", " ", -1), 1, 1)
    close = _close(first, F.col("x"), F.col("x2")) & ((F.col("y") == "") | _close(second, F.col("y"), F.col("y2")))
    # estimates leave out the explosion: without the hint a side might be broadcast
    met = held.hint("merge").join(asked, on & close)
    lower = F.col("form") < F.col("form2")
    pick = lambda a, b, name: F.when(lower, F.col(a)).otherwise(F.col(b)).alias(name)
    return _spread_distinct(met.select(pick("form", "form2", "form_a"), pick("form2", "form", "form_b"), pick("person", "person2", "person_a"), pick("person2", "person", "person_b")))


def link_names(links: DataFrame, queue: DataFrame) -> DataFrame:
    """(key, entity): keys that share their entity with another key, with the entity's smallest form.

    Full spellings are tied by words that are equal, misspelled (one edit or swap a word, in at most
    two words) or nicknames. Shortenings (initials, cut words, acronyms) are tied to the one entity
    they can stand for; where several can, they stay alone. Page titles are never tied, nor are names
    that differ in a figure or code. Empty tables give an empty result.
    """
    named = written(_forms(read_names(links, queue)), "names")
    forms = named.groupBy("form").agg(F.max("person").alias("person"))
    # few bytes but much work: their partitions are set here
    parts = max(int(links.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * links.sparkSession.sparkContext.defaultParallelism)
    pairs = candidates(written(rarest_words(forms).repartition(parts, "form"), "forms"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(x, y, judged(x.split(" "), y.split(" "), p, q)) for x, y, p, q in zip(*(c.to_pylist() for c in b.columns))]
            rows = [(x, y, *said) for x, y, said in rows if said]
            cols = list(zip(*rows)) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in cols[:3]), pa.array(cols[3], pa.int32())], names=["form_a", "form_b", "how", "typos"])

    matched = written(pairs.mapInArrow(verify, "form_a string, form_b string, how string, typos int"), "matched")
    tied = components(matched.where("how = 'full'"), "form_a", "form_b")
    short = matched.where("how <> 'full'").select(
        F.when(F.col("how") == "a", F.col("form_a")).otherwise(F.col("form_b")).alias("short"),
        F.when(F.col("how") == "a", F.col("form_b")).otherwise(F.col("form_a")).alias("long"), "typos",
    )
    # what is itself a shortening of something can't decide between entities
    shortened = short.select(F.col("short").alias("cut")).distinct()
    tied = written(tied, "tied")
    cluster = short.join(shortened, F.col("long") == F.col("cut"), "left_anti").join(tied, F.col("long") == F.col("node"), "left")
    # of the entities that a shortening can stand for, those count that need the fewest misspellings
    by_typos = cluster.groupBy("short", "typos").agg(F.min(F.coalesce("component", "long")).alias("entity"), F.max(F.coalesce("component", "long")).alias("last"))
    only = by_typos.groupBy("short").agg(F.min(F.struct("typos", "entity", "last")).alias("r")).where("r.entity = r.last").select("short", "r.entity")
    edges = tied.select(F.col("node").alias("x"), F.col("component").alias("y")).unionByName(only.select(F.col("short").alias("x"), F.col("entity").alias("y")))
    groups = components(edges, "x", "y")
    entities = named.join(groups, F.col("form") == F.col("node"), "left").select("key", F.coalesce("component", "form").alias("entity"))
    several = entities.groupBy("entity").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("entity").alias("kept"))
    return entities.join(several, F.col("entity") == F.col("kept"), "left_semi")


def name_pairs(links: DataFrame, queue: DataFrame) -> DataFrame:
    """(key_a, key_b): all pairs of keys of one entity, key_a < key_b."""
    e = written(link_names(links, queue), "entities")
    a, b = e.select(F.col("key").alias("key_a"), "entity"), e.select(F.col("key").alias("key_b"), F.col("entity").alias("same"))
    return a.join(b, (F.col("entity") == F.col("same")) & (F.col("key_a") < F.col("key_b"))).select("key_a", "key_b")
