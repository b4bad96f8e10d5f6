"""Names: word relations, forms, the segment join and whole groups."""

import random

import pytest

from notegraph.llm import names as N

SAME = [
    ("Abigail Gomzapul", "Gomzapul, Abigail"), ("Abigail Gomzapul", "Abby Gonzapul"), ("Gabrie1 Figindil", "Dr Gabriel Figindil"), ("Søren Rammeljer", "Sørne Rammeljer"),
    ("Kamlerhe Centre for Tidal Mechanics", "Ctr. for Tidal Mechanics, Kamlerhe"), ("Kamlerhe Centre for Tidal Mechanics", "The Kamlerhe Center for Tidal Mecanics"),
    ("initial Rudolbir transform", "Rudolbir's initial transform"), ("initial transform of Rudolbir", "initial Rudolbir transfrm"), ("Silnebi-10c", "10c Silnebi"),
    ("Furernar University Department of Harbour Archives", "Dept. of Harbour Archives, Furernar"),
]
SHORT = [
    ("A. Gomzapul", "Abigail Gomzapul"), ("AE Nopihem", "Anthony Nopihem"), ("Abig. Gomzapul", "Abigail Gomzapul"), ("CTM Kamlerhe", "Kamlerhe Centre for Tidal Mechanics"),
    ("init. Rudolbir transform", "initial Rudolbir transform"), ("Furernar UDHA", "Furernar University Department of Harbour Archives"), ("Penzenvam Soc. of Glac. Opptics", "Penzenvam Society of Glacial Optics"),
]
OTHER = [
    ("Anthony Figindil", "Margaret Figindil"), ("Figindil aquifer", "Figindil chamber"), ("Silnebi-10c", "Silnebi-10d"), ("Kamlerhe Centre for Tidal Mechanics", "Kamlerhe Centre for Orchard Genetics"),
    ("thermal Jorpalin threshold", "thermal Jorpalin transform"), ("A. Figindil", "Figindil aquifer"), ("Anthony Nopihem", "Anthony Figindil"), ("secondary Benulin threshold", "residual Benulin threshold"), ("UDGO Benulin", "UDOG Benulin"),
]


@pytest.mark.parametrize("a, b", SAME)
def test_same(a, b):
    assert N.compare(N.words(a), N.words(b)) == "full" == N.compare(N.words(b), N.words(a))


@pytest.mark.parametrize("a, b", SHORT)
def test_short(a, b):
    assert (N.compare(N.words(a), N.words(b)), N.compare(N.words(b), N.words(a))) == ("a", "b")


@pytest.mark.parametrize("a, b", OTHER)
def test_other(a, b):
    assert N.compare(N.words(a), N.words(b)) is None


@pytest.mark.parametrize("title", ["chat Benulin 000267", "Benulin_antenna_v128", "2022-01-08 protocol Galjanper 331", "Benulin.00005v2", "Amber furnace, Rammeljer 2", "--", ""])
def test_titles(title):
    assert N.words(title) is None


def distance(a, b):
    d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_banded_distance():
    rng = random.Random(8)
    words = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 9))) for _ in range(120)]
    assert all(N.near(a, b) == (distance(a, b) <= 1) for a in words for b in words)


def edited(rng, w):
    i, how = rng.randrange(len(w)), rng.randrange(4)
    if how == 3:
        i = min(i, len(w) - 2)
        return w[:i] + w[i + 1] + w[i] + w[i + 2 :]
    return w[:i] + ("" if how == 0 else rng.choice("abcde")) + w[i + (how < 2) :]


@pytest.mark.parametrize("n", [1, 2, 3, 5, 10])
def test_no_edit_escapes_the_segments(n):
    rng = random.Random(n)
    for _ in range(150):
        a = ["".join(rng.choice("abcde") for _ in range(rng.randrange(4, 10))) for _ in range(n)]
        b = [edited(rng, w) for w in a]
        rng.shuffle(b)
        rare = rng.sample(a, min(n, 2))
        assert {k for k, _, _ in N.index_keys(a, rare)} & {k for k, _, _ in N.probe_keys(b)}, (a, b, rare)


def test_candidates_are_complete(spark, monkeypatch):
    monkeypatch.setattr(N, "CROWD", 3)
    rng = random.Random(4)
    forms = sorted({" ".join(sorted("".join(rng.choice("ab") for _ in range(rng.randrange(4, 7))) for _ in range(2))) for _ in range(60)})
    df = spark.createDataFrame([(f, False) for f in forms], "form string, person boolean")
    got = {(r.form_a, r.form_b) for r in N.candidates(N.rarest_words(df)).collect()}
    want = {(a, b) for a in forms for b in forms if a < b and N.compare(a.split(" "), b.split(" "))}
    assert want and want <= got


LINKS = "source string, target_key string, display string, resolved boolean, key string, form string"
QUEUE = "key_a string, key_b string, display_a string, display_b string, entity string"


def tables(spark, displays):
    key = lambda d: N.re.sub("[^a-z0-9]", "", d.lower())
    links = [("p", key(d), d, None, "k", "f") for d in displays] + [("p", None, "x", None, "k", "f"), ("p", "", "y", None, "k", "f"), ("p", "nodisplay", None, None, "k", "f")]
    return spark.createDataFrame(links, LINKS), spark.createDataFrame([("a", None, None, "x", "e")], QUEUE)


def test_groups(spark):
    people = ["Anthony Nopihem", "Nopihem, Tony", "A. Nopihem", "AE Nopihem", "Gregory Pobirmen", "Gabriel Pobirmen", "G. Pobirmen", "Greg Pobirmen", "Lantern Drift", "chat Nopihem 000155", "Nopihem kernel"]
    got = {}
    for r in N.link_names(*tables(spark, people)).collect():
        got.setdefault(r.entity, set()).add(r.key)
    assert sorted(map(sorted, got.values())) == [["aenopihem", "anopihem", "anthonynopihem", "nopihemtony"], ["gregorypobirmen", "gregpobirmen"]]
    pairs = {tuple(r) for r in N.name_pairs(*tables(spark, people)).collect()}
    assert len(pairs) == 7 and all(a < b for a, b in pairs)


def test_crowded_blocks_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(N, "CROWD", 2)
    got = N.link_names(*tables(spark, ["Anthony Nopihem", "Anthhony Nopihem", "Abigail Nopihem", "Abigial Nopihem", "Anna Nopihem"])).collect()
    assert len(got) == 4
    links, queue = tables(spark, [])
    assert N.name_pairs(links.limit(0), queue.limit(0)).count() == 0


def groups(spark, displays):
    got = {}
    for r in N.link_names(*tables(spark, displays)).collect():
        got.setdefault(r.entity, set()).add(r.key)
    return sorted(map(sorted, got.values()))


def test_crowded_blocks_lose_no_variant(spark, monkeypatch):
    monkeypatch.setattr(N, "CROWD", 2)
    people = ["Quentin Nopihem", "Uqentin Nopihem", "Q. Nopihem", "Quentin Noppihem", "Q. Noppihem"]
    places = ["Nopihem Centre for Tidal Acoustic", "CTA Nopihem", "Nopihem Centre for Tidal Caoustic"]
    others = [f"Nopihem Centre for {a} {b}" for a in ("Thermal", "Tonal", "Tropical") for b in ("Cargo", "Music")]
    want = [["ctanopihem", "nopihemcentrefortidalacoustic", "nopihemcentrefortidalcaoustic"], ["qnopihem", "qnoppihem", "quentinnopihem", "quentinnoppihem", "uqentinnopihem"]]
    assert groups(spark, people + places + others) == want


def test_any_two_accepted_forms_share_a_key():
    for a, b in SAME + SHORT + [("Quentin Nopihem", "Uqentin Nopihem"), ("Mopihem, Bnthony", "Anthony Nopihem"), ("Nell Nopihem", "Nellson Nopihem"), ("nitial Rudolbir transform", "initial Rudolbir transform")]:
        a, b = N.words(a), N.words(b)
        for short, long in ((a, b), (b, a)):
            if N.compare(short, long) in ("full", "a"):
                for x in range(len(short)):
                    for y in range(x + 1, len(short)):
                        keys = {k for k, _, _ in N.index_keys(short, [short[x], short[y]])}
                        assert keys & {k for k, _, _ in N.probe_keys(long)}, (short, long)


def test_other_scripts_and_inner_figures(spark):
    names = ["Иван Петров", "Петров, Иван", "Иван Петрров", "Пётр Иванов", "山田 太郎", "太郎 山田", "山田 花子", "Firm 42 Labs", "Firmm 42 Labs", "Firm 43 Labs"]
    links = spark.createDataFrame([("p", f"k{i}", d, None, "k", "f") for i, d in enumerate(names)], LINKS)
    got = {}
    # keys that no display can come from are read from themselves, so the displays are joined to forms directly
    named = N._forms(links.select(N.F.col("target_key").alias("key"), "display"))
    pairs = N.candidates(N.rarest_words(named.groupBy("form").agg(N.F.max("person").alias("person")))).collect()
    tied = {frozenset((r.form_a, r.form_b)) for r in pairs if N.compare(r.form_a.split(" "), r.form_b.split(" "))}
    form = lambda d: " ".join(N.words(d))
    assert frozenset((form("Иван Петров"), form("Иван Петрров"))) in tied and frozenset((form("Firm 42 Labs"), form("Firmm 42 Labs"))) in tied
    assert form("山田 太郎") == form("太郎 山田") and form("Иван Петров") == form("Петров, Иван")
    assert not any({form("Firm 42 Labs"), form("Firm 43 Labs")} <= t or {form("山田 太郎"), form("山田 花子")} <= t for t in tied) and not got


def test_initials_of_unlisted_given_names(spark):
    people = ["Rajendra Nopihem", "Nopihem, Rajendra", "R. Nopihem", "K. Benulin", "Benulin kernel", "T. Figindil", "Ted Figindil"]
    assert groups(spark, people) == [["nopihemrajendra", "rajendranopihem", "rnopihem"], ["tedfigindil", "tfigindil"]]


def test_a_crowd_of_namesakes_loses_no_nickname(spark):
    crowd = [f"{chr(97 + i % 26)}{chr(97 + i // 26)}vule{chr(97 + i % 7)} Nopihem" for i in range(240)]
    got = groups(spark, crowd + ["Ted Nopihem", "Theodore Nopihem"])
    assert ["tednopihem", "theodorenopihem"] in got


def test_words_of_many_forms_still_lead(spark):
    crowd = [f"{chr(97 + i % 26)}{chr(97 + i // 26)}vule Nopihem" for i in range(110)]
    people = ["Quentin Nopihem", "Q. Nopihem", "Nopihem Centre for Tidal Acoustic", "CTA Nopihem", "Wolfgang Lim", "W. Lim", "Abig. Gomz.", "Abigail Gomzapul"]
    rare = [f"Quentin {c}" for c in ("Benulin", "Figindil", "Rammeljer", "Jorpalin", "Salmebon")]
    got = groups(spark, crowd + people + rare)
    for pair in (["qnopihem", "quentinnopihem"], ["ctanopihem", "nopihemcentrefortidalacoustic"], ["wlim", "wolfganglim"], ["abigailgomzapul", "abiggomz"]):
        assert pair in got
