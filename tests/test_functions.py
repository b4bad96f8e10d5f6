"""Scalar functions on known cases."""

import pytest
from pyspark.sql import functions as F

from notegraph.functions import names as N
from notegraph.functions import text as T


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_keys(spark):
    names = ["Gamma-ray bursts", "Gamma-Ray Burst", "categories", "version1", "version2", "gas", "class", "classes", "ß", ""]
    assert one(spark, *[T.normalize(F.lit(x)) for x in names]) == ("gammarayburst", "gammarayburst", "category", "version1", "version2", "gas", "class", "classe", "", "")
    assert one(spark, T.normalize(F.lit(None).cast("string"))) == (None,)
    assert one(spark, T.tokens(F.lit("K2-18b phases")))[0] == ["k2", "18b", "phase"]


@pytest.mark.parametrize("name, ok", [("gamma-ray burst", True), ("Markov Chain Monte Carlo", True), ("Tier 2", False), ("Figure 3", False), ("two classes", False), ("a", False), ("10^52", False), ("Section IV", False), (None, False)])
def test_shape(spark, name, ok):
    assert one(spark, T.shape_ok(F.lit(name).cast("string"))) == (ok,)


PAIRS = [
    ("GRB", "gamma-ray burst", "same"), ("GRBs", "Gamma-ray bursts", "same"), ("JWST", "James Webb Space Telescope", "same"),
    ("GRB", "GRB 200826A", "different"), ("GRBs", "GRB 221009A", "different"), ("K2-18b", "K2-18c", "different"), ("LM2576", "LM2577", "different"),
    ("version1", "version2", "different"), ("Ariel", "Ariel Tier 2", "different"), ("Ariel", "Ariel Space Telescope", "defer"),
    ("gamma-ray burst", "short gamma-ray burst", "defer"), ("ISM", "interstellar medium", "defer"), ("forward shock", "FS model", "defer"), ("GRB", "GRB fireball", "defer"),
]


@pytest.mark.parametrize("a, b, verdict", PAIRS)
def test_pairs(spark, a, b, verdict):
    assert one(spark, N.resolve_pair(F.lit(a), F.lit(b)), N.resolve_pair(F.lit(b), F.lit(a))) == (verdict, verdict)


def test_links_and_hash(spark):
    plain, linked = "Das ist [x] Hull\nbody", "\n Das ist [x] [[Hull page|Hull]]\n[[body]]  "
    assert one(spark, T.strip_links(F.lit("[[a|b]] [[c\nd]] [[e|]]"))) == ("b c\nd e|",)
    assert len(set(one(spark, T.content_hash(F.lit(plain)), T.content_hash(F.lit(linked))))) == 1
    assert one(spark, T.content_hash(F.lit("a")))[0] != one(spark, T.content_hash(F.lit("b")))[0]


def test_summaries(spark):
    assert one(spark, T.gate_summary(F.lit("")), T.gate_summary(F.lit("One. Two.")), T.gate_summary(F.lit("One.")), T.gate_summary(F.lit("x" * 301))) == ("empty", "more than one sentence", None, "301 chars, over 300")
    assert one(spark, T.first_sentence(F.lit("# Head\n\nFirst one here. And two.")), T.first_sentence(F.lit("## only\n")), T.first_sentence(F.lit(None).cast("string"))) == ("First one here.", "(no text yet)", None)
    assert one(spark, F.length(T.short(F.lit("y" * 400)))) == (160,)


@pytest.mark.parametrize("value", ["plain", "a: b", "#tag", " lead", "", "- item", "*star", 'say "hi": now', "back\\slash: x"])
def test_yaml_round_trip(spark, value):
    assert one(spark, T.yaml_read(T.yaml_value(F.lit(value)))) == (value,)


def test_presence(spark):
    body = "A gamma-ray\n burst, [[linked name]] and C++ (twice)."
    present = lambda c: one(spark, T.concept_present(F.lit(body), F.lit(c)))[0]
    assert present("Gamma-ray burst") and present("linked name") and present("(twice)")
    assert not present("gam") and not present("") and not present("burstx")


def test_tokens_round_half_to_even(spark):
    assert one(spark, *[T.count_tokens(F.lit("x" * n)) for n in (2, 6, 10, 0)]) == (0, 2, 2, 0)
