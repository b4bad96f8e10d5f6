"""Variant spellings of names."""

from notegraph.llm.names import link_names, name_pairs
from notegraph.session import table


def p3_found(spark, d):
    return name_pairs(table(spark, d, "links"), table(spark, d, "queue"))


def p3_entities(spark, d):
    return link_names(table(spark, d, "links"), table(spark, d, "queue"))


QUERIES = {"p3_found": p3_found, "p3_entities": p3_entities}
ORACLES: dict[str, str] = {}
