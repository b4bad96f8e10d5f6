"""Stuffed pages."""

from notegraph.llm.pages import stuffed_pages
from notegraph.session import table


def p8_found(spark, d):
    return stuffed_pages(table(spark, d, "documents")).select("doc_id")


QUERIES = {"p8_found": p8_found}
ORACLES: dict[str, str] = {}
