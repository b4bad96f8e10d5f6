"""Evaluation texts in documents."""

from pyspark.sql import functions as F

from notegraph.llm.leaks import leaked_items
from notegraph.session import table


def p7_found(spark, d):
    return leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_items(spark, d):
    """Per test item: how many documents leak it."""
    items = table(spark, d, "eval_items")
    counts = p7_found(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"))
    return items.select("item_id", "split").join(counts, "item_id", "left").select("item_id", "split", F.coalesce("n_docs", F.lit(0)).alias("n_docs"))


QUERIES = {"p7_found": p7_found, "p7_items": p7_items}
ORACLES: dict[str, str] = {}
