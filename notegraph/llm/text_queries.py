"""Splitting and encoding of texts."""

from pyspark.sql import functions as F

from notegraph.llm.split import split_oversized
from notegraph.llm.tokens import encode_corpus
from notegraph.session import table


def p5_found(spark, d):
    return split_oversized(table(spark, d, "chunks")).where("piece = 0").select("path", "seq")


def p5_pieces(spark, d):
    return split_oversized(table(spark, d, "chunks"))


def p5_lossless(spark, d):
    """Per oversized chunk: the content put together again from its pieces, and whether all fit."""
    pieces = split_oversized(table(spark, d, "chunks"))
    body = F.expr("substring(text, overlap + 1, length(text))")
    parts = F.array_sort(F.collect_list(F.struct("piece", body.alias("body"))))
    return pieces.groupBy("path", "seq").agg(
        F.sha1(F.array_join(F.transform(parts, lambda x: x["body"]), "")).alias("content_sha1"),
        F.bool_and(F.length("text") <= 2400).alias("all_fit"),
    )


def p6_ids(spark, d):
    return encode_corpus(table(spark, d, "documents"))


_LONG = r"length(trim(content, E' \t\r\n')) > 2400"

QUERIES = {"p5_found": p5_found, "p5_pieces": p5_pieces, "p5_lossless": p5_lossless, "p6_ids": p6_ids}
ORACLES = {
    "p5_found": f"SELECT DISTINCT path, seq FROM chunks WHERE {_LONG}",
    "p5_lossless": f"SELECT DISTINCT path, seq, sha1(content) AS content_sha1, true AS all_fit FROM chunks WHERE {_LONG}",
}
