"""Joins on keys of which one may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot if it holds at least this share of the rows, so there are at most 1 / HOT_SHARE hot keys.
HOT_SHARE = 1 / 200
SALTS = 16


def hot_keys(df: DataFrame, key: str, share: float = HOT_SHARE, floor: int = 10_000) -> DataFrame:
    """Keys that hold at least `share` of the non-null rows and at least `floor` rows.

    At most 1 / share rows by construction, whatever the input: safe to broadcast. Counting is
    pre-aggregated before its shuffle. Null keys never join and are not counted.
    """
    counts = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__hot")).agg(F.count(F.lit(1)).alias("__n"))
    total = counts.agg(F.sum("__n").alias("__total"))
    return (
        counts.where(F.col("__n") >= floor)
        .join(F.broadcast(total), F.col("__n") >= F.col("__total") * share)
        .select("__hot")
    )


def salted_join(
    left: DataFrame,
    right: DataFrame,
    left_key: str,
    right_key: str,
    how: str = "inner",
    condition: Column | None = None,
    salt_by: str | None = None,
    salts: int = SALTS,
    hot: DataFrame | None = None,
) -> DataFrame:
    """`left` joined with `right` on one key, with the hot keys of `left` split over `salts` tasks.

    Only rows of `right` under a hot key are repeated (once a salt), so the cost is bounded by
    `salts` times the rows that `right` has under at most 1 / HOT_SHARE keys. `how` may be any kind
    that keeps or drops whole rows of `left` (inner, left, left_semi, left_anti). The result has the
    columns of Spark's own join; `left` and `right` must not share column names.
    """
    hot = hot_keys(left, left_key) if hot is None else hot
    hot = F.broadcast(hot)
    spread = F.pmod(F.xxhash64(*([salt_by] if salt_by else left.columns)), F.lit(salts)).cast("int")
    l = (
        left.join(hot, F.col(left_key) == F.col("__hot"), "left")
        .withColumn("__ls", F.when(F.col("__hot").isNotNull(), spread).otherwise(F.lit(0)))
        .drop("__hot")
    )
    r = (
        right.join(hot, F.col(right_key) == F.col("__hot"), "left")
        .withColumn(
            "__rs",
            F.explode(F.when(F.col("__hot").isNotNull(), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))),
        )
        .drop("__hot")
    )
    on = (l[left_key] == r[right_key]) & (l["__ls"] == r["__rs"])
    if condition is not None:
        on = on & condition
    return l.join(r, on, how).drop("__ls", "__rs")
