"""Plans that keep hot keys from landing in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def heavy_keys(df: DataFrame, key: str, share: float = 0.001, weight: Column | None = None) -> list:
    """The keys that hold more than `share` of all rows; by arithmetic fewer than 1/share of them.

    Counted with map-side pre-aggregation; null is never heavy. Only these few keys come to the driver.
    """
    counts = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.sum(weight if weight is not None else F.lit(1)).alias("_n"))
    total = df.agg(F.sum(weight if weight is not None else F.lit(1)).alias("_all"))
    hot = counts.join(F.broadcast(total), F.col("_n") > F.greatest(F.col("_all") * share, F.lit(1000)), "inner")
    return [r[0] for r in hot.select(key).collect()]


def split_join(left: DataFrame, right: DataFrame, key: str, how: str = "left", hot: list | None = None, share: float = 0.001) -> DataFrame:
    """left joined (inner, left, left_semi or left_anti) with right, which has one row per key.

    Rows of heavy keys meet their few right-hand rows by broadcast (at most 1/share rows, as right is unique
    by key); all other rows are shuffled by the key. No row is dropped, null keys stay where `how` keeps them.
    """
    hot = heavy_keys(left, key, share) if hot is None else hot
    if not hot:
        return left.join(right, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    rest = left.filter(~is_hot).join(right.filter(~F.col(key).isin(hot)), key, how)
    return rest.unionByName(left.filter(is_hot).join(F.broadcast(right.filter(F.col(key).isin(hot))), key, how))


def spread_join(left: DataFrame, right: DataFrame, key: str, rows: int = 64_000, salts: int = 32, sampled: int = 64, most: int = 1_000) -> DataFrame:
    """Inner join of two tables that may both have many rows of a key.

    Keys with more than about `rows` rows on a side are spread: each left row takes one of `salts` salts, the right rows
    take all of them, so no task sees a whole hot key. They are looked for among one in `sampled` rows, chosen by a
    hash of the row, and the `most` largest are spread: that only decides where a row is joined, every row is joined
    once either way.
    """
    some = lambda df, side: df.select(F.col(key).alias("_k"), F.xxhash64(*df.columns).alias("_h")).filter(F.pmod("_h", F.lit(sampled)) == 0).select("_k", F.lit(side).alias("_side"))
    counts = some(left, 0).unionByName(some(right, 1)).filter(F.col("_k").isNotNull()).groupBy("_k", "_side").count().filter(F.col("count") > rows // sampled).orderBy(F.desc("count")).limit(most)
    hot = sorted({r[0] for r in counts.select("_k").collect()})
    if not hot:
        return left.join(right, key)
    rest = left.filter(~F.col(key).isin(hot)).join(right.filter(~F.col(key).isin(hot)), key)
    salted = left.filter(F.col(key).isin(hot)).withColumn("_salt", F.pmod(F.xxhash64(*left.columns), F.lit(salts)))
    copies = right.filter(F.col(key).isin(hot)).withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    return rest.unionByName(salted.join(copies, [key, "_salt"]).drop("_salt"))
