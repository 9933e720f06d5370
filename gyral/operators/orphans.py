"""References to records that do not exist, told apart by table, period and reason."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gyral.plans.skew import heavy_keys, split_join
from gyral.session import cut

#: Broadcast bound, in rows, of the heavy keys' lifetimes; beyond it they are salted instead.
BROADCAST_ROWS = 200_000
SALTS = 64


def lifetimes(files: DataFrame) -> DataFrame:
    """files(key, start, stop) -> the disjoint times (key, start, stop) in which a key exists.

    A null stop is open; empty and reversed intervals and null keys or starts hold nothing. Overlaps and repeats
    are merged: first within (key, day of start), so that a hot key is spread, then across days.
    """
    rows = (
        files.filter(F.col("key").isNotNull() & F.col("start").isNotNull() & (F.col("stop").isNull() | (F.col("start") < F.col("stop"))))
        .select("key", "start", F.coalesce("stop", F.lit("9999-12-31").cast("timestamp_ntz")).alias("stop"))
        .groupBy("key", "start")
        .agg(F.max("stop").alias("stop"))
        .withColumn("day", F.to_date("start"))
    )
    for by in (["key", "day"], ["key"]):
        w = Window.partitionBy(*by).orderBy("start")
        reach = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
        isle = F.sum(F.when(reach >= F.col("start"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
        rows = rows.withColumn("isle", isle).groupBy(*by, "isle").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    return rows.select("key", "start", "stop")


def _kept(refs: DataFrame, *more: str) -> DataFrame:
    """The references with a key, written once: paths are read and cut up a single time."""
    return cut(refs.filter(F.col("key").isNotNull()).select("ref_table", "row_id", "key", "t", *more), "p5-refs")


def _summary(spans: DataFrame) -> DataFrame:
    return spans.groupBy("key").agg(F.min("start").alias("first"), F.min("stop").alias("gone"), F.count("*").alias("spans"))


def _several(spans: DataFrame, summary: DataFrame) -> DataFrame:
    return spans.join(summary.filter(F.col("spans") > 1).select("key"), "key", "left_semi")


def orphan_references(refs: DataFrame, files: DataFrame, share: float = 0.001) -> DataFrame:
    """The references whose key does not exist at their time.

    refs(ref_table, row_id, key, t), files(key, start, stop). Returns (ref_table, row_id, t, reason) with reason
    'missing' (the key never exists), 'removed' (it existed before t) or 'later' (it only comes after t).
    Rows with a null key refer to nothing and are no orphans; a null t counts as before everything ('later',
    or 'missing'). An empty files table makes every reference 'missing'. Repeated rows stay repeated.

    Plan: references are counted per key and period before any shuffle of rows; keys above `share` of them are
    checked by broadcast, all others by a shuffled join on the key; both parts are united. Only references to
    keys with several lifetimes (a file that came back) take the second, interval-wise anti-join.
    """
    spans = cut(lifetimes(files), "p5-spans")
    refs = _kept(refs)
    counted = refs.groupBy("key", F.date_trunc("month", "t").alias("period")).count()
    return _judged(refs, spans, heavy_keys(counted, "key", share, weight=F.col("count")))


def _judged(refs: DataFrame, spans: DataFrame, hot: list) -> DataFrame:
    """The orphans of refs(ref_table, row_id, key, t), heavy keys by broadcast and the others by a shuffled join."""
    summary = _summary(spans)
    seen = split_join(refs, summary, "key", "left", hot)
    reason = (
        F.when(F.col("spans").isNull(), "missing")
        .when(F.col("gone") <= F.col("t"), "removed")
        .when(F.col("first") <= F.col("t"), None)
        .otherwise("later")
    )
    judged = seen.withColumn("reason", reason)
    plain = judged.filter(F.col("reason").isNotNull() & ((F.coalesce("spans", F.lit(0)) <= 1) | (F.col("reason") != "removed")))
    doubtful = judged.filter((F.col("spans") > 1) & (F.col("reason") == "removed"))
    checked = _not_within(doubtful, _several(spans, summary), hot)
    return plain.select("ref_table", "row_id", "t", "reason").unionByName(checked.select("ref_table", "row_id", "t", "reason"))


def _not_within(refs: DataFrame, spans: DataFrame, hot: list) -> DataFrame:
    """Anti-join of refs with spans on key and start <= t < stop; the heavy keys apart."""
    spans = spans.withColumnRenamed("key", "span_key")
    within = (F.col("key") == F.col("span_key")) & (F.col("start") <= F.col("t")) & (F.col("t") < F.col("stop"))
    if not hot:
        return refs.join(spans, within, "left_anti")
    few = spans.filter(F.col("span_key").isin(hot))
    bounded = few.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    rest = refs.filter(~F.col("key").isin(hot)).join(spans.filter(~F.col("span_key").isin(hot)), within, "left_anti")
    heavy = refs.filter(F.col("key").isin(hot))
    if bounded:
        return rest.unionByName(heavy.join(F.broadcast(few), within, "left_anti"))
    salted = heavy.withColumn("salt", F.pmod(F.xxhash64("row_id", "t"), F.lit(SALTS)))
    spread = few.withColumn("span_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    return rest.unionByName(salted.join(spread, within & (F.col("salt") == F.col("span_salt")), "left_anti").drop("salt"))


def orphan_report(refs: DataFrame, files: DataFrame, share: float = 0.001) -> DataFrame:
    """(ref_table, month, reason, n_refs): orphan_references() counted per table, month and reason.

    References are counted per table, key and month before anything is joined: a hot key is then a few rows a month. Where
    no lifetime of the key begins or ends within the month, between the group's first and last time, one check decides
    the whole group; only the references of the other groups are checked one by one.
    """
    spans = cut(lifetimes(files), "p5-spans")
    refs = _kept(refs.withColumn("period", F.date_trunc("month", "t")), "period")
    groups = refs.groupBy("ref_table", "key", "period").agg(F.count("*").alias("n"), F.min("t").alias("t"), F.max("t").alias("until"))
    groups = cut(groups, "p5-groups")
    hot = heavy_keys(groups, "key", share, weight=F.col("n"))
    edge = spans.select(F.col("key").alias("edge_key"), F.explode(F.array("start", "stop")).alias("at"))
    turns = (F.col("key") == F.col("edge_key")) & (F.col("t") < F.col("at")) & (F.col("at") <= F.col("until"))
    mixed = groups.filter(F.col("t") < F.col("until")).join(edge, turns, "left_semi").select("ref_table", "key", "period")
    mixed = cut(mixed, "p5-mixed")
    whole = groups.join(mixed, ["ref_table", "key", "period"], "left_anti")
    one_by_one = refs.join(mixed, ["ref_table", "key", "period"], "left_semi").select("ref_table", "row_id", "key", "t")
    month = F.date_format("t", "yyyy-MM").alias("month")
    # a group's count travels in row_id's place
    counted = _judged(whole.select("ref_table", F.col("n").alias("row_id"), "key", "t"), spans, hot).select("ref_table", month, "reason", F.col("row_id").alias("n"))
    single = _judged(one_by_one, spans, hot).select("ref_table", month, "reason", F.lit(1).cast("bigint").alias("n"))
    return counted.unionByName(single).groupBy("ref_table", "month", "reason").agg(F.sum("n").alias("n_refs"))
