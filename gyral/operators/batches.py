"""Restartable batch work: what is pending, what failed and why."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pending(items: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    """Items whose output does not exist yet."""
    return items.join(done.select(*keys), list(keys), "left_anti")


def judged(items: DataFrame, checks: list[tuple[str, Column]]) -> DataFrame:
    """items with status 'ok' or 'fail' and the reason: the first check that does not hold (null counts as not)."""
    reason = F.coalesce(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks)) if checks else F.lit(None).cast("string")
    return items.withColumn("reason", reason).withColumn("status", F.when(F.col("reason").isNull(), "ok").otherwise("fail"))


def tally(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n"))


def variants(items: DataFrame, key: str, order: list[str], pattern: str = "-%04d") -> DataFrame:
    """items with sfx, a running number within the key written by `pattern`, from 0."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1
    return items.withColumn("sfx", F.format_string(pattern, n))


def rerooted(path: Column, roots: list[tuple[str, str]]) -> Column:
    """The path with the first matching old root replaced by its new one; other paths stay."""
    out = None
    for old, new in roots:
        case = F.when if out is None else out.when
        out = case(path.startswith(old), F.concat(F.lit(new), F.substr(path, F.lit(len(old) + 1))))
    return path if out is None else out.otherwise(path)


def looked_up(items: DataFrame, dimension: DataFrame, key: str, strict: bool = True) -> DataFrame:
    """items with the columns of dimension, which has one row a key; a key that is missing there is an error at run time.

    strict=False keeps such rows, with nulls, instead.
    """
    from gyral.plans.skew import split_join

    found = split_join(items, dimension.withColumn("_there", F.lit(True)), key, "left")
    if strict:
        found = found.withColumn("_there", F.coalesce("_there", F.raise_error(F.concat(F.lit("no entry for "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast("boolean"))).filter("_there")
    return found.drop("_there")


def missed(items: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """The rows of items whose key dimension lacks."""
    return items.join(dimension.select(key), key, "left_anti")


def paired(sides: dict[str, DataFrame], key: str) -> DataFrame:
    """(key, one flag a side, missing): which sides hold each key, and the first side that does not; null where all do."""
    both = None
    for name, df in sides.items():
        one = df.select(key).distinct().withColumn(name, F.lit(True))
        both = one if both is None else both.join(one, key, "full")
    flags = {name: F.coalesce(name, F.lit(False)) for name in sides}
    both = both.select(key, *(c.alias(n) for n, c in flags.items()))
    return both.withColumn("missing", F.coalesce(*(F.when(~F.col(n), F.lit(n)) for n in sides)))


def enumerated(files: DataFrame, roots: list[str], keep: DataFrame | None = None) -> DataFrame:
    """files(path) -> (root, dir, name, sfx): one row per file under one of roots, in root order, split into name and variant suffix.

    A file without suffix has the empty one; keep(name) restricts the names; other files give no rows.
    """
    root = F.coalesce(*(F.when(F.startswith("path", F.lit(r)), F.lit(i)) for i, r in enumerate(roots)))
    stem = F.regexp_extract("path", r"/([^/]+?)(?:-(?:[0-9]{4}|m[0-9]+))?[.][^/]*$", 1)
    sfx = F.regexp_extract("path", r"(-(?:[0-9]{4}|m[0-9]+))[.][^/]*$", 1)
    rows = files.withColumn("root", root).filter("root is not null").select("root", F.regexp_replace("path", r"/[^/]*$", "").alias("dir"), stem.alias("name"), sfx.alias("sfx"))
    rows = rows.filter("name <> ''")
    return rows if keep is None else rows.join(keep.select("name"), "name", "left_semi").select("root", "dir", "name", "sfx")


def with_fallback(items: DataFrame, found: DataFrame, key: str, sfx: str = "sfx") -> DataFrame:
    """One row per variant of each item; an item without variants has one row with the empty suffix."""
    return items.select(key).distinct().join(found.select(key, sfx).distinct(), key, "left").withColumn(sfx, F.coalesce(sfx, F.lit("")))


def progress(rows: DataFrame, name: str = "progress", **checks: Column):
    """rows, and an observation that counts them, and those of each check, while whatever action reads them runs."""
    from pyspark.sql import Observation

    seen = Observation(name)
    return rows.observe(seen, F.count(F.lit(1)).alias("rows"), *(F.count_if(c).alias(n) for n, c in checks.items())), seen
