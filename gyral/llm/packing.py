"""Items of varying length in containers of fixed capacity: first-fit decreasing in randomised groups."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gyral.session import cut

#: Items of a randomised group; a group is one task's work, whatever the table's size.
GROUP_ITEMS = 20_000


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item, taken by size (ties: by place), each in the first bin with room for it.

    A tournament tree holds in each node the most room left in its bins, so the first fitting bin is one walk down.
    """
    order = np.argsort(-sizes, kind="stable")
    leaves = 1 << max(0, int(len(sizes) - 1).bit_length()) if len(sizes) else 1
    room = [capacity] * (2 * leaves)
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for item in order.tolist():
        size, node = int(sizes[item]), 1
        while node < leaves:
            node *= 2
            if room[node] < size:
                node += 1
        bins[item], offsets[item] = node - leaves, capacity - room[node]
        room[node] -= size
        node //= 2
        while node:
            most = room[2 * node] if room[2 * node] >= room[2 * node + 1] else room[2 * node + 1]
            if room[node] == most:
                break
            room[node] = most
            node //= 2
    return bins, offsets


def pack(items: DataFrame, capacity: int = 1024, group_items: int = GROUP_ITEMS) -> DataFrame:
    """items(id, size) -> (id, copy, piece, first, size, container, offset).

    An item above `capacity` is cut into full pieces, each a container, and a rest; all others stay whole. piece and
    first tell which part of the item the row is; offset is its place in the container. Sizes that are null, zero or
    negative take no room: one row with size 0 and null container. Repeated rows are items of their own, told apart
    by copy; they are counted before they are spread, so a hot id is spread over the groups like any other items.
    """
    counted = items.groupBy("id", F.greatest(F.coalesce("size", F.lit(0)), F.lit(0)).cast("bigint").alias("total")).count()
    each = counted.select("id", "total", F.explode(F.sequence(F.lit(1).cast("bigint"), "count")).alias("copy"))
    full = F.floor(F.col("total") / capacity).cast("bigint")
    rest = (F.col("total") - full * capacity).alias("size")
    whole = each.filter(full > 0).select("id", "copy", F.explode(F.sequence(F.lit(0).cast("bigint"), full - 1)).alias("piece"))
    whole = whole.select("id", "copy", "piece", (F.col("piece") * capacity).alias("first"), F.lit(capacity).cast("bigint").alias("size"), F.concat_ws("-", F.lit("full"), "id", "copy", "piece").alias("container"), F.lit(0).cast("bigint").alias("offset"))
    none = each.filter("total = 0").select("id", "copy", F.lit(0).cast("bigint").alias("piece"), F.lit(0).cast("bigint").alias("first"), F.lit(0).cast("bigint").alias("size"), F.lit(None).cast("string").alias("container"), F.lit(0).cast("bigint").alias("offset"))
    loose = cut(each.select("id", "copy", full.alias("piece"), (full * capacity).alias("first"), rest).filter("size > 0"), "p7-loose")
    groups = max(1, -(-loose.count() // group_items))
    loose = loose.withColumn("group", F.pmod(F.xxhash64(F.lit(7), "id", "copy"), F.lit(groups)).cast("int"))

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["id", "copy"], kind="stable")
        bins, offsets = first_fit_decreasing(group["size"].to_numpy(), capacity)
        group["container"] = [f"group-{g}-{b}" for g, b in zip(group["group"], bins)]
        group["offset"] = offsets
        return group.drop(columns="group")

    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in loose.schema if f.name != 'group')}, container string, offset bigint"
    return loose.groupBy("group").applyInPandas(fit, schema).unionByName(whole).unionByName(none)


def fill_report(packed: DataFrame, capacity: int = 1024) -> DataFrame:
    """Containers used, the fewest that could do, and the share of room that is filled."""
    used = packed.filter("size > 0").groupBy("container").agg(F.sum("size").alias("size"))
    return used.agg(
        F.count("*").alias("n_containers"), F.ceil(F.sum("size") / capacity).alias("n_least"), F.max("size").alias("largest"),
        F.round(F.sum("size") / (F.count("*") * capacity), 6).alias("fill"),
    )


def pack_check(packed: DataFrame, items: DataFrame, capacity: int = 1024, fill: float = 0.99) -> DataFrame:
    """packed, items(id, size), ids unique -> per item: every_token_once, whole (no more pieces than needed), fits, full.

    fits: none of the item's containers holds more than `capacity`, a gap or two pieces in one place; full: all containers
    together, less one, are filled to at least `fill`.
    """
    pieces = packed.filter("size > 0")
    w = Window.partitionBy("container").orderBy("offset")
    laid = pieces.withColumn("end", F.lag(F.col("offset") + F.col("size"), 1, 0).over(w)).groupBy("container").agg((F.bool_and(F.col("end") == F.col("offset")) & (F.sum("size") <= capacity)).alias("fits"), F.sum("size").alias("used"))
    total = laid.agg((F.sum("used") >= F.lit(fill) * capacity * (F.count("*") - 1)).alias("full"))
    each = packed.join(laid.select("container", "fits"), "container", "left").groupBy("id").agg(
        F.sum("size").alias("got"), F.count_if(F.col("size") > 0).alias("pieces"), F.bool_and(F.coalesce("fits", F.lit(True))).alias("fits"), (F.sum(F.when(F.col("size") > 0, F.col("first"))).alias("firsts"))
    )
    n = F.ceil(F.col("want") / capacity)
    wanted = items.select("id", F.greatest(F.coalesce("size", F.lit(0)), F.lit(0)).cast("bigint").alias("want"))
    both = wanted.join(each, "id", "left").crossJoin(F.broadcast(total))
    once = (F.col("got") == F.col("want")) & (F.coalesce("firsts", F.lit(0)) == F.lit(capacity) * n * (n - 1) / 2)
    return both.select("id", F.coalesce(once, F.lit(False)).alias("every_token_once"), F.coalesce(F.col("pieces") == n, F.lit(False)).alias("whole"), F.coalesce("fits", F.lit(False)).alias("fits"), F.coalesce("full", F.lit(True)).alias("full"))
