"""Splits that keep related records together: components, then grouped iterative stratification."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gyral.operators.components import components
from gyral.plans.ranks import group_rank
from gyral.plans.skew import split_join
from gyral.session import cut, scratch_dir

#: Placements written at once.
CHUNK = 20_000


def related(rows: DataFrame, links: DataFrame) -> DataFrame:
    """rows(id, subject), links(a, b) of subjects -> (id, root): the component of each row's subject.

    Rows without a subject get a null root and are related to nothing. Links of subjects that no row has still
    join others; repeated and reversed links don't matter.
    """
    roots = components(links).withColumnRenamed("node", "subject")
    named = rows.filter(F.col("subject").isNotNull())
    found = split_join(named, roots, "subject", "left").select("id", F.coalesce("root", "subject").alias("root"))
    return found.unionByName(rows.filter(F.col("subject").isNull()).select("id", F.lit(None).cast("string").alias("root")))


def first_of_group(groups: DataFrame) -> DataFrame:
    """groups(id, root) -> (first_id, id): the smallest id of each group with every other id of it."""
    groups = cut(groups.filter(F.col("root").isNotNull()), "p3-groups")
    first = groups.groupBy("root").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id")).filter("first_id < last_id").drop("last_id")
    return split_join(groups, first, "root", "inner").filter("id <> first_id").select("first_id", "id").distinct()


def stratified(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows(id, root, label), plan(split_name, target_frac) -> (id, split_name); whole components stay in one split.

    Grouped iterative stratification: every component has a vector of rows per label and is ranked by its rarest
    label. Labels are taken rarest outstanding first; of each label the components go, largest first, one after the
    other to the split that most needs the label, then rows as such; each placement lowers that split's needs by the
    component's whole vector. Ties go to the split named first. Rows with a null root are components of their own, a
    null label is a label. Fractions are scaled to sum to 1; an empty plan gives null splits.

    Components of equal vectors are interchangeable, so the driver reads each vector once with the number of components
    that have it, shares these out as one by one would, and holds nothing but the splits' needs: vectors come in
    order, a stream, and placements go out in chunks. Which of equal components goes where is decided by a hash, over
    range partitions. Labels are meant to be few (at most some dozens).
    """
    rows = rows.select("id", F.coalesce("root", F.concat(F.lit("row "), F.col("id").cast("string"))).alias("root"), F.coalesce("label", F.lit("")).alias("label"))
    wanted = sorted((r[0], float(r[1])) for r in plan.filter("split_name is not null and target_frac > 0").groupBy("split_name").agg(F.sum("target_frac")).collect())
    rows = cut(rows, "p3-labelled")
    by_label = cut(rows.groupBy("root", "label").count(), "p3-vectors")
    totals = {r[0]: r[1] for r in by_label.groupBy("label").agg(F.sum("count")).collect()}
    if not wanted or not totals:
        return rows.select("id", F.lit(None).cast("string").alias("split_name"))
    order = sorted(totals, key=lambda x: (totals[x], x))
    place = F.array_position(F.array(*map(F.lit, order)), F.col("label")).cast("int")
    vector = F.array_sort(F.collect_list(F.struct(place.alias("place"), F.col("count").alias("n"))))
    components_ = by_label.groupBy("root").agg(F.sum("count").alias("n"), F.min(place).alias("key"), vector.alias("vector"))
    kind = F.concat_ws(" ", F.transform("vector", lambda s: F.concat_ws(":", s["place"], s["n"])))
    components_ = cut(components_.select("root", "n", "key", kind.alias("kind")), "p3-components")
    kinds = cut(components_.groupBy("key", "n", "kind").agg(F.count("*").alias("many")), "p3-kinds")
    spark, at = rows.sparkSession, scratch_dir(rows.sparkSession, "p3-placed")
    chunk: list = []

    def write() -> None:
        if chunk:
            spark.createDataFrame(chunk, "kind string, low bigint, high bigint, split_name string").coalesce(1).write.mode("append").parquet(at)
            chunk.clear()

    for placed in _place(order, totals, wanted, lambda key: kinds.filter(F.col("key") == key).orderBy(F.desc("n"), "kind").select("kind", "many").toLocalIterator(), {r[0] for r in kinds.select("key").distinct().collect()}):
        chunk.append(placed)
        if len(chunk) >= CHUNK:
            write()
    write()
    ranges = spark.read.schema("kind string, low bigint, high bigint, split_name string").parquet(at)
    ranked = group_rank(components_.select("kind", "root", F.xxhash64(F.lit(3), "root").alias("draw")), "kind", "draw", "root", name="at", size="size")
    within = (F.col("at") >= F.col("low")) & (F.col("at") < F.col("high"))
    placed = ranked.join(ranges, "kind").filter(within).select("root", "split_name")
    return split_join(rows, placed, "root", "inner").select("id", "split_name")


def _place(order: list, totals: dict, wanted: list, read, keys: set) -> Iterator[tuple[str, int, int, str]]:
    """(kind, low, high, split): which of the components of a kind, in their order, go to which split."""
    whole = sum(f for _, f in wanted)
    need = {s: {x: f / whole * totals[x] for x in order} for s, f in wanted}
    left, todo = dict(totals), {order[k - 1]: k for k in keys}
    while todo:
        label = min(todo, key=lambda x: (left[x], x))
        for kind, many in read(todo.pop(label)):
            vector = {order[int(p) - 1]: int(n) for p, n in (x.split(":") for x in kind.split(" "))}
            at = 0
            for split, n in shared_out(many, vector[label], sum(vector.values()), {s: (v[label], sum(v.values())) for s, v in need.items()}).items():
                if n:
                    yield kind, at, at + n, split
                    at += n
                    for x, c in vector.items():
                        need[split][x] -= c * n
            for x, c in vector.items():
                left[x] -= c * many


def shared_out(many: int, size: int, rows: int, need: dict[str, tuple[float, float]]) -> dict[str, int]:
    """How many of `many` equal components, of `size` rows of a label and `rows` in all, each split gets.

    As if one after the other went to the split that then needs the label most (then rows, then the first): all splits
    are lowered to a common level at once, and only the last few are given out singly.
    """
    taken = dict.fromkeys(need, 0)
    low, high = min(v for v, _ in need.values()) - size * many, max(v for v, _ in need.values())
    fits = lambda level: sum(max(0, int((v - level) // size)) for v, _ in need.values())
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (low, middle) if fits(middle) <= many else (middle, high)
    if fits(high) <= many:
        taken = {s: max(0, int((v - high) // size)) for s, (v, _) in need.items()}
    for _ in range(many - sum(taken.values())):
        split = max(need, key=lambda s: (need[s][0] - taken[s] * size, need[s][1] - taken[s] * rows))
        taken[split] += 1
    return taken


def split_check(groups: DataFrame, placed: DataFrame, plan: DataFrame) -> DataFrame:
    """groups(id, root, label), placed(id, split_name) -> per split: rows_near, labels_near, torn components.

    near: the split's rows, and its rows of every label, differ from the target by at most twice the largest component,
    or by a thousandth of the rows in question.
    """
    all_ = cut(groups.join(placed, "id").select("root", "label", "split_name"), "p3-check")
    torn = all_.filter("root is not null").groupBy("root").agg(F.count_distinct("split_name").alias("n")).agg(F.count_if(F.col("n") > 1).alias("torn"))
    largest = all_.filter("root is not null").groupBy("root").count().agg(F.coalesce(F.max("count"), F.lit(1)).alias("largest"))
    share = F.col("target_frac") / F.sum("target_frac").over(Window.partitionBy(F.lit(0)))
    wanted = plan.groupBy("split_name").agg(F.sum("target_frac").alias("target_frac")).select("split_name", share.alias("share"))
    labels = all_.groupBy("label").count().withColumnRenamed("count", "whole")
    # splits times labels: two tiny tables
    cells = labels.crossJoin(F.broadcast(wanted)).join(all_.groupBy("label", "split_name").count(), ["label", "split_name"], "left").crossJoin(F.broadcast(largest)).crossJoin(F.broadcast(torn))
    near = lambda n, whole: F.abs(n - F.col("share") * whole) <= F.greatest(2 * F.col("largest"), whole * 0.001)
    got = F.coalesce("count", F.lit(0))
    return cells.groupBy("split_name", "share", "largest", "torn").agg(F.bool_and(near(got, F.col("whole"))).alias("labels_near"), F.sum(got).alias("got"), F.sum("whole").alias("whole")).select(
        "split_name", near(F.col("got"), F.col("whole")).alias("rows_near"), "labels_near", "torn"
    )
