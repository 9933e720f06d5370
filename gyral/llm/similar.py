"""Most similar vectors for every vector: inverted lists scanned by adaptive dimension sampling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gyral.llm.vectors import DIM, FIT_ROWS, SEED, centre, decode, fit_sample, prepare, unit
from gyral.plans.skew import split_join
from gyral.session import cut

K = 10
#: Rows of a list on average if each row were in one list only; lists at most; lists each row is put into.
LIST_ROWS, MAX_LISTS, PROBES = 200, 262_144, 6
#: Lists lie in about as many cells as a cell has lists. Cells whose lists a row is compared with, fitted rows for each cell,
#: and for each list (at most FIT_ROWS in one cell).
CELLS, CELL_SAMPLE, LIST_SAMPLE = 12, 64, 16
#: A list with more rows is scanned in tiles of so many queries by so many targets.
PART_ROWS = 4_096
#: Dimensions after which a candidate's partial distance is tested, and the tests' strictness.
BLOCKS, EPSILON = (48, 96), 2.1


def fit_lists(sample: np.ndarray, lists: int, mean: np.ndarray, rounds: int = 3) -> np.ndarray:
    """Spherical k-means on the residuals of a bounded sample, started from its own rows."""
    rest = unit((sample - mean).astype(np.float64))
    centroids = rest[np.random.default_rng(1).permutation(len(rest))[:lists]].copy() if len(rest) else np.zeros((1, len(mean)), np.float32)
    for _ in range(rounds):
        if not len(rest):
            break
        near = np.concatenate([(part @ centroids.T).argmax(1) for part in np.array_split(rest, len(rest) // 4096 + 1)])
        order = np.argsort(near, kind="stable")
        at = np.flatnonzero(np.r_[True, np.diff(near[order]) > 0])
        centroids[near[order][at]] = unit(np.add.reduceat(rest[order], at).astype(np.float64))
    return centroids


class Lists:
    """Inverted lists in two levels: cells, and in each cell its lists, as unit vectors of the residual."""

    def __init__(self, mean: np.ndarray, cells: np.ndarray, starts: np.ndarray, lists: np.ndarray) -> None:
        """starts: the first list of each cell and, last, the number of lists; lists: float16, cell after cell."""
        self.mean, self.cells, self.starts, self.lists, self.near = mean, cells, starts, lists, CELLS

    def cell(self, rest: np.ndarray) -> np.ndarray:
        return np.concatenate([(part @ self.cells.T).argmax(1) for part in np.array_split(rest, len(rest) // 4096 + 1)])

    def nearest(self, x: np.ndarray, probes: int) -> np.ndarray:
        """(rows, probes): the lists nearest to each vector among those of its CELLS nearest cells; -1 where there are fewer."""
        rest = (x - self.mean).astype(np.float32)
        score = rest @ self.cells.T
        near = np.argpartition(-score, self.near - 1, axis=1)[:, : self.near] if self.near < score.shape[1] else np.tile(np.arange(score.shape[1]), (len(x), 1))
        found, best = np.full((len(x), near.shape[1], probes), -1, np.int32), np.full((len(x), near.shape[1], probes), -np.inf, np.float32)
        order = np.argsort(near, axis=None, kind="stable")
        ends = np.cumsum(np.bincount(near.ravel(), minlength=len(self.cells)))
        for c, (a, b) in enumerate(zip(np.r_[0, ends[:-1]], ends)):
            row, place = np.divmod(order[a:b], near.shape[1])
            first, last = self.starts[c], self.starts[c + 1]
            if not len(row) or first == last:
                continue
            score = rest[row] @ self.lists[first:last].astype(np.float32).T
            n = min(probes, last - first)
            top = np.argpartition(-score, n - 1, axis=1)[:, :n]
            found[row, place, :n] = first + top
            best[row, place, :n] = np.take_along_axis(score, top, 1)
        found, best = found.reshape(len(x), -1), best.reshape(len(x), -1)
        top = np.argpartition(-best, probes - 1, axis=1)[:, :probes] if probes < best.shape[1] else np.tile(np.arange(best.shape[1]), (len(x), 1))
        return np.take_along_axis(found, top, 1)


def fit_two_levels(rows: DataFrame, total: int, dim: int) -> Lists:
    """Cells from a sample on the driver, then the lists of each cell from the cell's own sample, cell by cell in the tasks.

    Both samples are bounded and chosen by a hash of the id. Where rows lie densely there are more of the sample and so more
    lists, so that lists are about equally long; only the lists themselves, at most MAX_LISTS, reach the driver.
    """
    lists = int(min(MAX_LISTS, max(1, total // LIST_ROWS)))
    cells = max(1, round(lists**0.5))
    sample = fit_sample(rows, "id", min(FIT_ROWS, CELL_SAMPLE * cells), total, dim)
    mean = centre(sample, dim)
    lists_so_far = Lists(mean, fit_lists(sample, cells, mean), None, None)
    share = min(1.0, LIST_SAMPLE * lists / max(1, total))
    shared = rows.sparkSession.sparkContext.broadcast(lists_so_far)

    def celled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rest = unit(decode(batch.column(1).to_pylist(), dim)) - shared.value.mean
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.cell(rest).astype(np.int32))], ["id", "v", "cell"])

    def fit_cell(group: pd.DataFrame) -> pd.DataFrame:
        wanted = max(1, round(len(group) * lists / (share * total)))
        group = group.sort_values("id", kind="stable").iloc[:: -(-len(group) // FIT_ROWS)]
        own = fit_lists(unit(decode(group["v"], dim)), wanted, shared.value.mean)
        return pd.DataFrame({"cell": group["cell"].iloc[0], "list": [x.tobytes() for x in own.astype("<f2")]})

    some = rows.filter(F.pmod(F.xxhash64(F.lit(SEED + 1), "id"), F.lit(1_000_000)) < int(1_000_000 * share) + 1)
    fitted = some.select("id", "v").mapInArrow(celled, "id bigint, v binary, cell int").groupBy("cell").applyInPandas(fit_cell, "cell int, list binary").collect()
    fitted.sort(key=lambda r: (r[0], bytes(r[1])))
    starts = np.r_[0, np.cumsum(np.bincount([r[0] for r in fitted], minlength=len(lists_so_far.cells)))]
    return Lists(mean, lists_so_far.cells, starts, np.frombuffer(b"".join(bytes(r[1]) for r in fitted), "<f2").reshape(-1, dim))


def scan(ids: np.ndarray, files: np.ndarray, ints: np.ndarray, queries: np.ndarray, targets: np.ndarray, k: int, least: float) -> tuple[np.ndarray, ...]:
    """Within one list: for each query row the k best target rows of other files, as (row, row, cosine).

    Column blocks of the rotated vectors are added up one after the other; after each block a candidate is
    abandoned if its partial squared distance, scaled to all dimensions, exceeds what a pair at cosine `least`
    would show with the test's confidence. Survivors get their exact cosine from the stored integers.
    """
    norm = np.sqrt((ints * ints).sum(1))
    x = (ints / np.where(norm > 0, norm, 1)[:, None]).astype(np.float32)
    dim, far = x.shape[1], 2 - 2 * least
    blocks = [b for b in BLOCKS if b < dim]
    out = []
    first = blocks[0] if blocks else dim
    sq = (x[:, :first] ** 2).sum(1)
    for part in np.array_split(queries, len(queries) // 1024 + 1):
        if not len(part):
            continue
        dist = x[part, :first] @ x[targets, :first].T
        dist *= -2
        dist += sq[part][:, None]
        dist += sq[targets][None, :]
        i, j = np.nonzero(dist <= far * first / dim * (1 + EPSILON / np.sqrt(first)) ** 2 + 1e-6)
        so_far, i, j = dist[i, j], part[i], targets[j]
        keep = (i != j) & ((files[i] != files[j]) | (files[i] == 0))
        so_far, i, j = so_far[keep], i[keep], j[keep]
        for a, b in zip(blocks, [*blocks[1:], None]):
            if b is None:
                break
            so_far = so_far + ((x[i, a:b] - x[j, a:b]) ** 2).sum(1)
            keep = so_far <= far * b / dim * (1 + EPSILON / np.sqrt(b)) ** 2 + 1e-6
            so_far, i, j = so_far[keep], i[keep], j[keep]
        cos = np.empty(len(i))
        for s in range(0, len(i), 65_536):
            a, b = i[s : s + 65_536], j[s : s + 65_536]
            cos[s : s + 65_536] = (ints[a] * ints[b]).sum(1) / (norm[a] * norm[b])
        keep = cos >= least
        i, j, cos = i[keep], j[keep], cos[keep]
        order = np.lexsort((ids[j], -cos, i))
        i, j, cos = i[order], j[order], cos[order]
        if len(i):
            start = np.flatnonzero(np.r_[True, np.diff(i) > 0])
            rank = np.arange(len(i)) - np.repeat(start, np.diff(np.r_[start, len(i)]))
            out.append((i[rank < k], j[rank < k], cos[rank < k]))
    if not out:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    return tuple(np.concatenate(z) for z in zip(*out))


def neighbours(df: DataFrame, id_col: str, emb: str, file_col: str, k: int = K, least: float = 0.86, dim: int = DIM) -> DataFrame:
    """(a, b, cos): for every row with a valid vector the k most similar rows b of other files, cosine >= least.

    A null file differs from every file; rows without a valid vector take no part; ties go to the smaller id;
    an empty table gives no rows; further columns, whatever their names, are not read. Approximate in one point
    only: a pair is seen if its rows share one of their PROBES nearest lists (recall in the README). Rows with exactly
    equal vectors beyond 2k of a group (k per file) are not searched anew: they take over the list of a row of their
    vector and file, or the group's first rows at cosine 1, which is what a search would give them.
    """
    spark = df.sparkSession
    mine = df.select(F.col(id_col).alias("id"), F.when(F.col(file_col).isNull(), F.lit(0)).otherwise(F.xxhash64(file_col)).alias("file"), F.col(emb).alias("emb"))
    rows = cut(prepare(mine, "emb", dim).select("id", "file", "v", F.xxhash64("v").alias("code")), "p1-rows")
    total = rows.count()
    own_file = F.when(F.col("file") == 0, F.col("id")).otherwise(F.col("file"))
    crowd = rows.groupBy("code").count().filter(F.col("count") > 2 * k).select("code")
    in_crowd = split_join(rows.select("id", "code", "file"), crowd, "code", "left_semi")
    by_file = Window.partitionBy("code", own_file).orderBy("id")
    by_code = Window.partitionBy("code").orderBy("id")
    chosen = in_crowd.withColumn("n", F.row_number().over(by_file)).filter(F.col("n") <= k).withColumn("m", F.row_number().over(by_code)).filter(F.col("m") <= 2 * k)
    chosen = cut(chosen.select("id", "code", "file", "m"), "p1-crowd")
    crowded = not chosen.isEmpty()
    searched = rows
    if crowded:
        others = cut(in_crowd.join(chosen.select("id"), "id", "left_anti"), "p1-others")
        searched = rows.join(others.select("id"), "id", "left_anti")
    lists = spark.sparkContext.broadcast(fit_two_levels(searched, total, dim))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            near = lists.value.nearest(unit(decode(batch.column(2).to_pylist(), dim)), PROBES)
            offsets = np.r_[0, np.cumsum((near >= 0).sum(1))].astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(near[near >= 0]))], ["id", "file", "v", "lists"])

    assigned = searched.select("id", "file", "v").mapInArrow(assign, "id bigint, file bigint, v binary, lists array<int>")
    # the lists' true lengths, at most MAX_LISTS numbers; only longer ones than a tile are named
    lengths = assigned.select(F.explode("lists").alias("list")).groupBy("list").count().filter(F.col("count") > PART_ROWS)
    tiled = {r[0]: -(-r[1] // PART_ROWS) for r in lengths.collect()}
    spread = assigned.select("id", "file", "v", F.explode("lists").alias("list"))
    once = lambda df: df.select("list", F.lit(0).alias("q"), F.lit(0).alias("t"), "id", "file", "v", F.lit(True).alias("query"), F.lit(True).alias("target"))
    if not tiled:
        spread = once(spread)
    else:
        parts = spark.createDataFrame(sorted(tiled.items()), "list int, parts int")
        spread = spread.join(F.broadcast(parts), "list", "left")
        home = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
        tile = lambda q, t: F.struct(q.alias("q"), t.alias("t"), (q == F.col("home")).alias("query"), (t == F.col("home")).alias("target"))
        others_of = F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: p != F.col("home"))
        tiles = F.concat(F.array(tile(F.col("home"), F.col("home"))), F.transform(others_of, lambda p: tile(F.col("home"), p)), F.transform(others_of, lambda p: tile(p, F.col("home"))))
        long = spread.filter("parts is not null").withColumn("home", home).select("list", "id", "file", "v", F.explode(tiles).alias("z"))
        spread = once(spread.filter("parts is null")).unionByName(long.select("list", "z.q", "z.t", "id", "file", "v", "z.query", "z.target"))

    def search(group: pd.DataFrame) -> pd.DataFrame:
        ids = group["id"].to_numpy()
        i, j, cos = scan(ids, group["file"].to_numpy(), decode(group["v"], dim), np.flatnonzero(group["query"].to_numpy()), np.flatnonzero(group["target"].to_numpy()), k, least)
        return pd.DataFrame({"a": ids[i], "b": ids[j], "cos": cos})

    partial = spread.groupBy("list", "q", "t").applyInPandas(search, "a bigint, b bigint, cos double")
    best = (
        partial.groupBy("a")
        .agg(F.slice(F.array_sort(F.collect_set(F.struct((-F.col("cos")).alias("far"), F.col("b").alias("b")))), 1, k).alias("best"))
        .select("a", F.explode("best").alias("z"))
        .select("a", F.col("z.b").alias("b"), (-F.col("z.far")).alias("cos"))
    )
    if not crowded:
        return best
    best = cut(best, "p1-best")
    models = chosen.groupBy("code", own_file.alias("own")).agg(F.min("id").alias("model"))
    missing = others.withColumn("own", own_file).withColumn("pair", F.xxhash64("code", "own"))
    model = split_join(missing, models.select(F.xxhash64("code", "own").alias("pair"), "model"), "pair", "left").select("id", "code", "model")
    lists_of = best.groupBy("a").agg(F.collect_list(F.struct("b", "cos")).alias("list")).withColumnRenamed("a", "model")
    heads = chosen.groupBy("code").agg(F.array_sort(F.collect_list(F.struct("m", "id"))).alias("list"))
    taken = split_join(model.filter(F.col("model").isNotNull()), lists_of, "model", "inner").select("id", F.explode("list").alias("z")).select(F.col("id").alias("a"), F.col("z.b").alias("b"), F.col("z.cos").alias("cos"))
    first = split_join(model.filter(F.col("model").isNull()), heads, "code", "inner").select("id", F.explode(F.slice("list", 1, k)).alias("z")).select(F.col("id").alias("a"), F.col("z.id").alias("b"), F.lit(1.0).alias("cos"))
    return best.unionByName(taken).unionByName(first)


def neighbour_pairs(near: DataFrame) -> DataFrame:
    """(a_id, b_id), smaller id first, each pair once."""
    return near.select(F.least("a", "b").alias("a_id"), F.greatest("a", "b").alias("b_id")).distinct()
