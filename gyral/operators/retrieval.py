"""Exact shortlists by cosine, reranking by masked error, merging and pasting."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gyral.functions.vectors import doubles, mse, z_score

#: Queries that are sent to all tasks at once; a larger query set is worked off in blocks of this size.
BLOCK_ROWS = 4_096


def _usual_length(vectors: DataFrame, vec: str) -> int:
    """The length most vectors have; ties go to the shorter; 0 without vectors."""
    sizes = vectors.filter(F.col(vec).isNotNull()).groupBy(F.size(vec).alias("n")).count().orderBy(F.desc("count"), "n").first()
    return sizes[0] if sizes else 0


def _best(scores: np.ndarray, ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's n highest finite scores, ties by the column's id: only what can be among them is sorted."""
    low = np.partition(scores, -n, axis=1)[:, -n][:, None] if scores.shape[1] > n else np.full((len(scores), 1), -np.inf)
    i, j = np.nonzero((scores >= low) & np.isfinite(scores))
    order = np.lexsort((ids[j], -scores[i, j], i))
    i, j = i[order], j[order]
    rank = np.arange(len(i)) - np.searchsorted(i, i)
    return i[rank < n], j[rank < n]


def shortlist(queries: DataFrame, donors: DataFrame, n: int, first: int = 1, dims: int | None = None) -> DataFrame:
    """(query, donor, cos, rank): for each query the n donors of other subjects with the highest cosine.

    queries and donors have (id, subject, vec). Only dimensions first .. first+dims-1 count; without dims the length most
    donors have. Ties go to the smaller id; null vectors, zero ones, ones that are not finite and ones of another length
    have no cosine and no rows; a query without donors has none either. Queries come in blocks against one pass of the
    donors each; every task keeps n donors a query before anything is shuffled.
    """
    spark = donors.sparkSession
    width = dims or _usual_length(donors, "vec")
    part = lambda df: df.filter(F.col("vec").isNotNull()).select("id", "subject", doubles(F.slice("vec", first, dims) if dims else F.col("vec")).alias("vec")).filter(F.size("vec") == width)
    queries = part(queries)
    blocks = max(1, -(-queries.count() // BLOCK_ROWS))
    found = None
    for b in range(blocks):
        rows = queries.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).collect()
        rows = [r for r in rows if np.isfinite(np.array(r["vec"], float)).all() and np.any(r["vec"])]
        shared = spark.sparkContext.broadcast((np.array([r["id"] for r in rows], np.int64), np.array([r["subject"] for r in rows]), np.array([r["vec"] for r in rows], float).reshape(len(rows), width)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, subjects, q = shared.value
            q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
            for batch in batches:
                if not batch.num_rows or not len(q):
                    continue
                d = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
                norm = np.linalg.norm(d, axis=1)
                at = np.flatnonzero(np.isfinite(norm) & (norm > 0))
                d = d[at] / norm[at][:, None]
                donor = batch.column(0).to_numpy(zero_copy_only=False)[at]
                cos = np.round(q @ d.T, 12)
                cos[subjects[:, None] == batch.column(1).to_numpy(zero_copy_only=False)[at][None, :]] = -np.inf
                i, j = _best(cos, donor, n)
                yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(donor[j]), pa.array(cos[i, j])], ["query", "donor", "cos"])

        one = part(donors).mapInArrow(run, "query bigint, donor bigint, cos double")
        found = one if found is None else found.unionByName(one)
    w = Window.partitionBy("query").orderBy(F.desc("cos"), "donor")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def built_index(vectors: DataFrame, path: str, overwrite: bool = False) -> DataFrame:
    """vectors(id, subject, vec) as an index table at path, z-scored; an index that is there is used as it is.

    Null vectors are left out. Read from the table, so that building and asking need not share a session.
    """
    spark = vectors.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if overwrite or not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        vectors.filter(F.col("vec").isNotNull()).select("id", "subject", z_score(doubles(F.col("vec"))).alias("vec")).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def rerank(short: DataFrame, queries: DataFrame, donors: DataFrame, k: int, visible: slice) -> DataFrame:
    """The k shortlisted donors of each query with the least squared error over the visible dimensions.

    Adds mse, place (1 is best; ties by donor) and the donor's vector as donor_vec. Fewer than k donors stay as they are.
    """
    cutv = lambda c: doubles(F.slice(c, visible.start + 1, visible.stop - visible.start))
    q = queries.select(F.col("id").alias("query"), F.col("vec").alias("query_vec"))
    d = donors.select(F.col("id").alias("donor"), F.col("vec").alias("donor_vec"))
    both = short.join(q, "query").join(d, "donor").withColumn("mse", mse(cutv("query_vec"), cutv("donor_vec")))
    w = Window.partitionBy("query").orderBy(F.round("mse", 12), "donor")
    return both.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def merge(ranked: DataFrame, by: str = "query", vec: str = "donor_vec") -> DataFrame:
    """(query, dim, v): element-wise mean of the vectors of each query; dim counts from 0."""
    return ranked.select(by, F.posexplode(doubles(F.col(vec))).alias("dim", "v")).groupBy(by, "dim").agg(F.avg("v").alias("v"))


def paste(target: Column, donor: Column, inside: Column, scale: Column | float = 1.0) -> Column:
    """Donor times scale where inside, the target elsewhere."""
    return F.when(inside, donor * scale).otherwise(target)


def similar_to_any(pool: DataFrame, exclude: DataFrame, vec: str) -> DataFrame:
    """pool(id, vec) -> (id, best): each row's highest dot product with a row of exclude(vec), null if there is none.

    Vectors of another length than most excluded ones have no product, nor have vectors that are not finite. The distinct
    excluded vectors go to the tasks in blocks chosen by their hash; one number per pool row and block is shuffled.
    """
    spark = pool.sparkSession
    width = _usual_length(exclude, vec)
    exclude = exclude.filter(F.size(vec) == width).select(doubles(F.col(vec)).alias("v")).distinct()
    blocks = max(1, -(-exclude.count() // BLOCK_ROWS))
    parts = None
    for b in range(blocks):
        rows = exclude.filter(F.pmod(F.xxhash64("v"), F.lit(blocks)) == b).collect()
        rows = np.array([r["v"] for r in rows], float).reshape(len(rows), width)
        shared = spark.sparkContext.broadcast(rows[np.isfinite(rows).all(1)])

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            e = shared.value
            for batch in batches:
                if not len(e) or not batch.num_rows:
                    continue
                v = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
                at = np.flatnonzero(np.isfinite(v).all(1))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array((v[at] @ e.T).max(1))], ["id", "best"])

        one = pool.filter(F.size(vec) == width).select("id", doubles(F.col(vec))).mapInArrow(run, "id bigint, best double")
        parts = one if parts is None else parts.unionByName(one)
    return pool.select("id").join(parts.groupBy("id").agg(F.max("best").alias("best")), "id", "left")
