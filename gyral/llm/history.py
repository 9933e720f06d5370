"""Deduplication of new batches against everything accepted before, on content-defined chunks."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gyral.llm.signs import kept_letters, letters, residuals, rest_cosine
from gyral.llm.vectors import DIM, SEED, centre, fit_sample, prepare, verified
from gyral.plans.skew import split_join, spread_join
from gyral.session import cut, discard, release

#: One letter in BOUNDARY begins a chunk. Share of the pairs at exactly the least cosine that may share no chunk, letters at
#: most, and simulated pairs from which the number of letters follows.
BOUNDARY, MISS, MOST_LETTERS, SIMULATED = 3, 0.0025, 1024, 65_536
#: Rows the history is made for unless said otherwise: chunks get a letter longer beyond, and strings longer with them.
CAPACITY = 2**26
#: Bits of the sketch that a pair sharing a chunk is held to, and the share of pairs at the least cosine it may lose.
SKETCH, SKETCH_MISS = 64, 1e-6
#: Share of the fitted rows that may lie nearer to the template than the strings are made for, and the least such distance.
NEAREST, LEAST_REST = 0.001, 0.5
#: Buckets of up to SMALL rows are compared whole. In larger ones all rows are held to the first HEADS undecided rows;
#: a further wave, of what is then still undecided, takes four times as many.
SMALL, HEADS = 64, 4
FIT = 16_384
#: Up to so many chunk keys of a batch are broadcast, so that the history is read but not shuffled.
BROADCAST_KEYS = 2_000_000
#: Up to so many heads of large buckets are broadcast, so that the buckets are read but not shuffled once more.
BROADCAST_HEADS = 500_000
#: Up to so many candidate pairs are broadcast to fetch their vectors.
BROADCAST_PAIRS = 500_000
#: Vectors chunked at once.
BLOCK = 8_192


def shortest_chunk(rows: int, dim: int) -> int:
    """Letters of a chunk for a history of so many rows: it then meets a few strangers at most."""
    return max(1, math.ceil((math.log2(max(2, rows)) - 2) / math.log2(2 * dim)))


def chunks(text: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Content-defined chunks of each row's string of letters, as (row, hash).

    A chunk begins where the rolling hash of the letter read last is 0 modulo BOUNDARY, and takes in `least` letters; chunks
    may overlap. Its hash takes in the letters and where they stand.
    """
    each = _mix(text.astype(np.uint64) | (np.arange(text.shape[1], dtype=np.uint64) << np.uint64(16)))
    starts = max(0, text.shape[1] - least + 1)
    who, at = np.nonzero(each[:, :starts] % np.uint64(BOUNDARY) == 0)
    key = np.zeros(len(who), np.uint64)
    for k in range(least):
        key = _mix(key + each[who, at + k])
    return who, key.view(np.int64)


@cache
def missed(least: int, kept: float, count: int) -> float:
    """Share of the pairs with that share of letters in common that share no chunk in `count` letters, by simulation."""
    rng, runs = np.random.default_rng(SEED), np.zeros(SIMULATED, np.int64)
    opens, found = np.zeros((least, SIMULATED), bool), np.zeros(SIMULATED, bool)
    for i in range(count):
        same = rng.random(SIMULATED) < kept
        runs = np.where(same, runs + 1, 0)
        opens[i % least] = rng.random(SIMULATED) < 1 / BOUNDARY
        found |= (runs >= least) & opens[(i + 1) % least]
    return float(1 - found.mean())


def layout(rows: int, cosine: float, dim: int) -> tuple[int, int]:
    """(letters of a chunk, letters of a string) for a history of so many rows: all but MISS of the pairs share a chunk at every size."""
    least, kept = shortest_chunk(rows, dim), kept_letters(round(cosine, 3), dim)
    while least > 1 and missed(least, kept, MOST_LETTERS) > MISS:
        least -= 1
    return least, next((n for n in range(8, MOST_LETTERS, 8) if missed(least, kept, n) <= MISS), MOST_LETTERS)


def sketch_limit(cosine: float) -> int:
    """Differing bits up to which a sketch is kept: beyond are SKETCH_MISS of the pairs with that cosine at most."""
    flip = math.acos(cosine) / math.pi
    each = [math.comb(SKETCH, k) * flip**k * (1 - flip) ** (SKETCH - k) for k in range(SKETCH + 1)]
    return next(k for k in range(SKETCH + 1) if sum(each[k + 1 :]) <= SKETCH_MISS)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit numbers (fixed values)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunk_table(prepared: DataFrame, mean: np.ndarray, least: int, count: int, dim: int = DIM) -> DataFrame:
    """(batch, id, file, v, sketch, keys): each vector with its chunks' hashes; the sketch has signs of bases of its own."""
    shared = prepared.sparkSession.sparkContext.broadcast(mean)
    more = -(-SKETCH // dim)
    names = ["batch", "id", "file", "v", "sketch", "keys"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from gyral.llm.vectors import rotation

        for whole in batches:
            for batch in (whole.slice(at, BLOCK) for at in range(0, whole.num_rows, BLOCK)):
                rest = residuals(batch.column(3).to_pylist(), shared.value, dim)
                who, key = chunks(letters(rest, count), least)
                signs = np.hstack([rest @ rotation(dim, count + 1 + s).T > 0 for s in range(more)])
                sketch = np.packbits(signs[:, :SKETCH], axis=1).view(np.int64)[:, 0]
                ends = np.concatenate([[0], np.cumsum(np.bincount(who, minlength=len(rest)))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sketch), pa.ListArray.from_arrays(pa.array(ends), pa.array(key))], names)

    return prepared.select(*names[:4]).mapInArrow(run, "batch bigint, id bigint, file string, v binary, sketch bigint, keys array<bigint>")


def buckets_of(table: DataFrame) -> DataFrame:
    """(batch, id, key, sketch): one row per chunk, and one, without sketch, for the file."""
    parts = table.select("batch", "id", F.explode("keys").alias("key"), "sketch")
    files = table.filter(F.col("file").isNotNull()).select("batch", "id", F.xxhash64(F.lit("file"), "file").alias("key"), F.lit(None).cast("bigint").alias("sketch"))
    return parts.unionByName(files)


def _differ(lo: str, hi: str) -> Column:
    """Bits in which two sketches differ; 0 for files, which have none."""
    return F.coalesce(F.bit_count(F.col(lo).bitwiseXOR(F.col(hi))), F.lit(0))


class DedupHistory:
    """Everything accepted so far, in a folder that only grows.

    `accepted` (batch, id, file, v, sketch, keys) is the chunk table: its keys say which accepted rows hold a chunk. `rejected`
    (batch, id), a folder a call, and `template`, one row, lie beside it. process() checks a new batch against them and appends what it
    accepts; old rows are never chunked, shuffled or compared among themselves again: a batch's keys go to the
    history, and only vectors of rows that share enough with a new one are fetched.
    """

    def __init__(self, spark: SparkSession, folder: str, dim: int = DIM, capacity: int = CAPACITY) -> None:
        """capacity: rows the history is meant to reach, which sets the chunks' length and number but not the recall."""
        self.spark, self.folder, self.dim, self.capacity, self._template = spark, folder.rstrip("/"), dim, capacity, None

    def read(self, name: str) -> DataFrame | None:
        """The history's table of that name; None before anything was written to it."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        there = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.parquet(f"{self.folder}/{name}") if there else None

    def process(self, batch: DataFrame, least: float = 0.98, keep: bool = True) -> DataFrame:
        """batch(batch, id, file, emb) -> (batch, id): the rows to reject, the others are accepted.

        Rows are judged in the order of (batch, id), so one call may hold many batches. A row is rejected if it has
        cosine `least` or more to an accepted row, or the file of one. A null file is no file; rows without a valid
        vector take no part; a null batch comes first; an id that is repeated counts once and is rejected if one of its
        rows is; an empty batch rejects nothing. Each id must be new to the history. Of the pairs at exactly `least` all
        but MISS are found (more of nearer ones), whatever the history's size; the strings are made for the first
        batch's `least`, so a lower one later is an error.
        """
        return self.judge(self.prepared(batch), least, keep)

    def prepared(self, batch: DataFrame) -> DataFrame:
        """batch(batch, id, file, emb) -> (batch, id, file, v): its rows with a valid vector, as judge() takes them."""
        return prepare(batch.select(F.coalesce("batch", F.lit(-(2**62))).alias("batch"), "id", "file", "emb"), "emb", self.dim).drop("code")

    def _fitted(self, rows: DataFrame, least: float, keep: bool) -> tuple | None:
        """(mean, letters of a chunk, letters, sketch limit, least), from the first batch that has rows."""
        if self._template is None:
            kept = self.read("template")
            if kept is not None:
                self._template = tuple(kept.first())
        if self._template is not None:
            return self._template
        total = rows.count()
        if not total:
            return None
        sample = fit_sample(rows, "id", FIT, total, self.dim)
        mean = centre(sample, self.dim).astype(np.float64)
        rest = float(np.quantile(np.linalg.norm(sample - mean, axis=1), NEAREST))
        if rest < LEAST_REST:  # letters of rows about as near to the template as to each other say nothing
            mean, rest = np.zeros(self.dim), 1.0
        near = rest_cosine(rest, least)
        made = (mean.tolist(), *layout(self.capacity, near, self.dim), sketch_limit(near), least)
        if keep:
            self.spark.createDataFrame([made], "mean array<double>, least int, count int, limit int, cosine double").coalesce(1).write.parquet(f"{self.folder}/template")
            self._template = made
        return made

    def judge(self, prepared: DataFrame, least: float = 0.98, keep: bool = True) -> DataFrame:
        """process() for rows that prepared() has made."""
        own = cut(prepared, "p2-rows") if self._template is None else None
        rows = prepared if own is None else own
        made = self._fitted(rows, least, keep)
        if made is None:
            return rows.select("batch", "id").limit(0)
        mean, shortest, count, limit, made_for = made
        if least < made_for:
            raise ValueError(f"the history is made for cosines of {made_for} and more, not {least}")
        table = cut(chunk_table(rows, np.array(mean), shortest, count, self.dim), "p2-chunks")
        old = self.read("accepted")
        met = None if old is None else self._against(table, old, limit)
        rejected = self._waves(table, met, old, least, limit)
        verdict = table.select("batch", "id").join(rejected, "id", "left_semi").distinct()
        if keep:
            at = f"{self.folder}/rejected/call={uuid.uuid4().hex}"
            verdict.write.parquet(at)
            verdict = self.spark.read.schema("batch bigint, id bigint").parquet(at)
            table.join(verdict, "id", "left_anti").write.mode("append").parquet(f"{self.folder}/accepted")
        else:
            verdict = cut(verdict, "p2-verdict")
        discard(own, table)
        release(self.spark)
        return verdict.select(F.when(F.col("batch") > -(2**62), F.col("batch")).alias("batch"), "id")

    def _against(self, table: DataFrame, old: DataFrame, limit: int) -> DataFrame:
        """(lo, hi, sure, shared): accepted rows lo that share chunks, or the file, with new rows hi."""
        new = buckets_of(table).select("key", F.col("id").alias("hi"), "sketch")
        many = table.agg(F.sum(F.size("keys") + 1)).first()[0] or 0
        # a file's key meets a file's key only; it has no sketch on the new side
        held = F.explode(F.concat("keys", F.when(F.col("file").isNull(), F.array().cast("array<bigint>")).otherwise(F.array(F.xxhash64(F.lit("file"), "file")))))
        there = old.select(F.col("id").alias("lo"), F.col("sketch").alias("other"), held.alias("key"))
        both = there.join(F.broadcast(new), "key") if many <= BROADCAST_KEYS else spread_join(there, new, "key")
        return both.filter((_differ("sketch", "other") <= limit) & (F.col("lo") != F.col("hi"))).select("lo", "hi", F.col("sketch").isNull().alias("sure"))

    def _waves(self, table: DataFrame, met: DataFrame | None, old: DataFrame | None, least: float, limit: int) -> DataFrame:
        """Ids of new rows that repeat an accepted row, old or new; met has their candidates among the old.

        In waves: the rows of a large bucket are held to its first undecided rows only, so work stays linear in the
        bucket's size; a row is accepted once it is such a head in all its large buckets and no undecided earlier row
        repeats it. What is neither accepted nor rejected goes to the next wave with more heads.
        """
        buckets, heads, rejected = buckets_of(table), HEADS, None
        while True:
            most = max(SMALL, heads)
            row = F.struct("batch", "id", "sketch")
            ranked = buckets.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("batch", "id")))
            first = ranked.filter(F.col("n") <= most + 1).groupBy("key").agg(F.array_sort(F.collect_list(row)).alias("heads")).filter(F.size("heads") > 1)
            first = cut(first.select("key", "heads", (F.size("heads") > most).alias("large")), "p2-heads")
            large = first.filter("large").select("key", F.slice("heads", 1, heads).alias("heads"))
            n_large = large.count()
            # small buckets are whole in `heads`
            sides = first.filter(~F.col("large")).select("heads", F.explode("heads").alias("row"))
            late = None
            if n_large:
                in_large = buckets.join(F.broadcast(large), "key") if n_large * heads <= BROADCAST_HEADS else split_join(buckets, large, "key", "inner")
                sides = sides.unionByName(in_large.select("heads", row.alias("row")))
                last = F.element_at("heads", -1)
                late = in_large.filter(F.struct("batch", "id") > F.struct(last["batch"], last["id"])).select("id").distinct()
            pairs = (
                sides.select("row", F.explode("heads").alias("head"))
                .filter((F.struct("head.batch", "head.id") < F.struct("row.batch", "row.id")) & (F.col("head.id") != F.col("row.id")) & (_differ("head.sketch", "row.sketch") <= limit))
                .select(F.col("head.id").alias("lo"), F.col("row.id").alias("hi"), F.col("row.sketch").isNull().alias("sure"))
            )
            pairs = pairs if met is None else pairs.unionByName(met)
            # coverage: what a pair shares; one chunk or the file is enough for the exact check
            pairs = cut(pairs.groupBy("lo", "hi").agg(F.bool_or("sure").alias("sure"), F.count("*").alias("shared")).filter("shared >= 1"), "p2-pairs")
            doubtful = pairs.filter(~F.col("sure")).select("lo", "hi")
            vectors = table.select("id", "v") if old is None else table.select("id", "v").unionByName(old.select("id", "v"))
            few = pairs.limit(BROADCAST_PAIRS + 1).count() <= BROADCAST_PAIRS
            near = verified(doubtful, vectors, table, "id", least, self.dim, few)
            edges = cut(near.unionByName(pairs.filter("sure").select("lo", "hi")).distinct(), "p2-edges")
            late = None if late is None else cut(late, "p2-late")
            now, open_ = resolve(edges, late)
            discard(first, pairs)
            rejected = now if rejected is None else rejected.union(now)
            if open_ is None:
                return rejected.distinct()
            buckets = cut(buckets.join(open_, "id", "left_semi"), "p2-open")
            table, met, heads = table.join(open_, "id", "left_semi"), None, heads * 4


def resolve(edges: DataFrame, late: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """Rejected ids, and ids that stay open (None: none does), of the ordered conflicts edges(lo earlier, hi later).

    Rows in `late` may be rejected but not yet accepted. Each round accepts every row without an open earlier
    conflict and rejects what conflicts with it; only the conflicts between open rows go to the next round.
    """
    done = edges.select(F.col("hi").alias("id")).limit(0)
    while True:
        accepted = edges.select(F.col("lo").alias("id")).distinct().join(edges.select(F.col("hi").alias("id")), "id", "left_anti")
        if late is not None:
            accepted = accepted.join(late, "id", "left_anti")
        out = cut(edges.join(accepted.withColumnRenamed("id", "lo"), "lo", "left_semi").select(F.col("hi").alias("id")).distinct(), "p2-out")
        done = done.union(out)
        gone = out.select(F.col("id").alias("hi"))
        left = edges.join(gone, "hi", "left_anti").join(gone.withColumnRenamed("hi", "lo"), "lo", "left_anti")
        if left.isEmpty():
            edges = left
            if late is None:
                return done, None
            break
        if out.isEmpty():
            break
        edges = cut(left, "p2-edges")
    # what waits: rows that were not heads everywhere, and rows behind an open one
    waiting = edges.select(F.col("hi").alias("id"))
    waiting = cut((waiting if late is None else waiting.union(late)).distinct().join(done, "id", "left_anti"), "p2-waiting")
    return done, None if waiting.isEmpty() else waiting
