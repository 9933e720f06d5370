"""Records of evaluation splits that are also, exactly or almost, in the training split."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gyral.functions.ids import cohort_of
from gyral.llm.signs import letters, residuals
from gyral.llm.vectors import DIM, SEED, alike, centre, fit_sample, prepare
from gyral.plans.skew import split_join, spread_join
from gyral.session import cut, discard

#: A vector's shingles are {(place, letter)} of so many letters.
SHINGLES = 96
#: Minwise hashes per band, bands, and the least exact Jaccard similarity of two shingle sets.
#: At cosine 0.98 (0.96 once the template is off) 60 % of the letters agree, a Jaccard similarity of 0.43 give or take 0.05;
#: of such pairs 99.4 % share one of 80 bands of three, of strangers (a third of a letter in common on average) one in 10^5.
BAND, BANDS, JACCARD = 3, 80, 0.2
FIT = 16_384
#: Up to so many candidate pairs are sent to the vectors, which then stay where they are but for those of the pairs.
BROADCAST_PAIRS = 500_000
TRAIN, EVALUATION = "train", ("val", "official_val")


def bands(text: np.ndarray) -> np.ndarray:
    """(rows, BANDS) of 64-bit band keys: minwise hashes of the set {(place, letter)}, BAND of them a key."""
    rng = np.random.default_rng([SEED, 4])
    turn, times, weigh = (rng.integers(1, 2**63, n, dtype=np.uint64) | np.uint64(1) for n in (BAND * BANDS, BAND * BANDS, BAND))
    each = (text.astype(np.uint64) | (np.arange(text.shape[1], dtype=np.uint64) << np.uint64(16))) * np.uint64(0x9E3779B97F4A7C15)
    each = (each ^ (each >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    each ^= each >> np.uint64(32)
    least = np.empty((len(text), BAND * BANDS), np.uint64)
    for k in range(BAND * BANDS):
        h = (each ^ turn[k]) * times[k]
        least[:, k] = ((h ^ (h >> np.uint64(32))) * times[k]).min(1)
    mixed = (least.reshape(len(text), BANDS, BAND) * weigh).sum(2, dtype=np.uint64)
    return (mixed ^ (mixed >> np.uint64(31))).view(np.int64) if len(text) else mixed.view(np.int64)


def shingle_table(rows: DataFrame, mean: np.ndarray, dim: int) -> DataFrame:
    """rows(vector, v, train, eval) -> these, with `keys`, the band keys of the shingle set."""
    shared = rows.sparkSession.sparkContext.broadcast(mean)
    names = ["vector", "v", "train", "eval", "keys"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(at, 4096) for at in range(0, whole.num_rows, 4096)):
                text = letters(residuals(batch.column(1).to_pylist(), shared.value, dim), SHINGLES)
                keys = pa.ListArray.from_arrays(pa.array(np.arange(len(text) + 1, dtype=np.int32) * BANDS), pa.array(bands(text).ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns, keys], names)

    return rows.select(*names[:4]).mapInArrow(run, "vector bigint, v binary, train boolean, eval boolean, keys array<bigint>")


def jaccard(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact Jaccard similarity of the shingle sets of two (rows, SHINGLES) arrays of letters, row by row."""
    same = (a == b).sum(1)
    return same / (2 * SHINGLES - same)


def similar_cases(cases: DataFrame, vectors: DataFrame, least: float = 0.98, dim: int = DIM) -> DataFrame:
    """(eval_case, train_case): cases(case, train, eval) across the splits with alike vectors, or the same case.

    vectors(case, emb) may have many rows a case, or none. Null cases, invalid vectors and vectors of cases in no
    split take no part. Equal vectors are gathered first, so that copies count once; only pairs of an evaluation and
    a training vector are formed, from equal band keys; they need the exact Jaccard similarity of their shingle sets,
    then the cosine of their own vectors. Band keys and cases with very many rows are spread over tasks.
    """
    there = cases.filter(F.col("case").isNotNull() & (F.col("train") | F.col("eval")))
    valid = cut(prepare(vectors.filter(F.col("case").isNotNull()).select("case", "emb"), "emb", dim).select("case", "v", F.xxhash64("v").alias("vector")), "p4-rows")
    members = cut(split_join(valid.select("case", "vector").distinct(), there, "case", "inner").select("case", "vector", "train", "eval"), "p4-members")
    total = valid.count()
    mean = centre(fit_sample(valid, "case", FIT, total, dim), dim)
    flags = members.groupBy("vector").agg(F.max("train").alias("train"), F.max("eval").alias("eval"))
    units = valid.groupBy("vector").agg(F.first("v").alias("v")).join(flags, "vector")
    table = cut(shingle_table(units, mean, dim), "p4-shingles")
    side = lambda flag, name: table.filter(flag).select(F.col("vector").alias(name), F.posexplode("keys").alias("band", "key")).select(name, (F.col("key") + F.col("band")).alias("key"))
    met = cut(spread_join(side("eval", "lo"), side("train", "hi"), "key").filter("lo <> hi").select("lo", "hi").distinct(), "p4-candidates")
    few = met.limit(BROADCAST_PAIRS + 1).count() <= BROADCAST_PAIRS
    sent = F.broadcast if few else lambda df: df
    of = lambda c: table.select(F.col("vector").alias(c), F.col("v").alias(f"v_{c}"))
    lo, hi = of("lo").join(sent(met), "lo"), of("hi").join(sent(met.select("hi").distinct()), "hi", "left_semi")
    shared = table.sparkSession.sparkContext.broadcast(mean)
    shingles = lambda blobs: letters(residuals(blobs, shared.value, dim), SHINGLES)
    close = alike(lo.join(hi, "hi").select("lo", "hi", "v_lo", "v_hi"), least, dim, lambda a, b: jaccard(shingles(a), shingles(b)) >= JACCARD)
    pairs = close.unionByName(table.filter("eval and train").select(F.col("vector").alias("lo"), F.col("vector").alias("hi")))
    ev = members.filter("eval").select(F.col("vector").alias("lo"), F.col("case").alias("eval_case"))
    tr = members.filter("train").select(F.col("vector").alias("hi"), F.col("case").alias("train_case"))
    found = spread_join(spread_join(cut(pairs, "p4-pairs"), ev, "lo"), tr, "hi").select("eval_case", "train_case")
    same = there.filter("train and eval").select(F.col("case").alias("eval_case"), F.col("case").alias("train_case"))
    links = cut(found.union(same).distinct(), "p4-links")
    discard(valid, members, table, met)
    return links


def _sides(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The distinct rows(id, split_name, case) of a split with a case, and the cases with the sides they are on."""
    rows = rows.filter(F.col("case").isNotNull() & F.col("split_name").isin(TRAIN, *EVALUATION)).select("id", "split_name", "case").distinct()
    rows = cut(rows, "p4-names")
    return rows, rows.groupBy("case").agg(F.max(F.col("split_name") == TRAIN).alias("train"), F.max(F.col("split_name") != TRAIN).alias("eval"))


def cross_split(rows: DataFrame, vectors: DataFrame, least: float = 0.98, dim: int = DIM) -> DataFrame:
    """rows(id, split_name, case) -> (a_id, b_id, eval_split, eval_cohort): pairs across training and evaluation.

    a_id is the smaller id. Rows of a null or other split, or of a null case, pair with nothing; a repeated id in
    one split counts once; an empty side gives no rows.
    """
    rows, cases = _sides(rows)
    links = similar_cases(cases, vectors, least, dim)
    ev = rows.filter(F.col("split_name") != TRAIN).select(F.col("case").alias("eval_case"), F.col("id").alias("e"), F.col("split_name").alias("eval_split"), cohort_of(F.col("case")).alias("eval_cohort"))
    tr = rows.filter(F.col("split_name") == TRAIN).select(F.col("case").alias("train_case"), F.col("id").alias("t"))
    pairs = spread_join(spread_join(links, ev, "eval_case"), tr, "train_case").filter("e <> t")
    return pairs.select(F.least("e", "t").alias("a_id"), F.greatest("e", "t").alias("b_id"), "eval_split", "eval_cohort")


def overlap_report(rows: DataFrame, vectors: DataFrame, least: float = 0.98, dim: int = DIM) -> DataFrame:
    """(eval_split, eval_cohort, n_pairs, n_rows): the pairs of cross_split() and the evaluation rows that are in one.

    Rows are counted per case before they meet: a case with many rows costs one row, and no pair is written out. Ids are
    meant to be in one split each, as cross_split() leaves a row's pair with itself out.
    """
    rows, cases = _sides(rows)
    links = similar_cases(cases, vectors, least, dim)
    trained = rows.filter(F.col("split_name") == TRAIN).groupBy(F.col("case").alias("train_case")).agg(F.count("*").alias("n_train"))
    per_case = split_join(links, trained, "train_case", "inner").groupBy(F.col("eval_case").alias("case")).agg(F.sum("n_train").alias("n_train"))
    asked = rows.filter(F.col("split_name") != TRAIN).groupBy("case", F.col("split_name").alias("eval_split")).agg(F.count("*").alias("n"))
    met = asked.join(per_case, "case").withColumn("eval_cohort", cohort_of(F.col("case")))
    return met.groupBy("eval_split", "eval_cohort").agg(F.sum(F.col("n") * F.col("n_train")).alias("n_pairs"), F.sum("n").alias("n_rows"))
