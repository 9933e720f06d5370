"""The donor tables as inputs of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gyral.functions.ids import file_key


def donor_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ref_table, row_id, key, t) of every file reference in donor_index and donor_manifest."""
    index = spark.read.parquet(f"{sf_dir}/donor_index.parquet").select(
        F.lit("donor_index").alias("ref_table"), F.col("donor_id").alias("row_id"), file_key(F.col("paths")).alias("key"), F.col("added_at").alias("t")
    )
    manifest = spark.read.parquet(f"{sf_dir}/donor_manifest.parquet").select(
        F.lit("donor_manifest").alias("ref_table"), F.col("manifest_id").alias("row_id"), file_key(F.col("donor_paths")).alias("key"), F.col("made_at").alias("t")
    )
    return index.unionByName(manifest)


def donor_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, start, stop) of every row of volume_files."""
    files = spark.read.parquet(f"{sf_dir}/volume_files.parquet")
    return files.select(file_key(F.col("vol_path")).alias("key"), F.col("registered_at").alias("start"), F.col("removed_at").alias("stop"))
