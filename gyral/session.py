"""Session and shared-storage helpers."""

from __future__ import annotations

import atexit
import gc
import re
import shutil
import tempfile
import uuid
import zipfile
from functools import cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, **conf: str) -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("gyral")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session's spark.checkpoint.dir names it.

    Where the setting is absent a local session, whose only machine this is, gets a folder of its own that goes with
    the process; on a cluster that would be a folder the executors don't share, so there it is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = _own_folder()
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


@cache
def _own_folder() -> str:
    folder = tempfile.mkdtemp(prefix="gyral-")
    atexit.register(shutil.rmtree, folder, True)
    return folder


def cut(df: DataFrame, name: str = "cut", partition_by: list[str] | None = None) -> DataFrame:
    """Writes df once into the shared folder and reads it back: short lineage that outlives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    _forget_at_exit(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._gyral_path = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Deletes tables that cut() wrote and nothing needs any more; others are left alone."""
    for df in tables:
        path = getattr(df, "_gyral_path", None)
        if path:
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Asks for the shuffle files and broadcasts of finished queries, which else stay until the driver collects its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def _forget_at_exit(spark: SparkSession, path: str) -> None:
    """Deletes the folder when the application ends."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared one that lasts as long as the application."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _forget_at_exit(spark, path)
    return path


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once per application, so that none needs it installed."""
    context = spark.sparkContext
    if getattr(context, "_gyral_shipped", False):
        return
    package = Path(__file__).resolve().parent
    archive = Path(_own_folder()) / "gyral_package.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._gyral_shipped = True
