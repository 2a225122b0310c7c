"""Helpers shared by the text operators: shared-folder tables, joins on hot keys, hashing."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import small_batches as small_batches

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session.

    Only where that is unset and Spark runs on this machine alone a folder of this machine is made and set.
    """
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.quantframe.shared", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="quantframe-")
        spark.conf.set("spark.quantframe.shared", folder)
    return folder.rstrip("/")


def run_folder(spark: SparkSession) -> str:
    """The folder of this application's intermediate tables, under the shared one."""
    return f"{shared_dir(spark)}/quantframe/{spark.sparkContext.applicationId}"


def remove_tables(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application: to be called when its results are written, as results read them."""
    where, path = fs.FileSystem.from_uri(run_folder(spark))
    if where.get_file_info(path).type == fs.FileType.Directory:
        where.delete_dir(path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back.

    Cuts the lineage (a lost executor costs no earlier stage) and lets later plans use real sizes. The
    shuffle files of the write go as soon as it is done.
    """
    spark = df.sparkSession
    path = f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)


def join_counted(rows: DataFrame, keys: list[str], side: DataFrame, side_keys: list[str], total: int) -> DataFrame:
    """Inner join of rows to a table that has one row for each key and the number of its rows in the column c.

    Keys with over a 100,000th of all `total` rows (and 1,000 at least), fewer than 100,000 by that measure, are sent
    to all tasks; the other keys are shuffled, and none of them is hot.
    """
    limit = max(1000, total // 100_000)
    on = lambda a, b: [a[x] == b[y] for x, y in zip(keys, side_keys, strict=True)]
    if total <= limit:
        return rows.join(side, on(rows, side))
    hot, cold = F.broadcast(side.where(F.col("c") > limit)), side.where(F.col("c") <= limit)
    near, far = rows.join(hot, on(rows, hot)), rows.join(hot, on(rows, hot), "left_anti")
    return near.unionByName(far.join(cold, on(far, cold)))


def join_split(rows: DataFrame, key: str, side: DataFrame, side_key: str) -> DataFrame:
    """Inner join of rows (read three times) to a side that may have several rows for a key.

    Rows of a key with over a 100,000th of all rows (and 1,000 at least) are dealt to several tasks, and the side's rows
    of that key are copied to each. Fewer than 100,000 such keys, with their number of copies, are sent to all tasks.
    """
    limit = max(1000, rows.count() // 100_000)
    hot = rows.groupBy(F.col(key).alias("__qf_key")).agg(F.count(F.lit(1)).alias("__qf_rows")).where(F.col("__qf_rows") > limit)
    hot = F.broadcast(hot.select("__qf_key", F.ceil(F.col("__qf_rows") / limit).cast("int").alias("__qf_copies")))
    copies = F.coalesce("__qf_copies", F.lit(1))
    dealt = rows.join(hot, rows[key] == hot["__qf_key"], "left").withColumn("__qf_copy", F.pmod(F.xxhash64(*rows.columns), copies).cast("int")).drop("__qf_key", "__qf_copies")
    copied = side.join(hot, side[side_key] == hot["__qf_key"], "left").withColumn("__qf_at", F.explode(F.sequence(F.lit(0), copies - 1))).drop("__qf_key", "__qf_copies")
    return dealt.join(copied, (F.col(key) == F.col(side_key)) & (F.col("__qf_copy") == F.col("__qf_at"))).drop("__qf_copy", "__qf_at")


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix64) over a uint64 array."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
