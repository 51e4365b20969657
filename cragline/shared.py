"""Tables in the folder that all executors share, which is how lineage is cut, and joins that hot keys do not slow."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HOT_SHARE = 1000  #: a key is hot from 1/HOT_SHARE of all rows on, so that at most HOT_SHARE keys are


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where it is unset, a folder of our own in local mode, as in tests, and an error on a cluster,
    whose executors would not see each other's files."""
    sc = spark.sparkContext
    given = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if given is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        given = f"file://{tempfile.mkdtemp(prefix='cragline-')}"
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(given)
    return given.rstrip("/")


_made: list[str] = []


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back."""
    path = f"{shared_dir(df.sparkSession)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Deletes the tables made so far in this process and returns their number; call it once results are written."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    n = len(_made)
    while _made:
        path = jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(conf).delete(path, True)
    return n


def join_hot(big: DataFrame, table: DataFrame, keys: list[str], count_col: str, total: int) -> DataFrame:
    """Left join of ``big`` to ``table`` (unique on ``keys``; ``count_col``: rows of ``big`` a key has).

    Keys with at least ``total / HOT_SHARE`` rows number at most HOT_SHARE, so that part is
    broadcast and never shuffles; the other keys have few rows each and meet in a shuffle join.
    """
    least = max(2, -(-total // HOT_SHARE))
    values = [c for c in table.columns if c not in keys]
    hot = table.where(F.col(count_col) >= least)
    cold = table.where(F.col(count_col) < least)
    marked = big.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), keys, "left")
    rest = marked.where(F.col("_hot").isNull()).drop("_hot", *values)
    return marked.where(F.col("_hot")).drop("_hot").unionByName(rest.join(cold, keys, "left"))
