"""Intermediate results that outlive an executor."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one only where it is unset and the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="casemill-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    made = f"file://{folder}"
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def durable(df: DataFrame, name: str = "step") -> DataFrame:
    """Writes df as a table in the shared folder and reads it back.

    Cuts the lineage like checkpoint(), survives the loss of executors, and is columnar: later readers prune
    columns, and the statistics of the written files let the planner size joins. The table stays until the shared
    folder is cleared, as later plans may read it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/casemill/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._written_at = path
    return back


def forget(*written: DataFrame) -> None:
    """Removes tables of durable() that no plan reads any more, as those of a loop's earlier rounds; others are left alone."""
    for df in written:
        if path := getattr(df, "_written_at", None):
            spark = df.sparkSession
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def together(spark: SparkSession, *parts: Callable[[], object]) -> list:
    """The results of parts that don't need each other, each in a thread: one's short stages run beside the long ones of others.

    What they share must be made before.
    """
    shared_dir(spark)
    with ThreadPoolExecutor(len(parts)) as pool:
        return [x.result() for x in [pool.submit(inheritable_thread_target(spark)(p)) for p in parts]]


def broadcast_if_small(df: DataFrame, most: int = 200_000) -> DataFrame:
    """Hints a broadcast where df has at most ``most`` (narrow) rows; else the planner joins as it sees fit.

    df should be cheap to count, like a written table.
    """
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
