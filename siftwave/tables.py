"""Tables in the session's shared folder that cut lineage, so that a lost executor or a second reader repeats no earlier work."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. Where the session names none, a temporary one if it is local, else an error."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.conf.get("spark.master", "")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="siftwave-")
        spark.conf.set("spark.checkpoint.dir", configured)
    return configured.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written once as a Parquet table in the shared folder and read again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def delete(spark: SparkSession, folder: str) -> None:
    """Delete a folder and all in it; one that isn't there is no error."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables that `stored` wrote and that nothing reads any more."""
    for t in tables:
        delete(t.sparkSession, t.stored_at)


def release(spark: SparkSession) -> None:
    """Have shuffle files of plans that nothing refers to any more deleted now.

    Spark deletes them when the driver's JVM collects garbage, which a driver with little to do may
    not do for half an hour while its executors' disks fill.
    """
    gc.collect()
    spark._jvm.System.gc()
