"""Cutting lineage in the folder that all executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``. A session without one gets a local folder if it is a local session, and an error otherwise."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = jdir.get() if jdir.isDefined() else None
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="sedimill-ckpt-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def written(df: DataFrame, tag: str = "step") -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    What follows no longer depends on the lineage (a lost executor costs nothing
    that was finished), and a frame that is used several times is computed once.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/sedimill/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._durable_path = path
    return out


def released(*frames: DataFrame) -> None:
    """Delete what ``written`` made, once nothing that is still to be computed reads it."""
    for df in frames:
        path = df.__dict__.pop("_durable_path", None)
        if path:
            spark = df.sparkSession
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def swept(spark: SparkSession) -> None:
    """Let go of the shuffle files of what has run: Spark deletes them only after the driver has collected its garbage, which a small plan rarely makes it do."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
