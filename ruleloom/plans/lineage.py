"""Cutting lineage so that work is done once and survives the loss of an executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own; a cluster without it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = getattr(spark.sparkContext, "_ruleloom_dir", None)
    if own is None:
        own = spark.sparkContext._ruleloom_dir = "file://" + tempfile.mkdtemp(prefix="ruleloom-")
    return own


def settle(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` to the shared folder once and read it back: columnar, pruned by column, lineage cut."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ruleloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_at = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete settled tables that no later plan reads: those from which everything still needed has been settled itself."""
    for df in tables:
        path = getattr(df, "_settled_at", None)
        if path:
            jvm = df.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
