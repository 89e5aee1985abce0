"""Tables written once to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local folder only where that is absent and
    Spark runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="helixframe-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def write_once(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and reread: it cuts the lineage, survives the
    loss of any executor, and each reader scans the columns it needs."""
    path = f"{shared_dir(df.sparkSession)}/helixframe-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_dealt(df: DataFrame, name: str, key: str, parts: int) -> DataFrame:
    """As ``write_once``, in ``parts`` buckets by ``key``: groups and joins by the
    key need no shuffle.  ``df`` should lie in as many partitions by the key, else
    each task writes a file for every bucket it meets."""
    spark, name = df.sparkSession, f"helixframe_{name}_{uuid.uuid4().hex}"
    df.write.format("parquet").bucketBy(parts, key).option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    return spark.table(name)
