"""Written intermediate tables in the folder that driver and executors share.

The folder is ``spark.checkpoint.dir``.  Only where that setting is absent and
Spark runs in one process (unit tests) a local folder is chosen; elsewhere its
absence is an error.  A written table cuts lineage and survives the loss of any
executor.
"""

from __future__ import annotations

import tempfile
import threading
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Held while a write runs under another batch size than the session's.
_SETTING = threading.Lock()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder, set once where a one-process session has none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="helixframe-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def write_table(df: DataFrame, name: str, rows_per_batch: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return it reread.

    ``rows_per_batch`` bounds, for this write only, the rows that go to a
    Python worker at once; wide rows need few.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/helixframe-{name}-{uuid.uuid4().hex}"
    with _SETTING:
        before = spark.conf.get(_BATCH)
        try:
            if rows_per_batch:
                spark.conf.set(_BATCH, str(min(rows_per_batch, int(before))))
            df.write.option("compression", "zstd").parquet(path)
        finally:
            spark.conf.set(_BATCH, before)
    return spark.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with ``row_key``, a long that tells its rows apart and stays the
    same whenever they are read: from the place in the Parquet file a row was
    read from, or else of a written copy."""
    try:
        return df.withColumn("row_key", F.xxhash64("_metadata.file_path", "_metadata.row_index"))
    except AnalysisException:
        return write_table(df.withColumn("row_key", F.monotonically_increasing_id()), "rows")


#: A group with more than one in so many of all rows is hot; there are fewer than
#: so many of them, which is what bounds their broadcast.
MOST_HOT = 10_000


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """``rows`` inner-joined to ``groups``, one narrow row per value of ``keys``
    with the number of its rows in column ``size``, of ``total`` rows in all.  Hot
    groups are broadcast, so that no shuffled key holds more than its share; the
    others meet their rows by a merge join at every size."""
    hot = F.col(size) * MOST_HOT > total
    few = F.broadcast(groups.where(hot))
    rest = rows.join(few.select(*keys), keys, "left_anti")
    return rows.join(few, keys).unionByName(rest.join(groups.where(~hot).hint("merge"), keys))


#: So many identifiers, with a number each at most, are sent to all executors
#: rather than texts or sketches shuffled to meet them.
MOST_IDS = 2_000_000


def few(ids: DataFrame) -> DataFrame:
    """``ids`` written and counted, to be broadcast if there are ``MOST_IDS`` rows
    at most and else to be met by a shuffle."""
    ids = write_table(ids, "ids")
    return F.broadcast(ids) if ids.count() <= MOST_IDS else ids


def join_ids(rows: DataFrame, ids: DataFrame, key: str, how: str) -> DataFrame:
    """``rows`` with (left_semi) or without (left_anti) those of ``ids(key)``."""
    return rows.join(few(ids), key, how)
