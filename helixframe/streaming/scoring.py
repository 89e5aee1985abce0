"""Streaming variants of the blocks: token counts per sample as cells arrive,
and windowed event burden with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.functions import tokens as T


def token_burden(cells: DataFrame) -> DataFrame:
    """Streaming cells (sample_id, gene, cell) -> running counts per sample."""
    token = cells.select("sample_id", F.explode(T.split_tokens(F.col("cell"))).alias("token")).withColumn("kind", T.classify(F.col("token")))
    return token.groupBy("sample_id").agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("kind") == "missense").alias("missense"), F.count_if(F.col("kind") == "frameshift").alias("frameshift"))


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Tumbling windows per event type; rows later than the watermark go."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("window_start"), "event_type", "n", "total")
