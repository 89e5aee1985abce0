"""Prediction tables as CSV files: ID, p_<class>..., [y_true], [y_pred].

Files may begin with a byte order mark.  Probabilities are written with 12
places, so that the largest of a row is the same after rereading.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.operators.reports import argmax_label

PREFIX = "p_"
MARK = "﻿"


def read_predictions(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """(ID, proba, further columns as strings), and the classes in file order."""
    raw = spark.read.option("header", True).option("escape", '"').csv(path)
    raw = raw.toDF(*[c.lstrip(MARK) for c in raw.columns])
    classes = [c[len(PREFIX) :] for c in raw.columns if c.startswith(PREFIX)]
    if "ID" not in raw.columns or not classes:
        raise ValueError(f"no ID or no {PREFIX} column in {path}")
    other = [F.col(f"`{c}`") for c in raw.columns if c != "ID" and not c.startswith(PREFIX)]
    return raw.select("ID", F.array(*[F.col(f"`{PREFIX}{c}`").cast("double") for c in classes]).alias("proba"), *other), classes


def prediction_frame(scored: DataFrame, classes: Sequence[str]) -> DataFrame:
    """``scored(ID, proba[, y_true])`` -> the file's columns; y_pred is the
    first class of largest probability."""
    values = [F.round(F.element_at("proba", k + 1), 12).alias(f"{PREFIX}{c}") for k, c in enumerate(classes)]
    truth = [F.col("y_true")] if "y_true" in scored.columns else []
    rounded = F.transform("proba", lambda p: F.round(p, 12))
    return scored.select("ID", *values, *truth, argmax_label(rounded, classes).alias("y_pred"))


def schema_faults(frame: DataFrame, ids: DataFrame, classes: Sequence[str], truth: bool = False) -> list[str]:
    """What is wrong with a prediction frame against the expected IDs."""
    expected = ["ID", *[f"{PREFIX}{c}" for c in classes], *(["y_true"] if truth else []), "y_pred"]
    if frame.columns != expected:
        return [f"columns are {frame.columns[:5]}..., expected {expected[:5]}..."]
    bad = F.lit(False)
    for c in classes:
        v = F.col(f"`{PREFIX}{c}`")
        bad = bad | v.isNull() | F.isnan(v)
    total = frame.agg(F.count("ID").alias("n"), F.count_distinct("ID").alias("ids"), F.coalesce(F.sum(bad.cast("int")), F.lit(0)).alias("bad")).first()
    out = [] if total["n"] == total["ids"] else [f"{total['n'] - total['ids']} repeated IDs"]
    out += [f"{total['bad']} rows without a number"] if total["bad"] else []
    for what, one, two in (("missing", ids, frame), ("unexpected", frame, ids)):
        n = one.select("ID").join(two.select("ID"), "ID", "left_anti").count()
        out += [f"{n} {what} IDs"] if n else []
    return out


def write_csv_file(df: DataFrame, path: str, overwrite: bool = False, mark: bool = False) -> None:
    """One CSV file named ``path``: written beside it, then renamed onto it, so
    that a reader sees the whole file or none.  ``mark`` begins it with a byte
    order mark.  Meant for final tables of one row a sample: one task writes."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(target) and not overwrite:
        raise FileExistsError(path)
    beside = f"{path}.{uuid.uuid4().hex}.tmp"
    names = [(MARK if mark and k == 0 else "") + c for k, c in enumerate(df.columns)]
    try:
        df.toDF(*names).coalesce(1).write.option("header", True).option("escape", '"').option("quoteAll", False).csv(beside)
        parts = fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{beside}/part-*.csv"))
        if len(parts) != 1:
            raise OSError(f"{len(parts)} parts where one was written")
        if overwrite and fs.exists(target):
            fs.delete(target, False)
        if not fs.rename(parts[0].getPath(), target):
            raise OSError(f"cannot rename onto {path}")
    finally:
        fs.delete(jvm.org.apache.hadoop.fs.Path(beside), True)
