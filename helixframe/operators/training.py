"""Training a named configuration from long cells, fold by fold.

The plans fit on samples whose number is no multiple of five.  For a given fold
``coded`` numbers the samples so that this rule is exactly "a train sample of
another fold": held-out and test samples get multiples of five.  Every fitted
block of every fold is thus safe, whatever the identifiers and folds are.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from helixframe.operators import models
from helixframe.operators.ensemble import macro_f1
from helixframe.plans.matrices import Config, long_matrix
from helixframe.sources.shared import write_once

MOST_FEATURES = 200_000


def numbered(samples: DataFrame) -> DataFrame:
    """``samples`` with a number of their own, written once so that it stays."""
    return samples.withColumn("row", F.monotonically_increasing_id()).checkpoint()


def coded(variants: DataFrame, rows: DataFrame, held: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``rows(sample_id, label, fold, row)``, fold null for test samples ->
    variants and samples under their numbers, and key(sample_id, own_id)."""
    digit = F.when(F.coalesce(F.col("fold") != held, F.lit(False)), 1 + F.col("row") % 4).otherwise(0)
    key = rows.select((F.col("row") * 5 + digit).alias("code"), F.col("sample_id").alias("own_id"), "label")
    label = F.coalesce("label", F.lit(""))
    tokens = variants.drop("label").withColumnRenamed("sample_id", "own_id").join(key.select("own_id", "code", label.alias("label")), "own_id").drop("own_id")
    return tokens.withColumnRenamed("code", "sample_id"), key.select(F.col("code").alias("sample_id"), label.alias("label")), key.select(F.col("code").alias("sample_id"), "own_id")


def vectors(long: DataFrame, ids: DataFrame) -> tuple[DataFrame, int]:
    """(sample_id, features) for every one of ``ids``, and the width.  The
    dictionary of features is bounded by the configuration's selections."""
    names = [r["feature"] for r in long.select("feature").distinct().limit(MOST_FEATURES + 1).collect()]
    if len(names) > MOST_FEATURES:
        raise ValueError(f"more than {MOST_FEATURES} features")
    width = max(1, len(names))
    at = long.sparkSession.createDataFrame([(n, k) for k, n in enumerate(sorted(names))], "feature string, k int")
    pairs = long.join(F.broadcast(at), "feature").groupBy("sample_id", "k").agg(F.sum("value").alias("value")).groupBy("sample_id").agg(F.sort_array(F.collect_list(F.struct("k", "value"))).alias("pairs"))
    sparse = F.udf(lambda p: Vectors.sparse(width, [x["k"] for x in p or ()], [x["value"] for x in p or ()]), VectorUDT())
    return ids.join(pairs, "sample_id", "left").select("sample_id", sparse("pairs").alias("features")), width


def sample_weights(rows: DataFrame, scheme: str) -> DataFrame:
    """``rows(label[, group_key])`` plus weight: the product of the schemes that
    ``+`` joins (none, balanced, group, group_sqrt), mean 1."""
    size = F.count(F.lit(1)).over(W.partitionBy("group_key")) if "group" in scheme else None
    totals = rows.agg(F.count(F.lit(1)).alias("all_rows"), F.count_distinct("label").alias("all_labels"))
    weight = F.lit(1.0)
    for name in scheme.split("+"):
        if name not in ("none", "balanced", "group", "group_sqrt"):
            raise ValueError(f"unknown weighting {name}")
        if name == "balanced":
            weight = weight * F.col("all_rows") / (F.col("all_labels") * F.count(F.lit(1)).over(W.partitionBy("label")))
        elif name != "none":
            weight = weight / (size if name == "group" else F.sqrt(size))
    found = rows.crossJoin(totals).withColumn("weight", weight).drop("all_rows", "all_labels")
    mean = found.agg(F.avg("weight").alias("mean_weight"))
    return found.crossJoin(mean).withColumn("weight", F.col("weight") / F.col("mean_weight")).drop("mean_weight")


class FoldCache:
    """Numbered rows, each fold's tokens and each fold's blocks, written once and
    shared by all runs over the same samples and folds."""

    def __init__(self, variants: DataFrame, rows: DataFrame):
        self.rows = numbered(rows)
        self.variants, self.folds, self.blocks = variants, {}, {}

    def fold(self, held: int) -> tuple[DataFrame, DataFrame, DataFrame]:
        if held not in self.folds:
            tokens, samples, key = coded(self.variants, self.rows, held)
            self.folds[held] = (write_once(tokens, "tokens"), samples, key)
        return self.folds[held]

    def block(self, held: int):
        def keep(key: str, make) -> DataFrame:
            if (held, key) not in self.blocks:
                self.blocks[held, key] = write_once(make(), "block")
            return self.blocks[held, key]

        return keep


def train_config(variants: DataFrame, rows: DataFrame, config: Config, model: str, scheme: str, classes: Sequence[str], cache: FoldCache | None = None, **params) -> tuple[DataFrame, DataFrame]:
    """``rows(sample_id, label, fold[, group_key])`` -> out-of-fold table
    (sample_id, fold, y_true, proba) and the test samples' mean over the folds'
    models (sample_id, proba).  Test samples have no fold."""
    cache = cache or FoldCache(variants, rows)
    rows = cache.rows
    place = F.create_map(*[F.lit(x) for k, c in enumerate(classes) for x in (c, float(k))])
    oof, test = None, None
    for (held,) in rows.where("fold is not null").select("fold").distinct().orderBy("fold").collect():
        tokens, samples, key = cache.fold(held)
        ready, width = vectors(long_matrix(config, tokens, samples, cache=cache.block(held)), samples.select("sample_id"))
        ready = ready.join(key, "sample_id").drop("sample_id").withColumnRenamed("own_id", "sample_id").checkpoint()
        fit = sample_weights(rows.where(F.col("fold") != held).drop("row"), scheme).join(ready, "sample_id").withColumn("y", place[F.col("label")])
        rest = rows.where(f"fold is null or fold = {int(held)}").join(ready, "sample_id")
        if model in models.OWN:
            plain = lambda part: part.withColumn("features", vector_to_array("features"))
            scored = models.create(model, width, len(classes), **params).fit(plain(fit.select("features", "y", "weight")), len(classes), width).transform(plain(rest))
        else:
            fitted = models.create(model, width, len(classes), **params).fit(fit.select("features", "y", "weight"))
            scored = models.with_proba(fitted.transform(rest), model)
        scored = scored.select("sample_id", "fold", F.col("label").alias("y_true"), "proba").checkpoint()
        part, ahead = scored.where("fold is not null"), scored.where("fold is null").select("sample_id", "proba")
        oof, test = (part, ahead) if oof is None else (oof.union(part), test.union(ahead))
    mean = test.select("sample_id", F.posexplode("proba").alias("k", "p")).groupBy("sample_id", "k").agg(F.avg("p").alias("p"))
    return oof, mean.groupBy("sample_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "p"))), lambda x: x["p"]).alias("proba"))


def oof_score(oof: DataFrame, classes: Sequence[str]) -> float:
    """Macro F1 of an out-of-fold table, from the confusion counts."""
    best = F.array_position("proba", F.array_max("proba")).cast("int") - 1
    truth = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("y_true")).cast("int") - 1
    counts = oof.groupBy(truth.alias("t"), best.alias("p")).count().collect()
    t, p, n = (np.array([r[k] for r in counts], dtype=int) for k in range(3))
    return macro_f1(np.repeat(t, n), np.repeat(p, n), len(classes))
