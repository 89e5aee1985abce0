"""Classifiers behind one registry, and out-of-fold prediction.

The network is Spark's multilayer perceptron; extremely randomised trees, boosted
multiclass trees and ridge regression are this package's own and take an array
column.  Set encoders read tokens and stand in ``set_encoder``.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.operators.boosted import BoostedTrees
from helixframe.operators.extra_trees import ExtraTrees
from helixframe.operators.ridge import Ridge

DEFAULTS = {
    "rf": {"numTrees": 40, "maxDepth": 8, "seed": 42},
    "logistic": {"maxIter": 50, "regParam": 0.01, "family": "multinomial"},
    "gbt": {"rounds": 10, "depth": 3},
    "ridge": {"penalty": 1.0},
    "mlp": {"maxIter": 40, "seed": 42},
    "extra_trees": {"trees": 30, "depth": 6, "seed": 42},
}

#: Models of this package: they take arrays, know their weights and give ``proba``.
OWN = {"extra_trees": ExtraTrees, "gbt": BoostedTrees, "ridge": Ridge}


def create(name: str, width: int, classes: int, weighted: bool = True, **params):
    """An estimator of the registry; ``params`` override the defaults."""
    if name not in DEFAULTS:
        raise ValueError(f"unknown model {name}; there are {sorted(DEFAULTS)}")
    p = DEFAULTS[name] | params
    if name in OWN:
        return OWN[name](**p)
    common = {"featuresCol": "features", "labelCol": "y"}
    weight = {"weightCol": "weight"} if weighted else {}
    if name == "rf":
        return RandomForestClassifier(**common, **weight, **p)
    if name == "logistic":
        return LogisticRegression(**common, **weight, **p)
    return MultilayerPerceptronClassifier(layers=[width, max(16, 2 * classes), classes], **common, **p)


def assemble(features: DataFrame, columns: list[str]) -> DataFrame:
    """sample_id, label, fold, features (scaled), y, weight (balanced)."""
    stages = [VectorAssembler(inputCols=columns, outputCol="raw", handleInvalid="keep"), StandardScaler(inputCol="raw", outputCol="features", withMean=True), StringIndexer(inputCol="label", outputCol="y", stringOrderType="alphabetAsc")]
    made = Pipeline(stages=stages).fit(features).transform(features)
    counts = {r["y"]: r["c"] for r in made.groupBy("y").agg(F.count(F.lit(1)).alias("c")).collect()}
    total = sum(counts.values())
    weight = F.create_map(*[F.lit(x) for y, c in counts.items() for x in (y, total / (len(counts) * c))]) if counts else F.lit(None)
    return made.select("sample_id", "label", "fold", "features", "y", (weight[F.col("y")] if counts else weight.cast("double")).alias("weight"))


def with_proba(scored: DataFrame, name: str) -> DataFrame:
    """The array column ``proba`` from a model's own output columns."""
    return scored if name in OWN else scored.withColumn("proba", vector_to_array("probability"))


def out_of_fold(ready: DataFrame, name: str, **params) -> DataFrame:
    """sample_id, fold, y_true, proba: each fold predicted by a model of the
    other folds."""
    classes = ready.select("y").distinct().count()
    width = ready.first()["features"].size
    folds = sorted(r["fold"] for r in ready.select("fold").distinct().collect())

    def one(fold) -> DataFrame:
        train, test = ready.where(F.col("fold") != fold), ready.where(F.col("fold") == fold)
        if name in OWN:
            plain = lambda part: part.withColumn("features", vector_to_array("features"))
            scored = create(name, width, classes, **params).fit(plain(train), classes, width).transform(plain(test))
        else:
            scored = create(name, width, classes, **params).fit(train).transform(test)
        return with_proba(scored, name).select("sample_id", "fold", F.col("label").alias("y_true"), "proba")

    # folds do not wait for each other: their jobs share the cluster
    with ThreadPoolExecutor(max(1, len(folds))) as pool:
        return reduce(DataFrame.union, pool.map(one, folds))
