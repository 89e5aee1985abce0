"""Ridge regression on class indicators, as a classifier.

One pass sums the weighted cross products of the features and their targets, a
matrix of the features' number squared, which is solved on the driver; the
outputs become shares by the softmax.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from helixframe.operators.boosted import softmax
from helixframe.operators.extra_trees import stacked


class Ridge:
    """``fit`` reads features (an array column), y and weight; ``transform`` adds
    ``proba``.  The intercept is not penalised.  Missing values count as 0."""

    def __init__(self, penalty: float = 1.0):
        self.penalty = penalty

    def fit(self, table: DataFrame, classes: int, width: int) -> Ridge:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((width + 1, width + 1 + classes))
            for batch in batches:
                if len(batch):
                    x = np.c_[stacked(batch), np.ones(len(batch))]
                    y = np.eye(classes)[batch["y"].to_numpy(np.int64)]
                    total += (x * batch["weight"].to_numpy()[:, None]).T @ np.c_[x, y]
            yield pd.DataFrame({"row": np.arange(width + 1), "sums": [r.tobytes() for r in total]})

        def add(group: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"row": group["row"].iloc[:1], "sums": [sum(np.frombuffer(x, np.float64) for x in group["sums"]).tobytes()]})

        rows = table.select(F.col("features").alias("x"), F.col("y").cast("long").alias("y"), F.col("weight").cast("double").alias("weight"))
        got = rows.mapInPandas(run, "row long, sums binary").groupBy("row").applyInPandas(add, "row long, sums binary").toPandas().sort_values("row")
        whole = np.stack([np.frombuffer(x, np.float64) for x in got["sums"]]) if len(got) else np.zeros((width + 1, width + 1 + classes))
        penalty = np.diag([self.penalty] * width + [1e-9])
        self.weights = np.linalg.solve(whole[:, : width + 1] + penalty, whole[:, width + 1 :])
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return softmax(np.c_[x, np.ones(len(x))] @ self.weights)

    def transform(self, table: DataFrame) -> DataFrame:
        model = self

        @F.pandas_udf(ArrayType(DoubleType()))
        def proba(x: pd.Series) -> pd.Series:
            return pd.Series(list(model.predict(stacked(pd.DataFrame({"x": x})))) if len(x) else [], dtype=object)

        return table.withColumn("proba", proba("features"))
