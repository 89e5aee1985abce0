"""Extremely randomised trees, grown level by level over a distributed table.

All trees of a forest grow together.  A level takes two passes over the rows:
the first finds the range of every candidate feature in every open node, from
which a threshold is drawn; the second sums class weights on both sides of it.
Tasks emit partial ranges and sums per slot (tree, node, candidate), so what is
shuffled and what reaches the driver is bounded by the size of the forest and
never by the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType


def descend(x: np.ndarray, feature: np.ndarray, threshold: np.ndarray, depth: int) -> np.ndarray:
    """Heap number of the node each row (column of the result) is in, by tree."""
    at = np.zeros((len(feature), len(x)), dtype=np.int64)
    rows = np.arange(len(x))
    for t in range(len(feature)):
        for _ in range(depth):
            f = feature[t, at[t]]
            right = x[rows, np.maximum(f, 0)] > threshold[t, at[t]]
            at[t] = np.where(f >= 0, 2 * at[t] + 1 + right, at[t])
    return at


def stacked(batch: pd.DataFrame) -> np.ndarray:
    return np.nan_to_num(np.stack(batch["x"].to_list()).astype(np.float64))


class ExtraTrees:
    """Forest over ``features`` (an array column); ``fit`` reads features, y and
    weight, ``transform`` adds ``proba``.

    Missing values count as 0.  A node without two sides of positive weight, of
    one class, or without a gain of the Gini index is a leaf.  A leaf predicts
    its classes' share of the weight; an empty table gives equal shares.
    """

    def __init__(self, trees: int = 30, depth: int = 6, candidates: int | None = None, seed: int = 42):
        self.trees, self.depth, self.candidates, self.seed = trees, depth, candidates, seed

    def _ranges(self, rows: DataFrame, level: int, picks: np.ndarray) -> DataFrame:
        """slot, lo, hi over the rows of every open node of the level."""
        feature, threshold, trees = self.feature, self.threshold, self.trees
        first, (_, width, m) = 2**level - 1, picks.shape

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            lo, hi = np.full(picks.size, np.inf), np.full(picks.size, -np.inf)
            for batch in batches:
                x = stacked(batch)
                at = descend(x, feature, threshold, level) - first
                for t in range(trees):
                    held = np.flatnonzero(at[t] >= 0)
                    for c in range(m):
                        slot = (t * width + at[t, held]) * m + c
                        value = x[held, picks[t, at[t, held], c]]
                        np.minimum.at(lo, slot, value)
                        np.maximum.at(hi, slot, value)
            found = np.flatnonzero(hi >= lo)
            yield pd.DataFrame({"slot": found, "lo": lo[found], "hi": hi[found]})

        part = rows.mapInPandas(run, "slot long, lo double, hi double")
        return part.groupBy("slot").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo < hi")

    def _splits(self, rows: DataFrame, level: int, picks: np.ndarray, cuts: np.ndarray) -> DataFrame:
        """node, c: the candidate of largest Gini gain in every node that gains."""
        feature, threshold, trees, classes = self.feature, self.threshold, self.trees, self.classes
        first, (_, width, m) = 2**level - 1, picks.shape

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            side = [np.zeros(picks.size * classes) for _ in range(2)]
            for batch in batches:
                x, y, w = stacked(batch), batch["y"].to_numpy(), batch["weight"].to_numpy()
                at = descend(x, feature, threshold, level) - first
                for t in range(trees):
                    held = np.flatnonzero(at[t] >= 0)
                    for c in range(m):
                        slot = (t * width + at[t, held]) * m + c
                        right = x[held, picks[t, at[t, held], c]] > cuts[slot]
                        for k, mine in enumerate((~right, right)):
                            np.add.at(side[k], slot[mine] * classes + y[held[mine]], w[held[mine]])
            found = np.flatnonzero(side[0] + side[1] > 0)
            yield pd.DataFrame({"slot": found // classes, "y": found % classes, "l": side[0][found], "r": side[1][found]})

        both = rows.mapInPandas(run, "slot long, y long, l double, r double").groupBy("slot", "y").agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
        square = lambda e: F.sum(e * e)
        sums = both.groupBy("slot").agg(F.sum("l").alias("l"), F.sum("r").alias("r"), square(F.col("l")).alias("ll"), square(F.col("r")).alias("rr"), square(F.col("l") + F.col("r")).alias("whole"))
        gain = F.col("ll") / F.col("l") + F.col("rr") / F.col("r") - F.col("whole") / (F.col("l") + F.col("r"))
        scored = sums.where("l > 0 and r > 0").select(F.floor(F.col("slot") / m).alias("node"), (F.col("slot") % m).alias("c"), F.round(gain, 9).alias("gain"))
        return scored.where("gain > 0").groupBy("node").agg(F.max_by("c", F.struct("gain", -F.col("c"))).alias("c"))

    def _leaves(self, rows: DataFrame) -> np.ndarray:
        feature, threshold, depth, classes = self.feature, self.threshold, self.depth, self.classes

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros(feature.size * classes)
            for batch in batches:
                at = descend(stacked(batch), feature, threshold, depth)
                y, w = batch["y"].to_numpy(), batch["weight"].to_numpy()
                for t in range(len(feature)):
                    np.add.at(total, (t * feature.shape[1] + at[t]) * classes + y, w)
            found = np.flatnonzero(total)
            yield pd.DataFrame({"at": found, "w": total[found]})

        got = rows.mapInPandas(run, "at long, w double").groupBy("at").agg(F.sum("w").alias("w")).toPandas()
        total = np.zeros(feature.size * classes)
        total[got["at"].to_numpy(dtype=np.int64)] = got["w"]
        total = total.reshape(*feature.shape, classes)
        weight = total.sum(axis=2, keepdims=True)
        return np.where(weight > 0, total / np.where(weight > 0, weight, 1), 1 / classes)

    def fit(self, table: DataFrame, classes: int, width: int) -> ExtraTrees:
        rng = np.random.default_rng(self.seed)
        self.classes = classes
        m = self.candidates or max(1, int(np.sqrt(width)))
        self.feature = np.full((self.trees, 2 ** (self.depth + 1) - 1), -1, dtype=np.int32)
        self.threshold = np.zeros(self.feature.shape)
        rows = table.select(F.col("features").alias("x"), F.col("y").cast("long").alias("y"), F.col("weight").cast("double").alias("weight"))
        for level in range(self.depth):
            nodes = 2**level
            picks = rng.random((self.trees, nodes, width)).argsort(axis=2)[:, :, :m].astype(np.int32)
            draw = rng.random(picks.size)
            ranges = self._ranges(rows, level, picks).toPandas()
            slots = ranges["slot"].to_numpy(dtype=np.int64)
            cuts = np.full(picks.size, np.inf)
            cuts[slots] = ranges["lo"] + draw[slots] * (ranges["hi"] - ranges["lo"])
            chosen = self._splits(rows, level, picks, cuts).toPandas()
            if not len(chosen):
                break
            node, c = chosen["node"].to_numpy(dtype=np.int64), chosen["c"].to_numpy(dtype=np.int64)
            tree, inside = node // nodes, node % nodes
            self.feature[tree, nodes - 1 + inside] = picks[tree, inside, c]
            self.threshold[tree, nodes - 1 + inside] = cuts[node * m + c]
        self.value = self._leaves(rows)
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = descend(x, self.feature, self.threshold, self.depth)
        return sum(self.value[t, at[t]] for t in range(self.trees)) / self.trees

    def transform(self, table: DataFrame) -> DataFrame:
        model = self

        @F.pandas_udf(ArrayType(DoubleType()))
        def proba(x: pd.Series) -> pd.Series:
            return pd.Series(list(model.predict(stacked(pd.DataFrame({"x": x})))) if len(x) else [], dtype=object)

        return table.withColumn("proba", proba("features"))
