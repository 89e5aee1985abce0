"""Boosted multiclass trees on the softmax loss, grown over a distributed table.

Every round adds one regression tree a class, fitted to the gradient of the
weighted cross-entropy by Newton steps.  All trees of a round grow together, one
pass over the rows a level: tasks sum gradients and curvatures into histograms
per (class, node), which are added up and searched for the best split where they
meet.  What is shuffled is bounded by tasks x classes x nodes x features x bins,
what reaches the driver is one split a node; neither grows with the rows.

Features are cut into at most ``bins`` bins of about equal weight, found from
histograms of ``FINE`` equal stretches between each feature's ends, and written
once as one byte a feature.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from helixframe.operators.extra_trees import stacked
from helixframe.sources.shared import write_once

FINE = 1024


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _sum(group: pd.DataFrame) -> pd.DataFrame:
    """Histograms of one slot, added up."""
    total = sum(np.frombuffer(x, np.float64) for x in group["hist"])
    return pd.DataFrame({"slot": group["slot"].iloc[:1], "hist": [total.tobytes()]})


class BoostedTrees:
    """``fit`` reads features (an array column), y and weight; ``transform`` adds
    ``proba``.  Missing values count as 0.  A node is split where the gain is over
    ``least_gain`` and both sides have the curvature ``least_weight``; a leaf is
    ``-rate G / (H + ridge)``.  An empty table gives equal shares."""

    def __init__(self, rounds: int = 10, depth: int = 3, rate: float = 0.3, ridge: float = 1.0, bins: int = 32, least_gain: float = 1e-6, least_weight: float = 1e-3):
        self.rounds, self.depth, self.rate, self.ridge, self.bins = rounds, depth, rate, ridge, bins
        self.least_gain, self.least_weight = least_gain, least_weight

    def _edges(self, rows: DataFrame) -> np.ndarray:
        """Inner edges of the bins, (width, bins - 1); unused ones are infinite."""
        width = self.width

        def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            low, high = np.full(width, np.inf), np.full(width, -np.inf)
            for batch in batches:
                x = stacked(batch)
                low, high = np.minimum(low, x.min(axis=0)), np.maximum(high, x.max(axis=0))
            yield pd.DataFrame({"k": np.arange(width), "low": low, "high": high})

        found = rows.mapInPandas(ends, "k long, low double, high double").groupBy("k").agg(F.min("low").alias("low"), F.max("high").alias("high")).toPandas().sort_values("k")
        if not len(found):
            return np.full((width, self.bins - 1), np.inf)
        low, high = found["low"].to_numpy(), found["high"].to_numpy()
        span = np.where(high > low, high - low, 1.0)

        def fine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((width, FINE))
            for batch in batches:
                at = np.clip((stacked(batch) - low) / span * FINE, 0, FINE - 1).astype(np.int64)
                w = batch["weight"].to_numpy()
                for k in range(width):
                    total[k] += np.bincount(at[:, k], weights=w, minlength=FINE)
            yield pd.DataFrame({"slot": np.arange(width), "hist": [t.tobytes() for t in total]})

        got = rows.mapInPandas(fine, "slot long, hist binary").groupBy("slot").applyInPandas(_sum, "slot long, hist binary").toPandas()
        edges = np.full((width, self.bins - 1), np.inf)
        for k, hist in zip(got["slot"], got["hist"]):
            upto = np.cumsum(np.frombuffer(hist, np.float64))
            cuts = np.unique(np.searchsorted(upto, upto[-1] * np.arange(1, self.bins) / self.bins))
            cuts = cuts[cuts < FINE - 1]
            edges[k, : len(cuts)] = low[k] + span[k] * (cuts + 1) / FINE
        return edges

    def codes(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, v, side="right") for e, v in zip(self.edges, x.T)]).astype(np.uint8)

    def nodes(self, codes: np.ndarray, feature: np.ndarray, cut: np.ndarray, levels: int) -> np.ndarray:
        """Heap number of each row's node in one tree."""
        at, rows = np.zeros(len(codes), np.int64), np.arange(len(codes))
        for _ in range(levels):
            f = feature[at]
            at = np.where(f >= 0, 2 * at + 1 + (codes[rows, np.maximum(f, 0)] > cut[at]), at)
        return at

    def margins(self, codes: np.ndarray) -> np.ndarray:
        out = np.zeros((len(codes), self.classes))
        for trees in self.trees:
            for k, (feature, cut, value) in enumerate(trees):
                out[:, k] += value[self.nodes(codes, feature, cut, self.depth)]
        return out

    def _pass(self, rows: DataFrame, grown: list, level: int) -> DataFrame:
        """Best split and sums of every node of the level, of all classes:
        (slot, feature, cut, gain, g, h)."""
        own, first, width, bins, classes = self, 2**level - 1, self.width, self.bins, self.classes

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total: dict[int, np.ndarray] = {}
            for batch in batches:
                codes = np.frombuffer(b"".join(batch["codes"]), np.uint8).reshape(-1, width)
                p, y, w = softmax(own.margins(codes)), batch["y"].to_numpy(), batch["weight"].to_numpy()
                for k in range(classes):
                    g, h = w * (p[:, k] - (y == k)), w * np.maximum(p[:, k] * (1 - p[:, k]), 1e-12)
                    at = own.nodes(codes, *grown[k][:2], level) - first
                    for node in np.unique(at[at >= 0]):
                        held = at == node
                        hist = total.setdefault(k * 2**level + int(node), np.zeros((2, width, bins)))
                        for f in range(width):
                            hist[0, f] += np.bincount(codes[held, f], weights=g[held], minlength=bins)
                            hist[1, f] += np.bincount(codes[held, f], weights=h[held], minlength=bins)
            yield pd.DataFrame({"slot": list(total), "hist": [x.tobytes() for x in total.values()]}).astype({"slot": "int64"})

        def best(group: pd.DataFrame) -> pd.DataFrame:
            g, h = np.frombuffer(_sum(group)["hist"].iloc[0], np.float64).reshape(2, width, bins)
            whole_g, whole_h = g[0].sum(), h[0].sum()
            left_g, left_h = np.cumsum(g, axis=1)[:, :-1], np.cumsum(h, axis=1)[:, :-1]
            gain = left_g**2 / (left_h + own.ridge) + (whole_g - left_g) ** 2 / (whole_h - left_h + own.ridge) - whole_g**2 / (whole_h + own.ridge)
            gain = np.where((left_h >= own.least_weight) & (whole_h - left_h >= own.least_weight), np.round(gain, 9), -np.inf)
            f, cut = np.unravel_index(int(gain.argmax()), gain.shape)
            return pd.DataFrame({"slot": group["slot"].iloc[:1], "feature": int(f), "cut": int(cut), "gain": float(gain[f, cut]), "g": whole_g, "h": whole_h})

        hists = rows.mapInPandas(run, "slot long, hist binary")
        return hists.groupBy("slot").applyInPandas(best, "slot long, feature int, cut int, gain double, g double, h double")

    def fit(self, table: DataFrame, classes: int, width: int) -> BoostedTrees:
        self.classes, self.width, self.trees = classes, width, []
        rows = table.select(F.col("features").alias("x"), F.col("y").cast("long").alias("y"), F.col("weight").cast("double").alias("weight"))
        self.edges = self._edges(rows)
        own = self

        def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    yield pd.DataFrame({"codes": [c.tobytes() for c in own.codes(stacked(batch))], "y": batch["y"], "weight": batch["weight"]})

        rows = write_once(rows.mapInPandas(coded, "codes binary, y long, weight double"), "codes")
        size = 2 ** (self.depth + 1) - 1
        for _ in range(self.rounds):
            grown = [(np.full(size, -1), np.zeros(size, np.int64), np.zeros(size)) for _ in range(classes)]
            for level in range(self.depth + 1):
                found = self._pass(rows, grown, level).toPandas()
                for r in found.itertuples():
                    feature, cut, value = grown[r.slot // 2**level]
                    at = 2**level - 1 + r.slot % 2**level
                    value[at] = -self.rate * r.g / (r.h + self.ridge)
                    if level < self.depth and r.gain > self.least_gain:
                        feature[at], cut[at] = r.feature, r.cut
                if not any((f[2**level - 1 : 2 ** (level + 1) - 1] >= 0).any() for f, _, _ in grown):
                    break
            self.trees.append(grown)
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return softmax(self.margins(self.codes(x)))

    def transform(self, table: DataFrame) -> DataFrame:
        model = self

        @F.pandas_udf(ArrayType(DoubleType()))
        def proba(x: pd.Series) -> pd.Series:
            return pd.Series(list(model.predict(stacked(pd.DataFrame({"x": x})))) if len(x) else [], dtype=object)

        return table.withColumn("proba", proba("features"))
