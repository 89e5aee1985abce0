"""Blending, calibration and selection over out-of-fold probabilities.

A search judges its trials on every row.  Up to ``MOST_ROWS`` rows are one matrix
of the driver (``Held``); beyond, tasks count each trial's confusions and only
the counts are collected (``Spread``).  Both give the same values.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_ROWS = 200_000
Predict = Callable[[np.ndarray], np.ndarray]


def confusion(truth: np.ndarray, predicted: np.ndarray, classes: int) -> np.ndarray:
    return np.bincount(truth * classes + predicted, minlength=classes * classes).reshape(classes, classes)


def f1_of(counts: np.ndarray) -> float:
    """Macro F1 from a confusion matrix."""
    tp, total = np.diag(counts), counts.sum(axis=0) + counts.sum(axis=1)
    return float((2 * tp / np.maximum(total, 1))[total > 0].mean())


def macro_f1(truth: np.ndarray, predicted: np.ndarray, classes: int) -> float:
    """Mean F1 over the classes seen in either array; absent ones give 0."""
    return f1_of(confusion(truth, predicted, classes))


def better(score: float, best: float) -> bool:
    return score > best + 1e-12


class Held:
    """Rows as a matrix of the driver: stack (M, n, C), truth, fold."""

    def __init__(self, stack: np.ndarray, truth: np.ndarray, fold: np.ndarray | None = None):
        self.stack, self.truth, self.fold, self.members, self.classes = stack, truth, fold, stack.shape[0], stack.shape[2]

    def score(self, predict: Predict) -> float:
        return macro_f1(self.truth, predict(self.stack).argmax(axis=1), self.classes)

    def scores(self, predicts: Sequence[Predict]) -> list[float]:
        return [self.score(p) for p in predicts]

    def first(self, predicts: Sequence[Predict], best: float) -> tuple[int, float] | None:
        """Place and score of the first of ``predicts`` that is better."""
        return next(((k, s) for k, p in enumerate(predicts) if better(s := self.score(p), best)), None)

    def mean(self, losses: Sequence[Callable[[np.ndarray, np.ndarray], np.ndarray]]) -> list[float]:
        """Means over the rows of functions of (stack, truth)."""
        return [float(f(self.stack, self.truth).mean()) for f in losses]

    def folds(self) -> list[int]:
        return [int(f) for f in np.unique(self.fold)]

    def without(self, fold: int) -> Held:
        keep = self.fold != fold
        return Held(self.stack[:, keep], self.truth[keep], self.fold[keep])


class Spread:
    """The same over packed rows that stay in the tasks."""

    def __init__(self, rows: DataFrame, members: int, classes: int):
        self.rows, self.members, self.classes = rows, members, classes

    def _sums(self, of: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        shape = (self.members, self.classes)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = None
            for batch in batches:
                if len(batch):
                    part = of(unpacked(batch["p"], *shape), batch["truth"].to_numpy())
                    total = part if total is None else total + part
            if total is not None:
                yield pd.DataFrame({"sums": [total.astype(float)]})

        return np.sum([r["sums"] for r in self.rows.select("truth", "p").mapInPandas(run, "sums array<double>").collect()], axis=0)

    def scores(self, predicts: Sequence[Predict]) -> list[float]:
        if not predicts:
            return []
        c = self.classes
        counts = self._sums(lambda stack, truth: np.concatenate([confusion(truth, p(stack).argmax(axis=1), c).ravel() for p in predicts]))
        return [f1_of(k) for k in counts.reshape(-1, c, c)]

    def score(self, predict: Predict) -> float:
        return self.scores([predict])[0]

    def first(self, predicts: Sequence[Predict], best: float) -> tuple[int, float] | None:
        return next(((k, s) for k, s in enumerate(self.scores(predicts)) if better(s, best)), None)

    def mean(self, losses: Sequence[Callable[[np.ndarray, np.ndarray], np.ndarray]]) -> list[float]:
        sums = self._sums(lambda stack, truth: np.array([len(truth), *(f(stack, truth).sum() for f in losses)]))
        return [float(v / sums[0]) for v in sums[1:]]

    def folds(self) -> list[int]:
        return sorted(r["fold"] for r in self.rows.select("fold").distinct().collect())

    def without(self, fold: int) -> Spread:
        return Spread(self.rows.where(F.col("fold") != fold), self.members, self.classes)


Rows = Held | Spread


def unpacked(column: pd.Series, members: int, classes: int) -> np.ndarray:
    """(M, n, C) of flat arrays, each row of a member divided by its sum."""
    stack = np.stack(column.to_list()).reshape(-1, members, classes).transpose(1, 0, 2)
    return stack / stack.sum(axis=2, keepdims=True)


def pack(preds: DataFrame, classes: list[str], fold=None) -> tuple[DataFrame, int]:
    """``preds(sample_id, member, y_true, proba)`` -> every sample as one row
    (sample_id, truth, fold, p), written once, and the number of members."""
    order = F.create_map(*[F.lit(x) for kv in enumerate(classes) for x in reversed(kv)])
    flat = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("member", "proba"))), lambda x: x["proba"]))
    one = preds.groupBy("sample_id").agg(order[F.min("y_true")].cast("long").alias("truth"), flat.alias("p"))
    rows = one.withColumn("fold", F.lit(0) if fold is None else fold).checkpoint()
    width = rows.select(F.min(F.size("p")), F.max(F.size("p")), F.count_if(F.col("truth").isNull())).first()
    if width[0] != width[1] or width[0] % len(classes) or width[2]:
        raise ValueError("a sample lacks a member or a known class")
    return rows, width[0] // len(classes)


def searched(rows: DataFrame, members: int, classes: int) -> Rows:
    """The packed rows for a search, on the driver where they are few."""
    if rows.count() > MOST_ROWS:
        return Spread(rows, members, classes)
    held = rows.orderBy("sample_id").toPandas()
    return Held(unpacked(held["p"], members, classes), held["truth"].to_numpy(), held["fold"].to_numpy())


def as_rows(stack: np.ndarray | Rows, truth: np.ndarray | None) -> Rows:
    return Held(stack, truth) if isinstance(stack, np.ndarray) else stack


def climb(rows: Rows, state: np.ndarray, best: float, moves: Sequence, change: Callable, predict: Callable) -> tuple[np.ndarray, float]:
    """One pass over ``moves``: each that is better is kept, and the next starts
    from it; ``change(state, move)`` is None where a move is not possible."""
    at = 0
    while at < len(moves):
        tries = [(k, t) for k in range(at, len(moves)) if (t := change(state, moves[k])) is not None]
        if (found := rows.first([partial(predict, t) for _, t in tries], best)) is None:
            break
        best, (k, state) = found[1], tries[found[0]]
        at = k + 1
    return state, best


def blended(w: np.ndarray, stack: np.ndarray) -> np.ndarray:
    return np.tensordot(w, stack, 1)


def biased(weights: np.ndarray, bias: np.ndarray, stack: np.ndarray) -> np.ndarray:
    return np.log(np.maximum(blended(weights, stack), 1e-12)) + bias


class MacroF1Blender:
    """Convex weights by moving weight between members while macro F1 grows,
    from the uniform start and from every single member."""

    def __init__(self, steps: tuple[float, ...] = (0.25, 0.1, 0.05, 0.02, 0.01), passes: int = 5):
        self.steps, self.passes = steps, passes

    def fit(self, stack: np.ndarray | Rows, truth: np.ndarray | None = None) -> MacroF1Blender:
        rows = as_rows(stack, truth)
        m = rows.members
        moves = [(i, j) for i in range(m) for j in range(m) if i != j]
        self.score_, self.weights_ = -1.0, None

        def change(step: float, w: np.ndarray, move: tuple[int, int]) -> np.ndarray | None:
            i, j = move
            if w[i] <= 0:
                return None
            trial = w.copy()
            part = min(step, trial[i])
            trial[i] -= part
            trial[j] += part
            return trial

        for start in (np.full(m, 1 / m), *np.eye(m)):
            w, best = start.copy(), rows.score(partial(blended, start))
            for step in self.steps:
                for _ in range(self.passes):
                    before = best
                    w, best = climb(rows, w, best, moves, partial(change, step), blended)
                    if best == before:
                        break
            if better(best, self.score_):
                self.score_, self.weights_ = best, w
        return self


class GreedySelector:
    """Selection with replacement: each round adds the member that helps most;
    weights are the shares of picks."""

    def __init__(self, rounds: int = 30, start: int = 1):
        self.rounds, self.start = rounds, start

    def fit(self, stack: np.ndarray | Rows, truth: np.ndarray | None = None) -> GreedySelector:
        rows = as_rows(stack, truth)
        m = rows.members
        one = np.eye(m)
        alone = rows.scores([partial(blended, e) for e in one])
        picks = list(np.argsort([-s for s in alone], kind="stable")[: self.start])
        best, keep = -1.0, list(picks)
        for _ in range(self.rounds):
            total = np.bincount(picks, minlength=m).astype(float)
            scores = rows.scores([partial(blended, total + e) for e in one])
            k = int(np.argmax(scores))
            picks.append(k)
            if better(scores[k], best):
                best, keep = scores[k], list(picks)
        counts = np.bincount(keep, minlength=m)
        self.weights_, self.score_ = counts / counts.sum(), max(best, max(alone[:1]))
        return self


class LogitBias:
    """Additive class biases on log probabilities by coordinate search."""

    def __init__(self, steps: tuple[float, ...] = (0.5, 0.2, 0.1, 0.05, 0.02), bound: float = 2.0, passes: int = 4):
        self.steps, self.bound, self.passes = steps, bound, passes

    def fit(self, proba: np.ndarray | Rows, truth: np.ndarray | None = None, weights: np.ndarray | None = None) -> LogitBias:
        """Over one table of probabilities, or over rows blended by ``weights``."""
        rows = Held(proba[None], truth) if isinstance(proba, np.ndarray) else proba
        c = rows.classes
        predict = partial(biased, np.eye(rows.members)[0] if weights is None else weights)

        def change(b: np.ndarray, move: tuple[int, float]) -> np.ndarray:
            trial = b.copy()
            trial[move[0]] = np.clip(trial[move[0]] + move[1], -self.bound, self.bound)
            return trial

        bias, best = np.zeros(c), rows.score(partial(predict, np.zeros(c)))
        for step in self.steps:
            moves = [(k, way) for k in range(c) for way in (step, -step)]
            for _ in range(self.passes):
                before = best
                bias, best = climb(rows, bias, best, moves, change, predict)
                if best == before:
                    break
        self.bias_, self.score_ = bias - bias.mean(), best
        return self


def apply_weights(preds: DataFrame, weights: dict) -> DataFrame:
    """Weighted mean of the members' arrays: sample_id, proba."""
    table = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    one = preds.select("sample_id", F.posexplode("proba").alias("k", "p"), table[F.col("member")].alias("w"))
    mean = one.groupBy("sample_id", "k").agg((F.sum(F.col("p") * F.col("w")) / F.sum("w")).alias("p"))
    return mean.groupBy("sample_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "p"))), lambda x: x["p"]).alias("proba"))


def apply_bias(proba: DataFrame, bias) -> DataFrame:
    shifted = F.zip_with("proba", F.array(*[F.lit(float(b)) for b in bias]), lambda p, b: p * F.exp(b))
    total = F.aggregate("q", F.lit(0.0), lambda s, v: s + v)
    return proba.withColumn("q", shifted).withColumn("proba", F.transform("q", lambda v: v / total)).drop("q")


def crossfit(rows: Rows) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Fold -> weights and bias learned on all rows of the other folds."""
    out = {}
    for f in rows.folds():
        fit = rows.without(f)
        w = MacroF1Blender().fit(fit).weights_
        out[f] = w, LogitBias().fit(fit, weights=w).bias_
    return out


def apply_crossfit(packed: DataFrame, learned: dict[int, tuple[np.ndarray, np.ndarray]], members: int, classes: int) -> DataFrame:
    """sample_id, proba of every packed row by what its fold was given."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for f, part in batch.groupby("fold"):
                w, b = learned[int(f)]
                z = blended(w, unpacked(part["p"], members, classes)) * np.exp(b)
                yield pd.DataFrame({"sample_id": part["sample_id"], "proba": list(z / z.sum(axis=1, keepdims=True))})

    return packed.select("sample_id", "fold", "p").mapInPandas(run, "sample_id long, proba array<double>")
