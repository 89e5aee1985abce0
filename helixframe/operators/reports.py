"""Checks and reports over predictions, folds, latent bases and runs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from helixframe.operators.ensemble import Rows, as_rows, climb, macro_f1

CORRELATION_LIMIT, SHIFT_LIMIT = 0.90, 1.80


def argmax_label(proba: Column, classes: Sequence[str]) -> Column:
    """Label of the first largest probability."""
    return F.element_at(F.array(*[F.lit(c) for c in classes]), F.array_position(proba, F.array_max(proba)).cast("int"))


def oof_faults(oof: DataFrame, samples: DataFrame, classes: Sequence[str], n_splits: int = 5, groups: DataFrame | None = None) -> DataFrame:
    """One row of counts over ``oof(sample_id, fold, y_true, y_pred, proba)``:
    rows, repeated and missing and unexpected identifiers, folds out of range,
    unknown labels, widths, values and sums of probabilities that are wrong,
    predictions that are not the first maximum, groups in several folds."""
    total = F.aggregate("proba", F.lit(0.0), lambda a, b: a + b)
    bad_value = F.exists("proba", lambda p: p.isNull() | F.isnan(p) | (p < 0) | (p > 1))
    count = lambda test: F.count_if(F.coalesce(test, F.lit(True))).alias
    rows = oof.agg(
        F.count(F.lit(1)).alias("rows"),
        (F.count("sample_id") - F.count_distinct("sample_id")).alias("repeated_ids"),
        count((F.col("fold") < 0) | (F.col("fold") >= n_splits))("bad_fold"),
        count(~F.col("y_true").isin(*classes) | ~F.col("y_pred").isin(*classes))("unknown_label"),
        count(F.size("proba") != len(classes))("bad_width"),
        count(bad_value)("bad_value"),
        count(F.abs(total - 1) > 1e-6)("bad_sum"),
        count(F.col("y_pred") != argmax_label(F.col("proba"), classes))("not_argmax"),
    )
    both = oof.select("sample_id", F.lit(1).alias("o")).distinct().join(samples.select("sample_id", F.lit(1).alias("s")).distinct(), "sample_id", "full")
    ids = both.agg(F.count_if(F.col("o").isNull()).alias("missing_ids"), F.count_if(F.col("s").isNull()).alias("unexpected_ids"))
    out = rows.crossJoin(ids)
    if groups is not None:
        split = oof.join(groups, "sample_id").groupBy("group_key").agg(F.count_distinct("fold").alias("n"))
        out = out.crossJoin(split.agg(F.count_if(F.col("n") > 1).alias("split_groups")))
    return out


def validate_oof(oof: DataFrame, samples: DataFrame, classes: Sequence[str], n_splits: int = 5, groups: DataFrame | None = None) -> None:
    """Raises with the counts of all faults that ``oof_faults`` finds."""
    found = {k: v for k, v in oof_faults(oof, samples, classes, n_splits, groups).first().asDict().items() if k != "rows" and v}
    if found:
        raise ValueError(f"out-of-fold table is not valid: {found}")


def pair_premises(train: DataFrame, pairs: dict[str, str], least: int = 3) -> DataFrame:
    """(premise, label, n) of the train profiles with ``least`` genes: groups of
    one label, groups of two opposite labels, and single rows by pair label."""
    table = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
    groups = train.where(F.col("n_genes") >= least).groupBy("profile_hash").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("low"), F.max("label").alias("high"))
    kind = (
        F.when((F.col("n") == 1) & table[F.col("low")].isNotNull(), "orphan").when((F.col("n") > 1) & (F.col("low") == F.col("high")), "same_label")
        .when((F.col("n") == 2) & (table[F.col("low")] == F.col("high")), "pair_label")
    )
    marked = groups.withColumn("premise", kind).where("premise is not null").withColumn("label", F.when(F.col("premise") == "orphan", F.col("low")).otherwise(""))
    return marked.groupBy("premise", "label").agg(F.count(F.lit(1)).alias("n"))


def broken_premises(premises: DataFrame, matched: DataFrame, watched: Sequence[str]) -> list[str]:
    """Why the pair rule must not be used; empty if all holds.  ``matched`` has
    matched_label and new_label of the test rows."""
    at = {(r["premise"], r["label"]): r["n"] for r in premises.collect()}
    hits = {r["matched_label"]: (r["n"], r["off"]) for r in matched.groupBy("matched_label").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("new_label").isNull()).alias("off")).collect()}
    out = []
    if at.get(("same_label", "")):
        out.append(f"{at[('same_label', '')]} groups of equal profiles have one label")
    if not at.get(("pair_label", "")):
        out.append("no group of opposite labels")
    out += [f"{x}: {at.get(('orphan', x), 0)} single rows, {hits.get(x, (0, 0))[0]} matches" for x in watched if at.get(("orphan", x), 0) != hits.get(x, (0, 0))[0]]
    off = {x: o for x, (_, o) in hits.items() if o}
    return out + ([f"matches off the pair labels: {off}"] if off else [])


def rand_index(one: DataFrame, two: DataFrame) -> DataFrame:
    """Adjusted Rand index of two partitions (item, part), from the contingency
    counts: one row, ``ari`` and ``n``."""
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    cells = one.select("item", F.col("part").alias("p")).join(two.select("item", F.col("part").alias("q")), "item").groupBy("p", "q").agg(F.count(F.lit(1)).alias("c"))
    total = cells.agg(pairs("c").alias("both"), F.sum("c").alias("n"))
    side = lambda k, name: cells.groupBy(k).agg(F.sum("c").alias("c")).agg(pairs("c").alias(name))
    joined = total.crossJoin(side("p", "a")).crossJoin(side("q", "b"))
    expected = F.col("a") * F.col("b") / F.greatest(F.col("n") * (F.col("n") - 1) / 2, F.lit(1.0))
    most = (F.col("a") + F.col("b")) / 2
    return joined.select(F.when(most == expected, 1.0).otherwise((F.col("both") - expected) / (most - expected)).alias("ari"), "n")


def latent_report(train: DataFrame, test: DataFrame, burden: DataFrame) -> DataFrame:
    """(component, burden_corr, train_mean_abs, test_mean_abs, shift_ratio) of
    projections (sample_id, latent); ``burden`` has sample_id and burden."""
    value = F.posexplode("latent").alias("component", "value")
    spread = F.stddev_pop("value") * F.stddev_pop("burden")
    correlation = F.when(spread > 1e-12, F.try_divide(F.covar_pop("value", "burden"), spread)).otherwise(0.0)  # a constant component has none
    inner = train.join(burden, "sample_id").select("burden", value).groupBy("component").agg(correlation.alias("burden_corr"), F.avg(F.abs("value")).alias("train_mean_abs"))
    outer = test.select(value).groupBy("component").agg(F.avg(F.abs("value")).alias("test_mean_abs"))
    return inner.join(outer, "component", "left").withColumn("shift_ratio", F.when(F.col("train_mean_abs") > 0, F.col("test_mean_abs") / F.col("train_mean_abs")))


def latent_verdict(report: DataFrame, leading: int = 3) -> DataFrame:
    """One row: largest |correlation| and median shift of the leading components,
    and ``stop`` where both pass their limits."""
    lead = report.where(F.col("component") < leading).agg(F.max(F.abs("burden_corr")).alias("leading_corr"), F.median("shift_ratio").alias("leading_shift"))
    return lead.withColumn("stop", F.coalesce((F.col("leading_corr") > CORRELATION_LIMIT) & (F.col("leading_shift") > SHIFT_LIMIT), F.lit(False)))


def ablation(results: DataFrame) -> DataFrame:
    """``results(config, macro_f1)`` with configs full, base, drop:<block> and
    add:<block> -> block, removal, addition, composite, best first.  Blocks
    without both runs are left out."""
    ends = results.where("config in ('full', 'base')").agg(F.max(F.when(F.col("config") == "full", F.col("macro_f1"))).alias("full"), F.max(F.when(F.col("config") == "base", F.col("macro_f1"))).alias("base"))
    way, block = F.substring_index("config", ":", 1), F.substring_index("config", ":", -1)
    runs = results.where("config like 'drop:%' or config like 'add:%'").groupBy(block.alias("block"))
    table = runs.agg(F.max(F.when(way == "drop", F.col("macro_f1"))).alias("drop"), F.max(F.when(way == "add", F.col("macro_f1"))).alias("add")).crossJoin(ends)
    scored = table.select("block", (F.col("full") - F.col("drop")).alias("removal"), (F.col("add") - F.col("base")).alias("addition")).withColumn("composite", F.col("removal") + F.col("addition"))
    return scored.where("composite is not null").orderBy(F.desc("composite"), "block")


def seed_report(logs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Run logs (stem, seed, macro_f1, and ``keys`` that seeds must share) ->
    stem, seeds, mean, sd, and ``mixed``: the keys that differ between seeds."""
    mixed = F.filter(F.array(*[F.when(F.count_distinct(F.coalesce(F.col(k).cast("string"), F.lit("\0"))) > 1, F.lit(k)) for k in keys]), lambda k: k.isNotNull())
    return logs.groupBy("stem").agg(F.count_distinct("seed").alias("seeds"), F.avg("macro_f1").alias("mean"), F.stddev_samp("macro_f1").alias("sd"), mixed.alias("mixed"))


def standing(logs: DataFrame) -> DataFrame:
    """Runs by macro F1, ties by the score on singletons."""
    return logs.withColumn("place", F.row_number().over(W.orderBy(F.desc("macro_f1"), F.desc("singleton_f1"), "stem")))


def sharpened(proba: np.ndarray, temperature: float) -> np.ndarray:
    q = np.maximum(proba, 1e-12) ** (1 / temperature)
    return q / q.sum(axis=-1, keepdims=True)


def _tempered(member: int, t: float, stack: np.ndarray) -> np.ndarray:
    return sharpened(stack[member], t)


def _log_loss(member: int, t: float, stack: np.ndarray, truth: np.ndarray) -> np.ndarray:
    return -np.log(sharpened(stack[member], t)[np.arange(len(truth)), truth])


def fit_temperatures(stack: np.ndarray | Rows, truth: np.ndarray | None = None, grid: Sequence[float] = (0.5, 0.7, 0.85, 1.0, 1.25, 1.5, 2.0, 3.0), by: str = "macro_f1") -> list[float]:
    """Each member's best temperature on its own, the first of the grid on ties.
    A power keeps the order of classes, so macro F1 ties but for rounding;
    ``by="log_loss"`` tells temperatures apart."""
    rows = as_rows(stack, truth)
    tries = [(k, t) for k in range(rows.members) for t in grid]
    if by == "macro_f1":
        loss = [-s for s in rows.scores([partial(_tempered, k, t) for k, t in tries])]
    else:
        loss = rows.mean([partial({"log_loss": _log_loss}[by], k, t) for k, t in tries])
    return [float(grid[int(np.argmin(loss[k * len(grid) : (k + 1) * len(grid)]))]) for k in range(rows.members)]


class PerClassBlender:
    """A row of member weights for each class, moved while macro F1 grows."""

    def __init__(self, steps: Sequence[float] = (0.25, -0.25, 0.1, -0.1), passes: int = 3):
        self.steps, self.passes = steps, passes

    @staticmethod
    def mix(stack: np.ndarray, weights: np.ndarray) -> np.ndarray:
        return np.einsum("mnc,cm->nc", stack, weights)

    def fit(self, stack: np.ndarray | Rows, truth: np.ndarray | None = None) -> PerClassBlender:
        rows = as_rows(stack, truth)
        m, c = rows.members, rows.classes
        moves = [(k, j, s) for k in range(c) for j in range(m) for s in self.steps]

        def change(w: np.ndarray, move: tuple[int, int, float]) -> np.ndarray | None:
            k, j, step = move
            row = w[k].copy()
            row[j] = max(0.0, row[j] + step)
            if row.sum() <= 0:
                return None
            trial = w.copy()
            trial[k] = row / row.sum()
            return trial

        w = np.full((c, m), 1 / m)
        mix = lambda weights, stack: np.einsum("mnc,cm->nc", stack, weights)
        best = rows.score(partial(mix, w))
        for _ in range(self.passes):
            before = best
            w, best = climb(rows, w, best, moves, change, mix)
            if best == before:
                break
        self.weights_, self.score_ = w, best
        return self


def crossfit_strategies(stack: np.ndarray, truth: np.ndarray, fold: np.ndarray) -> dict[str, float]:
    """Macro F1 of uniform, tempered and per-class blends, each fitted on the
    other folds."""
    c = stack.shape[2]
    out = {name: np.zeros(stack.shape[1:]) for name in ("uniform", "tempered", "per_class")}
    for f in np.unique(fold):
        fit, held = fold != f, fold == f
        temperatures = fit_temperatures(stack[:, fit], truth[fit])
        out["uniform"][held] = stack[:, held].mean(axis=0)
        out["tempered"][held] = np.mean([sharpened(p[held], t) for p, t in zip(stack, temperatures)], axis=0)
        out["per_class"][held] = PerClassBlender.mix(stack[:, held], PerClassBlender().fit(stack[:, fit], truth[fit]).weights_)
    return {name: macro_f1(truth, p.argmax(axis=1), c) for name, p in out.items()}
