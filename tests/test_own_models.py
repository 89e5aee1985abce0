"""Boosted trees, ridge regression and set encoders against plain numpy."""

import numpy as np
import pandas as pd
import pytest

from helixframe.operators.boosted import BoostedTrees, softmax
from helixframe.operators.ridge import Ridge
from helixframe.operators.set_encoder import IDS, SetEncoder, collated, segments


def table_of(spark, x, y, weight):
    rows = [(k, [float(v) for v in r], int(t), float(w)) for k, (r, t, w) in enumerate(zip(x, y, weight))]
    return spark.createDataFrame(rows, "sample_id long, features array<double>, y long, weight double").repartition(3)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 4))
    y = (x[:, 0] > 0.3).astype(int) + (x[:, 1] + 0.2 * rng.normal(size=300) > 0.5)
    return x, y, rng.uniform(0.5, 2, 300)


def plain_boosting(model, x, y, weight, rounds, depth):
    """Margins after some rounds, by exhaustive search over the model's bins."""
    codes, z = model.codes(x), np.zeros((len(x), model.classes))
    for _ in range(rounds):
        p, step = softmax(z), np.zeros_like(z)
        for k in range(model.classes):
            g, h = weight * (p[:, k] - (y == k)), weight * p[:, k] * (1 - p[:, k])
            parts = [np.arange(len(x))]
            for _ in range(depth):
                fresh = []
                for part in parts:
                    best = (model.least_gain, None)
                    score = lambda at: g[at].sum() ** 2 / (h[at].sum() + model.ridge)
                    for f in range(x.shape[1]):
                        for cut in range(model.bins - 1):
                            low, high = part[codes[part, f] <= cut], part[codes[part, f] > cut]
                            if min(h[low].sum(), h[high].sum()) >= model.least_weight:
                                gain = round(score(low) + score(high) - score(part), 9)
                                if gain > best[0]:
                                    best = (gain, (low, high))
                    fresh += best[1] or [part]
                parts = fresh
            for part in parts:
                step[part, k] = -model.rate * g[part].sum() / (h[part].sum() + model.ridge)
        z += step
    return z


def test_boosted_trees_against_plain_search(spark, rows):
    x, y, weight = rows
    model = BoostedTrees(rounds=2, depth=2, bins=8).fit(table_of(spark, x, y, weight), 3, 4)
    assert np.abs(model.margins(model.codes(x)) - plain_boosting(model, x, y, weight, 2, 2)).max() < 1e-8


def test_boosted_trees_learn(spark, rows):
    x, y, weight = rows
    table = table_of(spark, x, y, weight)
    model = BoostedTrees(rounds=8, depth=3).fit(table, 3, 4)
    got = model.transform(table).collect()
    assert np.mean([int(np.argmax(r["proba"])) == r["y"] for r in got]) > 0.95 and abs(sum(got[0]["proba"]) - 1) < 1e-9
    empty = BoostedTrees(rounds=2).fit(table.limit(0), 3, 4)
    assert np.allclose(empty.predict(x[:2]), 1 / 3)


def test_ridge_against_closed_form(spark, rows):
    x, y, weight = rows
    model = Ridge(2.0).fit(table_of(spark, x, y, weight), 3, 4)
    z = np.c_[x, np.ones(len(x))]
    want = np.linalg.solve((z * weight[:, None]).T @ z + np.diag([2.0] * 4 + [1e-9]), (z * weight[:, None]).T @ np.eye(3)[y])
    assert np.allclose(model.weights, want)


@pytest.mark.parametrize("genes, smoothing, focal", [(True, 0.0, 0.0), (False, 0.05, 0.0), (True, 0.1, 2.0)])
def test_set_encoder_gradient(genes, smoothing, focal):
    """Every parameter's gradient against finite differences, with a sample that
    has no token, a gene of two tokens, and dense features."""
    rng = np.random.default_rng(2)
    model = SetEncoder([5, 4, 6, 6, 7], dense=2, size=3, hidden=4, genes=genes, smoothing=smoothing, focal=focal)
    p = model.draw(3)
    ids = [np.column_stack([np.sort(rng.integers(0, 5, n)), *[rng.integers(0, s, n) for s in (4, 6, 6, 7)]]).ravel() for n in (4, 0, 1, 6)]
    batch = pd.DataFrame({"ids": ids, "x": [rng.normal(size=2) for _ in ids], "y": [0, 1, 2, 1], "weight": [1.0, 2.0, 0.5, 1.0]})
    value, gradient = model.gradient(p, batch)
    for name, g in gradient.items():
        for at in list(np.ndindex(g.shape))[:: max(1, g.size // 6)]:
            moved = []
            for e in (1e-6, -1e-6):
                q = {k: v.copy() for k, v in p.items()}
                q[name][at] += e
                moved.append(model.gradient(q, batch)[0])
            assert abs((moved[0] - moved[1]) / 2e-6 - g[at]) < 1e-5, (name, at)


def test_set_encoder_learns(spark):
    """Classes told by a gene and kind, from rows of token ids; samples without
    tokens are predicted too."""
    rng = np.random.default_rng(3)
    tokens, samples = [], []
    for s in range(160):
        y = s % 2
        samples.append((s, y))
        if s % 40:
            tokens += [(s, int(g), 1 + int(rng.integers(3)), 1, 2, 3) for g in rng.integers(2, 9, 4)] + ([(s, 1, 2, 1, 2, 3)] if y else [])
    table = collated(spark.createDataFrame(tokens, "sample_id long, " + ", ".join(f"{c} int" for c in IDS)), spark.createDataFrame(samples, "sample_id long, y long")).selectExpr("*", "1.0D AS weight").repartition(3)
    model = SetEncoder([10, 5, 5, 5, 5], size=6, hidden=8, steps=60, rate=0.05).fit(table, 2)
    got = model.transform(table).collect()
    assert np.mean([int(np.argmax(r["proba"])) == r["y"] for r in got if len(r["ids"])]) > 0.95 and len(got) == 160
    assert model.losses[-1][0] < model.losses[0][0]
    flat, gene, sample = segments(pd.Series([[1, 1, 1, 1, 1, 1, 2, 2, 2, 2, 3, 1, 1, 1, 1], [], [3, 1, 1, 1, 1]]))
    assert gene.tolist() == [0, 0, 1, 2] and sample.tolist() == [0, 0, 2] and flat.shape == (4, 5)
