"""Extremely randomised trees on tables whose classes are known."""

import numpy as np
import pytest

from helixframe.operators.extra_trees import ExtraTrees, descend

COLUMNS = "features array<double>, y long, weight double"


def test_descend():
    feature = np.array([[0, -1, 1, -1, -1, -1, -1]])
    threshold = np.array([[0.5, 0, 2.0, 0, 0, 0, 0]])
    assert descend(np.array([[0.5, 9.0], [0.6, 2.0], [0.6, 2.1]]), feature, threshold, 2).tolist() == [[1, 5, 6]]


def test_learns(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 4))
    y = (x[:, 0] > 0).astype(int) + 2 * (x[:, 1] > 0.3)
    rows = [([float(v) for v in r], int(c), 1.0) for r, c in zip(x, y)]
    table = spark.createDataFrame(rows[:400], COLUMNS).repartition(3)
    model = ExtraTrees(trees=20, depth=6, candidates=3, seed=1).fit(table, 4, 4)
    got = model.transform(spark.createDataFrame(rows[400:], COLUMNS)).toPandas()
    proba = np.stack(got["proba"].to_list())
    assert proba.sum(axis=1) == pytest.approx(1)
    assert (proba.argmax(axis=1) == got["y"]).mean() > 0.85
    # the rows' order and partitions change nothing
    again = ExtraTrees(trees=20, depth=6, candidates=3, seed=1).fit(table.orderBy("weight", "y").coalesce(1), 4, 4)
    assert (again.feature == model.feature).all() and np.allclose(again.threshold, model.threshold)


def test_edges(spark):
    """Missing values, one class, no row, weight that decides a tie."""
    none = ExtraTrees(trees=2, depth=2).fit(spark.createDataFrame([], COLUMNS), 3, 2)
    assert none.predict(np.zeros((1, 2))) == pytest.approx(1 / 3)
    one = ExtraTrees(trees=2, depth=2).fit(spark.createDataFrame([([1.0, float("nan")], 1, 1.0), ([2.0, None], 1, 1.0)], COLUMNS), 2, 2)
    assert (one.feature == -1).all() and one.predict(np.zeros((1, 2))).tolist() == [[0.0, 1.0]]
    tie = ExtraTrees(trees=1, depth=1).fit(spark.createDataFrame([([1.0], 0, 3.0), ([1.0], 1, 1.0)], COLUMNS), 2, 1)
    assert tie.predict(np.ones((1, 1))).tolist() == [[0.75, 0.25]]
