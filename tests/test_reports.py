"""Checks and reports on hand-made tables, and their queries against SQL."""

import itertools
from pathlib import Path

import numpy as np
import pytest

from helixframe.operators import reports

DATA = Path("/root/testdata/sf0.001")
duckdb = pytest.importorskip("duckdb")


def test_validate_oof(spark):
    columns = "sample_id long, fold int, y_true string, y_pred string, proba array<double>"
    good = [(1, 0, "A", "A", [0.5, 0.5]), (2, 1, "B", "B", [0.2, 0.8])]
    samples = spark.createDataFrame([(1,), (2,)], "sample_id long")
    groups = spark.createDataFrame([(1, 7), (2, 7)], "sample_id long, group_key long")
    frame = lambda rows: spark.createDataFrame(rows, columns)
    reports.validate_oof(frame(good), samples, ["A", "B"])
    with pytest.raises(ValueError, match="split_groups"):
        reports.validate_oof(frame(good), samples, ["A", "B"], groups=groups)
    bad = [(1, 9, "A", "B", [0.5, 0.5]), (1, 0, "C", "A", [0.7, 0.7]), (3, 0, "A", "A", [float("nan"), 0.5, 0.5]), (4, 1, "A", "A", [None, 1.0])]
    found = reports.oof_faults(frame(bad), samples, ["A", "B"]).first().asDict()
    assert found == {"rows": 4, "repeated_ids": 1, "bad_fold": 1, "unknown_label": 1, "bad_width": 1, "bad_value": 2, "bad_sum": 3, "not_argmax": found["not_argmax"], "missing_ids": 1, "unexpected_ids": 2}


def test_premises(spark):
    rows = [("KIRC", "a", 3), ("LGG", "b", 3), ("GBMLGG", "b", 3), ("KIRC", "c", 3), ("KIRC", "c", 3), ("LGG", "d", 2), ("BRCA", "e", 9)]
    train = spark.createDataFrame(rows, "label string, profile_hash string, n_genes int")
    from helixframe.functions.dims import PAIR_LABELS

    premises = reports.pair_premises(train, PAIR_LABELS)
    assert {tuple(r) for r in premises.collect()} == {("orphan", "KIRC", 1), ("pair_label", "", 1), ("same_label", "", 1)}
    matched = spark.createDataFrame([("KIRC", "KIPAN"), ("BRCA", None)], "matched_label string, new_label string")
    broken = reports.broken_premises(premises, matched, ["KIRC", "LGG"])
    assert len(broken) == 2 and "one label" in broken[0] and "BRCA" in broken[1]


def test_rand_index(spark):
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 3, 40), rng.integers(0, 4, 40)
    table = lambda x: spark.createDataFrame([(k, int(v)) for k, v in enumerate(x)], "item long, part int")
    pairs = list(itertools.combinations(range(40), 2))
    both = sum(a[i] == a[j] and b[i] == b[j] for i, j in pairs)
    one, two = sum(a[i] == a[j] for i, j in pairs), sum(b[i] == b[j] for i, j in pairs)
    expected = one * two / len(pairs)
    assert reports.rand_index(table(a), table(b)).first()["ari"] == pytest.approx((both - expected) / ((one + two) / 2 - expected))
    assert reports.rand_index(table(a), table(a)).first()["ari"] == pytest.approx(1)


def test_runs(spark):
    runs = [("full", 0.5), ("base", 0.4), ("drop:x", 0.45), ("add:x", 0.42), ("drop:y", 0.5), ("add:y", 0.39), ("drop:z", 0.1)]
    out = reports.ablation(spark.createDataFrame(runs, "config string, macro_f1 double")).collect()
    assert [r["block"] for r in out] == ["x", "y"] and out[0]["composite"] == pytest.approx(0.07)
    logs = spark.createDataFrame([("m", 1, 0.4, 5, 0.1), ("m", 2, 0.6, 6, 0.1), ("k", 1, 0.6, 5, 0.3)], "stem string, seed int, macro_f1 double, width int, singleton_f1 double")
    rows = {r["stem"]: r for r in reports.seed_report(logs, ["width"]).collect()}
    assert rows["m"]["mixed"] == ["width"] and rows["k"]["mixed"] == [] and rows["m"]["mean"] == pytest.approx(0.5)
    assert [r["stem"] for r in reports.standing(logs).orderBy("place").collect()] == ["k", "m", "m"]


def test_latent_verdict(spark):
    columns = "sample_id long, latent array<double>"
    train = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(1, 6)], columns)
    test = spark.createDataFrame([(9, [30.0, 1.0])], columns)
    burden = spark.createDataFrame([(k, 2 * k) for k in range(1, 6)], "sample_id long, burden long")
    report = reports.latent_report(train, test, burden)
    rows = {r["component"]: r for r in report.collect()}
    assert rows[0]["burden_corr"] == pytest.approx(1) and rows[0]["shift_ratio"] == pytest.approx(10)
    assert reports.latent_verdict(report).first()["stop"]


def test_blends():
    rng = np.random.default_rng(2)
    truth = rng.integers(0, 3, 300)
    stack = np.stack([np.eye(3)[truth] * w + rng.random((300, 3)) for w in (0.5, 0.2)])
    stack /= stack.sum(axis=2, keepdims=True)
    assert reports.fit_temperatures(stack, truth, (0.5, 1.0)) == [0.5, 0.5]
    found = reports.PerClassBlender().fit(stack, truth)
    assert np.allclose(found.weights_.sum(axis=1), 1)
    assert found.score_ >= reports.macro_f1(truth, stack.mean(axis=0).argmax(axis=1), 3)
    assert set(reports.crossfit_strategies(stack, truth, np.arange(300) % 3)) == {"uniform", "tempered", "per_class"}


@pytest.mark.skipif(not DATA.exists(), reason="no driver tables")
@pytest.mark.parametrize("name", ["pair_rule_premises", "oof_faults"])
def test_query(spark, name):
    from helixframe.plans import catalog

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem documents".split():
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    one, two = catalog.queries()[name](spark, str(DATA)).toPandas(), con.sql(catalog.oracle_sql()[name]).df()
    columns = sorted(one.columns)
    assert columns == sorted(two.columns)
    key = lambda x: sorted(map(tuple, x[columns].to_numpy().tolist()))
    assert key(one) == key(two)


@pytest.mark.skipif(not DATA.exists(), reason="no driver tables")
def test_searched_queries(spark):
    from helixframe.plans import catalog

    q = catalog.queries()
    assert q["temperature_fit"](spark, str(DATA)).count() == 3
    assert q["per_class_fit"](spark, str(DATA)).count() == 15
    assert q["latent_inspect"](spark, str(DATA)).count() == 8
    assert -1 <= q["module_seed_ari"](spark, str(DATA)).first()["ari"] <= 1
