import numpy as np
import pytest

from helixframe.operators import ensemble, groups, latent


@pytest.fixture(scope="module")
def profile(spark):
    rows = [(k, "AB"[k % 2], f"p{k // 3}", 4) for k in range(30)]
    return spark.createDataFrame(rows, "sample_id long, label string, profile_hash string, n_genes int")


def test_group_folds_isolate(profile):
    folds = groups.group_folds(groups.group_keys(profile), 5)
    groups.check_groups(folds)
    assert folds.count() == 30 and folds.select("fold").distinct().count() == 5


def test_stratified_folds(profile):
    counts = {(r["label"], r["fold"]): r["count"] for r in groups.stratified_folds(profile, 5).groupBy("label", "fold").count().collect()}
    assert set(counts.values()) == {3}


def test_fingerprint_ignores_order(spark, profile):
    a = groups.fingerprint(profile, ["sample_id", "label"]).first()
    b = groups.fingerprint(profile.orderBy("label", "sample_id"), ["sample_id", "label"]).first()
    c = groups.fingerprint(profile.limit(29), ["sample_id", "label"]).first()
    assert a == b and a != c


def test_connected(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 9), (5, 6)], "a long, b long")
    assert {r["node"]: r["label"] for r in groups.connected(edges).collect()} == {1: 1, 2: 1, 3: 1, 9: 1, 5: 5, 6: 5}


def test_pair_rule(spark):
    columns = "sample_id long, label string, profile_hash string, n_genes int"
    train = spark.createDataFrame([(1, "KIRC", "x", 3), (2, "LGG", "y", 5), (3, "LGG", "y", 5), (4, "BRCA", "z", 9), (5, "LGG", "w", 2)], columns)
    test = spark.createDataFrame([(10, None, "x", 3), (11, None, "y", 5), (12, None, "z", 9), (13, None, "w", 2)], columns)
    assert {(r["sample_id"], r["new_label"]) for r in groups.pair_rule(train, test).collect()} == {(10, "KIPAN"), (12, None)}


def test_searches():
    rng = np.random.default_rng(3)
    truth = rng.integers(0, 4, 400)
    good = np.eye(4)[truth] * 0.6 + rng.random((400, 4))
    stack = np.stack([good, rng.random((400, 4)), rng.random((400, 4))])
    stack /= stack.sum(axis=2, keepdims=True)
    found = ensemble.MacroF1Blender((0.25, 0.1), 2).fit(stack, truth)
    alone = ensemble.macro_f1(truth, stack[0].argmax(axis=1), 4)
    assert found.score_ >= alone and abs(found.weights_.sum() - 1) < 1e-9
    assert ensemble.GreedySelector(6).fit(stack, truth).weights_[0] >= 0.5
    bias = ensemble.LogitBias((0.5, 0.1), 2).fit(stack[0], truth)
    assert bias.score_ >= alone and abs(bias.bias_.mean()) < 1e-9


def test_latent(spark):
    rows = [(s, f"g{g}", 1.0 + (s * g) % 3) for s in range(40) for g in range(6) if (s + g) % 2]
    x = spark.createDataFrame(rows, "sample_id long, gene string, value double")
    names = [f"g{g}" for g in range(6)]
    v = latent.svd_components(x, names, 3)
    assert np.allclose(v @ v.T, np.eye(3), atol=1e-8) and latent.alignment(v, v) > 1 - 1e-9
    h = latent.nmf_components(x, names, 2, rounds=3)
    assert (h >= 0).all() and all(min(r["latent"]) >= 0 for r in latent.project(x, names, h, nonnegative=True).collect())
    assert latent.gene_modules(x, names, k=2, components=3).count() == 6


def test_streaming(spark, tmp_path):
    from helixframe.streaming.scoring import token_burden

    (tmp_path / "a.json").write_text('{"sample_id": 1, "gene": "A", "cell": "R1H K2fs"}\n{"sample_id": 1, "gene": "B", "cell": "WT"}\n{"sample_id": 2, "gene": "A", "cell": "R1R"}\n')
    cells = spark.readStream.schema("sample_id long, gene string, cell string").json(str(tmp_path))
    query = token_burden(cells).writeStream.outputMode("complete").format("memory").queryName("burden").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert {tuple(r) for r in spark.table("burden").collect()} == {(1, 2, 1, 1), (2, 1, 0, 0)}


def test_searches_use_every_row(spark, monkeypatch):
    """Beyond the driver's bound no sample is lost, and all searches give what
    they give on the whole matrix."""
    from helixframe.operators import reports

    rng = np.random.default_rng(5)
    truth = rng.integers(0, 3, 300)
    stack = np.stack([np.eye(3)[truth] * 0.5 + rng.random((300, 3)), np.eye(3)[truth] * 0.3 + rng.random((300, 3))])
    preds = spark.createDataFrame([(s, m, "abc"[truth[s]], stack[m, s].tolist()) for s in range(300) for m in range(2)], "sample_id long, member int, y_true string, proba array<double>")
    packed, members = ensemble.pack(preds, list("abc"), preds["sample_id"] % 3)
    held = ensemble.searched(packed, members, 3)
    monkeypatch.setattr(ensemble, "MOST_ROWS", 50)
    spread = ensemble.searched(packed, members, 3)
    assert isinstance(held, ensemble.Held) and isinstance(spread, ensemble.Spread)
    fits = (
        lambda r: ensemble.MacroF1Blender((0.25, 0.1), 2).fit(r).weights_, lambda r: ensemble.GreedySelector(3).fit(r).weights_, lambda r: ensemble.LogitBias((0.5,), 2).fit(r).bias_,
        lambda r: reports.fit_temperatures(r, by="log_loss"), lambda r: reports.PerClassBlender(passes=1).fit(r).weights_,
    )
    for fit in fits:
        assert np.allclose(fit(held), fit(spread))
    learned = ensemble.crossfit(held)
    out = {r["sample_id"]: r["proba"] for r in ensemble.apply_crossfit(packed, learned, members, 3).collect()}
    assert sorted(out) == list(range(300)) and sorted(learned) == [0, 1, 2]
    shares = stack / stack.sum(axis=2, keepdims=True)
    z = np.tensordot(learned[7 % 3][0], shares[:, 7], 1) * np.exp(learned[7 % 3][1])
    assert np.allclose(out[7], z / z.sum())


def test_crossfit_blend_keeps_every_sample(spark, monkeypatch):
    from pathlib import Path

    from helixframe.plans import catalog

    if not Path("/root/testdata/sf0.001").exists():
        pytest.skip("no driver tables")
    monkeypatch.setattr(ensemble, "MOST_ROWS", 100)
    few = {0: (np.full(3, 1 / 3), np.zeros(5))}
    monkeypatch.setattr(ensemble, "crossfit", lambda rows: {f: few[0] for f in range(5)})
    preds, _ = catalog._labelled_members(spark, "/root/testdata/sf0.001")
    assert catalog.crossfit_blend(spark, "/root/testdata/sf0.001").count() == preds.select("sample_id").distinct().count() > 100


def test_registered_queries_use_production_values(monkeypatch):
    from helixframe.operators import reports
    from helixframe.plans import catalog

    class Seen(Exception):
        pass

    def fit(self, *a, **k):
        raise Seen(vars(self))

    monkeypatch.setattr(catalog, "_labelled_members", lambda *a: (None, list("abc")))
    monkeypatch.setattr(catalog, "_rows", lambda *a: None)
    for query, kind, values in (
        ("blend_search", ensemble.MacroF1Blender, {"steps": (0.25, 0.1, 0.05, 0.02, 0.01), "passes": 5}),
        ("greedy_select", ensemble.GreedySelector, {"rounds": 30, "start": 1}),
        ("logit_bias_fit", ensemble.LogitBias, {"steps": (0.5, 0.2, 0.1, 0.05, 0.02), "bound": 2.0, "passes": 4}),
        ("per_class_fit", reports.PerClassBlender, {"steps": (0.25, -0.25, 0.1, -0.1), "passes": 3}),
    ):
        monkeypatch.setattr(kind, "fit", fit)
        with pytest.raises(Seen) as found:
            catalog.queries()[query](None, "")
        assert found.value.args[0] == values
    monkeypatch.setattr(catalog, "written", lambda *a: (1, 2))
    monkeypatch.setattr(catalog, "long_matrix", lambda *a, **k: (a, k))
    assert catalog.queries()["matrix_f11"](None, "") == (("f11", 1, 2), {})


def test_nmf_converges(spark):
    """A product of nonnegative factors is found again; eight rounds are not enough."""
    rng = np.random.default_rng(1)
    exact = rng.random((60, 3)) @ (rng.random((3, 8)) * (rng.random((3, 8)) > 0.4))
    names = [f"g{g}" for g in range(8)]
    x = spark.createDataFrame([(s, names[g], float(exact[s, g])) for s in range(60) for g in range(8) if exact[s, g]], "sample_id long, gene string, value double")
    error = lambda h: np.linalg.norm(exact - latent.weights(exact, h, 500) @ h) / np.linalg.norm(exact)
    few, many = latent.nmf_components(x, names, 3, rounds=8), latent.nmf_components(x, names, 3)
    assert error(many) < 0.75 * error(few)
