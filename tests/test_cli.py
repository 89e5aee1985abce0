"""The command line from a wide file to a submission."""

import json

import numpy as np
import pytest

from helixframe import cli


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    """Two classes that mutate different genes; strings as identifiers."""
    folder = tmp_path_factory.mktemp("wide")
    rng = np.random.default_rng(11)
    genes = [f"G{k}" for k in range(6)]

    def rows(prefix, n, label):
        for k in range(n):
            kind = k % 2
            cells = [f"R{rng.integers(1, 90)}H" if rng.random() < (0.9 if (g < 3) == (kind == 0) else 0.1) else "WT" for g in range(6)]
            yield ",".join([f"{prefix}_{k}", *(["AB"[kind]] if label else []), *cells])

    (folder / "train.csv").write_text("﻿" + "\n".join([",".join(["ID", "SUBCLASS", *genes]), *rows("TRAIN", 60, True)]) + "\n")
    (folder / "test.csv").write_text("\n".join([",".join(["ID", *genes]), *rows("TEST", 10, False)]) + "\n")
    (folder / "sample.csv").write_text("ID,SUBCLASS\n" + "".join(f"TEST_{k},A\n" for k in range(10)))
    return folder


def test_way_to_a_submission(spark, files, tmp_path, capsys):
    out = str(tmp_path / "out")
    cli.main(["train", "extra_trees", "--config", "f3", "--folds", "2", "--input", str(files / "train.csv"), "--test", str(files / "test.csv"), "--output", out, "--params", '{"trees": 8, "depth": 3}'], spark)
    assert float(capsys.readouterr().out.split()[-1]) > 0.85
    assert json.loads((tmp_path / "out" / "runs.jsonl").read_text())["stem"] == "extra_trees_f3_skf"
    cli.main(["submit", "--sample", str(files / "sample.csv"), "--predictions", f"{out}/test.csv", "--output", f"{out}/submission.csv"], spark)
    lines = (tmp_path / "out" / "submission.csv").read_text("utf-8-sig").splitlines()
    assert lines[0] == "ID,SUBCLASS" and sorted(x.split(",")[0] for x in lines[1:]) == sorted(f"TEST_{k}" for k in range(10))
    assert np.mean([x == f"TEST_{k},{'AB'[k % 2]}" for x in lines[1:] for k in [int(x.split(",")[0][5:])]]) >= 0.8
    cli.main(["blend", f"{out}/oof.csv", f"{out}/oof.csv", "--output", f"{out}/blend.csv"], spark)
    assert len((tmp_path / "out" / "blend.csv").read_text().splitlines()) == 61


def test_fold_rule(spark, files):
    """A held-out or test sample never has a train number, and all others do."""
    from helixframe.operators import training

    rows = training.numbered(spark.createDataFrame([(f"s{k}", "A", k % 3 if k < 9 else None) for k in range(12)], "sample_id string, label string, fold int"))
    variants = spark.createDataFrame([("s1", "A", "G")], "sample_id string, label string, gene string")
    for held in range(3):
        tokens, samples, key = training.coded(variants, rows, held)
        found = {r["own_id"]: r["sample_id"] % 5 != 0 for r in key.collect()}
        assert found == {f"s{k}": k < 9 and k % 3 != held for k in range(12)}
        assert samples.count() == 12 and tokens.count() == 1 and key.select("sample_id").distinct().count() == 12


def test_weights(spark):
    from helixframe.operators.training import sample_weights

    rows = spark.createDataFrame([("A", 1), ("A", 1), ("A", 2), ("B", 3)], "label string, group_key int")
    got = sorted(tuple(r) for r in sample_weights(rows, "balanced+group").collect())
    raw = [2 / 3 / 2, 2 / 3 / 2, 2 / 3, 2.0]
    assert [w for *_, w in got] == pytest.approx([w / (sum(raw) / 4) for w in raw])
    with pytest.raises(ValueError):
        sample_weights(rows, "other")


def test_features_and_folds(spark, files, tmp_path):
    cli.main(["features", "sample_burden25", "--input", str(files / "train.csv"), "--output", str(tmp_path / "b")], spark)
    assert spark.read.parquet(str(tmp_path / "b")).count() == 60
    cli.main(["folds", "--cv", "sgkf", "--folds", "3", "--input", str(files / "train.csv"), "--output", str(tmp_path / "f")], spark)
    assert {r["fold"] for r in spark.read.parquet(str(tmp_path / "f")).collect()} == {0, 1, 2}


def test_ladder_and_search_go_on(spark, files, tmp_path, capsys):
    common = ["--folds", "2", "--input", str(files / "train.csv"), "--output", str(tmp_path)]
    cli.main(["ladder", "--configs", "f1", "--models", "logistic", *common], spark)
    cli.main(["ladder", "--configs", "f1", "--models", "logistic", *common], spark)
    assert len((tmp_path / "runs.jsonl").read_text().splitlines()) == 1
    cli.main(["tune", "logistic", "--config", "f1", "--trials", "1", *common], spark)
    cli.main(["tune", "logistic", "--config", "f1", "--trials", "2", *common], spark)
    trials = [json.loads(x) for x in (tmp_path / "logistic_f1.jsonl").read_text().splitlines()]
    assert [t["number"] for t in trials] == [0, 1] and trials[0]["params"] == {"regParam": 0.01} and all(t["state"] == "complete" for t in trials)


def test_settings_and_ablations(tmp_path):
    """Options of a file, which the command line overrides; runs of an ablation."""
    from helixframe.cli import ablations, arguments

    file = tmp_path / "run.yaml"
    file.write_text("config: f1\nfolds: 3\nparams: {numTrees: 2}\noverwrite: true\n")
    got = arguments(["train", "rf", "--settings", str(file), "--folds", "4", "--input", "a", "--output", "b"])
    assert (got.config, got.folds, got.params, got.overwrite) == ("f1", 4, '{"numTrees": 2}', True)
    assert ablations(("a", "b", "c", "d"), ["b", "d"]) == {"full": ("a", "b", "c", "d"), "drop:b": ("a", "c", "d"), "drop:d": ("a", "b", "c"), "base": ("a", "c"), "add:b": ("a", "b", "c"), "add:d": ("a", "c", "d")}
    with pytest.raises(ValueError):
        ablations(("a",), ["z"])


def test_line_profiles(spark, tmp_path):
    from helixframe.operators.groups import line_profiles

    path = tmp_path / "wide.csv"
    path.write_text("ID,SUBCLASS,APC,MET\r\n1,X,C9*,WT\r\n\r\n2,Y,C9*,WT\r\n3,Y,C9*,D4fs\r\n4,X,,NA\r\n")
    got = {r["sample_id"]: r for r in line_profiles(spark, str(path)).collect()}
    assert {k: (r["label"], r["n_genes"]) for k, r in got.items()} == {"1": ("X", 1), "2": ("Y", 1), "3": ("Y", 2), "4": ("X", 0)}
    assert got["1"]["profile_hash"] == got["2"]["profile_hash"] != got["3"]["profile_hash"]
