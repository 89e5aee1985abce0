"""Prediction files: round trip, marks, faults, whole files only."""

import pytest

from helixframe.sources import predictions as P


def test_round_trip(spark, tmp_path):
    scored = spark.createDataFrame([("a", [0.4, 0.4, 0.2], "Y"), ("b,\"x", [0.1, 1 / 3, 1 - 0.1 - 1 / 3], "Z")], "ID string, proba array<double>, y_true string")
    frame = P.prediction_frame(scored, ["X", "Y", "Z"])
    assert frame.columns == ["ID", "p_X", "p_Y", "p_Z", "y_true", "y_pred"]
    assert {r["ID"]: r["y_pred"] for r in frame.collect()} == {"a": "X", "b,\"x": "Z"}
    path = str(tmp_path / "oof.csv")
    P.write_csv_file(frame, path, mark=True)
    assert open(path, "rb").read().startswith(b"\xef\xbb\xbfID,p_X") and [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["oof.csv"]
    back, classes = P.read_predictions(spark, path)
    assert classes == ["X", "Y", "Z"]
    assert {r["ID"]: r["y_pred"] for r in P.prediction_frame(back, classes).collect()} == {"a": "X", "b,\"x": "Z"}
    with pytest.raises(FileExistsError):
        P.write_csv_file(frame, path)
    P.write_csv_file(frame.where("ID = 'a'"), path, overwrite=True)
    assert P.read_predictions(spark, path)[0].count() == 1


def test_faults(spark):
    ids = spark.createDataFrame([("a",), ("b",)], "ID string")
    frame = lambda rows: spark.createDataFrame(rows, "ID string, p_X double, p_Y double, y_pred string")
    assert P.schema_faults(frame([("a", 0.5, 0.5, "X"), ("b", 0.1, 0.9, "Y")]), ids, ["X", "Y"]) == []
    found = P.schema_faults(frame([("a", 0.5, None, "X"), ("a", 0.5, float("nan"), "X"), ("c", 0.5, 0.5, "X")]), ids, ["X", "Y"])
    assert found == ["1 repeated IDs", "2 rows without a number", "1 missing IDs", "1 unexpected IDs"]
    assert P.schema_faults(frame([]).drop("y_pred"), ids, ["X", "Y"])[0].startswith("columns")


def test_no_classes(spark, tmp_path):
    (tmp_path / "x.csv").write_text("ID,label\n1,A\n")
    with pytest.raises(ValueError):
        P.read_predictions(spark, str(tmp_path / "x.csv"))
