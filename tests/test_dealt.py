"""matrix_f11's tokens in buckets by sample, and its latent fits over equal rows."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.operators import latent
from helixframe.sources import tables

TRAIN = "sample_id % 5 <> 0"


@pytest.fixture(scope="module")
def star(spark, tmp_path_factory):
    """Few lines, repeated ones and ones without a quantity among them."""
    d = str(tmp_path_factory.mktemp("star"))
    lines = [(k % 37, k % 4, k % 30, k % 3, None if k % 6 == 0 else float(k % 11), float(k % 2)) for k in range(300)] * 2
    for name, rows, schema in (
        ("region", [(0, "A"), (1, "B")], "r_regionkey long, r_name string"),
        ("nation", [(0, 0), (1, 1)], "n_nationkey long, n_regionkey long"),
        ("supplier", [(k, k % 2) for k in range(3)], "s_suppkey long, s_nationkey long"),
        ("part", [(k, f"G{k % 7}") for k in range(30)], "p_partkey long, p_brand string"),
        ("lineitem", lines, "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double"),
    ):
        spark.createDataFrame(rows, schema).write.parquet(f"{d}/{name}.parquet")
    return d


@pytest.mark.parametrize("most", [tables.MOST_TOKENS, 0])
def test_dealt_tokens_are_the_variants(spark, star, monkeypatch, most):
    monkeypatch.setattr(tables, "MOST_TOKENS", most)
    monkeypatch.setattr(tables, "BUCKET_TOKENS", 200)
    want = tables.star_variants(spark, star).drop("seq")
    found, parts = tables.star_dealt(spark, star)
    assert parts == 3
    count = lambda df: collections.Counter(map(tuple, df.select(want.columns).collect()))
    assert count(found) == count(want)
    assert want.where("token is null").count()
    if most:
        grouped = found.groupBy("sample_id", "gene", "dkind").agg(F.count(F.lit(1)))
        assert "Exchange hashpartitioning" not in grouped._jdf.queryExecution().executedPlan().toString()


def test_equal_rows_are_fitted_once(spark, monkeypatch):
    genes = spark.range(400).selectExpr("id AS sample_id", "explode(filter(array('a', 'b', 'c', 'd'), (g, i) -> (id % 13 + 1) & (1 << i) > 0)) AS gene").union(spark.sql("SELECT CAST(NULL AS BIGINT), 'a'")).checkpoint()
    x, names = latent.matrix(genes)
    rows, same = latent.packed(genes)
    assert names == same == list("abcd")
    for df in (x, rows):
        n = [r["n"] for r in latent.fit_rows(df.where(TRAIN), names).collect()]
        assert len(n) == 13 and sum(n) == 320
    exact = np.zeros((400, 4))
    for r in x.collect():
        exact[r["sample_id"], names.index(r["gene"])] = r["value"]
    train = exact[np.arange(400) % 5 != 0]
    spark.sparkContext.setJobGroup("fit", "fit")
    few = latent.nmf_components(rows.where(TRAIN), names, 3, rounds=15)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("fit"))
    spark.sparkContext.setJobGroup("", "")
    assert jobs <= 12, "no job a round"
    monkeypatch.setattr(latent, "MOST_CELLS", 0)
    assert np.allclose(few, latent.nmf_components(x.where(TRAIN), names, 3, rounds=15))
    for most in (latent.DENSE_GENES, 0):
        monkeypatch.setattr(latent, "DENSE_GENES", most)
        assert np.allclose(latent.gram(rows.where(TRAIN), names), train.T @ train)
    placed = {r["sample_id"]: r["latent"] for r in latent.project(rows, names, few, nonnegative=True).collect()}
    assert np.allclose([placed[k] for k in range(400)], latent.weights(exact, few, 60))
