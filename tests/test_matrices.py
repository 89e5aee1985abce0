"""Matrices that are run block by block: the rows of the whole text, out of plans
that are short each."""

from functools import partial
from pathlib import Path

import pytest
from pyspark.sql import DataFrameWriter

from helixframe.operators import latent
from helixframe.plans.catalog import oracle_sql, queries
from helixframe.plans.matrices import LATENT, config_text
from helixframe.plans.oracle import oracle

DATA = Path("/root/testdata/sf0.001")
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no driver tables")
#: Exchanges of the longest plan; the whole text of f4rc has several times as many.
MOST_EXCHANGES = 40


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


@pytest.fixture
def plans(monkeypatch):
    """Exchanges of every table that is written."""
    seen, write = [], DataFrameWriter.parquet

    def parquet(self, *a, **k):
        seen.append(exchanges(self._df))
        return write(self, *a, **k)

    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    return seen


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem".split():
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def rows(found):
    return sorted(map(tuple, found))


@pytest.mark.parametrize("name", ["matrix_f4rc", "matrix_f5"])
def test_short_plans(spark, plans, con, name):
    df = queries()[name](spark, str(DATA))
    assert max(*plans, exchanges(df)) <= MOST_EXCHANGES, (plans, exchanges(df))
    assert rows(df.select("sample_id", "feature", "value").collect()) == rows(con.sql(f"SELECT sample_id, feature, value FROM ({oracle_sql()[name]}) x").fetchall())


def test_short_plans_with_latent_blocks(spark, plans, con, monkeypatch):
    """The portable blocks of f11 against SQL; few rounds, as only the others are compared."""
    monkeypatch.setattr(latent, "nmf_components", partial(latent.nmf_components, rounds=2))
    df = queries()["matrix_f11"](spark, str(DATA))
    assert max(*plans, exchanges(df)) <= MOST_EXCHANGES, (plans, exchanges(df))
    found = rows(df.select("sample_id", "feature", "value").collect())
    assert {r[1].split("__")[0] for r in found} >= set(LATENT)
    assert [r for r in found if r[1].split("__")[0] not in LATENT] == rows(con.sql(f"SELECT sample_id, feature, value FROM ({oracle(config_text('f11'))}) x").fetchall())
