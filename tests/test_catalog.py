"""Every portable plan against the comparison engine, on the smallest tables."""

from pathlib import Path

import pytest

from helixframe.plans.catalog import oracle_sql, queries
from helixframe.plans.configs import CONFIGS, dense_blocks
from helixframe.plans.independent import QUERIES, WRITTEN, second
from helixframe.plans.matrices import BURDEN, MATRIX_PLANS, ROBUST, config_text
from helixframe.plans.oracle import oracle
from helixframe.plans.reports import ALL_PLANS

DATA = Path("/root/testdata/sf0.001")
duckdb = pytest.importorskip("duckdb")
needs_data = pytest.mark.skipif(not DATA.exists(), reason="no driver tables")


@pytest.fixture(scope="module")
def relations(spark):
    from helixframe.sources.tables import star_samples, star_variants

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents labels".split():
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    variants = star_variants(spark, str(DATA)).cache()
    return con, variants, star_samples(spark, str(DATA), variants).cache()


@needs_data
@pytest.mark.parametrize("name", ALL_PLANS | MATRIX_PLANS)
def test_plan(relations, name):
    from helixframe.operators.relations import STAR, run_text

    con, variants, samples = relations
    text = (ALL_PLANS | MATRIX_PLANS)[name]
    one, two = run_text(variants.sparkSession, text, variants, samples, STAR).toPandas(), con.sql(oracle(second(name) if name in ALL_PLANS else text)).df()
    same_rows(one, two)


def same_rows(one, two):
    columns = sorted(one.columns)
    assert columns == sorted(two.columns)
    one, two = (x[columns].sort_values(columns).reset_index(drop=True) for x in (one, two))
    assert len(one) == len(two)
    for c in columns:
        assert ((one[c] == two[c]) | (one[c].isna() & two[c].isna())).all(), c


@needs_data
@pytest.mark.parametrize("name", [*QUERIES, "dense_matrix_f1"])
def test_query(relations, spark, name):
    con, _, _ = relations
    same_rows(queries()[name](spark, str(DATA)).toPandas(), con.sql(oracle_sql()[name]).df())


@needs_data
@pytest.mark.parametrize("name", [name for name in ALL_PLANS if name in WRITTEN or second(name) != ALL_PLANS[name]])
def test_second_formula(relations, name):
    """The plan's own text and its second formula, on one engine."""
    con, _, _ = relations
    same_rows(con.sql(oracle(ALL_PLANS[name])).df(), con.sql(oracle(second(name))).df())


def test_configs():
    assert len(CONFIGS) == 36
    assert CONFIGS["f4rws"] == (("domain", "rollup16", "enc3"), "balanced+group_sqrt")
    assert dense_blocks("f1") == ["domain_burden", "domain_kinds", "domain_sbs"]


@needs_data
def test_matrix_columns(relations):
    """Every configuration gives text, and the robust roll-up its columns."""
    assert all(config_text(name) for name in CONFIGS)
    con, _, _ = relations
    found = {f for (f,) in con.sql(f"select distinct feature from ({oracle(config_text('f4r'))}) x where feature like 'rollup16%'").fetchall()}
    assert found <= {f"rollup16__{c}" for c in (*ROBUST, *BURDEN)} and len(found) > 10


@needs_data
def test_selections_with_low_thresholds(relations):
    """The star schema's labels do not depend on genes, so few of its pairs and
    signatures pass the fixed thresholds; low ones fill the plans."""
    from helixframe.operators.relations import STAR, comutation_pairs, run_text
    from helixframe.plans.portable import class_signatures, comut_candidates, membership

    con, variants, samples = relations
    spark = variants.sparkSession
    low = comut_candidates(support=2, class_support=1, purity=0.0, lift=-1.0, hyper=1.0, pool=False)
    pairs = {tuple(r) for r in comutation_pairs(variants, samples, low, STAR).collect()}
    assert pairs == set(con.sql(oracle("SELECT gene_a, gene_b FROM {comutpairs}", low)).fetchall()) and len(pairs) == 25
    assert {tuple(r) for r in comutation_pairs(variants, samples, genes=STAR).collect()} == set(con.sql(oracle("SELECT gene_a, gene_b FROM {comutpairs}")).fetchall())
    for text in (class_signatures(lift=0.01, hyper=1.0), membership(lift=0.01, hyper=1.0)):
        one = sorted(map(tuple, run_text(spark, text, variants, samples).collect()))
        assert one == sorted(con.sql(oracle(text)).fetchall()) and one
