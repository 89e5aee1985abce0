"""Feature blocks and fitted statistics on a small wide file."""

import math

import pytest
from pyspark.sql import functions as F

from helixframe.functions.dims import DRIVERS, MANUAL_PAIRS, penalty_rows
from helixframe.operators.relations import STAR, apply, comutation_pairs, run_text
from helixframe.plans.portable import gene_panel_pivot
from helixframe.plans.reports import gene_type_pivot
from helixframe.sources.tables import build_submission, read_wide_csv, samples_of, variants_of

#: Four samples, none of them a multiple of five, over four driver genes.
WIDE = """ID,SUBCLASS,APC,MET,KIT,B2M
1,X,G12W L85L,T31X T31X,WT,WT
2,X,WT,20_21AC>W*,H7del M3_V6del,
3,Y,S2_T3insQ C9* D4fs,WT,WT,D4fs
4,Y,WT,NA,,WT
"""


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("wide") / "train.csv"
    path.write_text(WIDE)
    cells = read_wide_csv(spark, str(path)).withColumn("sample_id", F.col("sample_id").cast("long")).cache()
    return variants_of(cells).cache(), samples_of(cells).cache()


def got(name, tables):
    return {r["sample_id"]: r.asDict() for r in apply(name, *tables).collect()}


def test_burden25(tables):
    r = got("sample_burden25", tables)
    assert len(r) == 4 and len(r[1]) == 26
    names = ("mutated_gene_count", "mutation_event_count", "functional_event_count", "synonymous_event_count", "missense_event_count", "nonsense_event_count", "multihit_gene_count", "max_events_per_gene", "loss_of_function_count")
    assert [r[1][n] for n in names] == [2, 4, 3, 1, 1, 2, 2, 2, 2]
    assert [r[2][n] for n in names] == [2, 3, 3, 0, 0, 0, 1, 2, 2]
    assert [r[3][n] for n in names] == [2, 4, 4, 0, 0, 1, 1, 3, 3]
    assert (r[2]["complex_event_count"], r[2]["explicit_deletion_event_count"], r[2]["explicit_deletion_gene_count"], r[2]["has_explicit_deletion"]) == (1, 2, 1, 1)
    assert r[3]["frameshift_ratio"] == 0.5 and r[4]["no_mutation_flag"] == 1 and r[4]["functional_ratio"] == 0
    assert r[1]["log1p_mutation_event_count"] == round(math.log(5), 6)


def test_additional_and_rollup(tables):
    r = got("burden_additional8", tables)
    assert (r[1]["duplicate_event_count"], r[1]["events_per_mutated_gene"], r[1]["max_gene_event_share"]) == (1, 2.0, 0.5)
    assert (r[3]["indel_ratio"], r[3]["max_gene_event_share"], r[3]["high_multihit_gene_count"]) == (0.25, 0.75, 1)
    roll = got("sample_rollup44", tables)
    assert len(roll[1]) == 45 and (roll[1]["has_duplicate_token"], roll[1]["unique_nonsense_count"], roll[1]["duplicate_signature_count"]) == (1, 1, 1)
    assert (roll[2]["unique_indel_count"], roll[2]["mnv_count"], roll[3]["indel_count"], roll[3]["unique_frameshift_count"]) == (2, 1, 1, 2)


def test_two_burden_definitions(tables):
    """The older path counts indels and unknown tokens as complex."""
    r = got("burden_legacy18", tables)
    assert (r[2]["complex_event_count"], r[2]["explicit_deletion_event_count"], r[3]["complex_event_count"]) == (3, 2, 1)
    assert (r[1]["unique_mutation_token_count"], r[1]["repeated_mutation_token_count"], r[1]["mutation_gene_ratio"]) == (3, 1, 0.5)


def test_amino(tables):
    table = {(a, b): p for a, b, p in penalty_rows()}
    assert table["K", "K"] == 0 and table["A", "R"] == table["R", "A"]
    r = got("amino9", tables)
    assert (r[1]["aa_scored_count"], r[1]["aa_penalty_sum"], r[1]["aa_penalty_max"], r[2]["aa_scored_count"]) == (1, round(table["G", "W"], 6), round(table["G", "W"], 6), 0)
    assert [tuple(x) for x in apply("amino_gene_panel", *tables).collect()] == [(1, "APC", round(table["G", "W"], 6))]


def test_panels_are_the_real_genes(spark, tables):
    """Driver flags, targets of instability and immune genes of a wide file, by
    hand; the star schema's brands only where they are asked for."""
    flags = {(r["sample_id"], r["gene"]): (r["a_mutated"], r["a2_lof"], r["a2_mis"]) for r in apply("domain_driver", *tables).collect()}
    assert flags == {(1, "APC"): (1, 0, 1), (1, "MET"): (1, 1, 0), (2, "MET"): (1, 0, 0), (2, "KIT"): (1, 0, 0), (3, "APC"): (1, 1, 0), (3, "B2M"): (1, 1, 0)}
    msi = {s: (r["m_msi_fs"], r["m_msi_fs_frac"], r["m_imm_lof"]) for s, r in got("domain_msi", tables).items()}
    assert msi == {1: (0, 0.0, 0), 2: (0, 0.0, 0), 3: (1, 0.5, 1), 4: (0, 0.0, 0)}
    assert apply("domain_driver", *tables, STAR).count() == 0
    wide = {r["sample_id"]: r.asDict() for r in run_text(spark, gene_panel_pivot(("APC", "HLA-A")), *tables).collect()}
    assert {s: (r["gene_event_count_APC"], r["gene_event_count_HLA_A"]) for s, r in wide.items()} == {1: (2, 0), 2: (0, 0), 3: (3, 0), 4: (0, 0)}
    types = {r["sample_id"]: r.asDict() for r in run_text(spark, gene_type_pivot(), *tables).collect()}
    assert len(types[1]) == 1 + 6 * len(DRIVERS) and (types[3]["gene_frameshift_B2M"], types[3]["gene_indel_APC"], types[1]["gene_missense_MET"]) == (1, 1, 0)
    pairs = {tuple(sorted(r)) for r in comutation_pairs(*tables).collect()}
    assert pairs == {tuple(sorted(p)) for p in MANUAL_PAIRS}


def test_frequency(tables):
    r = got("freq21", tables)
    assert (r[1]["mean_mutated_gene_frequency"], r[2]["mean_mutated_gene_frequency"], r[3]["min_mutated_gene_frequency"]) == (0.5, 0.375, 0.25)
    assert r[1]["rare_mutation_token_count"] == 3 and r[4]["mean_token_rarity"] == 0
    assert r[2]["max_gene_rarity"] == round(-math.log(2 / 5), 6)
    # D4fs occurs in two genes of one sample: one document of the change, two of gene and change
    assert r[3]["max_aa_change_frequency"] == 0.25 and r[3]["rare_mutation_token_count"] == 4


def test_documents(tables):
    r = {x["term"]: (x["tokens"], x["documents"]) for x in apply("doc_exact", *tables).collect()}
    assert r["MUT__MET__T31X"] == (2, 1) and r["MUT__B2M__D4fs"] == (1, 1)


def test_submission(spark):
    sample = spark.createDataFrame([("a",), ("b",)], "ID string")
    full = spark.createDataFrame([("a", "X"), ("b", "Y")], "ID string, SUBCLASS string")
    assert build_submission(sample, full).count() == 2
    with pytest.raises(ValueError):
        build_submission(sample, full.limit(1))
    with pytest.raises(ValueError):
        build_submission(sample, full.union(full))


def test_profiles_hold_every_cell(spark):
    """Samples alike in the panel's smallest cell but not in another gene or in
    the cell's gene are apart; those without mutations are one group."""
    from helixframe.functions import tokens as T

    cells = [(1, "Brand#11", "A1V"), (1, "Brand#41", "R2H"), (2, "Brand#11", "A1V"), (3, "Brand#12", "A1V"), (4, "Brand#51", "K3fs"), (6, "Brand#41", "R2H"), (6, "Brand#11", "A1V")]
    variants = T.annotated(spark.createDataFrame([(s, "x", g, 1, t) for s, g, t in cells], "sample_id long, label string, gene string, seq int, token string")).cache()
    samples = spark.createDataFrame([(s, "x") for s in range(1, 8)], "sample_id long, label string")
    r = got("profile_groups", (variants, samples))
    assert {s: (x["group_size"], x["group_key"], x["singleton"]) for s, x in r.items()} == {1: (2, 1, 0), 6: (2, 1, 0), 2: (1, 2, 1), 3: (1, 3, 1), 4: (1, 4, 1), 5: (2, 5, 0), 7: (2, 5, 0)}
    assert got("weights_group", (variants, samples))[1]["weight"] == round(0.5 / 5 * 7, 6)
    from helixframe.operators import groups

    keys = {x["sample_id"]: x["group_key"] for x in groups.group_keys(groups.profiles(variants, samples)).collect()}
    assert keys == {s: x["group_key"] for s, x in r.items()}


def test_pair_choice():
    """Three pairs a gene, twenty in all, manual ones always and beside them."""
    from helixframe.operators.relations import choose_pairs

    ordered = [("A", f"B{k:02}") for k in range(9)] + [("M", "N")] + [(f"C{k:02}", f"D{k:02}") for k in range(30)]
    assert choose_pairs(ordered, manual=(("N", "M"), ("A", "Z"))) == [("A", "Z"), ("M", "N")] + ordered[:3] + ordered[10:27]


def test_signature_thresholds(spark):
    """A gene enters a class by a lift of .05 and at most half of its samples
    among the most mutated."""
    from helixframe.functions import tokens as T

    # train samples are those that 5 does not divide: 40 of each class
    ids = [s for s in range(1, 101) if s % 5]
    label = {s: "a" if k < 40 else "b" for k, s in enumerate(ids)}
    a, b = ids[:40], ids[40:]
    cells = [(s, "strong") for s in a[:20]] + [(s, "weak") for s in (*a[:11], *b[:10])] + [(s, f"g{k}") for s in b[:3] for k in range(9)] + [(s, "hyper") for s in b[:6]] + [(s, f"h{k}") for s in b[:4] for k in range(9, 15)]
    variants = T.annotated(spark.createDataFrame([(s, label[s], g, 1, "A1V") for s, g in cells], "sample_id long, label string, gene string, seq int, token string")).cache()
    samples = spark.createDataFrame(list(label.items()), "sample_id long, label string")
    from helixframe.operators.relations import run_text
    from helixframe.plans.portable import class_signatures

    found = {(r["label"], r["gene"]) for r in apply("class_signatures", variants, samples).collect()}
    loose = {(r["label"], r["gene"]) for r in run_text(spark, class_signatures(lift=0.01, hyper=1.0), variants, samples).collect()}
    assert found == {("a", "strong")} and loose == {("a", "strong"), ("a", "weak"), ("b", "hyper")}
