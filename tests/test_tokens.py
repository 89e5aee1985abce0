"""The token layer on hand-worked tokens."""

import pytest

from helixframe.functions import tokens as T

#: token -> kind, signature, three-level code, domain (kind, ref, alt)
CASES = {
    "G12W": ("missense", "missense|G>W", 2, ("missense", "G", "W")),
    "L85L": ("synonymous", "synonymous|L", 1, ("silent", "L", "L")),
    "*40*": ("synonymous", "synonymous|*", 1, ("unparsed", "", "")),
    "C9*": ("nonsense", "nonsense|C", 2, ("nonsense", "C", "*")),
    "T31X": ("nonsense", "nonsense|T", 2, ("nonsense", "T", "*")),
    "X8X": ("nonsense", "nonsense|X", 1, ("nonsense", "X", "*")),
    "D4fs": ("frameshift", "frameshift|D", 2, ("frameshift", "D", "")),
    "N52Wfs": ("frameshift", "frameshift|N", 2, ("frameshift", "N", "W")),
    "-19fs": ("frameshift", "frameshift|-", 2, ("unparsed", "", "")),
    "H7del": ("deletion", "deletion|Hdel", 2, ("inframe_indel", "H", "")),
    "M3_V6del": ("deletion", "deletion|M_Vdel", 2, ("inframe_indel", "M", "")),
    "S2_T3insQ": ("insertion", "insertion|S_TinsQ", 2, ("inframe_indel", "S", "Q")),
    "Q6dup": ("insertion", "insertion|Qdup", 2, ("inframe_indel", "Q", "")),
    "Y5_D8delinsG": ("delins", "delins|Y_DdelinsG", 2, ("inframe_indel", "Y", "G")),
    "20_21AC>W*": ("complex", "complex|AC>W*", 2, ("range_sub", "AC", "W*")),
    "EXON9": ("other", "other|EXON", 2, ("unparsed", "", "")),
    "NA": ("other", "other|NA", 0, ("unparsed", "", "")),
}


@pytest.fixture(scope="module")
def rows(spark):
    table = spark.createDataFrame([(k,) for k in CASES], "token string")
    return {r["token"]: r for r in T.annotated(table).collect()}


@pytest.mark.parametrize("token", CASES)
def test_token(rows, token):
    r = rows[token]
    assert (r["kind"], r["signature"], r["enc3"], (r["dkind"], r["dref"], r["dalt"])) == CASES[token]


def test_string_features(rows):
    r = rows["Y5_D8delinsG"]
    assert (r["ref_aa"], r["alt_aa"], r["position"], r["n_runs"], r["pos_key"], r["has_del_ins"]) == ("Y", "G", 5, 2, "POS__5_8", 1)
    assert (rows["NA"]["position"], rows["NA"]["pos_key"], rows["EXON9"]["pos_key"]) == (-1, None, "POS__9")


def test_split(spark):
    cells = spark.createDataFrame([(None,), ("",), (" none ",), (".",), ("\tG12W   C9*  ",), ("WT D4fs",)], "cell string")
    assert [r[0] for r in cells.select(T.split_tokens(cells["cell"])).collect()] == [[], [], [], [], ["G12W", "C9*"], ["WT", "D4fs"]]
