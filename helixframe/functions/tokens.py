"""Mutation tokens as Column expressions.  The order of the rules is the contract."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Cells that hold no mutation, compared in upper case.
EMPTY_CELLS = ("", "WT", "0", "NA", "NAN", "NONE", ".")
AMINO = "ACDEFGHIKLMNPQRSTVWY"


def split_tokens(cell: Column) -> Column:
    """Cell -> array of tokens; null and wild-type cells give an empty array."""
    text = F.regexp_replace(F.coalesce(cell, F.lit("")), r"^\s+|\s+$", "")
    return F.when(F.upper(text).isin(*EMPTY_CELLS), F.array().cast("array<string>")).otherwise(F.split(text, r"\s+"))


def classify(token: Column) -> Column:
    has = lambda pattern: token.rlike(pattern)
    same = F.substring(token, 1, 1) == F.substring(token, -1, 1)
    return (
        F.when(has("fs"), "frameshift").when(has("delins"), "delins").when(has("del"), "deletion").when(has("ins|dup"), "insertion")
        .when(has(r"^[A-Z]\d+[*X]$"), "nonsense").when(has(r"^[A-Z*]\d+[A-Z*]$"), F.when(same, "synonymous").otherwise("missense"))
        .when(has("[_>]"), "complex").otherwise("other")
    )


def coarse(kind: Column) -> Column:
    return F.when(kind.isin("deletion", "insertion", "delins"), "indel").when(kind == "other", "complex").otherwise(kind)


def signature(token: Column, kind: Column) -> Column:
    """Kind and residues without the position."""
    ends = F.when(kind == "missense", F.concat(F.substring(token, 1, 1), F.lit(">"), F.substring(token, -1, 1))).when(kind.isin("synonymous", "nonsense"), F.substring(token, 1, 1))
    shift = F.when((kind == "frameshift") & token.rlike(r"^(.*?)\d+[A-Z*]*fs"), F.regexp_extract(token, r"^(.*?)\d+[A-Z*]*fs", 1))
    spans = F.when((kind == "complex") & token.rlike(r"^\d+_\d+[A-Z*]+>[A-Z*]+$"), F.regexp_replace(token, r"^\d+_\d+", ""))
    return F.concat(kind, F.lit("|"), F.coalesce(ends, shift, spans, F.regexp_replace(token, r"\d+", "")))


def ref_residue(token: Column) -> Column:
    return F.regexp_extract(token, "^([A-Z])", 1)


def alt_residue(token: Column) -> Column:
    return F.regexp_extract(token, "([A-Z*X])$", 1)


def position(token: Column) -> Column:
    found = F.regexp_extract(token, r"(\d+)", 1)
    return F.when(found == "", F.lit(-1)).otherwise(found.cast("int"))


def encode3(token: Column) -> Column:
    """0 wild type, 1 same residue on both sides, 2 any other mutation."""
    same = token.rlike(r"^([A-Z*])\d+\1$")
    return F.when(F.upper(F.trim(token)).isin(*EMPTY_CELLS), 0).when(same, 1).otherwise(2)


def domain_kind(token: Column) -> Column:
    same = F.substring(token, 1, 1) == F.substring(token, -1, 1)
    return (
        F.when(token.rlike(r"^[A-Z]\d+[*X]$"), "nonsense").when(token.rlike(r"^[A-Z]\d+[A-Z]$"), F.when(same, "silent").otherwise("missense"))
        .when(token.rlike(r"^[A-Z]+\d+[A-Z]*fs$"), "frameshift").when(token.rlike(r"^[A-Z]\d+(_[A-Z]\d+)?(del|ins|delins|dup)[A-Z]*$"), "inframe_indel")
        .when(token.rlike(r"^\d+_\d+[A-Z]+>[A-Z*]+$"), "range_sub").otherwise("unparsed")
    )


def domain_ref(token: Column, kind: Column) -> Column:
    return (
        F.when(kind.isin("nonsense", "silent", "missense", "inframe_indel"), F.substring(token, 1, 1))
        .when(kind == "frameshift", F.regexp_extract(token, "^([A-Z]+)", 1)).when(kind == "range_sub", F.regexp_extract(token, r"^\d+_\d+([A-Z]+)>", 1)).otherwise("")
    )


def domain_alt(token: Column, kind: Column) -> Column:
    return (
        F.when(kind == "nonsense", "*").when(kind.isin("silent", "missense"), F.substring(token, -1, 1))
        .when(kind == "frameshift", F.regexp_extract(token, r"\d+([A-Z]*)fs$", 1)).when(kind == "inframe_indel", F.regexp_extract(token, r"(?:del|ins|delins|dup)([A-Z]*)$", 1))
        .when(kind == "range_sub", F.regexp_extract(token, r">([A-Z*]+)$", 1)).otherwise("")
    )


def position_key(token: Column) -> Column:
    runs = F.regexp_extract_all(token, F.lit(r"\d+"), F.lit(0))
    return F.when(F.size(runs) > 0, F.concat(F.lit("POS__"), F.array_join(runs, "_")))


def annotated(variants):
    """Add every token column to (…, token)."""
    token = F.col("token")
    return (
        variants.withColumn("kind", classify(token)).withColumn("coarse_kind", coarse(F.col("kind"))).withColumn("signature", signature(token, F.col("kind")))
        .withColumn("ref_aa", ref_residue(token)).withColumn("alt_aa", alt_residue(token)).withColumn("position", position(token)).withColumn("enc3", encode3(token))
        .withColumn("dkind", domain_kind(token)).withColumn("dref", domain_ref(token, F.col("dkind"))).withColumn("dalt", domain_alt(token, F.col("dkind")))
        .withColumn("pos_key", position_key(token)).withColumn("n_runs", F.size(F.regexp_extract_all(token, F.lit(r"\d+"), F.lit(0))))
        .withColumn("has_stop", token.rlike("[*X]").cast("int")).withColumn("has_fs", F.lower(token).rlike("fs").cast("int"))
        .withColumn("has_del_ins", F.lower(token).rlike("del|ins").cast("int")).withColumn("ends_del", F.lower(token).rlike("del$").cast("int"))
    )
