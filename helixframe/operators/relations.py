"""Running the portable plans on DataFrames."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions.dims import CODON_SQL, MANUAL_PAIRS, STAR_PAIRS, STAR_PANEL, panel_rows, penalties
from helixframe.functions.dims import panel as panel_of
from helixframe.plans.portable import _BURDEN_TABLE, _DOMAIN_TOKENS, _MUT, PAIRS_A_GENE, TOP_PAIRS, comut_candidates
from helixframe.plans.reports import ALL_PLANS, GENERALISED, PART_PLACE, SIGNATURE_BUCKETS


def cell_keys(variants: DataFrame) -> DataFrame:
    """(sample_id, gene, exact_key): a cell's tokens, sorted and joined by bars."""
    return variants.groupBy("sample_id", "gene").agg(F.array_join(F.sort_array(F.collect_list("token")), "|").alias("exact_key"))


def token_words(variants: DataFrame) -> DataFrame:
    """(sample_id, gene, seq, place, spot, word): runs of two or more word
    characters in the generalised tokens, and where they stand."""
    pieces = variants.sparkSession.sql(GENERALISED, variants=variants)
    return pieces.select("sample_id", "gene", "seq", F.expr(PART_PLACE).alias("place"), F.posexplode(F.regexp_extract_all("piece", F.lit(r"(?U)\w{2,}"), F.lit(0))).alias("spot", "word"))


def signature_buckets(variants: DataFrame) -> DataFrame:
    """(signature, bucket): a stable hash bucket of every signature."""
    head = F.conv(F.substring(F.md5("signature"), 1, 8), 16, 10).cast("long")
    return variants.select("signature").distinct().withColumn("bucket", head % SIGNATURE_BUCKETS)


Pair = tuple[str, str]


def choose_pairs(ordered: Iterable[Pair], manual: Sequence[Pair] = MANUAL_PAIRS, topk: int = TOP_PAIRS, per_gene: int = PAIRS_A_GENE) -> list[Pair]:
    """The manual pairs, then up to ``topk`` of the ordered ones with at most
    ``per_gene`` of a gene; manual ones count for neither bound."""
    forced, picked, used = {tuple(sorted(p)) for p in manual}, [], Counter()
    for pair in ordered:
        if len(picked) >= topk:
            break
        if pair not in forced and max(used[g] for g in pair) < per_gene:
            picked.append(pair)
            used.update(pair)
    return sorted(forced) + picked


class Genes:
    """Which genes the panel plans mean: (gene, role) rows, the pairs that are
    always taken, and whether candidate pairs come from the panel only."""

    def __init__(self, rows: list[tuple[str, str]] | None = None, manual: Sequence[Pair] = MANUAL_PAIRS, pool: bool = True):
        self.rows = (rows or panel_rows()) + [(g, "manual") for g in sorted({g for p in manual for g in p})]
        self.manual, self.pool = manual, pool


#: The genes of the star schema, all of which may pair.
STAR = Genes(STAR_PANEL, STAR_PAIRS, pool=False)


#: Relations that many plans define alike and read several times.  Spark plans
#: such a definition anew at each place that reads it, so a caller that has them
#: as tables passes these instead.
COMMON = {"mutated": _MUT, "burdens": _BURDEN_TABLE, "domains": _DOMAIN_TOKENS}


def common_text(name: str) -> str:
    """The relation ``name`` of COMMON alone."""
    return f"WITH {COMMON[name]} SELECT * FROM {COMMON[name].split(' ', 1)[0]}"


def _with_tables(text: str, made: dict[str, DataFrame]) -> str:
    """``text`` reading the tables ``made`` in place of their definitions."""
    for name in made:
        text = text.replace(COMMON[name], f"{COMMON[name].split(' ', 1)[0]} AS (SELECT * FROM {{{name}}})")
    return text


def comutation_pairs(variants: DataFrame, samples: DataFrame, candidates: str | None = None, genes: Genes | None = None, made: dict[str, DataFrame] | None = None) -> DataFrame:
    """(gene_a, gene_b): the chosen pairs, read in order until there are enough."""
    spark, genes = variants.sparkSession, genes or Genes()
    text = _with_tables(candidates or comut_candidates(pool=genes.pool), made or {})
    tables = {"variants": variants, "samples": samples} | (made or {}) | ({"panel": panel_of(spark, genes.rows)} if "{panel}" in text else {})
    ordered = spark.sql(text, **{k: v for k, v in tables.items() if "{" + k + "}" in text}).orderBy("place").select("gene_a", "gene_b")
    return spark.createDataFrame(choose_pairs(((r["gene_a"], r["gene_b"]) for r in ordered.toLocalIterator()), genes.manual), "gene_a string, gene_b string")


def apply(name: str, variants: DataFrame, samples: DataFrame, genes: Genes | None = None) -> DataFrame:
    """The plan ``name`` of the catalogue over (variants, samples)."""
    return run_text(variants.sparkSession, ALL_PLANS[name], variants, samples, genes)


def run_text(spark: SparkSession, text: str, variants: DataFrame, samples: DataFrame, genes: Genes | None = None, made: dict[str, DataFrame] | None = None) -> DataFrame:
    """A portable text; ``genes`` are the real driver panels by default, ``made``
    the tables of COMMON that there are already."""
    text = _with_tables(text, made or {})
    tables = {"variants": variants, "samples": samples} | (made or {})
    if "{cellkeys}" in text:
        tables["cellkeys"] = cell_keys(variants)
    if "{words}" in text:
        tables["words"] = token_words(variants)
    if "{sigbuckets}" in text:
        tables["sigbuckets"] = signature_buckets(variants)
    if "{penalties}" in text:
        tables["penalties"] = penalties(spark)
    if "{panel}" in text:
        tables["panel"] = panel_of(spark, (genes or Genes()).rows)
    if "{comutpairs}" in text:
        tables["comutpairs"] = comutation_pairs(variants, samples, genes=genes, made=made)
    text = text.replace("{codons}", CODON_SQL.strip())
    return spark.sql(text, **{k: v for k, v in tables.items() if "{" + k + "}" in text})
