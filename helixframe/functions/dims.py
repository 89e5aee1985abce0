"""Fixed small tables: amino-acid properties, codons, gene panels."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Polarity, hydrophobicity, charge, molecular weight.
AMINO_ACIDS = {
    "A": (8.1, 1.8, 0.0, 89.09), "R": (10.5, -4.5, 1.0, 174.20), "N": (11.6, -3.5, 0.0, 132.12), "D": (13.0, -3.5, -1.0, 133.10),
    "C": (5.5, 2.5, 0.0, 121.16), "Q": (10.5, -3.5, 0.0, 146.15), "E": (12.3, -3.5, -1.0, 147.13), "G": (9.0, -0.4, 0.0, 75.07),
    "H": (10.4, -3.2, 0.1, 155.16), "I": (5.2, 4.5, 0.0, 131.17), "L": (4.9, 3.8, 0.0, 131.17), "K": (11.3, -3.9, 1.0, 146.19),
    "M": (5.7, 1.9, 0.0, 149.21), "F": (5.2, 2.8, 0.0, 165.19), "P": (8.0, -1.6, 0.0, 115.13), "S": (9.2, -0.8, 0.0, 105.09),
    "T": (8.6, -0.7, 0.0, 119.12), "W": (5.4, -0.9, 0.0, 204.23), "Y": (6.2, -1.3, 0.0, 181.19), "V": (5.9, 4.2, 0.0, 117.15),
}
PROPERTY_WEIGHTS = (1.0, 1.0, 2.0, 1.0)

#: Driver genes, targets of microsatellite instability, immune genes.
DRIVERS = tuple(sorted(set(
    "TP53 VHL APC PTEN RB1 NF1 ATRX CDKN2A NOTCH1 FBXW7 CREBBP KMT2D B2M CDH1 TSC1 TSC2 NF2 CASP8 CYLD RUNX1 CEBPA BRCA1 BRCA2 CHEK2 MLH1 MSH2 PMS2 ERCC2 "
    "RASA1 PTCH1 SMAD2 ACVR1B AXIN1 AXIN2 BRAF PIK3CA HRAS IDH1 IDH2 KIT EGFR CTNNB1 SPOP FGFR3 FGFR1 RHOA NFE2L2 MTOR AKT1 AKT2 GNAS ERBB2 ERBB3 MET RET JAK2 "
    "MYD88 CD79B EZH2 U2AF1 SRSF2 CALR NPM1 POLE POLD1 RAC1 RIT1 CCND1 CDK4 MDM2 MYC MYCN PIM1 BTG1 BTG2 STAT3 ROS1 RPL22 HLA-A HLA-B HLA-C TAP1 TAP2 NLRC5 "
    "CIITA JAK1 CD274 SDHA MAP3K1 GATA3 ALB SOCS1".split()
)))
MSI_TARGETS = tuple("ACVR2A TGFBR2 BAX RPL22 TCF7L2 CASP5 RAD50 TTK EPHB2 MRE11 PRDM2 CHEK1 JAK1 B2M".split())
IMMUNE = tuple("HLA-A HLA-B HLA-C B2M TAP1 TAP2 NLRC5 CIITA JAK1 JAK2 CASP8 CD274".split())
MANUAL_PAIRS = (("ATRX", "IDH1"), ("IDH1", "TP53"), ("CTNNB1", "PTEN"), ("PIK3CA", "PTEN"), ("BRAF", "CDKN2A"))
#: What stands for these genes in the star schema, whose genes are brands.
STAR_DRIVERS = tuple(f"Brand#{n}" for n in range(11, 16))
STAR_IMMUNE = ("Brand#21",)
STAR_PAIRS = (("Brand#11", "Brand#12"), ("Brand#12", "Brand#13"), ("Brand#11", "Brand#14"), ("Brand#14", "Brand#15"), ("Brand#13", "Brand#15"))
PAIR_LABELS = {"KIPAN": "KIRC", "KIRC": "KIPAN", "GBMLGG": "LGG", "LGG": "GBMLGG"}
#: Residues of the codons in the order of TCAG at each place.
CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


def penalty_rows(weights: tuple[float, ...] = PROPERTY_WEIGHTS) -> list[tuple[str, str, float]]:
    """(ref, alt, penalty): weighted distance of min-max scaled properties."""
    columns = list(zip(*AMINO_ACIDS.values()))
    low, high = [min(c) for c in columns], [max(c) for c in columns]
    scaled = {a: [(v - lo) / (hi - lo) for v, lo, hi in zip(p, low, high)] for a, p in AMINO_ACIDS.items()}
    return [(a, b, math.sqrt(sum(w * (x - y) ** 2 for w, x, y in zip(weights, scaled[a], scaled[b])))) for a in scaled for b in scaled]


def penalties(spark: SparkSession) -> DataFrame:
    """400 rows, sent to every task."""
    return F.broadcast(spark.createDataFrame(penalty_rows(), "ref string, alt string, penalty double"))


def panel_rows(drivers: tuple[str, ...] = DRIVERS, msi: tuple[str, ...] = MSI_TARGETS, immune: tuple[str, ...] = IMMUNE) -> list[tuple[str, str]]:
    """(gene, role): a gene has a row for each of its roles."""
    return [(g, role) for role, genes in (("driver", drivers), ("msi", msi), ("immune", immune)) for g in genes]


STAR_PANEL = panel_rows(STAR_DRIVERS, STAR_DRIVERS, STAR_IMMUNE)


def panel(spark: SparkSession, rows: list[tuple[str, str]] | None = None) -> DataFrame:
    """A row per gene and role, as many as are given, sent to every task."""
    return F.broadcast(spark.createDataFrame(rows or panel_rows(), "gene string, role string"))


#: (ref, alt) of residues -> shares of the six channels, CpG and transition over
#: all single-base paths; plain SQL that Spark and other engines run alike.
CODON_SQL = f"""
bases AS (SELECT 'T' AS base, 0 AS k UNION ALL SELECT 'C', 1 UNION ALL SELECT 'A', 2 UNION ALL SELECT 'G', 3),
codons AS (
  SELECT concat(x.base, y.base, z.base) AS codon, substr('{CODE}', x.k * 16 + y.k * 4 + z.k + 1, 1) AS aa, x.base AS b1, y.base AS b2, z.base AS b3
  FROM bases x CROSS JOIN bases y CROSS JOIN bases z
),
steps AS (
  SELECT a.aa AS ref, b.aa AS alt, CASE WHEN a.b1 <> b.b1 THEN a.b1 WHEN a.b2 <> b.b2 THEN a.b2 ELSE a.b3 END AS f,
         CASE WHEN a.b1 <> b.b1 THEN b.b1 WHEN a.b2 <> b.b2 THEN b.b2 ELSE b.b3 END AS t,
         CASE WHEN a.b1 <> b.b1 THEN '' WHEN a.b2 <> b.b2 THEN a.b1 ELSE a.b2 END AS before_base,
         CASE WHEN a.b1 <> b.b1 THEN a.b2 WHEN a.b2 <> b.b2 THEN a.b3 ELSE '' END AS after_base
  FROM codons a CROSS JOIN codons b
  WHERE CASE WHEN a.b1 <> b.b1 THEN 1 ELSE 0 END + CASE WHEN a.b2 <> b.b2 THEN 1 ELSE 0 END + CASE WHEN a.b3 <> b.b3 THEN 1 ELSE 0 END = 1 AND a.aa <> b.aa
),
folded AS (
  SELECT ref, alt, CASE WHEN f IN ('C', 'T') THEN concat(f, '>', t) ELSE concat(translate(f, 'ACGT', 'TGCA'), '>', translate(t, 'ACGT', 'TGCA')) END AS channel,
         CASE WHEN (f = 'C' AND after_base = 'G') OR (f = 'G' AND before_base = 'C') THEN 1e0 ELSE 0e0 END AS cpg,
         CASE WHEN concat(f, t) IN ('AG', 'GA', 'CT', 'TC') THEN 1e0 ELSE 0e0 END AS ti
  FROM steps
),
pair_map AS (
  SELECT ref, alt, avg(CASE WHEN channel = 'C>A' THEN 1e0 ELSE 0e0 END) AS c_a, avg(CASE WHEN channel = 'C>G' THEN 1e0 ELSE 0e0 END) AS c_g,
         avg(CASE WHEN channel = 'C>T' THEN 1e0 ELSE 0e0 END) AS c_t, avg(CASE WHEN channel = 'T>A' THEN 1e0 ELSE 0e0 END) AS t_a,
         avg(CASE WHEN channel = 'T>C' THEN 1e0 ELSE 0e0 END) AS t_c, avg(CASE WHEN channel = 'T>G' THEN 1e0 ELSE 0e0 END) AS t_g, avg(cpg) AS cpg, avg(ti) AS ti
  FROM folded GROUP BY ref, alt
)"""
