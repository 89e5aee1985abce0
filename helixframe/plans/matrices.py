"""Whole matrices of the named configurations, in long form.

A matrix is (sample_id, feature, value) with zeros left out, so that a
configuration with hundreds of thousands of possible columns is never a wide
plan.  Gene and word blocks keep their best features by chi-square on the train
samples.  All blocks but the latent ones are portable text; those are added as
DataFrames.  ``config_text`` is a whole configuration as one text.  Spark runs its
blocks one after another (``long_matrix``), since the driver holds a plan, and
writes it out again after each of its stages, at a cost of its length squared.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.operators import latent
from helixframe.operators.relations import COMMON, Genes, common_text, run_text
from helixframe.plans.configs import BLOCKS, CONFIGS, dense_blocks
from helixframe.plans.portable import _TFIDF, PLANS, TRAIN, chi2, d, evidence
from helixframe.plans.reports import ALL_PLANS
from helixframe.sources.shared import write_dealt, write_once

TOP_GENES, TOP_WORDS = 500, 1000
LATENT = ("lsvd", "lnmf", "gmod")
#: The columns of the roll-up that hold under a shift of the data,
#: then the two of the burden bins.
ROBUST = (
    "functional_ratio", "missense_ratio", "synonymous_ratio", "nonsense_ratio", "frameshift_ratio", "multihit_gene_ratio", "has_missense", "has_synonymous", "has_nonsense",
    "has_frameshift", "has_duplicate_token", "no_mutation_flag", "log1p_mutated_gene_count", "log1p_mutation_event_count",
)
BURDEN = ("hypermutated_flag", "burden_quantile_bin")

_SIGNATURE_TFIDF = _TFIDF.replace("concat('MUT__', gene, '__', token) AS term, count(*) AS tf FROM {variants} GROUP BY sample_id, gene, token", "concat('SIG__', gene, '__', signature) AS term, count(*) AS tf FROM (SELECT DISTINCT sample_id, gene, signature FROM {variants}) u GROUP BY sample_id, gene, signature")


def _long(plan: str, feature: str, value: str) -> str:
    return f"SELECT sample_id, {feature} AS feature, CAST({value} AS DOUBLE) AS value FROM ({plan}) x"


def _evidence(method: str) -> str:
    """Train samples by counts without their inner fold, the others by all."""
    return f"{_long(evidence(method, crossfit=True), 'evidence_class', 'evidence')} UNION ALL {_long(evidence(method), 'evidence_class', 'evidence')} WHERE NOT ({TRAIN})"


def _driver() -> str:
    flags = {"mutated": "a_mutated", "lof": "a2_lof", "mis": "a2_mis"}
    return " UNION ALL ".join(_long(PLANS["domain_driver"], f"concat(gene, '__{k}')", c) for k, c in flags.items())


#: Blocks that are long already.
LONG = {
    "enc3": _long(PLANS["token_encode3"], "gene", "enc3"),
    "gec": _long(PLANS["gene_event_count_long"], "gene", "gene_event_count"),
    "gecr": _long(ALL_PLANS["gene_row_share"], "gene", "share"),
    "gtype": _long(PLANS["gene_type_long"], "concat(gene, '__', type)", "flag"),
    "exacttok": _long(f"WITH {_TFIDF} SELECT * FROM tfidf", "term", "weight"),
    "sigtok": _long(f"WITH {_SIGNATURE_TFIDF} SELECT * FROM tfidf", "term", "weight"),
    "ptok": _long(ALL_PLANS["doc_parsed"], "word", "n"),
    "comut": _long(PLANS["comut_features"], "pair", "share"),
    "csig": _long(PLANS["membership_values"], "signature_class", "share"),
    "ebovr": _evidence("ovr"),
    "ebbnb": _evidence("bnb"),
    "domain_pairs": _long(PLANS["domain_pairs"], "pair", "share"),
    "domain_driver": _driver(),
}
TOP = {"enc3": TOP_GENES, "gec": TOP_GENES, "gecr": TOP_GENES, "gtype": TOP_GENES, "exacttok": TOP_WORDS, "sigtok": TOP_WORDS, "ptok": TOP_WORDS}
PARTS = {"domain": ("domain_burden", "domain_kinds", "domain_sbs", "domain_msi", "domain_pairs", "domain_driver")}


def _names(plan: str) -> list[str]:
    """Columns of a per-sample plan, from its last select."""
    return re.findall(r"(?:AS BIGINT\)|, 6\)) AS (\w+)", plan[plan.rindex("sample_id,") :])


def _wide(plan: str, keep: tuple[str, ...] | None = None) -> str:
    names = [c for c in _names(plan) if keep is None or c in keep]
    doubles = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in names)
    return f"SELECT sample_id, feature, value FROM (SELECT sample_id, {doubles} FROM ({plan}) x) w UNPIVOT (value FOR feature IN ({', '.join(names)}))"


def dense_text(name: str) -> str:
    """The dense blocks of a configuration, one row a sample, as one text."""
    plans = dense_blocks(name)
    columns = ", ".join(f"p{k}.{c} AS {plan}__{c}" for k, plan in enumerate(plans) for c in _names(ALL_PLANS[plan]))
    joins = " ".join(f"JOIN ({ALL_PLANS[plan]}) p{k} ON p{k}.sample_id = s.sample_id" for k, plan in enumerate(plans))
    return f"SELECT s.sample_id, s.label, {columns} FROM {{samples}} s {joins}"


def _body(block: str) -> str:
    """All features of one block that is portable."""
    if block == "rollup16":
        return f"{_wide(PLANS['sample_rollup44'], ROBUST)} UNION ALL {_wide(PLANS['burden_bins'], BURDEN)}"
    return LONG[block] if block in LONG else _wide(ALL_PLANS[BLOCKS.get(block, block)])


def _kept(block: str) -> str:
    """Relations up to kept: the best features of f."""
    return f"{chi2('f', 'x.feature', 'x.value')}, kept AS (SELECT feature FROM scores ORDER BY round(score, 9) DESC, feature LIMIT {TOP[block]})"


def _named(block: str) -> str:
    return f"sample_id, concat('{block}__', feature) AS feature, {d('value')}"


_PICKED = "SELECT f.sample_id, f.feature, f.value FROM f JOIN kept ON f.feature = kept.feature"


def block_text(block: str) -> str:
    """(sample_id, feature, value) of one block that is portable."""
    if block not in TOP:
        return f"SELECT {_named(block)} FROM ({_body(block)}) b WHERE value <> 0"
    return f"""SELECT {_named(block)} FROM (WITH f AS ({_body(block)}), {_kept(block)}
{_PICKED}) b WHERE value <> 0"""


Config = str | tuple[str, ...]


def config_blocks(config: Config) -> list[str]:
    """The blocks of a named configuration, or of a list of blocks."""
    return [p for b in (CONFIGS[config][0] if isinstance(config, str) else config) for p in PARTS.get(b, (b,))]


def config_text(name: Config) -> str:
    """The portable blocks of a configuration as one text."""
    return "\nUNION ALL ".join(f"SELECT * FROM ({block_text(b)}) {b}_block" for b in config_blocks(name) if b not in LATENT)


def weight_text(scheme: str) -> str:
    """sample_id, weight: the product of the schemes joined by ``+``, mean 1."""
    if scheme == "none":
        return f"SELECT sample_id, {d('weight', '1e0')} FROM {{samples}}"
    first, *others = scheme.split("+")
    side = lambda s: f"({PLANS['weights_' + s]}) w_{s}"
    joined = side(first) + "".join(f" JOIN {side(s)} ON w_{s}.sample_id = w_{first}.sample_id" for s in others)
    product = " * ".join(f"w_{s}.weight" for s in (first, *others))
    return f"SELECT sample_id, {d('weight', 'w / avg(w) OVER ()')} FROM (SELECT w_{first}.sample_id AS sample_id, {product} AS w FROM {joined}) p"


#: Deals a cell's tokens out once; they lie together already where samples do.
_DEAL = "/*+ REPARTITION(sample_id, gene) */ "
#: The terms of a token block; broadcast if there are no more than MOST_TERMS.
_VOCABULARY = re.search(r"vocabulary AS \(.*\)(?=,\nraw)", _TFIDF)[0]
MOST_TERMS = 200_000


class Steps:
    """One configuration's blocks, run one after another.  What several of them
    read is written when the first one asks for it.  ``parts``: the tokens are in
    so many buckets by sample, and so are the tables that are made of them."""

    def __init__(self, variants: DataFrame, samples: DataFrame, genes: Genes | None, parts: int = 0):
        self.variants, self.genes, self.parts, self._samples = variants, genes, parts, samples
        self._made: dict[str, DataFrame] = {}
        self._latent: tuple[DataFrame, list[str]] | None = None
        self._singular: dict[int, np.ndarray] = {}

    def keep(self, frame: DataFrame, name: str) -> DataFrame:
        """A table of rows by sample that other steps read."""
        return write_dealt(frame, name, "sample_id", self.parts) if self.parts else write_once(frame, name)

    def made(self, name: str) -> DataFrame:
        if name not in self._made:
            if name == "samples":
                frame = self._samples.repartition(self.parts, "sample_id") if self.parts else self._samples
            else:
                frame = run_text(self.variants.sparkSession, common_text(name), self.variants, self.made("samples"))
            self._made[name] = self.keep(frame, name)
        return self._made[name]

    def latent(self) -> tuple[DataFrame, list[str]]:
        """The rows of the weighted gene matrix as a table, and its genes."""
        if not self._latent:
            x, names = latent.packed(self.made("mutated"))
            self._latent = self.keep(x, "latent"), names
        return self._latent

    def singular(self, k: int) -> np.ndarray:
        """The first k singular vectors of the train samples."""
        if k not in self._singular:
            x, names = self.latent()
            self._singular[k] = latent.svd_components(x.where(TRAIN), names, k)
        return self._singular[k]

    def run(self, text: str) -> DataFrame:
        text = text.replace(_DEAL, "") if self.parts else text
        common = {name: self.made(name) for name, meant in COMMON.items() if meant in text}
        return run_text(self.variants.sparkSession, text, self.variants, self.made("samples"), self.genes, common)

    def body(self, block: str) -> DataFrame:
        """All features of a portable block of which the best are taken."""
        text = _body(block)
        if not (self.parts and _VOCABULARY in text):
            return self.keep(self.run(text), block)
        head = text[text.index("WITH ") : text.index(_VOCABULARY)]
        terms = write_once(self.run(f"{head}{_VOCABULARY} SELECT * FROM vocabulary"), "vocabulary")
        side = F.broadcast(terms) if terms.count() <= MOST_TERMS else terms
        view = f"helixframe_terms_{uuid.uuid4().hex}"
        side.createOrReplaceTempView(view)
        try:
            return self.keep(self.run(text.replace(_VOCABULARY, f"vocabulary AS (SELECT * FROM {view})")), block)
        finally:
            terms.sparkSession.catalog.dropTempView(view)

    def block(self, block: str) -> DataFrame:
        """(sample_id, feature, value) of one block that is portable: all of it as
        a table, or all its features as a table and the best ones as another."""
        if block not in TOP:
            return write_once(self.run(block_text(block)), block)
        spark, f = self.variants.sparkSession, self.body(block)
        samples = self.made("samples")
        kept = write_once(spark.sql(f"WITH f AS (SELECT * FROM {{found}}), {_kept(block)} SELECT feature FROM kept", found=f, samples=samples), "kept")
        return spark.sql(f"SELECT {_named(block)} FROM (WITH f AS (SELECT * FROM {{found}}), kept AS (SELECT * FROM {{best}}) {_PICKED}) b WHERE value <> 0", found=f, best=kept)


def _latent_block(block: str, steps: Steps, components: int, modules: int) -> DataFrame:
    mutated, (x, names) = steps.made("mutated"), steps.latent()
    train, k = x.where(TRAIN), min(components, len(names) - 1)
    if block == "gmod":
        members = latent.gene_modules(train, names, k=min(modules, len(names)), basis=steps.singular(k)).select("gene", "module")
        found = mutated.join(members, "gene", "left")
        total = found.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"))
        share = found.where("module is not null").groupBy("sample_id", "module").agg(F.count(F.lit(1)).alias("c")).join(total, "sample_id")
        return share.select("sample_id", F.concat(F.lit("gmod__"), F.col("module").cast("string")).alias("feature"), (F.col("c") / F.col("n")).alias("value"))
    basis = steps.singular(k) if block == "lsvd" else latent.nmf_components(train, names, k)
    placed = latent.project(x, names, basis, nonnegative=block == "lnmf")
    return placed.select("sample_id", F.posexplode("latent").alias("k", "value")).select("sample_id", F.concat(F.lit(f"{block}__"), F.col("k").cast("string")).alias("feature"), "value")


def block_frame(block: str, steps: Steps, components: int, modules: int) -> DataFrame:
    """sample_id, feature, value of one block."""
    if block in LATENT:
        found = _latent_block(block, steps, components, modules)
        return write_once(found.where("value <> 0").select("sample_id", "feature", F.round("value", 6).alias("value")), block)
    return steps.block(block)


def long_matrix(name: Config, variants: DataFrame, samples: DataFrame, components: int = 64, modules: int = 24, genes: Genes | None = None, cache: Callable[[str, Callable[[], DataFrame]], DataFrame] | None = None, parts: int = 0) -> DataFrame:
    """sample_id, feature, value of every block of the configuration; ``genes``
    are the real driver panels by default, ``parts`` the buckets by sample in which
    the variants lie.  ``cache`` keeps a block's table by a
    key that names all it depends on, so that configurations share their blocks."""
    steps = Steps(variants, samples, genes, parts)
    keep = cache or (lambda key, make: make())
    frames = [keep(block_key(b, components, modules), lambda b=b: block_frame(b, steps, components, modules)) for b in config_blocks(name)]
    return reduce(DataFrame.unionByName, frames)


def block_key(block: str, components: int, modules: int) -> str:
    """What a block's values depend on beside the samples."""
    return block + (f"-{components}" if block in LATENT else "") + (f"-{modules}" if block == "gmod" else "")


#: Configurations that the catalogue runs as queries.
MATRICES = ("f4r", "f5", "f4rc")
SCHEMES = ("balanced+group", "balanced+group_sqrt")
MATRIX_PLANS = {f"matrix_{name}": config_text(name) for name in MATRICES} | {f"weights_{s.replace('+', '_')}": weight_text(s) for s in SCHEMES}
