"""Named feature configurations: blocks and weighting scheme."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from helixframe.operators.relations import apply

#: Block name -> plan of the catalogue that gives it per sample.
BLOCKS = {"fe25": "sample_burden25", "rollup": "sample_rollup44", "rollup16": "sample_rollup44", "burden8": "burden_additional8", "parsed19": "parsed19", "aa9": "amino9", "freq21": "freq21", "aatrans9": "aatrans9", "domain_burden": "domain_burden", "domain_kinds": "domain_kinds", "domain_sbs": "domain_sbs", "gec": "gene_panel_pivot"}
DOMAIN = ("domain_burden", "domain_kinds", "domain_sbs")

#: The blocks of each named configuration, then its weighting.
_BASE = {
    "f0": ("domain", "none"), "f1": ("domain", "balanced"), "f2": ("domain rollup", "balanced"), "f3": ("domain enc3", "balanced"), "f4": ("domain rollup enc3", "balanced"),
    "f4g": ("domain rollup gec", "balanced"), "f4r": ("domain rollup16 enc3", "balanced"), "f5": ("domain rollup16 enc3 sigtok", "balanced"), "f5x": ("domain rollup16 enc3 exacttok", "balanced"),
    "f4rw": ("domain rollup16 enc3", "balanced+group"), "f4rws": ("domain rollup16 enc3", "balanced+group_sqrt"), "f4rc": ("domain rollup16 enc3 comut", "balanced"), "f2c": ("domain rollup16 comut", "balanced"),
    "f4rl": ("domain rollup16 enc3 lsvd", "balanced"), "f4rn": ("domain rollup16 enc3 lnmf", "balanced"), "f4rm": ("domain rollup16 enc3 gmod", "balanced"), "f4rsig": ("domain rollup16 enc3 csig", "balanced"),
    "f2l": ("domain rollup16 lsvd", "balanced"), "f2m": ("domain rollup16 gmod", "balanced"), "f2sig": ("domain rollup16 csig", "balanced"),
    "f11": ("domain rollup16 enc3 gec sigtok exacttok comut lsvd lnmf gmod csig", "balanced"),
    "f16": ("domain rollup enc3 gec gtype parsed19 burden8 aa9 sigtok exacttok ptok comut lsvd lnmf gmod csig", "balanced"),
    "f16r": ("domain rollup16 enc3 gec gtype parsed19 burden8 aa9 sigtok exacttok ptok comut lsvd lnmf gmod csig", "balanced"),
    "f16n": ("domain rollup enc3 gecr gtype parsed19 burden8 aa9 sigtok exacttok ptok comut lsvd lnmf gmod csig", "balanced"),
    "full_all": ("domain rollup16 enc3 gtype parsed19 burden8 aa9 freq21 aatrans9 sigtok ptok comut lsvd gmod csig", "balanced"),
}
_ADDED = {"ebovr": "ebovr", "ebbnb": "ebbnb", "ebboth": "ebovr ebbnb", "parse": "parsed19", "burden": "burden8", "gtype": "gtype", "ptok": "ptok", "aa": "aa9", "freq": "freq21", "aatrans": "aatrans9", "freqaa": "freq21 aatrans9"}
CONFIGS: dict[str, tuple[tuple[str, ...], str]] = {k: (tuple(b.split()), w) for k, (b, w) in _BASE.items()} | {f"f4r_{k}": (("domain", "rollup16", "enc3", *b.split()), "balanced") for k, b in _ADDED.items()}


def dense_blocks(name: str) -> list[str]:
    """Plans of the per-sample dense blocks of a configuration."""
    out: list[str] = []
    for block in CONFIGS[name][0]:
        out += [BLOCKS[b] for b in (DOMAIN if block == "domain" else (block,)) if b in BLOCKS]
    return list(dict.fromkeys(out))


def dense_matrix(name: str, variants: DataFrame, samples: DataFrame, run: Callable[..., DataFrame] = apply) -> DataFrame:
    """All dense blocks of a configuration, one row per sample; columns are
    prefixed with the block's name."""
    out = samples
    for plan in dense_blocks(name):
        block = run(plan, variants, samples)
        out = out.join(block.select("sample_id", *[block[c].alias(f"{plan}__{c}") for c in block.columns if c != "sample_id"]), "sample_id")
    return out
