"""Plans written a second time, for comparison only.

Each text computes what the plan of its name does by another formula or another
shape of query, so that a misread formula shows.  Texts not listed here are
compared on another engine only.
"""

from __future__ import annotations

from helixframe.plans.portable import CELLS, FUNCTIONAL, INDEL, KINDS, PLANS, RARE, TRAIN, _PREDS, d, i
from helixframe.plans.reports import ALL_PLANS


def _n(test: str) -> str:
    return f"count(*) FILTER (WHERE {test})"


#: Cells out of one grouping with distinct counts.
_DISTINCT_CELLS = f"""cells AS (
  SELECT sample_id, gene, count(*) AS n, count(DISTINCT token) AS unique_tokens, count(DISTINCT signature) AS unique_signatures,
         {", ".join(f"{_n(f'kind = {k!r}')} AS {k}_count, count(DISTINCT token) FILTER (WHERE kind = {k!r}) AS unique_{k}_count" for k in KINDS)},
         {_n(f"kind IN {INDEL}")} AS indel_count, count(DISTINCT token) FILTER (WHERE kind IN {INDEL}) AS unique_indel_count, {_n("kind = 'other'")} AS other_count,
         {_n(f"kind IN {FUNCTIONAL}")} AS functional, {_n("kind IN ('deletion', 'delins')")} AS explicit_del, max(enc3) AS enc3, max(ends_del) AS ends_del, sum(ends_del) AS n_ends_del
  FROM {{variants}} GROUP BY sample_id, gene
)"""

#: Means, extremes and counts of a sample's keys of one family, by df and n.
_FAMILY = {"gene": "SELECT DISTINCT sample_id, gene AS key FROM {variants}", "token": "SELECT DISTINCT sample_id, gene || '|' || token AS key FROM {variants}", "exact": "SELECT sample_id, gene || '__' || exact_key AS key FROM {cellkeys}", "aa": "SELECT DISTINCT sample_id, token AS key FROM {variants}", "pos": "SELECT DISTINCT sample_id, pos_key AS key FROM {variants} WHERE pos_key IS NOT NULL"}
_FREQ = ", ".join(
    f"""{f}_df AS (SELECT key, count(*) AS c FROM ({q}) k WHERE {TRAIN} GROUP BY key),
{f}_per AS (SELECT k.sample_id, list(coalesce(c, 0)) AS cs FROM ({q}) k LEFT JOIN {f}_df USING (key) GROUP BY k.sample_id)"""
    for f, q in _FAMILY.items()
)
_N = f"(SELECT count(*) FROM {{samples}} WHERE {TRAIN})"
_share = lambda f, how: f"list_{how}({f}_per.cs) / CAST({_N} AS DOUBLE)"
#: ln((n + 1) / (c + 1)), whose largest value is that of the smallest count.
_log = lambda f, how: f"ln({_N} + 1) - " + (f"ln(list_min({f}_per.cs) + 1.0)" if how == "max" else f"list_avg(list_transform({f}_per.cs, lambda c: ln(c + 1.0)))")
_FREQ21 = f"""WITH {_FREQ} SELECT s.sample_id, {i("rare_mutation_token_count", f"len(list_filter(token_per.cs, lambda c: c <= {RARE}))")}, {i("unseen_token_count", "len(list_filter(token_per.cs, lambda c: c = 0))")}, {i("unseen_mutated_gene_count", "len(list_filter(gene_per.cs, lambda c: c = 0))")},
  {", ".join(d(f"{how if how != 'avg' else 'mean'}_{name}_frequency", _share(f, how)) for f, name, hows in (("token", "token", ("avg", "min")), ("gene", "mutated_gene", ("avg", "min")), ("exact", "exact_mutation", ("avg", "min", "max")), ("aa", "aa_change", ("avg", "min", "max")), ("token", "gene_aa_change", ("max",)), ("pos", "position", ("avg", "min", "max"))) for how in hows)},
  {d("mean_token_rarity", _log("token", "avg") + " + 1")}, {d("max_token_rarity", _log("token", "max") + " + 1")}, {d("mean_gene_rarity", _log("gene", "avg"))}, {d("max_gene_rarity", _log("gene", "max"))}
FROM {{samples}} s {" ".join(f"LEFT JOIN {f}_per ON {f}_per.sample_id = s.sample_id" for f in _FAMILY)}"""

_PARSED19 = f"""WITH ok AS (SELECT * FROM {{variants}} WHERE kind <> 'other'),
per AS (
  SELECT sample_id, count(*) AS parsed, list(position) FILTER (WHERE position >= 0) AS ps, count(DISTINCT ref_aa) FILTER (WHERE ref_aa <> '') AS refs, count(DISTINCT alt_aa) FILTER (WHERE alt_aa <> '') AS alts,
         count(DISTINCT ref_aa || alt_aa) FILTER (WHERE ref_aa <> '' AND alt_aa <> '') AS both_aa, count(DISTINCT position // 50) FILTER (WHERE position >= 0) AS nb, count(DISTINCT kind) AS kinds
  FROM ok GROUP BY sample_id
),
top AS (SELECT sample_id, max(c) FILTER (WHERE what = 'bin') AS top_bin, max(c) FILTER (WHERE what = 'kind') AS top_kind FROM (
  SELECT sample_id, 'bin' AS what, CAST(position // 50 AS VARCHAR) AS x, count(*) AS c FROM ok WHERE position >= 0 GROUP BY ALL UNION ALL SELECT sample_id, 'kind', kind, count(*) FROM ok GROUP BY ALL) t GROUP BY sample_id),
genes AS (SELECT sample_id, gene, count(*) AS c, count(DISTINCT position) AS u FROM ok WHERE position >= 0 GROUP BY sample_id, gene),
spots AS (SELECT sample_id, count(*) AS g, {_n("c > u")} AS hot, {_n("u > 1")} AS multi, avg(u) AS mu FROM genes GROUP BY sample_id),
whole AS (SELECT sample_id, count(*) AS e FROM {{variants}} GROUP BY sample_id)
SELECT s.sample_id, {i("parsed_token_count", "parsed")}, {i("unparsed_token_count", "e - coalesce(parsed, 0)")}, {d("parse_success_ratio", "CAST(parsed AS DOUBLE) / e")}, {d("position_mean", "list_avg(ps)")}, {d("position_std", "list_stddev_pop(ps)")},
  {i("position_min", "list_min(ps)")}, {i("position_max", "list_max(ps)")}, {d("position_median", "list_median(ps)")}, {i("unique_ref_aa_count", "refs")}, {i("unique_alt_aa_count", "alts")}, {i("unique_aa_pair_count", "both_aa")}, {i("unique_position_bin_count", "nb")},
  {i("top_position_bin_count", "top_bin")}, {i("kind_diversity", "kinds")}, {d("dominant_kind_ratio", "CAST(top_kind AS DOUBLE) / parsed")}, {i("genes_with_hotspot", "hot")}, {d("hotspot_ratio", "CAST(hot AS DOUBLE) / g")}, {i("genes_with_multiple_positions", "multi")}, {d("mean_positions_per_gene", "mu")}
FROM {{samples}} s LEFT JOIN per USING (sample_id) LEFT JOIN top USING (sample_id) LEFT JOIN spots USING (sample_id) LEFT JOIN whole USING (sample_id)"""

#: Groups of equal profiles as lists of their cells.
_EQUAL = "cells_of AS (SELECT sample_id, list(gene || chr(31) || exact_key ORDER BY gene) AS cells FROM {cellkeys} GROUP BY sample_id), own AS (SELECT s.sample_id, s.label, coalesce(cells, []) AS cells FROM {samples} s LEFT JOIN cells_of USING (sample_id))"


def _mean_one(raw: str) -> str:
    return f"WITH {_EQUAL}, w AS (SELECT sample_id, {raw} AS w FROM own) SELECT sample_id, {d('weight', 'w / (SELECT avg(w) FROM w)')} FROM w"


_SIZE, _SIZE_LABEL, _SIZE_CLASS = "count(*) OVER (PARTITION BY cells)", "count(*) OVER (PARTITION BY cells, label)", "count(*) OVER (PARTITION BY label)"
_LABELS = "(SELECT count(DISTINCT label) FROM own)"
_GROUPS_OF = "(SELECT count(*) FROM (SELECT DISTINCT cells FROM own o WHERE o.label = own.label) x)"


def _evidence(method: str) -> str:
    """Gene by gene out of a table of all genes and classes."""
    return f"""WITH train AS (SELECT * FROM {{samples}} WHERE {TRAIN}), g AS (SELECT DISTINCT sample_id, gene FROM {{variants}}), n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM train), classes AS (SELECT label, CAST(count(*) AS DOUBLE) AS nc FROM train GROUP BY label),
genes AS (SELECT gene, count(*) AS total FROM g JOIN train USING (sample_id) GROUP BY gene),
odds AS (
  SELECT gene, label, n, nc, total, (SELECT count(*) FROM g JOIN train t USING (sample_id) WHERE g.gene = genes.gene AND t.label = classes.label) AS c FROM genes, classes, n
),
pq AS (SELECT gene, label, (c + 20 * total / n) / (nc + 20) AS p, (total - c + 20 * total / n) / (n - nc + 20) AS q FROM odds),
w AS (SELECT gene, label, {"ln((p / (1 - p)) / (q / (1 - q)))" if method == "ovr" else "ln(p / (1 - p))"} AS w, ln(1 - p) AS none FROM pq),
base AS (SELECT label, {"sum(none)" if method == "bnb" else "0"} AS base FROM w GROUP BY label)
SELECT s.sample_id, b.label AS evidence_class, {d("evidence", "base + coalesce((SELECT sum(w.w) FROM g JOIN w USING (gene) WHERE g.sample_id = s.sample_id AND w.label = b.label), 0)")} FROM {{samples}} s CROSS JOIN base b"""


_PAIRS = f"""WITH sets AS (SELECT s.sample_id, s.label, list(DISTINCT gene) FILTER (WHERE gene IS NOT NULL) AS genes FROM {{samples}} s LEFT JOIN {{variants}} v USING (sample_id) WHERE s.{TRAIN} GROUP BY s.sample_id, s.label),
sized AS (SELECT *, coalesce(len(genes), 0) > (SELECT quantile_cont(coalesce(len(genes), 0), 0.95) FROM sets) AS hyper FROM sets),
names AS (SELECT DISTINCT unnest(genes) AS gene FROM sets),
pairs AS (SELECT a.gene AS a, b.gene AS b, s.label, s.hyper FROM names a, names b, sized s WHERE a.gene < b.gene AND list_contains(s.genes, a.gene) AND list_contains(s.genes, b.gene)),
tables AS (SELECT a, b, count(*) AS n_ab, avg(CASE WHEN hyper THEN 1.0 ELSE 0.0 END) AS hyper_fraction, arg_min(label, place) AS label, min(best) AS n_best FROM (
  SELECT p.*, m.c AS best, row_number() OVER (PARTITION BY p.a, p.b ORDER BY m.c DESC, p.label) AS place FROM pairs p JOIN (SELECT a, b, label, count(*) AS c FROM pairs GROUP BY ALL) m USING (a, b, label)) t GROUP BY a, b),
tops AS (SELECT a, b, max(c) AS n_best FROM (SELECT a, b, label, count(*) AS c FROM pairs GROUP BY ALL) m GROUP BY a, b),
alone AS (SELECT gene, label, count(*) AS c, sum(count(*)) OVER (PARTITION BY gene) AS total FROM (SELECT unnest(genes) AS gene, label FROM sets) x GROUP BY gene, label),
scored AS (
  SELECT t.a AS gene_a, t.b AS gene_b, t.label, t.n_ab, tops.n_best, tops.n_best / CAST(t.n_ab AS DOUBLE) AS purity, t.hyper_fraction,
         tops.n_best / CAST(t.n_ab AS DOUBLE) - greatest(coalesce((SELECT c / CAST(total AS DOUBLE) FROM alone x WHERE x.gene = t.a AND x.label = t.label), 0), coalesce((SELECT c / CAST(total AS DOUBLE) FROM alone x WHERE x.gene = t.b AND x.label = t.label), 0)) AS lift
  FROM tables t JOIN tops USING (a, b)
)
SELECT gene_a, gene_b, label, {i("n_ab")}, {i("n_best")}, {d("purity")}, {d("hyper_fraction")}, {d("lift")}, {d("score", "lift * sqrt(n_ab)")} FROM scored WHERE n_ab >= 20 AND n_best >= 8"""

#: Chi-square as the sum of squares over expectations less the total.
_CHI2 = f"""WITH train AS (SELECT * FROM {{samples}} WHERE {TRAIN}), hits AS (SELECT DISTINCT gene, sample_id, label FROM {{variants}} JOIN train USING (sample_id, label)),
cells AS (SELECT gene, label, CAST(count(*) AS DOUBLE) AS o FROM hits GROUP BY gene, label), totals AS (SELECT gene, sum(o) AS total FROM cells GROUP BY gene),
shares AS (SELECT label, count(*) / CAST((SELECT count(*) FROM train) AS DOUBLE) AS share FROM train GROUP BY label),
scores AS (SELECT gene AS feature, sum(o * o / (share * total)) - max(total) AS score FROM cells JOIN totals USING (gene) JOIN shares USING (label) GROUP BY gene)
SELECT feature, {d("score")}, {i("place", "row_number() OVER (ORDER BY round(score, 9) DESC, feature)")} FROM scores"""

#: F1 by precision and recall.
_BY_CLASS = f"""{_PREDS}, pr AS (
  SELECT m.member, c.cls, (SELECT count(*) FROM best b WHERE b.member = m.member AND y_true = cls AND y_pred = cls) AS hit, (SELECT count(*) FROM best b WHERE b.member = m.member AND y_pred = cls) AS said,
         (SELECT count(*) FROM best b WHERE b.member = m.member AND y_true = cls) AS is_so FROM members m CROSS JOIN classes c),
f AS (SELECT member, cls, is_so AS support, said + is_so AS seen, CASE WHEN hit > 0 THEN 2 * (hit / CAST(said AS DOUBLE)) * (hit / CAST(is_so AS DOUBLE)) / (hit / CAST(said AS DOUBLE) + hit / CAST(is_so AS DOUBLE)) ELSE 0 END AS f1 FROM pr)"""

_PROFILE = """cell AS (SELECT sample_id, gene, string_agg(token, ' ' ORDER BY token) AS cell FROM {variants} GROUP BY sample_id, gene),
own AS (SELECT sample_id, sha256('[' || string_agg('{"gene":"' || gene || '","cell":"' || cell || '"}', ',' ORDER BY gene, cell) || ']') AS profile_hash, count(*) AS n_genes, list(gene ORDER BY gene) AS genes FROM cell GROUP BY sample_id),
prof AS (SELECT s.sample_id, s.label, coalesce(profile_hash, '') AS profile_hash, coalesce(n_genes, 0) AS n_genes, genes, min(s.sample_id) OVER (PARTITION BY coalesce(profile_hash, '')) AS group_key FROM {samples} s LEFT JOIN own USING (sample_id))"""

#: SQL of queries that are not plans.
QUERIES: dict[str, str] = {
    "stratified_folds": "SELECT sample_id, label, CAST((row_number() OVER (PARTITION BY label ORDER BY md5('42:' || sample_id), sample_id) - 1) % 5 AS INT) AS fold FROM {samples}",
    "group_folds": f"""WITH {_PROFILE},
votes AS (SELECT group_key, label, count(*) AS c, sum(count(*)) OVER (PARTITION BY group_key) AS n FROM prof GROUP BY group_key, label),
groups AS (SELECT group_key, max(n) AS n, arg_max(label, -place) AS label FROM (SELECT *, row_number() OVER (PARTITION BY group_key ORDER BY c DESC, label) AS place FROM votes) v GROUP BY group_key),
dealt AS (SELECT group_key, (row_number() OVER (PARTITION BY label ORDER BY n DESC, md5('42:' || group_key), group_key) - 1) % 10 AS turn FROM groups)
SELECT sample_id, label, profile_hash, n_genes, prof.group_key, CAST(CASE WHEN turn < 5 THEN turn ELSE 9 - turn END AS INT) AS fold FROM prof JOIN dealt USING (group_key)""",
    "frame_fingerprint": "SELECT bit_xor(CAST('0x' || left(h, 15) AS BIGINT)) AS xor, CAST(sum(CAST('0x' || left(h, 6) AS BIGINT)) AS BIGINT) AS total, count(*) AS n FROM (SELECT md5(sample_id || chr(31) || coalesce(label, chr(0))) AS h FROM {samples}) x",
    # sets of fewer than 999 genes are as similar as .999 only if they are equal
    "twin_groups_jaccard": f"""WITH {_PROFILE} SELECT sample_id, CASE WHEN n_genes >= 3 THEN min(sample_id) OVER (PARTITION BY CASE WHEN n_genes >= 3 THEN genes END) WHEN n_genes > 0 THEN group_key ELSE sample_id END AS group_key FROM prof""",
}


WRITTEN: dict[str, str] = {
    "freq21": _FREQ21,
    "parsed19": _PARSED19,
    "profile_groups": f"WITH {_EQUAL} SELECT sample_id, label, {i('group_size', _SIZE)}, {i('singleton', f'CASE WHEN {_SIZE} = 1 THEN 1 ELSE 0 END')}, {i('group_key', 'min(sample_id) OVER (PARTITION BY cells)')} FROM own",
    "weights_group": _mean_one(f"1.0 / {_SIZE}"),
    "weights_group_sqrt": _mean_one(f"{_SIZE} ** -0.5"),
    "weights_same_label": _mean_one(f"1.0 / {_SIZE_LABEL}"),
    "weights_balanced": f"SELECT sample_id, {d('weight', '(SELECT count(*) FROM {samples}) / ((SELECT count(DISTINCT label) FROM {samples}) * CAST(count(*) OVER (PARTITION BY label) AS DOUBLE))')} FROM {{samples}}",
    "weights_rebalanced": f"WITH {_EQUAL}, per AS (SELECT label, count(DISTINCT cells) AS g FROM own GROUP BY label) SELECT sample_id, {d('weight', f'(SELECT count(*) FROM own) / CAST({_LABELS} AS DOUBLE) / g / ({_SIZE_LABEL})')} FROM own JOIN per USING (label)",
    "evidence_ovr": _evidence("ovr"),
    "evidence_bnb": _evidence("bnb"),
    "comut_pairs": _PAIRS,
    "chi2_scores": _CHI2,
    "macro_f1": f"WITH {_BY_CLASS} SELECT member, {d('macro_f1', 'avg(f1) FILTER (WHERE seen > 0)')}, {d('macro_f1_all', 'avg(f1)')} FROM f GROUP BY member",
    "per_class_f1": f"WITH {_BY_CLASS} SELECT member, cls, {d('f1')}, {i('support')} FROM f",
}


def second(name: str) -> str:
    """The text to compare the plan ``name`` with."""
    return WRITTEN.get(name) or ALL_PLANS[name].replace(CELLS, _DISTINCT_CELLS)


assert set(WRITTEN) <= set(PLANS)
