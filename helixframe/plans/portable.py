"""Feature blocks and statistics as portable SQL over the variant relations.

``{variants}``, ``{samples}``, ``{cellkeys}``, ``{penalties}``, ``{panel}``
(gene, role) and ``{comutpairs}`` stand for DataFrames; Catalyst plans the rest.  Every aggregate is two-level, per (sample,
gene) and then per sample, so that partial sums are combined before a shuffle;
fitted statistics are small grouped tables that are joined back by key.
Integers are cast to bigint and doubles rounded to six places at the end.
Tables of residue pairs have at most 400 rows and are broadcast by a hint.
"""

from __future__ import annotations

import re

from helixframe.functions.dims import DRIVERS, STAR_DRIVERS

KINDS = ("missense", "synonymous", "nonsense", "frameshift", "deletion", "insertion", "delins", "complex")
FUNCTIONAL = "('missense', 'nonsense', 'frameshift', 'deletion', 'insertion', 'delins', 'complex')"
INDEL = "('deletion', 'insertion', 'delins')"
TRAIN = "sample_id % 5 <> 0"
RARE, MIN_DF = 2, 3


def i(name: str, expression: str | None = None) -> str:
    return f"CAST(coalesce({expression or name}, 0) AS BIGINT) AS {name}"


def d(name: str, expression: str | None = None) -> str:
    return f"round(CAST(coalesce({expression or name}, 0) AS DOUBLE), 6) AS {name}"


def ratio(a: str, b: str) -> str:
    return f"CASE WHEN coalesce({b}, 0) > 0 THEN CAST({a} AS DOUBLE) / {b} ELSE 0 END"


def _count(test: str) -> str:
    return f"sum(CASE WHEN {test} THEN 1 ELSE 0 END)"


def _sum(test: str, value: str = "n") -> str:
    return f"sum(CASE WHEN {test} THEN {value} ELSE 0 END)"


_CELL_COUNTS = ", ".join([f"{_sum(f'kind = {k!r}')} AS {k}_count, {_sum(f'kind = {k!r}', 'tokens')} AS unique_{k}_count" for k in KINDS])
#: Cells by three steps of grouping, so that nothing is counted DISTINCT: equal
#: tokens, then equal signatures (each of one kind), then the cell.  All three
#: group within (sample, gene), by which the hint deals the rows out once.
CELLS = f"""toks AS (
  SELECT /*+ REPARTITION(sample_id, gene) */ sample_id, gene, token, signature, kind, enc3, ends_del FROM {{variants}}
),
once AS (SELECT sample_id, gene, token, signature, kind, count(*) AS n, max(enc3) AS enc3, max(ends_del) AS ends_del FROM toks GROUP BY sample_id, gene, token, signature, kind),
sigs AS (SELECT sample_id, gene, signature, kind, sum(n) AS n, count(*) AS tokens, max(enc3) AS enc3, max(ends_del) AS ends_del, sum(n * ends_del) AS n_ends_del FROM once GROUP BY sample_id, gene, signature, kind),
cells AS (
  SELECT sample_id, gene, sum(n) AS n, sum(tokens) AS unique_tokens, count(*) AS unique_signatures, {_CELL_COUNTS},
         {_sum(f"kind IN {INDEL}")} AS indel_count, {_sum(f"kind IN {INDEL}", "tokens")} AS unique_indel_count,
         {_sum("kind = 'other'")} AS other_count, {_sum(f"kind IN {FUNCTIONAL}")} AS functional, {_sum("kind IN ('deletion', 'delins')")} AS explicit_del,
         max(enc3) AS enc3, max(ends_del) AS ends_del, sum(n_ends_del) AS n_ends_del
  FROM sigs GROUP BY sample_id, gene
)"""

_BURDEN = {
    "mutated_gene_count": "i:M", "mutation_event_count": "i:E", "functional_event_count": "i:Fn", "synonymous_event_count": "i:syn", "missense_event_count": "i:mis", "nonsense_event_count": "i:non",
    "frameshift_event_count": "i:fs", "complex_event_count": "i:cx", "multihit_gene_count": "i:multi", "max_events_per_gene": "i:most", "no_mutation_flag": "i:CASE WHEN coalesce(M, 0) = 0 THEN 1 ELSE 0 END",
    "log1p_mutated_gene_count": "d:ln(1 + coalesce(M, 0))", "log1p_mutation_event_count": "d:ln(1 + coalesce(E, 0))", "functional_ratio": "r:Fn/E", "synonymous_ratio": "r:syn/E", "missense_ratio": "r:mis/Fn",
    "nonsense_ratio": "r:non/Fn", "frameshift_ratio": "r:fs/Fn", "multihit_gene_ratio": "r:multi/M", "explicit_deletion_event_count": "i:D", "explicit_deletion_gene_count": "i:Dg",
    "has_explicit_deletion": "i:CASE WHEN coalesce(D, 0) > 0 THEN 1 ELSE 0 END", "inframe_deletion_count": "i:D", "indel_or_frameshift_count": "i:D + fs", "loss_of_function_count": "i:non + fs + del_only",
}
_ADDITIONAL = {
    "events_per_mutated_gene": "r:E/M", "loss_of_function_ratio": "r:(non + fs + del_only)/Fn", "indel_ratio": "r:indel/E", "complex_ratio": "r:cx/E", "duplicate_event_count": "i:E - uniq",
    "duplicate_event_ratio": "r:(E - uniq)/E", "high_multihit_gene_count": "i:multi3", "max_gene_event_share": "r:most/E",
}
_ROLLUP = {f"has_{k}": f"i:CASE WHEN coalesce({x}, 0) > 0 THEN 1 ELSE 0 END" for k, x in (("missense", "mis"), ("synonymous", "syn"), ("nonsense", "non"), ("frameshift", "fs"), ("indel", "indel"), ("mnv", "cx"), ("duplicate_token", "E - uniq"))} | {
    "unique_mutation_token_count": "i:uniq", "indel_count": "i:indel", "mnv_count": "i:cx", "unique_missense_count": "i:u_mis", "unique_synonymous_count": "i:u_syn", "unique_nonsense_count": "i:u_non",
    "unique_frameshift_count": "i:u_fs", "unique_indel_count": "i:u_indel", "unique_mnv_count": "i:u_cx", "other_count": "i:other", "duplicate_token_count": "i:E - uniq", "duplicate_signature_count": "i:E - uniq_sig",
}


def columns(spec: dict[str, str]) -> str:
    out = []
    for name, how in spec.items():
        kind, text = how.split(":", 1)
        out.append(i(name, text) if kind == "i" else d(name, text) if kind == "d" else d(name, ratio(*text.rsplit("/", 1))))
    return ", ".join(out)


SUMS = f"""sums AS (
  SELECT sample_id, count(*) AS M, sum(n) AS E, sum(functional) AS Fn, sum(synonymous_count) AS syn, sum(missense_count) AS mis, sum(nonsense_count) AS non, sum(frameshift_count) AS fs,
         sum(complex_count) AS cx, {_count("n >= 2")} AS multi, {_count("n >= 3")} AS multi3, max(n) AS most, sum(explicit_del) AS D, {_count("explicit_del > 0")} AS Dg, sum(explicit_del) AS del_only,
         sum(indel_count) AS indel, sum(unique_tokens) AS uniq, sum(unique_signatures) AS uniq_sig, sum(unique_missense_count) AS u_mis, sum(unique_synonymous_count) AS u_syn,
         sum(unique_nonsense_count) AS u_non, sum(unique_frameshift_count) AS u_fs, sum(unique_indel_count) AS u_indel, sum(unique_complex_count) AS u_cx, sum(other_count) AS other
  FROM cells GROUP BY sample_id
)"""


def per_sample(spec: dict[str, str]) -> str:
    return f"WITH {CELLS}, {SUMS} SELECT s.sample_id, {columns(spec)} FROM {{samples}} s LEFT JOIN sums ON s.sample_id = sums.sample_id"


_FREQ_FAMILIES = {"gene": "gene", "gene_aa_change": "concat(gene, '|', token)", "aa_change": "token", "position": "pos_key"}
#: Keys of the families out of one scan of the tokens and one of the cells.
_FREQ_KEYS = f"""families AS ({" UNION ALL ".join(f"SELECT '{k}' AS family" for k in _FREQ_FAMILIES)}),
sk AS (
  SELECT DISTINCT sample_id, family, key FROM (
    SELECT sample_id, family, CASE family {" ".join(f"WHEN '{k}' THEN {e}" for k, e in _FREQ_FAMILIES.items())} END AS key FROM {{variants}} CROSS JOIN families
    UNION ALL SELECT sample_id, 'exact_mutation', concat(gene, '__', exact_key) FROM {{cellkeys}}
  ) k WHERE key IS NOT NULL
),
n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM {{samples}} WHERE {TRAIN}),
df AS (SELECT family, key, count(*) AS df FROM sk WHERE {TRAIN} GROUP BY family, key)"""


def _fam(kind: str, family: str, value: str) -> str:
    return f"{kind}(CASE WHEN family = '{family}' THEN {value} END)"


FREQ21 = f"""WITH {_FREQ_KEYS},
hit AS (
  SELECT sk.sample_id, sk.family, coalesce(df.df, 0) AS c, coalesce(df.df, 0) / n.n AS f, n.n AS n
  FROM sk LEFT JOIN df ON sk.family = df.family AND sk.key = df.key CROSS JOIN n
),
val AS (
  SELECT *, CASE WHEN c = 0 THEN ln(n + 1) + 1 ELSE ln((n + 1) / (c + 1)) + 1 END AS idf, -ln((c + 1) / (n + 1)) AS rarity FROM hit
),
agg AS (
  SELECT sample_id, sum(CASE WHEN family = 'gene_aa_change' AND c <= {RARE} THEN 1 ELSE 0 END) AS rare_mutation_token_count,
         {_fam("avg", "gene_aa_change", "f")} AS mean_token_frequency, {_fam("min", "gene_aa_change", "f")} AS min_token_frequency,
         {_fam("avg", "gene_aa_change", "idf")} AS mean_token_rarity, {_fam("max", "gene_aa_change", "idf")} AS max_token_rarity,
         {_fam("avg", "gene", "f")} AS mean_mutated_gene_frequency, {_fam("min", "gene", "f")} AS min_mutated_gene_frequency,
         {_fam("avg", "gene", "rarity")} AS mean_gene_rarity, {_fam("max", "gene", "rarity")} AS max_gene_rarity,
         sum(CASE WHEN family = 'gene_aa_change' AND c = 0 THEN 1 ELSE 0 END) AS unseen_token_count, sum(CASE WHEN family = 'gene' AND c = 0 THEN 1 ELSE 0 END) AS unseen_mutated_gene_count,
         {_fam("avg", "exact_mutation", "f")} AS mean_exact_mutation_frequency, {_fam("min", "exact_mutation", "f")} AS min_exact_mutation_frequency, {_fam("max", "exact_mutation", "f")} AS max_exact_mutation_frequency,
         {_fam("avg", "aa_change", "f")} AS mean_aa_change_frequency, {_fam("min", "aa_change", "f")} AS min_aa_change_frequency, {_fam("max", "aa_change", "f")} AS max_aa_change_frequency,
         {_fam("max", "gene_aa_change", "f")} AS max_gene_aa_change_frequency,
         {_fam("avg", "position", "f")} AS mean_position_frequency, {_fam("min", "position", "f")} AS min_position_frequency, {_fam("max", "position", "f")} AS max_position_frequency
  FROM val GROUP BY sample_id
)
SELECT s.sample_id, {i("rare_mutation_token_count")}, {i("unseen_token_count")}, {i("unseen_mutated_gene_count")}, {", ".join(d(c) for c in (
    "mean_token_frequency min_token_frequency mean_token_rarity max_token_rarity mean_mutated_gene_frequency min_mutated_gene_frequency mean_gene_rarity max_gene_rarity "
    "mean_exact_mutation_frequency min_exact_mutation_frequency max_exact_mutation_frequency mean_aa_change_frequency min_aa_change_frequency max_aa_change_frequency "
    "max_gene_aa_change_frequency mean_position_frequency min_position_frequency max_position_frequency").split())}
FROM {{samples}} s LEFT JOIN agg ON s.sample_id = agg.sample_id"""

FREQ_FAMILIES = f"WITH {_FREQ_KEYS} SELECT family, key, {i('document_count', 'df')}, {d('frequency', 'df / n')} FROM df CROSS JOIN n"

_ALPHA = 1.0
_TRANSITIONS = f"""tr AS (
  SELECT DISTINCT sample_id, left(token, 1) AS wt, right(token, 1) AS mu FROM {{variants}}
  WHERE kind = 'missense' AND left(token, 1) <> '*' AND right(token, 1) <> '*' AND left(token, 1) NOT IN ('B', 'J', 'O', 'U', 'X', 'Z') AND right(token, 1) NOT IN ('B', 'J', 'O', 'U', 'X', 'Z')
),
tn AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM {{samples}} WHERE {TRAIN}),
tc AS (SELECT wt, mu, CAST(count(*) AS DOUBLE) AS c FROM tr WHERE {TRAIN} GROUP BY wt, mu),
tw AS (SELECT wt, sum(c) AS cw FROM tc GROUP BY wt),
tm AS (SELECT mu, sum(c) AS cm FROM tc GROUP BY mu),
tt AS (SELECT coalesce(sum(c), 0) AS total FROM tc),
scored AS (
  SELECT p.wt, p.mu, coalesce(c, 0) AS c, coalesce(c, 0) / n AS f, -ln((coalesce(c, 0) + {_ALPHA}) / (coalesce(cw, 0) + 19 * {_ALPHA})) AS rarity,
         ln(((coalesce(c, 0) + {_ALPHA}) / (total + 380 * {_ALPHA})) / (((coalesce(cw, 0) + 19 * {_ALPHA}) / (total + 380 * {_ALPHA})) * ((coalesce(cm, 0) + 19 * {_ALPHA}) / (total + 380 * {_ALPHA})))) AS odds
  FROM (SELECT DISTINCT wt, mu FROM tr) p LEFT JOIN tc ON p.wt = tc.wt AND p.mu = tc.mu LEFT JOIN tw ON p.wt = tw.wt LEFT JOIN tm ON p.mu = tm.mu CROSS JOIN tt CROSS JOIN tn
)"""
AATRANS9 = f"""WITH {_TRANSITIONS}, agg AS (
  SELECT /*+ BROADCAST(s) */ tr.sample_id, avg(f) AS aa_transition_frequency_mean, max(f) AS aa_transition_frequency_max, avg(rarity) AS aa_transition_rarity_mean, max(rarity) AS aa_transition_rarity_max, avg(odds) AS aa_transition_log_odds_mean,
         min(odds) AS aa_transition_log_odds_min, max(odds) AS aa_transition_log_odds_max, {_count("c = 0")} AS unseen_aa_transition_count, {_count("c = 0")} / CAST(count(*) AS DOUBLE) AS unseen_aa_transition_ratio
  FROM tr JOIN scored s ON tr.wt = s.wt AND tr.mu = s.mu GROUP BY tr.sample_id
)
SELECT s.sample_id, {", ".join(d(c) for c in "aa_transition_frequency_mean aa_transition_frequency_max aa_transition_rarity_mean aa_transition_rarity_max aa_transition_log_odds_mean aa_transition_log_odds_min aa_transition_log_odds_max unseen_aa_transition_ratio".split())}, {i("unseen_aa_transition_count")}
FROM {{samples}} s LEFT JOIN agg ON s.sample_id = agg.sample_id"""
AATRANS_STATS = f"WITH {_TRANSITIONS} SELECT wt, mu AS mutant, {i('document_count', 'c')}, {d('frequency', 'f')}, {d('conditional_rarity', 'rarity')}, {d('log_odds', 'odds')} FROM scored WHERE c > 0"

_TFIDF = f"""tf AS (SELECT sample_id, concat('MUT__', gene, '__', token) AS term, count(*) AS tf FROM {{variants}} GROUP BY sample_id, gene, token),
n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM {{samples}} WHERE {TRAIN}),
vocabulary AS (SELECT term, ln((1 + max(n)) / (1 + count(*))) + 1 AS idf FROM tf CROSS JOIN n WHERE {TRAIN} GROUP BY term HAVING count(*) >= {MIN_DF}),
raw AS (SELECT sample_id, tf.term, tf * idf AS w FROM tf JOIN vocabulary v ON tf.term = v.term),
tfidf AS (SELECT sample_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY sample_id)) AS weight FROM raw)"""


def chi2(source: str, feature: str, value: str) -> str:
    """Relations obs, scores: chi-square of class sums over train samples."""
    return f"""classes AS (SELECT label, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS share FROM {{samples}} WHERE {TRAIN} GROUP BY label),
obs AS (SELECT {feature} AS feature, s.label, sum({value}) AS o FROM {source} x JOIN {{samples}} s ON x.sample_id = s.sample_id WHERE x.{TRAIN} GROUP BY {feature}, s.label),
totals AS (SELECT feature, sum(o) AS total FROM obs GROUP BY feature),
scores AS (
  SELECT t.feature, sum((coalesce(o, 0) - share * total) * (coalesce(o, 0) - share * total) / (share * total)) AS score
  FROM totals t CROSS JOIN classes c LEFT JOIN obs ON obs.feature = t.feature AND obs.label = c.label WHERE total > 0 GROUP BY t.feature
)"""


_BURDEN_TABLE = "m AS (SELECT s.sample_id, s.label, count(DISTINCT v.gene) AS burden, count(v.token) AS events FROM {samples} s LEFT JOIN {variants} v ON s.sample_id = v.sample_id GROUP BY s.sample_id, s.label)"
_PERCENTILES = "percentile_cont(0.{0}) WITHIN GROUP (ORDER BY events)"
_EDGES = ", ".join(f"percentile_cont(0.{k}) WITHIN GROUP (ORDER BY events) AS e{k}" for k in range(1, 10))
_EDGE_LIST = "UNION ALL ".join(f"SELECT e{k} AS e FROM q " for k in range(1, 10))
BURDEN_BINS = f"""WITH {_BURDEN_TABLE},
q AS (SELECT percentile_cont(0.95) WITHIN GROUP (ORDER BY events) AS threshold, {_EDGES} FROM m WHERE {TRAIN}),
edges AS (SELECT DISTINCT e FROM ({_EDGE_LIST}) x),
bins AS (SELECT m.sample_id, count(e) AS b FROM m LEFT JOIN edges ON e <= m.events GROUP BY m.sample_id)
SELECT m.sample_id, {i("hypermutated_flag", "CASE WHEN events > threshold THEN 1 ELSE 0 END")}, {i("burden_quantile_bin", "b")} FROM m JOIN bins ON m.sample_id = bins.sample_id CROSS JOIN q"""

_MUT = "g AS (SELECT DISTINCT sample_id, gene FROM {variants})"
_PAIRS = f"""{_MUT}, {_BURDEN_TABLE},
hyper AS (SELECT percentile_cont(0.95) WITHIN GROUP (ORDER BY burden) AS threshold FROM m WHERE {TRAIN}),
gt AS (SELECT g.gene, m.sample_id, m.label, CASE WHEN m.burden > h.threshold THEN 1 ELSE 0 END AS hyp FROM g JOIN m ON g.sample_id = m.sample_id CROSS JOIN hyper h WHERE g.{TRAIN}),
marg AS (SELECT gene, label, count(*) AS c FROM gt GROUP BY gene, label),
tot AS (SELECT gene, sum(c) AS c FROM marg GROUP BY gene),
pl AS (SELECT a.gene AS gene_a, b.gene AS gene_b, a.label, count(*) AS c, sum(a.hyp) AS hyp FROM gt a JOIN gt b ON a.sample_id = b.sample_id AND a.gene < b.gene GROUP BY a.gene, b.gene, a.label),
ranked AS (SELECT *, sum(c) OVER (PARTITION BY gene_a, gene_b) AS n_ab, sum(hyp) OVER (PARTITION BY gene_a, gene_b) AS n_hyp, row_number() OVER (PARTITION BY gene_a, gene_b ORDER BY c DESC, label) AS rk FROM pl),
pairs AS (
  SELECT r.gene_a, r.gene_b, r.label, r.n_ab, r.c AS n_best, CAST(r.c AS DOUBLE) / r.n_ab AS purity, CAST(r.n_hyp AS DOUBLE) / r.n_ab AS hyper_fraction,
         CAST(r.c AS DOUBLE) / r.n_ab - greatest(coalesce(ma.c, 0) / CAST(ta.c AS DOUBLE), coalesce(mb.c, 0) / CAST(tb.c AS DOUBLE)) AS lift
  FROM ranked r LEFT JOIN marg ma ON ma.gene = r.gene_a AND ma.label = r.label LEFT JOIN marg mb ON mb.gene = r.gene_b AND mb.label = r.label
       JOIN tot ta ON ta.gene = r.gene_a JOIN tot tb ON tb.gene = r.gene_b WHERE rk = 1
)"""
COMUT_PAIRS = f"WITH {_PAIRS} SELECT gene_a, gene_b, label, {i('n_ab')}, {i('n_best')}, {d('purity')}, {d('hyper_fraction')}, {d('lift')}, {d('score', 'lift * sqrt(n_ab)')} FROM pairs WHERE n_ab >= 20 AND n_best >= 8"
TOP_PAIRS, PAIRS_A_GENE = 20, 3


def comut_candidates(support: int = 20, class_support: int = 8, purity: float = 0.25, lift: float = 0.15, hyper: float = 0.50, pool: bool = True) -> str:
    """gene_a, gene_b, place: the pairs from which a greedy loop chooses
    (``{comutpairs}``), best first.  With ``pool`` both genes are drivers of the
    panel or of a manual pair, else any genes."""
    pairs = _PAIRS.replace("WHERE g.sample_id", "WHERE g.gene IN (SELECT gene FROM {panel} WHERE role IN ('driver', 'manual')) AND g.sample_id", 1) if pool else _PAIRS
    return f"""WITH {pairs}
SELECT gene_a, gene_b, {i("place", "row_number() OVER (ORDER BY round(lift * sqrt(n_ab), 9) DESC, gene_a, gene_b)")} FROM pairs
WHERE n_ab >= {support} AND n_best >= {class_support} AND purity >= {purity} AND lift >= {lift} AND hyper_fraction <= {hyper}"""


COMUT_FEATURES = f"""WITH {_MUT}, {_BURDEN_TABLE},
nbar AS (SELECT avg(CAST(burden AS DOUBLE)) AS nb, CAST(count(*) AS DOUBLE) AS n FROM m WHERE {TRAIN}),
ecdf AS (SELECT burden, sum(count(*)) OVER (ORDER BY burden) AS upto FROM m WHERE {TRAIN} GROUP BY burden),
ranks AS (SELECT b.burden, coalesce(max(e.upto), 0) AS upto FROM (SELECT DISTINCT burden FROM m) b LEFT JOIN ecdf e ON e.burden <= b.burden GROUP BY b.burden),
both_g AS (SELECT c.gene_a, c.gene_b, a.sample_id FROM {{comutpairs}} c JOIN g a ON a.gene = c.gene_a JOIN g b ON b.gene = c.gene_b AND b.sample_id = a.sample_id)
SELECT x.sample_id, concat(x.gene_a, '__', x.gene_b) AS pair, {i("and_flag", "1")}, {d("share", "nb / greatest(m.burden, 1)")}, {d("gate", "1 - upto / n")}
FROM both_g x JOIN m ON x.sample_id = m.sample_id JOIN ranks r ON r.burden = m.burden CROSS JOIN nbar"""

def _signatures(support: int, lift: float, hyper: float, topk: int) -> str:
    return f"""{_MUT}, {_BURDEN_TABLE},
hyper AS (SELECT percentile_cont(0.95) WITHIN GROUP (ORDER BY burden) AS threshold FROM m WHERE {TRAIN}),
sizes AS (SELECT label, CAST(count(*) AS DOUBLE) AS size, CAST(sum(count(*)) OVER () AS DOUBLE) AS n FROM m WHERE {TRAIN} GROUP BY label),
pc AS (SELECT g.gene, m.label, count(*) AS c, sum(CASE WHEN m.burden > h.threshold THEN 1 ELSE 0 END) AS hyp FROM g JOIN m ON g.sample_id = m.sample_id CROSS JOIN hyper h WHERE g.{TRAIN} GROUP BY g.gene, m.label),
pt AS (SELECT gene, sum(c) AS total FROM pc GROUP BY gene),
sig AS (
  SELECT pc.gene, pc.label, pc.c, c / size - (total - c) / (n - size) AS lift, CAST(hyp AS DOUBLE) / c AS hyper_fraction, total, n FROM pc JOIN pt ON pc.gene = pt.gene JOIN sizes s ON pc.label = s.label
),
topsig AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(lift * sqrt(c), 9) DESC, gene) AS rk FROM sig WHERE c >= {support} AND lift >= {lift} AND hyper_fraction <= {hyper}),
member AS (SELECT label, gene, ln((n + 1) / (total + 1)) + 1 AS idf, count(*) OVER (PARTITION BY label) AS size FROM topsig WHERE rk <= {topk})"""


def class_signatures(support: int = 5, lift: float = 0.05, hyper: float = 0.50, topk: int = 30) -> str:
    return f"WITH {_signatures(support, lift, hyper, topk)} SELECT label, gene, {i('support', 'c')}, {d('lift')}, {d('hyper_fraction')}, {d('score', 'lift * sqrt(c)')}, {i('place', 'rk')} FROM topsig WHERE rk <= {topk}"


def membership(support: int = 5, lift: float = 0.05, hyper: float = 0.50, topk: int = 30) -> str:
    return f"""WITH {_signatures(support, lift, hyper, topk)},
gene_count AS (SELECT CAST(count(DISTINCT gene) AS DOUBLE) AS genes FROM g),
weights AS (SELECT gene, ln((max(n) + 1) / (max(total) + 1)) + 1 AS idf FROM sig GROUP BY gene),
whole AS (SELECT g.sample_id, count(*) AS n, sum(coalesce(idf, 0)) AS wn FROM g LEFT JOIN weights w ON g.gene = w.gene GROUP BY g.sample_id),
part AS (SELECT g.sample_id, b.label, count(*) AS c, sum(b.idf) AS wc, max(b.size) AS size FROM g JOIN member b ON g.gene = b.gene GROUP BY g.sample_id, b.label)
SELECT p.sample_id, p.label AS signature_class, {d("share", "CAST(c AS DOUBLE) / w.n")}, {d("enrich", "(CAST(c AS DOUBLE) / w.n) / (size / genes)")}, {d("wshare", "wc / wn")}, {i("any_flag", "1")},
       {d("logcount", "ln(1 + c)")}, {d("fraction", "CAST(c AS DOUBLE) / size")}, {d("wburden", "wc")}
FROM part p JOIN whole w ON p.sample_id = w.sample_id CROSS JOIN gene_count"""


def evidence(method: str, crossfit: bool = False) -> str:
    """Smoothed gene evidence per class, fitted on train samples; with
    ``crossfit`` each train sample is scored by counts without its inner fold."""
    inner = "CAST(floor(sample_id / 5) AS BIGINT) % 5"
    weight = "ln(p) - ln(1 - p) - ln(r) + ln(1 - r)" if method == "ovr" else "ln(p) - ln(1 - p)"
    fold = f"SELECT DISTINCT {inner} AS fold FROM {{samples}}" if crossfit else "SELECT -1 AS fold"
    out = f"s.{TRAIN} AND {inner.replace('sample_id', 's.sample_id')} <> f.fold" if crossfit else f"s.{TRAIN}"
    keep = f"s.{TRAIN} AND {inner.replace('sample_id', 's.sample_id')} = f.fold" if crossfit else "1 = 1"
    base = "coalesce(bias, 0)" if method == "bnb" else "0"
    return f"""WITH {_MUT}, folds AS ({fold}),
fit AS (SELECT f.fold, s.sample_id, s.label FROM {{samples}} s CROSS JOIN folds f WHERE {out}),
nc AS (SELECT fold, label, CAST(count(*) AS DOUBLE) AS nc FROM fit GROUP BY fold, label),
nn AS (SELECT fold, sum(nc) AS n FROM nc GROUP BY fold),
gc AS (SELECT fit.fold, g.gene, fit.label, CAST(count(*) AS DOUBLE) AS c FROM g JOIN fit ON g.sample_id = fit.sample_id GROUP BY fit.fold, g.gene, fit.label),
gt AS (SELECT fold, gene, sum(c) AS total FROM gc GROUP BY fold, gene),
grid AS (
  SELECT gt.fold, gt.gene, nc.label, (coalesce(c, 0) + 20 * (total / n)) / (nc + 20) AS p0, (total - coalesce(c, 0) + 20 * (total / n)) / (n - nc + 20) AS r0
  FROM gt JOIN nc ON gt.fold = nc.fold JOIN nn ON gt.fold = nn.fold LEFT JOIN gc ON gc.fold = gt.fold AND gc.gene = gt.gene AND gc.label = nc.label
),
clipped AS (SELECT fold, gene, label, least(greatest(p0, 1e-7), 1 - 1e-7) AS p, least(greatest(r0, 1e-7), 1 - 1e-7) AS r FROM grid),
w AS (SELECT fold, gene, label, {weight} AS w, ln(1 - p) AS b FROM clipped),
bias AS (SELECT fold, label, sum(b) AS bias FROM w GROUP BY fold, label),
target AS (SELECT f.fold, s.sample_id FROM {{samples}} s CROSS JOIN folds f WHERE {keep}),
sums AS (SELECT t.fold, t.sample_id, w.label, sum(w.w) AS s FROM target t JOIN g ON g.sample_id = t.sample_id JOIN w ON w.fold = t.fold AND w.gene = g.gene GROUP BY t.fold, t.sample_id, w.label)
SELECT t.sample_id, b.label AS evidence_class, {d("evidence", f"coalesce(s, 0) + {base}")} FROM target t JOIN bias b ON b.fold = t.fold LEFT JOIN sums ON sums.fold = t.fold AND sums.sample_id = t.sample_id AND sums.label = b.label"""


_DOMAIN_TOKENS = "dd AS (SELECT DISTINCT sample_id, gene, dkind, dref, dalt FROM {variants})"
_DOMAIN = _DOMAIN_TOKENS + """,
dc AS (SELECT sample_id, gene, count(*) AS t, max(CASE WHEN dkind IN ('nonsense', 'frameshift') THEN 1 ELSE 0 END) AS lof, max(CASE WHEN dkind = 'missense' THEN 1 ELSE 0 END) AS mis FROM dd GROUP BY sample_id, gene)"""
_DKINDS = ("missense", "silent", "nonsense", "frameshift", "inframe_indel", "range_sub")
#: Genes of the panel with a role; none has two rows of one role.
_DRIVER = "(SELECT gene AS panel_gene FROM {panel} WHERE role = 'driver') panel"
_CHANNELS = {"CtoA": "c_a", "CtoG": "c_g", "CtoT": "c_t", "TtoA": "t_a", "TtoC": "t_c", "TtoG": "t_g", "cpg": "cpg", "ti": "ti"}

_PREDS = """classes AS (SELECT label AS cls, row_number() OVER (ORDER BY label) AS ci FROM (SELECT DISTINCT label FROM {samples}) x),
members AS (SELECT 1 AS member UNION ALL SELECT 2 UNION ALL SELECT 3),
rawp AS (SELECT s.sample_id, s.label AS y_true, m.member, c.cls, c.ci, (s.sample_id * (6 + m.member) + c.ci * 13 * m.member) % 97 + 1 + CASE WHEN c.cls = s.label THEN 20 * m.member ELSE 0 END AS v FROM {samples} s CROSS JOIN members m CROSS JOIN classes c),
preds AS (SELECT sample_id, y_true, member, cls, ci, v / CAST(sum(v) OVER (PARTITION BY sample_id, member) AS DOUBLE) AS p FROM rawp),
best AS (SELECT sample_id, member, y_true, cls AS y_pred FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, member ORDER BY round(p, 12) DESC, ci) AS rk FROM preds) x WHERE rk = 1)"""
_F1 = """tp AS (
  SELECT c.cls, sum(CASE WHEN y_true = c.cls AND y_pred = c.cls THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN y_true <> c.cls AND y_pred = c.cls THEN 1 ELSE 0 END) AS fp,
         sum(CASE WHEN y_true = c.cls AND y_pred <> c.cls THEN 1 ELSE 0 END) AS fn, b.member FROM best b CROSS JOIN classes c GROUP BY c.cls, b.member
),
f1 AS (SELECT member, cls, tp + fn AS support, CASE WHEN 2 * tp + fp + fn > 0 THEN 2e0 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1, tp + fp + fn AS seen FROM tp)"""

#: A profile is the digest of all of a sample's cells, each with its gene.
_PROFILE = """cells_of AS (SELECT sample_id, md5(CAST(array_sort(array_agg(concat(gene, ' ', exact_key))) AS STRING)) AS digest FROM {cellkeys} GROUP BY sample_id),
prof AS (SELECT s.sample_id, s.label, coalesce(digest, '') AS profile FROM {samples} s LEFT JOIN cells_of k ON s.sample_id = k.sample_id)"""
_GROUPS = f"{_PROFILE}, lab AS (SELECT *, count(*) OVER (PARTITION BY profile) AS gs, count(*) OVER (PARTITION BY label, profile) AS ncg, count(*) OVER (PARTITION BY label) AS nc FROM prof), tot AS (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(count(DISTINCT label) AS DOUBLE) AS k FROM prof)"


def weighted(raw: str, normal: bool = True) -> str:
    value = "w * n / total" if normal else "w"
    return f"""WITH {_GROUPS}, gcnt AS (SELECT label, CAST(count(DISTINCT profile) AS DOUBLE) AS g FROM prof GROUP BY label),
raww AS (SELECT lab.sample_id, {raw} AS w FROM lab JOIN gcnt ON lab.label = gcnt.label CROSS JOIN tot), summed AS (SELECT sum(w) AS total FROM raww)
SELECT sample_id, {d("weight", value)} FROM raww CROSS JOIN summed CROSS JOIN tot"""


_CELL_OUT = ", ".join(
    [f"{i(f'has_{k}', f'CASE WHEN {x}_count > 0 THEN 1 ELSE 0 END')}, {i(f'{k}_count', f'{x}_count')}, {i(f'unique_{k}_count', f'unique_{x}_count')}" for k, x in [(k, k) for k in KINDS] + [("indel", "indel"), ("mnv", "complex")]]
    + [i("mutation_token_count", "n"), i("unique_mutation_token_count", "unique_tokens"), i("has_duplicate_token", "CASE WHEN n > unique_tokens THEN 1 ELSE 0 END"), i("duplicate_token_count", "n - unique_tokens"), i("duplicate_signature_count", "n - unique_signatures"), i("other_count")]
)
_GENERAL = {
    "GENE": "concat('GENE__', gene)", "TYPE": "concat('TYPE__', CASE WHEN kind = 'other' THEN 'UNKNOWN' ELSE upper(kind) END)", "GENE_TYPE": "CASE WHEN kind = 'other' THEN concat('GENE_PARSE_FAILED__', gene) ELSE concat('GENE_TYPE__', gene, '__', upper(kind)) END",
    "FAILED": "CASE WHEN kind = 'other' THEN 'PARSE_FAILED' END", "REF": "CASE WHEN kind <> 'other' AND ref_aa <> '' THEN concat('REF__', ref_aa) END", "ALT": "CASE WHEN kind <> 'other' AND alt_aa <> '' THEN concat('ALT__', alt_aa) END",
    "AA": "CASE WHEN kind <> 'other' AND ref_aa <> '' AND alt_aa <> '' THEN concat('AA_CHANGE__', ref_aa, '_', alt_aa) END",
    "POSBIN": "CASE WHEN kind <> 'other' AND position >= 0 THEN concat('POSBIN__', CAST(CAST(floor(position / 50) AS BIGINT) * 50 AS VARCHAR(20)), '_', CAST(CAST(floor(position / 50) AS BIGINT) * 50 + 49 AS VARCHAR(20))) END",
    "GENE_POSBIN": "CASE WHEN kind <> 'other' AND position >= 0 THEN concat('GENE_POSBIN__', gene, '__', CAST(CAST(floor(position / 50) AS BIGINT) * 50 AS VARCHAR(20)), '_', CAST(CAST(floor(position / 50) AS BIGINT) * 50 + 49 AS VARCHAR(20))) END",
}
_PARTS = " UNION ALL ".join(f"SELECT '{k}' AS part" for k in _GENERAL)
_PIECE = "CASE part " + " ".join(f"WHEN '{k}' THEN {e}" for k, e in _GENERAL.items()) + " END"
_GENERALISED = f"SELECT sample_id, gene, seq, part, piece FROM (SELECT sample_id, gene, seq, part, {_PIECE} AS piece FROM {{variants}} CROSS JOIN ({_PARTS}) parts) y WHERE piece IS NOT NULL"


#: What a sample's parsed tokens are counted by, out of one scan.
_FACETS = {
    "ref": "CASE WHEN ref_aa <> '' THEN ref_aa END", "alt": "CASE WHEN alt_aa <> '' THEN alt_aa END", "pair": "CASE WHEN ref_aa <> '' AND alt_aa <> '' THEN concat(ref_aa, alt_aa) END",
    "bin": "CASE WHEN position >= 0 THEN CAST(CAST(floor(position / 50) AS BIGINT) AS VARCHAR(20)) END", "kind": "kind",
}
_PARSED_FACETS = f"""facet_names AS ({" UNION ALL ".join(f"SELECT '{k}' AS facet" for k in _FACETS)}),
facets AS (
  SELECT sample_id, facet, key, count(*) AS n FROM (
    SELECT sample_id, facet, CASE facet {" ".join(f"WHEN '{k}' THEN {e}" for k, e in _FACETS.items())} END AS key FROM {{variants}} CROSS JOIN facet_names WHERE kind <> 'other'
  ) f WHERE key IS NOT NULL GROUP BY sample_id, facet, key
)"""


def suffix(gene: str) -> str:
    """A gene's part of a column name: letters, digits and underscores."""
    return re.sub(r"\W", "_", gene.removeprefix("Brand#"))


def quoted(gene: str) -> str:
    return "'" + gene.replace("'", "''") + "'"


def gene_panel_pivot(genes: tuple[str, ...] = DRIVERS) -> str:
    """Events of each gene of a panel, a column each."""
    columns = ", ".join(i(f"gene_event_count_{suffix(g)}", f"sum(CASE WHEN gene = {quoted(g)} THEN n ELSE 0 END)") for g in genes)
    return f"WITH {CELLS} SELECT s.sample_id, {columns} FROM {{samples}} s LEFT JOIN cells c ON s.sample_id = c.sample_id GROUP BY s.sample_id"


PLANS: dict[str, str] = {
    "token_classify": f"SELECT sample_id, gene, {i('seq')}, token, kind, coarse_kind FROM {{variants}}",
    "token_signature": f"SELECT sample_id, gene, {i('seq')}, token, signature FROM {{variants}}",
    "token_string_features": f"SELECT sample_id, gene, {i('seq')}, ref_aa, alt_aa, {i('position')}, {d('log_position', 'CASE WHEN position >= 0 THEN ln(1 + position) ELSE 0 END')}, {i('has_stop')}, {i('has_frameshift', 'has_fs')}, {i('has_deletion_insertion', 'has_del_ins')}, {i('mutation_string_length', 'length(token)')}, {i('numeric_token_count', 'n_runs')} FROM {{variants}}",
    "token_domain": f"SELECT sample_id, gene, {i('seq')}, dkind, dref, dalt FROM {{variants}}",
    "token_encode3": f"SELECT sample_id, gene, {i('enc3', 'max(enc3)')} FROM {{variants}} GROUP BY sample_id, gene",
    "token_generalised": f"SELECT part, piece, {i('n', 'count(*)')} FROM ({_GENERALISED}) x GROUP BY part, piece",
    "coarse_kind_counts": f"SELECT label, coarse_kind, {i('n', 'count(*)')}, {i('samples', 'count(DISTINCT sample_id)')} FROM {{variants}} GROUP BY label, coarse_kind",
    "position_keys": f"SELECT pos_key, {i('n', 'count(*)')} FROM {{variants}} WHERE pos_key IS NOT NULL GROUP BY pos_key",
    "cell_features": f"WITH {CELLS} SELECT sample_id, gene, {_CELL_OUT} FROM cells",
    "cell_string_features": f"""SELECT sample_id, gene, max(CASE WHEN seq = 1 THEN ref_aa END) AS ref_aa, max(CASE WHEN seq = 1 THEN alt_aa END) AS alt_aa, {i("position", "max(CASE WHEN seq = 1 THEN position END)")},
        {i("has_repeated_position", "CASE WHEN count(CASE WHEN position >= 0 THEN 1 END) > count(DISTINCT CASE WHEN position >= 0 THEN position END) THEN 1 ELSE 0 END")}, {i("has_stop", "max(has_stop)")}, {i("has_frameshift", "max(has_fs)")},
        {i("has_deletion_insertion", "max(has_del_ins)")}, {i("total_length", "sum(length(token))")}, {i("total_numeric", "sum(n_runs)")}, {", ".join(i(f"{k}_count", _count(f"kind = '{k}'")) for k in (*KINDS, "other"))} FROM {{variants}} GROUP BY sample_id, gene""",
    "sample_burden25": per_sample(_BURDEN),
    "sample_rollup44": per_sample(_BURDEN | _ROLLUP),
    "burden_additional8": per_sample(_ADDITIONAL),
    "burden_legacy18": f"""WITH {CELLS}, gcount AS (SELECT count(DISTINCT gene) AS genes FROM {{variants}}), legacy AS (
        SELECT sample_id, count(DISTINCT gene) AS M, count(*) AS E, count(DISTINCT token) AS uniq, {_count("coarse_kind = 'synonymous'")} AS syn, {_count("coarse_kind <> 'synonymous'")} AS fn, {_count("coarse_kind = 'missense'")} AS mis,
               {_count("coarse_kind = 'nonsense'")} AS non, {_count("coarse_kind = 'frameshift'")} AS fs, {_count("coarse_kind IN ('complex', 'indel')")} AS cx, sum(ends_del) AS dels FROM {{variants}} GROUP BY sample_id
      ), g2 AS (SELECT sample_id, {_count("n >= 2")} AS multi, max(n) AS most, sum(ends_del) AS dg FROM cells GROUP BY sample_id)
      SELECT s.sample_id, {i("mutated_gene_count", "M")}, {i("mutation_event_count", "E")}, {i("synonymous_event_count", "syn")}, {i("functional_event_count", "fn")}, {i("missense_event_count", "mis")}, {i("nonsense_event_count", "non")},
             {i("frameshift_event_count", "fs")}, {i("complex_event_count", "cx")}, {i("multihit_gene_count", "multi")}, {i("max_events_per_gene", "most")}, {i("no_mutation_flag", "CASE WHEN M IS NULL THEN 1 ELSE 0 END")},
             {d("mutation_gene_ratio", "CAST(M AS DOUBLE) / genes")}, {d("multi_mutation_gene_ratio", ratio("multi", "M"))}, {i("unique_mutation_token_count", "uniq")}, {i("repeated_mutation_token_count", "E - uniq")},
             {i("explicit_deletion_event_count", "dels")}, {i("explicit_deletion_gene_count", "dg")}, {i("has_explicit_deletion", "CASE WHEN dels > 0 THEN 1 ELSE 0 END")}
      FROM {{samples}} s LEFT JOIN legacy l ON s.sample_id = l.sample_id LEFT JOIN g2 ON s.sample_id = g2.sample_id CROSS JOIN gcount""",
    "gene_event_count_long": f"WITH {CELLS} SELECT sample_id, gene, {i('gene_mutated', '1')}, {i('gene_event_count', 'n')} FROM cells",
    "gene_panel_pivot": gene_panel_pivot(STAR_DRIVERS),
    "gene_type_long": f"SELECT sample_id, gene, coarse_kind AS type, {i('flag', '1')} FROM (SELECT DISTINCT sample_id, gene, coarse_kind FROM {{variants}}) x",
    "parsed19": f"""WITH {_PARSED_FACETS},
      st AS (
        SELECT sample_id, count(*) AS E, {_count("kind <> 'other'")} AS parsed, avg(p) AS pm, stddev_pop(p) AS ps, min(p) AS pmin, max(p) AS pmax, median(p) AS pmed
        FROM (SELECT sample_id, kind, CASE WHEN kind <> 'other' AND position >= 0 THEN position END AS p FROM {{variants}}) x GROUP BY sample_id
      ),
      fc AS (
        SELECT sample_id, {", ".join(f"{_count(f'facet = {k!r}')} AS {k}s, max(CASE WHEN facet = {k!r} THEN n END) AS top_{k}" for k in _FACETS)} FROM facets GROUP BY sample_id
      ),
      gp AS (SELECT sample_id, gene, sum(n) AS c, count(*) AS u FROM (SELECT sample_id, gene, position, count(*) AS n FROM {{variants}} WHERE kind <> 'other' AND position >= 0 GROUP BY sample_id, gene, position) x GROUP BY sample_id, gene),
      gs AS (SELECT sample_id, count(*) AS g, {_count("c > u")} AS hot, {_count("u > 1")} AS multi, avg(u) AS mu FROM gp GROUP BY sample_id)
      SELECT s.sample_id, {i("parsed_token_count", "parsed")}, {i("unparsed_token_count", "E - parsed")}, {d("parse_success_ratio", ratio("parsed", "E"))}, {d("position_mean", "pm")}, {d("position_std", "ps")}, {i("position_min", "pmin")}, {i("position_max", "pmax")},
             {d("position_median", "pmed")}, {i("unique_ref_aa_count", "refs")}, {i("unique_alt_aa_count", "alts")}, {i("unique_aa_pair_count", "pairs")}, {i("unique_position_bin_count", "bins")}, {i("top_position_bin_count", "top_bin")}, {i("kind_diversity", "kinds")},
             {d("dominant_kind_ratio", ratio("top_kind", "parsed"))}, {i("genes_with_hotspot", "hot")}, {d("hotspot_ratio", ratio("hot", "g"))}, {i("genes_with_multiple_positions", "multi")}, {d("mean_positions_per_gene", "mu")}
      FROM {{samples}} s LEFT JOIN st ON s.sample_id = st.sample_id LEFT JOIN fc ON s.sample_id = fc.sample_id LEFT JOIN gs ON s.sample_id = gs.sample_id""",
    "amino9": f"""WITH t AS (SELECT DISTINCT sample_id, gene, token FROM {{variants}} WHERE kind = 'missense'),
      sc AS (SELECT t.sample_id, penalty FROM t LEFT JOIN {{penalties}} p ON p.ref = left(token, 1) AND p.alt = right(token, 1)),
      agg AS (SELECT sample_id, sum(penalty) AS ps, avg(penalty) AS pm, max(penalty) AS px, count(penalty) AS n, {_count("penalty >= 1.0")} AS rad, {_count("penalty <= 0.5")} AS cons, {_count("penalty IS NULL")} AS missing FROM sc GROUP BY sample_id)
      SELECT s.sample_id, {d("aa_penalty_sum", "ps")}, {d("aa_penalty_mean", "pm")}, {d("aa_penalty_max", "px")}, {i("aa_scored_count", "n")}, {i("aa_radical_count", "rad")}, {i("aa_conservative_count", "cons")}, {i("aa_has_radical", "CASE WHEN rad > 0 THEN 1 ELSE 0 END")},
             {i("aa_missing_count", "missing")}, {i("aa_has_missing", "CASE WHEN missing > 0 THEN 1 ELSE 0 END")} FROM {{samples}} s LEFT JOIN agg ON s.sample_id = agg.sample_id""",
    "amino_gene_panel": f"SELECT sample_id, gene, {d('max_penalty', 'max(penalty)')} FROM {{variants}} v JOIN {_DRIVER} ON v.gene = panel_gene JOIN {{penalties}} p ON p.ref = left(token, 1) AND p.alt = right(token, 1) WHERE kind = 'missense' GROUP BY sample_id, gene",
    "penalty_table": f"SELECT ref, alt, {d('penalty')} FROM {{penalties}}",
    "codon_pair_map": f"WITH {{codons}} SELECT ref, alt, {', '.join(d(f'n_{k}', c) for k, c in _CHANNELS.items())} FROM pair_map",
    "domain_burden": f"WITH {_DOMAIN}, a AS (SELECT sample_id, count(*) AS n, sum(t) AS t, {_count('t >= 2')} AS multi FROM dc GROUP BY sample_id) SELECT s.sample_id, {i('b_ngene', 'n')}, {d('b_log_ngene', 'ln(1 + n)')}, {i('b_ntok', 't')}, {d('b_log_ntok', 'ln(1 + t)')}, {d('b_tok_per_gene', ratio('t', 'n'))}, {i('b_multihit', 'multi')}, {d('b_multihit_frac', ratio('multi', 'n'))} FROM {{samples}} s LEFT JOIN a ON s.sample_id = a.sample_id",
    "domain_kinds": f"WITH {_DOMAIN}, a AS (SELECT sample_id, count(*) AS t, {', '.join(f'{_count(f'dkind = {k!r}')} AS k_{k}' for k in _DKINDS)} FROM dd GROUP BY sample_id) SELECT s.sample_id, {', '.join(d(f'c_{k}', ratio(f'k_{k}', 't')) for k in _DKINDS)} FROM {{samples}} s LEFT JOIN a ON s.sample_id = a.sample_id",
    "domain_pairs": f"WITH {_DOMAIN}, p AS (SELECT sample_id, concat(dref, '>', dalt) AS pair, count(*) AS c FROM dd WHERE dkind = 'missense' GROUP BY sample_id, dref, dalt) SELECT sample_id, pair, {d('share', 'c / CAST(sum(c) OVER (PARTITION BY sample_id) AS DOUBLE)')} FROM p",
    "domain_sbs": f"WITH {{codons}}, {_DOMAIN}, a AS (SELECT /*+ BROADCAST(p) */ d.sample_id, count(*) AS n, {', '.join(f'sum({c}) AS {c}' for c in _CHANNELS.values())} FROM dd d JOIN pair_map p ON p.ref = d.dref AND p.alt = d.dalt WHERE dkind IN ('missense', 'nonsense') GROUP BY d.sample_id) SELECT s.sample_id, {', '.join(d(f'n_{k}', ratio(c, 'n')) for k, c in _CHANNELS.items())}, {i('n_has', 'CASE WHEN n > 0 THEN 1 ELSE 0 END')} FROM {{samples}} s LEFT JOIN a ON s.sample_id = a.sample_id",
    "domain_driver": f"WITH {_DOMAIN} SELECT sample_id, gene, {i('a_mutated', '1')}, {i('a2_lof', 'lof')}, {i('a2_mis', 'mis')} FROM dc JOIN {_DRIVER} ON dc.gene = panel_gene",
    "domain_msi": f"""WITH {_DOMAIN}, roles AS (SELECT gene AS panel_gene, max(CASE WHEN role = 'msi' THEN 1 ELSE 0 END) AS msi, max(CASE WHEN role = 'immune' THEN 1 ELSE 0 END) AS immune FROM {{panel}} GROUP BY gene),
      a AS (SELECT sample_id, count(*) AS n, sum(lof * coalesce(msi, 0)) AS msi, sum(lof * coalesce(immune, 0)) AS imm FROM dc LEFT JOIN roles ON dc.gene = panel_gene GROUP BY sample_id)
      SELECT s.sample_id, {i('m_msi_fs', 'msi')}, {d('m_msi_fs_frac', ratio('msi', 'n'))}, {i('m_imm_lof', 'imm')} FROM {{samples}} s LEFT JOIN a ON s.sample_id = a.sample_id""",
    "gene_rule_stats19": f"""WITH p AS (SELECT DISTINCT sample_id, gene, position FROM {{variants}} WHERE position > 0), gaps AS (SELECT sample_id, gene, min(gap) AS gap FROM (SELECT sample_id, gene, position - lag(position) OVER (PARTITION BY sample_id, gene ORDER BY position) AS gap FROM p) x GROUP BY sample_id, gene),
      a AS (SELECT sample_id, gene, count(*) AS n, count(DISTINCT upper(token)) AS u, count(DISTINCT CASE WHEN position > 0 THEN position END) AS up, count(CASE WHEN position > 0 THEN 1 END) AS np, min(CASE WHEN position > 0 THEN position END) AS pmin, max(CASE WHEN position > 0 THEN position END) AS pmax,
            {", ".join(f"{_count(f'kind = {k!r}')} AS k_{k}" for k in ("missense", "synonymous", "nonsense", "frameshift", "other"))}, {_count(f"kind IN {INDEL}")} AS k_indel, count(DISTINCT kind) AS kinds, max(CASE WHEN kind = 'other' OR ref_aa = '' THEN 1 ELSE 0 END) AS odd FROM {{variants}} GROUP BY sample_id, gene)
      SELECT a.sample_id, a.gene, {i("variant_count", "n")}, {i("unique_count", "u")}, {i("duplicate_count", "n - u")}, {i("unique_positions", "up")}, {", ".join(d(f"{k}_ratio", f"CAST(k_{k} AS DOUBLE) / n") for k in ("missense", "synonymous", "nonsense", "frameshift", "indel", "other"))},
             {d("log_min", "ln(1 + pmin)")}, {d("log_max", "ln(1 + pmax)")}, {d("log_span", "ln(1 + pmax - pmin)")}, {d("log_gap", "ln(1 + gap)")}, {d("same_position_ratio", ratio("np - up", "np"))}, {i("has_multiple", "CASE WHEN n > 1 THEN 1 ELSE 0 END")},
             {i("has_multiple_kinds", "CASE WHEN kinds > 1 THEN 1 ELSE 0 END")}, {i("has_duplicate", "CASE WHEN n > u THEN 1 ELSE 0 END")}, {i("has_unparsed", "odd")} FROM a LEFT JOIN gaps ON a.sample_id = gaps.sample_id AND a.gene = gaps.gene""",
    "doc_exact": f"SELECT concat('MUT__', gene, '__', token) AS term, {i('tokens', 'count(*)')}, {i('documents', 'count(DISTINCT sample_id)')} FROM {{variants}} GROUP BY gene, token",
    "doc_signature": f"SELECT concat('SIG__', gene, '__', signature) AS term, {i('documents', 'count(DISTINCT sample_id)')} FROM {{variants}} GROUP BY gene, signature",
    "count_tokens": f"WITH piece AS ({_GENERALISED}), c AS (SELECT sample_id, piece, count(*) AS n FROM piece GROUP BY sample_id, piece), df AS (SELECT piece, count(*) AS df FROM c WHERE {TRAIN} GROUP BY piece HAVING count(*) >= 2) SELECT c.piece AS term, {i('documents', 'count(*)')}, {i('tokens', 'sum(n)')} FROM c JOIN df ON c.piece = df.piece GROUP BY c.piece",
    "burden_bins": BURDEN_BINS,
    "freq21": FREQ21,
    "freq_families": FREQ_FAMILIES,
    "aatrans9": AATRANS9,
    "aatrans_stats": AATRANS_STATS,
    "tfidf_weights": f"WITH {_TFIDF} SELECT sample_id, term, {d('weight')} FROM tfidf",
    "chi2_scores": f"WITH {_MUT}, {chi2('g', 'gene', '1')} SELECT feature, {d('score')}, {i('place', 'row_number() OVER (ORDER BY round(score, 9) DESC, feature)')} FROM scores",
    "tfidf_topk_chi2": f"WITH {_TFIDF}, {chi2('tfidf', 'term', 'weight')} SELECT feature, {d('score')} FROM scores",
    "comut_pairs": COMUT_PAIRS,
    "comut_features": COMUT_FEATURES,
    "class_signatures": class_signatures(),
    "membership_values": membership(),
    "evidence_ovr": evidence("ovr"),
    "evidence_bnb": evidence("bnb"),
    "evidence_crossfit": evidence("ovr", crossfit=True),
    "profile_groups": f"WITH {_PROFILE} SELECT sample_id, label, {i('group_size', 'count(*) OVER (PARTITION BY profile)')}, {i('singleton', 'CASE WHEN count(*) OVER (PARTITION BY profile) = 1 THEN 1 ELSE 0 END')}, {i('group_key', 'min(sample_id) OVER (PARTITION BY profile)')} FROM prof",
    "fold_distribution": f"SELECT fold, label, {i('n', 'count(*)')}, {d('pct', '1e2 * count(*) / sum(count(*)) OVER (PARTITION BY fold)')} FROM (SELECT CAST(sample_id % 5 AS BIGINT) AS fold, label FROM {{samples}}) x GROUP BY fold, label",
    "weights_balanced": weighted("n / (k * nc)", normal=False),
    "weights_group": weighted("1e0 / gs"),
    "weights_group_sqrt": weighted("1e0 / sqrt(gs)"),
    "weights_same_label": weighted("1e0 / ncg"),
    "weights_rebalanced": weighted("(n / k) / (g * ncg)", normal=False),
    "ess": f"WITH {_GROUPS}, w AS (SELECT 'group' AS scheme, 1e0 / gs AS w FROM lab UNION ALL SELECT 'same_label', 1e0 / ncg FROM lab UNION ALL SELECT 'balanced', n / (k * nc) FROM lab CROSS JOIN tot) SELECT scheme, {d('ess', 'sum(w) * sum(w) / sum(w * w)')} FROM w GROUP BY scheme",
    "macro_f1": f"WITH {_PREDS}, {_F1} SELECT member, {d('macro_f1', 'avg(CASE WHEN seen > 0 THEN f1 END)')}, {d('macro_f1_all', 'avg(f1)')} FROM f1 GROUP BY member",
    "per_class_f1": f"WITH {_PREDS}, {_F1} SELECT member, cls, {d('f1')}, {i('support')} FROM f1",
    "confusion_matrix": f"WITH {_PREDS} SELECT member, y_true, y_pred, {i('n', 'count(*)')}, {d('share', 'count(*) / CAST(sum(count(*)) OVER (PARTITION BY member, y_true) AS DOUBLE)')} FROM best GROUP BY member, y_true, y_pred",
    "tvd": f"WITH {_PREDS}, t AS (SELECT member, y_true AS cls, count(*) AS c FROM best GROUP BY member, y_true), p AS (SELECT member, y_pred AS cls, count(*) AS c FROM best GROUP BY member, y_pred), n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM {{samples}}) SELECT m.member, {d('tvd', '0.5 * sum(abs(coalesce(t.c, 0) - coalesce(p.c, 0)) / n)')}, {i('classes', 'count(*)')} FROM members m CROSS JOIN classes c LEFT JOIN t ON t.member = m.member AND t.cls = c.cls LEFT JOIN p ON p.member = m.member AND p.cls = c.cls CROSS JOIN n GROUP BY m.member",
    "distribution_report": f"WITH {_PREDS} SELECT member, y_pred AS cls, {i('n', 'count(*)')}, {d('share', 'count(*) / CAST(sum(count(*)) OVER (PARTITION BY member) AS DOUBLE)')} FROM best GROUP BY member, y_pred",
    "preds_validate": f"WITH {_PREDS}, s AS (SELECT member, sample_id, sum(p) AS total, min(p) AS low, max(p) AS high, count(*) AS k FROM preds GROUP BY member, sample_id) SELECT member, {i('rows_checked', 'count(*)')}, {i('bad_sum', _count('abs(total - 1) > 1e-6'))}, {i('bad_range', _count('low < 0 OR high > 1'))}, {i('width', 'max(k)')} FROM s GROUP BY member",
    "class_order": f"SELECT label, {i('class_index', 'row_number() OVER (ORDER BY label) - 1')} FROM (SELECT DISTINCT label FROM {{samples}}) x",
    "blend_average": f"WITH {_PREDS} SELECT sample_id, cls, {d('p', 'avg(p)')} FROM preds GROUP BY sample_id, cls",
    "blend_weighted": f"WITH {_PREDS} SELECT sample_id, cls, {d('p', 'sum(p * CASE member WHEN 1 THEN 0.45 WHEN 2 THEN 0.45 ELSE 0.10 END)')} FROM preds GROUP BY sample_id, cls",
    "blend_rank": f"WITH {_PREDS}, rk AS (SELECT sample_id, member, cls, (row_number() OVER (PARTITION BY member, cls ORDER BY round(p, 12), sample_id) - 1) / CAST(greatest(count(*) OVER (PARTITION BY member, cls) - 1, 1) AS DOUBLE) AS r FROM preds) SELECT sample_id, member, cls, {d('p', 'CASE WHEN sum(r) OVER (PARTITION BY sample_id, member) > 0 THEN r / sum(r) OVER (PARTITION BY sample_id, member) ELSE 0 END')} FROM rk",
    "blend_temperature": f"WITH {_PREDS}, t AS (SELECT sample_id, member, cls, power(p, 1e0 / 1.5e0) AS q FROM preds) SELECT sample_id, member, cls, {d('p', 'q / sum(q) OVER (PARTITION BY sample_id, member)')} FROM t",
    "logit_bias_apply": f"WITH {_PREDS}, t AS (SELECT sample_id, member, cls, p * exp(0.1 * ci - 0.3) AS q FROM preds) SELECT sample_id, member, cls, {d('p', 'q / sum(q) OVER (PARTITION BY sample_id, member)')} FROM t",
    "stack_features": f"WITH {_PREDS} SELECT sample_id, cls, {', '.join(d(f'logit_{m}', f'max(CASE WHEN member = {m} THEN ln(p) - ln(1 - p) END)') for m in (1, 2, 3))} FROM preds GROUP BY sample_id, cls",
    "submission_join": f"WITH {_PREDS} SELECT s.sample_id AS id, b.y_pred AS subclass FROM {{samples}} s LEFT JOIN best b ON s.sample_id = b.sample_id AND b.member = 3",
    "seed_report": f"WITH {_PREDS}, acc AS (SELECT member, sample_id % 5 AS fold, avg(CASE WHEN y_true = y_pred THEN 1e0 ELSE 0e0 END) AS a FROM best GROUP BY member, sample_id % 5) SELECT member, {d('mean_accuracy', 'avg(a)')}, {d('sd_accuracy', 'stddev_pop(a)')}, {i('folds', 'count(*)')} FROM acc GROUP BY member",
}
