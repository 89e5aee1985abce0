"""Further portable plans: token ids, word counts, fixed selections of columns,
class-weighted losses, selections and decisions across folds.

As in ``portable``; ``{words}`` and ``{sigbuckets}`` stand for two more
relations, the words of generalised tokens and the hash buckets of signatures.
"""

from __future__ import annotations

from helixframe.functions.dims import DRIVERS, STAR_DRIVERS
from helixframe.plans.portable import _BURDEN, _BURDEN_TABLE, _FREQ_KEYS, _GENERAL, _GENERALISED, _MUT, _PREDS, BURDEN_BINS, CELLS, PLANS, TRAIN, d, i, per_sample, quoted, suffix

POSITION_BIN, POSITION_BINS, SIGNATURE_BUCKETS = 25, 512, 4096
SMOOTHING, GAMMA = 0.05, 2
#: Residues in the order of their ids, which begin at 1.
RESIDUES = "*-ACDEFGHIKLMNPQRSTVWXY"
#: Kinds in the order of their ids, which begin at 1.
KIND_IDS = ("missense", "nonsense", "synonymous", "frameshift", "deletion", "insertion", "delins", "complex", "other")


def _residue(x: str) -> str:
    return f"CASE WHEN {x} = '' THEN 0 ELSE position({x} IN '{RESIDUES}') END"


_ENDPOINTS = f"""parts AS (
  SELECT *, regexp_extract(t, '^([A-Z*])[0-9]+[A-Z*]$', 1) AS s1, regexp_extract(t, '^[A-Z*][0-9]+([A-Z*])$', 1) AS s2,
         left(regexp_extract(t, '^[0-9]+_[0-9]+([A-Z*]+)>[A-Z*]+$', 1), 1) AS r1, left(regexp_extract(t, '^[0-9]+_[0-9]+[A-Z*]+>([A-Z*]+)$', 1), 1) AS r2,
         regexp_extract(t, '^([^0-9]*)[0-9]+', 1) AS prefix, left(regexp_extract(t, '(?:DELINS|INS|DUP)([A-Z*]+)$', 1), 1) AS added, left(regexp_extract(t, '^[A-Z*]+[0-9]+([A-Z*]+)FS$', 1), 1) AS shifted
  FROM (SELECT *, upper(token) AS t FROM {{variants}}) x
),
ends AS (
  SELECT *, CASE WHEN s1 <> '' THEN s1 WHEN r1 <> '' THEN r1 WHEN length(prefix) = 1 AND position(prefix IN '{RESIDUES}') > 0 THEN prefix ELSE '' END AS ref_end,
         CASE WHEN s1 <> '' THEN s2 WHEN r1 <> '' THEN r2 WHEN added <> '' THEN added ELSE shifted END AS alt_end FROM parts
),
genes AS (SELECT gene, row_number() OVER (ORDER BY gene) AS gene_id FROM (SELECT DISTINCT gene FROM {{variants}}) x)"""
_KIND_CASE = "CASE kind " + " ".join(f"WHEN '{k}' THEN {n}" for n, k in enumerate(KIND_IDS, 1)) + " ELSE 0 END"
TOKEN_IDS = f"""WITH {_ENDPOINTS} SELECT e.sample_id, e.gene, {i("seq")}, {i("gene_id")}, {i("kind_id", _KIND_CASE)}, {i("ref_id", _residue("ref_end"))}, {i("alt_id", _residue("alt_end"))},
  {i("position_id", f"CASE WHEN position < 0 THEN 0 ELSE least(floor(position / {POSITION_BIN}) + 1, {POSITION_BINS}) END")}, {i("signature_id", "b.bucket + 1")}, {i("position", "greatest(position, 0)")},
  {i("has_unknown", "CASE WHEN kind = 'other' OR ref_end = '' THEN 1 ELSE 0 END")}
FROM ends e JOIN genes g ON e.gene = g.gene JOIN {{sigbuckets}} b ON e.signature = b.signature"""

#: Counts of the words of a sample's generalised tokens; a sample without
#: tokens has one sentinel word.
PARSED_WORDS = f"""WITH doc AS (
  SELECT sample_id, word FROM {{words}} UNION ALL SELECT s.sample_id, 'SAMPLE__NO_PARSED_TOKEN' FROM {{samples}} s LEFT JOIN (SELECT DISTINCT sample_id FROM {{variants}}) v ON s.sample_id = v.sample_id WHERE v.sample_id IS NULL
), c AS (SELECT sample_id, word, count(*) AS n FROM doc GROUP BY sample_id, word), vocabulary AS (SELECT word FROM c WHERE {TRAIN} GROUP BY word HAVING count(*) >= 2)
SELECT c.sample_id, c.word, {i("n")}, {d("l1", "n / CAST(sum(n) OVER (PARTITION BY sample_id) AS DOUBLE)")}, {d("l2", "n / sqrt(CAST(sum(n * n) OVER (PARTITION BY sample_id) AS DOUBLE))")} FROM c JOIN vocabulary v ON c.word = v.word"""

_RATIOS = ("log1p_mutated_gene_count", "log1p_mutation_event_count", "functional_ratio", "synonymous_ratio", "missense_ratio", "nonsense_ratio", "frameshift_ratio", "multihit_gene_ratio")
_TYPES = ("missense", "synonymous", "nonsense", "frameshift", "indel", "complex")


def gene_mutated_pivot(genes: tuple[str, ...] = DRIVERS) -> str:
    columns = ", ".join(i(f"gene_mutated_{suffix(g)}", f"max(CASE WHEN gene = {quoted(g)} THEN 1 ELSE 0 END)") for g in genes)
    return f"WITH {CELLS} SELECT s.sample_id, {columns} FROM {{samples}} s LEFT JOIN cells c ON s.sample_id = c.sample_id GROUP BY s.sample_id"


def gene_type_pivot(genes: tuple[str, ...] = DRIVERS) -> str:
    columns = ", ".join(i(f"gene_{t}_{suffix(g)}", f"max(CASE WHEN gene = {quoted(g)} AND coarse_kind = {t!r} THEN 1 ELSE 0 END)") for g in genes for t in _TYPES)
    return f"SELECT s.sample_id, {columns} FROM {{samples}} s LEFT JOIN {{variants}} v ON s.sample_id = v.sample_id GROUP BY s.sample_id"


_FREQ_N = f"WITH {_FREQ_KEYS} SELECT key AS"
_CE = "-ln(greatest(p_true, 1e-12))"
_SMOOTH = f"((1 - {SMOOTHING}) * {_CE} + {SMOOTHING} * all_ce / k)"
_LOSSES = f"""{_PREDS}, nc AS (SELECT y_true, count(*) AS c FROM preds WHERE member = 1 AND ci = 1 GROUP BY y_true), tot AS (SELECT CAST(sum(c) AS DOUBLE) AS n, CAST(count(*) AS DOUBLE) AS k FROM nc),
rowp AS (SELECT member, sample_id, y_true, max(CASE WHEN cls = y_true THEN p END) AS p_true, sum(-ln(greatest(p, 1e-12))) AS all_ce FROM preds GROUP BY member, sample_id, y_true),
weighed AS (SELECT r.*, t.k, t.n / (t.k * nc.c) AS w FROM rowp r JOIN nc ON r.y_true = nc.y_true CROSS JOIN tot t)"""

_FOLDS = "folds AS (SELECT 0 AS fold UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4)"
#: Chi-square top ten genes of every outer fold's train rows.
_SELECTED = f"""{_MUT}, {_FOLDS}, share AS (SELECT fold, label, count(*) / CAST(sum(count(*)) OVER (PARTITION BY fold) AS DOUBLE) AS share FROM {{samples}} CROSS JOIN folds WHERE sample_id % 5 <> fold GROUP BY fold, label),
obs AS (SELECT fold, gene, label, count(*) AS o FROM g JOIN {{samples}} s ON g.sample_id = s.sample_id CROSS JOIN folds WHERE g.sample_id % 5 <> fold GROUP BY fold, gene, label),
total AS (SELECT fold, gene, sum(o) AS total FROM obs GROUP BY fold, gene),
score AS (SELECT t.fold, t.gene, sum((coalesce(o, 0) - share * total) * (coalesce(o, 0) - share * total) / (share * total)) AS score FROM total t JOIN share c ON t.fold = c.fold LEFT JOIN obs ON obs.fold = t.fold AND obs.gene = t.gene AND obs.label = c.label GROUP BY t.fold, t.gene),
picked AS (SELECT fold, gene FROM (SELECT fold, gene, row_number() OVER (PARTITION BY fold ORDER BY round(score, 9) DESC, gene) AS rk FROM score) x WHERE rk <= 10)"""

#: Macro F1 of each member by fold and over all rows.
_FOLD_F1 = f"""{_PREDS}, {_FOLDS}, hits AS (
  SELECT b.member, f.fold, c.cls, sum(CASE WHEN y_true = c.cls AND y_pred = c.cls THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN y_true = c.cls THEN 1 ELSE 0 END) + sum(CASE WHEN y_pred = c.cls THEN 1 ELSE 0 END) AS seen
  FROM best b JOIN (SELECT fold FROM folds UNION ALL SELECT -1) f ON f.fold = -1 OR b.sample_id % 5 = f.fold CROSS JOIN classes c GROUP BY b.member, f.fold, c.cls
), fold_f1 AS (SELECT member, fold, avg(CASE WHEN seen > 0 THEN 2e0 * tp / seen END) AS f1 FROM hits GROUP BY member, fold)"""

#: Macro F1 of (1 - w) times the mean of members 1 and 2 plus w times member 3,
#: the external one, for every weight of the scan.
WEIGHT_SCAN = f"""WITH {_PREDS}, scan AS ({" UNION ALL ".join(f"SELECT CAST({k} AS BIGINT) AS step" for k in range(11))}),
sides AS (SELECT sample_id, y_true, cls, ci, avg(CASE WHEN member < 3 THEN p END) AS ours, max(CASE WHEN member = 3 THEN p END) AS theirs FROM preds GROUP BY sample_id, y_true, cls, ci),
mixed AS (SELECT sample_id, y_true, cls, step, row_number() OVER (PARTITION BY sample_id, step ORDER BY round((1 - step * 0.05) * ours + step * 0.05 * theirs, 12) DESC, ci) AS rk FROM sides CROSS JOIN scan),
top AS (SELECT step, y_true, cls AS y_pred FROM mixed WHERE rk = 1),
hits AS (SELECT t.step, c.cls, sum(CASE WHEN y_true = c.cls AND y_pred = c.cls THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN y_true = c.cls THEN 1 ELSE 0 END) + sum(CASE WHEN y_pred = c.cls THEN 1 ELSE 0 END) AS seen FROM top t CROSS JOIN classes c GROUP BY t.step, c.cls)
SELECT {d("weight", "step * 0.05")}, {d("macro_f1", "avg(CASE WHEN seen > 0 THEN 2e0 * tp / seen END)")} FROM hits GROUP BY step"""

#: An external member against the scores it reports, by each way of dealing folds
#: that it may have used: the way whose every fold agrees is the member's.
EXTERNAL_CHECK = f"""WITH {_PREDS}, ways AS (SELECT sample_id, member, y_true, y_pred, 'modulo' AS way, sample_id % 5 AS fold FROM best UNION ALL SELECT sample_id, member, y_true, y_pred, 'blocks', CAST(floor(sample_id / 5) AS BIGINT) % 5 FROM best),
hits AS (SELECT w.way, w.member, w.fold, c.cls, sum(CASE WHEN y_true = c.cls AND y_pred = c.cls THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN y_true = c.cls THEN 1 ELSE 0 END) + sum(CASE WHEN y_pred = c.cls THEN 1 ELSE 0 END) AS seen FROM ways w CROSS JOIN classes c GROUP BY w.way, w.member, w.fold, c.cls),
scores AS (SELECT way, member, fold, avg(CASE WHEN seen > 0 THEN 2e0 * tp / seen END) AS f1 FROM hits GROUP BY way, member, fold),
reported AS (SELECT member, fold, f1 FROM scores WHERE way = 'modulo'),
faults AS (SELECT member, sum(CASE WHEN p IS NULL OR p < 0 OR p > 1 THEN 1 ELSE 0 END) AS bad_values FROM preds GROUP BY member)
SELECT s.member, s.way, {i("folds", "count(*)")}, {i("folds_that_agree", "sum(CASE WHEN abs(s.f1 - r.f1) <= 1e-6 THEN 1 ELSE 0 END)")}, {d("largest_difference", "max(abs(s.f1 - r.f1))")}, {i("bad_values", "max(f.bad_values)")}
FROM scores s JOIN reported r ON s.member = r.member AND s.fold = r.fold JOIN faults f ON f.member = s.member GROUP BY s.member, s.way"""

#: Place of a generalised part among those of its token.
PART_PLACE = "CASE part " + " ".join(f"WHEN '{k}' THEN {n}" for n, k in enumerate(_GENERAL)) + " END"

#: Pairs of words that follow each other in a sample's document, in the order of
#: genes, tokens and parts; kept where at least two train samples have them.
WORD_PAIRS = f"""WITH w AS (SELECT sample_id, word, lead(word) OVER (PARTITION BY sample_id ORDER BY gene, seq, place, spot) AS follows FROM {{words}}),
c AS (SELECT sample_id, word, follows, count(*) AS n FROM w WHERE follows IS NOT NULL GROUP BY sample_id, word, follows),
df AS (SELECT word, follows FROM c WHERE {TRAIN} GROUP BY word, follows HAVING count(*) >= 2)
SELECT concat(c.word, ' ', c.follows) AS term, {i("documents", "count(DISTINCT sample_id)")}, {i("tokens", "sum(n)")} FROM c JOIN df ON c.word = df.word AND c.follows = df.follows GROUP BY concat(c.word, ' ', c.follows)"""

REPORTS: dict[str, str] = {
    "external_weight_scan": WEIGHT_SCAN,
    "external_check": EXTERNAL_CHECK,
    "word_pairs": WORD_PAIRS,
    "token_ids": TOKEN_IDS,
    "doc_parsed": PARSED_WORDS,
    "ratio10": f"SELECT a.*, b.hypermutated_flag, b.burden_quantile_bin FROM ({per_sample({k: _BURDEN[k] for k in _RATIOS})}) a JOIN ({BURDEN_BINS}) b ON a.sample_id = b.sample_id",
    "scaled_dense": f"WITH {_BURDEN_TABLE}, st AS (SELECT avg(burden) AS mb, stddev_pop(burden) AS sb, avg(events) AS me, stddev_pop(events) AS se FROM m WHERE {TRAIN}) SELECT sample_id, {d('burden_z', 'CASE WHEN sb > 0 THEN (burden - mb) / sb ELSE burden - mb END')}, {d('events_z', 'CASE WHEN se > 0 THEN (events - me) / se ELSE events - me END')} FROM m CROSS JOIN st",
    "gene_row_share": f"WITH {CELLS} SELECT sample_id, gene, {d('share', 'n / CAST(sum(n) OVER (PARTITION BY sample_id) AS DOUBLE)')} FROM cells",
    "gene_mutated_pivot": gene_mutated_pivot(STAR_DRIVERS),
    "gene_type_pivot": gene_type_pivot(STAR_DRIVERS),
    "freq_gene_stats": f"{_FREQ_N} gene, {i('document_count', 'df')}, {d('frequency', 'df / n')}, {d('rarity', '-ln((df + 1) / (n + 1))')} FROM df CROSS JOIN n WHERE family = 'gene'",
    "freq_token_stats": f"{_FREQ_N} token_key, {i('document_count', 'df')}, {d('frequency', 'df / n')}, {d('idf', 'ln((n + 1) / (df + 1)) + 1')} FROM df CROSS JOIN n WHERE family = 'gene_aa_change'",
    "segment_pools": f"SELECT sample_id, {d('mean_pool', 'avg(x)')}, {d('max_pool', 'max(x)')}, {d('sum_sqrt_pool', 'sum(x) / sqrt(count(*))')} FROM (SELECT sample_id, gene, ln(1 + count(*)) AS x FROM {{variants}} GROUP BY sample_id, gene) y GROUP BY sample_id",
    "loss_values": f"WITH {_LOSSES} SELECT member, {d('cross_entropy', f'avg({_CE})')}, {d('weighted_cross_entropy', f'sum(w * {_CE}) / sum(w)')}, {d('smoothed', f'avg({_SMOOTH})')}, {d('focal', f'sum(w * power(1 - p_true, {GAMMA}) * {_SMOOTH}) / sum(w)')} FROM weighed GROUP BY member",
    "class_weights_sqrt": f"WITH c AS (SELECT label, count(*) AS c FROM {{samples}} GROUP BY label) SELECT label, {d('balanced', 'sum(c) OVER () / (count(*) OVER () * CAST(c AS DOUBLE))')}, {d('sqrt_balanced', 'sqrt(sum(c) OVER () / (count(*) OVER () * CAST(c AS DOUBLE)))')} FROM c",
    "selection_jaccard": f"WITH {_SELECTED}, pairs AS (SELECT a.fold AS fold_a, b.fold AS fold_b FROM folds a CROSS JOIN folds b WHERE a.fold < b.fold), both_in AS (SELECT a.fold AS fa, b.fold AS fb, count(*) AS n FROM picked a JOIN picked b ON a.gene = b.gene GROUP BY a.fold, b.fold), size AS (SELECT fold, count(*) AS n FROM picked GROUP BY fold) SELECT {i('fold_a')}, {i('fold_b')}, {d('jaccard', 'coalesce(x.n, 0) / CAST(sa.n + sb.n - coalesce(x.n, 0) AS DOUBLE)')} FROM pairs p JOIN size sa ON sa.fold = p.fold_a JOIN size sb ON sb.fold = p.fold_b LEFT JOIN both_in x ON x.fa = p.fold_a AND x.fb = p.fold_b",
    "fold_macro_f1": f"WITH {_FOLD_F1} SELECT member, {i('fold')}, {d('macro_f1', 'f1')} FROM fold_f1",
    "model_verdict": f"""WITH {_FOLD_F1}, pair AS (SELECT c.member, sum(CASE WHEN c.fold = -1 THEN c.f1 - b.f1 ELSE 0 END) AS delta, sum(CASE WHEN c.fold >= 0 AND c.f1 > b.f1 THEN 1 ELSE 0 END) AS improved, sum(CASE WHEN c.fold >= 0 AND c.f1 < b.f1 THEN 1 ELSE 0 END) AS worsened
      FROM fold_f1 c JOIN fold_f1 b ON c.fold = b.fold AND b.member = 1 WHERE c.member > 1 GROUP BY c.member)
      SELECT member, {d('delta')}, {i('improved')}, {i('worsened')}, CASE WHEN delta >= 0.005 AND improved >= 3 THEN 'ADOPT_CANDIDATE' WHEN delta <= 0 OR improved <= 2 THEN 'REJECT' ELSE 'WEAK_POSITIVE' END AS verdict FROM pair""",
    "baseline_match": f"WITH {_PREDS} SELECT {i('rows_compared', 'count(*)')}, {i('unmatched', 'sum(CASE WHEN a.p IS NULL OR b.p IS NULL THEN 1 ELSE 0 END)')}, {d('max_abs_diff', 'max(abs(a.p - b.p))')}, {i('differing', 'sum(CASE WHEN abs(a.p - b.p) > 1e-6 THEN 1 ELSE 0 END)')} FROM (SELECT * FROM preds WHERE member = 1) a FULL OUTER JOIN (SELECT * FROM preds WHERE member = 2) b ON a.sample_id = b.sample_id AND a.cls = b.cls",
    "exchange_format": f"WITH {_PREDS} SELECT sample_id, {', '.join(d(f'prob_class_{n}', f'max(CASE WHEN ci = {n + 1} THEN p END)') for n in range(5))}, {i('true_label', 'max(CASE WHEN cls = y_true THEN ci - 1 END)')}, {i('fold', 'sample_id % 5')} FROM preds WHERE member = 1 GROUP BY sample_id",
    "per_class_blend": f"WITH {_PREDS} SELECT sample_id, cls, {d('p', 'sum(p * CASE WHEN member = 1 + (ci - 1) % 3 THEN 0.6 ELSE 0.2 END)')} FROM preds GROUP BY sample_id, cls",
}

#: Every plan by name.
ALL_PLANS: dict[str, str] = PLANS | REPORTS
#: Text of the generalised tokens that ``{words}`` is made from.
GENERALISED = _GENERALISED
