"""The base relations as SQL for the comparison engine."""

from __future__ import annotations

from helixframe.functions.dims import CODON_SQL, STAR_PAIRS, STAR_PANEL, penalty_rows
from helixframe.plans.portable import PAIRS_A_GENE, TOP_PAIRS, comut_candidates
from helixframe.plans.reports import GENERALISED, PART_PLACE, SIGNATURE_BUCKETS

RAW = r"""
  SELECT l_suppkey * 1000 + l_orderkey % 40 AS sample_id, r_name AS label, p_brand AS gene,
       CASE (l_orderkey + l_linenumber) % 10
            WHEN 0 THEN concat(r, pos, 'fs') WHEN 1 THEN concat(r, pos, a) WHEN 2 THEN concat(r, pos, r) WHEN 3 THEN concat(r, pos, '*')
            WHEN 4 THEN concat(r, pos, 'del') WHEN 5 THEN concat(pos, '_', pos + 1, r, a, '>', a, r)
            WHEN 6 THEN concat(r, pos, '_', a, pos + 1, 'delins', a) WHEN 7 THEN concat(r, pos, '_', a, pos + 1, 'ins', a) WHEN 8 THEN concat(r, pos, 'X')
            ELSE CASE WHEN l_partkey % 11 = 0 THEN 'SPLICE' ELSE concat(r, pos, a) END END AS token,
       l_orderkey AS k1, l_linenumber AS k2, l_extendedprice AS k3
  FROM (SELECT l.*, p_brand, r_name, substr('ACDEFGHIKLMNPQRSTVWY', CAST(l_partkey % 20 AS INT) + 1, 1) AS r,
               substr('ACDEFGHIKLMNPQRSTVWY', CAST(l_quantity AS INT) % 20 + 1, 1) AS a, l_partkey % 60 + 1 AS pos
        FROM lineitem l JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
             JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) x
"""

VARIANTS = rf"""
raw_v AS ({RAW}),
v0 AS (
  SELECT sample_id, label, gene, token, row_number() OVER (PARTITION BY sample_id, gene ORDER BY k1, k2, k3, token) AS seq,
         left(token, 1) = right(token, 1) AS same,
         CASE WHEN regexp_matches(token, 'fs') THEN 'frameshift' WHEN regexp_matches(token, 'delins') THEN 'delins' WHEN regexp_matches(token, 'del') THEN 'deletion'
              WHEN regexp_matches(token, 'ins|dup') THEN 'insertion' WHEN regexp_matches(token, '^[A-Z]\d+[*X]$') THEN 'nonsense'
              WHEN regexp_matches(token, '^[A-Z*]\d+[A-Z*]$') THEN CASE WHEN left(token, 1) = right(token, 1) THEN 'synonymous' ELSE 'missense' END
              WHEN regexp_matches(token, '[_>]') THEN 'complex' ELSE 'other' END AS kind,
         CASE WHEN regexp_matches(token, '^[A-Z]\d+[*X]$') THEN 'nonsense' WHEN regexp_matches(token, '^[A-Z]\d+[A-Z]$') THEN CASE WHEN left(token, 1) = right(token, 1) THEN 'silent' ELSE 'missense' END
              WHEN regexp_matches(token, '^[A-Z]+\d+[A-Z]*fs$') THEN 'frameshift' WHEN regexp_matches(token, '^[A-Z]\d+(_[A-Z]\d+)?(del|ins|delins|dup)[A-Z]*$') THEN 'inframe_indel'
              WHEN regexp_matches(token, '^\d+_\d+[A-Z]+>[A-Z*]+$') THEN 'range_sub' ELSE 'unparsed' END AS dkind
  FROM raw_v
),
variants AS (
  SELECT sample_id, label, gene, seq, token, kind, dkind,
         CASE WHEN kind IN ('deletion', 'insertion', 'delins') THEN 'indel' WHEN kind = 'other' THEN 'complex' ELSE kind END AS coarse_kind,
         kind || '|' || CASE WHEN kind = 'missense' THEN left(token, 1) || '>' || right(token, 1) WHEN kind IN ('synonymous', 'nonsense') THEN left(token, 1)
              WHEN kind = 'frameshift' AND regexp_matches(token, '^.*?\d+[A-Z*]*fs') THEN regexp_extract(token, '^(.*?)\d+[A-Z*]*fs', 1)
              WHEN kind = 'complex' AND regexp_matches(token, '^\d+_\d+[A-Z*]+>[A-Z*]+$') THEN regexp_replace(token, '^\d+_\d+', '')
              ELSE regexp_replace(token, '\d+', '', 'g') END AS signature,
         regexp_extract(token, '^([A-Z])', 1) AS ref_aa, regexp_extract(token, '([A-Z*X])$', 1) AS alt_aa,
         coalesce(TRY_CAST(regexp_extract(token, '(\d+)', 1) AS INT), -1) AS position,
         CASE WHEN upper(trim(token)) IN ('', 'WT', '0', 'NA', 'NAN', 'NONE', '.') THEN 0 WHEN regexp_matches(token, '^[A-Z*]\d+[A-Z*]$') AND same THEN 1 ELSE 2 END AS enc3,
         CASE WHEN dkind IN ('nonsense', 'silent', 'missense', 'inframe_indel') THEN left(token, 1) WHEN dkind = 'frameshift' THEN regexp_extract(token, '^([A-Z]+)', 1)
              WHEN dkind = 'range_sub' THEN regexp_extract(token, '^\d+_\d+([A-Z]+)>', 1) ELSE '' END AS dref,
         CASE WHEN dkind = 'nonsense' THEN '*' WHEN dkind IN ('silent', 'missense') THEN right(token, 1) WHEN dkind = 'frameshift' THEN regexp_extract(token, '\d+([A-Z]*)fs$', 1)
              WHEN dkind = 'inframe_indel' THEN regexp_extract(token, '(?:del|ins|delins|dup)([A-Z]*)$', 1) WHEN dkind = 'range_sub' THEN regexp_extract(token, '>([A-Z*]+)$', 1) ELSE '' END AS dalt,
         CASE WHEN regexp_matches(token, '\d') THEN 'POS__' || array_to_string(regexp_extract_all(token, '\d+'), '_') END AS pos_key,
         len(regexp_extract_all(token, '\d+')) AS n_runs, CAST(regexp_matches(token, '[*X]') AS INT) AS has_stop, CAST(regexp_matches(lower(token), 'fs') AS INT) AS has_fs,
         CAST(regexp_matches(lower(token), 'del|ins') AS INT) AS has_del_ins, CAST(regexp_matches(lower(token), 'del$') AS INT) AS ends_del
  FROM v0
),
samples AS (
  SELECT DISTINCT sample_id, label FROM variants
  UNION SELECT s_suppkey * 1000 + 999, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
),
cellkeys AS (SELECT sample_id, gene, string_agg(token, '|' ORDER BY token) AS exact_key FROM variants GROUP BY sample_id, gene)"""

PENALTIES = "penalties AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', CAST({p!r} AS DOUBLE))" for a, b, p in penalty_rows()) + ") AS t(ref, alt, penalty))"
PANEL = "panel AS (SELECT * FROM (VALUES " + ", ".join(f"('{g}', '{role}')" for g, role in STAR_PANEL) + ") AS t(gene, role))"

WORDS = (
    r"words AS (SELECT sample_id, gene, seq, place, unnest(range(len(m))) AS spot, unnest(m) AS word FROM (SELECT *, " + PART_PLACE + r" AS place, regexp_extract_all(piece, '\w\w+') AS m FROM ("
    + GENERALISED.replace("{variants}", "variants") + ") w) z)"
)
BUCKETS = f"sigbuckets AS (SELECT DISTINCT signature, CAST('0x' || left(md5(signature), 8) AS BIGINT) % {SIGNATURE_BUCKETS} AS bucket FROM variants)"


def comut_pairs(candidates: str) -> str:
    """The greedy choice as a recursion, one candidate a step; ``used`` lists the
    genes of the picks between bars."""
    often = lambda g: f"(length(used) - length(replace(used, '|' || {g} || '|', ''))) / length('|' || {g} || '|') >= {PAIRS_A_GENE}"
    manual = ", ".join(f"('{a}', '{b}')" for a, b in STAR_PAIRS)
    return f"""manualpairs AS (SELECT * FROM (VALUES {manual}) AS t(gene_a, gene_b)),
paircand AS MATERIALIZED (SELECT gene_a, gene_b, row_number() OVER (ORDER BY place) AS place FROM ({candidates.format(variants='variants', samples='samples')}) c ANTI JOIN manualpairs USING (gene_a, gene_b)),
greedy AS (
  SELECT CAST(0 AS BIGINT) AS place, '' AS used, CAST(0 AS BIGINT) AS picks, '' AS gene_a, '' AS gene_b, false AS ok
  UNION ALL
  SELECT place, CASE WHEN ok THEN used || '|' || gene_a || '||' || gene_b || '|' ELSE used END, picks + CAST(ok AS BIGINT), gene_a, gene_b, ok
  FROM (SELECT c.place, g.used, g.picks, c.gene_a, c.gene_b, NOT ({often('c.gene_a')} OR {often('c.gene_b')}) AS ok FROM greedy g JOIN paircand c ON c.place = g.place + 1 WHERE g.picks < {TOP_PAIRS}) s
),
comutpairs AS (SELECT gene_a, gene_b FROM greedy WHERE ok UNION ALL SELECT gene_a, gene_b FROM manualpairs)"""


def oracle(text: str, candidates: str | None = None) -> str:
    """Portable text with its base relations for the comparison engine."""
    bases = [VARIANTS]
    if "{comutpairs}" in text:
        bases.append(comut_pairs(candidates or comut_candidates(pool=False)))
    if "{penalties}" in text:
        bases.append(PENALTIES)
    if "{panel}" in text:
        bases.append(PANEL)
    if "{words}" in text:
        bases.append(WORDS)
    if "{sigbuckets}" in text:
        bases.append(BUCKETS)
    if "{codons}" in text:
        text = text.replace("{codons}", CODON_SQL.strip())
    text = text.strip()
    for name in ("variants", "samples", "cellkeys", "penalties", "words", "sigbuckets", "comutpairs", "panel"):
        text = text.replace("{" + name + "}", name)
    body = text[4:].strip() if text[:4].upper() == "WITH" else None
    return ("WITH RECURSIVE " if "comutpairs" in text else "WITH ") + ",".join(bases) + ((",\n" + body) if body else "\n" + text)
