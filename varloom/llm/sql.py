"""DuckDB SQL that gives the same rows as the queries, where SQL can."""

from __future__ import annotations

_MEMBERS = "SELECT DISTINCT gene_set_id AS s, gene_symbol_id AS g FROM gene_set_gene_symbol WHERE gene_set_id IS NOT NULL AND gene_symbol_id IS NOT NULL"

P1_FOUND = f"""WITH m AS ({_MEMBERS}), z AS (SELECT s, count(*) AS n FROM m GROUP BY s HAVING count(*) >= 5),
k AS (SELECT m.s, m.g, z.n FROM m JOIN z USING (s)),
o AS (SELECT a.s AS s1, b.s AS s2, any_value(a.n) AS n1, any_value(b.n) AS n2, count(*) AS c
      FROM k a JOIN k b ON a.g = b.g AND a.s < b.s AND 10 * least(a.n, b.n) >= 7 * greatest(a.n, b.n) GROUP BY a.s, b.s)
SELECT s1 AS gene_set_id_1, s2 AS gene_set_id_2 FROM o WHERE 10 * c >= 7 * (n1 + n2 - c)"""

_CLASSES = f"""m AS ({_MEMBERS}), z AS (SELECT s, count(*) AS n, list(g ORDER BY g) AS l FROM m GROUP BY s HAVING count(*) >= 5),
c AS (SELECT s, n, min(s) OVER (PARTITION BY l) AS rep FROM z), k AS (SELECT m.s, m.g, c.n FROM m JOIN c USING (s) WHERE c.s = c.rep),
o AS (SELECT a.s AS s1, b.s AS s2, any_value(a.n) AS n1, any_value(b.n) AS n2, count(*) AS c
      FROM k a JOIN k b ON a.g = b.g AND a.s < b.s AND 10 * least(a.n, b.n) >= 7 * greatest(a.n, b.n) GROUP BY a.s, b.s),
p AS (SELECT s1, s2, c, round(c / (n1 + n2 - c), 6) AS similarity FROM o WHERE 10 * c >= 7 * (n1 + n2 - c))"""
P1_CLASS_PAIRS = f"WITH {_CLASSES} SELECT s1 AS class_id_1, s2 AS class_id_2, c AS overlap, similarity FROM p"
P1_CLASSES = f"""WITH {_CLASSES}, e AS (SELECT rep, count(*) AS links FROM (SELECT s1 AS rep FROM p UNION ALL SELECT s2 FROM p) GROUP BY rep)
SELECT s AS gene_set_id, c.rep AS class_id, coalesce(links, 0) AS links FROM c LEFT JOIN e USING (rep)"""

_VALUES = " UNION ALL ".join(
    f"SELECT '{s}' AS scope, {k} AS group_key, '{m}' AS metric, {m} AS v FROM dummy_processed_gwas WHERE {m} IS NOT NULL AND NOT isnan({m})"
    for s, k in (("study_id", "coalesce(study_id, '(none)')"), ("chr", "coalesce(CAST(chr AS VARCHAR), '(none)')"), ("all", "''"))
    for m in ("chisq", "beta")
)
P4_PERCENTILES = f"""WITH t AS ({_VALUES}),
r AS (SELECT *, row_number() OVER (PARTITION BY scope, group_key, metric ORDER BY v) AS rk, count(*) OVER (PARTITION BY scope, group_key, metric) AS total FROM t)
SELECT scope, group_key, metric, q, total, v + 0.0 AS value
FROM r, (SELECT unnest([0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]::DOUBLE[]) AS q) WHERE rk = greatest(1, ceil(round(q * total, 6)))"""

_WORDS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"
P7_FOUND = f"""WITH d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, {_WORDS.format("passage")} AS w FROM eval_items WHERE passage IS NOT NULL),
gd AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM d WHERE len(w) >= 12)),
gi AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM i WHERE len(w) >= 12))
SELECT DISTINCT doc_id, item_id FROM gd JOIN gi USING (g)"""

P4_MERGED_BOUNDS = f"SELECT scope, group_key, metric, q, total, true AS holds FROM ({P4_PERCENTILES})"
P7_CLEAN_DOCUMENTS = f"SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM ({P7_FOUND}))"

# A change is written without the bases both alleles share at their ends, one end before the other, on either strand.
_SAME = "list_max(list_filter(range(0, least(len({a}), len({b})) + 1), lambda k: {end}({a}, k) = {end}({b}, k)))"


def _trimmed(x: str, y: str, first: str, second: str) -> str:
    """SELECT list items that trim columns x, y at both ends."""
    k = _SAME.format(a=x, b=y, end=first)
    keep = {"right": "left({0}, len({0}) - k)", "left": "substr({0}, k + 1)"}
    inner = f"(SELECT {keep[first].format('x')} AS x, {keep[first].format('y')} AS y FROM (SELECT {x} AS x, {y} AS y, {k} AS k))"
    return f"(SELECT {keep[second].format('x')} || '>' || {keep[second].format('y')} FROM (SELECT x, y, {_SAME.format(a='x', b='y', end=second)} AS k FROM {inner}))"


def _ways(x: str, y: str) -> str:
    return f"[{_trimmed(x, y, 'right', 'left')}, {_trimmed(x, y, 'left', 'right')}]"


_RC = "reverse(translate({}, 'ACGT', 'TGCA'))"
_CODE = r"regexp_replace(regexp_replace(regexp_replace(lower(trim(chrom)), '^chr(omosome)?[_ ]*', ''), '\.0*$', ''), '^0+(.)', '\1')"
_BASE = "CASE WHEN trim({0}) IN ('-', '') THEN '' ELSE upper(trim({0})) END"
P2_FOUND = f"""WITH g AS (SELECT snpid, chr, pos, {_BASE.format("ea")} AS ea, {_BASE.format("nea")} AS nea, CASE WHEN NOT isnan(eaf) THEN eaf END AS eaf FROM dummy_processed_gwas WHERE snpid IS NOT NULL),
o AS (SELECT snpid, chr, pos, CASE WHEN ea IS NOT NULL AND nea IS NOT NULL THEN least(ea, nea) END AS lo, CASE WHEN ea IS NOT NULL AND nea IS NOT NULL THEN greatest(ea, nea) END AS hi,
  CASE WHEN ea >= nea THEN eaf WHEN ea < nea THEN 1 - eaf END AS f FROM g),
w AS (SELECT snpid, chr, pos, lo, hi, count(*) AS m FROM o GROUP BY ALL),
b AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY snpid ORDER BY (lo IS NOT NULL) DESC, m DESC, chr DESC, pos DESC, lo DESC, hi DESC) = 1),
v AS (SELECT b.snpid, chr, pos, lo, hi, freq FROM b JOIN (SELECT snpid, avg(f) AS freq FROM o GROUP BY snpid) USING (snpid) WHERE chr IS NOT NULL AND pos IS NOT NULL),
r AS (SELECT regenie_row, genpos, CASE c WHEN 'x' THEN 23 WHEN 'y' THEN 24 WHEN 'm' THEN 25 WHEN 'mt' THEN 25 ELSE TRY_CAST(c AS INTEGER) END AS c, c IN ('', 'na', 'nan', '.', 'none', 'null') AS lost, a0, a1, fr
  FROM (SELECT DISTINCT ON (regenie_row) regenie_row, genpos, coalesce({_CODE}, '') AS c, {_BASE.format("allele0")} AS a0, {_BASE.format("allele1")} AS a1, CASE WHEN NOT isnan(a1freq) THEN a1freq END AS fr FROM regenie_variants)),
p AS (SELECT regenie_row, snpid, genpos - pos AS shift, fr, freq, lo, hi, a0, a1 FROM r JOIN v ON (r.c = v.chr OR r.lost) AND genpos BETWEEN pos - 12 AND pos + 12),
f AS (SELECT *, list_concat({_ways("lo", "hi")}, {_ways(_RC.format("lo"), _RC.format("hi"))}) AS ways, {_ways("a0", "a1")} AS fwd, {_ways("a1", "a0")} AS bwd FROM p),
h AS (SELECT *, list_transform(ways, lambda x: string_split(x, '>')[1]) || [lo, {_RC.format("lo")}] AS lows, list_transform(ways, lambda x: string_split(x, '>')[2]) || [hi, {_RC.format("hi")}] AS highs FROM f),
d AS (SELECT *, CASE WHEN lo IS NULL OR (a0 IS NULL AND a1 IS NULL) THEN true WHEN a0 IS NULL THEN list_contains(highs, a1) WHEN a1 IS NULL THEN list_contains(lows, a0) ELSE a0 <> a1 AND list_has_any(fwd, ways) END AS same,
  CASE WHEN lo IS NULL OR (a0 IS NULL AND a1 IS NULL) THEN true WHEN a0 IS NULL THEN list_contains(lows, a1) WHEN a1 IS NULL THEN list_contains(highs, a0) ELSE a0 <> a1 AND list_has_any(bwd, ways) END AS turned FROM h),
e AS (SELECT *, least(CASE WHEN same THEN abs(fr - freq) END, CASE WHEN turned THEN abs(fr - (1 - freq)) END) AS gap FROM d WHERE same OR turned)
SELECT snpid, regenie_row FROM e WHERE gap IS NULL OR gap < 0.1 QUALIFY row_number() OVER (PARTITION BY regenie_row ORDER BY gap NULLS LAST, abs(shift), snpid) = 1"""


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1_FOUND, "p1_class_pairs": P1_CLASS_PAIRS, "p1_classes": P1_CLASSES, "p2_found": P2_FOUND, "p4_percentiles": P4_PERCENTILES, "p4_merged_bounds": P4_MERGED_BOUNDS, "p7_found": P7_FOUND, "p7_clean_documents": P7_CLEAN_DOCUMENTS}
