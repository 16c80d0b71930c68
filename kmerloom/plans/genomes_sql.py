"""DuckDB SQL of the genome queries."""

from __future__ import annotations

import numpy as np

from kmerloom.functions.kernel import MIX
from kmerloom.functions.scalars import COEFFICIENTS, COEFFICIENTS_95, DENOMINATORS, DENOMINATORS_95, EPSILON, NAIVE_INTERCEPT, NAIVE_SLOPE
from kmerloom.operators.legacy import permutation

_RECORDS = r"recs AS (SELECT rec_id, max(genome_id) AS g, max(regexp_replace(seq, '\s', '', 'g')) AS s FROM command_sketch WHERE rec_id IS NOT NULL GROUP BY rec_id)"
RECORDS = _RECORDS
_ALL = f"{(1 << 64) - 1}::UHUGEINT"

def _kmers(k: int, context: str, fold: int, genome: str = "g", longer: int = 0) -> str:
    """CTEs down to ``kept``: genome, forward and reverse k-mer numbers and whether the forward one counts."""
    def number(word: str) -> str:
        return f"replace(replace(replace(replace({word}, 'A', '00'), 'C', '01'), 'G', '10'), 'T', '11')::BIT::UBIGINT"

    forward, reverse = number("w"), number("reverse(translate(w, 'ACGT', 'TGCA'))")
    return f"""{_RECORDS},
cut AS (SELECT {genome} AS genome_id, upper(s) AS s, unnest(range(0, length(s), 200)) AS o FROM recs WHERE length(s) >= {k + longer} AND {genome} IS NOT NULL),
chunks AS (SELECT genome_id, substr(s, o + 1, {200 + k - 1}) AS t FROM cut),
win AS (SELECT genome_id, t, unnest(range(1, least(length(t) - {k} + 2, 201))) AS p FROM chunks WHERE length(t) >= {k}),
words AS (SELECT genome_id, substr(t, p, {k}) AS w FROM win WHERE regexp_full_match(substr(t, p, {k}), '[ACGT]+')),
nums AS (SELECT genome_id, {forward} AS f, {reverse} AS r FROM words),
ctxs AS (SELECT genome_id, f, r, f & {context} AS fc, r & {context} AS rc FROM nums),
m1 AS (SELECT *, (least(fc, rc)::UHUGEINT + {MIX[0]}::UHUGEINT) & {_ALL} AS x FROM ctxs),
m2 AS (SELECT genome_id, f, r, fc, rc, (xor(x, x >> 30) * {MIX[1]}::UHUGEINT) & {_ALL} AS x FROM m1),
m3 AS (SELECT genome_id, f, r, fc, rc, (xor(x, x >> 27) * {MIX[2]}::UHUGEINT) & {_ALL} AS x FROM m2),
kept AS (SELECT genome_id, CASE WHEN fc < rc THEN f ELSE r END AS u FROM m3 WHERE (xor(x, x >> 31) & 4294967295::UHUGEINT) <= {0xFFFFFFFF >> fold}::UHUGEINT)"""


_V = """v AS (SELECT ctxgid & 1048575 AS genome_id, ctxgid >> 20 AS ctx, CAST(obj AS BIGINT) AS obj, (ctxgid - (ctxgid & 1048575)) + obj AS ctxobj, max(coalesce(cnt, 1)) AS cnt
FROM sketch WHERE ctxgid IS NOT NULL AND obj IS NOT NULL GROUP BY 1, 2, 3, 4)"""
_PAIRS = f"""{_V}, z AS (SELECT genome_id, count(*) AS size FROM v GROUP BY 1),
o AS (SELECT a.genome_id AS q, b.genome_id AS r, count(*) AS shared FROM v a JOIN v b ON a.ctxobj = b.ctxobj WHERE a.genome_id % 50 = 0 GROUP BY 1, 2),
p AS (SELECT q, r, shared, a.size AS q_size, b.size AS r_size FROM o JOIN z a ON a.genome_id = q JOIN z b ON b.genome_id = r)"""
PAIRS = _PAIRS


def _bits(x: str) -> str:
    return f"bit_count(({x} | ({x} >> 1)) & 366503875925)"


_FEATURES = f"""{_V},
e AS (SELECT a.genome_id AS q, b.genome_id AS r, b.ctx, b.obj, min({_bits("xor(a.obj, b.obj)")}) AS d FROM v a JOIN v b ON a.ctx = b.ctx WHERE a.genome_id % 50 = 0 GROUP BY 1, 2, 3, 4),
f AS (SELECT q, r, count(*) AS xny_ctx, count(*) FILTER (d > 0) AS n_diff_obj, CAST(sum(d) AS BIGINT) AS n_diff_obj_section, count(*) FILTER (d > 1) AS n_mut2_ctx FROM e GROUP BY 1, 2)"""


def _regression(denominators, c) -> str:
    shares = [f"(1 / ({p[0]} * x + {p[1]} * s + {p[2]} * m + {p[3]} * d + {EPSILON}))" for p in denominators]
    features = ["x", "s", "m", "d", *shares] + [f"({f} * {h})" for h in shares for f in ("x", "s", "m")]
    return " + ".join([f"({c[0]!r}::DOUBLE)", *(f"({w!r}::DOUBLE * {f})" for w, f in zip(c[1:], features, strict=True))])


def _ani(unassembled: bool = False, metric: str = "model", rough: bool = True, ranked: bool = False, naive: bool = False) -> str:
    jaccard, containment = "(x / (a_size + b_size - x))", "(x / least(a_size, b_size))"
    mash, aaf = f"(ln((1 + {jaccard}) / (2 * {jaccard})) / 22)", f"(ln(1 / {containment}) / 22)"
    if unassembled or naive:
        whole = f"(1 - pow(1 - d / (x + d), (s + {EPSILON}) / (d + {EPSILON})))"
        model = f"CASE WHEN x = 0 THEN 1 WHEN {whole} <= 0 THEN 0 ELSE {whole} * {NAIVE_SLOPE} + {NAIVE_INTERCEPT} END"
    else:
        wide, close = _regression(DENOMINATORS, COEFFICIENTS), _regression(DENOMINATORS_95, COEFFICIENTS_95)
        model = f"CASE WHEN x = 0 THEN 1 WHEN d = 0 THEN 0 ELSE greatest(0, CASE WHEN {wide} < 0.05 THEN {close} ELSE {wide} END) END"
    deciding, first = ("af_ref", "TRUE") if unassembled else ("least(af_qry, af_ref)", "af_qry >= 0.1::FLOAT")
    far = f"{deciding} < 0.1::FLOAT"
    dist = {"model": f"CASE WHEN {far} THEN 1.0 ELSE {model} END", "mash": mash, "aaf": aaf, "mash_if_far": f"CASE WHEN {far} THEN {mash} ELSE {model} END", "aaf_if_far": f"CASE WHEN {far} THEN {aaf} ELSE {model} END"}[metric]
    passed = f"{first} AND rough >= 0.8::FLOAT" if rough else "af_ref >= 0.1::FLOAT"
    by = "round(CAST(rough AS DOUBLE), 5)" if rough else "round(1 - dist, 5)"
    columns = f"q, r, xny_ctx, row_number() OVER (PARTITION BY q ORDER BY {by} DESC, af_qry DESC, r) AS place" if ranked else """q, r, xny_ctx, round(CAST(af_qry AS DOUBLE), 5) AS af_qry, round(CAST(af_ref AS DOUBLE), 5) AS af_ref, n_diff_obj, n_diff_obj_section, n_mut2_ctx,
       round(1 - dist, 5) AS ani, round(dist, 5) AS dist"""
    return f"""WITH {_FEATURES}, z AS (SELECT genome_id, count(*) AS size FROM v GROUP BY 1),
g AS (SELECT f.*, CAST(xny_ctx AS DOUBLE) AS x, CAST(n_diff_obj AS DOUBLE) AS d, CAST(n_diff_obj_section AS DOUBLE) AS s, CAST(n_mut2_ctx AS DOUBLE) AS m, a.size AS a_size, b.size AS b_size,
      CAST(xny_ctx / a.size AS FLOAT) AS af_qry, CAST(xny_ctx / b.size AS FLOAT) AS af_ref, CAST(1 - n_diff_obj / xny_ctx / 7 AS FLOAT) AS rough FROM f JOIN z a ON a.genome_id = q JOIN z b ON b.genome_id = r),
h AS (SELECT *, {dist} AS dist FROM g WHERE {passed})
SELECT {columns} FROM h WHERE 1 - dist {">=" if rough else ">"} 0.8::FLOAT"""


def _sampled(size: str, rs: str, dist: str, limit: float) -> str:
    def d(m: str) -> str:
        return f"CASE WHEN {m} > 0 THEN ln({dist.format(m)}) / 32 END"

    return f"""WITH {_PAIRS}, a AS (SELECT *, {size} AS n, {rs} AS rs0 FROM p), b AS (SELECT *, (shared - rs0) / n AS m FROM a),
c AS (SELECT *, least(1.0, coalesce({d("m")}, 1.0)) AS d0, sqrt(greatest(0, m * (1 - m)) / n) AS sd0 FROM b), e AS (SELECT *, m - 1.96 * sd0 AS lo, m + 1.96 * sd0 AS hi FROM c WHERE d0 <= {limit})
SELECT q, r, shared, q_size, r_size, round(rs0, 6) AS rs, round(m, 6) AS metric, round(d0, 6) AS dist, round(sd0, 6) AS sd, round(lo, 6) AS metric_low, round(hi, 6) AS metric_high,
       round({d("hi")}, 6) AS dist_low, round({d("lo")}, 6) AS dist_high FROM e"""


_P1, _P2 = "(1 - pow(1 - pow(4.0, -14), r_size - shared))", "(1 - pow(1 - pow(4.0, -14), q_size - shared))"
_RS = f"coalesce({_P1} * {_P2} * (r_size + q_size - 2 * shared) / nullif({_P1} + {_P2} - 2 * {_P1} * {_P2}, 0), 0)"
_COMP_ALL = f"""{_V}, a AS (SELECT a.genome_id AS q, b.genome_id AS r, a.cnt, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY a.genome_id, b.genome_id) AS m
      FROM v a JOIN v b ON a.ctxobj = b.ctxobj WINDOW w AS (PARTITION BY a.genome_id, b.genome_id ORDER BY a.cnt)),
comp AS (SELECT q, r, m AS shared, sum(cnt) / m AS mean, coalesce(sum(cnt) FILTER (i >= floor(m * 0.98::DOUBLE) AND i < m * 0.99::DOUBLE), 0) / floor(m * 0.99::DOUBLE - floor(m * 0.98::DOUBLE) + 1) AS pct98_99,
      max(cnt) FILTER (i = m // 2) AS median, max(cnt) AS max FROM a WHERE m >= 6 GROUP BY q, r, m)"""
COMPOSED = _COMP = _COMP_ALL.replace("a.ctxobj = b.ctxobj WINDOW", "a.ctxobj = b.ctxobj WHERE a.genome_id % 50 = 0 WINDOW")
_ABV = f"""{_COMP_ALL}, passed AS (SELECT * FROM comp WHERE median > 1 AND shared > 7), sums AS (SELECT q, sum(pct98_99) - count(*) AS rest FROM passed GROUP BY q),
abv AS (SELECT q AS sample, r AS ref_idx, (pct98_99 - 1) * 100 / nullif(rest, 0) AS pct FROM passed JOIN sums USING (q))"""
VECTORS = f"WITH {_ABV}"
KEYS = f"WITH {_V} SELECT genome_id, ctxobj, cnt FROM v"
_MET = f"{_ABV}, met AS (SELECT a.sample AS q, b.sample, a.pct AS x, b.pct AS y FROM abv a JOIN abv b ON a.ref_idx = b.ref_idx WHERE a.sample % 50 = 0)"
_PLAIN_KEYS = f"WITH {_kmers(22, str((1 << 44) - 1), 4)}"
_CODEN_CONTEXT = str(sum(15 << 6 * i for i in range(11)))
_CODEN_CTX = " | ".join(f"(((u >> {6 * i}) & 15) << {4 * i})" for i in range(11))
_CODEN_OBJ = " | ".join(f"(((u >> {6 * i + 4}) & 3) << {2 * i})" for i in range(10))
_LEGACY = f"""WITH {_kmers(16, str((1 << 32) - 1), 0)}, kept_dims AS (SELECT unnest([{", ".join(map(str, sorted(np.flatnonzero(permutation(4, 11) < 4096).tolist())))}]) AS dim),
l AS (SELECT genome_id, CAST(least(f, r) AS BIGINT) AS key FROM nums), lk AS (SELECT genome_id, key, least(count(*), 65535) AS cnt FROM l SEMI JOIN kept_dims ON dim = (key >> 8) & 65535 GROUP BY 1, 2)"""
_SHORT = f"""WITH {_kmers(8, "65535", 0)}, dims AS (SELECT unnest([{", ".join(map(str, sorted(np.flatnonzero(permutation(4, 11) < 4096).tolist())))}]) AS dim),
l AS (SELECT genome_id, CAST(least(f, r) AS BIGINT) AS key FROM nums)"""
_LEGACY_RECORDS = _LEGACY.replace(_kmers(16, str((1 << 32) - 1), 0), _kmers(16, str((1 << 32) - 1), 0, "rec_id"))


def _ani_of_sequences() -> str:
    """Queries keep contexts with several objects, references don't."""
    wide, close = _regression(DENOMINATORS, COEFFICIENTS), _regression(DENOMINATORS_95, COEFFICIENTS_95)
    return f"""WITH {_kmers(32, _CODEN_CONTEXT, 4)}, vq AS (SELECT DISTINCT genome_id, {_CODEN_CTX} AS ctx, CAST({_CODEN_OBJ} AS BIGINT) AS obj FROM kept),
v AS (SELECT * FROM vq QUALIFY count(*) OVER (PARTITION BY genome_id, ctx) = 1),
e AS (SELECT a.genome_id AS q, b.genome_id AS r, b.ctx, b.obj, min({_bits("xor(a.obj, b.obj)")}) AS dd FROM vq a JOIN v b ON a.ctx = b.ctx WHERE a.genome_id % 50 = 0 GROUP BY 1, 2, 3, 4),
f AS (SELECT q, r, count(*) AS xny_ctx, count(*) FILTER (dd > 0) AS n_diff_obj, CAST(sum(dd) AS BIGINT) AS n_diff_obj_section, count(*) FILTER (dd > 1) AS n_mut2_ctx FROM e GROUP BY 1, 2),
g AS (SELECT *, CAST(xny_ctx AS DOUBLE) AS x, CAST(n_diff_obj AS DOUBLE) AS d, CAST(n_diff_obj_section AS DOUBLE) AS s, CAST(n_mut2_ctx AS DOUBLE) AS m FROM f),
h AS (SELECT *, CASE WHEN d = 0 THEN 0 ELSE greatest(0, CASE WHEN {wide} < 0.05 THEN {close} ELSE {wide} END) END AS dist FROM g)
SELECT q, r, xny_ctx, n_diff_obj, n_diff_obj_section, n_mut2_ctx, round(1 - dist, 5) AS ani FROM h WHERE CAST(1 - n_diff_obj / xny_ctx / 7 AS FLOAT) >= 0 AND 1 - dist >= 0"""


_GREEDY = f"""WITH RECURSIVE {_V}, z AS (SELECT genome_id, count(*) AS size FROM v GROUP BY 1),
o AS (SELECT a.genome_id AS late, b.genome_id AS early, count(*) AS n FROM v a JOIN v b ON a.ctxobj = b.ctxobj AND b.genome_id < a.genome_id GROUP BY 1, 2),
j AS (SELECT late, early, n / (a.size + b.size - n) AS j FROM o JOIN z a ON a.genome_id = late JOIN z b ON b.genome_id = early),
near AS (SELECT late, list(early) AS early FROM j WHERE ln((1 + j) / (2 * j)) / 32 < 0.2 GROUP BY 1),
line AS (SELECT row_number() OVER (ORDER BY genome_id) AS i, genome_id AS g, coalesce(early, []) AS early FROM z LEFT JOIN near ON late = genome_id),
walk(i, kept) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]) UNION ALL SELECT line.i, CASE WHEN list_has_any(line.early, kept) THEN kept ELSE list_append(kept, g) END FROM walk JOIN line ON line.i = walk.i + 1),
chosen AS (SELECT unnest(kept) AS g FROM (SELECT kept FROM walk ORDER BY i DESC LIMIT 1)),
result AS (SELECT genome_id, chosen.g IS NOT NULL AS kept FROM z LEFT JOIN chosen ON chosen.g = genome_id)"""
_P_VALUES = f"""WITH {_PAIRS}, a AS (SELECT q, r, shared, shared / (q_size + r_size - shared) AS m, q_size + r_size - shared AS n FROM p),
b AS (SELECT *, least(1.0, ln(1 / (2 * m) + 0.5) / 32) AS dist, sqrt(greatest(0, m * (1 - m)) / n) AS sd, (SELECT count(*) FILTER (genome_id % 50 = 0) * count(*) FROM z) AS tests FROM a WHERE least(1.0, ln(1 / (2 * m) + 0.5) / 32) <= 1),
c AS (SELECT *, m / nullif(sd, 0) / sqrt(2) AS x FROM b),
w AS (SELECT 0.01 * i AS t, CASE WHEN i IN (0, 3000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * 0.01 / 3 AS weight FROM range(0, 3001) AS g(i)),
i AS (SELECT q, r, ln(sum(weight * exp(-(t / (1 + x)) * (t / (1 + x)) - 2 * x * t / (1 + x))) / (1 + x) * 2 / sqrt(pi()) * 0.5) - x * x AS power FROM c, w WHERE x IS NOT NULL GROUP BY q, r, x),
d AS (SELECT c.*, CASE WHEN power > ln(1e-290) THEN -power / ln(10) END AS power FROM c LEFT JOIN i ON i.q = c.q AND i.r = c.r)
SELECT q, r, shared, round(m, 5) AS metric, round(dist, 5) AS dist, round(power, 5) AS p_power, round(power - log10(tests), 5) AS q_power FROM d"""
_HALF = (1 << 16) - 1
_PATTERN = f"""u, (((u >> 22) & {_HALF}) << 16) | ((u >> 2) & {_HALF}) AS ctx, (((u >> 38) & 3) << 6) | (((u >> 18) & 15) << 2) | (u & 3) AS obj"""

SQL = {
    "sketch_coden": f"""WITH {_kmers(32, _CODEN_CONTEXT, 4)}, keyed AS (SELECT genome_id, {_CODEN_CTX} AS ctx, {_CODEN_OBJ} AS obj FROM kept),
counted AS (SELECT genome_id, ctx, obj, count(*) AS cnt FROM keyed GROUP BY 1, 2, 3)
SELECT genome_id, CAST((ctx::HUGEINT << 20) + obj::HUGEINT - CASE WHEN ctx >= 8796093022208 THEN 18446744073709551616::HUGEINT ELSE 0 END AS BIGINT) AS ctxobj, cnt FROM counted QUALIFY count(*) OVER (PARTITION BY genome_id, ctx) = 1""",
    "sketch_legacy": f"{_LEGACY} SELECT * FROM lk",
    "legacy_frequent": f"{_SHORT} SELECT genome_id, key, least(count(*), 65535) AS cnt FROM l SEMI JOIN dims ON dim = key GROUP BY 1, 2 HAVING count(*) >= 2",
    "legacy_quality": f"{_SHORT} SELECT genome_id, key, least(count(*), 65535) AS cnt FROM l SEMI JOIN dims ON dim = key GROUP BY 1, 2".replace("upper(s) AS s", "replace(upper(s), 'T', 'N') AS s"),
    "legacy_by_record": f"{_LEGACY_RECORDS} SELECT genome_id AS rec_id, key, cnt FROM lk",
    "legacy_record_kmers": f"""{_LEGACY_RECORDS}, t AS (SELECT genome_id AS rec_id, {" || ".join(f"substr('ACGT', CAST((key >> {2 * (15 - i)}) & 3 AS INTEGER) + 1, 1)" for i in range(16))} AS kmer, cnt FROM lk)
SELECT rec_id, kmer, unnest(range(1, cnt + 1)) AS copy FROM t""",
    "ani_of_sequences": _ani_of_sequences(),
    "legacy_once": f"{_LEGACY} SELECT genome_id, key FROM lk WHERE cnt = 1",
    "legacy_kmers": f"""{_LEGACY} SELECT *, {" || ".join(f"substr('ACGT', CAST((key >> {2 * (15 - i)}) & 3 AS INTEGER) + 1, 1)" for i in range(16))} AS kmer FROM lk""",
    "legacy_abundance": f"{_LEGACY} SELECT a.genome_id AS q, b.genome_id AS r, count(*) AS shared, round(avg(a.cnt), 6) AS mean_cnt FROM lk a JOIN lk b USING (key) WHERE a.genome_id % 50 = 0 GROUP BY 1, 2",
    "dist_p_values": _P_VALUES,
    "dereplicated": f"{_GREEDY} SELECT * FROM result",
    "dereplication_codes": f"""{_GREEDY}, names AS (SELECT genome_id, min(name) AS name FROM genomes GROUP BY 1)
SELECT r.genome_id, CASE WHEN kept THEN concat_ws(chr(9), row_number() OVER (PARTITION BY kept ORDER BY r.genome_id), name) ELSE concat_ws(chr(9), '0', 'NULL', name) END AS code FROM result r LEFT JOIN names USING (genome_id)""",
    "merged": f"WITH {_V} SELECT genome_id, ctxobj, cnt FROM v UNION ALL SELECT genome_id + 1000000, ctxobj, cnt FROM v",
    "index_listing": f"WITH {_V} SELECT lower(hex(ctx * 1048576 + genome_id)) AS ctxgid, lower(hex(obj)) AS obj FROM v",
    "posting_lists": f"WITH {_V} SELECT ctxobj, string_agg(CAST(genome_id AS VARCHAR), ',' ORDER BY genome_id) AS genomes FROM v GROUP BY 1",
    "ani_mash": _ani(metric="mash"),
    "ani_aaf": _ani(metric="aaf"),
    "ani_mash_if_far": _ani(metric="mash_if_far"),
    "ani_aaf_if_far": _ani(metric="aaf_if_far"),
    "ani_direct": _ani(rough=False),
    "ani_naive": _ani(naive=True),
    "ani_ranked": _ani(ranked=True),
    "ani_direct_ranked": _ani(rough=False, ranked=True),
    "sketch_plain": f"{_PLAIN_KEYS} SELECT genome_id, CAST(u AS BIGINT) AS ctxobj, count(*) AS cnt FROM kept GROUP BY 1, 2",
    "sketch_records": f"WITH {_kmers(22, str((1 << 44) - 1), 4, 'rec_id', 1)} SELECT DISTINCT genome_id, CAST(u AS BIGINT) AS ctxobj FROM kept",
    "sketch_repeated": f"WITH {_kmers(8, str((1 << 16) - 1), 2)} SELECT genome_id, CAST(u AS BIGINT) AS ctxobj, count(*) AS cnt FROM kept GROUP BY 1, 2 HAVING count(*) >= 2",
    "sketch_patterned": f"""WITH {_kmers(20, str(_HALF << 22 | _HALF << 2), 4)}, keyed AS (SELECT genome_id, {_PATTERN} FROM kept),
counted AS (SELECT genome_id, ctx, obj, count(*) AS cnt FROM keyed GROUP BY 1, 2, 3)
SELECT genome_id, CAST((ctx << 8) | obj AS BIGINT) AS ctxobj, cnt FROM counted QUALIFY count(*) OVER (PARTITION BY genome_id, ctx) = 1""",
    "reverse_kmers": f"""{_PLAIN_KEYS}, k AS (SELECT DISTINCT genome_id, CAST(u AS BIGINT) AS ctxobj FROM kept)
SELECT genome_id, ctxobj, {" || ".join(f"substr('ACGT', CAST((ctxobj >> {2 * (21 - i)}) & 3 AS INTEGER) + 1, 1)" for i in range(22))} AS kmer,
       {" || ".join(f"substr('TGCA', CAST((ctxobj >> {2 * i}) & 3 AS INTEGER) + 1, 1)" for i in range(22))} AS reverse_complement FROM k""",
    "inverted_index": f"WITH {_V} SELECT ctx, genome_id, obj FROM v",
    "index_summary": f"""WITH {_V}, a AS (SELECT ctx, genome_id, count(*) AS n FROM v GROUP BY 1, 2), b AS (SELECT ctx, count(*) AS g, count(*) FILTER (n > 1) AS c FROM a GROUP BY 1)
SELECT count(*) AS contexts, max(g) AS most_genomes, CAST(sum(c) AS BIGINT) AS conflicts FROM b""",
    "sketch_sizes": f"WITH {_V}, z AS (SELECT genome_id, count(*) AS size FROM v GROUP BY 1) SELECT g.genome_id, min(name) AS name, coalesce(max(size), 0) AS size FROM genomes g LEFT JOIN z ON z.genome_id = g.genome_id GROUP BY 1",
    "set_union": f"WITH {_V} SELECT DISTINCT ctxobj FROM v",
    "set_unique_union": f"WITH {_V} SELECT ctxobj FROM v GROUP BY ctxobj HAVING count(*) = 1",
    "set_markers": f"WITH {_V} SELECT min(genome_id) AS genome_id, ctxobj FROM v GROUP BY ctxobj HAVING count(*) = 1",
    "set_intersect": f"WITH {_V}, pan AS (SELECT ctxobj FROM v GROUP BY 1 HAVING count(*) = 1) SELECT ctxobj, genome_id, cnt FROM v SEMI JOIN pan USING (ctxobj)",
    "set_subtract": f"WITH {_V}, pan AS (SELECT ctxobj FROM v GROUP BY 1 HAVING count(*) = 1) SELECT ctxobj, genome_id, cnt FROM v ANTI JOIN pan USING (ctxobj)",
    "set_group_union": f"WITH {_V}, t AS (SELECT genome_id, min(taxid) AS taxid FROM genomes WHERE taxid <> 0 GROUP BY 1) SELECT DISTINCT taxid, ctxobj FROM v JOIN t USING (genome_id)",
    "set_key_listing": f"WITH {_V} SELECT genome_id, lower(hex(ctxobj)) AS key, cnt FROM v",
    "set_combine": f"""WITH {_V} SELECT 0 AS genome_id, ctxobj FROM (SELECT DISTINCT ctxobj FROM v) UNION ALL
SELECT 1, ctxobj FROM (SELECT ctxobj FROM v GROUP BY ctxobj HAVING count(*) = 1)""",
    "conflict_free": f"WITH {_V} SELECT genome_id, ctxobj, cnt FROM v QUALIFY count(*) OVER (PARTITION BY genome_id, ctx) = 1",
    "dist_similarity": f"""WITH {_PAIRS}, j AS (SELECT *, shared / (q_size + r_size - shared) AS jac, shared / least(q_size, r_size) AS con FROM p)
SELECT q, r, shared, q_size, r_size, round(jac, 6) AS jaccard, round(con, 6) AS containment, round(ln((1 + jac) / (2 * jac)) / 32, 6) AS mash, round(ln(1 / con) / 32, 6) AS aaf FROM j""",
    "dist_corrected": _sampled("r_size + q_size - shared", _RS, "1 / (2 * {0}) + 0.5", 1.0),
    "dist_containment": _sampled("q_size", "0.0", "1 / {0}", 0.2),
    "dist_nearest": f"""WITH {_PAIRS}, j AS (SELECT *, shared / (q_size + r_size - shared) AS jac FROM p)
SELECT q, r, shared, round(jac, 6) AS jaccard, row_number() OVER (PARTITION BY q ORDER BY jac DESC, r) AS place FROM j QUALIFY row_number() OVER (PARTITION BY q ORDER BY jac DESC, r) <= 5""",
    "matrix_full": f"""WITH {_PAIRS}, j AS (SELECT q, r, shared / (q_size + r_size - shared) AS jac FROM p)
SELECT a.genome_id AS q, b.genome_id AS r, coalesce(round(ln((1 + jac) / (2 * jac)) / 32, 6), -1.0) AS value FROM (SELECT * FROM z WHERE genome_id % 50 = 0) a CROSS JOIN z b LEFT JOIN j ON j.q = a.genome_id AND j.r = b.genome_id""",
    "ani_features": f"WITH {_FEATURES} SELECT * FROM f",
    "ani_detail": _ani(),
    "ani_unassembled": _ani(unassembled=True),
    "ani_contexts": f"""WITH {_V}, one AS (SELECT genome_id, ctx, min(obj) AS obj FROM v GROUP BY 1, 2 HAVING count(*) = 1),
e AS (SELECT a.genome_id AS q, b.genome_id AS r, b.ctx, min(CASE WHEN a.obj = b.obj THEN 0 ELSE 1 END) AS d FROM v a JOIN one b ON a.ctx = b.ctx WHERE a.genome_id % 50 = 0 GROUP BY 1, 2, 3)
SELECT q, r, count(*) AS shared, round(CASE WHEN count(*) > 100 THEN pow(1 - sum(d) / count(*), 0.1) ELSE 0 END, 6) AS ani FROM e GROUP BY 1, 2""",
    "composition": f"WITH {_COMP} SELECT q, r, shared, round(mean, 6) AS mean, round(pct98_99, 6) AS pct98_99, median, max FROM comp",
    "abundance_vectors": f"WITH {_ABV} SELECT sample, ref_idx, round(pct, 6) AS pct FROM abv",
    "vector_search_l1": f"WITH {_MET}, e AS (SELECT q, sample, round(sum(abs(y - x)) + 200 - sum(x) - sum(y), 6) AS measure FROM met GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY q ORDER BY measure, sample) AS place FROM e",
    "vector_search_l2": f"WITH {_MET}, e AS (SELECT q, sample, round(sqrt(sum((y - x) * (y - x))), 6) AS measure FROM met GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY q ORDER BY measure, sample) AS place FROM e",
    "vector_search_cosine": f"""WITH {_MET}, n AS (SELECT sample, sqrt(sum(pct * pct)) AS norm FROM abv GROUP BY 1), d AS (SELECT q, sample, sum(x * y) AS dot FROM met GROUP BY 1, 2),
e AS (SELECT d.q, d.sample, round(dot / nullif(a.norm * b.norm, 0), 6) AS measure FROM d JOIN n a ON a.sample = d.q JOIN n b ON b.sample = d.sample) SELECT *, row_number() OVER (PARTITION BY q ORDER BY measure DESC, sample) AS place FROM e""",
    "error_rate": f"""WITH {_V}, n AS (SELECT cnt, count(DISTINCT ctxobj) AS n FROM v GROUP BY cnt),
x AS (SELECT coalesce(max(n) FILTER (cnt = 1), 0) AS h1, coalesce(max(n) FILTER (cnt = 2), 0) AS h2, CAST(sum(cnt * n) AS BIGINT) AS total FROM n)
SELECT h1, h2, total, round((h1 - 2 * h2) / total, 9) AS s, round((h1 - 2 * h2) / total / (0.9 - 0.1 * ((h1 - 2 * h2) / total)), 9) AS r FROM x""",
    "differing": f"WITH {_V}, l AS (SELECT *, min(obj) OVER (PARTITION BY ctx) AS least FROM v) SELECT {_bits('xor(obj, least)')} AS bases, count(*) AS n FROM l GROUP BY 1",
    "reversed_sequences": f"WITH {_RECORDS} SELECT rec_id, reverse(translate(upper(s), 'ACGT', 'TGCA')) AS reverse_complement FROM recs",
    "taxonomy_roll_up": rf"""WITH RECURSIVE {_V}, z AS (SELECT genome_id, count(*) AS size FROM v GROUP BY 1), t AS (SELECT genome_id, min(taxid) AS taxid FROM genomes WHERE taxid <> 0 GROUP BY 1),
n AS (SELECT node, min(try_cast(nullif(regexp_extract(pa, '(\d+)', 1), '') AS BIGINT)) AS pa, min(r) FILTER (r IN ('superkingdom', 'phylum', 'class', 'order', 'family', 'genus', 'species')) AS rank
      FROM (SELECT *, CASE lower(trim(regexp_replace(rank, '\s+', ' ', 'g'))) WHEN 'sp.' THEN 'species' WHEN 'fam.' THEN 'family' WHEN 'gen.' THEN 'genus'
            ELSE lower(trim(regexp_replace(rank, '\s+', ' ', 'g'))) END AS r FROM ncbitaxid_rank_parentnode_name) WHERE node IS NOT NULL GROUP BY node),
l AS (SELECT node, pa FROM n WHERE pa <> node AND pa IN (SELECT node FROM n)),
up(node, anc) AS (SELECT node, node FROM n UNION SELECT up.node, l.pa FROM up JOIN l ON up.anc = l.node),
bad AS (SELECT DISTINCT up.node FROM up JOIN l ON l.pa = up.node AND l.node = up.anc),
ok AS (SELECT up.* FROM up WHERE NOT EXISTS (SELECT 1 FROM up u JOIN bad ON bad.node = u.anc WHERE u.node = up.node))
SELECT 'all' AS sample, n.rank, ok.anc AS taxid, CAST(sum(size) AS DOUBLE) AS value FROM z JOIN t USING (genome_id) JOIN ok ON ok.node = t.taxid JOIN n ON n.node = ok.anc WHERE n.rank IS NOT NULL GROUP BY 1, 2, 3""",
}
