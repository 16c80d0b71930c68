"""Queries on the taxonomy's parent-child links, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kmerloom.operators.hierarchy import clean_rank, descendants, hierarchy, parent_number
from kmerloom.plans.tables import table


def _links(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "ncbitaxid_rank_parentnode_name")
    return rows.select("node", parent_number(F.col("pa")).alias("parent"), clean_rank(F.col("rank")).alias("rank"), "name")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes whose chain of parents runs into a loop."""
    return hierarchy(_links(spark, folder), paths=False).where("loop_node is not null").select("node", "loop_node")


def p3_hierarchy(spark: SparkSession, folder: str) -> DataFrame:
    """Path, depth, root, rank and number of descendants of every node."""
    links = _links(spark, folder)
    ranks = links.where("node is not null").groupBy("node").agg(F.min("rank").alias("rank"))
    return hierarchy(links).join(ranks, "node", "left").select("node", "rank", "root", "depth", F.array_join("path", "/").alias("path"), F.when(F.col("loop_node").isNull(), F.col("n_descendants")).alias("n_descendants"), "loop_node")


def p3_descendants(spark: SparkSession, folder: str) -> DataFrame:
    """Every node with each of its descendants."""
    return descendants(hierarchy(_links(spark, folder)))


QUERIES = {"p3_found": p3_found, "p3_hierarchy": p3_hierarchy, "p3_descendants": p3_descendants}

_LINKS = r"""
n AS (SELECT node, min(try_cast(nullif(regexp_extract(pa, '(\d+)', 1), '') AS BIGINT)) AS pa, min(r) AS rank
      FROM (SELECT *, CASE lower(trim(regexp_replace(rank, '\s+', ' ', 'g'))) WHEN 'sp.' THEN 'species' WHEN 'fam.' THEN 'family' WHEN 'gen.' THEN 'genus'
                      ELSE lower(trim(regexp_replace(rank, '\s+', ' ', 'g'))) END AS r FROM ncbitaxid_rank_parentnode_name)
      WHERE node IS NOT NULL GROUP BY node),
l AS (SELECT node, pa FROM n WHERE pa <> node AND pa IN (SELECT node FROM n)),
up(node, anc) AS (SELECT node, pa FROM l UNION SELECT up.node, l.pa FROM up JOIN l ON up.anc = l.node),
looped AS (SELECT up.node, min(up.anc) AS loop_node FROM up WHERE up.anc IN (SELECT node FROM up WHERE node = anc) GROUP BY up.node),
down(node, root, depth, path) AS (
  SELECT node, node, 0, CAST(node AS VARCHAR) FROM n WHERE node NOT IN (SELECT node FROM l)
  UNION ALL SELECT l.node, down.root, down.depth + 1, down.path || '/' || CAST(l.node AS VARCHAR) FROM down JOIN l ON l.pa = down.node)
"""

SQL = {
    "p3_found": f"WITH RECURSIVE {_LINKS} SELECT node, loop_node FROM looped",
    "p3_hierarchy": f"""WITH RECURSIVE {_LINKS},
below AS (SELECT anc, count(*) AS k FROM up GROUP BY anc)
SELECT n.node, n.rank, down.root, down.depth, coalesce(down.path, CAST(NULL AS VARCHAR)) AS path,
       CASE WHEN looped.node IS NULL THEN coalesce(below.k, 0) END AS n_descendants, looped.loop_node
FROM n LEFT JOIN down ON down.node = n.node LEFT JOIN looped ON looped.node = n.node LEFT JOIN below ON below.anc = n.node""",
    "p3_descendants": f"""WITH RECURSIVE {_LINKS}
SELECT up.anc AS node, up.node AS descendant, b.depth - a.depth AS distance FROM up JOIN down a ON a.node = up.anc JOIN down b ON b.node = up.node""",
}
