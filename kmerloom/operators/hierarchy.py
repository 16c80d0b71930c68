"""Parent-child links to full hierarchies, by bottom-up peeling and a top-down pass in reverse peel order.

One peel round removes every *pendant chain*: a leaf and the run of only-child ancestors above it. The run is found
by list ranking (pointer doubling down the only-child links), so a branch of depth d costs log2(d) joins instead of
d rounds; each round at least halves the number of leaves, so there are at most log2(leaves) rounds, at any size of the
table. Every chain sends its subtree size to the parent of its top. What is never peeled lies on a loop. The reverse
pass visits the rounds from last to first and hands roots, depths and paths from a chain's parent to the chain.

A node's descendant list is kept as the rows in which it occurs on a path (``descendants``): a root may have a
third of all nodes below it, which is no size for one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from kmerloom.operators.skew import SALTS, hot_left_join
from kmerloom.session import Scratch

SCHEMA = "node bigint, parent bigint, root bigint, depth int, path array<bigint>, n_descendants bigint, loop_node bigint"


def parent_number(text: Column) -> Column:
    """The number in a parent reference however it is wrapped: ``' 42'``, ``42.0``, ``taxid:42``, ``42\\r``; else null."""
    digits = F.regexp_extract(text, r"(\d+)", 1)
    return F.when(digits != "", digits.try_cast("bigint"))


def clean_rank(text: Column) -> Column:
    """Lower-cased rank without outer blanks, with short forms written out; null stays null."""
    plain = F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))
    return F.when(plain == "sp.", "species").when(plain == "fam.", "family").when(plain == "gen.", "genus").otherwise(plain)


def hierarchy(links: DataFrame, node: str = "node", parent: str = "parent", paths: bool = True, on_path: Column | None = None) -> DataFrame:
    """One row per distinct node: parent, root, depth, path, number of descendants, loop.

    ``node`` and ``parent`` are integer columns; other columns are ignored. Rows with a null node are dropped, a node
    with several rows counts once (with several parents, the smallest counts). A node whose parent is null, itself or
    not listed is a root (depth 0, path of itself). A node whose chain of parents runs into a loop of two or more
    nodes has ``loop_node`` (the smallest node on the loop) and null root, depth and path; on the loop itself
    ``n_descendants`` is null as well. An empty input gives an empty result. Paths run from the root to the node. They hold
    only nodes with a row for which ``on_path`` is true, if it is given, and are null without ``paths``: as long as the tree
    is deep, they are most of the work.
    """
    spark = links.sparkSession
    scratch = Scratch(spark, "hierarchy")
    mark = F.lit(True) if on_path is None else F.coalesce(on_path, F.lit(False))
    left = scratch.keep(
        links.select(F.col(node).cast("bigint").alias("node"), F.col(parent).cast("bigint").alias("parent"), mark.alias("mark"))
        .where("node is not null")
        .groupBy("node")
        .agg(F.min("parent").alias("parent"), F.bool_or("mark").alias("mark"))
        .select("node", F.when(F.col("parent") != F.col("node"), F.col("parent")).alias("parent"), "mark", F.lit(1).cast("bigint").alias("weight")),
        "nodes",
    )
    peeled: list[DataFrame] = []
    while left.measured["rows"]:
        chains = _pendant_chains(scratch, left)
        if chains is None:
            break
        tops = chains.groupBy("chain").agg(F.max(F.struct("hops", "parent", "size")).alias("top")).select("top.parent", "top.size")
        sent = tops.where("parent is not null").groupBy("parent").agg(F.sum("size").alias("sent")).withColumnRenamed("parent", "to")
        rest = left.join(chains.select("node"), "node", "left_anti")
        rest = rest.join(sent, rest["node"] == sent["to"], "left").select("node", "parent", "mark", (F.col("weight") + F.coalesce("sent", F.lit(0))).alias("weight"))
        before, left = left, scratch.keep(rest, "left")
        scratch.drop(before)
        peeled.append(chains)
    known = _loops(scratch, left) if left.measured["rows"] else spark.createDataFrame([], SCHEMA)
    for chains in reversed(peeled):
        known = known.unionByName(scratch.keep((_assign_paths if paths else _assign)(scratch, chains, known), "assigned"))
        scratch.drop(chains)
    return known


def _pendant_chains(scratch: Scratch, left: DataFrame) -> DataFrame | None:
    """(node, parent, mark, chain, hops, size): every leaf and only-child ancestor of a leaf; chain is the leaf. None without leaves.

    A node with one child steps to it; leaves and nodes with several children stand still. Doubling the steps leads every run to
    the leaf or the branching below it, and sums the weights on the way.
    """
    kids = left.where("parent is not null").groupBy("parent").agg(F.count("*").alias("kids"), F.max("node").alias("only")).withColumnRenamed("parent", "of")
    single = F.coalesce(F.col("kids") == 1, F.lit(False))
    start = left.join(kids, left["node"] == kids["of"], "left").select(
        "node",
        "parent",
        "mark",
        F.when(single, F.col("only")).otherwise(F.col("node")).alias("next"),
        single.cast("bigint").alias("hops"),
        F.col("weight").alias("size"),
        F.when(F.col("kids").isNull(), True).when(~single, False).alias("leaf"),
        (~single).alias("done"),
    )
    done, running = scratch.split(start, "done", "ranks", leaves=F.count_if("leaf"))
    if not done.measured["leaves"]:
        scratch.drop(done, running)
        return None
    parts = [done]
    while before := running.measured["rows"]:
        table = done.unionByName(running).select(F.col("node").alias("at"), F.col("next").alias("to"), F.col("hops").alias("more"), F.col("size").alias("add"), F.col("leaf").alias("is_leaf"))
        step = running.withColumn("done", F.lit(False))
        for _ in range(2):  # two steps in one job, each doubling the length
            ends = F.col("done")
            step = step.join(table, (step["next"] == table["at"]) & ~step["done"], "left").select(
                "node",
                "parent",
                "mark",
                F.when(ends, F.col("next")).otherwise(F.col("to")).alias("next"),
                F.when(ends, F.col("hops")).otherwise(F.col("hops") + F.col("more")).alias("hops"),
                F.when(ends, F.col("size")).otherwise(F.col("size") + F.col("add")).alias("size"),
                F.when(ends, F.col("leaf")).otherwise(F.col("is_leaf")).alias("leaf"),
                (ends | F.col("is_leaf").isNotNull()).alias("done"),
            )
        passed = running
        ended, running = scratch.split(step, "done", "ranks")
        scratch.drop(passed)
        parts.append(ended)
        done = done.unionByName(ended)
        if running.measured["rows"] == before:
            break  # no run ended, so all that are left go round a loop
    chains = scratch.keep(done.where("leaf").select("node", "parent", "mark", F.col("next").alias("chain"), "hops", "size"), "chains")
    scratch.drop(*parts, running)
    return chains


def _loops(scratch: Scratch, rest: DataFrame) -> DataFrame:
    """The residual nodes with the smallest node of their loop, by doubling until the minimum no longer changes."""
    ring = scratch.keep(rest.select("node", "parent", F.col("parent").alias("next"), F.col("node").alias("least")), "ring")
    while True:
        ahead = ring.select(F.col("node").alias("at"), F.col("next").alias("to"), F.col("least").alias("other"))
        step = ring.join(ahead, ring["next"] == ahead["at"]).select("node", "parent", F.col("to").alias("next"), F.least("least", "other").alias("least"), F.col("least").alias("was"))
        before, ring = ring, scratch.keep(step, "ring", moved=F.count_if(F.col("least") < F.col("was")))
        scratch.drop(before)
        if not ring.measured["moved"]:
            break
    null = lambda kind: F.lit(None).cast(kind)
    return ring.select("node", "parent", null("bigint").alias("root"), null("int").alias("depth"), null("array<bigint>").alias("path"), null("bigint").alias("n_descendants"), F.col("least").alias("loop_node"))


def _above(known: DataFrame, *paths: Column) -> DataFrame:
    return known.select(F.col("node").alias("above"), F.col("root").alias("a_root"), F.col("depth").alias("a_depth"), F.col("loop_node").alias("a_loop"), *paths)


def _assign(scratch: Scratch, chains: DataFrame, known: DataFrame) -> DataFrame:
    """Depths, roots and loops of one round's chains from those of the nodes that they hang on: as rows, however long a chain is."""
    tops = chains.groupBy("chain").agg(F.max(F.struct("hops", "node", "parent")).alias("top")).select("chain", F.col("top.hops").alias("top_hops"), F.col("top.node").alias("top"), F.col("top.parent").alias("hangs_on"))
    tops = scratch.keep(tops, "tops")
    met = hot_left_join(tops, _above(known), "hangs_on", "above", tops.measured["rows"]).withColumnRenamed("chain", "of")
    rows = hot_left_join(chains, met, "chain", "of", chains.measured["rows"])
    free = F.col("a_loop").isNull()
    return rows.select(
        "node",
        "parent",
        F.when(free, F.coalesce("a_root", "top")).alias("root"),
        F.when(free, F.coalesce(F.col("a_depth") + 1, F.lit(0)) + F.col("top_hops") - F.col("hops")).cast("int").alias("depth"),
        F.lit(None).cast("array<bigint>").alias("path"),
        (F.col("size") - 1).alias("n_descendants"),
        F.col("a_loop").alias("loop_node"),
    )


def _assign_paths(scratch: Scratch, chains: DataFrame, known: DataFrame) -> DataFrame:
    """As ``_assign``, with paths. A chain is gathered in one row, which is no longer than the path of its lowest node."""
    runs = scratch.keep(
        chains.groupBy("chain")
        .agg(F.sort_array(F.collect_list(F.struct("hops", "node", "parent", "size", "mark")), asc=False).alias("run"))
        .select(F.col("run")[0]["parent"].alias("hangs_on"), F.transform("run", lambda x: x.dropFields("hops")).alias("run")),
        "runs",
    )
    met = hot_left_join(runs, _above(known, F.col("path").alias("a_path")), "hangs_on", "above", runs.measured["rows"], salts=SALTS)
    marked = lambda run: F.transform(F.filter(run, lambda x: x["mark"]), lambda x: x["node"])
    free = F.col("a_loop").isNull()
    return met.select("a_root", "a_depth", "a_path", "a_loop", "run", F.posexplode("run").alias("i", "x")).select(
        F.col("x.node").alias("node"),
        F.col("x.parent").alias("parent"),
        F.when(free, F.coalesce("a_root", F.col("run")[0]["node"])).alias("root"),
        F.when(free, F.coalesce(F.col("a_depth") + 1, F.lit(0)) + F.col("i")).cast("int").alias("depth"),
        F.when(free, F.concat(F.coalesce("a_path", F.array().cast("array<bigint>")), marked(F.slice("run", F.lit(1), F.col("i") + 1)))).alias("path"),
        (F.col("x.size") - 1).alias("n_descendants"),
        F.col("a_loop").alias("loop_node"),
    )


def descendants(tree: DataFrame) -> DataFrame:
    """(node, descendant, distance) for every node of ``hierarchy``'s result and all nodes below it.

    Nodes without root (on or below a loop) have no rows. The rows grow with the sum of the depths.
    """
    return (
        tree.where("depth > 0")
        .select(F.col("node").alias("descendant"), "depth", F.posexplode(F.expr("slice(path, 1, depth)")).alias("at", "node"))
        .select("node", "descendant", (F.col("depth") - F.col("at")).alias("distance"))
    )
