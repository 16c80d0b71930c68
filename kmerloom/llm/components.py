"""Consolidating pairwise matches into groups (connected components by graph reduction).

Each round strips the degree-one vertices and compresses the degree-two chains of what is left: list ranking (pointer
doubling over the directed steps along a chain) gives every chain vertex both ends of its chain in log2(length) joins.
A chain between two vertices of higher degree becomes one edge, one that ends in a leaf disappears, a path or ring of
its own is solved. Rounds repeat, at any size, until every vertex has three neighbours or more. Only that reduced core is solved
otherwise: by contracting each vertex into its smallest neighbour in a hash order, after which stripping goes on, or, where
the core has at most ``core_edges`` edges (a checked count), in one task by union-find. Labels then return to the
removed vertices, round by round in reverse.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from kmerloom.operators.skew import hot_left_join
from kmerloom.session import Scratch

#: The largest core that one task solves: 16 bytes an edge to read, under a second a million.
CORE_EDGES = 200_000


def connected_groups(edges: DataFrame, left: str, right: str, core_edges: int = CORE_EDGES) -> DataFrame:
    """(vertex, group): every vertex with a partner, and the smallest vertex that it is linked to in any number of steps.

    ``left`` and ``right`` hold integer vertex ids. Pairs may repeat, stand in either order or in both; a pair with a
    null end or two equal ends links nothing, so a vertex that occurs only in such pairs has no row. Other columns
    are ignored, whatever their names. An empty input gives an empty result.
    """
    scratch = Scratch(edges.sparkSession, "groups")
    a, b = F.col(left).cast("bigint"), F.col(right).cast("bigint")
    graph = scratch.keep(edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u < v").where(a.isNotNull() & b.isNotNull()).distinct(), "edges")
    removed: list[DataFrame] = []
    size = graph.measured["rows"]
    while size:
        graph, size, gone = _strip_and_compress(scratch, graph, size)
        if gone is not None:
            removed.append(gone)
        elif size <= core_edges:
            removed.append(scratch.keep(graph.coalesce(1).mapInPandas(_union_find, "vertex bigint, up bigint, hung boolean"), "core"))
            break
        else:
            graph, size, gone = _contract(scratch, graph)
            removed.append(gone)
    labels = edges.sparkSession.createDataFrame([], "vertex bigint, label bigint")
    for gone in reversed(removed):
        known = labels.select(F.col("vertex").alias("at"), F.col("label").alias("top"))
        met = scratch.keep(hot_left_join(gone, known, "up", "at", gone.measured["rows"]), "met")
        back = met.where("vertex <> up or top is null").select("vertex", F.coalesce("top", "up").alias("label"))
        alone = met.where("hung and top is null").select(F.col("up").alias("vertex"), F.col("up").alias("label")).distinct()  # it lost all its neighbours
        labels = labels.unionByName(back).unionByName(alone)
    labels = scratch.keep(labels, "all-labels")
    least = labels.groupBy("label").agg(F.min("vertex").alias("group")).withColumnRenamed("label", "of")
    return hot_left_join(labels, least, "label", "of", labels.measured["rows"]).select("vertex", "group")


def _both_ways(graph: DataFrame) -> DataFrame:
    return graph.select(F.explode(F.array(F.struct(F.col("u").alias("vertex"), F.col("v").alias("other")), F.struct(F.col("v").alias("vertex"), F.col("u").alias("other")))).alias("x")).select("x.*")


def _strip_and_compress(scratch: Scratch, graph: DataFrame, size: int) -> tuple[DataFrame, int, DataFrame | None]:
    """The graph without vertices of degree one and two, its edges' number, and (vertex, up) of those removed."""
    degrees = _both_ways(graph).groupBy("vertex").agg(F.count("*").alias("degree"), F.min("other").alias("low"), F.max("other").alias("high"))
    light = scratch.keep(degrees.where("degree <= 2"), "light")
    if not light.measured["rows"]:
        scratch.drop(light)
        return graph, size, None
    ends = _chain_ends(scratch, light)
    gone = scratch.keep(
        ends.groupBy("vertex")
        .agg(F.min("anchor").alias("a"), F.max("anchor").alias("b"), F.min("least").alias("least"))
        .select("vertex", F.coalesce("a", "least").alias("up"), F.col("a").isNotNull().alias("hung"), "a", "b"),
        "removed",
    )
    ids = light.select(F.col("vertex").alias("id"))
    kept = graph.join(ids, graph["u"] == ids["id"], "left_anti").join(ids, F.col("v") == F.col("id"), "left_anti")
    bridges = gone.where("a < b").select(F.col("a").alias("u"), F.col("b").alias("v")).distinct()
    rest = scratch.keep(kept.unionByName(bridges).distinct(), "edges")
    scratch.drop(graph, light)
    return rest, rest.measured["rows"], gone


def _chain_ends(scratch: Scratch, light: DataFrame) -> DataFrame:
    """For each step out of a light vertex: the chain's end that way.

    A step (vertex, via) leads from a light vertex to a neighbour. Its successor is the step on to that neighbour's
    other neighbour, if it has just two. Doubling stops at a leaf (anchor null) or at a vertex of higher degree
    (the anchor). least is the smallest vertex passed, leaves included. A ring has no end: its steps are done when
    a round ends none and moves no minimum, for then the minimum is that of the whole ring.
    """
    ahead = light.select(F.col("vertex").alias("at"), F.col("degree").alias("n"), "low", "high")
    steps = light.select("vertex", F.explode(F.expr("if(degree = 2, array(low, high), array(low))")).alias("via"))
    two = F.col("n") == 2
    # all leaves of a hub step to it
    start = hot_left_join(steps, ahead, "via", "at", 2 * light.measured["rows"]).select(
        "vertex",
        "via",
        F.when(two, F.col("via")).otherwise(F.col("vertex")).alias("to"),
        F.when(two, F.when(F.col("low") == F.col("vertex"), F.col("high")).otherwise(F.col("low"))).otherwise(F.col("via")).alias("to_via"),
        F.when(F.col("n") == 1, F.least("vertex", "via")).otherwise(F.col("vertex")).alias("least"),
        F.when(F.col("n").isNull(), F.col("via")).alias("anchor"),
        (~F.coalesce(two, F.lit(False))).alias("done"),
    )
    done, running = scratch.split(start, "done", "steps")
    open_steps = running.measured["rows"]
    while open_steps:
        moved = None
        for _ in range(2):
            ahead = done.select("vertex", "via", "to", "to_via", "least", "anchor", F.lit(True).alias("end")).unionByName(running.select("vertex", "via", "to", "to_via", "least", "anchor", F.lit(False).alias("end")))
            ahead = ahead.select(F.col("vertex").alias("f"), F.col("via").alias("g"), F.col("to").alias("h"), F.col("to_via").alias("i"), F.col("least").alias("l"), F.col("anchor").alias("a"), "end")
            step = running.join(ahead, (running["to"] == ahead["f"]) & (running["to_via"] == ahead["g"])).select(
                "vertex", "via", F.col("h").alias("to"), F.col("i").alias("to_via"), F.least("least", "l").alias("least"), F.col("a").alias("anchor"), F.col("end").alias("done"), F.col("least").alias("was")
            )
            passed = running
            ended, running = scratch.split(step, "done", "steps", moved=F.count_if(F.col("least") < F.col("was")))
            scratch.drop(passed)
            moved = running.measured["moved"]
            done = done.unionByName(ended.drop("was"))
            before, open_steps = open_steps, running.measured["rows"]
            if not open_steps or open_steps == before:
                break
        if open_steps and open_steps == before and not moved:
            done = done.unionByName(running.drop("was"))
            break
    return done.select("vertex", "anchor", "least")


def _order(x: Column) -> Column:
    return F.struct(F.xxhash64(x).alias("h"), x.alias("id"))


def _contract(scratch: Scratch, graph: DataFrame) -> tuple[DataFrame, int, DataFrame]:
    """One contraction of the core: every vertex joins the tree of its smallest closed neighbour in hash order."""
    best = _both_ways(graph).groupBy("vertex").agg(F.min(_order(F.col("other"))).alias("o"))
    up = scratch.keep(best.select("vertex", F.least(F.col("o"), _order(F.col("vertex")))["id"].alias("up")), "up")
    while True:
        ahead = up.select(F.col("vertex").alias("at"), F.col("up").alias("top"))
        step = hot_left_join(up, ahead, "up", "at", up.measured["rows"]).select("vertex", F.col("top").alias("up"), F.col("up").alias("was"))
        before, up = up, scratch.keep(step, "up", moved=F.count_if(F.col("up") != F.col("was")))
        scratch.drop(before)
        if not up.measured["moved"]:
            break
    up = scratch.keep(up.select("vertex", "up", F.lit(False).alias("hung")), "up")
    names = up.select(F.col("vertex").alias("at"), F.col("up").alias("top"))
    one = scratch.keep(hot_left_join(graph, names, "u", "at", graph.measured["rows"]).select(F.col("top").alias("u"), "v"), "half")
    both = hot_left_join(one, names, "v", "at", one.measured["rows"]).select("u", F.col("top").alias("v"))
    rest = scratch.keep(both.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    scratch.drop(graph, one)
    return rest, rest.measured["rows"], up


def _union_find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    frames = list(batches)
    if not frames:
        return
    pairs = pd.concat(frames)[["u", "v"]].to_numpy(np.int64)
    ids, flat = np.unique(pairs, return_inverse=True)
    up = list(range(len(ids)))
    for a, b in flat.reshape(-1, 2).tolist():
        while up[a] != a:
            up[a] = a = up[up[a]]
        while up[b] != b:
            up[b] = b = up[up[b]]
        if a != b:
            up[max(a, b)] = min(a, b)
    for i in range(len(up)):
        up[i] = up[up[i]]
    yield pd.DataFrame({"vertex": ids, "up": ids[up], "hung": False})
