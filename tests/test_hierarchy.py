import random

import pytest
from pyspark.sql import functions as F

from kmerloom.operators.hierarchy import descendants, hierarchy


def brute(links):
    parent = {}
    for node, up in links:
        if node is not None:
            old = parent.get(node)
            parent[node] = up if old is None else old if up is None else min(old, up)
    out = {}
    for node in parent:
        path, at = [node], node
        while (up := parent[at]) is not None and up != at and up in parent and up not in path:
            path.append(up)
            at = up
        up = parent[at]
        if up in path and up != at:
            loop = path[path.index(up) :]
            out[node] = (None, None, None, min(loop))
        else:
            out[node] = (path[-1], len(path) - 1, path[::-1], None)
    return out


def rows(spark, links, **kw):
    df = spark.createDataFrame(links, "node long, parent long, path string")
    return {r.node: r for r in hierarchy(df, **kw).collect()}


@pytest.mark.parametrize("paths", [True, False])
def test_against_brute_force(spark, paths):
    rnd = random.Random(5)
    links = [(i, rnd.randrange(max(0, i - 30), i), "x") for i in range(1, 150)] + [(0, 0, "x")]
    links += [(200 + i, 199 + i, "deep") for i in range(1, 40)] + [(200, 7, "x"), (300, 999, "unlisted parent"), (301, 300, "x"), (302, None, "x")]
    links += [(400, 401, "x"), (401, 402, "x"), (402, 400, "x"), (403, 401, "x"), (404, 403, "x"), (405, 404, "x"), (None, 3, "x"), (5, None, "x")]
    links += links[:20]
    got, want = rows(spark, links, paths=paths), brute([x[:2] for x in links])
    assert {n: (r.root, r.depth, r.path, r.loop_node) for n, r in got.items()} == {n: (w[0], w[1], w[2] if paths else None, w[3]) for n, w in want.items()}
    for node, r in got.items():
        if r.loop_node is None:
            assert r.n_descendants == sum(node in (w[2] or [])[:-1] for w in want.values())


def test_descendants_are_the_paths(spark):
    df = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 1)], "node long, parent long")
    assert sorted(map(tuple, descendants(hierarchy(df)).collect())) == [(1, 2, 1), (1, 3, 2), (1, 4, 1), (2, 3, 1)]


def test_empty(spark):
    assert hierarchy(spark.createDataFrame([], "node long, parent long")).count() == 0


def test_only_loops(spark):
    got = rows(spark, [(i, (i + 1) % 9, "") for i in range(9)], paths=False)
    assert {r.loop_node for r in got.values()} == {0} and len(got) == 9


def test_paths_of_marked_nodes(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, 1, "b"), (3, 2, "a"), (4, 3, None), (5, 4, "a")], "node long, parent long, rank string")
    got = {r.node: r.path for r in hierarchy(df, on_path=F.col("rank") == "a").collect()}
    assert got == {1: [1], 2: [1], 3: [1, 3], 4: [1, 3], 5: [1, 3, 5]}


def test_large_forest(spark):
    """A hub with 8,000 children that have children, a branch 3,000 deep, a random tree and a loop with trees on it."""
    rnd = random.Random(4)
    links = [(i, 0) for i in range(1, 8000)] + [(8000 + i, 1 + i) for i in range(4000)] + [(0, None)]
    links += [(20_000 + i, 19_999 + i) for i in range(3000)] + [(30_000 + i, 30_000 + rnd.randrange(i)) for i in range(1, 6000)]
    links += [(40_000 + i, 40_000 + (i + 1) % 50) for i in range(50)] + [(41_000 + i, 40_000 + rnd.randrange(50)) for i in range(500)]
    parent = dict(links)
    got = hierarchy(spark.createDataFrame(links, "node long, parent long"), paths=False).toPandas().set_index("node")
    assert len(got) == len(parent) and (got.loc[(got.index >= 40_000) & (got.index < 41_500), "loop_node"] == 40_000).all()
    for n in rnd.sample(sorted(x for x in parent if x < 40_000), 500) + [22_999]:
        depth, at = 0, n
        while parent.get(at) in parent:
            at, depth = parent[at], depth + 1
        assert (got.depth[n], got.root[n]) == (depth, at)
    assert got.n_descendants[0] == 11_999 and got.n_descendants[20_000] == 2999
