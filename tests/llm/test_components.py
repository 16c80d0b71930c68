import random

import pytest

from kmerloom.llm import components
from kmerloom.llm.components import connected_groups
from kmerloom.llm.genomes import accession, fraction


def brute(pairs):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(up)}


def graph():
    rnd = random.Random(3)
    pairs = [(i, i + 1) for i in range(40)] + [(100 + i, 100 + (i + 1) % 17) for i in range(17)]  # a chain, a ring
    pairs += [(200, 201 + i) for i in range(30)]  # a star
    pairs += [(300 + i, 300 + j) for i in range(6) for j in range(i)]  # a clique
    pairs += [(300, 400), (400, 401), (401, 402), (402, 305), (403, 402), (404, 403)]  # chains on it
    pairs += [(1000 + rnd.randrange(120), 1000 + rnd.randrange(120)) for _ in range(200)]
    pairs += [(-5, -4), (-4, -9), (7, 7), (None, 3), (4, None), (5000, 5000)]
    pairs += [(b, a) for a, b in pairs[:25]] + pairs[30:60]
    rnd.shuffle(pairs)
    return pairs


@pytest.mark.parametrize("core_edges", [0, 200_000])
def test_against_union_find(spark, core_edges):
    df = spark.createDataFrame([(a, b, 1) for a, b in graph()], "qry long, ref long, vertex int")
    got = {r.vertex: r.group for r in connected_groups(df, "qry", "ref", core_edges).collect()}
    assert got == brute(graph())


def test_large_graph_with_hubs_rings_and_chains(spark):
    """Some 60,000 edges: two hubs with leaves and with chains, long chains, rings, trees that need several rounds, a random core."""
    rnd = random.Random(7)
    pairs = [(1, 10_000 + i) for i in range(15_000)] + [(2, 40_000 + i) for i in range(5000)] + [(40_000 + i, 50_000 + i) for i in range(5000)]
    pairs += [(100_000 + i, 100_001 + i) for i in range(6000)] + [(100_000, 106_000)]  # a ring
    pairs += [(120_000 + i, 120_001 + i) for i in range(7000)]  # a chain
    pairs += [(200_000 + i, 200_000 + i // 2) for i in range(2, 8000)]  # a tree
    pairs += [(300_000 + i, 300_000 + rnd.randrange(i)) for i in range(1, 4000)]  # a random tree
    pairs += [(400_000 + rnd.randrange(2500), 400_000 + rnd.randrange(2500)) for _ in range(6000)] + [(400_000, 1), (400_001, 103_000)]
    rnd.shuffle(pairs)
    names = list({x for p in pairs for x in p})
    code = dict(zip(names, rnd.sample(range(-(10**6), 10**6), len(names))))
    pairs = [(code[a], code[b]) for a, b in pairs]
    got = connected_groups(spark.createDataFrame(pairs, "a long, b long"), "a", "b", core_edges=100).toPandas()
    assert dict(zip(got["vertex"].tolist(), got["group"].tolist())) == brute(pairs) and got["vertex"].is_unique


def test_stripping_repeats_before_the_core_is_solved(spark, monkeypatch):
    """The one task of the core sees vertices of three neighbours or more only."""
    rnd = random.Random(9)
    pairs = {tuple(sorted((rnd.randrange(300), rnd.randrange(300)))) for _ in range(330)}
    pairs = [(a, b) for a, b in pairs if a != b]
    seen = []
    strip = components._strip_and_compress

    def watched(scratch, graph, size):
        out = strip(scratch, graph, size)
        seen.append((size, out[1], out[2] is None, components._both_ways(out[0]).groupBy("vertex").count().agg({"count": "min"}).first()[0]))
        return out

    monkeypatch.setattr(components, "_strip_and_compress", watched)
    got = {r.vertex: r.group for r in connected_groups(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()}
    assert got == brute(pairs) and len(seen) > 2 and seen[-1][2] and seen[-1][3] >= 3


def test_empty_and_no_links(spark):
    assert connected_groups(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0
    assert connected_groups(spark.createDataFrame([(1, 1), (None, 2)], "a long, b long"), "a", "b").count() == 0


def test_spellings(spark):
    names = ["genomes/batch01/ZQA_12.fna.gz", r"batch7\zqa-12.fna ", "ZQA_12", "none", None]
    df = spark.createDataFrame([(n, x) for n, x in zip(names, [95.0, 0.95, -1.0, float("nan"), None])], "n string, x double")
    assert [r[0] for r in df.select(accession(df.n)).collect()] == ["ZQA_12", "ZQA_12", "ZQA_12", None, None]
    assert [r[0] for r in df.select(fraction(df.x)).collect()] == [0.95, 0.95, None, None, None]
