import random

import pytest

from kmerloom.llm.similar_pairs import class_links, missed, similar_classes, similar_pairs, trees_needed


def sets():
    rnd = random.Random(8)
    out = {}
    for family in range(12):
        base = rnd.sample(range(10**12), rnd.choice([2, 3, 5, 40, 200]))
        for i in range(6):
            keep = [x for x in base if rnd.random() < rnd.choice([1, 0.9, 0.75])] or base[:1]
            out[family * 10 + i] = keep + [rnd.randrange(10**12) for _ in range(rnd.randrange(len(base) // 3 + 1))] + [7] * (family % 3 == 0)
    out[900], out[901], out[902] = out[0], out[0], [1, 2, 3, 4]
    out[903] = [1, 2]  # exactly half
    return out


def brute(threshold):
    s = {g: set(x) for g, x in sets().items()}
    return {(a, b): len(s[a] & s[b]) / len(s[a] | s[b]) for a in s for b in s if a < b and len(s[a] & s[b]) >= threshold * len(s[a] | s[b])}


@pytest.mark.parametrize("options", [{}, {"node_limit": 3, "max_depth": 3}, {"chunk_values": 50}])
def test_against_brute_force(spark, options):
    data = [(g, x, 0.0) for g, xs in sets().items() for x in xs]
    data += data[:100] + [(None, 1, 0.0), (5, None, 0.0), (777, None, 0.0)]
    got = similar_pairs(spark.createDataFrame(data, "r long, v long, size double"), "r", "v", 0.5, **options)
    assert {(r.a, r.b): round(r.similarity, 9) for r in got.collect()} == {k: round(v, 9) for k, v in brute(0.5).items()}


def test_classes_of_equal_sets(spark):
    s = {g: frozenset(x) for g, x in sets().items()}
    rep = {g: min(h for h in s if s[h] == s[g]) for g in s}
    links = {r: sum(2 * len(s[r] & s[o]) >= len(s[r] | s[o]) for o in set(rep.values()) if o != r) for r in rep.values()}
    pairs, members = similar_classes(spark.createDataFrame([(g, x) for g, xs in sets().items() for x in xs], "r long, v long"), "r", "v", 0.5)
    assert {(r.r, r.rep, r.links) for r in class_links(pairs, members).collect()} == {(g, rep[g], links[rep[g]]) for g in s}
    assert rep[900] == rep[901] == rep[0] == 0


def test_empty(spark):
    assert similar_pairs(spark.createDataFrame([], "r long, v long"), "r", "v").count() == 0


def test_trees_follow_the_depth():
    assert missed(0.5, 0.5, 20, 128, 6) > 1e-3  # what 20 trees and 128 coordinates lose
    for threshold in (0.3, 0.5, 0.8):
        for depth in (1, 3, 6):
            assert missed(threshold, threshold, trees_needed(threshold, 256, depth), 256, depth) <= 5e-6


def test_no_pair_at_the_threshold_is_lost_after_six_splits(spark):
    # a pair of 2 n and 2 n + 1 has 20 of 40 values in common; nodes of two are split to the end
    rows = spark.range(8000).selectExpr("id AS r", "explode(sequence(0, 29)) AS i").selectExpr("r", "IF(i < 20, xxhash64(r div 2, i), xxhash64(r, i, 'own')) AS v")
    got = similar_pairs(rows, "r", "v", 0.5, node_limit=1)
    assert got.where("similarity = 0.5 AND b = a + 1 AND a % 2 = 0").count() == got.count() == 4000
