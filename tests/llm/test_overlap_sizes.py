import numpy as np
import pytest

from kmerloom.llm.overlap_sizes import P, contained_pairs, joint_estimate, overlap_sizes, register_counts, register_sketches


def sets(seed=2):
    rng = np.random.default_rng(seed)
    base = rng.integers(-(2**62), 2**62, 6000).tolist()
    return {1: base[:3000], 2: base[1000:4000], 3: base[:60], 4: base[5000:], 5: base[2950:3050], 6: base[30:33]}


def rows(spark):
    data = [(g, x, "x") for g, xs in sets().items() for x in xs]
    data += data[:500] + [(None, 5, "x"), (1, None, "x"), (None, None, "x")]
    return spark.createDataFrame(data, "grp int, ctx long, registers string")


def brute(least):
    s = {g: set(x) for g, x in sets().items()}
    return {(a, b) for a in s for b in s if a < b and len(s[a] & s[b]) >= least * min(len(s[a]), len(s[b]))}


def test_contained_pairs(spark):
    found = contained_pairs(rows(spark), "grp", "ctx", 0.5).collect()
    true = {g: set(x) for g, x in sets().items()}
    assert brute(0.55) <= {(r.x, r.y) for r in found} <= brute(0.45)  # (1, 5) lies exactly at the limit
    for r in found:
        assert abs(r.xny - len(true[r.x] & true[r.y])) < 0.15 * len(true[r.x]) and abs(r.x_size - len(true[r.x])) <= 0.07 * len(true[r.x])


def test_exact_counts_are_an_option(spark):
    true = {g: set(x) for g, x in sets().items()}
    found = contained_pairs(rows(spark), "grp", "ctx", 0.5, exact=True).collect()
    assert {(r.x, r.y) for r in found} == brute(0.5) and all((r.xny, r.x_size) == (len(true[r.x] & true[r.y]), len(true[r.x])) for r in found)


@pytest.mark.parametrize("exact", [False, True])
def test_hot_identifiers_lose_no_pair(spark, exact):
    """Identifiers in every group, also as most of a group; limits far from the truth on both sides."""
    rng = np.random.default_rng(5)
    own = rng.integers(-(2**62), 2**62, (40, 400)).tolist()
    everywhere = rng.integers(-(2**62), 2**62, 300).tolist()
    data = {g: xs[:300] + everywhere[: 20 * (g % 16)] for g, xs in enumerate(own)}
    data |= {100 + g: data[g][: 60 + 10 * g] for g in range(20)}
    s = {g: set(x) for g, x in data.items()}
    ratio = {(a, b): len(s[a] & s[b]) / min(len(s[a]), len(s[b])) for a in s for b in s if a < b}
    df = spark.createDataFrame([(g, x) for g, xs in data.items() for x in xs], "g int, c long")
    found = {(r.x, r.y) for r in contained_pairs(df, "g", "c", 0.5, hot_groups=5, exact=exact).collect()}
    margin = 0 if exact else 0.05
    assert {k for k, v in ratio.items() if v >= 0.5 + margin} <= found <= {k for k, v in ratio.items() if v >= 0.5 - margin}


def test_more_registers_where_the_estimate_is_near_the_limit(spark):
    rng = np.random.default_rng(6)
    base = rng.integers(-(2**62), 2**62, 60_000).tolist()
    data = {1: base[:40_000], 2: base[38_000:42_300], 3: base[38_300:41_800]}  # 46.5 % and 48.6 % of the smaller are in 1
    s = {g: set(x) for g, x in data.items()}
    df = spark.createDataFrame([(g, x) for g, xs in data.items() for x in xs], "g int, c long")
    for least in (0.42, 0.53):
        want = {(a, b) for a in s for b in s if a < b and len(s[a] & s[b]) >= least * min(len(s[a]), len(s[b]))}
        assert {(r.x, r.y) for r in contained_pairs(df, "g", "c", least).collect()} == want


def test_estimates_are_close(spark):
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 4), (1, 99), (None, 1)], "x int, y int")
    got = {(r.x, r.y): r for r in overlap_sizes(pairs, register_sketches(rows(spark), "grp", "ctx")).collect()}
    assert abs(got[1, 2].xny - 2000) < 300 and abs(got[1, 2].x_size - 3000) < 150
    assert abs(got[1, 3].xny - 60) < 30 and got[1, 4].xny < 60
    assert got[1, 99].y_size < 1 and got[None, 1].x_size < 1


def test_estimator_on_equal_and_empty_sets():
    registers = np.zeros((2, 1 << P), np.uint8)
    registers[0, :50] = 3
    sizes, _ = joint_estimate(register_counts(registers, registers, P), P)
    assert abs(sizes[0, 2] - 50) < 5 and sizes[0, 0] < 1 and sizes[1].sum() == 0


def test_empty(spark):
    assert contained_pairs(spark.createDataFrame([], "g int, c long"), "g", "c").count() == 0
