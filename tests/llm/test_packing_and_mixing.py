import random

import numpy as np
import pytest

from kmerloom.llm import mixing
from kmerloom.llm.mixing import _part, hypergeometric, mixture, permuted, reached_shares, shard_counts
from kmerloom.llm.packing import fill, pack
from kmerloom.llm.tokens import token_count, with_token_counts

SCHEMA = "id long, source string, n_tokens long, block int"


def items():
    rnd = random.Random(4)
    rows = [(i, rnd.choice(["big"] * 6 + ["mid", "mid", "small", None]), int(rnd.lognormvariate(5, 1.2)), 1) for i in range(3000)]
    return rows + [(5000, "big", 10_000, 1), (5001, "mid", 2048, 1), (5002, "mid", 0, 1), (5003, "mid", None, 1), (5004, "small", 4096, 1)]


@pytest.mark.parametrize("options", [{"block_tokens": 10**9}, {"block_tokens": 60_000}, {"block_tokens": 10**9, "block_rows": 500}])
def test_containers_hold_everything_once(spark, options):
    rows = items()
    got = pack(spark.createDataFrame(rows, SCHEMA), **options).toPandas()
    per = got.groupby("container_id")["n_tokens"].sum()
    assert per.max() <= 2048
    sizes = {i: n or 0 for i, _, n, _ in rows}
    assert got.groupby("id")["n_tokens"].sum().to_dict() == sizes
    pieces = got.groupby("id").size()
    assert all(pieces[i] == max(1, -(-n // 2048)) for i, n in sizes.items())
    assert len(per) <= 1.03 * sum(sizes.values()) / 2048 + 12 * (len(per.index.to_series().floordiv(1 << 32).unique()) > 1)


def test_null_and_repeated_ids(spark):
    rows = [(None, "a", 100, 1)] * 300 + [(7, "a", 100, 1)] * 50 + [(8, None, None, 1)]
    got = pack(spark.createDataFrame(rows, SCHEMA), block_rows=40).toPandas()
    assert len(got) == 351 and got.n_tokens.sum() == 35_000 and got["id"].isna().sum() == 300 and got.container_id.floordiv(1 << 32).nunique() > 5


def running(containers, shares, capacity):
    """The largest distance of a source from its share of what is packed, at the end of each container."""
    own, packed, out = dict.fromkeys(shares, 0), 0, []
    for window in containers:
        for item in window:
            own[item[0]] += item[1]
            packed += item[1]
        out.append(max(abs(own[s] - shares[s] * packed) for s in shares))
    return out


def test_running_shares_follow_the_targets():
    rnd = random.Random(2)
    stock = {s: [min(2048, max(1, int(rnd.lognormvariate(5, 1.3)))) for _ in range(n)] for s, n in (("a", 6000), ("b", 2500), ("c", 600), ("d", 60))}
    stock["b"] += [2048] * 120  # pieces of oversized items
    items = [(s, z, i, 0, 0) for s, zs in stock.items() for i, z in enumerate(zs)]
    total = sum(z for _, z, *_ in items)
    natural = {s: sum(zs) / total for s, zs in stock.items()}
    out = fill(items, natural, {}, 2048)
    assert sum(map(len, out)) == len(items) and total / len(out) / 2048 > 0.98
    assert max(running(out, natural, 2048)) <= 3 * 2048 and sorted(running(out, natural, 2048))[len(out) * 9 // 10] <= 2 * 2048
    # other targets: followed until the first source runs out
    wanted = {"a": 0.25, "b": 0.25, "c": 0.4, "d": 0.1}
    out = fill(items, wanted, {}, 2048)
    last = next(k for k in range(len(out)) if sum(1 for w in out[: k + 1] for x in w if x[0] == "d") == 60)
    assert last > 5 and max(running(out[:last], wanted, 2048)) <= 3 * 2048 and total / len(out) / 2048 > 0.98
    # a block starts with what the blocks before it left
    first = fill(items, natural, {"d": 4 * 2048.0}, 2048)[:6]
    assert sum(x[1] for w in first for x in w if x[0] == "d") > 2 * 2048


def test_mixture_reaches_shares_within_caps(spark):
    rnd = random.Random(5)
    rows = [(i, "abcd"[min(3, int(rnd.expovariate(1)))], rnd.randrange(1, 900), "x") for i in range(2500)] + [(9000, None, 50, "x"), (9001, "z", 50, "x")]
    sizes = spark.createDataFrame(rows, "id long, source string, n_tokens long, s string")
    targets = spark.createDataFrame([("a", 0.3, 1, 0), ("b", 0.3, 2, 0), ("c", 0.2, 3, 0), ("d", 0.1, 4, 0), ("none", 0.1, 2, 0)], "source string, target_share double, max_repeats int, n_tokens long")
    held = {k: sum(n for _, x, n, _ in rows if x == k) for k in "abcd"}
    mixed = mixture(sizes, targets, block_tokens=64, shard_slots=100, total_tokens=400_000)
    got = {r.source: r for r in reached_shares(mixed, targets).collect()}
    for s, share in zip("abcd", (0.3, 0.3, 0.2, 0.1)):
        assert abs(got[s].actual_share - share / 0.9) < 0.005 and got[s].most_repeats <= got[s].max_repeats
        assert abs(got[s].n_tokens - 400_000 * share / 0.9) < 300
    assert got["none"].n_tokens == 0
    out = mixed.collect()
    assert sum(len(r.spans) for r in out if r.epoch == 0 and r.source == "a") and len({(r.shard, r.slot) for r in out}) == len(out)
    assert all(sum(x.end_token - x.first_token for x in r.spans) == r.n_tokens <= 64 for r in out)
    n = {i: k for i, _, k, _ in rows}
    assert all(0 <= x.first_token < x.end_token <= n[x.id] for r in out for x in r.spans)
    # a source that holds too little for its share of all tokens comes up to its cap, the others keep their part of the budget
    wanted = dict(zip("abcd", ((0.2, 1), (0.2, 2), (0.2, 3), (0.4, 2))))
    targets = spark.createDataFrame([(k, share, cap) for k, (share, cap) in wanted.items()], "source string, target_share double, max_repeats int")
    whole = {r.source: r for r in reached_shares(mixture(sizes, targets, block_tokens=64, shard_slots=100), targets).collect()}
    most = {k: cap * held[k] for k, (_, cap) in wanted.items()}
    for k, (share, cap) in wanted.items():
        assert abs(whole[k].n_tokens - min(most[k], share * sum(held.values()))) <= 64 * cap + 1 and whole[k].n_tokens <= most[k]
    short = [k for k, (share, _) in wanted.items() if most[k] < share * sum(held.values())]
    assert "d" in short and all(whole[k].n_tokens == most[k] and whole[k].most_repeats == wanted[k][1] for k in short)


def test_draws_at_any_size():
    rng = np.random.default_rng(3)
    counts = np.array([3_000_000_000, 40_000, 7, 0, 900_000_000], np.int64)
    total = int(counts.sum())
    draws = np.array([_part(counts, total // 2, [k]) for k in range(60)])
    assert (draws.sum(1) == total // 2).all() and (draws >= 0).all() and (draws <= counts).all()
    deviation = np.sqrt(counts / 4 * (1 - counts / total))
    z = (draws - counts / 2)[:, deviation > 10] / deviation[deviation > 10]
    assert (np.abs(z.mean(0)) < 0.7).all() and (0.6 < z.std(0)).all() and (z.std(0) < 1.4).all()  # random, not rounded
    assert len({tuple(d) for d in draws}) == 60 and 0 < draws[:, 2].std()
    assert (_part(counts, 11, [1]) <= 11).all() and (_part(counts, total, [1]) == counts).all() and _part(counts, 0, [1]).sum() == 0
    # the inverted distribution is the generator's
    small = [hypergeometric(rng, 60, 40, 30) for _ in range(4000)]
    limit, mixing.GENERATOR_LIMIT = mixing.GENERATOR_LIMIT, 0
    try:
        inverted = [hypergeometric(rng, 60, 40, 30) for _ in range(4000)]
        assert [hypergeometric(rng, 5, 0, 3), hypergeometric(rng, 0, 5, 3), hypergeometric(rng, 5, 5, 0)] == [3, 0, 0]
    finally:
        mixing.GENERATOR_LIMIT = limit
    assert abs(np.mean(small) - np.mean(inverted)) < 0.2 and abs(np.std(small) - np.std(inverted)) < 0.15
    before = shard_counts(700_000, counts, 4096, 1)
    after = shard_counts(700_001, counts, 4096, 1)
    assert before[0].sum() == 4096 and (before[0] + before[1] == after[1]).all()


def test_draws_add_up():
    counts = np.array([1000, 37, 1, 0])
    parts = [shard_counts(i, counts, 50, 3) for i in range(-(-1038 // 50))]
    assert (sum(p for p, _ in parts) == counts).all() and all(p.sum() == 50 for p, _ in parts[:-1])
    assert all((b == sum((q for q, _ in parts[:i]), np.zeros(4, int))).all() for i, (_, b) in enumerate(parts))


@pytest.mark.parametrize("n", [1, 2, 3, 100, 1024, 5001])
def test_permutations(n):
    assert sorted(permuted(np.arange(n), n, 5).tolist()) == list(range(n))


def test_token_counts_are_the_tokenizers(spark):
    import base64

    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    exact = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rnd = random.Random(6)
    texts = ["".join(rnd.choice("ab  \n\n\t1.,é中\xa0　'sd") for _ in range(rnd.randrange(60))) for _ in range(3000)] + ["", " ", "\n\n", "a  ", "  a"]
    assert [token_count(t) for t in texts] == [len(exact.encode_ordinary(t)) for t in texts]
    docs = spark.createDataFrame([(1, "a b", " Sketch_Users "), (2, None, None), (3, "", "A  B")], "k int, t string, s string")
    assert [tuple(r) for r in with_token_counts(docs, "k", "t", "s").collect()] == [(1, "sketch-users", 2), (2, None, 0), (3, "a-b", 0)]


def test_empty(spark):
    empty = spark.createDataFrame([], "id long, source string, n_tokens long")
    assert pack(empty).count() == 0
    assert mixture(empty, spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")).count() == 0
