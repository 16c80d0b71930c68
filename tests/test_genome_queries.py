import math
import random

import pytest

from kmerloom.operators import distance
from kmerloom.plans import genomes


def sketches(seed, ids):
    """Families of genomes that share keys; ids apart from the families."""
    rnd = random.Random(seed)
    out = {}
    for g in ids:
        family = rnd.randrange(6)
        out[g] = {family * 1000 + rnd.randrange(60) for _ in range(rnd.randrange(1, 40))} | {rnd.randrange(10**4, 10**6) for _ in range(rnd.randrange(30))}
    return out


def greedy(data, limit, k):
    kept = []
    for g in sorted(data):
        near = False
        for x in kept:
            n = len(data[g] & data[x])
            j = n / len(data[g] | data[x])
            near |= n > 0 and math.log((1 + j) / (2 * j)) / k < limit
        if not near:
            kept.append(g)
    return {g: g in kept for g in data}


def write(spark, folder, data, cnt=lambda g, x: 1):
    """The sketch table of the queries: the genome in the low bits of the context, small objects."""
    rows = [(((x >> 10) << 20) | g, x & 1023, cnt(g, x)) for g, xs in data.items() for x in xs]
    spark.createDataFrame([*rows, *rows[:20], (None, 1, 1)], "ctxgid long, obj int, cnt int").write.parquet(f"{folder}/sketch.parquet")


def test_dereplicated_settles_every_genome(spark, tmp_path):
    data = sketches(1, range(7, 87))  # 50 alone is divisible by 50
    write(spark, tmp_path, data)
    rows = genomes.dereplicated(spark, str(tmp_path)).collect()
    assert len(rows) == len(data) and {r.genome_id: r.kept for r in rows} == greedy(data, 0.2, 32)


@pytest.mark.parametrize("options", [{"block": 1}, {"block": 20}, {"block": 64, "block_rows": 3000}])
def test_dereplication_by_blocks(spark, options):
    data = sketches(2, range(60))
    keys = spark.createDataFrame([(g, x) for g, xs in data.items() for x in xs], "genome_id long, ctxobj long")
    want = greedy(data, 0.08, 32)
    assert 5 < sum(want.values()) < 55
    rows = distance.dereplicate_sketches(keys.where("genome_id < 6") if options["block"] == 1 else keys, 0.08, 32, **options).collect()
    assert {r.genome_id: r.kept for r in rows} == {g: x for g, x in want.items() if options["block"] > 1 or g < 6} and len(rows) == len({r.genome_id for r in rows})


def vectors(data, cnt):
    """Brute force of composition and abundance vectors: {sample: {reference: pct}}."""
    out = {}
    for q, mine in data.items():
        for r, keys in data.items():
            a = sorted(cnt(q, x) for x in mine & keys)
            m = len(a)
            if m > 7 and a[m // 2] > 1:
                first = int(m * 0.98)
                upper = sum(a[i] for i in range(first, m) if i < m * 0.99)
                out.setdefault(q, {})[r] = upper / int(m * 0.99 - first + 1) - 1
    return {q: {r: x * 100 / sum(v.values()) for r, x in v.items()} for q, v in out.items() if sum(v.values())}


def test_vector_search_asks_all_samples(spark, tmp_path):
    data = sketches(3, range(40, 104))  # 50 and 100 are asked
    cnt = lambda g, x: 2 + (g * x) % 7
    write(spark, tmp_path, data, cnt)
    want = vectors(data, cnt)
    got = {(r["sample"], r.ref_idx): r.pct for r in genomes.abundance_vectors(spark, str(tmp_path)).collect()}
    assert got == pytest.approx({(q, r): x for q, v in want.items() for r, x in v.items()}, abs=2e-6) and len(want) > 30
    for name, measure in (
        ("l1", lambda a, b: sum(abs(a.get(i, 0) - b.get(i, 0)) for i in a.keys() | b.keys())),
        ("l2", lambda a, b: math.sqrt(sum((a[i] - b[i]) ** 2 for i in a.keys() & b.keys()))),
        ("cosine", lambda a, b: sum(a[i] * b[i] for i in a.keys() & b.keys()) / math.hypot(*a.values()) / math.hypot(*b.values())),
    ):
        got = {(r.q, r["sample"]): r.measure for r in genomes.QUERIES[f"vector_search_{name}"](spark, str(tmp_path)).collect()}
        assert got == pytest.approx({(q, s): measure(want[q], want[s]) for q in (50, 100) if q in want for s in want if want[q].keys() & want[s].keys()}, abs=2e-6)
        assert {s for _, s in got} - {50, 100}
