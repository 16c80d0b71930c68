"""A context that all genomes hold with thousands of objects: billions of comparisons, if each object met each."""

import random
import time

import numpy as np
import pandas as pd
import pytest

from kmerloom.functions.contexts import compared, differing, nearest
from kmerloom.plans.genomes import QUERIES

GENOMES, OBJECTS = 30, 3000


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Half of the genomes hold the same objects, the others those with three bases changed; 8.1e9 pairs of objects."""
    at = tmp_path_factory.mktemp("hot")
    own = np.array(random.Random(5).sample(range(1 << 14), OBJECTS)) << 6
    rows = [pd.DataFrame({"ctxgid": (7 << 20) | 50 * g, "obj": own | (21 if g % 2 else 0)}) for g in range(GENOMES)]
    table = pd.concat(rows).assign(cnt=1, loaded_at=pd.Timestamp("2024-01-01")).astype({"ctxgid": "int64", "obj": "int32", "cnt": "int32"})
    spark.createDataFrame(table).write.parquet(f"{at}/sketch.parquet")
    return str(at)


@pytest.mark.parametrize("name", ["ani_direct_ranked", "ani_mash_if_far", "ani_ranked", "ani_aaf", "ani_detail", "ani_naive", "ani_unassembled", "ani_aaf_if_far", "ani_direct", "ani_mash"])
def test_hot_context(spark, folder, name):
    began = time.time()
    got = QUERIES[name](spark, folder).collect()
    assert time.time() - began < 120
    alike = [r for r in got if r.q % 100 == r.r % 100]
    assert len(alike) == len({(r.q, r.r) for r in alike}) == GENOMES**2 // 2
    if "ranked" in name:
        assert {r.xny_ctx for r in got} == {OBJECTS} and {r.place for r in alike} == set(range(1, GENOMES // 2 + 1))
        return
    assert {(r.xny_ctx, r.n_diff_obj, r.n_diff_obj_section, r.n_mut2_ctx, r.af_qry, r.af_ref, r.ani) for r in alike} == {(OBJECTS, 0, 0, 0, 1.0, 1.0, 1.0)}
    assert {(r.xny_ctx, r.n_diff_obj, r.n_diff_obj_section, r.n_mut2_ctx) for r in got if r.q % 100 != r.r % 100} <= {(OBJECTS, OBJECTS, 3 * OBJECTS, OBJECTS)}


def test_nearest_is_least_of_all():
    rng = np.random.default_rng(2)
    for bits in (8, 20, 40):
        own, objs = np.unique(rng.integers(0, 1 << bits, 400)), rng.integers(0, 1 << bits, 5000)
        assert (nearest(own, objs) == differing(objs[None, :] ^ own[:, None]).min(axis=0)).all()


@pytest.mark.parametrize("limits", [{}, {"GROUP_PAIRS": 10, "TABLE_PAIRS": 5, "STEP": 50}, {"GROUP_PAIRS": 1, "STEP": 1}])
def test_compared_as_one_by_one(monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(f"kmerloom.functions.contexts.{name}", value)
    rng = np.random.default_rng(3)
    queries, refs = ((rng.integers(a, b, n), rng.integers(-3, 4, n), rng.integers(0, 1 << 6, n)) for a, b, n in ((0, 9, 200), (5, 20, 300)))
    own, held = (set(zip(*(x.tolist() for x in side), strict=True)) for side in (queries, refs))
    want = {}
    for r, ctx, obj in held:
        for q in {q for q, c, _ in own if c == ctx}:
            d = min(int(differing(np.array([o ^ obj]))[0]) for p, c, o in own if (p, c) == (q, ctx))
            want.setdefault((q, r), []).append(d)
    size = lambda side, g: sum(x[0] == g for x in side)
    rows = {(q, r, len(ds), sum(d > 0 for d in ds), sum(ds), sum(d > 1 for d in ds), size(own, q), size(held, r)) for (q, r), ds in want.items()}
    got = list(zip(*(x.tolist() for x in compared(queries, refs)), strict=True))
    assert len(got) == len(rows) and set(got) == rows
