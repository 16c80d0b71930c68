"""ANI is reckoned where pairs are made: what the JVM does with a pair must stay small enough to be compiled."""

import numpy as np
import pytest

from kmerloom.functions import distances, scalars
from kmerloom.plans.genomes import QUERIES

#: HotSpot never compiles a method with more bytes than this.
HUGE = 8000
#: Distances as columns: logarithms, powers, the intercept of the regression.
RECKONED = ("LOG(", "ln(", "POWER(", str(scalars.COEFFICIENTS[0])[:8])


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("scored")
    rows = [(((x % 7) << 20) | 50 * g, x + g % 3, 1) for g in range(1, 5) for x in range(40)]
    spark.createDataFrame(rows, "ctxgid long, obj int, cnt int").write.parquet(f"{at}/sketch.parquet")
    return str(at)


@pytest.mark.parametrize("name", ["ani_ranked", "ani_aaf", "ani_detail", "ani_naive", "ani_unassembled", "ani_aaf_if_far", "ani_direct", "ani_mash"])
def test_pairs_come_scored(spark, folder, name):
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else code is generated later
    try:
        execution = QUERIES[name](spark, folder)._jdf.queryExecution()
        codes = spark._jvm.org.apache.spark.sql.execution.debug.package.codegenStringSeq(execution.executedPlan())
        assert max(codes.apply(i)._3().maxMethodCodeSize() for i in range(codes.length())) < HUGE
        after = execution.optimizedPlan().toString().split("FlatMapCoGroupsInArrow")[0]
        assert "Filter" not in after and not [x for x in RECKONED if x in after]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_arrays_as_columns(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(1, 500, 300)
    d = rng.integers(0, x + 1) * (rng.random(300) < 0.9).astype(int)
    m = rng.integers(0, d + 1)
    s, a, b = d + m * 2, x + rng.integers(0, 900, 300), x + rng.integers(0, 900, 300)
    rows = spark.createDataFrame([tuple(map(int, r)) for r in zip(x, d, s, m, a, b, strict=True)], "x long, d long, s long, m long, a long, b long")
    cols = scalars.regression_distance(rows.x, rows.d, rows.s, rows.m), scalars.naive_distance(rows.x, rows.d, rows.s), scalars.mash_distance(rows.x, rows.a, rows.b, 22), scalars.aaf_distance(rows.x, rows.a, rows.b, 22)
    want = np.array([tuple(r) for r in rows.select(*cols).collect()])
    got = distances.model(x, d, s, m), distances.naive(x, d, s), distances.mash(x, a, b, 22), distances.aaf(x, a, b, 22)
    np.testing.assert_allclose(np.stack(got, 1), want, rtol=1e-9, atol=1e-12)


@pytest.mark.parametrize("name", ["ani_unassembled", "ani_mash", "ani_detail"])
def test_pairs_come_rounded(spark, folder, name):
    plan = QUERIES[name](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert "round(" not in plan.split("FlatMapCoGroupsInArrow")[0]


def test_halves_go_away_from_zero():
    assert distances.rounded(np.float32([1 / 64, 3 / 64, -1 / 64, -1e-9, 0.1]), 5).tolist() == [0.01563, 0.04688, -0.01563, 0.0, 0.1]
    assert not np.signbit(distances.rounded(np.array([-1e-9]), 5)).any()
