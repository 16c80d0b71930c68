"""ANI hands genomes to numpy as packed rows, and numpy gives back no more than a query asks for."""

import numpy as np
import pyarrow as pa
import pytest

from kmerloom.functions import contexts
from kmerloom.operators import ani
from kmerloom.plans.genomes import QUERIES


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("packed")
    rows = [(((x % 7) << 20) | 50 * g, x + g % 3, 1) for g in range(1, 5) for x in range(40)]
    spark.createDataFrame(rows, "ctxgid long, obj int, cnt int").write.parquet(f"{at}/sketch.parquet")
    return str(at)


@pytest.mark.parametrize("name", ["ani_ranked", "ani_direct_ranked"])
def test_ranking_takes_what_it_needs(spark, folder, name):
    plan = QUERIES[name](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    after, before = plan.split("FlatMapCoGroupsInArrow")
    assert "round(" not in after and "n_mut2_ctx" not in before.split("\n")[0]
    assert before.count("Generate explode") == before.count("MapInArrow") == 2  # copies are made of packed rows
    got = QUERIES[name](spark, folder).collect()
    assert len(got) == 16 and all(sorted(r.place for r in got if r.q == q) == [1, 2, 3, 4] for q in (50, 100, 150, 200))


@pytest.mark.parametrize("parts", [1, 7])
def test_packed_rows_come_back(spark, parts):
    rng = np.random.default_rng(6)
    rows = list(zip(*(rng.integers(-a, a, 3000).tolist() for a in (20, 1 << 62, 1 << 40)), strict=True))
    got = ani.packed(spark.createDataFrame(rows, "genome_id long, ctx long, obj long").repartition(3), parts).toArrow()
    assert sorted(zip(*ani.unpacked(got).tolist(), strict=True)) == sorted(rows)
    where = [(x, part) for part, data in zip(got["part"].to_pylist(), got["data"].to_pylist(), strict=True) for x in np.frombuffer(data, np.int64).reshape(3, -1)[0].tolist()]
    assert len(set(where)) == len(dict(where)) == len({r[0] for r in rows}) and {p for _, p in where} <= set(range(parts))
    assert ani.unpacked(got.slice(0, 0)).shape == (3, 0)


def test_rows_are_gathered_some_at_a_time(monkeypatch):
    monkeypatch.setattr(ani, "PACKED_ROWS", 250)
    batches = [pa.record_batch({"a": np.arange(100), "b": np.arange(100) + 100 * i}) for i in range(7)]
    got = list(ani._gathered(batches, ["a", "b"]))
    assert [x.shape[1] for x in got] == [300, 300, 100] and np.concatenate(got, 1)[1].tolist() == list(range(700))


@pytest.mark.parametrize("low, high", [(0, 1 << 20), (-5, 1 << 20), (0, 1 << 40)])
def test_order_is_that_of_all_columns(low, high):
    columns = np.random.default_rng(8).integers(low, high, (3, 500)) // (high // 4)
    columns[2] = np.random.default_rng(9).integers(low, high, 500)
    by_one, by_all = contexts._order(*columns), np.lexsort(columns[::-1])
    assert (columns[:, by_one] == columns[:, by_all]).all()
    assert len(contexts._order(*columns[:, :0])) == 0


@pytest.mark.parametrize("bits", [19, 3])
def test_runs_are_summed(monkeypatch, bits):
    monkeypatch.setattr(contexts, "RUN_BITS", bits)
    contexts._packed.cache_clear()
    d, starts = np.random.default_rng(7).integers(0, 33, 100).astype(np.uint8), np.array([0, 1, 8, 60])
    runs = np.split(d.astype(int), starts[1:])
    assert [x.tolist() for x in contexts._summed(d, starts, 52)] == [[int((r > 0).sum()) for r in runs], [int(r.sum()) for r in runs], [int((r > 1).sum()) for r in runs]]
    contexts._packed.cache_clear()


def test_no_rows_on_a_side():
    none, some = (np.empty((3, 0), np.int64), np.array([[1, 1], [0, 2], [5, 6]]))
    for left, right in ((none, some), (some, none), (none, none), (some, some + [[0], [7], [0]])):
        assert [len(x) for x in contexts.compared(left, right)] == [0] * 8


def test_pairs_are_finished_some_at_a_time(monkeypatch):
    monkeypatch.setattr(contexts, "STEP", 500)
    rng = np.random.default_rng(10)
    queries, refs = (np.stack([rng.integers(0, n, 2000), rng.integers(0, 30, 2000), rng.integers(0, 64, 2000)]) for n in (40, 60))
    seen = []

    def finish(*columns):
        seen.append(len(columns[0]))
        return [columns[0], columns[1] * 2, columns[2] / 2]

    got, want = contexts.compared(queries, refs, finish=finish), contexts.compared(queries, refs)
    assert max(seen) < sum(seen) / 10 and sum(seen) == len(want[0]) > 1000
    assert [x.tolist() for x in got] == [x.tolist() for x in (want[0], want[1] * 2, want[2] / 2)]
