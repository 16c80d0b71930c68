"""Keys that are read from binary folders aren't broadcast, however small Spark takes them for."""

import pytest

from kmerloom.plans.files import QUERIES


def under_broadcasts(plan: str) -> str:
    """The parts of a plan's text that lie under a broadcast."""
    depth, kept = None, []
    for line in plan.splitlines():
        at = len(line) - len(line.lstrip(" :+-"))
        if depth is not None and at > depth:
            kept.append(line)
            continue
        depth = at if line.lstrip(" :+-").startswith("BroadcastExchange") else None
    return "\n".join(kept)


@pytest.mark.parametrize("name", ["files_older", "files_native"])
def test_keys_are_not_broadcast(spark, name):
    df = QUERIES[name](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "BroadcastExchange" in plan
    assert "MapInArrow" not in under_broadcasts(plan)
