"""Filling fixed-capacity containers with items, controlled by mixture.

Items wait in one queue per source, whole or as the pieces of what exceeds the capacity. A source's deficit is its target share of
all tokens packed so far less its own. Every item of every container (window) comes from the source with the largest deficit
that has one to fit, and is the largest that fits; in the last quarter of a container, sources whose deficit is at most a
capacity below the largest may go first if their item leaves less space. Deficits carry over from window to window, and from
partition to partition: items are spread over blocks by a hash of their id, and a block starts with the deficits that the
blocks before it leave, running sums over a table of one row per block and source. Tokens and rows of a block are
bounded by construction, whatever share of the rows one source has.
"""

from __future__ import annotations

import math
from bisect import bisect_right

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from kmerloom.operators.skew import with_sum_before
from kmerloom.session import Scratch


def fill(items: list[tuple[str, int, int, int, int]], shares: dict[str, float], deficits: dict[str, float], capacity: int) -> list[list[tuple]]:
    """Containers of (source, size, *rest) items of at most ``capacity``, by deficit round-robin."""
    queues: dict[str, list[tuple]] = {}
    for item in sorted(items, key=lambda x: x[1:]):
        queues.setdefault(item[0], []).append(item)
    sizes = {s: [x[1] for x in queue] for s, queue in queues.items()}
    own, packed, out = {s: -deficits.get(s, 0.0) for s in queues}, 0, []
    while queues:
        free, window = capacity, []
        while True:
            fitting = []
            for s in queues:
                at = bisect_right(sizes[s], free) - 1
                if at >= 0:
                    fitting.append((shares.get(s, 0.0) * packed - own[s], sizes[s][at], s, at))
            if not fitting:
                break
            best = max(fitting)
            if 4 * free <= capacity:
                best = max((x for x in fitting if x[0] >= best[0] - capacity), key=lambda x: (x[1], x[0]))
            _, size, s, at = best
            window.append(queues[s].pop(at))
            del sizes[s][at]
            if not queues[s]:
                del queues[s]
            free -= size
            own[s] += size
            packed += size
        out.append(window)
    return out


def pack(sizes: DataFrame, capacity: int = 2048, targets: dict[str, float] | None = None, block_tokens: int = 4_000_000, block_rows: int = 100_000) -> DataFrame:
    """(container_id, slot, id, piece_no, first_token, n_tokens, source): every item of ``sizes`` in a container.

    ``sizes`` has id, source and n_tokens. Items up to ``capacity`` stay whole. A larger one is cut into pieces of ``capacity``
    and a rest, which wait in the source's queue like items; first_token says where a piece starts in it. Items of null or no
    size take no space and go along in any container. ``targets`` maps sources to shares; by default each source's share of all
    tokens, so that all queues run out together. Every item is packed: where other targets exhaust a source, the rest goes on
    without it. A null source is a source of its own, shown as an empty name. Repeated ids are items of their own. An empty input
    gives an empty result.
    """
    kind = sizes.schema["id"].dataType.simpleString()
    scratch = Scratch(sizes.sparkSession, "packing")
    plain = sizes.select("id", F.coalesce("source", F.lit("")).alias("source"), F.greatest(F.coalesce("n_tokens", F.lit(0)), F.lit(0)).cast("bigint").alias("n_tokens"))
    totals = plain.agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows")).first()
    total = totals.tokens or 0
    blocks = max(1, math.ceil(total / block_tokens), math.ceil(totals.rows / block_rows))
    spread = F.when(F.col("id").isNull(), F.xxhash64(F.monotonically_increasing_id())).otherwise(F.xxhash64("id"))
    rows = scratch.keep(plain.withColumn("block", F.pmod(spread, F.lit(blocks)).cast("int")), "items")
    sums = scratch.keep(rows.groupBy("source", "block").agg(F.sum("n_tokens").alias("n")), "sums")
    if targets is None:
        shares = sums.groupBy("source").agg((F.sum("n") / F.lit(max(total, 1))).alias("share"))
    else:
        shares = sums.sparkSession.createDataFrame(list(targets.items()) or [("", 0.0)], "source string, share double")
    state = _block_state(scratch, sums, shares)
    schema = f"container_id bigint, slot int, id {kind}, piece_no int, first_token bigint, n_tokens bigint, source string"

    def place(key: tuple, items: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        shares = dict(zip(state["source"], state["share"], strict=True))
        deficits = dict(zip(state["source"], state["deficit"], strict=True))
        waiting = []
        for at, (source, size) in enumerate(zip(items["source"], items["n_tokens"].tolist(), strict=True)):
            pieces = max(0, -(-size // capacity) - 1)
            waiting += [(source, capacity, at, k, k * capacity) for k in range(pieces)]
            waiting.append((source, size - pieces * capacity, at, pieces, pieces * capacity))
        ids, out = items["id"].tolist(), []
        for n, window in enumerate(fill(waiting, shares, deficits, capacity)):
            out += [((int(key[0]) << 32) + n, slot, ids[at], piece, first, size, source) for slot, (source, size, at, piece, first) in enumerate(window)]
        return pd.DataFrame(out, columns=["container_id", "slot", "id", "piece_no", "first_token", "n_tokens", "source"])

    return rows.groupBy("block").cogroup(state.groupBy("block")).applyInPandas(place, schema)


def _block_state(scratch: Scratch, sums: DataFrame, shares: DataFrame) -> DataFrame:
    """(block, source, share, deficit): what the blocks before leave each source short of its share."""
    whole = with_sum_before(sums.groupBy("block").agg(F.sum("n").alias("all")), "all", "block", name="all_before")
    known = with_sum_before(sums.join(shares, "source", "left").fillna(0.0, ["share"]), "n", "block", ("source",), "own_before")
    return scratch.keep(known.join(whole, "block").select("block", "source", "share", (F.col("share") * F.col("all_before") - F.col("own_before")).alias("deficit")), "state")
