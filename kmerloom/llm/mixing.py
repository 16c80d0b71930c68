"""Mixing sources to target weights.

Each source's records, one after the other in a hash order, are cut into blocks of ``block_tokens`` tokens. The mixture is
a sequence of slots in output shards. Its size is a budget of tokens; a source that holds too little for its share of it is used as
often as its cap allows. A shard's counts per source are drawn at random: multinomial, given the totals,
so that the shares come out and no cap is passed. The draw splits the shards in halves from the whole down, each half by
a seed of its own, so every shard finds its counts and the number of slots before it without seeing another. The t-th
slot of a source takes block permutation(t mod blocks) of epoch t div blocks, a keyed permutation of the source's block
indices, and blocks are joined by index.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from kmerloom.llm.similar_pairs import mix
from kmerloom.operators.skew import with_sum_before
from kmerloom.session import Scratch

SLOTS = "shard bigint, slot int, s int, epoch int, block_no bigint"


def permuted(x: np.ndarray, n: int, key: int) -> np.ndarray:
    """A keyed permutation of 0 .. n - 1 at x: four Feistel rounds over the next even number of bits, walked into range."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    out, todo = x.astype(np.uint64), np.arange(len(x))
    while len(todo):
        a, b = out[todo] >> np.uint64(half), out[todo] & low
        for r in range(4):
            a, b = b, a ^ (mix(b + np.uint64((key * 4 + r) & (2**63 - 1))) & low)
        out[todo] = (a << np.uint64(half)) | b
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


#: The generator draws from populations below this size.
GENERATOR_LIMIT = 1_000_000_000


def hypergeometric(rng: np.random.Generator, good: int, bad: int, take: int) -> int:
    """How many of ``take`` slots drawn out of good + bad are good ones, at any size.

    Beyond the generator's limit the distribution is inverted: probabilities follow from that of the mode by ratios of neighbours,
    over all values within twelve standard deviations (what lies outside is below 1e-30).
    """
    total = good + bad
    if total < GENERATOR_LIMIT:
        return int(rng.hypergeometric(good, bad, take)) if take else 0
    low, high = max(0, take - bad), min(good, take)
    if low == high:
        return low
    mode = min(high, max(low, (take + 1) * (good + 1) // (total + 2)))
    deviation = math.sqrt(take / total * good * (bad / total) * ((total - take) / max(total - 1, 1)))
    reach = int(12 * deviation) + 60
    low, high = max(low, mode - reach), min(high, mode + reach)
    x = np.arange(high - low, dtype=np.float64)  # from low + x to low + x + 1
    up = np.log(float(good - low) - x) + np.log(float(take - low) - x) - np.log(x + float(low + 1)) - np.log(x + float(bad - take + low + 1))
    log = np.concatenate([[0.0], np.cumsum(up)])
    weights = np.cumsum(np.exp(log - log[mode - low]))
    return low + int(np.searchsorted(weights, rng.random() * weights[-1], side="right"))


def _part(counts: np.ndarray, take: int, seed: list[int]) -> np.ndarray:
    """How many of each source are among ``take`` slots drawn of sum(counts)."""
    total, rng = int(counts.sum()), np.random.default_rng(seed)
    if total < GENERATOR_LIMIT:
        return rng.multivariate_hypergeometric(counts, take, method="marginals")
    part = np.zeros_like(counts)
    for s, n in enumerate(counts.tolist()):
        total -= n
        part[s] = hypergeometric(rng, n, total, take)
        take -= int(part[s])
    return part


@lru_cache(maxsize=4096)
def _left_half(low: int, high: int, counts: tuple[int, ...], take: int, seed: int) -> np.ndarray:
    """The draw for the left half of shards low .. high; the shards of a task share most of their way down."""
    return _part(np.array(counts, np.int64), take, [seed, low, high])


def shard_counts(shard: int, counts: np.ndarray, slots: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots of each source in a shard, and in all shards before it."""
    total = int(counts.sum())
    low, high, before = 0, -(-total // slots), np.zeros_like(counts)
    while high - low > 1:
        middle = (low + high) // 2
        left = _left_half(low, high, tuple(counts.tolist()), min(middle * slots, total) - low * slots, seed)
        if shard < middle:
            counts, high = left, middle
        else:
            counts, before, low = counts - left, before + left, middle
    return counts, before


def mixture(sizes: DataFrame, targets: DataFrame, block_tokens: int = 256, shard_slots: int = 4096, total_tokens: int | None = None, seed: int = 7) -> DataFrame:
    """(shard, slot, source, epoch, block_no, n_tokens, spans) of the mixture; spans are (id, first_token, end_token).

    ``sizes`` has id, source and n_tokens; ``targets`` source, target_share and max_repeats, one row per source. The
    budget is ``total_tokens``, by default all tokens that the listed sources hold, so the mixture grows with its input. Every source
    gives its share of the budget, or all it has max_repeats times over where that is less; the others aren't stretched to make up
    for it, as that would move the sources' weights further from their targets (``reached_shares`` tells what came out). Sources
    without tokens, target or a positive share are left out and the other shares scaled to 1; other columns are ignored. No block, so no token of a record, occurs more than
    max_repeats times; occurrences of a source's blocks differ by one at most. Without any source the result is empty.
    """
    kind = sizes.schema["id"].dataType.simpleString()
    spark = sizes.sparkSession
    scratch = Scratch(spark, "mixing")
    sizes = sizes.select("id", "source", "n_tokens")
    goals = targets.where("source is not null and target_share > 0 and max_repeats > 0").groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("cap"))
    known = scratch.keep(sizes.where("n_tokens > 0").join(F.broadcast(goals.select("source")), "source", "left_semi"), "sizes")
    # one row per listed source: as bounded as the list of targets
    held = [r.asDict() for r in known.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("records")).join(goals, "source").orderBy("source").collect()]
    if not held:
        return spark.createDataFrame([], f"shard bigint, slot int, source string, epoch int, block_no bigint, n_tokens bigint, spans array<struct<id:{kind},first_token:bigint,end_token:bigint>>")
    scale = sum(x["share"] for x in held)
    for x in held:
        x["blocks"] = -(-x["tokens"] // block_tokens)
    budget = sum(x["tokens"] for x in held) if total_tokens is None else total_tokens
    # a source's blocks are full but for its last
    counts = np.array([min(x["cap"] * x["blocks"], round(x["share"] / scale * budget * x["blocks"] / x["tokens"])) for x in held], np.int64)
    n_blocks = [x["blocks"] for x in held]

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard in batch["id"].tolist():
                own, before = shard_counts(shard, counts, shard_slots, seed)
                frames = []
                for s, (n, start) in enumerate(zip(own.tolist(), before.tolist(), strict=True)):
                    t = np.arange(start, start + n)
                    epoch, at, block = t // n_blocks[s], t % n_blocks[s], np.empty(n, np.int64)
                    for e in np.unique(epoch):
                        block[epoch == e] = permuted(at[epoch == e], n_blocks[s], int(seed * 1_000_003 + s * 1009 + e))
                    frames.append(pd.DataFrame({"s": np.full(n, s, np.int32), "epoch": epoch.astype(np.int32), "block_no": block}))
                out = pd.concat(frames)
                out.insert(0, "slot", np.random.default_rng([seed, shard]).permutation(len(out)).astype(np.int32))
                out.insert(0, "shard", shard)
                yield out

    shards = -(-int(counts.sum()) // shard_slots)
    slots = spark.range(0, shards, 1, max(1, min(shards, 10_000))).mapInPandas(draw, SLOTS)
    names = F.broadcast(spark.createDataFrame([(i, x["source"]) for i, x in enumerate(held)], "s int, source string"))
    blocks = _blocks(scratch, known.join(names, "source"), block_tokens, sum(x["records"] for x in held))
    # the optimiser takes the slots for as few as the shards that they are drawn from
    return slots.join(blocks.hint("merge"), ["s", "block_no"]).join(names, "s").select("shard", "slot", "source", "epoch", "block_no", "n_tokens", "spans")


def _blocks(scratch: Scratch, known: DataFrame, block_tokens: int, records: int) -> DataFrame:
    """(s, block_no, n_tokens, spans). Offsets within a source are prefix sums over buckets, then within a bucket."""
    buckets = max(1, records // 20_000)
    rows = known.select("s", "id", "n_tokens", F.xxhash64("id").alias("h"), F.pmod(F.xxhash64("id"), F.lit(buckets)).alias("bucket"))
    sums = rows.groupBy("s", "bucket").agg(F.sum("n_tokens").alias("n"))
    starts = with_sum_before(sums, "n", "bucket", ("s",), "start").select("s", "bucket", "start")
    within = Window.partitionBy("s", "bucket").orderBy("h", "id").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("inner", F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).join(starts, ["s", "bucket"])
    placed = placed.select("s", "id", "n_tokens", (F.col("start") + F.col("inner")).alias("from"))
    size = F.lit(block_tokens)
    pieces = placed.select("*", F.explode(F.expr(f"sequence(`from` div {block_tokens}, (`from` + n_tokens - 1) div {block_tokens})")).alias("block_no"))
    first = F.greatest(F.lit(0), F.col("block_no") * size - F.col("from"))
    end = F.least("n_tokens", (F.col("block_no") + 1) * size - F.col("from"))
    spans = pieces.select("s", "block_no", F.struct((F.col("from") + first).alias("at"), "id", first.alias("first_token"), end.alias("end_token")).alias("x"))
    grouped = spans.groupBy("s", "block_no").agg(F.sum(F.col("x.end_token") - F.col("x.first_token")).alias("n_tokens"), F.sort_array(F.collect_list("x")).alias("x"))
    return grouped.select("s", "block_no", "n_tokens", F.transform("x", lambda x: F.struct(x["id"].alias("id"), x["first_token"].alias("first_token"), x["end_token"].alias("end_token"))).alias("spans"))


def reached_shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, actual_share, n_tokens, most_repeats, max_repeats) for every row of ``targets``."""
    uses = mixed.groupBy("source", "block_no").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("uses"))
    sums = uses.groupBy("source").agg(F.sum("n").alias("n_tokens"), F.max("uses").alias("most_repeats"))
    everything = Window.partitionBy()
    out = targets.select("source", "target_share", "max_repeats").join(sums, "source", "left").fillna(0, ["n_tokens", "most_repeats"])
    return out.select("source", "target_share", (F.col("n_tokens") / F.greatest(F.sum("n_tokens").over(everything), F.lit(1))).alias("actual_share"), "n_tokens", "most_repeats", "max_repeats")
