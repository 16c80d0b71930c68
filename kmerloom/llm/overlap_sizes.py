"""Overlap sizes between many large sets from logarithmic register sketches.

Every set becomes 2^p registers: a hash of the identifier picks the register, which keeps the highest position of the
first one-bit in the rest. Registers are maxima, so they are aggregated before and after the shuffle and no set is
ever gathered. For two sets the registers are compared pairwise; the counts of smaller, equal and greater ones at
each value have a joint likelihood under a Poisson model in the sizes of both differences and the intersection (Ertl,
"New cardinality estimation algorithms for HyperLogLog sketches", 2017), which is maximised for all pairs of a batch
at once. The information matrix at the maximum gives a standard error.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from kmerloom.operators.skew import SALTS, hot_left_join
from kmerloom.session import Scratch

P = 12
#: Logarithm of the least size that the estimate takes for a part.
LEAST = -7.0


def hash_of(identifier: Column) -> Column:
    return F.xxhash64(identifier)


def register_sketches(rows: DataFrame, group: str, identifier: str, p: int = P) -> DataFrame:
    """(g, registers): one byte for each of the 2^p registers of every group, deflated. Null groups and identifiers don't count,
    repeated rows change nothing."""
    h = hash_of(F.col(identifier))
    rest = F.shiftleft(h, p).bitwiseOR(F.lit(1 << (p - 1)))  # the bit below stops the count at 64 - p zeros
    cells = (
        rows.where(F.col(group).isNotNull() & F.col(identifier).isNotNull())
        .select(F.col(group).alias("g"), F.shiftrightunsigned(h, 64 - p).cast("int").alias("i"), (F.lit(65) - F.length(F.bin(rest))).cast("tinyint").alias("r"))
        .groupBy("g", "i")
        .agg(F.max("r").alias("r"))
    )
    kind = rows.schema[group].dataType.simpleString()
    lists = cells.groupBy("g").agg(F.collect_list("i").alias("i"), F.collect_list("r").alias("r"))  # at most 2^p entries

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            out = []
            for i, r in zip(frame["i"], frame["r"], strict=True):
                registers = np.zeros(1 << p, np.uint8)
                registers[np.asarray(i, np.int64)] = np.asarray(r, np.uint8)
                out.append(zlib.compress(registers.tobytes(), 1))
            yield pd.DataFrame({"g": frame["g"], "registers": out})

    return lists.mapInPandas(pack, f"g {kind}, registers binary")


def inflated(registers: list[bytes | None], p: int) -> np.ndarray:
    """[sketch, register] of deflated sketches; none is an empty set."""
    empty = bytes(1 << p)
    return np.frombuffer(b"".join(empty if r is None else zlib.decompress(r) for r in registers), np.uint8).reshape(-1, 1 << p)


def register_counts(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """[pair, kind, value]: how many registers have a < b (by a and by b), a > b (by a and by b), a = b."""
    q = 64 - p
    pairs = len(a)
    at = np.arange(pairs)[:, None] * (q + 2)

    def histogram(values: np.ndarray, where: np.ndarray) -> np.ndarray:
        return np.bincount((at + values)[where], minlength=pairs * (q + 2)).reshape(pairs, q + 2)

    less, more = a < b, a > b
    return np.stack([histogram(a, less), histogram(b, less), histogram(a, more), histogram(b, more), histogram(a, ~(less | more))], axis=1)


def cardinality(registers: np.ndarray, p: int) -> np.ndarray:
    """Size of each set alone: linear counting while registers are empty, else the harmonic mean."""
    m, values = 1 << p, 66 - p
    h = np.bincount((np.arange(len(registers))[:, None] * values + registers).ravel(), minlength=len(registers) * values).reshape(-1, values)
    return _alone(h, m)


def _alone(h: np.ndarray, m: int) -> np.ndarray:
    raw = m * m * 0.7213 / (1 + 1.079 / m) / (h * 2.0 ** -np.arange(h.shape[1])).sum(1)
    linear = m * np.log(m / np.maximum(h[:, 0], 0.5))
    return np.where(linear < 2.5 * m, linear, raw)


def joint_estimate(counts: np.ndarray, p: int, rounds: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """Maximum-likelihood sizes [pair, (a only, b only, both)] and their standard errors, by damped scoring steps."""
    m, q = float(1 << p), 64 - p
    k = np.arange(q + 2)
    s = np.where(k <= q, 1 / (m * 2.0 ** np.minimum(k, q)), 0.0)  # P(register <= k) = exp(-size * s), 1 at the top
    below = np.where(k == 0, np.inf, 1 / (m * 2.0 ** np.maximum(k - 1.0, 0)))
    width = np.where(k == 0, 0, np.minimum(below, 1e300) - s)
    c = counts.astype(float)

    def single(size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """log P(register = k) for one size, exp(-size s) (1 - exp(-size width)); its slope and, negated, its curvature."""
        x = size[:, None]
        rest = np.exp(-x * width)
        gap = np.maximum(-np.expm1(-x * width), 1e-300)
        first = k == 0
        log = -x * s + np.where(first, 0, np.log(gap))
        slope = -s + np.where(first, 0, width * rest / gap)
        return log, slope, np.where(first, 0, (width / gap) ** 2 * rest)

    def equal(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b, x = a[:, None], b[:, None], x[:, None]
        ea, eb, ex = np.exp(-a * width), np.exp(-b * width), np.exp(-x * width)
        na, nb = -np.expm1(-a * width), -np.expm1(-b * width)
        first = k == 0
        gap = np.where(first, 1, np.maximum(-np.expm1(-x * width) + ex * na * nb, 1e-300))
        log = -(a + b + x) * s + np.log(gap)
        slopes = np.stack([-s + np.where(first, 0, part / gap) for part in (width * ex * ea * nb, width * ex * eb * na, width * ex * (1 - na * nb))], axis=-1)
        return log, slopes

    def evaluate(t: np.ndarray, with_slopes: bool):
        size = np.exp(t)
        a, b, x = size.T
        terms = [(c[:, 0], single(a + x), (0, 2)), (c[:, 1], single(b), (1,)), (c[:, 2], single(a), (0,)), (c[:, 3], single(b + x), (1, 2))]
        log_e, slope_e = equal(a, b, x)
        value = sum((n * log).sum(1) for n, (log, _, _), _ in terms) + (c[:, 4] * log_e).sum(1)
        if not with_slopes:
            return value, None, None
        gradient, information = np.zeros((len(t), 3)), np.zeros((len(t), 3, 3))
        for n, (_, slope, _), which in terms:
            first = (n * slope).sum(1)
            for i in which:
                gradient[:, i] += first
        gradient += (c[:, 4, :, None] * slope_e).sum(1)
        for n, (_, _, curvature), which in terms:
            second = (n * curvature).sum(1)
            for i in which:
                for j in which:
                    information[:, i, j] += second
        information += np.einsum("pk,pki,pkj->pij", c[:, 4], slope_e, slope_e)
        return value, gradient * size, information * size[:, :, None] * size[:, None, :]

    size_a, size_b = _alone(c[:, 0] + c[:, 2] + c[:, 4], 1 << p), _alone(c[:, 1] + c[:, 3] + c[:, 4], 1 << p)
    share = np.clip((c[:, 4].sum(1) - c[:, 4, 0]) / np.maximum(m - c[:, 4, 0], 1), 0.01, 0.99)
    both = np.minimum(size_a, size_b) * share
    t = np.log(np.maximum(np.stack([size_a - both, size_b - both, both], axis=1), 0.5))
    damp = np.full(len(t), 1e-3)
    value, gradient, information = evaluate(t, True)
    eye = np.eye(3)
    for _ in range(rounds):
        free = ~((t <= LEAST) & (gradient <= 0))  # what the data push to nothing stays there and moves nothing else
        matrix = information * (free[:, :, None] & free[:, None, :])
        matrix += (damp[:, None] * np.maximum(np.einsum("pii->pi", information), 1e-9) + ~free)[:, :, None] * eye
        step = np.linalg.solve(matrix + 1e-12 * eye, (gradient * free)[:, :, None])[:, :, 0]
        step *= np.minimum(1, 2 / np.maximum(np.abs(step).max(1), 1e-300))[:, None]
        trial = np.clip(t + step, LEAST, 60)
        new, new_gradient, new_information = evaluate(trial, True)
        better = new >= value
        moved = np.abs(trial - t).max(1)
        t[better], value[better], gradient[better], information[better] = trial[better], new[better], new_gradient[better], new_information[better]
        damp = np.where(better, np.maximum(damp / 4, 1e-9), damp * 8)
        if (moved[better] < 1e-4).all() and better.all():
            break
    sizes = np.exp(t)
    covariance = np.linalg.pinv(information)
    errors = sizes * np.sqrt(np.maximum(np.einsum("pii->pi", covariance), 0))
    sizes[(c[:, :4].sum((1, 2)) == 0) & (c[:, 4, 0] == m)] = 0
    return sizes, errors


def overlap_sizes(pairs: DataFrame, sketches: DataFrame, x: str = "x", y: str = "y", p: int = P) -> DataFrame:
    """(x, y, x_size, y_size, xny, xny_error): estimated sizes and overlap with its standard error.

    ``pairs`` holds any list of pairs of groups, nulls included; a group without sketch counts as empty (sizes of 0). Other
    columns are ignored.
    """
    pairs = pairs.select(x, y)
    one = sketches.select(F.col("g").alias("__gx"), F.col("registers").alias("__rx"))
    two = sketches.select(F.col("g").alias("__gy"), F.col("registers").alias("__ry"))
    met = pairs.join(one, pairs[x] == F.col("__gx"), "left").join(two, F.col(y) == F.col("__gy"), "left").drop("__gx", "__gy")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema.fields)

    batch = max(1, (1 << 23) >> p)  # 16 MB of registers

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for from_row in range(0, len(whole), batch):
                frame = whole.iloc[from_row : from_row + batch]
                sizes, errors = joint_estimate(register_counts(*(inflated(frame[c].tolist(), p) for c in ("__rx", "__ry")), p), p)
                yield frame.drop(columns=["__rx", "__ry"]).assign(x_size=sizes[:, 0] + sizes[:, 2], y_size=sizes[:, 1] + sizes[:, 2], xny=sizes[:, 2], xny_error=errors[:, 2])

    return met.mapInPandas(run, fields + ", x_size double, y_size double, xny double, xny_error double")


def contained_pairs(rows: DataFrame, group: str, identifier: str, least: float = 0.5, p: int = P, fine_p: int = 16, hot_groups: int = 1000, errors: float = 4.0, exact: bool = False) -> DataFrame:
    """(x, y, x_size, y_size, xny), x < y: pairs of groups that share at least ``least`` of the smaller one's identifiers, with estimated figures.

    1. Register sketches of all groups; each group's estimated size sets the rate at which its identifiers are sampled
       by hash (64 / least to twice as many, all of a group with fewer).
    2. A group's sample meets the rows with the same identifiers; pairs whose sample shares at least half of ``least``
       are candidates (a pair at the limit of 0.5 is missed with a chance of 2e-9). Identifiers in more than ``hot_groups`` groups
       count as shared without being met, where the rest of the sample can still decide; the others meet in salted parts.
    3. The joint estimate decides, where it is ``errors`` standard errors away from ``least``; pairs nearer to it are
       estimated again from 2^fine_p registers, and that estimate decides.

    So sizes and overlaps come from registers alone. With ``exact``, candidates that may reach ``least`` are counted by a join
    of their rows instead. Null groups and identifiers don't count, repeated rows count once, other columns are ignored.
    """
    scratch = Scratch(rows.sparkSession, "overlaps")
    kind = rows.schema[group].dataType.simpleString()
    facts = rows.where(F.col(group).isNotNull() & F.col(identifier).isNotNull()).select(F.col(group).alias("g"), F.col(identifier).alias("i"))
    sketches = scratch.keep(register_sketches(facts, "g", "i", p), "sketches")
    pairs = _candidates(scratch, facts, sketches, kind, least, p, hot_groups)
    limit = least * F.least("x_size", "y_size")
    first = scratch.keep(overlap_sizes(pairs, sketches, p=p).withColumn("clear", F.abs(F.col("xny") - limit) >= errors * F.col("xny_error")), "estimates")
    reached = F.col("xny") >= limit
    figures = ["x", "y", "x_size", "y_size", "xny"]
    if exact:
        return _counted(scratch, facts, first.where(~F.col("clear") | reached).select("x", "y")).where(reached).select(*figures)
    near = scratch.keep(first.where("not clear").select("x", "y"), "near")
    ids = near.select(F.explode(F.array("x", "y")).alias("id")).distinct()
    finer = register_sketches(facts.join(ids, facts["g"] == ids["id"], "left_semi"), "g", "i", fine_p)
    again = overlap_sizes(near, finer, p=fine_p)
    return first.where(F.col("clear") & reached).select(*figures).unionByName(again.where(reached).select(*figures))


def _candidates(scratch: Scratch, facts: DataFrame, sketches: DataFrame, kind: str, least: float, p: int, hot_groups: int) -> DataFrame:
    sample = math.ceil(64 / least)

    def rate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            if len(frame):
                size = cardinality(inflated(frame["registers"].tolist(), p), p)
                yield pd.DataFrame({"of": frame["g"], "rate": np.maximum(0, np.floor(np.log2(np.maximum(size, 1) / sample))).astype(np.int32)})

    rates = scratch.keep(sketches.mapInPandas(rate, f"of {kind}, rate int"), "rates")
    lowest = rates.agg(F.min("rate")).first()[0] or 0
    h = hash_of(F.col("i"))
    some = facts.where(h.bitwiseAND(F.lit((1 << lowest) - 1)) == 0)  # no group samples any other row
    sampled = scratch.keep(hot_left_join(some, rates, "g", "of").where(h.bitwiseAND(F.expr("shiftleft(1L, rate) - 1L")) == 0).select("g", "i").distinct(), "sampled")
    hits = scratch.keep(some.join(sampled.select("i").distinct(), "i", "left_semi").select("g", "i").distinct(), "hits")
    spread = hits.groupBy("i").agg(F.count("*").alias("groups")).where(F.col("groups") > hot_groups).select(F.col("i").alias("hot"))
    spread = scratch.keep(spread, "hot")

    def marked(side: DataFrame) -> DataFrame:
        return side.join(spread, side["i"] == spread["hot"], "left").withColumn("hot", F.col("hot").isNotNull())

    mine = marked(sampled)
    sums = mine.groupBy("g").agg(F.count("*").alias("n"), F.sum(F.col("hot").cast("int")).alias("n_hot")).withColumnRenamed("g", "of")
    limit = F.greatest(F.lit(1), F.floor(F.col("n") * (least / 2)).cast("int"))
    asked = mine.join(sums, mine["g"] == sums["of"]).withColumn("meets_hot", F.col("n_hot") >= limit).where("not hot or meets_hot")
    # what a group's hot identifiers may add to what is met
    asked = asked.select(F.col("g").alias("a"), "i", "hot", (limit - F.when(F.col("meets_hot"), 0).otherwise(F.col("n_hot"))).alias("needed"))
    salts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    asked = asked.withColumn("salt", F.explode(salts)).drop("hot")
    held = marked(hits).select(F.col("g").alias("b"), "i", F.when(F.col("hot"), F.pmod(F.xxhash64("g"), F.lit(SALTS)).cast("int")).otherwise(0).alias("salt"))
    shared = asked.join(held, ["i", "salt"]).where("a <> b").groupBy("a", "b", "needed").agg(F.count("*").alias("k"))
    return shared.where("k >= needed").select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).distinct()


def _counted(scratch: Scratch, facts: DataFrame, pairs: DataFrame) -> DataFrame:
    """(x, y, x_size, y_size, xny) of pairs, exactly."""
    facts = scratch.keep(facts.distinct(), "facts")
    pairs = scratch.keep(pairs, "pairs")
    sizes = scratch.keep(facts.groupBy("g").agg(F.count("*").alias("size")), "sizes")
    for of in ("x", "y"):
        pairs = pairs.join(sizes.select(F.col("g").alias(of), F.col("size").alias(f"{of}_size")), of)
    first = F.col("x_size") <= F.col("y_size")
    asked = pairs.select("x", "y", "x_size", "y_size", F.when(first, F.col("x")).otherwise(F.col("y")).alias("small"), F.when(first, F.col("y")).otherwise(F.col("x")).alias("large"))
    found = asked.join(facts.withColumnRenamed("g", "small"), "small").join(facts.withColumnRenamed("g", "large"), ["large", "i"])
    return found.groupBy("x", "y", "x_size", "y_size").agg(F.count("*").alias("xny"))
