"""Composition of samples by the abundances of the keys that they share with reference genomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from kmerloom.operators.skew import SALTS, hot_left_join, list_block
from kmerloom.session import Scratch

LEAST_SHARED = 6
LOW, HIGH = 0.98, 0.99


def shared_abundances(samples: DataFrame, refs: DataFrame) -> DataFrame:
    """(q, r, cnt, n): how many keys with each abundance in the sample a sample and a reference share.

    Counts per abundance, not lists: a pair with millions of keys has as many rows as it has different abundances.
    """
    lists = samples.groupBy("ctxobj", "genome_id").agg(F.max("cnt").alias("cnt")).groupBy("ctxobj", list_block(F.col("genome_id")).alias("block")).agg(F.collect_list(F.struct(F.col("genome_id").alias("q"), "cnt")).alias("qs")).select(F.col("ctxobj").alias("of"), "qs")
    held = Scratch(refs.sparkSession, "composition").keep(refs.select(F.col("genome_id").alias("r"), "ctxobj").distinct(), "references")
    met = hot_left_join(held, lists, "ctxobj", "of", held.measured["rows"], salts=SALTS).where("qs is not null")
    return met.select("r", F.explode("qs").alias("x")).select("x.q", "r", F.coalesce("x.cnt", F.lit(1)).alias("cnt")).groupBy("q", "r", "cnt").agg(F.count("*").alias("n"))


def composition(samples: DataFrame, refs: DataFrame, least_shared: int = LEAST_SHARED) -> DataFrame:
    """(q, r, shared, mean, pct98_99, median, max) of the abundances, ascending a[0] .. a[m - 1], of every pair with m shared keys.

    pct98_99 sums a[int(.98 m)] up to below .99 m and divides by int(.99 m - int(.98 m) + 1); the median is a[m / 2].
    """
    up = Window.partitionBy("q", "r").orderBy("cnt")
    whole = Window.partitionBy("q", "r")
    ranks = shared_abundances(samples, refs).withColumn("end", F.sum("n").over(up)).withColumn("m", F.sum("n").over(whole)).withColumn("start", F.col("end") - F.col("n")).where(F.col("m") >= least_shared)
    m = F.col("m").cast("double")
    first, stop = F.floor(m * LOW), F.ceil(m * HIGH)
    middle = F.floor(F.col("m") / 2)
    inside = F.greatest(F.lit(0), F.least("end", stop) - F.greatest("start", first))
    return ranks.groupBy("q", "r", "m").agg(
        F.sum(F.col("cnt") * F.col("n")).alias("total"),
        F.sum(F.col("cnt") * inside).alias("upper"),
        F.max(F.when((F.col("start") <= middle) & (middle < F.col("end")), F.col("cnt"))).alias("median"),
        F.max("cnt").alias("max"),
    ).select("q", "r", F.col("m").alias("shared"), (F.col("total") / m).alias("mean"), (F.col("upper") / F.floor(m * HIGH - first + 1)).alias("pct98_99"), "median", "max")


def ranked(composed: DataFrame) -> DataFrame:
    """The rows with their place within the sample: most shared keys first, ties by the reference."""
    return composed.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("shared"), "r")))


def abundance_vectors(composed: DataFrame, least_shared: int = LEAST_SHARED) -> DataFrame:
    """(sample, ref_idx, pct): (x - 1) * 100 / (sum of x - n) of the pairs with a median above 1 and more than least_shared + 1 keys."""
    passed = composed.where((F.col("median") > 1) & (F.col("shared") > least_shared + 1))
    sums = passed.groupBy("q").agg((F.sum("pct98_99") - F.count("*")).alias("rest"))
    return passed.join(sums, "q").select(F.col("q").alias("sample"), F.col("r").alias("ref_idx"), ((F.col("pct98_99") - 1) * 100 / F.nullif(F.col("rest"), F.lit(0.0))).alias("pct"))


def vector_norms(vectors: DataFrame) -> DataFrame:
    return vectors.groupBy("sample").agg(F.sqrt(F.sum(F.col("pct") * F.col("pct"))).alias("norm"))


def search_vectors(queries: DataFrame, index: DataFrame, measure: str) -> DataFrame:
    """(q, sample, measure) of every query and indexed sample that share a dimension: "l1", "l2" (shared dimensions only) or "cosine".

    L1 adds to the shared differences what both have elsewhere, as either sums to 100. Best first: ``place``.
    """
    # lists of a sixty-fourth of the queries that have a dimension
    lists = queries.groupBy("ref_idx", F.pmod(F.xxhash64("sample"), F.lit(64)).alias("block")).agg(F.collect_list(F.struct(F.col("sample").alias("q"), F.col("pct").alias("x"))).alias("qs")).select(F.col("ref_idx").alias("of"), "qs")
    met = hot_left_join(index.select("sample", "ref_idx", F.col("pct").alias("y")), lists, "ref_idx", "of", salts=SALTS).where("qs is not null").select("sample", "y", F.explode("qs").alias("e")).select("e.q", "e.x", "sample", "y")
    x, y = F.col("x"), F.col("y")
    sums = met.groupBy("q", "sample").agg(F.sum(F.abs(y - x)).alias("d1"), F.sum((y - x) * (y - x)).alias("d2"), F.sum(x * y).alias("dot"), F.sum(x).alias("sx"), F.sum(y).alias("sy"))
    if measure == "cosine":
        a, b = vector_norms(queries), vector_norms(index)
        sums = sums.join(a.select(F.col("sample").alias("q"), F.col("norm").alias("nq")), "q").join(b.select("sample", F.col("norm").alias("ns")), "sample")
    value = {"l1": F.col("d1") + 200 - F.col("sx") - F.col("sy"), "l2": F.sqrt("d2"), "cosine": F.expr("dot / nullif(nq * ns, 0)") if measure == "cosine" else None}[measure]
    return placed(sums.select("q", "sample", value.alias("measure")), measure)


def placed(found: DataFrame, measure: str) -> DataFrame:
    """Adds place: 1 is the most similar sample of a query, ties go to the smaller sample."""
    best = F.desc("measure") if measure == "cosine" else F.asc("measure")
    return found.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy(best, "sample")))
