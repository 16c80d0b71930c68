"""The older sampling: a seeded permutation of middle sub-contexts decides which k-mers are kept."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from kmerloom.functions.kernel import BASES, U, letters, windows, within
from kmerloom.operators.skew import SALTS, hot_left_join, list_block
from kmerloom.session import Scratch

LEAST_DIMENSIONS = 4096
MOST_COUNT = 65535


def permutation(half_subcontext: int, seed: int) -> np.ndarray:
    """rank[dimension] of the 16 ** half_subcontext sub-contexts: a permutation that depends on the seed alone."""
    if not 1 <= half_subcontext < 8:
        raise ValueError("half_subcontext 1..7")
    return np.random.default_rng(seed).permutation(16**half_subcontext).astype(np.int64)


def permutation_table(spark: SparkSession, half_subcontext: int, seed: int) -> DataFrame:
    ranks = permutation(half_subcontext, seed)
    import pandas as pd

    return spark.createDataFrame(pd.DataFrame({"dim": np.arange(len(ranks)), "rank": ranks}))


def kept_dimensions(half_subcontext: int, level: int) -> int:
    return min(16**half_subcontext, max(16 ** max(0, half_subcontext - level), LEAST_DIMENSIONS))


def legacy_keys(records: DataFrame, half_k: int, half_subcontext: int, level: int, seed: int, genome: str = "genome_id", sequence: str = "seq", quality: str | None = None, least_quality: int = 0, offset: int = 33, ranks: np.ndarray | None = None) -> DataFrame:
    """(genome_id, key, cnt): canonical k-mers (the smaller strand) of 2 * half_k bases whose middle 2 * half_subcontext
    bases have a rank below the kept number. Bases of a quality below ``least_quality`` break a k-mer. Counts stop at 65,535.
    ``ranks`` is the permutation of a shuffle file in place of the seed's.
    """
    if half_k < half_subcontext or half_k > 16:
        raise ValueError("half_subcontext <= half_k <= 16")
    k, keep = 2 * half_k, kept_dimensions(half_subcontext, level)
    ranks = permutation(half_subcontext, seed) if ranks is None else ranks
    outer = half_k - half_subcontext

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            if quality is not None:
                column = pa.array([_masked(s, q, least_quality + offset) for s, q in zip(column.to_pylist(), batch.column(2).to_pylist(), strict=True)], pa.large_string())
            data, offsets = letters(column)
            found = [(np.empty(0, np.int64), np.empty(0, U))]
            for at, forward, reverse in windows(data, k):
                least = np.minimum(forward, reverse)
                kept = ranks[((least >> U(2 * outer)) & U(16**half_subcontext - 1)).astype(np.int64)] < keep
                sequence, whole = within(at[kept], k, offsets)
                found.append((sequence[whole], least[kept][whole]))
            index, kmers = (np.concatenate(x) for x in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(index)), pa.array(kmers.view(np.int64))], names=["genome_id", "key"])

    columns = [F.col(genome).cast("bigint"), F.col(sequence)] + ([F.col(quality)] if quality else [])
    rows = records.where(F.col(genome).isNotNull()).select(*columns).mapInArrow(run, "genome_id bigint, key bigint")
    return rows.groupBy("genome_id", "key").agg(F.least(F.count("*"), F.lit(MOST_COUNT)).alias("cnt"))


def _masked(sequence: str | None, quality: str | None, least: int) -> str:
    """The sequence with N for bases of a lower quality; a missing quality is a good one."""
    marks = np.frombuffer((quality or "").encode("ascii", "replace"), np.uint8)[: len(sequence or "")]
    text = np.frombuffer((sequence or "").encode("ascii", "replace"), np.uint8).copy()
    text[: len(marks)][marks < least] = ord("N")
    return text.tobytes().decode()


def frequent(keys: DataFrame, least: int) -> DataFrame:
    """The occurrence filter: keys that a genome has at least ``least`` times."""
    return keys.where(F.col("cnt") >= least)


def once_only(keys: DataFrame) -> DataFrame:
    """Keys that a genome has once."""
    return keys.where("cnt = 1")


def posting_lists(keys: DataFrame, key: str = "key") -> DataFrame:
    """(key, genomes): the genomes of every key, in order."""
    return keys.groupBy(key).agg(F.array_sort(F.collect_set("genome_id")).alias("genomes"))


def mean_shared_abundance(queries: DataFrame, refs: DataFrame) -> DataFrame:
    """(q, r, shared, mean_cnt): shared keys of every pair with the query's mean count over them."""
    lists = queries.groupBy("key", list_block(F.col("genome_id")).alias("block")).agg(F.collect_list(F.struct(F.col("genome_id").alias("q"), "cnt")).alias("qs")).select(F.col("key").alias("of"), "qs")
    held = Scratch(refs.sparkSession, "abundance").keep(refs.select(F.col("genome_id").alias("r"), "key").distinct(), "references")
    met = hot_left_join(held, lists, "key", "of", held.measured["rows"], salts=SALTS).where("qs is not null").select("r", F.explode("qs").alias("x"))
    return met.groupBy(F.col("x.q").alias("q"), "r").agg(F.count("*").alias("shared"), F.avg("x.cnt").alias("mean_cnt"))


def legacy_kmer(keys: DataFrame, half_k: int) -> DataFrame:
    """The rows with the k-mer that the key stands for."""
    pairs = [F.element_at(F.array(*map(F.lit, BASES)), (F.shiftrightunsigned("key", 2 * (2 * half_k - 1 - i)).bitwiseAND(F.lit(3)) + 1).cast("int")) for i in range(2 * half_k)]
    return keys.withColumn("kmer", F.concat(*pairs))
