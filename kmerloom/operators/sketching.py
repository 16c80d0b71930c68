"""Sequences to sketches: (genome_id, ctxobj, cnt), one row per kept key of a genome."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from kmerloom.functions.kernel import SketchParams, sampled_keys, unpack_keys

SKETCH = "genome_id bigint, ctxobj bigint, cnt bigint"


def raw_keys(records: DataFrame, genome: str, sequence: str, params: SketchParams) -> DataFrame:
    """Every kept k-mer with its count within a batch of records: the map side of the aggregation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, keys = sampled_keys(batch.column(1), params)
            if not len(keys):
                continue
            genomes = np.asarray(batch.column(0), np.int64)[index]
            order = np.lexsort((keys, genomes))
            g, k = genomes[order], keys[order]
            first = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (k[1:] != k[:-1])]))
            counts = np.diff(np.append(first, len(g)))
            yield pa.RecordBatch.from_arrays([pa.array(g[first]), pa.array(k[first].view(np.int64)), pa.array(counts)], names=["genome_id", "ctxobj", "cnt"])

    rows = records.where(F.col(genome).isNotNull()).select(F.col(genome).cast("bigint"), F.col(sequence))
    return rows.mapInArrow(run, SKETCH)


def without_conflicts(keys: DataFrame, object_bits: int) -> DataFrame:
    """Drops every key of a genome whose context occurs there with more than one object."""
    if not object_bits:
        return keys
    context = F.shiftrightunsigned("ctxobj", object_bits)
    objects = F.count("*").over(Window.partitionBy("genome_id", context))
    return keys.withColumn("objects", objects).where("objects = 1").drop("objects")


def sketch(records: DataFrame, params: SketchParams, genome: str = "genome_id", sequence: str = "seq") -> DataFrame:
    """The sketch of every genome: distinct keys with counts, those below the least count out, then conflicting contexts out.

    Rows with a null genome are dropped, a null or short sequence has no keys. Records of one genome count together.
    """
    keys = raw_keys(records, genome, sequence, params).groupBy("genome_id", "ctxobj").agg(F.sum("cnt").alias("cnt"))
    if params.least_count > 1:
        keys = keys.where(F.col("cnt") >= params.least_count)
    return keys if params.keep_conflicts else without_conflicts(keys, params.object_bits)


def sketch_by_record(records: DataFrame, params: SketchParams, record: str, sequence: str = "seq") -> DataFrame:
    """Every record longer than a k-mer as a genome of its own (counts aren't kept)."""
    long_enough = records.where(F.length(sequence) > params.k)
    return sketch(long_enough, params, record, sequence).drop("cnt")


def merge(*sketches: tuple[DataFrame, int, SketchParams]) -> DataFrame:
    """One sketch of several: (sketch, number of its genomes, its parameters) each; later genome ids are moved up."""
    ids = {p.hash_id for _, _, p in sketches}
    if len(ids) > 1:
        raise ValueError(f"sketches of different parameters: {sorted(ids)}")
    out, offset = None, 0
    for frame, n, _ in sketches:
        moved = frame.withColumn("genome_id", F.col("genome_id") + offset)
        out = moved if out is None else out.unionByName(moved)
        offset += n
    return out


def inverted_index(keys: DataFrame, object_bits: int) -> DataFrame:
    """(ctx, genome_id, obj), ready to be written in buckets of ctx."""
    low = F.lit((1 << object_bits) - 1).cast("bigint")
    return keys.select(F.shiftrightunsigned("ctxobj", object_bits).alias("ctx"), "genome_id", F.col("ctxobj").bitwiseAND(low).alias("obj"))


def index_summary(index: DataFrame) -> DataFrame:
    """One row: contexts, most genomes of a context, genome/context pairs with several objects."""
    per = index.groupBy("ctx", "genome_id").agg(F.count_distinct("obj").alias("objects"))
    by = per.groupBy("ctx").agg(F.count("*").alias("genomes"), F.sum((F.col("objects") > 1).cast("bigint")).alias("conflicts"))
    return by.agg(F.count("*").alias("contexts"), F.max("genomes").alias("most_genomes"), F.sum("conflicts").alias("conflicts"))


def kmers(keys: DataFrame, params: SketchParams) -> DataFrame:
    """The rows with the k-mer of their key and its reverse complement."""

    @F.pandas_udf("string")
    def unpack(column):
        import pandas as pd

        return pd.Series(unpack_keys(column.to_numpy(np.int64), params), index=column.index, dtype="object")

    out = keys.withColumn("kmer", unpack("ctxobj"))
    return out.withColumn("reverse_complement", F.translate(F.reverse("kmer"), "ACGT", "TGCA"))
