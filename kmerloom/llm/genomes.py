"""Columns of the test tables that several queries clean in the same way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

ACCESSION = r"([A-Za-z]+)[_-]([0-9]+)[^/\\]*$"


def accession(name: Column) -> Column:
    """The accession in the last part of a file name, spelled as ``ABC_123``; null where there is none."""
    found = F.concat_ws("_", F.upper(F.regexp_extract(name, ACCESSION, 1)), F.regexp_extract(name, ACCESSION, 2))
    return F.when(F.length(found) > 1, found)


def fraction(x: Column) -> Column:
    """Percentages (above 1) as fractions; NaN and negative values, which stand for missing ones, as null."""
    return F.when(~F.isnan(x) & (x >= 0), F.when(x > 1, x / 100).otherwise(x))


def matches(pairs: DataFrame, genomes: DataFrame, least_ani: float = 0.95, least_fraction: float = 0.3) -> DataFrame:
    """(a, b): genome ids of matching pairs. A file of no listed genome gets a negative id, as it may link others."""
    close = pairs.select(accession(F.col("qry")).alias("q"), accession(F.col("ref")).alias("r"), fraction(F.col("anim")).alias("ani"), fraction(F.col("qry_align_fraction")).alias("af"))
    close = close.where((F.col("ani") >= least_ani) & (F.col("af") >= least_fraction) & (F.col("q") != F.col("r"))).select("q", "r").distinct()
    ids = genomes.select(accession(F.col("name")).alias("acc"), F.col("genome_id").cast("bigint").alias("id")).where("acc is not null and id is not null").groupBy("acc").agg(F.min("id").alias("id"))
    for at, to in (("q", "a"), ("r", "b")):
        close = close.join(ids.select(F.col("acc").alias(at), F.col("id").alias(to)), at, "left")
        close = close.withColumn(to, F.coalesce(to, -1 - F.shiftrightunsigned(F.xxhash64(at), 1)))
    return close.select("a", "b")
