"""Set algebra on sketches. A pan is a set of keys without genomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from kmerloom.operators.skew import hot_left_join


def union(keys: DataFrame) -> DataFrame:
    """All distinct keys: a pan."""
    return keys.select("ctxobj").distinct()


def document_frequency(keys: DataFrame) -> DataFrame:
    """(ctxobj, genomes): in how many genomes a key occurs."""
    return keys.select("genome_id", "ctxobj").distinct().groupBy("ctxobj").agg(F.count("*").alias("genomes"))


def unique_union(keys: DataFrame) -> DataFrame:
    """The keys that occur in one genome only."""
    return document_frequency(keys).where("genomes = 1").select("ctxobj")


def markers(keys: DataFrame) -> DataFrame:
    """(genome_id, ctxobj) of the keys that occur in that genome only; one aggregation, as the genome is the only one."""
    return keys.groupBy("ctxobj").agg(F.min("genome_id").alias("genome_id"), F.max("genome_id").alias("last")).where("genome_id = last").select("genome_id", "ctxobj")


def intersect(keys: DataFrame, pan: DataFrame) -> DataFrame:
    return keys.join(pan.select("ctxobj"), "ctxobj", "left_semi")


def subtract(keys: DataFrame, pan: DataFrame) -> DataFrame:
    return keys.join(pan.select("ctxobj"), "ctxobj", "left_anti")


def checked_groups(groups: DataFrame) -> DataFrame:
    """(genome_id, taxid, taxname) without taxid 0 or null; raises if a taxid has two names."""
    named = groups.where("taxid <> 0").select("genome_id", "taxid", "taxname").distinct()
    clash = named.groupBy("taxid").agg(F.count_distinct("taxname").alias("names")).where("names > 1").select("taxid").limit(5).collect()
    if clash:
        raise ValueError(f"taxids with several names: {[r.taxid for r in clash]}")
    return named


def group_union(keys: DataFrame, groups: DataFrame) -> DataFrame:
    """(taxid, ctxobj): the union of the keys of a group's genomes. Groups of null or 0 are left out; a key's conflicts stay."""
    of = groups.where("taxid <> 0").groupBy("genome_id").agg(F.min("taxid").alias("taxid")).withColumnRenamed("genome_id", "of")
    return hot_left_join(keys.select("genome_id", "ctxobj"), of, "genome_id", "of").where("taxid is not null").select("taxid", "ctxobj").distinct()


def combine(*pans: DataFrame) -> DataFrame:
    """Pans as the genomes 0, 1, ... of one sketch."""
    out = None
    for i, pan in enumerate(pans):
        one = pan.select(F.lit(i).cast("bigint").alias("genome_id"), "ctxobj")
        out = one if out is None else out.unionByName(one)
    return out


def sizes(keys: DataFrame, genomes: DataFrame) -> DataFrame:
    """(genome_id, name, size) of every listed genome, 0 for those without keys."""
    n = keys.groupBy("genome_id").agg(F.count_distinct("ctxobj").alias("size"))
    return genomes.groupBy("genome_id").agg(F.min("name").alias("name")).join(n, "genome_id", "left").fillna(0, ["size"])


def key_listing(keys: DataFrame) -> DataFrame:
    """(genome_id, key, cnt) with the key in lower-case hexadecimal digits."""
    return keys.select("genome_id", F.lower(F.hex("ctxobj")).alias("key"), "cnt")


def index_listing(index: DataFrame, genome_bits: int = 20) -> DataFrame:
    """(ctxgid, obj) in hexadecimal digits, each row once."""
    return index.select(F.lower(F.hex(F.shiftleft("ctx", genome_bits).bitwiseOR(F.col("genome_id")))).alias("ctxgid"), F.lower(F.hex("obj")).alias("obj"))
