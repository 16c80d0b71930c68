"""Queries that write files of every format and read them again, with the SQL of what must come out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kmerloom.operators import composite, distance, legacy, sketching
from kmerloom.plans import genomes_sql as sql
from kmerloom.plans.genomes import CODEN, K, PLAIN, asked, keys_of, records_of, rounded, sketch_legacy, sketch_plain, vectors_of
from kmerloom.plans.tables import table
from kmerloom.session import Scratch
from kmerloom.sources import binary, files, sinks
from kmerloom.streaming.incremental import append_keys, arriving_records


def _folder(spark: SparkSession, name: str) -> str:
    return Scratch(spark, "files").path(name)


def _named(spark: SparkSession, folder: str) -> DataFrame:
    name = F.concat_ws(" ", F.col("rec_id").cast("string"), F.coalesce("genome_id", F.lit(-1)).cast("string"))
    return records_of(spark, folder).where("seq is not null").select(name.alias("name"), "seq", F.repeat(F.lit("@"), F.length("seq")).alias("qual"))


def files_fasta(spark, folder):
    """All records as FASTA files, read by ranges."""
    at = _folder(spark, "fasta")
    sinks.write_sequences(_named(spark, folder), at)
    return files.read_sequences(spark, at, range_bytes=100_000).select("name", "seq")


def files_fastq(spark, folder):
    """All records as FASTQ files, read by ranges; every quality begins with the mark of a record."""
    at = _folder(spark, "fastq")
    sinks.write_sequences(_named(spark, folder), at, quality="qual")
    return files.read_sequences(spark, at, range_bytes=100_000).select("name", "seq", "qual")


def files_packed(spark, folder):
    """All records as gzipped FASTA files, with the files' numbers."""
    at = _folder(spark, "packed")
    sinks.write_sequences(_named(spark, folder).repartition(3), at, packed=True)
    records = files.with_genome_ids(files.read_sequences(spark, at), files.folder_files(spark, at))
    return records.groupBy((F.col("genome_id") < 3).alias("numbered")).agg(F.count("*").alias("records"), F.sum(F.length("seq")).alias("letters"))


def _numbered(keys: DataFrame) -> DataFrame:
    return keys.select("genome_id").distinct().select("genome_id", F.col("genome_id").cast("string").alias("name"))


def _renumbered(keys: DataFrame, names: DataFrame) -> DataFrame:
    """Keys of a folder with the ids that its names hold.

    The names came through the driver. The keys must not: Spark takes them for as small as the list of genomes that they are read by.
    """
    return keys.join(F.broadcast(names), "genome_id").withColumn("genome_id", F.col("name").cast("bigint")).select("genome_id", "ctxobj", "cnt")


def files_native(spark, folder):
    """The sketch table as a native sketch folder."""
    keys, at = Scratch(spark, "files").keep(keys_of(spark, folder), "keys"), _folder(spark, "native")
    binary.write_binary_sketch(keys, _numbered(keys), CODEN, at)
    back, names, _ = binary.read_sketch_folder(spark, at, CODEN.hash_id)
    return _renumbered(back, names)


def files_older(spark, folder):
    """The older sampling as an older sketch folder."""
    keys, at = Scratch(spark, "files").keep(sketch_legacy(spark, folder), "keys"), _folder(spark, "older")
    binary.write_old_sketch(keys, _numbered(keys), 16, 1, 11, at)
    back, names, _ = binary.read_sketch_folder(spark, at, 11)
    return _renumbered(back, names).withColumnRenamed("ctxobj", "key")


def files_vectors(spark, folder):
    """The abundance vectors of all samples as files, one a sample."""
    at = _folder(spark, "vectors")
    binary.write_vectors(vectors_of(spark, folder), at)
    return rounded(binary.read_vectors(spark, at).select(F.col("sample").cast("bigint").alias("sample"), "ref_idx", "pct"), "pct", digits=4)


def files_shuffle(spark, folder):
    """A permutation of dimensions as a file; it samples the same keys as its seed."""
    at = binary.local_path(_folder(spark, "shuffle")) + ".shuf"
    binary.write_shuffle(legacy.permutation(4, 11), 8, 4, 1, 5, at)
    header, ranks = binary.read_shuffle(at)
    return legacy.legacy_keys(records_of(spark, folder), header["half_k"], header["half_subcontext"], header["level"], 0, ranks=ranks)


def files_groups(spark, folder):
    """A group file with a line for each listed genome."""
    at = _folder(spark, "groups")
    taxa = table(spark, folder, "genomes").groupBy("genome_id").agg(F.min(F.coalesce("taxid", F.lit(0))).alias("taxid"), F.min("taxname").alias("taxname"))
    lines = taxa.orderBy("genome_id").select(F.concat_ws("\t", F.col("taxid").cast("string"), "taxname").alias("value"))
    lines.write.text(at)
    return files.read_groups(spark, at, taxa.count()).withColumnRenamed("genome_id", "line")


def files_listed(spark, folder):
    """A list file with a path for each listed genome, and the formats that it names."""
    at = _folder(spark, "list")
    ending = F.when(F.col("genome_id") % 3 == 0, ".fna.gz").when(F.col("genome_id") % 3 == 1, ".fq").otherwise(".fasta")
    rows = table(spark, folder, "genomes").select("genome_id").distinct().select(F.concat(F.lit("  batch/g"), F.col("genome_id").cast("string"), ending, F.lit(" \r")).alias("value"))
    rows.unionByName(spark.createDataFrame([("",)], "value string")).write.text(at)
    return files.count_formats(files.listed_files(spark, at))


def files_sketch(spark, folder):
    """A plain sketch stored with its parameters."""
    keys, at = sketch_plain(spark, folder), _folder(spark, "sketch")
    sinks.write_sketch(keys, _numbered(keys), PLAIN, at)
    return sinks.read_sketch(spark, at)[0].select("genome_id", "ctxobj", "cnt")


def files_kmers(spark, folder):
    """K-mers as text, in a folder for each genome."""
    at = _folder(spark, "kmers")
    sinks.write_kmers(sketching.kmers(sketch_plain(spark, folder), PLAIN), at)
    return spark.read.text(at).select(F.col("genome_id").cast("bigint").alias("genome_id"), "value")


def files_tsv(spark, folder):
    """Distances as text with tabs."""
    at = _folder(spark, "tsv")
    keys = keys_of(spark, folder)
    sinks.write_tsv(rounded(distance.similarities(distance.sized_overlaps(asked(keys), keys), K).select("q", "r", "shared", "jaccard"), "jaccard"), at)
    return spark.read.option("sep", "\t").option("header", "true").schema("q bigint, r bigint, shared bigint, jaccard double").csv(at)


def composition_text(spark, folder):
    """Compositions as text, best first within a sample."""
    at = _folder(spark, "composition")
    keys = keys_of(spark, folder)
    sinks.write_tsv(rounded(composite.ranked(composite.composition(asked(keys), keys)), "mean", "pct98_99").drop("place"), at, header=False)
    return spark.read.option("sep", "\t").schema("q bigint, r bigint, shared bigint, mean double, pct98_99 double, median bigint, max bigint").csv(at)


def arriving_keys(spark, folder):
    """Keys of all records as they arrive, redelivered ones too, by a streaming query over the file."""
    schema = table(spark, folder, "command_sketch").schema
    arriving = arriving_records(spark, f"{folder}/command_sketch.parque[t]", schema)  # a pattern: a stream of one file has no base folder
    arriving = arriving.withColumn("seq", F.regexp_replace("seq", r"\s", ""))
    at = _folder(spark, "stream")
    append_keys(arriving, PLAIN, f"{at}/keys", f"{at}/checkpoint").awaitTermination()
    return spark.read.schema("genome_id bigint, ctxobj bigint, cnt bigint").parquet(f"{at}/keys/*").groupBy("genome_id", "ctxobj").agg(F.sum("cnt").alias("cnt"))


QUERIES = {
    f.__name__: f
    for f in (files_fasta, files_fastq, files_packed, files_native, files_older, files_vectors, files_shuffle, files_groups, files_listed, files_sketch, files_kmers, files_tsv, composition_text, arriving_keys)
}

_NAMED = f"WITH {sql.RECORDS} SELECT concat_ws(' ', rec_id, coalesce(g, -1)) AS name, s AS seq"
SQL = {
    "files_fasta": f"{_NAMED} FROM recs WHERE s IS NOT NULL",
    "files_fastq": f"{_NAMED}, repeat('@', length(s)) AS qual FROM recs WHERE s IS NOT NULL",
    "files_packed": f"WITH {sql.RECORDS} SELECT true AS numbered, count(*) AS records, CAST(sum(length(s)) AS BIGINT) AS letters FROM recs WHERE s IS NOT NULL",
    "files_native": sql.KEYS,
    "files_older": sql.SQL["sketch_legacy"],
    "files_shuffle": sql.SQL["sketch_legacy"],
    "files_vectors": sql.VECTORS + " SELECT sample, ref_idx, round(CAST(CAST(pct AS FLOAT) AS DOUBLE), 4) AS pct FROM abv",
    "files_groups": """WITH t AS (SELECT genome_id, min(coalesce(taxid, 0)) AS taxid, min(taxname) AS taxname FROM genomes GROUP BY 1)
SELECT row_number() OVER (ORDER BY genome_id) - 1 AS line, taxid, nullif(trim(taxname), '') AS taxname FROM t""",
    "files_listed": "SELECT CASE WHEN genome_id % 3 = 1 THEN 'fastq' ELSE 'fasta' END AS format, count(DISTINCT genome_id) AS files FROM genomes GROUP BY 1",
    "files_sketch": sql.SQL["sketch_plain"],
    "files_kmers": f"SELECT genome_id, kmer || chr(9) || reverse_complement AS value FROM ({sql.SQL['reverse_kmers']})",
    "files_tsv": f"SELECT q, r, shared, jaccard FROM ({sql.SQL['dist_similarity']})",
    "composition_text": sql.SQL["composition"],
    "arriving_keys": sql.SQL["sketch_plain"].replace(sql.RECORDS, r"recs AS (SELECT genome_id AS g, regexp_replace(seq, '\s', '', 'g') AS s FROM command_sketch)"),
}
