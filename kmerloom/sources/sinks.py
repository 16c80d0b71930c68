"""Writers of sketches, indices, tables and matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from kmerloom.functions.kernel import SketchParams


def write_sketch(keys: DataFrame, genomes: DataFrame, params: SketchParams, folder: str) -> None:
    """keys (sorted by genome and key within files), genomes and the one-row table of parameters below ``folder``."""
    spark = keys.sparkSession
    keys.repartition("genome_id").sortWithinPartitions("genome_id", F.col("ctxobj").bitwiseXOR(F.lit(-(1 << 63)))).write.parquet(f"{folder}/keys")
    genomes.write.parquet(f"{folder}/genomes")
    meta = (params.hash_id, "cnt" in keys.columns, params.keep_conflicts, params.coden, params.k, params.half_context, params.outer, params.inner, params.fold, params.least_count)
    fields = "hash_id bigint, counted boolean, conflicts boolean, coden boolean, k int, half_context int, outer int, inner int, fold int, least_count int"
    spark.createDataFrame([meta], fields).write.parquet(f"{folder}/params")


def read_sketch(spark, folder: str) -> tuple[DataFrame, DataFrame, SketchParams]:
    row = spark.read.parquet(f"{folder}/params").first()
    params = SketchParams(row.half_context, row.outer, row.inner, row.fold, row.coden, row.least_count, row.conflicts)
    if params.hash_id != row.hash_id:
        raise ValueError("the parameters don't give the sketch's id")
    return spark.read.parquet(f"{folder}/keys"), spark.read.parquet(f"{folder}/genomes"), params


def write_index(index: DataFrame, table: str, buckets: int = 64) -> None:
    """A table bucketed and sorted by context: joins on ctx with equal buckets need no shuffle."""
    index.write.bucketBy(buckets, "ctx").sortBy("ctx", "genome_id", "obj").format("parquet").saveAsTable(table)


def write_tsv(rows: DataFrame, folder: str, header: bool = True) -> None:
    rows.write.option("sep", "\t").option("header", str(header).lower()).csv(folder)


def write_kmers(rows: DataFrame, folder: str) -> None:
    """``kmer<TAB>reverse complement`` lines in a folder for each genome."""
    rows.select("genome_id", F.concat_ws("\t", "kmer", "reverse_complement").alias("value")).write.partitionBy("genome_id").text(folder)


def write_sequences(records: DataFrame, folder: str, name: str = "name", sequence: str = "seq", quality: str | None = None, packed: bool = False) -> None:
    """FASTA files, or FASTQ files if there is a column of qualities, plain or gzipped; a null sequence is empty."""
    seq = F.coalesce(F.col(sequence), F.lit(""))
    lines = [F.concat(F.lit(">"), F.col(name)), seq] if quality is None else [F.concat(F.lit("@"), F.col(name)), seq, F.lit("+"), F.coalesce(F.col(quality), F.lit(""))]
    writer = records.select(F.concat_ws("\n", *lines).alias("value")).write
    (writer.option("compression", "gzip") if packed else writer).text(folder)
    ending = ("fa" if quality is None else "fq") + (".gz" if packed else "")
    spark = records.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in system.listStatus(place):  # one for each task
        part = status.getPath()
        if part.getName().startswith("part-"):
            system.rename(part, spark._jvm.org.apache.hadoop.fs.Path(place, f"{part.getName().split('.')[0]}.{ending}"))
        else:
            system.delete(part, False)
