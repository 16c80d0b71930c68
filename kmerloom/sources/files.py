"""Sequence files, list files and group files."""

from __future__ import annotations

import bz2
import gzip
import io
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from kmerloom.operators.skew import with_sum_before
from kmerloom.session import Scratch

# Accepted endings, each also with .gz or .bz2 behind it.
FASTA = ("fna", "fas", "fasta", "fa")
FASTQ = ("fq", "fastq")
OTHER = ("co",)
PATTERN = r"\.(" + "|".join((*FASTA, *FASTQ, *OTHER)) + r")(\.gz|\.bz2)?$"
RECORDS = "path string, rec_id bigint, name string, seq string, qual string"
NAME_BYTES = 256


def format_of(path) -> object:
    """fasta, fastq, co or null for a path column."""
    ending = F.regexp_extract(path, PATTERN, 1)
    return F.when(ending.isin(*FASTA), "fasta").when(ending.isin(*FASTQ), "fastq").when(ending.isin(*OTHER), "co")


def listed_files(spark: SparkSession, list_file: str) -> DataFrame:
    """(path) of a file with one path a line: outer blanks and line ends off, blank lines skipped; raises on other endings."""
    lines = spark.read.text(list_file).select(F.trim(F.regexp_replace("value", "\r", "")).alias("path")).where("path <> ''")
    wrong = lines.where((~F.col("path").rlike(PATTERN)) | (F.length("path") >= NAME_BYTES)).limit(3).collect()
    if wrong:
        raise ValueError(f"not a sequence file, or its path is too long: {[r.path for r in wrong]}")
    return lines


def folder_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, bytes) of the sequence files below a folder; others are passed over."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", F.col("length").alias("bytes"))
    return files.where(F.col("path").rlike(PATTERN))


def count_formats(files: DataFrame) -> DataFrame:
    return files.groupBy(format_of(F.col("path")).alias("format")).agg(F.count("*").alias("files"))


def _text(stream: io.BufferedIOBase, offset: int) -> Iterator[tuple[int, bytes]]:
    """(offset, line without its end) from the stream's place on."""
    for line in stream:
        yield offset, line.rstrip(b"\r\n")
        offset += len(line)


def records_between(stream: io.BufferedIOBase, path: str, start: int = 0, end: int | None = None) -> Iterator[tuple[int, str, str, str | None]]:
    """(rec_id, name, sequence, quality) of the FASTA or FASTQ records that begin from ``start`` to before ``end``.

    rec_id is the record's offset in the (unpacked) text. The formats are told apart by the file's first letter. A range that begins
    inside a record skips to the next: a FASTQ record begins where a line starts with @ and the second after it with +, which
    no line of qualities can. A record that begins in the range is read to its end.
    """
    fastq = stream.peek(1)[:1] == b"@" if start == 0 else stream.read(1) == b"@"
    if start:
        stream.seek(start - 1)
        start += len(stream.readline()) - 1
    lines = _text(stream, start)
    yield from (_fastq if fastq else _fasta)(lines, path, end, start > 0)


def _fasta(lines: Iterator[tuple[int, bytes]], path: str, end: int | None, inside: bool) -> Iterator[tuple[int, str, str, None]]:
    place, name, parts = None, "", []
    for offset, line in lines:
        if line.startswith(b">"):
            if place is not None:
                yield place, name, b"".join(parts).decode("latin-1"), None
            if end is not None and offset >= end:
                return
            place, name, parts = offset, line[1:].decode("latin-1"), []
        elif place is not None:
            parts.append(line.strip())
        elif inside and end is not None and offset >= end:
            return
    if place is not None:
        yield place, name, b"".join(parts).decode("latin-1"), None


def _fastq(lines: Iterator[tuple[int, bytes]], path: str, end: int | None, inside: bool) -> Iterator[tuple[int, str, str, str]]:
    window: list[tuple[int, bytes]] = []
    for line in lines:
        if not window and (not line[1] or (end is not None and line[0] >= end)):
            if line[1]:
                return
            continue
        window.append(line)
        if inside and len(window) == 3 and not (window[0][1].startswith(b"@") and window[2][1].startswith(b"+")):
            window.pop(0)
            if end is not None and window[0][0] >= end:
                return
        elif len(window) == 4:
            inside = False
            if not (window[0][1].startswith(b"@") and window[2][1].startswith(b"+")):
                raise ValueError(f"{path}: no record of four lines at {window[0][0]}")
            yield window[0][0], window[0][1][1:].decode("latin-1"), window[1][1].decode("latin-1"), window[3][1].decode("latin-1")
            window = []
    if window and not inside:
        raise ValueError(f"{path}: the record at {window[0][0]} is cut off")


def _opened(path: str) -> io.BufferedIOBase:
    system, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    stream = io.BufferedReader(system.open_input_file(inner), 1 << 20)
    if path.endswith(".gz"):
        return io.BufferedReader(gzip.GzipFile(fileobj=stream), 1 << 20)
    return io.BufferedReader(bz2.BZ2File(stream), 1 << 20) if path.endswith(".bz2") else stream


def read_sequences(spark: SparkSession, path: str | list[str], batch_letters: int = 8_000_000, range_bytes: int = 64 << 20, others: str = "raise") -> DataFrame:
    """(path, rec_id, name, seq, qual) of all records of sequence files or folders.

    Plain files are read by ranges of ``range_bytes``, each a task's, so one large file spreads over tasks; a compressed file is
    unpacked as a stream by one task, as its format demands. Rows leave in batches of some ``batch_letters`` letters, so memory is that
    of a batch or of the longest record. Files of other endings raise an error, or are passed over with ``others="skip"``; ``.co``
    files hold no text and always raise.
    """
    schema = pa.schema([("path", pa.string()), ("rec_id", pa.int64()), ("name", pa.string()), ("seq", pa.large_string()), ("qual", pa.large_string())])

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for where, start, end in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                rows, held = [], 0
                with _opened(where) as stream:
                    for record in records_between(stream, where, start, end):
                        rows.append((where, *record))
                        held += len(record[2])
                        if held > batch_letters:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("bytes"))
    wrong = found.where(~F.col("path").rlike(PATTERN) | (format_of(F.col("path")) == "co"))
    wrong = [r.path for r in (wrong.where(F.col("path").rlike(PATTERN)) if others == "skip" else wrong).limit(3).collect()]
    if wrong:
        raise ValueError(f"not sequence text: {wrong}")
    files = found.where(F.col("path").rlike(PATTERN) & (F.col("bytes") > 0))
    packed = F.col("path").rlike(r"\.(gz|bz2)$")
    starts = F.when(packed, F.array(F.lit(0).cast("bigint"))).otherwise(F.sequence(F.lit(0).cast("bigint"), F.col("bytes") - 1, F.lit(range_bytes).cast("bigint")))
    ranges = files.select("path", packed.alias("packed"), F.explode(starts).alias("start")).select("path", "start", F.when(~F.col("packed"), F.col("start") + range_bytes).alias("end"))
    return ranges.repartition(max(1, min(10_000, ranges.count()))).mapInArrow(run, RECORDS)


def with_genome_ids(records: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Adds genome_id: the place of the record's file in the order of paths. Give the files' paths where they are known, else the
    records are read once more for them."""
    ordered = (records if files is None else files).select("path").distinct().orderBy("path")
    low = F.lit((1 << 33) - 1)  # where the row stands in its partition
    rows = Scratch(records.sparkSession, "files").keep(ordered.select("path", F.monotonically_increasing_id().alias("at")), "paths")
    rows = rows.select("path", F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND(low).alias("inner"))
    sums = with_sum_before(rows.groupBy("part").agg(F.count("*").alias("n")), "n", "part")
    return records.join(rows.join(sums.select("part", "before"), "part").select("path", (F.col("before") + F.col("inner")).alias("genome_id")), "path")


def read_groups(spark: SparkSession, path: str, genomes: int | None = None) -> DataFrame:
    """(genome_id, taxid, taxname) of a file whose i-th line (from 0) is ``taxid<TAB>name`` of genome i; the name may be missing.

    With the number of ``genomes``, raises if the lines aren't as many.
    """
    lines = spark.sparkContext.textFile(path).zipWithIndex().toDF("line string, genome_id bigint")
    if genomes is not None and (n := lines.count()) != genomes:
        raise ValueError(f"{n} lines for {genomes} genomes")
    parts = F.split(F.regexp_replace("line", "\r", ""), "\t")
    name = F.trim(F.get(parts, F.lit(1)))
    return lines.select("genome_id", F.trim(parts[0]).cast("int").alias("taxid"), F.when(name != "", name).alias("taxname"))
