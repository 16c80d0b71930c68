import bz2
import gzip
import io
import random
import struct

import numpy as np
import pytest

from kmerloom.functions.kernel import SketchParams
from kmerloom.operators.sketching import inverted_index, kmers, sketch
from kmerloom.operators.legacy import permutation
from kmerloom.sources.binary import read_binary_sketch, read_shuffle, read_sketch_folder, read_vectors, write_binary_sketch, write_old_sketch, write_shuffle, write_vectors
from kmerloom.sources.files import count_formats, folder_files, format_of, listed_files, read_groups, read_sequences, records_between, with_genome_ids
from kmerloom.sources.sinks import read_sketch, write_index, write_kmers, write_sketch, write_tsv
from kmerloom.streaming.incremental import append_keys, arriving_records

FASTA = b">r1 first\r\nACGT\r\nacgn\n\n>r2\n>r3\nTT\n"
FASTQ = b"@q1\nACGT\n+\nIIII\n@q2\nGG\n+q2\n@@"


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "a.fna").write_bytes(FASTA)
    (tmp_path / "b.fa.gz").write_bytes(gzip.compress(FASTA))
    (tmp_path / "c.fq").write_bytes(FASTQ)
    (tmp_path / "d.fastq.bz2").write_bytes(bz2.compress(FASTQ))
    (tmp_path / "notes.txt").write_text("x")
    return tmp_path


def parsed(data, path="x", start=0, end=None):
    return list(records_between(io.BufferedReader(io.BytesIO(data)), path, start, end))


def test_parser():
    assert parsed(FASTA) == [(0, "r1 first", "ACGTacgn", None), (23, "r2", "", None), (27, "r3", "TT", None)]
    assert parsed(FASTQ) == [(0, "q1", "ACGT", "IIII"), (16, "q2", "GG", "@@")]
    assert parsed(b"") == [] and parsed(b"\n\n") == []
    for bad in (b"@q\nAC\nIIII\nx\n", b"@q\nAC\n+\n"):
        with pytest.raises(ValueError):
            parsed(bad)


@pytest.mark.parametrize("kind", ["fasta", "fastq"])
def test_ranges_give_every_record_once(kind):
    """Cuts at every place, with qualities that begin with @ and + and with sequences of several lines."""
    rnd = random.Random(3)
    text = b""
    for i in range(25):
        seq = "".join(rnd.choice("ACGT") for _ in range(rnd.randrange(1, 12)))
        qual = "".join(rnd.choice("@+IJ") for _ in seq)
        text += (f">r{i}\n{seq}\n{seq}\r\n\n" if kind == "fasta" else f"@r{i} @x\n{seq}\n+{'x' * (i % 2)}\n{qual}\n").encode()
    whole = parsed(text)
    assert len(whole) == 25
    for step in (1, 2, 3, 7, 16, 50, 1000):
        cuts = range(0, len(text), step)
        assert [r for s in cuts for r in parsed(text, "x", s, s + step)] == whole


def test_reading_folders_and_lists(spark, folder):
    with pytest.raises(ValueError):
        read_sequences(spark, str(folder))
    records = read_sequences(spark, str(folder), others="skip", range_bytes=7)
    assert records.count() == 10
    numbered = {r.path[-4:]: r.genome_id for r in with_genome_ids(records).collect()}
    assert numbered == {".fna": 0, "a.gz": 1, "c.fq": 2, ".bz2": 3}
    assert with_genome_ids(records, folder_files(spark, str(folder))).where("genome_id = 3").count() == 2
    (folder / "old.co").write_text("x")
    with pytest.raises(ValueError):
        read_sequences(spark, str(folder), others="skip")
    (folder / "old.co").unlink()
    assert {r["format"]: r.files for r in count_formats(folder_files(spark, str(folder))).collect()} == {"fasta": 2, "fastq": 2}
    (folder / "list").write_text(f"  {folder}/a.fna\r\n\n{folder}/c.fq\n")
    assert listed_files(spark, str(folder / "list")).count() == 2
    (folder / "bad").write_text("a.doc\n")
    with pytest.raises(ValueError):
        listed_files(spark, str(folder / "bad"))
    df = spark.createDataFrame([("x.co",), ("x.fas.bz2",), ("x.gz",)], "p string")
    assert [r[0] for r in df.select(format_of(df.p)).collect()] == ["co", "fasta", None]


def test_groups_and_binary_sketch(spark, tmp_path):
    (tmp_path / "g").write_text("5\tname\r\n0\n7\t\n")
    assert [tuple(r) for r in read_groups(spark, str(tmp_path / "g")).orderBy("genome_id").collect()] == [(0, 5, "name"), (1, 0, None), (2, 7, None)]
    np.array([3, 2**64 - 1, 9], np.uint64).tofile(tmp_path / "comblco")
    np.array([0, 2, 2, 3], np.uint64).tofile(tmp_path / "comblco.index")
    assert sorted(map(tuple, read_binary_sketch(spark, str(tmp_path)).collect())) == [(0, -1, 1), (0, 3, 1), (2, 9, 1)]
    np.array([4, 5, 6], np.uint32).tofile(tmp_path / "comblco.a")
    assert sorted(map(tuple, read_binary_sketch(spark, str(tmp_path)).collect())) == [(0, -1, 5), (0, 3, 4), (2, 9, 6)]


def test_binary_folders(spark, tmp_path):
    p = SketchParams(half_context=4, outer=1, fold=0, keep_conflicts=True)
    rows = [(5, -1, 70_000), (5, 3, 1), (5, 3, 2), (9, 7, 4)]
    keys = spark.createDataFrame(rows, "genome_id long, ctxobj long, cnt long")
    genomes = spark.createDataFrame([(5, "five"), (7, "none"), (9, None)], "genome_id long, name string")
    write_binary_sketch(keys, genomes, p, str(tmp_path / "n"))
    back, names, header = read_sketch_folder(spark, "file://" + str(tmp_path / "n"), p.hash_id)
    assert sorted(map(tuple, back.collect())) == [(0, -1, 70_000), (0, 3, 2), (2, 7, 4)]
    assert (tmp_path / "n" / "comblco").read_bytes()[:16] == np.array([3, 2**64 - 1], np.uint64).tobytes()
    assert [r.name for r in names.orderBy("genome_id").collect()] == ["five", "none", ""] and header["genomes"] == 3 and header["conflicts"]
    with pytest.raises(ValueError):
        read_sketch_folder(spark, str(tmp_path / "n"), 1)
    with pytest.raises(ValueError):
        read_sketch_folder(spark, str(tmp_path))
    write_binary_sketch(keys.drop("cnt"), genomes, p, str(tmp_path / "m"))
    assert {r.cnt for r in read_sketch_folder(spark, str(tmp_path / "m"))[0].collect()} == {1}
    old = spark.createDataFrame([(5, 2**32 - 1, 65_535), (5, 8, 1), (9, 8, 3)], "genome_id long, key long, cnt long")
    write_old_sketch(old, genomes, 16, 2, 77, str(tmp_path / "o"))
    back, names, header = read_sketch_folder(spark, str(tmp_path / "o"), 77)
    assert sorted(map(tuple, back.collect())) == [(0, 8, 1), (0, 2**32 - 1, 65_535), (2, 8, 3)] and (header["k"], header["level"], names.count()) == (16, 2, 3)
    vectors = spark.createDataFrame([("s", 4, 60.5, 9), ("s", 2, 39.5, 30), ("t", 1, 100.0, 8)], "sample string, ref_idx long, pct double, shared long")
    write_vectors(vectors, str(tmp_path / "v"))
    assert sorted(map(tuple, read_vectors(spark, str(tmp_path / "v")).collect())) == [("s", 0, 2, 39.5), ("s", 1, 4, 60.5), ("t", 0, 1, 100.0)]
    assert (tmp_path / "v" / "t.abv").read_bytes() == struct.pack("<if", 1, 100.0)
    ranks = permutation(2, 5)
    assert not write_shuffle(ranks, 6, 2, 1, 9, str(tmp_path / "a.shuf")) and write_shuffle(permutation(4, 5), 6, 4, 1, 9, str(tmp_path / "b.shuf"))
    header, back = read_shuffle(str(tmp_path / "a.shuf"))
    assert header == {"id": 9, "half_k": 6, "half_subcontext": 2, "level": 1} and (back == ranks).all()
    for bad in (lambda: write_shuffle(ranks, 1, 2, 1, 9, str(tmp_path / "c.shuf")), lambda: read_shuffle("x.txt"), lambda: write_shuffle(ranks[:9], 6, 2, 1, 9, str(tmp_path / "c.shuf"))):
        with pytest.raises(ValueError):
            bad()


def test_groups_must_fit(spark, tmp_path):
    (tmp_path / "g").write_text("5\tname\n0\n")
    assert read_groups(spark, str(tmp_path / "g"), 2).count() == 2
    with pytest.raises(ValueError):
        read_groups(spark, str(tmp_path / "g"), 3)


def test_sketch_round_trip_and_sinks(spark, tmp_path):
    p = SketchParams(half_context=4, outer=1, fold=0)
    records = spark.createDataFrame([(1, "ACGTTGCATGCCATAGGT" * 3), (2, "TTGACCATGACATTAGAC" * 2)], "genome_id long, seq string")
    keys = sketch(records, p)
    write_sketch(keys, spark.createDataFrame([(1, "a"), (2, "b")], "genome_id long, name string"), p, str(tmp_path / "s"))
    back, genomes, params = read_sketch(spark, str(tmp_path / "s"))
    assert params == p and genomes.count() == 2
    assert sorted(map(tuple, back.select("genome_id", "ctxobj", "cnt").collect())) == sorted(map(tuple, keys.select("genome_id", "ctxobj", "cnt").collect()))
    write_index(inverted_index(back, p.object_bits), "index_of_test", 4)
    assert spark.table("index_of_test").count() == back.count()
    spark.sql("DROP TABLE index_of_test")
    write_kmers(kmers(back, p), str(tmp_path / "k"))
    assert spark.read.text(str(tmp_path / "k")).count() == back.count()
    write_tsv(back, str(tmp_path / "t"))
    assert spark.read.option("sep", "\t").option("header", "true").csv(str(tmp_path / "t")).count() == back.count()


def test_arriving_records(spark, tmp_path):
    p = SketchParams(half_context=4, fold=0)
    records = spark.createDataFrame([(1, "ACGTTGCATGCC")], "genome_id long, seq string")
    for _ in range(2):  # a second delivery comes as a batch of its own
        records.write.mode("append").parquet(str(tmp_path / "in"))
        append_keys(arriving_records(spark, str(tmp_path / "in"), records.schema), p, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).agg({"cnt": "sum"}).first()[0] == 2 * 5
