import random

import pytest

from kmerloom.__main__ import main
from kmerloom.operators.pipeline import ani_of_first, ani_of_sequences, as_references, fraction_sketch
from kmerloom.sources.binary import write_vectors


def genomes():
    rnd = random.Random(12)
    base = rnd.choices("ACGT", k=6000)
    near = [rnd.choice("ACGT") if rnd.random() < 0.004 else c for c in base]
    return [(1, "".join(base)), (2, "".join(near)), (3, "".join(rnd.choices("ACGT", k=6000)))]


def test_near_genomes_are_found(spark):
    df = spark.createDataFrame(genomes(), "genome_id long, seq string")
    got = {(r.q, r.r): r for r in ani_of_sequences(df, df, fold=1, least_ani=0.9).collect()}
    assert got[1, 1].ani == 1.0 and got[1, 1].place == 1 and 0.97 < got[1, 2].ani < 1 and (1, 3) not in got
    assert [r.r for r in ani_of_first(df, fold=1, least_ani=0.9).collect()] == [2]


def test_fraction_sketch(spark):
    df = spark.createDataFrame(genomes(), "genome_id long, seq string")
    every, part = fraction_sketch(df, 20, 1), fraction_sketch(df, 20, 10)
    assert 0.07 < part.count() / every.count() < 0.13 and part.join(every, ["genome_id", "ctxobj"], "left_anti").count() == 0
    assert as_references(every, 0).count() == every.count()
    with pytest.raises(ValueError):
        fraction_sketch(df, 21, 10)


def test_commands(spark, tmp_path):
    for g, seq in genomes():
        (tmp_path / f"g{g}.fa").write_text(f">a\n{seq}\n>b\n{seq[:500]}\n")
    run = lambda *args: main(list(map(str, args)), spark)
    run("sketch", tmp_path, "-T", "-f", 1, "-o", tmp_path / "s")
    run("merge", tmp_path / "s", tmp_path / "s", "-o", tmp_path / "m")
    assert spark.read.parquet(f"{tmp_path}/m/genomes").count() == 6
    run("set", tmp_path / "s", "-u", "-o", tmp_path / "pan")
    run("set", tmp_path / "s", "-s", tmp_path / "pan", "-o", tmp_path / "none")
    assert spark.read.parquet(f"{tmp_path}/none").count() == 0
    for command, *more in (("dist", "-N", 1), ("matrix",), ("ani", "-n", 0.9), ("composite",)):
        run(command, tmp_path / "s", tmp_path / "s", *more, "-o", tmp_path / command)
    read = lambda name: spark.read.option("sep", "\t").option("header", "true").csv(str(tmp_path / name))
    assert read("dist").count() == 3 and read("matrix").count() == 9 and read("ani").where("q <> r").count() == 2
    run("reverse", tmp_path / "s", "-o", tmp_path / "kmers")
    assert spark.read.text(str(tmp_path / "kmers")).count() == spark.read.parquet(f"{tmp_path}/s/keys").count()


def test_more_commands(spark, tmp_path):
    files = tmp_path / "in"
    files.mkdir()
    for g, seq in genomes():
        (files / f"g{g}.fa").write_text(f">a\n{seq}\n")
    (tmp_path / "list").write_text("".join(f"{files}/g{g}.fa\n" for g in (1, 2)))
    run = lambda *args: main(list(map(str, args)), spark)
    read = lambda name, header=True: spark.read.option("sep", "\t").option("header", str(header).lower()).csv(str(tmp_path / name))
    run("sketch", tmp_path / "list", "-l", "-i", "-T", "-f", 1, "-o", tmp_path / "two")
    assert spark.read.parquet(f"{tmp_path}/two/genomes").count() == 2
    assert spark.read.parquet(f"{tmp_path}/two/index").count() == spark.read.parquet(f"{tmp_path}/two/keys").count()
    run("sketch", files, "-T", "-f", 1, "-o", tmp_path / "s")
    run("export", tmp_path / "s", "-o", tmp_path / "bin")
    run("import", tmp_path / "bin", "-o", tmp_path / "back")
    run("ani", tmp_path / "back", tmp_path / "s", "-v", "-n", 0.5, "-o", tmp_path / "naive")
    assert read("naive").where("q = r").count() == 3
    run("ani", tmp_path / "s", tmp_path / "s", "--direct", "-n", 0.9, "-o", tmp_path / "direct")
    assert read("direct").where("q <> r").count() == 2
    for name, options, cells in (("m1", ["-m", 1], 9), ("m2", ["-m", 2, "-s", -2], 3)):
        run("ani", tmp_path / "s", tmp_path / "s", *options, "-o", tmp_path / name)
        assert read(name).count() == cells
    run("matrix", tmp_path / "s", tmp_path / "s", "-t", "-d", "-n", "-o", tmp_path / "context")
    assert read("context").count() == 6
    run("dist", tmp_path / "s", tmp_path / "s", "-O", 0, "-o", tmp_path / "d0")
    assert "p" not in read("d0").columns and "dist" in read("d0").columns
    run("dist", tmp_path / "s", tmp_path / "s", "-A", "-o", tmp_path / "abundance")
    assert "mean_cnt" in read("abundance").columns
    run("derep", tmp_path / "s", "-c", 0.05, "-o", tmp_path / "codes")
    assert sorted(r[1].split("\t")[0] for r in read("codes", False).collect()) == ["0", "1", "2"]
    run("pair", files, "-f", 1, "-o", tmp_path / "pair")
    assert read("pair").count() == 1
    run("shuffle", "-k", 6, "-s", 4, "-l", 1, "-o", tmp_path / "x.shuf")
    run("legacy", files, "--shuf", tmp_path / "x.shuf", "-n", 1, "-o", tmp_path / "old")
    run("legacy", files, "-k", 6, "-s", 4, "-L", 1, "-u", "-o", tmp_path / "once")
    assert spark.read.parquet(f"{tmp_path}/old").where("cnt = 1").count() == spark.read.parquet(f"{tmp_path}/once").count() > 0
    write_vectors(spark.createDataFrame([("x", 1, 60.0), ("x", 2, 40.0), ("y", 1, 100.0)], "sample string, ref_idx long, pct double"), str(tmp_path / "v"))
    run("vectors", tmp_path / "v", "-o", tmp_path / "listed")
    run("vectors", tmp_path / "v", "-s", "l1", "-q", "x", "-o", tmp_path / "found")
    assert read("listed").count() == 3 and [r.sample for r in read("found").orderBy("place").collect()] == ["x", "y"]
