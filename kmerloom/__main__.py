"""python -m kmerloom COMMAND ...: the operators over files, one sketch folder in and tables out.

shuffle -o OUT.shuf [-k 8 -s 5 -l 2 --seed 1]
sketch  FILES_OR_FOLDER [-l] -o OUT [-C 11 -O 0 -I 0 -f 12 -n 1 -T --conflict --splitmfa -i]
import  BINARY_FOLDER -o OUT          (a native binary sketch folder)
export  SKETCH -o BINARY_FOLDER
merge   SKETCH... -o OUT
set     SKETCH (-u | -q | --markerdb | -i PAN | -s PAN | -g GROUPS | -P | --psketch | --pindex) -o OUT
legacy  FILES_OR_FOLDER -o OUT [-k 8 -s 5 -L 2 --shuf FILE -n 1 -Q 0 -u]
dist    REF QUERY -o OUT [-N 0 -D 1 -M 0 -C 0 -O 2 -A --correction]
matrix  REF QUERY -o OUT [-m mash -e -1 -n]      (REF = QUERY with -t: triangle, -d with diagonal)
derep   SKETCH -o OUT [-m mash -c 0.05]          (-c and -g of matrix and ani: codes of the chosen genomes)
ani     REF QUERY -o OUT [-f 0.3 -n 0.95 -s 1 -e 1 -x -v -m 0 --direct]
pair    FILES_OR_FOLDER -o OUT [-f 8]            (the first genome against the others)
composite REF QUERY -o OUT [-b]
vectors FOLDER -o OUT [-s l1|l2|cosine -q SAMPLE...]   (reads .abv files, or searches them)
reverse SKETCH -o OUT
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession, functions as F

from kmerloom.functions.kernel import SketchParams
from kmerloom.operators import ani, composite, distance, legacy, setops, sketching
from kmerloom.operators.pipeline import ani_of_first
from kmerloom.sources import binary
from kmerloom.sources.files import folder_files, listed_files, read_groups, read_sequences, with_genome_ids
from kmerloom.sources.sinks import read_sketch, write_kmers, write_sketch, write_tsv


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="kmerloom", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, *inputs: str, many: bool = False) -> argparse.ArgumentParser:
        sub = commands.add_parser(name)
        for each in inputs:
            sub.add_argument(each, **({"nargs": "+"} if many else {}))
        sub.add_argument("-o", "--out", required=True)
        return sub

    one = command("sketch", "input")
    for flag, name, default in (("-C", "half_context", 11), ("-O", "outer", 0), ("-I", "inner", 0), ("-f", "fold", 12), ("-n", "least_count", 1)):
        one.add_argument(flag, dest=name, type=int, default=default)
    one.add_argument("-T", dest="coden", action="store_true")
    one.add_argument("-l", dest="listed", action="store_true", help="the input is a file with one path a line")
    one.add_argument("-i", dest="index", action="store_true", help="also the inverted index, in OUT/index")
    one.add_argument("--conflict", action="store_true")
    one.add_argument("--splitmfa", action="store_true")
    command("merge", "sketches", many=True)
    shuffle = command("shuffle")
    older = command("legacy", "input")
    for flag, name, default in (("-k", "half_k", 8), ("-s", "half_subcontext", 5), ("-l", "level", 2), ("--seed", "seed", 1)):
        shuffle.add_argument(flag, dest=name, type=int, default=default)
        older.add_argument(flag.upper() if name == "level" else flag, dest=name, type=int, default=default)
    older.add_argument("--shuf")
    older.add_argument("-n", dest="least", type=int, default=1)
    older.add_argument("-Q", dest="quality", type=int, default=0)
    older.add_argument("-u", dest="once", action="store_true")
    command("import", "folder")
    command("export", "sketch")
    derep = command("derep", "sketch")
    derep.add_argument("-m", dest="metric", choices=("mash", "aaf"), default="mash")
    derep.add_argument("-c", dest="limit", type=float, default=0.05)
    pair = command("pair", "input")
    pair.add_argument("-f", dest="fold", type=int, default=8)
    vectors = command("vectors", "folder")
    vectors.add_argument("-s", dest="measure", choices=("l1", "l2", "cosine"))
    vectors.add_argument("-q", dest="samples", nargs="+", default=[])
    sets = command("set", "sketch").add_mutually_exclusive_group(required=True)
    for flag, name in (("-u", "union"), ("-q", "unique"), ("--markerdb", "markers"), ("-P", "sizes"), ("--psketch", "keys"), ("--pindex", "index")):
        sets.add_argument(flag, dest=name, action="store_true")
    for flag, name in (("-i", "intersect"), ("-s", "subtract"), ("-g", "groups")):
        sets.add_argument(flag, dest=name)
    dist = command("dist", "ref", "query")
    dist.add_argument("-N", dest="nearest", type=int, default=0)
    dist.add_argument("-D", dest="limit", type=float, default=1.0)
    dist.add_argument("-M", dest="containment", type=int, choices=(0, 1), default=0)
    dist.add_argument("-C", dest="divide_by", type=int, choices=(0, 1, 2), default=0)
    dist.add_argument("-O", dest="fields", type=int, choices=(0, 1, 2), default=2)
    dist.add_argument("-A", dest="abundance", action="store_true")
    dist.add_argument("--correction", action="store_true")
    matrix = command("matrix", "ref", "query")
    matrix.add_argument("-m", dest="metric", choices=("jaccard", "containment", "mash", "aaf"), default="mash")
    matrix.add_argument("-e", dest="missing", type=float, default=-1.0)
    matrix.add_argument("-n", dest="context", action="store_true")
    matrix.add_argument("-t", dest="triangle", action="store_true")
    matrix.add_argument("-d", dest="diagonal", action="store_true")
    table = command("ani", "ref", "query")
    table.add_argument("-v", dest="naive", action="store_true")
    table.add_argument("-m", dest="form", type=int, choices=(0, 1, 2), default=0)
    table.add_argument("--direct", action="store_true", help="the way without an index: the reference's fraction decides")
    table.add_argument("-f", dest="fraction", type=float, default=0.3)
    table.add_argument("-n", dest="ani", type=float, default=0.95)
    table.add_argument("-s", dest="metric", type=int, choices=[x for x in range(-5, 6) if x], default=1)
    table.add_argument("-e", dest="far", type=float, default=1.0)
    table.add_argument("-x", dest="unassembled", action="store_true")
    command("composite", "ref", "query").add_argument("-b", dest="vectors", action="store_true")
    command("reverse", "sketch")
    return top


def _two(spark: SparkSession, a) -> tuple[DataFrame, DataFrame, SketchParams, int]:
    ref, genomes, params = read_sketch(spark, a.ref)
    query, others, same = read_sketch(spark, a.query)
    if params.hash_id != same.hash_id:
        raise SystemExit("the sketches have different parameters")
    return ref, query, params, genomes.count() * others.count()


def _set(spark: SparkSession, a) -> DataFrame:
    keys, genomes, params = read_sketch(spark, a.sketch)
    pan = spark.read.parquet(a.intersect or a.subtract) if a.intersect or a.subtract else None
    index = lambda: setops.index_listing(sketching.inverted_index(keys, params.object_bits))
    choices = {
        "union": lambda: setops.union(keys), "unique": lambda: setops.unique_union(keys), "markers": lambda: setops.markers(keys), "sizes": lambda: setops.sizes(keys, genomes), "keys": lambda: setops.key_listing(keys),
        "index": index, "intersect": lambda: setops.intersect(keys, pan), "subtract": lambda: setops.subtract(keys, pan), "groups": lambda: setops.group_union(keys, setops.checked_groups(read_groups(spark, a.groups, genomes.count()))),
    }
    return next(make for name, make in choices.items() if getattr(a, name))()


def _triangle(rows: DataFrame, triangle: bool, diagonal: bool) -> DataFrame:
    """A matrix's cells: all, or those with r before q, and the diagonal."""
    return rows.where("r < q" + (" or r = q" if diagonal else "")) if triangle else rows


def _sketch(spark: SparkSession, a) -> None:
    params = SketchParams(a.half_context, a.outer, a.inner, a.fold, a.coden, a.least_count, a.conflict)
    paths = [r.path for r in listed_files(spark, a.input).collect()] if a.listed else a.input  # a list of files is given by hand
    records = with_genome_ids(read_sequences(spark, paths), folder_files(spark, paths))
    if a.splitmfa:
        records = records.withColumn("genome_id", F.col("genome_id") * (1 << 40) + F.col("rec_id")).withColumn("path", F.col("name"))
        keys = sketching.sketch_by_record(records, params, "genome_id")
    else:
        keys = sketching.sketch(records, params)
    write_sketch(keys, records.select("genome_id", F.col("path").alias("name")).distinct(), params, a.out)
    if a.index:
        sketching.inverted_index(read_sketch(spark, a.out)[0], params.object_bits).repartition("ctx").sortWithinPartitions("ctx", "genome_id", "obj").write.parquet(f"{a.out}/index")


def _merge(spark: SparkSession, a) -> None:
    parts = [read_sketch(spark, x) for x in a.sketches]
    counts = [g.agg(F.max("genome_id")).first()[0] + 1 for _, g, _ in parts]
    merged = sketching.merge(*((k, n, p) for (k, _, p), n in zip(parts, counts, strict=True)))
    offset, names = 0, None
    for (_, g, _), n in zip(parts, counts, strict=True):
        moved = g.withColumn("genome_id", F.col("genome_id") + offset)
        names = moved if names is None else names.unionByName(moved)
        offset += n
    write_sketch(merged, names, parts[0][2], a.out)


def _legacy(spark: SparkSession, a) -> DataFrame:
    header, ranks = binary.read_shuffle(a.shuf) if a.shuf else (vars(a), None)
    records = with_genome_ids(read_sequences(spark, a.input), folder_files(spark, a.input))
    keys = legacy.legacy_keys(records, header["half_k"], header["half_subcontext"], header["level"], a.seed, quality="qual" if a.quality else None, least_quality=a.quality, ranks=ranks)
    return legacy.once_only(keys) if a.once else legacy.frequent(keys, a.least) if a.least > 1 else keys


def _vectors(spark: SparkSession, a) -> DataFrame:
    rows = binary.read_vectors(spark, a.folder)
    return rows if a.measure is None else composite.search_vectors(rows.where(F.col("sample").isin(a.samples)) if a.samples else rows, rows, a.measure)


def _between(spark: SparkSession, a) -> DataFrame:
    """The commands that compare two sketches."""
    ref, query, params, comparisons = _two(spark, a)
    index = lambda keys: sketching.inverted_index(keys, params.object_bits)
    if a.command == "ani":
        bases = params.context_mask.bit_count() // 2
        options = dict(metric=ani.METRICS[abs(a.metric) - 1], far=a.far, unassembled=a.unassembled, context_bases=bases, naive=a.naive)
        if a.form:  # a matrix has every pair
            out = ani.ani_table(index(query), index(ref), 0.0, -1e9, **options).select("q", "r", "ani", "dist")
            return _triangle(distance.full_matrix(out, query, ref, "ani" if a.metric > 0 else "dist", 0.0 if a.metric > 0 else a.far), a.form == 2, False)
        return ani.ranked(ani.ani_table(index(query), index(ref), a.fraction, a.ani, rough=not a.direct, **options), "ani" if a.direct else "rough_ani")
    if a.command == "composite":
        out = composite.composition(query, ref)
        return composite.abundance_vectors(out) if a.vectors else composite.ranked(out)
    if a.command == "dist" and a.abundance:
        return legacy.mean_shared_abundance(query.withColumnRenamed("ctxobj", "key"), ref.withColumnRenamed("ctxobj", "key"))
    if a.command == "matrix" and a.context:
        cells = ani.context_ani(index(query), index(ref), max(1, params.object_bits // 2))
        return _triangle(distance.full_matrix(cells, query, ref, "ani", a.missing), a.triangle, a.diagonal)
    pairs = distance.sized_overlaps(query, ref)
    if a.command == "matrix":
        return _triangle(distance.full_matrix(distance.similarities(pairs, params.k), query, ref, a.metric, a.missing), a.triangle, a.diagonal)
    by = ("min", "ref", "qry")[a.divide_by] if a.containment else None
    out = distance.with_p_values(distance.sampled_distance(pairs, params.k, params.fold // 2, by, a.correction, a.limit), comparisons)
    out = distance.nearest(out, "metric", a.nearest) if a.nearest else out
    more = {0: ["p", "q_value", "sd", "metric_low", "metric_high", "dist_low", "dist_high"], 1: ["sd", "metric_low", "metric_high", "dist_low", "dist_high"], 2: []}
    return out.drop(*more[a.fields])


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = _parser().parse_args(args)
    if a.command == "shuffle":
        if not binary.write_shuffle(legacy.permutation(a.half_subcontext, a.seed), a.half_k, a.half_subcontext, a.level, a.seed, a.out):
            print(f"fewer than {legacy.LEAST_DIMENSIONS} dimensions are kept; -s {a.level + 3} is better", file=sys.stderr)
        return
    spark = spark or SparkSession.builder.appName("kmerloom").getOrCreate()
    if a.command == "sketch":
        _sketch(spark, a)
    elif a.command == "merge":
        _merge(spark, a)
    elif a.command == "set":
        _set(spark, a).write.parquet(a.out)
    elif a.command == "reverse":
        keys, _, params = read_sketch(spark, a.sketch)
        write_kmers(sketching.kmers(keys, params), a.out)
    elif a.command == "import":
        keys, genomes, header = binary.read_sketch_folder(spark, a.folder)
        if "codens" not in header:
            raise SystemExit("an older sketch folder; its keys are those of the legacy command")
        coden = header["codens"] > 0
        inner = 0 if coden else header["k"] - 2 * (header["half_context"] + header["outer"])
        params = SketchParams(header["half_context"] or 11, header["outer"], inner, header["fold"], coden, 1, header["conflicts"])
        write_sketch(keys, genomes, params, a.out)
    elif a.command == "export":
        binary.write_binary_sketch(*read_sketch(spark, a.sketch), a.out)
    elif a.command == "legacy":
        _legacy(spark, a).write.parquet(a.out)
    elif a.command == "derep":
        keys, genomes, params = read_sketch(spark, a.sketch)
        write_tsv(distance.selection_codes(distance.dereplicate_sketches(keys, a.limit, params.k, a.metric), genomes), a.out, header=False)
    elif a.command == "pair":
        records = with_genome_ids(read_sequences(spark, a.input), folder_files(spark, a.input))
        write_tsv(ani_of_first(records, a.fold), a.out)
    elif a.command == "vectors":
        write_tsv(_vectors(spark, a), a.out)
    else:
        write_tsv(_between(spark, a), a.out)


if __name__ == "__main__":
    main(sys.argv[1:])
