"""Queries of the genome operators, with their SQL. Searches ask every genome whose id is divisible by 50 against all."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from kmerloom.functions.kernel import SketchParams
from kmerloom.functions.scalars import differing_bases, reverse_complement
from kmerloom.operators import ani, composite, distance, legacy, pipeline, reports, setops, sketching
from kmerloom.operators.hierarchy import clean_rank, parent_number
from kmerloom.plans.tables import table
from kmerloom.session import Scratch

PLAIN = SketchParams(fold=4)
PATTERNED = SketchParams(half_context=8, outer=1, inner=2, fold=4)
CODEN = SketchParams(fold=4, coden=True)
OBJECT_BITS = 20
K = 32
LOW = (1 << OBJECT_BITS) - 1


def records_of(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record, whatever was redelivered, without white space. Sequences aren't sorted: a redelivered one is the same."""
    rows = table(spark, folder, "command_sketch").where("rec_id is not null")
    return rows.groupBy("rec_id").agg(F.max("genome_id").alias("genome_id"), F.first(F.regexp_replace("seq", r"\s", ""), ignorenulls=True).alias("seq"))


def values_of(spark: SparkSession, folder: str) -> DataFrame:
    """(genome_id, ctxobj, cnt) of the sketch table's rows that hold a value, repeated ones too."""
    low = F.lit(LOW).cast("bigint")
    key = F.col("ctxgid").bitwiseAND(F.bitwise_not(low)).bitwiseOR(F.col("obj").cast("bigint"))
    rows = table(spark, folder, "sketch").where("ctxgid is not null and obj is not null")
    return rows.select(F.col("ctxgid").bitwiseAND(low).alias("genome_id"), key.alias("ctxobj"), "cnt")


def keys_of(spark: SparkSession, folder: str) -> DataFrame:
    """(genome_id, ctxobj, cnt) of the sketch table: distinct values with their highest count."""
    return values_of(spark, folder).groupBy("genome_id", "ctxobj").agg(F.max(F.coalesce("cnt", F.lit(1))).cast("bigint").alias("cnt"))


def asked(keys: DataFrame) -> DataFrame:
    return keys.where("genome_id % 50 = 0")


def _index(keys: DataFrame) -> DataFrame:
    low = F.lit(LOW).cast("bigint")
    return keys.select(F.shiftright("ctxobj", OBJECT_BITS).alias("ctx"), "genome_id", F.col("ctxobj").bitwiseAND(low).alias("obj"))


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    keys = keys_of(spark, folder)
    return distance.sized_overlaps(asked(keys), keys)


def rounded(rows: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return rows.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in columns})


def _taxa(spark: SparkSession, folder: str) -> DataFrame:
    """One taxid per genome: the smallest that isn't 0."""
    return table(spark, folder, "genomes").where("taxid <> 0").groupBy(F.col("genome_id").cast("bigint").alias("genome_id")).agg(F.min("taxid").alias("taxid"))


def sketch_plain(spark, folder):
    return sketching.sketch(records_of(spark, folder), PLAIN)


def sketch_patterned(spark, folder):
    return sketching.sketch(records_of(spark, folder), PATTERNED)


def sketch_coden(spark, folder):
    return sketching.sketch(records_of(spark, folder), CODEN)


def sketch_records(spark, folder):
    return sketching.sketch_by_record(records_of(spark, folder), PLAIN, "rec_id")


def sketch_repeated(spark, folder):
    return sketching.sketch(records_of(spark, folder), SketchParams(half_context=4, fold=2, least_count=2))


def sketch_legacy(spark, folder):
    return legacy.legacy_keys(records_of(spark, folder), 8, 4, 1, seed=11)


def reverse_kmers(spark, folder):
    return sketching.kmers(sketch_plain(spark, folder), PLAIN).select("genome_id", "ctxobj", "kmer", "reverse_complement")


def inverted_index(spark, folder):
    return _index(keys_of(spark, folder))


def index_summary(spark, folder):
    return sketching.index_summary(_index(keys_of(spark, folder)))


def sketch_sizes(spark, folder):
    return setops.sizes(keys_of(spark, folder), table(spark, folder, "genomes"))


def set_union(spark, folder):
    return setops.union(keys_of(spark, folder))


def set_unique_union(spark, folder):
    return setops.unique_union(keys_of(spark, folder))


def set_markers(spark, folder):
    return setops.markers(keys_of(spark, folder))


def set_intersect(spark, folder):
    keys = keys_of(spark, folder)
    return setops.intersect(keys, setops.unique_union(keys))


def set_subtract(spark, folder):
    keys = keys_of(spark, folder)
    return setops.subtract(keys, setops.unique_union(keys))


def set_group_union(spark, folder):
    return setops.group_union(keys_of(spark, folder), _taxa(spark, folder))


def set_key_listing(spark, folder):
    return setops.key_listing(keys_of(spark, folder))


def set_combine(spark, folder):
    keys = keys_of(spark, folder)
    return setops.combine(setops.union(keys), setops.unique_union(keys))


def conflict_free(spark, folder):
    return sketching.without_conflicts(keys_of(spark, folder), OBJECT_BITS)


def dist_similarity(spark, folder):
    return rounded(distance.similarities(_pairs(spark, folder), K), "jaccard", "containment", "mash", "aaf")


def dist_corrected(spark, folder):
    out = distance.sampled_distance(_pairs(spark, folder), K, 18, correction=True)
    return rounded(out, "rs", "metric", "dist", "sd", "metric_low", "metric_high", "dist_low", "dist_high")


def dist_containment(spark, folder):
    out = distance.sampled_distance(_pairs(spark, folder), K, containment="qry", limit=0.2)
    return rounded(out, "rs", "metric", "dist", "sd", "metric_low", "metric_high", "dist_low", "dist_high")


def dist_p_values(spark, folder):
    """P values as negative logarithms, null where they are below 1e-290; the number of comparisons is queries times references."""
    keys = distance.distinct_keys(keys_of(spark, folder), "keys")
    genomes = keys.select("genome_id").distinct()
    comparisons = genomes.where("genome_id % 50 = 0").count() * genomes.count()
    out = distance.with_p_values(distance.sampled_distance(distance.sized_overlaps(asked(keys), keys), K), comparisons)
    power = F.when(F.col("p") > 1e-290, -F.log10("p"))
    return rounded(out.select("q", "r", "shared", "metric", "dist", power.alias("p_power"), F.when(F.col("p") > 1e-290, -F.log10("q_value")).alias("q_power")), "metric", "dist", "p_power", "q_power", digits=5)


def dist_nearest(spark, folder):
    near = distance.nearest(distance.similarities(_pairs(spark, folder), K), "jaccard", 5)
    return rounded(near.select("q", "r", "shared", "jaccard", "place"), "jaccard")


def matrix_full(spark, folder):
    keys = keys_of(spark, folder)
    pairs = distance.similarities(distance.sized_overlaps(asked(keys), keys), K)
    return rounded(distance.full_matrix(pairs, asked(keys), keys, "mash"), "value")


def dereplicated(spark, folder):
    return distance.dereplicate_sketches(keys_of(spark, folder), 0.2, K)


def ani_features(spark, folder):
    index = _index(values_of(spark, folder))
    return ani.features(asked(index), index)


def ani_detail(spark, folder):
    index = _index(values_of(spark, folder))
    out = ani.ani_table(asked(index), index, least_fraction=0.1, least_ani=0.8, digits=5)
    return out.drop("rough_ani")


def ani_unassembled(spark, folder):
    index = _index(values_of(spark, folder))
    out = ani.ani_table(asked(index), index, least_fraction=0.1, least_ani=0.8, unassembled=True, digits=5)
    return out.drop("rough_ani")


def ani_contexts(spark, folder):
    index = _index(values_of(spark, folder))
    return rounded(ani.context_ani(asked(index), index, 10), "ani")


def composition(spark, folder):
    keys = keys_of(spark, folder)
    return rounded(composite.composition(asked(keys), keys), "mean", "pct98_99")


def dereplication_codes(spark, folder):
    """Kept genomes with their running number, the others without."""
    return distance.selection_codes(dereplicated(spark, folder), table(spark, folder, "genomes").withColumn("genome_id", F.col("genome_id").cast("bigint")))


def _detail(metric="model", rough=True, naive=False):
    def query(spark, folder):
        index = _index(values_of(spark, folder))
        out = ani.ani_table(asked(index), index, least_fraction=0.1, least_ani=0.8, metric=metric, rough=rough, naive=naive, digits=5)
        return out.drop("rough_ani")

    return query


def _ranked(rough):
    def query(spark, folder):
        index = _index(values_of(spark, folder))
        by = "rough_ani" if rough else "ani"
        out = ani.ani_table(asked(index), index, least_fraction=0.1, least_ani=0.8, rough=rough, digits={by: 5}, columns=("q", "r", "xny_ctx", "af_qry", by))
        return ani.ranked(out, by).select("q", "r", "xny_ctx", "place")

    return query


def merged(spark, folder):
    """The sketch table twice as one sketch: the second copy's genomes are moved up."""
    keys = keys_of(spark, folder)
    return sketching.merge((keys, 1_000_000, CODEN), (keys, 1_000_000, CODEN))


def index_listing(spark, folder):
    return setops.index_listing(_index(keys_of(spark, folder)))


def posting_lists(spark, folder):
    lists = legacy.posting_lists(keys_of(spark, folder), "ctxobj")
    return lists.select("ctxobj", F.array_join(F.transform("genomes", lambda x: x.cast("string")), ",").alias("genomes"))


def legacy_once(spark, folder):
    return legacy.once_only(sketch_legacy(spark, folder)).select("genome_id", "key")


def legacy_frequent(spark, folder):
    """Short keys that a genome has twice or more."""
    return legacy.frequent(legacy.legacy_keys(records_of(spark, folder), 4, 4, 1, seed=11), 2)


def legacy_quality(spark, folder):
    """Bases T have a low quality here, so k-mers with one don't count."""
    records = records_of(spark, folder).withColumn("qual", F.translate("seq", "ACGTacgt", "III#III#"))
    return legacy.legacy_keys(records, 4, 4, 1, seed=11, quality="qual", least_quality=10)


def legacy_by_record(spark, folder):
    """Keys of every record by itself."""
    return legacy.legacy_keys(records_of(spark, folder), 8, 4, 1, seed=11, genome="rec_id").withColumnRenamed("genome_id", "rec_id")


def legacy_record_kmers(spark, folder):
    """The records' k-mers out of their keys, each as often as it occurs."""
    rows = legacy.legacy_kmer(legacy_by_record(spark, folder), 8)
    return rows.select("rec_id", "kmer", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("cnt"))).alias("copy"))


def ani_of_sequences(spark, folder):
    """From sequences to ranked pairs in one run."""
    records = records_of(spark, folder)
    out = pipeline.ani_of_sequences(records.where("genome_id % 50 = 0"), records, fold=4, least_fraction=0.0, least_ani=0.0)
    return rounded(out.select("q", "r", "xny_ctx", "n_diff_obj", "n_diff_obj_section", "n_mut2_ctx", "ani"), "ani", digits=5)


def legacy_kmers(spark, folder):
    return legacy.legacy_kmer(sketch_legacy(spark, folder), 8)


def legacy_abundance(spark, folder):
    keys = sketch_legacy(spark, folder)
    return rounded(legacy.mean_shared_abundance(asked(keys), keys), "mean_cnt")


def vectors_of(spark, folder):
    """Of all samples: every one may be the nearest to one that is asked."""
    keys = keys_of(spark, folder)
    return Scratch(spark, "vectors").keep(composite.abundance_vectors(composite.composition(keys, keys)), "vectors")


def abundance_vectors(spark, folder):
    return rounded(vectors_of(spark, folder), "pct")


def _search(measure):
    def query(spark, folder):
        vectors = vectors_of(spark, folder)
        found = rounded(composite.search_vectors(vectors.where("sample % 50 = 0"), vectors, measure).drop("place"), "measure")
        return composite.placed(found, measure)

    return query


def taxonomy_roll_up(spark, folder):
    """Sketch sizes of the genomes, summed at every ranked ancestor of their taxon."""
    nodes = table(spark, folder, "ncbitaxid_rank_parentnode_name").select("node", parent_number(F.col("pa")).alias("parent"), clean_rank(F.col("rank")).alias("rank"))
    sizes = keys_of(spark, folder).groupBy("genome_id").agg(F.count("*").cast("double").alias("value"))
    rows = sizes.join(_taxa(spark, folder), "genome_id").select(F.lit("all").alias("sample"), F.col("taxid").cast("bigint").alias("taxid"), "value")
    return reports.roll_up(rows, nodes, value="value")


def error_rate(spark, folder):
    return rounded(reports.error_rate(keys_of(spark, folder), 0.9, 0.1), "s", "r", digits=9)


def differing(spark, folder):
    """How many bases of the object differ from the context's smallest object."""
    index = _index(keys_of(spark, folder))
    least = index.groupBy("ctx").agg(F.min("obj").alias("least"))
    bases = differing_bases(F.col("obj").bitwiseXOR(F.col("least")))
    return index.join(least, "ctx").groupBy(bases.alias("bases")).agg(F.count("*").alias("n"))


def reversed_sequences(spark, folder):
    return records_of(spark, folder).select("rec_id", reverse_complement(F.upper("seq")).alias("reverse_complement"))


QUERIES = {
    f.__name__: f
    for f in (
        sketch_plain, sketch_patterned, sketch_coden, sketch_records, sketch_repeated, sketch_legacy, reverse_kmers, inverted_index, index_summary, sketch_sizes, set_union, set_unique_union, set_markers,
        set_intersect, set_subtract, set_group_union, set_key_listing, set_combine, conflict_free, dist_similarity, dist_corrected, dist_containment, dist_p_values, dist_nearest, matrix_full,
        dereplicated, dereplication_codes, merged, index_listing, posting_lists, legacy_once, legacy_frequent, legacy_quality, legacy_by_record, legacy_record_kmers, ani_of_sequences, legacy_kmers, legacy_abundance, ani_features, ani_detail, ani_unassembled, ani_contexts, composition, abundance_vectors, taxonomy_roll_up, error_rate, differing, reversed_sequences,
    )
} | {f"vector_search_{m}": _search(m) for m in ("l1", "l2", "cosine")}
QUERIES |= {f"ani_{m}": _detail(m) for m in ("mash", "aaf", "mash_if_far", "aaf_if_far")} | {"ani_direct": _detail(rough=False), "ani_naive": _detail(naive=True), "ani_ranked": _ranked(True), "ani_direct_ranked": _ranked(False)}
