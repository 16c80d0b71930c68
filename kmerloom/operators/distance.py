"""Pairwise overlaps of sketches and the distances made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from kmerloom.functions.scalars import aaf_distance, erfc, jaccard, mash_distance, max_containment
from kmerloom.operators.skew import SALTS, hot_left_join, list_block
from kmerloom.session import Scratch


def distinct_keys(keys: DataFrame, name: str) -> DataFrame:
    """(genome_id, ctxobj), each once, stored: overlaps and sizes read it again."""
    rows = keys.where("genome_id is not null and ctxobj is not null").select("genome_id", "ctxobj").distinct()
    return Scratch(keys.sparkSession, "overlaps").keep(rows, name)


def overlaps(queries: DataFrame, refs: DataFrame) -> DataFrame:
    """(q, r, shared): how many keys a query and a reference genome share; pairs without any are left out.

    Both sides are stored tables of distinct keys (``distinct_keys``). The queries of every key are gathered into lists of bounded
    length, so a reference row meets a few list rows, and keys that many reference rows hold are spread by ``hot_left_join``.
    """
    lists = queries.groupBy("ctxobj", list_block(F.col("genome_id")).alias("block")).agg(F.collect_list("genome_id").alias("qs")).select(F.col("ctxobj").alias("of"), "qs")
    met = hot_left_join(refs.select(F.col("genome_id").alias("r"), "ctxobj"), lists, "ctxobj", "of", refs.count(), salts=SALTS).where("qs is not null")
    return met.select(F.explode("qs").alias("q"), "r").groupBy("q", "r").agg(F.count("*").alias("shared"))


def set_sizes(keys: DataFrame) -> DataFrame:
    """(genome_id, size) of distinct keys."""
    return keys.groupBy("genome_id").agg(F.count("*").alias("size"))


def with_sizes(pairs: DataFrame, q: DataFrame, r: DataFrame) -> DataFrame:
    """Adds q_size and r_size, from (genome_id, size) of either side."""
    out = pairs.join(q.select(F.col("genome_id").alias("q"), F.col("size").alias("q_size")), "q")
    return out.join(r.select(F.col("genome_id").alias("r"), F.col("size").alias("r_size")), "r").select("q", "r", "shared", "q_size", "r_size")


def sized_overlaps(queries: DataFrame, refs: DataFrame) -> DataFrame:
    """(q, r, shared, q_size, r_size) of any two sketches: repeated rows count once, rows with a null key or genome don't."""
    asked, held = distinct_keys(queries, "queries"), distinct_keys(refs, "references")
    return with_sizes(overlaps(asked, held), set_sizes(asked), set_sizes(held))


def similarities(pairs: DataFrame, k: int) -> DataFrame:
    """Jaccard, containment, and the Mash and AAF distances of every pair."""
    n, x, y = F.col("shared"), F.col("r_size"), F.col("q_size")
    return pairs.select("*", jaccard(n, x, y).alias("jaccard"), max_containment(n, x, y).alias("containment"), mash_distance(n, x, y, k).alias("mash"), aaf_distance(n, x, y, k).alias("aaf"))


def sampled_distance(pairs: DataFrame, k: int, dropped: int = 0, containment: str | None = None, correction: bool = False, limit: float = 1.0) -> DataFrame:
    """Adds rs, metric, dist and its statistics: sd, the interval of the metric and of the distance (95 %).

    ``containment`` is None for Jaccard, or "min", "ref" or "qry" for the size that the overlap is divided by. ``dropped`` is
    the number of bases of the k-mer that the sampling fixes; ``correction`` takes off the overlap expected by chance. Distances
    above 1 become 1, pairs above ``limit`` are left out.
    """
    n, x, y = (F.col(c).cast("double") for c in ("shared", "r_size", "q_size"))
    rs = F.lit(0.0)
    if correction:
        chance = [1 - F.pow(F.lit(1 - 4.0 ** -(k - dropped)), size - n) for size in (x, y)]
        rs = F.coalesce(chance[0] * chance[1] * (x + y - 2 * n) / F.nullif(chance[0] + chance[1] - 2 * chance[0] * chance[1], F.lit(0.0)), F.lit(0.0))
    size = {None: x + y - n, "min": F.least(x, y), "ref": x, "qry": y}[containment]

    def distance(metric):
        return F.when(metric > 0, F.log((1 / (2 * metric) + 0.5) if containment is None else 1 / metric) / k)

    out = pairs.select("*", rs.alias("rs"), size.alias("of")).withColumn("metric", (F.col("shared") - F.col("rs")) / F.col("of"))
    out = out.withColumn("dist", F.least(F.lit(1.0), F.coalesce(distance(F.col("metric")), F.lit(1.0)))).where(F.col("dist") <= limit)
    m, sd = F.col("metric"), F.col("sd")
    out = out.withColumn("sd", F.sqrt(F.greatest(F.lit(0.0), m * (1 - m)) / F.col("of"))).drop("of")
    low, high = m - 1.96 * sd, m + 1.96 * sd
    return out.select("*", low.alias("metric_low"), high.alias("metric_high"), distance(high).alias("dist_low"), distance(low).alias("dist_high"))


def with_p_values(distances: DataFrame, comparisons: int) -> DataFrame:
    """Adds p, the chance of no overlap beyond it, and q, p times the number of comparisons (made in 64 bits)."""
    p = F.coalesce(0.5 * erfc(F.col("metric") / F.nullif(F.col("sd"), F.lit(0.0)) * 2**-0.5), F.lit(0.0))
    return distances.withColumn("p", p).withColumn("q_value", F.col("p") * F.lit(float(comparisons)))


def nearest(pairs: DataFrame, metric: str, n: int) -> DataFrame:
    """The n references with the highest positive metric of each query; ties go to the smaller reference."""
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc(metric), "r"))
    return pairs.where(F.col(metric) > 0).withColumn("place", place).where(F.col("place") <= n)


def full_matrix(pairs: DataFrame, queries: DataFrame, refs: DataFrame, metric: str, missing: float = -1.0) -> DataFrame:
    """(q, r, value) of every query with every reference: the dense matrix in long form, ``missing`` where nothing is shared.

    Its size is the product of both sides by definition; ask it of a stated set of queries.
    """
    grid = queries.select(F.col("genome_id").alias("q")).distinct().crossJoin(refs.select(F.col("genome_id").alias("r")).distinct())
    return grid.join(pairs.select("q", "r", F.col(metric).alias("value")), ["q", "r"], "left").fillna(missing, ["value"])


def wide_matrix(long: DataFrame, refs: list[int]) -> DataFrame:
    """One row per query, one column per listed reference, values with six decimals."""
    return long.groupBy("q").pivot("r", refs).agg(F.format_string("%.6f", F.first("value")))


def symmetric(triangle: DataFrame, diagonal: float = 0.0) -> DataFrame:
    """(q, r, value) of a lower triangle in both directions, with the diagonal."""
    names = triangle.select(F.explode(F.array("q", "r")).alias("q")).distinct()
    both = triangle.select("q", "r", "value").unionByName(triangle.select(F.col("r").alias("q"), F.col("q").alias("r"), "value"))
    return both.unionByName(names.select("q", F.col("q").alias("r"), F.lit(diagonal).alias("value")))


def dereplicate(pairs: DataFrame, genomes: DataFrame, limit: float, distance: str = "mash") -> DataFrame:
    """(genome_id, kept): greedy choice in order of genome id; one is kept if no kept one is nearer than ``limit``.

    This is the greedy (lexicographically first) independent set of the graph of near pairs. Each round settles all genomes at
    once whose earlier neighbours are settled: those with a kept earlier neighbour go, those with none left are kept. A
    round costs two aggregations over the pairs that are still open.
    """
    scratch = Scratch(pairs.sparkSession, "dereplicate")
    near = pairs.where((F.col("q") != F.col("r")) & (F.col(distance) < limit))
    open_pairs = scratch.keep(near.select(F.greatest("q", "r").alias("late"), F.least("q", "r").alias("early")).distinct(), "near")
    waiting = scratch.keep(genomes.select("genome_id").distinct(), "waiting")
    settled = []
    while waiting.limit(1).count():
        blocked = open_pairs.select(F.col("late").alias("genome_id")).distinct()
        kept = scratch.keep(waiting.join(blocked, "genome_id", "left_anti"), "kept")
        gone = open_pairs.join(kept.withColumnRenamed("genome_id", "early"), "early", "left_semi").select(F.col("late").alias("genome_id")).distinct()
        gone = scratch.keep(gone, "gone")
        settled += [kept.withColumn("kept", F.lit(True)), gone.withColumn("kept", F.lit(False))]
        done = kept.unionByName(gone)
        waiting = scratch.keep(waiting.join(done, "genome_id", "left_anti"), "waiting")
        rest = open_pairs.join(done.withColumnRenamed("genome_id", "late"), "late", "left_anti").join(done.withColumnRenamed("genome_id", "early"), "early", "left_anti")
        open_pairs = scratch.keep(rest.select("late", "early"), "open")
    if not settled:
        return genomes.select("genome_id", F.lit(True).alias("kept")).limit(0)
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    return out


def dereplicate_sketches(keys: DataFrame, limit: float, k: int, distance: str = "mash", block: int = 1000, block_rows: int = 20_000_000) -> DataFrame:
    """(genome_id, kept) of every genome of ``keys``: the choice of ``dereplicate`` over all pairs, without making them all.

    The first ``block`` genomes that wait are compared with each other and settled; then all later ones go that are near to a
    newly kept one. So a pair of two genomes is made only if they wait in the same block or the earlier one is kept, which
    are the pairs that decide. Distances are exact; pairs that share no key are near to no ``limit``. A block whose keys
    would make more than ``block_rows`` rows of pairs is halved, one far below that makes the next block twice as large.
    """
    scratch = Scratch(keys.sparkSession, "sketches")
    rows = scratch.keep(keys.where("genome_id is not null and ctxobj is not null").select("genome_id", "ctxobj").distinct(), "keys")
    sizes = scratch.keep(rows.groupBy("genome_id").agg(F.count("*").alias("size")), "sizes")
    settled = [sizes.select("genome_id", F.lit(True).alias("kept")).limit(0)]
    while (left := rows.select("genome_id").distinct()).limit(1).count():
        while True:
            first = scratch.keep(left.orderBy("genome_id").limit(block), "block")
            own = scratch.keep(rows.join(first, "genome_id", "left_semi"), "own")
            made = own.groupBy("ctxobj").count().agg(F.sum(F.col("count") * F.col("count"))).first()[0]
            if made <= block_rows or block == 1:
                break
            scratch.drop(first, own)
            block = max(1, block // 2)
        pairs = similarities(with_sizes(overlaps(own, own), sizes, sizes), k)
        chosen = scratch.keep(dereplicate(pairs, first, limit, distance), "chosen")
        newly = scratch.keep(own.join(chosen.where("kept"), "genome_id", "left_semi"), "newly")
        later = scratch.keep(rows.join(first, "genome_id", "left_anti"), "later")
        near = similarities(with_sizes(overlaps(newly, later), sizes, sizes), k).where(F.col(distance) < limit)
        gone = scratch.keep(near.select(F.col("r").alias("genome_id")).distinct(), "gone")
        settled += [chosen.select("genome_id", "kept"), gone.withColumn("kept", F.lit(False))]
        scratch.drop(rows, own, newly)
        rows = scratch.keep(later.join(gone, "genome_id", "left_anti"), "waiting")
        scratch.drop(later)
        if made * 8 <= block_rows:
            block *= 2
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    return out


def selection_codes(chosen: DataFrame, genomes: DataFrame) -> DataFrame:
    """(genome_id, code): ``rank<TAB>name`` of kept genomes in order, ``0<TAB>NULL<TAB>name`` of the others.

    The rank is a running number over all kept genomes, counted by ranges of the id so that no task sees them all.
    """
    named = chosen.join(genomes.groupBy("genome_id").agg(F.min("name").alias("name")), "genome_id", "left")

    block = F.shiftright("genome_id", 16)
    sums = named.where("kept").groupBy(block.alias("block")).agg(F.count("*").alias("n"))
    before = sums.select("block", (F.sum("n").over(Window.orderBy("block")) - F.col("n")).alias("before"))
    inner = F.sum(F.col("kept").cast("int")).over(Window.partitionBy("block").orderBy("genome_id"))
    out = named.withColumn("block", block).withColumn("inner", inner).join(before, "block", "left")
    rank = (F.coalesce("before", F.lit(0)) + F.col("inner")).cast("string")
    return out.select("genome_id", F.when(F.col("kept"), F.concat_ws("\t", rank, "name")).otherwise(F.concat_ws("\t", F.lit("0"), F.lit("NULL"), "name")).alias("code"))
