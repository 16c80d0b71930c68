"""Average nucleotide identity from context/object sketches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from kmerloom.functions import distances
from kmerloom.functions.contexts import compared
from kmerloom.session import Scratch

METRICS = ("model", "mash", "aaf", "mash_if_far", "aaf_if_far")


#: About how many rows and genomes of either side meet in one task; a genome isn't divided.
QUERY_ROWS, REF_ROWS, GENOMES = 1_000_000, 1_000_000, 1536
#: So many rows are packed at once.
PACKED_ROWS = 200_000
FEATURES = ("q", "r", "xny_ctx", "n_diff_obj", "n_diff_obj_section", "n_mut2_ctx")
SIZED = ", ".join(f"{c} bigint" for c in (*FEATURES, "q_size", "r_size"))
SCORED = "q bigint, r bigint, xny_ctx bigint, af_qry float, af_ref float, n_diff_obj bigint, n_diff_obj_section bigint, n_mut2_ctx bigint, ani double, dist double, rough_ani float"
COLUMNS = tuple(c.split()[0] for c in SCORED.split(", "))


def packed(rows: DataFrame, parts: int) -> DataFrame:
    """(part, data): the rows of every part as the bytes of their int64 columns, some at a time; a genome is in one part.

    Copies of them for the blocks of the other side, their shuffle and their sorting cost bytes, not rows.
    """
    names = rows.columns

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _gathered(batches, names):
            part = ((columns[0].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % np.uint64(parts)
            order = np.argsort(part, kind="stable")
            columns, part = columns[:, order], part[order]
            starts = np.flatnonzero(np.diff(part, prepend=part[:1] + np.uint64(1)))
            data = [columns[:, a:b].tobytes() for a, b in zip(starts, [*starts[1:], len(part)], strict=True)]
            yield pa.record_batch([pa.array(part[starts].astype(np.int64)), pa.array(data, pa.binary())], names=["part", "data"])

    return rows.mapInArrow(pack, "part bigint, data binary")


def _gathered(batches: Iterable[pa.RecordBatch], names: list[str]) -> Iterator[np.ndarray]:
    """The columns of about PACKED_ROWS rows, again and again."""
    waiting, n = [], 0
    for batch in batches:
        waiting.append(np.stack([batch.column(c).to_numpy() for c in names]))
        n += batch.num_rows
        if n >= PACKED_ROWS:
            yield np.concatenate(waiting, axis=1)
            waiting, n = [], 0
    if n:
        yield np.concatenate(waiting, axis=1)


def unpacked(table: pa.Table) -> np.ndarray:
    """The three columns of all rows in ``data``."""
    data = [np.frombuffer(x.as_buffer(), np.int64).reshape(3, -1) for chunk in table.column("data").chunks for x in chunk]
    return np.concatenate([np.empty((3, 0), np.int64), *data], axis=1)


def features(queries: DataFrame, refs: DataFrame) -> DataFrame:
    """(q, r, xny_ctx, n_diff_obj, n_diff_obj_section, n_mut2_ctx) of every pair that shares a context.

    Both sides have genome_id, ctx and obj; repeated rows count once, rows with a null don't. A query's objects of one context are
    compared together and the nearest counts; a reference's count one by one, so give conflict-free references where that matters.
    """
    return sized_features(queries, refs).select(*FEATURES)


def sized_features(queries: DataFrame, refs: DataFrame, least_qry: float = 0.0, least_ref: float = 0.0, finish: Callable[..., list[np.ndarray]] | None = None, schema: str = SIZED) -> DataFrame:
    """``features`` with q_size and r_size, how many (ctx, obj) either genome has; pairs with a smaller align fraction are left out.
    ``finish`` makes the columns of ``schema`` of these columns.

    Blocks of query genomes meet blocks of reference genomes, so a pair is finished in one task and rows of pairs aren't shuffled
    to be summed up. A context that all genomes hold with many objects costs a query the references' rows, not their product
    with its own.
    """
    scratch = Scratch(refs.sparkSession, "features")

    def stored(side: DataFrame, name: str) -> DataFrame:
        rows = side.select(*[F.col(c).cast("bigint").alias(c) for c in ("genome_id", "ctx", "obj")]).dropna()
        return scratch.keep(rows, name, genomes=F.approx_count_distinct("genome_id"))

    asked, held = stored(queries, "queries"), stored(refs, "references")
    parts = lambda side, rows: max(1, -(-side.measured["rows"] // rows), -(-side.measured["genomes"] // GENOMES))
    blocks, chunks = parts(asked, QUERY_ROWS), parts(held, REF_ROWS)
    chunks = max(chunks, min(2 * refs.sparkSession.sparkContext.defaultParallelism, -(-held.measured["rows"] // (REF_ROWS // 10))))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))).alias("other")
    asked = packed(asked, blocks).select("*", every(chunks)).select((F.col("part") * chunks + F.col("other")).alias("pair"), "data")
    held = packed(held, chunks).select("*", every(blocks)).select((F.col("other") * chunks + F.col("part")).alias("pair"), "data")

    names = [c.split()[0] for c in schema.split(", ")]

    def met(left: pa.Table, right: pa.Table) -> pa.Table:
        return pa.table(compared(unpacked(left), unpacked(right), least_qry, least_ref, finish), names=names)

    return asked.groupBy("pair").cogroup(held.groupBy("pair")).applyInArrow(met, schema)


def ani_table(queries: DataFrame, refs: DataFrame, least_fraction: float = 0.3, least_ani: float = 0.95, metric: str = "model", far: float = 1.0, unassembled: bool = False, context_bases: int = 22, rough: bool = True, naive: bool = False, digits: int | dict[str, int] | None = None, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """Detail rows: q, r, features, both align fractions, ani and dist of the chosen metric, and the rough ani.

    With ``rough`` (the indexed way) pairs must first pass the query's align fraction and the rough ani, which is
    1 - differing / shared contexts / 7 in single precision; the ani of the metric must reach ``least_ani``. Without, the
    reference's align fraction is tested and the ani must exceed it. The model's distance is ``far`` where the smaller align
    fraction (for ``unassembled`` queries the reference's) is below ``least_fraction``. ``naive`` takes the distance for unassembled
    queries as the model of assembled ones. With ``digits`` both align fractions, ani and dist are rounded doubles, or the columns
    that it names. Only ``columns`` are made.

    It is reckoned in numpy where the pairs are made: as column expressions the regression grows to a method of more than 8,000
    bytes, which the JVM never compiles, and pairs that don't pass would be handed over too.
    """
    if metric not in METRICS:
        raise ValueError(f"metric is one of {METRICS}")
    limit, near = np.float32(least_fraction), np.float32(least_ani)
    rounding = digits if isinstance(digits, dict) else dict.fromkeys(("af_qry", "af_ref", "ani", "dist"), digits) if digits is not None else {}
    least = {"least_qry": 0.0 if unassembled else least_fraction} if rough else {"least_ref": least_fraction}

    def scored(*pairs: np.ndarray) -> list[np.ndarray]:
        _, _, x, d, *_ = pairs
        rough_ani = (1 - d.astype(np.float32).astype(float) / x.astype(np.float32) / 7).astype(np.float32)
        if rough:
            close = rough_ani >= near
            pairs, rough_ani = [c[close] for c in pairs], rough_ani[close]
        q, r, x, d, s, m, q_size, r_size = pairs
        af_qry, af_ref = (x / q_size).astype(np.float32), (x / r_size).astype(np.float32)
        low = np.minimum(af_qry, af_ref)
        apart = {"mash": distances.mash, "aaf": distances.aaf}.get(metric.removesuffix("_if_far"))
        if metric in ("mash", "aaf"):
            dist = apart(x, r_size, q_size, context_bases)
        else:
            model = distances.naive(x, d, s) if unassembled or naive else distances.model(x, d, s, m)
            deciding = af_ref if unassembled and not apart else low
            dist = np.where(deciding < limit, apart(x, r_size, q_size, context_bases) if apart else far, model)
        ani = 1 - dist
        passed = np.flatnonzero(ani >= near if rough else ani > near)
        made = dict(zip(COLUMNS, (q, r, x, af_qry, af_ref, d, s, m, ani, dist, rough_ani), strict=True))
        made = {c: made[c][passed] for c in columns}
        return [distances.rounded(x, rounding[c]) if c in rounding else x for c, x in made.items()]

    kinds = dict(c.split() for c in SCORED.split(", "))
    schema = ", ".join(f"{c} {'double' if c in rounding else kinds[c]}" for c in columns)
    return sized_features(queries, refs, **least, finish=scored, schema=schema)


def ranked(table: DataFrame, by: str = "rough_ani") -> DataFrame:
    """The rows with their place within the query: best first, ties by the query's align fraction, then the reference.

    The indexed way ranks by ``rough_ani``, the other by ``ani``.
    """
    return table.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy(F.desc(by), F.desc("af_qry"), "r")))


def context_ani(queries: DataFrame, refs: DataFrame, object_bases: int, least_shared: int = 100) -> DataFrame:
    """(q, r, shared, ani): (1 - share of contexts with another object) ** (1 / object bases), 0 up to ``least_shared`` contexts.

    Contexts that a reference holds with several objects don't count.
    """
    single = refs.groupBy("genome_id", "ctx").agg(F.count_distinct("obj").alias("n"), F.min("obj").alias("obj")).where("n = 1").drop("n")
    x = F.col("xny_ctx")
    return features(queries, single).select("q", "r", x.alias("shared"), F.when(x > least_shared, F.pow(1 - F.col("n_diff_obj") / x, F.lit(1 / object_bases))).otherwise(0.0).alias("ani"))
