"""All similar pairs between set-valued records, by recursive chosen-path splitting.

Every set is embedded into ``coordinates`` MinHash tokens (Christiani, Pagh and Sivertsen, "Scalable and robust set
similarity join", 2018). A tree node chooses 1 / threshold coordinates at random (by a hash of the node) and sends each of
its records to one child per chosen coordinate, named by the record's token there; records that share the token meet again.
Nodes of at most ``node_limit`` records are compared by brute force on the embedding, larger ones are split further.
A pair at the threshold meets in a tree with probability 0.75 after one split, 0.61 after two and 0.36 after six. All trees
share the embedding, so a pair whose tokens agree less than its sets does is missed more often: ``missed`` sums over
that, and ``trees_needed`` gives the trees for the deepest split that nodes may reach. What passes the embedding's
lenient test is verified exactly on the sets.

Records with the same set are joined into one representative first, as no split can part them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kmerloom.operators.skew import hot_left_join
from kmerloom.session import Scratch

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
#: By the trees; the test of the embedding misses 3 in a million besides.
MISSED = 5e-6


def mix(x: np.ndarray) -> np.ndarray:
    """The SplitMix64 step on uint64."""
    x = x + _A
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def missed(similarity: float, threshold: float, trees: int, coordinates: int, depth: int) -> float:
    """The chance that a pair of this similarity meets in none of the trees after ``depth`` splits."""
    agreeing = np.arange(coordinates + 1)
    log = np.array([math.lgamma(x + 1) for x in agreeing])
    chance = np.exp(log[-1] - log - log[::-1] + agreeing * math.log(similarity) + (coordinates - agreeing) * math.log1p(-similarity))
    meets = np.ones(coordinates + 1)
    for _ in range(depth):
        meets = 1 - (1 - agreeing / coordinates * meets) ** math.ceil(1 / threshold)
    return float(chance @ (1 - meets) ** trees)


def trees_needed(threshold: float, coordinates: int, depth: int) -> int:
    """Trees by which a pair at the threshold is missed with a chance of at most MISSED after ``depth`` splits."""
    if threshold >= 1:
        return 1
    trees = 1
    while missed(threshold, threshold, trees, coordinates, depth) > MISSED:
        trees += 1
    return trees


def _sketch(coordinates: int):
    """(r, size, print_a, print_b, tokens) of every chunk of a set."""
    factors = mix(np.arange(1, coordinates + 1, dtype=np.uint64)) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            if not len(lists):
                continue
            offsets = np.asarray(lists.offsets, np.int64)
            values = mix(np.asarray(lists.values, np.int64).view(np.uint64)[offsets[0] : offsets[-1]])
            at = offsets[:-1] - offsets[0]
            tokens = np.empty((len(at), coordinates), np.uint32)
            for i, factor in enumerate(factors):
                tokens[:, i] = np.minimum.reduceat(((values * factor) >> np.uint64(32)).astype(np.uint32), at)
            prints = [np.add.reduceat(x, at).view(np.int64) for x in (values, mix(values ^ _C))]
            packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * coordinates), len(at), [None, pa.py_buffer(tokens.tobytes())]).cast(pa.binary())
            sizes = pa.array(np.diff(offsets))
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array(prints[0]), pa.array(prints[1]), packed], names=["r", "size", "print_a", "print_b", "tokens"])

    return run


def _merge(frame: pd.DataFrame) -> pd.DataFrame:
    tokens = np.stack([np.frombuffer(t, np.uint32) for t in frame["tokens"]]).min(0)
    first = frame.iloc[:1].copy()
    for c in ("size", "print_a", "print_b"):
        first[c] = np.asarray(frame[c], np.int64).sum()
    first["tokens"] = [tokens.tobytes()]
    return first


def _children(nodes: np.ndarray, tokens: np.ndarray, branches: int) -> np.ndarray:
    """[record, branch]: the children of node i that record i goes to."""
    coordinates = tokens.shape[1]
    out = np.empty((len(nodes), branches), np.int64)
    step = mix(nodes ^ _C)
    first, stride = step % np.uint64(coordinates), np.uint64(1) + np.uint64(2) * ((step >> np.uint64(32)) % np.uint64(max(1, coordinates // 4)))
    for b in range(branches):  # an odd stride meets each coordinate of a power of two once
        at = ((first + np.uint64(b) * stride) % np.uint64(coordinates)).astype(np.int64)
        token = tokens[np.arange(len(nodes)), at].astype(np.uint64) | (at.astype(np.uint64) << np.uint64(32))
        out[:, b] = mix(nodes ^ mix(token)).view(np.int64)
    return out


def _split(coordinates: int, branches: int, roots: np.ndarray | None):
    """Rows (r, tokens[, node]) to rows (node, r) of the children: of all trees' roots, or of the row's own node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            tokens = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(n, coordinates)
            r = np.asarray(batch.column(0), np.int64)
            if roots is None:
                nodes = [_children(np.asarray(batch.column(2), np.int64).view(np.uint64), tokens, branches)]
            else:
                nodes = [_children(np.full(n, root), tokens, branches) for root in roots]
            nodes = np.concatenate(nodes, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(nodes.ravel()), pa.array(np.repeat(r, nodes.shape[1]))], names=["node", "r"])

    return run


def _brute(coordinates: int, threshold: float, least: float):
    """Rows (node, r, size, short tokens) in order of node to pairs (a, b) that may be similar. Nodes are bounded."""

    def compare(node, r, size, short):
        kept = []
        for d in range(1, len(node)):
            same = np.flatnonzero(node[d:] == node[:-d])
            if not len(same):
                break
            same = same[(np.minimum(size[same], size[same + d]) >= threshold * np.maximum(size[same], size[same + d])) & (r[same] != r[same + d])]
            close = (short[same] == short[same + d]).sum(1) >= least * coordinates
            kept.append(np.stack([r[same[close]], r[same[close] + d]]))
        pairs = np.concatenate(kept, axis=1) if kept else np.empty((2, 0), np.int64)
        pairs = np.unique(np.sort(pairs, axis=0), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not len(batch):
                continue
            rows = [np.asarray(batch.column(i), np.int64) for i in range(3)] + [np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(len(batch), coordinates)]
            if held is not None:
                rows = [np.concatenate([x, y]) for x, y in zip(held, rows, strict=True)]
            last = int(np.searchsorted(rows[0], rows[0][-1]))  # the last node may go on in the next batch
            held = [x[last:] for x in rows]
            if last:
                yield compare(*(x[:last] for x in rows))
        if held is not None:
            yield compare(*held)

    return run


def similar_pairs(rows: DataFrame, record: str, value: str, threshold: float = 0.5, **options) -> DataFrame:
    """(a, b, similarity), a < b: all pairs of records whose sets have a Jaccard similarity of at least ``threshold``.

    These are the pairs of ``similar_classes`` written out for all members, copies with each other included: a set that occurs k
    times makes k (k - 1) / 2 rows. Where that is too much, use the classes.
    """
    similar, members = similar_classes(rows, record, value, threshold, **options)
    m1, m2 = members.select(F.col("rep").alias("a"), F.col("r").alias("r1")), members.select(F.col("rep").alias("b"), F.col("r").alias("r2"))
    between = similar.join(m1, "a").join(m2, "b").select(F.least("r1", "r2").alias("a"), F.greatest("r1", "r2").alias("b"), "similarity")
    copies = m1.join(m2, m1["a"] == m2["b"]).where("r1 < r2").select(F.col("r1").alias("a"), F.col("r2").alias("b"), F.lit(1.0).alias("similarity"))
    return between.unionByName(copies)


def class_links(similar: DataFrame, members: DataFrame) -> DataFrame:
    """(r, rep, links): every record with its class and the number of other classes that it is similar to."""
    ends = similar.select(F.explode(F.array("a", "b")).alias("of")).groupBy("of").agg(F.count("*").alias("links"))
    return hot_left_join(members, ends, "rep", "of").select("r", "rep", F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))


def similar_classes(
    rows: DataFrame, record: str, value: str, threshold: float = 0.5, trees: int | None = None, coordinates: int = 256, node_limit: int = 100, max_depth: int = 6, chunk_values: int = 1 << 20, seed: int = 1
) -> tuple[DataFrame, DataFrame]:
    """((a, b, similarity), (r, rep)): similar pairs of representatives, a < b, and the members of each class of equal sets.

    ``rows`` holds one row per value of a record, both integers. Rows with a null in either column hold no value, repeated
    rows count once, records without values are in no class, other columns are ignored. The smallest record of equal sets represents
    them. A similarity of exactly ``threshold`` counts. ``coordinates`` is a power of two, ``trees`` follows from it and ``max_depth``
    unless given. For pairs between two tables, give the union of both and keep the pairs between them. Sets above
    ``chunk_values`` values are held in several rows by hash of the value.
    """
    trees = trees or trees_needed(threshold, coordinates, max_depth)
    scratch = Scratch(rows.sparkSession, "pairs")
    facts = rows.where(F.col(record).isNotNull() & F.col(value).isNotNull()).select(F.col(record).cast("bigint").alias("r"), F.col(value).cast("bigint").alias("v"))
    largest = facts.groupBy("r").count().agg(F.max("count")).first()[0] or 0
    chunks = max(1, math.ceil(largest / chunk_values))
    part = F.pmod(F.xxhash64("v"), F.lit(chunks)).cast("int") if chunks > 1 else F.lit(0)
    sets = scratch.keep(facts.groupBy("r", part.alias("part")).agg(F.collect_set("v").alias("vs")), "sets")
    sketches = sets.select("r", "vs").mapInArrow(_sketch(coordinates), "r bigint, size bigint, print_a bigint, print_b bigint, tokens binary")
    if chunks > 1:
        sketches = sketches.groupBy("r").applyInPandas(_merge, sketches.schema)
    sketches = scratch.keep(sketches, "sketches")
    members = scratch.keep(sketches.groupBy("size", "print_a", "print_b").agg(F.min("r").alias("rep")).join(sketches.select("r", "size", "print_a", "print_b"), ["size", "print_a", "print_b"]).select("r", "rep"), "members")
    reps = scratch.keep(sketches.join(members.where("r = rep").select("r"), "r", "left_semi").select("r", "size", "tokens"), "representatives")

    pairs = _candidates(scratch, reps, threshold, trees, coordinates, node_limit, max_depth, seed)
    sizes = reps.select("r", "size")
    found = pairs.join(sets.select(F.col("r").alias("a"), "part", F.col("vs").alias("va")), "a").join(sets.select(F.col("r").alias("b"), "part", F.col("vs").alias("vb")), ["b", "part"])
    common = found.select("a", "b", F.size(F.array_intersect("va", "vb")).cast("bigint").alias("n"))
    if chunks > 1:
        common = common.groupBy("a", "b").agg(F.sum("n").alias("n"))
    for of in ("a", "b"):
        common = common.join(sizes.select(F.col("r").alias(of), F.col("size").alias(f"size_{of}")), of)
    union = F.col("size_a") + F.col("size_b") - F.col("n")
    similar = common.where(F.col("n") >= threshold * union).select("a", "b", (F.col("n") / union).alias("similarity"))
    return scratch.keep(similar, "similar"), members


def _candidates(scratch: Scratch, reps: DataFrame, threshold: float, trees: int, coordinates: int, node_limit: int, max_depth: int, seed: int) -> DataFrame:
    branches = math.ceil(1 / threshold)
    spread = math.sqrt(threshold * (1 - threshold) / coordinates)
    least = threshold - 4.5 * spread  # 3 in a million pairs at the threshold lie further below it
    roots = mix(np.arange(trees, dtype=np.uint64) + np.uint64(seed) * _B)
    short = reps.select("r", "size", F.col("tokens").alias("t")).mapInArrow(_shorten(coordinates), "r bigint, size bigint, short binary")
    nodes = scratch.keep(reps.select("r", "tokens").mapInArrow(_split(coordinates, branches, roots), "node bigint, r bigint"), "nodes")
    found = []
    for depth in range(1, max_depth + 1):
        sizes = nodes.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").withColumnRenamed("node", "of")
        sized = hot_left_join(nodes, sizes, "node", "of", nodes.count()).where("n is not null")
        small, large = scratch.split(sized.withColumn("small", F.col("n") <= node_limit), "small", "sized")
        scratch.drop(nodes)
        if depth == max_depth:
            # nodes whose records stay together to the end hold mostly similar ones: they are compared in blocks
            blocks = F.ceil(F.col("n") / node_limit).cast("int")
            block = F.pmod(F.xxhash64("r"), blocks).cast("int")
            cells = large.select("node", "r", block.alias("k"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("j"))
            small = small.select("node", "r").unionByName(cells.select(F.xxhash64("node", F.least("k", "j"), F.greatest("k", "j")).alias("node"), "r"))
        rows = small.select("node", "r").join(short, "r").select("node", "r", "size", "short")
        ordered = rows.repartition("node").sortWithinPartitions("node")
        found.append(scratch.keep(ordered.mapInArrow(_brute(coordinates, threshold, least), "a bigint, b bigint"), "found"))
        if depth == max_depth or not large.limit(1).count():
            break
        nodes = scratch.keep(large.join(reps.select("r", "tokens"), "r").select("r", "tokens", "node").mapInArrow(_split(coordinates, branches, None), "node bigint, r bigint").distinct(), "nodes")
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    return scratch.keep(pairs.distinct(), "candidates")


def _shorten(coordinates: int):
    """The low byte of every token: enough to tell tokens apart in all but one of 256 comparisons."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            tokens = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint32).astype(np.uint8)
            packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(coordinates), len(batch), [None, pa.py_buffer(tokens.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed], names=["r", "size", "short"])

    return run
