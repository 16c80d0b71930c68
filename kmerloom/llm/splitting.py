"""Splitting oversized items at natural boundaries, with a set overlap.

The greedy rule (end at the last boundary within reach, else at the limit; start the next piece ``overlap`` before that
end) is a successor function on boundaries: whatever forced cuts lie between, a piece that starts before boundary b
leads to one next boundary. The successors of all boundaries come from one search in the sorted boundaries, the forced
cuts from a closed formula. Squaring the successor table (pointer doubling) then marks all boundaries that the greedy
walk meets and counts the pieces before each, in log2(boundaries) vector steps for all items of a batch at once.
No step depends on an item's neighbours in the table, so nothing is shuffled but the finished cuts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Ends of runs of ten or more letters other than A, C, G and T.
UNKNOWN_RUN = r"[^ACGTacgt]{10,}"
CUTS = "delivery string, n_letters bigint, piece_no int, start_pos bigint, end_pos bigint, piece string"


def greedy_cuts(lengths: list[int], boundaries: list[np.ndarray], limit: int, overlap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, start, end) of all pieces of all items with more than ``limit`` letters.

    Node 0 of an item stands for its start, node j for the piece that starts ``overlap`` before its j-th boundary.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be below the limit")
    big = [i for i, n in enumerate(lengths) if n > limit]
    if not big:
        return (np.empty(0, np.int64),) * 3
    step = limit - overlap
    # all items on one axis, further apart than a piece reaches
    base = np.concatenate([[0], np.cumsum([lengths[i] + 2 * limit for i in big])])[:-1].astype(np.int64)
    size = np.array([lengths[i] for i in big], np.int64)
    marks = [np.asarray(boundaries[i], np.int64) for i in big]
    per = np.array([len(m) + 1 for m in marks], np.int64)
    first = np.concatenate([[0], np.cumsum(per)])[:-1]
    item = np.repeat(np.arange(len(big)), per)
    ends = np.concatenate([np.concatenate([[overlap], m]) + b for m, b in zip(marks, base, strict=True)])  # start + overlap, on the axis
    stop = (base + size)[item]
    begin = ends - overlap
    # the next boundary after each node, where the item has one
    following = np.searchsorted(ends, ends, side="right")
    is_start = np.zeros(len(ends) + 1, bool)
    is_start[first] = True
    is_start[-1] = True
    inside = ~is_start[np.minimum(following, len(ends))]
    ahead = ends[np.minimum(following, len(ends) - 1)]
    final_forced = np.maximum(0, -((begin + limit - stop) // step))  # pieces before the last if no boundary came in reach
    forced = np.where(inside, np.maximum(0, -((ends + step - ahead) // step)), final_forced)  # cuts at the limit before the first in reach
    ends_here = ~inside | (forced >= final_forced)  # the rest fits before any further boundary is needed
    forced = np.where(ends_here, final_forced, forced)
    target = np.searchsorted(ends, ends + (forced + 1) * step, side="right") - 1
    node = np.arange(len(ends))
    jump = np.where(ends_here, node, target)
    hops = np.where(ends_here, 0, forced + 1)
    # squaring: reached from the starts by 1, 2, 4 ... jumps; rank counts the pieces before a node
    reached, rank = np.zeros(len(ends), bool), np.zeros(len(ends), np.int64)
    reached[first] = True
    while True:
        at = np.flatnonzero(reached)
        to = jump[at]
        new = ~reached[to]
        rank[to[new]] = rank[at[new]] + hops[at[new]]
        reached[to[new]] = True
        double = jump[jump]
        if not new.any() and np.array_equal(double, jump):
            break
        hops = hops + hops[jump]
        jump = double
    at = np.flatnonzero(reached)
    counts = np.where(ends_here, final_forced, forced)[at] + 1
    owner = np.repeat(at, counts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = begin[owner] + nth * step
    last = nth == np.repeat(counts - 1, counts)
    reach = np.where(last, np.where(ends_here[owner], stop[owner], ends[target[owner]]), start + limit)
    origin = base[item[owner]]
    return np.array(big, np.int64)[item[owner]], start - origin, reach - origin


def _kernel(limit: int, overlap: int, boundary: str, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, rule = re.compile(r"\s+"), re.compile(boundary)
        schema = pa.schema([("delivery", pa.string()), ("n_letters", pa.int64()), ("piece_no", pa.int32()), ("start_pos", pa.int64()), ("end_pos", pa.int64()), ("piece", pa.string())])
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), [space.sub("", t or "") for t in batch.column(1).to_pylist()]
            marks = [np.array([m.end() for m in rule.finditer(t)] if len(t) > limit else [], np.int64) for t in texts]
            item, start, end = greedy_cuts([len(t) for t in texts], marks, limit, overlap)
            if not len(item):
                continue
            new = np.flatnonzero(np.diff(item, prepend=-1))
            number = np.arange(len(item)) - np.repeat(new, np.diff(np.append(new, len(item))))
            pieces = [texts[i][a:b] for i, a, b in zip(item.tolist(), start.tolist(), end.tolist(), strict=True)] if with_text else [None] * len(item)
            lengths = np.array([len(t) for t in texts], np.int64)[item]
            yield pa.RecordBatch.from_arrays(
                [pa.array([names[i] for i in item.tolist()], pa.string()), pa.array(lengths), pa.array(number, pa.int32()), pa.array(start), pa.array(end), pa.array(pieces, pa.string())], schema=schema
            )

    return run


def split_oversized(items: DataFrame, key: str, text: str, limit: int = 5000, overlap: int = 31, boundary: str = UNKNOWN_RUN, with_text: bool = False, unique_length: bool = True) -> DataFrame:
    """(key, piece_no, start_pos, end_pos, piece): the pieces of every item with more than ``limit`` letters.

    White space in ``text`` is taken out first; positions are 0-based in what remains, ends exclusive. A boundary is
    the position after a match of the pattern ``boundary``. Items with null, empty or shorter text have no pieces,
    nor have rows with a null key. A key may have several rows with the same text, which count once; set
    ``unique_length`` to False where texts of one key may differ in length, then the longest counts (this reads the
    texts twice). piece is null unless ``with_text``. Other columns are ignored.
    """
    kind = items.schema[key].dataType
    rows = items.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("k"), F.col(text).cast("string").alias("t"))
    cuts = rows.mapInArrow(_kernel(limit, overlap, boundary, with_text), CUTS)
    tops = cuts.groupBy("delivery").agg(F.max("n_letters").alias("top")).withColumnRenamed("delivery", "d")
    once = cuts.join(tops, (cuts["delivery"] == tops["d"]) & (cuts["n_letters"] == tops["top"])) if not unique_length else cuts
    once = once.groupBy("delivery", "piece_no").agg(F.max(F.struct("end_pos", "start_pos", "piece")).alias("b"))
    return once.select(F.col("delivery").cast(kind).alias(key), "piece_no", "b.start_pos", "b.end_pos", "b.piece")
