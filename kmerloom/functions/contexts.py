"""Comparison of the objects that genomes hold in shared contexts, in numpy."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

import numpy as np

#: Objects below 2 ** 20 (ten bases) may be looked up in a table of all objects, which is made of two halves.
HALF_BITS, HALF = 10, 1 << 10
#: So many comparisons of two objects take about as long as making such a table.
TABLE_PAIRS = 200_000
#: Contexts with more comparisons than this go one at a time, the others together.
GROUP_PAIRS = 50_000
#: Comparisons that are held at once.
STEP = 1_000_000
#: Runs below this are summed up in one number: of at most 32 bases the sum has 24 bits, either count 19.
RUN_BITS = 19


def differing(x: np.ndarray) -> np.ndarray:
    """The number of two-bit bases in which an XOR of packed sequences isn't zero."""
    x = x.view(np.uint64)
    return np.bitwise_count((x | x >> np.uint64(1)) & np.uint64(0x5555555555555555))


@cache
def _halves() -> np.ndarray:
    each = np.arange(HALF, dtype=np.int64)
    return differing(each[:, None] ^ each[None, :])


def nearest(own: np.ndarray, objs: np.ndarray) -> np.ndarray:
    """In how many bases each of ``objs`` differs from the nearest of ``own`` (sorted, not empty).

    Where there are many of both, from a table of all objects: the least distance of the lower five bases in each row that ``own`` has, then
    over the upper bases one at a time. So it costs the sum of both lengths, not their product.
    """
    if len(own) * len(objs) > TABLE_PAIRS and _in_table(own) and _in_table(objs):
        return _table(own).take(objs)
    least = np.full(len(objs), 255, np.uint8)
    step = max(1, STEP // max(1, len(objs)))
    for i in range(0, len(own), step):
        np.minimum(least, differing(objs[None, :] ^ own[i : i + step, None]).min(axis=0), out=least)
    return least


def _in_table(objs: np.ndarray) -> bool:
    return 0 <= objs.min() and objs.max() < HALF * HALF


def _table(own: np.ndarray, table: np.ndarray | None = None) -> np.ndarray:
    """The least distances of all objects from ``own``, in ``table`` if given."""
    table = np.empty((HALF, HALF), np.uint8) if table is None else table
    table.fill(2 * HALF_BITS)
    rows, low = own >> HALF_BITS, own & (HALF - 1)
    starts = _starts(rows)
    nth = np.arange(len(own)) - np.repeat(starts, np.diff(np.append(starts, len(own))))  # of its row
    for i in range(int(nth.max()) + 1):
        at = np.flatnonzero(nth == i)
        near = _halves()[low[at]]
        table[rows[at]] = np.minimum(table[rows[at]], near) if i else near
    fours = rows[starts] >> 2  # of rows that differ in their last base; the others are out of reach of it
    fours = fours[_starts(fours)]
    base = table.reshape(-1, 4, HALF)
    near = base[fours]
    base[fours] = np.minimum(near, near.min(axis=1, keepdims=True) + np.uint8(1))
    for i in range(HALF_BITS // 2 - 1):
        base = table.reshape(4**i, 4, -1)
        least = base.min(axis=1, keepdims=True)
        least += np.uint8(1)
        np.minimum(base, least, out=base)
    return table.ravel()


@cache
def _packed() -> np.ndarray:
    """Of each distance: whether it is more than 1, whether it is more than 0, and itself, in one number."""
    d = np.arange(256)
    return d | (d > 0) << 24 | (d > 1) << (24 + RUN_BITS)


def _summed(d: np.ndarray, starts: np.ndarray, longest: int) -> tuple[np.ndarray, ...]:
    """Of each run of distances: how many aren't 0, their sum, and how many are more than 1."""
    if longest < 1 << RUN_BITS:
        sums = np.add.reduceat(_packed().take(d), starts)
        return sums >> 24 & (1 << RUN_BITS) - 1, sums & (1 << 24) - 1, sums >> (24 + RUN_BITS)
    return tuple(np.add.reduceat(x.astype(np.int64), starts) for x in (d > 0, d, d > 1))


def _distinct(*columns: np.ndarray) -> list[np.ndarray]:
    """The distinct rows, sorted by the columns."""
    order = _order(*columns)
    columns = [x[order] for x in columns]
    new = _starts(*columns)
    return [x[new] for x in columns]


def _order(*columns: np.ndarray) -> np.ndarray:
    """Sorts rows by the columns; as one number, which is several times faster, if they fit into 63 bits."""
    bits = [int(x.max()).bit_length() if x.min() >= 0 else 64 for x in columns if len(x)]
    if sum(bits) > 63:
        return np.lexsort(columns[::-1])
    key = np.zeros(len(columns[0]), np.int64)
    for x, n in zip(columns, bits, strict=False):
        key = key << n | x
    return np.argsort(key)


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in columns])
    return np.flatnonzero(new)


def compared(queries: tuple[np.ndarray, ...], refs: tuple[np.ndarray, ...], least_qry: float = 0.0, least_ref: float = 0.0, finish: Callable[..., list[np.ndarray]] | None = None) -> list[np.ndarray]:
    """q, r, shared contexts, of these differing, differing bases, contexts with two or more, and both sizes, of pairs that share a context.

    Both sides are int64 columns (genome, context, object), repeated rows count once. A query's objects of one context are compared
    together and the nearest counts; a reference's count one by one. Pairs are left out whose shared contexts are a smaller part
    (in single precision) of a size than asked for. ``finish`` makes other columns of these, some queries' pairs at a time.
    """
    (asked, q_at), (held, r_at), (q_ctx, qc), (r_ctx, rc) = (np.unique(side[i], return_inverse=True) for i in (0, 1) for side in (queries, refs))
    (q_at, qc, qo), (rc, r_at, ro) = _distinct(q_at, qc, queries[2]), _distinct(rc, r_at, refs[2])
    q_size, r_size = np.bincount(q_at, minlength=len(asked)), np.bincount(r_at, minlength=len(held))
    begins = np.append(0, np.cumsum(np.bincount(rc, minlength=len(r_ctx))))  # of each context's references
    at = np.searchsorted(r_ctx, q_ctx)
    shared = np.append(r_ctx, 0)[at] == q_ctx
    shared[at == len(r_ctx)] = False
    met = np.where(shared, begins[np.minimum(at + 1, len(r_ctx))] - begins[at], 0)[qc]
    first = begins[at][qc]
    q_at, qc, qo, first, met = (x[met > 0] for x in (q_at, qc, qo, first, met))
    group = _starts(q_at, qc)  # a query's objects of one context
    n = np.diff(np.append(group, len(qc)))
    together = (n > 1) & (n * met[group] >= GROUP_PAIRS)
    cost = np.bincount(q_at[group], np.where(together, met[group], n * met[group]), len(asked)).astype(np.int64)
    run = (np.cumsum(cost) - cost) // STEP  # of each query
    group_run = run[q_at[group]]
    finish = finish or (lambda *columns: list(columns))
    out = [finish(*[np.empty(0, np.int64)] * 8)]
    runs = {}  # of the references in a context: where each genome begins, and whether the table holds all objects
    table = np.empty((HALF, HALF), np.uint8) if together.any() else None
    bounds = [*np.flatnonzero(np.diff(group_run, prepend=-1)).tolist(), len(group)] if len(group) else [0]
    for begin, end in zip(bounds[:-1], bounds[1:], strict=True):
        base = int(q_at[group[begin]])
        parts = [_one_by_one(slice(begin, end), base, len(held), group, n, together, q_at, qo, first, met, r_at, ro)]
        for g in (begin + np.flatnonzero(together[begin:end])).tolist():
            i, at = group[g], int(first[group[g]])
            rows = slice(at, at + int(met[i]))
            if at not in runs:
                starts = _starts(r_at[rows])
                runs[at] = starts, r_at[rows][starts], np.diff(np.append(starts, met[i])), _in_table(ro[rows])
            starts, genomes, each, small = runs[at]
            own, objs = qo[i : i + n[g]], ro[rows]
            d = _table(own, table).take(objs) if small and len(own) * len(objs) > TABLE_PAIRS and _in_table(own) else nearest(own, objs)
            parts.append(((int(q_at[i]) - base) * len(held) + genomes, each, *_summed(d, starts, each.max())))
        key, *values = (np.concatenate(x) for x in zip(*parts, strict=True))
        cells = (int(q_at[group[end - 1]]) - base + 1) * len(held)
        pairs = None
        if cells > 4 * len(key) + STEP:
            pairs, key = np.unique(key, return_inverse=True)
            cells = len(pairs)
        sums = [np.bincount(key, x, cells).astype(np.int64) for x in values]
        some = np.flatnonzero(sums[0])
        pairs = some if pairs is None else pairs[some]
        q, r = base + pairs // len(held), pairs % len(held)
        near = np.logical_and.reduce([(sums[0][some] / size).astype(np.float32) >= np.float32(least) for size, least in ((q_size[q], least_qry), (r_size[r], least_ref))])
        some, q, r = some[near], q[near], r[near]
        out.append(finish(asked[q], held[r], *(x[some] for x in sums), q_size[q], r_size[r]))
    return [np.concatenate(x) for x in zip(*out, strict=True)]


def _one_by_one(groups, base, width, group, n, together, q_at, qo, first, met, r_at, ro):
    """Pair number, 1, and the three figures for every reference row in the groups that don't go together."""
    alone = np.flatnonzero(~together[groups]) + groups.start
    of = np.repeat(alone, n[alone])
    rows = np.repeat(group[alone], n[alone]) + _counting(n[alone])
    ref = np.repeat(first[rows], met[rows]) + _counting(met[rows])
    row, of = np.repeat(rows, met[rows]), np.repeat(of, met[rows])
    d = differing(qo[row] ^ ro[ref]).astype(np.int64)
    if (n[alone] > 1).any():
        order = np.lexsort((ref, of))
        row, ref, of, d = row[order], ref[order], of[order], d[order]
        new = _starts(of, ref)
        row, ref, d = row[new], ref[new], np.minimum.reduceat(d, new) if len(new) else d
    return (q_at[row] - base) * width + r_at[ref], np.ones(len(d), np.int64), (d > 0).astype(np.int64), d, (d > 1).astype(np.int64)


def _counting(lengths: np.ndarray) -> np.ndarray:
    """0, 1, ... up to each of the lengths."""
    return np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
