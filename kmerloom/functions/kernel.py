"""Vectorised k-mer kernel: bases to packed k-mers of both strands, canonical contexts, hash sampling, context/object keys."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
# The SplitMix64 constants and the constant that goes into a sketching id.
MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
ID_SALT = 31415926
CODENS = 11

_CODES = np.full(256, 255, np.uint8)
for _i, _pair in enumerate(("Aa", "Cc", "Gg", "Tt")):
    _CODES[[ord(c) for c in _pair]] = _i
BASES = "ACGT"


def mix64(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, U) + U(MIX[0])
    x = (x ^ (x >> U(30))) * U(MIX[1])
    x = (x ^ (x >> U(27))) * U(MIX[2])
    return x ^ (x >> U(31))


def runs(mask: int) -> list[tuple[int, int]]:
    """(lowest bit, length) of the runs of ones, from the lowest."""
    out, bit = [], 0
    while mask >> bit:
        if mask >> bit & 1:
            n = 1
            while mask >> (bit + n) & 1:
                n += 1
            out.append((bit, n))
            bit += n
        else:
            bit += 1
    return out


def gather_bits(x: np.ndarray, mask: int) -> np.ndarray:
    """The bits under the mask, moved together at the low end."""
    out, at = np.zeros_like(x), 0
    for low, n in runs(mask):
        out |= ((x >> U(low)) & U((1 << n) - 1)) << U(at)
        at += n
    return out


def scatter_bits(x: np.ndarray, mask: int) -> np.ndarray:
    """The inverse of ``gather_bits``."""
    out, at = np.zeros_like(x), 0
    for low, n in runs(mask):
        out |= ((x >> U(at)) & U((1 << n) - 1)) << U(low)
        at += n
    return out


@dataclass(frozen=True)
class SketchParams:
    """How sequences are sampled. The k-mer is [outer][half context][inner][half context][outer]; coden mode alternates
    eleven context pairs with ten object bases over 32 bases and ignores the three lengths."""

    half_context: int = 11
    outer: int = 0
    inner: int = 0
    fold: int = 12
    coden: bool = False
    least_count: int = 1
    keep_conflicts: bool = False

    def __post_init__(self):
        if not self.coden and not (4 <= self.half_context <= 16 and 0 <= self.outer <= 8 and 0 <= self.inner <= 8):
            raise ValueError("half_context 4..16, outer 0..8, inner 0..8")
        if not 0 <= self.fold < 24 or not 1 <= self.least_count <= 65536:
            raise ValueError("fold 0..23, least_count 1..65536")
        if self.k > 32:
            raise ValueError("k-mers of up to 32 bases")

    @property
    def k(self) -> int:
        return 3 * CODENS - 1 if self.coden else self.inner + 2 * (self.half_context + self.outer)

    @property
    def whole_mask(self) -> int:
        return (1 << 2 * self.k) - 1

    @property
    def context_mask(self) -> int:
        if self.coden:
            return sum(0b1111 << 6 * i for i in range(CODENS))
        half = (1 << 2 * self.half_context) - 1
        return half << 2 * self.outer | half << 2 * (self.outer + self.half_context + self.inner)

    @property
    def object_mask(self) -> int:
        return self.whole_mask & ~self.context_mask

    @property
    def object_bits(self) -> int:
        return self.object_mask.bit_count()

    @property
    def threshold(self) -> int:
        return 0xFFFFFFFF >> self.fold

    @property
    def hash_id(self) -> int:
        """Sketches may be compared only where this is equal."""
        parts = (CODENS, 0, 0) if self.coden else (self.half_context, self.outer, self.inner)
        out = 0
        for v in (*parts, self.fold, self.threshold, ID_SALT):
            out ^= int(mix64(np.array([v], U))[0]) & 0xFFFFFFFF
        return out


#: Windows that are worked on at a time: some 60 bytes of memory each, however long a sequence is.
SLICE = 1 << 20


def letters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all strings of an Arrow column and the start of each, with the end behind; without copying them. Null is empty."""
    if column.null_count:
        column = column.fill_null("")
    _, starts, data = column.buffers()
    if not len(column) or data is None:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(starts, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def windows(data: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(place, forward, reverse) of the k-mers of A, C, G, T in either case, packed, slice by slice; some cross sequences."""
    for start in range(0, len(data) - k + 1, SLICE):
        codes = _CODES[data[start : start + SLICE + k - 1]]
        n = len(codes) - k + 1
        bad = np.concatenate([[0], np.cumsum(codes == 255, dtype=np.int32)])
        at = np.flatnonzero(bad[k:] == bad[:-k])
        if not len(at):
            continue
        wide = codes.astype(U) & U(3)
        forward, reverse = np.zeros(n, U), np.zeros(n, U)
        for j in range(k):
            part = wide[j : j + n]
            forward |= part << U(2 * (k - 1 - j))
            reverse |= (part ^ U(3)) << U(2 * j)
        yield start + at, forward[at], reverse[at]


def within(at: np.ndarray, k: int, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sequence of each place, and whether the k-mer ends in it."""
    index = np.searchsorted(offsets, at, side="right") - 1
    return index, at + k <= offsets[index + 1]


def sampled_keys(sequences: pa.Array | list[str | None], params: SketchParams) -> tuple[np.ndarray, np.ndarray]:
    """(index of the sequence, context/object key) of every kept k-mer, repeats included.

    Windows never cross sequences or a letter other than A, C, G, T in either case. Of the two strands the one with the
    smaller context counts, the reverse one if they are equal.
    """
    data, offsets = letters(sequences if isinstance(sequences, pa.Array) else pa.array(sequences, pa.large_string()))
    mask, bits, found = U(params.context_mask), params.object_bits, [(np.empty(0, np.int64), np.empty(0, U))]
    for at, forward, reverse in windows(data, params.k):
        f, r = forward & mask, reverse & mask
        kept = (mix64(np.minimum(f, r)) & U(0xFFFFFFFF)) <= U(params.threshold)
        index, whole = within(at[kept], params.k, offsets)
        kmers = np.where(f[kept] < r[kept], forward[kept], reverse[kept])[whole]
        keys = gather_bits(kmers, params.context_mask)
        if bits:
            keys = keys << U(bits) | gather_bits(kmers, params.object_mask)
        found.append((index[whole], keys))
    return np.concatenate([i for i, _ in found]), np.concatenate([x for _, x in found])


def unpack_keys(keys: np.ndarray, params: SketchParams) -> list[str]:
    """The k-mers that the keys stand for."""
    keys = np.asarray(keys, np.int64).view(U)
    bits = params.object_bits
    kmers = scatter_bits(keys >> U(bits), params.context_mask) if bits else scatter_bits(keys, params.context_mask)
    if bits:
        kmers |= scatter_bits(keys & U((1 << bits) - 1), params.object_mask)
    letters = np.frombuffer(BASES.encode(), np.uint8)
    shifts = U(2) * np.arange(params.k - 1, -1, -1, dtype=U)
    rows = letters[((kmers[:, None] >> shifts) & U(3)).astype(np.int64)]
    return [r.tobytes().decode() for r in rows]
