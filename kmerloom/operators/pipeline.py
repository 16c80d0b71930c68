"""End-to-end runs from sequences to ranked pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from kmerloom.functions.kernel import SketchParams
from kmerloom.operators.ani import ani_table, ranked
from kmerloom.operators.sketching import inverted_index, sketch, without_conflicts


def ani_of_sequences(queries: DataFrame, refs: DataFrame, fold: int = 8, genome: str = "genome_id", sequence: str = "seq", **options) -> DataFrame:
    """Coden sketches of both sides and the ANI of their pairs, best first within a query.

    Query sketches keep contexts with several objects, reference sketches don't. Options go to ``ani_table``.
    """
    asked = SketchParams(fold=fold, coden=True, keep_conflicts=True)
    held = SketchParams(fold=fold, coden=True)
    q = inverted_index(sketch(queries, asked, genome, sequence), asked.object_bits)
    r = inverted_index(sketch(refs, held, genome, sequence), held.object_bits)
    return ranked(ani_table(q, r, **options))


def ani_of_first(genomes: DataFrame, fold: int = 8, genome: str = "genome_id", sequence: str = "seq", **options) -> DataFrame:
    """The first genome (smallest id) against all others, without an index file between."""
    first = genomes.agg(F.min(genome)).first()[0]
    return ani_of_sequences(genomes.where(F.col(genome) == F.lit(first)), genomes.where(F.col(genome) != F.lit(first)), fold, genome, sequence, rough=False, **options)


def fraction_sketch(records: DataFrame, k: int, scale: int, genome: str = "genome_id", sequence: str = "seq") -> DataFrame:
    """(genome_id, ctxobj, cnt) of the plain canonical k-mers (k even, 8 to 32), of which a hash keeps one in ``scale``.

    A k-mer stays where a second hash of it, as a 64-bit number, is below 2^64 / scale, compared in the upper 32 bits.
    """
    if k % 2 or not 8 <= k <= 32 or scale < 1:
        raise ValueError("k even from 8 to 32, scale from 1")
    every = sketch(records, SketchParams(half_context=k // 2, fold=0), genome, sequence)
    upper = F.shiftrightunsigned(F.xxhash64("ctxobj"), 32)
    return every.where(upper < F.lit((1 << 32) // scale))


def as_references(keys: DataFrame, object_bits: int) -> DataFrame:
    """An index of conflict-free references from any sketch."""
    return inverted_index(without_conflicts(keys, object_bits), object_bits)
