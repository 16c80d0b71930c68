"""Binary files of the native and the older sketch format, of abundance vectors and of shuffled dimensions.

Keys and vectors are read and written by tasks, each at its own place of a file; only headers, names and offsets (some hundred
bytes a genome) pass through the driver. The folder must be mounted by all executors.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from kmerloom.functions.kernel import CODENS, SketchParams
from kmerloom.operators.legacy import kept_dimensions

# File names, the length of a name, and the layout of the headers.
KEYS, OFFSETS, COUNTS, STAT = "comblco", "comblco.index", "comblco.a", "lcofiles.stat"
OLD_KEYS, OLD_OFFSETS, OLD_COUNTS, OLD_STAT = "combco.0", "combco.index.0", "combco.0.a", "cofiles.stat"
NAME_BYTES = 256
HEADER = struct.Struct("<I??2xiiiiii")  # id, counts, conflicts, codens, k, half context, outer, fold, genomes
OLD_HEADER = struct.Struct("<I?3xiiii4xq")  # id, counts, k, twice the level, components, genomes, all keys
SHUFFLE_HEADER = struct.Struct("<iiii")  # id, half k, half sub-context, level
VECTOR = np.dtype([("ref_idx", "<i4"), ("pct", "<f4")])
SKETCH = "genome_id bigint, ctxobj bigint, cnt bigint"


def local_path(path: str) -> str:
    """The path without ``file:``; other schemes can't be written at a place."""
    if "://" in path and not path.startswith("file://"):
        raise ValueError(f"{path}: a folder that is mounted is needed")
    return path.removeprefix("file://") if path.startswith("file://") else path.removeprefix("file:")


def _named(names: list[str]) -> bytes:
    return b"".join(n.encode()[: NAME_BYTES - 1].ljust(NAME_BYTES, b"\0") for n in names)


def _names(data: bytes, n: int) -> list[str]:
    return [data[i * NAME_BYTES : (i + 1) * NAME_BYTES].split(b"\0")[0].decode() for i in range(n)]


def write_binary_sketch(keys: DataFrame, genomes: DataFrame, params: SketchParams, folder: str) -> None:
    """A native sketch folder of (genome_id, ctxobj, cnt) and (genome_id, name); genomes are numbered anew in the order of their ids.

    A genome's keys are sorted as unsigned numbers. Without a cnt column no counts are written.
    """
    folder, counted = local_path(folder), "cnt" in keys.columns
    names = genomes.groupBy("genome_id").agg(F.min("name").alias("name")).where("genome_id is not null").orderBy("genome_id").toPandas()
    sizes = dict(keys.groupBy("genome_id").agg(F.count_distinct("ctxobj")).toLocalIterator())
    ids = names["genome_id"].tolist()
    if not sizes.keys() <= set(ids):
        raise ValueError("keys of genomes without a name")
    offsets = np.concatenate([[0], np.cumsum([sizes.get(g, 0) for g in ids])]).astype(np.uint64)
    os.makedirs(folder, exist_ok=True)
    codens = CODENS if params.coden else 0
    header = HEADER.pack(params.hash_id, counted, params.keep_conflicts, codens, params.k, 0 if params.coden else params.half_context, 0 if params.coden else params.outer, params.fold, len(ids))
    with open(os.path.join(folder, STAT), "wb") as out:
        out.write(header + _named([n or "" for n in names["name"]]))
    offsets.tofile(os.path.join(folder, OFFSETS))
    for name, width in ((KEYS, 8), (COUNTS, 4)) if counted else ((KEYS, 8),):
        with open(os.path.join(folder, name), "wb") as out:
            out.truncate(width * int(offsets[-1]))
    starts = dict(zip(ids, offsets[:-1].tolist(), strict=True))

    def write(rows: pd.DataFrame) -> pd.DataFrame:
        own = rows.groupby(rows["ctxobj"].to_numpy(np.int64).view(np.uint64))["cnt"].max()
        start = starts[int(rows["genome_id"].iloc[0])]
        for name, width, values in ((KEYS, 8, own.index.to_numpy(np.uint64)), (COUNTS, 4, own.to_numpy(np.uint32)))[: 1 + counted]:
            with open(os.path.join(folder, name), "r+b") as out:
                out.seek(width * start)
                out.write(values.tobytes())
        return pd.DataFrame({"n": [len(own)]})

    rows = keys.select("genome_id", "ctxobj", (F.col("cnt") if counted else F.lit(1)).cast("bigint").alias("cnt"))
    rows.groupBy("genome_id").applyInPandas(write, "n bigint").agg(F.sum("n")).collect()


def read_binary_sketch(spark: SparkSession, folder: str) -> DataFrame:
    """(genome_id, ctxobj, cnt) of a native sketch folder: keys (u64), offsets (u64, one more than genomes), counts (u32) if there."""
    folder = local_path(folder)
    counts = COUNTS if os.path.exists(os.path.join(folder, COUNTS)) else None
    return _read_keys(spark, folder, OFFSETS, KEYS, np.uint64, counts, np.uint32)


def _read_keys(spark: SparkSession, folder: str, index: str, keys: str, kind: type, counts: str | None, count_kind: type) -> DataFrame:
    """Every genome is a row with its place, from the offsets that are read on the driver (8 bytes a genome)."""
    offsets = np.fromfile(os.path.join(folder, index), np.uint64).astype(np.int64)
    width, count_width = np.dtype(kind).itemsize, np.dtype(count_kind).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g in batch.column(0).to_pylist():
                first, n = int(offsets[g]), int(offsets[g + 1] - offsets[g])
                own = np.fromfile(os.path.join(folder, keys), kind, n, offset=width * first).astype(np.uint64).view(np.int64)
                cnt = np.fromfile(os.path.join(folder, counts), count_kind, n, offset=count_width * first).astype(np.int64) if counts else np.ones(n, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, g, np.int64)), pa.array(own), pa.array(cnt)], names=["genome_id", "ctxobj", "cnt"])

    return spark.range(max(0, len(offsets) - 1)).mapInArrow(run, SKETCH)


def read_sketch_folder(spark: SparkSession, folder: str, like: int | None = None) -> tuple[DataFrame, DataFrame, dict]:
    """(keys, genomes, header) of a native or older sketch folder, whichever header it has.

    The header has hash_id, counted, conflicts, k and genomes. With ``like``, the id of another sketch, raises if they differ,
    as such sketches can't be compared. An older folder of several components raises.
    """
    folder = local_path(folder)
    new, old = os.path.join(folder, STAT), os.path.join(folder, OLD_STAT)
    if os.path.exists(old):
        data = open(old, "rb").read()
        shuffle, counted, k, level, components, n, _ = OLD_HEADER.unpack_from(data)
        if components > 1:
            raise ValueError(f"{folder}: {components} components, one is needed")
        header = {"hash_id": shuffle, "counted": counted, "conflicts": False, "k": k, "level": level // 2, "genomes": n}
        names = _names(data[OLD_HEADER.size + 4 * n :], n)
        keys = _read_keys(spark, folder, OLD_OFFSETS, OLD_KEYS, np.uint32, OLD_COUNTS if counted else None, np.uint16)
    elif os.path.exists(new):
        data = open(new, "rb").read()
        hash_id, counted, conflicts, codens, k, half, outer, fold, n = HEADER.unpack_from(data)
        header = {"hash_id": hash_id, "counted": counted, "conflicts": conflicts, "codens": codens, "k": k, "half_context": half, "outer": outer, "fold": fold, "genomes": n}
        names = _names(data[HEADER.size :], n)
        keys = _read_keys(spark, folder, OFFSETS, KEYS, np.uint64, COUNTS if counted else None, np.uint32)
    else:
        raise ValueError(f"{folder}: no sketch header")
    if like is not None and header["hash_id"] != like:
        raise ValueError(f"{folder}: sketched with other parameters")
    return keys, spark.createDataFrame(list(enumerate(names)), "genome_id bigint, name string"), header


def write_old_sketch(keys: DataFrame, genomes: DataFrame, k: int, level: int, shuffle_id: int, folder: str) -> None:
    """An older sketch folder of one component from (genome_id, key, cnt) of keys below 2^32 and (genome_id, name)."""
    folder = local_path(folder)
    names = genomes.groupBy("genome_id").agg(F.min("name").alias("name")).orderBy("genome_id").toPandas()
    sizes = dict(keys.groupBy("genome_id").agg(F.count_distinct("key")).toLocalIterator())
    ids = names["genome_id"].tolist()
    offsets = np.concatenate([[0], np.cumsum([sizes.get(g, 0) for g in ids])]).astype(np.uint64)
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, OLD_STAT), "wb") as out:
        out.write(OLD_HEADER.pack(shuffle_id, True, k, 2 * level, 1, len(ids), int(offsets[-1])))
        out.write(np.diff(offsets).astype(np.uint32).tobytes() + _named([n or "" for n in names["name"]]))
    offsets.tofile(os.path.join(folder, OLD_OFFSETS))
    for name, width in ((OLD_KEYS, 4), (OLD_COUNTS, 2)):
        with open(os.path.join(folder, name), "wb") as out:
            out.truncate(width * int(offsets[-1]))
    starts = dict(zip(ids, offsets[:-1].tolist(), strict=True))

    def write(rows: pd.DataFrame) -> pd.DataFrame:
        own = rows.groupby(rows["key"].to_numpy(np.int64).astype(np.uint32))["cnt"].max()
        start = starts[int(rows["genome_id"].iloc[0])]
        for name, width, values in ((OLD_KEYS, 4, own.index.to_numpy(np.uint32)), (OLD_COUNTS, 2, own.to_numpy(np.uint16))):
            with open(os.path.join(folder, name), "r+b") as out:
                out.seek(width * start)
                out.write(values.tobytes())
        return pd.DataFrame({"n": [len(own)]})

    keys.select("genome_id", "key", "cnt").groupBy("genome_id").applyInPandas(write, "n bigint").agg(F.sum("n")).collect()


def write_vectors(vectors: DataFrame, folder: str) -> None:
    """One ``.abv`` file a sample: its (ref_idx, pct) in the order of shared keys if there is a column ``shared``, else of ref_idx."""
    folder = local_path(folder)
    os.makedirs(folder, exist_ok=True)

    def write(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["__order", "ref_idx"])
        out = np.empty(len(rows), VECTOR)
        out["ref_idx"], out["pct"] = rows["ref_idx"], rows["pct"]
        out.tofile(os.path.join(folder, f"{rows['sample'].iloc[0]}.abv"))
        return pd.DataFrame({"n": [len(rows)]})

    order = -F.col("shared") if "shared" in vectors.columns else F.lit(0)
    rows = vectors.select(F.col("sample").cast("string").alias("sample"), "ref_idx", "pct", order.cast("bigint").alias("__order"))
    rows.groupBy("sample").applyInPandas(write, "n bigint").agg(F.sum("n")).collect()


def read_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """(sample, place, ref_idx, pct) of all ``.abv`` files of a folder; the sample is the file's name without its ending."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = np.frombuffer(content.as_py(), VECTOR)
                name = os.path.basename(path).removesuffix(".abv")
                columns = [pa.array([name] * len(own), pa.string()), pa.array(np.arange(len(own), dtype=np.int32)), pa.array(own["ref_idx"].astype(np.int64)), pa.array(own["pct"].astype(np.float64))]
                yield pa.RecordBatch.from_arrays(columns, names=["sample", "place", "ref_idx", "pct"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.abv").load(folder).select("path", "content")
    return files.mapInArrow(run, "sample string, place int, ref_idx bigint, pct double")


def write_shuffle(ranks: np.ndarray, half_k: int, half_subcontext: int, level: int, shuffle_id: int, path: str) -> bool:
    """A ``.shuf`` file of a permutation of the 16 ** half_subcontext dimensions. False (a warning) where fewer are kept than advised."""
    if half_k < half_subcontext or half_subcontext >= 8:
        raise ValueError("half_subcontext at most half_k and below 8")
    if not path.endswith(".shuf") or len(ranks) != 16**half_subcontext:
        raise ValueError("a .shuf file of 16 ** half_subcontext dimensions")
    path = local_path(path)
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "wb") as out:
        out.write(SHUFFLE_HEADER.pack(shuffle_id, half_k, half_subcontext, level) + np.asarray(ranks, "<i4").tobytes())
    return 16 ** max(0, half_subcontext - level) >= kept_dimensions(half_subcontext, level)


def read_shuffle(path: str) -> tuple[dict[str, int], np.ndarray]:
    """(header, ranks) of a ``.shuf`` file; raises where it isn't one or its length doesn't fit."""
    if not path.endswith(".shuf"):
        raise ValueError(f"{path}: not a .shuf file")
    data = open(local_path(path), "rb").read()
    header = dict(zip(("id", "half_k", "half_subcontext", "level"), SHUFFLE_HEADER.unpack_from(data), strict=True))
    ranks = np.frombuffer(data, "<i4", offset=SHUFFLE_HEADER.size).astype(np.int64)
    if len(ranks) != 16 ** header["half_subcontext"]:
        raise ValueError(f"{path}: {len(ranks)} dimensions")
    return header, ranks
