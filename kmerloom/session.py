"""Session helpers: builder, scratch tables in the shared checkpoint folder, unique column names.

Iterative operators cut their lineage by writing a parquet table below ``spark.checkpoint.dir`` and reading
it back: the files are shared, so a lost executor costs only the tasks that were running on it.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

_OPEN: list[Scratch] = []


def local_session(cpus: int = 8, app: str = "kmerloom", **conf: str) -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only where it is unset on a local master."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="kmerloom-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


class Scratch:
    """Tables written by one operator call. ``keep`` cuts the lineage, ``drop`` frees what no later step reads."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0
        _OPEN.append(self)

    def path(self, label: str) -> str:
        self.count += 1
        return f"{self.base}/{self.count:03d}-{label}"

    def keep(self, df: DataFrame, label: str, **measures: Column) -> DataFrame:
        """The table written and read back; ``measured`` holds the rows and the given aggregates, taken while writing."""
        path = self.path(label)
        measured = self._write(df, path, measures)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept._scratch_path, kept.measured = path, measured
        return kept

    def split(self, df: DataFrame, flag: str, label: str, **measures: Column) -> tuple[DataFrame, DataFrame]:
        """Writes once and gives back the rows with and without the flag, without the flag's column, both with their number."""
        path = self.path(label)
        measured = self._write(df, path, measures | {"flagged": F.count_if(F.col(flag))}, flag)
        fields = [f for f in df.schema.fields if f.name != flag]
        schema = type(df.schema)(fields)
        parts = []
        for value, rows in (("true", measured["flagged"]), ("false", measured["rows"] - measured["flagged"])):
            if rows:
                part = self.spark.read.schema(schema).parquet(f"{path}/{flag}={value}")
                part._scratch_path = f"{path}/{flag}={value}"
            else:
                part = self.spark.createDataFrame([], schema)
            part.measured = measured | {"rows": rows}
            parts.append(part)
        return parts[0], parts[1]

    def _write(self, df: DataFrame, path: str, measures: dict[str, Column], flag: str | None = None) -> dict[str, int]:
        seen = Observation()
        writer = df.observe(seen, F.count(F.lit(1)).alias("rows"), *[x.alias(name) for name, x in measures.items()]).write.option("compression", "zstd")
        (writer.partitionBy(flag) if flag else writer).parquet(path)
        return {name: x or 0 for name, x in seen.get.items()}

    def _fs(self, path: str):
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def drop(self, *kept: DataFrame) -> None:
        for df in kept:
            path = getattr(df, "_scratch_path", None)
            if path:
                fs, at = self._fs(path)
                fs.delete(at, True)

    def clear(self) -> None:
        fs, at = self._fs(self.base)
        fs.delete(at, True)


def clear_scratch() -> None:
    """Removes every scratch table of this process; frames that read them can't be used any more."""
    while _OPEN:
        try:
            _OPEN.pop().clear()
        except Exception:  # noqa: BLE001  the JVM may be gone already
            pass


atexit.register(clear_scratch)


def fresh(name: str, taken: Iterable[str]) -> str:
    """``name`` with as many underscores in front as it takes to clash with no column, in any case."""
    used = {x.lower() for x in taken}
    while name.lower() in used:
        name = "_" + name
    return name
