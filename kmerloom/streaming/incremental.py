"""Sketching of records as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from kmerloom.functions.kernel import SketchParams
from kmerloom.operators.sketching import raw_keys


def arriving_records(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def append_keys(records: DataFrame, params: SketchParams, folder: str, checkpoint: str, genome: str = "genome_id", sequence: str = "seq"):
    """Starts a query that appends the keys of every batch of arriving records to ``folder``, each batch once.

    A batch's files carry its number, so a batch that is run again after a failure replaces what it had written. Sum
    cnt by genome and key when reading.
    """

    def write(batch: DataFrame, number: int) -> None:
        raw_keys(batch, genome, sequence, params).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return records.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
