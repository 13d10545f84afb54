"""Files that keep arriving, through the same operators batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import intake, suffix


def arriving(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """A stream of (path, modificationTime, length, content, suffix, intake)."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    out = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).load(path)
    return out.withColumns({"suffix": suffix(out["path"]), "intake": intake(out["path"])})


def run(stream: DataFrame, step: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> StreamingQuery:
    """Appends step's rows to Parquet; each batch has a folder of its own, so that one which is repeated overwrites itself."""

    def write(batch: DataFrame, number: int) -> None:
        step(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
