"""Where results go: files of predictions, growing sets of truth records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .schemas import TRUTH


def write_predictions(predictions: DataFrame, path: str) -> None:
    """JSON lines (file, character, confidence), one for each image; the folder of an earlier run is replaced."""
    predictions.select("file", "character", F.col("confidence").cast("double").alias("confidence")).write.mode("overwrite").json(path)


def append_truth(records: DataFrame, path: str) -> None:
    """Adds truth records to those at path as JSON lines; nothing that is there is read or written again."""
    fields = StructType.fromDDL(TRUTH).fields
    records.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields]).write.mode("append").json(path)


def latest(files: DataFrame, by: list[str]) -> DataFrame:
    """by and the path modified last in each group; of equals the last by name."""
    return files.groupBy(*by).agg(F.max(F.struct("modificationTime", "path"))["path"].alias("path"))
