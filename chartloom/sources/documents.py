"""Documents: files, recognition plug-ins, truth records."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import intake, suffix
from .schemas import TRUTH

IMAGES = "*.{png,jpg,jpeg,tif,tiff,bmp}"


def files(spark: SparkSession, path: str, pattern: str | None = None, recursive: bool = True) -> DataFrame:
    """(path, modificationTime, length, content, suffix, intake) of the files under path."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
    out = (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)
    return out.withColumns({"suffix": suffix(F.col("path")), "intake": intake(F.col("path"))})


def labelled_images(spark: SparkSession, path: str, canonical: bool = True) -> DataFrame:
    """Images with label, the name of their folder; canonical keeps single digits and capitals."""
    out = files(spark, path, IMAGES).withColumn("label", F.element_at(F.split("path", "/"), -2))
    return out.where(F.col("label").rlike("^[0-9A-Z]$")) if canonical else out


def truth_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of a JSON array over several lines."""
    return spark.read.option("multiLine", True).schema(TRUTH).json(path)


#: Gets (path, suffix, content) of one file; gives (page number, text) in order.
Recogniser = Callable[[str, str, bytes], list[tuple[int, str]]]


def recognised(scans: DataFrame, factory: Callable[[], Recogniser]) -> DataFrame:
    """(path, text): pages in order, joined by line feeds. factory runs once in each worker, as models are slow to load.

    A file that the recogniser fails on has a null text and the error's name; it doesn't end the job.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = factory()
        for batch in batches:
            out = []
            for path, kind, content in zip(batch["path"], batch["suffix"], batch["content"]):
                try:
                    pages = sorted(read(path, kind, bytes(content)))
                    out.append((path, "\n".join(t for _, t in pages), None))
                except Exception as e:  # one bad scan among many
                    out.append((path, None, type(e).__name__))
            yield pd.DataFrame(out, columns=["path", "text", "error"])

    return scans.select("path", "suffix", "content").mapInPandas(run, "path string, text string, error string")


def plain_text() -> Recogniser:
    """The stand-in where no engine is installed: the file's bytes are its text, form feeds part its pages."""
    return lambda path, kind, content: list(enumerate(content.decode("utf-8", "replace").split("\f"), 1))


def tagged(df: DataFrame, factory: Callable[[], Callable[[str], dict[str, list[str]]]], text: str = "text") -> DataFrame:
    """df with an array of (label, entity) from a named-entity plug-in; empty without one that finds any."""
    schema = T.StructType([*df.schema.fields, T.StructField("entities", T.ArrayType(T.StructType().add("label", "string").add("entity", "string")))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = factory()
        for batch in batches:
            yield batch.assign(entities=[[{"label": k, "entity": v} for k, vs in find(t or "").items() for v in vs] for t in batch[text]])

    return df.mapInPandas(run, schema)
