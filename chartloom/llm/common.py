"""What the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of one Arrow batch that a worker gets (a longer row comes alone), and rows of it that are worked on at a time.
BATCH_BYTES = 4 << 20
BATCH_ROWS = 256
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def text_batches(df: DataFrame) -> DataFrame:
    """Bounds the Arrow batches that Python workers get by bytes, as rows of whole texts are of any width. The bound is
    the same for all operators and one that the session names stays, so the order of calls is of no consequence."""
    conf = df.sparkSession.conf
    if conf.get(_BYTES, None) is None:
        conf.set(_BYTES, str(BATCH_BYTES))
    return df


def lean(run, rows: int = BATCH_ROWS):
    """A function for mapInArrow that gets at most so many rows at a time, and after whose task the worker gives its free
    memory back; reused workers keep it else."""

    def sliced(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, rows):
                yield batch.slice(k, rows)

    @functools.wraps(run)
    def whole(batches):
        try:
            yield from run(sliced(batches))
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc alone
            if trim:
                trim(0)

    return whole


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; one of our own only where none is set and all runs in one
    process, as in tests. On a cluster without one this is an error, as executors share no local folder."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found
    context = spark.sparkContext._jsc.sc().getCheckpointDir()
    if context.isDefined():
        return context.get()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="chartloom-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: a Parquet table in the shared folder, read back with its known schema."""
    path = f"{shared_dir(df.sparkSession)}/chartloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checked(df: DataFrame, rows: int) -> DataFrame:
    """A written table of narrow rows, for the smaller side of a join: broadcast if it has at most so many rows."""
    return F.broadcast(df) if df.count() <= rows else df


def fresh(name: str, taken: list[str]) -> str:
    """name, with as many underscores after it as make it differ from all taken ones, case aside."""
    lower = {t.lower() for t in taken}
    while name.lower() in lower:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc32_mod(column: Column, n: int) -> Column:
    """crc32 of the value as text, modulo n; a null counts as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % n


def texts(column: pa.Array) -> list[str]:
    """Whole texts of an Arrow column; a null is the empty text."""
    return [x or "" for x in column.to_pylist()]


def raw(column: pa.Array) -> list[bytes]:
    """Whole texts as UTF-8; a null is the empty text."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
