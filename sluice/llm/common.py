"""Helpers shared by the operators of this subpackage."""

import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
# The ASCII white space that separates words in the shingle operators.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; where it is unset, a local one, but on one machine only."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not (spark.sparkContext.master + "[").startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def small_batches(spark: SparkSession, rows: int = 256):
    """While it lasts, Arrow hands Python so many rows at once; the session's own setting comes back after it.

    It serves jobs that run within it. Python in tables that are handed out lazily gets the session's batches.
    """
    own = spark.conf.getAll.get(BATCH)
    spark.conf.set(BATCH, str(rows))
    try:
        yield
    finally:
        spark.conf.unset(BATCH) if own is None else spark.conf.set(BATCH, own)


def written(df: DataFrame, name: str, codec: str = "snappy", rows: int = 256) -> DataFrame:
    """Write df once to the shared folder, in small batches where Python makes it, and read it back, which cuts its lineage."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with small_batches(spark, rows):
        df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def picked(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, so that further ones, whatever their names, cannot clash."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def utf8_of(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column (null: empty) and the offsets of its rows, without copies per row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def row_slices(ends: np.ndarray, most: int = 1 << 18):
    """Ranges of rows whose bytes add up to about `most`, so that arrays made of them stay small; a longer row stands alone."""
    n, i = len(ends) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def ranges(at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All indices at[i] .. at[i]+size[i]-1, one range after the other."""
    upto = np.cumsum(size)
    return np.repeat(at - (upto - size), size) + np.arange(upto[-1] if len(upto) else 0)
