"""Helpers that the operators of this package share."""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import checkpointed as checkpointed
from ..plans.lineage import shared_folder

_SHIPPED = "_crownlake_shipped"


#: Most rows and bytes of an Arrow batch, as rows may be long texts.
_BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 16 << 20}


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per context, so that workers can import it.

    Arrow batches of the session become smaller, if they were larger: the setting is read when a result is
    computed, after the operator has returned, so it can't be put back. Smaller ones are left as they are.
    """
    for name, most in _BATCH.items():
        now = spark.conf.get(name, None)
        if not (now and now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(name, str(most))
    sc = spark.sparkContext
    if getattr(sc, _SHIPPED, False):
        return
    root = Path(__file__).resolve().parents[1]
    to = os.path.join(tempfile.mkdtemp(prefix="crownlake"), "crownlake_src.zip")
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(to)
    setattr(sc, _SHIPPED, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_views(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its row limits (nulls are empty), without a copy per row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    _, offsets, data = column.buffers()
    limits = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[limits[0] : limits[-1]], limits - limits[0]


def release() -> None:
    """Give memory that earlier tasks of this worker freed back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only one C library has it
        ctypes.CDLL(None).malloc_trim(0)


def sliced(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that one holds at most ``max_bytes`` of ``column``, or a single row."""
    release()
    for batch in batches:
        n, start = batch.num_rows, 0
        if not n:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        _, limits = text_views(col)
        while start < n:
            end = max(start + 1, int(np.searchsorted(limits, limits[start] + max_bytes, side="right")) - 1)
            yield batch.slice(start, min(end, n) - start)
            start = end


def crc_remainder(key: str, modulus: int):
    """crc32 of the id as decimal text, modulo ``modulus``; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % modulus


def most_frequent(df: DataFrame, count: str, most: int) -> DataFrame:
    """The rows with the highest ``count``, at most ``most``: all above a limit from a small histogram.

    Ties at the limit all stay out, so the number is a proven bound and no sort is needed.
    """
    step = F.floor(F.log2(F.col(count).cast("double")) * 16)
    least, room = None, most
    for r in sorted(df.groupBy(step.alias("step")).count().collect(), reverse=True):
        room -= r["count"]
        if room < 0:
            break
        least = r.step
    return df.filter(step >= least) if least is not None else df.filter("false")


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again; smaller than a checkpoint."""
    import uuid

    spark = df.sparkSession
    path = f"{shared_folder(spark)}/crownlake-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(df: DataFrame) -> None:
    """Delete the files of ``stored``."""
    spark = df.sparkSession
    files = df.inputFiles()
    if files:
        path = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
