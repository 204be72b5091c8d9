"""What the operators share: scratch tables (of `quire.scratch`) and Arrow helpers."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.scratch import Workspace, open_fs, released

# Python workers outlive their tasks: with the system allocator, trim() gives freed Arrow memory back as well.
pa.set_memory_pool(pa.system_memory_pool())
try:
    _malloc_trim = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):
    _malloc_trim = None


def tasks_of(spark: SparkSession, df: DataFrame) -> int:
    """Shuffle width for work that this session's settings size."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def trim() -> None:
    """Return freed memory to the system."""
    pa.default_memory_pool().release_unused()
    if _malloc_trim is not None:
        _malloc_trim(0)


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch where its texts pass `most` bytes, so that scratch arrays stay small; a longer text is alone."""
    if not batch.num_rows:
        return
    size = np.cumsum(np.asarray(pc.binary_length(batch.column(column)).fill_null(0)).astype(np.int64) + 16)
    at, n = 0, batch.num_rows
    while at < n:
        base = size[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(size, base + most, side="right")))
        yield batch.slice(at, to - at)
        trim()
        at = to


def texts(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8 bytes; null is empty."""
    return column.cast(pa.large_binary()).fill_null(b"").to_pylist()


def crc32_text(column: F.Column) -> F.Column:
    """crc32 of a value written as text."""
    return F.crc32(column.cast("string").cast("binary"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


__all__ = ["Workspace", "crc32_text", "open_fs", "released", "slices", "table", "tasks_of", "texts", "trim"]
