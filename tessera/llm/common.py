"""What the corpus operators share: tables, intermediate results, joins by size, Arrow maps."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes that an Arrow batch holds at most, or one longer row; kernels cut batches further. One setting for all plans of a session.
BATCH_BYTES = 4 << 20
#: A side of a join is broadcast up to this many rows of at most ROW_BYTES each, otherwise both sides are shuffled.
BROADCAST_ROWS = 500_000
ROW_BYTES = 64
#: Spark's setting that removes shuffle files when a query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own = ""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder path below ``spark.checkpoint.dir``; where that is unset and the master is this machine, a folder of this process."""
    global _own
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.conf.get("spark.master", "local").split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        root = _own = _own or tempfile.mkdtemp(prefix="tessera-")
    return f"{root.rstrip('/')}/tessera-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: lineage ends there, and a lost executor costs no recomputation.

    What the write has shuffled is removed with its end, not when the driver happens to collect its garbage.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def arrow(df: DataFrame, function: Callable, schema: str | StructType) -> DataFrame:
    """``df.mapInArrow(function, schema)`` with batches of at most BATCH_BYTES."""
    conf = df.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxBytesPerBatch").removesuffix("b") != str(BATCH_BYTES):
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed()
        yield from function(batches)
        give_back()

    return df.mapInArrow(run, schema)


def keep_freed() -> None:
    """Within a task, arrays of a few MB come from memory that is there: mapping it anew costs more than most sums over it."""
    if (option := getattr(ctypes.CDLL(None), "mallopt", None)) is not None:
        option(-3, 32 << 20)  # M_MMAP_THRESHOLD
        option(-1, 64 << 20)  # M_TRIM_THRESHOLD


def give_back() -> None:
    """Returns what a task has freed to the system: workers are kept for later tasks, and so is what their allocators hold."""
    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
        trim(0)


def join_small(big: DataFrame, small: DataFrame, key: str | list[str], how: str = "inner", row_bytes: int = ROW_BYTES) -> DataFrame:
    """``big`` joined to ``small``, a stored table: broadcast behind a check of its size, else by a shuffle of both."""
    if small.count() * max(1, row_bytes // ROW_BYTES) <= BROADCAST_ROWS:
        small = F.broadcast(small)
    return big.join(small, key, how)


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, dtype=kind, count=column.offset + len(column) + 1)[column.offset :].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``limit`` bytes together, or of one longer row."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(rows, max(first + 1, last))
        yield first, last
        first = last


def texts_of(column: pa.Array) -> list[str]:
    return ["" if x is None else x for x in column.to_pylist()]


def emit(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)
