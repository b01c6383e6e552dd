"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import threading
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that ``split`` counts as word separators (fixed values).
ASCII_SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names; one of our own only where none is set and
    all runs on this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="quillon-")
        spark.sparkContext.setCheckpointDir(root)
    return root


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001 - the session may be gone at exit
        pass


_by_thread = threading.local()


def _written() -> list[str]:
    """What this thread has written: operators that run in other threads keep their own."""
    if not hasattr(_by_thread, "paths"):
        _by_thread.paths = []
    return _by_thread.paths


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` into the shared checkpoint folder and reads it again: lineage ends
    there, so a lost executor costs a re-read and not a recomputation. The folder goes
    when the operator says so (``only``), or when the driver exits."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/quillon-{name}-{uuid.uuid4().hex}"
    # Spark deletes the shuffle files of earlier steps once the driver has collected them
    spark.sparkContext._jvm.System.gc()
    df.write.parquet(path)
    _written().append(path)
    atexit.register(_delete, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def written() -> int:
    """A mark for ``only``."""
    return len(_written())


def only(df: DataFrame, name: str, since: int, but: int | None = None) -> DataFrame:
    """Materialises a result and deletes all that was written for it since a mark, but for
    what was written at the mark ``but``."""
    kept = materialise(df, name)
    paths = _written()
    for at in reversed(range(since, len(paths) - 1)):
        if at != but:
            _delete(df.sparkSession, paths.pop(at))
    return kept


#: Rows of an Arrow batch: Spark bounds batches by rows only, and 10,000 rows of long texts
#: would stand in memory several times, on both sides.
BATCH_ROWS = 512
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def short_batches(spark: SparkSession) -> None:
    """Lowers the rows of an Arrow batch to ``BATCH_ROWS`` for this session. Plans are made
    when a result is written, so the setting stays."""
    if not 0 < int(spark.conf.get(ARROW_ROWS)) <= BATCH_ROWS:
        spark.conf.set(ARROW_ROWS, str(BATCH_ROWS))


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of so many rows for what is written meanwhile."""
    before = spark.conf.get(ARROW_ROWS)
    spark.conf.set(ARROW_ROWS, str(rows))
    try:
        yield
    finally:
        spark.conf.set(ARROW_ROWS, before)


_caches: dict[str, dict] = {}


def cache_of(operator: str) -> dict:
    """What an operator keeps in a Python worker between tasks. Workers serve one operator
    after another, so what others have kept there goes."""
    if _caches.keys() - {operator}:
        kept = _caches.pop(operator, {})
        _caches.clear()
        _caches[operator] = kept
        release()
    return _caches.setdefault(operator, {})


def release() -> None:
    """Gives freed memory back to the system: Python workers live on for other tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries do so themselves
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def shrink_heaps(spark: SparkSession) -> None:
    """Has the executors collect their garbage and give back what earlier steps have grown
    their heaps by, which would stand beside the Python workers of the next: a task for
    each, which Spark deals over idle executors in turn. Busy ones may be left out."""
    executors = max(1, spark.sparkContext._jsc.sc().getExecutorMemoryStatus().size() - 1)  # the driver is listed too
    spark.range(0, executors, 1, executors).select(F.expr("reflect('java.lang.System', 'gc')")).collect()


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batches again, cut so that ``column`` holds about ``most`` bytes in each (a
    single longer row stays whole): bounds what a vectorised step holds at once."""
    for batch in batches:
        if not batch.num_rows:
            continue
        offsets = text_offsets(batch.column(batch.schema.get_field_index(column)))
        begin = 0
        while begin < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[begin] + most, side="right")) - 1
            end = min(max(end, begin + 1), batch.num_rows)
            yield batch.slice(begin, end - begin)
            begin = end
    release()


def text_offsets(column: pa.Array) -> np.ndarray:
    """Offsets of a string or binary column (int64), of its own slice."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    raw = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)
    return raw[column.offset : column.offset + len(column) + 1].astype(np.int64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column as one uint8 array, and the rows' offsets in it
    (nulls: empty)."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    offsets = text_offsets(column)
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64: spreads every input bit over the whole word."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def whole_text(column: str = "text"):
    return F.coalesce(F.col(column), F.lit("")).alias(column)
