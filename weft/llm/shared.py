"""Scratch space that driver and executors share, and Arrow helpers.

Intermediate tables go to ``spark.checkpoint.dir``: they cut lineage, survive
the loss of any executor, and are read back like any other input.
"""

from __future__ import annotations

import ctypes
import posixpath
import uuid
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from weft.scratch import shared_folder

_made: dict[str, list[str]] = {}

#: A key is hot when it has over so many rows and is among so many with most.
HOT_ROWS, HOT_KEYS = 2_000, 1_000
#: Bytes of rows that go to a Python worker in one Arrow batch, and rows, whole
#: documents often, that a scan holds in one batch.
BATCH_BYTES, SCAN_ROWS = 4 << 20, 512
#: Members of a small group that one copy of its representative serves.
MEMBERS_A_SALT = 64
#: Bytes of a list that is broadcast, as its columns' values count.
BROADCAST_BYTES = 32 << 20


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own below the shared folder."""
    path = posixpath.join(shared_folder(spark), f"weft-{name}-{uuid.uuid4().hex[:12]}")
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back."""
    spark = df.sparkSession
    small_batches(spark)
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def staged_so_far(spark: SparkSession) -> int:
    """How many paths this application has asked for; see :func:`clear_scratch`."""
    return len(_made.get(spark.sparkContext.applicationId, []))


def clear_scratch(spark: SparkSession, since: int = 0, keep: Iterable[DataFrame] = ()) -> None:
    """Delete what this application has staged since ``since`` paths, but for
    the tables in ``keep``, which later plans still read."""
    made = _made.get(spark.sparkContext.applicationId, [])
    kept = {df.staged_at for df in keep}
    for path in made[since:]:
        if path not in kept:
            remove(spark, path)
    made[since:] = [p for p in made[since:] if p in kept]


def fits_broadcast(df: DataFrame, rows: int) -> bool:
    """Whether a staged table has at most ``rows`` rows and BROADCAST_BYTES bytes."""
    size = sum((F.coalesce(F.octet_length(f.name), F.lit(0)) if f.dataType.simpleString() in ("string", "binary") else F.lit(8) for f in df.schema), F.lit(16))
    n, total = df.agg(F.count(F.lit(1)), F.sum(size.cast("long"))).first()
    return n <= rows and (total or 0) <= BROADCAST_BYTES


def hot_keys(counts: DataFrame, on: list[str], n: str = "n", least: int = HOT_ROWS) -> DataFrame | None:
    """The keys that most rows share, more than ``least`` and at most HOT_KEYS
    whatever the data, of a table of keys and their rows; None if there is none."""
    rows = counts.filter(F.col(n) > least).select(*on, n).orderBy(F.col(n).desc()).limit(HOT_KEYS).collect()
    return counts.sparkSession.createDataFrame([r[:-1] for r in rows], counts.select(*on).schema) if rows else None


def keyed_join(many: DataFrame, one: DataFrame, on: list[str], hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """``many`` joined with ``one``, which has a row a key: rows with a hot key
    stay where they are and get its row by broadcast, the others are shuffled."""
    if hot is None:
        return many.join(one, on, how)
    hot = F.broadcast(hot)
    cold = many.join(hot, on, "left_anti").join(one, on, how)
    return cold.unionByName(many.join(hot, on, "left_semi").join(F.broadcast(one.join(hot, on, "left_semi")), on, how))


def salts(n):
    """Copies of its representative that serve a group of ``n`` members: one for
    each MEMBERS_A_SALT, and beyond the square of that one for each root of n,
    so that neither the copies nor a copy's members grow as the group does."""
    return F.ceil(n / F.greatest(F.lit(float(MEMBERS_A_SALT)), F.sqrt(n))).cast("int")


def own_names(*names: str) -> list[str]:
    """Column names that no caller's table has."""
    mark = uuid.uuid4().hex[:12]
    return [f"weft_{name}_{mark}" for name in names]


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared space."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


#: Spark's names of stores, and the file system library's.
SCHEMES = {"s3a": "s3", "s3n": "s3", "wasb": "abfs", "wasbs": "abfss"}


def filesystem(uri: str):
    """(pyarrow filesystem, path) of a URI as Spark names it: local files, HDFS and object stores."""
    from pyarrow import fs

    scheme, _, rest = uri.partition(":")
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    if scheme == "dbfs":  # mounted on every machine
        return fs.LocalFileSystem(), "/dbfs/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}:{rest}" if rest else uri)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, n+1 offsets from 0) of a string column, null as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def binary_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, n+1 offsets from 0) of a binary column without nulls."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches, column: str, most: int = 4 << 20):
    """Batches cut so that ``column`` holds about ``most`` bytes in each; a
    longer single text is a slice of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        sizes = np.cumsum(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            base = sizes[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(sizes, base + most, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def give_back() -> None:
    """Hand freed memory back to the system, as the worker process goes on to other stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:  # glibc only
        trim(0)


def small_batches(spark: SparkSession) -> None:
    """Bound what scans and Python workers hold at once: rows are whole documents."""
    arrow, scan = "spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.parquet.columnarReaderBatchSize"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(arrow)) > BATCH_BYTES:
        spark.conf.set(arrow, f"{BATCH_BYTES}b")
    if int(spark.conf.get(scan)) > SCAN_ROWS:
        spark.conf.set(scan, str(SCAN_ROWS))


def arrow_map(rows: DataFrame, run: Callable, schema: str | StructType) -> DataFrame:
    """``rows.mapInArrow(run, schema)`` in batches of at most BATCH_BYTES, a
    longer row in one of its own; what a task has freed goes back to the system
    at its end."""
    small_batches(rows.sparkSession)

    def whole(batches):
        yield from run(batches)
        give_back()

    return rows.mapInArrow(whole, schema)


def mapped(raw: np.ndarray, table: bytes) -> np.ndarray:
    """Each byte replaced by its entry in a table of 256."""
    return np.frombuffer(raw.tobytes().translate(table), np.uint8)


def lowered(raw: np.ndarray) -> np.ndarray:
    """A-Z lower-cased, all other bytes as they are."""
    return np.frombuffer(raw.tobytes().lower(), np.uint8)


def ragged_binary(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Consecutive runs of ``values`` (run i ends before ``ends[i]``) as a binary column."""
    values = np.ascontiguousarray(values)
    offsets = np.concatenate([[0], ends]).astype(np.int64) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(values)])
