"""Tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

import getpass
import os
import posixpath
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, on the file system that it names or else the
    session's own.  Where it is unset, a local folder serves a local session;
    on a cluster, whose machines wouldn't share it, that is an error."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        made = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not made.isDefined() and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        root = made.get() if made.isDefined() else "file://" + os.path.join(tempfile.gettempdir(), f"weft-{getpass.getuser()}")
        spark.conf.set("spark.checkpoint.dir", root)
    if "://" in root:
        return root
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    full = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return "file://" + full[5:] if full.startswith("file:/") else full


#: Shuffled bytes that adaptive execution gives to a task at most, and parts that it begins with at least.
TASK_BYTES, FIRST_PARTS = 4 << 20, 1_000


def fine_tasks(spark: SparkSession) -> None:
    """Lowers the session's advisory size of a task's shuffled rows, and raises
    the number of parts that adaptive execution makes tasks of.

    Facts are short strings of which a compressed byte holds much: tasks of the
    usual 64 MB take some 3 GB where several joins meet, and 200 parts make tasks that
    grow with the input.
    """
    size, first = "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    given = spark.conf.get(size, None) or "64m"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(given) > TASK_BYTES:
        spark.conf.set(size, str(TASK_BYTES))
    if int(spark.conf.get(first, None) or spark.conf.get("spark.sql.shuffle.partitions")) < FIRST_PARTS:
        spark.conf.set(first, str(FIRST_PARTS))


def paths_of(spec: str) -> list[str]:
    """The paths of a list with ``:`` between them; schemes and ports keep theirs."""
    return re.split(r":(?!//)(?!\d+/)(?<!\bfile:)(?<!\bdbfs:)", spec)


#: Paths of tables written within each of the open blocks of :func:`intermediates`.
_owners: list[list[str]] = []


@contextmanager
def intermediates(spark: SparkSession) -> Iterator[list[str]]:
    """Tables that the engine writes within the block are deleted at its end;
    what is to outlive it must be stored elsewhere by then::

        with intermediates(spark):
            engine.inference("offers/io", branches).write.parquet(path)
    """
    paths: list[str] = []
    _owners.append(paths)
    try:
        yield paths
    finally:
        _owners[:] = [o for o in _owners if o is not paths]
        conf = spark._jsc.hadoopConfiguration()
        for path in paths:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)


def bucketed(df: DataFrame, name: str, column: str, buckets: int) -> DataFrame:
    """``df`` written as a table in buckets by a column, so that joins and sums
    by it don't move its rows.  A bucket is one file where ``df`` was dealt out
    by that column into so many parts."""
    table = f"weft_{name}_{uuid.uuid4().hex[:12]}"
    path = posixpath.join(shared_folder(df.sparkSession), table)
    for owner in _owners:
        owner.append(path)
    df.write.bucketBy(buckets, column).option("path", path).saveAsTable(table)
    return df.sparkSession.table(table)


def buckets_for(size: int) -> int:
    """Buckets for facts made from so many bytes."""
    return max(8, min(2 * FIRST_PARTS, size // TASK_BYTES))


def written(df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """``df`` written to a folder of its own, in parts by some columns if
    wanted, and read back."""
    path = posixpath.join(shared_folder(df.sparkSession), f"weft-{name}-{uuid.uuid4().hex[:12]}")
    for owner in _owners:
        owner.append(path)
    writer = df.write.partitionBy(*by) if by else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
