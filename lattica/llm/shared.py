"""What several operators need: the shared folder, text columns as bytes, worker caches."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Hashes whose bits are counted at a time.
CHUNK = 1 << 16


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of our own only in local mode where that is unset."""
    conf = spark.sparkContext.getConf()
    folder = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    kept = spark.sparkContext.getCheckpointDir() if hasattr(spark.sparkContext, "getCheckpointDir") else None
    if kept:
        return kept.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="lattica-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


#: Paths and tables written by staged() and staged_table() in this process.
WRITTEN: list[tuple[str, str | None]] = []


def staged(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """df, written to the shared folder and read again: it is computed once and needs no executor's disk. temporary() leaves it if `keep`."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if not keep:
        WRITTEN.append((path, None))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def staged_table(df: DataFrame, name: str, buckets: int, by: str) -> DataFrame:
    """df as a table in the shared folder, bucketed by a column, so that joins on it move no rows."""
    spark, table = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{table}"
    WRITTEN.append((path, table))
    df.write.format("parquet").option("path", path).bucketBy(buckets, by).saveAsTable(table)
    return spark.table(table)


@contextmanager
def temporary(spark: SparkSession):
    """Drops, at its end, what was staged since its beginning. Results that read it must be written by then."""
    before = len(WRITTEN)
    try:
        yield
    finally:
        for path, table in WRITTEN[before:]:
            if table:
                spark.sql(f"drop table if exists {table}")
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        del WRITTEN[before:]


#: Rows of keys that may be broadcast: 8 MB of longs.
FEW = 1 << 20


def few(keys: DataFrame, name: str) -> DataFrame:
    """keys, staged, and to be broadcast if there are no more than `FEW` of them; else a join picks its own way."""
    keys = staged(keys, name)
    return F.broadcast(keys) if keys.count() <= FEW else keys


def majority(hashes: np.ndarray) -> int:
    """64 bits, each 1 if over half of the 64-bit hashes have it."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        counts += np.unpackbits(hashes[at : at + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def free_name(taken: list[str], name: str) -> str:
    """name, with underscores before it while a column of that name (in any case) exists."""
    low = {x.lower() for x in taken}
    while name.lower() in low:
        name = "_" + name
    return name


def once_a_worker(key: str, make: Callable):
    """make()'s result, kept for later tasks of the same Python worker."""
    kept = sys.modules.setdefault("_lattica_worker", types.ModuleType("_lattica_worker")).__dict__.setdefault("kept", {})
    if key not in kept:
        kept[key] = make()
    return kept[key]


def as_bytes(column) -> list[bytes]:
    """An Arrow string column's values as UTF-8 bytes; null is empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def slices(batches: Iterator, rows: int = 256, keep: tuple[str, ...] = ()) -> Iterator:
    """Arrow batches of at most so many rows, to bound what one step holds. Of what once_a_worker() keeps, only keys that begin like `keep` stay."""
    kept = getattr(sys.modules.get("_lattica_worker"), "kept", {})
    for key in [k for k in kept if not k.startswith(keep or ("\0",))]:
        del kept[key]
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    release()


def release() -> None:
    """Gives memory that a finished task no longer uses back to the system: workers live on with the next task."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
