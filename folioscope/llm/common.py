"""What the training-data operators share: the shared folder, written intermediate tables, row batches."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTING = "spark.checkpoint.dir"
_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Where the setting is absent a temporary folder is made, but only for a local master, where all tasks run on
    this machine; on a cluster its absence is an error.
    """
    found = spark.conf.get(SETTING, None)
    if found:
        return found.rstrip("/")
    if _own:
        return _own[0]
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError(f"set {SETTING} to a folder that all machines of the cluster share")
    _own.append("file://" + tempfile.mkdtemp(prefix="folioscope-"))
    spark.sparkContext.setCheckpointDir(_own[0])
    return _own[0]


def new_dir(spark: SparkSession, tag: str) -> str:
    """The URI of a new folder below :func:`shared_dir`; it goes when the driver's process ends."""
    uri = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex[:12]}"
    fs, path = filesystem(uri)
    fs.create_dir(path, recursive=True)
    atexit.register(remove, uri)
    return uri


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system for a URI, and the path in it."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def local_path(uri: str) -> str | None:
    """The path to open or to map into memory, or None where the URI isn't a mounted folder's."""
    parts = urlparse(uri)
    return parts.path if parts.scheme in ("", "file") else None


def remove(uri: str) -> None:
    """Deletes a folder that this process made."""
    if path := local_path(uri):
        shutil.rmtree(path, ignore_errors=True)
        return
    try:
        fs, path = filesystem(uri)
        fs.delete_dir(path)
    except OSError:
        pass


def written(df: DataFrame, tag: str) -> DataFrame:
    """The same rows, written as Parquet to the shared folder and read again: a cut lineage that outlives executors."""
    spark = df.sparkSession
    out = f"{new_dir(spark, tag)}/table"
    df.write.parquet(out)
    return spark.read.schema(df.schema).parquet(out)


#: Rows from which a key counts as hot, and its share of all rows for that: at most so many keys are hot.
HOT_ROWS, HOT_SHARE = 1000, 1 << 16

#: Bits of a sieve, as a power of two: 16 MB that all executors get.
SIEVE_BITS = 27


def spread(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """An inner or left join whose right side has each key once, in which no task gathers the left rows of a hot key.

    The right rows of hot keys, HOT_SHARE at most, come to the left rows where these lie; all others meet by a shuffle.
    The left table is read twice, so it should be a written one.
    """
    rows = left.count()
    if rows <= HOT_ROWS:
        return left.join(right, on, how)
    counts = left.groupBy(on).agg(F.count("*").alias("rows_of_key"))
    hot = written(counts.where(F.col("rows_of_key") > max(HOT_ROWS, rows // HOT_SHARE)).select(on), "hot")
    if not hot.limit(1).count():
        return left.join(right, on, how)
    own = right.join(F.broadcast(hot), on, "left_semi")
    cold = left.join(F.broadcast(hot), on, "left_anti").join(right, on, how)
    return cold.unionByName(left.join(F.broadcast(hot), on, "left_semi").join(F.broadcast(own), on, how))


def sieved(rows: DataFrame, key: F.Column, wanted: DataFrame, name: str) -> DataFrame:
    """Adds a boolean: false only where a row's key is not among the wanted ones, which are a table with the one column ``key``.

    The wanted keys set bits in a field of fixed size that comes to the rows, so that a join which follows has to shuffle
    little more than the rows that it finds; the more keys there are, the more others pass. Null keys don't.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << SIEVE_BITS))
    bits = wanted.select(place(F.col("key")).alias("at")).groupBy(F.bitmap_bucket_number("at").alias(f"{name}_part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias(f"{name}_bits"))
    at = F.bitmap_bit_position(place(key))
    marked = rows.withColumn(f"{name}_part", F.bitmap_bucket_number(place(key))).join(F.broadcast(bits), f"{name}_part", "left")
    byte = F.conv(F.hex(F.substring(F.col(f"{name}_bits"), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    test = F.coalesce(key.isNotNull() & (F.floor(byte / F.pow(F.lit(2), at % 8)) % 2 == 1), F.lit(False))
    return marked.withColumn(name, test).drop(f"{name}_part", f"{name}_bits")


def settle() -> None:
    """Gives memory that a worker no longer uses back to the machine, so that idle workers hold little."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def by_bytes(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose texts have about ``most`` bytes together, one row at least; tidies up at the end."""
    for batch in batches:
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start, total = 0, 0
        for i, n in enumerate(sizes):
            if i > start and total + n > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += int(n)
        if start < batch.num_rows:
            yield batch.slice(start)
    settle()
