"""What the operators of this subpackage share."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import shutil
import tempfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


#: Paths of the tables stored in each open scratch().
_HELD: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). Only a local master, as in tests, may do without."""
    sc = spark.sparkContext
    if path := sc.getConf().get("spark.checkpoint.dir"):
        return path
    own = sc._jsc.sc().getCheckpointDir()
    if own.isDefined():
        return own.get()
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set: executors need a folder that they share")
    path = tempfile.mkdtemp(prefix="meridion-")
    atexit.register(shutil.rmtree, path, True)
    sc.setCheckpointDir(path)
    return path


def write(df: DataFrame, name: str) -> str:
    """The path of a table with df's rows in the shared folder."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return path


def delete(spark: SparkSession, *paths: str) -> None:
    """Deletes tables of the shared folder."""
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def stored(df: DataFrame, name: str, outer: bool = False) -> DataFrame:
    """df written to the shared folder and read again: the lineage ends here, and any executor can read the files.

    The table goes when the scratch() around it ends; with `outer`, when the one around that ends."""
    path = write(df, name)
    if len(_HELD) > outer:
        _HELD[-1 - outer].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Tables stored inside are deleted at the end."""
    _HELD.append([])
    try:
        yield
    finally:
        delete(spark, *_HELD.pop())


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until df has no such column."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def trim() -> None:
    """Gives memory that this worker has freed in earlier tasks back to the machine (workers outlive their tasks)."""
    pa.default_memory_pool().release_unused()
    pa.set_memory_pool(pa.system_memory_pool())  # what Arrow frees goes back by malloc_trim too
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):  # another C library than glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def docs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def crc(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, elementwise."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x
