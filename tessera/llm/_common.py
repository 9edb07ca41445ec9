"""Shared folders, written tables and small helpers of the operators here."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows of a file of a table of narrow rows, and of one whose rows hold texts, sets or signatures.
FILE_ROWS, WIDE_ROWS = 1 << 16, 1 << 13

_own_dir: str | None = None
_made: list[str] = []
_kept: list[dict] = []


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir`; a temporary one where that is unset and the master is local."""
    global _own_dir
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="tessera-shared-")
    return f"file://{_own_dir}"


def run_dir(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    _made.append(f"{shared_root(spark)}/tessera/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def remove_runs(spark: SparkSession) -> int:
    """Delete the folders that this session's operators made; for when their results have been used. Returns their number."""
    n = 0
    while _made:
        path = spark._jvm.org.apache.hadoop.fs.Path(_made.pop())
        n += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def written(df: DataFrame, path: str, codec: str = "snappy") -> DataFrame:
    """Write `df` as Parquet and read it again: the lineage is cut, and lost executors cost no rework."""
    spark = df.sparkSession
    df.write.mode("overwrite").option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def few(df: DataFrame, rows: int, each: int = FILE_ROWS) -> DataFrame:
    """`df`, of at most so many rows, in as many partitions as these need, or as there are cores: each partition becomes a file, which costs an executor several processes on a local store."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // each)))


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that `df` hasn't, in any case."""
    used = {c.lower() for c in df.columns}
    while stem.lower() in used:
        stem = f"_{stem}"
    return stem


def kept() -> dict:
    """A dictionary that a worker keeps from task to task, until `release`."""
    _kept.append({})
    return _kept[-1]


def release() -> None:
    """Empty what this worker keeps, and give the memory back: workers outlive a stage, and the next one has no use for it."""
    if not any(_kept):
        return
    import ctypes
    import gc

    import pyarrow as pa

    for held in _kept:
        held.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def text_of(col: str = "text"):
    """The text with null as the empty text."""
    return F.coalesce(F.col(col), F.lit(""))


def filesystem(uri: str):
    """(pyarrow filesystem, path) for a folder of the shared store, on driver or executor."""
    from pyarrow import fs

    if "://" not in uri:
        uri = f"file://{uri.removeprefix('file:')}"
    return fs.FileSystem.from_uri(uri)


def by_bytes(batch, column: str, most: int = 16 << 20):
    """An Arrow batch in slices of at most so many bytes in a string or binary column, or of one row."""
    import numpy as np
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(at, to - at)
        at = to
