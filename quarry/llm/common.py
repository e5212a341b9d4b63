"""Helpers the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a longest run of characters other than blank and U+0009..U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` under ``sf_dir``; only Spark opens the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor shares: ``spark.checkpoint.dir``.

    Only a session on a single machine (tests) may name none; a temporary folder is
    set there, once per session. On a cluster that is an error.
    """
    current = spark.sparkContext.getCheckpointDir()
    held = spark.conf.get("spark.checkpoint.dir", None) or current
    if not held:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        held = tempfile.mkdtemp(prefix="quarry-checkpoint-")
    if current is None:
        spark.sparkContext.setCheckpointDir(held)
    return held


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def drop(spark: SparkSession, path: str) -> None:
    """Delete a folder that ``scratch`` named."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def hashed(*cols: Column | str, seed: int = 0) -> Column:
    """Seeded 64-bit hash that depends on the values alone."""
    return F.xxhash64(F.lit(seed), *cols)


#: What operators keep in a Python worker from task to task, by operator.
_WORKER: dict[str, dict] = {}


def worker_state(operator: str) -> dict:
    """The operator's memo in this worker; the next other operator there empties it."""
    return _WORKER.setdefault(operator, {})


def release(keep: str = "") -> None:
    """Empty the memos of other operators and give freed memory back to the system.

    Workers outlive their tasks; what one operator has left would otherwise count
    against the next one on the same executor.
    """
    import ctypes
    import gc

    import pyarrow as pa

    for operator, state in _WORKER.items():
        if operator != keep:
            state.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def slices(batch, column: int, limit: int = 8 << 20):
    """Cut an Arrow record batch so that ``column``'s texts of a piece stay near ``limit`` bytes.

    A single longer text is a piece of its own. Bounds what one step holds.
    """
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if len(sizes) > start:
        yield batch.slice(start)
