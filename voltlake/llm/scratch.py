"""Intermediate tables in the folder that the cluster shares.

``spark.checkpoint.dir`` names that folder; it is read from the session.
Only where it is unset, as in tests, a folder in the session's warehouse is used.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def root(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables."""
    return spark.conf.get("spark.checkpoint.dir", "") or f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints"


def table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a Parquet table in the shared folder and read it back: lineage is
    cut, and a lost executor costs a read, not a recomputation."""
    path = f"{root(df.sparkSession)}/voltlake-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    got = df.sparkSession.read.schema(df.schema).parquet(path)
    got._stored_at = path
    return got


def drop(*tables: DataFrame) -> None:
    """Delete stored tables that nothing to come reads."""
    for t in tables:
        jvm = t.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(t._stored_at)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def free(columns: list[str], *names: str) -> list[str]:
    """Names like the given ones that no column has, whatever its case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out


def checked(ids: DataFrame, most: int = 1_000_000) -> DataFrame:
    """Ids to be joined with texts: broadcast if a count finds at most ``most`` (about 32 MB as a hashed relation of longs), else as they are,
    so that Spark shuffles."""
    return F.broadcast(ids) if ids.limit(most + 1).count() <= most else ids


@contextmanager
def small_batches(spark: SparkSession, rows: int = 500):
    """Arrow batches of whole texts with few rows each, for what runs inside; the session's setting returns after."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def tidy() -> None:
    """Give freed memory of a Python worker back to the system; workers serve many tasks."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        return  # not this C library
