"""Structured Streaming over polled files: version guards, change detection, windows.

Sources are file streams; every run drains what is there (``availableNow``), so the trigger is the
scheduler's. Sinks are versioned tables in a folder shared by the cluster.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, or under the warehouse where that is unset (tests)."""
    shared = spark.conf.get("spark.checkpoint.dir", "") or f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints"
    return f"{shared}/stream-{name}-{uuid.uuid4().hex}"


def files(spark: SparkSession, path: str, schema, pattern: str = "*.parquet", per_trigger: int = 1) -> DataFrame:
    """A stream of the Parquet files of a folder."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", per_trigger).parquet(path)


def drain(stream: DataFrame, each: Callable[[DataFrame, int], None], mode: str = "append", name: str = "run") -> None:
    """Run a stream over all that is there now, batch by batch."""
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", folder(stream.sparkSession, name)).foreachBatch(each).trigger(availableNow=True).start()
    q.awaitTermination()


class Table:
    """A table of one part for each batch: a batch that is replayed replaces its own part, and a batch costs what it brings, not what was there
    before. ``compacted`` merges parts into one."""

    def __init__(self, spark: SparkSession, name: str, schema: str):
        self.spark, self.base, self.schema, self.parts = spark, folder(spark, name), schema, {}

    def read(self, before: int | None = None) -> DataFrame:
        """All parts, or those of batches before one."""
        own = [path for batch, path in sorted(self.parts.items()) if before is None or batch < before]
        return self.spark.read.schema(self.schema).parquet(*own) if own else self.spark.createDataFrame([], self.schema)

    def write(self, df: DataFrame, batch: int) -> None:
        path = f"{self.base}/b{batch}"
        df.write.mode("overwrite").parquet(path)
        self.parts[batch] = path

    def compacted(self, merge: Callable[[DataFrame], DataFrame], batch: int, every: int = 32) -> None:
        """Replaces all parts up to ``batch`` by their merge once there are ``every`` of them."""
        if len(self.parts) >= every:
            path = f"{self.base}/m{batch}"
            merge(self.read()).write.mode("overwrite").parquet(path)
            self.parts = {batch: path}


def newest_versions(stream: DataFrame, state: Table, key: str, version: list[str]) -> DataFrame:
    """Keep the newest row per key; older versions that arrive late are refused. A batch adds its own newest rows; parts are
    merged on reading."""
    names = state.read().columns
    best = lambda df: df.groupBy(key).agg(F.max_by(F.struct(*names), F.struct(*version)).alias("r")).select("r.*")

    def step(batch: DataFrame, number: int) -> None:
        state.write(best(batch.select(*names)), number)
        state.compacted(best, number)

    drain(stream, step, name="versions")
    return best(state.read())


def changes(stream: DataFrame, published: Table, keys: list[str], content: Column) -> DataFrame:
    """Append rows whose (keys, content hash) was not published before."""

    def step(batch: DataFrame, number: int) -> None:
        rows = batch.select(*keys, F.sha2(content, 256).alias("hash")).distinct()
        published.write(rows.join(published.read(number), [*keys, "hash"], "left_anti"), number)
        published.compacted(lambda df: df, number)

    drain(stream, step, name="changes")
    return published.read()


def appended(stream: DataFrame, out: Table) -> DataFrame:
    """All rows of a stream; a replayed batch replaces its own."""
    drain(stream, out.write, name="appended")
    return out.read()


def complete(stream: DataFrame, result: Table) -> DataFrame:
    """The whole result of a streaming aggregate once the input is drained."""
    drain(stream, lambda batch, _: result.write(batch, 0), "complete", "complete")
    return result.read()


def tumbling(stream: DataFrame, ts: str, width: str, late: str, *keys: str) -> DataFrame:
    """Counts per window and keys; rows later than the watermark are dropped by Spark (an extension)."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width), *keys).agg(F.count("*").alias("n"))


def sessions(stream: DataFrame, ts: str, gap: str, key: str) -> DataFrame:
    """Counts per session of a key (an extension; the streaming form of gap clustering)."""
    return stream.groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n"))


def staleness(state: DataFrame, checked: str, now: Column, stale_after: float = 36.0) -> DataFrame:
    """Adds the state of each feed by the hours since it was last checked."""
    from voltlake.functions.timewin import freshness

    age = (F.unix_seconds(now) - F.unix_seconds(F.col(checked).cast("timestamp"))) / 3600.0
    return state.withColumn("state", freshness(age, stale_after))
