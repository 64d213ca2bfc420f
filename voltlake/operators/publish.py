"""Publishing: change detection, idempotent landing, retention, the feed index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stable_hash(columns: list[str]) -> Column:
    """SHA-256 of the canonical JSON of the columns that count as content."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def hash_of_parts(parts: Column) -> Column:
    """Order-free hash of an array of hashes: sorted, joined by a bar, hashed."""
    return F.sha2(F.array_join(F.array_sort(parts), "|"), 256)


def hash_of_hashes(part: Column) -> Column:
    """Order-free hash of a group, such as the files of a release: as ``hash_of_parts``. The group is held in one row;
    ``tree_hash`` is for groups without a bound."""
    return hash_of_parts(F.collect_list(part))


def tree_hash(df: DataFrame, keys: list[str], part: str, digits: int = 3) -> DataFrame:
    """(keys, hash): an order-free hash of any number of hashes. They are hashed by their first ``digits`` digits, then
    these at most 16 ** ``digits`` hashes with their digits in front."""
    prefix, inner = "_prefix", "_inner"
    buckets = df.groupBy(*keys, F.left(part, F.lit(digits)).alias(prefix)).agg(hash_of_hashes(F.col(part)).alias(inner))
    return buckets.groupBy(*keys).agg(hash_of_hashes(F.concat_ws(":", prefix, inner)).alias("hash"))


def build_id(files: DataFrame, suffixes: tuple[str, ...] = (".html", ".js", ".css"), digits: int = 12) -> DataFrame:
    """One row, the id of a build: the first digits of the SHA-256 of its files' bytes in order of path. ``files``: path, content; only the given
    suffixes count, and nothing in a folder named data. A build's files are few."""
    own = files.where(F.array_contains(F.array(*[F.lit(s) for s in suffixes]), F.regexp_extract("path", r"(\.[^./]*)$", 1)) & ~F.array_contains(F.split("path", "/"), "data"))
    rows = F.array_sort(F.collect_list(F.struct("path", F.hex("content").alias("h"))))
    return own.agg(F.left(F.sha2(F.unhex(F.array_join(F.transform(rows, lambda x: x["h"]), "")), 256), F.lit(digits)).alias("build"))


def changed(new: DataFrame, active: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """New rows whose content differs from the active row of their key, or that have none."""
    a = active.select(F.col(key).alias("_k"), stable_hash(columns).alias("_h"))
    n = new.withColumn("_n", stable_hash(columns))
    return n.join(a, (F.col(key) == F.col("_k")) & (F.col("_n") == F.col("_h")), "left_anti").drop("_n")


def landed(batch: DataFrame, archive: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a batch that the archive lacks, each once."""
    return batch.dropDuplicates(keys).join(archive.select(*keys).distinct(), keys, "left_anti")


def feed_status(ok: Column, live: Column, weekday: Column, today: int, has_last: Column, link_only: Column) -> Column:
    """fresh only if this run fetched live and the sheet's weekday is today's or unknown; a failure keeps the last good
    version as stale."""
    return (
        F.when(link_only, "link-only").when(ok & live & (weekday.isNull() | (weekday == today)), "fresh")
        .when(ok | has_last, "stale").otherwise("unavailable")
    )


def coverage_level(status: Column, sources: Column) -> Column:
    return F.when(status.isin("fresh", "stale"), "feeder").when(status == "link-only", "link").when(sources > 0, "registered").otherwise("none")


def index_order(status: Column, utility: Column) -> list[Column]:
    """Fresh feeds first, then by utility."""
    return [(status != "fresh").asc(), utility.asc()]


def is_heartbeat(changed_rows: Column, targeted: Column) -> Column:
    """Whether a run writes the index: always on a full run, else only if something changed."""
    return ~targeted | (changed_rows > 0)
