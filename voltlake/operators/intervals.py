"""Interval operators: DataFrame -> DataFrame, one shuffle on the keys each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge_hours(df: DataFrame, keys: list[str], hour: str = "hour") -> DataFrame:
    """Consecutive marked hours as windows: keys, start_min, end_min."""
    own = df.select(*keys, F.col(hour).cast("int").alias("_h")).distinct()
    w = Window.partitionBy(*keys).orderBy("_h")
    island = own.withColumn("_i", F.col("_h") - F.row_number().over(w))
    return island.groupBy(*keys, "_i").agg((F.min("_h") * 60).alias("start_min"), ((F.max("_h") + 1) * 60).alias("end_min")).drop("_i")


def merge_intervals(df: DataFrame, keys: list[str], start: str, end: str, mode: str = "touch_or_overlap") -> DataFrame:
    """Intervals merged per key. ``touch``: only where one ends exactly where the next starts;
    ``touch_or_overlap``: also where they overlap. Malformed intervals (end <= start) are dropped."""
    if mode not in ("touch", "touch_or_overlap"):
        raise ValueError(mode)
    own = df.select(*keys, F.col(start).alias("_s"), F.col(end).alias("_e")).where(F.col("_e") > F.col("_s"))
    w = Window.partitionBy(*keys).orderBy("_s", "_e")
    if mode == "touch":
        new = F.coalesce(F.lag("_e").over(w) != F.col("_s"), F.lit(True))
    else:
        new = F.coalesce(F.max("_e").over(w.rowsBetween(Window.unboundedPreceding, -1)) < F.col("_s"), F.lit(True))
    grouped = own.withColumn("_n", new.cast("int")).withColumn("_g", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy(*keys, "_g").agg(F.min("_s").alias(start), F.max("_e").alias(end)).drop("_g")


def active_next(df: DataFrame, keys: list[str], now: int, start: str = "start_min", end: str = "end_min") -> DataFrame:
    """Per key: total minutes, whether a window is active at ``now`` (start <= now < end), minutes left, and the
    next start."""
    s, e = F.col(start), F.col(end)
    live = (s <= now) & (e > now)
    return df.groupBy(*keys).agg(
        F.sum(e - s).cast("long").alias("total_min"), F.bool_or(live).alias("active"),
        F.max(F.when(live, e - now)).alias("left_min"), F.min(F.when(s > now, s)).alias("next_start"),
    )


def weekday_fallback(df: DataFrame, keys: list[str], today: int, weekday: str = "weekday") -> DataFrame:
    """Per key today's rows, else those without a weekday, else all; ``match`` says which."""
    prio = F.when(F.col(weekday) == today, 0).when(F.col(weekday).isNull(), 1).otherwise(2)
    best = F.min("_p").over(Window.partitionBy(*keys))
    return df.withColumn("_p", prio).withColumn("_b", best).where("_p = _b").withColumn("match", F.element_at(F.array(F.lit("today"), F.lit("undated"), F.lit("other")), F.col("_p") + 1)).drop("_p", "_b")


def gap_clusters(df: DataFrame, keys: list[str], order: Column, gap: Column | float, name: str = "cluster") -> DataFrame:
    """Rows numbered by cluster: a new one starts where the step from the last row exceeds ``gap``."""
    w = Window.partitionBy(*keys).orderBy("_o")
    own = df.withColumn("_o", order)
    new = F.coalesce((F.col("_o") - F.lag("_o").over(w)) > gap, F.lit(True)).cast("int")
    return own.withColumn("_n", new).withColumn(name, F.sum("_n").over(w.rangeBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_n", "_o")


def first_per_key(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """First-wins dedupe: the first row of each key in an order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def newest(df: DataFrame, keys: list[str], k: int, *order: Column) -> DataFrame:
    """The first ``k`` rows of each key in an order (snapshot retention)."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= k).drop("_r")


def with_margin(df: DataFrame, keys: list[str], score: str, k: int, *ties: str) -> DataFrame:
    """The ``k`` best rows of each key with rank and margin to the next row (the last row's is its score)."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score), *ties)
    out = df.withColumn("rank", F.row_number().over(w)).withColumn("margin", F.col(score) - F.coalesce(F.lead(score).over(w), F.lit(0.0)))
    return out.where(F.col("rank") <= k)


def delta(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Delta encoding: the first value, then steps."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("delta", F.col(value) - F.coalesce(F.lag(value).over(w), F.lit(0)))


def undelta(df: DataFrame, keys: list[str], order: str, step: str = "delta") -> DataFrame:
    """Running sums of steps."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("value", F.sum(step).over(w))
