"""Keyed lookups between tables: aliases, novel keys, carry-forward, upserts and defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltlake.functions.text import collapse_ws

#: An alias table's kinds in order of precedence.
KINDS = ["canonical", "alias", "unusable"]


def alias_key(name: Column) -> Column:
    return F.lower(collapse_ws(name))


def canonicalise(df: DataFrame, aliases: DataFrame, name: str, out: str = "canonical") -> DataFrame:
    """Adds the canonical form of a name and the reason where there is none. The match is exact but for case
    and spaces, never fuzzy. ``aliases``: key, canonical, kind, reason. The table is one row per key after a grouped choice,
    so the join cannot multiply rows; Spark picks broadcast by its size."""
    prio = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    best = aliases.groupBy(alias_key(F.col("key")).alias("_k")).agg(F.min_by(F.struct("canonical", "kind", "reason"), F.struct(prio, F.col("canonical"))).alias("_a"))
    j = df.withColumn("_k", alias_key(F.col(name))).join(best, "_k", "left")
    usable = F.col("_a.kind").isin("canonical", "alias")
    reason = F.when(F.col("_a").isNull(), "unrecognised").when(~usable, F.col("_a.reason"))
    return j.withColumns({out: F.when(usable, F.col("_a.canonical")), "reason": reason}).drop("_k", "_a")


def novel(seen: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Distinct keys seen but not known; none if nothing is known."""
    some = known.limit(1).agg((F.count("*") > 0).alias("_some"))  # one row
    return seen.select(key).where(F.col(key).isNotNull()).distinct().join(known.select(key), key, "left_anti").join(F.broadcast(some)).where("_some").drop("_some")


def learn(known: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """The known keys and the newly seen ones, distinct."""
    return known.select(key).union(seen.select(key).where(F.col(key).isNotNull())).distinct()


def carry_forward(new: DataFrame, previous: DataFrame, key: str, flag: str = "carried") -> DataFrame:
    """The new rows, and the previous rows of keys that the new build lacks, flagged."""
    kept = previous.join(new.select(key).distinct(), key, "left_anti").withColumn(flag, F.lit(True))
    return new.withColumn(flag, F.lit(False)).unionByName(kept, allowMissingColumns=True)


def upsert(current: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The current rows with those of the new keys replaced."""
    return current.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def with_defaults(left: DataFrame, right: DataFrame, left_key: Column, right_key: Column, defaults: dict) -> DataFrame:
    """A case-insensitive left join on codes; missing values take the defaults."""
    r = right.withColumn("_rk", F.upper(F.trim(right_key)))
    return left.withColumn("_lk", F.upper(F.trim(left_key))).join(r, F.col("_lk") == F.col("_rk"), "left").drop("_lk", "_rk").fillna(defaults)


def keep_previous(new: DataFrame, previous: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """New rows whose missing values are taken from the previous observation."""
    old = previous.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    j = new.join(old, key, "left")
    return j.select(*[F.coalesce(c, f"_{c}").alias(c) if c in columns else F.col(c) for c in new.columns])
