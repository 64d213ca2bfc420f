"""The data-quality gate: each check is a table of findings; the verdict is the worst of them.

Documents have the claims schema of ``sources.claims``. Checks run as column expressions over one row
per document; only duplicates and novel divisions need a grouped pass.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltlake.functions.timewin import hhmm_strict

SEVERITY = {"pass": 0, "quarantine": 1, "reject": 2}
BADGES = ["OFFICIAL", "DERIVED", "ESTIMATED", "UNKNOWN"]


def severity(verdict: Column) -> Column:
    return F.when(verdict == "reject", 2).when(verdict == "quarantine", 1).otherwise(0)


def verdict(findings: DataFrame, docs: DataFrame, key: str) -> DataFrame:
    """(key, verdict): the most severe finding; pass without findings."""
    worst = findings.groupBy(key).agg(F.max_by("verdict", severity(F.col("verdict"))).alias("verdict"))
    return docs.select(key).distinct().join(worst, key, "left").select(key, F.coalesce("verdict", F.lit("pass")).alias("verdict"))


def histogram(findings: DataFrame) -> DataFrame:
    return findings.groupBy("verdict", "check").agg(F.count("*").alias("n"))


def rows(df: DataFrame, key: str, when: Column, level: Column | str, check: str, detail: Column | str) -> DataFrame:
    """Findings of one check."""
    as_col = lambda c: F.lit(c) if isinstance(c, str) else c
    return df.where(F.coalesce(when, F.lit(False))).select(F.col(key), as_col(level).alias("verdict"), F.lit(check).alias("check"), as_col(detail).cast("string").alias("detail"))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row with the number of rows beyond the first of their keys."""
    return df.groupBy(*keys).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("n_duplicates"))


def validate(docs: DataFrame, key: str = "doc_key", known: DataFrame | None = None, previous: DataFrame | None = None, strict_utility: str = "A") -> DataFrame:
    """All findings of claims documents: (key, verdict, check, detail).

    ``known``: (utility, division) learned so far. ``previous``: (utility, effective_date, claim_count) now active.
    ``strict_utility`` must have exactly 24 hour columns, others 1 to 24.
    """
    n = F.size("claims")
    hours = F.col("parse_meta.hour_column_count")
    claims = F.col("claims")
    bad_window = lambda w: hhmm_strict(w["start"]).isNull() | hhmm_strict(w["end"]).isNull() | (hhmm_strict(w["end"]) <= hhmm_strict(w["start"]))
    malformed = F.aggregate(claims, F.lit(0), lambda s, c: s + F.size(F.filter(F.coalesce(c["windows"], F.array()), bad_window)))
    windowless = F.size(F.filter(claims, lambda c: F.coalesce(F.size(c["windows"]), F.lit(0)) <= 0))
    bare = F.size(F.filter(claims, lambda c: c["division_canonical"].isNull()))
    missing = F.array_compact(F.array(*[F.when(F.coalesce(F.col(f"source.{f}"), F.lit("")) == "", F.lit(f)) for f in ("source_url", "retrieved_at", "sha256", "parser_adapter")]))
    shape = (
        (F.col("schema") != "schedule-claims/1") | ~F.col("effective_date").rlike(r"^\d{4}-\d{2}-\d{2}$") | ~F.col("badge").isin(BADGES)
        | F.exists(claims, lambda c: ~c["feeder_id"].rlike(r"^[a-z0-9]+:[a-z0-9-]+:[a-z0-9-]+$") | c["feeder"].isNull() | (c["weekday"] < 0) | (c["weekday"] > 6) | (c["load_mw"] < 0))
    )
    found = [
        rows(docs, key, shape, "reject", "schema", "the document violates its schema"),
        rows(docs, key, (n == 0) & F.col("had_content"), "reject", "empty-parse", "content but no claims"),
        rows(docs, key, (hours < 1) | (hours > 24) | ((F.col("utility") == strict_utility) & (hours != 24)), "reject", "hour-columns", hours),
        rows(docs, key, malformed > 0, "reject", "time-sanity", malformed),
        rows(docs, key, windowless > 0, "quarantine", "empty-claims", windowless),
        rows(docs, key, (n > 0) & (bare > 0), F.when(bare / n > 0.25, "reject").otherwise("quarantine"), "canonical-division", bare),
    ]
    each = docs.select(key, F.explode(missing).alias("field"))
    found.append(each.select(key, F.lit("reject").alias("verdict"), F.lit("provenance").alias("check"), F.col("field").alias("detail")))
    flat = docs.select(key, "utility", F.explode("claims").alias("c"))
    windows = flat.select(key, "c.feeder_id", "c.weekday", F.explode("c.windows").alias("w")).groupBy(key, "feeder_id", "weekday", "w").count()
    again = windows.where("count > 1").groupBy(key).agg(F.sum(F.col("count") - 1).alias("n"))
    found.append(again.select(key, F.lit("quarantine").alias("verdict"), F.lit("duplicates").alias("check"), F.col("n").cast("string").alias("detail")))
    if known is not None:
        learned = known.select("utility").distinct()
        seen = flat.select(key, "utility", F.col("c.division").alias("division")).distinct().join(learned, "utility", "left_semi").join(known, ["utility", "division"], "left_anti")
        first = seen.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy("division"))).where("r <= 8")
        names = first.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list("division")), ", ").alias("d"))
        found.append(names.select(key, F.lit("quarantine").alias("verdict"), F.lit("unknown-division").alias("check"), F.col("d").alias("detail")))
    if previous is not None:
        p = previous.select("utility", F.col("effective_date").alias("_date"), F.col("claim_count").alias("_n"))
        j = docs.join(p, "utility")
        found.append(rows(j, key, F.col("effective_date") < F.col("_date"), "reject", "date-regression", F.col("_date")))
        found.append(rows(j, key, (F.col("_n") >= 50) & (n < 0.5 * F.col("_n")), "quarantine", "volume-drop", n))
    return reduce(DataFrame.unionByName, found)
