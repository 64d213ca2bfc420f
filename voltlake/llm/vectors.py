"""Vectors of a table as rows that can take part: finite and not zero. Vectors of different lengths have nothing to do with each other."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(df: DataFrame, vec: str) -> DataFrame:
    """Rows whose vector is neither null, empty, zero nor holds null or non-finite components."""
    x = F.col(vec)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return df.where(x.isNotNull() & (F.size(x) > 0)).where(~bad & F.exists(x, lambda v: v != 0))


def lengths(df: DataFrame, vec: str) -> list[tuple[int, int]]:
    """(length, rows) of the vectors, the most frequent length first."""
    return [(r["n"], r["count"]) for r in df.groupBy(F.size(vec).alias("n")).count().orderBy(F.desc("count"), "n").collect()]


def matrix(column) -> np.ndarray:
    """The rows of a list column (equal lengths) as doubles."""
    flat = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    values = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(flat), -1)


def unit(x: np.ndarray) -> np.ndarray:
    top = np.abs(x).max(axis=1, keepdims=True)
    x = x / np.where(top > 0, top, 1)
    return x / np.sqrt((x * x).sum(1, keepdims=True))
