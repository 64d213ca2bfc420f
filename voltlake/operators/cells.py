"""Zone cells: the part of a territory nearest to each of its offices, and shapes clipped or simplified by row.

A territory and its offices are one group, mostly of tens of zones; the cells of a large group are dealt out in parts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltlake.functions import shapes

SHAPE = "array<array<array<struct<x:double,y:double>>>>"


def plain(polys) -> shapes.Shape:
    """Nested rows as lists of points; a ring's repeated last point is dropped."""
    out = []
    for rings in polys if polys is not None else []:
        own = [[(p["x"], p["y"]) for p in ring] for ring in rings]
        out.append([r[:-1] if len(r) > 1 and r[0] == r[-1] else r for r in own])
    return out


def nested(shape: shapes.Shape) -> list:
    return [[[{"x": x, "y": y} for x, y in ring] for ring in rings] for rings in shape]


def mapped(f: Callable[[shapes.Shape], shapes.Shape]) -> Callable[[Column], Column]:
    """A column function of shapes from a function of one shape; null stays null."""

    @F.pandas_udf(SHAPE)
    def run(polys: pd.Series) -> pd.Series:
        return polys.map(lambda p: None if p is None else nested(f(plain(p))))

    return run


def clipped(convex: shapes.Ring) -> Callable[[Column], Column]:
    return mapped(lambda s: shapes.intersection(s, convex))


def without(convex: shapes.Ring) -> Callable[[Column], Column]:
    return mapped(lambda s: shapes.difference(s, convex))


def simplify(tolerance: float) -> Callable[[Column], Column]:
    return mapped(lambda s: shapes.simplified_shape(s, tolerance))


def ring_area(ring: Column) -> Column:
    """Area of a ring of struct(x, y), closed or not."""
    n = F.size(ring)
    steps = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(ring, i)["x"] * F.get(ring, (i + 1) % n)["y"] - F.get(ring, (i + 1) % n)["x"] * F.get(ring, i)["y"])
    return F.abs(F.aggregate(steps, F.lit(0.0), lambda s, v: s + v)) / 2


def area(polys: Column) -> Column:
    """Area of a shape: outer rings less holes."""
    one = lambda rings: ring_area(rings[0]) - F.aggregate(F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(0))), F.lit(0.0), lambda s, r: s + ring_area(r))
    return F.aggregate(polys, F.lit(0.0), lambda s, rings: s + one(rings))


def voronoi_cells(seeds: DataFrame, territories: DataFrame, least: int = 3, bound: int = 2_000_000) -> DataFrame:
    """(owner, seed, polys) of seeds (owner, seed, lon, lat) and territories (owner, polys); owners with fewer than ``least`` seeds have
    none. Up to ``bound`` seeds in all are broadcast, and the cells of an owner come from up to 16 tasks, each of which knows all its
    seeds; beyond, an owner is one task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples():
                got = shapes.voronoi_part(r.names, r.xs, r.ys, plain(r.polys), r.part, r.parts)
                yield pd.DataFrame({"owner": pd.Series([r.owner] * len(got), dtype=object), "seed": pd.Series(list(got), dtype=object), "polys": pd.Series([nested(s) for s in got.values()], dtype=object)})

    pairs = seeds.select("owner", F.col("seed").cast("string").alias("seed"), F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat"))
    pairs = pairs.where("lon is not null and lat is not null and not isnan(lon) and not isnan(lat)")
    count = pairs.groupBy(F.col("owner").alias("_own")).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    count = count.withColumn("parts", F.when(F.col("n") < 4096, 1).when(F.col("n") < 65536, 4).otherwise(16))
    size = count.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum("parts").alias("parts")).first()
    spread = 0 < size["n"] <= bound
    known = pairs.groupBy(F.col("owner").alias("_owner")).agg(F.sort_array(F.collect_list(F.struct("seed", "lon", "lat"))).alias("_all"))
    known = known.select("_owner", F.col("_all.seed").alias("names"), F.col("_all.lon").alias("xs"), F.col("_all.lat").alias("ys"))
    land = territories.groupBy("owner").agg(F.first("polys").alias("polys")).join(count, F.col("owner").eqNullSafe(F.col("_own")))
    land = land.select("owner", "polys", (F.col("parts") if spread else F.lit(1)).alias("parts")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    if spread:
        # Where their number is given, partitions of few but costly rows are not put together.
        most = max(64, int(seeds.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        land, known = land.repartition(min(size["parts"], most)), F.broadcast(known)
    return land.join(known, F.col("owner").eqNullSafe(F.col("_owner"))).drop("_owner").mapInPandas(run, f"owner string, seed string, polys {SHAPE}")


def coverage(cells: DataFrame, territories: DataFrame) -> DataFrame:
    """(owner, share): how much of its territory an owner's cells cover; cells do not overlap, so areas add up."""
    held = cells.groupBy("owner").agg(F.sum(area(F.col("polys"))).alias("held"))
    return territories.join(held, "owner", "left").select("owner", (F.coalesce("held", F.lit(0.0)) / area(F.col("polys"))).alias("share"))
