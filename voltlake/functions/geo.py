"""Geographic functions on longitude and latitude, as column expressions.

Polygons are arrays of rings (the outer one first), rings arrays of struct(x, y).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The country's bounding box and the capital region's (fixed values: west, south, east, north).
COUNTRY = (88.0, 20.5, 92.7, 26.7)
CAPITAL = (90.2, 23.55, 90.65, 24.05)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance on a sphere of 6371 km."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * 6371.0) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def in_box(lon: Column, lat: Column, box: tuple[float, float, float, float]) -> Column:
    return lon.between(box[0], box[2]) & lat.between(box[1], box[3])


def in_ring(ring: Column, x: Column, y: Column) -> Column:
    """Whether a point is inside a ring, by counting the edges that a ray to the right crosses."""
    n = F.size(ring)
    edge = lambda i: (F.element_at(ring, i), F.element_at(ring, F.when(i == 1, n).otherwise(i - 1)))

    def crosses(i):
        a, b = edge(i)
        return ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"] + F.lit(1e-300)) + a["x"])

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(False), lambda odd, i: odd != crosses(i))


def in_polygon(rings: Column, x: Column, y: Column) -> Column:
    """Inside the outer ring and no hole."""
    holes = F.slice(rings, 2, F.size(rings))
    return in_ring(F.element_at(rings, 1), x, y) & ~F.exists(holes, lambda r: in_ring(r, x, y))


def in_multipolygon(polys: Column, x: Column, y: Column) -> Column:
    return F.exists(polys, lambda p: in_polygon(p, x, y))


def bbox(polys: Column) -> Column:
    """struct(min_x, min_y, max_x, max_y) of all vertices."""
    flat = F.flatten(F.flatten(polys))
    xs, ys = F.transform(flat, lambda p: p["x"]), F.transform(flat, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("min_x"), F.array_min(ys).alias("min_y"), F.array_max(xs).alias("max_x"), F.array_max(ys).alias("max_y"))


def _cross(ring: Column):
    n = F.size(ring)
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.element_at(ring, i).alias("a"), F.element_at(ring, F.when(i == n, 1).otherwise(i + 1)).alias("b")))


def signed_area(ring: Column) -> Column:
    return F.aggregate(_cross(ring), F.lit(0.0), lambda s, e: s + (e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])) / 2


def centroid(polys: Column) -> Column:
    """struct(x, y): outer-ring centroids weighted by absolute area; null without area."""

    def part(p):
        ring = F.element_at(p, 1)
        area = signed_area(ring)
        sx = F.aggregate(_cross(ring), F.lit(0.0), lambda s, e: s + (e["a"]["x"] + e["b"]["x"]) * (e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]))
        sy = F.aggregate(_cross(ring), F.lit(0.0), lambda s, e: s + (e["a"]["y"] + e["b"]["y"]) * (e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]))
        return F.struct(F.abs(area).alias("w"), (sx / (6 * area)).alias("x"), (sy / (6 * area)).alias("y"))

    parts = F.transform(polys, part)
    w = F.aggregate(parts, F.lit(0.0), lambda s, p: s + p["w"])
    x = F.aggregate(parts, F.lit(0.0), lambda s, p: s + p["w"] * p["x"])
    y = F.aggregate(parts, F.lit(0.0), lambda s, p: s + p["w"] * p["y"])
    return F.when(w > 0, F.struct((x / w).alias("x"), (y / w).alias("y")))


def circle(lon: Column, lat: Column, km: float, corners: int = 8) -> Column:
    """A regular polygon around a point, its first corner repeated."""
    step = lambda i: F.lit(2.0) * F.pi() * i / corners
    return F.transform(F.sequence(F.lit(0), F.lit(corners)), lambda i: F.struct((lon + F.lit(km / 111.32) * F.cos(step(i)) / F.cos(F.radians(lat))).alias("x"), (lat + F.lit(km / 110.574) * F.sin(step(i))).alias("y")))


def rounded(polys: Column, places: int) -> Column:
    """All coordinates rounded."""
    return F.transform(polys, lambda p: F.transform(p, lambda r: F.transform(r, lambda v: F.struct(F.round(v["x"], places).alias("x"), F.round(v["y"], places).alias("y")))))


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Length that two intervals share."""
    return F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))
