"""Map layers and documents: a registry of layers, GeoJSON collections, a zone registry, documents written whole.

A layer is one document, of a size that its publisher bounds; layers are built side by side or one by one, and one that fails is an empty
collection with a note.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_document(spark: SparkSession, path: str, text: str) -> str:
    """Write one document whole: to a name beside it, then renamed over it. Returns its SHA-256."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    beside = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.part")
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(beside, True)
    raw = text.encode()
    out.write(bytearray(raw))
    out.close()
    if not fs.rename(beside, at):
        fs.delete(at, False)
        if not fs.rename(beside, at):
            raise OSError(f"cannot replace {path}")
    return hashlib.sha256(raw).hexdigest()


def document(content) -> str:
    """Deterministic JSON: sorted keys, two spaces, letters as they are."""
    return json.dumps(content, ensure_ascii=False, indent=2, sort_keys=True) + "\n"


def geometry(polys: Column, places: int = 5) -> Column:
    """The GeoJSON text of a shape (``array<array<array<struct<x, y>>>>``), rounded; rings are closed."""
    point = lambda p: F.array(F.round(p["x"], places), F.round(p["y"], places))
    closed = lambda r: F.when(F.get(r, F.lit(0)) == F.element_at(r, -1), r).otherwise(F.concat(r, F.slice(r, 1, 1)))
    rings = lambda poly: F.transform(poly, lambda r: F.transform(closed(r), point))
    one = F.to_json(F.struct(F.lit("Polygon").alias("type"), rings(polys[0]).alias("coordinates")))
    many = F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), F.transform(polys, rings).alias("coordinates")))
    return F.when(F.size(polys) == 1, one).otherwise(many)


def point_geometry(lon: Column, lat: Column, places: int = 5) -> Column:
    return F.to_json(F.struct(F.lit("Point").alias("type"), F.array(F.round(lon, places), F.round(lat, places)).alias("coordinates")))


def collections(features: DataFrame) -> DataFrame:
    """(layer, n_features, geojson) of features (layer, id, geometry text or null, properties as a map): in order of id; features without a
    geometry are left out."""
    one = F.concat(F.lit('{"type":"Feature","geometry":'), "geometry", F.lit(',"properties":'), F.to_json("properties", {"ignoreNullFields": "false"}), F.lit("}"))
    rows = features.groupBy("layer").agg(F.array_sort(F.collect_list(F.when(F.col("geometry").isNotNull(), F.struct("id", one.alias("f"))))).alias("r"))
    body = F.array_join(F.transform("r", lambda x: x["f"]), ",")
    return rows.select("layer", F.size("r").alias("n_features"), F.concat(F.lit('{"type":"FeatureCollection","features":['), body, F.lit("]}")).alias("geojson"))


Builder = Callable[[SparkSession], DataFrame]


class Layers:
    """Layers by name; any subset can be built, and one that fails does not stop the others."""

    def __init__(self):
        self.builders: dict[str, Builder] = {}

    def register(self, name: str, build: Builder) -> None:
        """``build`` gives features (id, geometry, properties)."""
        self.builders[name] = build

    def build(self, spark: SparkSession, folder: str, names: Iterable[str] | None = None) -> dict[str, str | None]:
        """Writes ``folder``/name.geojson of the layers; returns the failure of each, or None."""
        names, out = list(names if names is not None else self.builders), {}
        if unknown := [n for n in names if n not in self.builders]:
            raise KeyError(f"unknown layers: {unknown}")
        for name in names:
            try:
                got = collections(self.builders[name](spark).withColumn("layer", F.lit(name))).first()
                content, out[name] = json.loads(got["geojson"]) if got else {"type": "FeatureCollection", "features": []}, None
            except Exception as e:  # a failed layer is an empty collection that says so
                content, out[name] = {"type": "FeatureCollection", "features": [], "note": f"{type(e).__name__}: {e}"[:500]}, str(e)
            write_document(spark, f"{folder}/{name}.geojson", document(content))
        return out


def zone_layers(layers: Layers, zones: list[dict], cells: Callable[[SparkSession, dict], DataFrame]) -> None:
    """One layer for each row of a table of distributors (``file``, ``utility``, ``color``): another distributor is another row. ``cells`` gives seed and
    polys; every cell is marked as an estimate."""
    for zone in zones:

        def build(spark, zone=zone):
            fixed = {"utility": zone["utility"], "color_hex": zone["color"], "level": "zone", "status": "estimated", "method": "nearest office"}
            props = F.create_map(F.lit("name"), F.col("seed"), *(F.lit(x) for kv in sorted(fixed.items()) for x in kv))
            return cells(spark, zone).select(F.col("seed").alias("id"), geometry(F.col("polys")).alias("geometry"), props.alias("properties"))

        layers.register(zone["file"], build)


def zone_registry(zones: DataFrame, utility: str, discovery: str) -> DataFrame:
    """One row: the registry document (JSON text) of zones (slug, name, lat, lon, pdf_url) in order of slug, with counts."""
    rows = F.array_sort(F.collect_list(F.struct("slug", "name", "lat", "lon", "pdf_url", F.col("pdf_url").isNotNull().alias("pdf_live"))))
    doc = F.struct(F.lit("zones/1").alias("schema"), F.lit(utility).alias("utility"), F.lit(discovery).alias("discovery"), F.count("*").alias("zone_count"), F.count("pdf_url").alias("with_live_pdf"), F.count("lat").alias("with_point"), rows.alias("zones"))
    return zones.agg(F.to_json(doc, {"ignoreNullFields": "false"}).alias("document"))


def coverage_document(rows: DataFrame) -> DataFrame:
    """One row: the Markdown report of (utility, level, sources, claims), in order of utility."""
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("—"))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", cell("utility"), cell("level"), cell("sources"), cell("claims")), F.lit(" |\n"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("utility", line.alias("l")))), lambda x: x["l"]), "")
    return rows.agg(F.concat(F.lit("| Utility | Coverage | Sources | Claims |\n|---|---|---|---|\n"), body).alias("report"))
