"""Scans: JSON documents, GeoJSON layers, HTML links, delimited columns, fixed-width text and file sniffing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON documents of a schema; a missing path is an empty table, a malformed document a row whose
    ``_corrupt_record`` says so."""
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    full = T.StructType([*kind.fields, T.StructField("_corrupt_record", T.StringType())])
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], full)
    return spark.read.schema(full).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


#: A GeoJSON collection; coordinates stay JSON text until the geometry's type is known.
GEOJSON = "features array<struct<properties: map<string,string>, geometry: struct<type: string, coordinates: string>>>"
_POLY = "array<array<array<double>>>"


def features(layer: DataFrame) -> DataFrame:
    """ord, props, geom_type and polys (a polygon is a multipolygon of one part) or pt of each feature."""
    rows = layer.select(F.posexplode("features").alias("ord", "f"))
    text = F.col("f.geometry.coordinates")
    as_xy = lambda rings: F.transform(rings, lambda r: F.transform(r, lambda v: F.struct(v[0].alias("x"), v[1].alias("y"))))
    one = F.array(as_xy(F.from_json(text, _POLY)))
    many = F.transform(F.from_json(text, f"array<{_POLY}>"), as_xy)
    kind = F.col("f.geometry.type")
    point = F.from_json(text, "array<double>")
    return rows.select(
        "ord", F.col("f.properties").alias("props"), kind.alias("geom_type"),
        F.when(kind == "Polygon", one).when(kind == "MultiPolygon", many).alias("polys"),
        F.when(kind == "Point", F.struct(point[0].alias("x"), point[1].alias("y"))).alias("pt"),
    )


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    return features(read_json(spark, path, GEOJSON))


def links(html: Column) -> Column:
    """All link targets of a page, in order."""
    return F.regexp_extract_all(html, F.lit(r'href="([^"]*)"'), F.lit(1))


def label_before(html: Column, target: Column, reach: int = 300, keep: int = 90) -> Column:
    """The text before a link: tags dropped from the ``reach`` characters before it, its last ``keep``."""
    at = F.locate("\u0001", F.replace(html, F.concat(F.lit('href="'), target, F.lit('"')), F.lit("\u0001")))
    return label_at(html, at, reach, keep)


def label_at(html: Column, at: Column, reach: int = 300, keep: int = 90) -> Column:
    """The text before the character ``at`` (from 1; 0: none), as ``label_before`` gives it."""
    piece = F.substring(html, F.greatest(F.lit(1), at - reach), F.least(F.lit(reach), at - 1))
    text = F.trim(F.regexp_replace(F.regexp_replace(piece, "<[^>]+>", " "), r"\s+", " "))
    return F.when(at > 0, F.right(text, F.lit(keep)))


def sniff(content: Column, content_type: Column, url: Column) -> Column:
    """pdf, html, the type's or the address's format, else bin."""
    head = F.lower(F.substring(content, 1, 200))
    by_type = F.when(F.contains(content_type, F.lit("pdf")), "pdf").when(F.contains(content_type, F.lit("html")), "html").when(F.contains(content_type, F.lit("json")), "json").when(F.contains(content_type, F.lit("csv")), "csv")
    tail = F.regexp_extract(F.lower(url), r"\.([a-z0-9]{2,4})(?:[?#].*)?$", 1)
    return F.when(F.startswith(content, F.lit("%PDF-")), "pdf").when(head.rlike(r"<!doctype html|<html"), "html").when(by_type.isNotNull(), by_type).when(tail.isin("pdf", "html", "json", "csv", "xlsx", "png", "jpg"), tail).otherwise("bin")


def fixed_width(line: Column, spans: list[tuple[int, int]], slack: int = 3) -> Column:
    """The first integer near each character span (0-based, end exclusive) of a line, or null."""
    return F.array(*[F.regexp_extract(F.substring(line, max(1, a - slack + 1), b - a + 2 * slack if a >= slack else b + slack), r"(\d+)", 1).try_cast("int") for a, b in spans])


def delimited(columns: dict[str, Column], sep: str = "|") -> Column:
    """An array of structs from columns whose values are joined by ``sep``."""
    arrays = [F.split(c, F.lit(rf"\{sep}")).alias(k) for k, c in columns.items()]
    return F.transform(F.arrays_zip(*arrays), lambda s: F.struct(*[s[k].alias(k) for k in columns]))


def newest_file(files: DataFrame) -> DataFrame:
    """Per utility the newest archived file by (date prefix, modification time), never by name."""
    date = F.regexp_extract(F.element_at(F.split("path", "/"), -1), r"^(\d{4}-\d{2}-\d{2})", 1)
    return files.groupBy("utility").agg(F.max_by("path", F.struct(date, F.col("mtime"))).alias("path"))


def write_json(df: DataFrame, path: str) -> None:
    """One deterministic JSON-lines file set: columns sorted, rows sorted within the table, replaced as a whole."""
    names = sorted(df.columns)
    df.select(*names).orderBy(*names).write.mode("overwrite").json(path)

