"""Queries over places, distances and candidate ranking, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from voltlake.functions import geo as G
from voltlake.functions import ranking as R
from voltlake.operators import cells as CE
from voltlake.operators import spatial as SP
from voltlake.sources import layers as LA
from voltlake.sources.tables import located, table

Q: dict = {}
S: dict = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        Q[name] = f
        if sql:
            S[name] = sql
        return f

    return keep


def points(spark, sf):
    return located(table(spark, sf, "customer"), "c_custkey").select(F.col("c_custkey").alias("id"), "lon", "lat")


def offices(spark, sf):
    return located(table(spark, sf, "supplier"), "s_suppkey").select(F.col("s_suppkey").alias("place_id"), "lon", "lat")


def _at(key: str) -> str:
    return f"88.0::DOUBLE + CAST(({key} * 7919) % 4700 AS DOUBLE) / 1000 AS lon, 20.5::DOUBLE + CAST(({key} * 104729) % 6200 AS DOUBLE) / 1000 AS lat"


def km_sql(a: str, b: str) -> str:
    return f"(12742.0 * asin(sqrt(least(1.0, pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2)))))"


P = f"p AS (SELECT c_custkey AS id, {_at('c_custkey')} FROM customer), o AS (SELECT s_suppkey AS place_id, {_at('s_suppkey')} FROM supplier)"

#: Territories of the queries: ord, name, polygons -> rings -> (x, y). One is concave, one has a hole, one has two
#: parts, and the last overlaps the first.
SHAPES = [
    (1, "north", [[[(89.0, 24.5), (91.0, 24.5), (91.0, 26.5), (89.0, 26.5)]]]),
    (2, "south", [[[(89.0, 21.0), (92.0, 21.0), (92.0, 22.0), (90.0, 22.0), (90.0, 23.5), (89.0, 23.5)]]]),
    (3, "ring", [[[(90.2, 22.2), (92.4, 22.2), (92.4, 24.2), (90.2, 24.2)], [(90.8, 22.8), (91.6, 22.8), (91.6, 23.6), (90.8, 23.6)]]]),
    (4, "pair", [[[(88.1, 20.6), (88.9, 20.6), (88.9, 22.4)]], [[(91.6, 24.6), (92.6, 24.6), (92.1, 26.4)]]]),
    (5, "wide", [[[(88.5, 24.0), (91.5, 24.0), (91.5, 26.0), (88.5, 26.0)]]]),
]

_POLYS = "array<array<array<struct<x:double,y:double>>>>"


def features(spark):
    return spark.createDataFrame(SHAPES, f"ord int, name string, polys {_POLYS}")


def _edges() -> str:
    rows = []
    for k, name, polys in SHAPES:
        for a, rings in enumerate(polys):
            for b, ring in enumerate(rings):
                for c, (x, y) in enumerate(ring):
                    u, v = ring[c - 1]
                    rows.append(f"({k}, '{name}', {a}, {b}, {c}, {x}::DOUBLE, {y}::DOUBLE, {u}::DOUBLE, {v}::DOUBLE)")
    return f"e(ord, name, poly, ring, i, x, y, px, py) AS (VALUES {', '.join(rows)})"


HITS = f"""{P}, {_edges()}, odd AS (SELECT p.id, p.lon, p.lat, e.ord, e.name, e.poly, e.ring,
count(*) FILTER (WHERE (e.y > p.lat) <> (e.py > p.lat) AND p.lon < (e.px - e.x) * (p.lat - e.y) / (e.py - e.y + 1e-300) + e.x) % 2 = 1 AS inside FROM p, e GROUP BY ALL),
poly AS (SELECT id, ord, name, poly, bool_and(CASE WHEN ring = 0 THEN inside ELSE NOT inside END) AS inside FROM odd GROUP BY ALL),
hits AS (SELECT DISTINCT id, ord, name FROM poly WHERE inside)"""


@query("pip_join", f"WITH {HITS} SELECT id, ord, name FROM hits")
def pip_join(spark, sf):
    return SP.containment(points(spark, sf), features(spark)).select("id", "ord", "name")


@query("pip_grid", f"WITH {HITS} SELECT id, ord, name FROM hits")
def pip_grid(spark, sf):
    return SP.containment(points(spark, sf), features(spark), broadcast=False).select("id", "ord", "name")


@query("first_territory", f"WITH {HITS} SELECT p.id, min_by(h.name, h.ord) AS name FROM p LEFT JOIN hits h USING (id) GROUP BY p.id")
def first_territory(spark, sf):
    return SP.first_containing(points(spark, sf), features(spark), "id", "name").select("id", "name")


@query("bbox_filter", f"WITH {P} SELECT id, lon BETWEEN 90.2 AND 90.65 AND lat BETWEEN 23.55 AND 24.05 AS in_capital, lon BETWEEN 88.0 AND 92.7 AND lat BETWEEN 20.5 AND 26.7 AS in_country FROM p WHERE lon BETWEEN 89 AND 92")
def bbox_filter(spark, sf):
    p = points(spark, sf).where(F.col("lon").between(89.0, 92.0))
    return p.select("id", G.in_box(F.col("lon"), F.col("lat"), G.CAPITAL).alias("in_capital"), G.in_box(F.col("lon"), F.col("lat"), G.COUNTRY).alias("in_country"))


@query("geo_gates", f"WITH {P} SELECT count(*) AS n, count(*) FILTER (WHERE lat BETWEEN 20 AND 26 AND lon BETWEEN 88.5 AND 92) AS ranged FROM p")
def geo_gates(spark, sf):
    return points(spark, sf).agg(F.count("*").alias("n"), F.count_if(F.col("lat").between(20, 26) & F.col("lon").between(88.5, 92)).alias("ranged"))


@query("knn", f"WITH {P}, d AS (SELECT p.id, o.place_id, {km_sql('p', 'o')} AS km FROM p, o) SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY km, place_id) AS INTEGER) AS rank, place_id, round(km, 4) AS km FROM d QUALIFY rank <= 5")
def knn(spark, sf):
    return SP.nearest_any(points(spark, sf), offices(spark, sf), 5).withColumn("km", F.round("km", 4))


@query("nearest1", f"WITH {P}, d AS (SELECT p.id, o.place_id, {km_sql('p', 'o')} AS km FROM p, (SELECT *, CASE WHEN place_id % 7 <> 0 THEN 'sheet ' || place_id END AS url FROM o) o WHERE o.url IS NOT NULL) SELECT id, min_by(place_id, (km, place_id)) AS place_id, round(min(km), 4) AS km FROM d GROUP BY id")
def nearest1(spark, sf):
    # Only places with a published sheet count.
    zones = offices(spark, sf).withColumn("url", F.when(F.col("place_id") % 7 != 0, F.concat(F.lit("sheet "), F.col("place_id").cast("string"))))
    return SP.nearest_any(points(spark, sf), zones.where("url is not null"), 1).select("id", "place_id", F.round("km", 4).alias("km"))


@query("voronoi_assign", f"WITH {P}, d AS (SELECT p.id, o.place_id, {km_sql('p', 'o')} AS km FROM p, o), b AS (SELECT id, min_by(place_id, (km, place_id)) AS seed FROM d GROUP BY id) SELECT seed, count(*) AS n FROM b GROUP BY seed")
def voronoi_assign(spark, sf):
    return SP.nearest_any(points(spark, sf), offices(spark, sf), 1).groupBy(F.col("place_id").alias("seed")).agg(F.count("*").alias("n"))


@query("radius", f"WITH {P}, d AS (SELECT p.id, o.place_id, {km_sql('p', 'o')} AS km FROM p, o) SELECT id, place_id, round(km, 4) AS km FROM d WHERE km <= 40 QUALIFY row_number() OVER (PARTITION BY id ORDER BY km, place_id) <= 8")
def radius(spark, sf):
    near = SP.within(points(spark, sf), offices(spark, sf), 40.0)
    return SP.top_by(near, "id", 8, F.col("km"), F.col("place_id")).select("id", "place_id", F.round("km", 4).alias("km"))


def seeds(spark, sf):
    """Offices dealt to the first three territories, as seeds of their zones."""
    names = F.element_at(F.array(*[F.lit(name) for _, name, _ in SHAPES[:3]]), (F.col("place_id") % 3 + 1).cast("int"))
    return offices(spark, sf).select(names.alias("owner"), F.col("place_id").alias("seed"), "lon", "lat")


@query("voronoi_cells")
def voronoi_cells(spark, sf):
    cells = CE.voronoi_cells(seeds(spark, sf), features(spark).withColumnRenamed("name", "owner"))
    return cells.select("owner", "seed", F.size("polys").alias("parts"), F.round(CE.area(F.col("polys")), 6).alias("area"))


_OWNERS = ", ".join(f"({k}, '{name}')" for k, (_, name, _) in enumerate(SHAPES))


@query("coverage_share", f"WITH n(k, owner) AS (VALUES {_OWNERS}) SELECT owner, CASE WHEN count(s_suppkey) >= 3 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS share FROM n LEFT JOIN supplier ON s_suppkey % 3 = k GROUP BY owner")
def coverage_share(spark, sf):
    land = features(spark).withColumnRenamed("name", "owner")
    return CE.coverage(CE.voronoi_cells(seeds(spark, sf), land), land).select("owner", F.round("share", 6).alias("share"))


_BOX = [(90.0, 21.5), (91.5, 21.5), (91.5, 25.5), (90.0, 25.5)]


@query("clip_shapes")
def clip_shapes(spark, sf):
    """Areas of the territories inside and outside a box, and of what simplification leaves."""
    f = features(spark)
    own = [("whole", F.col("polys")), ("inside", CE.clipped(_BOX)(F.col("polys"))), ("outside", CE.without(_BOX)(F.col("polys"))), ("simple", CE.simplify(0.01)(F.col("polys")))]
    return f.select("name", *[F.round(CE.area(shape), 6).alias(k) for k, shape in own])


@query("layer_collections", f"WITH {P} SELECT CASE WHEN place_id % 2 = 0 THEN 'even' ELSE 'odd' END AS layer, count(*) AS n_features, count(*) AS read_back FROM o GROUP BY 1")
def layer_collections(spark, sf):
    o = offices(spark, sf).select(F.when(F.col("place_id") % 2 == 0, "even").otherwise("odd").alias("layer"), F.col("place_id").alias("id"), LA.point_geometry(F.col("lon"), F.col("lat")).alias("geometry"), F.create_map(F.lit("name"), F.col("place_id").cast("string")).alias("properties"))
    made = LA.collections(o)
    back = F.size(F.from_json("geojson", "features array<struct<geometry: struct<coordinates: array<double>>>>")["features"])
    return made.select("layer", F.col("n_features").cast("long").alias("n_features"), back.cast("long").alias("read_back"))


@query("bbox_agg", f"WITH {_edges()} SELECT name, min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y FROM e GROUP BY name")
def bbox_agg(spark, sf):
    return features(spark).select("name", G.bbox(F.col("polys")).alias("b")).select("name", "b.*")


@query("centroid", f"""WITH {_edges()}, r AS (SELECT name, poly, sum(px * y - x * py) / 2 AS a, sum((px + x) * (px * y - x * py)) AS sx, sum((py + y) * (px * y - x * py)) AS sy FROM e WHERE ring = 0 GROUP BY name, poly)
SELECT name, round(sum(abs(a) * sx / (6 * a)) / sum(abs(a)), 5) AS x, round(sum(abs(a) * sy / (6 * a)) / sum(abs(a)), 5) AS y FROM r GROUP BY name""")
def centroid(spark, sf):
    return features(spark).select("name", G.centroid(F.col("polys")).alias("c")).select("name", F.round("c.x", 5).alias("x"), F.round("c.y", 5).alias("y"))


@query("median_point", f"WITH {P} SELECT place_id % 5 AS grp, median(lat) AS lat, median(lon) AS lon FROM o GROUP BY 1")
def median_point(spark, sf):
    return offices(spark, sf).groupBy((F.col("place_id") % 5).alias("grp")).agg(F.median("lat").alias("lat"), F.median("lon").alias("lon"))


@query("geo_round", f"WITH {P} SELECT place_id, round(lon / 3, 3) AS x, round(lat / 3, 3) AS y FROM o")
def geo_round(spark, sf):
    o = offices(spark, sf).select("place_id", F.array(F.array(F.array(F.struct((F.col("lon") / 3).alias("x"), (F.col("lat") / 3).alias("y"))))).alias("polys"))
    return o.select("place_id", G.rounded(F.col("polys"), 3)[0][0][0].alias("v")).select("place_id", "v.x", "v.y")


@query("circle_poly", f"WITH {P}, i AS (SELECT unnest(range(9)) AS i) SELECT place_id, CAST(i AS INTEGER) AS corner, round(lon + (2.0 / 111.32) * cos(2 * pi() * i / 8) / cos(radians(lat)), 6) AS x, round(lat + (2.0 / 110.574) * sin(2 * pi() * i / 8), 6) AS y FROM o, i")
def circle_poly(spark, sf):
    c = offices(spark, sf).select("place_id", F.posexplode(G.circle(F.col("lon"), F.col("lat"), 2.0)).alias("corner", "v"))
    return c.select("place_id", "corner", F.round("v.x", 6).alias("x"), F.round("v.y", 6).alias("y"))


@query("band_sort", f"WITH {P} SELECT place_id, CAST(row_number() OVER (ORDER BY floor(lat * 20 + 0.5), lon, place_id) AS INTEGER) AS pos FROM o")
def band_sort(spark, sf):
    o = offices(spark, sf)
    # Rank within bands, then add the sizes of the bands before: no single-partition sort of the rows.
    band = F.floor(F.col("lat") * 20 + 0.5)
    ranked = o.withColumn("band", band).withColumn("r", F.row_number().over(Window.partitionBy("band").orderBy("lon", "place_id")))
    sizes = o.groupBy(band.alias("band")).agg(F.count("*").alias("n"))
    first = sizes.withColumn("before", F.sum("n").over(Window.orderBy("band").rowsBetween(Window.unboundedPreceding, -1))).drop("n")
    return ranked.join(F.broadcast(first), "band").select("place_id", (F.col("r") + F.coalesce("before", F.lit(0))).cast("int").alias("pos"))


RANKED = f"""{P}, d AS (SELECT p.id, o.place_id, {km_sql('p', 'o')} AS km FROM p, o), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY km, place_id) AS r FROM d),
s AS (SELECT id, place_id, km, CASE WHEN km < 30 THEN 1.0::DOUBLE ELSE 0.95 * exp(-km / 55.0) END AS score FROM k WHERE r <= 6),
ranked AS (SELECT *, CAST(row_number() OVER w AS INTEGER) AS rank, score - coalesce(lead(score) OVER w, 0) AS margin, lead(score) OVER w IS NULL AS alone FROM s WINDOW w AS (PARTITION BY id ORDER BY score DESC, place_id))"""


def ranked(spark, sf):
    near = SP.nearest_any(points(spark, sf), offices(spark, sf), 6).drop("rank")
    score = F.when(F.col("km") < 30, 1.0).otherwise(R.distance_decay(F.col("km") / 10))
    w = Window.partitionBy("id").orderBy(F.desc("score"), "place_id")
    s = near.withColumn("score", score)
    return s.withColumns({"rank": F.row_number().over(w), "margin": F.col("score") - F.coalesce(F.lead("score").over(w), F.lit(0.0))})


@query("division_rank", f"WITH {RANKED} SELECT id, place_id, rank, round(score, 5) AS score, round(margin, 5) AS margin, CASE WHEN score >= 0.98 AND margin > 0.15 THEN 'high' WHEN score >= 0.6 THEN 'medium' ELSE 'low' END AS confidence FROM ranked WHERE rank = 1")
def division_rank(spark, sf):
    r = ranked(spark, sf).where("rank = 1")
    return r.select("id", "place_id", "rank", F.round("score", 5).alias("score"), F.round("margin", 5).alias("margin"), R.division_confidence(F.col("score"), F.col("margin")).alias("confidence"))


FEEDERS = f"""{RANKED}, f AS (SELECT s_suppkey AS feeder, s_suppkey % 120 AS division, CAST(s_suppkey % 11 AS DOUBLE) / 10 AS area FROM supplier),
c AS (SELECT p.id, f.feeder, CASE WHEN r.rank IS NULL THEN 0.10 WHEN r.rank = 1 THEN 1.0 WHEN r.rank = 2 THEN 0.62 WHEN r.rank = 3 THEN 0.36 ELSE 0.15 END::DOUBLE AS div, least(1.0, area) AS area FROM p CROSS JOIN f LEFT JOIN ranked r ON r.id = p.id AND r.place_id = f.division),
t AS (SELECT *, 0.5 * div + 0.5 * area AS score FROM c), b AS (SELECT *, CAST(row_number() OVER w AS INTEGER) AS rank, score - coalesce(lead(score) OVER w, 0) AS margin FROM t WINDOW w AS (PARTITION BY id ORDER BY score DESC, feeder))"""


def feeders(spark, sf):
    """The three best feeders (one utility's claims, hundreds of rows) for every point."""
    k = F.col("s_suppkey")
    f = table(spark, sf, "supplier").select(k.alias("feeder"), (k % 120).alias("place_id"), F.least(F.lit(1.0), (k % 11).cast("double") / 10).alias("area"))
    # Feeders of a division differ by area alone, so only its first four can be among a point's first three or follow them.
    f = SP.top_by(f, "place_id", 4, F.desc("area"), F.col("feeder")).drop("rank")
    r = ranked(spark, sf).select("id", "place_id", "rank")
    # Every point has the unranked weight for all feeders; ranked ones are joined by division.
    ids = r.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("place_id", "rank"))).alias("ranks"))
    c = ids.join(F.broadcast(f)).withColumn("r", F.try_element_at("ranks", F.col("place_id")))
    c = c.withColumn("div", R.division_weight(F.col("r"), F.lit(True))).withColumn("score", R.feeder_score(F.col("div"), F.col("area")))
    w = Window.partitionBy("id").orderBy(F.desc("score"), "feeder")
    best = c.withColumns({"rank": F.row_number().over(w), "margin": F.col("score") - F.coalesce(F.lead("score").over(w), F.lit(0.0))})
    return best.where("rank <= 3").select("id", "feeder", "rank", "div", "area", "score", "margin")


@query("feeder_rank", f"""WITH {FEEDERS} SELECT id, feeder, rank, round(score, 5) AS score, round(margin, 5) AS margin,
CASE WHEN score < 0.28 THEN 'none' WHEN div >= 0.95 AND area >= 0.7 AND margin >= 0.2 THEN 'medium' WHEN div >= 0.95 AND area >= 0.45 AND margin >= 0.10 THEN 'medium' ELSE 'low' END AS confidence FROM b WHERE rank <= 3""")
def feeder_rank(spark, sf):
    f = feeders(spark, sf)
    level = R.capped(R.confidence(F.col("score"), F.col("div"), F.col("area"), F.col("margin")), F.lit(False))
    return f.select("id", "feeder", "rank", F.round("score", 5).alias("score"), F.round("margin", 5).alias("margin"), level.alias("confidence"))


@query("agreement", f"""WITH {FEEDERS}, a AS (SELECT id, count(*) FILTER (WHERE feeder % 3 = id % 3) AS active, count(*) AS total FROM b WHERE rank <= 3 GROUP BY id)
SELECT id, active, total, CASE WHEN active = 0 THEN 'none' WHEN active = total THEN 'all' ELSE format('{{:d}} of {{:d}}', active, total) END AS said, CASE WHEN active = 0 THEN 'clear' WHEN active = total THEN 'active' ELSE 'split' END AS state FROM a""")
def agreement(spark, sf):
    a = feeders(spark, sf).groupBy("id").agg(F.count_if(F.col("feeder") % 3 == F.col("id") % 3).alias("active"), F.count("*").alias("total"))
    return a.select("*", R.agreement(F.col("active"), F.col("total")).alias("said"), R.answer_state(F.col("total"), F.col("active")).alias("state"))


@query("evidence_filter", f"WITH {P}, d AS (SELECT p.id, o.place_id, CASE WHEN o.place_id % 9 = 0 THEN NULL ELSE round({km_sql('p', 'o')}, 6) END AS km FROM p JOIN customer ON c_custkey = p.id JOIN supplier ON s_nationkey = c_nationkey JOIN o ON o.place_id = s_suppkey) SELECT id, place_id, km FROM d WHERE km IS NULL OR km <= 150")
def evidence_filter(spark, sf):
    p = points(spark, sf).join(table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation")), "id")
    o = offices(spark, sf).join(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("place_id"), F.col("s_nationkey").alias("nation")), "place_id").withColumnsRenamed({"lat": "_lat", "lon": "_lon"})
    km = F.when(F.col("place_id") % 9 != 0, F.round(G.haversine_km(F.col("lat"), F.col("lon"), F.col("_lat"), F.col("_lon")), 6))
    return p.join(o, "nation").select("id", "place_id", km.alias("km")).where("km is null or km <= 150")


@query("deeplink", f"WITH {P}, t AS (SELECT id, CASE WHEN id % 5 = 0 THEN 'page?x=1' ELSE 'page?at=' || printf('%.4f', lat) || ',' || printf('%.4f', lon) END AS url FROM p) SELECT id, TRY_CAST(nullif(regexp_extract(url, 'at=([0-9.-]+),([0-9.-]+)', 1), '') AS DOUBLE) AS lat, TRY_CAST(nullif(regexp_extract(url, 'at=([0-9.-]+),([0-9.-]+)', 2), '') AS DOUBLE) AS lon FROM t")
def deeplink(spark, sf):
    url = F.when(F.col("id") % 5 == 0, "page?x=1").otherwise(F.concat(F.lit("page?at="), F.format_string("%.4f", "lat"), F.lit(","), F.format_string("%.4f", "lon")))
    part = lambda k: F.regexp_extract("url", r"at=([0-9.-]+),([0-9.-]+)", k).try_cast("double")
    return points(spark, sf).select("id", url.alias("url")).select("id", part(1).alias("lat"), part(2).alias("lon"))


@query("holdout", f"WITH {P}, n AS (SELECT place_id, CASE WHEN place_id % 6 = 0 THEN NULL ELSE lat END AS lat, lon FROM o) SELECT place_id, lat FROM n WHERE lat IS NOT NULL AND place_id NOT IN (3, 5, 8)")
def holdout(spark, sf):
    o = offices(spark, sf).select("place_id", F.when(F.col("place_id") % 6 != 0, F.col("lat")).alias("lat"))
    return o.where(F.col("lat").isNotNull() & ~F.col("place_id").isin(3, 5, 8))


@query("overlap_clamp", """SELECT l_orderkey, l_linenumber, greatest(0.0, least(l_quantity + 10, l_discount * 100 + 20) - greatest(l_quantity, l_discount * 100)) AS shared, least(30.0, greatest(5.0, l_quantity)) AS clamped FROM lineitem""")
def overlap_clamp(spark, sf):
    q, d = F.col("l_quantity"), F.col("l_discount") * 100
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", G.overlap(q, q + 10, d, d + 20).alias("shared"), G.clamp(q, 5.0, 30.0).alias("clamped"))


@query("column_height", "WITH z AS (SELECT s_nationkey AS zone, sum(CASE WHEN s_acctbal > 0 THEN s_acctbal ELSE 0 END) AS mw FROM supplier GROUP BY 1) SELECT zone, round(80 + 820 * sqrt(mw / max(mw) OVER ()), 3) AS height FROM z")
def column_height(spark, sf):
    z = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("zone")).agg(F.sum(F.greatest(F.col("s_acctbal"), F.lit(0.0))).alias("mw"))
    top = z.agg(F.max("mw").alias("top"))  # one row
    return z.join(F.broadcast(top)).select("zone", F.round(80 + 820 * F.sqrt(F.col("mw") / F.col("top")), 3).alias("height"))
