"""Shapes, cells, grids, layers, readings and build ids against plain rules."""

import hashlib
import json
import math
import random
import time

import pytest
from pyspark.sql import functions as F

from voltlake.functions import codecs, shapes
from voltlake.operators import cells, grids, publish, readings, sheets
from voltlake.plans import q_geo
from voltlake.sources import layers, scans

BOX = [(0.0, 0.0), (4.0, 0.0), (4.0, 3.0), (0.0, 3.0)]
HOLED = [[BOX, [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 2.0)]]]


def inside(shape, x, y):
    def odd(ring):
        return sum((a[1] > y) != (b[1] > y) and x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0] for a, b in zip(ring, ring[1:] + ring[:1], strict=True)) % 2

    return any(odd(rings[0]) and not any(odd(h) for h in rings[1:]) for rings in shape)


def test_set_operations_of_shapes():
    assert shapes.area(HOLED) == 11
    other = [(1.5, -1.0), (5.0, 1.5), (1.5, 4.0), (0.5, 1.5)]
    both, less, all_ = shapes.intersection(HOLED, other), shapes.difference(HOLED, other), shapes.union(HOLED, other)
    assert math.isclose(shapes.area(both) + shapes.area(less), 11) and math.isclose(shapes.area(all_), shapes.area(less) + abs(shapes.ring_area(other)))
    rng = random.Random(1)
    for _ in range(500):
        x, y = rng.uniform(-1, 6), rng.uniform(-2, 5)
        a, b = inside(HOLED, x, y), inside([[other]], x, y)
        assert (inside(both, x, y), inside(less, x, y), inside(all_, x, y)) == (a and b, a and not b, a or b)
    assert shapes.intersection(HOLED, [(9.0, 9.0), (10.0, 9.0), (10.0, 10.0)]) == []


def test_simplified_rings():
    ring = [(math.cos(k / 50 * math.pi), math.sin(k / 50 * math.pi)) for k in range(100)]
    out = shapes.simplified(ring, 0.05)
    assert 3 <= len(out) < 30 and all(min(shapes._apart(p, a, b) for a, b in zip(out, out[1:] + out[:1], strict=True)) <= 0.05 for p in ring)
    assert shapes.simplified(BOX, 0.1) == BOX and shapes.simplified(BOX[:3], 9.0) == BOX[:3] and len(shapes.simplified(BOX, 99.0)) >= 3


def test_voronoi_cells_are_nearest():
    rng = random.Random(2)
    seeds = [(k, rng.uniform(-0.5, 4.5), rng.uniform(-0.5, 3.5)) for k in range(40)] + [("again", 1.0, 1.0), ("twice", 1.0, 1.0)]
    got = shapes.voronoi(seeds, HOLED)
    assert "twice" not in got and math.isclose(sum(map(shapes.area, got.values())), 11)
    for _ in range(400):
        x, y = rng.uniform(0, 4), rng.uniform(0, 3)
        if inside(HOLED, x, y):
            assert inside(got[min(seeds, key=lambda s: (s[1] - x) ** 2 + (s[2] - y) ** 2)[0]], x, y)


def test_voronoi_of_many_seeds():
    rng = random.Random(4)
    spread = [(k, rng.uniform(-1, 5), rng.uniform(-1, 4)) for k in range(4000)]
    took = []
    for seeds in (spread[:500], spread):
        began = time.process_time()
        got = shapes.voronoi(seeds, HOLED)
        took.append(time.process_time() - began)
        assert math.isclose(sum(map(shapes.area, got.values())), 11)
    assert took[1] < 25 * took[0]  # every seed against every other one: 64 times, and more
    crowd = [(rng.choice([1.0, rng.gauss(1, 1e-4), 2.0]), rng.choice([1.0, rng.gauss(1, 1e-4), 5.0])) for _ in range(300)]
    for p in crowd[:40]:
        assert list(shapes.Places(crowd).around(p)) == sorted((((u - p[0]) ** 2 + (v - p[1]) ** 2, u, v) for u, v in crowd if (u, v) != p))


def test_voronoi_in_parts():
    rng = random.Random(5)
    spread = [(k, rng.uniform(-9, 13), rng.uniform(-9, 12)) for k in range(2500)]
    crowd = [(k, rng.choice([rng.gauss(1, 1e-3), 1.0, rng.uniform(-9, 13)]), rng.choice([rng.gauss(1, 1e-3), 5e-7, rng.uniform(-9, 12)])) for k in range(1500)]
    for seeds in (spread, crowd, crowd[:2], [(k, x + 50, y) for k, x, y in crowd]):
        whole, first, sure = shapes.voronoi(seeds, HOLED), {}, {}
        for parts in (3, 16):
            each = [shapes.voronoi(seeds, HOLED, k, parts) for k in range(parts)]
            assert sum(map(len, each)) == len(whole) and {n: c for cells_ in each for n, c in cells_.items()} == whole
        for k, x, y in seeds:
            first.setdefault((round(x, 6), round(y, 6)), k)
        for (x, y), k in rng.sample(sorted(first.items()), min(len(first), 120)):
            sure[k] = HOLED
            for u, v in sorted(first, key=lambda p: ((p[0] - x) ** 2 + (p[1] - y) ** 2, p)):
                if (u, v) != (x, y) and sure[k]:
                    sure[k] = shapes.cut_shape(sure[k], 2 * (u - x), 2 * (v - y), u * u + v * v - x * x - y * y)
            assert math.isclose(shapes.area(sure[k]), shapes.area(whole.get(k, [])), abs_tol=1e-9)


@pytest.fixture(scope="module")
def offices(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("offices"))
    spark.range(60_000).select(F.col("id").alias("s_suppkey")).write.parquet(f"{folder}/supplier.parquet")
    return folder


def test_coverage_share_of_many_offices(spark, offices):
    began = time.time()
    got = {r["owner"]: r["share"] for r in q_geo.Q["coverage_share"](spark, offices).collect()}
    assert got == {"north": 1, "south": 1, "ring": 1, "pair": 0, "wide": 0} and time.time() - began < 60


def test_cells_of_many_offices_come_from_many_tasks(spark, offices):
    got = q_geo.Q["voronoi_cells"](spark, offices).select("*", F.spark_partition_id().alias("at")).groupBy("owner").agg(F.count("*").alias("n"), F.countDistinct("seed").alias("seeds"), F.countDistinct("at").alias("tasks"), F.sum("area").alias("area"))
    rows = {r["owner"]: r for r in got.collect()}
    assert sorted(rows) == ["north", "ring", "south"] and all(r["tasks"] > 1 and r["n"] == r["seeds"] for r in rows.values())
    assert all(math.isclose(rows[name]["area"], shapes.area(polys), abs_tol=2e-3) for _, name, polys in q_geo.SHAPES[:3])


def as_rows(shape):
    return [[[{"x": x, "y": y} for x, y in ring] for ring in rings] for rings in shape]


def test_cells_of_territories(spark):
    land = spark.createDataFrame([("a", as_rows(HOLED)), ("b", as_rows([[BOX]])), ("c", None)], f"owner string, polys {cells.SHAPE}")
    seeds = [("a", f"s{k}", 0.5 + k, 1.0 + k % 2) for k in range(4)] + [("b", "s0", 1.0, 1.0), ("b", "s1", 2.0, 2.0), ("a", "lost", None, 1.0)]
    got = cells.voronoi_cells(spark.createDataFrame(seeds, "owner string, seed string, lon double, lat double"), land)
    assert sorted((r["owner"], r["seed"]) for r in got.collect()) == [("a", f"s{k}") for k in range(4)]
    share = {r["owner"]: r["share"] for r in cells.coverage(got, land).collect()}
    assert math.isclose(share["a"], 1) and share["b"] == 0 and share["c"] is None
    one = land.where("owner <> 'c'").select("owner", cells.area(F.col("polys")).alias("n"), cells.area(cells.clipped(BOX[:3])(F.col("polys"))).alias("t"), cells.area(cells.without(BOX[:3])(F.col("polys"))).alias("u"), F.size(cells.simplify(0.1)(F.col("polys"))[0]).alias("r"))
    rows = {r["owner"]: r for r in one.collect()}
    assert (rows["a"]["n"], rows["b"]["n"], rows["b"]["t"], rows["a"]["r"]) == (11, 12, 6, 2) and math.isclose(rows["a"]["t"] + rows["a"]["u"], 11)


def test_cells_without_broadcast(spark):
    land = spark.createDataFrame([("a", as_rows(HOLED)), (None, as_rows([[BOX]])), ("b", as_rows([[BOX]]))], f"owner string, polys {cells.SHAPE}")
    rng = random.Random(6)
    seeds = [(o, f"s{k}", x, rng.uniform(0, 3)) for o in ("a", None, "x") for k, x in enumerate([*(rng.uniform(0, 4) for _ in range(30)), None, math.nan])] + [("b", "lost", math.nan, 1.0)] * 3
    own = spark.createDataFrame(seeds, "owner string, seed string, lon double, lat double")
    one, other = (sorted(cells.voronoi_cells(own, land, bound=b).collect(), key=str) for b in (1000, 10))
    assert one == other and [sum(r["owner"] == o for r in one) for o in ("a", None, "b", "x")] == [30, 30, 0, 0]
    assert cells.voronoi_cells(own.where("seed = 'lost'"), land).collect() == []


def lines(*widths):
    out = [0]
    for w in widths:
        out.append(out[-1] + w)
    return out


def test_hour_region():
    cols = lines(40, 300, 30, 31, 30, 29, 30, 30, 120)
    assert grids.hour_region(cols) == (1, [2, 3, 4, 5, 6, 7])
    assert grids.without_lead(lines(10, 90, 95, 30, 30, 30, 30, 30), [1, 2, 3, 4, 5, 6, 7]) == [3, 4, 5, 6, 7]
    assert grids.hour_region([5]) == (0, [])


def test_merged_columns_are_split_where_it_is_dark():
    cols = lines(40, 300, 30, 30, 60, 30, 30, 30)
    dark = [0.0] * (cols[-1] + 1)
    dark[cols[4] + 31] = 0.8
    got = grids.resolve(cols, dark)
    assert got.cols == sorted([*cols, cols[4] + 31]) and len(got.region) == 7 and got.problem is None
    dark[cols[4] + 31] = 0.3  # too faint without a recorded count
    assert grids.resolve(cols, dark).problem.startswith("merged") and grids.resolve(cols, dark, 7).problem is None
    assert grids.resolve(cols, dark, 3).region == grids.resolve(cols, dark).region[-3:]
    assert grids.resolve(cols, dark, None, [True, True, False, True, True, True]).problem is None
    assert grids.resolve([], []).problem == "no ruled grid"


def test_grids_of_sheets(spark):
    cols = lines(40, 300, 30, 30, 60, 30, 30, 30)
    rows = [("a", cols, [0.0] * 600, 7, None), ("b", cols, [0.0] * 600, None, [True, True, False, True, True, True]), ("c", [], [], None, None)]
    got = {r["doc_id"]: r for r in grids.resolved(spark.createDataFrame(rows, "doc_id string, cols array<int>, dark array<double>, target int, labelled array<boolean>")).collect()}
    assert len(got["a"]["region"]) == 7 and got["b"]["problem"] is None and got["c"]["problem"] == "no ruled grid"
    tries = [("a", 0, [0] * 5, [0] * 8), ("a", 1, [0] * 9, [0] * 12), ("a", 2, [0] * 20, [0] * 20), ("b", 0, [0] * 4, [0] * 50), ("b", 1, [0] * 6, [0] * 9), ("b", 2, [0] * 6, [0] * 9), ("c", 0, [0], [0])]
    best = {r["doc_id"]: r["ord"] for r in grids.best_sweep(spark.createDataFrame(tries, "doc_id string, ord int, rows array<int>, cols array<int>")).collect()}
    assert best == {"a": 1, "b": 1}


def test_headers(spark):
    bands = [("a", r, 10 if r == 2 else 30, c, 0.5 if c < n else 0.0) for r, n in ((0, 1), (1, 4), (2, 9), (3, 4)) for c in range(9)] + [("b", 0, 30, 0, 0.0)]
    got = {r["doc_id"]: (r["header_row"], r["inked"]) for r in grids.header_row(spark.createDataFrame(bands, "doc_id string, row int, height int, col int, dark double")).collect()}
    assert got == {"a": (1, 4), "b": (0, 0)}
    words = [("a", 0, 5.0, "09"), ("a", 1, 6.0, "00"), ("a", 2, 7.0, "10"), ("a", 3, 8.0, "00"), ("a", 4, 15.0, "11"), ("a", 5, 25.0, "7"), ("a", 6, 26.0, "15")]
    edges = [("a", k, 10.0 * k, 10.0 * k + 10) for k in range(3)]
    hours = grids.header_hours(spark.createDataFrame(words, "doc_id string, pos int, x double, text string"), spark.createDataFrame(edges, "doc_id string, col int, x0 double, x1 double"))
    assert [tuple(r) for r in hours.collect()] == [("a", 0, 9, 10)]
    cols = lines(200, 30, 31, 29, 30)
    assert grids.template_columns(cols, [(9, 10), (10, 11)], [False, True, False, True, False]) == [(1, 9, 10), (3, 10, 11)]
    assert grids.template_columns(cols, [(k, k + 1) for k in range(4)]) == [(k + 1, k, k + 1) for k in range(4)] and grids.template_columns(cols, [(1, 2)]) == []
    assert grids.hour_label("৯.০০-১০.০০") == (9, 10) and grids.hour_label("5 9") is None


def test_evicted_runs_go_home(spark):
    where = "doc_id string, page int, row int, col int"
    runs = spark.createDataFrame([("d", 0, 0, 5.0, 0.0, 60.0, "long area"), ("d", 0, 1, 5.0, 8.0, 14.0, "Kawlar"), ("d", 0, 2, 9.0, 5.0, 38.0, "other")], "doc_id string, page int, run int, top double, x0 double, x1 double, text string")
    boxes = [("d", 0, r, c, x0, x1) for r in (0, 1) for c, x0, x1 in ((0, 0.0, 20.0), (1, 20.0, 40.0), (2, 40.0, 60.0))]
    present = [("d", 0, 0, 0, 0), ("d", 0, 0, 0, 1), ("d", 0, 0, 1, 0), ("d", 0, 0, 2, 0), ("d", 0, 1, 0, 2), ("d", 0, 1, 1, 2), ("d", 0, 1, 1, 1)]
    box = spark.createDataFrame(boxes, f"{where}, c_x0 double, c_x1 double")
    held = spark.createDataFrame(present, f"{where}, run int")
    gone = sheets.evicted(runs, held.join(box, ["doc_id", "page", "row", "col"]))
    assert [tuple(r) for r in gone.select("row", "col", "run").collect()] == [(0, 0, 0)]
    assert [tuple(r) for r in sheets.rehomed(gone, runs, box, held).collect()] == [("d", 0, 0, 1, "long area")]
    taken = spark.createDataFrame([*present, ("d", 0, 0, 1, 2)], f"{where}, run int")
    assert sheets.rehomed(gone, runs, box, taken).count() == 0


def test_readings_of_an_injected_reader(spark):
    def reader(image, allow, page, lang):
        if image == b"bad":
            raise ValueError("torn")
        return f"{image.decode()}{lang}" if page == 7 else "x"

    img = spark.createDataFrame([("d", 0, 0, b"ok"), ("d", 1, 0, b"bad"), ("d", 2, 0, None)], "doc_id string, row int, col int, image binary")
    got = readings.read(img, reader, [("eng", "", 6), ("ben", "", 7)])
    rows = {(r["row"], r["mode"]): (r["text"], r["error"]) for r in got.collect()}
    assert rows[0, 1] == ("okben", None) and rows[1, 0] == ("", "ValueError: torn") and rows[2, 0] == ("x", None)
    assert {r["row"]: r["text"] for r in sheets.read_choice(got, ["doc_id", "row", "col"]).collect()} == {0: "okben", 1: "", 2: "ben"}


def test_layers(spark, tmp_path):
    def zones(s, zone):
        land = s.createDataFrame([(zone["utility"], as_rows([[BOX]]))], f"owner string, polys {cells.SHAPE}")
        seeds = s.createDataFrame([(zone["utility"], f"z{k}", 1.0 + k, 1.0 + k % 2) for k in range(3)], "owner string, seed string, lon double, lat double")
        return cells.voronoi_cells(seeds, land)

    def broken(s):
        raise RuntimeError("no source")

    own = layers.Layers()
    layers.zone_layers(own, [{"file": "north", "utility": "N", "color": "red"}, {"file": "south", "utility": "S", "color": "blue"}], zones)
    own.register("broken", broken)
    folder = str(tmp_path)
    assert own.build(spark, folder, ["north", "broken"]) == {"north": None, "broken": "no source"}
    assert not (tmp_path / "south.geojson").exists() and not list(tmp_path.glob("*.part"))
    got = json.loads((tmp_path / "north.geojson").read_text())
    assert [f["properties"]["name"] for f in got["features"]] == ["z0", "z1", "z2"] and all(f["properties"]["status"] == "estimated" and f["geometry"]["coordinates"][0][0] == f["geometry"]["coordinates"][0][-1] for f in got["features"])
    note = json.loads((tmp_path / "broken.geojson").read_text())
    assert note["features"] == [] and "no source" in note["note"]
    back = scans.read_geojson(spark, f"{folder}/north.geojson")
    assert back.count() == 3 and math.isclose(back.agg(F.sum(shapes_area(back))).first()[0], 12, abs_tol=1e-3)
    before = (tmp_path / "north.geojson").read_bytes()
    own.build(spark, folder, ["north"])
    assert (tmp_path / "north.geojson").read_bytes() == before
    with pytest.raises(KeyError):
        own.build(spark, folder, ["none"])


def shapes_area(df):
    # A closed ring's last point adds no area.
    return cells.area(F.col("polys"))


def test_registry_and_report(spark):
    zones = spark.createDataFrame([("b", "B", None, None, None), ("a", "A", 23.0, 90.0, "u")], "slug string, name string, lat double, lon double, pdf_url string")
    doc = json.loads(layers.zone_registry(zones, "U", "index").first()["document"])
    assert (doc["zone_count"], doc["with_live_pdf"], doc["with_point"]) == (2, 1, 1) and [z["slug"] for z in doc["zones"]] == ["a", "b"] and doc["zones"][1]["pdf_url"] is None
    rows = spark.createDataFrame([("Z", "link", None, 0), ("A", "feeder", 2, 5)], "utility string, level string, sources int, claims int")
    assert layers.coverage_document(rows).first()["report"] == codecs.coverage_report([("A", "feeder", 2, 5), ("Z", "link", None, 0)])


def test_build_id(spark):
    files = [("b.js", b"two"), ("a.html", b"one"), ("data/c.js", b"skip"), ("d.png", b"skip"), ("sub/e.css", b"three")]
    df = spark.createDataFrame(files, "path string, content binary")
    assert publish.build_id(df).first()["build"] == hashlib.sha256(b"onetwothree").hexdigest()[:12]


def test_tree_hash_is_order_free(spark):
    parts = [hashlib.sha256(str(k).encode()).hexdigest() for k in range(300)]
    rows = spark.createDataFrame([("g", p) for p in parts], "g string, part string")
    got = {publish.tree_hash(d, ["g"], "part").first()["hash"] for d in (rows, rows.orderBy(F.desc("part")).coalesce(1))}
    by: dict = {}
    for p in sorted(parts):
        by.setdefault(p[:3], []).append(p)
    inner = [f"{b}:{hashlib.sha256('|'.join(x).encode()).hexdigest()}" for b, x in sorted(by.items())]
    assert got == {hashlib.sha256("|".join(inner).encode()).hexdigest()}


@pytest.mark.parametrize("raw, want", [("w wK", " কিি"), ("w ", " ি"), ("†Kv", "ক\u09cb"), ("wK†K", "কিকে")])
def test_signs_wait_for_their_consonant(raw, want):
    assert codecs.bijoy(raw) == want


def test_replayed_batches_replace_their_part(spark):
    from voltlake.streaming import feeds

    t = feeds.Table(spark, "parts", "k long")
    for number, rows in ((0, 3), (1, 2), (1, 2)):
        t.write(spark.range(rows).withColumnRenamed("id", "k"), number)
    assert t.read().count() == 5 and t.read(1).count() == 3
    t.compacted(lambda df: df.distinct(), 1, 2)
    assert t.read().count() == 3
