"""Operators that SQL does not cover: the gate, sheets, sources, flows."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from voltlake.functions import codecs
from voltlake.operators import gate, lookups, sheets, spatial
from voltlake.plans import flows
from voltlake.sources import scans

CLAIM = "division string, division_canonical string, feeder string, feeder_id string, weekday int, load_mw double, windows array<struct<start:string,`end`:string>>"
DOC = f"doc_key string, schema string, utility string, effective_date string, badge string, had_content boolean, source struct<source_url:string,retrieved_at:string,sha256:string,parser_adapter:string>, parse_meta struct<hour_column_count:int>, claims array<struct<{CLAIM.replace(' string', ':string').replace(' int', ':int').replace(' double', ':double').replace(' array', ':array')}>>"


def claim(k=0, **over):
    c = {"division": "North", "division_canonical": "North", "feeder": f"F{k}", "feeder_id": f"a:north:f{k}", "weekday": None, "load_mw": 1.0, "windows": [("09:00", "10:00")]}
    return tuple((c | over).values())


def doc(spark, n=4, claims=None, **over):
    d = {"doc_key": "d", "schema": "schedule-claims/1", "utility": "A", "effective_date": "2024-05-02", "badge": "OFFICIAL", "had_content": True, "source": ("u", "2024-05-02T00:00:00Z", "0" * 64, "p"), "parse_meta": (24,), "claims": [claim(k) for k in range(n)] if claims is None else claims}
    return spark.createDataFrame([tuple((d | over).values())], DOC)


def judge(spark, df, **kw):
    found = gate.validate(df, **kw)
    return gate.verdict(found, df, "doc_key").first()["verdict"], {r["check"] for r in found.collect()}


def test_gate(spark):
    known = spark.createDataFrame([("A", "South")], "utility string, division string")
    none = known.where("false")
    previous = spark.createDataFrame([("A", "2024-05-03", 60)], "utility string, effective_date string, claim_count int")
    assert judge(spark, doc(spark)) == ("pass", set())
    assert judge(spark, doc(spark, claims=[])) == ("reject", {"empty-parse"})
    assert judge(spark, doc(spark, claims=[claim(windows=[("18:00", "09:00")])])) == ("reject", {"time-sanity"})
    assert judge(spark, doc(spark, claims=[claim(windows=[("23:00", "24:00")])])) == ("pass", set())
    assert judge(spark, doc(spark, parse_meta=(23,))) == ("reject", {"hour-columns"})
    assert judge(spark, doc(spark, utility="B", parse_meta=(12,))) == ("pass", set())
    assert judge(spark, doc(spark, utility="B", parse_meta=(25,)))[0] == "reject"
    assert judge(spark, doc(spark, source=("", "t", "h", "p"))) == ("reject", {"provenance"})
    assert judge(spark, doc(spark, claims=[claim(k, division_canonical=None if k == 0 else "North") for k in range(4)])) == ("quarantine", {"canonical-division"})
    assert judge(spark, doc(spark, claims=[claim(k, division_canonical=None if k < 2 else "North") for k in range(7)]))[0] == "reject"
    assert judge(spark, doc(spark, claims=[claim(1), claim(1)])) == ("quarantine", {"duplicates"})
    assert judge(spark, doc(spark), known=known) == ("quarantine", {"unknown-division"})
    assert judge(spark, doc(spark), known=none) == ("pass", set())
    assert judge(spark, doc(spark, n=20), previous=previous) == ("reject", {"date-regression", "volume-drop"})
    assert judge(spark, doc(spark, n=20, effective_date="2024-05-03"), previous=previous) == ("quarantine", {"volume-drop"})
    assert judge(spark, doc(spark, n=30, effective_date="2024-05-03"), previous=previous) == ("pass", set())
    assert judge(spark, doc(spark, claims=[claim(windows=None)])) == ("quarantine", {"empty-claims"})


def test_quarantine_policy(spark):
    df = doc(spark, claims=[claim(1), claim(1)])
    out, aside, _ = flows.gated(df)
    assert out.count() == 1 and aside.count() == 1
    assert flows.gated(df, "hold")[0].count() == 0


def test_claims_of_rows(spark):
    aliases = spark.createDataFrame([("Rupnagar", "Rupnagar", "canonical", None), ("rupnagor", "Rupnagar", "alias", None)], "key string, canonical string, kind string, reason string")
    hours = [""] * 24
    hours[14] = hours[15] = "x"
    hours[23] = "0"
    rows = spark.createDataFrame([("d", ["rupnagor", "Area 1", "Feeder 9", "1 . 8 5", ""] + hours), ("d", ["Division", "", "Feeder Name", "", ""] + hours), ("d", ["x", "", "F", "", ""] + [""] * 24)], "doc_id string, row array<string>")
    got = flows.claims(rows, aliases, "A").collect()
    assert len(got) == 1
    r = got[0]
    assert (r["division_canonical"], r["load_mw"], r["feeder_id"]) == ("Rupnagar", 1.85, "a:rupnagor:feeder-9")
    assert [tuple(w) for w in r["windows"]] == [(840, 960), (1380, 1440)]


def test_aliases(spark):
    aliases = spark.createDataFrame([("Tongi Central", "Tongi Central", "canonical", None)], "key string, canonical string, kind string, reason string")
    df = spark.createDataFrame([("TONGI  central",), ("Nowhere",)], "n string")
    got = {r["n"]: (r["canonical"], r["reason"]) for r in lookups.canonicalise(df, aliases, "n").collect()}
    assert got == {"TONGI  central": ("Tongi Central", None), "Nowhere": (None, "unrecognised")}


def cells(rows, langs=("ben", "eng")):
    out = []
    for r, row in enumerate(rows):
        for c, value in enumerate(row):
            for lang in langs:
                out.append(("d", r, c, lang, value))
    return out


def test_column_roles(spark):
    names = ["পূর্ব রামপুরা", "পশ্চিম মেরাদিয়া", "উত্তর গোড়ান"]
    rows = [["1", f"A{130 + k}E", n, "2.4", f"{n}, মালিবাগ, খিলগাঁও"] for k, n in enumerate(names)]
    df = spark.createDataFrame(cells(rows), "doc_id string, row int, col int, lang string, text string")
    widths = spark.createDataFrame([("d", k, w) for k, w in enumerate((108, 173, 306, 289, 626))], "doc_id string, col int, width_px int")
    got = {r["role"]: r["col"] for r in sheets.column_roles(df, widths, ["১১ কেভি"]).collect()}
    assert got == {"area": 4, "name": 2, "code": 1, "load": 3}
    same = [["ফতুল্লা", f"{n}, মালিবাগ"] for n in names]
    df = spark.createDataFrame(cells(same), "doc_id string, row int, col int, lang string, text string")
    assert {r["role"]: r["col"] for r in sheets.column_roles(df, widths, ["১১ কেভি"]).collect()} == {"area": 1}


def test_glyph_runs(spark):
    rows, gi = [], 0
    for x, word in ((10.0, "AB"), (30.0, "CD")):
        for k, c in enumerate(word):
            rows.append(("d", 1, gi, c, x + 4 * k, x + 4 * k + 4, 50.0, 58.0, 8.0))
            gi += 1
    df = spark.createDataFrame(rows, "doc_id string, page int, gi int, text string, x0 double, x1 double, top double, bottom double, size double")
    assert sorted(r["text"] for r in sheets.runs(df).collect()) == ["AB", "CD"]


def test_overprint(spark):
    runs = spark.createDataFrame([("d", 1, 0, 50.0, 10.0, 28.0), ("d", 1, 1, 50.0, 20.0, 60.0)], "doc_id string, page int, run int, top double, x0 double, x1 double")
    present = spark.createDataFrame([("d", 1, 0, 0, k, 8.0, 30.0) for k in (0, 1)], "doc_id string, page int, row int, col int, run int, c_x0 double, c_x1 double")
    assert [r["run"] for r in sheets.evicted(runs, present).collect()] == [1]


def test_axis_operators(spark):
    profile = spark.createDataFrame([("d", "x", p, 9.0, 500) for p in (10, 11, 12, 50, 52, 90)], "doc_id string, axis string, pos int, value double, span int")
    assert sorted(r["px"] for r in sheets.peaks(profile, 5.0).collect()) == [11, 51, 90]
    edges = spark.createDataFrame([("d", k, p) for k, p in enumerate((0, 10, 20, 30, 50))], "doc_id string, idx int, px int")
    assert [r["px"] for r in sheets.trim_edges(edges).orderBy("idx").collect()] == [0, 10, 20, 30]
    assert sheets.merged_columns(edges).first()["refused"]


def test_shading(spark):
    flat = spark.createDataFrame([("a", float(v)) for v in (200, 201, 202)] + [("b", float(v)) for v in (20, 22, 200, 210)], "sheet string, mean double")
    assert {(r["sheet"], r["mean"]) for r in sheets.shaded(flat, ["sheet"], "mean").collect()} == {("b", 20.0), ("b", 22.0)}


def test_geojson(spark, tmp_path):
    square = [[[0, 0], [2, 0], [2, 2], [0, 2]]]
    layer = {"features": [{"properties": {"name": "p"}, "geometry": {"type": "Polygon", "coordinates": square}}, {"properties": {"name": "m"}, "geometry": {"type": "MultiPolygon", "coordinates": [square]}}, {"properties": {"name": "o"}, "geometry": {"type": "Point", "coordinates": [1, 2]}}]}
    (tmp_path / "l.json").write_text(json.dumps(layer))
    got = scans.read_geojson(spark, str(tmp_path / "l.json")).orderBy("ord").collect()
    assert [len(r["polys"] or []) for r in got] == [1, 1, 0] and got[2]["pt"]["y"] == 2.0
    feats = scans.read_geojson(spark, str(tmp_path / "l.json")).where("polys is not null").select("ord", F.col("props")["name"].alias("name"), "polys")
    points = spark.createDataFrame([(1, 1.0, 1.0), (2, 3.0, 3.0)], "id int, lon double, lat double")
    assert {(r["id"], r["name"]) for r in spatial.first_containing(points, feats, "id", "name").select("id", "name").collect()} == {(1, "p"), (2, None)}


def test_missing_and_malformed_json(spark, tmp_path):
    assert scans.read_json(spark, str(tmp_path / "none.json"), "a int").count() == 0
    (tmp_path / "bad.json").write_text("{not json")
    assert scans.read_json(spark, str(tmp_path / "bad.json"), "a int").first()["_corrupt_record"]


def test_newest_file(spark):
    df = spark.createDataFrame([("A", "x/2024-05-01-ff.pdf", 9), ("A", "x/2024-05-02-aa.pdf", 1), ("A", "x/2024-05-02-00.pdf", 2)], "utility string, path string, mtime long")
    assert scans.newest_file(df).first()["path"] == "x/2024-05-02-00.pdf"


def test_adapter_isolates_failures(spark):
    def parse(path, content):
        if content == b"bad":
            raise ValueError("no table")
        return pd.DataFrame({"row": [0], "text": [content.decode()]})

    a = flows.register(flows.Adapter("plain", "1", "row int, text string", parse))
    files = spark.createDataFrame([("p1", bytearray(b"ok")), ("p2", bytearray(b"bad"))], "path string, content binary")
    got = {r["path"]: (r["text"], r["error"]) for r in a.cells(files).collect()}
    assert got == {"p1": ("ok", None), "p2": (None, "ValueError: no table")}
    assert flows.adapter_of("plain") is a and flows.adapter_of("unknown") is None


def test_prefer(spark):
    a = spark.createDataFrame([("d1", "a")], "doc string, v string")
    b = spark.createDataFrame([("d1", "b"), ("d2", "b")], "doc string, v string")
    assert {(r["doc"], r["v"]) for r in flows.prefer([a, b], "doc").collect()} == {("d1", "a"), ("d2", "b")}


def test_calendar(spark):
    w = F.array(F.struct(F.lit(1380).alias("start_min"), F.lit(1440).alias("end_min")))
    t = spark.range(1).select(codecs.calendar(F.lit("2024-05-02"), w, F.lit("Feeder 1"), F.lit("U"), F.lit("http://x"), "S").alias("t")).first()["t"]
    assert "DTSTART:20240502T170000Z\r\nDTEND:20240502T180000Z" in t and t.startswith("BEGIN:VCALENDAR\r\n") and t.endswith("END:VCALENDAR")
    assert "TRIGGER:-PT15M" in t


def test_cell_area(spark):
    square = [[[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]]]
    half = [[[(0.5, 0.0), (1.5, 0.0), (1.5, 1.0), (0.5, 1.0)]]]
    df = spark.createDataFrame([("a", square), ("a", half)], "owner string, polys array<array<array<struct<x:double,y:double>>>>")
    r = spatial.cell_area(df, "owner", 0.1).first()
    assert (r["cells"], r["total"]) == (150, 200)


def test_within_equals_brute_force(spark):
    from voltlake.functions import geo

    p = spark.range(60).select("id", (F.lit(90.0) + (F.col("id") * 37 % 100) / 100).alias("lon"), (F.lit(23.0) + (F.col("id") * 53 % 100) / 100).alias("lat"))
    q = p.select(F.col("id").alias("place_id"), (F.col("lon") + 0.01).alias("lon"), F.col("lat"))
    got = {(r["id"], r["place_id"]) for r in spatial.within(p, q, 12.0).collect()}
    q2 = q.withColumnsRenamed({"lon": "x", "lat": "y"})
    want = {(r["id"], r["place_id"]) for r in p.crossJoin(q2).where(geo.haversine_km(F.col("lat"), F.col("lon"), F.col("y"), F.col("x")) <= 12.0).collect()}
    assert got == want and len(got) > 60


def test_late_versions_are_refused(spark, tmp_path):
    from voltlake.streaming import feeds

    schema = "utility string, effective_date string, doc string"
    for k, row in enumerate([("A", "2024-05-02", "new"), ("A", "2024-05-01", "late")]):
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    state = feeds.Table(spark, "t", schema)
    stream = feeds.files(spark, str(tmp_path / "in"), schema)
    assert [r["doc"] for r in feeds.newest_versions(stream, state, "utility", ["effective_date"]).collect()] == ["new"]


@pytest.mark.parametrize("edge", [(88.0, 92.0, 20.5, 26.7), (-180.0, 180.0, -89.9, 89.9)])
def test_nearest_of_many_places(spark, edge):
    w, e, s, n = edge
    at = lambda seed: ((F.rand(seed) * (e - w) + w).alias("lon"), (F.rand(seed + 1) * (n - s) + s).alias("lat"))
    p = spark.range(60).select("id", *at(1)).cache()
    q = spark.range(300).select(F.col("id").alias("place_id"), *at(5)).cache()
    q = q.union(q.limit(5).select(F.col("place_id") + 1000, "lon", "lat")).cache()
    rows = lambda d: sorted((r["id"], r["rank"], r["place_id"], round(r["km"], 6)) for r in d.collect())
    want = rows(spatial.nearest(p, q, 4))
    assert len(want) == 240 and rows(spatial.nearest_any(p, q, 4, bound=10)) == want


def test_refused_sizes(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0)], "id int, lon double, lat double")
    many = spark.range(30).select(F.col("id").alias("place_id"), F.lit(0.0).alias("lon"), F.lit(0.0).alias("lat"))
    with pytest.raises(ValueError):
        spatial.nearest(p, many, 1, bound=10)
