import json
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from chronogeo.functions import colors, geo, style, text
from chronogeo.operators import derive, overlay, points, shapes, temporal
from chronogeo.plans import queries as engine
from chronogeo.sources import readers, writers

SF = "/root/testdata/sf0.001"


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("lat,y", [(0, 0), (45, 49.29125493511359), (-45, -49.29125493511359), (85, 175.11957980289137), (-85, -175.11957980289137), (90, 180), (-90, -180), (100, 180), (-100, -180)])
def test_projection_goldens(spark, lat, y):
    assert value(spark, geo.mercator(F.lit(float(lat)))) == pytest.approx(y, abs=1e-8)


@pytest.mark.parametrize("lat", [-90, -85, -3, 0, 10, 35.213, 85, 89.99999, 90])
def test_projection_round_trip(spark, lat):
    assert value(spark, geo.inverse_mercator(geo.mercator(F.lit(float(lat))))) == pytest.approx(lat, abs=1e-8)


def test_touching_ranges_do_not_meet(spark):
    lit = lambda x: F.lit(x).cast("int")
    meet = lambda a, b, c, d: value(spark, temporal.intersects(lit(a), lit(b), lit(c), lit(d)))
    assert not meet(4, 5, 5, 6) and meet(4, 5, 4, 6) and meet(None, None, 4, 5) and not meet(5, 5, 4, 6) and not meet(None, 4, 4, None)


def test_ranges_coalesce(spark):
    rows = spark.createDataFrame([("a", None, None), ("a", 4, 5), ("b", 1, 2), ("b", 2, 3), ("b", 5, 6), ("c", 3, 3)], "k string, time_start int, time_end int")
    assert sorted(temporal.coalesce_time(rows, ["k"]).collect(), key=str) == sorted([("a", None, None), ("b", 1, 3), ("b", 5, 6)], key=str)


def test_slice_then_merge_is_identity(spark):
    rng = random.Random(5)
    rows = spark.createDataFrame([(i, rng.choice([None, s]), rng.choice([None, s + rng.randint(1, 9)])) for i in range(60) for s in [rng.randint(0, 30)]], "fid int, time_start int, time_end int")
    axis = temporal.slices(temporal.barriers(rows))
    assert sorted(temporal.merge_layer(temporal.slice_layer(rows, axis)).collect(), key=str) == sorted(rows.collect(), key=str)


def test_empty_layers(spark):
    none = spark.createDataFrame([], "fid int, time_start int, time_end int")
    assert temporal.slices(temporal.barriers(none)).collect() == [(None, None)]
    assert temporal.coalesce_time(none, ["fid"]).count() == 0


def test_one_slice_is_an_error(spark):
    rows = spark.createDataFrame([(1, None, None)], "fid int, time_start int, time_end int")
    with pytest.raises(Exception, match="at most one time slice"):
        temporal.collect_time_meta(rows).collect()


@pytest.mark.parametrize("t", ["", "abc", "Käse", "€uro", "a\U0001F600b", "polygenelubricants"])
def test_string_hash(spark, t):
    units = t.encode("utf-16-be")
    h = 0
    for i in range(0, len(units), 2):
        h = (h * 31 + int.from_bytes(units[i : i + 2], "big")) & 0xFFFFFFFF
    assert value(spark, text.string_hash(F.lit(t))) == (h - (1 << 32) if h >> 31 else h)


def test_colors(spark):
    assert value(spark, colors.hex_text(colors.rgba(119, 136, 153))) == "#789"
    assert value(spark, colors.hex_text(colors.rgba(255, 255, 255, 191))) == "#ffffffbf"
    assert value(spark, colors.parse_hex(F.lit("#7894")))["a"] == 0x44
    for rgb in [(255, 0, 0), (12, 200, 99), (138, 180, 248), (0, 0, 0), (255, 255, 255)]:
        assert colors.from_hsluv(*colors.to_hsluv(*rgb)) == rgb
    dark = value(spark, colors.with_lightness(F.lit("#8ab4f8"), lightness=0.15))
    assert colors.to_hsluv(*(int(dark[i : i + 2], 16) for i in (1, 3, 5)))[2] == pytest.approx(15, abs=0.6)
    with pytest.raises(Exception, match="no colour"):
        value(spark, colors.layer_color(F.lit("nowhere")))


def test_style_errors_and_absence(spark):
    s = style.Style({"a": F.lit(None).cast("int")}, zoom=3, state={"on": True})
    assert value(spark, s.compile(["all", ["!", ["has", "a"]], ["!", ["has", "b"]], ["global-state", "on"]]))
    assert not value(spark, s.compile(["<", ["get", "a"], 5]))
    assert value(spark, s.compile(["case", [">", ["zoom"], 2], "near", "far"])) == "near"
    with pytest.raises(style.StyleError):
        s.compile(["nope", 1])


def test_labels(spark):
    nested = json.dumps([["x", {"label": "y", "id": "i"}], "z", 5])
    rows = spark.createDataFrame([(1, nested), (2, " "), (3, None), (4, "[broken"), (5, '"quoted"')], "fid int, labels string")
    out = derive.resolve_labels(rows).select("fid", "label.label", "label.id").collect()
    assert sorted(out, key=str) == sorted([(1, "x", None), (1, "y", "i"), (1, "z", None), (1, "5", None), (2, None, None), (3, None, None), (4, "[broken", None), (5, "quoted", None)], key=str)


def test_excerpt(spark):
    html = '<div>no</div><p>One <a class="new" href="/x">two</a> <a title="t" href="/y">three</a></p><table><tr><td>gone</td></tr></table><h2>Rest</h2><p>four</p>'
    e = value(spark, text.article_excerpt(F.lit(html)))
    assert e["excerpt"] == '<p>One two <a href="https://example.org/y">three</a></p>' and e["length"] == len("Onetwothree") + len("Restfour")
    assert value(spark, text.article_excerpt(F.lit("")))["excerpt"] is None


def star(rng, n, cx, cy):
    ring = []
    for i in range(n):
        r, a = rng.uniform(1, 4), 2 * math.pi * i / n
        ring.append((cx + math.cos(a) * r, cy + math.sin(a) * r))
    return [[[*ring, ring[0]]]]


def test_overlay_areas_add_up():
    rng = random.Random(1)
    for _ in range(60):
        a, b = star(rng, rng.randint(3, 20), 0, 0), star(rng, rng.randint(3, 20), rng.uniform(-3, 3), rng.uniform(-3, 3))
        both, left, right, whole = (overlay.area(f) for f in (overlay.intersection(a, b), overlay.difference(a, b), overlay.difference(b, a), overlay.union([a, b])))
        assert both + left == pytest.approx(overlay.area(a), abs=1e-5)
        assert both + left + right == pytest.approx(whole, abs=1e-5)
        assert sum(overlay.area(c) for _, c in overlay.Arrangement([a, b]).cells()) == pytest.approx(whole, abs=1e-5)
        assert overlay.area(overlay.union([overlay.union([a, b])])) == pytest.approx(whole, abs=1e-5)


def test_overlay_agrees_with_a_geometry_library(spark):
    jvm = spark.sparkContext._jvm
    reader = jvm.org.locationtech.jts.io.WKTReader()
    wkt = lambda g: "MULTIPOLYGON(" + ",".join("(" + ",".join("(" + ",".join(f"{x} {y}" for x, y in r) + ")" for r in p) + ")" for p in g) + ")"
    rng = random.Random(4)
    for _ in range(10):
        a, b = star(rng, 9, 0, 0), star(rng, 12, 1, 1)
        ja, jb = reader.read(wkt(a)), reader.read(wkt(b))
        assert overlay.area(overlay.intersection(a, b)) == pytest.approx(ja.intersection(jb).getArea(), abs=1e-5)
        assert overlay.area(overlay.difference(a, b)) == pytest.approx(ja.difference(jb).getArea(), abs=1e-5)


def test_shapes():
    square = [[[[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [0.0, 4.0], [0.0, 0.0]]]]
    assert overlay.area(overlay.buffer(square, 1, 20)) == pytest.approx(32 + math.pi, abs=0.02)
    assert overlay.area(overlay.buffer(square, -1)) == pytest.approx(4)
    assert shapes.inner_point(square) == pytest.approx((2, 2), abs=0.1)
    assert shapes.oriented_box([[[[0.0, 0.0], [4.0, 0.0], [4.0, 1.0], [0.0, 1.0], [0.0, 0.0]]]]) == pytest.approx((1, 4, 90))
    a, b = [0.0, 0.0], [1.0, 0.5]
    there, back = shapes.detailed_edges(np.array([a, b]), np.array([b, a]), 0.1)
    assert len(there) == 17 and there.tolist() == back[::-1].tolist()
    assert len(shapes.cut_corners(square[0][0], 1)) == 9
    line = shapes.smooth_line([[0.0, 0.0], [1.0, 1.0], [2.0, 0.0]])
    assert len(line) > 8 and line[0] == pytest.approx([0, 0]) and line[-1] == pytest.approx([2, 0])
    assert shapes.dots(square, 5, "k") == shapes.dots(square, 5, "k") and len(shapes.dots(square, 5, "k")) == 5


def test_geojson_round_trip(spark, tmp_path):
    text_in = '{"type":"FeatureCollection","features":[{"type":"Feature","id":7,"properties":{"label":"A","timeStart":5},"geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]}},{"type":"Feature","properties":{"label":"B"},"geometry":null},{"type":"Feature","properties":{},"geometry":{"type":"Point","coordinates":[1,2,3]}}]}'
    (tmp_path / "a.geojson").write_text(text_in)
    rows = readers.read_geojson(spark, str(tmp_path / "a.geojson"), "label string, timeStart int")
    got = rows.orderBy("label").collect()
    assert [r["label"] for r in got] == [None, "A", "B"] and got[1]["fid"] == 7 and got[1]["timeStart"] == 5 and got[2]["geom"] is None
    assert got[0]["geom"]["coords"][0][0][0][:2] == [1.0, 2.0]
    out = [json.loads(r["value"]) for r in writers.geojson_features(rows.drop("extra")).collect()]
    first = next(f for f in out if f["properties"].get("label") == "A")
    assert first["properties"] == {"label": "A", "timeStart": 5} and first["geometry"]["coordinates"] == [[[0, 0], [1, 0], [1, 1], [0, 0]]]
    with pytest.raises(ValueError):
        readers.read_layer(spark)


def test_paged_source(spark, tmp_path):
    spark.dataSource.register(readers.PagedJson)
    result = {"query": {"results": [{"Some Page#sub": {"printouts": {"Has coordinates": ['{"lat":1.23456789,"lon":-170.5}'], "Has population": ["6000"], "Is capital": ["t"], "Modification date": ['{"timestamp":"86400"}']}}}]}}
    (tmp_path / "0.json").write_text(json.dumps(result))
    (tmp_path / "50.json").write_text(json.dumps({"query": {"results": []}}))
    pages = spark.read.format("paged_json").option("folder", str(tmp_path)).option("pages", "3").load()
    r = readers.query_rows(pages).first()
    assert (r["page"], r["name"], r["lng"], r["lat"], r["size"], r["capital"]) == ("Some Page", "sub", 189.5, 1.234568, 1, True)


def test_paged_source_is_read_to_its_end(spark, tmp_path):
    spark.dataSource.register(readers.PagedJson)
    page = lambda n: json.dumps({"query": {"results": [{f"P{i}": {"printouts": {}}} for i in range(n)]}})
    for offset, n in ((0, 50), (50, 50), (100, 50), (150, 7)):
        (tmp_path / f"{offset}.json").write_text(page(n))
    offsets = lambda reader: [r["offset"] for r in reader.load().orderBy("offset").collect()]
    saved = lambda: spark.read.format("paged_json").option("folder", str(tmp_path))
    assert offsets(saved()) == offsets(saved().option("pages", "2")) == [0, 50, 100, 150]
    url = lambda: spark.read.format("paged_json").option("url", f"file://{tmp_path}/{{offset}}.json")
    assert offsets(url()) == offsets(url().option("pages", "2")) == [0, 50, 100, 150]
    (tmp_path / "150.json").unlink()  # the page before is full
    with pytest.raises(Exception, match="missing"):
        offsets(saved())
    (tmp_path / "150.json").write_text(page(7))
    (tmp_path / "50.json").unlink()
    with pytest.raises(Exception, match="missing"):
        offsets(saved())


def test_writers(spark, tmp_path):
    texts = spark.createDataFrame([(11, 1, "x"), (12, 2, "y")], "id bigint, bucket int, html string")
    writers.write_texts(texts, str(tmp_path / "t"))
    assert spark.read.json(str(tmp_path / "t")).filter("bucket = 1").first()["html"] == "x"
    layer = spark.createDataFrame([("L", ("Point", [[[[1.0, 2.0]]]])), ("K", ("Point", [[[[3.0, 2.0]]]]))], "label string, geom struct<type:string,coords:array<array<array<array<double>>>>>")
    assert [r[0] for r in writers.write_per_label(layer, str(tmp_path / "l")).collect()] == ["K", "L"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in engine.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows):
    return sorted(tuple("None" if v is None else (repr(round(v, 9) + 0.0) if isinstance(v, float) else str(v)) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(engine.ORACLE))
def test_against_sql(spark, duck, name):
    got = engine.QUERIES[name](spark, SF)
    want = duck.sql(engine.ORACLE[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got.select(*want.columns).collect()) == plain(want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert engine.QUERIES["location_groups"](spark, SF).count() > 0
    assert engine.QUERIES["location_texts"](spark, SF).filter("bucket <> id % 10").count() == 0


def test_geometry_column_is_decoded(spark):
    import struct

    head = lambda flags=1: b"GP\x00" + bytes([flags]) + struct.pack("<i", 4326)
    point = b"\x01" + struct.pack("<I2d", 1, 3.0, 4.0)
    line = b"\x00" + struct.pack(">II6d", 1002, 2, 0.0, 0.0, 9.0, 1.0, 2.0, 9.0)
    ring = struct.pack("<I8d", 4, 0, 0, 1, 0, 1, 1, 0, 0)
    multi = b"\x01" + struct.pack("<II", 6, 1) + b"\x01" + struct.pack("<II", 3, 1) + ring
    blobs = [None, head(0x11), head() + point, head(0x03) + struct.pack("<4d", 0, 1, 0, 2) + line, head() + multi]
    rows = spark.createDataFrame([(i, None if b is None else bytearray(b)) for i, b in enumerate(blobs)], "i int, geom binary")
    got = [r["g"] and (r["g"]["type"], r["g"]["coords"]) for r in rows.select("i", readers.geometry_column(F.col("geom")).alias("g")).orderBy("i").collect()]
    assert got == [None, None, ("Point", [[[[3.0, 4.0]]]]), ("LineString", [[[[0.0, 0.0], [1.0, 2.0]]]]), ("MultiPolygon", [[[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 0.0]]]])]


def test_clashing_texts_move_to_free_ids(spark):
    # "Aa" and "BB" hash alike, and so do texts that hold them.
    rows = [(x, None, None) for x in ("Aa", "BB", "AaAa", "BBBB", "AaBB", "BBAa", "plain")]
    layer = spark.createDataFrame(rows, "label string, link string, text string")
    got = {r["html"]: r["id"] for r in derive.location_texts(layer).collect()}
    own = {r["html"]: r["h"] for r in spark.createDataFrame([(k,) for k in got], "html string").withColumn("h", F.abs(text.string_hash(F.col("html")))).collect()}
    assert len(got) == 7 == len(set(got.values()))
    for alike in (("Aa", "BB"), ("AaAa", "AaBB", "BBAa", "BBBB")):
        assert [got[f"<h3>{x}</h3>"] - own[f"<h3>{x}</h3>"] for x in alike] == list(range(len(alike)))


def test_options_are_whole(spark):
    from chronogeo.functions import options

    one = lambda t: value(spark, options.parse_options(F.lit(t), {"a": "x", "ab": "y"})["a"])
    assert [one(t) for t in (None, "", "#", "#a=1", "#ab=2", "a=%C3%A9+b", "#a", "#a=1&a=2&b=3", "#a=b=c")] == ["x", "x", "x", "1", "x", "é b", "", "2", "b=c"]
    assert value(spark, options.fly_to(F.lit("1/2/x"))) is None and value(spark, options.bbox_numbers(F.lit("1,2,3"))) is None


def test_measured_lines_follow_great_circles():
    points = [(0.0, 50.0), *shapes.great_circle((0.0, 50.0), (90.0, 50.0)), (90.0, 50.0)]
    assert len(points) > 10 and max(y for _, y in points) > 58
    for x, y in points:
        v = (math.cos(math.radians(y)) * math.cos(math.radians(x)), math.cos(math.radians(y)) * math.sin(math.radians(x)), math.sin(math.radians(y)))
        u = (math.cos(math.radians(50)), 0.0, math.sin(math.radians(50)))
        w = (0.0, math.cos(math.radians(50)), math.sin(math.radians(50)))
        n = (u[1] * w[2] - u[2] * w[1], u[2] * w[0] - u[0] * w[2], u[0] * w[1] - u[1] * w[0])
        assert abs(sum(a * b for a, b in zip(v, n))) < 1e-9
    assert shapes.great_circle((0.0, 0.0), (10.0, 0.0)) == []


@pytest.mark.parametrize("seed,cells", [(0, 1), (1, 4), (2, 64)])
def test_groups_by_tiles_equal_the_greedy_kernel(spark, seed, cells):
    rng = random.Random(seed)
    rows = [(i, rng.uniform(-170, 170) if i % 3 else 5 + rng.random(), rng.uniform(-60, 60) if i % 3 else 8 + rng.random(), float(rng.randint(0, 5)), rng.choice([None, 0, 2]), rng.choice([None, 3])) for i in range(150)]
    rows += [(1000 + i, rows[i % 9][1], rows[i % 9][2], float(i % 4), None, None) for i in range(40)]  # many at one place
    layer = spark.createDataFrame(rows + rows[:3], "fid bigint, lng double, lat double, weight double, minzoom int, maxzoom int").withColumn("slice_start", F.when(F.col("fid") % 2 == 1, 7))
    groups, members = points.location_groups(layer, 3, ("slice_start",), cells)
    got = {(r.slice_start, r.zoom, r.best, r.fid) for r in members.collect()}
    half = 50 / math.pi
    want = set()
    for slice_start in (None, 7):
        own = sorted((r for r in rows if (r[0] % 2 == 1) == (slice_start == 7)), key=lambda r: (-r[3], r[0]))
        xs, ys = [half * (math.radians(r[1]) + math.pi) for r in own], [half * (math.pi - math.log(math.tan(math.radians(r[2]) / 2 + math.pi / 4))) for r in own]
        for zoom in range(5):
            found = points.group_at_zoom([r[0] for r in own], xs, ys, [None] * len(own), [r[5] for r in own], 2 / 2**zoom, zoom)
            want |= {(slice_start, zoom, g, m) for g, members in found for m in members}
    assert got == want and groups.count() > 0
    assert points.location_groups(layer.limit(0), 3, ("slice_start",), cells)[0].count() == 0


def test_falling_ranks_take_few_rounds(spark, monkeypatch):
    rows = [(i, -170 + i * 0.5, 0.0, float(-i), None, None) for i in range(680)]
    layer = spark.createDataFrame(rows, "fid bigint, lng double, lat double, weight double, minzoom int, maxzoom int")
    rounds = []
    monkeypatch.setattr(points, "durable_table", lambda df, f=points.durable_table: rounds.append(1) or f(df))
    members = points.location_groups(layer, 3, (), 2)[1]
    assert members.filter("zoom = 4").count() == 680 and len(rounds) - 5 <= 6  # the greatest tiles hold the whole map
