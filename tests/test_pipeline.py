import json
import math
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from chronogeo.operators import lines, overlay, shapes
from chronogeo.plans import pipeline
from chronogeo.plans.steps import STEPS, Context, run_step


def box(x, y, w, h):
    return [[[[float(a), float(b)] for a, b in ((x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y))]]]


GEOM = overlay.GEOM


@pytest.fixture(scope="module")
def ctx(spark):
    land = spark.createDataFrame([("Land A", box(0, 0, 10, 10), None, None), ("Land B", box(20, 0, 6, 6), 100, None)], f"labels string, coords {GEOM}, time_start int, time_end int")
    waters = spark.createDataFrame([("Lake", box(4, 4, 2, 2))], f"labels string, coords {GEOM}")
    borders = spark.createDataFrame(
        [("N1", "S1", "R1", "P1", box(0, 0, 5, 5)), ("N1", "", "R1", "P2", box(5, 0, 5, 5)), ("N2", "", "R2", "P3", box(0, 5, 10, 5))],
        f"nation string, subregion string, region string, province string, coords {GEOM}",
    )
    rivers = spark.createDataFrame([("River", [[[[0.5, 0.5], [2.0, 2.0], [3.0, 2.0], [4.5, 4.5]]]], 2000)], f"labels string, coords {GEOM}, width int")
    cities = spark.createDataFrame([("C1", [[[[1.0, 1.0]]]], True, 0, 300, "a"), ("C2", [[[[1.01, 1.0]]]], False, 2, 100, "b"), ("C3", [[[[8.0, 8.0]]]], False, None, 200, None)], f"labels string, coords {GEOM}, capital boolean, size int, article_length int, text string")
    buildings = spark.createDataFrame([("Keep", box(1, 1, 0.2, 0.2), "fortification")], f"labels string, coords {GEOM}, type string")
    return Context(spark, {"land": land, "waters": waters, "borders": borders, "rivers": rivers, "roads": rivers, "cities": cities, "buildings": buildings}, max_zoom=4)


TEXT = """
- name: land
  steps:
    - step: READ_FILE
      layer: land
    - step: ADD_FRACTAL_DETAIL
- name: land_without_water
  steps:
    - step: SUBTRACT
      dependsOn: {in: land.READ_FILE, subtrahend: waters}
- name: waters
  steps:
    - step: READ_FILE
      layer: waters
- name: borders-raw
  steps:
    - step: READ_FILE
      layer: borders
- name: nation-borders
  steps:
    - step: BORDER_VARIANTS__NATION_BORDERS
      dependsOn: {in: borders-raw, land_without_water: land_without_water}
- name: province-borders
  steps:
    - step: BORDER_VARIANTS__PROVINCE_BORDERS
      dependsOn: {in: borders-raw, land_without_water: land_without_water}
- name: borders
  steps:
    - step: MERGE_BORDERS
      dependsOn: {nation: nation-borders, province: province-borders}
    - step: SMOOTH_LINES
- name: time-meta
  steps:
    - step: TIME_META_COLLECT
      dependsOn: {borders: borders.MERGE_BORDERS, land: land.READ_FILE}
- name: labels
  steps:
    - step: RESOLVE_LABELS
      dependsOn: {in: land.READ_FILE}
    - step: GENERATE_LABEL_CENTERS
    - step: PREPARE_EXPORT
      dependsOn: {time-meta: time-meta}
- name: rivers
  steps:
    - step: READ_FILE
      layer: rivers
    - step: SMOOTH_LINES
    - step: SHAPE_RIVERS
      dependsOn: {land_without_water: land_without_water}
- name: geometry
  steps:
    - step: MERGE_GEOMETRY
      dependsOn: {land: land.READ_FILE, waters: waters, rivers: rivers, buildings: buildings}
- name: buildings
  steps:
    - step: READ_FILE
      layer: buildings
    - step: COLOR_BUILDINGS
- name: locations
  steps:
    - step: READ_FILE
      layer: cities
    - step: ADD_CITY_ZOOM
      dependsOn: {in: named}
    - step: CITY_TYPE_TO_ICON
    - step: LOCATION_GROUP
    - step: LOCATION_SCALE
- name: named
  steps:
    - step: RESOLVE_LABELS
      dependsOn: {in: locations.READ_FILE}
- name: search-index
  steps:
    - step: CREATE_SEARCH_INDEX
      dependsOn: {time-meta: time-meta, locations: named}
- name: highlights
  steps:
    - step: HIGHLIGHTS
      dependsOn: {land: labels.RESOLVE_LABELS}
- name: tiles
  steps:
    - step: COMPILE_TILES
      dependsOn: {time-meta: time-meta, labels: labels, geometry: geometry}
"""


@pytest.fixture(scope="module")
def done(ctx):
    return pipeline.run(ctx, TEXT)


def area(df):
    return sum(overlay.area(r["coords"]) for r in df.collect())


def test_subtract_keeps_area_and_time(done):
    rows = done["land_without_water.SUBTRACT"]
    assert {(r["time_start"], r["time_end"]) for r in rows.collect()} == {(None, None), (100, None)}
    assert area(rows.filter("time_start IS NULL")) == pytest.approx(96)
    assert area(rows.filter("time_start = 100")) == pytest.approx(36)


def test_borders(done):
    rows = done["borders.MERGE_BORDERS"].collect()
    assert {r["border_type"] for r in rows} == {3, 4}
    # N1 and N2 meet along y = 5, outside of the lake; provinces of N1 meet along x = 5.
    provinces = [r for r in rows if r["border_type"] == 4]
    assert all(p[0] == 5.0 for r in provinces for part in r["coords"] for ring in part for p in ring)


def test_label_centers_lie_inside(done, ctx):
    rows = done["labels.GENERATE_LABEL_CENTERS"].collect()
    assert {r["label"] for r in rows} == {"Land A", "Land B"}
    for r in rows:
        x, y = r["coords"][0][0][0]
        assert (0 <= x <= 10 and 0 <= y <= 10) if r["label"] == "Land A" else (20 <= x <= 26 and 0 <= y <= 6)
    exported = done["labels.PREPARE_EXPORT"].collect()
    assert all(r["time_index_end"] == 1 for r in exported)
    assert {r["time_index_start"] for r in exported if r["label"] == "Land B"} == {0}


def test_geometry_keeps_opaque_layers_whole(done):
    rows = done["geometry.MERGE_GEOMETRY"].filter("time_end IS NULL")
    river = area(done["rivers.SHAPE_RIVERS"].filter("time_end IS NULL"))
    assert river > 0
    assert area(rows.filter("layer_ord = 2")) == pytest.approx(river, abs=1e-6)
    assert overlay.area(overlay.union([[[[tuple(p) for p in ring] for ring in part] for part in r["coords"]] for r in rows.collect()])) == pytest.approx(136, abs=1e-3)
    assert rows.filter("color = '#8ab4f8'").count() > 0


def test_detail_leaves_edges_that_features_share(spark):
    rows = [(1, box(0, 0, 1, 1)), (2, box(1, 0, 1, 1)), (3, None), (4, [])]
    layer = spark.createDataFrame(rows, f"fid int, coords {GEOM}")
    got = {r["fid"]: r["coords"] for r in shapes.add_fractal_detail(layer, 0.2).collect()}
    assert got[3] is None and got[4] == []
    for fid in (1, 2):
        ring = got[fid][0][0]
        assert len(ring) == 1 + 3 * 8 + 1 and ring[0] == ring[-1]
        assert all(x == 1 and y in (0, 1) for x, y in ring if abs(x - 1) < 1e-12)


def test_locations_and_search(done, ctx):
    rows = done["locations.LOCATION_SCALE"].collect()
    assert {r["label"] for r in rows} >= {"C1", "C3"}
    first = [r for r in rows if r["label"] == "C1" and r["group_text"]]
    assert first and "C2" in first[0]["group_text"]
    index = done["search-index.CREATE_SEARCH_INDEX"].collect()
    assert [r["label"] for r in index] == ["C1", "C2", "C3"]


def test_search_index_has_time(ctx, spark):
    rows = spark.createDataFrame([("A", [[[[1.0, 1.0]]]], None, 100), ("A", [[[[1.0, 2.0]]]], 100, None), ("B", [[[[3.0, 1.0]]]], None, None)], f"label string, coords {GEOM}, time_start int, time_end int")
    meta = run_step(ctx, "TIME_META_COLLECT", {"places": rows})
    index = run_step(ctx, "CREATE_SEARCH_INDEX", {"time-meta": meta, "places": rows}).collect()
    got = [(r["label"], t["time_index_start"], t["time_index_end"], t["time_end"]) for r in index for t in r["timed"]]
    assert got == [("A", -1, 0, 100), ("A", 0, 1, None), ("B", -1, 1, None)]


def test_rivers_are_alone_in_their_time(spark):
    ctx = Context(spark)
    river = [[[[0.5, 0.5], [2.0, 2.0], [3.0, 2.0], [4.5, 4.5]]]]
    later = [[[[20.0, 1.0], [21.0, 1.0]]]]
    one = spark.createDataFrame([(river, 2000, None, None)], f"coords {GEOM}, width int, time_start int, time_end int")
    two = one.unionByName(spark.createDataFrame([(later, 2000, 100, None), (river, 2000, None, None)], one.schema))
    alone = area(run_step(ctx, "SHAPE_RIVERS", {"in": one}))
    rows = run_step(ctx, "SHAPE_RIVERS", {"in": two})
    assert area(rows.filter("time_start IS NULL")) == pytest.approx(alone, rel=1e-6) and rows.filter("time_start = 100").count() == 1
    # An end at sea keeps its width; a smoothed river has an outline too.
    sea = run_step(ctx, "SHAPE_RIVERS", {"in": one, "land_without_water": spark.createDataFrame([(box(0, 0, 3.5, 9),)], f"coords {GEOM}")})
    assert area(sea) > alone > 0
    smooth = run_step(ctx, "SHAPE_RIVERS", {"in": run_step(ctx, "SMOOTH_LINES", {"in": one})})
    assert smooth.count() == 1 and area(smooth) > 0.5 * alone


def test_tiles_are_cut(ctx, spark):
    ctx = Context(spark, max_zoom=3)
    shapes_ = [("a", box(1, 1, 60, 40)), ("b", [[[[-100.0, 10.0], [100.0, 20.0]]]]), ("c", [[[[12.0, 13.0]]]])]
    rows = spark.createDataFrame(shapes_, f"label string, coords {GEOM}").withColumn("minzoom", F.lit(3))
    tiles = run_step(ctx, "COMPILE_TILES", {"places": rows}).filter("z = 3")
    assert tiles.filter("label = 'a'").count() > 1 and tiles.filter("label = 'c'").count() == 1
    assert 2400 < area(tiles.filter("label = 'a'")) < 2600  # with the margins
    widest = max(abs(p[0] - q[0]) for r in tiles.collect() for part in r["coords"] for ring in part for p in ring for q in ring)
    assert widest <= 45 * (1 + 2 / 64) + 1e-6


def test_geojson_names_the_type(ctx, spark):
    rows = spark.createDataFrame([("p", [[[[1.0, 1.0]]]]), ("l", [[[[0.0, 0.0], [1.0, 2.0]]]]), ("s", box(0, 0, 1, 1)), ("n", None)], f"label string, coords {GEOM}")
    found = [json.loads(r["value"]) for r in run_step(ctx, "GEOJSON_OUT", {"in": rows}).collect()]
    assert {f["properties"]["label"]: f["geometry"] and (f["geometry"]["type"], f["geometry"]["coordinates"]) for f in found} == {"p": ("Point", [1.0, 1.0]), "l": ("LineString", [[0.0, 0.0], [1.0, 2.0]]), "s": ("Polygon", box(0, 0, 1, 1)[0]), "n": None}


def test_faults_are_found(ctx, spark):
    bow = [[[[0.0, 0.0], [2.0, 2.0], [2.0, 0.0], [0.0, 2.0], [0.0, 0.0]]]]
    touch = [[[[10.0, 0.0], [12.0, 0.0], [11.0, 1.0], [12.0, 2.0], [10.0, 2.0], [11.0, 1.0], [10.0, 0.0]]]]
    rows = spark.createDataFrame([(g,) for g in (bow, touch, box(20, 0, 2, 2), box(21, 1, 2, 2), box(30, 0, 1, 1), box(40, 0, 1, 1), box(40, 0, 1, 1), None)], f"coords {GEOM}")
    faults = run_step(ctx, "CHECK_GEOMETRY", {"in": rows}).groupBy("fault").count().collect()
    assert {r["fault"]: r["count"] for r in faults} == {"self intersection": 1, "self contact": 1, "overlap": 2, "duplicate": 1, "null geometry": 1}


def test_steps_run_from_another_folder(tmp_path):
    code = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "1").getOrCreate()
from chronogeo.operators.overlay import GEOM
from chronogeo.plans.steps import Context, run_step
ring = [[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 1.0], [0.0, 0.0]]
rows = spark.createDataFrame([("a", [[ring]])], f"city string, coords {GEOM}")
print(run_step(Context(spark), "CITY_POLYGONS", {"in": rows}).count())
"""
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", code, repo], cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True, text=True, timeout=240)
    assert done.stdout.strip().endswith("1"), done.stderr[-2000:]


def test_runtimes(done, ctx):
    rows = pipeline.runtimes(ctx, TEXT).collect()
    assert {"READ_FILE", "SHAPE_RIVERS"} <= {r["step"] for r in rows} and all(r["seconds"] >= 0 for r in rows)


def test_highlights_are_inverted(done):
    rows = done["highlights.HIGHLIGHTS"].collect()
    assert len(rows) == 2 and all(r["coords"][0][0][0] == [-138.0, -90.0] for r in rows)


def test_tiles(done, ctx):
    tiles = done["tiles.COMPILE_TILES"]
    assert tiles.filter("z = 0").select("x", "y").distinct().count() == 1
    assert ctx.results["props-map"].filter("layer = 'labels' AND key = 'label'").first()["nulls"] == 0


@pytest.mark.parametrize("name", ["BORDER_VARIANTS__NATIONS", "BORDER_VARIANTS__SUBREGIONS", "BORDER_VARIANTS__REGIONS", "BORDER_VARIANTS__DISTRICT_BORDERS", "BORDER_VARIANTS__REGION_BORDERS", "BORDER_VARIANTS__PROVINCES"])
def test_border_variants(ctx, name):
    out = run_step(ctx, name, {"in": ctx.layers["borders"]})
    assert out.count() == {"BORDER_VARIANTS__NATIONS": 3, "BORDER_VARIANTS__SUBREGIONS": 1, "BORDER_VARIANTS__REGIONS": 2, "BORDER_VARIANTS__DISTRICT_BORDERS": 1, "BORDER_VARIANTS__REGION_BORDERS": 1, "BORDER_VARIANTS__PROVINCES": 3}[name]


def test_other_steps(ctx, spark):
    roads = run_step(ctx, "SHAPE_ROADS", {"in": ctx.layers["roads"]})
    assert area(roads) > 0
    named = run_step(ctx, "RESOLVE_LABELS", {"in": ctx.layers["rivers"]})
    assert run_step(ctx, "RIVER_LABELS", {"in": named}).first()["minzoom"] == 5
    grown = run_step(ctx, "BUFFER_POLYGONS", {"in": ctx.layers["waters"]})
    assert area(grown) > 4
    both = run_step(ctx, "ADD_POLYGONS", {"in": ctx.layers["waters"], "summand": ctx.layers["land"].filter("time_start IS NULL")})
    assert area(both) == pytest.approx(100)
    specials = ctx.layers["waters"].withColumn("pattern", F.lit("pebbles"))
    assert run_step(ctx, "CHECK_GEOMETRY", {"in": ctx.layers["waters"]}).count() == 0
    small = specials.withColumn("coords", F.lit(None).cast(GEOM))
    assert run_step(ctx, "RESOLVE_PATTERNS", {"in": small}).count() == 1
    assert run_step(ctx, "GEOJSON_OUT", {"in": ctx.layers["waters"]}).first()["value"].startswith('{"type":"Feature"')


def test_tiling_changes_no_area(ctx):
    land = ctx.layers["land"].withColumn("k", F.col("labels"))
    cut = overlay.tiled(land, 4.0)
    assert cut.select("tile_x", "tile_y").distinct().count() == 9 + 4
    assert area(cut) == pytest.approx(136) and area(overlay.dissolve(cut, ["k"])) == pytest.approx(136)
    erased = overlay.erase(cut, overlay.tiled(ctx.layers["waters"], 4.0), ["tile_x", "tile_y"])
    assert area(erased) == pytest.approx(132)


def test_errors():
    with pytest.raises(pipeline.PipelineError):
        pipeline.parse("- name: a\n  steps: [{step: NOPE}]")
    with pytest.raises(pipeline.PipelineError):
        pipeline.parse("- name: a\n  steps: [{step: ADD_ZOOM, dependsOn: {in: b}}]")
    nodes = pipeline.parse("- name: a\n  steps: [{step: ADD_ZOOM, dependsOn: {in: b}}]\n- name: b\n  steps: [{step: ADD_ZOOM, dependsOn: {in: a}}]")
    with pytest.raises(pipeline.PipelineError):
        pipeline.ordered(nodes)
    assert len(STEPS) >= 40


def areas(rows, *keys):
    out = {}
    for r in rows.collect():
        k = tuple(r[c] for c in keys)
        out[k] = round(out.get(k, 0.0) + overlay.area(r["coords"]), 6)
    return out


def test_crowded_groups_are_tiled_and_joined_again(spark):
    cells = [(f"k{(x + y) % 3}", box(x * 30.5, y * 20.25, 30.5, 20.25)) for x in range(4) for y in range(4)]
    layer = spark.createDataFrame(cells, f"key string, coords {GEOM}")
    mask = spark.createDataFrame([("m", box(10, 10, 50, 40)), ("n", box(70, 5, 20, 70))], f"name string, coords {GEOM}")
    plain, tiled = Context(spark), Context(spark, group_vertices=10)
    assert overlay.tile_size([layer], [], 1000) is None
    assert overlay.tile_size([layer], [], 10) < 64
    for name, inputs, key, parameters in (
        ("CLIP", {"in": layer, "mask": mask}, "key", {}),
        ("SUBTRACT", {"in": layer, "subtrahend": mask}, "key", {"keepField": "key"}),
        ("CITY_POLYGONS", {"in": layer.withColumnRenamed("key", "city")}, "city", {}),
        ("MERGE_GEOMETRY", {"land": layer, "waters": mask}, "layer_ord", {}),
        ("MERGE_GEOMETRY", {"land": layer, "ice": mask}, "color", {}),
    ):
        a, b = (run_step(c, name, inputs, **parameters) for c in (plain, tiled))
        assert areas(a, key) == areas(b, key) != {}, name
    one, many = (overlay.dissolve_tiled(layer, ["key"], s).collect() for s in (None, 16.0))
    count = lambda rows: sorted((r["key"], len(r["coords"])) for r in rows)
    assert count(one) == count(many)


def test_cuts_of_empty_groups_and_of_shared_origin(spark):
    layer = spark.createDataFrame([(1, box(0, 0, 2, 2)), (2, box(5, 5, 1, 1)), (3, None)], f"k int, coords {GEOM}")
    mask = layer.filter("k = 1").unionByName(spark.createDataFrame([(9, box(0, 0, 1, 1))], f"k int, coords {GEOM}"))
    assert areas(overlay.clip(layer, mask, ["k"]), "k") == {(1,): 4.0}
    assert areas(overlay.erase(layer, mask, ["k"]), "k") == {(2,): 1.0}
    line = spark.createDataFrame([(1, [[[[0.5, 0.5], [3.0, 0.5]]]])], f"k int, coords {GEOM}")
    assert [r["coords"] for r in lines.clip_lines(line, mask, ["k"]).collect()] == [[[[[0.5, 0.5], [2.0, 0.5]]]]]


def length(rows):
    return sum(math.dist(a, b) for r in rows.collect() for part in r["coords"] for ring in part for a, b in zip(ring, ring[1:]))


def test_lines_are_clipped_and_subtracted_as_lines(spark):
    ctx = Context(spark)
    make = lambda *shapes: spark.createDataFrame([(s,) for s in shapes], f"coords {GEOM}")
    districts, mask = make(box(0, 0, 4, 4), box(4, 0, 4, 4), box(20, 0, 2, 2)), make(box(-1, -1, 30, 4))
    borders = run_step(ctx, "BORDER_VARIANTS__DISTRICT_BORDERS", {"in": districts})
    assert length(borders) == pytest.approx(28 + 8)
    clipped = run_step(ctx, "CLIP", {"in": borders, "mask": mask})
    assert length(clipped) == pytest.approx(8 + 9 + 8)  # a chain round a lone district is no area
    # Masks overlap each other; between x = 1 and 3 the border at y = 0 goes, and that at x = 20 below y = 1.
    masks = make(box(1, -1, 1.5, 2), box(2, -1, 1, 2), box(19, -1, 2, 2))
    left = run_step(ctx, "SUBTRACT", {"in": clipped, "subtrahend": masks})
    assert length(left) == pytest.approx(25 - 2 - 2)
    assert length(run_step(ctx, "SUBTRACT", {"in": left, "subtrahend": masks.limit(0)})) == pytest.approx(21)
    # Without a mark: open chains are lines wherever they stand, closed rings are polygons.
    mixed = make(box(0, 0, 2, 2), [[[[0.0, 1.0], [1.0, 1.0], [2.0, 1.0], [3.0, 1.0], [4.0, 1.0]]]])
    rows = run_step(ctx, "CLIP", {"in": mixed, "mask": make(box(1, 0, 9, 9))})
    assert sorted(round(x, 6) for x in (length(rows.filter(F.size(F.col("coords")[0][0]) < 5)), area(rows.filter(F.size(F.col("coords")[0][0]) > 4)))) == [2, 3]


def test_crowded_lines_are_tiled_and_joined_again(spark):
    grid = [(f"n{x // 2}", box(x * 20.5, y * 20.25, 20.5, 20.25)) for x in range(4) for y in range(4)]
    layer = spark.createDataFrame(grid, f"nation string, coords {GEOM}")
    mask = spark.createDataFrame([(box(10, 10, 50, 40),), (box(40, -5, 24, 69),)], f"coords {GEOM}")  # sides at 64 lie on tile borders
    plain, tiled = Context(spark), Context(spark, group_vertices=10)
    chained = lambda rows: sorted((sorted((round(x, 9), round(y, 9)) for x, y in (c[0], c[-1])), len(c), round(sum(map(math.dist, c, c[1:])), 6)) for r in rows.collect() for part in r["coords"] for c in part)
    for name, inputs in (
        ("BORDER_VARIANTS__DISTRICT_BORDERS", {"in": layer}),
        ("BORDER_VARIANTS__PROVINCE_BORDERS", {"in": layer, "land_without_water": mask}),
    ):
        a, b = (chained(run_step(c, name, inputs)) for c in (plain, tiled))
        assert a == b != [], name
    slanted = [[[float(x), 0.3 + x * 0.7] for x in range(0, 90, 3)]]
    borders = spark.createDataFrame([("a", [slanted]), ("b", [[[[64.0, -9.0], [64.0, 90.0]]]]), ("c", [[[[0.0, 0.0], [80.0, 0.0]], [[5.0, 5.0], [5.0, 70.0]]]]), ("d", None)], f"name string, coords {GEOM}").withColumn("geom_type", F.lit("LineString"))
    for name, other in (("CLIP", "mask"), ("SUBTRACT", "subtrahend")):
        a, b = (run_step(c, name, {"in": borders, other: mask}) for c in (plain, tiled))
        assert chained(a) == chained(b) != [] and length(a) == pytest.approx(length(b)), name
