import io
import random
from contextlib import redirect_stdout

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from chronogeo import session
from chronogeo.operators import derive, fuzzy, lines, overlay, points, shapes, temporal, topology


def _plan(df) -> str:
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain()
    return out.getvalue()


def _square(x, y, size=1.0):
    x, y = float(x), float(y)
    return [[[[x, y], [x + size, y], [x + size, y + size], [x, y + size], [x, y]]]]


def test_features_are_not_compared_with_every_slice(spark):
    ranges = [(0, 1, 3), (1, 12, 15), (2, None, 11), (3, 14, None), (4, None, None), (5, 40, 41), (6, 12, 12), (7, -5, 90)]
    rows = spark.createDataFrame(ranges, "fid int, time_start int, time_end int")
    axis = temporal.slices(spark.createDataFrame([(b,) for b in (10, 12, 13, 30)], "barrier int"))
    cut = temporal.slice_layer(rows, axis)
    assert "NestedLoop" not in _plan(cut)
    slices = [(None, 10), (10, 12), (12, 13), (13, 30), (30, None)]
    low, high = (lambda v: -999 if v is None else v), (lambda v: 999 if v is None else v)
    want = {(f, a, b) for f, s, e in ranges for a, b in slices if max(low(s), low(a)) < min(high(e), high(b))}
    assert {(r["fid"], r["slice_start"], r["slice_end"]) for r in cut.collect()} == want


def test_tiles_cut_once(spark):
    layer = spark.createDataFrame([(1, _square(0.5, 0.5))], f"k int, coords {overlay.GEOM}")
    assert _plan(overlay.tiled(layer, 1.0)).count("ArrowEvalPython") == 1


def test_fields_of_a_key_in_tiles(spark):
    rows = [(k, "a", _square(k % 4, k // 4)) for k in range(16)] + [(20, "a", _square(9.25, 9.25, 0.5))]
    layer = spark.createDataFrame(rows, f"fid int, key string, coords {overlay.GEOM}")
    whole = overlay.dissolve_fields(layer, ["key"], ("fid",), most=8).first()
    assert whole["fid"] == 0 and overlay.area(whole["coords"]) == 16.25 and len(whole["coords"]) == 2


def test_label_points_of_many_are_those_of_each():
    some = [_square(k, 0) for k in range(300)] + [[], [[[[0.0, 0.0], [4.0, 0.0], [0.0, 3.0], [0.0, 0.0]]]]]
    assert shapes.inner_points(some) == [shapes.inner_point(g) if g else None for g in some]


def test_shared_sides_are_compared_once(spark):
    sides = [(1, 0.0, 0.0, 2.0, 0.0), (2, 2.0, 0.0, 0.0, 0.0), (3, 1.0, -1.0, 1.0, 1.0)]
    rows = spark.createDataFrame([(0, *s) for s in sides], "g int, sid long, x1 double, y1 double, x2 double, y2 double")
    found = {(r["m_sid"], r["p"]["x"], r["p"]["y"]) for r in topology.meetings(rows, ["g"]).collect()}
    assert found == {(1, 1.0, 0.0), (2, 1.0, 0.0), (3, 1.0, 0.0)}


def test_heads_go_to_few_cells(spark):
    rows = spark.range(900).select((F.col("id") % 30 * 1.0).alias("x"), F.floor(F.col("id") / 30).cast("double").alias("y"))
    assert points._around(rows, F.lit(8.0), F.lit(2.001)).count() < 3 * 900


def test_groups_of_a_cut_lie_in_many_tasks(spark):
    rows = [(k or None, k, [[[[-1.0, 0.5], [3.0, 0.5]]]]) for k in range(40)]
    layer = spark.createDataFrame(rows, f"g int, fid int, coords {overlay.GEOM}")
    mask = spark.createDataFrame([(k or None, _square(0, 0)) for k in range(39)] + [(99, _square(0, 0))], f"g int, coords {overlay.GEOM}")
    cut = lines.clip_lines(layer, mask, ["g"])
    assert {(r["fid"], str(r["coords"])) for r in cut.collect()} == {(k, "[[[[0.0, 0.5], [1.0, 0.5]]]]") for k in range(39)}
    assert cut.select(F.spark_partition_id()).distinct().count() > 4


def test_lines_are_cut_by_near_polygons_as_by_all():
    squares = [_square(3 * k, k % 2) for k in range(9)] + [_square(30, 0, 2.0), _square(31, 0.5, 2.0)]
    seg, owner = overlay._segments(squares)
    near = lines.near_lines(seg, owner)
    for line in ([[-1.0, 0.5], [40.0, 0.5]], [[0.5, 0.5], [3.5, 1.5], [3.5, 9.0]], [[50.0, 0.0], [51.0, 1.0]], [[31.0, 0.7], [31.0, 5.0]]):
        for erase in (False, True):
            assert lines.cut_line(line, *near(line), erase) == lines.cut_line(line, seg, owner, erase)
    assert len(near([[0.5, 0.5], [0.6, 0.6]])[0]) == 4


def test_many_polygons_are_cut_by_boxes_as_each():
    rng = random.Random(5)
    turn = lambda n: [[round(rng.uniform(-3, 3)), round(rng.uniform(-3, 3), 1)] for _ in range(n)]
    some = [[[(r := turn(rng.randint(1, 8))) + r[:1] for _ in range(rng.randint(0, 3))] for _ in range(rng.randint(0, 2))] for _ in range(400)]
    boxes = np.array([[-1, -1, 1, 1] if k % 2 else [-np.inf, -1, 0.5, np.inf] for k in range(400)], float)
    got = shapes.box_parts(pa.array(some, pa.list_(pa.list_(pa.list_(pa.list_(pa.float64()))))), boxes).to_pylist()
    assert got == [shapes.box_part(g, "Polygon", *b) for g, b in zip(some, boxes.tolist())] and any(got)


def test_boxes_cut_layers_of_all_kinds(spark):
    rows = [(0, None, None), (1, _square(0.5, 0.5), "Polygon"), (2, [[[[0.0, 0.5], [3.0, 0.5]]]], "LineString"), (3, _square(5, 5), None), (4, [[[[0.5, 0.5]]]], "Point")]
    layer = spark.createDataFrame(rows, f"k int, coords {overlay.GEOM}, kind string").coalesce(1)
    cut = shapes.clipped_to_box(F.col("coords"), F.col("kind"), *[F.lit(x) for x in (0.0, 0.0, 1.0, 1.0)])
    got = {r["k"]: r["g"] for r in layer.select("k", cut.alias("g")).collect()}
    assert got[0] is None and overlay.area(got[1]) == 0.25 and got[2] == [[[[0.0, 0.5], [1.0, 0.5]]]] and got[3] == [] and got[4] == rows[4][1]


def test_lines_smoothed_together_are_those_of_each():
    rng = random.Random(3)
    some = [[[rng.uniform(-180, 180), rng.uniform(-90, 90)] for _ in range(rng.randint(0, 6))] for _ in range(200)]
    some += [[[0.0, 0.0], [0.0, 0.0], [1.0, 1.0]], [[0.0, 0.0], [1.0, 0.0], [0.0, 0.0]]]
    assert shapes.smoothed(some) == [shapes.smooth_line(x) for x in some]
    assert [len(x) for x in shapes.smoothed([[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0]], [[0.0, 0.0], [1.0, 0.0], [2.0, 0.0]]])] == [13, 3]


def test_arcs_of_many_sides_lie_in_many_tasks(spark, monkeypatch):
    rows = [(k, _square(k % 20, k // 20)) for k in range(400)]
    layer = spark.createDataFrame(rows, f"fid int, coords {overlay.GEOM}")
    monkeypatch.setattr(session, "TASK_ROWS", 100)
    thin = topology.simplified(layer, 0.5)
    assert thin.count() == 400 and thin.select(F.spark_partition_id()).distinct().count() > 8


def test_texts_of_one_hash_keep_it_beside_free_ids(spark):
    rows = [(x, None, None) for x in ("Aa", "BB")]
    got = derive.location_texts(spark.createDataFrame(rows, "label string, link string, text string")).collect()
    assert len({r["id"] for r in got}) == 2 and len({r["hash"] for r in got}) == 1


def test_pairs_found_by_few_names_are_all_hits(spark):
    rows = [(("House", "house", None)[k % 3], f"{'HX'[k % 2]}ous{k % 7} {k % 40}") for k in range(300)] + [("house", None)]
    names = spark.createDataFrame(rows, "category string, label string")
    queries = spark.createDataFrame([(1, "hous3"), (2, "House"), (3, "xous1 2"), (4, "h"), (5, "zzzz")], "qid int, query string")
    full = queries.filter("length(query) > 1").crossJoin(names.distinct()).withColumn("score", fuzzy.score(F.lower("query"), F.col("label"), F.col("category"))).filter("score <= 0.4")
    order = Window.partitionBy("qid").orderBy("score", "label", "category")
    want = full.withColumn("rank", F.row_number().over(order)).filter("rank <= 10").select("qid", "rank", "category", "label", "score")
    got = fuzzy.search_all(names, queries)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 30
