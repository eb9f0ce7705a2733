import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronogeo.functions import geo
from chronogeo.functions.noise import simplex
from chronogeo.operators import edges, lines, overlay, topology
from chronogeo.plans.steps import Context, run_step
from chronogeo.session import ship_package

GEOM = "coords array<array<array<array<double>>>>"


def sides(layer):
    return lines.polygon_edges(layer, ["fid"])


def star(rng, x, y):
    n = rng.randint(3, 7)
    ring = [[round(x + rng.uniform(0.3, 1.5) * math.cos(2 * math.pi * k / n), 3), round(y + rng.uniform(0.3, 1.5) * math.sin(2 * math.pi * k / n), 3)] for k in range(n)]
    return [[[*ring, ring[0]]]]


@pytest.mark.parametrize("crowd", [6, 64])
def test_noded_outlines_equal_the_arrangement(spark, crowd):
    ship_package(spark)
    rng = random.Random(3)
    square = lambda x, y, w: [[[[x, y], [x + w, y], [x + w, y + w], [x, y + w], [x, y]]]]
    rows = [(i, i % 2, star(rng, rng.uniform(0, 5), rng.uniform(0, 5))) for i in range(40)]
    rows += [(50, 0, square(0.0, 0.0, 2.0)), (51, 0, square(2.0, 0.0, 1.0)), (52, 0, square(0.5, 2.0, 1.0)), (53, 0, square(0.0, 0.0, 2.0)), (54, 0, square(0.0, 0.0, 1.0) + square(1.0, 0.0, 1.0)), (55, 1, None)]
    df = spark.createDataFrame(rows, f"fid int, g int, {GEOM}")
    key = lambda r: (r.g, r.fid, r.x1, r.y1, r.x2, r.y2)
    got = sorted(map(key, topology.boundaries(df, ["g"], ["fid"], crowd=crowd).collect()))
    assert got == sorted(map(key, edges.normalised(overlay.boundaries(df, ["g"], ["fid"]), 7).collect()))


def test_crowded_cells_are_divided(spark):
    rng = random.Random(1)
    rows = [(i, rng.gauss(0, 0.01), rng.gauss(0, 0.01)) for i in range(3000)] + [(9000 + i, 5.0 * i, 7.0) for i in range(20)]
    df = spark.createDataFrame(rows, "sid long, x1 double, y1 double").selectExpr("sid", "x1", "y1", "x1 + 0.0005 AS x2", "y1 + 0.0003 AS y2")
    cells = topology.dealt(df, [], 64)
    assert cells.groupBy("level", "cx", "cy").count().agg(F.max("count")).first()[0] <= 64
    assert cells.select("sid").distinct().count() == 3020


def test_shared_arcs_are_simplified_once(spark):
    rng = random.Random(7)
    corner = {(i, j): (i + rng.uniform(-0.2, 0.2), j + rng.uniform(-0.2, 0.2)) for i in range(6) for j in range(6)}
    bend = {}

    def path(a, b):
        p, q = min(a, b), max(a, b)
        if (p, q) not in bend:
            (x1, y1), (x2, y2) = corner[p], corner[q]
            bend[p, q] = [(x1 + (x2 - x1) * k / 6 + rng.uniform(-0.04, 0.04), y1 + (y2 - y1) * k / 6 + rng.uniform(-0.04, 0.04)) for k in range(1, 6)]
        inner = bend[p, q] if (a, b) == (p, q) else bend[p, q][::-1]
        return [corner[a], *inner]

    rows = []
    for i in range(5):
        for j in range(5):
            ring = path((i, j), (i + 1, j)) + path((i + 1, j), (i + 1, j + 1)) + path((i + 1, j + 1), (i, j + 1)) + path((i, j + 1), (i, j))
            rows.append((10 * i + j, [[[list(p) for p in [*ring, ring[0]]]]]))
    df = spark.createDataFrame(rows, f"fid int, {GEOM}")
    thin = topology.simplified(df, 0.5).cache()
    count = lambda layer: Counter(r["count"] for r in edges.normalised(sides(layer)).groupBy(*edges.EDGE).count().collect())
    before, after = count(df), count(thin)
    assert set(after) == {1, 2} and after[2] < before[2]
    removable = before[2] + before[1] - 60 + 4 + (2 * 5 - 2) * 0  # inner points of all arcs; the four outer corners are no nodes
    assert before[2] + before[1] - after[2] - after[1] == pytest.approx(removable / 2, abs=2)
    # What neighbours lose to one another cancels out: the layer's area is that of its outer outline.
    outer = [r for r in edges.normalised(sides(thin).select("x1", "y1", "x2", "y2")).groupBy(*edges.EDGE).count().filter("count = 1").collect()]
    directed = {tuple(sorted(((r.x1, r.y1), (r.x2, r.y2)))) for r in outer}
    ring_sum = sum(r.x1 * r.y2 - r.x2 * r.y1 for r in sides(thin).collect() if tuple(sorted(((r.x1, r.y1), (r.x2, r.y2)))) in directed) / 2
    assert thin.agg(F.sum(geo.planar_area(F.col("coords")))).first()[0] == pytest.approx(ring_sum)


def test_rings_do_not_collapse_and_shares_by_feature(spark):
    ring = [[math.cos(i / 50 * math.pi), math.sin(i / 50 * math.pi)] for i in range(100)]
    moved = [[x + 9, y] for x, y in ring]
    lens = lambda low, high: [[[[20.0, 0.0], [21.0, low], [22.0, 0.0], [21.0, high], [20.0, 0.0]]]]
    rows = [(1, [[[*ring, ring[0]]]]), (2, [[[*moved, moved[0]]]]), (3, lens(-0.1, 0.1)), (4, [[[[20.0, 0.0], [21.0, 0.1], [22.0, 0.0], [21.0, 5.0], [20.0, 0.0]]]]), (5, None)]
    df = spark.createDataFrame(rows, f"fid int, {GEOM}")
    got = {r.fid: len(r.coords[0][0]) for r in topology.simplified(df, 0.0).collect()}
    assert got[1] == got[2] == 4 and got[3] >= 4 and got[4] >= 4 and 5 not in got
    share = F.when(F.col("fid") == 1, 0.1).otherwise(1.0)
    got = {r.fid: len(r.coords[0][0]) for r in topology.simplified(df, share).collect()}
    assert got[2] == 101 and 9 <= got[1] <= 14 and got[4] == 5
    assert topology.simplified(df.limit(0), 0.5).collect() == []


def test_weights_go_up():
    rng = random.Random(6)
    line = [(float(k), rng.random()) for k in range(20)]
    w = topology.vertex_weights(line)
    first = [abs((a[0] - b[0]) * (c[1] - b[1]) - (c[0] - b[0]) * (a[1] - b[1])) for a, b, c in zip(line, line[1:], line[2:])]
    assert len(w) == 18 and min(w) == min(first) and w.index(min(w)) == first.index(min(first))
    assert topology.vertex_weights([(0.0, 0.0), (1.0, 0.0)]) == [] and topology.vertex_weights([(0.0, 0.0), (1.0, 1.0), (2.0, 0.0)]) == [2.0]


def test_merged_lines_are_alike_at_every_size(spark):
    ship_package(spark)
    rng = random.Random(2)
    rows = []
    for k in range(40):
        x, y = 10.0 * (k % 8), 8.0 * (k // 8)
        pts = [[x + i * 0.5, y + rng.uniform(0, 1)] for i in range(8)]
        rows += [(f"l{k % 2}", [[[p, q]]]) for p, q in zip(pts, pts[1:])]
    df = spark.createDataFrame(rows, f"label string, {GEOM}")
    out = []
    for most in (20, 20_000):
        got = run_step(Context(spark, group_vertices=most), "RIVER_LABELS", {"in": df}).collect()
        out.append(sorted((r.label, sorted(min(c, c[::-1]) for part in r.coords for c in part)) for r in got))
    assert out[0] == out[1] and len(out[0]) == 2
    cells = [(str(i % 2), "", str(i % 2), str(i), [[[[x, y], [x + 1, y], [x + 1, y + 1], [x, y + 1], [x, y]]]]) for i in range(30) for x, y in [(float(i % 6), float(i // 6))]]
    layer = spark.createDataFrame(cells, f"nation string, subregion string, region string, province string, {GEOM}")
    land = spark.createDataFrame([([[[[-1.0, -1.0], [4.5, -1.0], [4.5, 9.0], [-1.0, 9.0], [-1.0, -1.0]]]],)], GEOM)
    for step in ("PROVINCE_BORDERS", "DISTRICT_BORDERS", "NATION_BORDERS", "REGION_BORDERS"):
        found = []
        for most in (20, 20_000):
            got = run_step(Context(spark, group_vertices=most), f"BORDER_VARIANTS__{step}", {"in": layer} | ({"land_without_water": land} if step in ("PROVINCE_BORDERS", "NATION_BORDERS") else {})).collect()
            found.append(Counter(tuple(sorted([tuple(a), tuple(b)])) for r in got for part in r.coords for c in part for a, b in zip(c, c[1:])))
            assert len(got) == (2 if step == "PROVINCE_BORDERS" else 1)  # of each nation
        assert found[0] == found[1], step


def test_ellipsoid_area(spark):
    e = geo.ECCENTRICITY
    q = lambda lat: (1 - e * e) * (math.sin(math.radians(lat)) / (1 - (e * math.sin(math.radians(lat))) ** 2) + math.log((1 + e * math.sin(math.radians(lat))) / (1 - e * math.sin(math.radians(lat)))) / (2 * e))
    world = [[[[-180.0, -90.0], [180.0, -90.0], [180.0, 90.0], [-180.0, 90.0], [-180.0, -90.0]]]]
    slope = [[[[0.0, 10.0], [5.0, 40.0], [0.0, 40.0], [0.0, 10.0]]]]
    got = [r.km2 for r in spark.createDataFrame([(world,), (slope,), (None,)], GEOM).select(geo.area_km2(F.col("coords")).alias("km2")).collect()]
    assert got[0] == pytest.approx(510_065_621.7, rel=1e-9) and got[2] is None
    lats = 10 + (np.arange(4000) + 0.5) / 4000 * 30
    exact = geo.AXIS_KM**2 / 2 * math.radians(5) * (q(40) - np.mean([q(x) for x in lats]))
    assert got[1] == pytest.approx(exact, rel=1e-6)


def test_noise_goldens_and_continuity():
    x, y = np.array([0.0, 0.013, 1.5, -3.25]), np.array([0.0, 0.021, -2.25, 7.125])
    n = simplex(x, y)
    assert n[0] == 0 and np.all(np.abs(n) <= 1) and n.dtype == np.float32
    rng = np.random.default_rng(4)
    p, q = rng.uniform(-5, 5, 20_000), rng.uniform(-5, 5, 20_000)
    assert np.abs(simplex(p, q) - simplex(p + 1e-5, q - 1e-5)).max() < 0.01  # also where triangles and cells meet
    assert 0.2 < simplex(p, q).std() < 0.6 and abs(simplex(p, q).mean()) < 0.02
