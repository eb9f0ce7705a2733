import math
import random
import time

import pytest
from pyspark.sql import functions as F

from chronogeo.operators import lines, overlay


def _star(rng, x, y):
    n = rng.randint(3, 12)
    ring = [(x + rng.uniform(0.3, 3) * math.cos(2 * math.pi * i / n), y + rng.uniform(0.3, 3) * math.sin(2 * math.pi * i / n)) for i in range(n)]
    return [[[*ring, ring[0]]]]


def test_groups_of_one_call_do_not_meet():
    rng = random.Random(4)
    groups = [[_star(rng, rng.uniform(-3, 3), rng.uniform(-3, 3)) for _ in range(rng.randint(1, 5))] for _ in range(60)]
    assert overlay.unions([*groups, []]) == [overlay.union(g) for g in groups] + [[]]


def _square(x, y):
    return [[[(x, y), (x + 1, y), (x + 1, y + 1), (x, y + 1), (x, y)]]]


def test_union_of_many_cells_is_not_quadratic():
    """One by one against all cells, 1 000 took 1.5 s and 2 000 took 4.1 s."""
    began = time.time()
    assert overlay.area(overlay.union([_square(x, y) for x in range(20) for y in range(400)])) == 8000
    assert time.time() - began < 20


def test_groups_with_and_without_a_mask(spark):
    square = lambda x, y: [[[[float(v) for v in p] for p in _square(x, y)[0][0]]]]
    layer = spark.createDataFrame([(None, 1, square(0, 0)), (None, 2, square(5, 0)), (1, 3, square(0, 0)), (2, 4, None)], f"k int, n int, coords {overlay.GEOM}")
    mask = spark.createDataFrame([(None, square(0.5, 0)), (2, square(0, 0))], f"k int, coords {overlay.GEOM}")
    found = lambda df: sorted((r["n"], overlay.area(r["coords"])) for r in df.collect())
    assert found(overlay.clip(layer, mask, ["k"])) == [(1, 0.5)]
    assert found(overlay.erase(layer, mask, ["k"])) == [(1, 0.5), (2, 1.0), (3, 1.0)]
    line = layer.withColumn("coords", F.transform("coords", lambda part: F.array(F.slice(part[0], 1, 2))))
    assert [(r["n"], r["coords"]) for r in lines.clip_lines(line, mask, ["k"]).collect()] == [(1, [[[[0.5, 0.0], [1.0, 0.0]]]])]
    assert sorted(r["n"] for r in lines.clip_lines(line, mask, ["k"], erase=True).collect()) == [1, 2, 3]


def test_buffer_of_a_divided_side():
    """Points on a straight side add no arcs of their own."""
    few = [[[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)]]]
    many = [[[*[(i / 8, 0.0) for i in range(32)], *few[0][0][1:]]]]
    for distance in (1.0, -1.0):
        a, b = overlay.buffer(few, distance, 20), overlay.buffer(many, distance, 20)
        assert overlay.area(a) == pytest.approx(overlay.area(b)) and len(a[0][0]) == len(b[0][0])
