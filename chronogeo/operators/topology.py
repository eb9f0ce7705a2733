"""Topology of polygon layers as DataFrames: arcs between nodes, and noded outlines.

An arc is a stretch of outline between two nodes, which are the points where
not exactly two edges of the layer meet. Neighbours share arcs, so what is done to
an arc is done to both. Noding splits sides where they meet others of the same
group: sides are dealt to the cells of a grid, crowded cells to finer ones, and
only sides of one cell are compared. No operator here takes a whole layer, slice
or key into one task; what meets in one task is a ring, or a cell.
"""

from __future__ import annotations

import heapq
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronogeo.operators import edges
from chronogeo.session import by_size, durable_table, ship_package

PRECISION = 8
#: A side's end that is so near to another side lies on it.
NEAR = 1e-8
#: Cells with more sides are divided, into so many by so many, so many times at most.
CROWD, PARTS, DEPTH = 64, 4, 8
RING = ["_uid", "_part", "_ring"]
WEIGHTS = "array<double>"


def vertex_weights(line: list[tuple[float, float]]) -> list[float]:
    """Visvalingam's weights of a line's inner points: twice the triangle's area at which each goes, never less than one that went before."""
    n = len(line)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    area = lambda i: abs((line[before[i]][0] - line[i][0]) * (line[after[i]][1] - line[i][1]) - (line[after[i]][0] - line[i][0]) * (line[before[i]][1] - line[i][1]))
    now = {i: area(i) for i in range(1, n - 1)}
    heap, out = [(w, i) for i, w in now.items()], [0.0] * n
    heapq.heapify(heap)
    while heap:
        w, i = heapq.heappop(heap)
        if now.get(i) != w:
            continue
        out[i] = w
        del now[i]
        a, b = before[i], after[i]
        after[a], before[b] = b, a
        for j in (a, b):
            if j in now:
                now[j] = max(w, area(j))
                heapq.heappush(heap, (now[j], j))
    return out[1:-1]


def _same(keys: list[str], of: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{of}_{k}")) for k in keys], F.lit(True))


def _named(keys: list[str], of: str) -> list[Column]:
    return [F.col(k).alias(f"{of}_{k}") for k in keys]


def arcs(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, _uid, _part, _ring, arc (its number in the ring), arcs (their number), line (from its lesser end), turned (whether the ring takes it the other way).

    rows have _uid and coords. A ring without a node is one arc that begins at its least point.
    """
    point = lambda p: F.struct((p[0] + F.lit(0.0)).alias("x"), (p[1] + F.lit(0.0)).alias("y"))
    rings = rows.select(*by, "_uid", F.posexplode("coords").alias("_part", "_rings")).select(*by, "_uid", "_part", F.posexplode("_rings").alias("_ring", "_r"))
    rings = rings.withColumn("_r", F.transform("_r", point))
    rings = rings.withColumn("_r", F.filter("_r", lambda p, i: ~p.eqNullSafe(F.get(F.col("_r"), i - 1))))
    rings = rings.withColumn("_r", F.when(F.element_at("_r", 1) == F.element_at("_r", -1), F.slice("_r", 1, F.size("_r") - 1)).otherwise(F.col("_r"))).filter(F.size("_r") > 2)
    sides = rings.select(*by, *RING, F.size("_r").alias("n"), F.inline(F.transform("_r", lambda p, i: F.struct(i.alias("seq"), p.alias("a"), F.get(F.col("_r"), (i + 1) % F.size("_r")).alias("b")))))
    sides = durable_table(sides)
    n = sides.count()
    # A point is no node if its sides lead to two points: the least and the greatest of them.
    own = F.struct("a", "b", F.lit(True).alias("own"))
    ends = sides.select(*by, *RING, "n", "seq", F.inline(F.array(own, F.struct(F.col("b").alias("a"), F.col("a").alias("b"), F.lit(False).alias("own")))))
    point = Window.partitionBy(*by, "a")
    met = by_size(ends, [*by, "a"], 2 * n).withColumn("low", F.min("b").over(point)).withColumn("high", F.max("b").over(point))
    other = F.max((F.col("b") != F.col("low")) & (F.col("b") != F.col("high"))).over(point)
    met = met.withColumn("node", ((F.col("low") == F.col("high")) | other).cast("int")).filter("own").drop("low", "high", "own")
    met = by_size(met, RING, n)
    ring = Window.partitionBy(*RING)
    met = met.withColumn("arc", F.sum("node").over(ring.orderBy("seq"))).withColumn("arcs", F.sum("node").over(ring)).withColumn("first", F.min(F.struct("a", "seq")).over(ring)["seq"])
    lone = F.col("arcs") == 0
    met = met.withColumn("seq", F.when(lone, (F.col("seq") - F.col("first") + F.col("n")) % F.col("n")).when(F.col("arc") == 0, F.col("seq") + F.col("n")).otherwise(F.col("seq")))
    met = met.withColumn("arc", F.when(lone, 1).when(F.col("arc") == 0, F.col("arcs")).otherwise(F.col("arc"))).withColumn("arcs", F.greatest("arcs", F.lit(1)))
    lines = met.groupBy(*by, *RING, "arc", "arcs").agg(F.array_sort(F.collect_list(F.struct("seq", "a", "b"))).alias("_s"))  # of one ring
    line = F.concat(F.transform("_s", lambda s: s["a"]), F.array(F.element_at("_s", -1)["b"]))
    lines = lines.withColumn("line", line).withColumn("turned", F.col("line") > F.reverse("line"))
    return lines.withColumn("line", F.least("line", F.reverse("line"))).drop("_s")


def simplified(layer: DataFrame, share: Column | float, by: list[str] | None = None) -> DataFrame:
    """The layer with so large a share of its removable points, those with the greatest triangles, each shared arc simplified once.

    A number is the share of each group's distinct points (groups, by, have a topology of their own); a column is that of
    a feature's points, and an arc of several features keeps what any of them keeps. Ends of arcs stay, and as many points
    as keep a ring from collapsing.
    """
    by = by or []
    ship_package(layer.sparkSession)
    rows = durable_table(layer.withColumn("_uid", F.monotonically_increasing_id()).withColumn("_share", share if isinstance(share, Column) else F.lit(float(share))))
    # An arc's key tells its group too: what is joined by it lies together.
    key = F.md5(F.to_json(F.struct(*by, "line"), {"ignoreNullFields": "false"}))
    uses = durable_table(arcs(rows, by).withColumn("key", key))
    n = uses.agg(F.sum(F.size("line"))).first()[0] or 0
    distinct = by_size(uses.select(*by, "key", "line"), ["key"], n).groupBy(*by, "key").agg(F.first("line").alias("line"))

    def udf(lines: pa.Array) -> pa.Array:
        from chronogeo.operators.topology import vertex_weights

        return pa.array([vertex_weights([(p["x"], p["y"]) for p in line]) for line in lines.to_pylist()], pa.list_(pa.float64()))

    distinct = durable_table(distinct.withColumn("w", F.arrow_udf(udf, WEIGHTS)("line")))
    used = by_size(uses.select(*by, *RING, "arc", "arcs", "turned", "key"), ["key"], n)
    weighed = durable_table(used.join(by_size(distinct.select("key", "line", "w"), ["key"], n), "key"))
    if isinstance(share, Column):
        own = by_size(weighed.select("_uid", "w"), ["_uid"], n).groupBy("_uid").agg(F.sort_array(F.flatten(F.collect_list("w"))).alias("_w")).join(rows.select(F.col("_uid").alias("r_uid"), "_share"), F.col("_uid") == F.col("r_uid"))  # of one feature
        own = own.select(F.col("_uid").alias("o_uid"), F.get("_w", F.greatest(F.ceil((1 - F.col("_share")) * F.size("_w")).cast("int"), F.lit(1)) - 1).alias("t"))
        least = by_size(weighed.join(own, F.col("_uid") == F.col("o_uid")).select("key", "t"), ["key"], n).groupBy("key").agg(F.min("t").alias("t"))
        weighed = by_size(weighed, ["key"], n).join(least, "key", "left")
    else:
        least = distinct.select(*by, F.explode("w").alias("v")).groupBy(*_named(by, "t")).agg(F.percentile_approx("v", 1 - share, 100_000).alias("t"))
        weighed = weighed.join(least, _same(by, "t"), "left")
    # A ring of one arc needs two inner points, one of two arcs needs one: that with the greatest weight.
    heaviest = F.row_number().over(Window.partitionBy(*RING).orderBy(F.desc(F.array_max("w")), "key"))
    few = by_size(weighed.filter("arcs < 3"), RING, n).withColumn("need", F.when(F.col("arcs") == 1, 2).when(heaviest == 1, 1).otherwise(0))
    needs = by_size(few.select("key", "need"), ["key"], n).groupBy("key").agg(F.max("need").alias("need"))
    kept = by_size(weighed, ["key"], n).join(needs, "key", "left")
    bound = F.least("t", F.get(F.sort_array("w", asc=False), F.coalesce("need", F.lit(0)) - 1))
    kept = kept.withColumn("t", F.when(F.coalesce("need", F.lit(0)) > 0, bound).otherwise(F.col("t")))
    inner = F.filter("line", lambda p, i: (i == 0) | (i == F.size("line") - 1) | (F.get(F.col("w"), i - 1) >= F.col("t")))
    part = F.when(F.col("turned"), F.reverse(inner)).otherwise(inner)
    kept = by_size(kept.select(*RING, "arc", F.slice(part, F.lit(1), F.size(part) - 1).alias("part")), ["_uid"], n)  # its last point begins the next
    rings = kept.groupBy(*RING).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("arc", "part"))), lambda x: x["part"])).alias("r"))
    closed = F.transform(F.concat("r", F.slice("r", 1, 1)), lambda p: F.array(p["x"], p["y"]))
    ordered = lambda value, at: F.transform(F.array_sort(F.collect_list(F.struct(at, value))), lambda x: x[value])
    parts = rings.withColumn("r", closed).filter(F.size("r") > 3).groupBy("_uid", "_part").agg(ordered("r", "_ring").alias("p"))
    shapes = parts.groupBy(F.col("_uid").alias("s_uid")).agg(ordered("p", "_part").alias("s_coords"))
    names = [F.col("s_coords").alias(c) if c == "coords" else F.col(c) for c in layer.columns]
    return by_size(rows, ["_uid"], n).join(shapes, F.col("_uid") == F.col("s_uid")).select(*names)


def _in_cells(sides: DataFrame, size: Column) -> DataFrame:
    """Sides once for each cell of a grid that they cross, with a little around it: columns cx and cy."""
    reach = F.lit(NEAR)
    low, high = F.least("x1", "x2"), F.greatest("x1", "x2")
    cell = lambda v: F.floor(v / size).cast("bigint")
    rows = sides.withColumn("cx", F.explode(F.sequence(cell(low - reach), cell(high + reach))))
    share = lambda x: F.least(F.greatest((x - F.col("x1")) / (F.col("x2") - F.col("x1")), F.lit(0.0)), F.lit(1.0))
    at = lambda x: F.when(F.col("x1") == F.col("x2"), F.col("y1")).otherwise(F.col("y1") + share(x) * (F.col("y2") - F.col("y1")))
    upright = F.col("x1") == F.col("x2")
    a, b = at(F.col("cx") * size - reach), at((F.col("cx") + 1) * size + reach)
    bottom = F.when(upright, F.least("y1", "y2")).otherwise(F.least(a, b)) - 2 * reach
    top = F.when(upright, F.greatest("y1", "y2")).otherwise(F.greatest(a, b)) + 2 * reach
    return rows.withColumn("cy", F.explode(F.sequence(cell(bottom), cell(top))))


def dealt(sides: DataFrame, by: list[str], crowd: int = CROWD) -> DataFrame:
    """Sides with level, cx, cy: the cells of a grid that they cross, crowded ones divided."""
    shape = sides.agg(F.count(F.lit(1)).alias("n"), F.avg(F.greatest(F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1")))).alias("mean")).first()
    size = max(2 * (shape["mean"] or 1.0), 1e-5)
    rows, done = durable_table(_in_cells(sides, F.lit(size)).withColumn("level", F.lit(0))), []
    for level in range(DEPTH + 1):
        full = rows.groupBy(*_named(by, "f"), F.col("cx").alias("f_cx"), F.col("cy").alias("f_cy")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > crowd)
        if level == DEPTH or full.isEmpty():
            done.append(rows)
            break
        on = _same([*by, "cx", "cy"], "f")
        done.append(rows.join(full, on, "left_anti"))
        size /= PARTS
        finer = rows.join(full, on, "left_semi").withColumnsRenamed({"cx": "up_x", "cy": "up_y"})
        finer = _in_cells(finer, F.lit(size)).filter((F.floor(F.col("cx") / PARTS) == F.col("up_x")) & (F.floor(F.col("cy") / PARTS) == F.col("up_y")))
        rows = durable_table(finer.drop("up_x", "up_y").withColumn("level", F.lit(level + 1)))
    return reduce(lambda a, b: a.unionByName(b), done)


def meetings(sides: DataFrame, by: list[str], crowd: int = CROWD) -> DataFrame:
    """m_sid, p: the points, besides its ends, in which a side (sid, x1, y1, x2, y2) meets others of its group."""
    # Sides that neighbours share are compared with others once, by the least number of them.
    turned = edges.normalised(sides.select(*by, "sid", *edges.EDGE))
    once = durable_table(turned.groupBy(*by, *edges.EDGE).agg(F.min("sid").alias("sid"), F.collect_list("sid").alias("sids")))  # of one side
    cells = dealt(once.select(*by, "sid", "x1", "y1", "x2", "y2"), by, crowd)
    own = ["level", "cx", "cy"]
    a = cells.select(*_named([*by, *own], "a"), *[F.col(c).alias(f"a_{c}") for c in ("sid", "x1", "y1", "x2", "y2")])
    on = _same([*by, *own], "a") & (F.col("a_sid") < F.col("sid"))
    reach = lambda x, y: (F.least(f"a_{x}", f"a_{y}") <= F.greatest(x, y) + NEAR) & (F.greatest(f"a_{x}", f"a_{y}") >= F.least(x, y) - NEAR)
    pairs = cells.join(a, on & reach("x1", "x2") & reach("y1", "y2"))
    dx, dy, ax, ay = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), F.col("a_x2") - F.col("a_x1"), F.col("a_y2") - F.col("a_y1")
    length, a_length = F.sqrt(dx * dx + dy * dy), F.sqrt(ax * ax + ay * ay)
    off = lambda x, y: dx * (y - F.col("y1")) - dy * (x - F.col("x1"))  # noqa: E731  twice the area under a point, from this side
    a_off = lambda x, y: ax * (y - F.col("a_y1")) - ay * (x - F.col("a_x1"))
    spot = lambda sid, x, y: F.struct(F.col(sid).alias("m_sid"), F.struct(x.alias("x"), y.alias("y")).alias("p"))

    def lies_on(x: Column, y: Column, of: str, area: Column, long: Column) -> Column:
        """A point on a side, at neither of its ends."""
        x1, y1, x2, y2 = (F.col(f"{of}{c}") for c in ("x1", "y1", "x2", "y2"))
        within = (x >= F.least(x1, x2) - NEAR) & (x <= F.greatest(x1, x2) + NEAR) & (y >= F.least(y1, y2) - NEAR) & (y <= F.greatest(y1, y2) + NEAR)
        return (F.abs(area) <= NEAR * long) & within & ~((x == x1) & (y == y1)) & ~((x == x2) & (y == y2))

    found = []
    for k in ("1", "2"):
        x, y = F.col(f"a_x{k}"), F.col(f"a_y{k}")
        found.append(F.when(lies_on(x, y, "", off(x, y), length), spot("sid", x, y)))
        x, y = F.col(f"x{k}"), F.col(f"y{k}")
        found.append(F.when(lies_on(x, y, "a_", a_off(x, y), a_length), spot("a_sid", x, y)))
    clear = lambda area, long: F.abs(area) > NEAR * long
    p, q = off(F.col("a_x1"), F.col("a_y1")), off(F.col("a_x2"), F.col("a_y2"))
    r, s = a_off(F.col("x1"), F.col("y1")), a_off(F.col("x2"), F.col("y2"))
    cross = (p * q < 0) & (r * s < 0) & clear(p, length) & clear(q, length) & clear(r, a_length) & clear(s, a_length)
    share = p / (p - q)
    x, y = F.round(F.col("a_x1") + share * ax, PRECISION), F.round(F.col("a_y1") + share * ay, PRECISION)
    found += [F.when(cross, spot("sid", x, y)), F.when(cross, spot("a_sid", x, y))]
    places = pairs.select(F.explode(F.filter(F.array(*found), lambda v: v.isNotNull())).alias("m")).select("m.*").distinct()
    return places.join(once.select("sid", "sids"), F.col("m_sid") == F.col("sid")).select(F.explode("sids").alias("m_sid"), "p")


def noded(sides: DataFrame, by: list[str], crowd: int = CROWD) -> DataFrame:
    """The sides (by, x1, y1, x2, y2 and others) in pieces between the points in which they meet others of their group."""
    names = sides.columns
    sides = sides.withColumns({c: F.round(c, PRECISION) + F.lit(0.0) for c in edges.EDGE}).filter("x1 <> x2 OR y1 <> y2")
    sides = durable_table(sides.withColumn("sid", F.monotonically_increasing_id()))
    cuts = meetings(sides, by, crowd).groupBy("m_sid").agg(F.collect_list("p").alias("cuts"))  # on one side
    along = lambda p: (p["x"] - F.col("x1")) * (F.col("x2") - F.col("x1")) + (p["y"] - F.col("y1")) * (F.col("y2") - F.col("y1"))
    point = lambda k: F.struct(F.col(f"x{k}").alias("x"), F.col(f"y{k}").alias("y"))
    rows = sides.join(cuts, F.col("sid") == F.col("m_sid"), "left")
    ordered = F.transform(F.array_sort(F.transform("cuts", lambda p: F.struct(along(p).alias("t"), p.alias("p")))), lambda s: s["p"])
    rows = rows.withColumn("_path", F.concat(F.array(point(1)), F.coalesce(ordered, F.array().cast("array<struct<x:double,y:double>>")), F.array(point(2))))
    steps = F.transform(F.sequence(F.lit(1), F.size("_path") - 1), lambda i: F.struct(F.element_at("_path", i).alias("a"), F.element_at("_path", i + 1).alias("b")))
    rows = rows.select(*[c for c in names if c not in edges.EDGE], F.inline(steps))
    return rows.select(*[c for c in names if c not in edges.EDGE], F.col("a.x").alias("x1"), F.col("a.y").alias("y1"), F.col("b.x").alias("x2"), F.col("b.y").alias("y2")).filter("x1 <> x2 OR y1 <> y2")


def boundaries(layer: DataFrame, by: list[str], keep: list[str], decimals: int = 7, crowd: int = CROWD) -> DataFrame:
    """by, keep, x1, y1, x2, y2: each feature's outline in pieces that neighbours of the same group share exactly, lesser end first.

    A piece that a feature has an even number of times has the feature on both of its sides, or on none, and is no outline.
    """
    from chronogeo.operators.lines import polygon_edges

    rows = durable_table(layer.filter("coords IS NOT NULL").select(*by, *keep, "coords", F.monotonically_increasing_id().alias("_uid")))
    pieces = edges.normalised(noded(polygon_edges(rows, [*by, *keep, "_uid"]), by, crowd), decimals).filter("x1 <> x2 OR y1 <> y2")
    counted = pieces.groupBy(*by, *keep, "_uid", *edges.EDGE).agg(F.count(F.lit(1)).alias("n"))
    return counted.filter(F.col("n") % 2 == 1).drop("_uid", "n")
