"""Segments and shared edges of lines and polygons, as relational operators.

An edge has columns x1, y1, x2, y2. Normalised edges are written in one fixed
direction, so equal borders of neighbours compare equal.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronogeo.functions import geo
from chronogeo.operators import temporal

# Border types, strongest first, and the greatest zoom of region borders.
BORDER_TYPES = {"region": 1, "subregion": 2, "nation": 3, "province": 4, "district": 5}
REGION_MAXZOOM = 5
EDGE = ("x1", "y1", "x2", "y2")


def vertices(layer: DataFrame, key: list[str], geom: str = "geom") -> DataFrame:
    """key, part, ring, seq, lng, lat of every vertex of a layer's geometries."""
    parts = layer.select(*key, F.posexplode(F.col(f"{geom}.coords")).alias("part", "_rings"))
    rings = parts.select(*key, "part", F.posexplode("_rings").alias("ring", "_points"))
    points = rings.select(*key, "part", "ring", F.posexplode("_points").alias("seq", "_p"))
    return points.select(*key, "part", "ring", "seq", F.col("_p")[0].alias("lng"), F.col("_p")[1].alias("lat"))


def segments(points: DataFrame, line: list[str], order: str, x: str = "lng", y: str = "lat") -> DataFrame:
    """Each vertex with the next one of its line."""
    w = Window.partitionBy(*line).orderBy(order)
    out = points.select(*line, order, F.col(x).alias("x1"), F.col(y).alias("y1"), F.lead(x).over(w).alias("x2"), F.lead(y).over(w).alias("y2"))
    return out.filter("x2 IS NOT NULL")


def normalised(edges: DataFrame, decimals: int | None = None, wrap: bool = False) -> DataFrame:
    """Edges rounded (half up), optionally with wrapped longitudes, in ascending direction."""
    out = edges
    if wrap:
        out = out.withColumn("x1", geo.wrap_lng(F.col("x1"))).withColumn("x2", geo.wrap_lng(F.col("x2")))
    if decimals is not None:
        out = out.withColumns({c: F.round(c, decimals) for c in EDGE})
    a, b = F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y"))
    out = out.withColumn("_a", F.least(a, b)).withColumn("_b", F.greatest(a, b))
    return out.withColumns({"x1": F.col("_a.x"), "y1": F.col("_a.y"), "x2": F.col("_b.x"), "y2": F.col("_b.y")}).drop("_a", "_b")


def edge_kinds(edges: DataFrame, within: list[str] | None = None) -> DataFrame:
    """Distinct edges (per value of within) with kind: inner if two or more polygons have them, else outer."""
    keys = [*(within or []), *EDGE]
    counted = edges.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(*keys, F.when(F.col("n") > 1, "inner").otherwise("outer").alias("kind"))


def inner_lines(edges: DataFrame, within: list[str] | None = None) -> DataFrame:
    return edge_kinds(edges, within).filter("kind = 'inner'").drop("kind")


def outline(edges: DataFrame, key: list[str]) -> DataFrame:
    """Edges on the outside of the polygons of each key: what is left when these dissolve."""
    return edge_kinds(edges, key).filter("kind = 'outer'").drop("kind")


def border_key(primary: str, other: str) -> Column:
    """The primary name, or the other where that is missing or empty."""
    return F.coalesce(F.nullif(F.col(primary), F.lit("")), F.nullif(F.col(other), F.lit("")))


def merge_borders(layers: dict[str, DataFrame], decimals: int = 7) -> DataFrame:
    """Border edges of all layers with the strongest type per time; region borders stay apart, with a greatest zoom.

    layers: border kind -> edges with time_start, time_end.
    """
    typed = [normalised(x, decimals).select(*EDGE, "time_start", "time_end", F.lit(BORDER_TYPES[k]).alias("border_type")) for k, x in layers.items()]
    every = reduce(DataFrame.unionByName, typed)
    strongest = temporal.range_merge(every.filter(F.col("border_type") != BORDER_TYPES["region"]), list(EDGE), "border_type").withColumnRenamed("value", "border_type").withColumn("maxzoom", F.lit(None).cast("int"))
    regions = temporal.coalesce_time(every.filter(F.col("border_type") == BORDER_TYPES["region"]), [*EDGE, "border_type"]).withColumn("maxzoom", F.lit(REGION_MAXZOOM))
    return strongest.unionByName(regions)


def nodes(segs: DataFrame, width: str = "width", smooth: str = "smooth") -> DataFrame:
    """Graph nodes of line segments: width (greatest), smooth (all), degree (parallel segments count each)."""
    ends = segs.select(F.explode(F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")))).alias("p"), width, smooth)
    return ends.groupBy(F.col("p.x").alias("x"), F.col("p.y").alias("y")).agg(F.max(width).alias("width"), F.bool_and(smooth).alias("smooth"), F.count(F.lit(1)).alias("degree"))


def neighbours(segs: DataFrame) -> DataFrame:
    """x, y, to_x, to_y: each node with each node that a segment joins it to, once."""
    there = segs.select(F.col("x1").alias("x"), F.col("y1").alias("y"), F.col("x2").alias("to_x"), F.col("y2").alias("to_y"))
    back = segs.select(F.col("x2").alias("x"), F.col("y2").alias("y"), F.col("x1").alias("to_x"), F.col("y1").alias("to_y"))
    return there.unionByName(back).distinct()


def node_order(lng: Column, lat: Column) -> Column:
    """Number by which nodes are sorted: south to north, west to east."""
    return lat * 400 + lng


def springs(node_rows: DataFrame, on_land: DataFrame) -> DataFrame:
    """Nodes of degree 1 that are points on land (x, y)."""
    return node_rows.filter("degree = 1").join(on_land.select("x", "y"), ["x", "y"], "left_semi")


def chain_distance(points: DataFrame, line: list[str], order: str) -> DataFrame:
    """Metres along a line up to each vertex."""
    w = Window.partitionBy(*line).orderBy(order)
    step = geo.haversine_m(F.lag("lng").over(w), F.lag("lat").over(w), F.col("lng"), F.col("lat"))
    return points.withColumn("_step", F.coalesce(step, F.lit(0.0))).withColumn("metres", F.sum("_step").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_step")


def turn_angles(points: DataFrame, line: list[str], order: str) -> DataFrame:
    """Angle at each inner vertex of a line."""
    w = Window.partitionBy(*line).orderBy(order)
    angle = geo.angle_of_three(F.lag("lng").over(w), F.lag("lat").over(w), F.col("lng"), F.col("lat"), F.lead("lng").over(w), F.lead("lat").over(w))
    return points.withColumn("angle", angle).filter("angle IS NOT NULL")


def bounding_boxes(points: DataFrame, key: list[str]) -> DataFrame:
    """bbox array of each key: two numbers for a single point, else four."""
    box = points.groupBy(*key).agg(F.min("lng").alias("w"), F.min("lat").alias("s"), F.max("lng").alias("e"), F.max("lat").alias("n"))
    one = (F.col("w") == F.col("e")) & (F.col("s") == F.col("n"))
    return box.select(*key, F.when(one, F.array("w", "s")).otherwise(F.array("w", "s", "e", "n")).alias("bbox"))


def ring_vertex_count(coords: Column) -> Column:
    """Vertices of a polygon geometry without the closing points."""
    return F.aggregate(F.flatten(coords), F.lit(0), lambda a, ring: a + F.size(ring) - 1)


def inverted(coords: Column, west: float = -138.0, east: float = 222.0) -> Column:
    """A polygon's complement in the working window: the world ring first, its rings reversed."""
    corner = lambda x, y: F.array(F.lit(x), F.lit(y))
    world = F.array(corner(west, -90.0), corner(east, -90.0), corner(east, 90.0), corner(west, 90.0), corner(west, -90.0))
    return F.array(F.concat(F.array(world), F.transform(F.flatten(coords), lambda r: F.reverse(r))))


def geometry_type(coords: Column) -> Column:
    """Type of a geometry by its shape: single points, closed rings, and all else lines."""
    rings = F.flatten(coords)
    points = F.forall(rings, lambda r: F.size(r) == 1)
    closed = F.forall(rings, lambda r: (F.size(r) >= 4) & (F.get(r, F.lit(0)) == F.get(r, F.size(r) - 1)))
    several = lambda n, name: F.when(n > 1, F.lit("Multi" + name)).otherwise(F.lit(name))
    return F.when(F.size(rings) > 0, F.when(points, several(F.size(rings), "Point")).when(closed, several(F.size(coords), "Polygon")).otherwise(several(F.size(rings), "LineString")))


def map_points(coords: Column, f) -> Column:
    """Every point of a geometry through a function of its x and y."""
    return F.transform(coords, lambda part: F.transform(part, lambda ring: F.transform(ring, lambda p: F.array(*f(p[0], p[1])))))


def insert_point(line: Column, at: Column | int, point: Column) -> Column:
    """An array of points with one more at a place, counted from 1."""
    return F.array_insert(line, at if isinstance(at, Column) else F.lit(at), point)


def drop_holes(coords: Column) -> Column:
    return F.transform(coords, lambda p: F.slice(p, 1, 1))


def unshifted(coords: Column) -> Column:
    """Geometries wholly beyond the antimeridian moved back by one turn."""
    points = F.flatten(F.flatten(coords))
    by = F.when(F.forall(points, lambda p: p[0] > 180), -360.0).when(F.forall(points, lambda p: p[0] < -180), 360.0).otherwise(0.0)
    return map_points(coords, lambda x, y: (x + by, y))
