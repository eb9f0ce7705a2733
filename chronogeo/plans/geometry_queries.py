"""Registered queries of the geometric steps, on unit cells whose overlays SQL can count.

Cells are the parts of ``f_cells``; a band of 20 rows of the grid is a time
slice, so that a step's groups stay alike in size however large the table is.
Geometries are compared by area, length and counts, which don't depend on
where a ring begins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronogeo.functions import colors, geo
from chronogeo.functions.geo import planar_area
from chronogeo.operators import derive, edges, lines, overlay, shapes, topology
from chronogeo.plans.queries import VIEWS, query
from chronogeo.plans.steps import Context, _merge_lines, run_step
from chronogeo.session import spread

BAND = 20
VIEWS["f_bands"] = f"SELECT fid, key, x, y, CAST(floor(y / {BAND}e0) AS INT) AS time_start, CAST(floor(y / {BAND}e0) AS INT) + 1 AS time_end FROM f_cells"
VIEWS["f_sides"] = f"SELECT e.fid, e.key, e.x1, e.y1, e.x2, e.y2, b.time_start, b.time_end FROM f_edges e JOIN f_bands b ON e.fid = b.fid"


def square(x, y, size: float = 1.0) -> Column:
    """coords of a square with its least corner at x, y."""
    x, y = x.cast("double"), y.cast("double")
    ring = [F.array(a, b) for a, b in ((x, y), (x + size, y), (x + size, y + size), (x, y + size), (x, y))]
    return F.array(F.array(F.array(*ring)))


def planar_length(coords: Column) -> Column:
    step = lambda r, i: F.sqrt(F.pow(r[i][0] - r[i - 1][0], 2) + F.pow(r[i][1] - r[i - 1][1], 2))
    length = lambda r: F.aggregate(F.sequence(F.lit(1), F.size(r) - 1), F.lit(0.0), lambda a, i: a + step(r, i))
    return F.aggregate(F.transform(F.flatten(coords), length), F.lit(0.0), lambda a, x: a + x)


def _cells(get, shift: float = 0.0) -> DataFrame:
    return get("f_bands").withColumn("coords", square(F.col("x") + F.lit(shift), F.col("y")))


def _borders_layer(get) -> DataFrame:
    return _cells(get).select(F.col("key").alias("nation"), F.lit("").alias("subregion"), F.col("key").alias("region"), F.col("fid").cast("string").alias("province"), "coords", "time_start", "time_end")


#: Where the land of the grid ends, to the east, in the middle of cells.
LAND_EAST = 9.5


def _land(get) -> DataFrame:
    """The west of the grid: all cells up to the middle of one column."""
    size = float(1 << 24)
    return get("region").filter("r_regionkey = 0").select(square(F.lit(LAND_EAST - size), F.lit(-1.0), size).alias("coords"))


def _step(layer: DataFrame, name: str, **parameters) -> DataFrame:
    more = {k: parameters.pop(k) for k in list(parameters) if isinstance(parameters[k], DataFrame)}
    return run_step(Context(layer.sparkSession, max_zoom=5), name, {"in": layer} | more, **parameters)


def _areas(layer: DataFrame, *keys: str) -> DataFrame:
    return layer.groupBy(*keys).agg(F.round(F.sum(planar_area(F.col("coords"))), 6).alias("area"))


def _lengths(layer: DataFrame, *keys: str) -> DataFrame:
    return layer.groupBy(*keys).agg(F.round(F.sum(planar_length(F.col("coords"))), 6).alias("length"))


_BESIDE = "f_bands c LEFT JOIN f_bands d ON d.key = c.key AND d.x = c.x - 1 AND d.y = c.y"


@query("dissolve", "SELECT a.key, a.area, b.length FROM (SELECT key, CAST(count(*) AS DOUBLE) AS area FROM f_cells GROUP BY key) a JOIN (SELECT key, CAST(count(*) AS DOUBLE) AS length FROM (SELECT key FROM f_edges GROUP BY key, x1, y1, x2, y2 HAVING count(*) = 1) GROUP BY key) b ON a.key = b.key")
def _(get):
    rows = _cells(get)
    whole = overlay.dissolve_tiled(rows, ["key"], overlay.tile_size([rows], ["key"], 2_000))
    return whole.select("key", F.round(planar_area(F.col("coords")), 6).alias("area"), F.round(planar_length(F.col("coords")), 6).alias("length"))


@query("clip_polygons", f"SELECT c.fid, CASE WHEN d.fid IS NULL THEN 0.5e0 ELSE 1e0 END AS area FROM {_BESIDE}")
def _(get):
    by = ["key", "time_start"]
    cut = overlay.clip(_cells(get), _cells(get, 0.5).select(*by, "coords"), by)
    return cut.select("fid", F.round(planar_area(F.col("coords")), 6).alias("area"))


@query("erase_polygons", f"SELECT c.fid, 0.5e0 AS area FROM {_BESIDE} WHERE d.fid IS NULL")
def _(get):
    by = ["key", "time_start"]
    cut = overlay.erase(_cells(get), _cells(get, 0.5).select(*by, "coords"), by)
    return cut.select("fid", F.round(planar_area(F.col("coords")), 6).alias("area"))


_N = f"n AS (SELECT c.key, c.time_start, CAST(count(*) AS DOUBLE) AS n, CAST(count(d.fid) AS DOUBLE) AS m FROM {_BESIDE} GROUP BY c.key, c.time_start)"


@query("mosaic", f"WITH {_N} SELECT * FROM (SELECT key, time_start, '0,1' AS covers, n / 2 + m / 2 AS area FROM n UNION ALL SELECT key, time_start, '0', n / 2 - m / 2 FROM n UNION ALL SELECT key, time_start, '1', n / 2 - m / 2 FROM n) WHERE area > 0")
def _(get):
    by = ["key", "time_start"]
    layers = [overlay.dissolve(_cells(get, 0.5 * k), by).withColumn("ord", F.lit(k).cast("bigint")) for k in (0, 1)]
    cells = overlay.mosaic(layers[0].unionByName(layers[1]), by)
    return cells.select(*by, F.array_join("covers", ",").alias("covers"), F.round(planar_area(F.col("coords")), 6).alias("area"))


@query("buffer_area", "SELECT fid, round(1 + 4 * 0.25 + 10 * 0.0625 * sin(2 * 3.141592653589793 / 20), 4) AS area FROM f_cells")
def _(get):
    grown = shapes.buffered(F.col("coords"), 0.25, 5)
    return spread(_cells(get)).select("fid", F.round(planar_area(grown), 4).alias("area"))


@query("buffer_inwards", "SELECT fid, 0.25e0 AS area FROM f_cells")
def _(get):
    return spread(_cells(get)).select("fid", F.round(planar_area(shapes.buffered(F.col("coords"), -0.25, 5)), 4).alias("area"))


@query("explode_parts", "SELECT fid, key, 1e0 AS area FROM f_cells UNION ALL SELECT fid, key, 1e0 FROM f_cells")
def _(get):
    two = _cells(get).withColumn("coords", F.concat("coords", square(F.col("x") + 100, F.col("y"))))
    return overlay.exploded(two).select("fid", "key", F.round(planar_area(F.col("coords")), 6).alias("area"))


@query("ring_vertices", "SELECT fid, 4 AS vertices, 1 AS rings, 2 AS inverted_rings FROM f_cells")
def _(get):
    coords = F.col("coords")
    return _cells(get).select("fid", edges.ring_vertex_count(coords).cast("int").alias("vertices"), F.size(F.flatten(edges.drop_holes(coords))).alias("rings"), F.size(F.flatten(edges.inverted(coords))).alias("inverted_rings"))


@query("provinces", "SELECT CAST(fid AS VARCHAR(20)) AS label, time_start, 1e0 AS area FROM f_bands")
def _(get):
    return _areas(_step(_borders_layer(get), "BORDER_VARIANTS__PROVINCES"), "label", "time_start")


def _areal(step: str, sql: str):
    @query(step.rsplit("__", 1)[-1].lower(), sql)
    def _(get):
        return _areas(_step(_borders_layer(get), step), "label", "time_start")


_BY_KEY = "SELECT key AS label, time_start, CAST(count(*) AS DOUBLE) AS area FROM f_bands GROUP BY key, time_start"
_areal("BORDER_VARIANTS__NATIONS", _BY_KEY)
_areal("BORDER_VARIANTS__REGIONS", _BY_KEY)


@query("subregions", "SELECT 's' || (fid % 3) AS label, time_start, CAST(count(*) AS DOUBLE) AS area FROM f_bands WHERE fid % 3 > 0 GROUP BY 's' || (fid % 3), time_start")
def _(get):
    part = F.when(F.col("fid") % 3 > 0, F.concat(F.lit("s"), (F.col("fid") % 3).cast("string"))).otherwise("")
    layer = _cells(get).select(F.col("key").alias("nation"), part.alias("subregion"), F.col("key").alias("region"), "coords", "time_start", "time_end")
    return _areas(_step(layer, "BORDER_VARIANTS__SUBREGIONS"), "label", "time_start")


_SHARED = "SELECT time_start, x1, y1, x2, y2, count(*) AS n, count(DISTINCT key) AS k FROM f_sides GROUP BY time_start, x1, y1, x2, y2"


#: Length of an edge on land: west-east ones are cut, others lie on one side.
_ON_LAND = f"CASE WHEN x1 < x2 THEN greatest(least(x2, {LAND_EAST}e0) - x1, 0) WHEN x1 < {LAND_EAST} THEN 1e0 ELSE 0e0 END"


@query("nation_borders", f"SELECT time_start, sum(CASE WHEN n = 1 THEN {_ON_LAND} ELSE 1 END) AS length FROM ({_SHARED}) s WHERE n = 1 OR k = 2 GROUP BY time_start HAVING sum(CASE WHEN n = 1 THEN {_ON_LAND} ELSE 1 END) > 0")
def _(get):
    return _lengths(_step(_borders_layer(get), "BORDER_VARIANTS__NATION_BORDERS", land_without_water=_land(get)), "time_start")


@query("subregion_borders", f"SELECT time_start, sum(CASE WHEN n = 1 THEN {_ON_LAND} ELSE 1 END) AS length FROM ({_SHARED}) s WHERE n = 1 OR k = 2 GROUP BY time_start HAVING sum(CASE WHEN n = 1 THEN {_ON_LAND} ELSE 1 END) > 0")
def _(get):
    return _lengths(_step(_borders_layer(get), "BORDER_VARIANTS__SUBREGION_BORDERS", land_without_water=_land(get)), "time_start")


@query("region_borders", f"SELECT time_start, CAST(count(*) AS DOUBLE) AS length FROM ({_SHARED}) s WHERE k = 2 GROUP BY time_start")
def _(get):
    return _lengths(_step(_borders_layer(get), "BORDER_VARIANTS__REGION_BORDERS"), "time_start")


@query("province_borders", f"SELECT time_start, sum({_ON_LAND}) AS length FROM ({_SHARED}) s WHERE n = 2 AND k = 1 GROUP BY time_start HAVING sum({_ON_LAND}) > 0")
def _(get):
    return _lengths(_step(_borders_layer(get), "BORDER_VARIANTS__PROVINCE_BORDERS", land_without_water=_land(get)), "time_start")


@query("district_borders", f"SELECT time_start, CAST(count(*) AS DOUBLE) AS length FROM ({_SHARED}) s GROUP BY time_start")
def _(get):
    return _lengths(_step(_borders_layer(get), "BORDER_VARIANTS__DISTRICT_BORDERS"), "time_start")


@query("city_polygons", "SELECT key AS labels, time_start, CAST(count(*) AS DOUBLE) AS area FROM f_bands GROUP BY key, time_start")
def _(get):
    return _areas(_step(_cells(get).select(F.col("key").alias("city"), "coords", "time_start", "time_end"), "CITY_POLYGONS"), "labels", "time_start")


def _some(get, remainder: int, shift: float = 0.0) -> DataFrame:
    return _cells(get, shift).filter(F.col("fid") % 2 == remainder).select("key", "coords", "time_start", "time_end")


@query("add_polygons", "SELECT time_start, CAST(count(*) AS DOUBLE) AS area FROM f_bands GROUP BY time_start")
def _(get):
    return _areas(_step(_some(get, 0), "ADD_POLYGONS", summand=_some(get, 1)), "time_start")


@query("subtract", "SELECT key, time_start, CAST(count(*) AS DOUBLE) AS area FROM f_bands WHERE fid % 2 = 1 GROUP BY key, time_start")
def _(get):
    rows = _cells(get).select("key", "coords", "time_start", "time_end")
    return _areas(_step(rows, "SUBTRACT", subtrahend=_some(get, 0), keepField="key"), "key", "time_start")


@query("clip_step", "SELECT key, time_start, CAST(count(*) AS DOUBLE) AS area FROM f_bands WHERE fid % 2 = 0 GROUP BY key, time_start")
def _(get):
    whole = _step(_cells(get).select(F.col("key").alias("city"), "coords", "time_start", "time_end"), "CITY_POLYGONS").select(F.col("city").alias("key"), "coords", "time_start", "time_end")
    return _areas(_step(whole, "CLIP", mask=_some(get, 0)), "key", "time_start")


@query("add_points", "SELECT fid, label FROM f_locations UNION ALL SELECT n_nationkey, n_name FROM nation")
def _(get):
    more = get("nation").select(F.col("n_nationkey").cast("bigint").alias("fid"), F.col("n_name").alias("label"))
    return _step(get("f_locations"), "ADD_POINTS", summand=more).select("fid", "label")


_ICE = "CASE WHEN fid % 2 = 0 THEN '#e1ecfd' WHEN fid % 3 <> 0 THEN '#fdfbf7' ELSE '#dae7fc' END"


@query("merge_geometry", f"SELECT layer_ord, color, time_start, CAST(count(*) AS DOUBLE) AS area FROM (SELECT 0 AS layer_ord, '#f8f1e1' AS color, time_start FROM f_bands WHERE fid % 3 <> 0 UNION ALL SELECT 1, '#8ab4f8', time_start FROM f_bands WHERE fid % 2 = 0 UNION ALL SELECT 2, {_ICE}, time_start FROM f_bands WHERE fid % 5 = 0) GROUP BY layer_ord, color, time_start")
def _(get):
    cells = _cells(get)
    layers = {name: cells.filter(where).select("coords", "time_start", "time_end") for name, where in (("land", "fid % 3 <> 0"), ("waters", "fid % 2 = 0"), ("ice", "fid % 5 = 0"))}
    return _areas(run_step(Context(cells.sparkSession), "MERGE_GEOMETRY", layers), "layer_ord", "color", "time_start")


@query("layer_colors", "SELECT * FROM (VALUES ('land', 248, 241, 225), ('districts', 212, 204, 185), ('deserts', 255, 247, 190), ('swamps', 183, 197, 188), ('mountains', 222, 212, 184), ('hills', 235, 227, 205), ('forests', 187, 226, 198), ('waters', 138, 180, 248), ('buildings', 119, 136, 153), ('roads', 185, 157, 92)) AS t(layer, r, g, b)")
def _(get):
    names = F.array(*[F.lit(x) for x in ("land", "districts", "deserts", "swamps", "mountains", "hills", "forests", "waters", "buildings", "roads")])
    rows = get("region").filter("r_regionkey = 0").select(F.explode(names).alias("layer"))
    return rows.withColumn("c", colors.layer_color(F.col("layer"))).select("layer", "c.r", "c.g", "c.b")


@query("prepare_export", "SELECT fid, CAST(least(size, 5) AS INT) AS tile_minzoom, 5 AS tile_maxzoom FROM f_locations")
def _(get):
    rows = get("f_locations").withColumn("minzoom", F.col("size")).withColumn("maxzoom", F.lit(None).cast("int"))
    meta = get("region").filter("r_regionkey = 0").select(F.lit(0).alias("id"), F.lit(None).cast("int").alias("slice_start"), F.lit(None).cast("int").alias("slice_end"))
    none = F.lit(None).cast("int")
    return derive.prepare_export(rows.withColumn("time_start", none).withColumn("time_end", none), meta, "fid", 5).select("fid", "export.*")


def _lines(get) -> DataFrame:
    point = F.struct("seq", F.array("lng", "lat").alias("p"))
    rows = get("f_vertices").groupBy("line_id").agg(F.array_sort(F.collect_list(point)).alias("v")).filter(F.size("v") > 1)
    return rows.select("line_id", F.array(F.array(F.col("v.p"))).alias("coords"))


@query("smooth_lines")
def _(get):
    return _lengths(_step(_lines(get), "SMOOTH_LINES"), "line_id")


@query("river_labels", "SELECT 'r' || (line_id % 1000) AS label, round(sum(sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))), 6) AS length FROM (SELECT line_id, lng AS x1, lat AS y1, lead(lng) OVER w AS x2, lead(lat) OVER w AS y2 FROM f_vertices WINDOW w AS (PARTITION BY line_id ORDER BY seq)) WHERE x2 IS NOT NULL GROUP BY ALL")
def _(get):
    return _lengths(_step(_lines(get).withColumn("label", F.concat(F.lit("r"), F.col("line_id") % 1000)), "RIVER_LABELS"), "label")


def _shrunk(get, size: float = 0.01) -> DataFrame:
    """Cells of a hundredth of a degree, within the range of latitudes of any table."""
    rows = get("f_bands")
    return rows.withColumn("coords", square(F.col("x") * size, F.pmod(F.col("y"), F.lit(8000)) * size, size)).select("fid", "key", "coords", "time_start", "time_end")


def _zone(lat: str) -> str:
    """Twice the area from the equator to a latitude, for a radian of longitude, in km2."""
    e, s = geo.ECCENTRICITY, f"sin(radians({lat}))"
    return f"({geo.AXIS_KM ** 2 * (1 - e * e)}e0 * ({s} / (1 - {e * e}e0 * {s} * {s}) + ln((1 + {e}e0 * {s}) / (1 - {e}e0 * {s})) / {2 * e}e0))"


_CELL_KM2 = f"(radians(1) / 2 * ({_zone('y % 80 + 1')} - {_zone('y % 80')}))"


@query("ellipsoid_area", f"SELECT fid, round({_CELL_KM2} * 0.75e0, 6) AS km2 FROM f_bands")
def _(get):
    """Cells with a hole of a quarter of their width, from their lower to their upper side."""
    x, y = F.col("x").cast("double"), F.pmod(F.col("y"), F.lit(80)).cast("double")
    box = lambda a, b: F.array(*[F.array(p, q) for p, q in ((x + a, y), (x + b, y), (x + b, y + 1), (x + a, y + 1), (x + a, y))])
    return get("f_bands").select("fid", F.round(geo.area_km2(F.array(F.array(box(0.0, 1.0), box(0.25, 0.5)))), 6).alias("km2"))


@query("label_centers", f"""WITH c AS (SELECT fid, CAST(floor(log2(10000 / sqrt({_CELL_KM2} / cos(radians(y % 80 + 0.5e0))))) AS INT) AS z FROM f_bands)
SELECT CAST(fid AS VARCHAR(20)) AS label, z AS minzoom, z + 3 AS maxzoom, 0e0 AS angle, 1 AS n FROM c UNION ALL SELECT CAST(fid AS VARCHAR(20)), z + 4, z + 7, 0e0, 4 FROM c WHERE floor((10 + 3 - z) / 4) >= 1 UNION ALL SELECT CAST(fid AS VARCHAR(20)), z + 8, z + 11, 0e0, 16 FROM c WHERE floor((10 + 3 - z) / 4) >= 2""")
def _(get):
    rows = get("f_bands").select(F.col("fid").cast("string").alias("label"), square(F.col("x"), F.pmod(F.col("y"), F.lit(80))).alias("coords"), "time_start", "time_end")
    found = run_step(Context(rows.sparkSession, max_zoom=10), "GENERATE_LABEL_CENTERS", {"in": rows})
    return found.groupBy("label", "minzoom", "maxzoom", "angle").agg(F.count(F.lit(1)).cast("int").alias("n"))


@query("label_order", f"WITH a AS (SELECT CAST(fid AS VARCHAR(20)) AS label, round({_CELL_KM2}, 6) AS km2 FROM f_bands) SELECT label, CAST(rank() OVER (ORDER BY km2 DESC) AS BIGINT) AS place FROM a")
def _(get):
    """The least number of all labels of the same area: the order of equal areas is that of their labels."""
    rows = get("f_bands").select(F.col("fid").cast("string").alias("label"), square(F.col("x"), F.pmod(F.col("y"), F.lit(80))).alias("coords"), "time_start", "time_end", "y")
    found = run_step(Context(rows.sparkSession, max_zoom=10), "GENERATE_LABEL_CENTERS", {"in": rows.drop("y")}, generateSubLabels=False)
    places = found.join(rows.select("label", F.pmod("y", F.lit(80)).alias("row")), "label")
    least = places.groupBy("row").agg(F.min("ord").alias("place"))
    return places.join(least, "row").select("label", "place")


@query("highlights")
def _(get):
    return _areas(_step(_shrunk(get).drop("key").withColumn("label", F.concat(F.lit("b"), "time_start")), "HIGHLIGHTS"), "label", "time_start")


@query("buffer_polygons")
def _(get):
    return _areas(_step(_shrunk(get), "BUFFER_POLYGONS"), "time_start")


_SIZE = 0.1
_RIVERS = f"""r AS (SELECT fid, x * {_SIZE} AS x, (y % 300) * {_SIZE} AS y, time_start, time_start + 1 + CAST(fid % 2 AS INT) AS time_end, CASE WHEN x < {LAND_EAST} AND fid % 3 > 0 THEN 0.1e0 ELSE 1e0 END AS u, CASE WHEN x < {LAND_EAST} AND fid % 3 = 1 THEN 0.1e0 ELSE 1e0 END AS v FROM f_bands),
m AS (SELECT *, 2000 * ((1 + 0.00001120378 * (cos(2 * radians(y + 0.5 * {_SIZE})) - 1)) / cos(radians(y + 0.5 * {_SIZE})) / 111319.491 / 2) AS half FROM r)"""
#: Area of a stretch with half widths at both ends, each with half a polygon of 20 corners as its cap.
_RIBBON = f"0.4e0 * {_SIZE} * (u + v) * half + 5 * sin(pi() / 10) * (u * u + v * v) * half * half"


def _short_lines(get) -> DataFrame:
    """One short line in the middle of each cell; every second one lives for two slices."""
    rows = get("f_bands").withColumn("time_end", F.col("time_end") + (F.col("fid") % 2).cast("int"))
    x, y = F.col("x") * _SIZE, F.pmod(F.col("y"), F.lit(300)) * _SIZE
    point = lambda dx: F.array(x + dx * _SIZE, y + 0.5 * _SIZE)
    return rows.select("fid", F.col("x").alias("column"), F.array(F.array(F.array(point(0.3), point(0.7)))).alias("coords"), F.lit(2000).alias("width"), "time_start", "time_end")


@query("shape_roads", f"WITH {_RIVERS} SELECT time_start, time_end, round(sum({_RIBBON.replace('u', '1').replace('v', '1')}), 6) AS area FROM m GROUP BY time_start, time_end")
def _(get):
    return _ribbon_areas(_step(_short_lines(get).drop("fid", "column"), "SHAPE_ROADS"))


def _ribbon_areas(layer: DataFrame) -> DataFrame:
    return layer.groupBy("time_start", "time_end").agg(F.round(F.sum(planar_area(F.col("coords"))), 6).alias("area"))


@query("shape_rivers", f"WITH {_RIVERS} SELECT time_start, time_end, round(sum({_RIBBON}), 6) AS area FROM m GROUP BY time_start, time_end")
def _(get):
    # On land, west of a line: all of a river (both ends are springs), or its beginning only, or nothing.
    rivers = _short_lines(get)
    span = F.when(F.col("fid") % 3 == 1, 1.0).when(F.col("fid") % 3 == 2, 0.5)
    x, y = F.col("coords")[0][0][0][0] - 0.3 * _SIZE, F.col("coords")[0][0][0][1] - 0.5 * _SIZE
    corner = lambda dx, dy: F.array(x + dx * _SIZE, y + dy * _SIZE)
    ring = F.array(corner(F.lit(0.0), 0), corner(span, 0), corner(span, 1), corner(F.lit(0.0), 1), corner(F.lit(0.0), 0))
    land = rivers.filter((F.col("column") < LAND_EAST) & span.isNotNull()).select(F.array(F.array(ring)).alias("coords"), "time_start", "time_end")
    return _ribbon_areas(_step(rivers.drop("fid", "column"), "SHAPE_RIVERS", land_without_water=land))


@query("fractal_detail", "WITH c AS (SELECT fid, x, y, floor(y / 40e0) AS b FROM f_cells) SELECT c.fid, CAST(33 - 7 * count(d.fid) AS INT) AS vertices FROM c LEFT JOIN c d ON d.b = c.b AND abs(d.x - c.x) + abs(d.y - c.y) = 1 GROUP BY c.fid")
def _(get):
    # Stacks of 40 rows go round the map; each has an offset of its own, so that stacks that come to lie on one another share no edge.
    stack = F.floor(F.col("y") / 40)
    west = F.col("x") + 0.5 + 21 * stack + stack * 1e-5
    cells = get("f_bands").withColumn("coords", square(west, F.pmod(F.col("y"), F.lit(40))))
    return _step(cells.select("fid", "coords", "time_start", "time_end"), "ADD_FRACTAL_DETAIL").select("fid", F.size(F.flatten(F.flatten("coords"))).alias("vertices"))


@query("pattern_pebbles")
def _(get):
    return _areas(_step(_shrunk(get, 0.001).withColumn("pattern", F.when(F.col("fid") % 10 == 0, "pebbles")).drop("key"), "RESOLVE_PATTERNS"), "fid")


@query("simplify_rings", "SELECT fid, 0.5e0 AS area FROM f_cells")
def _(get):
    """Each cell by itself (its number is a group), with a corner drawn in, so that of three removable points the two greatest stay."""
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    ring = [F.array(x + a, y + b) for a, b in ((0, 0), (1, 0), (0.75, 0.75), (0, 1), (0, 0))]
    cells = spread(get("f_bands")).select("fid", F.array(F.array(F.array(*ring))).alias("coords"))
    return topology.simplified(cells, 0.5, ["fid"]).select("fid", F.round(planar_area(F.col("coords")), 6).alias("area"))


#: Cells whose sides bulge by a number of the side, in 1024ths: sides of neighbours are the same arc.
_BULGES = {"v": "(1 + (7 * x + 13 * y) % 97) / 1024e0", "h": "(1 + (11 * x + 5 * y) % 89) / 1024e0"}


def _bulging(get) -> DataFrame:
    cells = spread(get("f_bands")).select("fid", "time_start", "x", "y")
    bulge = {k: lambda x, y, v=v: F.expr(v.replace("x", f"(x + {x})").replace("y", f"(y + {y})")).cast("double") for k, v in _BULGES.items()}
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    ring = [(x, y), (x + 0.5, y + bulge["h"](0, 0)), (x + 1, y), (x + 1 + bulge["v"](1, 0), y + 0.5), (x + 1, y + 1), (x + 0.5, y + 1 + bulge["h"](0, 1)), (x, y + 1), (x + bulge["v"](0, 0), y + 0.5), (x, y)]
    return cells.withColumn("coords", F.array(F.array(F.array(*[F.array(a, b) for a, b in ring]))))


_SIDES_OF = " UNION ".join(f"SELECT time_start, '{k}' AS k, x{dx} AS x, y{dy} AS y FROM f_bands" for k, dx, dy in (("v", "", ""), ("v", " + 1", ""), ("h", "", ""), ("h", "", " + 1")))
_KEPT_SIDES = f"""s AS (SELECT *, CASE WHEN k = 'v' THEN {_BULGES["v"]} ELSE {_BULGES["h"]} END AS w FROM ({_SIDES_OF}) u),
d AS (SELECT time_start, x, y, count(*) AS n FROM (SELECT time_start, x, y FROM s UNION ALL SELECT time_start, CASE WHEN k = 'v' THEN x ELSE x + 1 END, CASE WHEN k = 'v' THEN y + 1 ELSE y END FROM s) e GROUP BY ALL),
lone AS (SELECT c.time_start, c.x, c.y FROM f_bands c JOIN d ON d.time_start = c.time_start AND d.x BETWEEN c.x AND c.x + 1 AND d.y BETWEEN c.y AND c.y + 1 GROUP BY ALL HAVING max(n) = 2),
t AS (SELECT time_start, quantile_disc(w, 0.5) AS t FROM (SELECT time_start, w FROM s UNION ALL SELECT d.time_start, 9e0 FROM d LEFT JOIN lone USING (time_start, x, y) WHERE n = 2 AND lone.x IS NULL) w GROUP BY time_start),
kept AS (SELECT s.time_start, k, x, y, CASE WHEN w >= t THEN 1 ELSE 0 END AS kept, CASE WHEN w >= t THEN w / 2 ELSE 0e0 END AS part FROM s JOIN t ON s.time_start = t.time_start)"""


@query("simplify_shared", f"""WITH {_KEPT_SIDES}
SELECT c.fid, CAST(4 + l.kept + r.kept + b.kept + a.kept AS INT) AS vertices, round(1 - l.part + r.part - b.part + a.part, 6) AS area FROM f_bands c
JOIN kept l ON l.time_start = c.time_start AND l.k = 'v' AND l.x = c.x AND l.y = c.y JOIN kept r ON r.time_start = c.time_start AND r.k = 'v' AND r.x = c.x + 1 AND r.y = c.y
JOIN kept b ON b.time_start = c.time_start AND b.k = 'h' AND b.x = c.x AND b.y = c.y JOIN kept a ON a.time_start = c.time_start AND a.k = 'h' AND a.x = c.x AND a.y = c.y + 1""")
def _(get):
    thin = topology.simplified(_bulging(get), 0.5, ["time_start"])
    return thin.select("fid", edges.ring_vertex_count(F.col("coords")).cast("int").alias("vertices"), F.round(planar_area(F.col("coords")), 6).alias("area"))


@query("simplify_shared_edges", f"""WITH {_KEPT_SIDES},
u AS (SELECT time_start, k, x, y, count(*) AS cells FROM (SELECT time_start, 'v' AS k, x, y FROM f_bands UNION ALL SELECT time_start, 'v', x + 1, y FROM f_bands UNION ALL SELECT time_start, 'h', x, y FROM f_bands UNION ALL SELECT time_start, 'h', x, y + 1 FROM f_bands) c GROUP BY ALL)
SELECT u.time_start, CAST(u.cells AS BIGINT) AS cells, CAST(sum(1 + kept) AS BIGINT) AS edges FROM u JOIN kept k ON u.time_start = k.time_start AND u.k = k.k AND u.x = k.x AND u.y = k.y GROUP BY ALL""")
def _(get):
    """How many edges one cell has, and how many two cells share, when all is simplified."""
    thin = topology.simplified(_bulging(get), 0.5, ["time_start"])
    sides = edges.normalised(lines.polygon_edges(thin, ["time_start"])).groupBy("time_start", *edges.EDGE).agg(F.count(F.lit(1)).alias("cells"))
    return sides.groupBy("time_start", "cells").agg(F.count(F.lit(1)).alias("edges"))


@query("line_parts", "SELECT line_id, count(*) - 1 AS segments FROM f_vertices GROUP BY line_id HAVING count(*) > 1")
def _(get):
    return _lines(get).select("line_id", (F.size(F.flatten(F.flatten("coords"))) - 1).cast("bigint").alias("segments"))


@query("line_merge", "SELECT key, CAST(count(*) AS DOUBLE) AS length FROM (SELECT DISTINCT key, x1, y1, x2, y2 FROM f_edges) GROUP BY key")
def _(get):
    sides = get("f_edges").select("key", *[F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")]).distinct()
    return _lengths(_merge_lines(Context(sides.sparkSession), lines.as_lines(sides), ["key"]), "key")
