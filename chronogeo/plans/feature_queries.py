"""Registered queries of client filters, options, measuring, ordering, sources and sinks.

Queries of sinks write into the checkpoint folder and read back what they wrote.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronogeo.functions import geo, options, style
from chronogeo.operators import derive, edges, overlay, points, shapes, temporal
from chronogeo.plans.geometry_queries import planar_area, square
from chronogeo.plans.queries import _HAVERSINE, _META, _SEGMENTS, _axis, _index, query
from chronogeo.session import by_keys, checkpoint_root, spread
from chronogeo.sources import readers, writers


def _folder(layer: DataFrame) -> str:
    return f"{checkpoint_root(layer.sparkSession).rstrip('/')}/sink-{uuid.uuid4().hex}"


# -- filters and options of the client --


@query("border_layer", "SELECT fid, CASE t WHEN 3 THEN 0 WHEN 2 THEN 1 WHEN 1 THEN 2 WHEN 4 THEN 3 WHEN 5 THEN 4 END AS place FROM (SELECT fid, fid % 7 AS t FROM f_locations)")
def _(get):
    return get("f_locations").select("fid", style.border_layer((F.col("fid") % 7).cast("int")).cast("int").alias("place"))


@query("nation_label_shows", "SELECT fid FROM f_locations WHERE NOT coalesce(CASE WHEN fid % 3 > 0 THEN fid % 3 = 1 END, false) OR fid % 9 > 4")
def _(get):
    inside = F.when(F.col("fid") % 3 > 0, F.col("fid") % 3 == 1)
    return get("f_locations").filter(style.nation_label_shows(inside, F.col("fid") % 9)).select("fid")


@query("location_label_shows", "SELECT fid FROM f_locations WHERE fid % 5 > 0 AND fid % 12 >= CASE WHEN fid % 2 = 0 THEN size ELSE 0 END + 5")
def _(get):
    label = F.when(F.col("fid") % 5 > 0, F.col("label"))
    return get("f_locations").filter(style.location_label_shows(label, F.when(F.col("fid") % 2 == 0, F.col("size")), F.col("fid") % 12)).select("fid")


@query("clickable", "SELECT c_custkey FROM customer WHERE c_custkey % 4 <> 1")
def _(get):
    return get("customer").filter(style.clickable(F.when(F.col("c_custkey") % 4 != 1, F.col("c_custkey")))).select("c_custkey")


@query("listed_labels", "SELECT fid FROM f_locations WHERE type IN (SELECT lower(c_mktsegment) FROM customer WHERE c_custkey <= 3)")
def _(get):
    rows = get("f_locations")
    return style.listed(rows, rows.filter("fid <= 3").select("type"), "type").select("fid")


@query("layer_zooms", "SELECT type AS layer, CASE WHEN min(size) <> 0 THEN CAST(min(size) AS INT) END AS minzoom, CASE WHEN count(z) = count(*) AND max(z) <> 9 THEN CAST(max(z) AS INT) END AS maxzoom FROM (SELECT type, size + (length(type) % 2) AS size, CASE WHEN type = 'building' AND fid % 2 = 0 THEN NULL WHEN type = 'machinery' THEN 9 ELSE fid % 8 END AS z FROM f_locations) GROUP BY type")
def _(get):
    low = F.col("size") + F.length("type") % 2
    high = F.when((F.col("type") == "building") & (F.col("fid") % 2 == 0), None).when(F.col("type") == "machinery", 9).otherwise(F.col("fid") % 8)
    rows = get("f_locations").select("type", low.alias("tile_minzoom"), high.alias("tile_maxzoom"))
    kinds = ("automobile", "building", "furniture", "household", "machinery")
    profiles = [points.property_profile(rows.filter(F.col("type") == k).drop("type"), k) for k in kinds]
    whole = profiles[0]
    for p in profiles[1:]:
        whole = whole.unionByName(p)
    return style.layer_zooms(whole, 9)


_DEFAULTS = {"hideLabels": "false", "year": "0", "projection": "auto"}


@query("url_options", "SELECT fid, CASE WHEN fid % 2 = 0 THEN 'true' ELSE 'false' END AS hide, CASE WHEN fid % 3 = 0 THEN CAST(fid AS VARCHAR) ELSE '0' END AS year, 'auto' AS projection, '#' || concat_ws('&', CASE WHEN fid % 2 = 0 THEN 'hideLabels=true' END, CASE WHEN fid % 3 = 0 AND fid <> 0 THEN 'year=' || fid END) AS written FROM f_locations")
def _(get):
    year = F.when(F.col("fid") % 3 == 0, F.concat(F.lit("&year=1&year="), F.col("fid").cast("string"))).otherwise(F.lit(""))
    fragment = F.concat(F.lit("#location=3/4/5&hideLabels="), (F.col("fid") % 2 == 0).cast("string"), year)
    values = options.parse_options(fragment, _DEFAULTS)
    return get("f_locations").select("fid", values["hideLabels"].alias("hide"), values["year"].alias("year"), values["projection"].alias("projection"), options.write_options(values, _DEFAULTS).alias("written"))


@query("fly_to", "SELECT fid, CASE WHEN fid % 3 = 0 THEN 7.5e0 END AS zoom, CASE WHEN fid % 3 = 0 THEN lat END AS lat, CASE WHEN fid % 3 = 0 THEN lng END AS lng FROM f_locations")
def _(get):
    number = lambda c: F.col(c).cast("string")
    place = F.when(F.col("fid") % 3 == 0, F.concat_ws("/", F.lit("7.5"), number("lat"), number("lng"))).when(F.col("fid") % 3 == 1, F.concat_ws("/", F.lit("7.5"), number("lat"))).otherwise("a/b/c")
    return get("f_locations").select("fid", options.fly_to(place).alias("p")).select("fid", "p.*")


@query("hit_centre", "SELECT fid, CASE fid % 3 WHEN 0 THEN lng WHEN 1 THEN (lng + lng + 4) / 2 END AS x, CASE fid % 3 WHEN 0 THEN lat WHEN 1 THEN (lat + lat + 2) / 2 END AS y FROM f_locations")
def _(get):
    corner = F.concat_ws(",", "lng", "lat")
    text = F.when(F.col("fid") % 3 == 0, corner).when(F.col("fid") % 3 == 1, F.concat_ws(", ", corner, F.col("lng") + 4, F.col("lat") + 2)).otherwise(F.concat_ws(",", corner, F.lit("x")))
    x, y = geo.box_centre(options.bbox_numbers(text))
    return get("f_locations").select("fid", x.alias("x"), y.alias("y"))


@query("search_filtered", "SELECT category, label FROM (SELECT type AS category, label FROM f_locations WHERE lower(label) LIKE '%customer#0000000%' AND type IN ('building', 'machinery') AND size <= 1 ORDER BY label, category LIMIT 10)")
def _(get):
    return points.search(points.search_rows(_index(get)), "customer#0000000", categories=["building", "machinery"], year=1).select("category", "label")


# -- measuring --


@query("planar_midpoint", f"WITH {_SEGMENTS} SELECT line_id, seq, (x1 + x2) / 2 AS x, (y1 + y2) / 2 AS y FROM g")
def _(get):
    x, y = geo.midpoint(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    return edges.segments(get("f_vertices"), ["line_id"], "seq").select("line_id", "seq", x.alias("x"), y.alias("y"))


@query("great_circle_midpoint", f"WITH {_SEGMENTS}, d AS (SELECT *, round({_HAVERSINE} / 2, 2) AS half FROM g WHERE NOT (abs(abs(x2 - x1) - 180) < 1e-6 AND abs(y1 + y2) < 1e-6)) SELECT line_id, seq, half AS before, half AS after FROM d")
def _(get):
    rows = edges.segments(get("f_vertices"), ["line_id"], "seq").filter("NOT (abs(abs(x2 - x1) - 180) < 1e-6 AND abs(y1 + y2) < 1e-6)")  # no one midpoint between antipodes
    x, y = geo.great_circle_midpoint(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    rows = rows.withColumn("x", x).withColumn("y", y)
    part = lambda a, b: F.round(geo.haversine_m(F.col(f"x{a}"), F.col(f"y{a}"), F.col(f"x{b}"), F.col(f"y{b}")), 2)
    return rows.select("line_id", "seq", part(1, "").alias("before"), part("", 2).alias("after"))


@query("measured_line", "SELECT fid, round(2 * 6371000.0 * asin(sqrt(power(sin(radians(lat / -2 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(lat / -2)) * power(sin(radians(70) / 2), 2))), 1) AS metres FROM f_locations")
def _(get):
    line = F.array(F.array("lng", "lat"), F.array(F.col("lng") + 70, F.col("lat") / -2))
    rows = get("f_locations").select("fid", shapes.measured_lines(line).alias("p"))
    step = lambda i: geo.haversine_m(F.get("p", i - 1)[0], F.get("p", i - 1)[1], F.get("p", i)[0], F.get("p", i)[1])
    return rows.select("fid", F.round(F.aggregate(F.sequence(F.lit(1), F.size("p") - 1), F.lit(0.0), lambda a, i: a + step(i)), 1).alias("metres"))


@query("continuous_lng", "WITH RECURSIVE c AS (SELECT line_id, seq, lng AS x FROM f_vertices WHERE seq = 1 UNION ALL SELECT v.line_id, v.seq, CASE WHEN v.lng - c.x > 180 THEN v.lng - 360 * ceil((v.lng - c.x - 180) / 360) WHEN v.lng - c.x < -180 THEN v.lng + 360 * ceil((c.x - v.lng - 180) / 360) ELSE v.lng END FROM c JOIN f_vertices v ON v.line_id = c.line_id AND v.seq = c.seq + 1) SELECT line_id, seq, round(x, 6) AS lng FROM c")
def _(get):
    lines = get("f_vertices").groupBy("line_id").agg(F.array_sort(F.collect_list(F.struct("seq", "lng"))).alias("p"))
    rows = lines.select("line_id", F.posexplode(geo.continuous_lng(F.col("p.lng"))).alias("i", "x"))
    return rows.select("line_id", (F.col("i") + 1).alias("seq"), F.round("x", 6).alias("lng"))


@query("copy_near", "SELECT fid, round(lng + 360 * round((500e0 - lng) / 360), 6) AS lng FROM f_locations WHERE abs(abs(500 - lng - 360 * round((500e0 - lng) / 360)) - 180) > 1e-6")
def _(get):
    near = geo.copy_near(F.col("lng"), F.lit(500.0))
    return get("f_locations").select("fid", F.round(near, 6).alias("lng")).filter(F.abs(F.abs(F.lit(500.0) - F.col("lng")) - 180) > 1e-6)


@query("vectors", "SELECT fid, round(lng * cos(radians(30)) - lat * sin(radians(30)), 6) AS x, round(lng * sin(radians(30)) + lat * cos(radians(30)), 6) AS y, round(lng / nullif(sqrt(lng * lng + lat * lat), 0), 9) AS u, round(lat / nullif(sqrt(lng * lng + lat * lat), 0), 9) AS v FROM f_locations")
def _(get):
    x, y = geo.rotated(F.col("lng"), F.col("lat"), F.lit(30.0))
    u, v = geo.unit_vector(F.col("lng"), F.col("lat"))
    return get("f_locations").select("fid", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"), F.round(u, 9).alias("u"), F.round(v, 9).alias("v"))


# -- nodes, orders, numbers --


@query("neighbours", f"WITH {_SEGMENTS} SELECT x1 AS x, y1 AS y, x2 AS to_x, y2 AS to_y FROM g UNION SELECT x2, y2, x1, y1 FROM g")
def _(get):
    return edges.neighbours(edges.segments(get("f_vertices"), ["line_id"], "seq"))


@query("node_order", "SELECT fid, row_number() OVER (ORDER BY lat * 400 + lng, fid) AS place FROM f_locations")
def _(get):
    rows = get("f_locations").withColumn("o", edges.node_order(F.col("lng"), F.col("lat")))
    return derive.numbered(rows, [F.col("o").asc(), F.col("fid").asc()], "place").select("fid", "place")


@query("area_order", "SELECT fid, row_number() OVER (ORDER BY article_length DESC, fid) AS ord FROM f_locations")
def _(get):
    return derive.area_order(get("f_locations"), "article_length").select("fid", "ord")


@query("fill_fids", "SELECT CASE WHEN fid % 3 = 0 THEN (SELECT max(fid) FROM f_locations WHERE fid % 3 > 0) + row_number() OVER (PARTITION BY fid % 3 = 0 ORDER BY label) ELSE fid END AS fid, label FROM f_locations")
def _(get):
    rows = get("f_locations").select(F.when(F.col("fid") % 3 > 0, F.col("fid")).alias("fid"), "label")
    return derive.fill_fids(rows, ["label"])


@query("greedy_chunks", "WITH RECURSIVE r AS (SELECT p_brand AS key, p_partkey AS fid, p_size AS n, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS i FROM part), g AS (SELECT key, fid, i, 0 AS chunk, CAST(n AS BIGINT) AS total FROM r WHERE i = 1 UNION ALL SELECT r.key, r.fid, r.i, CASE WHEN g.total >= 100 THEN g.chunk + 1 ELSE g.chunk END, CAST(CASE WHEN g.total >= 100 THEN r.n ELSE g.total + r.n END AS BIGINT) FROM g JOIN r ON r.key = g.key AND r.i = g.i + 1) SELECT key, fid, CAST(chunk AS INT) AS chunk FROM g")
def _(get):
    return points.greedy_chunks(get("part").select(F.col("p_brand").alias("key"), F.col("p_partkey").alias("fid"), "p_size"), ["key"], "fid", "p_size", 100)


@query("clean_label_points", "SELECT label, type, lng AS minzoom FROM f_locations")
def _(get):
    return derive.clean_label_points(get("f_locations").withColumn("minzoom", F.col("lng")))


@query("simple_label", "SELECT fid, CASE WHEN fid % 2 = 0 THEN label WHEN fid % 3 = 0 THEN type END AS name FROM f_locations")
def _(get):
    label, labels = F.when(F.col("fid") % 2 == 0, F.col("label")), F.when(F.col("fid") % 3 == 0, F.col("type")).otherwise(F.lit("  "))
    return get("f_locations").select("fid", derive.simple_label(label, labels).alias("name"))


@query("representative_year", f"WITH {_META} SELECT id, coalesce(slice_start, slice_end - 1) AS year FROM m")
def _(get):
    s, e = F.col("slice_start"), F.col("slice_end")
    return temporal.time_meta(_axis(get)).select("id", temporal.representative_year(s, e).alias("year"))


@query("time_by_id", f"WITH {_META}, e AS (SELECT event_id, -(event_id % 20) AS id FROM events) SELECT e.event_id, m.slice_start AS \"start\", m.slice_end AS \"end\" FROM e JOIN m ON m.id = e.id")
def _(get):
    ids = get("events").select("event_id", (-(F.col("event_id") % 20)).cast("int").alias("asked"))
    return writers.time_by_id(ids, temporal.time_meta(_axis(get)), "asked").select("event_id", "start", "end")


# -- geometries --


def _cell(get, size: float = 1.0) -> DataFrame:
    return get("f_cells").withColumn("coords", square(F.col("x"), F.pmod(F.col("y"), F.lit(80)), size))


@query("tile_clip", "SELECT fid, z, 1e0 AS area FROM f_cells, (VALUES (3), (6), (8)) AS t(z)")
def _(get):
    # Dealt by feature before tiles are told: what is cut lies where it is put together again.
    rows = by_keys(_cell(get), ["fid"]).withColumn("x0", F.col("x")).withColumn("y0", F.pmod(F.col("y"), F.lit(80))).drop("x", "y")
    at = rows.withColumn("tile_minzoom", F.explode(F.array(F.lit(3), F.lit(6), F.lit(8)))).withColumn("tile_maxzoom", F.col("tile_minzoom"))
    cut = points.tiles(at.withColumns({"w": F.col("x0").cast("double"), "e": F.col("x0") + 1.0, "s": F.col("y0").cast("double"), "n": F.col("y0") + 1.0}))
    part = shapes.clipped_to_box(F.col("coords"), edges.geometry_type(F.col("coords")), *points.tile_box(F.col("z"), F.col("x"), F.col("y")))
    return cut.withColumn("coords", part).groupBy("fid", "z").agg(F.round(F.sum(planar_area(F.col("coords"))), 6).alias("area"))


@query("unshifted", "SELECT fid, CASE WHEN fid % 3 = 0 THEN x + 360 - 360 WHEN fid % 3 = 1 THEN x WHEN x > 10 THEN x - 190 ELSE x + 170 END AS x FROM f_cells")
def _(get):
    by = F.when(F.col("fid") % 3 == 0, 360.0).when(F.col("fid") % 3 == 1, 0.0).otherwise(170.0)
    rows = get("f_cells").withColumn("coords", square(F.col("x") + by, F.col("y"), 100.0))
    return rows.select("fid", edges.unshifted(F.col("coords"))[0][0][0][0].cast("int").alias("x"))


@query("map_points", "SELECT fid, 6e0 AS area FROM f_cells")
def _(get):
    return _cell(get).select("fid", F.round(planar_area(edges.map_points(F.col("coords"), lambda x, y: (x * 2 + 1, y * 3))), 6).alias("area"))


@query("insert_point", "SELECT fid, 1.5e0 AS area, 6 AS points FROM f_cells")
def _(get):
    tip = F.array(F.col("x") + 2.0, F.pmod(F.col("y"), F.lit(80)) + 0.5)
    ring = edges.insert_point(F.col("coords")[0][0], 3, tip)
    return _cell(get).select("fid", F.round(planar_area(F.array(F.array(ring))), 6).alias("area"), F.size(ring).alias("points"))


@query("dissolve_fields", "SELECT key, min_by(x, fid) AS x, CAST(sum(y) AS BIGINT) AS y, CAST(count(*) AS DOUBLE) AS area FROM f_cells GROUP BY key")
def _(get):
    rows = get("f_cells").withColumn("coords", square(F.col("x"), F.col("y")))
    return overlay.dissolve_fields(rows, ["key"], ("x",), ("y",)).select("key", "x", "y", F.round(planar_area(F.col("coords")), 6).alias("area"))


@query("clean_polygons", "SELECT fid, 1.5e0 AS area, 1 AS parts FROM f_cells")
def _(get):
    two = F.concat("coords", square(F.col("x") + 0.5, F.pmod(F.col("y"), F.lit(80))), square(F.col("x") + 3.0, F.pmod(F.col("y"), F.lit(80)), 0.01))
    rows = spread(_cell(get)).withColumn("coords", overlay.cleaned(two, 0.001))
    return rows.select("fid", F.round(planar_area(F.col("coords")), 6).alias("area"), F.size("coords").alias("parts"))


@query("geometry_type", "SELECT fid, CASE fid % 4 WHEN 0 THEN 'Polygon' WHEN 1 THEN 'LineString' WHEN 2 THEN 'Point' ELSE 'MultiPolygon' END AS kind FROM f_cells")
def _(get):
    return _mixed(get).select("fid", edges.geometry_type(F.col("coords")).alias("kind"))


def _mixed(get) -> DataFrame:
    """Cells as polygons, lines, points and pairs of polygons."""
    ring = F.col("coords")[0][0]
    kinds = F.when(F.col("fid") % 4 == 1, F.array(F.array(F.slice(ring, 1, 3)))).when(F.col("fid") % 4 == 2, F.array(F.array(F.slice(ring, 1, 1))))
    pair = F.concat("coords", square(F.col("x") + 50, F.col("y")))
    return _cell(get).withColumn("coords", F.when(F.col("fid") % 4 == 3, pair).otherwise(F.coalesce(kinds, F.col("coords"))))


# -- sources and sinks --


@query("geojson_roundtrip", "SELECT fid, key, CASE fid % 4 WHEN 0 THEN 'Polygon' WHEN 1 THEN 'LineString' WHEN 2 THEN 'Point' ELSE 'MultiPolygon' END AS kind, CASE fid % 4 WHEN 0 THEN 5 WHEN 1 THEN 3 WHEN 2 THEN 1 ELSE 10 END AS points, CAST(x AS DOUBLE) AS x FROM f_cells")
def _(get):
    layer = writers.with_geometry(_mixed(get).select("fid", "key", "coords"))
    path = _folder(layer)
    writers.write_geojson(layer, path)
    rows = readers.read_features(layer.sparkSession, path, "key string")
    return rows.select("fid", "key", F.col("geom.type").alias("kind"), F.size(F.flatten(F.flatten("geom.coords"))).alias("points"), F.col("geom.coords")[0][0][0][0].alias("x"))


@query("geojson_collection", "SELECT fid, label, round(lng, 2) AS lng, round(lat, 2) AS lat FROM f_locations")
def _(get):
    rows = get("f_locations").withColumn("coords", F.array(F.array(F.array(F.array("lng", "lat")))))
    features = writers.geojson_features(writers.with_geometry(rows.select("fid", "label", "type", "coords")))
    path = _folder(rows)
    by = features.groupBy(F.pmod(F.xxhash64("value"), F.lit(64))).agg(F.array_join(F.collect_list("value"), ",").alias("f"))
    by.select(F.concat(F.lit('{"type":"FeatureCollection","features":['), "f", F.lit("]}")).alias("value")).repartition(64).write.option("maxRecordsPerFile", 1).text(path)
    read = readers.read_geojson(rows.sparkSession, path, "label string")
    return read.select("fid", "label", F.round(F.col("geom.coords")[0][0][0][0], 2).alias("lng"), F.round(F.col("geom.coords")[0][0][0][1], 2).alias("lat"))


@query("per_label_files", "SELECT type AS label, count(*) AS n FROM f_locations GROUP BY type")
def _(get):
    rows = get("f_locations").select("fid", F.col("type").alias("label"), F.array(F.array(F.array(F.array("lng", "lat")))).alias("coords"))
    path = _folder(rows)
    writers.write_per_label(writers.with_geometry(rows), path)
    return rows.sparkSession.read.text(path).groupBy(F.col("_label").alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("search_index_reload", "SELECT type AS category, label, size AS time_start, lng AS w FROM f_locations")
def _(get):
    index = _index(get)
    path = _folder(index)
    writers.write_search_index(index, path)
    rows = points.search_rows(readers.read_search_index(index.sparkSession, f"{path}/gzip"))
    return rows.select("category", "label", "time_start", F.col("bbox")[0].alias("w"))


@query("text_lookup", "SELECT fid, '<h3>' || label || '</h3>' || type AS html FROM f_locations")
def _(get):
    rows = get("f_locations").withColumn("link", F.lit(None).cast("string")).withColumn("text", F.col("type"))
    texts = derive.location_texts(rows)
    path = _folder(rows)
    writers.write_texts(texts, path)
    html = F.concat(F.lit("<h3>"), "label", F.lit("</h3>"), "type")
    ids = rows.select("fid", html.alias("own")).join(texts.select("id", F.col("html").alias("own")), "own")
    return readers.texts_of(ids.select("fid", "id"), path).select("fid", "html")


@query("tile_read", "SELECT fid FROM f_locations WHERE CAST(least(greatest(floor((lng + 180) / 360 * 4), 0), 3) AS INT) = 1 AND CAST(least(greatest(floor((1 - asinh(tan(radians(lat))) / pi()) / 2 * 4), 0), 3) AS INT) = 2")
def _(get):
    box = {"w": F.col("lng"), "e": F.col("lng"), "s": F.col("lat"), "n": F.col("lat"), "tile_minzoom": F.lit(0), "tile_maxzoom": F.lit(3)}
    rows = get("f_locations").select("fid", "lng", "lat").withColumns(box)
    path = _folder(rows)
    points.tiles(rows).write.partitionBy("z").parquet(path)
    return readers.read_tile(rows.sparkSession, path, 2, 1, 2).select("fid")
