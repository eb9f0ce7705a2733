"""Pipeline steps by name. A step takes named layers and parameters and returns a layer.

A layer is a DataFrame with property columns, ``coords`` ([part][ring][point])
and ``time_start``, ``time_end``. Steps that combine rows geometrically ask
for slices: their inputs carry ``slice_start``, ``slice_end``, which are
grouping columns, so all slices run in one plan.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronogeo.functions import colors, geo
from chronogeo.operators import derive, edges, lines, overlay, points, shapes, temporal, topology
from chronogeo.session import by_size, durable_table, ship_package, spread
from chronogeo.sources import writers

ANY, MERGED, SLICED = "ANY", "MERGED", "SLICED"
SLICE = ["slice_start", "slice_end"]
TIME = ["time_start", "time_end"]
HIGHLIGHT_VERTICES = 10_000
RIVER_WIDTH_M = 2000.0
#: Tiles hold what lies in them and so much, as a share of a tile, beyond.
TILE_MARGIN = 1 / 64


@dataclass
class Context:
    """What steps need besides their inputs: layers by name, an output folder, icons, limits."""

    spark: SparkSession
    layers: dict[str, DataFrame] = field(default_factory=dict)
    out: str = ""
    icons: DataFrame | None = None
    max_zoom: int = 8
    longest_edge: float = 0.2
    #: Groups of a geometric step with more vertices are cut into tiles.
    group_vertices: int = 20_000
    results: dict[str, DataFrame] = field(default_factory=dict)
    #: Seconds of the steps of a pipeline, by id.
    seconds: dict[str, float] = field(default_factory=dict)


@dataclass
class Step:
    name: str
    needs: str
    run: Callable[..., DataFrame | None]


STEPS: dict[str, Step] = {}


def step(name: str, needs: str = ANY):
    def add(f: Callable) -> Callable:
        STEPS[name] = Step(name, needs, f)
        return f

    return add


def timed(layer: DataFrame) -> DataFrame:
    """The layer with time columns, null where it has none."""
    for c in TIME:
        if c not in layer.columns:
            layer = layer.withColumn(c, F.lit(None).cast("int"))
    return layer


def run_step(ctx: Context, name: str, inputs: dict[str, DataFrame], **parameters) -> DataFrame | None:
    """Runs a step; slices its inputs on a common axis and merges its output where it asks for that."""
    s = STEPS[name]
    ship_package(ctx.spark)
    inputs = {k: timed(x) if k not in ("time-meta", "meta") else x for k, x in inputs.items()}
    if s.needs != SLICED:
        return s.run(ctx, inputs, **parameters)
    # Written first: whether there is time, the axis, sizes and the step itself read them, and each would run anew what they come from.
    inputs = {k: durable_table(spread(x)) for k, x in inputs.items()}
    if not any(temporal.has_time(x) for x in inputs.values()):  # one always-slice, no join
        cut = {k: x.withColumn("slice_start", F.lit(None).cast("int")).withColumn("slice_end", F.lit(None).cast("int")) for k, x in inputs.items()}
    else:
        cut = temporal.align(inputs)
    out = s.run(ctx, cut, **parameters)
    out = out.drop(*TIME).withColumn("time_start", F.col("slice_start")).withColumn("time_end", F.col("slice_end")).drop(*SLICE)
    return temporal.merge_layer(out, size=sum(_vertices(x) for x in inputs.values()))


def _vertices(layer: DataFrame) -> int:
    """Vertices of all features of a written layer."""
    count = F.aggregate(F.flatten("coords"), F.lit(0).cast("bigint"), lambda n, r: n + F.size(r))
    return (layer.agg(F.sum(count)).first()[0] or 0) if "coords" in layer.columns else 0


def _key(*columns: str) -> Column:
    """One text for some columns; unlike Spark's hashes it tells where a null stands."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def _truthy(name: str) -> Column:
    return F.col(name).isNotNull() & (F.col(name).cast("string") != "")


def _union(inputs: dict[str, DataFrame]) -> DataFrame:
    named = [x.withColumn("layer", F.lit(k)).withColumn("layer_ord", F.lit(i)) for i, (k, x) in enumerate(inputs.items()) if k not in ("time-meta", "meta")]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


@step("READ_FILE")
def read_file(ctx, inputs, file=None, layer=None):
    if (file is None) == (layer is None):
        raise ValueError("give either file or layer")
    return timed(ctx.layers[file or layer])


@step("ADD_ZOOM")
def add_zoom(ctx, inputs, minZoom=None, maxZoom=None):
    return derive.add_zoom(inputs["in"], minZoom, maxZoom)


@step("ADD_CITY_ZOOM")
def add_city_zoom(ctx, inputs):
    return derive.add_city_zoom(inputs["in"])


@step("CITY_TYPE_TO_ICON")
def city_type_to_icon(ctx, inputs):
    return derive.city_type_to_icon(inputs["in"])


@step("LOCATION_TYPE_TO_ICON")
def location_type_to_icon(ctx, inputs):
    icons = ctx.icons if ctx.icons is not None else ctx.spark.createDataFrame([], "name string")
    return derive.location_type_to_icon(inputs["in"], icons)


@step("COLOR_BUILDINGS")
def color_buildings(ctx, inputs):
    return derive.color_buildings(inputs["in"])


@step("COLOR_GENERIC_LABELS")
def color_generic_labels(ctx, inputs):
    return derive.color_generic_labels(inputs["in"])


@step("RESOLVE_LABELS")
def resolve_labels(ctx, inputs, **parameters):
    return derive.resolve_labels(inputs["in"], parameters.get("from", "labels")).withColumn("label_id", F.col("label.id")).withColumn("label", F.col("label.label"))


@step("MERGE_LABELS")
def merge_labels(ctx, inputs, invert=False):
    return derive.merge_labels(inputs, invert)


@step("ADD_POINTS")
def add_points(ctx, inputs):
    return inputs["in"].unionByName(inputs["summand"], allowMissingColumns=True)


def _dissolve(ctx: Context, rows: DataFrame, keys: list[str]) -> DataFrame:
    """overlay.dissolve(), by tiles where a key has too many vertices; written first, as what rows come from would run twice."""
    rows = durable_table(rows.select(*keys, "coords"))
    return overlay.dissolve_tiled(rows, keys, overlay.tile_size([rows], keys, ctx.group_vertices))


def _cut(ctx: Context, layer: DataFrame, mask: DataFrame, cut: Callable[..., DataFrame]) -> DataFrame:
    """overlay.clip() or erase() by slice, and by tile where a slice has too many vertices; pieces of a feature are joined again."""
    size = overlay.tile_size([layer, mask], SLICE, ctx.group_vertices)
    if size is None:
        return cut(layer, mask, SLICE)
    rows = durable_table(layer.withColumn("_uid", F.monotonically_increasing_id()))
    pieces = cut(overlay.tiled(rows.select(*SLICE, "_uid", "coords"), size), overlay.tiled(mask.select(*SLICE, "coords"), size), [*SLICE, *overlay.TILE])
    whole = overlay.dissolve(pieces, ["_uid"])
    return rows.drop("coords").join(whole, "_uid").select(*layer.columns)


def _clip_lines(ctx: Context, layer: DataFrame, mask: DataFrame, erase: bool = False) -> DataFrame:
    """lines.clip_lines() by slice, and by tile where a slice has too many vertices."""
    layer = durable_table(layer)
    size = overlay.tile_size([layer, mask], SLICE, ctx.group_vertices)
    return lines.clip_lines(layer, mask, SLICE, erase) if size is None else lines.clip_lines_tiled(layer, mask, SLICE, size, erase)


def _merge_lines(ctx: Context, layer: DataFrame, keys: list[str], apart: bool = False) -> DataFrame:
    """The lines of each key joined end to end, by tiles where a key has too many vertices; a feature for each key or, apart, for each line."""
    layer = durable_table(layer)
    size = overlay.tile_size([layer], keys, ctx.group_vertices)
    if size is None:
        whole = lines.merge_lines(layer, keys)
        return overlay.exploded(whole) if apart else whole
    merged = lines.merge_lines_tiled(layer, keys, size, ctx.group_vertices)
    return merged if apart else by_size(merged, keys, _vertices(layer)).groupBy(*keys).agg(F.flatten(F.collect_list("coords")).alias("coords"))  # of one feature


@step("ADD_POLYGONS", SLICED)
def add_polygons(ctx, inputs):
    both = inputs["in"].select(*SLICE, "coords").unionByName(inputs["summand"].select(*SLICE, "coords"))
    return overlay.exploded(_dissolve(ctx, both, SLICE))


def _as_line_layer(layer: DataFrame) -> DataFrame:
    """The layer marked as lines: some of its chains come back to their start."""
    return layer.withColumn("geom_type", F.lit("LineString"))


def _by_kind(layer: DataFrame, on_lines: Callable[[DataFrame], DataFrame], on_polygons: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows of lines and of polygons, each by its own way; those without geom_type are lines if a ring is open."""
    is_open = F.exists(F.flatten("coords"), lambda r: (F.size(r) < 4) | ~F.get(r, F.lit(0)).eqNullSafe(F.get(r, F.size(r) - 1)))
    told = F.col("geom_type").isin("LineString", "MultiLineString") if "geom_type" in layer.columns else F.lit(None).cast("boolean")
    is_line = F.coalesce(told, is_open, F.lit(False))
    layer = durable_table(layer)
    kinds = {r[0] for r in layer.select(is_line).distinct().collect()}
    if True not in kinds:
        return on_polygons(layer)
    found = on_lines(layer.filter(is_line))
    return found.unionByName(on_polygons(layer.filter(~is_line)), allowMissingColumns=True) if False in kinds else found


@step("CLIP", SLICED)
def clip(ctx, inputs):
    mask = inputs["mask"]
    return _by_kind(inputs["in"], lambda x: _clip_lines(ctx, x, mask), lambda x: _cut(ctx, x, mask, overlay.clip))


@step("SUBTRACT", SLICED)
def subtract(ctx, inputs, keepField=None):
    """Polygons are dissolved, lines merged with the sides that they share taken once, before both are erased."""
    keys, mask = [*SLICE, *([keepField] if keepField else [])], inputs["subtrahend"]

    def on_lines(layer: DataFrame) -> DataFrame:
        sides = edges.edge_kinds(edges.normalised(lines.polygon_edges(layer, keys)), keys).drop("kind")
        merged = _merge_lines(ctx, lines.as_lines(sides), keys, apart=True)
        return _as_line_layer(_clip_lines(ctx, merged, mask, erase=True))

    return _by_kind(inputs["in"], on_lines, lambda x: _cut(ctx, overlay.exploded(_dissolve(ctx, x, keys)), mask, overlay.erase))


@step("CITY_POLYGONS", SLICED)
def city_polygons(ctx, inputs):
    return _dissolve(ctx, inputs["in"].filter(_truthy("city")), [*SLICE, "city"]).withColumn("labels", F.col("city"))


@step("BORDER_VARIANTS__PROVINCES")
def provinces(ctx, inputs):
    return inputs["in"].filter(_truthy("province")).select(F.col("province").alias("label"), "coords", *TIME)


def _variant(ctx: Context, layer: DataFrame, name: str, flag: bool = False) -> DataFrame:
    rows = layer.filter(_truthy(name)).withColumn("label", F.col(name))
    if flag:
        rows = rows.withColumn("in_subregion", F.coalesce(F.col("subregion") != "", F.lit(False)))
    return _dissolve(ctx, rows, [*SLICE, "label", *(["in_subregion"] if flag else [])])


@step("BORDER_VARIANTS__NATIONS", SLICED)
def nations(ctx, inputs):
    return _variant(ctx, inputs["in"], "nation", True)


@step("BORDER_VARIANTS__SUBREGIONS", SLICED)
def subregions(ctx, inputs):
    return _variant(ctx, inputs["in"], "subregion")


@step("BORDER_VARIANTS__REGIONS", SLICED)
def regions(ctx, inputs):
    return _variant(ctx, inputs["in"], "region")


def _side_lines(layer: DataFrame, keys: list[str]) -> DataFrame:
    """Outlines in pieces that neighbours share, normalised."""
    return topology.boundaries(layer, SLICE, [k for k in keys if k not in SLICE])


@step("BORDER_VARIANTS__PROVINCE_BORDERS", SLICED)
def province_borders(ctx, inputs):
    sides = _side_lines(inputs["in"], [*SLICE, "nation"])
    inner = _merge_lines(ctx, lines.as_lines(edges.inner_lines(sides, [*SLICE, "nation"])), [*SLICE, "nation"]).drop("nation")
    return _as_line_layer(_clip_lines(ctx, inner, inputs["land_without_water"]))


@step("BORDER_VARIANTS__DISTRICT_BORDERS", SLICED)
def district_borders(ctx, inputs):
    sides = edges.edge_kinds(_side_lines(inputs["in"], SLICE), SLICE).drop("kind")
    return _as_line_layer(_merge_lines(ctx, lines.as_lines(sides), SLICE))


def _keyed_borders(ctx: Context, inputs: dict[str, DataFrame], primary: str, other: str) -> DataFrame:
    rows = inputs["in"].withColumn("key", edges.border_key(primary, other)).filter("key IS NOT NULL")
    whole = _dissolve(ctx, rows, [*SLICE, "key"])
    kinds = edges.edge_kinds(_side_lines(whole, SLICE), SLICE)
    inner = lines.as_lines(kinds.filter("kind = 'inner'").drop("kind"))
    outer = _clip_lines(ctx, lines.as_lines(kinds.filter("kind = 'outer'").drop("kind")), inputs["land_without_water"])
    return _as_line_layer(_merge_lines(ctx, inner.unionByName(outer), SLICE))


@step("BORDER_VARIANTS__NATION_BORDERS", SLICED)
def nation_borders(ctx, inputs):
    return _keyed_borders(ctx, inputs, "nation", "subregion")


@step("BORDER_VARIANTS__SUBREGION_BORDERS", SLICED)
def subregion_borders(ctx, inputs):
    return _keyed_borders(ctx, inputs, "subregion", "nation")


@step("BORDER_VARIANTS__REGION_BORDERS", SLICED)
def region_borders(ctx, inputs):
    whole = _variant(ctx, inputs["in"], "region")
    return _as_line_layer(_merge_lines(ctx, lines.as_lines(edges.inner_lines(_side_lines(whole, SLICE), SLICE)), SLICE))


@step("MERGE_BORDERS", MERGED)
def merge_borders(ctx, inputs):
    sides = {k: lines.polygon_edges(x, TIME) for k, x in inputs.items() if k in edges.BORDER_TYPES}
    merged = lines.as_lines(edges.merge_borders(sides))
    keys = ["border_type", "maxzoom", *TIME]
    return _as_line_layer(_merge_lines(ctx, merged, keys, apart=True))


@step("BUFFER_POLYGONS", SLICED)
def buffer_polygons(ctx, inputs):
    whole = _dissolve(ctx, inputs["in"], SLICE)
    grown = overlay.exploded(whole.withColumn("coords", shapes.buffered(F.col("coords"), 0.5, 20)))
    thin = topology.simplified(grown, 0.3, SLICE)
    return thin.withColumn("coords", shapes.rounded(F.col("coords"), 3, 180.0))


@step("HIGHLIGHTS")
def highlights(ctx, inputs):
    rows = _union(inputs).filter(_truthy("label"))
    whole = _dissolve(ctx, rows, ["label", *TIME]).filter(F.size("coords") > 0)
    whole = whole.withColumn("_b", F.least(F.sqrt(F.abs(geo.planar_area(F.col("coords")))) / 40, F.lit(0.5)))
    thin = topology.simplified(whole, F.least(F.lit(1.0), F.lit(HIGHLIGHT_VERTICES) / edges.ring_vertex_count(F.col("coords"))))
    wide = thin.withColumn("coords", edges.drop_holes(shapes.buffered(F.col("coords"), 5 * F.col("_b"))))
    wide = wide.withColumn("coords", shapes.buffered(F.col("coords"), -4 * F.col("_b"))).filter(F.size("coords") > 0)
    shaped = topology.simplified(wide.drop("_b"), 0.4).withColumn("coords", shapes.rounded(F.col("coords"), 2, 170.0))
    return shaped.withColumn("coords", edges.inverted(F.col("coords")))


@step("SMOOTH_LINES")
def smooth_lines(ctx, inputs):
    layer = inputs["in"]
    return shapes.smooth_lines(layer if "no_smooth" in layer.columns else layer.withColumn("no_smooth", F.lit(False)))


@step("ADD_FRACTAL_DETAIL")
def add_fractal_detail(ctx, inputs):
    return shapes.add_fractal_detail(inputs["in"], ctx.longest_edge)


def _line_points(layer: DataFrame, width: Column) -> DataFrame:
    """Vertices of the distinct lines of a layer: slice, line (a hash of it), seq, last (the greatest seq), lng, lat, w (metres)."""
    rows = layer.select(*SLICE, width.alias("w"), F.explode(F.flatten("coords")).alias("_r")).filter(F.size("_r") > 1).distinct()
    rows = rows.select(*SLICE, "w", F.md5(F.to_json(F.struct("_r", "w"))).alias("line"), (F.size("_r") - 1).alias("last"), F.posexplode("_r").alias("seq", "_p"))
    return rows.select(*SLICE, "w", "line", "last", "seq", F.col("_p")[0].alias("lng"), F.col("_p")[1].alias("lat"))


def _width(layer: DataFrame) -> Column:
    return F.coalesce(F.col("width").cast("double"), F.lit(RIVER_WIDTH_M)) if "width" in layer.columns else F.lit(RIVER_WIDTH_M)


@step("SHAPE_ROADS", SLICED)
def shape_roads(ctx, inputs):
    pts = _line_points(inputs["in"], _width(inputs["in"]))
    wide = pts.withColumn("half_width", geo.metres_to_degrees(F.col("w"), F.col("lat")))
    return overlay.exploded(_dissolve(ctx, shapes.ribbons(wide, ["line", *SLICE]), SLICE))


def _land_points(ctx: Context, layer: DataFrame, land: DataFrame) -> DataFrame:
    """Slice, x, y of the vertices of lines clipped to land."""
    inside = _clip_lines(ctx, layer.select(*SLICE, "coords"), land)
    points = inside.select(*SLICE, F.explode(F.flatten(F.flatten("coords"))).alias("p"))
    return points.select(*[F.col(c).alias(f"l_{c}") for c in SLICE], F.col("p")[0].alias("l_lng"), F.col("p")[1].alias("l_lat")).distinct()


@step("SHAPE_RIVERS", SLICED)
def shape_rivers(ctx, inputs):
    """River outlines: widths are the greatest at joins, springs (ends of one line, on land) have a tenth, and widths ease over three quarters of a line."""
    layer = inputs["in"]
    pts = _line_points(layer, _width(layer))
    here = lambda of: reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"{of}_{c}")) for c in SLICE])
    count = F.when((F.col("seq") == 0) | (F.col("seq") == F.col("last")), 1).otherwise(2)
    node = pts.groupBy(*[F.col(c).alias(f"n_{c}") for c in (*SLICE, "lng", "lat")]).agg(F.max("w").alias("n_w"), F.sum(count).alias("degree"))
    met = pts.join(node, here("n") & (F.col("lng") == F.col("n_lng")) & (F.col("lat") == F.col("n_lat")))
    spring = F.col("degree") == 1
    if "land_without_water" in inputs:
        met = met.join(_land_points(ctx, layer, inputs["land_without_water"]), here("l") & (F.col("lng") == F.col("l_lng")) & (F.col("lat") == F.col("l_lat")), "left")
        spring = spring & F.col("l_lng").isNotNull()
    line = Window.partitionBy("line", *SLICE)
    least = lambda at: F.max(F.when((F.col("seq") == at) & spring, 0.1)).over(line)
    eased = lambda least, share: F.when(share < 0.75, least + (1 - least) * (1 - F.cos(share / 0.75 * 3.141592653589793)) / 2).otherwise(1.0)
    share = F.col("seq") / F.col("last")
    grow = F.least(eased(F.coalesce("first_share", F.lit(1.0)), share), eased(F.coalesce("last_share", F.lit(1.0)), 1 - share))
    shaped = met.withColumn("first_share", least(0)).withColumn("last_share", least(F.col("last"))).withColumn("half_width", geo.metres_to_degrees(F.col("n_w") * grow, F.col("lat")))
    return overlay.exploded(_dissolve(ctx, shapes.ribbons(shaped, ["line", *SLICE]), SLICE))


@step("RIVER_LABELS", SLICED)
def river_labels(ctx, inputs):
    return _as_line_layer(_merge_lines(ctx, inputs["in"].filter(_truthy("label")), [*SLICE, "label"])).withColumn("minzoom", F.lit(5))


@step("GENERATE_LABEL_CENTERS", MERGED)
def generate_label_centers(ctx, inputs, labelRange=3, dissolve=True, generateSubLabels=True, forceMinzoom=None):
    rows = inputs["in"].filter(_truthy("label"))
    keep = [c for c in ("color", "type", "in_subregion") if c in rows.columns]
    if dissolve:
        shape = _dissolve(ctx, rows, ["label", *TIME])
        extra = rows.groupBy(*[F.col(c).alias(f"_{c}") for c in ("label", *TIME)]).agg(*[F.first(c, ignorenulls=True).alias(c) for c in keep]) if keep else None
        if extra is not None:
            on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("label", *TIME)])
            shape = shape.join(extra, on).drop("_label", "_time_start", "_time_end")
    else:
        shape = rows.select("label", *TIME, "coords", *keep)
    shape = shape.withColumn("area_km2", geo.area_km2(F.col("coords"))).withColumn("p", shapes.label_point(F.col("coords"))).withColumn("lat", F.col("p.lat"))
    missing = F.raise_error(F.concat(F.lit("no label point in "), F.col("label"))).cast(shapes.LABEL_POINT)
    shape = shape.withColumn("p", F.when(F.col("p").isNull(), missing).otherwise(F.col("p")))
    # Written first: ranges are told from a sample of the rows, and what comes before a sample runs twice.
    shape = durable_table(shape)
    zoomed = derive.area_order(derive.label_zoom(shape, labelRange, forceMinzoom), "area_km2", "label")
    zoomed = zoomed.withColumn("angle", geo.label_angle(F.col("p.width"), F.col("p.height"), F.col("p.box_angle")))
    point = lambda x, y: F.array(F.array(F.array(F.array(x, y))))
    names = ["label", *TIME, *keep, "minzoom", "maxzoom", "angle", "ord"]
    out = zoomed.select(*names, point(F.col("p.lng"), F.col("p.lat")).alias("coords"))
    if generateSubLabels:
        more = derive.sub_label_steps(zoomed, ctx.max_zoom, labelRange)
        key = F.concat_ws("|", "label", F.col("round").cast("string"))
        more = more.withColumn("dot", F.explode(shapes.dot_points(F.col("coords"), F.col("n_points"), key)))
        out = out.unionByName(more.select(*names, point(F.col("dot")[0], F.col("dot")[1]).alias("coords")))
    return out


@step("RESOLVE_PATTERNS", SLICED)
def resolve_patterns(ctx, inputs):
    rows = inputs["in"]
    plain = rows.filter("pattern IS NULL OR lower(pattern) <> 'pebbles'").drop("pattern")
    some = rows.filter("lower(pattern) = 'pebbles'").drop("pattern").withColumn("_m2", geo.area_km2(F.col("coords")) * 1e6).withColumn("_key", F.to_json("coords"))
    # Written first: the kernel takes plain columns, as Spark doesn't take out a kernel whose arguments are lambdas over arrays.
    some = durable_table(some)
    some = some.withColumn("coords", shapes.pebbles(F.col("coords"), F.col("_m2"), F.col("_key"))).drop("_m2", "_key")
    return plain.unionByName(some)


@step("MERGE_GEOMETRY", SLICED)
def merge_geometry(ctx, inputs):
    """One polygon layer, a feature for each layer and colour, in the order of the layers.

    Where a feature with a transparent colour is on top, the cells of the mosaic of all layers stand for it, coloured by
    their stacks; a feature that is on top nowhere, or opaque, stays whole.
    """
    rows = _union(inputs).filter("coords IS NOT NULL")
    own = colors.parse_hex(F.col("color")) if "color" in rows.columns else F.lit(None).cast(colors.RGBA)
    rows = rows.withColumn("c", F.coalesce(own, colors.layer_color(F.col("layer"))))
    rows = rows.withColumn("c", F.when(F.col("c").isNull(), F.raise_error(F.lit("a feature has no colour")).cast(colors.RGBA)).otherwise(F.col("c")))
    # Layer and colour in one number: what covers a cell tells its colours.
    places = {"r": 24, "g": 16, "b": 8, "a": 0}
    packed = reduce(lambda x, k: x + F.shiftleft(F.col("c")[k].cast("long"), places[k]), places, F.shiftleft(F.col("layer_ord").cast("long"), 32))
    unpacked = lambda o: colors.rgba(*[F.shiftright(o, n).bitwiseAND(F.lit(255)) for n in places.values()])
    rows = rows.withColumn("ord", packed).select(*SLICE, "ord", "coords")
    size = overlay.tile_size([rows], SLICE, ctx.group_vertices)
    by = SLICE if size is None else [*SLICE, *overlay.TILE]
    flat = durable_table(overlay.dissolve(rows if size is None else overlay.tiled(rows, size), [*by, "ord"]))
    whole = flat if size is None else overlay.dissolve(flat, [*SLICE, "ord"])
    top = F.element_at("covers", -1)
    seen = overlay.mosaic(flat, by).filter(top % 256 < 255)
    pieces = seen.select(*SLICE, top.alias("ord"), colors.hex_text(colors.composite(F.transform("covers", unpacked))).alias("color"), "coords")
    pieces = durable_table(overlay.dissolve(pieces, [*SLICE, "ord", "color"]))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"p_{c}")) for c in (*SLICE, "ord")])
    kept = whole.join(pieces.select(*[F.col(c).alias(f"p_{c}") for c in (*SLICE, "ord")]), same, "left_anti")
    out = kept.withColumn("color", colors.hex_text(unpacked(F.col("ord")))).unionByName(pieces)
    return out.withColumn("layer_ord", F.shiftright("ord", 32).cast("int")).drop("ord")


@step("LOCATION_GROUP", SLICED)
def location_group(ctx, inputs):
    rows = inputs["in"].withColumn("fid", F.xxhash64("label", F.to_json("coords"))).withColumn("lng", F.col("coords")[0][0][0][0]).withColumn("lat", F.col("coords")[0][0][0][1])
    for c in ("minzoom", "maxzoom", "article_length"):
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast("int"))
    weighted = points.weighted(rows)
    groups, members = points.location_groups(weighted.select(*SLICE, "fid", "lng", "lat", "weight", "minzoom", "maxzoom"), ctx.max_zoom, tuple(SLICE))
    groups = groups.withColumn("_g", _key(*SLICE, "best", "at_zoom"))
    feature = rows.withColumnsRenamed({"slice_start": "r_s", "slice_end": "r_e", "minzoom": "pregroup_minzoom"}).drop("maxzoom", *TIME, "article_length")
    best = groups.join(feature, (F.col("best") == F.col("fid")) & F.col("slice_start").eqNullSafe(F.col("r_s")) & F.col("slice_end").eqNullSafe(F.col("r_e")))
    names = weighted.select(F.col("fid").alias("m_fid"), F.col("label").alias("m_label"), F.col("weight").alias("m_weight")).distinct()
    of = members.filter("fid <> best").select(*[F.col(c).alias(f"m_{c}") for c in SLICE], F.col("zoom").alias("m_zoom"), F.col("best").alias("m_best"), F.col("fid").alias("member"))
    same = F.col("slice_start").eqNullSafe(F.col("m_slice_start")) & F.col("slice_end").eqNullSafe(F.col("m_slice_end")) & (F.col("best") == F.col("m_best")) & (F.col("at_zoom") == F.col("m_zoom"))
    others = groups.select("_g", *SLICE, "best", "at_zoom").join(of, same).join(names, F.col("member") == F.col("m_fid"))
    texts = points.group_texts(others, ["_g"], "m_label", "m_weight").select(F.col("_g").alias("t_g"), F.col("text").alias("group_text"))
    out = best.join(texts, F.col("_g") == F.col("t_g"), "left")
    return out.withColumnsRenamed({"first_zoom": "minzoom", "last_zoom": "maxzoom"}).drop("_g", "t_g", "r_s", "r_e", "best", "n_members", "at_zoom", "fid", "lng", "lat")


@step("LOCATION_SCALE")
def location_scale(ctx, inputs):
    rows = inputs["in"]
    for c in ("link", "text"):
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast("string"))
    texts = derive.location_texts(rows)
    ctx.results["location-texts"] = texts
    if ctx.out:
        writers.write_texts(texts, f"{ctx.out}/location-texts")
    from chronogeo.functions.text import popup_text

    keyed = rows.withColumn("_html", popup_text(F.col("label"), F.col("link"), F.col("text")))
    found = texts.select(F.col("id").alias("fid"), F.col("html").alias("t_html"))
    return keyed.join(found, F.col("_html") == F.col("t_html"), "left").drop("_html", "t_html", "link", "text")


@step("PREPARE_EXPORT", MERGED)
def prepare_export(ctx, inputs):
    rows = inputs["in"].withColumn("_key", F.monotonically_increasing_id())
    for c in ("minzoom", "maxzoom"):
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast("int"))
    return derive.prepare_export(durable_table(rows), inputs["time-meta"], "_key", ctx.max_zoom).drop("_key")


@step("TIME_META_COLLECT", MERGED)
def time_meta_collect(ctx, inputs):
    return temporal.collect_time_meta(*[x for k, x in inputs.items()])


@step("TIME_META_LIMIT", MERGED)
def time_meta_limit(ctx, inputs, time=None):
    return temporal.limit_time(inputs["in"], (time or {}).get("timeStart"), (time or {}).get("timeEnd"))


@step("TIME_META_OUT", MERGED)
def time_meta_out(ctx, inputs):
    ctx.results["time-table"] = writers.time_table(inputs["meta"])
    return ctx.results["time-table"]


def _boxes(rows: DataFrame) -> DataFrame:
    pts = F.flatten(F.flatten(edges.unshifted(F.col("coords"))))
    xs, ys = F.transform(pts, lambda p: p[0]), F.transform(pts, lambda p: p[1])
    return rows.withColumns({"w": F.array_min(xs), "e": F.array_max(xs), "s": F.array_min(ys), "n": F.array_max(ys)})


@step("COMPILE_TILES", MERGED)
def compile_tiles(ctx, inputs, filename="map", extension="pmtiles"):
    """Features by tile, cut to it; labels of locations show from five zooms after their own least zoom."""
    rows = _union({k: x for k, x in inputs.items() if k != "time-meta"})
    every = F.struct(F.lit(0).alias("tile_minzoom"), F.lit(ctx.max_zoom).alias("tile_maxzoom"))
    rows = rows.withColumn("export", F.coalesce(F.col("export"), every) if "export" in rows.columns else every)
    boxes = _boxes(rows.filter(F.size("coords") > 0)).select("*", "export.tile_minzoom", "export.tile_maxzoom").drop("export")
    tiles = points.tiles(boxes)
    kind = edges.geometry_type(F.col("coords"))
    kind = F.when(F.col("geom_type").isNotNull(), F.col("geom_type")).otherwise(kind) if "geom_type" in tiles.columns else kind
    tiles = tiles.withColumn("coords", shapes.clipped_to_box(edges.unshifted(F.col("coords")), kind, *points.tile_box(F.col("z"), F.col("x"), F.col("y"), TILE_MARGIN))).filter(F.size("coords") > 0)
    if "label" in tiles.columns:
        late = (F.col("layer") == "locations") & (F.col("z") < F.least(F.lit(ctx.max_zoom), F.coalesce(F.col("pregroup_minzoom") if "pregroup_minzoom" in tiles.columns else F.lit(0), F.lit(0)) + 5))
        tiles = tiles.withColumn("label", F.when(~late, F.col("label")))
    ctx.results[f"tiles-{filename}"] = tiles
    ctx.results[f"props-{filename}"] = props_meta(ctx, inputs, filename)
    if ctx.out:
        tiles.write.mode("overwrite").partitionBy("z").parquet(f"{ctx.out}/{filename}")
    return tiles


@step("PROPS_META", MERGED)
def props_meta(ctx, inputs, filenameSuffix=""):
    profiles = [points.property_profile(x.drop("coords"), k) for k, x in inputs.items() if k != "time-meta"]
    return reduce(DataFrame.unionByName, profiles)


@step("CREATE_SEARCH_INDEX", MERGED)
def create_search_index(ctx, inputs):
    rows = _union({k: x for k, x in inputs.items() if k != "time-meta"})
    rows = rows.withColumn("label", F.when(_truthy("label"), F.coalesce(F.col("label_id"), F.col("label")) if "label_id" in rows.columns else F.col("label")).otherwise(F.raise_error(F.lit("a label is blank or unresolved"))))
    area = F.col("area_m2") if "area_m2" in rows.columns else F.lit(None).cast("double")
    pts = rows.select(F.col("layer").alias("category"), "label", *TIME, area.alias("area_m2"), F.explode(F.flatten(F.flatten("coords"))).alias("p"))
    none = F.lit(None).cast("int")
    indices = [none.alias("time_index_start"), none.alias("time_index_end")]
    if "time-meta" in inputs and temporal.has_time(rows):
        ranges = rows.select(*TIME).distinct().withColumn("_range", _key(*TIME))
        found = temporal.time_index(ranges, inputs["time-meta"], ["_range"]).withColumnRenamed("_range", "_r")
        pts = pts.withColumn("_range", _key(*TIME)).join(found, F.col("_range") == F.col("_r")).drop("_range", "_r")
        indices = []
    index = points.search_index(pts.select("*", F.col("p")[0].alias("lng"), F.col("p")[1].alias("lat"), *indices))
    ctx.results["search-index"] = index
    if ctx.out:
        writers.write_search_index(index, f"{ctx.out}/search")
    return index


@step("GEOJSON_OUT", MERGED)
def geojson_out(ctx, inputs, filename="out"):
    rows = writers.with_geometry(inputs["in"])
    if ctx.out:
        writers.write_geojson(rows, f"{ctx.out}/{filename}")
    return writers.geojson_features(rows)


@step("GEOJSON_OUT_PER_LABEL", MERGED)
def geojson_out_per_label(ctx, inputs, dirname="labels"):
    rows = writers.with_geometry(inputs["in"])
    if ctx.out:
        return writers.write_per_label(rows, f"{ctx.out}/{dirname}")
    return rows.select("label").distinct().orderBy("label")


@step("CHECK_GEOMETRY")
def check_geometry(ctx, inputs, layer=None):
    """A report of null geometries, rings with too few points or not closed, rings that touch or cross themselves, duplicates, and features that overlap.

    The layer itself isn't changed. Overlaps are told by time and, but for labels, as polygons; features are cut into tiles first.
    """
    rows = inputs["in"]
    ring = F.flatten("coords")
    few = F.exists(ring, lambda r: F.size(r) < 4)
    open_ring = F.exists(ring, lambda r: F.element_at(r, 1) != F.element_at(r, -1))
    again = F.exists(ring, lambda r: F.size(F.array_distinct(F.slice(r, 1, F.greatest(F.size(r) - 1, F.lit(0))))) < F.size(r) - 1)
    fault = F.when(F.col("coords").isNull(), "null geometry").when(few, "degenerate ring").when(open_ring, "open ring").when(again, "self contact").when(shapes.crosses_itself(F.col("coords")), "self intersection")
    # Geometries are compared by 128 bits of a hash; the report names them in full.
    shape, digest = F.to_json("coords"), F.md5(F.to_json("coords"))
    faults = rows.select(shape.alias("shape"), fault.alias("fault"))
    twice = rows.groupBy(digest.alias("d")).agg(F.count(F.lit(1)).alias("n"), F.first(shape, ignorenulls=True).alias("shape")).filter("n > 1").select("shape", F.lit("duplicate").alias("fault"))
    faults = faults.filter("fault IS NOT NULL").unionByName(twice)
    if layer == "labels":
        return faults
    whole = rows.filter("coords IS NOT NULL").select("coords", *TIME).join(faults.select(F.md5("shape").alias("_s")).distinct(), digest == F.col("_s"), "left_anti")
    numbered = durable_table(whole.withColumn("ord", F.monotonically_increasing_id()))
    cut = temporal.align({"a": numbered})["a"]
    size = overlay.tile_size([cut], SLICE, ctx.group_vertices)
    by = SLICE if size is None else [*SLICE, *overlay.TILE]
    cells = overlay.mosaic((cut if size is None else overlay.tiled(cut, size)).select(*by, "ord", "coords"), by)
    above = cells.filter(F.size("covers") > 1).select(F.explode("covers").alias("c_ord")).distinct()
    return faults.unionByName(numbered.join(above, F.col("ord") == F.col("c_ord")).select(F.to_json("coords").alias("shape"), F.lit("overlap").alias("fault")))
