"""Per-row derivations of feature layers: zooms, icons, colours, labels, export columns."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronogeo.functions import colors, geo, text
from chronogeo.operators import temporal
from chronogeo.session import durable, durable_table

# Cities that show from zoom 11 only.
LATE_CITIES = ("Absalom", "Shoreline", "Westerhold", "Copperwood", "Dawnfoot", "Magnimar")
LATE_CITY_MAXZOOM = 11
CITY_ICONS = {1: "large", 2: "medium", 3: "small"}
LABEL_DDL = "struct<label:string,id:string>"


def add_zoom(layer: DataFrame, minzoom: int | None = None, maxzoom: int | None = None) -> DataFrame:
    """Overwrites only the given bounds."""
    if minzoom is not None:
        layer = layer.withColumn("minzoom", F.lit(minzoom))
    return layer.withColumn("maxzoom", F.lit(maxzoom)) if maxzoom is not None else layer


def add_city_zoom(layer: DataFrame, late: tuple[str, ...] = LATE_CITIES) -> DataFrame:
    size = F.col("size")
    out = layer.withColumn("minzoom", F.when(size == 0, 2).when(size == 1, 3).otherwise(4))
    if late:
        old = F.col("maxzoom") if "maxzoom" in layer.columns else F.lit(None).cast("int")
        out = out.withColumn("maxzoom", F.when(F.col("label").isin(*late), LATE_CITY_MAXZOOM).otherwise(old))
    return out


def city_type_to_icon(layer: DataFrame) -> DataFrame:
    """A missing size counts as major here, though add_city_zoom counts it as smallest."""
    name = F.lit("major")
    for size, word in CITY_ICONS.items():
        name = F.when(F.col("size") == size, word).otherwise(name)
    icon = F.concat(F.lit("city-"), name, F.when(F.coalesce(F.col("capital"), F.lit(False)), "-capital").otherwise(""))
    return layer.withColumn("icon", icon).drop("capital", "size")


def location_type_to_icon(layer: DataFrame, icons: DataFrame) -> DataFrame:
    """location-<type> where such an icon exists (icons: column name), else location-other."""
    names = icons.select(F.concat(F.lit("location-"), F.col("name")).alias("icon"), F.col("name").alias("_type"))
    return layer.join(names, F.col("type") == F.col("_type"), "left").withColumn("icon", F.coalesce("icon", F.lit("location-other"))).drop("_type", "type")


def type_counts(layer: DataFrame) -> DataFrame:
    return layer.groupBy("type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "type")


def color_buildings(layer: DataFrame) -> DataFrame:
    return layer.withColumn("color", colors.building_color(F.col("type")))


def color_generic_labels(layer: DataFrame) -> DataFrame:
    known = F.col("type").isin("waters", "land")
    hexes = colors.hex_text(colors.layer_color(F.col("type")))
    return layer.withColumn("color", F.when(known, hexes).otherwise(F.raise_error(F.lit("a generic label is neither waters nor land"))))


def merge_labels(layers: dict[str, DataFrame], invert: bool = False) -> DataFrame:
    """Ordered union of labelled layers; colour and halo from the feature's or its layer's colour."""
    out = None
    for i, (name, x) in enumerate(layers.items()):
        own = F.col("color") if "color" in x.columns else F.lit(None).cast("string")
        source = F.coalesce(own, colors.hex_text(colors.layer_color(F.lit(name))), F.raise_error(F.lit(f"no colour in layer {name}")).cast("string"))
        dark, light = colors.with_lightness(F.col("_c"), lightness=0.15), colors.with_lightness(F.col("_c"), add=0.1)
        x = x.withColumn("_c", source).withColumn("color", light if invert else dark).withColumn("halo", dark if invert else light).drop("_c").withColumn("layer_ord", F.lit(i))
        out = x if out is None else out.unionByName(x, allowMissingColumns=True)
    return out


def _label_values(value) -> list[dict | None]:
    import json

    if value is None or (isinstance(value, str) and not value.strip()):
        return []
    if isinstance(value, str):
        t = value.strip()
        if t[0] in '[{"':
            try:
                return _label_values(json.loads(t))
            except ValueError:
                pass
        return [{"label": t, "id": None}]
    if isinstance(value, dict):
        name, key = value.get("label"), value.get("id")
        return [{"label": name if name is None or isinstance(name, str) else json.dumps(name), "id": key if key is None or isinstance(key, str) else json.dumps(key)}]
    if isinstance(value, list):
        return [x for v in value for x in _label_values(v)]
    return [{"label": json.dumps(value), "id": None}]


def label_values(labels: Column) -> Column:
    """Array of (label, id) of a label text, which may be plain, an object or a list, nested at will."""

    def udf(rows: pa.Array) -> pa.Array:
        from chronogeo.operators.derive import _label_values

        return pa.array([_label_values(x) for x in rows.to_pylist()], pa.list_(pa.struct([("label", pa.string()), ("id", pa.string())])))

    return F.arrow_udf(udf, f"array<{LABEL_DDL}>")(labels)


def resolve_labels(layer: DataFrame, source: str = "labels") -> DataFrame:
    """One row per label; a row without labels stays once, with a null label."""
    return layer.withColumn("label", F.explode_outer(label_values(F.col(source))))


def identifier(label: Column) -> Column:
    return F.coalesce(label["id"], label["label"])


def simple_label(label: Column, labels: Column) -> Column:
    """The label, else the labels' text if it is plain, else its JSON."""
    return F.coalesce(label, F.when(F.trim(labels) != "", labels))


def feature_name(label: Column, fid: Column) -> Column:
    return F.coalesce(label, F.concat(F.lit("fid:"), fid.cast("string")), F.lit("unnamed"))


def label_zoom(layer: DataFrame, label_range: int = 3, force_minzoom: int | None = None) -> DataFrame:
    """minzoom by area_km2 and lat (or forced), maxzoom = minzoom + label_range."""
    low = F.lit(force_minzoom) if force_minzoom is not None else geo.zoom_of_area(F.col("area_km2"), F.col("lat"))
    return layer.withColumn("minzoom", low.cast("int")).withColumn("maxzoom", F.col("minzoom") + label_range)


def sub_label_steps(layer: DataFrame, max_zoom: int, label_range: int = 3) -> DataFrame:
    """Rounds of sub-labels: round i puts 4^i points, (label_range + 1) * i zooms later, while that is in range."""
    rounds = F.floor((max_zoom + label_range - F.col("minzoom")) / (label_range + 1))
    dealt = layer.withColumn("round", F.explode(F.when(rounds >= 1, F.sequence(F.lit(1), rounds.cast("int")))))
    shift = F.col("round") * (label_range + 1)
    return dealt.withColumn("n_points", F.pow(F.lit(4), F.col("round")).cast("int")).withColumn("minzoom", F.col("minzoom") + shift).withColumn("maxzoom", F.col("maxzoom") + shift)


def prepare_export(layer: DataFrame, meta: DataFrame, key: str, max_zoom: int) -> DataFrame:
    """Tile zooms, time indices (for all features if any has a bound), and no years or unknown properties."""
    low = F.least(F.greatest(F.coalesce("minzoom", F.lit(0)), F.lit(0)), F.lit(max_zoom))
    high = F.least(F.greatest(F.coalesce("maxzoom", F.lit(max_zoom)), F.lit(0)), F.lit(max_zoom))
    out = layer.withColumn("export", F.struct(low.cast("int").alias("tile_minzoom"), high.cast("int").alias("tile_maxzoom")))
    out = out.withColumn("minzoom", F.when(F.col("minzoom") != F.col("export.tile_minzoom"), F.col("minzoom"))).withColumn("maxzoom", F.when(F.col("maxzoom") != F.col("export.tile_maxzoom"), F.col("maxzoom")))
    if temporal.has_time(layer):
        index = temporal.time_index(layer.select(key, "time_start", "time_end"), meta, [key])
        out = out.join(index, key, "left")
    else:
        out = out.withColumn("time_index_start", F.lit(None).cast("int")).withColumn("time_index_end", F.lit(None).cast("int"))
    return out.drop("time_start", "time_end", "extra")


LABEL_POINT = ("label", "color", "angle", "minzoom", "maxzoom", "time_start", "time_end", "type", "in_subregion", "coords")


def clean_label_points(layer: DataFrame) -> DataFrame:
    """Only what a label needs, as far as the layer has it."""
    return layer.select(*[c for c in LABEL_POINT if c in layer.columns])


def numbered(layer: DataFrame, order: list[Column], name: str, above: int = 0) -> DataFrame:
    """Rows numbered from above + 1 in an order, by ranges: no task holds all rows. Rows equal in the order have some order."""
    parts = max(1, int(layer.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranges = durable_table(layer.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()))
    before = F.coalesce(F.sum("count").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = ranges.groupBy("_range").count().withColumn("_before", before).drop("count")
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranges.withColumn("_place", place).join(F.broadcast(sizes), "_range").withColumn(name, F.col("_before") + F.col("_place") + above).drop("_range", "_place", "_before")  # one row for each range


def fill_fids(layer: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Missing fids numbered above the greatest one, in the order of some columns (of all others, if none are given)."""
    top = layer.agg(F.coalesce(F.max("fid"), F.lit(0)).alias("top")).first()["top"]
    missing = layer.filter("fid IS NULL").drop("fid")
    rows = numbered(missing, [F.col(c).asc_nulls_first() for c in order or missing.columns], "fid", top)
    return layer.filter("fid IS NOT NULL").unionByName(rows.select(*layer.columns))


def area_order(layer: DataFrame, area: str = "area_km2", then: str = "fid") -> DataFrame:
    """ord: 1 for the largest; equal areas by another column."""
    return numbered(layer, [F.col(area).desc(), F.col(then).asc()], "ord")


def location_texts(layer: DataFrame, buckets: int = 10) -> DataFrame:
    """id, bucket, html and hash of each distinct popup text; texts whose hash collides are moved to free ids.

    The first text of a hash keeps it. All others try the next id in rounds, each one join: where it is free, the
    first text that tries it has it.
    """
    html = layer.select(text.popup_text(F.col("label"), F.col("link"), F.col("text")).alias("html")).distinct()
    hashed = durable_table(html.withColumn("id", F.abs(text.string_hash(F.col("html")))))
    first = hashed.groupBy("id").agg(F.min("html").alias("html"))
    placed, left = first, durable(hashed.join(first.select("html"), "html", "left_anti"))
    while not left.isEmpty():
        left = left.withColumn("id", F.col("id") + 1)
        moved = durable(left.join(placed.select("id"), "id", "left_anti").groupBy("id").agg(F.min("html").alias("html")))
        placed = durable_table(placed.select("id", "html").unionByName(moved.select("id", "html")))
        left = durable(left.join(moved.select("html"), "html", "left_anti"))
    return placed.select("id", F.pmod("id", F.lit(buckets)).cast("int").alias("bucket"), "html", F.abs(text.string_hash(F.col("html"))).alias("hash"))


def reuse_excerpts(new: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    """New rows with the old text where keys and modification date are the same and the text isn't empty; else fetch is true."""
    before = old.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("modification_date").alias("_date"), F.col("text").alias("_text"), F.col("article_length").alias("_length")).filter("coalesce(_text, '') <> ''")
    same = F.col("modification_date") == F.col("_date")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    joined = new.join(before, same, "left")
    return joined.withColumn("text", F.col("_text")).withColumn("article_length", F.col("_length")).withColumn("fetch", F.col("_text").isNull()).drop(*[f"_{k}" for k in keys], "_date", "_text", "_length")
