"""Sinks: GeoJSON, one file per label, search index, time table, bucketed texts, tiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronogeo.operators import edges, points, temporal


def geojson_coords(geom: Column) -> Column:
    """Coordinates text in the nesting of the geometry's type."""
    kind, c = geom["type"], geom["coords"]
    return (
        F.when(kind == "Point", F.to_json(c[0][0][0]))
        .when(kind == "MultiPoint", F.to_json(F.flatten(F.flatten(c))))
        .when(kind == "LineString", F.to_json(c[0][0]))
        .when(kind == "MultiLineString", F.to_json(F.flatten(c)))
        .when(kind == "Polygon", F.to_json(c[0]))
        .otherwise(F.to_json(c))
    )


def geojson_features(layer: DataFrame) -> DataFrame:
    """value: one GeoJSON feature a row; null properties are left out."""
    props = F.to_json(F.struct(*[c for c in layer.columns if c not in ("geom", "fid", "extra")]))
    shape = F.when(F.col("geom").isNull(), F.lit("null")).otherwise(F.concat(F.lit('{"type":"'), F.col("geom.type"), F.lit('","coordinates":'), geojson_coords(F.col("geom")), F.lit("}")))
    fid = F.when(F.col("fid").isNotNull(), F.concat(F.lit('"id":'), F.col("fid").cast("string"), F.lit(","))).otherwise("") if "fid" in layer.columns else F.lit("")
    return layer.select(F.concat(F.lit('{"type":"Feature",'), fid, F.lit('"properties":'), props, F.lit(',"geometry":'), shape, F.lit("}")).alias("value"))


def write_geojson(layer: DataFrame, path: str) -> None:
    """Newline-delimited features, in as many files as the layer has partitions."""
    geojson_features(layer).write.mode("overwrite").text(path)


def write_per_label(layer: DataFrame, path: str, label: str = "label") -> DataFrame:
    """Features in one folder per label; the distinct labels in order."""
    labelled = layer.select(F.col(label).alias("_label"), F.struct(*layer.columns).alias("row")).select("_label", "row.*")
    props = F.to_json(F.struct(*[c for c in layer.columns if c not in ("geom", "fid", "extra")]))
    shape = F.concat(F.lit('{"type":"'), F.col("geom.type"), F.lit('","coordinates":'), geojson_coords(F.col("geom")), F.lit("}"))
    out = labelled.select("_label", F.concat(F.lit('{"type":"Feature","properties":'), props, F.lit(',"geometry":'), shape, F.lit("}")).alias("value"))
    out.write.mode("overwrite").partitionBy("_label").text(path)
    return layer.select(label).distinct().orderBy(label)


def write_search_index(index: DataFrame, path: str) -> None:
    """JSON, plain and compressed."""
    index.write.mode("overwrite").json(f"{path}/plain")
    index.write.mode("overwrite").option("compression", "gzip").json(f"{path}/gzip")


def with_geometry(layer: DataFrame) -> DataFrame:
    """The layer with geom (type and coords) in place of coords; the type is that of geom_type, if it has one, or told by the shape."""
    told = F.col("geom_type") if "geom_type" in layer.columns else F.lit(None).cast("string")
    lines = F.when(F.size(F.flatten("coords")) > 1, "MultiLineString").otherwise("LineString")
    kind = F.when(told.isin("LineString", "MultiLineString"), lines).otherwise(edges.geometry_type(F.col("coords")))
    geom = F.when(kind.isNotNull(), F.struct(kind.alias("type"), F.col("coords")))
    return layer.withColumn("geom", geom).drop("coords", "geom_type")


def time_by_id(ids: DataFrame, meta: DataFrame, column: str) -> DataFrame:
    """ids with the row of the time table of each; an id that it doesn't hold is an error."""
    table = time_table(meta).withColumnRenamed("id", "_id")
    met = ids.join(table, F.col(column) == F.col("_id"), "left")
    return met.withColumn("label", F.when(F.col("_id").isNull(), F.raise_error(F.lit("no slice of this id")).cast("string")).otherwise(F.col("label"))).drop("_id")


def time_table(meta: DataFrame) -> DataFrame:
    """id, label, representative_year, start, end of the slices."""
    s, e = F.col("slice_start"), F.col("slice_end")
    return meta.select("id", temporal.slice_label(s, e).alias("label"), temporal.representative_year(s, e).alias("representative_year"), s.alias("start"), e.alias("end"))


def write_texts(texts: DataFrame, path: str) -> None:
    """id and html in one folder per bucket, which lookups by id prune."""
    texts.write.mode("overwrite").partitionBy("bucket").json(path)


def write_tiles(boxes: DataFrame, path: str) -> None:
    """Features by tile, one folder per zoom."""
    points.tiles(boxes).withColumnRenamed("z", "zoom").write.mode("overwrite").partitionBy("zoom").parquet(path)
