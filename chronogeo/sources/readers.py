"""Sources: GeoJSON, staged layers, paged query responses, articles, icons, control points, snapshots, indices."""

from __future__ import annotations

import json
import os
import struct

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from chronogeo.functions import geo, text
from chronogeo.session import ship_package
from chronogeo.sources import layer_file

PAGE_ROWS = 50
DEPTH = {"Point": 0, "MultiPoint": 1, "LineString": 1, "MultiLineString": 2, "Polygon": 2, "MultiPolygon": 3}


def normalised_coords(kind: Column, raw: Column) -> Column:
    """[part][ring][point] of a GeoJSON coordinates text."""
    parsed = lambda t: F.from_json(raw, t)
    point, line, poly, multi = "array<double>", "array<array<double>>", "array<array<array<double>>>", "array<array<array<array<double>>>>"
    return (
        F.when(kind == "Point", F.array(F.array(F.array(parsed(point)))))
        .when(kind.isin("MultiPoint", "LineString"), F.array(F.array(parsed(line))))
        .when(kind == "MultiLineString", F.transform(parsed(poly), lambda x: F.array(x)))
        .when(kind == "Polygon", F.array(parsed(poly)))
        .when(kind == "MultiPolygon", parsed(multi))
    )


def read_geojson(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """Features of a GeoJSON file: typed properties (DDL), geom, and the raw properties text in extra."""
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", "features array<string>").alias("c")).select(F.explode("c.features").alias("f"))
    return feature_rows(rows, properties)


def read_features(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """As read_geojson(), of files with one feature a line: these are read in parts."""
    return feature_rows(spark.read.text(path).select(F.col("value").alias("f")), properties)


def feature_rows(rows: DataFrame, properties: str) -> DataFrame:
    """Features of a column f of texts."""
    kind, raw = F.get_json_object("f", "$.geometry.type"), F.get_json_object("f", "$.geometry.coordinates")
    props = F.get_json_object("f", "$.properties")
    geom = F.when(kind.isNotNull(), F.struct(kind.alias("type"), normalised_coords(kind, raw).alias("coords")))
    return rows.select(F.get_json_object("f", "$.id").cast("bigint").alias("fid"), F.from_json(props, properties).alias("p"), geom.alias("geom"), props.alias("extra")).select("fid", "p.*", "geom", "extra")


def _wkb(data: bytes, at: int) -> tuple[int, list, int]:
    """Kind, parts ([part][ring][point]) and end of a well-known binary geometry; heights and measures are left out."""
    order = "<" if data[at] else ">"
    code = struct.unpack_from(order + "I", data, at + 1)[0]
    kind, extra = code & 0xFFFF, bin(code >> 30).count("1")  # two high bits, or thousands, tell heights and measures
    extra += {0: 0, 1: 1, 2: 1, 3: 2}[kind // 1000]
    kind, at = kind % 1000, at + 5 + (4 if code & 0x20000000 else 0)

    def number() -> int:
        nonlocal at
        at += 4
        return struct.unpack_from(order + "I", data, at - 4)[0]

    def point() -> list[float]:
        nonlocal at
        x, y = struct.unpack_from(order + "2d", data, at)
        at += 8 * (2 + extra)
        return [x, y]

    if kind == 1:
        p = point()
        return kind, [] if p[0] != p[0] else [[[p]]], at
    if kind == 2:
        return kind, [[[point() for _ in range(number())]]], at
    if kind == 3:
        return kind, [[[point() for _ in range(number())] for _ in range(number())]], at
    parts: list = []
    for _ in range(number()):
        _, inner, at = _wkb(data, at)
        parts += inner
    return kind, parts, at


WKB_TYPES = {1: "Point", 2: "LineString", 3: "Polygon", 4: "MultiPoint", 5: "MultiLineString", 6: "MultiPolygon", 7: "GeometryCollection"}


def decode_geometry(blob: bytes | None) -> dict | None:
    """Type and coords of a geometry column's value: a header, an envelope of 0 to 8 numbers, well-known binary."""
    if blob is None or blob[:2] != b"GP" or blob[3] >> 4 & 1:
        return None
    kind, parts, _ = _wkb(blob, 8 + 8 * {0: 0, 1: 4, 2: 6, 3: 6, 4: 8}[blob[3] >> 1 & 7])
    return {"type": WKB_TYPES[kind], "coords": parts}


def geometry_column(blob: Column) -> Column:
    """geom (type and coords) of a binary geometry column."""

    def udf(rows: pa.Array) -> pa.Array:
        from chronogeo.sources.readers import decode_geometry

        shape = pa.struct([("type", pa.string()), ("coords", pa.list_(pa.list_(pa.list_(pa.list_(pa.float64())))))])
        return pa.array([decode_geometry(x) for x in rows.to_pylist()], shape)

    return F.arrow_udf(udf, "struct<type:string,coords:array<array<array<array<double>>>>>")(blob)


def scan_layer(spark: SparkSession, database: str, layer: str, partitions: int = layer_file.PARTITIONS, columns: list[str] | None = None) -> DataFrame:
    """One layer of a GeoPackage without its fid column, read in ranges of its row ids."""
    ship_package(spark)
    spark.dataSource.register(layer_file.LayerFile)
    scan = spark.read.format("layer_file").option("path", database).option("layer", layer).option("partitions", str(partitions)).option("pushdown", spark.conf.get("spark.sql.python.filterPushdown.enabled", "false"))
    return (scan.option("columns", ",".join(columns)) if columns else scan).load().drop("fid")


def stage_layer(database: str, layer: str, folder: str, spark: SparkSession) -> DataFrame:
    """One layer of a GeoPackage staged as Parquet without its fid column."""
    path = os.path.join(folder, layer)
    scan_layer(spark, database, layer).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def read_layer(spark: SparkSession, *, file: str | None = None, layer: str | None = None, properties: str = "label string") -> DataFrame:
    """A GeoJSON file or a staged layer; one of both must be given."""
    if (file is None) == (layer is None):
        raise ValueError("give either file or layer")
    return read_geojson(spark, file, properties) if file else spark.read.parquet(layer).drop("fid")


class PagedJson(DataSource):
    """Paged JSON responses as a table (offset, body), up to the end of the results.

    Options: folder (saved pages named <offset>.json) or url (with {offset}), and pages. Of a folder, all pages are
    read, one partition each; a page that is missing is an error. Of an url, the first pages (1, if not given) are
    partitions, and the last of them follows the results until none is left.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return "offset int, body string"

    def reader(self, schema):
        return _PagedReader(self.options)


class _PagedReader(DataSourceReader):
    def __init__(self, options):
        self.folder, self.url, self.pages = options.get("folder"), options.get("url"), int(options.get("pages", "1"))

    def partitions(self):
        if not self.folder:
            return [InputPartition(i * PAGE_ROWS) for i in range(max(1, self.pages))]
        saved = {int(name[:-5]) for name in os.listdir(self.folder) if name.endswith(".json") and name[:-5].isdecimal()}
        wanted = set(range(0, max(saved, default=0) + 1, PAGE_ROWS))
        if saved and next_offset(max(saved), self._page(max(saved))) is not None:
            wanted.add(max(saved) + PAGE_ROWS)
        if saved != wanted:
            raise ValueError(f"pages of {self.folder}: missing {sorted(wanted - saved)}, unexpected {sorted(saved - wanted)}")
        return [InputPartition(i) for i in sorted(saved)]

    def _page(self, offset: int) -> str:
        if self.folder:
            with open(os.path.join(self.folder, f"{offset}.json"), encoding="utf-8") as f:
                return f.read()
        from urllib.request import urlopen

        with urlopen(self.url.replace("{offset}", str(offset)), timeout=60) as f:
            return f.read().decode("utf-8")

    def read(self, partition):
        offset = partition.value
        follow = not self.folder and offset == (max(1, self.pages) - 1) * PAGE_ROWS
        while offset is not None:
            body = self._page(offset)
            yield (offset, body)
            after = next_offset(offset, body)
            if not follow and after not in (None, offset + PAGE_ROWS):
                raise ValueError(f"the page at {offset} goes on at {after}, not {offset + PAGE_ROWS}")
            offset = after if follow else None


def next_offset(offset: int, body: str) -> int | None:
    """Where the results go on after a page: as it says, else behind a full page."""
    page = json.loads(body)
    after = page.get("query-continue-offset")
    if after is None:
        return offset + PAGE_ROWS if len(page["query"]["results"]) >= PAGE_ROWS else None
    if int(after) <= offset:
        raise ValueError(f"the page at {offset} goes on at {after}")
    return int(after)


PRINTOUTS = "map<string,struct<printouts:map<string,array<string>>>>"


def query_rows(pages: DataFrame) -> DataFrame:
    """page, name, lon, lat and first printouts of the results of query responses."""
    results = pages.select(F.explode(F.from_json(F.get_json_object("body", "$.query.results"), f"array<{PRINTOUTS}>")).alias("r")).select(F.explode("r").alias("key", "v"))
    first = lambda n: F.try_element_at(F.col("v.printouts")[n], F.lit(1))
    page, name = text.page_and_name(F.col("key"))
    where = first("Has coordinates")
    return results.select(
        page.alias("page"), F.coalesce(first("Has name"), name).alias("name"),
        geo.ingest_lng(F.get_json_object(where, "$.lon").cast("double")).alias("lng"), geo.significant(F.get_json_object(where, "$.lat").cast("double")).alias("lat"),
        text.population_class(first("Has population")).alias("size"), (first("Is capital") == "t").alias("capital"), first("Has location type").alias("type"), first("Has infobox type").alias("infobox_type"),
        F.timestamp_seconds(F.get_json_object(first("Modification date"), "$.timestamp").cast("bigint")).alias("modification_date"),
    ).filter(~F.col("infobox_type").eqNullSafe("City district")).orderBy("name")


def read_search_index(spark: SparkSession, path: str) -> DataFrame:
    """A search index as write_search_index() leaves it, plain or compressed."""
    timed = "array<struct<time_index_start:int,time_start:int,time_end:int,time_index_end:int,bbox:array<double>,area_m2:double>>"
    return spark.read.schema(f"category string, label string, timed {timed}").json(path)


def read_tile(spark: SparkSession, path: str, z: int, x: int, y: int) -> DataFrame:
    """Features of one tile: only the folder of its zoom is read, and of that only row groups that may hold it."""
    return spark.read.parquet(path).filter((F.col("z") == z) & (F.col("x") == x) & (F.col("y") == y))


def texts_of(ids: DataFrame, path: str, buckets: int = 10) -> DataFrame:
    """ids (column id) with their html, from texts in one folder per bucket."""
    texts = ids.sparkSession.read.schema("id bigint, html string, bucket int").json(path)
    asked = ids.withColumn("bucket", F.pmod("id", F.lit(buckets)).cast("int"))
    return asked.join(texts, ["bucket", "id"], "left").drop("bucket")


def query_url(base: Column, parameters: list[tuple[str, Column]]) -> Column:
    return F.concat(base, F.lit("?"), F.concat_ws("&", *[F.concat(F.lit(k), F.lit("="), F.url_encode(v)) for k, v in parameters]))


def article_html(body: Column) -> Column:
    return F.get_json_object(body, "$.parse.text")


def icon_names(spark: SparkSession, folder: str) -> DataFrame:
    """Names of location-*.svg files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "location-*.svg").load(folder).select("path")
    return files.select(F.regexp_extract("path", r"location-([^/]*)\.svg$", 1).alias("name"))


def control_points(spark: SparkSession, path: str) -> DataFrame:
    """A table of ground control points; the first line is a comment."""
    return spark.read.csv(path, header=True, comment="#", schema="mapX double, mapY double, sourceX double, sourceY double, enable int, dX double, dY double, residual double")


def affine_fit(points: DataFrame) -> DataFrame:
    """Least squares of map = a + b * source for each axis: one row."""
    p = points.filter("enable = 1")
    return p.agg(F.regr_slope("mapX", "sourceX").alias("x_scale"), F.regr_intercept("mapX", "sourceX").alias("x_offset"), F.regr_slope("mapY", "sourceY").alias("y_scale"), F.regr_intercept("mapY", "sourceY").alias("y_offset"))
