"""Point layers: grouping by zoom, search index and search, tiles, property profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronogeo.functions import geo
from chronogeo.session import durable_table

# Weights of icons in rankings.
ICON_WEIGHTS = {
    "city-major-capital": 9, "city-large-capital": 8, "city-medium-capital": 7, "city-small-capital": 6,
    "city-major": 5, "city-large": 4, "city-medium": 3, "city-small": 2, "location-other": -1,
}
#: Points that a tile of a map of evenly spread points holds, at first.
TILE_POINTS = 5_000
LISTED = 10


def icon_weight(icon: Column) -> Column:
    out = F.lit(0)
    for name, w in ICON_WEIGHTS.items():
        out = F.when(icon == name, w).otherwise(out)
    return out


def weighted(layer: DataFrame) -> DataFrame:
    """weight: the icon's, and 0.9 times the share of the longest article."""
    top = layer.agg(F.max("article_length").alias("_top"))
    share = F.coalesce(F.col("article_length") / F.nullif(F.col("_top"), F.lit(0)), F.lit(0.0))
    return layer.join(F.broadcast(top)).withColumn("weight", icon_weight(F.col("icon")) + 0.9 * share).drop("_top")


def group_at_zoom(ids: list[int], xs: list[float], ys: list[float], low: list, high: list, distance: float, zoom: int) -> list[tuple[int, list[int]]]:
    """Greedy groups of ranked points: each joins the closest group within the distance, or founds one where it stands."""
    cell: dict[tuple[int, int], list[int]] = {}
    heads: list[tuple[float, float]] = []
    out: list[tuple[int, list[int]]] = []
    for i, x, y, hi in zip(ids, xs, ys, high):
        if hi is not None and hi < zoom:
            continue
        cx, cy, best, near = int(x // distance), int(y // distance), None, distance
        for gx in (cx - 1, cx, cx + 1):
            for gy in (cy - 1, cy, cy + 1):
                for g in cell.get((gx, gy), ()):
                    d = ((heads[g][0] - x) ** 2 + (heads[g][1] - y) ** 2) ** 0.5
                    if d <= near and (d < near or best is None or g < best):
                        best, near = g, d
        if best is None:
            cell.setdefault((cx, cy), []).append(len(heads))
            heads.append((x, y))
            out.append((i, [i]))
        else:
            out[best][1].append(i)
    return out


def _same(keys: list[str], prefix: str) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).eqNullSafe(F.col(f"{prefix}{k}"))
    return out


def heads_of_tile(x: list[float], y: list[float], known: list[bool], own: list[bool], distance: float) -> list[bool | None]:
    """For each of ranked points whether it founds a group; None where that hangs on a point of another tile.

    known heads found one; others that aren't the tile's own are in doubt. A point near an earlier head founds none; one
    near an earlier point in doubt is in doubt itself.
    """
    cells: dict[tuple[int, int], list[tuple[float, float, bool]]] = {}
    out: list[bool | None] = []
    for px, py, head, mine in zip(x, y, known, own):
        cx, cy = int(px // distance), int(py // distance)
        found: bool | None = True if head else None
        if not head and mine:
            near = [sure for i in (cx - 1, cx, cx + 1) for j in (cy - 1, cy, cy + 1) for qx, qy, sure in cells.get((i, j), ()) if ((px - qx) ** 2 + (py - qy) ** 2) ** 0.5 <= distance]
            found = False if any(near) else None if near else True
        if found is not False:
            cells.setdefault((cx, cy), []).append((px, py, bool(found)))
        out.append(found)
    return out


def _around(rows: DataFrame, cell: Column, reach: Column) -> DataFrame:
    """Rows once for each cell, cx and cy, that lies within reach of them."""
    near = lambda v: F.explode(F.sequence(F.floor((F.col(v) - reach) / cell), F.floor((F.col(v) + reach) / cell)))
    return rows.withColumn("cx", near("x")).withColumn("cy", near("y"))


def _heads(points: DataFrame, by: list[str], cells: int | None) -> DataFrame:
    """by, x, y, rank: the points that found a group, told tile by tile.

    A tile, with the points around it that are near enough, settles what hangs on none of its neighbours. What is left
    goes on to tiles four times as wide, so that the number of rounds is the logarithm of the map's width.
    Of points at one place only the first is asked: the others are near its head.
    """
    side = 1 / F.pow(F.lit(2.0), F.col("zoom"))
    left = durable_table(points.groupBy(*by, "x", "y").agg(F.min("rank").alias("rank")).withColumn("head", F.lit(False)))
    kinds = ", ".join(f"`{k}` {points.schema[k].dataType.simpleString()}" for k in by)
    ddl = f"{kinds}, x double, y double, rank struct<w:double,f:bigint>, head boolean"

    def run(pdf):
        from chronogeo.operators.points import heads_of_tile

        order = sorted(range(len(pdf)), key=lambda i: (pdf["rank"].iloc[i]["w"], pdf["rank"].iloc[i]["f"]))
        pdf = pdf.iloc[order]
        found = heads_of_tile(pdf["x"].tolist(), pdf["y"].tolist(), pdf["head"].tolist(), pdf["own"].tolist(), 2 / 2 ** int(pdf["zoom"].iloc[0]))
        keep = [own and not head and state is not False for own, head, state in zip(pdf["own"], pdf["head"], found)]
        return pdf.assign(head=[state is True for state in found])[keep][[*by, "x", "y", "rank", "head"]]

    if cells is None:
        most = left.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
        first = F.greatest(F.lit(100.0 / max(1, round((most / TILE_POINTS) ** 0.5))), 8 * side)
    else:
        first = side * cells
    done: DataFrame | None = None
    wider = 1
    while True:
        width = first * wider
        tile = lambda v: F.floor(v / width)
        every = left if done is None else left.unionByName(done)
        # An inch of rounding: a tile takes a little more around it than the distance.
        reach = lambda c: F.explode(F.sequence(tile(F.col(c) - 2.001 * side), tile(F.col(c) + 2.001 * side)))
        dealt = every.withColumn("tx", reach("x")).withColumn("ty", reach("y")).withColumn("own", (F.col("tx") == tile(F.col("x"))) & (F.col("ty") == tile(F.col("y"))))
        dealt = dealt.join(left.select(*[F.col(k).alias(f"o_{k}") for k in by], tile(F.col("x")).alias("o_tx"), tile(F.col("y")).alias("o_ty")).distinct(), _same([*by, "tx", "ty"], "o_"), "left_semi")
        told = durable_table(dealt.groupBy(*by, "tx", "ty").applyInPandas(run, ddl))
        new = told.filter("head")
        done = new if done is None else done.unionByName(new)
        left = told.filter("NOT head")
        if left.isEmpty():
            return done
        wider *= 4


def _members(points: DataFrame, by: list[str], cells: int | None) -> DataFrame:
    """by, best, fid: each point with the closest head before it; of equally close ones the first.

    Cells are four distances wide: most heads are near to one cell only, and a cell has few heads, as these are a distance apart.
    """
    rank = F.struct((-F.col("weight")).alias("w"), F.col("fid").alias("f"))
    side = 1 / F.pow(F.lit(2.0), F.col("zoom"))
    cell = 8 * side
    every = durable_table(points.select(*by, "fid", "x", "y", rank.alias("rank"), F.floor(F.col("x") / cell).alias("cx"), F.floor(F.col("y") / cell).alias("cy")))
    heads = _heads(every.drop("cx", "cy"), by, cells).drop("head")
    near = durable_table(_around(heads, cell, 2.001 * side))
    near = near.withColumnsRenamed({c: f"h_{c}" for c in near.columns})
    distance = F.sqrt(F.pow(F.col("x") - F.col("h_x"), 2) + F.pow(F.col("y") - F.col("h_y"), 2))
    met = every.join(near, _same([*by, "cx", "cy"], "h_") & (distance <= 2 * side) & (F.col("h_rank") <= F.col("rank")))
    best = F.min_by("h_rank", F.struct(distance.alias("d"), F.col("h_rank").alias("r")))
    return met.groupBy(*by, "fid").agg(best.alias("b")).select(*by, F.col("b.f").alias("best"), "fid")


def location_groups(layer: DataFrame, max_zoom: int, keys: tuple[str, ...] = (), cells: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Groups of points: (keys, best, n_members, first_zoom, last_zoom (null beyond max_zoom), at_zoom) and the members of each zoom (keys, zoom, best, fid).

    layer: keys, fid, lng, lat, weight, minzoom, maxzoom; rows that repeat a fid count once. Points join in the order
    of weight, then fid. Groups with the same best and members at neighbouring zooms are one row, whose members are
    those of at_zoom. Points are grouped in tiles of so many cells (half a zoom's distance each), or by default
    of about ``TILE_POINTS`` points if these are spread evenly, and in wider ones what is left.
    """
    by = [*keys, "zoom"]
    x, y = geo.grouping_xy(F.col("lng"), F.col("lat"))
    points = layer.dropDuplicates([*keys, "fid"]).select(*keys, "fid", x.alias("x"), y.alias("y"), F.col("weight").cast("double").alias("weight"), F.coalesce("minzoom", F.lit(0)).alias("least"), "maxzoom")
    dealt = durable_table(points.withColumn("zoom", F.explode(F.sequence(F.lit(0), F.lit(max_zoom + 1)))).filter("maxzoom IS NULL OR maxzoom >= zoom").drop("maxzoom"))
    members = durable_table(_members(dealt.drop("least"), by, cells))
    own = dealt.select(*[F.col(c).alias(f"_{c}") for c in (*by, "fid")], "least")
    sets = members.join(own, _same([*by, "fid"], "_")).groupBy(*by, "best").agg(F.count(F.lit(1)).alias("n_members"), F.sum(F.xxhash64("fid").cast("decimal(38,0)")).alias("_set"), F.min("least").alias("least"))
    same = [*keys, "best", "n_members", "_set"]
    island = F.col("zoom") - F.row_number().over(Window.partitionBy(*same).orderBy("zoom"))
    spans = sets.withColumn("_i", island).groupBy(*same, "_i").agg(F.min("zoom").alias("at_zoom"), F.max("zoom").alias("last_zoom"), F.min("least").alias("least"))
    cut = spans.filter((F.col("at_zoom") <= max_zoom) & (F.col("least") <= F.col("last_zoom")))
    groups = cut.select(*keys, "best", "n_members", F.greatest("at_zoom", "least").alias("first_zoom"), F.when(F.col("last_zoom") <= max_zoom, F.col("last_zoom")).alias("last_zoom"), "at_zoom")
    return groups, members


def group_texts(members: DataFrame, group: list[str], label: str = "label", weight: str = "weight") -> DataFrame:
    """HTML list of each group's others: up to ten by label, else the nine heaviest and how many more."""
    # Ten rows of a group at most are ranked and collected, whatever its size.
    w = Window.partitionBy(*group).orderBy(F.desc(weight), label)
    top = members.select(*group, label, weight).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= LISTED)
    sizes = members.groupBy(*[F.col(g).alias(f"_{g}") for g in group]).agg(F.count(F.lit(1)).alias("_n"))
    kept = top.join(sizes, _same(group, "_")).filter((F.col("_n") <= LISTED) | (F.col("_r") < LISTED))
    named = F.struct(F.when(F.col("_n") <= LISTED, 0).otherwise(F.col("_r")).alias("r"), F.col(label).alias("label"))
    lists = kept.groupBy(*group).agg(F.max("_n").alias("n"), F.transform(F.array_sort(F.collect_list(named)), lambda s: F.concat(F.lit("<li>"), s["label"], F.lit("</li>"))).alias("items"))
    more = F.when(F.col("n") > LISTED, F.concat(F.lit("<li>and "), (F.col("n") - (LISTED - 1)).cast("string"), F.lit(" others</li>"))).otherwise("")
    return lists.select(*group, F.col("n").alias("n_members"), F.concat(F.lit("<ul>"), F.array_join("items", ""), more, F.lit("</ul>")).alias("text"))


def search_index(features: DataFrame) -> DataFrame:
    """category, label, timed (start, end, bbox, area of each time, sorted by index start): a row for each label, in ranges by category and label.

    features: category, label, time_start, time_end, time_index_start, time_index_end, lng, lat, area_m2, one row per vertex.
    """
    times = ["time_start", "time_end", "time_index_start", "time_index_end"]
    timed = features.groupBy("category", "label", *times).agg(F.min("lng").alias("w"), F.min("lat").alias("s"), F.max("lng").alias("e"), F.max("lat").alias("n"), F.max("area_m2").alias("area_m2"))
    one = (F.col("w") == F.col("e")) & (F.col("s") == F.col("n"))
    timed = timed.withColumn("bbox", F.when(one, F.array("w", "s")).otherwise(F.array("w", "s", "e", "n")))
    entry = F.struct("time_index_start", "time_start", "time_end", "time_index_end", "bbox", "area_m2")
    labels = timed.groupBy("category", "label").agg(F.array_sort(F.collect_list(entry)).alias("timed"))
    return labels.orderBy("category", "label")


def search_rows(index: DataFrame) -> DataFrame:
    """One row per category, label and time of an index."""
    return index.select("category", "label", F.inline("timed"))


def fuzzy_score(query: str, label: Column, category: Column) -> Column:
    """0 (the same) to 1: edit distance to the best part of a name, label weighing 2 and category 0.5."""
    q = query.lower()

    def part(c: Column) -> Column:
        low = F.lower(c)
        windows = F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - len(q) + 1, F.lit(1))), lambda i: F.substring(low, i, F.lit(len(q))))
        return F.when(F.contains(low, F.lit(q)), 0.0).otherwise(F.array_min(F.transform(windows, lambda x: F.levenshtein(x, F.lit(q)))) / len(q))

    return F.least(part(label), F.lit(0.2) + 0.8 * part(category)) if category is not None else part(label)


def search(rows: DataFrame, query: str, limit: int = 10, threshold: float = 0.4, categories: list[str] | None = None, year: int | None = None) -> DataFrame:
    """The best hits of a query; queries of less than two characters have none. Filters go below the ranking."""
    if len(query) < 2:
        return rows.withColumn("score", F.lit(0.0)).limit(0)
    if categories is not None:
        rows = rows.filter(F.col("category").isin(*categories))
    if year is not None:
        rows = rows.filter((F.col("time_start").isNull() | (F.col("time_start") <= year)) & (F.col("time_end").isNull() | (F.col("time_end") > year)))
    return rows.withColumn("score", fuzzy_score(query, F.col("label"), F.col("category"))).filter(F.col("score") <= threshold).orderBy("score", "label", "category").limit(limit)


def tile_xy(lng: Column, lat: Column, zoom: Column) -> tuple[Column, Column]:
    """Tile of a point, clamped to the world."""
    n = F.pow(F.lit(2.0), zoom)
    clamp = lambda v: F.least(F.greatest(F.floor(v), F.lit(0)), (n - 1).cast("bigint")).cast("int")
    y = (1 - F.asinh(F.tan(F.radians(F.least(F.greatest(lat, F.lit(-85.0511)), F.lit(85.0511))))) / 3.141592653589793) / 2
    return clamp((lng + 180) / 360 * n), clamp(y * n)


def tiles(boxes: DataFrame) -> DataFrame:
    """Every (zoom, x, y) that a feature's box covers at its export zooms: columns w, s, e, n, tile_minzoom, tile_maxzoom."""
    at = boxes.withColumn("z", F.explode(F.sequence("tile_minzoom", "tile_maxzoom")))
    x0, y0 = tile_xy(F.col("w"), F.col("n"), F.col("z"))
    x1, y1 = tile_xy(F.col("e"), F.col("s"), F.col("z"))
    return at.withColumn("x", F.explode(F.sequence(x0, x1))).withColumn("y", F.explode(F.sequence(y0, y1)))


def tile_box(z: Column, x: Column, y: Column, margin: float = 0.0) -> tuple[Column, Column, Column, Column]:
    """West, south, east and north of a tile, wider by a share of it; tiles at the edge of the world have no end there."""
    n = F.pow(F.lit(2.0), z)
    edge = lambda beyond, v: F.when(beyond, F.lit(None).cast("double")).otherwise(v)
    lng = lambda v: v / n * 360 - 180
    lat = lambda v: F.degrees(F.atan(F.sinh(F.lit(3.141592653589793) * (1 - 2 * v / n))))
    far = F.lit(float("inf"))
    return (
        F.coalesce(edge(x == 0, lng(x - margin)), -far), F.coalesce(edge(y == n - 1, lat(y + 1 + margin)), -far),
        F.coalesce(edge(x == n - 1, lng(x + 1 + margin)), far), F.coalesce(edge(y == 0, lat(y - margin)), far),
    )


def greedy_chunks(rows: DataFrame, key: list[str], fid: str, size: str, limit: int) -> DataFrame:
    """key, fid, chunk: rows in order of fid, a new chunk of each key begins when the one before holds limit or more. Only sizes are moved."""
    head = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in [*key, fid])

    def run(pdf):
        chunk, total, out = 0, 0, []
        pdf = pdf.sort_values(fid)
        for n in pdf[size]:
            if total >= limit:
                chunk, total = chunk + 1, 0
            out.append(chunk)
            total += n
        return pdf[[*key, fid]].assign(chunk=out)

    return rows.select(*key, fid, size).groupBy(*key).applyInPandas(run, f"{head}, chunk int")


def property_profile(layer: DataFrame, name: str) -> DataFrame:
    """layer, key, min_number, max_number, non_null, nulls of each property; keys sorted."""
    columns = [c for c, t in layer.dtypes if not t.startswith(("struct", "array", "map"))]
    number = lambda c: F.col(c).cast("double") if dict(layer.dtypes)[c] not in ("string", "boolean", "date", "timestamp") else F.lit(None).cast("double")
    aggs = [F.struct(F.lit(c).alias("key"), F.min(number(c)).alias("min_number"), F.max(number(c)).alias("max_number"), F.count(c).alias("non_null"), (F.count(F.lit(1)) - F.count(c)).alias("nulls")) for c in columns]
    wide = layer.agg(F.array(*aggs).alias("props"))
    return wide.select(F.lit(name).alias("layer"), F.inline("props")).orderBy("key")


def nearest_point(points: DataFrame, key: list[str], lng: float, lat: float, order: str) -> DataFrame:
    """The nearest point of each key to a place; of equal ones the later."""
    d = geo.planar_distance(F.col("lng"), F.col("lat"), F.lit(lng), F.lit(lat))
    return points.groupBy(*key).agg(F.min_by(F.struct("lng", "lat", order), F.struct(d, -F.col(order))).alias("p")).select(*key, "p.*")
