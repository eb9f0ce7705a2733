"""Valid-time interval algebra on half-open integer ranges; null is unbounded.

Spark's greatest and least skip nulls, which is what unbounded ends need.
Slices are a column, never a loop: a layer is cut by one join with the slice
axis and put together again by one window per distinct feature.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronogeo.session import by_size

#: A slice axis up to this many rows is broadcast, and else joined by buckets.
MAX_BROADCAST_SLICES = 100_000


def intersects(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Whether two ranges share time; touching ranges and empty ranges don't."""
    return F.coalesce(F.greatest(s1, s2) < F.least(e1, e2), F.lit(True))


def intersection(s1: Column, e1: Column, s2: Column, e2: Column) -> tuple[Column, Column]:
    return F.greatest(s1, s2), F.least(e1, e2)


def contains(start: Column, end: Column, at: Column) -> Column:
    return (start.isNull() | (start <= at)) & (end.isNull() | (at < end))


def barriers(*layers: DataFrame, start: str = "time_start", end: str = "time_end") -> DataFrame:
    """Distinct bounds of all ranges: column barrier."""
    both = [x.select(F.explode(F.array(start, end)).alias("barrier")) for x in layers]
    return reduce(DataFrame.unionByName, both).filter("barrier IS NOT NULL").distinct()


def slices(bounds: DataFrame) -> DataFrame:
    """slice_start, slice_end of the n + 1 ranges between n barriers; one unbounded slice for none.

    The axis is a dictionary (tens of rows, one per distinct year at most), so one ordered window is right.
    """
    w = Window.orderBy("barrier")
    inner = bounds.select(F.col("barrier").alias("slice_start"), F.lead("barrier").over(w).alias("slice_end"))
    first = bounds.agg(F.min("barrier").alias("slice_end")).select(F.lit(None).cast("int").alias("slice_start"), "slice_end")
    return first.unionByName(inner)


def time_meta(axis: DataFrame) -> DataFrame:
    """id, slice_start, slice_end: slices numbered so that the latest is 0."""
    w = Window.orderBy(F.col("slice_start").asc_nulls_first())
    n = F.count(F.lit(1)).over(Window.partitionBy())
    return axis.select((F.row_number().over(w) - n).cast("int").alias("id"), "slice_start", "slice_end")


def collect_time_meta(*layers: DataFrame) -> DataFrame:
    """Global slice dictionary of all layers; at most one slice is an error, raised when it is read."""
    meta = time_meta(slices(barriers(*layers)))
    ok = F.count(F.lit(1)).over(Window.partitionBy()) > 1
    return meta.withColumn("id", F.when(ok, F.col("id")).otherwise(F.raise_error(F.lit("at most one time slice"))))


def bucket_join(left: DataFrame, right: DataFrame, condition: Column, ranges: tuple[str, str, str, str], width: int, low: int, high: int, small: bool = False) -> DataFrame:
    """Overlap join by equal buckets: both sides go to buckets of a width, and a pair meets in its first common one.

    ranges: start and end column of left, then of right. low and high bound the buckets of unbounded ends and of what lies
    beyond. small: right is broadcast.
    """
    s1, e1, s2, e2 = ranges

    def within(v: Column) -> Column:
        return F.least(F.greatest(v, F.lit(low)), F.lit(high - 1))

    def first(s: str) -> Column:
        return F.floor(within(F.coalesce(F.col(s), F.lit(low))) / width)

    def last(e: str) -> Column:
        return F.floor(within(F.coalesce(F.col(e), F.lit(high)) - 1) / width)

    def dealt(x: DataFrame, s: str, e: str, name: str) -> DataFrame:
        return x.withColumn(f"{name}_first", first(s)).withColumn(f"{name}_bucket", F.explode(F.when(last(e) >= first(s), F.sequence(first(s), last(e)))))

    a, b = dealt(left, s1, e1, "_l"), dealt(right, s2, e2, "_r")
    met = a.join(F.broadcast(b) if small else b, (F.col("_l_bucket") == F.col("_r_bucket")) & (F.col("_l_bucket") == F.greatest("_l_first", "_r_first")) & condition)
    return met.drop("_l_first", "_l_bucket", "_r_first", "_r_bucket")


def slice_layer(layer: DataFrame, axis: DataFrame, start: str = "time_start", end: str = "time_end") -> DataFrame:
    """Each feature once per slice that it lives in, its range clipped to the slice.

    They are joined by buckets of time, so that a feature isn't compared with every slice; a small axis is broadcast behind
    a check of its size.
    """
    hit = intersects(F.col(start), F.col(end), F.col("slice_start"), F.col("slice_end"))
    row = axis.agg(F.count(F.lit(1)).alias("n"), F.min("slice_end").alias("low"), F.max("slice_start").alias("high")).first()
    n = row["n"]
    if row["low"] is None or row["high"] is None:  # one slice, or none
        met = layer.join(F.broadcast(axis), hit)
    else:
        low, high = row["low"] - 1, row["high"] + 1
        met = bucket_join(layer, axis, hit, (start, end, "slice_start", "slice_end"), max(1, (high - low) // n), low, high, n <= MAX_BROADCAST_SLICES)
    s, e = intersection(F.col(start), F.col(end), F.col("slice_start"), F.col("slice_end"))
    return met.withColumn(start, s).withColumn(end, e)


def coalesce_time(rows: DataFrame, keys: list[str], start: str = "time_start", end: str = "time_end") -> DataFrame:
    """Rows equal in keys with touching or overlapping ranges become one row per maximal range.

    Nothing but the keys and the range is returned. Empty ranges count for nothing.
    """
    rows = rows.select(*keys, start, end).filter(F.coalesce(F.col(start) < F.col(end), F.lit(True)))
    low, high = -(2**31), 2**31 - 1
    s, e = F.coalesce(F.col(start), F.lit(low)), F.coalesce(F.col(end), F.lit(high))
    w = Window.partitionBy(*keys).orderBy("_s", "_e")
    reach = F.max("_e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col("_s") > reach), 1).otherwise(0)
    marked = rows.withColumn("_s", s).withColumn("_e", e).withColumn("_new", new)
    island = F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    merged = marked.withColumn("_island", island).groupBy(*keys, "_island").agg(F.min("_s").alias("_s"), F.max("_e").alias("_e"))
    return merged.select(*keys, F.when(F.col("_s") > low, F.col("_s")).cast("int").alias(start), F.when(F.col("_e") < high, F.col("_e")).cast("int").alias(end))


def merge_layer(sliced: DataFrame, start: str = "time_start", end: str = "time_end", size: int = 0) -> DataFrame:
    """The opposite of slice_layer: features equal in all but time get their maximal ranges.

    Whole features are sorted; of a layer of a size (in vertices) each task has so many of them.
    """
    keys = [c for c in sliced.columns if c not in (start, end, "slice_start", "slice_end")]
    return coalesce_time(by_size(sliced, keys, size) if size else sliced, keys, start, end)


def _elementary(rows: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Keys' ranges between neighbouring bounds: _from, _to (null: unbounded)."""
    low, high = -(2**31), 2**31 - 1
    bounds = rows.select(*keys, F.explode(F.array(F.coalesce(F.col(start), F.lit(low)), F.coalesce(F.col(end), F.lit(high)))).alias("_from")).distinct()
    w = Window.partitionBy(*keys).orderBy("_from")
    pieces = bounds.withColumn("_to", F.lead("_from").over(w)).filter("_to IS NOT NULL")
    return pieces


def _range_combine(rows: DataFrame, keys: list[str], pick: Column, start: str, end: str) -> DataFrame:
    low, high = -(2**31), 2**31 - 1
    pieces = _elementary(rows, keys, start, end).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_from", "_to")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    covers = (F.coalesce(F.col(start), F.lit(low)) <= F.col("_from")) & (F.coalesce(F.col(end), F.lit(high)) >= F.col("_to"))
    best = rows.join(pieces, same & covers).groupBy(*keys, "_from", "_to").agg(pick.alias("value"))
    best = best.select(*keys, "value", F.when(F.col("_from") > low, F.col("_from")).alias(start), F.when(F.col("_to") < high, F.col("_to")).alias(end))
    return coalesce_time(best, [*keys, "value"], start, end)


def range_merge(rows: DataFrame, keys: list[str], value: str, start: str = "time_start", end: str = "time_end") -> DataFrame:
    """Per key a map from range to value, the least value where ranges overlap, equal neighbours joined."""
    return _range_combine(rows, keys, F.min(value), start, end)


def range_put(rows: DataFrame, keys: list[str], value: str, order: str, start: str = "time_start", end: str = "time_end") -> DataFrame:
    """As range_merge, but the row with the greatest order wins where ranges overlap."""
    return _range_combine(rows, keys, F.max_by(value, order), start, end)


def range_subtract(rows: DataFrame, taken: DataFrame, keys: list[str], start: str = "time_start", end: str = "time_end") -> DataFrame:
    """Per key the time in rows that isn't in taken."""
    marked = rows.select(*keys, start, end, F.lit(0).alias("_out")).unionByName(taken.select(*keys, start, end, F.lit(1).alias("_out")))
    return _range_combine(marked, keys, F.max("_out"), start, end).filter("value = 0").drop("value")


def align(layers: dict[str, DataFrame], start: str = "time_start", end: str = "time_end") -> dict[str, DataFrame]:
    """All layers cut by one common axis; a layer without features in a slice is empty there."""
    axis = slices(barriers(*layers.values(), start=start, end=end))
    return {name: slice_layer(x, axis, start, end) for name, x in layers.items()}


def pad(sliced: DataFrame, axis: DataFrame, key: str) -> DataFrame:
    """Every slice of the axis, with the layer's rows or one row without a feature."""
    a = axis.select(F.col("slice_start").alias("_s"), F.col("slice_end").alias("_e"))
    met = a.join(sliced, F.col("_s").eqNullSafe(F.col("slice_start")) & F.col("_e").eqNullSafe(F.col("slice_end")), "left")
    return met.withColumn("slice_start", F.col("_s")).withColumn("slice_end", F.col("_e")).drop("_s", "_e")


def time_index(layer: DataFrame, meta: DataFrame, key: list[str], start: str = "time_start", end: str = "time_end") -> DataFrame:
    """key, time_index_start (first slice that the feature lives in), time_index_end (last one plus 1)."""
    found = slice_layer(layer.select(*key, start, end), meta, start, end).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], "id")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(key)])
    found = found.groupBy(*[f"_k{i}" for i in range(len(key))]).agg(F.min("id").alias("_low"), F.max("id").alias("_high"))
    met = layer.select(*key).join(found, same, "left").groupBy(*key).agg(F.min("_low").alias("_first"), F.max("_high").alias("_last"))
    first = F.when(F.col("_first").isNull(), F.raise_error(F.lit("no slice for a range"))).otherwise(F.col("_first"))
    return met.select(*key, first.cast("int").alias("time_index_start"), (F.col("_last") + 1).cast("int").alias("time_index_end"))


def index_years(ids: DataFrame, meta: DataFrame, column: str = "id") -> DataFrame:
    """slice_start, slice_end of an index: unknown is the last slice, null is always."""
    low = meta.agg(F.min("id")).first()[0]
    asked = F.when(F.col(column).between(low, 0), F.col(column)).when(F.col(column).isNotNull(), 0)
    m = meta.select(F.col("id").alias("_id"), "slice_start", "slice_end")
    return ids.join(m, asked == F.col("_id"), "left").drop("_id")


def limit_time(layer: DataFrame, low: int | None, high: int | None, start: str = "time_start", end: str = "time_end") -> DataFrame:
    """Features within a window, clipped to it."""
    lo, hi = F.lit(low).cast("int"), F.lit(high).cast("int")
    s, e = intersection(F.col(start), F.col(end), lo, hi)
    return layer.filter(intersects(F.col(start), F.col(end), lo, hi)).withColumn("_s", s).withColumn("_e", e).drop(start, end).withColumnsRenamed({"_s": start, "_e": end})


def slice_label(s: Column, e: Column) -> Column:
    """before X, since X, X for one year, X - Y for several."""
    text = lambda c: c.cast("string")
    return (
        F.when(s.isNull() & e.isNull(), F.lit("always"))
        .when(s.isNull(), F.concat(F.lit("before "), text(e)))
        .when(e.isNull(), F.concat(F.lit("since "), text(s)))
        .when(e - s == 1, text(s))
        .otherwise(F.concat(text(s), F.lit(" - "), text(e - 1)))
    )


def representative_year(s: Column, e: Column) -> Column:
    return F.coalesce(s, e - 1)


def year_to_slice(years: DataFrame, meta: DataFrame, year: str = "year") -> DataFrame:
    """years with the id of the slice that holds each."""
    distinct = years.select(F.col(year).alias("_year"), (F.col(year) + 1).alias("_after")).filter("_year IS NOT NULL").distinct()
    found = slice_layer(distinct, meta, "_year", "_after")
    return years.join(found.drop("_after"), F.col(year) == F.col("_year"), "left").drop("_year")


def has_time(layer: DataFrame, start: str = "time_start", end: str = "time_end") -> bool:
    """Whether a layer is MERGED (some feature has a bound) or TIMELESS."""
    return not layer.filter(F.col(start).isNotNull() | F.col(end).isNotNull()).isEmpty()
