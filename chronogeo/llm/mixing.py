"""Mixing sources to target weights by systematic sampling. DataFrame functions only.

Sources in code point order, null last, weigh 5, 2, 1, repeating, and share
the words of all documents; no source takes more than ``max_repeat`` times its
size, and the excess is shared again by weight. Within a source every
document is expected rate = target / size times. Expected copies are summed
along the source, one offset per source is added, and a document is emitted
once for each whole number that its stretch of the sum crosses.

Along a source, documents lie by size class and, within one, by hash: taken
words then stay within about one document of the target. The sum is taken in
two steps (cells of a source, then rows of a cell), and a cell is a size class
and a range of hashes, so no task holds a large source. The number of ranges
grows with the root of the number of rows, at least ``SALTS``: cells of a
source and rows of a cell then both grow slower than the input. It changes no
result, as ranges follow one another in the order of hashes. Rows alike in
doc_id, source and size, which have one hash, are counted by partition before
they meet, so that no task holds all rows of one id, or all without any.

Defined results: a null text has size 0; a null source is a source of its own;
a source without words has target 0 and emits nothing; rows that repeat a
doc_id, or have none, are separate documents, and which of those of one source
and size are emitted is left open; reruns give the same copies; an empty table
gives an empty result; columns other than id, source and text are ignored by
``mixed`` and kept by ``emit_rows``, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronogeo.session import durable, durable_table

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
SALTS = 64
HASH_BITS = 32
#: Sizes with the same bit length and the same so many leading bits are one class.
CLASS_BITS = 4
WORD = r"[^\x20\x09-\x0D]+"
SEED = "mix"


def sized(docs: DataFrame, text: str, doc_id: str, source: str) -> DataFrame:
    digest = F.md5(F.concat_ws("|", F.lit(SEED), F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("-"))))
    size = F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), size.alias("size"), F.conv(F.substring(digest, 1, 8), 16, 10).cast("long").alias("hash"))
    bits = F.length(F.bin("size"))
    leading = F.expr(f"shiftright(size, greatest(length(bin(size)) - {CLASS_BITS}, 0))")
    return rows.withColumn("class", (bits * 2**CLASS_BITS + leading).cast("int"))


def salt_bits(n: int, least: int = SALTS) -> int:
    """Bits of the hash that tell the ranges of n rows apart."""
    return min(HASH_BITS, max((least - 1).bit_length(), (math.isqrt(max(0, n)) // 32).bit_length()))


def source_targets(cells: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """source, source_size, target. Only single rows of totals reach the driver."""
    sizes = cells.groupBy("source").agg(F.sum("words").alias("source_size"))
    n = max(1, int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = durable(sizes.repartitionByRange(n, F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()))
    before = ordered.groupBy("part").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1 + F.col("before")
    table = F.array(*[F.lit(w) for w in weights])
    weighted = durable(
        ordered.join(before.drop("n"), "part")
        .withColumn("weight", F.element_at(table, (rank % len(weights) + 1).cast("int")).cast("long"))
        .select("source", "source_size", "weight")
        .withColumn("cap", F.col("source_size") * max_repeat)
    )
    level = None
    while True:
        free = F.lit(True) if level is None else F.col("cap") > F.col("weight") * F.lit(level)
        row = weighted.agg(F.sum("source_size").alias("all"), F.coalesce(F.sum(F.when(~free, F.col("cap"))), F.lit(0)).alias("capped"), F.coalesce(F.sum(F.when(free, F.col("weight"))), F.lit(0)).alias("weight")).first()
        if not row["weight"]:
            break
        following = (row["all"] - row["capped"]) / float(row["weight"])
        if following == level:
            break
        level = following
    return weighted.withColumn("target", F.least(F.col("cap").cast("double"), F.col("weight") * F.lit(level or 0.0))).select("source", "source_size", "target")


def copies(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", source: str = "source", weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, one row per input row."""
    rows = durable(sized(docs, text, doc_id, source))
    # Rows that are alike, counted in each partition of the saved table; no group is larger than a partition.
    alike = ["doc_id", "source", "size", "hash", "class", "salt"]
    rows = rows.withColumn("part", F.spark_partition_id()).withColumn("salt", F.shiftright("hash", HASH_BITS - salt_bits(rows.count())).cast("int"))
    cells = rows.groupBy("source", "class", "salt").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words"))
    targets = source_targets(cells, weights, max_repeat)
    along = Window.partitionBy("source").orderBy("class", "salt").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(SEED), F.lit("offset"), F.coalesce(F.col("source"), F.lit("-")))), 1, 5), 16, 10).cast("double") / 1048576.0
    placed = cells.withColumn("before", F.coalesce(F.sum("n").over(along), F.lit(0))).select(F.col("source").alias("c_source"), F.col("class").alias("c_class"), F.col("salt").alias("c_salt"), "before")
    targets = targets.select(F.col("source").alias("t_source"), "source_size", "target")
    placed = placed.join(targets, F.col("c_source").eqNullSafe(F.col("t_source"))).drop("t_source")
    groups = rows.groupBy(*alike, "part").agg(F.count(F.lit(1)).alias("rows"))
    inside = Window.partitionBy("source", "class", "salt").orderBy("hash", "doc_id", "size", "part").rowsBetween(Window.unboundedPreceding, -1)
    here = groups.withColumn("ahead", F.coalesce(F.sum("rows").over(inside), F.lit(0)))
    joined = here.join(placed, F.col("source").eqNullSafe(F.col("c_source")) & (F.col("class") == F.col("c_class")) & (F.col("salt") == F.col("c_salt")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    joined = joined.withColumn("place", F.explode(F.sequence(F.col("ahead") + 1, F.col("ahead") + F.col("rows"))))
    end = F.col("before") + F.col("place")
    crossed = F.floor(end * rate + offset) - F.floor((end - 1) * rate + offset)
    return joined.select("doc_id", "source", "size", "source_size", "target", F.least(crossed, F.lit(max_repeat)).cast("long").alias("copies"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken (words the mix takes, repeats counted)."""
    return copies(docs, **options).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def emit_rows(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", source: str = "source", **options) -> DataFrame:
    """The mix itself: rows of docs, each as often as it is taken, with docs' columns only.

    Rows that repeat a doc_id and a source and a size share out their copies in
    one order, so that the number of emitted rows is that of ``copies``.
    """
    names = docs.columns
    taken = [F.count_if(F.col("copies") >= c).alias(f"at_least_{c}") for c in range(1, options.get("max_repeat", MAX_REPEAT) + 1)]
    plan = copies(docs, text=text, doc_id=doc_id, source=source, **options)
    plan = plan.groupBy(F.col("doc_id").alias("p_id"), F.col("source").alias("p_source"), F.col("size").alias("p_size")).agg(F.count(F.lit(1)).alias("n"), F.array(*taken).alias("taken"))
    plan = durable(plan.filter(F.col("taken")[0] > 0))  # a table of its own, so that Spark can split rows that are alike
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(f"`{doc_id}`").alias("id"), F.col(f"`{source}`").alias("src"), F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(WORD)), F.lit(0)).cast("long").alias("words"))
    same = F.col("id").eqNullSafe(F.col("p_id")) & F.col("src").eqNullSafe(F.col("p_source")) & (F.col("words") == F.col("p_size"))
    repeated = lambda nth: F.explode(F.sequence(F.lit(1), F.size(F.filter("taken", lambda c: c >= nth)))).alias("copy")
    one = rows.join(plan.filter("n = 1"), same).select("row", repeated(F.lit(1))).select("row.*")
    many = plan.filter("n > 1")
    if many.isEmpty():
        return one
    # Rows that are alike: numbered in each partition of a saved table, and from partition to partition.
    several = durable(rows.join(many, same).select("row", "p_id", "p_source", "p_size", "taken")).withColumn("part", F.spark_partition_id())
    key = ["p_id", "p_source", "p_size"]
    ahead = F.coalesce(F.sum("rows").over(Window.partitionBy(*key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = several.groupBy(*key, "part").agg(F.count(F.lit(1)).alias("rows")).withColumn("ahead", ahead)
    parts = parts.select(*[F.col(c).alias(f"of_{c}") for c in (*key, "part")], "ahead")
    numbered = several.withColumn("nth", F.row_number().over(Window.partitionBy(*key, "part").orderBy(F.lit(1))))
    on = F.col("p_id").eqNullSafe(F.col("of_p_id")) & F.col("p_source").eqNullSafe(F.col("of_p_source")) & (F.col("p_size") == F.col("of_p_size")) & (F.col("part") == F.col("of_part"))
    counted = numbered.join(parts, on).withColumn("nth", F.col("nth") + F.col("ahead")).filter(F.col("nth") <= F.col("taken")[0])
    return one.unionByName(counted.select("row", repeated(F.col("nth"))).select("row.*"))
