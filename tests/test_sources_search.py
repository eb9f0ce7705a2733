import random
import sqlite3
import struct

import pytest
from pyspark.sql import functions as F

from chronogeo.operators import fuzzy
from chronogeo.sources import readers


def blob(x, y):
    return b"GP\x00\x01" + struct.pack("<i", 4326) + b"\x01" + struct.pack("<I2d", 1, x, y)


@pytest.fixture(scope="module")
def package(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("layers") / "map.gpkg")
    rng = random.Random(1)
    with sqlite3.connect(path) as con:
        con.execute('CREATE TABLE "my layer" (fid INTEGER PRIMARY KEY, geom POINT, "the name" TEXT, size MEDIUMINT, share REAL, big BOOLEAN)')
        rows = [(i * 3 + 1, blob(i, -i), None if i % 7 == 0 else f"n{i % 50}", rng.randint(0, 99), i / 8, i % 2) for i in range(20_000)]
        con.executemany('INSERT INTO "my layer" VALUES (?, ?, ?, ?, ?, ?)', rows)
        con.execute("CREATE TABLE bare (fid INTEGER PRIMARY KEY, label TEXT)")
    return path, rows


def test_layer_scan_in_ranges(spark, package, tmp_path):
    path, rows = package
    scan = readers.scan_layer(spark, path, "my layer", 6)
    assert scan.rdd.getNumPartitions() == 6 and scan.dtypes == [("geom", "binary"), ("the name", "string"), ("size", "bigint"), ("share", "double"), ("big", "boolean")]
    sizes = [r["count"] for r in scan.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 6 and max(sizes) < 1.1 * min(sizes)
    got = scan.withColumn("g", readers.geometry_column(F.col("geom")))
    assert sorted((r["the name"] or "", r["size"], r["share"], r["big"], r.g.coords[0][0][0][0]) for r in got.collect()) == sorted((n or "", s, x, bool(b), float((i - 1) // 3)) for i, _, n, s, x, b in rows)
    staged = readers.stage_layer(path, "my layer", str(tmp_path), spark)
    assert staged.count() == 20_000 and "fid" not in staged.columns
    assert readers.scan_layer(spark, path, "my layer", columns=["size"]).columns == ["size"]
    assert readers.scan_layer(spark, path, "bare").collect() == []
    with pytest.raises(Exception, match="no layer"):
        readers.scan_layer(spark, path, "absent")


def test_layer_filters_are_pushed(spark, package):
    path, rows = package
    name = "spark.sql.python.filterPushdown.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        scan = readers.scan_layer(spark, path, "my layer", 4)
        some = scan.filter((F.col("size") >= 90) & (F.col("the name") == "n3") & F.col("share").isNotNull())
        want = sum(1 for _, _, n, s, _, _ in rows if s >= 90 and n == "n3")
        assert some.count() == want > 0
        plan = some._jdf.queryExecution().executedPlan().toString()
        assert "Filter" not in plan.split("BatchScan")[0] or "size" not in plan.split("BatchScan")[0]
        assert scan.filter(F.col("the name").isNull()).count() == sum(1 for r in rows if r[2] is None)
        assert scan.filter(F.col("size").isin(1, 2)).count() == sum(1 for r in rows if r[3] in (1, 2))
        assert scan.filter(F.length("the name") == 2).count() == sum(1 for r in rows if r[2] and len(r[2]) == 2)  # not for the file
    finally:
        spark.conf.set(name, before)


def test_fuzzy_search_finds_what_a_full_scan_finds(spark):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("aabcd e") for _ in range(n))
    rows = [(rng.choice(["City", "cab", "river bed", None]), word(rng.randint(0, 14))) for _ in range(400)] + [("City", None), (None, "abc"), ("City", "ABC dab")]
    asked = [(i, word(rng.randint(1, 12)).strip()) for i in range(60)] + [(90, "river"), (91, "ab"), (92, "a"), (93, ""), (94, "CITY"), (95, "citx"), (96, "zzzz")]
    names = spark.createDataFrame(rows, "category string, label string")
    queries = spark.createDataFrame(asked, "qid int, query string")
    got = {(r.qid, r["rank"]): (r.category, r.label, round(r.score, 9)) for r in fuzzy.search_all(names, queries).collect()}
    pairs = names.distinct().join(queries.filter(F.length("query") > 1).withColumn("query", F.lower("query")))
    full = pairs.withColumn("score", fuzzy.score(F.col("query"), F.col("label"), F.col("category"))).filter("score <= 0.4").collect()
    want = {}
    for qid in {r.qid for r in full}:
        own = sorted((r for r in full if r.qid == qid), key=lambda r: (r.score, r.label is not None, r.label or "", r.category is not None, r.category or ""))[:10]
        want |= {(qid, k + 1): (r.category, r.label, round(r.score, 9)) for k, r in enumerate(own)}
    assert got == want and len(got) > 200
    assert fuzzy.search_all(names.limit(0), queries).collect() == []
