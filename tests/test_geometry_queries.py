import __spark_entry__ as entry


def _parts(spark, tmp_path, keys):
    """A folder with a table part of the given keys, all of one brand."""
    spark.createDataFrame([(k, "Brand#11") for k in keys], "p_partkey bigint, p_brand string").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    return str(tmp_path)


def test_pebbles_of_a_sliced_layer(spark, tmp_path):
    rows = entry.queries()["pattern_pebbles"](spark, _parts(spark, tmp_path, range(20))).collect()
    area = {r["fid"]: r["area"] for r in rows}
    assert sorted(area) == list(range(20)) and all(area[k] > 0 for k in area)


def test_detail_of_stacks_that_lie_on_one_another(spark, tmp_path):
    """21 degrees for each stack: 120 stacks are seven times round."""
    keys = [0, 1, 120 * 800, 120 * 800 + 1]
    rows = entry.queries()["fractal_detail"](spark, _parts(spark, tmp_path, keys)).collect()
    assert {r["fid"]: r["vertices"] for r in rows} == dict.fromkeys(keys, 26)
