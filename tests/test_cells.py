"""Cells: shapes in and out, scans, filters and mutations on small literals."""

from __future__ import annotations

from bisect import bisect_right

import pytest
from pyspark.sql import functions as F

from quernstone.functions import codecs
from quernstone.operators import bulkload, mutate, predicates, ranks
from quernstone.operators.cells import Field, from_entities, from_headers, from_map, from_nested, latest, nested, to_entities
from quernstone.operators.scan import ScanSpec, entities, point_get, pulled, row_page, scan
from quernstone.sources import tables

FIELDS = [Field("v1", "t1"), Field("v2", "t1")]


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()))


@pytest.fixture()
def cells(spark):
    df = spark.createDataFrame([("r1", "f", "a", 1, "x"), ("r1", "f", "a", 2, "y"), ("r1", "g", "b", 1, "z"), ("r2", "f", "a", 5, "10"), ("r3", "f", "a", 1, "9")], "row_key string, family string, qualifier string, ts long, v string")
    return df.select("row_key", "family", "qualifier", "ts", F.encode("v", "UTF-8").alias("value"))


def test_put_get_scan(spark):
    e = spark.createDataFrame([("r1", "v1", "v2"), ("r2", "v3", "v4"), (None, "x", "y")], "row_key string, v1 string, v2 string")
    cells = from_entities(e, FIELDS, "row_key", 7)
    assert rows(point_get(cells, "r1", FIELDS), "row_key", "v1", "v2") == [("r1", "v1", "v2")]
    assert rows(entities(cells, ScanSpec(start="r1", stop="r2", include_stop=True), FIELDS), "row_key", "v1") == [("r1", "v1"), ("r2", "v3")]
    assert rows(entities(cells, ScanSpec(start="r1", stop="r2"), FIELDS), "row_key") == [("r1",)]


def test_nested_families_missing_and_newest_wins(cells):
    got = {r.row_key: r.data for r in nested(cells, columns={"f": ["a"], "g": ["b"]}).collect()}
    assert got["r1"] == {"f": {"a": "y"}, "g": {"b": "z"}}
    assert got["r2"] == {"f": {"a": "10"}, "g": {}}
    by_family = {r.row_key: r.data for r in nested(cells, families=["f", "g"], with_ts=True).collect()}
    assert set(by_family["r2"]) == {"f"} and by_family["r1"]["f"]["a"].ts == 2


def test_write_shapes(spark):
    df = spark.createDataFrame([("k", {"q": "v"}, ["1", "2"], {"f": {"q": "v"}, "z": {}})], "row_key string, data map<string,string>, values array<string>, n map<string,map<string,string>>")
    assert rows(from_map(df, "f", ts=1), "row_key", "family", "qualifier", "ts") == [("k", "f", "q", 1)]
    assert rows(from_headers(df, "f", ["a", "b", "c"], ts=1), "qualifier") == [("a",), ("b",)]
    assert rows(from_headers(df, "f", ["a"], ts=1), "qualifier") == [("a",)]
    assert rows(from_nested(df, "n", ts=1), "family", "qualifier") == [("f", "q")]
    assert rows(from_nested(df, "n", ts=1, families=["z"]), "family") == []


def test_value_comparison_is_by_bytes(cells):
    keep = lambda f: [r[0] for r in rows(scan(cells, ScanSpec(filters=(f,))).select("row_key").distinct(), "row_key")]
    assert keep(predicates.lt("f", "a", "9")) == ["r2"]
    assert keep(predicates.eq("f", "a", "x")) == []  # the newest version is tested
    assert keep(predicates.neq("g", "b", "q")) == ["r1"]  # rows without the column go
    assert keep(predicates.substring("f", "a", "Y")) == ["r1"]
    assert keep(predicates.regex("f", "a", "[0-9]")) == ["r2", "r3"]


def test_versions_limits_pages(cells):
    assert rows(scan(cells, ScanSpec(max_versions=1)), "row_key", "qualifier", "ts") == [("r1", "a", 2), ("r1", "b", 1), ("r2", "a", 5), ("r3", "a", 1)]
    assert rows(scan(cells, ScanSpec(family_limit=1, family_offset=1)), "row_key", "ts") == [("r1", 1)]
    assert rows(row_page(cells, 1, 2), "row_key") == [("r2",)]
    assert [len(x) for x in pulled(cells, 2)] == [2, 2, 1]
    assert rows(scan(cells, ScanSpec(time_range=(1, 2))), "row_key") == [("r1",), ("r1",), ("r3",)]


def test_deletes(spark, cells):
    keys = spark.createDataFrame([("r1",), (None,)], "row_key string")
    assert rows(mutate.delete_rows(cells, keys).select("row_key").distinct(), "row_key") == [("r2",), ("r3",)]
    assert rows(mutate.delete_families(cells, keys, ["g"]), "row_key", "family").count(("r1", "g")) == 0
    assert mutate.delete_columns(cells, keys, {"f": []}).count() == cells.count()
    assert mutate.delete_columns(cells, keys, {"f": ["a"]}).count() == cells.count() - 2
    sets = spark.createDataFrame([("r1", ["a"]), ("r2", [])], "row_key string, qualifiers array<string>")
    assert mutate.delete_column_sets(cells, sets, "f").count() == cells.count() - 2
    versions = spark.createDataFrame([("r1", "f", "a", 2)], "row_key string, family string, qualifier string, ts long")
    assert [r for r in rows(latest(mutate.delete_versions(cells, versions)), "row_key", "qualifier", "ts") if r[0] == "r1"] == [("r1", "a", 1), ("r1", "b", 1)]
    tombs = spark.createDataFrame([("r1", "f", None, None), ("r2", None, None, None)], "row_key string, family string, qualifier string, ts long")
    assert rows(mutate.apply_tombstones(cells, tombs), "row_key", "family") == [("r1", "g"), ("r3", "f")]


def test_upsert_counts_the_change(spark, cells):
    change = spark.createDataFrame([("r2", "f", "a", 5, b"new")], cells.schema)
    assert bytes(latest(mutate.upsert(cells, change)).where("row_key = 'r2'").first().value) == b"new"


@pytest.mark.parametrize("kind,spark_type,values", [
    ("int", "int", [0, 1, -1, 2**31 - 1, -(2**31)]), ("long", "long", [0, -5, 2**63 - 1, -(2**63)]), ("short", "short", [0, -1, 32767, -32768]), ("byte", "tinyint", [0, -128, 127]),
    ("boolean", "boolean", [True, False]), ("double", "double", [0.0, -1.5, 1e300]), ("float", "float", [0.0, 2.5]), ("string", "string", ["", "é"]), ("char", "string", ["a", "é"]),
])
def test_codecs_round_trip(spark, kind, spark_type, values):
    df = spark.createDataFrame([(v,) for v in [*values, None]], f"v {spark_type}")
    out = df.select("v", codecs.decode(kind, codecs.encode(kind, F.col("v"))).alias("w")).collect()
    assert all(r.v == r.w for r in out)


def test_codec_bytes(spark):
    r = spark.range(1).select(codecs.encode("int", F.lit(-2)).alias("i"), codecs.encode("double", F.lit(1.0)).alias("d"), codecs.decode("int", F.lit(b"abc")).alias("bad")).first()
    assert bytes(r.i) == b"\xff\xff\xff\xfe" and bytes(r.d) == b"\x3f\xf0\0\0\0\0\0\0" and r.bad is None


def test_exact_tiles_equal_ntile(spark):
    df = spark.range(103).select((F.col("id") * 7 % 101).alias("k"))
    got = rows(ranks.tiles(df, "k", 8, parts=5).groupBy("tile").agg(F.count("*").alias("n"), F.min("k").alias("lo")), "tile", "n", "lo")
    df.createOrReplaceTempView("t")
    want = rows(spark.sql("select tile, count(*) n, min(k) lo from (select k, ntile(8) over (order by k) tile from t) group by tile"), "tile", "n", "lo")
    assert got == want


def test_bulk_load_publishes_sorted_files(spark, cells, tmp_path):
    path = f"file://{tmp_path}/table"
    for _ in range(2):
        loaded = bulkload.bulk_load(cells, path, ["r2"], ["f"], files_per_region=2)
    assert loaded.count() == 8 and {r.family for r in loaded.collect()} == {"f"}
    assert not [p for p in (tmp_path / "table").iterdir() if p.name.startswith("_")]


def test_tables_in_the_catalog(spark, cells):
    tables.create(spark, "cells_test", ["f", "g"], ["r2"])
    tables.create(spark, "cells_test", ["other"])
    assert tables.exists(spark, "cells_test") and tables.families(spark, "cells_test") == ["f", "g"] and tables.splits(spark, "cells_test") == ["r2"]
    with pytest.raises(tables.MissingFamily, match="zz"):
        tables.check(spark, "cells_test", ["f", "zz"])
    cells.select("row_key", "qualifier", "ts", "value", "family").write.insertInto("cells_test")
    snap = tables.snapshot(spark, "cells_test", "cells_snap")
    tables.truncate(spark, "cells_test", keep_splits=False)
    assert spark.table("cells_test").count() == 0 and spark.table(snap).count() == 5 and tables.splits(spark, "cells_test") == []
    tables.drop(spark, "cells_test")
    tables.drop(spark, snap)
    assert not tables.check(spark, "cells_test", [])


def test_entities_unset_stay_null(cells):
    got = rows(to_entities(cells, [Field("a", "f"), Field("b", "g")]), "row_key", "a", "b")
    assert got[1:] == [("r2", "10", None), ("r3", "9", None)]


def test_range_of_counts_split_keys(spark):
    keys = spark.range(-2, 60).selectExpr("id AS k").union(spark.sql("SELECT CAST(null AS BIGINT)"))
    for splits in ([], [7], [3, 3, 9], [9, 4, 30], list(range(0, 50, 2)), list(range(1, 38))):
        got = keys.select("k", ranks.range_of(F.col("k"), splits).alias("n")).collect()
        assert all(r.n == (0 if r.k is None else bisect_right(sorted(splits), r.k)) for r in got)
