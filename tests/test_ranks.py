"""Selection by rank, sketched splits, merged ranges, bucketed stores and atomic loads."""

from __future__ import annotations

import random
import uuid

import pytest
from pyspark.sql import functions as F

from quernstone.operators import buckets, bulkload, predicates, ranks
from quernstone.operators.scan import row_page
from quernstone.sources import tables

CELLS = "row_key string, family string, qualifier string, ts long, value binary"


def some_keys(n, seed=1):
    rng = random.Random(seed)
    return [rng.choice(["", "a", "key-", "é", "zz"]) + str(rng.randrange(n)) for _ in range(n)]


def cells_of(spark, keys):
    return spark.createDataFrame([(k, "f", "q", i, b"v") for i, k in enumerate(keys)], CELLS)


def test_keys_at_any_rank(spark):
    keys = some_keys(3000) + ["hot"] * 3000 + [None]
    table, order = cells_of(spark, keys), sorted({k for k in keys if k is not None}, key=lambda k: k.encode())
    at = [1, 2, 777, len(order) // 2, len(order) - 1, len(order), len(order) + 1, 0]
    want = [order[i - 1] if 0 < i <= len(order) else None for i in at]
    # narrowed several times, or counted once
    assert ranks.keys_at(table, "row_key", at, parts=4, small=20) == want
    assert ranks.keys_at(table, "row_key", at) == want
    assert ranks.keys_at(table.limit(0), "row_key", [1]) == [None]
    assert ranks.keys_at(cells_of(spark, ["x"] * 5), "row_key", [1, 2], small=1) == ["x", None]


def test_pages_at_any_depth(spark):
    keys = some_keys(900, 4)
    table, order = cells_of(spark, keys), sorted(set(keys), key=lambda k: k.encode())
    pages = -(-len(order) // 100)
    for no in (1, 3, pages, pages + 1):
        page = row_page(table, 100, no)
        assert sorted({r.row_key for r in page.collect()}, key=lambda k: k.encode()) == order[(no - 1) * 100 : no * 100]
        assert "Limit" not in page._jdf.queryExecution().toString()
    first = predicates.page(7).apply(table)
    assert {r.row_key for r in first.collect()} == set(order[:7])
    assert predicates.page(0).apply(table).count() == 0 and predicates.page(10_000).apply(table).count() == 900


@pytest.mark.parametrize("k", [200, 2000])
def test_sketched_splits_are_close(spark, k):
    keys = [f"user-{i:06d}" for i in range(20_000)]
    random.Random(2).shuffle(keys)
    table = spark.createDataFrame([(x,) for x in keys], "key string").repartition(5)
    splits = ranks.sketched_splits(table, "key", 10, k)
    assert len(splits) == 9 and splits == sorted(splits)
    off = [abs(sum(x < s for x in keys) / len(keys) - (i + 1) / 10) for i, s in enumerate(splits)]
    assert max(off) <= 2 * ranks.rank_error(k)
    plan = table.agg(F.kll_sketch_agg_bigint(F.lit(1).cast("long"), F.lit(k)))._jdf.queryExecution().toString()
    assert "partial_kll" in plan
    assert ranks.sketched_splits(table.limit(0), "key", 10) == [] == ranks.sketched_splits(cells_of(spark, ["x", "x"]), "row_key", 10)


def test_ranges_filled_forward(spark):
    keys = some_keys(2000, 6) + ["hot"] * 2000 + [None, ""]
    cuts = sorted(set(random.Random(3).sample(sorted(set(keys[:2000])), 300)), key=lambda k: k.encode())
    splits = spark.createDataFrame([(c,) for c in cuts] + [(cuts[0],), (None,)], "split string")
    got = ranks.filled_ranges(cells_of(spark, keys), "row_key", splits, parts=16, salts=3)
    rows = got.collect()
    assert len(rows) == len(keys)
    assert all(r.region == (0 if r.row_key is None else sum(c.encode() <= r.row_key.encode() for c in cuts)) for r in rows)
    # the splits are no list in the plan
    assert not any(c in got._jdf.queryExecution().optimizedPlan().toString() for c in cuts if len(c) > 6 and c not in ranks.sketched_splits(cells_of(spark, keys), "row_key", 16))
    none = ranks.filled_ranges(cells_of(spark, keys[:5]), "row_key", splits.limit(0))
    assert {r.region for r in none.collect()} == {0}


def test_upserts_leave_the_big_side_where_it_is(spark):
    name = f"store_{uuid.uuid4().hex}"
    cells = cells_of(spark, [f"k{i % 50}" for i in range(500)])
    buckets.create(cells, name, 6)
    changes = spark.createDataFrame([("k1", "f", "q", 1, b"new"), ("k1", "f", "q", 1, b"less"), ("k77", "f", "q", 9, b"x")], CELLS)
    staged = buckets.staged(changes, name)
    with buckets._row_key_is_enough(spark):
        plan = buckets.merged(spark, name, staged)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("Bucketed: true") == 2
    first = buckets.generation(spark, name)[0]
    buckets.upsert(changes, name)
    got = {(r.row_key, r.ts): bytes(r.value) for r in spark.table(name).collect()}
    assert len(got) == 501 and got["k1", 1] == b"new" and got["k77", 9] == b"x"
    assert buckets.generation(spark, name)[1] == first
    plan = bulk = spark.table(name).groupBy("row_key", "family", "qualifier").agg(F.max("ts"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in bulk
    buckets.compact_store(spark, name, 2)
    assert not spark.catalog.tableExists(first)
    left = spark.table(name).groupBy("row_key").count().collect()
    assert {r["count"] for r in left if r.row_key != "k77"} == {2}
    buckets.drop(spark, name)
    assert not spark.catalog.tableExists(name)


def test_a_load_shows_all_or_nothing(spark):
    name = f"loads_{uuid.uuid4().hex}"
    tables.create(spark, name, ["f", "g"], by_load=True)
    cells = cells_of(spark, [f"k{i:03d}" for i in range(60)])
    cells = cells.unionByName(cells.withColumn("family", F.lit("g"))).unionByName(cells.withColumn("family", F.lit("other")))
    dying = cells.withColumn("ts", F.when(F.col("row_key") == "k055", F.raise_error(F.lit("dies")).cast("long")).otherwise(F.col("ts")))
    with pytest.raises(Exception, match="dies"):
        bulkload.load_table(dying, name, "it's one", ["k020", "k040"], ["f", "g"])
    assert spark.table(name).count() == 0 and tables.partitions(spark, name) == []
    assert bulkload.load_table(cells, name, "it's one", ["k020", "k040"], ["f", "g"])
    assert not bulkload.load_table(cells, name, "it's one", ["k020"], ["f", "g"])
    assert bulkload.load_table(cells.limit(0), name, "empty", [], ["f", "g"])
    assert sorted((r.family, r.load, r["count"]) for r in spark.table(name).groupBy("family", "load").count().collect()) == [("f", "it's one", 60), ("g", "it's one", 60)]


def test_placed_by_a_table_of_splits(spark):
    cells = cells_of(spark, [f"k{i:03d}" for i in range(300)])
    splits = spark.createDataFrame([("k100",), ("k200",)], "split string")
    rows = bulkload.placed_by(cells, splits, 3, 2).withColumn("at", F.spark_partition_id()).collect()
    assert all(r.at // 2 == r.region == int(r.row_key[1:]) // 100 for r in rows) and {r.at for r in rows} == set(range(6))


def test_cuts_keep_parts_small(spark, monkeypatch):
    """A region of nearly all keys is cut further; the given split keys stay."""
    monkeypatch.setattr(ranks, "parts_for", lambda rows, least=1: max(least, -(-rows // 100)))
    keys = spark.range(2000).select(F.lpad(F.col("id").cast("string"), 10, "0").alias("k"))
    splits = ranks.with_cuts(keys, "k", ["0000000030", "0000000070"], 2000)
    assert {"0000000030", "0000000070"} <= set(splits)
    sizes = keys.groupBy(ranks.range_of(F.col("k"), splits).alias("at")).count().collect()
    assert len(sizes) >= 15 and max(r["count"] for r in sizes) <= 200
    assert ranks.with_cuts(keys, "k", ["0000000030"], 50) == ["0000000030"]


def test_places_over_several_files_of_a_region(spark, tmp_path):
    path = f"file://{tmp_path}/table"
    cells = spark.range(300).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("row_key"), F.lit("f").alias("family"), F.lit("q").alias("qualifier"), F.lit(1).alias("ts"), F.lit(b"v").alias("value"))
    bulkload.bulk_load(cells, path, ["040", "100", "150", "222"], ["f"])
    got = {r.row_key: r.nth for r in bulkload.places(spark.read.parquet(path), ["100"]).collect()}
    assert got == {f"{i:03}": i + 1 if i < 100 else i - 99 for i in range(300)}


def test_buckets_of_a_store_grow_with_its_cells(spark, sf_dir, monkeypatch):
    from quernstone.plans import ranked
    from quernstone.plans.tables import order_cells

    cells = order_cells(spark, sf_dir)
    assert buckets.buckets(spark, ranked._store(spark, cells)) == 8
    monkeypatch.setattr(ranks.parts_for, "__defaults__", (1, 300))
    name = ranked._store(spark, cells)
    assert buckets.buckets(spark, name) == -(-cells.count() // 300) > 8


def test_filled_ranges_have_partitions_by_rows(spark, monkeypatch):
    monkeypatch.setattr(ranks.parts_for, "__defaults__", (1, 50))
    rows = spark.range(2000).select(F.lpad(F.col("id").cast("string"), 10, "0").alias("k"))
    found = ranks.filled_ranges(rows, "k", rows.where("k % 100 = 3").select(F.col("k").alias("split")))
    assert found.rdd.getNumPartitions() >= 40
    assert {(r.k, r.region) for r in found.collect()} == {(f"{i:010}", (i + 97) // 100) for i in range(2000)}


def test_placed_by_a_table_of_many_splits(spark):
    """More files than partitions: each partition has a stretch of files, whole and one after the other."""
    cells = cells_of(spark, [f"k{i:03d}" for i in range(300)])
    splits = spark.createDataFrame([(f"k{i:03d}",) for i in range(3, 300, 3)], "split string")
    placed = bulkload.placed_by(cells, splits, 100, 2)
    assert placed.rdd.getNumPartitions() == ranks.PARTS
    rows = placed.select("row_key", "region", (F.pmod(F.xxhash64("row_key"), F.lit(2)) + 2 * F.col("region")).alias("file"), F.spark_partition_id().alias("at"), F.monotonically_increasing_id().alias("id")).collect()
    assert len(rows) == cells.count() and all(r.region == int(r.row_key[1:]) // 3 for r in rows)
    files = [r.file for r in sorted(rows, key=lambda r: r.id)]
    assert files == sorted(files) and all(len({r.at for r in rows if r.file == f}) == 1 for f in set(files))
