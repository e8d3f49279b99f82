"""Every query that has SQL gives what DuckDB says."""

from __future__ import annotations

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from quernstone.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events".split()


def plain(df):
    df = df[sorted(df.columns)]
    return sorted(map(tuple, df.astype(object).where(df.notna(), None).astype(str).values.tolist()))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = catalog.queries()[name](spark, sf_dir).toPandas()
    want = con.sql(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_value_filters_reach_the_scan(spark, sf_dir, tmp_path):
    from quernstone.operators import predicates
    from quernstone.operators.scan import ScanSpec, scan
    from quernstone.plans.tables import order_cells

    order_cells(spark, sf_dir).write.partitionBy("family").parquet(f"file://{tmp_path}/cells")
    cells = spark.read.parquet(f"file://{tmp_path}/cells")
    plan = scan(cells, ScanSpec(start="0000000100", stop="0000000200", columns={"d": None}, filters=(predicates.eq("d", "status", "F"),)))._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(row_key), GreaterThanOrEqual(row_key,0000000100)" in plan and "PartitionFilters: [isnotnull(family" in plan
