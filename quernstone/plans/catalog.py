"""The queries over the standard tables, with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import codecs, composite
from ..operators import bloom, bulkload, mutate, predicates, ranks, replay
from ..operators.cells import from_entities, from_headers, from_map, from_nested, latest, nested
from ..operators.scan import ScanSpec, count_rows, entities, point_get, row_page, scan
from ..sources import csv
from ..streaming import consume, records
from .session import ship_package
from .tables import ORDER_FIELDS, counter_ops, dense_log, event_cells, event_log, order_cells, order_entities, table

_QUERIES: dict = {}
_SQL: dict[str, str] = {}

# What the cell tables are in SQL.
_MICROS = "epoch_us({0})"
_MONEY = "CAST(CAST({0} AS DECIMAL(18,2)) AS VARCHAR)"
_ORDERS = f"""o AS (
  SELECT lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS row_key, o_orderstatus AS status, o_orderpriority AS priority,
         {_MONEY.format('o_totalprice')} AS price, CAST(o_custkey AS VARCHAR) AS custkey, {_MICROS.format('o_orderdate')} AS ts FROM orders
), oc AS (
  SELECT row_key, 'd' AS family, 'status' AS qualifier, ts, status AS value FROM o UNION ALL
  SELECT row_key, 'd', 'priority', ts, priority FROM o UNION ALL
  SELECT row_key, 'm', 'price', ts, price FROM o UNION ALL
  SELECT row_key, 'm', 'custkey', ts, custkey FROM o
)"""
_EVENTS = f"""ec AS (
  SELECT CAST(user_id AS VARCHAR) AS row_key, 'e' AS family, event_type AS qualifier, {_MICROS.format('ts')} AS ts, {_MONEY.format('value')} AS value FROM events
), el AS (
  SELECT row_key, family, qualifier, max(ts) AS ts, arg_max(value, (ts, value)) AS value FROM ec GROUP BY row_key, family, qualifier
)"""
_LOG = """log AS (
  SELECT event_type AS topic, CAST(user_id % 4 AS INTEGER) AS "partition", event_id AS "offset", CAST(user_id AS VARCHAR) AS key, props AS value, ts AS "timestamp" FROM events
), dense AS (
  SELECT topic, "partition", "offset" AS event_id, row_number() OVER (PARTITION BY topic, "partition" ORDER BY "offset") - 1 AS "offset", key, value FROM log
)"""
#: Stands for a time range in the middle of both tables' versions.
_FROM, _TO = 694_224_000_000_000, 852_076_800_000_000
_AT = 842_918_400_000_000


def query(name: str, sql: str | None = None):
    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return f(spark, sf_dir)

        run.__name__, run.__doc__ = name, f.__doc__
        _QUERIES[name] = run
        if sql is not None:
            _SQL[name] = sql
        return f

    return add


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _shown(cells: DataFrame) -> DataFrame:
    """Cells with text values."""
    return cells.select("row_key", "family", "qualifier", "ts", F.decode("value", "UTF-8").alias("value"))


def _unnested(rows: DataFrame, with_ts: bool = False) -> DataFrame:
    """Nested rows as one row for each family and column; a family without columns as one with nulls."""
    out = rows.select("row_key", F.explode("data").alias("family", "inner")).select("row_key", "family", F.explode_outer("inner").alias("qualifier", "value"))
    return out.select("row_key", "family", "qualifier", F.col("value.ts").alias("ts"), F.col("value.value").alias("value")) if with_ts else out


# --- scans

_ENTITY = 'SELECT row_key, status, priority, price, custkey FROM o'


@query("scan_eq_range_entity", f"WITH {_ORDERS} {_ENTITY} WHERE status = 'F' AND row_key >= '0000001000' AND row_key < '0000009000'")
def _(spark, d):
    spec = ScanSpec(start="0000001000", stop="0000009000", filters=(predicates.eq("d", "status", "F"),))
    return entities(order_cells(spark, d), spec, ORDER_FIELDS)


@query("scan_include_stop", f"WITH {_ORDERS} SELECT * FROM oc WHERE row_key >= '0000002000' AND row_key <= '0000002400'")
def _(spark, d):
    return _shown(scan(order_cells(spark, d), ScanSpec(start="0000002000", stop="0000002400", include_stop=True)))


@query(
    "scan_columns_latest",
    f"""WITH {_EVENTS}, k AS (SELECT DISTINCT row_key FROM el WHERE qualifier IN ('click', 'purchase'))
SELECT row_key, family, qualifier, value FROM el WHERE qualifier IN ('click', 'purchase')
UNION ALL SELECT row_key, 'x', NULL, NULL FROM k""",
)
def _(spark, d):
    """Every requested family is there; one without cells (x) has an empty map."""
    return _unnested(nested(event_cells(spark, d), columns={"e": ["click", "purchase"], "x": ["nothing"]}))


@query("scan_columns_with_ts", f"WITH {_EVENTS} SELECT * FROM el WHERE qualifier IN ('click', 'view')")
def _(spark, d):
    return _unnested(nested(event_cells(spark, d), columns={"e": ["click", "view"]}, with_ts=True), True)


@query("scan_family", f"WITH {_ORDERS} SELECT row_key, family, qualifier, value FROM oc WHERE family = 'd'")
def _(spark, d):
    """Families without cells (x) are absent."""
    return _unnested(nested(order_cells(spark, d), families=["d", "x"]))


@query("scan_family_with_ts", f"WITH {_EVENTS} SELECT * FROM el")
def _(spark, d):
    return _unnested(nested(event_cells(spark, d), families=["e"], with_ts=True), True)


@query("scan_raw", f"WITH {_EVENTS} SELECT row_key, family, qualifier, ts, hex(encode(value)) AS value FROM ec")
def _(spark, d):
    return event_cells(spark, d).withColumn("value", F.hex("value"))


_VERSIONED = "SELECT row_key, family, qualifier, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY row_key, family, qualifier ORDER BY ts DESC, value DESC) AS n FROM ec) WHERE n <= {0}"


@query("scan_max_versions", f"WITH {_EVENTS} {_VERSIONED.format(3)}")
def _(spark, d):
    return _shown(scan(event_cells(spark, d), ScanSpec(max_versions=3)))


@query("scan_time_range", f"WITH {_ORDERS} SELECT * FROM oc WHERE ts >= {_FROM} AND ts < {_TO}")
def _(spark, d):
    return _shown(scan(order_cells(spark, d), ScanSpec(time_range=(_FROM, _TO))))


@query("scan_family_time_range", f"WITH {_ORDERS} SELECT * FROM oc WHERE family <> 'm' OR (ts >= {_FROM} AND ts < {_TO})")
def _(spark, d):
    return _shown(scan(order_cells(spark, d), ScanSpec(family_time_ranges={"m": (_FROM, _TO)})))


@query("scan_timestamp", f"WITH {_ORDERS} SELECT * FROM oc WHERE ts = {_AT}")
def _(spark, d):
    return _shown(scan(order_cells(spark, d), ScanSpec(timestamp=_AT)))


@query(
    "scan_limit_offset_per_family",
    f"WITH {_EVENTS} SELECT row_key, family, qualifier, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY row_key, family ORDER BY qualifier, ts DESC, value DESC) AS n FROM ec) WHERE n > 2 AND n <= 7",
)
def _(spark, d):
    return _shown(scan(event_cells(spark, d), ScanSpec(family_limit=5, family_offset=2)))


@query("scan_page", f"WITH {_ORDERS} SELECT * FROM oc WHERE row_key IN (SELECT row_key FROM o ORDER BY row_key LIMIT 50 OFFSET 100)")
def _(spark, d):
    return _shown(row_page(order_cells(spark, d), 50, 3))


@query("get_point", f"WITH {_ORDERS} {_ENTITY} WHERE row_key = '0000000007'")
def _(spark, d):
    return point_get(order_cells(spark, d), "0000000007", ORDER_FIELDS)


@query("count_row_keys", f"WITH {_EVENTS} SELECT count(DISTINCT row_key) AS n_rows FROM ec")
def _(spark, d):
    return count_rows(event_cells(spark, d))


# --- filters: value filters keep whole rows


def _value_filter(name: str, f: predicates.ValueFilter, where: str) -> None:
    @query(name, f"WITH {_ORDERS} {_ENTITY} WHERE {where}")
    def _(spark, d):
        return entities(order_cells(spark, d), ScanSpec(filters=(f,)), ORDER_FIELDS)


_value_filter("filter_cmp_eq", predicates.eq("d", "priority", "1-URGENT"), "priority = '1-URGENT'")
_value_filter("filter_cmp_neq", predicates.neq("d", "status", "O"), "status <> 'O'")
_value_filter("filter_cmp_gt", predicates.gt("m", "price", "5"), "price > '5'")
_value_filter("filter_cmp_ge", predicates.ge("m", "custkey", "75"), "custkey >= '75'")
_value_filter("filter_cmp_lt", predicates.lt("m", "price", "2"), "price < '2'")
_value_filter("filter_cmp_le", predicates.le("m", "custkey", "120"), "custkey <= '120'")
_value_filter("filter_regex", predicates.regex("d", "priority", "^[12]-"), "regexp_matches(priority, '^[12]-')")
_value_filter("filter_nregex", predicates.regex("d", "priority", "[TW]$", negate=True), "NOT regexp_matches(priority, '[TW]$')")
_value_filter("filter_substring", predicates.substring("d", "priority", "uRGe"), "contains(lower(priority), 'urge')")
_value_filter("filter_nsubstring", predicates.substring("d", "priority", "HIGH", negate=True), "NOT contains(lower(priority), 'high')")


@query("filter_and", f"WITH {_ORDERS} SELECT row_key, family, qualifier, value FROM oc WHERE family = 'd' AND row_key IN (SELECT row_key FROM o WHERE status = 'F' AND priority >= '3')")
def _(spark, d):
    """Projection first, then all filters together."""
    spec = ScanSpec(columns={"d": None}, filters=(predicates.eq("d", "status", "F"), predicates.ge("d", "priority", "3")))
    return _shown(scan(order_cells(spark, d), spec)).drop("ts")


@query("filter_projected_away", f"WITH {_ORDERS} SELECT * FROM oc WHERE false")
def _(spark, d):
    """A filter on a column that the projection leaves out drops every row."""
    return _shown(scan(order_cells(spark, d), ScanSpec(columns={"m": None}, filters=(predicates.eq("d", "status", "F"),))))


@query("filter_exclude_tested", f"WITH {_ORDERS} SELECT * FROM oc WHERE qualifier <> 'status' AND row_key IN (SELECT row_key FROM o WHERE status = 'P')")
def _(spark, d):
    return _shown(scan(order_cells(spark, d), ScanSpec(filters=(predicates.without_tested(predicates.eq("d", "status", "P")),))))


# --- filters: cell filters keep cells


def _cell_filter(name: str, f: predicates.Filter, where: str) -> None:
    @query(name, f"WITH {_ORDERS} SELECT * FROM oc WHERE {where}")
    def _(spark, d):
        return _shown(scan(order_cells(spark, d), ScanSpec(filters=(f,))))


_cell_filter("filter_family", predicates.family_is("d"), "family = 'd'")
_cell_filter("filter_nfamily", predicates.family_is("d", negate=True), "family <> 'd'")
_cell_filter("filter_qualifier", predicates.qualifier_is("price"), "qualifier = 'price'")
_cell_filter("filter_nqualifier", predicates.qualifier_is("price", negate=True), "qualifier <> 'price'")
_cell_filter("filter_prefix", predicates.qualifier_prefix("pri"), "starts_with(qualifier, 'pri')")
_cell_filter("filter_multiprefix", predicates.qualifier_prefix("cust", "stat"), "starts_with(qualifier, 'cust') OR starts_with(qualifier, 'stat')")
_cell_filter("filter_qrange", predicates.qualifier_range("custkey", False, "priority", True), "qualifier > 'custkey' AND qualifier <= 'priority'")
_cell_filter("filter_row", predicates.row_is("0000000033"), "row_key = '0000000033'")
_cell_filter("filter_nrow", predicates.row_is("0000000033", negate=True), "row_key <> '0000000033'")
_cell_filter("filter_row_prefix", predicates.row_prefix("000000012"), "starts_with(row_key, '000000012')")
_cell_filter("filter_page", predicates.page(25), "row_key IN (SELECT row_key FROM o ORDER BY row_key LIMIT 25)")
_cell_filter("filter_first_key", predicates.first_key_only(), "qualifier = 'priority'")
_cell_filter("filter_column_page", predicates.column_page(2, 1), "qualifier IN ('status', 'custkey')")


@query("filter_key_only", f"WITH {_ORDERS} SELECT row_key, family, qualifier, ts, '' AS value FROM oc")
def _(spark, d):
    return _shown(scan(order_cells(spark, d), ScanSpec(filters=(predicates.key_only(),))))


@query("filter_dependent_column", f"WITH {_EVENTS} SELECT * FROM ec WHERE EXISTS (SELECT 1 FROM ec r WHERE r.qualifier = 'purchase' AND r.row_key = ec.row_key AND r.ts = ec.ts)")
def _(spark, d):
    return _shown(scan(event_cells(spark, d), ScanSpec(filters=(predicates.same_version_as("e", "purchase"),))))


@query("filter_random_rows", f"WITH {_ORDERS} SELECT * FROM oc WHERE CAST('0x' || substr(md5(row_key || ':0'), 1, 8) AS BIGINT) < 429496729")
def _(spark, d):
    """A sampling filter: about a tenth of the rows, each as a whole."""
    return _shown(scan(order_cells(spark, d), ScanSpec(filters=(predicates.random_rows(0.1),))))


# --- writes

_CUSTOMER = "SELECT CAST(c_custkey AS VARCHAR) AS row_key, '{0}' AS family, '{1}' AS qualifier, CAST(1000 AS BIGINT) AS ts, {2} AS value FROM customer WHERE {3}"


@query("write_simple", _CUSTOMER.format("c", "name", "c_name", "true") + " UNION ALL " + _CUSTOMER.format("c", "segment", "c_mktsegment", "true"))
def _(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("row_key"), F.create_map(F.lit("name"), "c_name", F.lit("segment"), "c_mktsegment").alias("data"))
    return _shown(from_map(rows, "c", ts=1000))


@query("write_fixed_headers", _CUSTOMER.format("c", "name", "c_name", "true") + " UNION ALL " + _CUSTOMER.format("c", "segment", "c_mktsegment", "c_nationkey % 2 = 0"))
def _(spark, d):
    """Three headers, one or two values: the shorter side counts."""
    values = F.when(F.col("c_nationkey") % 2 == 0, F.array("c_name", "c_mktsegment")).otherwise(F.array("c_name"))
    rows = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("row_key"), values.alias("values"))
    return _shown(from_headers(rows, "c", ["name", "segment", "more"], ts=1000))


@query(
    "write_multi_family",
    "SELECT row_key, family, qualifier, CASE family WHEN 'a' THEN 5 ELSE 6 END AS ts, value FROM (" + _CUSTOMER.format("a", "name", "c_name", "c_acctbal > 0") + " UNION ALL " + _CUSTOMER.format("b", "segment", "c_mktsegment", "true") + ")",
)
def _(spark, d):
    """Versions given with the values; a row's empty family writes nothing; a family the table hasn't is left out."""
    v = lambda c, ts: F.struct(F.col(c).alias("value"), F.lit(ts).cast("long").alias("ts"))
    a = F.map_filter(F.create_map(F.lit("name"), v("c_name", 5)), lambda k, x: F.col("c_acctbal") > 0)
    data = F.create_map(F.lit("a"), a, F.lit("b"), F.create_map(F.lit("segment"), v("c_mktsegment", 6)), F.lit("z"), F.create_map(F.lit("lost"), v("c_name", 7)))
    rows = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("row_key"), data.alias("data"), "c_acctbal")
    return _shown(from_nested(rows, versioned=True, families=["a", "b"]))


@query("write_entities_skip_blank", f"WITH {_ORDERS} SELECT * FROM oc WHERE qualifier <> 'status' OR value <> 'O'")
def _(spark, d):
    rows = order_entities(spark, d).withColumn("status", F.when(F.col("status") == "O", "  ").otherwise(F.col("status")))
    return _shown(from_entities(rows, ORDER_FIELDS, "row_key", F.col("ts"), skip_blank=True))


@query(
    "upsert_latest",
    f"""WITH {_ORDERS}, u AS (SELECT * FROM oc UNION ALL SELECT row_key, 'd', 'status', ts + 1, 'X' FROM o WHERE status = 'P')
SELECT row_key, family, qualifier, max(ts) AS ts, arg_max(value, (ts, value)) AS value FROM u GROUP BY row_key, family, qualifier""",
)
def _(spark, d):
    cells = order_cells(spark, d)
    pending = (F.col("qualifier") == "status") & (F.decode("value", "UTF-8") == "P")
    changes = cells.where(pending).withColumn("ts", F.col("ts") + 1).withColumn("value", F.encode(F.lit("X"), "UTF-8"))
    return _shown(latest(mutate.upsert(cells, changes)))


# --- deletes; the rows to delete are the orders of the customers with a negative balance

_GONE = "gone AS (SELECT o.row_key FROM o JOIN customer ON CAST(c_custkey AS VARCHAR) = o.custkey WHERE c_acctbal < 0)"


def _keys(spark, d) -> DataFrame:
    c = table(spark, d, "customer").where("c_acctbal < 0").select("c_custkey")
    o = table(spark, d, "orders").select(F.lpad(F.col("o_orderkey").cast("string"), 10, "0").alias("row_key"), F.col("o_custkey").alias("c_custkey"))
    return o.join(c, "c_custkey", "left_semi").select("row_key")


@query("delete_rows", f"WITH {_ORDERS}, {_GONE} SELECT * FROM oc WHERE row_key NOT IN (SELECT row_key FROM gone)")
def _(spark, d):
    return _shown(mutate.delete_rows(order_cells(spark, d), _keys(spark, d)))


@query("delete_families", f"WITH {_ORDERS}, {_GONE} SELECT * FROM oc WHERE NOT (family = 'm' AND row_key IN (SELECT row_key FROM gone))")
def _(spark, d):
    return _shown(mutate.delete_families(order_cells(spark, d), _keys(spark, d), ["m"]))


@query("delete_columns", f"WITH {_ORDERS}, {_GONE} SELECT * FROM oc WHERE NOT (qualifier IN ('status', 'price') AND row_key IN (SELECT row_key FROM gone))")
def _(spark, d):
    return _shown(mutate.delete_columns(order_cells(spark, d), _keys(spark, d), {"d": ["status"], "m": ["price"], "z": []}))


@query("delete_column_sets", f"WITH {_ORDERS} SELECT * FROM oc WHERE NOT (qualifier = 'price' AND row_key IN (SELECT row_key FROM o WHERE status = 'F')) AND NOT (qualifier = 'priority' AND row_key IN (SELECT row_key FROM o WHERE status = 'O'))")
def _(spark, d):
    """Each row's own columns, over several families."""
    o = order_entities(spark, d)
    columns = F.create_map(F.lit("m"), F.when(F.col("status") == "F", F.array(F.lit("price"))).otherwise(F.array().cast("array<string>")), F.lit("d"), F.when(F.col("status") == "O", F.array(F.lit("priority"))).otherwise(F.array().cast("array<string>")))
    return _shown(mutate.delete_column_sets(order_cells(spark, d), o.select("row_key", columns.alias("columns"))))


@query("delete_versions", f"WITH {_EVENTS} SELECT * FROM ec WHERE NOT EXISTS (SELECT 1 FROM el WHERE el.row_key = ec.row_key AND el.qualifier = ec.qualifier AND el.ts = ec.ts)")
def _(spark, d):
    """Delete each cell's newest version."""
    cells = event_cells(spark, d)
    return _shown(mutate.delete_versions(cells, latest(cells)))


@query(
    "delete_tombstones",
    f"""WITH {_ORDERS} SELECT * FROM oc WHERE row_key NOT IN (SELECT row_key FROM o WHERE priority = '5-LOW')
AND NOT (family = 'm' AND row_key IN (SELECT row_key FROM o WHERE priority = '1-URGENT')) AND NOT (qualifier = 'status' AND row_key IN (SELECT row_key FROM o WHERE priority = '2-HIGH'))""",
)
def _(spark, d):
    o = order_entities(spark, d)
    null = F.lit(None).cast("string")
    is_ = lambda p, x: F.when(F.col("priority") == p, F.lit(x)).otherwise(null)
    deletes = o.where(F.col("priority").isin("5-LOW", "1-URGENT", "2-HIGH")).select("row_key", F.coalesce(is_("1-URGENT", "m"), is_("2-HIGH", "d")).alias("family"), is_("2-HIGH", "status").alias("qualifier"), F.lit(None).cast("long").alias("ts"))
    return _shown(mutate.apply_tombstones(order_cells(spark, d), deletes))


# --- regions and order


@query("splits_exact", "SELECT CAST(tile AS INTEGER) AS tile, min(l_orderkey) AS split FROM (SELECT l_orderkey, ntile(8) OVER (ORDER BY l_orderkey) AS tile FROM lineitem) WHERE tile > 1 GROUP BY tile")
def _(spark, d):
    return bulkload.exact_splits(table(spark, d, "lineitem").select("l_orderkey"), "l_orderkey", 8)


@query(
    "region_histogram",
    f"WITH {_ORDERS} SELECT CASE WHEN row_key < '0000003000' THEN 0 WHEN row_key < '0000007000' THEN 1 WHEN row_key < '0000012000' THEN 2 ELSE 3 END AS region, count(*) AS n, min(row_key) AS first, max(row_key) AS last FROM oc GROUP BY 1",
)
def _(spark, d):
    splits = ["0000003000", "0000007000", "0000012000"]
    rows = order_cells(spark, d).withColumn("region", ranks.range_of(F.col("row_key"), splits))
    return rows.groupBy("region").agg(F.count("*").alias("n"), F.min("row_key").alias("first"), F.max("row_key").alias("last"))


@query("bulk_placed_partitions", f"WITH {_ORDERS} SELECT count(*) AS n, 0 AS misplaced, 0 AS unsorted FROM oc")
def _(spark, d):
    """Cells outside the partition of their region and file, and cells out of order: none."""
    entities_ = order_entities(spark, d)
    splits = ranks.with_cuts(entities_, "row_key", ["0000003000", "0000007000", "0000012000"], 4 * entities_.count())
    rows = bulkload.placed(order_cells(spark, d), splits, 2).select("row_key", "family", "qualifier", "ts", F.spark_partition_id().alias("at"), F.monotonically_increasing_id().alias("i"))
    rows = rows.repartition(8 * (len(splits) + 1), "at")  # by the placed partitions, not by their compressed bytes
    order = Window.partitionBy("at").orderBy("i")
    key = F.struct("family", "row_key", "qualifier", -F.col("ts"))
    rows = rows.withColumn("before", F.lag(key).over(order)).withColumn("wrong", F.col("at") != bulkload.file_number(F.col("row_key"), splits, 2))
    return rows.agg(F.count("*").alias("n"), F.count(F.when(F.col("wrong"), 1)).cast("int").alias("misplaced"), F.count(F.when(F.col("before") > key, 1)).cast("int").alias("unsorted"))


@query("kv_secondary_sort_rank", "SELECT l_orderkey, l_linenumber, l_shipdate, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey) AS INTEGER) AS nth FROM lineitem")
def _(spark, d):
    order = Window.partitionBy("l_orderkey").orderBy("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", F.row_number().over(order).cast("int").alias("nth"))


# --- pairs, collections, maps


def _numbered(rows: DataFrame, key, *more) -> DataFrame:
    return ranks.numbered(rows.withColumn("sort_key", key), "sort_key", *more)[0].drop("sort_key")


@query("pair_order", "SELECT o_orderkey, '(' || o_orderpriority || ', ' || o_orderstatus || ')' AS pair, row_number() OVER (ORDER BY o_orderpriority, o_orderstatus, o_orderkey) AS number FROM orders")
def _(spark, d):
    p = composite.pair(F.col("o_orderpriority"), F.col("o_orderstatus"))
    rows = table(spark, d, "orders").select("o_orderkey", p.alias("p"))
    return _numbered(rows, composite.pair_order(F.col("p"))[0], composite.pair_order(F.col("p"))[1], "o_orderkey").select("o_orderkey", composite.pair_text(F.col("p")).alias("pair"), "number")


@query("pair_second_order", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus, o_orderkey) AS number FROM orders")
def _(spark, d):
    p = composite.pair(F.col("o_orderpriority"), F.col("o_orderstatus"))
    order = Window.partitionBy("o_custkey").orderBy(*composite.second_order(F.col("p")), "o_orderkey")
    return table(spark, d, "orders").withColumn("p", p).select("o_orderkey", F.row_number().over(order).cast("long").alias("number"))


_WORDS = "string_split(p_type, ' ')"


def _parts(spark, d) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.split("p_type", " ").alias("a"), F.split("p_name", " ").alias("b"), "p_brand", "p_size", F.create_map("p_brand", F.col("p_size").cast("string"), F.lit("size"), F.col("p_size").cast("string")).alias("m"))


@query("array_order", f"SELECT p_partkey, row_number() OVER (ORDER BY len({_WORDS}), {_WORDS}, p_partkey) AS number FROM part")
def _(spark, d):
    size, elements = composite.collection_order(F.col("a"))
    # one key that orders as both do: the size in ten digits, then the elements
    key = F.concat(F.array(F.lpad(size.cast("string"), 10, "0")), elements)
    return ranks.numbered(_parts(spark, d).select("p_partkey", key.alias("key")), "key", "p_partkey")[0].select("p_partkey", "number")


@query("map_order", "SELECT p_partkey, row_number() OVER (ORDER BY p_brand, p_partkey) AS number FROM part")
def _(spark, d):
    size, keys = composite.map_order(F.col("m"))
    key = F.concat(F.array(F.lpad(size.cast("string"), 10, "0")), keys)
    return ranks.numbered(_parts(spark, d).select("p_partkey", key.alias("key")), "key", "p_partkey")[0].select("p_partkey", "number")


@query("sorted_array", f"SELECT p_partkey, array_to_string(list_sort(list_distinct({_WORDS})), ' ') AS words FROM part")
def _(spark, d):
    return _parts(spark, d).select("p_partkey", F.array_join(composite.sorted_distinct(F.col("a")), " ").alias("words"))


@query("sorted_map", "SELECT p_partkey, '{' || p_brand || '=' || CAST(p_size AS VARCHAR) || ', size=' || CAST(p_size AS VARCHAR) || '}' AS entries FROM part")
def _(spark, d):
    return _parts(spark, d).select("p_partkey", composite.map_text(composite.sorted_map(F.col("m"))).alias("entries"))


@query(
    "array_ops",
    f"""WITH p AS (SELECT p_partkey, {_WORDS} AS a, string_split(p_name, ' ') AS b FROM part)
SELECT p_partkey, CAST(len(a) AS INTEGER) AS size, len(a) = 0 AS empty, list_contains(a, 'STEEL') AS has, '[' || array_to_string(list_append(a, 'x'), ', ') || ']' AS added,
  array_to_string(a || b, ' ') AS joined, array_to_string(CASE WHEN list_position(a, a[2]) > 0 THEN a[1:list_position(a, a[2]) - 1] || a[list_position(a, a[2]) + 1:] ELSE a END, ' ') AS removed,
  array_to_string(a[1:1] || a[3:], ' ') AS removed_all, list_has_all(a, a[1:1]) AS has_all, array_to_string(list_filter(a || a, lambda x: x = a[1]), ' ') AS kept, 0 AS cleared FROM p""",
)
def _(spark, d):
    a, b = F.col("a"), F.col("b")
    second = F.get("a", F.lit(1))
    return _parts(spark, d).select(
        "p_partkey", composite.size(a).alias("size"), composite.is_empty(a).alias("empty"), composite.contains(a, F.lit("STEEL")).alias("has"),
        composite.text(composite.add(a, F.lit("x"))).alias("added"), F.array_join(composite.add_all(a, b), " ").alias("joined"),
        F.array_join(composite.remove(a, second), " ").alias("removed"), F.array_join(composite.remove_all(a, F.array(second, F.lit("none"), F.get("a", F.lit(0)))), " ").alias("removed_all"),
        composite.contains_all(a, F.slice("a", 1, 1)).alias("has_all"), F.array_join(composite.retain_all(F.concat(a, a), F.slice("a", 1, 1)), " ").alias("kept"),
        composite.size(composite.cleared(a)).alias("cleared"),
    )


@query(
    "map_ops",
    """WITH p AS (SELECT p_partkey, p_brand, CAST(p_size AS VARCHAR) AS s FROM part)
SELECT p_partkey, 2 AS size, true AS has_key, false AS has_value, s AS got, 'none' AS fallback, '{' || p_brand || '=' || s || ', size=9}' AS put,
  '{' || p_brand || '=0, size=' || s || '}' AS put_all, CAST(NULL AS VARCHAR) AS put_twice, 'y' AS put_new, '{size=' || s || '}' AS removed, p_brand || ' size' AS keys, true AS same FROM p""",
)
def _(spark, d):
    m = F.col("m")
    other = F.create_map(F.col("p_brand"), F.lit("0"))
    return _parts(spark, d).select(
        "p_partkey", composite.size(m).alias("size"), composite.contains_key(m, F.lit("size")).alias("has_key"), composite.contains_value(m, F.lit("-1")).alias("has_value"),
        composite.get(m, F.lit("size")).alias("got"), composite.get_or_default(m, F.lit("x"), F.lit("none")).alias("fallback"), composite.map_text(composite.put(m, F.lit("size"), F.lit("9"))).alias("put"),
        composite.map_text(composite.put_all(m, other)).alias("put_all"), composite.put_if_absent(m, F.lit("size"), F.lit("y"))[1].alias("put_twice"), composite.put_if_absent(m, F.lit("x"), F.lit("y"))[1].alias("put_new"),
        composite.map_text(composite.remove_key(m, F.col("p_brand"))).alias("removed"), F.array_join(F.array_sort(F.map_keys(m)), " ").alias("keys"), composite.maps_equal(m, composite.sorted_map(m)).alias("same"),
    )


# --- codecs


@query(
    "codec_roundtrip",
    """SELECT l_orderkey, l_linenumber, CAST(l_orderkey - 30000 AS INTEGER) AS i, -l_orderkey AS l, CAST(l_linenumber - 4 AS SMALLINT) AS s, CAST(l_linenumber - 4 AS TINYINT) AS b, l_returnflag AS c,
  l_linenumber > 3 AS bool, -l_extendedprice AS dbl, CAST(l_quantity AS FLOAT) AS flt, l_linestatus AS str FROM lineitem""",
)
def _(spark, d):
    x = table(spark, d, "lineitem")
    typed = {
        "i": ("int", (F.col("l_orderkey") - 30000).cast("int")), "l": ("long", -F.col("l_orderkey")), "s": ("short", (F.col("l_linenumber") - 4).cast("smallint")),
        "b": ("byte", (F.col("l_linenumber") - 4).cast("tinyint")), "c": ("char", F.col("l_returnflag")), "bool": ("boolean", F.col("l_linenumber") > 3),
        "dbl": ("double", -F.col("l_extendedprice")), "flt": ("float", F.col("l_quantity").cast("float")), "str": ("string", F.col("l_linestatus")),
    }
    raw = x.select("l_orderkey", "l_linenumber", *[codecs.encode(kind, c).alias(n) for n, (kind, c) in typed.items()])
    return raw.select("l_orderkey", "l_linenumber", *[codecs.decode(kind, F.col(n)).alias(n) for n, (kind, _) in typed.items()])


@query("codec_bytes", "SELECT c_custkey, upper(printf('%08x', c_custkey)) AS int_hex, upper(printf('%016x', c_custkey)) AS long_hex, upper(printf('%04x', c_nationkey)) AS short_hex, CASE WHEN c_acctbal > 0 THEN 'FF' ELSE '00' END AS bool_hex FROM customer")
def _(spark, d):
    c = table(spark, d, "customer")
    return c.select("c_custkey", *[F.hex(codecs.encode(k, v)).alias(f"{n}_hex") for n, k, v in (("int", "int", F.col("c_custkey")), ("long", "long", F.col("c_custkey")), ("short", "short", F.col("c_nationkey")), ("bool", "boolean", F.col("c_acctbal") > 0))])


# --- Bloom filter


def _customers_with_balance(spark, d):
    c = table(spark, d, "customer").where("c_acctbal > 5000").select("c_custkey")
    return c, bloom.BloomSpec(max(1, c.count()))


@query("bloom_semi_exact", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def _(spark, d):
    """Probe first, then the exact semi-join of what passed."""
    keys, spec = _customers_with_balance(spark, d)
    maybe = bloom.probe(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", bloom.build(keys, "c_custkey", spec), spec).where("maybe").drop("maybe")
    return maybe.join(keys, maybe.o_custkey == keys.c_custkey, "left_semi")


@query("bloom_no_false_negative", "SELECT count(*) AS members, 0 AS lost, true AS few_false FROM customer WHERE c_acctbal > 5000")
def _(spark, d):
    keys, spec = _customers_with_balance(spark, d)
    probed = bloom.probe(table(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_custkey", bloom.build(keys, "c_custkey", spec), spec)
    inside = F.col("c_acctbal") > 5000
    return probed.agg(
        F.count(F.when(inside, 1)).alias("members"), F.count(F.when(inside & ~F.col("maybe"), 1)).cast("int").alias("lost"),
        (F.count(F.when(~inside & F.col("maybe"), 1)) <= 0.1 * F.count(F.when(~inside, 1))).alias("few_false"),
    )


# --- record logs


@query("consume_counters", f"WITH {_LOG} SELECT topic, count(*) AS records, CAST(sum(strlen(value)) AS BIGINT) AS bytes FROM log GROUP BY topic")
def _(spark, d):
    return consume.counters(event_log(spark, d), "topic")


@query("max_offset", f'WITH {_LOG} SELECT topic, "partition", max("offset") + 1 AS "commit" FROM log GROUP BY topic, "partition"')
def _(spark, d):
    return consume.max_offsets(event_log(spark, d))


@query("pending_offsets", f'WITH {_LOG} SELECT topic, "partition", arg_max("offset", key || CAST("offset" AS VARCHAR)) AS "offset" FROM log GROUP BY topic, "partition"')
def _(spark, d):
    return consume.pending_offsets(event_log(spark, d).withColumn("seq", F.concat("key", F.col("offset").cast("string"))))


@query("start_offsets", f"""WITH {_LOG} SELECT topic, "partition", "offset" FROM dense WHERE NOT (topic = 'click' AND "partition" = 1 AND "offset" < 50) AND NOT (topic = 'view' AND "partition" = 3 AND "offset" < 120)""")
def _(spark, d):
    return records.from_starts(dense_log(spark, d).select("topic", "partition", "offset"), "click:1:50, view:3:120, view:2:0,")


_CONTIGUOUS = """f AS (SELECT topic, "partition", "offset" FROM dense WHERE event_id % 97 <> 0),
g AS (SELECT *, "offset" - row_number() OVER (PARTITION BY topic, "partition" ORDER BY "offset") AS lag, count(*) OVER (PARTITION BY topic, "partition") AS n FROM f)
SELECT topic, "partition", max("offset") + 1 AS "commit" FROM g WHERE lag = -1{0} GROUP BY topic, "partition\""""


def _finished(spark, d):
    log = dense_log(spark, d)
    starts = log.select("topic", "partition").distinct().withColumn("start", F.lit(0).cast("long"))
    return log.where("event_id % 97 <> 0"), starts


@query("contiguous_commit", f"WITH {_LOG}, {_CONTIGUOUS.format('')}")
def _(spark, d):
    return consume.contiguous_commit(*_finished(spark, d))


@query("windowed_commit", f"WITH {_LOG}, {_CONTIGUOUS.format(' AND n >= 400')}")
def _(spark, d):
    return consume.contiguous_commit(*_finished(spark, d), window=400)


@query("fixed_rate_commit", f"""WITH {_LOG}, r AS (SELECT topic, "partition", "offset", row_number() OVER (PARTITION BY topic ORDER BY "offset") AS nth FROM log) SELECT topic, "partition", "offset" + 1 AS "commit", nth FROM r WHERE nth % 100 = 0""")
def _(spark, d):
    return consume.fixed_rate_commits(event_log(spark, d), 100)


@query("commit_by_topic", f"""WITH {_LOG}, r AS (SELECT topic, "partition", "offset", row_number() OVER (PARTITION BY topic ORDER BY "offset") AS nth FROM log)
SELECT topic, "partition", "offset" + 1 AS "commit" FROM r WHERE topic <> 'click' AND nth % 100 = 0 UNION ALL SELECT topic, "partition", max("offset") + 1 FROM log WHERE topic = 'click' GROUP BY topic, "partition\"""")
def _(spark, d):
    """One topic by its last offsets, the others by the default rate."""
    return consume.commits_by_topic(event_log(spark, d), {"click": consume.max_offsets})


@query("offset_report", f"""WITH {_LOG}, m AS (SELECT topic, "partition", max("offset") + 1 AS c FROM log GROUP BY topic, "partition") SELECT string_agg(topic || '-' || CAST("partition" AS VARCHAR) || '(' || CAST(c AS VARCHAR) || ')', ', ' ORDER BY topic, "partition") AS report FROM m""")
def _(spark, d):
    return records.offset_report(consume.max_offsets(event_log(spark, d)).withColumnRenamed("commit", "offset"))


@query("partition_list", f"""WITH {_LOG}, m AS (SELECT DISTINCT topic, "partition" FROM log) SELECT string_agg(topic || '-' || CAST("partition" AS VARCHAR), ',' ORDER BY topic, "partition") AS partitions FROM m""")
def _(spark, d):
    return records.partition_list(event_log(spark, d))


@query("record_detail", f"""WITH {_LOG} SELECT "offset", key || ' >>> ' || value || '(' || topic || '-' || CAST("partition" AS VARCHAR) || ')' AS detail FROM log""")
def _(spark, d):
    return event_log(spark, d).select("offset", records.detail().alias("detail"))


@query("record_build", "SELECT event_type AS topic, CAST(user_id AS VARCHAR) AS key, props AS value FROM events")
def _(spark, d):
    e = table(spark, d, "events")
    return records.records(e, F.col("event_type"), F.col("props"), F.col("user_id"))


@query("worker_dispatch", "SELECT CAST(user_id AS VARCHAR) AS key, CAST(CAST('0x' || substr(md5(CAST(user_id AS VARCHAR)), 1, 8) AS BIGINT) % 8 AS INTEGER) AS worker, count(*) AS records FROM events GROUP BY user_id")
def _(spark, d):
    """Every key's records go to one worker of eight."""
    return event_log(spark, d).withColumn("worker", consume.worker_of(F.col("key"), 8)).groupBy("key", "worker").agg(F.count("*").alias("records"))


@query("stream_counters", f"WITH {_LOG} SELECT topic, count(*) AS records, CAST(sum(strlen(value)) AS BIGINT) AS bytes FROM log GROUP BY topic")
def _(spark, d):
    """The counters as a stream over all there is, then read from the sink."""
    import uuid

    schema = spark.read.parquet(f"{d}/events.parquet").schema
    # a file or a folder of files, by one pattern
    stream = spark.readStream.schema(schema).parquet(f"{d}/events.parque[t]")
    log = stream.select(F.col("event_type").alias("topic"), F.col("props").alias("value"))
    name = f"counters_{uuid.uuid4().hex}"
    q = consume.counters(log, "topic").writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


# --- counters

_OPS = "ops AS (SELECT event_type AS counter, event_id AS log_index, CASE WHEN event_id % 5 = 0 THEN 1 ELSE 2 END AS op, user_id % 7 + 1 AS delta FROM events), c AS (SELECT *, CASE WHEN op = 2 THEN delta ELSE 0 END AS change FROM ops)"


@query("counter_fold", f"WITH {_OPS} SELECT counter, CAST(sum(change) AS BIGINT) AS value, max(log_index) AS log_index FROM c GROUP BY counter")
def _(spark, d):
    return replay.fold(counter_ops(spark, d))


@query("counter_running", f"WITH {_OPS} SELECT counter, log_index, CAST(op AS TINYINT) AS op, delta, CAST(sum(change) OVER (PARTITION BY counter ORDER BY log_index) AS BIGINT) AS value FROM c")
def _(spark, d):
    return replay.running(counter_ops(spark, d))


@query("counter_snapshot_replay", f"WITH {_OPS} SELECT counter, CAST(sum(change) AS BIGINT) AS value, max(log_index) AS log_index FROM c GROUP BY counter")
def _(spark, d):
    ops = counter_ops(spark, d)
    return replay.replay(replay.snapshot(ops, 4000), ops)


# --- CSV: a table's rows written as lines and parsed again


@query("csv_fields_roundtrip", "SELECT c_custkey, 4 AS n, c_name AS name, 'say \"' || c_mktsegment || '\", \\ ok' AS quoted, '' AS empty FROM customer")
def _(spark, d):
    values = F.array(F.col("c_custkey").cast("string"), "c_name", F.concat(F.lit('say "'), "c_mktsegment", F.lit('", \\ ok')), F.lit(""))
    lines = table(spark, d, "customer").select("c_custkey", csv.fields(csv.to_line(values)).alias("f"))
    return lines.select("c_custkey", F.size("f").alias("n"), F.get("f", F.lit(1)).alias("name"), F.get("f", F.lit(2)).alias("quoted"), F.get("f", F.lit(3)).alias("empty"))


# queries that write and read back, and those over streams and data sources, register themselves here, too
from . import ranked, sources, streams, written  # noqa: E402, F401
