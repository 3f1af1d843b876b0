"""Rows are dealt out as seldom as the results allow, and nothing that grows is collected for a broadcast."""

import datetime as dt
import pathlib
import re

import pytest
from pyspark.sql import functions as F

from marketloom import registry
from marketloom.operators import diff, history, upsert
from marketloom.plans import core, enrich, increments, staging
from marketloom.registry import QUERIES
from marketloom.session import fresh_path
from marketloom.sources import sample_retail
from tests.conftest import rows
from tests.test_pipelines import AS_OF, inputs  # noqa: F401
from tests.test_plans import FOLDER, plan, subtrees

given = pytest.mark.skipif(not pathlib.Path(FOLDER).exists(), reason="test tables not present")


@pytest.fixture
def merged_joins(spark):
    """Every table counts as too large for a broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def exchanges_over(df, found):
    return [line for line, below in subtrees(plan(df)) if "Exchange" in line and any(found in x for x in below)]


@given
def test_lines_are_dealt_by_order_and_by_product_only(spark, merged_joins):
    assert len(exchanges_over(QUERIES["fct_order_items"](spark, FOLDER), "l_extendedprice")) == 2


@given
def test_distinct_products_deal_no_line_twice(spark, merged_joins):
    assert not re.search(r"hashpartitioning\(order_id#\w+, product_id#", plan(QUERIES["fct_orders"](spark, FOLDER)))


def test_unknown_products_are_not_counted(spark, inputs):  # noqa: F811
    lines = inputs["raw_order_items"].withColumn("product_id", F.expr("if(order_item_id % 2 = 0, NULL, product_id)"))
    built = enrich.orders_enriched({**inputs, "raw_order_items": lines}, AS_OF)
    asked = inputs["raw_orders"].select("order_id").join(lines, "order_id", "left").groupBy("order_id").agg(F.countDistinct("product_id").alias("distinct_products"))
    assert rows(built, "order_id", "distinct_products") == rows(asked, "order_id", "distinct_products")


@given
def test_days_of_the_stock_are_not_dealt_out(spark, merged_joins):
    tables = sample_retail.retail_inputs(spark, FOLDER)
    opening = spark.range(1).selectExpr("id AS product_id", "id AS store_id", "id AS opening_units")
    days = core.inventory_daily(tables, dt.date(2001, 8, 2), opening, dt.date(2001, 7, 24))
    assert "Generate explode(" in plan(days)
    assert not exchanges_over(days, "Generate explode(")


def test_keys_of_updates_are_not_broadcast(spark, table):
    old, new = table("k long, v int", (1, 1), (2, 1)), table("k long, v int", (2, 2))
    after = upsert.merged(old, new, ["k"])
    assert "Broadcast" not in plan(after)
    assert rows(after) == [(1, 1), (2, 2)]


def test_first_rows_of_a_table_are_written_once(spark, table, monkeypatch):
    def twice(df, label):
        raise AssertionError(f"{label} written beside the table")

    monkeypatch.setattr(upsert, "written", twice)
    store = upsert.KeyedTable(spark, fresh_path(spark, "t"), ["k"], "p", "int")
    store.upsert(table("k long, p int", (1, 1), (2, None)))
    assert rows(store.read()) == [(1, 1), (2, None)]


@pytest.mark.parametrize("sort_by", [[], ["s"]])
def test_rows_that_leave_their_place_are_replaced(spark, table, sort_by):
    schema = "k long, p int, s int, v int"
    old = [(1, 1, 1, 0), (2, 1, 1, 0), (3, 2, 5, 0), (4, 3, 1, 0), (None, 1, 1, 0), (6, None, 1, 0)]
    new = [(1, 2, 1, 1), (2, 1, 7, 1), (3, 2, 5, 1), (6, 1, None, 1), (9, 9, 9, 1)]
    store = upsert.KeyedTable(spark, fresh_path(spark, "t"), ["k"], "p", "int", sort_by=sort_by)
    store.upsert(table(schema, *old))
    for _ in range(2):
        store.upsert(table(schema, *new))
        assert rows(store.read()) == rows(upsert.merged(table(schema, *old), table(schema, *new), ["k"]))


def test_rows_outside_the_bounds_stay(spark, table):
    schema = "k long, p int, v int"
    old, new = [(1, 1, 0), (2, 1, 5), (3, 2, None)], [(1, 1, 1), (2, 1, 1), (3, 2, 1)]
    store = upsert.KeyedTable(spark, fresh_path(spark, "t"), ["k", "p"], "p", "int", keys_stay=True)
    store.upsert(table(schema, *old))
    store.upsert(table(schema, *new), target_where="v < 3")
    assert rows(store.read()) == rows(upsert.merged(table(schema, *old), table(schema, *new), ["k", "p"], "v < 3"))


def test_counts_per_column_need_no_rows_per_key(spark, table, merged_joins):
    a, b = table("k long, v string", (1, "x"), (1, "y"), (2, None)), table("k long, v string", (1, "x"), (2, "z"))
    df = diff.compare_all_columns(a, b, "k")
    assert not re.search(r"hashpartitioning\(primary_key#\w+, column_name#", plan(df))
    assert rows(df.filter("column_name = 'V'"), "perfect_match", "null_in_a", "conflicting_values") == [(1, 1, 2)]


def test_a_snapshot_is_planned_once(spark, table, monkeypatch):
    labels = []
    keep = history.written
    monkeypatch.setattr(history, "written", lambda df, label: labels.append(label) or keep(df, label))
    kept = history.HistoryTable(spark, fresh_path(spark, "history"), "k", ["v"])
    for day, value in ((1, 0), (2, 1)):
        kept.snapshot(table("k long, v int", (1, value)), dt.date(2024, 1, day))
    assert labels == ["snapshot"]
    assert kept.read().count() == 2


@given
def test_lines_for_buckets_are_dealt_once(spark, merged_joins, monkeypatch):
    dealt, keep = [], registry.bucketed

    def seen(df, name, path, column, buckets, append=False):
        if not append:
            dealt.extend(line for found in ("l_extendedprice", "line_gross_revenue") for line in exchanges_over(df.repartition(buckets, column), found))
        return keep(df, name, path, column, buckets, **({"append": True} if append else {}))

    monkeypatch.setattr(registry, "bucketed", seen)
    result = QUERIES["bucketed_order_items"](spark, FOLDER)
    assert len(set(dealt)) == 1 and "l_orderkey" in dealt[0]
    assert result.count() == spark.read.parquet(f"{FOLDER}/lineitem.parquet").count()
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"


@pytest.mark.parametrize("whole", ["true", "false"])
def test_lines_by_order_are_the_enriched_lines(spark, inputs, whole):  # noqa: F811
    lines, products = staging.stg_order_items(inputs, AS_OF), inputs["catalog_products"]
    unknown = [lines.withColumn(c, F.lit(None).cast("long")) for c in ("product_id", "order_id")]
    odd = lines.unionByName(lines).unionByName(unknown[0]).unionByName(unknown[1])
    tables = {**inputs, "stg_order_items": odd, "catalog_products": products.unionByName(products)}
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", whole)
    try:
        built = enrich.order_items_by_order(tables, AS_OF)
        assert rows(built.drop("product_copy")) == rows(enrich.order_items_enriched(tables, AS_OF).filter("order_id IS NOT NULL"))
        # Each line once, however often the catalogue has its product.
        once = built.filter("product_copy = 1")
        assert rows(once, "order_item_id", "product_id") == rows(odd.filter("order_id IS NOT NULL"), "order_item_id", "product_id")
    finally:
        spark.conf.unset("spark.sql.requireAllClusterKeysForCoPartition")


def test_stores_join_orders_before_these_lie_by_order(spark, inputs, merged_joins):  # noqa: F811
    lines = plan(enrich.orders_enriched(inputs, AS_OF).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "order_id")).splitlines()
    first = next(line for line in lines if "Exchange" in line or "Join" in line)
    assert "Join" in first and "order_id" in first  # nothing is dealt after the last join


@given
def test_ids_of_lines_do_not_read_what_no_result_shows(spark):
    assert not re.search("l_tax|l_returnflag|l_linestatus", plan(QUERIES["fct_order_items"](spark, FOLDER)))


def test_the_partition_may_be_a_key(spark, table):
    store = upsert.KeyedTable(spark, fresh_path(spark, "t"), ["k", "p"], "p", "int")
    for v in (1, 2):
        store.upsert(table("k long, p int, v int", (1, 1, v), (1, 2 * v, v)))
    assert rows(store.read()) == [(1, 1, 2), (1, 2, 1), (1, 4, 2)]


@pytest.mark.parametrize("deal", [True, False])
def test_an_upsert_writes_no_row_that_stays_beside_new_keys(spark, table, monkeypatch, deal):
    store = upsert.KeyedTable(spark, fresh_path(spark, "t"), ["k"], "p", "int", deal=deal)
    writes, write = [], upsert.KeyedTable._write
    monkeypatch.setattr(upsert.KeyedTable, "_write", lambda self, df: writes.append(df.count()) or write(self, df))
    store.upsert(table("k long, p int, v int", (1, 1, 0), (2, 1, 0), (3, 2, 0)))
    store.upsert(table("k long, p int, v int", (4, 1, 1), (5, 2, 1)))  # new keys: the rows of both partitions stay in their files
    store.upsert(table("k long, p int, v int", (3, 2, 2), (5, 2, 2)))  # all rows of a partition: none is read again
    assert writes == [3, 2, 2]
    store.upsert(table("k long, p int, v int", (1, 2, 3)))  # leaves three others behind
    assert writes == [3, 2, 2, 1, 2]
    assert rows(store.read(), "k", "p", "v") == [(1, 2, 3), (2, 1, 0), (3, 2, 2), (4, 1, 1), (5, 2, 2)]


def test_rows_without_a_deal_are_not_shuffled(spark):
    store = upsert.KeyedTable(spark, fresh_path(spark, "t"), ["k"], "p", "int", sort_by=["k"], deal=False)
    store.upsert(spark.range(0, 40, 1, 3).selectExpr("id AS k", "int(id % 2) AS p"))
    assert len(store.read().inputFiles()) == 6  # three tasks with two partitions each
    assert rows(store.read()) == [(k, k % 2) for k in range(40)]


def by_order(spark, inputs):  # noqa: F811
    return {**inputs, **{name: registry._by_order(inputs[name], fresh_path(spark, name)) for name in increments.ORDER_TABLES}}


def test_lines_landed_by_order_are_not_dealt_again(spark, inputs, merged_joins):  # noqa: F811
    tables = by_order(spark, inputs)
    keys = increments.affected_orders(tables, F.lit(None).cast("timestamp"))
    built = core.fct_orders(increments.of_orders(tables, keys), AS_OF)
    assert "raw_order_items_" in plan(built)
    # Only the ids of what was loaded go to their orders.
    assert not any("sum(" in x or "line_gross_revenue" in x for x in exchanges_over(built, "raw_order_items_"))
    assert rows(built) == rows(core.fct_orders(inputs, AS_OF))


def test_lines_that_lie_by_order_stay_there(spark, inputs, merged_joins):  # noqa: F811
    tables, orders = by_order(spark, inputs), core.fct_orders(inputs, AS_OF)
    with registry._staying_by_order(spark):
        built = increments.lines_of_orders(tables, AS_OF, orders, by_order=True)
        dealt = exchanges_over(built, "raw_order_items_")
        assert dealt and all("hashpartitioning(product_id" in x or "hashpartitioning(order_id" in x for x in dealt)
        assert rows(built) == rows(core.fct_order_items(inputs, AS_OF))


def test_unknown_orders_meet_unknown_keys_only(spark, table):
    orders = table("order_id long, v int", (1, 1), (2, 2), (None, 3), (1, 4))
    among = lambda *keys: rows(increments._orders_among(orders, table("order_id long", *[(k,) for k in keys])), "v")
    assert (among(1, 5), among(None, 2), among()) == ([(1,), (4,)], [(2,), (3,)], [])


def test_store_days_do_not_number_lines(spark, tmp_path):
    """A line without a number has no id, which store days do not show."""
    empty = {name: spark.createDataFrame([], schema) for name, schema in sample_retail.SOURCES.items()}
    line = "SELECT 1L AS l_orderkey, 1L AS l_partkey, 1L AS l_suppkey, int(NULL) AS l_linenumber, 1D AS l_quantity, 2D AS l_extendedprice, 0D AS l_discount, 0D AS l_tax, 'N' AS l_returnflag, 'O' AS l_linestatus, TIMESTAMP_NTZ'2000-01-01 00:00:00' AS l_shipdate"
    for name, df in {**empty, "lineitem": spark.sql(line)}.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    assert rows(registry._landed(spark, str(tmp_path), line_ids=False)["raw_order_items"], "order_id", "order_item_id", "line_gross_revenue") == [(1, None, 2)]
    with pytest.raises(Exception, match="beyond the range"):
        registry._landed(spark, str(tmp_path))
