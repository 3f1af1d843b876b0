"""Plans have the shape they are meant to have at scale."""

import pathlib

import pytest
from pyspark.sql import functions as F

from marketloom.operators import shape
from marketloom.registry import QUERIES
from marketloom.sources import sample_retail

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not pathlib.Path(FOLDER).exists(), reason="test tables not present")

EAGER = ("incremental", "stream", "scd2", "published", "declared", "refunds", "metric_across", "inventory_increment")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in QUERIES if not n.startswith(EAGER)])
def test_no_pairwise_joins_and_no_python_rows(spark, name):
    text = plan(QUERIES[name](spark, FOLDER))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas"):
        assert operator not in text


def test_unused_totals_are_not_computed(spark):
    # Weekly order counts need neither lines nor returns nor customers.
    inputs = sample_retail.retail_inputs(spark, FOLDER)
    from marketloom.plans.core import fct_orders

    counted = fct_orders(inputs, __import__("datetime").date(2001, 8, 2)).groupBy("order_week").count()
    assert "lineitem" not in plan(counted)


def test_rank_is_limited_before_the_shuffle(spark):
    df = shape.deduplicate(spark.range(100).selectExpr("id % 3 AS k", "id"), ["k"], [F.desc("id")])
    text = plan(df)
    assert text.count("WindowGroupLimit") == 2
    assert text.index("WindowGroupLimit", text.index("WindowGroupLimit") + 1) > text.index("Exchange")


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(QUERIES["check_accepted_range"](spark, FOLDER))
    assert "PushedFilters: [Or(" in text
    assert "l_extendedprice" not in text


def subtrees(text):
    """Of every node of a plan, its own line and the lines below it."""
    lines = text.splitlines()
    depth = [len(line) - len(line.lstrip(" :+-")) for line in lines]
    for k, line in enumerate(lines):
        end = next((j for j in range(k + 1, len(lines)) if depth[j] <= depth[k]), len(lines))
        yield line, lines[k + 1 : end]


@pytest.mark.parametrize("run", ["store_days", "campaign_days", "months"])
def test_a_run_sums_the_lines_of_its_orders_only(spark, run):
    import datetime as dt

    from marketloom.plans import increments

    inputs = sample_retail.web_inputs(spark, FOLDER) if run == "months" else sample_retail.retail_inputs(spark, FOLDER)
    at, since = dt.date(2001, 8, 2), dt.date(2001, 2, 1)
    held = spark.createDataFrame([(dt.date(2001, 1, 31),)], "order_date date")
    df = {
        "store_days": lambda: increments.store_performance_increment(inputs, at, held, dt.date(1998, 1, 1), loaded_since=since),
        "campaign_days": lambda: increments.campaign_performance_increment(inputs, at, held, loaded_since=since),
        "months": lambda: increments.channel_attribution_increment(inputs, at, held, loaded_since=dt.date(2024, 1, 20)),
    }[run]()
    text = df._jdf.queryExecution().optimizedPlan().toString()
    source = "event_id#" if run == "months" else "l_extendedprice#"
    sums = [below for line, below in subtrees(text) if line.lstrip(" :+-").startswith("Aggregate") and "sum(" in line and any(source in x for x in below)]
    assert sums and all(any("LeftSemi" in x for x in below) for below in sums)
