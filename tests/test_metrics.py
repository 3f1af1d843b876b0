import datetime as dt
from decimal import Decimal as D

import pytest

from marketloom.operators.metrics import Derived, Entity, Fact, Metrics, Ratio, Simple
from marketloom.plans.catalogue import CATALOGUE, METRICS, SAVED, VIEWS
from tests.conftest import rows


@pytest.fixture(scope="module")
def shop(table):
    d = dt.date
    sales = table(
        "day date, region string, customer long, amount decimal(12,2), ok boolean",
        (d(2026, 1, 5), "N", 1, D("10"), True), (d(2026, 1, 20), "N", 2, D("20"), False), (d(2026, 1, 7), None, 1, D("5"), True),
        (d(2026, 3, 31), "N", 3, D("60"), True), (d(2026, 4, 1), "N", 9, D("15"), False),
    )
    costs = table("day date, region string, cost decimal(12,2)", (d(2026, 1, 9), "N", D("4")), (d(2026, 2, 9), "N", D("8")), (d(2026, 1, 9), None, D("1")))
    people = table("id long, kind string", (1, "old"), (2, "new"), (3, "new"))
    metrics = Metrics(
        {"sales": Fact("day", {"people": Entity("people", "customer", "id")}), "costs": Fact("day")},
        {
            "revenue": Simple("sales", "sum", "amount"),
            "orders": Simple("sales", "count", "amount"),
            "mean": Simple("sales", "average", "amount"),
            "good": Simple("sales", "sum", "amount", "ok"),
            "cost": Simple("costs", "sum", "cost"),
            "basket": Ratio("revenue", "orders"),
            "profit": Derived("coalesce({revenue}, 0) - coalesce({cost}, 0)"),
            "margin": Ratio("profit", "revenue"),
            "growth": Derived("double({revenue} - {revenue@1}) / nullif(double({revenue@1}), 0D)"),
        },
    )
    return metrics, {"sales": sales, "costs": costs, "people": people}


def test_facts_meet_on_dimensions(shop):
    metrics, tables = shop
    got = metrics.query(tables, ["revenue", "basket", "good", "profit", "margin"], ["region"], "quarter")
    q = dt.date
    assert rows(got) == [
        (None, q(2026, 1, 1), D("5.00"), 5.0, D("5.00"), D("4.00"), 0.8),
        ("N", q(2026, 1, 1), D("90.00"), 30.0, D("70.00"), D("78.00"), pytest.approx(78 / 90)),
        ("N", q(2026, 4, 1), D("15.00"), 15.0, None, D("15.00"), 1.0),
    ]


def test_offset_does_not_skip_missing_months(shop):
    metrics, tables = shop
    got = metrics.query(tables, ["revenue", "growth"], [], "month")
    m = dt.date
    assert rows(got) == [(m(2026, 1, 1), D("35.00"), None), (m(2026, 3, 1), D("60.00"), None), (m(2026, 4, 1), D("15.00"), -0.75)]
    with pytest.raises(ValueError):
        metrics.query(tables, ["growth"], [], "week")


def test_foreign_dimension_filter_and_spine(shop, spark):
    metrics, tables = shop
    assert rows(metrics.query(tables, ["orders", "mean"], ["people.kind"])) == [(None, 1, 15.0), ("new", 2, 40.0), ("old", 2, 7.5)]
    assert rows(metrics.query(tables, ["revenue"], where="ok")) == [(D("75.00"),)]
    new_in_winter = "{people.kind} = 'new' AND month(day) < 3"
    assert rows(metrics.query(tables, ["revenue"], ["region"], where=new_in_winter)) == [("N", D("20.00"))]
    assert rows(metrics.query(tables, ["orders"], ["people.kind"], where="{people.kind} IS NOT NULL")) == [("new", 2), ("old", 2)]
    spine = spark.sql("SELECT explode(sequence(DATE'2026-01-01', DATE'2026-04-30')) AS date_day")
    filled = metrics.query(tables, ["revenue"], [], "month", spine=spine)
    assert rows(filled) == [(dt.date(2026, i, 1), v) for i, v in ((1, D("35.00")), (2, None), (3, D("60.00")), (4, D("15.00")))]
    weekly = metrics.query(tables, ["revenue"], [], "week")
    assert rows(weekly)[0] == (dt.date(2026, 1, 5), D("15.00"))
    with pytest.raises(ValueError):
        metrics.query(tables, ["revenue"], [], "hour")


def test_catalogue_is_complete():
    # 50 named ones, the restricted month-1 retention, and the revenue a share is taken of.
    assert len(METRICS) == 52
    for name in METRICS:
        assert CATALOGUE._inputs(name) and CATALOGUE._sql(name)
    assert len(SAVED) == 8 and all(set(q["names"]) <= set(METRICS) for q in SAVED.values())
    assert {v: len(m.metrics) for v, m in VIEWS.items()} == {
        "revenue": 9, "customers": 8, "customer_orders": 2, "campaigns": 9, "attribution": 3
    }


@pytest.mark.parametrize("grain", ["month", "week", "quarter"])
def test_every_value_unfolds_its_periods(shop, table, grain):
    """Regions have a row for every period of the spine, NULL regions too; values without any row do not appear."""
    metrics, tables = shop
    days = [(dt.date(2025, 12, 1) + dt.timedelta(days=n),) for n in range(200)]
    got = rows(metrics.query(tables, ["revenue", "cost"], ["region"], grain, spine=table("date_day date", *days)))
    cut = {"month": lambda x: x.replace(day=1), "week": lambda x: x - dt.timedelta(days=x.weekday()), "quarter": lambda x: x.replace(month=(x.month - 1) // 3 * 3 + 1, day=1)}[grain]
    periods = sorted({cut(x) for (x,) in days})
    assert [(r[0], r[1]) for r in got] == [(None, p) for p in periods] + [("N", p) for p in periods]
    plain = rows(metrics.query(tables, ["revenue", "cost"], ["region"], grain))
    assert [r for r in got if r[2] is not None or r[3] is not None] == plain


def test_every_value_of_a_linked_table_unfolds_its_periods(shop, table):
    metrics, tables = shop
    spine = table("date_day date", (dt.date(2026, 1, 1),), (dt.date(2026, 2, 1),), (dt.date(2026, 4, 1),))
    got = rows(metrics.query(tables, ["orders"], ["people.kind"], "month", where="{people.kind} IS NOT NULL", spine=spine))
    d = dt.date  # the spine has no day in March, so March is not filled, and its order is not shown
    assert got == [("new", d(2026, 1, 1), 1), ("new", d(2026, 2, 1), None), ("new", d(2026, 4, 1), None)] + [
        ("old", d(2026, 1, 1), 2), ("old", d(2026, 2, 1), None), ("old", d(2026, 4, 1), None)
    ]
