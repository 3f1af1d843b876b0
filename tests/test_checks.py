import datetime as dt

import pytest

from marketloom.operators import checks
from tests.conftest import rows


def failures(found):
    return checks.verdict(found, "x").first().failures


def test_row_checks_alone_and_fused(table):
    df = table("id long, city string, note string", (-1, "Barcelona", " "), (11, "London", None), (None, "Paris", "x"))
    assert checks.accepted_range(df, "id", -1, 11).count() == 0
    assert checks.accepted_range(df, "id", -2, 11.1, inclusive=False).count() == 0
    assert checks.accepted_range(df, "id", -1, 11, inclusive=False).count() == 2
    assert checks.not_null(df, "id").count() == 1
    assert checks.not_accepted_values(df, "city", ["Madrid", "Berlin"]).count() == 0
    assert rows(checks.accepted_values(df, "city", ["Paris"])) == [("Barcelona", 1), ("London", 1)]
    assert checks.not_empty_string(df, "note").count() == 1
    assert checks.not_empty_string(df, "note", trim_whitespace=False).count() == 0
    fused = checks.run_row_checks(
        df, {"a": checks.fails_not_null("id"), "b": checks.fails_range("id", 0), "c": checks.fails_accepted_values("city", ["O'Hare"])}
    )
    assert rows(fused) == [("a", 1, False), ("b", 1, False), ("c", 3, False)]


def test_expression(table):
    df = table("a double, b double", (0.0, 1.0), (1.0, 0.0), (0.5, 0.5), (None, 1.0))
    assert checks.expression_is_true(df, "a + b = 1").count() == 0
    assert checks.expression_is_true(df, "+ b = 1", "a").count() == 0
    assert checks.expression_is_true(df, "= 0.5", "a").count() == 2


def test_unique_and_relationships(table):
    df = table("month string, product string", ("1", "a"), ("1", "b"), ("2", "a"), ("2", "a"), (None, "a"), (None, "b"))
    assert rows(checks.unique_combination_of_columns(df, ["month", "product"])) == [("2", "a", 2)]
    assert rows(checks.unique(df, "month")) == [("1", 2), ("2", 2)]
    child, parent = table("id long", (1,), (2,), (4,), (4,), (None,)), table("id long", (1,), (2,), (3,))
    assert rows(checks.relationships(child, "id", parent, "id")) == [(4, 2)]
    assert checks.relationships_where(child, "id", parent, "id", from_condition="id <> 4").count() == 0
    assert rows(checks.relationships_where(child, "id", parent, "id", to_condition="id > 1")) == [(1, 1), (4, 2)]


def test_at_least_one_and_not_constant(table):
    df = table("field string, value long", ("a", 1), ("b", None), ("b", None))
    assert checks.at_least_one(df, "value").count() == 0
    assert rows(checks.at_least_one(df, "value", ["field"])) == [("b", 0)]
    assert checks.at_least_one(df.filter("false"), "value").count() == 1
    same = table("a long, f long", (1, 1), (1, 1), (1, 2), (2, 5), (3, None))
    assert checks.not_constant(same, "f").count() == 0
    assert rows(checks.not_constant(same, "f", ["a"])) == [(2, 1)]


def test_proportion(table):
    data = [(1, 1), (None, 2), (None, 3), (4, 4), (5, 5), (6, 6), (None, 7), (None, 8), (None, None), (10, 10)]
    df = table("half long, most long", *data)
    assert checks.not_null_proportion(df, "half", 0.5, 0.5).count() == 0
    assert checks.not_null_proportion(df, "most", 0.9).count() == 0
    assert checks.not_null_proportion(df, "most", 0.95).count() == 1
    assert checks.not_null_proportion(df, "half", 0, group_by=["most"]).count() == 0


def test_recency_and_freshness(table):
    df = table("at timestamp, g string", (dt.datetime(2026, 1, 1, 23), "a"), (dt.datetime(2026, 1, 3), "b"))
    now = dt.datetime(2026, 1, 3, 12)
    assert rows(checks.recency(df, "at", "day", 1, now, group_by=["g"]), "g") == [("a",)]
    assert checks.recency(df, "at", "day", 1, now).count() == 0
    assert checks.recency(df.filter("g = 'a'"), "at", "day", 2, now, ignore_time_component=True).count() == 0
    assert checks.freshness(df, now, 11, "at").count() == 1
    assert checks.freshness(df, now, 12, "at").count() == 0


def test_cardinality_and_counts(table):
    a = table("x long", (1,), (2,), (3,))
    b = table("x long, y long", (1, 2), (2, 3), (3, 1))
    assert checks.cardinality_equality(a, "x", b, "x").count() == 0
    assert checks.cardinality_equality(a, "x", b, "y").count() == 0
    c = table("x long", (1,), (1,), (3,), (None,))
    assert rows(checks.cardinality_equality(a, "x", c, "x")) == [(None, 1, False), (1, 1, True), (1, 2, False), (2, 1, True)]
    assert failures(checks.equal_rowcount(a, b)) == 0
    assert failures(checks.equal_rowcount(a, c)) == 1
    # A group on one side only counts 0.
    assert failures(checks.equal_rowcount(a, c, ["x"])) == 1
    assert checks.equal_rowcount(a, c, ["x"]).count() == 4
    assert failures(checks.fewer_rows_than(a, b)) == 1
    assert failures(checks.fewer_rows_than(a, c)) == 0
    assert failures(checks.fewer_rows_than(c, a)) == 1
    assert failures(checks.fewer_rows_than(c, a, ["x"])) == 2


def test_equality(table):
    a = table("col_a long, col_b long, col_c long", (1, 1, 3), (1, 2, 1), (2, 3, 3))
    b = table("col_a long, col_b long, col_c long", (1, 1, 2), (1, 2, 2), (2, 3, 2))
    assert failures(checks.equality(a, a)) == 0
    assert failures(checks.equality(a, b)) == 6
    assert failures(checks.equality(a, b, compare_columns=["col_a", "col_b"])) == 0
    assert failures(checks.equality(a, b, exclude_columns=["COL_C"])) == 0
    assert failures(checks.equality(a, a.limit(0))) == 6
    f, g = table("id string, v double", ("p", 62.3888186)), table("id string, v double", ("p", 62.3888187))
    assert failures(checks.equality(f, g, precision=4)) == 0
    assert failures(checks.equality(f, g, precision=8)) == 2
    with pytest.raises(ValueError):
        checks.equality(a, b.drop("col_c"))


def test_exclusive_ranges(table):
    check = checks.mutually_exclusive_ranges
    whole = table("lo long, hi long", (0, 1), (1, 2), (2, 4))
    assert check(whole, "lo", "hi", gaps="not_allowed").count() == 0
    assert check(whole, "lo", "hi", gaps="required").count() == 2
    d = dt.date
    gaps = table(
        "s long, a date, b date", (1, d(2019, 1, 1), d(2019, 2, 1)), (1, d(2019, 3, 3), d(2019, 4, 1)),
        (2, d(2019, 5, 6), d(2019, 7, 2)), (2, d(2019, 7, 3), None),
    )
    upper = "coalesce(b, DATE'2099-01-01')"
    assert check(gaps, "a", upper, "s", "allowed").count() == 0
    assert check(gaps, "a", upper, "s", "required").count() == 0
    assert check(gaps, "a", upper, "s", "not_allowed").count() == 2
    assert check(gaps, "a", "b", "s").count() == 1
    zero = table(
        "s long, a date, b date", (3, d(2020, 5, 6), d(2020, 5, 7)), (3, d(2020, 5, 8), d(2020, 5, 10)),
        (3, d(2020, 5, 8), d(2020, 5, 8)), (3, d(2020, 5, 12), d(2020, 5, 15)), (4, d(2020, 6, 6), d(2020, 6, 7)),
        (4, d(2020, 6, 8), d(2020, 6, 8)), (4, d(2020, 6, 9), d(2020, 6, 10)),
    )
    assert check(zero, "a", "b", "s", zero_length_range_allowed=True).count() == 0
    assert check(zero, "a", "b", "s").count() == 2
    copies = table("lo long, hi long", (1, 2), (1, 2), (1, 2), (2, 3), (None, 4))
    found = check(copies, "lo", "hi")
    assert rows(found, "lower_bound", "next_lower_bound", "copies") == [(None, None, 1), (1, 1, 2)]
    assert failures(found) == 3
    with pytest.raises(ValueError):
        check(whole, "lo", "hi", gaps="perhaps")


def test_sequential(table):
    df = table("g long, v long", (1, 2), (1, 4), (1, 6), (2, 8), (2, 10))
    assert checks.sequential_values(df, "v", 2).count() == 0
    assert checks.sequential_values(df, "v", 2, group_by=["g"]).count() == 0
    assert checks.sequential_values(df, "v").count() == 4
    hours = table("t timestamp", *[(dt.datetime(2021, 1, 1, h),) for h in (0, 1, 2, 3, 3, 5)])
    assert rows(checks.sequential_values(hours, "t", 1, "hour"), "previous_value", "copies") == [
        (dt.datetime(2021, 1, 1, 3), 1), (dt.datetime(2021, 1, 1, 3), 1)
    ]
