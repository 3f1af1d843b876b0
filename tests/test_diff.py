import datetime as dt
import itertools
import random

import pytest

from marketloom.operators import diff
from tests.conftest import rows


@pytest.fixture(scope="module")
def produce(table):
    schema = "id long, fruit string, ripeness string"
    a = table(schema, (1, "banana", "yellow"), (2, "banana", "green"), (3, "banana", "brown"), (4, "orange", "green"),
              (5, "orange", "orange"), (6, "orange", "brown"), (7, "orange", None), (8, "apple", "mushy"))
    b = table(schema, (1, "banana", "yellow"), (2, "banana", "brown"), (3, "banana", "brown"), (4, "orange", "green"),
              (5, "orange", "orange"), (6, None, "brown"), (7, "orange", "orange"), (9, "apple", "mushy"), (10, "apple", None))
    return a, b


def test_row_summary_and_detail(table):
    a, b = table("x long, y string", (1, "a"), (2, "b"), (2, "b")), table("x long, y string", (1, "a"), (2, "c"))
    assert [(r.in_a, r.in_b, r["count"], float(r.percent_of_total)) for r in diff.compare_rows(a, b).collect()] == [
        (True, True, 1, 33.33), (True, False, 1, 33.33), (False, True, 1, 33.33)
    ]
    assert [(r.in_a, r["count"], float(r.percent_of_total)) for r in diff.compare_rows(a, b, ["Y"]).collect()] == [(True, 2, 100.0)]
    assert rows(diff.row_differences(a, b)) == [(2, "b", True, False), (2, "c", False, True)]
    assert rows(diff.row_differences(a, b, order_by=["x"], limit=1)) == [(2, "b", True, False)]


def test_all_columns(produce):
    a, b = produce
    summary = diff.compare_all_columns(a, b, "id")
    assert rows(summary) == [("FRUIT", 6, 0, 1, 2, 1, 1), ("ID", 7, 0, 0, 2, 1, 0), ("RIPENESS", 5, 1, 1, 2, 1, 2)]
    assert rows(diff.compare_all_columns(a, b, "id", keys_are_unique=True)) == rows(summary)
    assert rows(diff.compare_all_columns(a, b, "id", ["ripeness"])) == [("FRUIT", 6, 0, 1, 2, 1, 1), ("ID", 7, 0, 0, 2, 1, 0)]
    detail = diff.compare_all_columns(a, b, "id", summarize=False)
    assert detail.count() == 30
    conflicts = detail.filter("conflicting_values OR missing_from_a OR missing_from_b").drop("row_count")
    assert rows(conflicts.filter("column_name <> 'ID'")) == [
        (2, "RIPENESS", False, False, False, False, False, True),
        (6, "FRUIT", False, False, True, False, False, True),
        (7, "RIPENESS", False, True, False, False, False, True),
        (8, "FRUIT", False, False, False, False, True, False),
        (8, "RIPENESS", False, False, False, False, True, False),
        (9, "FRUIT", False, False, False, True, False, False),
        (9, "RIPENESS", False, False, False, True, False, False),
        (10, "FRUIT", False, False, False, True, False, False),
        (10, "RIPENESS", False, False, True, True, False, False),
    ]


def test_one_column(produce):
    a, b = produce
    got = diff.compare_column(a, b, "id", "ripeness").collect()
    assert [(r.match_status, r.count_records, float(r.percent_of_total)) for r in got] == [
        ("✅: perfect match", 5, 50.0),
        # In the last row the other side is missing, so both values are unknown.
        ("✅: both are null", 1, 10.0),
        ("🤷: missing from a", 1, 10.0),
        ("🤷: missing from b", 1, 10.0),
        ("🤷: value is null in a only", 1, 10.0),
        ("❌: values do not match", 1, 10.0),
    ]
    assert diff.compare_column(a, b, "id", "fruit", "x", "y", emojis=False).filter("match_status = 'missing from x'").count() == 1


def brute_force_flags(a, b):
    """Pairs as a full outer join builds them."""
    out = {}
    pairs = [(x, y) for x in a for y in b if x[0] is not None and x[0] == y[0]]
    pairs += [(x, None) for x in a if x[0] is None or all(x[0] != y[0] for y in b)]
    pairs += [(None, y) for y in b if y[0] is None or all(y[0] != x[0] for x in a)]
    for x, y in pairs:
        apk, bpk = (x or (None,))[0], (y or (None,))[0]
        u, v = (x or (0, None))[1], (y or (0, None))[1]
        both = apk is not None and bpk is not None
        equal = (u == v and both) if u is not None and v is not None else ((u is None and v is None) if both else False)
        conflict = both and not (u is None and v is None) and u != v
        flags = (equal, u is None and apk is not None, v is None and bpk is not None, apk is None, bpk is None, conflict)
        key = (apk if apk is not None else bpk, *flags)
        out[key] = out.get(key, 0) + 1
    return out


def test_repeated_and_null_keys_count_pairs(table):
    random.seed(3)
    pick = lambda n: [(random.choice([1, 2, 3, 4, None]), random.choice(["x", "y", None])) for _ in range(n)]
    for _ in range(3):
        a, b = pick(14), pick(11)
        got = diff.column_flags(table("k long, v string", *a), table("k long, v string", *b), "k", ["v"]).collect()
        assert {(r[0], *r[2:8]): r.row_count for r in got} == brute_force_flags(a, b)


def test_a_hot_repeated_key_is_counted_not_paired(spark):
    # 40,000 × 30,000 rows of one key: 1.2 billion pairs, a few rows of work.
    a = spark.range(40_000).selectExpr("1L AS k", "id % 4 AS v").union(spark.range(10, 60).selectExpr("id", "id"))
    b = spark.range(30_000).selectExpr("1L AS k", "id % 3 AS v").union(spark.range(10, 50).selectExpr("id", "id"))
    got = diff.compare_column(a, b, "k", "v", emojis=False)
    assert rows(got, "match_status", "count_records") == [
        ("missing from b", 10), ("perfect match", 3 * 10_000 * 10_000 + 40), ("values do not match", 1_200_000_000 - 300_000_000)
    ]
    sizes = diff.classify_rows(a, b, ["k"], sample_limit=3)
    assert rows(sizes.select("row_status", "num_rows_in_status").distinct()) == [("identical", 40), ("nonunique_pk", 40_000), ("removed", 10)]
    whole = diff.classify_rows(a, b, ["k"], sample_limit=None)
    # Copies on both sides: 10,000 of each of three values; all other copies are on one side.
    assert whole.filter("row_status = 'nonunique_pk' AND in_a AND in_b").count() == 30_000
    assert whole.filter("in_a").count() == 40_050 and whole.filter("in_b").count() == 30_040


def classify(a, b, keys, **kw):
    return diff.classify_rows(a, b, keys, **kw)


def test_classify_all_statuses(table):
    a = table("id long, c1 string, c2 string", (1, "abc", "def"), (2, "hij", "klm"), (3, "nop", "qrs"))
    b = table("id long, c1 string, c2 string", (1, "abc", "def"), (2, "changed", "values"), (4, "nop", "qrs"))
    for limit in (20, None):
        assert rows(classify(a, b, ["id"], sample_limit=limit), "row_status", "id", "in_a", "in_b", "num_rows_in_status") == [
            ("added", 4, False, True, 1),
            ("identical", 1, True, True, 1),
            ("modified", 2, False, True, 1),
            ("modified", 2, True, False, 1),
            ("removed", 3, True, False, 1),
        ]
    # Key columns are compared even if they are not listed.
    assert "id" in classify(a, b, ["ID".lower()], columns=["c1"]).columns


def test_classify_keys(table):
    a = table("id long, id_2 long, c string", (12, 3, "a"), (1, 23, "b"))
    assert rows(classify(a, a, ["id", "id_2"]), "row_status", "id", "num_rows_in_status") == [("identical", 1, 2), ("identical", 12, 2)]
    one_null = table("id long, c string", (None, "a"), (2, "b"))
    assert rows(classify(one_null, one_null, ["id"]), "row_status", "id") == [("identical", None), ("identical", 2)]
    two = table("id long, c string", (None, "a"), (None, "b"), (3, "c"))
    assert rows(classify(two, two, ["id"]), "row_status", "id", "num_rows_in_status") == [
        ("identical", 3, 1), ("nonunique_pk", None, 2), ("nonunique_pk", None, 2)
    ]
    twice = table("id long, c string", (None, "a"), (None, "a"), (3, "c"))
    thrice = table("id long, c string", (None, "a"), (None, "a"), (None, "a"), (3, "c"))
    got = classify(twice, thrice, ["id"], sample_limit=None)
    assert rows(got, "row_status", "id", "in_a", "num_rows_in_status") == [
        ("identical", 3, True, 1), ("nonunique_pk", None, False, 3), ("nonunique_pk", None, True, 3), ("nonunique_pk", None, True, 3)
    ]


def test_classify_sample_and_period(table, spark):
    a = spark.range(100).selectExpr("id", "id % 7 AS v")
    b = spark.range(30, 130).selectExpr("id", "id % 7 + if(id % 2 = 0, 1, 0) AS v")
    got = classify(a, b, ["id"], sample_limit=5)
    assert rows(got.groupBy("row_status", "num_rows_in_status").count()) == [
        ("added", 30, 5), ("identical", 35, 5), ("modified", 35, 10), ("removed", 30, 5)
    ]
    whole = classify(a, b, ["id"], event_time="id", sample_limit=None)
    assert rows(whole.groupBy("row_status").count()) == [("identical", 35), ("modified", 70)]


def test_structs_can_be_compared(table):
    schema = "id long, s struct<a:int,b:string>"
    a, b = table(schema, (1, (1, "x")), (2, (2, "y"))), table(schema, (1, (1, "x")), (2, (2, "z")))
    assert rows(classify(a, b, ["id"]), "row_status", "id") == [("identical", 1), ("modified", 2), ("modified", 2)]
    assert rows(diff.which_columns_differ(a, b, ["id"])) == [("id", False), ("s", True)]
    assert rows(diff.compare_all_columns(a, b, "id"), "column_name", "conflicting_values") == [("ID", 0), ("S", 1)]


def test_which_columns_differ(table):
    schema = "id long, value_changes string, becomes_null long, becomes_not_null string, does_not_change string"
    a = table(schema, (1, "pink", 22, "a", "dave"), (2, "blue", 33, None, "dave"), (3, "green", 44, "c", "dave"))
    b = table(schema, (1, "red", 22, "a", "dave"), (2, "blue", None, "b", "dave"), (3, "green", 44, "c", "dave"), (9, "x", 1, "y", "z"))
    assert {r.column_name: r.has_difference for r in diff.which_columns_differ(a, b, ["id"]).collect()} == {
        "id": False, "value_changes": True, "becomes_null": True, "becomes_not_null": True, "does_not_change": False
    }
    some = diff.which_columns_differ(a, b, ["id"], ["does_not_change"])
    assert rows(some) == [("does_not_change", False), ("id", False)]


def test_identity(table):
    a = table("x long, y string", (1, "a"), (1, "a"), (None, "b"))
    same = lambda b: diff.tables_identical(a, b).first()[0]
    assert same(table("x long, y string", (None, "b"), (1, "a"), (1, "a")))
    assert not same(table("x long, y string", (None, "b"), (None, "b"), (1, "a")))
    assert not same(table("x long, y string", (1, "a"), (None, "b")))
    nulls, moved = table("x string, y string", ("a", None)), table("x string, y string", (None, "a"))
    assert not diff.tables_identical(nulls, moved).first()[0]
    empty = a.filter("false")
    assert diff.tables_identical(empty, empty).first()[0]
    assert not diff.tables_identical(a, empty).first()[0]
    assert rows(diff.row_counts({"p": a, "q": empty})) == [("p", 3), ("q", 0)]


def test_column_sets():
    assert diff.with_keys(["ID", "k"], ["id", "x"]) == ["k", "id", "x"]
    assert list(itertools.chain(diff.with_keys([], ["x"]))) == ["x"]


def test_one_meaning_of_equal_for_single_and_repeated_keys(table):
    a = table("k long, x double, y int", (1, 0.0, 7), (2, 0.0, 7), (2, 0.0, 7), (3, float("nan"), 1))
    b = table("k long, x double, y long", (1, -0.0, 7), (2, -0.0, 7), (3, float("nan"), 1))
    for column in ("x", "y"):
        states = {r.match_status: r.count_records for r in diff.compare_column(a, b, "k", column, emojis=False).collect()}
        assert states == {"perfect match": 4}


def test_common_period_of_an_empty_side(table):
    a = table("k long, at date", (1, dt.date(2026, 1, 1)), (2, dt.date(2026, 1, 2)))
    assert [df.count() for df in diff.common_bounds(a, a.filter("false"), "at")] == [0, 0]
