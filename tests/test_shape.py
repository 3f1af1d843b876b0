import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from marketloom.functions import scalars as fx
from marketloom.operators import shape
from marketloom.plans.web import url_report
from tests.conftest import rows


def test_date_spine_excludes_its_end(spark):
    leap = rows(shape.date_spine(spark, "day", "2024-02-27", "2024-03-02"))
    assert [d[0].isoformat()[5:] for d in leap] == ["02-27", "02-28", "02-29", "03-01"]
    months = rows(shape.date_spine(spark, "month", "2026-01-31", "2026-05-01"))
    assert [m[0].month for m in months] == [1, 2, 3, 4]
    assert shape.date_spine(spark, "week", "2026-01-01", "2026-01-29").count() == 4
    assert shape.date_spine(spark, "hour", "2026-01-01", "2026-01-02").count() == 24
    with pytest.raises(ValueError):
        shape.date_spine(spark, "decade", "2026-01-01", "2026-01-02")


def test_generate_series(spark):
    for n in (0, 1, 37):
        assert rows(shape.generate_series(spark, n)) == [(i,) for i in range(1, n + 1)]


def test_surrogate_key(table):
    values = [("oak", "elm"), ("oak", None), (None, "elm"), (None, None), ("", "elm"), ("oak-elm", "")]
    df = table("left_tree string, right_tree string", *values)

    def digest(*parts):
        return hashlib.md5("-".join(fx.NULL_KEY_TOKEN if p is None else p for p in parts).encode()).hexdigest()

    both = shape.with_surrogate_key(df, ["left_tree", "right_tree"], "k").collect()
    assert [r.k for r in both] == [digest(*v) for v in values] and len({r.k for r in both}) == len(values)
    one = shape.with_surrogate_key(df, ["right_tree"], "k").collect()
    assert [r.k for r in one] == [digest(v[1]) for v in values]
    empty = shape.with_surrogate_key(df, ["left_tree", "right_tree"], "k", nulls_as_empty=True).collect()
    assert empty[2].k == empty[4].k != both[2].k


def test_deduplicate(table):
    df = table("sensor string, reading double, taken long", ("n", 0.5, 8), ("n", 0.7, 31), ("s", 0.1, 2), ("n", 0.6, 30), (None, 0.9, 1))
    assert rows(shape.deduplicate(df, ["sensor"], [F.desc("taken")])) == [(None, 0.9, 1), ("n", 0.7, 31), ("s", 0.1, 2)]


def test_pivot(table):
    df = table("port string, cargo string", ("Oslo", "fish"), ("Oslo", "fish"), ("Oslo", "ship's oil"), ("Bergen", "wood"), ("Bergen", None))
    got = shape.pivot(df, ["port"], "cargo", ["fish", "wood", "ship's oil"])
    assert got.columns == ["port", "fish", "wood", "ship's oil"]
    assert rows(got) == [("Bergen", 0, 1, 0), ("Oslo", 2, 0, 1)]
    others = shape.pivot(df, ["port"], "cargo", ["fish"], cmp="!=", prefix="no_", suffix="_rows", else_value=None, agg="count")
    assert others.columns == ["port", "no_fish_rows"] and rows(others) == [("Bergen", 1), ("Oslo", 1)]


def test_unpivot(table):
    df = table(
        "Boat_Id long, built date, rig string, crew long, is_racing boolean",
        (7, dt.date(1988, 6, 30), "sloop", 4, None),
        (9, dt.date(2003, 9, 9), None, 11, False),
    )
    got = shape.unpivot(df, ["boat_id"], ["BUILT"], field_name="what", value_name="worth")
    assert got.columns == ["Boat_Id", "what", "worth"]
    assert rows(got) == [
        (7, "crew", "4"), (7, "is_racing", None), (7, "rig", "sloop"), (9, "crew", "11"), (9, "is_racing", "false"), (9, "rig", None)
    ]


def test_union_tables(table):
    a = table("code long, city string, score string", (11, "Kyoto", "high"), (12, "Lima", "3"))
    b = table("code long, river string, score long", (12, "Rimac", 40), (13, None, 41))
    got = shape.union_tables({"first": a, "second": b})
    assert got.columns == ["source_table", "code", "city", "score", "river"]
    assert rows(got, "source_table", "code", "city", "score", "river") == [
        ("first", 11, "Kyoto", "high", None), ("first", 12, "Lima", "3", None), ("second", 12, None, "40", "Rimac"), ("second", 13, None, "41", None)
    ]
    assert shape.union_tables({"first": a, "second": b}, exclude=["CITY"], source_column=None).columns == ["code", "score", "river"]
    assert shape.union_tables({"first": a, "second": b}, include=["code"], where="code > 11").count() == 3
    assert dict(shape.union_tables({"only": b}, overrides={"score": "double"}).dtypes)["score"] == "double"
    for wrong in ({"include": ["code"], "exclude": ["code"]}, {"include": ["depth"]}):
        with pytest.raises(ValueError):
            shape.union_tables({"first": a}, **wrong)


def test_star_and_blanks(table):
    df = table("Title string, note string, pages long", ("Atlas", "  ", 90), ("", "worn", 12))
    assert shape.star(df, ["NOTE"]).columns == ["Title", "pages"]
    assert [c.lower() for c in shape.star(df, prefix="b_", suffix="_x").columns] == ["b_title_x", "b_note_x", "b_pages_x"]
    assert (None, "worn", 12) in rows(shape.blank_to_null(df))


def test_column_values(table):
    df = table("tone string, kept boolean", *[("mi", k % 2 == 0) for k in range(5)], ("do", True), ("do", True), ("re", False), (None, False))
    got = [tuple(r) for r in shape.column_values(df, "tone").collect() if r[0]]
    assert got == [("mi", 5), ("do", 2), ("re", 1)]
    assert [r.value for r in shape.column_values(df, "tone", "kept", 1).collect()] == ["mi"]


def test_safe_arithmetic(table):
    cases = [(8, -5, None), (None, None, None), (0, 21, 4), (None, 13, 13)]
    df = table("x long, y long, z long", *cases)
    plain = [[v or 0 for v in c] for c in cases]
    assert [r[0] for r in df.selectExpr(fx.safe_add("x", "y", "z")).collect()] == [sum(c) for c in plain]
    assert [r[0] for r in df.selectExpr(fx.safe_subtract("x", "y", "z")).collect()] == [x - y - z for x, y, z in plain]
    quotients = [(9, 4), (9, 0), (0, 4), (0, 0), (None, 4), (9, None), (None, None)]
    df = table("top long, bottom long", *quotients)
    assert [r[0] for r in df.selectExpr(fx.safe_divide("top", "bottom")).collect()] == [2.25, None, 0.0, None, None, None, None]
    assert df.selectExpr(fx.safe_divide("top * 2", "bottom + 5")).first()[0] == 2.0


def test_rounding_is_half_up_in_decimal(table):
    df = table("a string, b long", ("4913.73", 2), ("-4913.73", 2))
    got = df.selectExpr(fx.ratio("cast(a AS decimal(12,2))", "b", 1, 2)).collect()
    assert [r[0] for r in got] == [2456.87, -2456.87]


def test_equal_width_bucket(table):
    weights = [-1.0, 0.0, 2.49, 2.5, 7.49, 9.99, 10.0, 55.0]
    df = table("w double", *[(w,) for w in weights])
    expected = [0 if w < 0 else 5 if w >= 10 else int(w // 2.5) + 1 for w in weights]
    assert [r[0] for r in df.selectExpr(fx.equal_width_bucket("w", 0, 10, 4)).collect()] == expected
    assert rows(shape.histogram(df, "w", 0, 10, 4), "bucket", "n") == sorted((b, expected.count(b)) for b in set(expected))


def test_urls(table):
    urls = {
        "https://shop.example.org/tea/green?utm_source=mail&utm_medium=x": ("shop.example.org", "tea/green", "mail"),
        "http://example.net/": ("example.net", "", None),
        "example.com": ("example.com", "", None),
        "example.com?utm_source=a/b": ("example.com", "", "a/b"),
        "http://example.net/one?x=1&utm_source=": ("example.net", "one", None),
        "android-app://org.example.reader/page/2": ("org.example.reader", "page/2", None),
    }
    df = table("url string", *[(u,) for u in urls])
    got = df.selectExpr("url", f"{fx.url_host('url')} AS host", f"{fx.url_path('url')} AS path", f"{fx.url_parameter('url', 'utm_source')} AS source")
    assert {r.url: (r.host, r.path, r.source) for r in got.collect()} == urls
    report = {(r[0], r[1], r[2]): r[3] for r in url_report(df).collect()}
    assert report[("shop.example.org", "mail", "tea")] == 1 and report[("example.net", None, "")] == 1 and sum(report.values()) == len(urls)


def test_distance(table):
    df = table("a double, b double, c double, d double", (0.0, 0.0, 0.0, 90.0), (90.0, 12.0, -90.0, 77.0), (10.0, 20.0, 10.0, 20.0))
    quarter = [r[0] for r in df.selectExpr(fx.great_circle_distance("a", "b", "c", "d", "km")).collect()]
    assert quarter[1] == pytest.approx(2 * quarter[0]) and 10_000 < quarter[0] < 10_020 and quarter[2] == 0
    miles = [r[0] for r in df.selectExpr(fx.great_circle_distance("a", "b", "c", "d")).collect()]
    assert quarter[0] / miles[0] == pytest.approx(1.609, abs=0.01)
    with pytest.raises(ValueError):
        fx.great_circle_distance("a", "b", "c", "d", "ly")


def test_month_count_counts_boundaries(table):
    df = table("a string, b string", ("2026-01-31", "2026-02-01"), ("2026-01-01", "2026-01-31"), ("2026-03-01", "2025-12-31"))
    got = [r[0] for r in df.selectExpr(fx.month_count("date(a)", "date(b)")).collect()]
    assert got == [1, 0, -3]
