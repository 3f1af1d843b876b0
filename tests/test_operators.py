"""Numbering, as-of joins, upserts, history, nearest sites: against brute force."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from marketloom.functions import scalars as fx
from marketloom.operators import history, numbering, sketches, upsert
from marketloom.operators.asof import last_touch
from marketloom.operators.spatial import nearest_in_rings, nearest_site
from marketloom.session import fresh_path, shared_folder
from marketloom.sources.tables import PublishedTable, bucketed, clustered, interleaved, land, read_inputs, read_table
from tests.conftest import rows


def test_global_row_number(spark):
    ids = random.Random(1).sample(range(10**6), 3000)
    df = spark.createDataFrame([(i,) for i in ids] + [(None,)], "id long")
    got = {r.id: r.n for r in numbering.global_row_number(df, "id", "n", ranges=16).collect()}
    assert got == {i: n for n, i in enumerate([*sorted(ids), None], 1)}
    assert numbering.global_row_number(df.filter("false"), "id", "n").count() == 0


@pytest.mark.parametrize("grouped", [False, True])
def test_neighbours_cross_range_borders(spark, grouped):
    r = random.Random(2)
    # A third of all values in one group, another third equal in every group.
    data = {(r.choice([1, 1, 2, None]) if grouped else 0, r.randrange(500)) for _ in range(900)}
    df = spark.createDataFrame(list(data), "g long, v long")
    by = ["g"] if grouped else []
    after = {(x.g, x.v): x.n for x in numbering.with_next(df, "v", "n", by, ranges=8).collect()}
    before = {(x.g, x.v): x.n for x in numbering.with_previous(df, "v", "n", by, ranges=8).collect()}
    for g in {g for g, _ in data}:
        values = sorted(v for h, v in data if h == g)
        assert [after[g, v] for v in values] == [*values[1:], None]
        assert [before[g, v] for v in values] == [None, *values[:-1]]


def test_last_touch_equals_join_and_top_one(spark):
    r = random.Random(3)
    day = dt.date(2026, 1, 1)
    # One customer has a third of all events and orders.
    who = lambda: r.choice([1, 1, 2, 3, 4, None])
    touches = [(who(), day + dt.timedelta(r.randrange(120)), f"s{r.randrange(30)}", r.choice("abc")) for _ in range(900)]
    orders = [(i, who(), day + dt.timedelta(r.randrange(150))) for i in range(300)]
    o = spark.createDataFrame(orders, "order_id long, customer long, day date")
    t = spark.createDataFrame(touches, "customer long, seen date, session string, source string")
    got = last_touch(o, t, "customer", "day", "seen", ["session", "source"], lookback_days=30)
    expected = []
    for i, c, d in orders:
        near = [(s, session, source) for k, s, session, source in touches if k is not None and k == c and d - dt.timedelta(30) <= s <= d]
        if near:
            expected.append((i, *max(near)))
    assert rows(got, "order_id", "last_seen", "session", "source") == sorted(expected)


def test_nearest_site_equals_all_pairs(spark):
    r = random.Random(4)
    place = lambda: (r.uniform(-90, 90), r.choice([r.uniform(-180, 180), r.uniform(179, 180), r.uniform(-180, -179)]))
    points = [(i, *place()) for i in range(120)] + [(500 + i, 10.0, 20.0) for i in range(60)]
    sites = [(i, *place()) for i in range(80)] + [(90, 10.0, 20.5), (91, 10.0, 19.5), (92, 89.9, 0.0)]
    p, s = spark.createDataFrame(points, "id long, lat double, lon double"), spark.createDataFrame(sites, "sid long, lat double, lon double")

    def distance(a, b):
        (x, y), (u, v) = a, b
        h = math.sin(math.radians(u - x) / 2) ** 2 + math.cos(math.radians(x)) * math.cos(math.radians(u)) * math.sin(math.radians(v - y) / 2) ** 2
        return 2 * 3961 * math.asin(math.sqrt(min(1, h)))

    for within in (60, 700, 9000):
        got = {x.point_id: (x.site_id, x.distance) for x in nearest_site(p, s, "id", "sid", within).collect()}
        assert len(got) == len(points)
        for i, *at in points:
            best = min((round(distance(at, there), 6), k) for k, *there in sites)
            if best[0] > within:
                assert got[i][0] is None
            else:
                assert (round(got[i][1], 4), got[i][0]) == (pytest.approx(best[0], abs=1e-3), best[1])


def test_merge_rows(table):
    target = table("k long, part long, v string", (1, 1, "a"), (2, 2, "b"), (None, 1, "n"))
    updates = table("k long, part long, v string", (2, 2, "B"), (3, 1, "c"), (None, 1, "m"))
    # NULL never equals NULL in a merge condition.
    assert rows(upsert.merged(target, updates, ["k"])) == [(None, 1, "m"), (None, 1, "n"), (1, 1, "a"), (2, 2, "B"), (3, 1, "c")]
    bounded = upsert.merged(target, updates, ["k"], target_where="part = 1")
    assert rows(bounded, "k", "v") == [(None, "m"), (None, "n"), (1, "a"), (2, "B"), (2, "b"), (3, "c")]
    assert rows(upsert.repeated_keys(target.union(target), ["k"])) == [(None, 2), (1, 2), (2, 2)]


def test_schema_drift(table):
    target, updates = table("k long, v string", (1, "a")), table("k long, w long", (1, 5), (2, 6))
    with pytest.raises(upsert.SchemaDrift):
        upsert.merged(target, updates, ["k"])
    got = upsert.merged(target, updates, ["k"], on_schema_change="append_new_columns")
    assert got.columns == ["k", "v", "w"] and rows(got) == [(1, None, 5), (2, None, 6)]
    with pytest.raises(ValueError):
        upsert.reconcile(target, updates, "ignore")


def folder_of(df, column, value):
    return {f for f in df.filter(F.col(column) == value).inputFiles() if f"_slot=v{str(value).encode().hex().upper()}" in f}


def test_keyed_table(spark, table):
    store = upsert.KeyedTable(spark, fresh_path(spark, "t"), ["k"], "d", sort_by=["k"])
    d = dt.date
    schema = "k long, v string, d date"
    store.upsert(table(schema, (1, "a", d(2026, 1, 1)), (2, "b", d(2026, 1, 1)), (3, "c", d(2026, 2, 1)), (4, "d", d(2026, 3, 1))))
    files = folder_of(store.read(), "d", "2026-03-01")
    # 3 moves to another partition and leaves its old one empty; a rerun changes nothing.
    change = table(schema, (2, "B", d(2026, 1, 1)), (3, "C", d(2026, 1, 1)), (5, "e", d(2026, 4, 1)))
    for _ in range(2):
        store.upsert(change)
        assert rows(store.read().select("k", "v", "d")) == [
            (1, "a", d(2026, 1, 1)), (2, "B", d(2026, 1, 1)), (3, "C", d(2026, 1, 1)), (4, "d", d(2026, 3, 1)), (5, "e", d(2026, 4, 1))
        ]
    assert files and folder_of(store.read(), "d", "2026-03-01") == files  # not rewritten
    with pytest.raises(ValueError, match="more than one row"):
        store.upsert(table(schema, (9, "x", d(2026, 1, 1)), (9, "y", d(2026, 1, 1))))


def test_partition_values_of_any_kind(spark, table):
    store = upsert.KeyedTable(spark, fresh_path(spark, "t"), ["k"], "p", "string")
    store.upsert(table("k long, p string", (1, "a:b"), (2, "x/y%z"), (3, None), (4, "")))
    store.upsert(table("k long, p string", (1, "c"), (3, "x/y%z"), (4, "null")))
    assert rows(store.read().select("k", "p")) == [(1, "c"), (2, "x/y%z"), (3, "x/y%z"), (4, "null")]


def test_an_upsert_that_fails_changes_nothing(spark, table, monkeypatch):
    path = fresh_path(spark, "t")
    spark.range(3).write.parquet(f"{path}/data/left-over")  # of a first load that died
    store = upsert.KeyedTable(spark, path, ["k"], "p", "int")
    assert not store.exists()
    store.upsert(table("k long, p int, v int", (1, 1, 1), (2, 2, 1)), mark="one")
    change = table("k long, p int, v int", (1, 2, 2), (3, 3, 2))
    with monkeypatch.context() as patch, pytest.raises(RuntimeError, match="lost"):
        patch.setattr(type(store._commits), "add", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        store.upsert(change, mark="two")
    assert store.mark() == "one" and rows(store.read().select("k", "p", "v")) == [(1, 1, 1), (2, 2, 1)]
    store.upsert(change, mark="two")
    assert store.mark() == "two" and rows(store.read().select("k", "p", "v")) == [(1, 2, 2), (2, 2, 1), (3, 3, 2)]


def test_matching_reads_only_partitions_of_the_updates(spark, table, monkeypatch):
    store = upsert.KeyedTable(spark, fresh_path(spark, "t"), ["k", "p"], "p", "int", keys_stay=True)
    store.upsert(table("k long, p int, v int", *[(k, k % 5, 0) for k in range(50)]))
    read = []
    of = upsert.KeyedTable._of
    monkeypatch.setattr(upsert.KeyedTable, "_of", lambda self, record, slots: read.append(set(slots)) or of(self, record, slots))
    store.upsert(table("k long, p int, v int", (3, 3, 1), (103, 3, 1)))
    assert read == [{"v" + b"3".hex()}] * 2
    assert store.read().count() == 51 and store.read().filter("v = 1").count() == 2


def test_whole_partitions(spark, table):
    store = upsert.KeyedTable(spark, fresh_path(spark, "t"), ["k"], "p", "int")
    store.upsert(table("k long, p int", (1, 1), (2, 1), (3, 2)))
    store.upsert(table("k long, p int", (1, 1), (4, 3)), whole_partitions=True)
    assert rows(store.read().select("k", "p")) == [(1, 1), (3, 2), (4, 3)]


def test_keyed_table_gains_columns(spark, table):
    store = upsert.KeyedTable(spark, fresh_path(spark, "t"), ["k"], "p", "int", on_schema_change="append_new_columns")
    store.upsert(table("k long, p int", (1, 1), (2, 2)))
    store.upsert(table("k long, p int, extra string", (2, 2, "x"), (3, 2, "y")))
    assert rows(store.read().select("k", "p", "extra")) == [(1, 1, None), (2, 2, "x"), (3, 2, "y")]


def test_high_water_mark(table):
    source = table("k long, at timestamp", *[(i, dt.datetime(2026, 1, i)) for i in range(1, 11)])
    target = source.filter("k <= 6")
    assert rows(upsert.since_last(source, target, "at", "at"), "k") == [(i,) for i in range(3, 11)]
    assert upsert.since_last(source, target.filter("false"), "at", "at").count() == 10


def test_history(spark, table):
    schema = "id long, tier string, note string"
    t = [dt.datetime(2026, 1, d, 6) for d in (1, 2, 3, 4)]
    runs = [
        table(schema, (1, "a", "n"), (2, "b", "n"), (3, None, "n")),
        table(schema, (1, "A", "n"), (2, "b", "other note"), (3, None, "n"), (4, "d", "n")),
        table(schema, (1, "A", "n"), (3, "c", "n"), (4, "d", "n")),  # 2 is gone
        table(schema, (1, "A", "n"), (2, "b", "n"), (3, "c", "n"), (4, "d", "n")),  # 2 is back
    ]
    kept = history.opened(runs[0], "id", t[0])
    for snapshot, at in zip(runs[1:], t[1:]):
        once = history.snapshot_history(kept, snapshot, "id", ["tier"], at)
        again = history.snapshot_history(once, snapshot, "id", ["tier"], at)
        assert rows(once) == rows(again)
        kept = once
    assert rows(kept, "id", "tier", "note", "valid_from", "valid_to") == [
        (1, "A", "n", t[1], None), (1, "a", "n", t[0], t[1]),
        (2, "b", "n", t[0], t[2]), (2, "b", "n", t[3], None),
        (3, None, "n", t[0], t[2]), (3, "c", "n", t[2], None),
        (4, "d", "n", t[1], None),
    ]
    assert kept.select("version_id").distinct().count() == kept.count()
    assert rows(history.as_of(kept, dt.datetime(2026, 1, 3, 12)), "id", "tier") == [(1, "A"), (3, "c"), (4, "d")]
    facts = table("id long, at timestamp", (1, t[0]), (1, t[1]), (2, dt.datetime(2026, 1, 3, 7)), (9, t[0]))
    assert rows(history.as_of_join(facts, kept, "id", "at", ["tier"]), "id", "version_tier") == [(1, "A"), (1, "a"), (2, None), (9, None)]
    open_ended = history.snapshot_history(history.opened(runs[1], "id", t[1]), runs[2], "id", ["tier"], t[2], close_deleted=False)
    assert open_ended.filter("id = 2 AND valid_to IS NULL").count() == 1


def test_history_table_leaves_closed_versions_alone(spark, table):
    schema = "id long, tier string"
    moments = [dt.datetime(2026, 1, d) for d in (1, 2, 3, 4)]
    runs = [
        table(schema, (1, "a"), (2, "b")), table(schema, (1, "A"), (2, "b"), (3, "c")), table(schema, (1, "A"), (3, "C")), table(schema, (2, "b")),
    ]
    store = history.HistoryTable(spark, fresh_path(spark, "history"), "id", ["tier"], buckets=1)
    kept, closed = None, []
    for rows_now, at in zip(runs, moments, strict=True):
        for _ in range(2):
            store.snapshot(rows_now, at)
        kept = history.opened(rows_now, "id", at) if kept is None else history.snapshot_history(kept, rows_now, "id", ["tier"], at)
        record = store._commits.latest()
        assert record["closed"][: len(closed)] == closed and len(record["open"]) <= 1
        closed = record["closed"]
    assert rows(store.read(), *kept.columns) == rows(kept)
    store.snapshot(runs[0].filter("false"), dt.datetime(2026, 1, 9))
    assert store.read().filter("valid_to IS NULL").count() == 0


def test_sources(spark, tmp_path):
    stores = "store_id,store_name,store_type,channel,city,state,region,opened_date,sq_footage,district,is_active,manager_name\n"
    (tmp_path / "catalog_stores.csv").write_text(stores + "1,Main,physical,in-store,c,s,North,2020-01-31,,d,true,m\n")
    df = read_table(spark, str(tmp_path), "catalog_stores", "csv")
    assert (df.first().opened_date, df.first().sq_footage, df.first().is_active) == (dt.date(2020, 1, 31), None, True)
    landed = land({"catalog_stores": df}, str(tmp_path))
    assert rows(landed["catalog_stores"]) == rows(df)
    assert land({"a": df})["a"] is df
    df.write.parquet(str(tmp_path / "x" / "catalog_stores.parquet"))
    assert rows(read_inputs(spark, str(tmp_path / "x"), ["catalog_stores"])["catalog_stores"]) == rows(df)
    with pytest.raises(ValueError):
        read_table(spark, str(tmp_path), "catalog_stores", "xml")


def test_published_table(spark):
    table = PublishedTable(spark, fresh_path(spark, "published"))
    assert not table.exists()
    first = table.publish(spark.range(100), "v1")
    second = table.publish(spark.range(7, -1, -1), "v2", cluster_by=["id"])
    assert (first.count(), second.count(), table.version()) == (100, 8, "v2")
    assert [r.id for r in spark.read.parquet(second.inputFiles()[0]).collect()] == sorted(
        r.id for r in spark.read.parquet(second.inputFiles()[0]).collect()
    )
    with pytest.raises(ValueError):
        table.publish(spark.range(1), "v2")


def test_a_refresh_that_fails_changes_nothing(spark, monkeypatch):
    table = PublishedTable(spark, fresh_path(spark, "published"))
    table.publish(spark.range(3), "v1")
    with monkeypatch.context() as patch, pytest.raises(RuntimeError, match="lost"):
        patch.setattr(type(table._commits), "add", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        table.publish(spark.range(9), "v2")
    assert table.version() == "v1" and table.read().count() == 3
    assert table.publish(spark.range(9), "v2").count() == 9


def test_shared_folder_is_named_by_the_session(spark):
    assert spark.conf.get("spark.checkpoint.dir") == shared_folder(spark)


def test_surrogate_key_is_one_expression(spark):
    assert spark.range(1).select(F.expr(fx.surrogate_key(["id"]))).first()[0] == "cfcd208495d565ef66e7dff9f98764da"


def test_a_run_writes_touched_buckets_only(spark, table):
    store = history.HistoryTable(spark, fresh_path(spark, "history"), "id", ["tier"], buckets=8)
    make = lambda **tiers: table("id long, tier string, note string", *[(i, tiers.get(f"i{i}", "a"), "n") for i in range(100) if tiers.get(f"i{i}") != "gone"])
    store.snapshot(make(), dt.date(2026, 1, 1))
    first = store._commits.latest()
    assert len(first["open"]) == 8 and first["closed"] == []
    store.snapshot(make(), dt.date(2026, 1, 2))
    assert store._commits.latest() == first
    store.snapshot(make(i7="b"), dt.date(2026, 1, 3))
    second = store._commits.latest()
    assert sum(first["open"][b] != f for b, f in second["open"].items()) == 1 and len(second["closed"]) == 1
    store.snapshot(make(i7="b", i8="gone"), dt.date(2026, 1, 4))
    third = store._commits.latest()
    assert sum(second["open"][b] != f for b, f in third["open"].items()) == 1 and third["closed"][:1] == second["closed"]
    got = rows(store.read().filter("id IN (7, 8, 9)"), "id", "tier", "valid_from", "valid_to")
    d = lambda n: dt.datetime(2026, 1, n)
    assert got == [(7, "a", d(1), d(3)), (7, "b", d(3), None), (8, "a", d(1), d(4)), (9, "a", d(1), None)]


def test_as_of_join_of_a_key_with_ten_thousand_versions(spark):
    versions = spark.range(10_000).selectExpr(
        "if(id < 9990, 1L, id) AS k", "timestamp_seconds(id * 60) AS valid_from", "CASE WHEN id % 7 <> 3 THEN timestamp_seconds(id * 60 + 60) END AS valid_to", "id AS tier"
    )
    # Of the hot key every seventh version but the last ones ends early, so some moments have none.
    versions = versions.withColumn("valid_to", F.expr("CASE WHEN k = 1 AND valid_to IS NULL THEN timestamp_seconds(tier * 60 + 30) ELSE valid_to END"))
    facts = spark.range(30_000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN NULL WHEN id % 50 = 1 THEN 9995L ELSE 1L END AS k", "timestamp_seconds(id * 20) AS at")
    got = history.as_of_join(facts, versions, "k", "at", ["tier"])
    on = (facts.k == versions.k) & (versions.valid_from <= facts["at"]) & (versions.valid_to.isNull() | (facts["at"] < versions.valid_to))
    plain = facts.join(versions, on, "left").select(facts["*"], versions.tier.alias("version_tier"))
    assert got.columns == ["id", "k", "at", "version_tier"] and got.count() == 30_000
    assert got.exceptAll(plain).isEmpty() and plain.exceptAll(got).isEmpty()
    # Versions meet facts by equal keys and moments only, so no key forms pairs.
    text = got._jdf.queryExecution().optimizedPlan().toString()
    assert "valid_from" not in "".join(line for line in text.splitlines() if "Join" in line)


def test_nearest_in_rings_equals_all_pairs(spark):
    r = random.Random(8)
    place = lambda: (r.uniform(-90, 90), r.uniform(-180, 180))
    crowded = [(100 + i, 48 + r.random() / 50, 2 + r.random() / 50) for i in range(60)]
    points = [(i, *place()) for i in range(80)] + [(300 + i, 48 + r.random() / 50, 2 + r.random() / 50) for i in range(60)] + [(900, None, 1.0)]
    sites = [(i, *place()) for i in range(12)] + crowded + [(5000, *crowded[0][1:]), (5001, None, None)]
    p, s = spark.createDataFrame(points, "id long, lat double, lon double"), spark.createDataFrame(sites, "sid long, lat double, lon double")
    got = {x.point_id: x for x in nearest_in_rings(p, s, "id", "sid").collect()}
    assert len(got) == len(points) and got[900].site_id is None
    pairs = p.filter("lat IS NOT NULL").join(s.filter("lat IS NOT NULL").withColumnsRenamed({"lat": "u", "lon": "v"}))
    best = pairs.selectExpr("id", f"struct({fx.great_circle_distance('lat', 'lon', 'u', 'v')} AS d, sid) AS b").groupBy("id").agg(F.min("b").alias("b"))
    for x in best.collect():
        assert (got[x.id].site_id, round(got[x.id].distance, 6)) == (x.b.sid, round(x.b.d, 6))
    assert {x.site_id for x in nearest_in_rings(p, s.limit(0), "id", "sid").collect()} == {None}
    assert nearest_in_rings(p.limit(0), s, "id", "sid").count() == 0


def test_frequent_values_of_combined_days(spark):
    # Customer 1 has one clear value among thousands of rare ones, customer 2 few values, customer 3 none.
    rare = spark.range(20_000).selectExpr("1L AS k", "id % 30 AS d", "IF(id % 4 = 0, 'top', 'v' || id) AS v")
    few = spark.createDataFrame([(2, i % 3, v) for i, v in enumerate("aabbc")] + [(3, 1, None)], "k long, d long, v string")
    days = sketches.frequent_values(rare.unionByName(few), ["k", "d"], "v")
    got = {r.k: r for r in sketches.top_values(sketches.combined_values(days, ["k"]), ["k"], "v").collect()}
    assert set(got) == {1, 2} and got[1].v == "top" and (got[2].v, got[2].estimated, got[2].seen, got[2].error) == ("a", 2, 5, 0)
    assert got[1].seen == 20_000 and 0 < got[1].error < 1_000 and abs(got[1].estimated - 5_000) <= got[1].error
    with pytest.raises(ValueError):
        sketches.top_values(days, ["k"], "v", k=60)


def test_distinct_counts_of_combined_days(spark):
    rows_ = spark.range(60_000).selectExpr("id % 2 AS k", "id % 30 AS d", "id % 9000 AS v")
    days = sketches.distinct_counts(rows_, ["k", "d"], "v")
    for r in sketches.combined_counts(days, ["k"], "n").collect():
        assert abs(r.n - 4500) <= 4 * sketches.STANDARD_ERROR * 4500


def groups_read(path: str, column: str, low: int, high: int) -> int:
    """Row groups whose statistics do not rule out a value between the two."""
    import pathlib

    import pyarrow.parquet as pq

    kept = 0
    for file in pathlib.Path(path).rglob("*.parquet"):
        meta = pq.ParquetFile(file).metadata
        at = meta.schema.names.index(column)
        for g in range(meta.num_row_groups):
            stats = meta.row_group(g).column(at).statistics
            kept += stats.min <= high and stats.max >= low
    return kept


def test_interleaved_layout_serves_filters_on_either_column(spark):
    df = spark.range(40_000).selectExpr("id", "id * 7919 % 40009 AS a", "IF(id % 3 = 0, 5L, id * 104729 % 39989) AS b")  # a third on one value
    read = {}
    for name, layout in (("sorted", clustered), ("curve", interleaved)):
        path = fresh_path(spark, name)
        layout(df, ["a", "b"], 64).write.parquet(path)
        assert spark.read.parquet(path).exceptAll(df).isEmpty() and spark.read.parquet(path).count() == 40_000
        read[name] = [groups_read(path, "a", 1000, 1400), groups_read(path, "b", 20_000, 20_400)]
    # Sorted by a first, all of some 64 row groups hold values of b; along the curve few do, for either column.
    assert read["sorted"][1] > 55 and max(read["curve"]) <= 24 and read["sorted"][0] <= 3
    assert interleaved(df.limit(0), ["a", "b"], 4).count() == 0
    odd = spark.createDataFrame([(None, dt.date(2026, 1, 1)), (1, None), (2, dt.date(2026, 1, 2)), (None, None)], "a long, b date")
    assert rows(interleaved(odd, ["a", "b"], 2)) == rows(odd)
    with pytest.raises(ValueError):
        interleaved(df.selectExpr("a", "string(b) AS b"), ["a", "b"])


def test_bucketed_tables_meet_without_a_shuffle(spark):
    made = []
    for name in ("left_rows", "right_rows"):
        path = fresh_path(spark, name)
        table_name = path.rpartition("/")[2].replace("-", "_")
        made.append(bucketed(spark.range(5000).selectExpr("id % 700 AS k", f"id AS {name}"), table_name, path, "k", 8))
    with_shuffle = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sums = made[0].groupBy("k").agg(F.sum("left_rows").alias("s"))
        joined = made[1].join(sums, "k")
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == 5000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", with_shuffle)
