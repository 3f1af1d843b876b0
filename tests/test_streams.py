"""Stream forms: whatever the order of arrival and the restarts, they end in the batch result."""

import datetime as dt
import json
import pathlib
import random

import pytest
from pyspark.sql import functions as F

from marketloom.operators.asof import last_touch
from marketloom.operators.upsert import KeyedTable
from marketloom.session import fresh_path
from marketloom.streaming import attribution, flows
from tests.conftest import rows

DAY = dt.date(2026, 1, 1)


def on(n):
    return DAY + dt.timedelta(days=n)


@pytest.mark.parametrize("touches_first", [True, False])
def test_last_touch_in_any_order_of_arrival(spark, touches_first):
    r = random.Random(3)
    key = lambda: r.choice([1, 1, 1, 2, 3, None])  # noqa: E731  one key has half of all rows
    orders = spark.createDataFrame([(i, key(), on(r.randint(0, 59))) for i in range(120)], "order_id long, k long, day date")
    touches = spark.createDataFrame([(key(), on(r.randint(0, 59)), r.choice([None, "s1", "s2", "s3"]), r.choice("ab")) for _ in range(300)], "k long, seen date, session string, source string")
    parts = {"orders": orders, "touches": touches}
    paths = {name: fresh_path(spark, name) for name in parts}
    table = KeyedTable(spark, fresh_path(spark, "credits"), ["k", "day"], "day", keys_stay=True)
    checkpoint, told = fresh_path(spark, "offsets"), []

    def run():
        # A new query each time: it goes on from its checkpoint, with the state of both sides.
        streams = {name: flows.read_stream(spark, f"{paths[name]}/*", ", ".join(f"{n} {t}" for n, t in parts[name].dtypes)) for name in parts}
        pairs = attribution.touch_pairs(streams["orders"], streams["touches"], "k", "day", "seen", ["session", "source"], 30, late="100 days")
        attribution.maintain_last_touch(pairs, table, "seen", ["session", "source"], checkpoint, lambda b: told.append(b.count())).awaitTermination()

    for name in sorted(parts, reverse=touches_first):
        other = next(n for n in parts if n != name)
        parts[name].write.parquet(f"{paths[name]}/arrival=0")
        if not spark._jvm.java.io.File(paths[other]).exists():
            parts[other].filter("false").write.parquet(f"{paths[other]}/arrival=empty")
        run()
    before = rows(table.read())
    run()  # nothing new
    assert rows(table.read()) == before and sum(told) > 0
    expected = last_touch(orders, touches, "k", "day", "seen", ["session", "source"], 30)
    assert rows(attribution.credited(orders, table.read(), "k", "day"), *expected.columns) == rows(expected)


def test_a_hot_key_brings_one_row_for_each_day_and_task():
    import pandas as pd

    frame = pd.DataFrame({"k": [1] * 6 + [2], "d": [1, 1, 1, 2, 2, 2, 1], "s": ["b", None, "c", "a", "z", "b", None]})
    (out,) = attribution._winners(["k", "d"], ["s"])([frame])
    assert sorted(map(tuple, out[["k", "d"]].to_numpy().tolist())) == [(1, 1), (1, 2), (2, 1)]
    assert set(out["s"].dropna()) == {"c", "z"}


def test_lines_follow_their_orders(spark):
    orders, lines = fresh_path(spark, "orders"), fresh_path(spark, "lines")
    table = KeyedTable(spark, fresh_path(spark, "items"), ["line"], "day", keys_stay=True)
    checkpoint, built = fresh_path(spark, "offsets"), []

    def build(keys):
        built.append(sorted(r[0] for r in keys.collect()))
        mine = spark.read.parquet(f"{lines}/*").join(keys, "order_id", "left_semi")
        return mine.join(spark.read.parquet(f"{orders}/*"), "order_id").select("line", "order_id", "day")

    def arrive(number, some_orders, some_lines):
        spark.createDataFrame(some_orders, "order_id long, day date").write.parquet(f"{orders}/arrival={number}")
        spark.createDataFrame(some_lines, "line long, order_id long").write.parquet(f"{lines}/arrival={number}")
        feeds = [flows.read_stream(spark, f"{p}/*", s).select("order_id") for p, s in ((orders, "order_id long, day date"), (lines, "line long, order_id long"))]
        flows.follow_parents(feeds[0].unionByName(feeds[1]), "order_id", build, table, checkpoint).awaitTermination()

    arrive(0, [(1, on(0))], [(10, 1), (20, 2)])  # line 20 comes before its order
    assert rows(table.read()) == [(10, 1, on(0))]
    arrive(1, [(2, on(1))], [(11, 1)])
    assert rows(table.read()) == [(10, 1, on(0)), (11, 1, on(0)), (20, 2, on(1))]
    assert built == [[1, 2], [1, 2]]


def test_closed_days_and_late_rows_are_all_rows(spark):
    path = fresh_path(spark, "arrivals")
    closed = KeyedTable(spark, fresh_path(spark, "closed"), ["k", "day"], "day", keys_stay=True)
    late = KeyedTable(spark, fresh_path(spark, "late"), ["i"], "day", keys_stay=True)
    offsets = [fresh_path(spark, "offsets") for _ in range(2)]
    r, at = random.Random(1), 0
    everything = []
    for number, (low, high) in enumerate([(10, 14), (0, 12), (20, 25), (3, 22), (30, 30)]):
        data = []
        for _ in range(40):
            at += 1
            data.append((at, r.randint(1, 2), dt.datetime(2026, 1, 1) + dt.timedelta(days=r.randint(low, high), hours=r.randint(0, 23)), r.randint(1, 9)))
        everything += data
        spark.createDataFrame(data, "i long, k long, ts timestamp, v long").write.parquet(f"{path}/arrival={number}")
        stream = flows.read_stream(spark, f"{path}/*", "i long, k long, ts timestamp, v long")
        flows.closed_totals(flows.daily_totals(stream, "ts", ["k"], ["count(*) AS n", "sum(v) AS total"], "3 days"), closed, offsets[0]).awaitTermination()
        flows.keep_late(stream.withColumn("day", F.to_date("ts")), "ts", late, offsets[1], 3).awaitTermination()
    newest = max(t for _, _, t, _ in everything)
    done = [x for x in everything if dt.datetime.combine(x[2].date(), dt.time()) + dt.timedelta(days=1) <= newest - dt.timedelta(days=3)]
    got = closed.read().agg(F.sum("n"), F.sum("total")).first()
    behind = late.read().agg(F.count("i"), F.sum("v")).first()
    assert behind[0] > 0 and (got[0] + behind[0], got[1] + behind[1]) == (len(done), sum(x[3] for x in done))
    assert closed.read().count() == closed.read().select("k", "day").distinct().count()


def test_a_batch_delivered_again_finds_the_same_days_closed(spark):
    class Once:
        """A stream of which the same batch is delivered twice."""

        def __init__(self, batches):
            self.batches, self.writeStream = batches, self

        def foreachBatch(self, apply):
            for number, batch in self.batches:
                apply(batch, number)
            return self

        option = trigger = start = lambda self, *a, **b: self

    make = lambda *days: spark.createDataFrame([(d, dt.datetime(2026, 1, d), dt.date(2026, 1, d)) for d in days], "i long, ts timestamp, day date")
    late = KeyedTable(spark, fresh_path(spark, "late"), ["i"], "day", keys_stay=True)
    flows.keep_late(Once([(0, make(10)), (1, make(4, 20)), (1, make(4, 20)), (2, make(15))]), "ts", late, "", 3)
    assert rows(late.read(), "i") == [(4,), (15,)]
    assert json.loads(late.mark())["before"].startswith("2026-01-20")


class Batches:
    """A stream of given batches."""

    def __init__(self, *batches):
        self.batches, self.writeStream = batches, self

    def foreachBatch(self, apply):
        for number, batch in enumerate(self.batches):
            apply(batch, number)
        return self

    option = trigger = start = lambda self, *a, **b: self


def test_a_batch_without_rows_changes_nothing(spark, table, monkeypatch):
    store, told = KeyedTable(spark, fresh_path(spark, "t"), ["k"], "p", "int", keys_stay=True), []
    upserts, keep = [], KeyedTable.upsert
    monkeypatch.setattr(KeyedTable, "upsert", lambda self, *a, **b: upserts.append(1) or keep(self, *a, **b))
    some = table("k long, p int, v int", (1, 1, 1), (2, 1, 1))
    flows.upsert_stream(Batches(some, some.filter("false"), some.withColumn("v", F.lit(0))), store, ["v"], "", then=lambda b: told.append(b.count()))
    assert (len(upserts), told) == (2, [2, 2])
    assert rows(store.read()) == [(1, 1, 1), (2, 1, 1)]


def test_only_what_can_win_is_written(spark, table, monkeypatch):
    counts, keep = [], flows.written
    monkeypatch.setattr(flows, "written", lambda df, label: counts.append(df.count()) or keep(df, label))
    store = KeyedTable(spark, fresh_path(spark, "t"), ["k"], "p", "int", keys_stay=True)
    flows.upsert_stream(Batches(table("k long, p int, v int", *[(1, 1, v) for v in range(9)])), store, ["v"], "")
    assert counts == [1] and rows(store.read()) == [(1, 1, 8)]


def test_state_has_as_many_partitions_as_cores(spark, table):
    paths = {name: fresh_path(spark, name) for name in ("orders", "touches")}
    table("k long, day date", (1, on(1))).write.parquet(f"{paths['orders']}/arrival=0")
    table("k long, seen date, session string", (1, on(0), "a"), (1, on(1), "b")).write.parquet(f"{paths['touches']}/arrival=0")
    orders = flows.read_stream(spark, f"{paths['orders']}/*", "k long, day date")
    touches = flows.read_stream(spark, f"{paths['touches']}/*", "k long, seen date, session string")
    store, checkpoint = KeyedTable(spark, fresh_path(spark, "credits"), ["k", "day"], "day", keys_stay=True), fresh_path(spark, "offsets")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        pairs = attribution.touch_pairs(orders, touches, "k", "day", "seen", ["session"])
        attribution.maintain_last_touch(pairs, store, "seen", ["session"], checkpoint).awaitTermination()
        assert spark.conf.get("spark.sql.shuffle.partitions") == "40"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    held = [p for p in pathlib.Path(checkpoint, "state", "0").iterdir() if p.name.isdigit()]
    assert len(held) == spark.sparkContext.defaultParallelism
    assert rows(store.read(), "k", "day", "session") == [(1, on(1), "b")]
