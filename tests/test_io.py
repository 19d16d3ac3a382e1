"""Readers, writers and streams, read back from files."""

from __future__ import annotations

import datetime as dt

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tidemark.operators import writers
from tidemark.operators.writers import VersionStore
from tidemark.plans import metrics
from tidemark.plans.registry import Tables
from tidemark.sources import readers
from tidemark.streaming import held, streams


def at(n):
    return F.lit(f"2024-01-0{n} 00:00:00").cast("timestamp")


def test_append_only_what_changed(spark, tmp_path):
    store = VersionStore(spark, str(tmp_path / "s"), ("k",))
    first = spark.createDataFrame([(1, 5, "a"), (2, None, "b")], "k int, v int, x string")
    assert store.append_changed(first, at(1)) == writers.WriteResult(2, 0, 0)
    again = store.append_changed(first, at(2))
    assert again == writers.WriteResult(0, 0, 2) and not again.changed
    grown = spark.createDataFrame([(1, 6, "a", 1), (3, 1, "c", None)], "k int, v int, x string, more int")
    assert store.append_changed(grown, at(3)) == writers.WriteResult(1, 1, 0)
    assert store.read().count() == 4 and rows(store.latest().select("k", "v", "more")) == [(1, 1, 6), (2, None, None), (3, None, 1)]
    assert store.compact(str(tmp_path / "c")).read().count() == 4


def test_snapshots_spare_the_history(spark, tmp_path):
    store = VersionStore(spark, str(tmp_path / "s"), ("k",))
    assert not store.snapshot()
    store.append_changed(spark.createDataFrame([(1, 5), (2, None)], "k int, v int"), at(1))
    store.append_changed(spark.createDataFrame([(1, 6)], "k int, v int"), at(2))
    assert store.snapshot() and not store.snapshot()
    files = store.latest().inputFiles()
    assert files and all("/_latest-" in f for f in files) and rows(store.latest().select("k", "v")) == [(1, 6), (2, None)]
    assert store.append_changed(spark.createDataFrame([(2, 7, 1), (3, 1, 2)], "k int, v int, more int"), at(3)) == writers.WriteResult(1, 1, 0)
    before = rows(store.latest().select("k", "more", "v"))
    assert before == [(1, None, 6), (2, 1, 7), (3, 2, 1)] and store.read().count() == 5
    assert store.snapshot() and rows(store.latest().select("k", "more", "v")) == before and store.read().count() == 5
    store.append_changed(spark.createDataFrame([(3, 4, 2)], "k int, v int, more int"), at(4))
    store.snapshot()
    assert len(list((tmp_path / "s").glob("_latest-*"))) == 2 and not list((tmp_path / "s").glob("_staged-*"))


def test_a_snapshot_of_a_batch_taken_back_is_passed_over(spark, tmp_path):
    store = VersionStore(spark, str(tmp_path / "s"), ("k",))
    store.append_changed(spark.createDataFrame([(1, 5)], "k int, v int"), at(1), batch="batch-a")
    store.append_changed(spark.createDataFrame([(1, 6)], "k int, v int"), at(2), batch="batch-b")
    store.snapshot()
    store._forget("batch-b")
    assert rows(store.latest().select("k", "v")) == [(1, 5)]


def test_ties_give_the_same_row_with_and_without_a_snapshot(spark, tmp_path):
    store = VersionStore(spark, str(tmp_path / "s"), ("k",))
    for n in range(4):
        store._write(spark.createDataFrame([(1, n)], "k int, v int"), at(1))
    found = rows(store.latest().select("k", "v"))
    store.snapshot()
    assert rows(store.latest().select("k", "v")) == found
    store._write(spark.createDataFrame([(None, 9, 2)], "more int, v int, k int"), at(1))
    with_snapshot = rows(store.latest().select("k", "v"))
    whole = store.compact(str(tmp_path / "c"))
    assert rows(whole.latest().where("k = 1").select("k", "v")) == [r for r in with_snapshot if r[0] == 1] == found


def test_compare_normalised_text(spark, tmp_path):
    store = VersionStore(spark, str(tmp_path / "s"), ("k",))
    store.append_changed(spark.createDataFrame([(1, "a  b")], "k int, x string"), at(1))
    result = store.append_changed(spark.createDataFrame([(1, "a b")], "k int, x string"), at(2), normalize=lambda c: F.regexp_replace(c, r"\s+", " "))
    assert result == writers.WriteResult(0, 0, 1)


def test_unknown_values_change_nothing(spark, tmp_path):
    store = VersionStore(spark, str(tmp_path / "s"), ("k",))
    store.append_known(spark.createDataFrame([(1, 5, 6)], "k int, a int, b int"), at(1), ["a", "b"])
    assert store.append_known(spark.createDataFrame([(1, None, 6)], "k int, a int, b int"), at(2), ["a", "b"]) == writers.WriteResult(0, 0, 1)
    assert store.append_known(spark.createDataFrame([(1, None, 7)], "k int, a int, b int"), at(3), ["a", "b"]) == writers.WriteResult(0, 1, 0)
    assert rows(store.latest().select("a", "b")) == [(5, 7)]


def test_upstream_change_time(spark, tmp_path):
    store = VersionStore(spark, str(tmp_path / "s"), ("k",))
    df = spark.createDataFrame([(1, "t1"), (2, None)], "k int, updated_at string")
    assert store.append_updated(df, at(1)) == writers.WriteResult(2, 0, 0)
    assert store.append_updated(df, at(2)) == writers.WriteResult(0, 1, 1)


def test_children_follow_parents(spark, tmp_path):
    posts, kids = VersionStore(spark, str(tmp_path / "p"), ("k",)), VersionStore(spark, str(tmp_path / "c"), ("k", "place"))
    p = spark.createDataFrame([(1, "x"), (2, "y")], "k int, text string")
    c = spark.createDataFrame([(1, "n", 3), (2, "s", 4)], "k int, place string, n int")
    posts.append_with_children(p, c, kids, at(1), ["text"])
    posts.append_with_children(spark.createDataFrame([(1, "x"), (2, "z")], "k int, text string"), c, kids, at(2), ["text"])
    assert posts.read().count() == 3 and rows(kids.read().select("k")) == [(1,), (2,), (2,)]


def test_children_of_a_run_that_failed_are_written_once(spark, tmp_path, monkeypatch):
    posts, kids = VersionStore(spark, str(tmp_path / "p"), ("k",)), VersionStore(spark, str(tmp_path / "c"), ("k", "place"))
    p, c = spark.createDataFrame([(1, "x")], "k int, text string"), spark.createDataFrame([(1, "n")], "k int, place string")
    show = VersionStore._show

    def broken(self, *names, **_):
        if self.path == posts.path:
            raise OSError("lost")
        show(self, *names)

    for breaks in ("_show", "append_changed"):
        with monkeypatch.context() as m:
            m.setattr(VersionStore, breaks, broken)
            with pytest.raises(OSError):
                posts.append_with_children(p, c, kids, at(1), ["text"])
        assert posts.read() is None
    posts.append_with_children(p, c, kids, at(2), ["text"])
    assert posts.read().count() == kids.read().count() == 1


def test_a_store_that_cannot_be_read_is_not_empty(spark, tmp_path):
    store = VersionStore(spark, str(tmp_path / "s"), ("k",))
    assert store.read() is None
    (tmp_path / "s" / "batch-x").mkdir(parents=True)
    (tmp_path / "s" / "batch-x" / "part-0.parquet").write_text("no parquet")
    with pytest.raises(Exception):  # noqa: B017
        store.append_changed(spark.range(1).withColumnRenamed("id", "k"), at(1))


def test_corrections_say_something_new(spark):
    stored = spark.createDataFrame([(1, 20, 5), (1, 32, 6), (1, 34, 7), (2, 33, None), (3, 20, 9)], "d int, hour int, v int")
    fetched = spark.createDataFrame([(1, 11, 7), (2, 11, None), (3, 11, 9), (4, 11, 1)], "d int, hour int, v int")
    assert rows(writers.corrections(stored, fetched, "d", "hour", ["v"])) == [(3, 35, 9), (4, 35, 1)]
    assert rows(writers.corrections(stored, fetched.where("d = 1").withColumn("v", F.lit(6)), "d", "hour", ["v"])) == [(1, 35, 6)]


def test_a_key_that_changes_its_partition_leaves_the_old_one(spark, tmp_path):
    path = str(tmp_path / "t")
    writers.upsert(spark, path, spark.createDataFrame([(1, "a", 1), (2, "b", 1), (3, "b", 1)], "k int, d string, v int"), ["k"], "d")
    writers.upsert(spark, path, spark.createDataFrame([(1, "b", 2), (3, "c", 2)], "k int, d string, v int"), ["k"], "d")
    assert rows(spark.read.parquet(path).select("d", "k", "v")) == [("b", 1, 2), ("b", 2, 1), ("c", 3, 2)]
    assert [f.name for f in tmp_path.iterdir()] == ["t"]


def test_upsert_touches_its_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    writers.upsert(spark, path, spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, d string, v int"), ["k"], "d")
    writers.upsert(spark, path, spark.createDataFrame([(1, "a", 9), (3, "a", 9)], "k int, d string, v int"), ["k"], "d")
    assert rows(spark.read.parquet(path).select("d", "k", "v")) == [("a", 1, 9), ("a", 3, 9), ("b", 2, 1)]


def test_small_writers(spark, tmp_path):
    writers.replace_lookup(spark.range(3), str(tmp_path / "l"))
    writers.replace_lookup(spark.range(2), str(tmp_path / "l"))
    assert spark.read.parquet(str(tmp_path / "l")).count() == 2
    df = spark.createDataFrame([(1, "long")], "k int, x string")
    assert rows(writers.blank_columns(df, ["x"])) == [(1, None)]
    assert writers.add_columns(df, spark.range(1)).columns == ["k", "x", "id"]
    data = spark.createDataFrame([(dt.date(2024, 1, 1),)], "report_date date")
    days = writers.mark_silent(None, "2024-01-02", "quiet", data, spark)
    assert rows(writers.mark_silent(days, "2024-01-02", "still", data, spark)) == [("still", dt.date(2024, 1, 2))]
    with pytest.raises(ValueError):
        writers.mark_silent(days, "2024-01-01", "no", data, spark)
    again = writers.reparsed(df, "x", lambda c: F.length(c) > 1, {"n": F.length})
    assert again.first()["n"] == 4 and writers.reparsed(df, "x", lambda c: F.length(c) > 9, {}).count() == 0
    assert df.select(writers.correction_hour(F.lit(8))).first()[0] == 32


def test_csv(spark, tmp_path):
    f = tmp_path / "a.csv"
    f.write_text("﻿model,n, place \n X , 600.0,a\nY,,\n", encoding="utf-8")
    assert rows(readers.csv_rows(spark, str(f), ["model", "n"], ["n"])) == [("X", 600, "a"), ("Y", None, None)]
    with pytest.raises(ValueError):
        readers.csv_rows(spark, str(f), ["gone"])
    w = tmp_path / "w.csv"
    w.write_text("week,total,a\n24.02.2022,5,\n03.03.2022,,1\n")
    assert rows(readers.weekly_counts(spark, str(w), "week", "total", ["a"])) == [(0, 5, dt.date(2022, 2, 24))]
    e = tmp_path / "e.csv"
    e.write_text("week,real,rnd\n21.02.2022,5,\n28.02.2022,,\n")
    assert rows(readers.weekly_estimates(spark, str(e), "week", ["real", "rnd"])) == [(5.0, None, dt.date(2022, 2, 21))]


def test_json(spark, tmp_path):
    f = tmp_path / "a.json"
    f.write_text('[{"date": "2024-01-01", "n": 1}, {"date": "2024-01-02"}]')
    assert rows(readers.json_array(spark, str(f), "date string, n bigint")) == [("2024-01-01", 1), ("2024-01-02", None)]
    body = '{"data": {"dataCollectedAt": "2024-06-01T21:30:00Z", "personnel": {"killed": 3}, "targetsByType": [{"targetClassId": 7, "hit": 2, "destroyed": 1}]}}'
    r = spark.createDataFrame([(body,)], "b string").select(readers.nested_record(F.col("b")).alias("r")).first()["r"]
    assert r.collected_at == dt.datetime(2024, 6, 2, 0, 30) and r.personnel_killed == 3 and r.hit == {7: 2} and r.flights_strike is None


def test_sheets_pages_and_scripts(spark, tmp_path):
    df = spark.createDataFrame([(1, "x", None, "u", None)], "id int, a1 string, a2 string, b1 string, b2 string")
    assert rows(readers.repeated_groups(df, ["id"], {"a": ["a1", "a2"], "b": ["b1", "b2"]})) == [("x", "u", 1)]
    assert readers.positional(df, ["k", "first"]).columns == ["k", "first"]
    assert rows(readers.with_defaults(df.select("id"), ["n", "m"], ["m"])) == [(1, None, 0)]
    page = '<div data-post="c/12"><div class="text">a<br>b</div><time datetime="2024-01-01T10:00:00+00:00"></time></div>'
    (tmp_path / "p.html").write_text(page + page.replace("/12", "/13"))
    pages = readers.saved_pages(spark, str(tmp_path / "p.html"))
    assert [r.post_id for r in readers.timeline_posts(pages, newest=12).collect()] == [13]
    assert readers.timeline_posts(pages).count() == 2
    js = spark.createDataFrame([("a=JSON.parse('{\"x\": \"it\\'s\"}');b=JSON.parse('[1]')",)], "js string")
    assert js.select(readers.script_blobs(F.col("js"))).first()[0] == ['{"x": "it\'s"}', "[1]"]
    posts = spark.createDataFrame([(dt.date(2024, 1, 1), True, None, None), (dt.date(2024, 1, 2), None, None, None)], "d date, pinned boolean, repost boolean, reply boolean")
    assert readers.mirrored(posts, "d", "2024-01-01", "2024-01-02").count() == 1


def test_charts():
    cat = metrics.catalogue()
    (a, b) = metrics.parse_charts("A%3AB:d7ylog:events.click,lines.lines;M:mall:lines.lines", cat)
    assert (a.name, a.window, a.axis, a.metrics) == ("A:B", 7, "log", ("events.click",))
    assert (b.granularity, b.window, b.metrics) == ("monthly", None, ("lines.lines",))
    assert metrics.parse_charts(metrics.format_charts([a, b]), cat) == [a, b]
    assert metrics.parse_charts("X:dall:events.click", cat)[0].window == 30
    assert [m.id for m in cat.search("filled ORDERS")] == ["orders.filled"]
    assert len(cat.metrics) == 31 and cat.find("events.click").views == {"daily", "monthly", "hourly"}
    assert "hourly" not in cat.find("orders.orders").views and cat.find("lines.returned_quantity").views == {"monthly"}


def test_series_of_nothing(spark, data):
    assert metrics.series(Tables(spark, data), metrics.catalogue(), metrics.Chart("x"), dt.date(2024, 1, 1)).count() == 0


def test_stream_of_versions(spark, tmp_path):
    schema = "k int, v int, seen timestamp"
    row = lambda k, v, d: (k, v, dt.datetime(2024, 1, d))
    spark.createDataFrame([row(1, 5, 1), row(1, 6, 2), row(2, 1, 1)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    store = VersionStore(spark, str(tmp_path / "out"), ("k",), "scraped_at")
    go = lambda: streams.append_versions(streams.source(spark, str(tmp_path / "in"), schema), store, str(tmp_path / "ck"), order="seen", snapshot_every=2).awaitTermination()
    go()
    spark.createDataFrame([row(1, 6, 3), row(2, 9, 3)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    go()
    assert rows(store.latest().select("k", "v")) == [(1, 6), (2, 9)]
    assert [p.name for p in (tmp_path / "out").glob("_latest-*")] == ["_latest-000000000002"]


def collected(spark, df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return rows(spark.table(name))


def test_stream_windows_and_duplicates(spark, tmp_path):
    schema = "k int, v double, seen timestamp"
    at_hour = lambda d, h: dt.datetime(2024, 1, d, h)
    spark.createDataFrame([(1, 1.0, at_hour(1, 16)), (1, 1.0, at_hour(1, 16)), (2, 2.0, at_hour(1, 18)), (3, 3.0, at_hour(2, 16))], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    src = lambda: streams.source(spark, str(tmp_path / "in"), schema)
    days = streams.report_days(src(), "seen", [F.count("*").alias("n")]).select(F.col("window.start").alias("start"), "n")
    assert [r[0] for r in collected(spark, days, "days", "complete")] == [2, 2]
    slid = streams.windowed(src(), "seen", "2 days", [F.count("*").alias("n")], slide="1 day").select("n")
    assert sum(r[0] for r in collected(spark, slid, "slid", "complete")) == 8
    assert len(collected(spark, streams.deduplicated(src(), ["k"], "seen"), "dedup", "append")) == 3


def test_stream_holds_the_last_good(spark, tmp_path):
    schema = "k string, i int, v double"
    spark.createDataFrame([("a", 1, 110827.0), ("a", 2, 11257.0), ("a", 3, 111720.0)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    out = collected(spark, held.held_increments(streams.source(spark, str(tmp_path / "in"), schema), "k", "i", "v"), "held", "append")
    assert [(r[0], r[1]) for r in out] == [(1, 110827.0), (2, None), (3, 893.0)]


def test_stream_gives_null_after_a_null_start(spark, tmp_path):
    schema = "k string, i int, v double"
    spark.createDataFrame([("a", 1, None), ("a", 2, 500.0), ("a", 3, 510.0)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    out = collected(spark, held.held_increments(streams.source(spark, str(tmp_path / "in"), schema), "k", "i", "v"), "null_start", "append")
    assert [(r[0], r[1]) for r in out] == [(1, None), (2, None), (3, 10.0)]


def test_stream_sessions(spark, tmp_path):
    schema = "k int, seen timestamp"
    at_minute = lambda m: dt.datetime(2024, 1, 1, 12, m)
    spark.createDataFrame([(1, at_minute(0)), (1, at_minute(4)), (1, at_minute(20)), (2, at_minute(5))], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    out = streams.sessions(streams.source(spark, str(tmp_path / "in"), schema), "seen", "5 minutes", [F.count("*").alias("n")], by=("k",)).select("k", "n")
    assert collected(spark, out, "sessions", "complete") == [(1, 1), (1, 2), (2, 1)]
