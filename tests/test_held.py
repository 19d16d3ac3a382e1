"""Held readings as a stream with state that ends."""

from __future__ import annotations

import datetime as dt
import random
import time

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tidemark.operators.folds import hold_last_good
from tidemark.streaming import streams
from tidemark.streaming.held import held_increments

SCHEMA = "k string, at timestamp, v double"


def at(days: float) -> dt.datetime:
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=days)


class Feed:
    """Files that come one by one, a query that is started anew each time."""

    def __init__(self, spark, path, **options):
        self.spark, self.path, self.options = spark, path, options

    def add(self, *readings):
        self.spark.createDataFrame([(k, at(d), v) for k, d, v in readings], SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.path}/in")
        return self

    def go(self):
        out = held_increments(streams.source(self.spark, f"{self.path}/in", SCHEMA, 1), "k", "at", "v", **self.options)
        out.writeStream.format("parquet").option("checkpointLocation", f"{self.path}/kept").trigger(availableNow=True).start(f"{self.path}/out").awaitTermination()
        return sorted(self.spark.read.schema("k string, at timestamp, increment double").parquet(f"{self.path}/out").collect(), key=lambda r: (r.k, r.at))

    def state(self, name):
        return self.spark.read.format("statestore").option("stateVarName", name).load(f"{self.path}/kept").count()


def test_late_readings_are_folded_in_their_place(spark, tmp_path):
    """Shuffled within five days, over three starts of the query: the rows of the batch fold."""
    rnd = random.Random(8)
    data = [(k, d, rnd.choice([100.0 * d, 110.0 * d, 9.0, None])) for k in "abc" for d in range(40)]
    data.sort(key=lambda r: r[1] + 5 * rnd.random())
    feed = Feed(spark, str(tmp_path), late="6 days", silent="100 days")
    for k in range(0, len(data), 20):
        feed.add(*data[k : k + 20])
        if k in (40, 80):
            feed.go()
    feed.add(("end", 90, 1.0)).add(("end", 91, 1.0))  # moves the watermark past all readings
    got = [r for r in feed.go() if r.k != "end"]
    want = hold_last_good(spark.createDataFrame([(k, at(d), v) for k, d, v in data], SCHEMA), ["k"], "at", "v")
    assert [tuple(r) for r in got] == [(r["k"], r["at"], r["increment"]) for r in sorted(want.collect(), key=lambda r: (r["k"], r["at"]))]


def test_silent_keys_lose_their_state(spark, tmp_path):
    feed = Feed(spark, str(tmp_path), late="1 day", silent="10 days")
    feed.add(("a", 1, 500.0), ("b", 1, 700.0)).add(("b", 8, 710.0)).add(("b", 14, 720.0)).add(("b", 15, 725.0))
    got = feed.go()
    assert [(r.k, r.at, r.increment) for r in got] == [("a", at(1), 500.0), ("b", at(1), 700.0), ("b", at(8), 10.0), ("b", at(14), 10.0)]
    feed.add(("a", 16, 30.0)).add(("c", 30, 1.0)).add(("c", 31, 1.0))
    got = {(r.k, r.at): r.increment for r in feed.go()}
    assert got["a", at(16)] == 30.0 and got["b", at(15)] == 5.0  # a's drop from 500 is none: it starts anew
    assert feed.state("fold") <= 2 and feed.state("waiting") <= 1


def test_state_ends_by_the_clock_without_event_time(spark, tmp_path):
    feed = Feed(spark, str(tmp_path)).add(("a", 1, 500.0), ("a", 2, 510.0))
    out = held_increments(streams.source(spark, f"{tmp_path}/in", SCHEMA, 1), "k", "at", "v", silent="3 seconds")
    query = out.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/kept").trigger(processingTime="1 second").start(f"{tmp_path}/out")

    def increments(n):
        for _ in range(90):
            time.sleep(1)
            got = sorted(spark.read.schema("at timestamp, increment double").parquet(f"{tmp_path}/out").collect())
            if len(got) >= n or query.exception():
                return [r.increment for r in got]

    try:
        assert increments(2) == [500.0, 10.0]
        time.sleep(6)
        feed.add(("a", 3, 30.0))
        assert increments(3) == [500.0, 10.0, 30.0]  # no drop: what came before is forgotten
    finally:
        query.stop()


def test_readings_without_an_order_are_left_out(spark, tmp_path):
    spark.createDataFrame([("a", None, 5.0), ("a", at(1), None), (None, at(1), 3.0), (None, at(2), 4.0)], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    out = held_increments(streams.source(spark, str(tmp_path / "in"), SCHEMA), "k", "at", "v")
    out.writeStream.format("memory").queryName("no_order").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert rows(spark.table("no_order").select("k", "increment")) == sorted([(None, "a"), (3.0, None), (1.0, None)], key=repr)
