"""Editions: tables that change together, readers that keep theirs."""

from __future__ import annotations

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tidemark.operators.editions import Conflict, Editions, Layout
from tidemark.operators.writers import replace_lookup


def test_a_reader_keeps_its_edition(spark, tmp_path):
    store = Editions(spark, str(tmp_path / "store"))
    assert store.at().number == 0 and store.numbers() == []
    with pytest.raises(KeyError):
        store.at().table("rows")
    store.publish(append={"rows": spark.createDataFrame([(1, "a")], "id int, k string")}, replace={"names": spark.createDataFrame([("a", "Alpha")], "k string, name string")})
    pinned = store.at()
    before = pinned.table("rows").join(pinned.table("names"), "k")
    store.publish(append={"rows": spark.createDataFrame([(2, "b", 5)], "id int, k string, more int")}, replace={"names": spark.createDataFrame([("a", "Aleph"), ("b", "Beth")], "k string, name string")})
    # rows and names changed together; the pinned reader has both old ones, however late it reads
    assert rows(before.select("id", "name")) == rows(pinned.table("rows").join(pinned.table("names"), "k").select("id", "name")) == [(1, "Alpha")]
    now = store.at()
    assert rows(now.table("rows").join(now.table("names"), "k").select("id", "more", "name")) == [(1, None, "Aleph"), (2, 5, "Beth")]
    assert rows(store.at(1).table("names")) == [("a", "Alpha")]


def test_a_failed_or_late_run_changes_nothing(spark, tmp_path):
    store = Editions(spark, str(tmp_path / "store"))
    store.publish(append={"rows": spark.range(3)})
    bad = spark.range(3).select(F.when(F.col("id") == 2, F.raise_error(F.lit("broken"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception, match="broken"):
        store.publish(append={"rows": spark.range(9)}, replace={"names": bad})
    assert store.numbers() == [1] and store.at().table("rows").count() == 3
    base = store.at()
    store.publish(append={"rows": spark.range(1)})
    with pytest.raises(Conflict):
        store.publish(append={"rows": spark.range(5)}, base=base)
    assert store.numbers() == [1, 2] and store.at().table("rows").count() == 4
    store.publish(replace={"rows": spark.range(7)})
    store.forget(keep=1)
    assert store.numbers() == [3] and store.at().table("rows").count() == 7
    assert len([p for p in (tmp_path / "store/data").iterdir()]) == 1 and not [p for p in (tmp_path / "store/editions").iterdir() if p.name.startswith("_")]


def scanned(df) -> int:
    """Rows that left the scan, before the filter."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan
    return plan.collectLeaves().apply(0).metrics().apply("numOutputRows").value()


def test_sorted_files_and_blooms_spare_row_groups(spark, tmp_path):
    store = Editions(spark, str(tmp_path / "store"))
    n = 200_000
    df = spark.range(n).select((F.col("id") * 7919 % n).alias("id"), F.concat(F.lit("name "), F.xxhash64("id").cast("string")).alias("name"), F.col("id").alias("value"))
    small = {"parquet.block.size": "65536", "parquet.page.size": "16384"}
    store.publish(append={"plain": df.repartition(4), "laid": df}, layouts={"plain": Layout(options=small), "laid": Layout(("id",), ("name",), small)})
    at = store.at()
    one = df.where("id = 12345").first()["name"]
    for seek in (F.col("id") == 12345, F.col("name") == one):
        found = [at.table(t).where(seek) for t in ("plain", "laid")]
        assert rows(found[0]) == rows(found[1]) and len(rows(found[1])) == 1
        assert scanned(found[1]) < n / 20 and scanned(found[0]) > n / 2


def test_lookup_is_replaced_or_stays(spark, tmp_path):
    path = str(tmp_path / "lookup")
    replace_lookup(spark.range(2), path)
    replace_lookup(spark.range(3), path)
    bad = spark.range(1).select(F.raise_error(F.lit("broken")).cast("long").alias("id"))
    with pytest.raises(Exception, match="broken"):
        replace_lookup(bad, path)
    assert spark.read.parquet(path).count() == 3
