"""Where queries are registered, each with the SQL that gives the same rows."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: The day on which all queries run; they never ask a clock.
AS_OF = dt.date(2024, 1, 30)


@dataclass(frozen=True)
class Tables:
    """The driver's tables, as attributes."""

    spark: SparkSession
    path: str

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    @property
    def readings(self) -> DataFrame:
        """Events with their day and hour."""
        return self.events.withColumns({"date": F.to_date("ts"), "hour": F.hour("ts").cast("long")})

    @property
    def days(self) -> DataFrame:
        """Orders with their day and month."""
        return self.orders.withColumns({"date": F.to_date("o_orderdate"), "month": F.date_format("o_orderdate", "yyyy-MM")})

    @property
    def lines(self) -> DataFrame:
        """Line items with their ship day."""
        return self.lineitem.withColumn("date", F.to_date("l_shipdate"))


def query(sql: str | None = None) -> Callable:
    """Registers ``f(tables)`` under its name."""

    def register(f: Callable[[Tables], DataFrame]) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def long(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


def dec(c: Column | str) -> Column:
    """An exact sum's argument, so that the order of summing doesn't matter."""
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(18,4)")


def total(c: Column | str) -> Column:
    return F.sum(dec(c)).cast("double")
