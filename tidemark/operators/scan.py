"""Running aggregates over a series of any length, by a prefix scan on two levels.

The rows are dealt by ranges of their order, however many there are of a key or without one.  Each range, called a
cell, is summed up by itself; what precedes a cell follows from the cells' sums alone, of which there is one a cell
and key.  A row's value joins what precedes its cell with the rows before it inside.  No task gets more than a cell.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.tables import settled

#: Each row's cell, and its place in it from 1 on; running values may refer to both.
CELL, PLACE = "_cell", "_place"


@dataclass(frozen=True)
class Running:
    """An aggregate of ``value`` that can be taken in pieces: ``over`` a set of rows, and by ``join`` from two sets' results, neither null."""

    value: Column
    over: Callable[[Column], Column]
    join: Callable[[Column, Column], Column]
    #: What ``over`` makes of pieces' results.
    again: Callable[[Column], Column]


def total(value: Column) -> Running:
    return Running(value, F.sum, lambda a, b: a + b, F.sum)


def count(value: Column) -> Running:
    return Running(value, F.count, lambda a, b: a + b, F.sum)


def greatest(value: Column) -> Running:
    return Running(value, F.max, F.greatest, F.max)


def scan(df: DataFrame, order: Sequence[str | Column], values: dict[str, Running], by: Sequence[str] = (), *, before: bool = False) -> DataFrame:
    """``df`` with each value over the rows up to this one in ``order``, and as ``{name}_all`` over the whole series.

    ``by`` names the series' keys (null is a key); without it the table is one series.  With ``before`` the row itself doesn't count.
    Where no row has counted yet the value is null.  Rows equal in ``order`` stand in an order of their own, the same for
    all values of a call.  Also adds CELL and PLACE.
    """
    ordered = [F.col(c) if isinstance(c, str) else c for c in order]
    cells = settled(df.repartitionByRange(*[F.col(k) for k in by], *ordered).withColumn(CELL, F.spark_partition_id()))
    keys = [f"_k{i}" for i in range(len(by))]
    inside = Window.partitionBy(CELL, *by)
    rows = cells.withColumn(PLACE, F.row_number().over(inside.orderBy(*ordered)))
    # one row a cell and key; the constant is no literal, which would make one partition of a table without keys at once
    sums = rows.groupBy(CELL, *by).agg(F.max(F.lit(1)).alias("_one"), *[v.over(v.value).alias(n) for n, v in values.items()])
    series = Window.partitionBy(*(by or ["_one"]))
    earlier = series.orderBy(CELL).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        F.col(CELL).alias("_c"), *[F.col(k).alias(n) for n, k in zip(keys, by, strict=True)],
        *[v.again(F.col(n)).over(earlier).alias(f"_e_{n}") for n, v in values.items()], *[v.again(F.col(n)).over(series).alias(f"{n}_all") for n, v in values.items()],
    )
    upto = inside.orderBy(PLACE).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    rows = rows.withColumns({f"_i_{n}": v.over(v.value).over(upto) for n, v in values.items()})
    on = (F.col(CELL) == F.col("_c")) if not by else [F.col(CELL) == F.col("_c"), *[F.col(k).eqNullSafe(F.col(n)) for n, k in zip(keys, by, strict=True)]]
    out = rows.join(sums, on)
    both = {n: F.when(F.col(f"_e_{n}").isNull(), F.col(f"_i_{n}")).when(F.col(f"_i_{n}").isNull(), F.col(f"_e_{n}")).otherwise(v.join(F.col(f"_e_{n}"), F.col(f"_i_{n}"))) for n, v in values.items()}
    return out.select(*df.columns, CELL, PLACE, *[c.alias(n) for n, c in both.items()], *[f"{n}_all" for n in values])


def places(df: DataFrame, order: Sequence[str | Column], name: str = "place", by: Sequence[str] = ()) -> DataFrame:
    """Adds each row's number in its series, from 1 on, and ``{name}_all``: the number of its rows."""
    return scan(df, order, {name: count(F.lit(1))}, by).drop(CELL, PLACE)
