"""Queries for checks, key sets and joins of several sources."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import attribution as a
from tidemark.operators import calendar as c
from tidemark.operators import guards as g
from tidemark.plans.registry import Tables, dec, long, query, total


@query("SELECT event_type, count(*) AS n, count(*) >= 300 AS enough FROM events GROUP BY 1")
def guard_floor(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.count("*").alias("n")).withColumn("enough", F.col("n") >= 300)


SOME_KEYS = "SELECT DISTINCT l_orderkey AS o, l_linenumber AS n, l_partkey AS p FROM lineitem WHERE l_shipdate {}"


@query(
    f"WITH o AS ({SOME_KEYS.format("< TIMESTAMP '1998-01-01'")}), n AS ({SOME_KEYS.format(">= TIMESTAMP '1998-01-01'")}) SELECT o, CAST(n AS BIGINT) AS n, p FROM o"
    " WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.n = o.n AND n.p = o.p) AND NOT EXISTS (SELECT 1 FROM n WHERE n.o = o.o AND n.p = o.p) AND NOT EXISTS (SELECT 1 FROM n WHERE n.o = o.o AND n.n = o.n)"
)
def guard_shrink_explained(t: Tables) -> DataFrame:
    rows, cut = t.lineitem, F.lit(dt.datetime(1998, 1, 1))
    keys = [F.col("l_orderkey").alias("o"), long("l_linenumber").alias("n"), F.col("l_partkey").alias("p")]
    old = rows.where(F.col("l_shipdate") < cut).select(*keys)
    new = rows.where(F.col("l_shipdate") >= cut).select(*keys)
    return g.unexplained_missing(old, new, ["o", "n", "p"])


@query("SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def guard_duplicates(t: Tables) -> DataFrame:
    return g.duplicates(t.lineitem, ["l_orderkey", "l_linenumber"]).withColumn("l_linenumber", long("l_linenumber"))


@query("SELECT o_orderkey, o_totalprice, s AS children FROM orders JOIN (SELECT l_orderkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,4))) AS DOUBLE) AS s FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE abs(o_totalprice - s) > 1000")
def guard_mismatch(t: Tables) -> DataFrame:
    children = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), dec("l_extendedprice").alias("part"))
    out = g.child_mismatch(t.orders, children, ["o_orderkey"], "o_totalprice", "part", 1000)
    return out.withColumn("children", F.col("children").cast("double"))


BUSY = "SELECT DISTINCT CAST(ts AS DATE) AS date FROM events WHERE event_type = 'error'"


@query(f"SELECT CAST(d AS DATE) AS date FROM (SELECT unnest(generate_series(DATE '2023-12-20', DATE '2024-02-10', INTERVAL 1 DAY)) AS d) WHERE d NOT IN (SELECT date FROM ({BUSY})) AND day(d) % 10 <> 5")
def gap_days(t: Tables) -> DataFrame:
    # the range begins before the first error and ends after the last one
    first, last = dt.date(2023, 12, 20), dt.date(2024, 2, 10)
    audited = c.spine(t.spark, first, last).where(F.dayofmonth("date") % 10 == 5)
    return g.gap_days(t.readings.where("event_type = 'error'"), "date", first, last, audited)


@query(
    "WITH v AS (SELECT n_name AS name, CAST(count(*) AS DOUBLE) AS value FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1),"
    " s AS (SELECT CAST(count(*) AS DOUBLE) * 14 AS total FROM supplier GROUP BY s_nationkey)"
    " SELECT name, value FROM v WHERE NOT EXISTS (SELECT 1 FROM s WHERE abs(value - total) <= greatest(10, 0.1 * greatest(value, total)))"
)
def taxonomy_tolerance(t: Tables) -> DataFrame:
    values = t.customer.join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("name")).agg(F.count("*").cast("double").alias("value"))
    totals = t.supplier.groupBy("s_nationkey").agg((F.count("*").cast("double") * 14).alias("total"))
    return g.unmatched_within(values, totals, "value", "total")


@query("SELECT p_type, p_brand FROM (SELECT DISTINCT p_type, p_brand FROM part) WHERE p_type NOT IN ('ECONOMY', 'SMALL', 'MEDIUM')")
def unmapped_names(t: Tables) -> DataFrame:
    df = t.part.select("p_brand", F.create_map("p_type", F.lit(1)).alias("m"))
    keys = g.unmapped_keys(df, "m", ["ECONOMY", "SMALL", "MEDIUM"]).withColumnRenamed("key", "p_type")
    return t.part.select("p_type", "p_brand").distinct().join(keys, "p_type")


@query("SELECT DISTINCT o_custkey AS custkey FROM orders WHERE o_orderstatus = 'P' INTERSECT SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def key_intersection(t: Tables) -> DataFrame:
    key = F.col("o_custkey").alias("custkey")
    return t.orders.where("o_orderstatus = 'P'").select(key).intersect(t.orders.where("o_orderpriority = '1-URGENT'").select(key))


@query("SELECT c_custkey AS custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def key_difference(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("custkey")).exceptAll(t.orders.where("o_orderpriority = '1-URGENT'").select("o_custkey").distinct())


@query("SELECT min(d) AS first_date, max(d) AS last_date FROM (SELECT CAST(o_orderdate AS DATE) AS d FROM orders UNION ALL SELECT CAST(l_shipdate AS DATE) FROM lineitem)")
def union_window(t: Tables) -> DataFrame:
    both = t.days.select("date").union(t.lines.select("date"))
    return both.agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"))


@query("SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem")
def distinct_dates(t: Tables) -> DataFrame:
    return t.lines.select("date").distinct()


@query("SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS month FROM orders WHERE o_orderpriority = '1-URGENT' INTERSECT SELECT strftime(l_shipdate, '%Y-%m') FROM lineitem WHERE l_returnflag = 'R'")
def common_months(t: Tables) -> DataFrame:
    left = t.days.where("o_orderpriority = '1-URGENT'").select("month").distinct()
    right = t.lines.where("l_returnflag = 'R'").select(c.month_of(F.col("date")).alias("month"))
    return left.join(right, "month", "left_semi")


@query("SELECT o_custkey, o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, CAST(o_orderdate AS DATE) ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END, o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1")
def priority_pick(t: Tables) -> DataFrame:
    out = a.pick_by_priority(t.days, ["o_custkey", "date"], "o_orderpriority", ["1-URGENT", "2-HIGH"], [F.col("o_totalprice").desc(), F.col("o_orderkey")])
    return out.select("o_custkey", "o_orderpriority", "o_orderkey")


@query("SELECT o_orderkey, o_orderstatus FROM orders o WHERE o_orderstatus = 'F' OR NOT EXISTS (SELECT 1 FROM orders p WHERE p.o_orderstatus = 'F' AND p.o_custkey = o.o_custkey AND p.o_orderpriority = o.o_orderpriority)")
def priority_dedup_anti(t: Tables) -> DataFrame:
    return a.drop_covered(t.orders, ["o_custkey", "o_orderpriority"], "o_orderstatus", "F").select("o_orderkey", "o_orderstatus")


@query("SELECT CAST(l_shipdate AS DATE) AS date, l_suppkey, max(l_quantity) AS quantity, max(CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_tax END) AS tax FROM lineitem GROUP BY 1, 2")
def multipart_max_merge(t: Tables) -> DataFrame:
    return t.lines.groupBy("date", "l_suppkey").agg(F.max("l_quantity").alias("quantity"), F.max(F.when(F.col("l_returnflag") != "R", F.col("l_tax"))).alias("tax"))


SHARE = "SELECT l_orderkey, l_returnflag AS place, max(l_quantity / l_linenumber) AS attributed FROM lineitem GROUP BY 1, 2"


def shares(t: Tables) -> DataFrame:
    return a.fair_share(t.lineitem, ["l_orderkey"], "l_returnflag", F.col("l_quantity"), F.col("l_linenumber")).withColumnRenamed("l_returnflag", "place")


@query(f"SELECT place, CAST(sum(CAST(attributed AS DECIMAL(18,4))) AS DOUBLE) AS attributed, count(*) AS orders FROM ({SHARE}) GROUP BY 1")
def fair_share(t: Tables) -> DataFrame:
    return shares(t).groupBy("place").agg(total("attributed").alias("attributed"), F.count("*").alias("orders"))


COVER = f"SELECT o_orderkey, tot, coalesce(att, 0) AS attributed, CASE WHEN tot IS NULL THEN 0 ELSE greatest(0, tot - coalesce(att, 0)) END AS unattributed FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice / 8192 END AS tot FROM orders) LEFT JOIN (SELECT l_orderkey, sum(CASE WHEN attributed > 0 THEN attributed END) AS att FROM ({SHARE}) GROUP BY 1) ON l_orderkey = o_orderkey"


def covered(t: Tables) -> DataFrame:
    totals = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice") / 8192).alias("tot"))
    return a.coverage(totals, shares(t), ["l_orderkey"], "tot")


@query(f"SELECT o_orderkey AS id, round(tot, 4) AS tot, round(attributed, 4) AS attributed, round(unattributed, 4) AS unattributed FROM ({COVER})")
def composition_map_rows(t: Tables) -> DataFrame:
    return covered(t).select(F.col("l_orderkey").alias("id"), F.round("tot", 4).alias("tot"), F.round("attributed", 4).alias("attributed"), F.round("unattributed", 4).alias("unattributed"))


@query(f"SELECT round(sum(attributed) / (sum(attributed) + sum(unattributed)) * 100, 4) AS attributed_percent, count(*) FILTER (WHERE attributed > 0) AS covered, count(*) AS n FROM ({COVER})")
def coverage_summary(t: Tables) -> DataFrame:
    att, un = F.sum("attributed"), F.sum("unattributed")
    return covered(t).agg(F.round(att / (att + un) * 100, 4).alias("attributed_percent"), F.count(F.when(F.col("attributed") > 0, 1)).alias("covered"), F.count("*").alias("n"))


@query("SELECT user_id, event_type, count(*) AS n FROM (SELECT *, rank() OVER (PARTITION BY user_id, event_type ORDER BY CAST(ts AS DATE) DESC) AS rk FROM events) WHERE rk = 1 GROUP BY 1, 2")
def last_snapshot_join(t: Tables) -> DataFrame:
    return a.last_snapshot(t.readings, ["user_id", "event_type"], "date").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


HOURLY = "SELECT CAST(ts AS DATE) AS date, CAST(hour(ts) AS BIGINT) AS hour, count(*) AS n FROM events WHERE event_type = '{0}' GROUP BY 1, 2"


def hourly(t: Tables, kind: str) -> DataFrame:
    """Hours that hold an event of a kind; on small tables many hold none."""
    return t.readings.where(F.col("event_type") == kind).groupBy("date", "hour").agg(F.count("*").alias("n"))


@query(f"SELECT coalesce(a.date, b.date) AS date, coalesce(a.hour, b.hour) AS hour, a.n AS clicks, b.n AS views FROM ({HOURLY.format('click')}) a FULL JOIN ({HOURLY.format('view')}) b ON a.date = b.date AND a.hour = b.hour")
def full_outer_series(t: Tables) -> DataFrame:
    return hourly(t, "click").withColumnRenamed("n", "clicks").join(hourly(t, "view").withColumnRenamed("n", "views"), ["date", "hour"], "full")


@query(f"SELECT date, hour, max(CASE WHEN k = 'click' THEN n END) AS click, max(CASE WHEN k = 'view' THEN n END) AS view, max(CASE WHEN k = 'error' THEN n END) AS error FROM (SELECT 'click' AS k, * FROM ({HOURLY.format('click')}) UNION ALL SELECT 'view', * FROM ({HOURLY.format('view')}) UNION ALL SELECT 'error', * FROM ({HOURLY.format('error')})) GROUP BY 1, 2")
def point_series_full_outer(t: Tables) -> DataFrame:
    kinds = ["click", "view", "error"]
    click, view, error = (hourly(t, k).withColumn("k", F.lit(k)) for k in kinds)
    return click.unionByName(view).unionByName(error).groupBy("date", "hour").pivot("k", kinds).agg(F.max("n"))


SPINE = "SELECT CAST(unnest(generate_series(DATE '2024-01-10', DATE '2024-02-05', INTERVAL 1 DAY)) AS DATE) AS date"
DAILY = "SELECT CAST(ts AS DATE) AS date, count(*) AS n FROM events WHERE event_type = '{0}' GROUP BY 1"


@query(f"SELECT s.date, a.n AS left_value, b.n AS right_value FROM ({SPINE}) s LEFT JOIN ({DAILY.format('click')}) a ON a.date = s.date LEFT JOIN ({DAILY.format('view')}) b ON b.date = s.date")
def paired_series(t: Tables) -> DataFrame:
    # the range ends after the last event
    daily = lambda kind, name: t.readings.where(F.col("event_type") == kind).groupBy("date").agg(F.count("*").alias(name))
    left = c.fill_days(daily("click", "left_value"), "date", dt.date(2024, 1, 10), dt.date(2024, 2, 5))
    return left.join(daily("view", "right_value"), "date", "left")


@query("SELECT o_orderkey, coalesce(r, 0) AS returned, CASE WHEN k IS NULL THEN o_totalprice ELSE 0 END AS unsplit FROM orders LEFT JOIN (SELECT l_orderkey AS k, count(*) AS r FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON k = o_orderkey")
def left_default_split(t: Tables) -> DataFrame:
    split = t.lineitem.where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("r"))
    out = t.orders.join(split, "o_orderkey", "left")
    return out.select("o_orderkey", F.coalesce("r", F.lit(0)).alias("returned"), F.when(F.col("r").isNull(), F.col("o_totalprice")).otherwise(0.0).alias("unsplit"))


@query(f"SELECT date, hour, n, 'primary' AS source FROM ({HOURLY.format('click')}) UNION ALL SELECT date, hour, n, 'supplement' FROM ({HOURLY.format('view')}) v WHERE NOT EXISTS (SELECT 1 FROM ({HOURLY.format('click')}) p WHERE p.date = v.date AND p.hour = v.hour)")
def supplement_union(t: Tables) -> DataFrame:
    first = hourly(t, "click").withColumn("source", F.lit("primary"))
    rest = hourly(t, "view").join(first.select("date", "hour"), ["date", "hour"], "left_anti")
    return first.unionByName(rest.withColumn("source", F.lit("supplement")))
