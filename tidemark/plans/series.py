"""Queries on daily, hourly, weekly and monthly series."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.numbers import log_or_null, round_half_up, share, sum_or_null
from tidemark.operators import calendar as c
from tidemark.operators import disclosure, folds, intervals, projection, stats
from tidemark.operators.scan import places
from tidemark.operators.versioned import best_per_key
from tidemark.plans.registry import AS_OF, Tables, dec, long, query, total
from tidemark.sources.saved import post_parts, register
from tidemark.tables import scratch

#: The order tables end in 2001; their queries run on this day.
ORDERS_AS_OF = dt.date(2001, 7, 20)
LATEST_READING = "SELECT event_type, CAST(ts AS DATE) AS date, CAST(hour(ts) AS BIGINT) AS hour, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1"


def latest_readings(t: Tables) -> DataFrame:
    return best_per_key(t.readings, ["event_type", "date"], [F.col("ts").desc(), F.col("event_id").desc()]).select("event_type", "date", "hour", "value")


@query(LATEST_READING)
def daily_latest_reading(t: Tables) -> DataFrame:
    return latest_readings(t)


def flagship_rows(t: Tables) -> DataFrame:
    """Seven days up to AS_OF without gaps, from each day's latest reading."""
    last = best_per_key(t.readings, ["date"], [F.col("ts").desc(), F.col("event_id").desc()]).select("date", "hour", "value")
    return c.fill_days(last, "date", AS_OF - dt.timedelta(days=6), AS_OF)


@query("SELECT s.date, x.hour, x.value FROM (SELECT CAST(unnest(generate_series(DATE '2024-01-24', DATE '2024-01-30', INTERVAL 1 DAY)) AS DATE) AS date) s LEFT JOIN (SELECT CAST(ts AS DATE) AS date, CAST(hour(ts) AS BIGINT) AS hour, value FROM (SELECT *, row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1) x ON x.date = s.date")
def flagship_week(t: Tables) -> DataFrame:
    return flagship_rows(t)


@query(f"SELECT * FROM ({LATEST_READING}) WHERE date BETWEEN DATE '2024-01-24' AND DATE '2024-01-30'")
def daily_window_7(t: Tables) -> DataFrame:
    # the day belongs to the key, so that its window goes below the version window
    return c.day_window(latest_readings(t), "date", AS_OF, 7)


@query("SELECT CAST(ts AS DATE) AS date, CAST(hour(ts) AS BIGINT) AS hour, count(*) AS n FROM events WHERE CAST(ts AS DATE) >= DATE '2024-01-28' AND hour(ts) < 24 GROUP BY 1, 2")
def hourly_window(t: Tables) -> DataFrame:
    return c.day_window(t.readings, "date", AS_OF, 3).where("hour < 24").groupBy("date", "hour").agg(F.count("*").alias("n"))


MONTHLY = "SELECT strftime(o_orderdate, '%Y-%m') AS month, CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) AS DOUBLE) AS total FROM orders GROUP BY 1"


def monthly(t: Tables) -> DataFrame:
    return t.days.groupBy("month").agg(total("o_totalprice").alias("total"))


@query(f"SELECT * FROM ({MONTHLY}) WHERE month >= '2000-08' AND month <= '2001-07'")
def month_window_12(t: Tables) -> DataFrame:
    return c.month_window(monthly(t), "month", ORDERS_AS_OF, 12)


@query("SELECT CAST(o_orderdate AS DATE) AS date, count(*) AS n FROM orders WHERE dayofweek(o_orderdate) IN (0, 6) GROUP BY 1")
def weekday_filter(t: Tables) -> DataFrame:
    return c.weekdays(t.days, "date", [0, 6]).groupBy("date").agg(F.count("*").alias("n"))


STATS = "SELECT event_type, 'v' AS metric, CAST(coalesce(max(v), 0) AS DOUBLE) AS max_value, CAST(coalesce(percentile_disc(0.5) WITHIN GROUP (ORDER BY v DESC), 0) AS DOUBLE) AS median_value, round(coalesce(sum(v), 0), 4) AS total_value FROM (SELECT event_type, {} AS v FROM events) GROUP BY 1"


@query(STATS.format("CASE WHEN hour(ts) >= 4 THEN value END"))
def stat_bundle_skip_null(t: Tables) -> DataFrame:
    # readings before four o'clock are unknown
    return stats.stat_bundle(t.events.withColumn("v", F.when(F.hour("ts") >= 4, F.col("value"))), ["v"], ["event_type"])


@query(STATS.format("CASE WHEN hour(ts) >= 4 THEN value ELSE 0 END"))
def stat_bundle_zero_null(t: Tables) -> DataFrame:
    return stats.stat_bundle(t.events.withColumn("v", F.when(F.hour("ts") >= 4, F.col("value"))), ["v"], ["event_type"], nulls="zero")


CLICKS = "SELECT CAST(ts AS DATE) AS date, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1"


def clicks(t: Tables, kind: str = "click") -> DataFrame:
    return t.readings.where(F.col("event_type") == kind).groupBy("date").agg(F.count("*").alias("n"))


@query(f"SELECT s.date, x.n AS value FROM (SELECT CAST(unnest(generate_series(DATE '2024-01-24', DATE '2024-02-02', INTERVAL 1 DAY)) AS DATE) AS date) s LEFT JOIN ({CLICKS}) x ON x.date = s.date")
def daily_filled(t: Tables) -> DataFrame:
    return c.fill_days(clicks(t), "date", dt.date(2024, 1, 24), dt.date(2024, 2, 2)).withColumnRenamed("n", "value")


#: Months are padded up to this day's, after the last order.
YEAR_END = dt.date(2001, 12, 31)
PADDED = f"SELECT * FROM ({MONTHLY}) UNION ALL SELECT strftime(d, '%Y-%m'), NULL FROM (SELECT unnest(generate_series((SELECT date_trunc('month', max(o_orderdate)) + INTERVAL 1 MONTH FROM orders), TIMESTAMP '2001-12-01', INTERVAL 1 MONTH)) AS d)"


@query(PADDED)
def trailing_month_pad(t: Tables) -> DataFrame:
    return c.pad_months(monthly(t), "month", YEAR_END)


@query(f"SELECT month FROM ({PADDED})")
def month_list_extend(t: Tables) -> DataFrame:
    return c.pad_months(monthly(t).select("month"), "month", YEAR_END)


DAY_BEST = "SELECT CAST(o_orderdate AS DATE) AS d, max(CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END) AS v FROM orders GROUP BY 1"


@query(f"SELECT strftime(d, '%Y-%m') AS month, CAST(coalesce(sum(CAST(v AS DECIMAL(18,4))), 0) AS DOUBLE) AS total, count(v) AS days FROM ({DAY_BEST}) GROUP BY 1")
def monthly_rollup(t: Tables) -> DataFrame:
    best = stats.peak_per_day(t.days.withColumn("v", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice"))), "date", "v")
    out = best.groupBy(c.month_of(F.col("date")).alias("month")).agg(F.sum(dec("v")).alias("s"), F.count("v").alias("days"))
    return out.select("month", F.coalesce(F.col("s").cast("double"), F.lit(0.0)).alias("total"), "days")


PROJECTED = f"SELECT month, total, CASE WHEN month = '2001-07' THEN CAST(floor(total * 31 / 20 + 0.5) AS BIGINT) END AS projected FROM ({MONTHLY})"


@query(PROJECTED)
def month_projection(t: Tables) -> DataFrame:
    return monthly(t).withColumn("projected", projection.month_projection(F.col("total"), F.col("month"), ORDERS_AS_OF))


@query(f"SELECT month, projected - total AS gap FROM ({PROJECTED}) WHERE projected IS NOT NULL")
def projection_gap(t: Tables) -> DataFrame:
    out = monthly(t).withColumn("projected", projection.month_projection(F.col("total"), F.col("month"), ORDERS_AS_OF)).where("projected is not null")
    return out.select("month", (F.col("projected") - F.col("total")).alias("gap"))


@query(
    "WITH h AS (SELECT event_type k, CAST(ts AS DATE) d, hour(ts) h, count(*) n FROM events GROUP BY 1,2,3),"
    " r AS (SELECT k, d, h, sum(n) OVER (PARTITION BY k, d ORDER BY h) AS v FROM h),"
    " w AS (SELECT * FROM r WHERE d >= DATE '2024-01-30' - 90 AND (d < DATE '2024-01-30' OR h <= 14)),"
    " f AS (SELECT k, d, arg_max(v, h) AS fin, max(h) AS last_h FROM w GROUP BY 1,2),"
    " s AS (SELECT w.k, w.h, percentile_disc(0.5) WITHIN GROUP (ORDER BY w.v / f.fin DESC) AS frac, count(*) AS n FROM w JOIN f ON w.k=f.k AND w.d=f.d WHERE w.d <> DATE '2024-01-30' AND f.fin > 0 GROUP BY 1,2)"
    " SELECT t.k AS metric, CAST(t.last_h AS BIGINT) AS bucket, CAST(t.fin AS BIGINT) AS partial, round(s.frac,6) AS fraction, CAST(floor(t.fin / s.frac + 0.5) AS BIGINT) AS projected"
    " FROM f t JOIN s ON s.k=t.k AND s.h=t.last_h WHERE t.d = DATE '2024-01-30' AND s.n >= 5 AND s.frac > 0 AND s.frac < 0.98"
)
def eod_projection(t: Tables) -> DataFrame:
    hours = t.readings.groupBy("event_type", "date", "hour").agg(F.count("*").alias("n"))
    so_far = F.sum("n").over(Window.partitionBy("event_type", "date").orderBy("hour").rowsBetween(Window.unboundedPreceding, 0))
    r = hours.select(F.col("event_type").alias("metric"), "date", F.col("hour").alias("bucket"), so_far.alias("value"))
    r = c.lookback(r, "date", AS_OF).where((F.col("date") < F.lit(AS_OF)) | (F.col("bucket") <= 14))
    return projection.end_of_day(r, AS_OF).select("metric", "bucket", "partial", F.round("fraction", 6).alias("fraction"), "projected")


GAPPY_DAYS = "SELECT s.d, x.v FROM (SELECT CAST(unnest(generate_series(DATE '2023-12-28', DATE '2024-02-03', INTERVAL 1 DAY)) AS DATE) AS d) s LEFT JOIN (SELECT CAST(ts AS DATE) AS d, count(*) AS v FROM events GROUP BY 1) x ON x.d = s.d"


@query(f"WITH i AS ({GAPPY_DAYS}) SELECT d AS date, CAST(CASE WHEN d > max(CASE WHEN v IS NOT NULL THEN d END) OVER () THEN NULL ELSE coalesce(sum(v) OVER (ORDER BY d),0) END AS BIGINT) AS running FROM i")
def running_total(t: Tables) -> DataFrame:
    # days before the first reading and after the last one are unknown
    days = c.fill_days(t.readings.groupBy("date").agg(F.count("*").alias("v")), "date", dt.date(2023, 12, 28), dt.date(2024, 2, 3))
    return projection.running_total(days, "date", "v").select("date", "running")


@query("WITH x AS (SELECT CAST(ts AS DATE) d, count(*) v FROM events WHERE event_type='view' GROUP BY 1), i AS (SELECT d, v, row_number() OVER (ORDER BY d) - 1 AS idx FROM x) SELECT d AS date, CAST(v AS BIGINT) AS value, CAST(greatest(0, floor(round(regr_slope(v,idx) OVER () * idx + regr_intercept(v,idx) OVER (), 6) + 0.5)) AS BIGINT) AS trend FROM i")
def trend_line(t: Tables) -> DataFrame:
    return projection.trend(clicks(t, "view").withColumnRenamed("n", "value"), "date", "value").select("date", "value", long("trend").alias("trend"))


@query("SELECT event_type, date, round(n / max(n) OVER (PARTITION BY event_type), 6) AS normalized FROM (SELECT event_type, CAST(ts AS DATE) AS date, count(*) AS n FROM events GROUP BY 1, 2)")
def normalized_series(t: Tables) -> DataFrame:
    days = t.readings.groupBy("event_type", "date").agg(F.count("*").alias("n"))
    return projection.normalized(days, "n", ["event_type"]).select("event_type", "date", F.round("normalized", 6).alias("normalized"))


@query("SELECT event_type, date, hour, CASE WHEN n > 1 THEN round(log10(n - 1), 6) END AS log_value FROM (SELECT event_type, CAST(ts AS DATE) AS date, CAST(hour(ts) AS BIGINT) AS hour, count(*) AS n FROM events GROUP BY 1, 2, 3)")
def log_series(t: Tables) -> DataFrame:
    hours = t.readings.groupBy("event_type", "date", "hour").agg(F.count("*").alias("n"))
    return hours.select("event_type", "date", "hour", F.round(log_or_null((F.col("n") - 1).cast("double")), 6).alias("log_value"))


@query("SELECT CAST(pos AS BIGINT) AS pos, coalesce(a, 0) AS d29, coalesce(b, 0) AS d30 FROM (SELECT unnest(range(0, 25)) AS pos) p LEFT JOIN (SELECT hour(ts) + 1 AS h, count(*) FILTER (WHERE CAST(ts AS DATE) = DATE '2024-01-29') AS a, count(*) FILTER (WHERE CAST(ts AS DATE) = DATE '2024-01-30') AS b FROM events GROUP BY 1) x ON x.h = p.pos")
def hourly_pivot(t: Tables) -> DataFrame:
    on = lambda day: F.count(F.when(F.col("date") == F.lit(day), 1))
    hours = t.readings.groupBy((F.col("hour") + 1).alias("pos")).agg(on(dt.date(2024, 1, 29)).alias("d29"), on(AS_OF).alias("d30"))
    return t.spark.range(25).withColumnRenamed("id", "pos").join(hours, "pos", "left").fillna(0)


@query("SELECT CAST(ts AS DATE) AS date, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'view') AS view, count(*) AS \"all\" FROM events GROUP BY 1")
def category_pivot_all(t: Tables) -> DataFrame:
    return stats.pivot_all(t.readings, ["date"], "event_type", ["click", "view"], F.lit(1).cast("long"))


HIDDEN = "sum(CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END)"


def withheld(t: Tables, keys: list[str]) -> DataFrame:
    return disclosure.disclosed_sums(t.days, keys, F.col("o_orderstatus") == "P", {"launched": F.col("o_totalprice")}).withColumn("launched", F.round("launched", 4))


@query(f"SELECT CAST(o_orderdate AS DATE) AS date, o_orderpriority AS category, round({HIDDEN}, 4) AS launched, CAST(sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) AS BIGINT) AS hidden FROM orders GROUP BY 1, 2")
def withheld_daily(t: Tables) -> DataFrame:
    return withheld(t, ["date", "o_orderpriority"]).withColumnRenamed("o_orderpriority", "category")


@query(f"SELECT strftime(o_orderdate, '%Y-%m') AS month, round({HIDDEN}, 4) AS launched, CAST(sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) AS BIGINT) AS hidden FROM orders GROUP BY 1")
def withheld_monthly(t: Tables) -> DataFrame:
    return withheld(t, ["month"])


@query(f"SELECT month, category, launched, hidden > 0 AS undisclosed, row_number() OVER (PARTITION BY month ORDER BY launched DESC NULLS LAST, category) AS place FROM (SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderpriority AS category, round({HIDDEN}, 4) AS launched, sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) AS hidden FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY 1, 2)")
def withheld_breakdown(t: Tables) -> DataFrame:
    rows = withheld(Tables(t.spark, t.path), ["month", "o_orderpriority"]).where("o_orderpriority <> '5-LOW'").withColumnRenamed("o_orderpriority", "category")
    place = F.row_number().over(Window.partitionBy("month").orderBy(F.col("launched").desc_nulls_last(), "category"))
    return rows.select("month", "category", "launched", (F.col("hidden") > 0).alias("undisclosed"), long(place).alias("place"))


@query("SELECT d.date, CASE WHEN x.hidden IS NULL THEN 0 ELSE x.value END AS value, coalesce(x.hidden, 0) AS hidden FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders) d LEFT JOIN (SELECT CAST(o_orderdate AS DATE) AS date, CAST(sum(CASE WHEN o_orderstatus <> 'P' THEN CAST(o_totalprice AS DECIMAL(18,4)) END) AS DOUBLE) AS value, CAST(sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) AS BIGINT) AS hidden FROM orders WHERE o_orderpriority = '2-HIGH' GROUP BY 1) x ON x.date = d.date")
def dense_model_daily(t: Tables) -> DataFrame:
    out = disclosure.dense_daily(t.days, "date", F.col("o_orderpriority") == "2-HIGH", F.col("o_orderstatus") == "P", dec("o_totalprice"))
    return out.withColumn("value", F.col("value").cast("double"))


KIND = "CASE WHEN hour(ts) < 6 THEN 'night' WHEN hour(ts) < 18 THEN 'day' WHEN hour(ts) < 22 THEN 'other' END"


@query(f"SELECT date, count(*) FILTER (WHERE k = 'night') AS night, count(*) FILTER (WHERE k IS DISTINCT FROM 'night') AS rest, count(*) FILTER (WHERE k = 'day' OR k = 'other') AS known_rest FROM (SELECT CAST(ts AS DATE) AS date, {KIND} AS k FROM events) GROUP BY 1")
def conditional_split_sums(t: Tables) -> DataFrame:
    k = F.when(F.col("hour") < 6, "night").when(F.col("hour") < 18, "day").when(F.col("hour") < 22, "other")
    rows = t.readings.withColumn("k", k)
    night = F.coalesce(F.col("k") == "night", F.lit(False))
    return rows.groupBy("date").agg(F.count(F.when(night, 1)).alias("night"), F.count(F.when(~night, 1)).alias("rest"), F.count(F.when(F.col("k").isin("day", "other"), 1)).alias("known_rest"))


NOTES = "SELECT user_id, CAST(ts AS DATE) AS date, string_agg(CAST(event_id AS VARCHAR) || ':' || event_type, ', ' ORDER BY event_id) AS notes FROM events GROUP BY 1, 2"


@query(NOTES)
def overlap_notes_listagg(t: Tables) -> DataFrame:
    note = F.struct("event_id", F.concat(F.col("event_id").cast("string"), F.lit(":"), F.col("event_type")).alias("note"))
    return t.readings.groupBy("user_id", "date").agg(F.array_join(F.transform(F.array_sort(F.collect_list(note)), lambda x: x["note"]), ", ").alias("notes"))


OVERLAP = (
    "WITH w AS (SELECT o_custkey AS grp, o_orderkey AS id, o_orderdate AS s, max(l_shipdate) AS e FROM orders JOIN lineitem ON l_orderkey=o_orderkey GROUP BY 1,2,3),"
    " p AS (SELECT *, max(e) OVER (PARTITION BY grp ORDER BY s, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_end FROM w)"
)


def order_windows(t: Tables) -> DataFrame:
    ends = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("e"))
    w = t.orders.join(ends, "o_orderkey").select(F.col("o_custkey").alias("grp"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("s"), "e")
    return intervals.overlaps(w, ["grp"], "s", "e", "id")


@query(f"{OVERLAP} SELECT grp, id, CAST(s AS DATE) AS start_d, CAST(prev_end AS DATE) AS prev_end_d FROM p WHERE prev_end IS NOT NULL AND s < prev_end")
def interval_overlap(t: Tables) -> DataFrame:
    return order_windows(t).where("prev_end is not null and s < prev_end").select("grp", "id", F.to_date("s").alias("start_d"), F.to_date("prev_end").alias("prev_end_d"))


@query(
    "SELECT id, prev_id, epoch_us(prev_end) AS prev_end_us FROM (SELECT event_id AS id, ts, max(e) OVER w AS prev_end, arg_max(event_id, (e, -place)) OVER w AS prev_id"
    " FROM (SELECT event_id, ts, ts + to_minutes(CAST(floor(value) AS BIGINT)) AS e, row_number() OVER (ORDER BY ts, event_id) AS place FROM events)"
    " WINDOW w AS (ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE ts < prev_end"
)
def overlapping_events(t: Tables) -> DataFrame:
    # an event takes as many minutes as its value says; all events are one series
    begin = F.unix_micros(F.col("ts").cast("timestamp"))
    w = t.events.select(F.col("event_id").alias("id"), begin.alias("s"), (begin + F.floor("value").cast("long") * 60_000_000).alias("e"))
    return intervals.overlaps(w, [], "s", "e", "id").where("s < prev_end").select("id", "prev_id", F.col("prev_end").alias("prev_end_us"))


@query(f"{OVERLAP} SELECT id, CASE WHEN s < prev_end THEN 'overlaps a window that ends ' || strftime(prev_end, '%Y-%m-%d') END AS notes FROM p")
def overlap_notes_recomputed(t: Tables) -> DataFrame:
    note = F.when(F.col("s") < F.col("prev_end"), F.concat(F.lit("overlaps a window that ends "), F.date_format("prev_end", "yyyy-MM-dd")))
    return order_windows(t).select("id", note.alias("notes"))


CUMULATIVE = "SELECT k, d, sum(n) OVER (PARTITION BY k ORDER BY d) AS v FROM (SELECT event_type AS k, CAST(ts AS DATE) AS d, count(*) AS n FROM events GROUP BY 1, 2)"


def cumulative(t: Tables) -> DataFrame:
    days = t.readings.groupBy(F.col("event_type").alias("k"), F.col("date").alias("d")).agg(F.count("*").alias("n"))
    return days.select("k", "d", F.sum("n").over(Window.partitionBy("k").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)).alias("v"))


@query(f"SELECT k, d, CAST(v - lag(v) OVER (PARTITION BY k ORDER BY d) AS BIGINT) AS increment FROM ({CUMULATIVE})")
def cumulative_to_increment(t: Tables) -> DataFrame:
    return projection.increments(cumulative(t), "d", "v", ["k"]).select("k", "d", "increment")


@query(
    f"WITH RECURSIVE c AS (SELECT k, d, row_number() OVER (PARTITION BY k ORDER BY d) AS i, CAST(CASE WHEN day(d) = 9 THEN NULL WHEN day(d) % 8 = 0 THEN v / 10 ELSE v END AS DOUBLE) AS v FROM ({CUMULATIVE})),"
    " f(k, i, prev, inc) AS (SELECT k, CAST(0 AS BIGINT), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE) FROM (SELECT DISTINCT k FROM c) UNION ALL SELECT c.k, c.i,"
    " CASE WHEN c.v IS NULL OR (f.prev > 100 AND c.v < f.prev * 0.5) THEN f.prev ELSE c.v END,"
    " CASE WHEN c.v IS NULL OR (f.prev > 100 AND c.v < f.prev * 0.5) THEN NULL WHEN f.prev IS NULL THEN CASE WHEN c.i = 1 THEN c.v END ELSE c.v - f.prev END FROM f JOIN c ON c.k = f.k AND c.i = f.i + 1)"
    " SELECT c.k, CAST(c.d AS DATE) AS d, round(f.inc, 4) AS increment FROM f JOIN c ON c.k = f.k AND c.i = f.i WHERE f.i > 0"
)
def hold_last_good(t: Tables) -> DataFrame:
    d = F.dayofmonth("d")
    v = F.when(d == 9, None).when(d % 8 == 0, F.col("v") / 10).otherwise(F.col("v"))
    return folds.hold_last_good(cumulative(t).withColumn("v", v.cast("double")), ["k"], "d", "v").withColumn("increment", F.round("increment", 4))


@query("SELECT CAST(h AS BIGINT) AS hour, count(event_id) AS total FROM (SELECT unnest(range(0, 24)) AS h) LEFT JOIN events ON hour(ts) = h GROUP BY 1")
def rle_decode_sum(t: Tables) -> DataFrame:
    # each user's day as 24 counts, packed into run-length codes and unpacked again
    hours = t.readings.groupBy("user_id", "date", "hour").agg(F.count("*").alias("n")).groupBy("user_id", "date").agg(F.map_from_entries(F.collect_list(F.struct("hour", "n"))).alias("m"))
    counts = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(23).cast("long")), lambda h: F.coalesce(F.try_element_at("m", h), F.lit(0)))
    codes = hours.select(folds.rle_encode(counts).alias("codes"))
    values = codes.select(F.posexplode(folds.checked_rle(F.col("codes"), F.lit(24))).alias("hour", "v"))
    return values.groupBy(long("hour").alias("hour")).agg(long(F.sum("v")).alias("total"))


@query("SELECT CAST(CAST(o_orderdate AS DATE) - CAST(((CAST(o_orderdate AS DATE) - DATE '1970-01-01') % 7) AS INTEGER) AS DATE) AS week, count(*) AS n FROM orders GROUP BY 1")
def week_buckets_thu(t: Tables) -> DataFrame:
    return t.days.groupBy(c.thursday_week(F.col("date")).alias("week")).agg(F.count("*").alias("n"))


@query("SELECT CAST(date_trunc('week', o_orderdate) AS DATE) AS week, count(*) AS n FROM orders GROUP BY 1")
def week_buckets_mon(t: Tables) -> DataFrame:
    return t.days.groupBy(c.monday_week(F.col("date")).alias("week")).agg(F.count("*").alias("n"))


@query("SELECT CAST(DATE '2024-01-02' + CAST(7 * ((CAST(ts AS DATE) - DATE '2024-01-02') // 7) AS INTEGER) AS DATE) AS week, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-02' GROUP BY 1")
def week_buckets_anchored(t: Tables) -> DataFrame:
    days = t.readings.where(F.col("date") >= F.lit(dt.date(2024, 1, 2))).groupBy("date").agg(F.count("*").alias("n"))
    return folds.bucket_sums(days, "date", F.lit(dt.date(2024, 1, 2)), "n")


@query("SELECT strftime(w, '%Y-%m') AS month, CAST(floor(CAST(sum(v) AS DOUBLE) + 0.5) AS BIGINT) AS total FROM (SELECT date_trunc('week', o_orderdate) AS w, sum(CASE WHEN o_orderstatus = 'F' THEN CAST(o_totalprice AS DECIMAL(18,4)) END) AS v FROM orders GROUP BY 1) GROUP BY 1")
def week_to_month(t: Tables) -> DataFrame:
    value = F.when(F.col("o_orderstatus") == "F", dec("o_totalprice"))
    weeks = t.days.groupBy(c.monday_week(F.col("date")).alias("w")).agg(F.sum(value).alias("v"))
    return weeks.groupBy(c.month_of(F.col("w")).alias("month")).agg(F.sum("v").cast("double").alias("v")).select("month", round_half_up(F.col("v")).alias("total"))


PIVOT = "SELECT CAST(ts AS DATE) AS date, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'view') AS view, count(*) FILTER (WHERE event_type = 'purchase') AS purchase, count(*) AS n FROM events GROUP BY 1"


def pivoted(t: Tables) -> DataFrame:
    return stats.pivot_all(t.readings, ["date"], "event_type", ["click", "view", "purchase"], F.lit(1).cast("long"))


@query(f"SELECT date, click + view AS browsing, purchase AS buying FROM ({PIVOT})")
def grouped_columns_sum(t: Tables) -> DataFrame:
    return stats.grouped_columns(pivoted(t), {"browsing": ["click", "view"], "buying": ["purchase"]}).select("date", "browsing", "buying")


@query(f"SELECT date, round(click / greatest(n, 1), 6) AS click_share, round(view / greatest(n, 1), 6) AS view_share FROM ({PIVOT})")
def composition_share(t: Tables) -> DataFrame:
    whole = F.greatest(F.col("all"), F.lit(1))
    return pivoted(t).select("date", F.round(F.col("click") / whole, 6).alias("click_share"), F.round(F.col("view") / whole, 6).alias("view_share"))


TYPED = "SELECT event_type, CAST(ts AS DATE) AS date, count(*) AS n FROM events GROUP BY 1, 2"


def typed(t: Tables) -> DataFrame:
    return t.readings.groupBy("event_type", "date").agg(F.count("*").alias("n"))


@query(f"SELECT event_type, date, n FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY date DESC) AS rn FROM ({TYPED})) WHERE rn <= 12")
def last_n_rows(t: Tables) -> DataFrame:
    return projection.tail_flag(typed(t), "date", 12, ["event_type"]).where("provisional").drop("provisional")


@query(f"SELECT event_type, date, row_number() OVER (PARTITION BY event_type ORDER BY date DESC) <= 6 AS provisional FROM ({TYPED})")
def provisional_tail(t: Tables) -> DataFrame:
    return projection.tail_flag(typed(t), "date", 6, ["event_type"]).drop("n")


@query(f"SELECT date, event_type, row_number() OVER (PARTITION BY date ORDER BY CASE WHEN n % 5 = 0 THEN NULL ELSE n END DESC NULLS LAST, event_type) AS place FROM ({TYPED})")
def rank_per_point(t: Tables) -> DataFrame:
    n = F.when(F.col("n") % 5 != 0, F.col("n"))
    place = F.row_number().over(Window.partitionBy("date").orderBy(n.desc_nulls_last(), "event_type"))
    return typed(t).select("date", "event_type", long(place).alias("place"))


@query(f"SELECT date, event_type, round((n - m) / m * 100, 4) AS deviation FROM ({TYPED}) x JOIN (SELECT date AS dd, CAST(percentile_disc(0.5) WITHIN GROUP (ORDER BY n DESC) AS DOUBLE) AS m FROM ({TYPED}) GROUP BY 1) ON dd = date")
def rank_with_deviation(t: Tables) -> DataFrame:
    days = typed(t)
    middle = days.groupBy("date").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY n DESC)").cast("double").alias("m"))
    return days.join(middle, "date").select("date", "event_type", F.round((F.col("n") - F.col("m")) / F.col("m") * 100, 4).alias("deviation"))


@query("SELECT 'events' AS source, DATE '2024-02-03' - CAST(max(ts) AS DATE) AS days_behind, DATE '2024-02-03' - CAST(max(ts) AS DATE) > 3 AS stale, hour(max(ts)) >= 22 AS complete FROM events UNION ALL SELECT 'orders', DATE '2001-08-03' - CAST(max(o_orderdate) AS DATE), DATE '2001-08-03' - CAST(max(o_orderdate) AS DATE) > 3, hour(max(o_orderdate)) >= 22 FROM orders")
def freshness_lag(t: Tables) -> DataFrame:
    def lag(df: DataFrame, name: str, at: str, on: dt.date) -> DataFrame:
        last = df.agg(F.max(at).alias("m"))
        behind = long(F.datediff(F.lit(on), F.to_date("m")))
        return last.select(F.lit(name).alias("source"), behind.alias("days_behind"), (behind > 3).alias("stale"), (F.hour("m") >= 22).alias("complete"))

    return lag(t.events, "events", "ts", dt.date(2024, 2, 3)).unionByName(lag(t.orders, "orders", "o_orderdate", dt.date(2001, 8, 3)))


@query("SELECT event_type, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS total FROM events GROUP BY 1")
def group_sum(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(total("value").alias("total"))


@query("SELECT user_id, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS total FROM events WHERE event_type = 'purchase' GROUP BY 1 HAVING sum(value) > 500 ORDER BY total DESC")
def having_top_totals(t: Tables) -> DataFrame:
    sums = t.events.where("event_type = 'purchase'").groupBy("user_id").agg(total("value").alias("total"))
    return sums.where("total > 500").orderBy(F.col("total").desc())


@query("SELECT date, max(n) AS n FROM (SELECT CAST(ts AS DATE) AS date, hour(ts) AS h, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1")
def peak_per_day(t: Tables) -> DataFrame:
    return stats.peak_per_day(t.readings.groupBy("date", "hour").agg(F.count("*").alias("n")), "date", "n")


@query("SELECT lower(p_type) AS name, min(p_partkey) AS first_at, CAST(sum(p_size) AS BIGINT) AS total FROM part GROUP BY 1")
def merge_duplicate_names(t: Tables) -> DataFrame:
    return t.part.groupBy(F.lower("p_type").alias("name")).agg(F.min("p_partkey").alias("first_at"), long(F.sum("p_size")).alias("total"))


@query(f"SELECT a.date, greatest(b.n - a.n, 0) AS band, round(b.n / a.n, 6) AS ratio FROM ({CLICKS}) a JOIN (SELECT CAST(ts AS DATE) AS date, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY 1) b ON a.date = b.date")
def gap_band_ratio(t: Tables) -> DataFrame:
    both = clicks(t).join(clicks(t, "view").withColumnRenamed("n", "v"), "date")
    return both.select("date", F.greatest(F.col("v") - F.col("n"), F.lit(0)).alias("band"), F.round(F.col("v") / F.col("n"), 6).alias("ratio"))


@query("SELECT DISTINCT event_type FROM events ORDER BY event_type")
def distinct_series(t: Tables) -> DataFrame:
    return t.events.select("event_type").distinct().orderBy("event_type")


@query("SELECT count(*) AS n, min(CAST(ts AS DATE)) AS first_date FROM events WHERE CAST(ts AS DATE) >= DATE '2024-04-09' - 90")
def lookback_90(t: Tables) -> DataFrame:
    # on the column itself, so that the scan skips row groups
    return t.events.where(F.col("ts") >= F.lit(dt.datetime(2024, 1, 10))).agg(F.count("*").alias("n"), F.min(F.to_date("ts")).alias("first_date"))


@query(f"SELECT date, n, date = DATE '2024-01-30' AS is_today FROM ({CLICKS})")
def today_flag(t: Tables) -> DataFrame:
    return clicks(t).withColumn("is_today", F.col("date") == F.lit(AS_OF))


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus IN ('F', 'O') AND o_totalprice BETWEEN 1000 AND 50000 AND o_custkey <> 7")
def literal_filters(t: Tables) -> DataFrame:
    wanted = (F.col("o_orderpriority") == "1-URGENT") & F.col("o_orderstatus").isin("F", "O") & F.col("o_totalprice").between(1000, 50000) & (F.col("o_custkey") != 7)
    return t.orders.where(wanted).select("o_orderkey")


@query("SELECT s.date, coalesce(x.v, 0) AS value FROM (SELECT CAST(unnest(generate_series(DATE '2024-01-26', DATE '2024-01-30', INTERVAL 1 DAY)) AS DATE) AS date) s LEFT JOIN (SELECT CAST(ts AS DATE) AS date, arg_max(value, event_id) AS v FROM events WHERE event_type = 'signup' GROUP BY 1) x ON x.date = s.date")
def long_category_window(t: Tables) -> DataFrame:
    rows = t.readings.where("event_type = 'signup'").groupBy("date").agg(F.max_by("value", "event_id").alias("value"))
    return c.fill_days(rows, "date", AS_OF - dt.timedelta(days=4), AS_OF).fillna(0.0, ["value"])


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date FROM orders WHERE o_orderdate >= TIMESTAMP '2001-01-01' AND o_orderdate <= TIMESTAMP '2001-02-15' AND o_orderkey > 5000")
def since_until(t: Tables) -> DataFrame:
    o = t.orders.where((F.col("o_orderdate") >= F.lit(dt.datetime(2001, 1, 1))) & (F.col("o_orderdate") <= F.lit(dt.datetime(2001, 2, 15))) & (F.col("o_orderkey") > 5000))
    return o.select("o_orderkey", F.to_date("o_orderdate").alias("date"))


@query("SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) = 1")
def single_member_series(t: Tables) -> DataFrame:
    ends = t.lineitem.groupBy("l_orderkey").agg(F.min("l_suppkey").alias("least"), F.max("l_suppkey").alias("most"))
    return ends.where("least = most").select("l_orderkey")


@query("SELECT o_custkey, round(min(CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END), 2) AS low FROM orders GROUP BY 1 ORDER BY low ASC NULLS FIRST, o_custkey")
def nulls_order(t: Tables) -> DataFrame:
    low = F.round(F.min(F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice"))), 2)
    return t.orders.groupBy("o_custkey").agg(low.alias("low")).orderBy(F.col("low").asc_nulls_first(), "o_custkey")


@query(f"SELECT date, n, row_number() OVER (ORDER BY date = DATE '2024-01-15', date) AS place FROM ({CLICKS})")
def today_last(t: Tables) -> DataFrame:
    return places(clicks(t), [F.col("date") == F.lit(dt.date(2024, 1, 15)), "date"]).drop("place_all")


@query("SELECT p_brand, CAST(p_size AS BIGINT) AS p_size, CAST(d AS BIGINT) AS place FROM (SELECT p_brand, p_size, min(CASE p_type WHEN 'PROMO' THEN 0 WHEN 'LARGE' THEN 1 WHEN 'SMALL' THEN 2 ELSE 3 END) AS d FROM part GROUP BY 1, 2)")
def declared_order(t: Tables) -> DataFrame:
    order = t.spark.range(3).select(F.get(F.array(F.lit("PROMO"), F.lit("LARGE"), F.lit("SMALL")), F.col("id").cast("int")).alias("p_type"), F.col("id").alias("at"))
    named = t.part.withColumn("p_size", long("p_size")).join(F.broadcast(order), "p_type", "left")
    return named.groupBy("p_brand", "p_size").agg(F.min(F.coalesce("at", F.lit(3))).alias("place"))


@query("SELECT event_id, CAST(CASE WHEN CAST(ts AS DATE) > DATE '2024-01-29' THEN 23 ELSE least(23, greatest(0, hour(ts))) END AS BIGINT) AS effective_hour FROM events WHERE ts >= TIMESTAMP '2024-01-29'")
def effective_hour(t: Tables) -> DataFrame:
    day = dt.date(2024, 1, 29)
    hour = F.when(F.to_date("ts") > F.lit(day), 23).otherwise(F.least(F.lit(23), F.greatest(F.lit(0), F.hour("ts"))))
    return t.events.where(F.col("ts") >= F.lit(dt.datetime(2024, 1, 29))).select("event_id", long(hour).alias("effective_hour"))


@query("SELECT CAST(ts + INTERVAL 7 HOUR AS DATE) AS report_date, count(*) AS n FROM events GROUP BY 1")
def window_end_date(t: Tables) -> DataFrame:
    # days that begin at 17:00
    return t.events.groupBy(F.to_date(F.col("ts") + F.expr("interval 7 hours")).alias("report_date")).agg(F.count("*").alias("n"))


@query("SELECT event_type, CAST(floor(log10(min(value))) AS BIGINT) AS low_power, CAST(ceil(log10(max(value))) AS BIGINT) AS high_power, round(max(value) * 1.15, 4) AS top FROM events WHERE value > 0 GROUP BY 1")
def axis_domains(t: Tables) -> DataFrame:
    v = t.events.where("value > 0").groupBy("event_type").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    return v.select("event_type", long(F.floor(F.log10("lo"))).alias("low_power"), long(F.ceil(F.log10("hi"))).alias("high_power"), F.round(F.col("hi") * 1.15, 4).alias("top"))


@query("SELECT date, CASE WHEN n > 0 THEN round(r / n * 100, 4) END AS rate FROM (SELECT CAST(l_shipdate AS DATE) AS date, count(*) FILTER (WHERE l_returnflag <> 'N') AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS r FROM lineitem GROUP BY 1)")
def subset_rate(t: Tables) -> DataFrame:
    days = t.lines.groupBy("date").agg(F.count(F.when(F.col("l_returnflag") != "N", 1)).alias("n"), F.count(F.when(F.col("l_returnflag") == "R", 1)).alias("r"))
    return days.select("date", F.round(share(F.col("r"), F.col("n")), 4).alias("rate"))


@query("SELECT date, CAST(sum(CASE WHEN p = '1' THEN v END) AS DOUBLE) AS urgent, CAST(sum(CASE WHEN p = '2' THEN v END) AS DOUBLE) AS high, CAST(coalesce(sum(CASE WHEN p = '1' THEN v END), 0) + coalesce(sum(CASE WHEN p = '2' THEN v END), 0) AS DOUBLE) AS both_sum FROM (SELECT CAST(o_orderdate AS DATE) AS date, substr(o_orderpriority, 1, 1) AS p, CAST(o_totalprice AS DECIMAL(18,4)) AS v FROM orders) GROUP BY 1 HAVING sum(CASE WHEN p IN ('1', '2') THEN v END) IS NOT NULL")
def sum_of_known(t: Tables) -> DataFrame:
    p = F.substring("o_orderpriority", 1, 1)
    of = lambda x: F.sum(F.when(p == x, dec("o_totalprice")))
    days = t.days.groupBy("date").agg(of("1").alias("urgent"), of("2").alias("high"))
    days = days.withColumn("both_sum", sum_or_null(F.col("urgent"), F.col("high"))).where("both_sum is not null")
    return days.select("date", *[F.col(x).cast("double").alias(x) for x in ("urgent", "high", "both_sum")])


@query("WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderpriority AS k, count(*) AS v FROM orders WHERE NOT (o_orderpriority = '5-LOW' AND month(o_orderdate) % 2 = 0) GROUP BY 1, 2) SELECT month, k, v, false AS derived FROM m UNION ALL SELECT month, '5-LOW', CAST(sum(v) AS BIGINT), true FROM m WHERE k IN ('1-URGENT', '2-HIGH', '3-MEDIUM') AND month NOT IN (SELECT month FROM m WHERE k = '5-LOW') GROUP BY 1")
def derived_total_union(t: Tables) -> DataFrame:
    kept = t.days.where(~((F.col("o_orderpriority") == "5-LOW") & (F.month("date") % 2 == 0)))
    m = kept.groupBy("month", F.col("o_orderpriority").alias("k")).agg(F.count("*").alias("v"))
    with_total = m.where("k = '5-LOW'").select("month")
    parts = m.where(F.col("k").isin("1-URGENT", "2-HIGH", "3-MEDIUM")).join(with_total, "month", "left_anti").groupBy("month").agg(F.sum("v").alias("v"))
    return m.withColumn("derived", F.lit(False)).unionByName(parts.select("month", F.lit("5-LOW").alias("k"), "v", F.lit(True).alias("derived")))


@query("SELECT l.month, l.a AS left_value, r.b AS right_value, CASE WHEN l.a > r.b THEN 'left' WHEN r.b > l.a THEN 'right' END AS higher FROM (SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) FILTER (WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')) AS a FROM orders GROUP BY 1) l JOIN (SELECT strftime(l_shipdate, '%Y-%m') AS month, count(*) FILTER (WHERE l_returnflag = 'R') // 4 AS b FROM lineitem GROUP BY 1) r ON r.month = l.month")
def comparison_table(t: Tables) -> DataFrame:
    left = t.days.groupBy("month").agg(F.count(F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), 1)).alias("left_value"))
    right = t.lines.groupBy(c.month_of(F.col("date")).alias("month")).agg(long(F.floor(F.count(F.when(F.col("l_returnflag") == "R", 1)) / 4)).alias("right_value"))
    higher = F.when(F.col("left_value") > F.col("right_value"), "left").when(F.col("right_value") > F.col("left_value"), "right")
    return left.join(right, "month").withColumn("higher", higher)


@query("SELECT CAST(o_orderdate AS DATE) AS start_d, CAST(last_day(o_orderdate) AS DATE) AS end_d, count(*) AS n FROM orders WHERE day(o_orderdate) = 1 GROUP BY 1, 2")
def calendar_month_periods(t: Tables) -> DataFrame:
    periods = t.days.select(F.col("date").alias("start_d"), F.last_day("date").alias("end_d"))
    return periods.where(c.whole_month(F.col("start_d"), F.col("end_d"))).groupBy("start_d", "end_d").agg(F.count("*").alias("n"))


@query("SELECT CAST(ts AS DATE) AS date, count(*) AS n FROM events WHERE CAST(ts AS DATE) > DATE '2024-01-03' AND CAST(ts AS DATE) < (SELECT min(CAST(d AS DATE)) FROM (SELECT unnest(generate_series(DATE '2024-01-04', DATE '2024-02-11', INTERVAL 1 DAY)) AS d) WHERE CAST(d AS DATE) NOT IN (SELECT CAST(ts AS DATE) FROM events)) GROUP BY 1")
def stop_at_first_gap(t: Tables) -> DataFrame:
    # the range ends after the last reading, so that there is a gap
    days = t.readings.groupBy("date").agg(F.count("*").alias("n"))
    return c.first_gap(days, "date", dt.date(2024, 1, 3), dt.date(2024, 2, 10))


@query("SELECT event_id, user_id FROM events WHERE event_id > (SELECT max(event_id) FROM events WHERE ts < TIMESTAMP '2024-01-29')")
def newest_id_filter(t: Tables) -> DataFrame:
    known = t.events.where(F.col("ts") < F.lit(dt.datetime(2024, 1, 29))).agg(F.max("event_id").alias("m"))
    return t.events.join(F.broadcast(known), F.col("event_id") > F.col("m")).select("event_id", "user_id")


@query("SELECT event_type, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY 1")
def json_props_flatten(t: Tables) -> DataFrame:
    return t.events.select("event_type", F.from_json("props", "struct<k:bigint>")["k"].alias("k")).groupBy("event_type").agg(F.sum("k").alias("k"))


@query("SELECT min(CAST(ts AS DATE)) AS first_date, max(CAST(ts AS DATE)) AS last_date, strftime(max(ts), '%Y-%m-%d %H:%M') AS newest FROM events")
def data_window(t: Tables) -> DataFrame:
    out = stats.data_window(t.readings, "date", F.col("ts"))
    return out.withColumn("newest", F.date_format("newest", "yyyy-MM-dd HH:mm"))


@query("SELECT p_brand, p_type, CAST(count(*) AS BIGINT) AS n, CAST(sum(p_size) AS BIGINT) AS total, CAST(2 - GROUPING(p_brand) - GROUPING(p_type) AS BIGINT) AS level FROM part GROUP BY ROLLUP (p_brand, p_type)")
def rolled_up(t: Tables) -> DataFrame:
    out = stats.rolled_up(t.part, ["p_brand", "p_type"], [F.count("*").alias("n"), F.sum("p_size").cast("long").alias("total")])
    return out.withColumn("level", long("level"))


@query("SELECT page_id AS post_id, CAST(DATE '2024-01-01' + CAST(page_id % 300 AS INTEGER) AS DATE) AS posted_on, trim(regexp_replace(url, '\\s+', ' ', 'g')) AS text FROM pages")
def saved_timeline_posts(t: Tables) -> DataFrame:
    # the pages' addresses as posts of saved timeline pages, fifty ids each, read back by the data source
    register(t.spark)
    low = F.floor(F.col("page_id") / 50) * 50
    text = F.replace(F.replace(F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    at = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 300).cast("int")).cast("string")
    post = F.format_string('<div class="m" data-post="pages/%d"><div class="text">%s</div><time datetime="%sT00:00:00Z"></time></div>', "page_id", text, at)
    path = scratch(t.spark, "timeline")
    t.pages.select(post.alias("value"), F.concat_ws("-", low, low + 49).alias("ids")).write.partitionBy("ids").text(path)
    return post_parts(t.spark.read.format("saved_timeline").load(path)).select("post_id", F.to_date("posted_at").alias("posted_on"), "text")
