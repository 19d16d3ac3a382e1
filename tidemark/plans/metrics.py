"""The catalogue of metrics across sources, the text form of charts, and the series they ask for.

A metric is ``<source>.<key>``.  A chart is ``name[:spec]:id,id``, charts are joined by ``;``; a spec is ``d`` or
``m``, a count of days or months (``all`` for months only), and an axis (``ylin``, ``ylog`` or ``ynorm``).
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators import calendar as c
from tidemark.operators import projection
from tidemark.operators.stats import stat_bundle
from tidemark.plans.registry import AS_OF, Tables, dec, query


@dataclass(frozen=True)
class Metric:
    """A series: its source, its key there, and the views that have it."""

    source: str
    key: str
    label: str
    views: frozenset[str] = frozenset({"daily", "monthly"})

    @property
    def id(self) -> str:
        return f"{self.source}.{self.key}"


@dataclass(frozen=True)
class Source:
    """How a source gives one row a day, and its metrics' columns in it; ``monthly`` where it has months only.

    ``hourly`` gives a row for each day and hour with what came in that hour, where a source knows hours.
    """

    name: str
    daily: Callable[[Tables], DataFrame] | None
    monthly: Callable[[Tables], DataFrame] | None = None
    columns: tuple[str, ...] = ()
    hourly: Callable[[Tables], DataFrame] | None = None


@dataclass
class Catalogue:
    """Metrics by id and sources by name."""

    sources: dict[str, Source] = field(default_factory=dict)
    metrics: dict[str, Metric] = field(default_factory=dict)

    def add(self, source: Source, labels: dict[str, str]) -> None:
        self.sources[source.name] = source
        views = frozenset({"daily", "monthly"} if source.daily else {"monthly"}) | ({"hourly"} if source.hourly else frozenset())
        for key in source.columns:
            m = Metric(source.name, key, labels.get(key, key.replace("_", " ")), views)
            self.metrics[m.id] = m

    def find(self, metric_id: str) -> Metric | None:
        return self.metrics.get(metric_id)

    def search(self, words: str) -> list[Metric]:
        """Metrics whose label, source or key have all the words."""
        wanted = words.lower().split()
        return [m for m in self.metrics.values() if all(w in f"{m.label} {m.source} {m.key}".lower() for w in wanted)]


@dataclass(frozen=True)
class Chart:
    name: str
    granularity: str = "daily"
    window: int | None = 30
    axis: str = "lin"
    metrics: tuple[str, ...] = ()


SPEC = re.compile(r"^([dm])(\d+|all)(?:y(lin|log|norm))?$")


def parse_charts(text: str, catalogue: Catalogue) -> list[Chart]:
    """Charts of a text; ids that are unknown or lack the granularity go, ``all`` days are no spec."""
    out = []
    for part in filter(None, text.split(";")):
        pieces = part.split(":")
        name, spec, ids = unquote(pieces[0]), None, pieces[-1] if len(pieces) > 1 else ""
        if len(pieces) > 2:
            spec = SPEC.match(pieces[1])
        if spec and spec[1] == "d" and spec[2] == "all":
            spec = None
        granularity = "monthly" if spec and spec[1] == "m" else "daily"
        window = 30 if not spec else None if spec[2] == "all" else int(spec[2])
        known = [m.id for i in ids.split(",") if (m := catalogue.find(unquote(i))) and granularity in m.views]
        out.append(Chart(name, granularity, window, spec[3] if spec and spec[3] else "lin", tuple(known)))
    return out


def format_charts(charts: Sequence[Chart]) -> str:
    """The text form; only ``%``, ``:`` and ``;`` are escaped."""
    escape = lambda s: s.replace("%", "%25").replace(":", "%3A").replace(";", "%3B")
    spec = lambda x: f"{x.granularity[0]}{'all' if x.window is None else x.window}y{x.axis}"
    return ";".join(f"{escape(x.name)}:{spec(x)}:{','.join(map(escape, x.metrics))}" for x in charts)


def series(t: Tables, catalogue: Catalogue, chart: Chart, as_of: dt.date) -> DataFrame:
    """The chart's series as (metric, date or month, value), without gaps by day; one scan a source, not a metric."""
    out = None
    by_source: dict[str, list[Metric]] = {}
    for m in map(catalogue.metrics.__getitem__, chart.metrics):
        by_source.setdefault(m.source, []).append(m)
    at = "date" if chart.granularity == "daily" else "month"
    for name, metrics in by_source.items():
        source = catalogue.sources[name]
        if chart.granularity == "daily":
            rows = c.day_window(source.daily(t), "date", as_of, chart.window or 30)
            rows = c.fill_days(rows.select("date", *[m.key for m in metrics]), "date", as_of - dt.timedelta(days=(chart.window or 30) - 1), as_of)
        else:
            if source.monthly:
                rows = source.monthly(t)
            else:
                sums = [F.sum(dec(m.key)).cast("double").alias(m.key) for m in metrics]
                rows = source.daily(t).groupBy(c.month_of(F.col("date")).alias("month")).agg(*sums)
            rows = c.pad_months(c.month_window(rows.select("month", *[m.key for m in metrics]), "month", as_of, chart.window), "month", as_of)
        wide = rows.select(at, *[F.col(m.key).cast("double").alias(m.id) for m in metrics])
        ids = [m.id for m in metrics]
        rows = wide.unpivot([at], [F.col(f"`{i}`") for i in ids], "metric", "value")
        out = rows if out is None else out.unionByName(rows)
    return t.spark.createDataFrame([], f"metric string, {at} {'date' if at == 'date' else 'string'}, value double") if out is None else out.select("metric", at, "value")


def global_stats(t: Tables, catalogue: Catalogue, ids: Sequence[str]) -> DataFrame:
    """Statistics over all of each daily series, whatever the chart's window."""
    out = None
    for name in dict.fromkeys(catalogue.metrics[i].source for i in ids):
        keys = [catalogue.metrics[i].key for i in ids if catalogue.metrics[i].source == name]
        rows = stat_bundle(catalogue.sources[name].daily(t), keys).withColumn("metric", F.concat(F.lit(f"{name}."), "metric"))
        out = rows if out is None else out.unionByName(rows)
    return out


def hours(t: Tables, catalogue: Catalogue, ids: Sequence[str], as_of: dt.date, days: int) -> DataFrame:
    """(metric, date, hour, value) of the last days of metrics that have hours; the others give no rows, as do silent hours."""
    out = t.spark.createDataFrame([], "metric string, date date, hour long, value double")
    known = [m for i in ids if (m := catalogue.find(i)) and "hourly" in m.views]
    for name in dict.fromkeys(m.source for m in known):
        rows = c.day_window(catalogue.sources[name].hourly(t), "date", as_of, days)
        wide = rows.select("date", "hour", *[F.col(m.key).cast("double").alias(m.id) for m in known if m.source == name])
        out = out.unionByName(wide.unpivot(["date", "hour"], [F.col(f"`{i}`") for i in wide.columns[2:]], "metric", "value"))
    return out


def end_of_day(t: Tables, catalogue: Catalogue, ids: Sequence[str], as_of: dt.date, hour: int, days: int = 90) -> DataFrame:
    """What the metrics come to at the end of ``as_of``, as seen after ``hour``, from the ``days`` days before it."""
    seen = hours(t, catalogue, ids, as_of, days + 1).where((F.col("date") < F.lit(as_of)) | (F.col("hour") <= hour))
    so_far = F.sum(dec("value")).over(Window.partitionBy("metric", "date").orderBy("hour").rowsBetween(Window.unboundedPreceding, 0))
    return projection.end_of_day(seen.select("metric", "date", F.col("hour").alias("bucket"), so_far.cast("double").alias("value")), as_of)


def windows(t: Tables, catalogue: Catalogue) -> DataFrame:
    """First and last day, or month, of each source as text, and how many of them have data."""
    out = t.spark.createDataFrame([], "source string, first string, last string, filled long")
    for source in catalogue.sources.values():
        at = F.date_format("date", "yyyy-MM-dd") if source.daily else F.col("month")
        rows = (source.daily or source.monthly)(t).where(at.isNotNull())
        out = out.unionByName(rows.agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("filled")).withColumn("source", F.lit(source.name)))
    return out


def by_kind(column: str, kinds: dict[str, str], value: str | None = None, suffix: str = "") -> list[Column]:
    """An aggregate a kind (by the metric's key): rows of that kind, or the exact sum of their ``value``."""
    of = {key: F.when(F.col(column) == kind, dec(value) if value else F.lit(1)) for key, kind in kinds.items()}
    return [(F.sum(x).cast("double") if value else F.count(x)).alias(key + suffix) for key, x in of.items()]


EVENT_KINDS = {k: k for k in ("click", "view", "purchase", "signup", "error")}
STATES = {"filled": "F", "open_value": "O", "pending": "P"}
PRIORITIES = {"urgent": "1-URGENT", "high": "2-HIGH", "medium": "3-MEDIUM", "unspecified": "4-NOT SPECIFIED", "low": "5-LOW"}
FLAGS = {"accepted": "A", "unflagged": "N", "returned": "R"}


def _of_events(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(*by_kind("event_type", EVENT_KINDS), *by_kind("event_type", EVENT_KINDS, "value", "_value"))


def _events(t: Tables) -> DataFrame:
    return _of_events(t.readings, "date")


def _event_hours(t: Tables) -> DataFrame:
    return _of_events(t.readings, "date", "hour")


def _orders(t: Tables) -> DataFrame:
    priced = [*by_kind("o_orderstatus", STATES, "o_totalprice"), *by_kind("o_orderpriority", PRIORITIES, "o_totalprice", "_value")]
    return t.days.groupBy("date").agg(F.count("*").alias("orders"), *by_kind("o_orderpriority", PRIORITIES), *priced)


def _lines(t: Tables) -> DataFrame:
    months = t.lines.groupBy(c.month_of(F.col("date")).alias("month"))
    return months.agg(F.count("*").alias("lines"), *by_kind("l_returnflag", FLAGS), *by_kind("l_returnflag", FLAGS, "l_quantity", "_quantity"))


def catalogue() -> Catalogue:
    """The metrics of the driver's tables: events by day and hour, orders by day, shipped lines by month only.

    Kinds make families of metrics, a count and a sum each; a further source is one more ``add``.
    """
    out = Catalogue()
    both = lambda kinds, suffix: (*kinds, *[k + suffix for k in kinds])
    out.add(Source("events", _events, None, both(EVENT_KINDS, "_value"), _event_hours), {"click": "Clicks", "view": "Views"})
    out.add(Source("orders", _orders, None, ("orders", *STATES, *both(PRIORITIES, "_value"))), {"filled": "Value of filled orders"})
    out.add(Source("lines", None, _lines, ("lines", *both(FLAGS, "_quantity"))), {"returned": "Lines returned"})
    return out


@query(
    "WITH s AS (SELECT CAST(unnest(generate_series(DATE '2024-01-21', DATE '2024-01-30', INTERVAL 1 DAY)) AS DATE) AS date),"
    " e AS (SELECT CAST(ts AS DATE) AS date, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'error') AS error FROM events GROUP BY 1)"
    " SELECT 'events.click' AS metric, s.date, CAST(click AS DOUBLE) AS value FROM s LEFT JOIN e ON e.date = s.date UNION ALL SELECT 'events.error', s.date, CAST(error AS DOUBLE) FROM s LEFT JOIN e ON e.date = s.date"
    " UNION ALL SELECT 'orders.orders', s.date, NULL FROM s"
)
def combined_series_daily(t: Tables) -> DataFrame:
    chart = parse_charts("Mixed:d10ylin:events.click,events.error,orders.orders,lines.lines,nothing.here", catalogue())[0]
    return series(t, catalogue(), chart, AS_OF)


@query(
    "WITH o AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, CAST(count(*) AS DOUBLE) AS n, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN CAST(o_totalprice AS DECIMAL(18,4)) END) AS DOUBLE) AS f FROM orders GROUP BY 1),"
    " l AS (SELECT strftime(l_shipdate, '%Y-%m') AS month, CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY 1)"
    " SELECT 'orders.orders' AS metric, month, n AS value FROM o WHERE month BETWEEN '2001-02' AND '2001-07' UNION ALL SELECT 'orders.filled', month, f FROM o WHERE month BETWEEN '2001-02' AND '2001-07' UNION ALL SELECT 'lines.lines', month, n FROM l WHERE month BETWEEN '2001-02' AND '2001-07'"
)
def combined_series_monthly(t: Tables) -> DataFrame:
    chart = parse_charts("Months:m6ylog:orders.orders,orders.filled,lines.lines", catalogue())[0]
    return series(t, catalogue(), chart, dt.date(2001, 7, 20))


@query(
    "WITH e AS (SELECT CAST(ts AS DATE) AS date, CAST(count(*) FILTER (WHERE event_type = 'click') AS DOUBLE) AS v FROM events GROUP BY 1),"
    " o AS (SELECT CAST(o_orderdate AS DATE) AS date, CAST(count(*) AS DOUBLE) AS v FROM orders GROUP BY 1)"
    " SELECT 'events.click' AS metric, max(v) AS max_value, CAST(percentile_disc(0.5) WITHIN GROUP (ORDER BY v DESC) AS DOUBLE) AS median_value, sum(v) AS total_value FROM e UNION ALL SELECT 'orders.orders', max(v), CAST(percentile_disc(0.5) WITHIN GROUP (ORDER BY v DESC) AS DOUBLE), sum(v) FROM o"
)
def combined_global_stats(t: Tables) -> DataFrame:
    return global_stats(t, catalogue(), ["events.click", "orders.orders"])


EVENT_HOURS = (
    "SELECT 'events.click' AS metric, CAST(ts AS DATE) AS date, CAST(hour(ts) AS BIGINT) AS hour, CAST(count(*) FILTER (WHERE event_type = 'click') AS DOUBLE) AS value FROM events GROUP BY 2, 3"
    " UNION ALL SELECT 'events.error_value', CAST(ts AS DATE), CAST(hour(ts) AS BIGINT), CAST(sum(CAST(value AS DECIMAL(18,4))) FILTER (WHERE event_type = 'error') AS DOUBLE) FROM events GROUP BY 2, 3"
)


@query(f"SELECT * FROM ({EVENT_HOURS}) WHERE date BETWEEN DATE '2024-01-28' AND DATE '2024-01-30' AND value IS NOT NULL")
def combined_hours(t: Tables) -> DataFrame:
    return hours(t, catalogue(), ["events.click", "events.error_value", "orders.orders", "nothing.here"], AS_OF, 3).where("value IS NOT NULL")


@query(
    f"WITH h AS ({EVENT_HOURS}), r AS (SELECT metric, date, hour, CAST(sum(CAST(value AS DECIMAL(18,4))) OVER (PARTITION BY metric, date ORDER BY hour) AS DOUBLE) AS v FROM h"
    " WHERE date BETWEEN DATE '2023-11-01' AND DATE '2024-01-29' OR (date = DATE '2024-01-30' AND hour <= 14)),"
    " f AS (SELECT metric, date, arg_max(v, hour) AS fin, max(hour) AS bucket FROM r GROUP BY 1, 2),"
    " s AS (SELECT r.metric, r.hour, percentile_disc(0.5) WITHIN GROUP (ORDER BY r.v / f.fin DESC) FILTER (WHERE r.v IS NOT NULL) AS frac, count(*) AS n FROM r JOIN f ON f.metric = r.metric AND f.date = r.date WHERE r.date <> DATE '2024-01-30' AND f.fin > 0 GROUP BY 1, 2)"
    " SELECT f.metric, f.bucket, round(f.fin, 4) AS partial, round(s.frac, 6) AS fraction FROM f JOIN s ON s.metric = f.metric AND s.hour = f.bucket WHERE f.date = DATE '2024-01-30' AND s.n >= 5 AND s.frac > 0 AND s.frac < 0.98"
)
def combined_end_of_day(t: Tables) -> DataFrame:
    out = end_of_day(t, catalogue(), ["events.click", "events.error_value"], AS_OF, 14)
    return out.select("metric", "bucket", F.round("partial", 4).alias("partial"), F.round("fraction", 6).alias("fraction"))


@query(
    "SELECT 'events' AS source, strftime(min(ts), '%Y-%m-%d') AS first, strftime(max(ts), '%Y-%m-%d') AS last, count(DISTINCT CAST(ts AS DATE)) AS filled FROM events"
    " UNION ALL SELECT 'orders', strftime(min(o_orderdate), '%Y-%m-%d'), strftime(max(o_orderdate), '%Y-%m-%d'), count(DISTINCT CAST(o_orderdate AS DATE)) FROM orders"
    " UNION ALL SELECT 'lines', strftime(min(l_shipdate), '%Y-%m'), strftime(max(l_shipdate), '%Y-%m'), count(DISTINCT strftime(l_shipdate, '%Y-%m')) FROM lineitem"
)
def combined_windows(t: Tables) -> DataFrame:
    return windows(t, catalogue())
