"""Queries on versions: which row holds, what changed, what a batch brings."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import versioned as v
from tidemark.operators import writers
from tidemark.plans.registry import Tables, dec, long, query, total

KEYS = ("l_orderkey", "l_linenumber")
#: Rows that are alike in all but these have no order among them.
REST = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
FIRST = "row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus)"
SHOWN_SQL = "l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_quantity, CAST(l_shipdate AS DATE) AS version"
CUT = dt.datetime(1999, 1, 1)
STORED_SQL = f"SELECT * FROM (SELECT *, {FIRST} AS rn FROM lineitem WHERE l_shipdate < TIMESTAMP '1999-01-01') WHERE rn = 1"
INCOMING_SQL = f"SELECT * FROM (SELECT *, {FIRST} AS rn FROM lineitem) WHERE rn = 1"


def shown(df: DataFrame) -> DataFrame:
    return df.select("l_orderkey", long("l_linenumber").alias("l_linenumber"), "l_quantity", F.to_date("l_shipdate").alias("version"))


def table(t: Tables) -> v.VersionedTable:
    return v.VersionedTable(t.lineitem, KEYS, "l_shipdate")


def stored(t: Tables) -> DataFrame:
    """The latest row of each key before CUT."""
    return v.VersionedTable(t.lineitem.where(F.col("l_shipdate") < F.lit(CUT)), KEYS, "l_shipdate").latest("one", list(map(F.col, REST)))


def incoming(t: Tables) -> DataFrame:
    return table(t).latest("one", list(map(F.col, REST)))


@query(f"SELECT {SHOWN_SQL} FROM lineitem l JOIN (SELECT l_orderkey AS k, l_linenumber AS n, max(l_shipdate) AS m FROM lineitem GROUP BY 1, 2) x ON x.k = l_orderkey AND x.n = l_linenumber AND x.m = l_shipdate")
def latest_version_keep_ties(t: Tables) -> DataFrame:
    return shown(table(t).latest())


@query(f"SELECT {SHOWN_SQL} FROM lineitem p WHERE NOT EXISTS (SELECT 1 FROM lineitem n WHERE n.l_orderkey = p.l_orderkey AND n.l_linenumber = p.l_linenumber AND n.l_shipdate > p.l_shipdate)")
def latest_version_not_exists(t: Tables) -> DataFrame:
    return shown(table(t).latest(null_versions=True))


@query(f"SELECT {SHOWN_SQL} FROM ({INCOMING_SQL})")
def latest_version_one(t: Tables) -> DataFrame:
    return shown(incoming(t))


@query("SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, count(DISTINCT l_shipdate) AS versions, CAST(min(l_shipdate) AS DATE) AS first_version, CAST(max(l_shipdate) AS DATE) AS last_version FROM lineitem GROUP BY 1, 2")
def version_history_counts(t: Tables) -> DataFrame:
    return table(t).history().select("l_orderkey", long("l_linenumber").alias("l_linenumber"), "versions", F.to_date("first_version").alias("first_version"), F.to_date("last_version").alias("last_version"))


ONE_A_VERSION = "SELECT l_orderkey, l_linenumber, l_shipdate, max(l_returnflag) AS f, max(l_linestatus) AS s FROM lineitem GROUP BY 1, 2, 3"


@query(f"SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CAST(l_shipdate AS DATE) AS version, f, s FROM (SELECT *, lag(f) OVER w AS pf, lag(s) OVER w AS ps, row_number() OVER w AS rn FROM ({ONE_A_VERSION}) WINDOW w AS (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate)) WHERE rn = 1 OR f IS DISTINCT FROM pf OR s IS DISTINCT FROM ps")
def changed_versions(t: Tables) -> DataFrame:
    one = t.lineitem.groupBy(*KEYS, "l_shipdate").agg(F.max("l_returnflag").alias("f"), F.max("l_linestatus").alias("s"))
    return v.VersionedTable(one, KEYS, "l_shipdate").changes(["f", "s"]).select("l_orderkey", long("l_linenumber").alias("l_linenumber"), F.to_date("l_shipdate").alias("version"), "f", "s")


SAME = " AND ".join(f"o.{c} IS NOT DISTINCT FROM i.{c}" for c in ("l_quantity", "l_returnflag", "l_linestatus"))


@query(f"SELECT CASE WHEN o.l_orderkey IS NULL THEN 'new' WHEN {SAME} THEN 'unchanged' ELSE 'revised' END AS status, count(*) AS n FROM ({INCOMING_SQL}) i LEFT JOIN ({STORED_SQL}) o ON o.l_orderkey = i.l_orderkey AND o.l_linenumber = i.l_linenumber GROUP BY 1")
def diff_new_revised_unchanged(t: Tables) -> DataFrame:
    return v.diff(stored(t), incoming(t), KEYS, ["l_quantity", "l_returnflag", "l_linestatus"]).groupBy("status").agg(F.count("*").alias("n"))


GAPPY = "CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_quantity END AS q, CASE WHEN l_linestatus = 'F' THEN NULL ELSE l_tax END AS x"


@query(f"SELECT i.l_orderkey, CAST(i.l_linenumber AS BIGINT) AS l_linenumber, coalesce(i.q, o.q) AS q, coalesce(i.x, o.x) AS x FROM (SELECT l_orderkey, l_linenumber, {GAPPY} FROM ({INCOMING_SQL})) i LEFT JOIN (SELECT l_orderkey, l_linenumber, {GAPPY} FROM ({STORED_SQL})) o ON o.l_orderkey = i.l_orderkey AND o.l_linenumber = i.l_linenumber WHERE o.l_orderkey IS NULL OR (i.q IS NOT NULL AND i.q IS DISTINCT FROM o.q) OR (i.x IS NOT NULL AND i.x IS DISTINCT FROM o.x)")
def null_aware_merge(t: Tables) -> DataFrame:
    gappy = [F.when(F.col("l_returnflag") != "R", F.col("l_quantity")).alias("q"), F.when(F.col("l_linestatus") != "F", F.col("l_tax")).alias("x")]
    out = v.merge_known(stored(t).select(*KEYS, *gappy), incoming(t).select(*KEYS, *gappy), KEYS, ["q", "x"])
    return out.withColumn("l_linenumber", long("l_linenumber"))


@query(f"SELECT o.l_orderkey, CAST(o.l_linenumber AS BIGINT) AS l_linenumber, CASE WHEN i.q IS NOT NULL AND (o.q IS NULL OR i.q > o.q) THEN i.q ELSE o.q END AS q FROM (SELECT l_orderkey, l_linenumber, {GAPPY} FROM ({STORED_SQL})) o LEFT JOIN (SELECT l_orderkey, l_linenumber, {GAPPY} FROM ({INCOMING_SQL})) i ON o.l_orderkey = i.l_orderkey AND o.l_linenumber = i.l_linenumber")
def monotone_refresh(t: Tables) -> DataFrame:
    q = F.when(F.col("l_returnflag") != "R", F.col("l_quantity")).alias("q")
    return v.monotone_refresh(stored(t).select(*KEYS, q), incoming(t).select(*KEYS, q), KEYS, ["q"]).withColumn("l_linenumber", long("l_linenumber"))


@query("SELECT l_orderkey, count(*) AS lines FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_quantity DESC, l_partkey, l_suppkey, l_shipdate) AS rn FROM lineitem) l WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM lineitem s WHERE s.l_shipdate < TIMESTAMP '1999-01-01' AND s.l_orderkey = l.l_orderkey AND s.l_linenumber = l.l_linenumber) GROUP BY 1")
def backfill_missing_keys(t: Tables) -> DataFrame:
    before = t.lineitem.where(F.col("l_shipdate") < F.lit(CUT))
    rows = v.backfill(before, t.lineitem, KEYS, [F.col("l_quantity").desc(), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_shipdate")])
    return rows.groupBy("l_orderkey").agg(F.count("*").alias("lines"))


@query("SELECT o_orderkey, o_orderpriority, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END DESC NULLS LAST, o_orderkey) AS rn FROM orders) WHERE rn = 1")
def best_row_per_key(t: Tables) -> DataFrame:
    price = F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice"))
    return v.best_per_key(t.orders, ["o_custkey"], [price.desc_nulls_last(), F.col("o_orderkey")]).select("o_orderkey", "o_orderpriority", "o_totalprice")


LATEST_ORDERS = "SELECT l_orderkey, max(l_shipdate) AS m FROM lineitem GROUP BY 1"


@query(f"SELECT l.l_orderkey, count(*) AS lines, CAST(sum(CAST(l_quantity AS DECIMAL(18,4))) AS DOUBLE) AS quantity FROM lineitem l JOIN ({LATEST_ORDERS}) x ON x.l_orderkey = l.l_orderkey AND x.m = l.l_shipdate GROUP BY 1")
def child_version_join(t: Tables) -> DataFrame:
    parents = t.lineitem.groupBy("l_orderkey").agg(F.max("l_shipdate").alias("l_shipdate"))
    rows = v.with_parent_version(t.lineitem, parents, ["l_orderkey"], "l_shipdate")
    return rows.groupBy("l_orderkey").agg(F.count("*").alias("lines"), total("l_quantity").alias("quantity"))


@query("SELECT l_suppkey, CAST(sum(CAST(l_quantity AS DECIMAL(18,4))) AS DOUBLE) AS quantity, count(DISTINCT CAST(l_shipdate AS DATE)) AS days FROM (SELECT *, rank() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC) AS rk FROM lineitem) WHERE rk = 1 GROUP BY 1")
def child_totals_latest(t: Tables) -> DataFrame:
    return table(t).latest().groupBy("l_suppkey").agg(total("l_quantity").alias("quantity"), F.count_distinct(F.to_date("l_shipdate")).alias("days"))


@query("SELECT d.doc_id, sha256(coalesce(d.text, '')) <> sha256(coalesce(p.text, '')) AS changed FROM documents d JOIN documents p ON p.doc_id = d.doc_id - 1")
def text_hash_changed(t: Tables) -> DataFrame:
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    before = t.documents.select((F.col("doc_id") + 1).alias("doc_id"), digest.alias("old"))
    return t.documents.select("doc_id", digest.alias("new")).join(before, "doc_id").select("doc_id", (F.col("new") != F.col("old")).alias("changed"))


@query(f"SELECT i.l_orderkey, CAST(i.l_linenumber AS BIGINT) AS l_linenumber, i.l_quantity FROM ({INCOMING_SQL}) i JOIN ({STORED_SQL}) o ON o.l_orderkey = i.l_orderkey AND o.l_linenumber = i.l_linenumber WHERE i.l_quantity IS DISTINCT FROM o.l_quantity")
def field_changed(t: Tables) -> DataFrame:
    out = v.diff(stored(t), incoming(t), KEYS, ["l_quantity"]).where("status = 'revised'")
    return out.select("l_orderkey", long("l_linenumber").alias("l_linenumber"), "l_quantity")


def _signature_sql(where: str) -> str:
    return f"SELECT l_orderkey, string_agg(CAST(l_linenumber AS VARCHAR) || '|' || l_returnflag, ';' ORDER BY CAST(l_linenumber AS VARCHAR) || '|' || l_returnflag) AS sig FROM lineitem {where} GROUP BY 1"


@query(f"SELECT n.l_orderkey, n.sig FROM ({_signature_sql('')}) n LEFT JOIN ({_signature_sql(chr(87) + 'HERE l_shipdate < TIMESTAMP ' + chr(39) + '1999-01-01' + chr(39))}) o ON o.l_orderkey = n.l_orderkey WHERE n.sig IS DISTINCT FROM o.sig")
def signature_changed(t: Tables) -> DataFrame:
    cells = ["l_linenumber", "l_returnflag"]
    new = v.signature(t.lineitem, ["l_orderkey"], cells, "sig")
    old = v.signature(t.lineitem.where(F.col("l_shipdate") < F.lit(CUT)), ["l_orderkey"], cells, "sig")
    return v.diff(old, new, ["l_orderkey"], ["sig"]).where("status <> 'unchanged'").drop("status")


@query(f"SELECT i.l_orderkey, CAST(i.l_linenumber AS BIGINT) AS l_linenumber FROM (SELECT *, CASE WHEN l_returnflag <> 'R' THEN l_shipdate END AS u FROM ({INCOMING_SQL})) i LEFT JOIN (SELECT *, CASE WHEN l_returnflag <> 'R' THEN l_shipdate END AS u FROM ({STORED_SQL})) o ON o.l_orderkey = i.l_orderkey AND o.l_linenumber = i.l_linenumber AND o.u = i.u WHERE o.l_orderkey IS NULL")
def updated_at_changed(t: Tables) -> DataFrame:
    u = F.when(F.col("l_returnflag") != "R", F.col("l_shipdate"))
    old = stored(t).select(*KEYS, u.alias("u")).where("u is not null")
    new = incoming(t).select(*KEYS, u.alias("u")).join(old, [*KEYS, "u"], "left_anti")
    return new.select("l_orderkey", long("l_linenumber").alias("l_linenumber"))


@query("SELECT doc_id, CAST(NULL AS VARCHAR) AS text, source, n_chars FROM documents")
def blank_columns(t: Tables) -> DataFrame:
    return writers.blank_columns(t.documents, ["text"]).select("doc_id", "text", "source", "n_chars")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AND o_totalprice > (SELECT avg(p.o_totalprice) FROM orders p WHERE p.o_orderpriority = orders.o_orderpriority)")
def correlated_exists(t: Tables) -> DataFrame:
    t.orders.createOrReplaceTempView("tm_orders")
    t.lineitem.createOrReplaceTempView("tm_lines")
    return t.spark.sql(
        "SELECT o_orderkey, o_totalprice FROM tm_orders o WHERE EXISTS (SELECT 1 FROM tm_lines WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')"
        " AND o_totalprice > (SELECT avg(p.o_totalprice) FROM tm_orders p WHERE p.o_orderpriority = o.o_orderpriority)"
    )


@query("SELECT CAST(sum(CAST(l_tax * 100 AS DECIMAL(18,4))) AS DOUBLE) AS tax, CAST(sum(CAST(coalesce(q, 0) AS DECIMAL(18,4))) AS DOUBLE) AS q, count(m) AS m FROM (SELECT l_tax, CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_quantity END AS q, CAST(NULL AS BIGINT) AS m FROM lineitem)")
def default_columns(t: Tables) -> DataFrame:
    from tidemark.sources.readers import with_defaults

    df = t.lineitem.select((F.col("l_tax") * 100).alias("l_tax"), F.when(F.col("l_returnflag") != "R", F.col("l_quantity")).alias("q"))
    df = with_defaults(df, ["q", "m"], nullable=["m"])
    return df.agg(total("l_tax").alias("tax"), F.sum(dec("q")).cast("double").alias("q"), F.count("m").alias("m"))
