"""Readers of the inputs' formats, with explicit schemas; nothing infers types from data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.text import html_to_text
from tidemark.operators.guards import header_drift


def snapshot(spark: SparkSession, path: str) -> DataFrame:
    """A table at a pinned path: writers never change a path's files, so a reader sees one version."""
    return spark.read.parquet(path)


def with_defaults(df: DataFrame, columns: Sequence[str], nullable: Sequence[str] = ()) -> DataFrame:
    """The columns in order: missing ones are 0, or null if nullable; nulls of the others count as 0."""
    out = []
    for c in columns:
        if c not in df.columns:
            out.append((F.lit(None) if c in nullable else F.lit(0)).cast("long").alias(c))
        else:
            out.append(F.col(c) if c in nullable else F.coalesce(F.col(c), F.lit(0)).alias(c))
    return df.select(*[c for c in df.columns if c not in columns], *out)


def csv_rows(spark: SparkSession, path: str, required: Sequence[str], counts: Sequence[str] = ()) -> DataFrame:
    """A CSV with a header: cells trimmed, blanks null, a byte-order mark dropped, counts such as ``600.0`` whole.

    Raises if a required column is missing; more columns are kept as text.
    """
    df = spark.read.csv(path, header=True, inferSchema=False, encoding="UTF-8", multiLine=True)
    df = df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])
    header_drift(df, required)
    clean = {c: F.when(F.trim(F.col(f"`{c}`")) != "", F.trim(F.col(f"`{c}`"))) for c in df.columns}
    return df.select(*[(v.try_cast("double").cast("long") if c in counts else v).alias(c) for c, v in clean.items()])


def weekly_counts(spark: SparkSession, path: str, day: str, total: str, counts: Sequence[str]) -> DataFrame:
    """A CSV of weeks (``dd.mm.yyyy``): blank counts are 0, rows with a blank total go."""
    df = csv_rows(spark, path, [day, total, *counts])
    number = {c: F.coalesce(F.col(c).try_cast("double").cast("long"), F.lit(0)).alias(c) for c in counts}
    return df.where(F.col(total).isNotNull()).select(F.to_date(day, "dd.MM.yyyy").alias(day), F.col(total).cast("double").cast("long").alias(total), *number.values())


def weekly_estimates(spark: SparkSession, path: str, day: str, values: Sequence[str]) -> DataFrame:
    """A CSV of weeks with estimates; rows on which all values are blank go."""
    df = csv_rows(spark, path, [day, *values])
    return df.where(F.coalesce(*[F.col(v) for v in values]).isNotNull()).select(F.to_date(day, "dd.MM.yyyy").alias(day), *[F.col(v).try_cast("double").alias(v) for v in values])


def json_array(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A file with one JSON array of objects."""
    return spark.read.json(path, schema=schema, multiLine=True)


TARGETS = "struct<dataCollectedAt:string,lastUpdated:string,personnel:struct<killed:bigint,wounded:bigint>,flights:struct<strike:bigint,recon:bigint>,totalTargetsHit:bigint,totalTargetsDestroyed:bigint,totalPersonnelCasualties:bigint,targetsByType:array<struct<targetClassId:int,hit:bigint,destroyed:bigint>>>"


def nested_record(body: Column, zone: str = "Europe/Kyiv") -> Column:
    """The flat record of an API's JSON answer, targets by id as maps, the time of collection in ``zone``."""
    d = F.from_json(body, f"struct<data:{TARGETS}>")["data"]
    by_id = lambda name: F.map_from_entries(F.transform(d["targetsByType"], lambda t: F.struct(t["targetClassId"], t[name])))
    return F.struct(
        F.from_utc_timestamp(F.try_to_timestamp(d["dataCollectedAt"]), zone).alias("collected_at"), d["lastUpdated"].alias("last_updated"),
        d["personnel"]["killed"].alias("personnel_killed"), d["personnel"]["wounded"].alias("personnel_wounded"), d["flights"]["strike"].alias("flights_strike"), d["flights"]["recon"].alias("flights_recon"),
        d["totalTargetsHit"].alias("total_targets_hit"), d["totalTargetsDestroyed"].alias("total_targets_destroyed"), d["totalPersonnelCasualties"].alias("total_personnel_casualties"),
        by_id("hit").alias("hit"), by_id("destroyed").alias("destroyed"),
    )


def positional(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Columns renamed by place, for sheets whose headers change; surplus columns go."""
    return df.select(*[F.col(f"`{old}`").alias(new) for old, new in zip(df.columns, names, strict=False)])


def repeated_groups(df: DataFrame, keys: Sequence[str], groups: dict[str, Sequence[str]]) -> DataFrame:
    """Repeated column groups as rows: ``groups`` names each output column's source columns, in order; blank groups go."""
    zipped = F.arrays_zip(*[F.array(*[F.col(c) for c in cols]).alias(name) for name, cols in groups.items()])
    out = df.select(*keys, F.explode(zipped).alias("g")).select(*keys, *[F.col("g")[name].alias(name) for name in groups])
    return out.where(F.coalesce(*[F.col(n) for n in groups]).isNotNull())


def saved_pages(spark: SparkSession, path: str) -> DataFrame:
    """Saved HTML files as (path, html)."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.decode("content", "UTF-8").alias("html"))


def timeline_posts(pages: DataFrame, html: str = "html", known: DataFrame | None = None, newest: int | None = None) -> DataFrame:
    """Posts of saved timeline pages as (post_id, posted_at, text), each once, newer than ``newest`` and not ``known``."""
    post = r'(?s)data-post="[^"]*?(\d+)".*?<div class="text">(.*?)</div>.*?<time datetime="([^"]+)"'
    found = pages.select(F.explode(F.regexp_extract_all(html, F.lit(post), F.lit(0))).alias("p"))
    rows = found.select(F.regexp_extract("p", post, 1).cast("long").alias("post_id"), F.try_to_timestamp(F.regexp_extract("p", post, 3)).alias("posted_at"), html_to_text(F.regexp_extract("p", post, 2)).alias("text"))
    rows = rows.groupBy("post_id").agg(F.max(F.struct("posted_at", "text")).alias("r")).select("post_id", "r.posted_at", "r.text")
    if newest is not None:
        rows = rows.where(F.col("post_id") > newest)
    return rows if known is None else rows.join(known.select("post_id"), "post_id", "left_anti")


def script_blobs(js: Column) -> Column:
    """The JSON texts in a script's ``JSON.parse('…')`` calls, quotes unescaped."""
    found = F.regexp_extract_all(js, F.lit(r"JSON\.parse\('((?:[^'\\]|\\.)*)'\)"), F.lit(1))
    return F.transform(found, lambda x: F.replace(F.replace(x, F.lit("\\'"), F.lit("'")), F.lit("\\\\"), F.lit("\\")))


def mirrored(posts: DataFrame, day: str, since: str | None = None, until: str | None = None, flags: Sequence[str] = ("pinned", "repost", "reply")) -> DataFrame:
    """Posts of their author alone, within inclusive days."""
    for f in flags:
        posts = posts.where(~F.coalesce(F.col(f), F.lit(False)))
    if since:
        posts = posts.where(F.col(day) >= F.lit(since).cast("date"))
    return posts.where(F.col(day) <= F.lit(until).cast("date")) if until else posts


def new_slugs(listing: DataFrame, url: str, order: str, pattern: str, known: DataFrame) -> DataFrame:
    """URLs that match, each at its first place, without known ones."""
    found = listing.where(F.col(url).rlike(pattern)).groupBy(url).agg(F.min(order).alias(order))
    return found.join(known.select(url), url, "left_anti")
