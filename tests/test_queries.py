"""Every query of the catalogue against its SQL in DuckDB."""

from __future__ import annotations

import os

import duckdb
import pytest

from tidemark.plans.catalogue import ORACLE, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{data}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def normal(rows):
    return sorted(tuple(repr(round(x, 6) + 0.0) if isinstance(x, float) else str(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(name, spark, duck, data):
    df = QUERIES[name](spark, data)
    columns = sorted(df.columns)
    found = duck.execute(f"SELECT {', '.join(f'"{c}"' for c in columns)} FROM ({ORACLE[name]}) q")
    kinds = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE", "boolean": "BOOLEAN"}
    assert [kinds.get(df.schema[c].dataType.simpleString()) for c in columns] == [str(d[1]) for d in found.description]
    assert normal(df.select(*[f"`{c}`" for c in columns]).collect()) == normal(found.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_other_queries_give_rows(name, spark, data):
    assert QUERIES[name](spark, data).count() > 0


def test_entry_module(spark, data):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 7


def test_day_windows_reach_the_scan(spark, data):
    plan = QUERIES["lookback_90"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in plan


def test_latest_version_takes_one_shuffle(spark, data):
    plan = QUERIES["latest_version_keep_ties"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_longest_opening_tells_letters_apart_as_its_sql_does(spark, tmp_path):
    texts = {
        1: "GROSSE STRASSE. eine Große Straße", 2: "grosse strasse", 3: "straße am, strasze am", 4: "ΟΔΟΣ ΜΟΥ und οδος μου", 5: "οδοσ μου", 6: "οδος μου", 7: "İzmir von hier", 8: "izmir von", 9: "maß ab mass ab", 10: "mass abc maß ab", 11: None, 12: "ohne wert und eine große",
    }
    rows = [*texts.items(), (None, "GROSSE STRASSE"), (None, "maß ab"), (13, "maß ab"), (13, "izmir von")]
    items = [(1, "Große Straße"), (2, "grosse strasse!"), (3, "strasze am"), (4, "Straße am"), (5, "ΟΔΟΣ ΜΟΥ"), (6, "izmir von"), (7, "İzmir von hier an"), (8, "maß ab"), (9, "mass ab"), (10, "mass abc"), (11, "eine große"), (None, "und eine große Straße"), (None, "ohne wert und eine"), (12, None), (13, "maß")]
    con = duckdb.connect()
    for name, key, made in (("documents", "doc_id", rows), ("benchmark", "item_id", items)):
        spark.createDataFrame(made, f"{key} bigint, text string").coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = QUERIES["longest_opening"](spark, str(tmp_path)).collect()
    assert normal(got) == normal(con.execute(ORACLE["longest_opening"]).fetchall())
    assert len(got) == 16 and sum(r["item_id"] is not None for r in got) >= 12
