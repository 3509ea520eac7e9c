"""Registered queries run, and agree with their SQL, on the smallest driver tables."""

from __future__ import annotations

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from fleetlens.plans import more as more  # registers its queries
from fleetlens.plans import queries as fleet

FOLDER = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are not here")


def shown(v) -> str:
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return "null"
    if isinstance(v, float):
        return str(int(v)) if v == int(v) and abs(v) < 1e15 else f"{v:.5f}"
    return str(v)


def rows(df: pd.DataFrame) -> tuple[list[str], list[tuple]]:
    df = df[sorted(df.columns)]
    return list(df.columns), sorted(tuple(map(shown, r)) for r in df.itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(fleet.QUERIES))
def test_query(spark, duck, name):
    got = fleet.QUERIES[name](spark, FOLDER).toPandas()
    if name in fleet.ORACLE:
        assert rows(got) == rows(duck.execute(fleet.ORACLE[name]).df())
    else:
        assert len(got.columns) > 0


def test_thin_usage_at_its_age(spark, tmp_path):
    """Samples of exactly the age are young, whichever engine asks."""
    con = duckdb.connect()
    for t in TABLES:
        if t != "events":
            os.symlink(f"{FOLDER}/{t}.parquet", tmp_path / f"{t}.parquet")
    aged = "timestamp '2024-01-22 00:00:00'"
    con.execute(f"copy (select * replace (e.event_id + 1000000 * i as event_id, case when event_id % 3 = 0 then {aged} when event_id % 3 = 1 then {aged} - interval 1 second else ts end as ts) from '{FOLDER}/events.parquet' e, range(2) r(i)) to '{tmp_path}/events.parquet'")
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet'")
    got = fleet.QUERIES["thin_usage"](spark, str(tmp_path)).toPandas()
    assert con.execute("select count(*) > 500 from events").fetchall()[0][0]
    assert (got["at"] == pd.Timestamp("2024-01-22")).sum() == con.execute(f"select count(*) from events where ts = {aged}").fetchall()[0][0]
    assert rows(got) == rows(con.execute(fleet.ORACLE["thin_usage"]).df())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(fleet.QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
