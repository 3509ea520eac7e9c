"""What attention_list asks of a large fleet: the newest points, lost archives and floors from one list a source, and each table worked out once."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import attention, chains, placement, retention, trends
from fleetlens.plans.tables import NOW as DRIVER_NOW
from tests.helpers import NOW
from tests.test_chains_retention import frame, many, now


@pytest.fixture(params=[1024, 3])
def catalogs(spark, request, monkeypatch):
    """Random catalogs whose sources are all worked on as lists, or mostly by rounds."""
    monkeypatch.setattr(chains, "LONG", request.param)
    return frame(spark, [r for rows in many(range(25)).values() for r in rows])


def copies_of(df):
    """Copies of most archives on one or two media."""
    n = F.pmod(F.xxhash64("dle", "run"), F.lit(5))
    media = F.when(n == 0, F.array().cast("array<string>")).when(n < 3, F.array(F.lit("disk"))).otherwise(F.array(F.lit("disk"), F.lit("tape")))
    return df.select("run", "dle", "level", F.explode(media).alias("medium"))


def rows_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_lost_archives(catalogs):
    columns = ["dle", "run", "level", "stranded"]
    got = rows_of(chains.lost(catalogs), *columns)
    assert got == rows_of(chains.stranded(chains.base_of(catalogs)), *columns) and {r[3] for r in got} == {True, False}


def test_newest_points(catalogs):
    copies = copies_of(catalogs)
    every = {}
    for r in chains.recovery_points(catalogs, copies).collect():
        every[r.dle] = max(every.get(r.dle, ()), (r.run, r.level, r.links, r.verdict))
    copied = placement.with_media(catalogs, copies, ["run", "dle", "level"])
    got = chains.newest_points(copied.withColumn("copy", F.size("media") > 0)).collect()
    assert {r.dle: (r.run, r.level, r.links, r.verdict) for r in got} == every and len(got) == len(every)


def test_newest_points_walk_cycles_and_long_chains(spark):
    run = "run-2024-01-{:02d}.000000".format
    rows = [("a", run(1), 0, None, True), *(("a", run(i), 1, run(i - 1), True) for i in range(2, 25)), ("b", run(1), 1, run(2), True), ("b", run(2), 1, run(1), True)]
    rows += [("c", run(1), 1, "run-1990-01-01.000000", True), ("d", run(1), 0, None, False), ("d", run(2), 1, run(1), True), ("e", run(1), 1, None, True), ("f", run(1), 1, run(1), False)]
    nodes = spark.createDataFrame(rows, "dle string, run string, level int, base_run string, copy boolean")
    got = {r.dle: (r.verdict, r.links) for r in chains.newest_points(nodes).collect()}
    assert got == {"a": ("complete", 24), "b": ("cycle", 2), "c": ("base missing", 1), "d": ("no copy", 2), "e": ("base missing", 1), "f": ("cycle", 1)}


def test_floor_of_archives(spark, catalogs):
    dim = spark.createDataFrame([("disk", 100, 3, False), ("tape", 0, 0, True)], "medium string, capacity bigint, min_age_days int, labeled boolean")
    copies = copies_of(catalogs)
    want = retention.retention_floor(retention.held_archives(catalogs, copies, dim), chains.stranded(chains.base_of(catalogs)), now())
    got = retention.floor_of_archives(placement.with_media(catalogs, copies, ["run", "dle", "level"]), dim, now())
    columns = ["medium", "dle", "run", "level", F.coalesce("kind", F.lit("")), "compressed", "labeled"]
    assert rows_of(got, *columns) == rows_of(want, *columns)


def test_classes_of_short_archives_alone(spark, catalogs):
    copies = copies_of(catalogs)
    route = catalogs.select("dle", F.lit("disk").alias("medium")).distinct()
    rules = spark.createDataFrame([("", "tape", 2), ("disk", "cloud", 3)], "src string, dst string, last_n int")
    dim = spark.createDataFrame([("disk", 100, 3, False), ("tape", 0, 0, True), ("cloud", 0, 9, False)], "medium string, capacity bigint, min_age_days int, labeled boolean")
    short = placement.short_of(placement.with_media(catalogs, copies, ["run", "dle", "level"]))
    every = placement.copy_class(catalogs, copies, route, rules, dim, now())
    own = placement.copy_class(catalogs, copies, route, rules, dim, now(), of=short)
    columns = ["run", "dle", "level", "medium", "class"]
    assert rows_of(own, *columns) == rows_of(every.join(short, ["run", "dle", "level"], "left_semi"), *columns)
    reasons = ["reason", "n", "least", "first_run", "first_dle"]
    assert rows_of(placement.short_posture(short, own), *reasons) == rows_of(placement.copies_posture(catalogs, every, copies), *reasons)


def test_dumps_of_the_newest_run(spark):
    rows = [(dle, f"r{i}", i, 0, 10 << 30 if (dle, i) == ("a", 6) else 1 << 30, 100) for dle, last in (("a", 6), ("b", 5)) for i in range(last + 1)]
    dumps = spark.createDataFrame(rows, "dle string, run_id string, ended_at int, level int, orig bigint, seconds bigint")
    near = trends.of_newest_run(dumps)
    assert {r.dle for r in near.collect()} == {"a"} and near.count() == 7
    assert rows_of(trends.size_anomalies(near), "dle", "kind") == rows_of(trends.size_anomalies(dumps), "dle", "kind") == [("a", "grown")]


def test_findings_work_each_table_out_once(spark, monkeypatch):
    """Media were worked out for each topic, rules of copies for each severity, last runs for each status: all that stands behind them ran as often."""
    plans = []
    monkeypatch.setattr(attention, "cut", lambda df: plans.append(df) or df, raising=False)
    table = lambda n, *columns: spark.range(n).selectExpr(*columns)
    media = table(1001, "'m' as medium", "100L as capacity", "id as used", "id as residual", "1 as volumes", "1 as with_room", f"timestamp_ntz '{DRIVER_NOW}' as over_at")
    copies = table(1002, "if(id > 1, 'red', 'amber') as severity", "string(id) as subject")
    runs = table(1003, "string(id) as command", "if(id > 1, 'FAILED', 'WARNING') as status")
    one = table(1004, "string(id) as dle")
    points = table(1005, "string(id) as dle", "'r' as run", "'no copy' as verdict")
    out = attention.findings(runs, media, one.withColumn("ok", F.lit(False)), one, points, one, one.withColumn("host", F.lit("h")), one, one, copies, F.lit(str(NOW)).cast("timestamp_ntz"))
    plan = out._jdf.queryExecution().analyzed().toString()
    assert {n: plan.count(f"Range (0, {n},") for n in (1001, 1002, 1003, 1005)} == {1001: 1, 1002: 1, 1003: 1, 1005: 1}
