"""What needs a look: each kind of alert, and the cases that are none."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import attention


def march():
    return F.lit(dt.datetime(2024, 3, 1)).cast("timestamp_ntz")


MEDIA = "medium string, capacity bigint, used bigint, residual bigint, volumes int, with_room int, over_at timestamp_ntz"
SOON, LATER = dt.datetime(2024, 3, 20), dt.datetime(2024, 4, 20)


@pytest.mark.parametrize(
    "row,want",
    [
        ((0, 100, 100, 0, 0, SOON), None),  # no capacity, no alert
        ((100, 100, 0, 0, 0, None), ("red", "over capacity")),
        ((100, 100, 95, 3, 0, SOON), ("red", "over capacity")),  # full comes before all else
        ((100, 99, 99, 3, 0, SOON), ("red", "no room")),
        ((100, 99, 99, 3, 1, SOON), ("amber", "last volume")),
        ((100, 99, 99, 3, 2, SOON), None),  # a pool is near full by design
        ((100, 95, 90, 0, 0, None), ("amber", "retention pressure")),
        ((100, 95, 89, 0, 0, SOON), None),  # no longer filling
        ((100, 50, 10, 0, 0, SOON), ("amber", "capacity forecast")),
        ((100, 50, 10, 0, 0, LATER), None),
        ((100, 50, 10, 0, 0, None), None),
    ],
)
def test_media(spark, row, want):
    got = attention.medium_alerts(spark.createDataFrame([("m", *row)], MEDIA), march()).collect()
    assert [(r.severity, r.topic, r.subject) for r in got] == ([(*want, "m")] if want else [])


def test_stale_sources_of_a_host_are_one(spark):
    configured = spark.createDataFrame([("a", "h1"), ("b", "h1"), ("c", "h1"), ("d", "h2"), ("e", None), ("f", ""), ("g", None)], "dle string, host string")
    stale = spark.createDataFrame([(x,) for x in ("a", "b", "d", "e", "f", "unknown")], "dle string")
    assert sorted(r.subject for r in attention.stale_alerts(stale, configured).collect()) == ["d", "e", "f", "h1: 2 of 3", "unknown"]
    assert attention.stale_alerts(stale.limit(0), configured).count() == 0


@pytest.mark.parametrize(
    "short,facts,want",
    [
        ([("none", 1), ("backfill", 5)], (2, 1, 9), [("red", "copies")]),
        ([("backfill", 1)], (2, 1, 9), [("amber", "copies")]),
        ([("structural", 1), ("aged", 2)], (1, 0, 9), [("amber", "copies"), ("amber", "media"), ("amber", "offsite")]),
        ([("aged", 3)], (2, 1, 9), []),
        ([], (2, 1, 9), []),
        ([], (0, 0, 0), [("red", "copies"), ("amber", "media"), ("amber", "offsite")]),
    ],
)
def test_rules_of_copies(spark, short, facts, want):
    rows = spark.createDataFrame(short, "reason string, n bigint")
    fact = spark.createDataFrame([facts], "media bigint, offsite bigint, archives bigint")
    got = attention.copy_alerts(rows, F.col("media"), F.col("offsite"), F.col("archives"), fact).collect()
    assert [(r.severity, r.subject) for r in got] == want


def everything(spark, ledger, overdue, points, runs=(), sizes=(), slow=()):
    make, one = spark.createDataFrame, "dle string"
    media = make([("disk", 100, 100, 0, 0, 0, None)], MEDIA)
    copies = make([("amber", "media")], "severity string, subject string")
    configured = make([("a", "h"), ("b", "h")], "dle string, host string")
    got = attention.findings(
        make(runs, "command string, status string"), media, make(ledger, "dle string, ok boolean"), make(overdue, one), make(points, "dle string, run string, verdict string"), make([("a",)], one), configured, make(sizes, one), make(slow, one), copies, march()
    )
    return [(r.severity, r.topic, r.subject) for r in got.collect()]


def test_findings(spark):
    run = "run-2024-01-0{}.000000".format
    points = [("a", run(1), "base missing"), ("a", run(2), "complete"), ("b", run(1), "complete"), ("b", run(2), "no copy"), ("c", run(1), "cycle")]
    got = everything(spark, [("a", False), ("b", True)], [("a",), ("b",), ("c",)], points, [("dump", "FAILED"), ("sync", "WARNING"), ("drill", "OK")], [("a",)], [("b",)])
    assert got == [
        ("red", "drill failing", "a"), ("red", "failed", "dump"), ("red", "over capacity", "disk"), ("red", "unrestorable", "b"), ("red", "unrestorable", "c"),
        ("amber", "drill overdue", "2"), ("amber", "recoverability", "media"), ("amber", "size anomaly", "a"), ("amber", "slow dump", "b"), ("amber", "stale", "a"), ("amber", "warning", "sync"),
    ]


def test_failing_drills_are_not_overdue_too(spark):
    got = everything(spark, [("a", False)], [("a",)], [("a", "run-2024-01-01.000000", "complete")])
    assert ("red", "drill failing", "a") in got and not any(t == "drill overdue" for _, t, _ in got)
