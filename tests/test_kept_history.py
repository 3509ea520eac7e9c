"""Histories over days are those of each day's floor, and no copy has a row for each day it was kept."""

from __future__ import annotations

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import retention
from fleetlens.plans import queries as fleet
from fleetlens.plans import tables
from tests.helpers import COLUMNS, NOW, archive
from tests.test_chains_retention import many, slow_kept

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("days", [[11, 8, 5, 2], [13 - i / 10 for i in range(125)]])
def test_histories_match_the_floor_of_each_day(spark, monkeypatch, days):
    """Two media of which one has labels; commits out of run order, unknown commits, and more days than one number holds."""
    monkeypatch.setattr(retention, "kept_days", None)
    rows = [r for rows in many(range(500, 512)).values() for r in rows]
    rows = [(*r[:-1], None if i % 17 == 3 else r[-1] + dt.timedelta(days=5 * i % 4) if r[2][:4] in ("k500", "k504") else r[-1]) for i, r in enumerate(rows)]
    days = [NOW - dt.timedelta(days=d) for d in days]
    on = {"tape": rows, "disk": [r for i, r in enumerate(rows) if i % 3]}
    age = {"tape": 2, "disk": 3}
    held = None
    for m, own in on.items():
        copies = spark.createDataFrame(own, COLUMNS).withColumns({"medium": F.lit(m), "min_age_days": F.lit(age[m])})
        held = copies if held is None else held.unionByName(copies)
    kept = {(m, k): slow_kept(own, age[m], day) for m, own in on.items() for k, day in enumerate(days)}
    asked = spark.createDataFrame([(d,) for d in days], "day timestamp_ntz")
    size = {(m, r[1], r[2]): r[6] for m, own in on.items() for r in own}
    want = {(days[k], m): (sum(size[m, *c] for c in copies), len(copies)) for (m, k), copies in kept.items() if copies}
    assert {(r.day, r.medium): (r.protected, r.copies) for r in retention.protected_history(held, asked).collect()} == want

    runs = sorted({r[1] for r in rows})
    written = {f"T{i}": None if i == 4 else NOW - dt.timedelta(days=12 - 2 * i) for i in range(5)}
    labels = {(run, f"T{i % n}") for i, run in enumerate(runs) for n in (3, 5)}
    part_file = spark.createDataFrame([("tape", run, label) for run, label in labels] * 2 + [("disk", run, "") for run in runs], "medium string, run string, label string")
    volume = spark.createDataFrame(list(written.items()), "label string, written_at timestamp_ntz")
    got = {r.day: r.volumes for r in retention.volumes_in_use_history(held, asked, part_file, volume).collect()}
    wanted = {}
    for k, day in enumerate(days):
        on_day = {run for run, _ in kept["tape", k]}
        if used := {label for run, label in labels if run in on_day and (written[label] is None or written[label] <= day)}:
            wanted[day] = len(used)
    assert got == wanted and len(set(wanted.values())) > 1


def test_copies_without_labels_are_not_followed(spark, monkeypatch):
    asked = []
    block = retention._kept_block
    monkeypatch.setattr(retention, "_kept_block", lambda held, days: asked.append({r.medium for r in held.select("medium").distinct().collect()}) or block(held, days))
    held = spark.createDataFrame([archive("a", 5, 0), archive("a", 4, 1)], COLUMNS).withColumns({"medium": F.explode(F.array(F.lit("disk"), F.lit("tape"))), "min_age_days": F.lit(1)})
    parts = held.select("medium", "run", F.when(F.col("medium") == "tape", "T1").otherwise("").alias("label"))
    days = spark.createDataFrame([(NOW,)], "day timestamp_ntz")
    got = retention.volumes_in_use_history(held, days, parts, spark.createDataFrame([("T1", None)], "label string, written_at timestamp_ntz")).collect()
    assert [r.volumes for r in got] == [1] and asked == [{"tape"}]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are not here")
def test_parts_are_summed_not_written(spark, monkeypatch):
    """The query asks for no table of all parts."""
    asked = []
    seen = tables.Tables.__getattr__
    monkeypatch.setattr(tables.Tables, "__getattr__", lambda t, name: asked.append(name) or seen(t, name))
    assert fleet.QUERIES["volumes_in_use_history"](spark, FOLDER).count() == 20
    assert "archive" in asked and not {"part_file", "placement", "volume"} & set(asked)
