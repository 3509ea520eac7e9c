"""Streams with late events: the same events in ten orders and batchings, one order a key, must give what the batch form gives."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlens.streaming import live

START = dt.datetime(2024, 1, 1)
ORDERS, BATCHES = 10, 6


def at(seconds: float) -> dt.datetime:
    return START + dt.timedelta(seconds=seconds)


def shuffled(seed: int, rows: list[tuple]) -> list[list[tuple]]:
    """Batches in which each of ORDERS keys gets all rows, in an order and batching of its own."""
    rng = random.Random(seed)
    batches: list[list[tuple]] = [[] for _ in range(BATCHES)]
    for k in range(ORDERS):
        own = rng.sample(rows, len(rows))
        cuts = sorted(rng.choices(range(len(own) + 1), k=BATCHES - 1))
        for batch, a, b in zip(batches, [0, *cuts], [*cuts, len(own)], strict=True):
            batch += [(f"o{k}", *r) for r in own[a:b]]
    return batches


def streamed(spark, folder, batches, schema, operator, mode):
    """(batch number, row) of all that operator gives for a stream of the batches."""
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(folder / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))
    out: list[tuple] = []
    q = operator(stream).writeStream.outputMode(mode).foreachBatch(lambda df, i: out.extend((i, r) for r in df.collect())).option("checkpointLocation", str(folder / "ck")).start()
    q.processAllAvailable()
    q.stop()
    return out


INTERVAL = "lane string, begin_at timestamp, end_at timestamp, bytes bigint"


def test_lanes_in_any_order(spark, tmp_path):
    rng = random.Random(1)
    rows = [(at(b), at(b + rng.randint(0, 60)), rng.randint(1, 99)) for b in (rng.randint(0, 1000) for _ in range(40))]
    got = streamed(spark, tmp_path, shuffled(2, rows), INTERVAL, lambda s: live.lane_busy_stream(s, "lane", "10 days"), "update")
    last = {r.lane: tuple(r)[1:] for _, r in got}
    batch = live.lane_busy(spark.createDataFrame([("x", *r) for r in rows], INTERVAL), "lane").first()
    assert last == {f"o{k}": (batch.busy, batch.wall, batch.bytes, batch.rate, batch.utilisation, 0) for k in range(ORDERS)}


def test_lanes_with_rows_behind_the_watermark(spark, tmp_path):
    batches = [[("a", at(0), at(10), 1), ("a", at(20), at(30), 1)], [("a", at(5), at(25), 1)], [("a", at(1000), at(1010), 1)], [("a", at(31), at(32), 7), ("a", at(950), at(1005), 1)]]
    got = streamed(spark, tmp_path, batches, INTERVAL, lambda s: live.lane_busy_stream(s, "lane", "100 seconds"), "update")
    assert [(r.busy, r.wall, r.bytes, r.late) for _, r in got] == [(20, 30, 2, 0), (30, 30, 3, 0), (40, 1010, 4, 0), (90, 1010, 5, 1)]


def test_united():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 30):
        b = rng.integers(0, 50, n)
        e = b + rng.integers(0, 5, n)
        x, y = live.united(b, e)
        assert {t for p, q in zip(x, y, strict=True) for t in range(p, q)} == {t for p, q in zip(b, e, strict=True) for t in range(p, q)}
        assert (x[1:] > y[:-1]).all() and (x <= y).all()


SAMPLE = "run string, ts timestamp, used bigint"


def test_rates_at_every_tick(spark, tmp_path):
    rng = random.Random(3)
    times = sorted(rng.sample(range(200), 45))
    rows = [(at(t), sum(rng.randint(0, 9) for _ in range(t)) if rng.random() < 0.9 else 5) for t in times]
    batches = shuffled(4, rows)
    got = streamed(spark, tmp_path, batches, SAMPLE, lambda s: live.rate_stream(s, "run", "10 days"), "update")
    ticks = [[r for b in batches[: i + 1] for r in b] for i in range(BATCHES)]
    seen = {(i, r.run): r.rate for i, r in got}
    for i, so_far in enumerate(ticks):
        for key in {r[0] for r in batches[i]}:
            own = spark.createDataFrame([r for r in so_far if r[0] == key], SAMPLE) if i in (0, 2, BATCHES - 1) and key in ("o0", "o1", "o2") else None
            if own is not None:
                assert seen[i, key] == live.rate_now(own, own.agg(F.max("ts")), "run").first().rate
    final = {k: v for (i, k), v in sorted(seen.items())}
    assert len(set(final.values())) == 1 and len(final) == ORDERS


def test_rates_fall_to_nothing(spark, tmp_path):
    batches = [[("a", at(0), 0), ("a", at(10), 100), ("b", at(10), 0)], [("b", at(35), 50)], [("b", at(60), 60)], [("a", at(70), 400), ("b", at(61), 70)]]
    got = streamed(spark, tmp_path, batches, SAMPLE, lambda s: live.rate_stream(s, "run", "5 seconds"), "update")
    base = int(START.replace(tzinfo=dt.UTC).timestamp())
    assert [(r.run, r["at"] - base, r.rate) for _, r in got if r.run == "a"] == [("a", 10, 10.0), ("a", 40, 0.0), ("a", 70, 5.0)]


USAGE = "medium string, seq bigint, at timestamp, used bigint"


def test_usage_in_any_order_with_falls(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, at(h * 3600), rng.choice([0, 5, 7])) for i, h in enumerate(sorted(rng.sample(range(24 * 20), 60)))]
    flush = [[("zz", 0, at(86400 * 100), 1)], [("zz", 1, at(86400 * 100 + 60), 1)]]
    silence = 12 * 3600
    got = streamed(spark, tmp_path, shuffled(6, rows) + flush, USAGE, lambda s: live.usage_changes_stream(s, silence, "40 days"), "append")
    usage = spark.createDataFrame([("x", *r) for r in rows], USAGE)
    want = sorted((r["at"], r.seq, r.used) for r in live.usage_changes(live.with_silences(usage, silence, F.lit(at(86400 * 60)))).collect())
    assert sum(r[1] == -1 for r in want) >= 3 and want[-1][2] == 0
    for k in range(ORDERS):
        assert sorted((r["at"], r.seq, r.used) for _, r in got if r.medium == f"o{k}") == want
    assert [r.seq for _, r in got if r.medium == "zz"] == []


def test_a_medium_that_stops_reporting_falls_once(spark, tmp_path):
    batches = [[("a", 1, at(0), 5), ("b", 2, at(0), 7)], [("b", 3, at(400), 7)], [("b", 4, at(800), 8)], [("b", 5, at(1200), 8)], [("a", 6, at(1300), 5), ("b", 7, at(1600), 8)], [("b", 8, at(1700), 8)]]
    got = streamed(spark, tmp_path, batches, USAGE, lambda s: live.usage_changes_stream(s, 500, "10 seconds"), "append")
    shown = [(r.medium, r.seq, (r["at"] - START).total_seconds(), r.used) for _, r in got]
    assert sorted(shown) == [("a", -1, 500.0, 0), ("a", 1, 0.0, 5), ("a", 6, 1300.0, 5), ("b", 2, 0.0, 7), ("b", 4, 800.0, 8)]


EVENT = "source string, ts timestamp, bytes bigint"


def written(spark, folder, batches, gap, delay):
    """(sessions that stand, late events) of a stream of the batches."""
    for batch in batches:
        spark.createDataFrame(batch, EVENT).coalesce(1).write.mode("append").parquet(str(folder / "in"))
    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))
    q = live.write_sessions(live.sessions_stream(stream, "source", gap, delay), str(folder / "out"), str(folder / "late"), str(folder / "ck"))
    q.processAllAvailable()
    q.stop()
    return live.standing_sessions(spark.read.parquet(str(folder / "out")), "source").collect(), [(r.source, r.ts, r.bytes) for r in spark.read.parquet(str(folder / "late")).collect()]


def session(r):
    return (r.source, r.begin, r.end, r.events, r.bytes)


def test_sessions_and_their_late_rows(spark, tmp_path):
    rng = random.Random(7)
    rows = [(f"s{rng.randrange(3)}", at(rng.randint(0, 3000)), rng.randint(1, 9)) for _ in range(120)]
    rows.sort(key=lambda r: r[1] + dt.timedelta(seconds=rng.choice([0, 0, 30, 400, 900])))  # some come late, a few too late
    got, late = written(spark, tmp_path, [rows[i : i + 20] for i in range(0, 120, 20)], 50, "60 seconds")
    kept = list(rows)
    for r in late:
        kept.remove(r)
    assert 0 < len(late) < 40 and len(kept) + len(late) == 120
    assert sorted(map(session, got)) == sorted(map(session, live.activity_sessions(spark.createDataFrame(kept, EVENT), "source", 50).collect()))


def test_sessions_in_any_order(spark, tmp_path):
    rng = random.Random(8)
    rows = [(at(t), rng.randint(1, 9)) for t in rng.choices(range(0, 3000, 10), k=60)]
    got, late = written(spark, tmp_path, shuffled(9, rows), 50, "10 days")
    want = [session(r)[1:] for r in live.activity_sessions(spark.createDataFrame([("x", *r) for r in rows], EVENT), "source", 50).collect()]
    assert late == [] and len(want) > 5
    assert sorted(map(session, got)) == sorted((f"o{k}", *w) for k in range(ORDERS) for w in want)


@pytest.mark.parametrize("silence", [1, 10**6])
def test_silences_of_nothing(spark, silence):
    assert live.with_silences(spark.createDataFrame([], USAGE), silence, F.lit(START)).count() == 0
