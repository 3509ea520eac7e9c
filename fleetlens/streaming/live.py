"""Live views of running backups, as Structured Streaming queries with batch forms of the same rules."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions import columns as C
from fleetlens.plans.lineage import preceding

#: Reach of the current rate in seconds, and the least time it is taken over.
RATE_SECONDS, LEAST_SECONDS = 30, 1


def latest_progress(events: DataFrame) -> DataFrame:
    """(run, dle, done, total, state) as of the newest event of each source; works on streams (complete or update mode) and tables alike."""
    return events.groupBy("run", "dle").agg(F.max_by(F.struct("done", "total", "state"), "seq").alias("p")).select("run", "dle", "p.*")


def progress_totals(latest: DataFrame) -> DataFrame:
    """(run, dles, finished, done, total, percent) of each run."""
    out = latest.groupBy("run").agg(F.count("*").alias("dles"), F.sum((F.col("state") == "done").cast("long")).alias("finished"), F.sum("done").alias("done"), F.sum("total").alias("total"))
    return out.withColumn("percent", F.when(F.col("total") > 0, F.least(F.lit(100), F.expr("done * 100 div total"))).otherwise(0).cast("long"))


def stage_split(latest: DataFrame) -> DataFrame:
    """(run, landed, holding, in_flight, to_go): bytes by where they are."""
    part = lambda c, v: F.coalesce(F.sum(F.when(c, v)), F.lit(0)).cast("long")
    s, done, total = F.col("state"), F.col("done"), F.col("total")
    rest = F.greatest(total - done, F.lit(0))
    return latest.groupBy("run").agg(part(s == "done", done).alias("landed"), part(s == "holding", done).alias("holding"), part(s == "dumping", done).alias("in_flight"), part(s.isin("dumping", "waiting"), rest).alias("to_go"))


def write_progress(stream: DataFrame, path: str, checkpoint: str):
    """Start writing the progress totals of a stream of events to path: each batch replaces them."""

    def batch(df: DataFrame, _: int) -> None:
        progress_totals(df).write.mode("overwrite").parquet(path)

    return latest_progress(stream).writeStream.outputMode("complete").foreachBatch(batch).option("checkpointLocation", checkpoint).start()


def sliding_rate(events: DataFrame, key: str) -> DataFrame:
    """(key, begin, bytes, rate): bytes a second in windows of 30 seconds every 2; late events wait for the watermark."""
    w = F.window("ts", f"{RATE_SECONDS} seconds", "2 seconds")
    out = events.withWatermark("ts", "1 minute").groupBy(F.col(key), w.alias("w")).agg(F.sum("bytes").alias("bytes"))
    return out.select(key, F.col("w.start").alias("begin"), "bytes", (F.col("bytes") / RATE_SECONDS).alias("rate"))


def rate_now(samples: DataFrame, now: DataFrame, key: str) -> DataFrame:
    """(key, rate): at the instant that the one row of `now` holds, the difference of the newest sample and the newest one at least 30 seconds older (else the oldest), a second; 0 where stale, falling or under a second. samples has key, ts, used (a running counter)."""
    at = C.epoch("ts")
    order = F.struct(at.alias("at"), "used")
    newest = samples.groupBy(key).agg(F.max(order).alias("new"), F.min(order).alias("old"))
    rows = samples.join(newest, key).filter(at <= F.col("new.at") - RATE_SECONDS)
    base = rows.groupBy(key).agg(F.max(order).alias("base"))
    both = newest.join(base, key, "left").withColumn("from", F.coalesce("base", "old")).join(F.broadcast(now.toDF("now")), F.lit(True))
    seconds, moved = F.col("new.at") - F.col("from.at"), F.col("new.used") - F.col("from.used")
    fresh = C.epoch("now") - F.col("new.at") <= RATE_SECONDS
    return both.select(key, F.when(fresh & (seconds >= LEAST_SECONDS) & (moved > 0), F.round(moved / seconds, 6)).otherwise(F.lit(0.0)).alias("rate"))


def lane_busy(intervals: DataFrame, key: str) -> DataFrame:
    """(key, busy, wall, bytes, rate, utilisation): time a lane had a writer, overlaps counted once. intervals has key, begin_at, end_at, bytes."""
    # Equal intervals are one: the second adds no time, and the order tells all others apart.
    rows = intervals.groupBy(key, C.epoch("begin_at").alias("_b"), C.epoch("end_at").alias("_e")).agg(F.sum("bytes").alias("bytes"))
    rows = preceding(rows, [key], [F.col("_b"), F.col("_e")], {"_reach": (F.max, "_e")})
    gained = F.greatest(F.lit(0), F.col("_e") - F.greatest("_b", F.coalesce("_reach", "_b")))
    out = rows.withColumn("_g", gained).groupBy(key).agg(F.sum("_g").alias("busy"), (F.max("_e") - F.min("_b")).alias("wall"), F.sum("bytes").alias("bytes"))
    return out.select(key, "busy", "wall", "bytes", F.when(F.col("busy") > 0, F.round(F.col("bytes") / F.col("busy"), 6)).otherwise(F.lit(0.0)).alias("rate"), F.when(F.col("wall") > 0, F.round(F.least(F.lit(1.0), F.col("busy") / F.col("wall")), 6)).otherwise(F.lit(0.0)).alias("utilisation"))


def _instant(ts: str) -> Column:
    """Whole seconds of an instant, as watermarks count them."""
    return F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / 1_000_000).cast("long")


def united(begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The disjoint intervals that cover what the given ones do, in order."""
    order = np.lexsort((ends, begins))
    begins, ends = begins[order], np.maximum.accumulate(ends[order])
    first = np.concatenate(([True], begins[1:] > ends[:-1]))[: len(begins)]
    return begins[first], ends[np.concatenate((first[1:], [True]))[: len(begins)]]


def _busy(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """State: disjoint intervals that a later one may still touch, seconds of those behind them, first begin, last end, bytes, late rows."""
    begins, ends, closed, first, last, size, late = state.get if state.exists else ([], [], 0, None, None, 0, 0)
    pdf = pd.concat(list(batches))
    mark = state.getCurrentWatermarkMs() // 1000
    on_time = pdf[pdf["b"] >= mark]
    late += len(pdf) - len(on_time)
    b, e = united(np.concatenate((begins, on_time["b"].to_numpy())).astype(np.int64), np.concatenate((ends, on_time["e"].to_numpy())).astype(np.int64))
    if len(on_time):
        first = min(x for x in (first, int(on_time["b"].min())) if x is not None)
        last = max(x for x in (last, int(on_time["e"].max())) if x is not None)
        size += int(on_time["bytes"].sum())
    done = e < mark  # nothing that begins from now on touches these
    closed += int((e - b)[done].sum())
    b, e = b[~done], e[~done]
    state.update((b.tolist(), e.tolist(), closed, first, last, size, late))
    busy, wall = closed + int((e - b).sum()), (last - first) if first is not None else 0
    rate, used = round(size / busy, 6) if busy > 0 else 0.0, round(min(1.0, busy / wall), 6) if wall > 0 else 0.0
    yield pd.DataFrame({"lane": [key[0]], "busy": [busy], "wall": [wall], "bytes": [size], "rate": [rate], "utilisation": [used], "late": [late]})


def lane_busy_stream(intervals: DataFrame, key: str, delay: str = "10 minutes") -> DataFrame:
    """lane_busy of a stream (update mode), with the number of intervals left out as too late: those that begin before the watermark, `delay` behind the latest begin.

    Intervals may come in any order and batching. A lane keeps disjoint intervals, into
    which each one is merged as it comes; those that end before the watermark are summed up
    and forgotten, so the state is as long as the gaps of the last `delay`.
    """
    rows = intervals.withWatermark("begin_at", delay).select(F.col(key).cast("string").alias("lane"), "begin_at", _instant("begin_at").alias("b"), _instant("end_at").alias("e"), F.col("bytes").cast("long").alias("bytes"))
    out = rows.groupBy("lane").applyInPandasWithState(
        _busy, "lane string, busy long, wall long, bytes long, rate double, utilisation double, late long", "begins array<long>, ends array<long>, closed long, first long, last long, size long, late long", "update", "NoTimeout"
    )
    return out.withColumnRenamed("lane", key)


def _rate(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """State: samples of the last RATE_SECONDS before the newest one, and the one before them; whether they were told to be stale."""
    at, used, fallen = state.get if state.exists else ([], [], True)
    at, used, mark = np.array(at, np.int64), np.array(used, np.int64), state.getCurrentWatermarkMs()
    # A new sample may come in the very batch in which the last one is found stale.
    if not fallen and (int(at[-1]) + RATE_SECONDS + 1) * 1000 <= mark:
        yield pd.DataFrame({"key": [key[0]], "at": [int(at[-1]) + RATE_SECONDS], "rate": [0.0]})
        fallen = True
    if state.hasTimedOut:
        state.update((at.tolist(), used.tolist(), fallen))
        return
    pdf = pd.concat(list(batches))
    at, used = np.concatenate((at, pdf["at"].to_numpy())), np.concatenate((used, pdf["used"].to_numpy()))
    order = np.lexsort((used, at))
    at, used = at[order], used[order]
    base = max(int(np.searchsorted(at, at[-1] - RATE_SECONDS, "right")) - 1, 0)
    at, used = at[base:], used[base:]
    seconds, moved = int(at[-1] - at[0]), int(used[-1] - used[0])
    stale = (int(at[-1]) + RATE_SECONDS + 1) * 1000
    fresh = stale > mark
    state.update((at.tolist(), used.tolist(), not fresh))
    if fresh:
        state.setTimeoutTimestamp(stale)
    yield pd.DataFrame({"key": [key[0]], "at": [int(at[-1])], "rate": [round(moved / seconds, 6) if fresh and seconds >= LEAST_SECONDS and moved > 0 else 0.0]})


def rate_stream(samples: DataFrame, key: str, delay: str = "10 seconds") -> DataFrame:
    """(key, at: seconds, rate) of a stream of samples (key, ts, used; update mode): after each batch rate_now as of the key's newest sample, and a rate of 0 once the watermark, `delay` behind the latest sample of any key, is past RATE_SECONDS after it.

    A key keeps the samples of the last RATE_SECONDS and one before them, in whatever order
    they come; samples behind the watermark are dropped.
    """
    rows = samples.withWatermark("ts", delay).select(F.col(key).cast("string").alias("key"), "ts", _instant("ts").alias("at"), F.col("used").cast("long").alias("used"))
    return rows.groupBy("key").applyInPandasWithState(_rate, "key string, at long, rate double", "at array<long>, used array<long>, fallen boolean", "update", "EventTimeTimeout").withColumnRenamed("key", key)


def eta(snapshot: DataFrame) -> DataFrame:
    """(run, seconds): the longer of dumping and draining what is left; null where a rate that is needed is 0. snapshot has to_dump, dump_rate, to_drain, drain_rate."""
    need = lambda left, rate: F.when(F.col(left) <= 0, F.lit(0.0)).when(F.col(rate) > 0, F.col(left) / F.col(rate))
    a, b = need("to_dump", "dump_rate"), need("to_drain", "drain_rate")
    return snapshot.select("run", F.when(a.isNotNull() & b.isNotNull(), F.round(F.greatest(a, b), 3)).alias("seconds"))


def usage_changes(usage: DataFrame) -> DataFrame:
    """Samples (medium, at, used, seq) at which a medium's total changed, the first included. Samples are compared along ranges of time, so a medium may have any number of them."""
    rows = preceding(usage.withColumn("_s", F.struct("at", "seq", "used")), ["medium"], [F.col("at"), F.col("seq")], {"_p": (F.max, "_s")})
    return rows.filter(F.col("_p").isNull() | (F.col("_p.used") != F.col("used"))).drop("_p", "_s")


def emptied(totals: DataFrame, known: DataFrame, at: Column) -> DataFrame:
    """(medium, at, used): samples to record now: what each medium holds, and 0 for one that earlier samples (known: medium, used; its last ones) have and that holds nothing any more; only where it differs from the last one."""
    rows = totals.select("medium", F.col("bytes").alias("used")).join(known.select("medium", F.col("used").alias("_last")), "medium", "full")
    rows = rows.withColumn("used", F.coalesce("used", F.lit(0).cast("long")))
    return rows.filter(F.col("_last").isNull() | (F.col("_last") != F.col("used"))).select("medium", at.alias("at"), "used")


def with_silences(usage: DataFrame, silence: int, until: Column) -> DataFrame:
    """usage (medium, seq, at, used) with a sample of 0 (no seq), `silence` seconds after the last one, wherever a medium then gave none until the next, or until the instant given."""
    rows = preceding(usage.withColumn("_s", F.struct("at", "seq", "used")), ["medium"], [F.col("at"), F.col("seq")], {"_p": (F.max, "_s")}).drop("_s")
    gap = F.make_dt_interval(secs=F.lit(silence))
    lasts = usage.groupBy("medium").agg(F.max("at").alias("_last"))
    inside = rows.filter(F.col("at") > F.col("_p.at") + gap).select("medium", (F.col("_p.at") + gap).alias("at"))
    behind = lasts.filter(F.col("_last") + gap <= until).select("medium", (F.col("_last") + gap).alias("at"))
    zeros = inside.unionByName(behind).select("medium", F.lit(-1).cast("long").alias("seq"), "at", F.lit(0).cast("long").alias("used"))
    return usage.select("medium", F.col("seq").cast("long").alias("seq"), "at", F.col("used").cast("long").alias("used")).unionByName(zeros)


def _changed(key: tuple, batches: Iterator[pd.DataFrame], state, silence: int) -> Iterator[pd.DataFrame]:
    """State: samples that earlier ones may still come before (at in microseconds), and the last one that was settled with what was told of the medium since."""
    at, seq, used, last_at, told = state.get if state.exists else ([], [], [], None, None)
    if not state.hasTimedOut:
        pdf = pd.concat(list(batches))
        more = sorted(zip([*at, *pdf["us"].tolist()], [*seq, *pdf["seq"].tolist()], [*used, *pdf["used"].tolist()], strict=True))
        at, seq, used = ([int(r[i]) for r in more] for i in range(3))
    mark, gap, out = state.getCurrentWatermarkMs() * 1000, silence * 1_000_000, []

    def fallen(now: int) -> None:
        nonlocal told
        if last_at is not None and told != 0 and now > last_at + gap:
            out.append((-1, last_at + gap, 0))
            told = 0

    settled = 0
    while settled < len(at) and at[settled] <= mark:
        fallen(at[settled])
        if told != used[settled]:
            out.append((seq[settled], at[settled], used[settled]))
            told = used[settled]
        last_at = at[settled]
        settled += 1
    at, seq, used = at[settled:], seq[settled:], used[settled:]
    # A sample that is still to come may be as early as the watermark.
    fallen(min(mark + 1, at[0]) if at else mark + 1)
    state.update((at, seq, used, last_at, told))
    waits = [*at[:1], *([last_at + gap] if last_at is not None and told != 0 else [])]
    if waits:
        state.setTimeoutTimestamp(max(min(waits) // 1000 + 1, mark // 1000 + 1))
    yield pd.DataFrame({"medium": [key[0]] * len(out), "seq": [r[0] for r in out], "at": pd.to_datetime([r[1] for r in out], unit="us"), "used": [r[2] for r in out]})


def usage_changes_stream(usage: DataFrame, silence: int, delay: str = "1 minute") -> DataFrame:
    """(medium, seq, at, used) of a stream of samples (append mode): usage_changes of with_silences up to the watermark, `delay` behind the latest sample of any medium.

    Samples may come in any order within delay: a medium's wait until the watermark is past
    them and are then told in order. One that gives none for `silence` seconds falls to 0
    once (seq -1), by a timer that other media's samples move on.
    """
    rows = usage.withWatermark("at", delay).select("medium", "at", F.unix_micros(F.col("at").cast("timestamp")).alias("us"), F.col("seq").cast("long").alias("seq"), F.col("used").cast("long").alias("used"))
    return rows.groupBy("medium").applyInPandasWithState(partial(_changed, silence=silence), "medium string, seq long, at timestamp, used long", "at array<long>, seq array<long>, used array<long>, last_at long, told long", "append", "EventTimeTimeout")


def activity_sessions(events: DataFrame, key: str, gap: int) -> DataFrame:
    """(key, begin, end, events, bytes): runs of a key's activity (ts, bytes) in which no two neighbours lie further apart than `gap` seconds; end is `gap` after the last."""
    out = events.groupBy(F.col(key), F.session_window("ts", f"{gap} seconds").alias("w")).agg(F.count("*").alias("events"), F.sum("bytes").alias("bytes"))
    return out.select(key, F.col("w.start").alias("begin"), F.col("w.end").alias("end"), "events", "bytes")


def _sessions(key: tuple, batches: Iterator[pd.DataFrame], state, gap: int) -> Iterator[pd.DataFrame]:
    """State: sessions (begin, end, events, bytes) that a later event may still join."""
    held = list(zip(*state.get, strict=True)) if state.exists else []
    pdf, mark = pd.concat(list(batches)), state.getCurrentWatermarkMs() * 1000
    too_late = (pdf["us"] + gap <= mark).to_numpy()
    rows = sorted([*held, *((t, t + gap, 1, n) for t, n in zip(pdf["us"][~too_late].tolist(), pdf["bytes"][~too_late].tolist(), strict=True))])
    merged: list[list[int]] = []
    for begin, end, events, size in rows:
        if merged and begin <= merged[-1][1]:
            last = merged[-1]
            last[1:] = max(last[1], end), last[2] + events, last[3] + size
        else:
            merged.append([begin, end, events, size])
    now, before = {tuple(m) for m in merged}, {tuple(h) for h in held}
    gone = {b for b, *_ in before} - {b for b, *_ in now}
    out = [(*m, "session") for m in sorted(now - before)] + [(b, b, 0, 0, "session") for b in sorted(gone)]
    out += [(t, t, 1, n, "late") for t, n in zip(pdf["us"][too_late].tolist(), pdf["bytes"][too_late].tolist(), strict=True)]
    state.update(tuple([m[i] for m in merged if m[1] > mark] for i in range(4)))
    times = [pd.to_datetime([r[i] for r in out], unit="us") for i in (0, 1)]
    yield pd.DataFrame({"key": [key[0]] * len(out), "begin": times[0], "end": times[1], "events": [r[2] for r in out], "bytes": [r[3] for r in out], "kind": [r[4] for r in out]})


def sessions_stream(events: DataFrame, key: str, gap: int, delay: str = "10 minutes") -> DataFrame:
    """(key, begin, end, events, bytes, kind) of a stream (update mode): kind 'session' for each session that a batch changed, kind 'late' for each event that came too late to be in one (begin and end are its ts).

    A later row for a begin stands for an earlier one, and 0 events say that it has gone into
    another session. An event is too late if its own `gap` ends before the watermark, `delay`
    behind the latest event of earlier batches; with those left out, what stands in the end
    is activity_sessions of the rest, in whatever order and batches they came. A key keeps
    the sessions that end behind the watermark.
    """
    rows = events.withWatermark("ts", delay).select(F.col(key).cast("string").alias("key"), "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("bytes").cast("long").alias("bytes"))
    fields = "begin array<long>, end array<long>, events array<long>, bytes array<long>"
    out = rows.groupBy("key").applyInPandasWithState(partial(_sessions, gap=gap * 1_000_000), "key string, begin timestamp, end timestamp, events long, bytes long, kind string", fields, "update", "NoTimeout")
    return out.withColumnRenamed("key", key)


def write_sessions(stream: DataFrame, path: str, late_path: str, checkpoint: str):
    """Start writing what sessions_stream gives: changes of sessions with the number of their batch to path, late events to a table of their own."""

    def batch(df: DataFrame, number: int) -> None:
        df.persist()
        df.filter("kind = 'session'").drop("kind").withColumn("batch", F.lit(number)).write.mode("append").parquet(path)
        df.filter("kind = 'late'").drop("kind", "end", "events").withColumnRenamed("begin", "ts").write.mode("append").parquet(late_path)
        df.unpersist()

    return stream.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint).start()


def standing_sessions(changes: DataFrame, key: str) -> DataFrame:
    """(key, begin, end, events, bytes): the sessions that stand, of what write_sessions wrote to its path."""
    last = F.max_by(F.struct("end", "events", "bytes"), "batch").alias("x")
    return changes.groupBy(key, "begin").agg(last).select(key, "begin", "x.*").filter("events > 0")
