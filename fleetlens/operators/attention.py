"""What needs a look, and where alerts go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions import columns as C
from fleetlens.plans.lineage import cut

#: Failure classes of drills, whether each is a failure, and what to do.
DRILL_CLASSES = [
    ("ok", False, ""),
    ("integrity", True, "copy the archive again from another medium"),
    ("pipeline", True, "check decryption keys and filters"),
    ("chain", True, "force a full dump"),
    ("missing", True, "rebuild the catalog or load the volume"),
    ("skipped", False, "load the volume and drill again"),
]


def drill_classes(spark) -> DataFrame:
    return spark.createDataFrame(DRILL_CLASSES, "class string, is_failure boolean, remedy string")


def classified(ledger: DataFrame, classes: DataFrame) -> DataFrame:
    """ledger with is_failure and remedy of its class; an unknown or empty class is no failure and has no remedy. classes are the few of drill_classes."""
    return ledger.join(F.broadcast(classes), "class", "left").withColumn("is_failure", F.coalesce("is_failure", F.lit(False))).withColumn("remedy", F.coalesce("remedy", F.lit("")))


def attention(*parts: tuple[str | Column, str | Column, DataFrame]) -> DataFrame:
    """(rank, severity, topic, subject): rows of several findings, red before amber. Each part is (severity, topic, DataFrame with `subject`); a severity or topic that differs by row is a Column, so that no part is read once for each."""
    out: DataFrame | None = None
    for severity, topic, df in parts:
        severity, topic = (F.lit(x) if isinstance(x, str) else x for x in (severity, topic))
        rows = df.select(F.when(severity == "red", 0).otherwise(1).alias("rank"), severity.alias("severity"), topic.alias("topic"), F.col("subject").cast("string").alias("subject"))
        out = rows if out is None else out.unionByName(rows)
    # Written before they are sorted, as ranges are drawn from the rows: they would be worked out again for it.
    return cut(out).orderBy("rank", "topic", "subject")


def route_alerts(run_log: DataFrame, channels: DataFrame) -> DataFrame:
    """(run_id, command, status, channel): who hears of each run. channels (channel, kind, commands: array, empty for all) are few.

    Failures and warnings go to every channel that lists the command or lists none;
    successes only of dumps unless the command is listed; health checks hear of all.
    """
    runs = run_log.withColumn("status", C.run_status("outcome", "warnings"))
    rows = runs.join(F.broadcast(channels), F.lit(True))
    listed = F.array_contains("commands", F.col("command"))
    open_list = F.size("commands") == 0
    loud = (F.col("status") != "OK") & (open_list | listed)
    quiet = (F.col("status") == "OK") & (listed | (open_list & (F.col("command") == "dump")))
    return rows.filter((F.col("kind") == "healthcheck") | loud | quiet).select("run_id", "command", "status", "channel")


#: Share of a capacity from which what must be kept is pressure, and from which a medium is no longer filling; days a forecast looks ahead; stale sources of a host from which they are one alert.
PRESSURE, FORECAST_DAYS, TOGETHER = 0.9, 30, 2


def medium_alerts(media: DataFrame, now: Column) -> DataFrame:
    """(severity, topic, subject): at most one alert for each medium with a capacity.

    media has medium, capacity, used, residual (what must be kept), volumes (labelled ones; 0
    where data lies by address), with_room (of them, those that can be written) and over_at
    (when its use is forecast to pass its capacity, or null). Full comes before all else. A
    pool of volumes is out of room, or on its last one; near full it stays by design. Other
    media warn when what must be kept nears capacity, or when they still fill and will be
    full within FORECAST_DAYS.
    """
    used, capacity = F.col("used"), F.col("capacity")
    soon = C.epoch("over_at") < C.epoch(now) + FORECAST_DAYS * 86400
    topic = (
        F.when(used >= capacity, "over capacity")
        .when(F.col("volumes") > 0, F.when(F.col("with_room") == 0, "no room").when(F.col("with_room") == 1, "last volume"))
        .when(F.col("residual") / capacity >= PRESSURE, "retention pressure")
        .when((used / capacity < PRESSURE) & soon, "capacity forecast")
    )
    rows = media.filter(capacity > 0).withColumn("topic", topic).filter("topic is not null")
    return rows.select(F.when(F.col("topic").isin("over capacity", "no room"), "red").otherwise("amber").alias("severity"), "topic", F.col("medium").alias("subject"))


def stale_alerts(stale: DataFrame, configured: DataFrame) -> DataFrame:
    """(subject): stale sources (dle), those of a host with TOGETHER or more as one: 'host: n of m'. configured has dle and host; sources without a host stand alone. Which are stale is written once, as it is read by host and by source."""
    known = configured.select("dle", F.when(F.col("host") != "", F.col("host")).alias("host")).distinct()
    rows = cut(stale.select("dle").distinct().join(known, "dle", "left"))
    late = rows.filter("host is not null").groupBy("host").agg(F.count("*").alias("n")).filter(F.col("n") >= TOGETHER)
    every = known.filter("host is not null").groupBy("host").agg(F.count("*").alias("m"))
    hosts = late.join(every, "host").select(F.format_string("%s: %d of %d", "host", "n", "m").alias("subject"))
    return hosts.unionByName(rows.join(late.select("host"), "host", "left_anti").select(F.col("dle").alias("subject")))


def copy_alerts(short: DataFrame, media: Column, offsite: Column, archives: Column, facts: DataFrame) -> DataFrame:
    """(severity, subject) of the rules of copies that are not met. short comes from placement.copies_posture; facts is a row that media, offsite (numbers of media with copies, and of those that are no landing) and archives are taken from.

    Copies: an archive without any, or no archive at all, is red; one that still owes a copy,
    or that no route gives a second, is amber; copies that rotated away are not a fault.
    """
    n = lambda *reasons: F.coalesce(F.sum(F.when(F.col("reason").isin(*reasons), F.col("n"))), F.lit(0))
    counted = facts.join(short.agg(n("none").alias("_none"), n("backfill", "structural").alias("_short")), F.lit(True))
    rules = F.array(
        F.struct(F.lit("copies").alias("subject"), F.when((archives == 0) | (F.col("_none") > 0), "red").when(F.col("_short") > 0, "amber").alias("severity")),
        F.struct(F.lit("media").alias("subject"), F.when(media < 2, "amber").alias("severity")),
        F.struct(F.lit("offsite").alias("subject"), F.when(offsite < 1, "amber").alias("severity")),
    )
    return counted.select(F.explode(rules).alias("r")).select("r.severity", "r.subject").filter("severity is not null")


def newest_unrestorable(points: DataFrame) -> DataFrame:
    """(subject): sources whose newest recovery point (dle, run, verdict) is not complete; older ones are no alert."""
    newest = points.groupBy("dle").agg(F.max_by("verdict", C.run_key("run")).alias("verdict"))
    return newest.filter("verdict <> 'complete'").select(F.col("dle").alias("subject"))


def findings(last_runs: DataFrame, media: DataFrame, ledger: DataFrame, overdue: DataFrame, points: DataFrame, stale: DataFrame, configured: DataFrame, sizes: DataFrame, slow: DataFrame, copies: DataFrame, now: Column) -> DataFrame:
    """attention() over all findings of a fleet, from the tables that the other operators give.

    Red: the last run of a command failed; a medium is full, or a pool has no volume with
    room; a drill that fails, by source; a source whose newest point cannot be restored; no
    copies. Amber: a last run with warnings; the last volume, retention pressure, a forecast;
    how many drills are overdue beside those that fail, as one; stale sources, by host; odd
    sizes and slow dumps; rules of copies. last_runs has a row a command, ledger a row a
    source (ok), overdue the sources whose drill is, failing ones included; media, points,
    copies: see medium_alerts, newest_unrestorable, copy_alerts. Each table is worked out
    once, failing sources twice: their ledger should be written.
    """
    name = lambda df, c: df.withColumnRenamed(c, "subject")
    failing = ledger.filter("not ok").select(F.col("dle").alias("subject"))
    gap = overdue.select("dle").distinct().join(failing.withColumnRenamed("subject", "dle"), "dle", "left_anti").agg(F.count("*").alias("n")).filter("n > 0").select(F.col("n").alias("subject"))
    failed = F.col("status") == "FAILED"
    return attention(
        (F.when(failed, "red").otherwise("amber"), F.when(failed, "failed").otherwise("warning"), name(last_runs.filter(F.col("status").isin("FAILED", "WARNING")), "command")),
        ("red", "drill failing", failing), ("amber", "drill overdue", gap), ("red", "unrestorable", newest_unrestorable(points)), ("amber", "stale", stale_alerts(stale, configured)),
        ("amber", "size anomaly", name(sizes, "dle")), ("amber", "slow dump", name(slow, "dle")),
        (F.col("severity"), F.col("topic"), medium_alerts(media, now)), (F.col("severity"), "recoverability", copies),
    )


def metrics(summary: DataFrame, totals: DataFrame, medium_dim: DataFrame, last_runs: DataFrame, counts: DataFrame) -> DataFrame:
    """(metric, labels, value): fleet gauges. Sources without a dump, runs without an end and media without a capacity give no gauge of these; a run without a begin or an end took 0 seconds.

    counts (metric, value) are gauges of the whole fleet: sources, stale ones, drills overdue and failing.
    """

    def rows(name: str, df: DataFrame, label: str, value: Column) -> DataFrame:
        return df.select(F.lit(name).alias("metric"), F.concat(F.lit(label + "="), F.col(label)).alias("labels"), value.cast("double").alias("value"))

    took = F.coalesce(C.epoch("ended_at") - C.epoch("started_at"), F.lit(0).cast("long"))
    parts = [
        rows("source_last_backup_seconds", summary.filter("last_at is not null"), "dle", C.epoch("last_at")),
        rows("medium_used_bytes", totals, "medium", F.col("bytes")),
        rows("medium_capacity_bytes", medium_dim.filter("capacity > 0"), "medium", F.col("capacity")),
        rows("command_last_success", last_runs, "command", (F.col("status") != "FAILED").cast("int")),
        rows("command_last_end_seconds", last_runs.filter("ended_at is not null"), "command", C.epoch("ended_at")),
        rows("command_last_duration_seconds", last_runs, "command", took),
        counts.select("metric", F.lit("").alias("labels"), F.col("value").cast("double").alias("value")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
