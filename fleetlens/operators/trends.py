"""Growth of data sizes, and dumps that do not fit the past."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions import columns as C
from fleetlens.plans.lineage import cut

DAY = 86400
#: Reach of a trend, dumps compared with, and what makes a difference notable.
TREND_DAYS, PRIORS, LEAST_BYTES, MADS, LEAST_SECONDS = 180, 5, 64 << 20, 3, 300


def upper_median(values: Column) -> Column:
    """The middle of a sorted array, the upper one of an even number; null for none."""
    s = F.array_sort(values)
    return F.get(s, F.floor(F.size(s) / 2).cast("int"))


def mean_median(values: Column) -> Column:
    """The middle of a sorted array of whole numbers, the whole mean of two for an even number."""
    s = F.array_sort(values)
    n = F.size(s)
    low, high = F.get(s, F.floor((n - 1) / 2).cast("int")), F.get(s, F.floor(n / 2).cast("int"))
    return F.floor((low + high) / 2).cast("long")


def _fulls_span(dump_stat: DataFrame, days: int) -> DataFrame:
    """For each source its first and last full of the days up to its newest dump (a, z), their number, the seconds between, and the upper median of the incrementals since."""
    end = dump_stat.groupBy("dle").agg(F.max(C.epoch("ended_at")).alias("_end"))
    rows = dump_stat.withColumn("_at", C.epoch("ended_at")).join(end, "dle").filter(F.col("_at") >= F.col("_end") - days * DAY)
    full = F.col("level") == 0
    first = F.min_by(F.struct("_at", "orig", "out"), F.when(full, F.struct("_at", "run_id")))
    last = F.max_by(F.struct("_at", "orig", "out"), F.when(full, F.struct("_at", "run_id")))
    out = rows.groupBy("dle").agg(F.sum(full.cast("long")).alias("fulls"), first.alias("a"), last.alias("z"), upper_median(F.collect_list(F.when(~full, F.col("out")))).alias("median_incr"))
    percent = F.when(F.col("a.out") > 0, ((F.col("z.out") - F.col("a.out")).cast("double") / F.col("a.out") * 100.0).cast("long")).otherwise(F.lit(0).cast("long"))
    return out.withColumn("span", F.col("z._at") - F.col("a._at")).withColumn("percent", percent)


def evolution(dump_stat: DataFrame, days: int = TREND_DAYS) -> DataFrame:
    """(dle, fulls, first_out, last_out, span, per_day, per_day_orig, percent, median_incr): growth of full sizes.

    Seen are the days up to the source's newest dump; two fulls a day apart are needed.
    Slopes are whole bytes a day and percent is whole, both cut toward zero; percent is 0 where the first full is
    empty; the median increment is the upper one.
    """
    out = _fulls_span(dump_stat, days).filter(f"fulls >= 2 and span >= {DAY}")
    slope = lambda c: F.expr(f"cast((z.{c} - a.{c}) * {DAY}.0D / span as bigint)")
    return out.select("dle", "fulls", F.col("a.out").alias("first_out"), F.col("z.out").alias("last_out"), "span", slope("out").alias("per_day"), slope("orig").alias("per_day_orig"), "percent", "median_incr")


def trend_delta(dump_stat: DataFrame, warn: float = 20.0) -> DataFrame:
    """(dle, percent, warns): change in whole percent, cut toward zero, from the first to the last full within the trend, of sources with two fulls or more, however close."""
    return _fulls_span(dump_stat, TREND_DAYS).filter("fulls >= 2").select("dle", "percent", (F.col("percent") >= warn).alias("warns"))


def usage_growth(usage: DataFrame, capacity: DataFrame, days: int = 30) -> DataFrame:
    """(medium, per_day, full_in_days): bytes a day a medium grew over the days up to its newest sample; only growing ones. full_in_days where a capacity is above the use. A row for each medium is broadcast."""
    end = usage.groupBy("medium").agg(F.max(C.epoch("at")).alias("_end"))
    rows = usage.withColumn("_at", C.epoch("at")).join(F.broadcast(end), "medium").filter(F.col("_at") >= F.col("_end") - days * DAY)
    order = F.struct("_at", "seq")
    out = rows.groupBy("medium").agg(F.count("*").alias("n"), F.min_by(F.struct("_at", "used"), order).alias("a"), F.max_by(F.struct("_at", "used"), order).alias("z"))
    out = out.withColumn("span", F.col("z._at") - F.col("a._at")).filter(f"n >= 2 and span >= {DAY} and z.used > a.used")
    out = out.withColumn("per_day", F.expr(f"cast((z.used - a.used) * {DAY}.0D / span as bigint)")).join(F.broadcast(capacity.select("medium", "capacity")), "medium", "left")
    return out.select("medium", "per_day", F.when((F.col("capacity") > F.col("z.used")) & (F.col("per_day") > 0), F.expr("(capacity - z.used) div per_day")).alias("full_in_days"))


def of_newest_run(dump_stat: DataFrame) -> DataFrame:
    """All dumps of the sources that the newest run dumped, written once: what size_anomalies and slow_dumps look at of a fleet."""
    newest = dump_stat.agg(F.max(F.struct("ended_at", "run_id")).alias("_new"))
    new = cut(dump_stat.join(F.broadcast(newest), F.col("run_id") == F.col("_new.run_id")).select("dle").distinct())  # one row
    return cut(dump_stat.join(new, "dle", "left_semi"))


def _with_priors(dump_stat: DataFrame, value: Column) -> DataFrame:
    """The dumps of the newest run with the values of the up to PRIORS dumps of the same source and level before it, two at least.

    Only sources of the newest run are looked at, and their dumps are numbered only after
    all others have been left out. A null value does not count.
    """
    newest = dump_stat.agg(F.max(F.struct("ended_at", "run_id")).alias("_new"))
    rows = dump_stat.withColumn("_v", value).join(F.broadcast(newest), F.lit(True))  # one row
    new = rows.filter(F.col("run_id") == F.col("_new.run_id")).filter("_v is not null").select("dle", "level", F.struct("run_id", "_v", "orig", "seconds").alias("new"))
    old = rows.filter((F.col("run_id") != F.col("_new.run_id")) & F.col("_v").isNotNull()).join(new.select("dle", "level"), ["dle", "level"], "left_semi")
    w = Window.partitionBy("dle", "level").orderBy(F.col("ended_at").desc(), F.col("run_id").desc())
    priors = old.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= PRIORS).groupBy("dle", "level").agg(F.collect_list("_v").alias("priors"))
    return new.join(priors, ["dle", "level"]).filter(F.size("priors") >= 2)


def _notable(value: Column, median: Column, mad: Column) -> Column:
    """Outside the band around a median: by a factor of two, by more than LEAST_BYTES and by more than MADS deviations."""
    d = F.abs(value - median)
    return (median > 0) & (d > LEAST_BYTES) & ((value > 2 * median) | (value * 2 < median)) & (d > MADS * mad)


def size_anomalies(dump_stat: DataFrame) -> DataFrame:
    """(dle, level, run_id, orig, median, mad, kind): dumps of the newest run whose original size is over twice or under half the median of the last ones, by more than 64 MiB and three deviations; only fulls shrink. Medians are means of the middle two."""
    rows = _with_priors(dump_stat, F.col("orig")).withColumn("median", mean_median(F.col("priors")))
    rows = rows.withColumn("mad", mean_median(F.transform("priors", lambda x: F.abs(x - F.col("median")))))
    v, m = F.col("new._v"), F.col("median")
    kind = F.when(v > m, "grown").when(F.col("level") == 0, "shrunk")
    return rows.filter(_notable(v, m, F.col("mad"))).withColumn("kind", kind).filter("kind is not null").select("dle", "level", F.col("new.run_id").alias("run_id"), v.alias("orig"), "median", "mad", "kind")


def slow_dumps(dump_stat: DataFrame) -> DataFrame:
    """(dle, level, run_id, rate, median): dumps of the newest run at under half the usual rate that took more than five minutes longer than they should have."""
    rate = F.when((F.col("orig") > 0) & (F.col("seconds") > 0), (F.col("orig") / F.col("seconds")).cast("long"))
    rows = _with_priors(dump_stat, rate).withColumn("median", mean_median(F.col("priors")))
    v, m = F.col("new._v"), F.col("median")
    lost = F.col("new.seconds").cast("double") - F.col("new.orig") / F.greatest(m, F.lit(1).cast("long"))
    return rows.filter((m > 0) & (v * 2 < m) & (lost > LEAST_SECONDS)).select("dle", "level", F.col("new.run_id").alias("run_id"), v.alias("rate"), "median")


def incr_spikes(dump_stat: DataFrame, days: int = TREND_DAYS) -> DataFrame:
    """(dle, run_id, out, median, mad): incrementals within the trend that are notably above the source's median, of two at least. The median is the upper one, the deviation the mean of the middle two."""
    end = dump_stat.groupBy("dle").agg(F.max(C.epoch("ended_at")).alias("_end"))
    rows = dump_stat.join(end, "dle").filter((F.col("level") > 0) & (C.epoch("ended_at") >= F.col("_end") - days * DAY))
    typical = rows.groupBy("dle").agg(F.collect_list("out").alias("all")).filter(F.size("all") >= 2).withColumn("median", upper_median(F.col("all")))
    typical = typical.select("dle", "median", mean_median(F.transform("all", lambda x: F.abs(x - F.col("median")))).alias("mad"))
    return rows.join(typical, "dle").filter((F.col("out") > F.col("median")) & _notable(F.col("out"), F.col("median"), F.col("mad"))).select("dle", "run_id", "out", "median", "mad")


def group_curve(dump_stat: DataFrame, groups: DataFrame, days: int = TREND_DAYS) -> DataFrame:
    """(group, at, total): at each full of a group's members in the days up to its newest one, the sum of all members' last known stored full sizes.

    A full changes the total by what it differs from the member's full before, so the
    curve is a running sum of differences; no grid of instants and members is made.
    Earlier fulls only give what the curve begins with.
    """
    member = Window.partitionBy("dle").orderBy("ended_at", "run_id")
    fulls = dump_stat.filter("level = 0").withColumn("_d", F.col("out") - F.coalesce(F.lag("out").over(member), F.lit(0)))
    steps = fulls.join(groups, "dle").groupBy("group", F.col("ended_at").alias("at")).agg(F.sum("_d").alias("_d"))
    line = Window.partitionBy("group").orderBy("at")
    curve = steps.select("group", "at", F.sum("_d").over(line.rowsBetween(Window.unboundedPreceding, 0)).alias("total"), F.max("at").over(Window.partitionBy("group")).alias("_end"))
    return curve.filter(C.epoch("at") >= C.epoch("_end") - days * DAY).select("group", "at", "total")


def chain_sizes(archive: DataFrame) -> DataFrame:
    """(dle, nth, archives, bytes): recovery chains of each source, newest first; each full opens one, and incrementals before any full make up the first."""
    w = Window.partitionBy("dle").orderBy(C.run_key("run")).rowsBetween(Window.unboundedPreceding, 0)
    rows = archive.withColumn("_seg", F.sum((F.col("level") == 0).cast("int")).over(w))
    out = rows.groupBy("dle", "_seg").agg(F.count("*").alias("archives"), F.sum("compressed").alias("bytes"))
    return out.withColumn("nth", F.row_number().over(Window.partitionBy("dle").orderBy(F.col("_seg").desc()))).select("dle", "nth", "archives", "bytes")


def restore_depth(archive: DataFrame, marks: tuple[int, ...] = (1, 2, 4, 8)) -> DataFrame:
    """(chains, bytes): bytes to keep the newest 1, 2, 4 and 8 chains of every source; a source with fewer gives all it has, and marks beyond the longest history are left out."""
    sizes = chain_sizes(archive)
    most = sizes.agg(F.max("nth").alias("most"))
    cols = [F.sum(F.when(F.col("nth") <= m, F.col("bytes")).otherwise(0)).cast("long").alias(f"m{m}") for m in marks]
    wide = sizes.agg(*cols).join(most, F.lit(True))
    stacked = ", ".join(f"{m}, m{m}" for m in marks)
    return wide.select("most", F.expr(f"stack({len(marks)}, {stacked}) as (chains, bytes)")).filter("chains <= most").select(F.col("chains").cast("int").alias("chains"), "bytes")


def capacity_depth(depth: DataFrame, capacity: DataFrame) -> DataFrame:
    """(medium, cycles): how many chains of history each capacity keeps, by restore_depth's marks and in proportion between them; 0 below the first mark, the last mark beyond it. Unbounded media give no row."""
    ahead = Window.orderBy("chains")  # four rows
    steps = depth.select("chains", "bytes", F.lead("chains").over(ahead).alias("_c"), F.lead("bytes").over(ahead).alias("_b"))
    fits = capacity.filter("capacity > 0").join(F.broadcast(steps), F.col("bytes") <= F.col("capacity"), "left")
    share = F.when(F.col("_b") > F.col("bytes"), (F.col("capacity") - F.col("bytes")) / (F.col("_b") - F.col("bytes")) * (F.col("_c") - F.col("chains"))).otherwise(F.lit(0.0))
    best = F.max_by(F.col("chains") + share, F.col("chains"))
    return fits.groupBy("medium").agg(F.round(F.coalesce(best, F.lit(0.0)), 6).alias("cycles"))


def dle_state(archive: DataFrame, today: Column) -> DataFrame:
    """(dle, days_since_full, last_level, at_level, incrs_since_full, last_run): days are whole, -1 without a full; at_level counts the newest archives in a row at the last level."""
    w = Window.partitionBy("dle").orderBy(C.run_key("run"))
    rows = archive.withColumn("_i", F.row_number().over(w)).withColumn("_change", F.coalesce(F.lag("level").over(w) != F.col("level"), F.lit(True)))
    full = F.col("level") == 0
    out = rows.groupBy("dle").agg(
        F.max("_i").alias("n"), F.max_by("level", "_i").alias("last_level"), F.max(F.when(F.col("_change"), F.col("_i"))).alias("since"),
        F.max(F.when(full, F.col("_i"))).alias("full_i"), F.max_by("created_at", F.when(full, F.col("_i"))).alias("full_at"), F.max_by("run", "_i").alias("last_run"),
    )
    days = F.when(F.col("full_at").isNotNull(), F.expr("(_now - _full) div 86400")).otherwise(F.lit(-1))
    out = out.withColumn("_now", C.epoch(today)).withColumn("_full", C.epoch("full_at"))
    return out.select("dle", days.cast("long").alias("days_since_full"), "last_level", (F.col("n") - F.col("since") + 1).cast("long").alias("at_level"), (F.col("n") - F.coalesce("full_i", F.lit(0))).cast("long").alias("incrs_since_full"), "last_run")


def estimate_from_history(dump_stat: DataFrame, at: Column) -> DataFrame:
    """(dle, full_est, same_est, next_est): sizes to expect of a full, of another dump at the level last used and of one a level up, since the last full; 0 without any full. An `at` before the last full takes that as it was."""
    key = F.struct("ended_at", "run_id")
    last = dump_stat.groupBy("dle").agg(F.max_by(F.struct("orig", "ended_at", "run_id"), F.when(F.col("level") == 0, key)).alias("full"), F.max_by("level", key).alias("at_level"))
    slope = evolution(dump_stat).select("dle", "per_day_orig")
    since = dump_stat.join(last, "dle").filter("full is not null and level > 0").filter(F.struct("ended_at", "run_id") > F.struct("full.ended_at", "full.run_id"))
    meds = since.groupBy("dle").agg(upper_median(F.collect_list(F.when(F.col("level") == F.greatest("at_level", F.lit(1)), F.col("orig")))).alias("same"), upper_median(F.collect_list(F.when(F.col("level") == F.greatest("at_level", F.lit(1)) + 1, F.col("orig")))).alias("next"))
    days = (C.epoch(at) - C.epoch("full.ended_at")) / F.lit(float(DAY))
    full = F.when(F.col("full").isNull(), F.lit(0)).otherwise(F.greatest(F.lit(0), F.col("full.orig") + F.coalesce(F.when(days > 0, (F.col("per_day_orig") * days).cast("long")), F.lit(0))))
    return last.join(slope, "dle", "left").join(meds, "dle", "left").select("dle", full.cast("long").alias("full_est"), F.coalesce("same", F.lit(0)).alias("same_est"), F.coalesce("next", F.lit(0)).alias("next_est"))


def next_level(state: DataFrame, estimate: DataFrame, force_full: DataFrame, cycle: int = 7, bump: float = 5.0) -> DataFrame:
    """(dle, level, reason): the level each source should be dumped at next."""
    rows = state.join(estimate, "dle", "left").join(force_full.select("dle").distinct().withColumn("_forced", F.lit(True)), "dle", "left")
    last = F.col("last_level")
    saves = (F.col("same_est") - F.col("next_est")) * F.lit(100.0) >= F.col("full_est") * F.lit(bump)
    climbs = (last < 9) & (F.col("next_est") > 0) & (F.col("at_level") >= 2) & saves
    to = lambda level, reason: F.struct(level.cast("int").alias("level"), F.lit(reason).alias("reason"))
    pick = (
        F.when(F.col("_forced"), to(F.lit(0), "forced"))
        .when(F.col("days_since_full") < 0, to(F.lit(0), "first full"))
        .when(F.col("days_since_full") >= cycle, to(F.lit(0), "cycle due"))
        .when(last < 1, to(F.lit(1), "after full"))
        .when(climbs, to(last + 1, "bump"))
        .otherwise(to(last, "hold"))
    )
    return rows.select("dle", pick.alias("p")).select("dle", "p.level", "p.reason")


def with_base(levels: DataFrame, archive: DataFrame) -> DataFrame:
    """levels (of next_level) with base_level and base_run: the newest run of the source at the level below, on which an incremental builds. A full has none (-1 and null); where no run is at that level base_run is null."""
    newest = archive.groupBy("dle", F.col("level").alias("base_level")).agg(F.max_by("run", C.run_key("run")).alias("base_run"))
    return levels.withColumn("base_level", F.col("level") - 1).join(newest, ["dle", "base_level"], "left").select(*levels.columns, "base_level", "base_run")


def cycle_fits(estimate: DataFrame, capacity: int) -> DataFrame:
    """(fulls, capacity, fits): whether a full of every source fits at once; 0 is unbounded."""
    return estimate.agg(F.sum("full_est").alias("fulls")).select("fulls", F.lit(capacity).cast("long").alias("capacity"), (F.lit(capacity == 0) | (F.col("fulls") <= capacity)).alias("fits"))


def promotion_candidates(state: DataFrame, estimate: DataFrame, cycle: int, room: int) -> DataFrame:
    """(dle, due_in, full_est, peak, square, place): not yet due sources that could have their full today, by how even the days up to their deadlines become.

    The calendar has a load for each of the cycle's days, so it is one small array that
    every candidate is scored against: its full moves from its day to today.
    """
    rows = state.join(estimate, "dle").select("dle", (F.lit(cycle) - F.col("days_since_full")).alias("due_in"), "days_since_full", "full_est")
    due = F.when((F.col("days_since_full") < 0) | (F.col("due_in") <= 0), 0).otherwise(F.col("due_in")).cast("int")
    rows = rows.withColumn("slot", due)
    loads = rows.groupBy("slot").agg(F.sum("full_est").alias("load"))
    calendar = loads.agg(F.map_from_entries(F.collect_list(F.struct("slot", "load"))).alias("m")).select(F.transform(F.sequence(F.lit(0), F.lit(cycle)), lambda d: F.coalesce(F.element_at("m", d), F.lit(0).cast("long"))).alias("calendar"))
    scored = rows.filter((F.col("slot") > 0) & (F.col("days_since_full") * 2 >= cycle)).join(F.broadcast(calendar), F.lit(True))
    moved = F.transform("calendar", lambda load, d: F.when(d == 0, load + F.col("full_est")).when(d == F.col("slot"), load - F.col("full_est")).otherwise(load))
    scored = scored.withColumn("_new", moved).withColumn("peak", F.array_max("_new")).withColumn("square", F.aggregate("_new", F.lit(0).cast("double"), lambda a, x: a + x.cast("double") * x.cast("double")))
    scored = scored.filter((F.col("_new")[0] <= room) & (F.col("_new")[0] <= F.array_max("calendar")))
    return scored.select("dle", "due_in", "full_est", "peak", F.round(F.col("square") / 1e18, 6).alias("square")).orderBy("peak", "square", "dle")
