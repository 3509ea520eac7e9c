"""Summaries of runs, sources, media and volumes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions import columns as C
from fleetlens.plans.lineage import cut

KEY = ["run", "dle", "level"]


def _sum_if(condition: Column, value: Column | str) -> Column:
    v = F.col(value) if isinstance(value, str) else value
    return F.coalesce(F.sum(F.when(condition, v)), F.lit(0)).cast("long")


def run_summary(archive: DataFrame) -> DataFrame:
    """(run, date, archives, bytes, partial, last_at)."""
    out = archive.groupBy("run").agg(F.count("*").alias("archives"), F.sum("compressed").alias("bytes"), F.max(C.is_partial("unreadable")).alias("partial"), F.max("created_at").alias("last_at"))
    return out.withColumn("date", C.run_date("run"))


def dle_summary(archive: DataFrame, placement: DataFrame, resolved: DataFrame | None = None) -> DataFrame:
    """(dle, display, runs, bytes, last_level, last_full, last_at, media, rest) of each source; rest marks the remainder of a partitioned source by the latest resolved set (dle, rest)."""
    key = C.run_key("run")
    own = archive.groupBy("dle").agg(F.count("*").alias("runs"), F.sum("compressed").alias("bytes"), F.max_by("level", key).alias("last_level"), F.max(F.when(F.col("level") == 0, C.run_date("run"))).alias("last_full"), F.max("created_at").alias("last_at"), F.max_by(C.dle_display("host", "path", "dle"), key).alias("display"))
    media = placement.groupBy("dle").agg(F.array_join(F.sort_array(F.collect_set("medium")), ",").alias("media"))
    out = own.join(media, "dle", "left").fillna("", ["media"])
    if resolved is None:
        return out.withColumn("rest", F.lit(False))
    marks = resolved.groupBy("dle").agg(F.max("rest").alias("rest"))
    return out.join(marks, "dle", "left").withColumn("rest", F.coalesce("rest", F.lit(False)))


def medium_totals(archive: DataFrame, placement: DataFrame) -> DataFrame:
    """(medium, archives, runs, bytes): what each medium stores."""
    rows = placement.select(*KEY, "medium").distinct().join(archive.select(*KEY, "compressed"), KEY)
    return rows.groupBy("medium").agg(F.count("*").alias("archives"), F.countDistinct("run").alias("runs"), F.sum("compressed").alias("bytes"))


def comprate(archive: DataFrame) -> DataFrame:
    """(dle, full_rate, incr_rate): compressed over original size of the latest full and the latest incremental that have both sizes; each stands in for the other, 0 without either. Of equally new archives the first run counts."""
    usable = archive.filter((F.col("uncompressed") > 0) & (F.col("compressed") > 0))
    rate = F.col("compressed") / F.col("uncompressed")
    order = F.struct(F.col("created_at").alias("a"), (-F.datediff(F.to_date(C.run_date("run")), F.lit("1970-01-01").cast("date"))).alias("r"))
    newest = lambda c: F.max_by(rate, F.when(c, order))
    out = usable.groupBy("dle").agg(newest(F.col("level") == 0).alias("f"), newest(F.col("level") > 0).alias("i"))
    rows = archive.select("dle").distinct().join(out, "dle", "left")
    zero = F.lit(0.0)
    return rows.select("dle", F.round(F.coalesce("f", "i", zero), 9).alias("full_rate"), F.round(F.coalesce("i", "f", zero), 9).alias("incr_rate"))


def medium_stats(archive: DataFrame, placement: DataFrame) -> DataFrame:
    """(medium, archives, full_bytes, incr_bytes, first_at, last_at): first and last are of the first and last run by id."""
    rows = placement.select(*KEY, "medium").distinct().join(archive.select(*KEY, "compressed", "created_at"), KEY)
    runs = rows.groupBy("medium", "run").agg(F.count("*").alias("n"), _sum_if(F.col("level") == 0, "compressed").alias("f"), _sum_if(F.col("level") > 0, "compressed").alias("i"), F.max("created_at").alias("at"))
    key = C.run_key("run")
    return runs.groupBy("medium").agg(F.sum("n").alias("archives"), F.sum("f").alias("full_bytes"), F.sum("i").alias("incr_bytes"), F.min_by("at", key).alias("first_at"), F.max_by("at", key).alias("last_at"))


def medium_growth_curve(archive: DataFrame, placement: DataFrame) -> DataFrame:
    """(medium, run, bytes, cumulative): bytes that each run added to a medium, and the running total."""
    rows = placement.select(*KEY, "medium").distinct().join(archive.select(*KEY, "compressed"), KEY)
    runs = rows.groupBy("medium", "run").agg(F.sum("compressed").alias("bytes"))
    w = Window.partitionBy("medium").orderBy(C.run_key("run")).rowsBetween(Window.unboundedPreceding, 0)
    return runs.withColumn("cumulative", F.sum("bytes").over(w))


def per_volume(part_file: DataFrame) -> DataFrame:
    """(label, bytes, archives, runs, last_run): an archive's bytes count for its first volume only, archives and runs for every volume they touch."""
    rows = part_file.filter(F.col("label") != "")
    touched = rows.groupBy("label").agg(F.countDistinct("dle", "run", "level").alias("archives"), F.countDistinct("run").alias("runs"), F.max("run").alias("last_run"))
    first = rows.groupBy(*KEY).agg(F.sum("size").alias("bytes"), F.min_by("label", "part_no").alias("label"))
    return touched.join(first.groupBy("label").agg(F.sum("bytes").alias("bytes")), "label", "left").fillna(0, ["bytes"])


def volume_fill(part_file: DataFrame, volume: DataFrame) -> DataFrame:
    """(label, files, used): bytes charged to each registered volume: its label, and every part and commit with a header block."""
    rows = part_file.filter(F.col("label") != "").select("label", *KEY, "size")
    parts = rows.select("label", C.file_cost(F.lit("archive"), F.col("size")).alias("cost"))
    commits = rows.select("label", *KEY).distinct().select("label", C.file_cost(F.lit("commit"), F.lit(C.VOLUME_BLOCK)).alias("cost"))
    labels = volume.select("label", C.file_cost(F.lit("label"), F.lit(C.VOLUME_BLOCK)).alias("cost"))
    charged = parts.unionByName(commits).unionByName(labels).groupBy("label").agg(F.count("*").alias("files"), F.sum("cost").cast("long").alias("used"))
    return charged.join(volume.select("label"), "label", "left_semi")


def volume_segments(part_file: DataFrame) -> DataFrame:
    """(medium, label, pos, run, dle, begin, end): parts along each volume in order of position."""
    w = Window.partitionBy("medium", "label").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = part_file.filter(F.col("label") != "").withColumn("end", F.sum("size").over(w))
    return rows.select("medium", "label", "pos", "run", "dle", (F.col("end") - F.col("size")).alias("begin"), "end")


def dump_report(dump_stat: DataFrame) -> DataFrame:
    """(kind, n, orig, out, files, seconds, percent, rate): totals, fulls and incrementals, from one cube."""
    rows = dump_stat.withColumn("is_full", F.col("level") == 0)
    out = rows.cube("is_full").agg(F.count("*").alias("n"), F.sum("orig").alias("orig"), F.sum("out").alias("out"), F.sum("files").alias("files"), F.sum("seconds").alias("seconds"))
    kind = F.when(F.col("is_full"), "full").when(~F.col("is_full"), "incr").otherwise("total")
    return out.select(kind.alias("kind"), "n", "orig", "out", "files", "seconds", C.comp_pct("orig", "out").alias("percent"), C.dump_rate("orig", "seconds").alias("rate"))


def landing_stats(landing_stat: DataFrame) -> DataFrame:
    """(landing, bytes, rate, utilisation): bytes over busy time, and busy over wall time, at most 1."""
    out = landing_stat.groupBy("landing").agg(F.sum("bytes").alias("bytes"), F.sum("busy_seconds").alias("busy"), F.sum("wall_seconds").alias("wall"))
    return out.select("landing", "bytes", C.dump_rate("bytes", "busy").alias("rate"), F.when(F.col("wall") > 0, F.round(F.least(F.lit(1.0), F.col("busy") / F.col("wall")), 6)).alias("utilisation"))


def digest(run_log: DataFrame) -> DataFrame:
    """(status, runs, bytes, first_at, last_at): runs by status."""
    rows = run_log.withColumn("status", C.run_status("outcome", "warnings"))
    return rows.groupBy("status").agg(F.count("*").alias("runs"), F.coalesce(F.sum("bytes_moved"), F.lit(0)).alias("bytes"), F.min("started_at").alias("first_at"), F.max("ended_at").alias("last_at"))


def last_per_command(run_log: DataFrame) -> DataFrame:
    return run_log.withColumn("status", C.run_status("outcome", "warnings")).groupBy("command").agg(F.max_by(F.struct("run_id", "status", "started_at", "ended_at"), "ended_at").alias("r")).select("command", "r.*")


def recovery_health(drill_health: DataFrame) -> DataFrame:
    """(degrading, failing, never, overdue): sources by what their drills say."""
    n = lambda c: _sum_if(c, F.lit(1))
    return drill_health.agg(n(C.is_degrading("drilled", "ok", "was_ok")).alias("degrading"), n(F.col("drilled") & ~F.col("ok")).alias("failing"), n(~F.col("drilled")).alias("never"), n(F.col("overdue")).alias("overdue"))


def stale_dles(configured: DataFrame, archive: DataFrame, window_days: int, now: Column) -> DataFrame:
    """(dle, last_at): configured sources without an archive, or whose last one is a window old or more."""
    last = archive.groupBy("dle").agg(F.max("created_at").alias("last_at"))
    age = C.epoch(now) - C.epoch("last_at")
    return configured.select("dle").distinct().join(last, "dle", "left").filter(F.col("last_at").isNull() | (age >= window_days * 86400))


def stale_hosts(stale: DataFrame, configured: DataFrame) -> DataFrame:
    """(host, stale, all): hosts with two stale sources or more. configured has dle and host."""
    rows = configured.select("dle", "host").distinct().join(stale.select("dle", F.lit(1).alias("_s")), "dle", "left")
    return rows.groupBy("host").agg(F.coalesce(F.sum("_s"), F.lit(0)).cast("long").alias("stale"), F.count("*").alias("all")).filter("stale >= 2").withColumn("whole", F.col("stale") == F.col("all"))


def drill_coverage(configured: DataFrame, ledger: DataFrame, window_days: int, now: Column) -> DataFrame:
    """(dles, drilled, never, failed, overdue): a source is overdue if never drilled, failed, or drilled a window ago or more."""
    rows = configured.select("dle").distinct().join(ledger, "dle", "left")
    never, failed = F.col("last_drill").isNull(), F.coalesce(~F.col("ok"), F.lit(False))
    old = C.epoch(now) - C.epoch("last_drill") >= window_days * 86400
    n = lambda c: _sum_if(c, F.lit(1))
    return rows.agg(F.count("*").alias("dles"), n(~never).alias("drilled"), n(never).alias("never"), n(failed).alias("failed"), n(never | failed | old).alias("overdue"))


def drill_overdue(configured: DataFrame, ledger: DataFrame, window_days: int, now: Column) -> DataFrame:
    """(dle): configured sources never drilled, failed, or drilled a window ago or more."""
    rows = configured.select("dle").distinct().join(ledger, "dle", "left")
    old = C.epoch(now) - C.epoch("last_drill") >= window_days * 86400
    return rows.filter(F.col("last_drill").isNull() | F.coalesce(~F.col("ok"), F.lit(False)) | old).select("dle")


def drill_select(configured: DataFrame, ledger: DataFrame, chain_links: DataFrame, window_days: int, now: Column, sample: int) -> DataFrame:
    """The next sources to drill: never drilled first, then the oldest drill, the longest chain, the oldest full by its day, the name. chain_links has dle, links, full_at of chains that reach a full. This is a top-n report."""
    rows = configured.select("dle").distinct().join(chain_links, "dle").join(ledger.select("dle", "last_drill", "ok"), "dle", "left")
    recent = F.coalesce(F.col("ok") & (C.epoch(now) - C.epoch("last_drill") < window_days * 86400), F.lit(False))
    order = [F.col("last_drill").isNotNull(), F.col("last_drill"), F.col("links").desc(), C.run_date("full_at"), F.col("dle")]
    return rows.filter(~recent).orderBy(*order).limit(sample).select("dle", "last_drill", "links", "full_at")


def sample_plan(chain: DataFrame, part_file: DataFrame, ledger: DataFrame, drilled: DataFrame) -> DataFrame:
    """(dle, run, medium, part_no, parts, size): the part of each archive of a chain to test next on the medium its source is drilled from (drilled: dle, medium): part number drills modulo parts, and its size.

    A chain of which an archive has no copy there, or a part without a size, gives no row: it is to be checked whole.
    """
    links = chain.select("dle", "run").distinct()
    rows = links.join(drilled.select("dle", "medium"), "dle").join(ledger.select("dle", "drills"), "dle", "left")
    own = part_file.join(drilled.select("dle", "medium"), ["dle", "medium"], "left_semi")
    counted = own.groupBy("run", "dle", "medium").agg(F.count("*").alias("parts"), F.min(F.col("size").isNotNull()).alias("_sealed"))
    rows = rows.join(counted, ["dle", "run", "medium"], "left").withColumn("_good", F.coalesce("_sealed", F.lit(False)))
    whole = rows.groupBy("dle").agg(F.min("_good").alias("_whole")).filter("_whole")
    picked = rows.join(whole, "dle").select("dle", "run", "medium", (F.coalesce("drills", F.lit(0)) % F.col("parts")).cast("int").alias("part_no"), "parts")
    return picked.join(own.select("run", "dle", "medium", "part_no", "size"), ["dle", "run", "medium", "part_no"]).select("dle", "run", "medium", "part_no", "parts", "size")


def daily_load(archive: DataFrame) -> DataFrame:
    """(day, full_bytes, incr_bytes, fulls, incrs)."""
    full = F.col("level") == 0
    return archive.groupBy(C.run_date("run").alias("day")).agg(_sum_if(full, "compressed").alias("full_bytes"), _sum_if(~full, "compressed").alias("incr_bytes"), _sum_if(full, F.lit(1)).alias("fulls"), _sum_if(~full, F.lit(1)).alias("incrs"))


def balance(load: DataFrame) -> DataFrame:
    """(days, peak, mean, cv, verdict): how even the daily load is. The mean is whole bytes, and the deviation is taken from it."""
    total = load.withColumn("b", F.col("full_bytes") + F.col("incr_bytes"))
    sums = total.agg(F.count("*").alias("days"), F.max("b").alias("peak"), F.sum("b").alias("s"), F.sum(F.col("b").cast("decimal(38,0)") * F.col("b")).cast("double").alias("q"))
    mean = F.expr("s div days")
    out = sums.withColumn("mean", mean)
    variance = F.col("q") / F.col("days") - 2.0 * F.col("mean") * (F.col("s") / F.col("days")) + F.col("mean").cast("double") * F.col("mean")
    out = out.withColumn("cv", F.when(F.col("mean") > 0, F.round(F.sqrt(F.greatest(variance, F.lit(0.0))) / F.col("mean"), 6)).otherwise(F.lit(0.0)))
    return out.select("days", "peak", "mean", "cv", C.balance_verdict("cv").alias("verdict"))


def load_weights(daily: DataFrame) -> DataFrame:
    """(day, bytes, weight): each day's load with its weight of 0 to 4 against the heaviest day."""
    rows = daily.select("day", (F.col("full_bytes") + F.col("incr_bytes")).alias("bytes"))
    most = rows.agg(F.max("bytes").alias("_most"))
    return rows.crossJoin(F.broadcast(most)).select("day", "bytes", C.weight_bucket("bytes", "_most").alias("weight"))  # one row


def activity_matrix(archive: DataFrame, now: Column, days: int = 35) -> DataFrame:
    """(dle, day, mark, levels, bytes, run): what each source did on each day with a dump within the last days: partial before full before incr; the run where there was one only."""
    day = F.to_date(C.run_date("run"))
    rows = archive.withColumn("day", day).filter((F.col("day") > F.date_sub(F.to_date(now), days)) & (F.col("day") <= F.to_date(now)))
    mark = F.when(F.max(C.is_partial("unreadable")), "partial").when(F.min("level") == 0, "full").otherwise("incr")
    return rows.groupBy("dle", "day").agg(mark.alias("mark"), F.array_join(F.transform(F.sort_array(F.collect_set("level")), lambda x: x.cast("string")), ",").alias("levels"), F.sum("compressed").alias("bytes"), F.when(F.countDistinct("run") == 1, F.max("run")).alias("run"))


def restore_cost(located: DataFrame, cost_rate: DataFrame) -> DataFrame:
    """(dle, point, medium, bytes, parts, price): reading each chain, priced at the rates of the medium its first archive is read from. located comes from chains.located."""
    totals = located.groupBy("dle", "point").agg(F.min_by("medium", F.when(F.col("medium").isNotNull(), C.run_key("run"))).alias("medium"), F.sum("bytes").alias("bytes"), F.sum("parts").alias("parts"))
    rated = totals.join(F.broadcast(cost_rate), "medium", "left")
    return rated.select("dle", "point", "medium", "bytes", "parts", C.read_cost("bytes", "parts", "gib_month", "gib_egress", "per_1000").alias("price"))


def storage_cost(totals: DataFrame, cost_rate: DataFrame) -> DataFrame:
    rated = totals.join(F.broadcast(cost_rate), "medium", "left")
    return rated.select("medium", "bytes", C.monthly_cost("bytes", "gib_month", "gib_egress", "per_1000").alias("price"))


def read_order(refs: DataFrame) -> DataFrame:
    """refs (dle, run, level, label, pos) with place: one pass over the volumes, yet level by level within a source.

    A file waits for all lower levels of its source, so its effective key is the largest
    among its own and theirs; sorting by it is what taking the next ready file gives.
    """
    own = F.struct("label", "pos")
    lower = Window.partitionBy("dle").orderBy("level").rangeBetween(Window.unboundedPreceding, -1)
    keyed = refs.withColumn("_own", own).withColumn("_eff", F.greatest("_own", F.coalesce(F.max("_own").over(lower), F.col("_own"))))
    order = [F.col("_eff"), F.col("level"), F.col("_own")]
    # Numbered by range: each range counts its rows, and only the counts are summed up in one task.
    dealt = keyed.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    dealt = cut(dealt)
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("n"))
    before = sizes.select("_range", F.coalesce(F.sum("n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inner = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return dealt.join(F.broadcast(before), "_range").withColumn("place", (F.col("_before") + inner).cast("long")).drop("_own", "_eff", "_range", "_before")


def select_runs(archive: DataFrame, last: int | None = None, since: str | None = None, ids: list[str] | None = None) -> DataFrame:
    """(run): the last N runs, those dated since a day, or the named ones."""
    runs = archive.select("run").distinct()
    if last is not None:
        return runs.orderBy(C.run_key("run").desc()).limit(last)
    if since is not None:
        return runs.filter(C.run_date("run") >= since)
    return runs.filter(F.col("run").isin(ids or []))


def cap_runs(archive: DataFrame, n: int) -> DataFrame:
    """Archives of the newest n runs."""
    return archive.join(select_runs(archive, last=n), "run", "left_semi")


def expected_volume(volume: DataFrame, reusable: DataFrame, appendable: bool) -> DataFrame:
    """(label, used, fresh): the volume to load next: the newest written with its fill if runs are appended, else the oldest that may be written anew; fresh, without a label, where there is none."""
    pool = volume.select("label", "last_run", "used") if appendable else reusable.select("label", "last_run", F.lit(0).cast("long").alias("used"))
    order = [F.col("last_run").desc() if appendable else F.col("last_run"), F.col("label")]
    one = pool.orderBy(*order).limit(1).agg(F.max("label").alias("label"), F.coalesce(F.max("used"), F.lit(0)).alias("used"))
    return one.select("label", "used", F.col("label").isNull().alias("fresh"))
