"""What each medium must keep, what it may reclaim, and in which order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions import columns as C
from fleetlens.operators.chains import _any_long, _long, base_of, stranded, with_lost
from fleetlens.plans.lineage import cut, cut_counting, preceding

DAY = 86400


def young(min_age_days: Column, created_at: Column, now: Column) -> Column:
    """Within the minimum age. An unknown commit time is not young."""
    return F.coalesce((min_age_days > 0) & (C.epoch(now) - C.epoch(created_at) < min_age_days.cast("long") * DAY), F.lit(False))


def held_archives(archive: DataFrame, placement: DataFrame, medium_dim: DataFrame) -> DataFrame:
    """A row for each (medium, archive) copy, with the medium's figures. The dimension has a row for each medium."""
    # Dealt by archive once, for both the copies told apart and their archives.
    copies = placement.select("medium", "run", "dle", "level").repartition("run", "dle", "level").distinct()
    return copies.join(archive, ["run", "dle", "level"]).join(F.broadcast(medium_dim.select("medium", "capacity", "min_age_days", "labeled")), "medium")


def retention_floor(held: DataFrame, lost: DataFrame, now: Column) -> DataFrame:
    """held with kind: CONDEMNED, AGE, LAST_FULL, CHAIN, or null where nothing keeps the copy.

    lost (dle, run, stranded) is judged over the whole catalog, the rest for each medium.
    Whether a run is young is summed up by run and joined back, as a nightly run holds every source.
    Copies are dealt by source once; what is lost of a source meets them as a list.
    """
    held = held.withColumn("_young", young(F.col("min_age_days"), F.col("created_at"), now))
    young_runs = cut(held.filter("_young").select("medium", "run").distinct().withColumn("_run_young", F.lit(True)))
    rows = held.join(young_runs, ["medium", "run"], "left").withColumn("_run_young", F.coalesce("_run_young", F.lit(False)))
    gone = lost.filter("stranded").groupBy("dle").agg(F.collect_set("run").alias("_gone"))
    rows = rows.repartition("dle").join(gone, "dle", "left").withColumn("_lost", F.coalesce(F.array_contains("_gone", F.col("run")), F.lit(False))).drop("_gone")
    return _pinned(rows, ["medium"]).drop("_young", "_run_young", "_lost")


def floor_of_archives(copied: DataFrame, medium_dim: DataFrame, now: Column) -> DataFrame:
    """retention_floor of archives with media (see placement.with_media), judged over their whole catalog: only young runs are joined, and archives are dealt once, by source."""
    ask = lambda df: df.withColumn("medium", F.explode("media")).drop("media").join(F.broadcast(medium_dim.select("medium", "capacity", "min_age_days", "labeled")), "medium").withColumn("_young", young(F.col("min_age_days"), F.col("created_at"), now))
    young_runs = cut(ask(copied).filter("_young").select("medium", "run").distinct().withColumn("_run_young", F.lit(True)))
    rows = ask(with_lost(copied)).withColumnRenamed("stranded", "_lost").join(young_runs, ["medium", "run"], "left").withColumn("_run_young", F.coalesce("_run_young", F.lit(False)))
    return _pinned(rows, ["medium"], F.col("place")).drop("_young", "_run_young", "_lost", "place")


def _pinned(rows: DataFrame, by: list[str], place: Column | None = None) -> DataFrame:
    """rows (by..., dle, run, level, _young, _run_young, _lost) with kind.

    A source's archives on a medium are numbered in run order and cut into segments at
    fulls; what the segment needs is up to its last anchor: a restorable archive of a
    young run, or the newest archive. Numbers and anchors are window results, so no chain
    is walked. place is a number that puts a source's archives in run order, where it is known.
    """
    # Sorted by source first: what tells most rows apart.
    line = Window.partitionBy("dle", *by).orderBy(C.run_key("run") if place is None else place)
    whole = Window.partitionBy("dle", *by)
    rows = rows.withColumns({"_i": F.row_number().over(line), "_seg": F.sum((F.col("level") == 0).cast("int")).over(line.rowsBetween(Window.unboundedPreceding, 0))})
    rows = rows.withColumns({"_n": F.count("*").over(whole), "_full": F.max(F.when(F.col("level") == 0, F.col("_i"))).over(whole)})
    anchor = ~F.col("_lost") & (F.col("_run_young") | (F.col("_i") == F.col("_n")))
    rows = rows.withColumn("_to", F.max(F.when(anchor, F.col("_i"))).over(Window.partitionBy("dle", *by, "_seg")))
    kind = (
        F.when(F.col("_lost") & ~F.col("_young"), "CONDEMNED")
        .when(F.col("_young"), "AGE")
        .when((F.col("level") == 0) & (F.col("_i") == F.col("_full")), "LAST_FULL")
        .when((F.col("_seg") > 0) & (F.col("_to") >= F.col("_i")), "CHAIN")
    )
    return rows.withColumn("kind", kind).drop("_i", "_n", "_seg", "_full", "_to")


def strength(kind: Column) -> Column:
    return F.when(kind == "AGE", 1).when(kind == "LAST_FULL", 2).when(kind == "CHAIN", 3)


def floor_by_run(floor: DataFrame) -> DataFrame:
    """(medium, run, kind, dle): the strongest pin of each run that is kept; ties go to the first source."""
    pinned = floor.filter("kind is not null and kind <> 'CONDEMNED'")
    return pinned.groupBy("medium", "run").agg(F.min(F.struct(strength(F.col("kind")).alias("s"), "dle", "kind")).alias("p")).select("medium", "run", "p.kind", "p.dle")


def reusable_volumes(floor: DataFrame, part_file: DataFrame, volume: DataFrame) -> DataFrame:
    """(label, last_run, place): volumes none of whose runs is kept, oldest first."""
    kept = floor_by_run(floor).select("medium", "run")
    busy = part_file.filter(F.col("label") != "").join(kept, ["medium", "run"], "left_semi").select("label").distinct()
    return volume.join(busy, "label", "left_anti").select("label", "last_run")


def _order(nodes: DataFrame) -> DataFrame:
    """nodes (medium, dle, run, k, base, wanted, ...) with m: the latest (run, source) among the node and all that build on it, and free: nothing that stays builds on it, and it need not stay itself.

    Bases are earlier runs, so a source's nodes are gone through from the newest on, and
    each asks those that name it as their base. Sources with over LONG nodes on a medium go
    by rounds.
    """
    line = F.struct("medium", "dle").alias("dle")
    keyed = nodes.select(line)
    if not _any_long(keyed):
        return _order_listed(nodes)
    long = cut(_long(keyed).select("dle.*"))
    return _order_listed(nodes.join(long, ["medium", "dle"], "left_anti")).unionByName(_order_rounds(nodes.join(long, ["medium", "dle"], "left_semi")))


def _order_listed(nodes: DataFrame) -> DataFrame:
    rest = [c for c in nodes.columns if c not in ("medium", "dle")]
    lines = nodes.groupBy("medium", "dle").agg(F.sort_array(F.collect_list(F.struct("k", *(c for c in rest if c != "k"))), asc=False).alias("_all"))
    none = F.array().cast("array<struct<base:string,m:string,blocked:boolean>>")

    def hand(found: Column, x: Column) -> Column:
        on = F.filter(found, lambda f: f["base"] == x["run"])
        m = F.greatest(x["k"], F.array_max(F.transform(on, lambda f: f["m"])))
        blocked = ~x["wanted"] | F.exists(on, lambda f: f["blocked"])
        return F.concat(found, F.array(F.struct(x["base"].alias("base"), m.alias("m"), blocked.alias("blocked"))))

    found = lines.withColumn("_found", F.aggregate("_all", none, hand))
    rows = found.select("medium", "dle", F.explode(F.arrays_zip("_all", "_found")).alias("z"))
    return rows.select("medium", "dle", *(F.col(f"z._all.{c}").alias(c) for c in rest), F.struct(F.col("z._found.m").alias("k"), "dle").alias("m"), (~F.col("z._found.blocked")).alias("free"))


def _order_rounds(nodes: DataFrame) -> DataFrame:
    """A node is blocked while anything that builds on it stays. Each round a node hands what it knows to the base that is twice as far away as in the round before, so a chain of n archives takes log n rounds."""
    state = cut(nodes.select("medium", "dle", "run", "k", F.struct("k", "dle").alias("m"), (~F.col("wanted")).alias("blocked"), "base"))
    while True:
        up = state.filter("base is not null").groupBy("medium", "dle", F.col("base").alias("run")).agg(F.max("m").alias("m2"), F.max("blocked").alias("b2"))
        far = state.select("medium", "dle", F.col("run").alias("base"), F.col("base").alias("base2"))
        step = state.join(up, ["medium", "dle", "run"], "left").join(far, ["medium", "dle", "base"], "left")
        step = step.select("medium", "dle", "run", "k", F.greatest("m", F.coalesce("m2", "m")).alias("m"), (F.col("blocked") | F.coalesce("b2", F.lit(False))).alias("blocked"), F.col("base2").alias("base"))
        state, open_rows = cut_counting(step, F.col("base").isNotNull())
        if not open_rows:
            return nodes.join(state.select("medium", "dle", "run", "m", (~F.col("blocked")).alias("free")), ["medium", "dle", "run"])


def reclaim_plan(floor: DataFrame, target_share: float = 1.0, targets: DataFrame | None = None) -> DataFrame:
    """(medium, run, dle, bytes, phase, place): copies to delete, in order.

    Condemned copies go first and always. Then, on a medium with a capacity, the oldest
    copies that nothing keeps go until what is left fits; a base goes only after all that
    builds on it. Media with labelled volumes reclaim whole volumes and give nothing here.

    Deleting always the oldest copy on which nothing depends is the order by (m, newest
    first) with m from _order, as a base freed by its last dependent is older than all
    others that are ready. The plan is the prefix at which the running total meets the
    target (targets: medium, target; else target_share of the capacity). Totals and places
    along the order are taken by ranges, so a medium may hold any number of copies.
    """
    rows = floor.filter("not labeled").withColumn("k", C.run_key("run"))
    slim = cut(rows.select("medium", "dle", "run", "k", "level", "base_run", "compressed", "capacity", F.coalesce("kind", F.lit("")).alias("kind")))
    based = medium_bases(slim).drop("level", "base_run").withColumn("wanted", F.col("kind") == "CONDEMNED")
    first = cut(_order(based))
    # What builds on a condemned copy that goes is gone too, so no base of what is left is missing.
    left = first.filter("not free").drop("m", "free")
    second = _order(left.withColumn("wanted", F.col("kind").isin("", "CONDEMNED")))
    totals = left.groupBy("medium").agg(F.sum("compressed").alias("total"), F.max("capacity").alias("capacity"))
    if targets is not None:
        totals = totals.join(F.broadcast(targets), "medium")
    else:
        totals = totals.withColumn("target", (F.col("capacity") * target_share).cast("long"))
    go = lambda df, phase: df.filter("free").select("medium", "dle", "run", "k", "m", F.col("compressed").alias("bytes"), F.lit(phase).alias("phase"))
    both = go(first, 1).unionByName(go(second, 2))
    order = [F.col("phase"), F.col("m"), F.col("k").desc(), F.col("dle").desc()]
    second_bytes = F.when(F.col("phase") == 2, F.col("bytes")).otherwise(F.lit(0))
    ranked = preceding(both.withColumns({"_bytes": second_bytes, "_one": F.lit(1).cast("long")}), ["medium"], order, {"_before": (F.sum, "_bytes"), "_place": (F.sum, "_one")})
    zero = F.lit(0).cast("long")
    before = F.coalesce("_before", zero)
    ranked = ranked.join(F.broadcast(totals), "medium", "left")  # a row for each medium
    needed = (F.col("phase") == 1) | ((F.col("capacity") > 0) & (F.col("total") - before > F.greatest("target", zero)))
    return ranked.filter(needed).select("medium", "run", "dle", "bytes", "phase", (F.coalesce("_place", zero) + 1).cast("int").alias("place"))


def medium_bases(copies: DataFrame) -> DataFrame:
    """copies (medium, dle, run, level, base_run, ...) with base: bases count where both copies are on the medium."""
    line = F.struct("medium", "dle")
    based = base_of(copies.withColumns({"_source": F.col("dle"), "dle": line}))
    return based.withColumn("dle", F.col("_source")).drop("_source")


def capacity_status(floor: DataFrame, medium_dim: DataFrame, incoming: int = 0) -> DataFrame:
    """Stored, protected and reclaimable bytes of each medium against its capacity; room -1 means unbounded.

    residual is what a prune to nothing leaves: stored less all that the floor clears
    (with labelled volumes nothing is cleared copy by copy). age_bound: over, and all that
    is kept is kept by its age.
    """
    kept = F.col("kind").isNotNull() & (F.col("kind") != "CONDEMNED")
    used = floor.groupBy("medium").agg(
        F.sum("compressed").alias("stored"), F.sum(F.when(kept, F.col("compressed")).otherwise(0)).alias("protected"), F.sum(F.when(kept | F.col("labeled"), F.col("compressed")).otherwise(0)).alias("residual"), F.sum((kept & (F.col("kind") != "AGE")).cast("long")).alias("chained"),
    )
    rows = medium_dim.select("medium", "capacity").join(used, "medium", "left").fillna(0, ["stored", "protected", "residual", "chained"])
    bounded = F.col("capacity") > 0
    over = bounded & (F.col("residual") + incoming > F.col("capacity"))
    return rows.select(
        "medium", "capacity", "stored", "protected", "residual", (bounded & (F.col("stored") > F.col("capacity"))).alias("over"),
        F.when(bounded, F.expr("(stored * 100) div capacity")).otherwise(F.lit(0)).cast("long").alias("percent"),
        F.when(bounded, F.col("capacity") - F.col("protected")).otherwise(F.lit(-1)).cast("long").alias("room"),
        over.alias("infeasible"), (over & (F.col("chained") == 0)).alias("age_bound"),
    )


def room_checks(floor: DataFrame, medium_dim: DataFrame) -> DataFrame:
    """(medium, newest, need, room, fits): whether another run of the newest run's size has room beside what is protected."""
    runs = floor.groupBy("medium", "run").agg(F.sum("compressed").alias("bytes"))
    newest = runs.groupBy("medium").agg(F.max_by(F.struct("run", "bytes"), C.run_key("run")).alias("r"))
    status = capacity_status(floor, medium_dim)
    return status.join(newest, "medium").select("medium", F.col("r.run").alias("newest"), F.col("r.bytes").alias("need"), "room", ((F.col("room") < 0) & (F.col("capacity") == 0) | (F.col("room") >= F.col("r.bytes"))).alias("fits"))


#: Days that are bits of one number.
DAYS_AT_ONCE = 62


def kept_days(held: DataFrame, days: DataFrame) -> DataFrame:
    """held with kept: the numbers of the sampled days (ascending, from 0) on which the floor of its medium kept a copy. days has `day`, the instants judged at, of any number: a copy has a row for each DAYS_AT_ONCE of them."""
    return _by_day(held, days, lambda rows: rows)


def _by_day(held: DataFrame, days: DataFrame, summed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """summed(rows of held with _kept, the bits of DAYS_AT_ONCE days) for all days, with kept, the numbers of the days, for _kept: what is summed by those bits needs no row a copy and day."""
    numbered = _numbered(days)
    blocks = max(1, -(-numbered.count() // DAYS_AT_ONCE))
    out = None
    for b in range(blocks):
        own = numbered.filter((F.col("k") >= b * DAYS_AT_ONCE) & (F.col("k") < (b + 1) * DAYS_AT_ONCE)).select("day")
        part = summed(_kept_block(held, own)).withColumn("kept", F.transform(_numbers("_kept"), lambda k: (k + b * DAYS_AT_ONCE).cast("int"))).drop("_kept")
        out = part if out is None else out.unionByName(part)
    return out


def _on(bits: str, day: Column) -> Column:
    return F.call_function("shiftright", F.col(bits), day).bitwiseAND(F.lit(1).cast("long")) == 1


def _numbers(bits: str) -> Column:
    """The days whose bits are set, ascending."""
    return F.filter(F.sequence(F.lit(0), F.lit(DAYS_AT_ONCE - 1)), lambda d: _on(bits, d))


def _kept_block(held: DataFrame, days: DataFrame) -> DataFrame:
    """held with _kept, the bits of the days on which a copy was kept, for DAYS_AT_ONCE days at the most; copies that no day sees are left out.

    A day sees what the medium held by then, and judges broken chains by that alone. Days
    are bits of one number, so a copy stays one row: a copy's days, a run's young days, the
    days on which it is the newest, and the days it is an anchor for the archives before it are
    sums of bits over the source's run order, for which copies are dealt by source once. This
    needs commits to come in run order (to the day sampled); sources with others are few and
    are worked on day by day.
    """
    listed = days.agg(F.array_sort(F.collect_set("day")).alias("_days")).withColumn("_ends", F.transform("_days", C.epoch))
    zero = F.lit(0).cast("long")
    below = lambda n: F.call_function("shiftleft", F.lit(1).cast("long"), n) - 1
    without = lambda a, b: a.bitwiseAND(F.bitwise_not(b))
    at, age = F.col("created_at"), F.col("min_age_days")
    end = C.epoch(at) + age.cast("long") * DAY
    # Days are in order, so those before the commit, and those up to the end of its youth, are counted; most commits are before all days.
    first = F.when(at > F.get("_days", F.lit(0)), F.size(F.filter("_days", lambda d: d < at))).otherwise(0)
    until = F.when((age > 0) & (end > F.get("_ends", F.lit(0))), F.size(F.filter("_ends", lambda d: d < end))).otherwise(0)
    rows = held.join(F.broadcast(listed), F.lit(True))  # one row
    rows = rows.withColumns({"_first": first, "_until": until, "_size": F.size("_days")}).drop("_days", "_ends")
    rows = rows.withColumns({"_in": without(below(F.col("_size")), below(F.col("_first"))), "_young": without(below(F.col("_until")), below(F.col("_first")))}).drop("_until", "_size").filter("_in <> 0")
    young_runs = cut(rows.filter("_young <> 0").groupBy("medium", "run").agg(F.expr("bit_or(_young)").alias("_run_young")))
    rows = rows.join(young_runs, ["medium", "run"], "left").withColumn("_run_young", F.coalesce("_run_young", zero))
    own = with_lost(rows.withColumns({"_source": F.col("dle"), "dle": F.struct("medium", "dle")})).withColumnRenamed("stranded", "_lost")
    ordered = Window.partitionBy("dle").orderBy("place")
    late = F.max("_first").over(ordered.rowsBetween(Window.unboundedPreceding, -1)) > F.col("_first")
    after = ordered.rowsBetween(1, Window.unboundedFollowing)
    full = F.col("level") == 0
    own = own.withColumns({"_late": F.coalesce(late, F.lit(False)), "_seg": F.sum(full.cast("int")).over(ordered.rowsBetween(Window.unboundedPreceding, 0)), "_fulls": F.when(full, F.col("_in")).otherwise(zero)})
    later = lambda c: F.coalesce(F.expr(f"bit_or({c})").over(after), zero)
    own = own.withColumns({"_odd": F.max("_late").over(Window.partitionBy("dle")), "_newest": without(F.col("_in"), later("_in")), "_last_full": without(F.col("_fulls"), later("_fulls"))})
    own = own.withColumn("_anchor", F.when(F.col("_lost"), zero).otherwise(F.col("_in").bitwiseAND(F.col("_run_young").bitwiseOR(F.col("_newest")))))
    onward = Window.partitionBy("dle", "_seg").orderBy("place").rowsBetween(0, Window.unboundedFollowing)
    chain = F.when(F.col("_seg") > 0, F.expr("bit_or(_anchor)").over(onward)).otherwise(zero)
    pins = F.col("_young").bitwiseOR(F.when(F.col("_lost"), zero).otherwise(F.col("_last_full").bitwiseOR(chain)))
    own = own.withColumn("_kept", F.col("_in").bitwiseAND(pins))
    done, odds = cut_counting(own.select(*(F.col("_source").alias(c) if c == "dle" else c for c in held.columns), "_kept", "_odd"), F.col("_odd"))
    out = done.filter("not _odd").drop("_odd")
    if odds:
        each = rows.join(done.filter("_odd").select("medium", "dle").distinct(), ["medium", "dle"], "left_semi").withColumn("_day", F.explode(_numbers("_in")))
        each = each.withColumns({"_young": _on("_young", F.col("_day")), "_run_young": _on("_run_young", F.col("_day"))})
        line = F.struct("medium", "dle", "_day")
        based = base_of(each.select(line.alias("dle"), "run", "level", "base_run"))
        lost = stranded(based).filter("stranded").select("dle.*", "run", F.lit(True).alias("_lost"))
        each = each.join(lost, ["medium", "dle", "_day", "run"], "left").withColumn("_lost", F.coalesce("_lost", F.lit(False)))
        pinned = _pinned(each, ["medium", "_day"]).withColumn("_keep", F.coalesce(F.col("kind") != "CONDEMNED", F.lit(False)))
        bit = F.when(F.col("_keep"), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_day"))).otherwise(zero)
        kept = pinned.withColumn("_bit", bit).groupBy("medium", "dle", "run").agg(F.expr("bit_or(_bit)").alias("_kept"))
        out = out.unionByName(held.join(kept, ["medium", "dle", "run"]).select(*held.columns, "_kept"))
    return out


def _numbered(days: DataFrame) -> DataFrame:
    """(k, day) of the sampled days."""
    return days.agg(F.array_sort(F.collect_set("day")).alias("d")).select(F.posexplode("d").alias("k", "day"))


def protected_history(held: DataFrame, days: DataFrame) -> DataFrame:
    """(day, medium, protected, copies): bytes that each sampled day's floor kept."""
    copies = held.select("medium", "run", "dle", "level", "base_run", "created_at", "min_age_days", "compressed")
    same = _by_day(copies, days, lambda rows: rows.groupBy("medium", "_kept").agg(F.sum("compressed").alias("protected"), F.count("*").alias("copies")))
    sums = same.withColumn("k", F.explode("kept")).groupBy("k", "medium").agg(F.sum("protected").alias("protected"), F.sum("copies").alias("copies"))
    return sums.join(F.broadcast(_numbered(days)), "k").select("day", "medium", "protected", "copies")


def volumes_in_use_history(held: DataFrame, days: DataFrame, part_file: DataFrame, volume: DataFrame) -> DataFrame:
    """(day, volumes): labelled volumes, written by then, that held a kept run on each sampled day. volume has label and written_at. Copies on media without labels are not asked for."""
    labels = cut(part_file.filter(F.col("label") != "").select("medium", "run", "label").distinct())
    copies = held.select("medium", "run", "dle", "level", "base_run", "created_at", "min_age_days")
    copies = cut(copies.join(F.broadcast(labels.select("medium").distinct()), "medium", "left_semi"))  # a row for each medium
    runs = _by_day(copies, days, lambda rows: rows.groupBy("medium", "run").agg(F.expr("bit_or(_kept)").alias("_kept")))
    kept = runs.select("medium", "run", F.explode("kept").alias("k"))
    rows = kept.join(labels.join(volume.select("label", "written_at"), "label"), ["medium", "run"]).join(F.broadcast(_numbered(days)), "k")
    return rows.filter(F.col("written_at").isNull() | (F.col("written_at") <= F.col("day"))).groupBy("day").agg(F.countDistinct("label").alias("volumes"))
