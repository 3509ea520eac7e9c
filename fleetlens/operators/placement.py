"""Where copies are, where they should be, and which are missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions import columns as C
from fleetlens.plans.lineage import cut, tasks

KEY = ["run", "dle", "level"]


def with_media(archive: DataFrame, placement: DataFrame, key: list[str]) -> DataFrame:
    """archive with media: the sorted names of the media that have a copy, none for an archive without; key names the columns that tell archives apart in both."""
    copies = placement.groupBy(*key).agg(F.sort_array(F.collect_set("medium")).alias("media"))
    return archive.join(copies, key, "left").withColumn("media", F.coalesce("media", F.array().cast("array<string>")))


def archives_on(archive: DataFrame, placement: DataFrame, medium: str) -> DataFrame:
    return archive.join(placement.filter(F.col("medium") == medium), KEY, "left_semi")


def placed_archives_on(archive: DataFrame, placement: DataFrame, medium: str) -> DataFrame:
    """Archives on a medium with their parts and bytes there."""
    return archive.join(placement.filter(F.col("medium") == medium).select(*KEY, "parts", "bytes"), KEY)


def runs_on(placement: DataFrame, medium: str) -> DataFrame:
    return placement.filter(F.col("medium") == medium).select("run").distinct()


def runs_on_label(part_file: DataFrame) -> DataFrame:
    """(label, run): runs with any file on each volume."""
    return part_file.filter(F.col("label") != "").select("label", "run").distinct()


def missing_on(archive: DataFrame, placement: DataFrame, medium: str) -> DataFrame:
    return archive.join(placement.filter(F.col("medium") == medium), KEY, "left_anti")


def missing_volumes(part_file: DataFrame, volume: DataFrame) -> DataFrame:
    """(label, runs, n): volumes that files name but no scan has seen, with their runs."""
    lost = runs_on_label(part_file).join(volume.select("label"), "label", "left_anti")
    return lost.groupBy("label").agg(F.array_join(F.sort_array(F.collect_set("run")), ",").alias("runs"), F.countDistinct("run").alias("n"))


def last_fulls(archive: DataFrame) -> DataFrame:
    return archive.filter("level = 0").groupBy("dle").agg(F.max(C.run_key("run")).alias("last_full"))


def owed(min_age_days: Column, now: Column) -> Column:
    """Whether a medium is still owed an archive: on the source's live chain, or within the minimum age."""
    young = (min_age_days > 0) & F.coalesce(C.epoch(now) - C.epoch("created_at") < min_age_days.cast("long") * 86400, F.lit(False))
    return F.col("last_full").isNull() | (C.run_key("run") >= F.col("last_full")) | young


def copy_class(archive: DataFrame, placement: DataFrame, route: DataFrame, sync_rule: DataFrame, medium_dim: DataFrame, now: Column, of: DataFrame | None = None) -> DataFrame:
    """(run, dle, level, medium, class): 3 routed, 2 promised by a rule, 1 aged out, for each copy that is or was expected.

    A rule without a source promises every archive to a medium that is no source's landing;
    a rule with one promises exactly what the source holds, within its last runs. With `of`
    (archives with media, see with_media) only the copies of these are given; last fulls and
    newest runs are still those of all.
    """
    ages = F.broadcast(medium_dim.select("medium", "min_age_days"))
    # Archives are dealt by source and marks by copy to a number of tasks: what one of them sorts and groups does not grow by being joined with others.
    n = tasks(archive.sparkSession)
    base = (archive if of is None else of).select(*KEY, "created_at").repartition(n, "dle").join(last_fulls(archive), "dle", "left")
    routed = base.join(route.select("dle", "medium"), "dle").join(ages, "medium")
    routed = routed.select(*KEY, "medium", F.when(owed(F.col("min_age_days"), now), 3).otherwise(1).alias("class"))
    landings = route.select(F.col("medium").alias("dst")).distinct()
    rules = sync_rule.filter("dst <> '' and dst <> src")
    auto = rules.filter("src = ''").join(landings, "dst", "left_anti")
    # A rule that promises the last n runs promises all from the n-th newest on; only the newest runs are ordered for it.
    runs = archive.select(C.run_key("run").alias("_key")).distinct()
    limits = [r.last_n for r in auto.select("last_n").distinct().collect() if r.last_n > 0]  # rules are configuration
    since = auto.filter("last_n <= 0").select("last_n", F.lit("").alias("_since")).distinct()
    for last in limits:
        since = since.unionByName(runs.orderBy(F.col("_key").desc()).limit(last).agg(F.min("_key").alias("_since")).select(F.lit(last).alias("last_n"), "_since"))
    mirrored = base.join(F.broadcast(auto.join(since, "last_n")), C.run_key("run") >= F.col("_since")).join(F.broadcast(medium_dim.select(F.col("medium").alias("dst"), "min_age_days")), "dst")
    mirrored = mirrored.select(*KEY, F.col("dst").alias("medium"), F.when(owed(F.col("min_age_days"), now), 2).otherwise(1).alias("class"))
    sources = placement.select("medium", *KEY).distinct().withColumnRenamed("medium", "src")
    held = sources if of is None else of.select(*KEY, F.explode("media").alias("src"))
    ranked = sources.select("src", "run").distinct().withColumn("_rank", F.dense_rank().over(Window.partitionBy("src").orderBy(C.run_key("run").desc())))
    pulled = held.join(F.broadcast(rules.filter("src <> ''")), "src").join(ranked, ["src", "run"]).filter("last_n <= 0 or _rank <= last_n")
    pulled = pulled.select(*KEY, F.col("dst").alias("medium"), F.lit(2).alias("class"))
    return routed.unionByName(mirrored).unionByName(pulled).repartition(n, *KEY, "medium").groupBy(*KEY, "medium").agg(F.max("class").alias("class"))


def _dealt(placement: DataFrame) -> DataFrame:
    """(run, dle, level, medium), a row a copy, dealt as classes are."""
    return placement.select(*KEY, "medium").repartition(tasks(placement.sparkSession), *KEY, "medium").distinct()


def judge_copies(classes: DataFrame, placement: DataFrame) -> DataFrame:
    """Copies of each (run, medium): held, and routed, promised and aged ones with what is missing of them."""
    held = _dealt(placement).withColumn("_held", F.lit(True))
    rows = classes.join(held, [*KEY, "medium"], "full").withColumn("_held", F.coalesce("_held", F.lit(False)))
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    k, h = F.col("class"), F.col("_held")
    out = rows.groupBy("run", "medium").agg(n(h).alias("held"), n(k == 3).alias("routed"), n((k == 3) & h).alias("routed_held"), n(k == 2).alias("promised"), n((k == 2) & h).alias("promised_held"), n(k == 1).alias("aged"))
    return out.withColumn("missing", F.col("routed") - F.col("routed_held")).withColumn("behind", F.col("promised") - F.col("promised_held"))


def copies_summary(judged: DataFrame) -> DataFrame:
    """(run, medium, status): what a run's copy on a medium is."""
    expected = F.col("routed") + F.col("promised")
    met = F.col("routed_held") + F.col("promised_held")
    status = (
        F.when((F.col("held") == 0) & (F.col("routed") > 0), "missing")
        .when((F.col("held") == 0) & (F.col("promised") > 0), "not yet synced")
        .when(F.col("missing") > 0, F.concat(F.lit("partial "), met.cast("string"), F.lit("/"), expected.cast("string")))
        .when(F.col("behind") > 0, F.concat(F.lit("behind "), F.col("behind").cast("string")))
        .when(F.col("held") > 0, "ok")
        .otherwise("aged")
    )
    return judged.select("run", "medium", status.alias("status"))


def placement_grid(archive: DataFrame, classes: DataFrame, placement: DataFrame) -> DataFrame:
    """(run, dle, level, medium, class, held): each archive against each medium that expects or holds it."""
    held = _dealt(placement).withColumn("held", F.lit(True))
    return archive.select(*KEY).join(classes.join(held, [*KEY, "medium"], "full"), KEY).select(*KEY, "medium", F.coalesce("class", F.lit(0)).alias("class"), F.coalesce("held", F.lit(False)).alias("held"))


def copies_posture(archive: DataFrame, classes: DataFrame, placement: DataFrame, wanted: int = 2) -> DataFrame:
    """Archives with fewer than `wanted` copies, by reason, with the first of each in run order.

    none: no copy at all; backfill: a promise is not met yet; aged: copies rotated away;
    structural: no route or rule asks for more. Only short archives are judged.
    """
    return short_posture(cut(short_of(with_media(archive, placement, KEY), wanted)), classes)


def short_of(copied: DataFrame, wanted: int = 2) -> DataFrame:
    """Of archives with media (see with_media) those with fewer than `wanted` copies."""
    return copied.filter(F.size("media") < wanted)


def short_posture(short: DataFrame, classes: DataFrame) -> DataFrame:
    """copies_posture of short archives with media; classes may be those of all archives, or of these alone."""
    copies = F.size("media").cast("long")
    held = short.select(*KEY, F.explode("media").alias("medium")).withColumn("_held", F.lit(True))
    short = short.select(*KEY, copies.alias("copies"))
    open_marks = classes.join(short, KEY, "left_semi").join(held, [*KEY, "medium"], "left").filter("_held is null").groupBy(*KEY).agg(F.max((F.col("class") >= 2).cast("int")).alias("owed"), F.max((F.col("class") == 1).cast("int")).alias("aged"))
    judged = short.join(open_marks, KEY, "left")
    reason = F.when(F.col("copies") == 0, "none").when(F.col("owed") == 1, "backfill").when(F.col("aged") == 1, "aged").otherwise("structural")
    first = F.min(F.struct(C.run_key("run").alias("k"), "dle", "run")).alias("f")
    return judged.withColumn("reason", reason).groupBy("reason").agg(F.count("*").alias("n"), F.min("copies").alias("least"), first).select("reason", "n", "least", F.col("f.run").alias("first_run"), F.col("f.dle").alias("first_dle"))


def posture(archive: DataFrame, placement: DataFrame, route: DataFrame, status: DataFrame, drill_ledger: DataFrame, wanted: int = 2) -> DataFrame:
    """(rule, value, ok): copies, media, offsite, errors and capacity of the whole fleet; the live source is a third copy."""
    copies = placement.select(*KEY, "medium").distinct()
    least = archive.select(*KEY).join(copies.groupBy(*KEY).agg(F.count("*").alias("n")), KEY, "left").agg(F.min(F.coalesce("n", F.lit(0))).cast("long").alias("value"))
    media = copies.agg(F.countDistinct("medium").alias("value"))
    landings = route.filter("ord = 0").select("medium").distinct()
    offsite = copies.join(F.broadcast(landings), "medium", "left_anti").agg(F.countDistinct("medium").alias("value"))
    errors = drill_ledger.agg(F.coalesce(F.sum((~F.col("ok")).cast("long")), F.lit(0)).alias("value"))
    over = status.agg(F.coalesce(F.sum(F.col("over").cast("long")), F.lit(0)).alias("value"))
    rows = [("copies", least, F.col("value") >= wanted), ("media", media, F.col("value") >= 2), ("offsite", offsite, F.col("value") >= 1), ("errors", errors, F.col("value") == 0), ("capacity", over, F.col("value") == 0)]
    parts = [df.select(F.lit(name).alias("rule"), "value", ok.alias("ok")) for name, df, ok in rows]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def sync_backlog(archive: DataFrame, placement: DataFrame, classes: DataFrame, medium: str, landing: str, source: str | None = None) -> DataFrame:
    """(run, source, archives, bytes): what each run still owes the medium and from where to copy it.

    The source is the first medium, the landing first and then by name, that holds all that
    is missing; null where none does. With an explicit source a run owes what that holds.
    """
    if source is not None:
        placement_of = placement.filter(F.col("medium") == source).select(*KEY)
        classes = classes.join(placement_of, KEY, "left_semi")
        placement = placement.filter(F.col("medium").isin(source, medium))
    owed_here = classes.filter((F.col("medium") == medium) & (F.col("class") >= 2)).select(*KEY)
    missing = owed_here.join(placement.filter(F.col("medium") == medium), KEY, "left_anti").join(archive.select(*KEY, "compressed"), KEY)
    wanted = missing.groupBy("run").agg(F.count("*").alias("archives"), F.sum("compressed").alias("bytes"))
    holders = missing.join(placement.select(*KEY, F.col("medium").alias("source")).distinct(), KEY).groupBy("run", "source").agg(F.count("*").alias("held"))
    full = holders.join(wanted, "run").filter("held = archives").groupBy("run").agg(F.min(F.struct((F.col("source") != landing).cast("int").alias("o"), "source")).alias("s"))
    return wanted.join(full, "run", "left").select("run", F.col("s.source").alias("source"), "archives", "bytes")


def sync_capacity(backlog: DataFrame, totals: DataFrame, medium_dim: DataFrame, medium: str) -> DataFrame:
    """(medium, projected, capacity, over): what the medium holds once the backlog has landed; 0 is unbounded."""
    lands = backlog.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("_more"))
    rows = medium_dim.filter(F.col("medium") == medium).join(totals.select("medium", "bytes"), "medium", "left").join(lands, F.lit(True))
    projected = F.coalesce("bytes", F.lit(0)) + F.col("_more")
    return rows.select("medium", projected.cast("long").alias("projected"), "capacity", ((F.col("capacity") > 0) & (projected > F.col("capacity"))).alias("over"))


def sync_lag(backlog: DataFrame) -> DataFrame:
    return backlog.agg(F.count("*").alias("runs"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))


def drain_worklist(placement: DataFrame, route: DataFrame, holding: str) -> DataFrame:
    """(run, dle, level, to): archives on the holding medium and each routed medium that lacks them; `to` is null where all are served and the copy may go."""
    staged = placement.filter(F.col("medium") == holding).select(*KEY).distinct()
    targets = staged.join(route.filter(F.col("medium") != holding).select("dle", F.col("medium").alias("to")), "dle", "left")
    done = placement.select(*KEY, F.col("medium").alias("to")).distinct().withColumn("_done", F.lit(True))
    rows = targets.join(done, [*KEY, "to"], "left")
    open_rows = rows.filter("to is not null and _done is null").select(*KEY, "to")
    served = staged.join(open_rows, KEY, "left_anti").select(*KEY, F.lit(None).cast("string").alias("to"))
    return open_rows.unionByName(served)


def orphan_files(headers: DataFrame, known: DataFrame, min_age_days: int, now: Column) -> DataFrame:
    """headers (medium, label, pos, kind, torn, modified) that no assembled archive uses: never labels, torn ones at any age, others past the minimum age."""
    unused = headers.filter("kind <> 'label'").join(known.select("medium", "label", "pos"), ["medium", "label", "pos"], "left_anti")
    return unused.filter(F.col("torn") | (C.epoch(now) - C.epoch("modified") >= min_age_days * 86400))


def torn_files(store: DataFrame) -> DataFrame:
    """Rows of a scanned store (run, pos, payload, sidecar) with exactly one of the two files."""
    return store.filter(F.col("payload").isNull() != F.col("sidecar").isNull())


def merge_catalogs(base: DataFrame, newer: DataFrame) -> DataFrame:
    """Union of two placement tables; the newer record of a (run, medium, dle, level) replaces the older."""
    both = base.withColumn("_new", F.lit(0)).unionByName(newer.withColumn("_new", F.lit(1)))
    w = Window.partitionBy("run", "medium", "dle", "level").orderBy(F.col("_new").desc())
    return both.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r", "_new")


def drop_stale_epoch(part_file: DataFrame, volume: DataFrame) -> DataFrame:
    """Copies without those that have any part on a volume written anew since. part_file has an epoch."""
    current = volume.select("label", F.col("epoch").alias("_now"))
    stale = part_file.join(current, "label").filter(F.col("epoch") != F.col("_now")).select(*KEY, "medium").distinct()
    return part_file.join(stale, [*KEY, "medium"], "left_anti")


def remove_copies(placement: DataFrame, archive: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(placement, archive) without the copies in keys (run, dle, level, medium); an archive goes with its last copy."""
    rest = placement.join(keys, [*KEY, "medium"], "left_anti")
    dropped = keys.select(*KEY).distinct().join(rest, KEY, "left_anti")
    return rest, archive.join(dropped, KEY, "left_anti")


def intended_dles(configured: DataFrame, resolved: DataFrame) -> DataFrame:
    """Configured and resolved sources; configuration wins."""
    return configured.unionByName(resolved.join(configured.select("dle"), "dle", "left_anti"))


def reachable_media(route: DataFrame, sync_rule: DataFrame) -> DataFrame:
    """(dle, medium): media a source's data gets to over its route and then over sync rules.

    Each round adds media that are not there yet, and media are few, so rounds end.
    """
    rules = F.broadcast(sync_rule.filter("src <> ''").select("src", "dst"))
    auto = route.select("dle").distinct().join(F.broadcast(sync_rule.filter("src = ''").select(F.col("dst").alias("medium"))), F.lit(True))
    found = cut(route.select("dle", "medium").unionByName(auto).distinct())
    while True:
        more = found.join(rules, found["medium"] == rules["src"]).select("dle", F.col("dst").alias("medium")).distinct().join(found, ["dle", "medium"], "left_anti")
        more = cut(more)
        if not more.head(1):
            return found
        found = found.unionByName(more)


def force_full_after(force_full: DataFrame, archive: DataFrame) -> DataFrame:
    """Flags (dle, set_at run) that no later full has cleared."""
    done = archive.filter("level = 0").groupBy("dle").agg(F.max(C.run_key("run")).alias("_full"))
    return force_full.join(done, "dle", "left").filter(F.col("_full").isNull() | (F.col("_full") <= C.run_key("set_at"))).drop("_full")


def refresh_resolved(planned: DataFrame, failed: DataFrame, previous: DataFrame) -> DataFrame:
    """(dle, origin, via): planned sources, then units that failed before their dump, known or not, then the last units of an origin that could not be listed; the first wins.

    failed has dle, origin and source: a failure with a source is of the unit dle, one
    without (null or empty) is of the whole origin, which cannot name its units.
    """
    named = F.coalesce("source", F.lit("")) != ""
    carried = previous.join(failed.filter(~named).select("origin").distinct(), "origin", "left_semi")
    rows = planned.select("dle", "origin", F.lit("planned").alias("via"), F.lit(0).alias("_p"))
    rows = rows.unionByName(failed.filter(named).select("dle", "origin", F.lit("failed").alias("via"), F.lit(1).alias("_p")))
    rows = rows.unionByName(carried.select("dle", "origin", F.lit("carried").alias("via"), F.lit(2).alias("_p")))
    w = Window.partitionBy("dle").orderBy("_p", "origin")
    return rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select("dle", "origin", "via")


def barcode_map(sightings: DataFrame) -> DataFrame:
    """(barcode, label): the label last seen under each barcode. sightings has barcode, label, seen."""
    w = Window.partitionBy("barcode").orderBy(F.col("seen").desc(), "label")
    return sightings.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select("barcode", "label")


def members_diff(recorded: DataFrame, listed: DataFrame, archive: tuple[str, ...] = ("dle",)) -> DataFrame:
    """(archive..., path, nth, problem): members of two lists of an archive that differ: missing, extra, or at another offset (where both are known).

    archive names the columns that tell archives apart. Repeated paths are paired in order of offset.
    """
    keys = [*archive, "path", "nth"]
    number = lambda df: df.withColumn("nth", F.row_number().over(Window.partitionBy(*archive, "path").orderBy("off")))
    a, b = number(recorded).select(*keys, F.col("off").alias("_a"), F.lit(True).alias("_in_a")), number(listed).select(*keys, F.col("off").alias("_b"), F.lit(True).alias("_in_b"))
    rows = a.join(b, keys, "full")
    problem = F.when(F.col("_in_b").isNull(), "missing").when(F.col("_in_a").isNull(), "extra").when((F.col("_a") >= 0) & (F.col("_b") >= 0) & (F.col("_a") != F.col("_b")), "offset")
    return rows.withColumn("problem", problem).filter("problem is not null").select(*keys, "problem")


def slug_collisions(resolved: DataFrame) -> DataFrame:
    """(slug, origins): slugs that several origins give."""
    return resolved.groupBy("slug").agg(F.countDistinct("origin").alias("n"), F.array_join(F.sort_array(F.collect_set("origin")), ",").alias("origins")).filter("n > 1").drop("n")

