"""More queries over tables derived from the driver's: set operations on catalogs, scans, units, gauges and scalar functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions import columns as C
from fleetlens.operators import attention, chains, placement, reads, retention, summaries, trends
from fleetlens.plans.lineage import cut
from fleetlens.plans.queries import AS_OF, CHAIN, chain_rows, configured, ET, events_now, EVOLUTION, floor_of, floor_sql, now, query, RUN_LOG, run_log
from fleetlens.plans.tables import Tables
from fleetlens.sources import readers, sinks
from fleetlens.streaming import live


@query(
    """select o_orderkey as id, concat('run-', strftime(o_orderdate, '%Y-%m-%d.%H%M%S')) as run_id, concat('h', o_custkey, '-data-x_', o_custkey % 7) as slug, concat('h', o_custkey, ':/data/x ', o_custkey % 7, '/') as display,
    o_totalprice > 0 as ok, case when o_orderkey % 50 > 0 then true else false end as partial, cast(floor(o_orderkey % 9 * 1.5::double * 1024) as bigint) as bytes, o_orderkey % 9 * 86400.0::double + 1800 as seconds,
    32768 + o_orderkey as cost, greatest(o_orderkey * 1000 - 65536, 0) as usable from orders"""
)
def scalar_functions(t: Tables) -> DataFrame:
    n = F.col("o_custkey").cast("string")
    host, path = F.concat(F.lit("h"), n), F.concat(F.lit("/data/x "), (F.col("o_custkey") % 7).cast("string"), F.lit("/"))
    ninth = (F.col("o_orderkey") % 9).cast("string")
    rows = t.orders.select("o_orderkey", "o_orderdate", "o_totalprice", host.alias("host"), path.alias("path"), F.concat(ninth.cast("double") * 1.5, F.lit(" KiB")).alias("size"), F.concat(ninth, F.lit("d30m")).alias("age"))
    return rows.select(
        F.col("o_orderkey").alias("id"), C.run_id("o_orderdate").alias("run_id"), C.dle_slug("host", "path").alias("slug"), C.dle_display("host", "path", "host").alias("display"), (F.col("o_totalprice") > 0).alias("ok"),
        C.is_partial(F.col("o_orderkey") % 50).alias("partial"), C.parse_bytes("size").alias("bytes"), C.parse_duration("age").alias("seconds"), C.file_cost(F.lit("archive"), F.col("o_orderkey")).alias("cost"), C.usable_volume(F.col("o_orderkey") * 1000).alias("usable"),
    )


@query("select landing, cast(sum(bytes) as bigint) as bytes, round(sum(bytes) / sum(busy)::double, 6) as rate, round(least(1.0::double, sum(busy) / sum(wall)::double), 6) as utilisation from (select landing, bytes, floor(epoch(end_at)) - floor(epoch(begin_at)) as busy, 2 * (floor(epoch(end_at)) - floor(epoch(begin_at))) as wall from write_interval) x group by landing")
def landing_stats(t: Tables) -> DataFrame:
    busy = C.epoch("end_at") - C.epoch("begin_at")
    return summaries.landing_stats(t.write_interval.select("landing", "bytes", busy.alias("busy_seconds"), (busy * 2).alias("wall_seconds")))


@query(f"with k as (select *, row_number() over (partition by command order by ts desc, id desc) as rk from {RUN_LOG}) select command, cast(id as string) as run_id, case when outcome = 'failure' then 'FAILED' when warns then 'WARNING' else 'OK' end as status, ts as started_at, ts as ended_at from k where rk = 1")
def last_per_command(t: Tables) -> DataFrame:
    return summaries.last_per_command(run_log(t))


@query("select count(*) filter (where drilled and not ok and was) as degrading, count(*) filter (where drilled and not ok) as failing, count(*) filter (where not drilled) as never, count(*) filter (where od) as overdue from (select drills > 3 as drilled, ok, drills % 2 = 0 as was, drills < 6 as od from drill_ledger) x")
def recovery_health(t: Tables) -> DataFrame:
    d = F.col("drills")
    return summaries.recovery_health(t.drill_ledger.select((d > 3).alias("drilled"), "ok", (d % 2 == 0).alias("was_ok"), (d < 6).alias("overdue")))


@query("select label, used, false as fresh from volume order by last_run desc, label limit 1")
def expected_volume(t: Tables) -> DataFrame:
    return summaries.expected_volume(t.volume, t.volume, True)


@query(floor_sql() + ", kept as (select distinct medium, run from floor where kind is not null and kind <> 'CONDEMNED'), r as (select label, last_run from volume where label not in (select p.label from part_file p join kept k on k.medium = p.medium and k.run = p.run)), o as (select min(label) as label from r where last_run = (select min(last_run) from r)) select label, 0::bigint as used, label is null as fresh from o")
def expected_volume_anew(t: Tables) -> DataFrame:
    _, parts = t.archive, t.part_file  # written in this order, as parts are made of archives, copies and volumes of parts
    volume = cut(t.volume)
    return summaries.expected_volume(volume, retention.reusable_volumes(floor_of(t), parts, volume), False)


@query("select run, dle, level, medium, arch_key, case when arch_key % 3 = 0 then parts + 100 else parts end as parts, bytes from placement")
def merge_catalogs(t: Tables) -> DataFrame:
    newer = t.placement.filter("arch_key % 3 = 0").withColumn("parts", F.col("parts") + 100)
    return placement.merge_catalogs(t.placement, newer)


@query("with p as (select *, case when part_no % 4 = 3 then 0 else 1 end as epoch from part_file), bad as (select distinct run, dle, level, medium from p join volume v using (label) where p.epoch <> v.epoch) select arch_key, run, dle, level, medium, part_no from p where not exists (select 1 from bad b where b.run = p.run and b.dle = p.dle and b.level = p.level and b.medium = p.medium)")
def drop_stale_epoch(t: Tables) -> DataFrame:
    parts = t.part_file.withColumn("epoch", F.when(F.col("part_no") % 4 == 3, 0).otherwise(1))
    return placement.drop_stale_epoch(parts, t.volume.select("label", "epoch")).select("arch_key", "run", "dle", "level", "medium", "part_no")


@query("select a.run, a.dle, a.level from archive a where not (exists (select 1 from placement p where p.run = a.run and p.dle = a.dle and p.level = a.level and p.medium = 'disk' and p.arch_key % 2 = 0) and not exists (select 1 from placement p where p.run = a.run and p.dle = a.dle and p.level = a.level and p.medium <> 'disk'))")
def remove_copies(t: Tables) -> DataFrame:
    keys = t.placement.filter("medium = 'disk' and arch_key % 2 = 0").select("run", "dle", "level", "medium")
    return placement.remove_copies(t.placement, t.archive, keys)[1].select("run", "dle", "level")


@query("select dle, min(via) as via from (select distinct concat('c', cast(c_custkey as string)) as dle, 'configured' as via from customer where c_custkey % 2 = 0 union all select distinct dle, 'resolved' from archive) x group by dle")
def intended_dles(t: Tables) -> DataFrame:
    own = configured(t).filter(F.substring("dle", 2, 20).cast("int") % 2 == 0).select("dle", F.lit("configured").alias("via"))
    return placement.intended_dles(own, t.archive.select("dle", F.lit("resolved").alias("via")).distinct())


@query("with f as (select distinct dle, 'run-1999-01-01.000000' as set_at from archive where arch_key % 5 = 0), d as (select dle, max(run) as r from archive where level = 0 group by dle) select dle, set_at from f left join d using (dle) where r is null or r <= set_at")
def force_full_after(t: Tables) -> DataFrame:
    flags = t.archive.filter("arch_key % 5 = 0").select("dle", F.lit("run-1999-01-01.000000").alias("set_at")).distinct()
    return placement.force_full_after(flags, t.archive)


@query("""with s as (select distinct dle, host as origin, cast(substr(dle, 2) as int) as n from archive), p as (select dle, origin, 'planned' as via from s where n % 3 = 0),
    f as (select concat('new-', dle) as dle, origin, 'failed' as via from s where n % 3 = 1 and n % 2 = 0 union all select dle, origin, 'failed' from s where n % 3 = 1 and n % 2 = 1),
    c as (select dle, origin, 'carried' as via from s where origin in ('h3', 'h8') and dle not in (select dle from p) and dle not in (select dle from f)) select * from p union all select * from f union all select * from c""")
def refresh_resolved(t: Tables) -> DataFrame:
    known = t.archive.select("dle", F.col("host").alias("origin")).distinct().withColumn("n", F.substring("dle", 2, 20).cast("int"))
    units = known.filter("n % 3 = 1").select(F.when(F.col("n") % 2 == 0, F.concat(F.lit("new-"), "dle")).otherwise(F.col("dle")).alias("dle"), "origin", F.lit("s").alias("source"))
    whole = t.spark.createDataFrame([(None, "h3", None), (None, "h8", "")], "dle string, origin string, source string")
    return placement.refresh_resolved(known.filter("n % 3 = 0").drop("n"), units.unionByName(whole), known.drop("n"))


@query("with k as (select concat('B', pos % 50) as barcode, label, row_number() over (partition by pos % 50 order by pos desc, label) as rk from part_file where label <> '') select barcode, label from k where rk = 1")
def barcode_map(t: Tables) -> DataFrame:
    return placement.barcode_map(t.part_file.filter("label <> ''").select(F.concat(F.lit("B"), (F.col("pos") % 50).cast("string")).alias("barcode"), "label", F.col("pos").alias("seen")))


HEADERS = "(select medium, label, pos, case when pos % 11 = 0 then 'label' else 'archive' end as kind, pos % 13 = 0 as torn, created_at as modified, part_file.run, part_file.dle, part_file.level, part_no from part_file join archive using (arch_key)) hd"


def headers(t: Tables) -> DataFrame:
    rows = t.part_file.join(t.archive.select("arch_key", F.col("created_at").alias("modified")), "arch_key")
    return rows.withColumns({"kind": F.when(F.col("pos") % 11 == 0, "label").otherwise("archive"), "torn": F.col("pos") % 13 == 0})


@query(f"select medium, label, pos from {HEADERS} where kind <> 'label' and pos % 3 <> 0 and (torn or epoch(timestamp '1999-01-01 00:00:00') - floor(epoch(modified)) >= 30 * 86400)")
def orphan_files(t: Tables) -> DataFrame:
    known = t.part_file.filter("pos % 3 = 0")
    return placement.orphan_files(headers(t), known, 30, C.instant("1999-01-01 00:00:00")).select("medium", "label", "pos")


@query("select run, pos from part_file where (pos % 7 = 0) <> (pos % 5 = 0)")
def torn_files(t: Tables) -> DataFrame:
    store = t.part_file.select("run", "pos", F.when(F.col("pos") % 7 != 0, "p").alias("payload"), F.when(F.col("pos") % 5 != 0, "s").alias("sidecar"))
    return placement.torn_files(store).select("run", "pos")


SCAN = """with p as (select * from part_file where medium = 'tape'), c as (select run, dle, level, count(*) as parts from p where arch_key % 6 <> 0 group by run, dle, level),
    g as (select run, dle, level, count(*) as n from p where pos % 9 <> 0 group by run, dle, level)"""


def scanned(t: Tables, pool: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Tape parts as a scan finds them, some lost, assembled; pool is the pool of each label, the medium's own by default."""
    tape = t.part_file.filter("medium = 'tape'").withColumn("part", F.row_number().over(_by_part()) - 1)
    commits = tape.filter("arch_key % 6 <> 0").groupBy("run", "dle", "level").agg(F.count("*").cast("int").alias("parts")).withColumn("part_map", F.lit(None).cast("array<struct<label: string, epoch: int, pos: bigint>>"))
    parts = tape.filter("pos % 9 <> 0").select("run", "dle", "level", "part", "label", F.lit(1).alias("epoch"), "pos", (F.lit("main") if pool is None else pool).alias("pool"))
    return readers.assemble(parts, commits, "tape", "main")


def _by_part():
    return Window.partitionBy("run", "dle", "level").orderBy("part_no", "pos")


@query(SCAN + " select run, dle, level, 'tape' as medium, parts from c join g using (run, dle, level) where n = parts")
def assemble(t: Tables) -> DataFrame:
    return scanned(t)[0].select("run", "dle", "level", "medium", "parts")


@query(SCAN + " select run, count(*) as files, string_agg(distinct label, ',' order by label) as labels from p where pos % 9 <> 0 and not exists (select 1 from c where c.run = p.run and c.dle = p.dle and c.level = p.level) group by run")
def orphan_runs(t: Tables) -> DataFrame:
    return scanned(t)[1].select("run", "files", F.array_join("labels", ",").alias("labels"))


@query(SCAN + ", pl as (select run from c join g using (run, dle, level) where n = parts), o as (select distinct run from p where pos % 9 <> 0 and not exists (select 1 from c where c.run = p.run and c.dle = p.dle and c.level = p.level)) select (select count(distinct run) from pl) as runs, (select count(*) from o where run not in (select run from pl) and run not in (select run from archive where arch_key % 2 = 0)) as unresolved")
def rebuild_report(t: Tables) -> DataFrame:
    placed, orphans = scanned(t)
    return readers.rebuild_report(placed, orphans, t.archive.filter("arch_key % 2 = 0").select("run").distinct())


@query("with m as (select l_orderkey as seq, l_linenumber, concat('base/', l_suppkey % 40, case l_linenumber % 3 when 1 then '_vm' when 2 then '.1' else '' end) as path, concat('c', l_partkey % 5) as dle from lineitem) select dle, 'r' as run, concat('u', split_part(regexp_replace(regexp_replace(path, '\\.[0-9]+$', ''), '_vm$', ''), '/', 2)) as unit, count(*) as n from m group by all")
def units_from(t: Tables) -> DataFrame:
    tail = F.when(F.col("l_linenumber") % 3 == 1, "_vm").when(F.col("l_linenumber") % 3 == 2, ".1").otherwise("")
    member = t.lineitem.select(F.concat(F.lit("c"), (F.col("l_partkey") % 5).cast("string")).alias("dle"), F.lit("r").alias("run"), F.col("l_orderkey").alias("seq"), F.concat(F.lit("base/"), (F.col("l_suppkey") % 40).cast("string"), tail).alias("path"))
    relation = member.select("dle", C.relation_key("path").alias("path")).distinct().withColumn("unit", F.concat(F.lit("u"), C.base_name("path")))
    return chains.units_from(member, relation).select("dle", "run", "unit", "n")


UNIT_ARGS = """u as (select distinct host as dle, path from archive),
    w as (select dle, min(path) as arg from u group by dle union select dle, substr(max(path), 7) from u group by dle union select dle, concat('a/c', substr(dle, 2), '7') from u union select dle, '/data/' from u union select dle, 'nowhere' from u)"""


@query(
    f"""with {UNIT_ARGS}, r as (select w.dle, w.arg, max(case when u.path = w.arg then u.path end) as exact, count(u.path) as n, min(u.path) as one from w left join u on u.dle = w.dle and contains(u.path, w.arg) group by w.dle, w.arg)
    select dle, arg, case when exact is not null then exact when n = 1 then one end as path, case when exact is not null then 1 else n end as matches from r"""
)
def match_units(t: Tables) -> DataFrame:
    """Five arguments a host: a whole name, the end of one, the middle of some, one that all contain, one that none does."""
    unit = t.archive.select(F.col("host").alias("dle"), "path").distinct()
    ends = unit.groupBy("dle").agg(F.min("path").alias("low"), F.max("path").alias("high"))
    args = F.array(F.col("low"), F.substring("high", 7, 99), F.concat(F.lit("a/c"), F.substring("dle", 2, 9), F.lit("7")), F.lit("/data/"), F.lit("nowhere"))
    return chains.match_units(unit, ends.select("dle", F.explode(args).alias("arg")), strict=False)


@query(
    CHAIN
    + f""", r as (select l_orderkey, concat('table.p', l_partkey) as path, cast(sum(cast(round(l_extendedprice * 100) as bigint)) as bigint) as size, string_agg(distinct concat('base/', l_suppkey), ',' order by concat('base/', l_suppkey)) as members
        from lineitem where l_returnflag = 'R' group by 1, 2), u as (select a.dle, a.run, r.path, size, members from archive a join r on a.arch_key = l_orderkey), h as (select c.dle, max(c.run) as run from chain c join (select distinct dle, run from u) x using (dle, run) group by c.dle)
    select u.dle, '{AS_OF}' as point, u.run, u.path, size, members from u join h using (dle, run)"""
)
def inventory(t: Tables) -> DataFrame:
    """Units as of a date: the returned parts of an order are the tables in its archive; archives without any are passed over."""
    _, chain = chain_rows(t)
    supp = F.col("l_suppkey")
    file = F.concat(F.lit("base/"), F.when(supp % 2 == 0, "INCREMENTAL.").otherwise(""), supp.cast("string"))
    returned = t.lineitem.filter("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("arch_key"), F.concat(F.lit("table.p"), F.col("l_partkey").cast("string")).alias("path"))
    unit = returned.agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("size"), F.collect_set(file).alias("members"))
    unit = t.archive.select("arch_key", "dle", "run").join(unit, "arch_key").select("dle", "run", "path", "size", "members")
    return chains.inventory(chain, unit).select("dle", "point", "run", "path", "size", F.array_join(F.array_sort("members"), ",").alias("members"))


@query(
    f"""with s as (select dle, max(created_at) as l from archive group by dle), m as (select p.medium, sum(a.compressed) as b from placement p join archive a using (run, dle, level) group by p.medium),
    k as (select *, row_number() over (partition by command order by ts desc, id desc) as rk from {RUN_LOG})
    select 'source_last_backup_seconds' as metric, concat('dle=', dle) as labels, floor(epoch(l))::double as value from s union all select 'medium_used_bytes', concat('medium=', medium), b::double from m
    union all select 'medium_capacity_bytes', concat('medium=', medium), capacity::double from medium_dim where capacity > 0 union all select 'command_last_success', concat('command=', command), case when outcome = 'failure' then 0.0 else 1.0 end from k where rk = 1
    union all select 'command_last_end_seconds', concat('command=', command), floor(epoch(ts))::double from k where rk = 1 union all select 'command_last_duration_seconds', concat('command=', command), 0.0 from k where rk = 1
    union all select 'sources', '', count(*)::double from customer union all select 'sources_stale', '', count(*)::double from (select c_custkey from customer left join archive on dle = concat('c', cast(c_custkey as string)) group by c_custkey having max(created_at) is null or epoch(timestamp '2001-08-02 00:00:00') - epoch(max(created_at)) >= 2592000) x
    union all select 'drills_failing', '', count(*)::double from drill_ledger where not ok
    union all select 'drills_overdue', '', count(*)::double from customer left join drill_ledger on dle = concat('c', cast(c_custkey as string)) where last_drill is null or not ok or floor(epoch(timestamp '2024-02-01 00:00:00')) - floor(epoch(last_drill)) >= 604800"""
)
def metrics(t: Tables) -> DataFrame:
    drills = summaries.drill_coverage(configured(t), t.drill_ledger, 7, events_now())
    stale = summaries.stale_dles(configured(t), t.archive, 30, now())
    count = lambda name, df: df.agg(F.count("*").alias("value")).select(F.lit(name).alias("metric"), "value")
    counts = count("sources", configured(t)).unionByName(count("sources_stale", stale)).unionByName(count("drills_failing", t.drill_ledger.filter("not ok"))).unionByName(drills.select(F.lit("drills_overdue").alias("metric"), F.col("overdue").alias("value")))
    return attention.metrics(summaries.dle_summary(t.archive, t.placement), summaries.medium_totals(t.archive, t.placement), t.medium_dim, summaries.last_per_command(run_log(t)), counts)


STATES = "(select landing as run, dle, seq, bytes as done, bytes * 2 as total, case seq % 4 when 0 then 'done' when 1 then 'dumping' when 2 then 'holding' else 'waiting' end as state, row_number() over (partition by landing, dle order by seq desc) as rk from progress_event) pe where rk = 1"


def progress(t: Tables) -> DataFrame:
    fourth = F.col("seq") % 4
    state = F.when(fourth == 0, "done").when(fourth == 1, "dumping").when(fourth == 2, "holding").otherwise("waiting")
    return live.latest_progress(t.progress_event.select(F.col("landing").alias("run"), "dle", "seq", F.col("bytes").alias("done"), (F.col("bytes") * 2).alias("total"), state.alias("state")))


@query(f"select run, count(*) as dles, count(*) filter (where state = 'done') as finished, cast(sum(done) as bigint) as done, cast(sum(total) as bigint) as total, cast(least(100, sum(done) * 100 // sum(total)) as bigint) as percent from {STATES} group by run")
def progress_totals(t: Tables) -> DataFrame:
    return live.progress_totals(progress(t))


@query(f"select run, cast(sum(case when state = 'done' then done else 0 end) as bigint) as landed, cast(sum(case when state = 'holding' then done else 0 end) as bigint) as holding, cast(sum(case when state = 'dumping' then done else 0 end) as bigint) as in_flight, cast(sum(case when state in ('dumping', 'waiting') then total - done else 0 end) as bigint) as to_go from {STATES} group by run")
def stage_split(t: Tables) -> DataFrame:
    return live.stage_split(progress(t))


@query(f"select run, round(greatest(sum(total - done) / 1000.0::double, sum(done) / 3000.0::double), 3) as seconds from {STATES} group by run")
def eta(t: Tables) -> DataFrame:
    sums = progress(t).groupBy("run").agg(F.sum(F.col("total") - F.col("done")).alias("to_dump"), F.sum("done").alias("to_drain"))
    return live.eta(sums.withColumns({"dump_rate": F.lit(1000.0), "drain_rate": F.lit(3000.0)}))


@query("select landing, b as begin, cast(sum(bytes) as bigint) as bytes, sum(bytes) / 30.0::double as rate from (select landing, bytes, unnest(range((floor(epoch(ts))::bigint // 2 - 14) * 2, floor(epoch(ts))::bigint + 1, 2)) as b from progress_event) x group by landing, b")
def sliding_rate(t: Tables) -> DataFrame:
    rows = live.sliding_rate(t.progress_event, "landing")
    return rows.withColumn("begin", C.epoch("begin"))


@query("select arch_key, medium, part_no as seq, cast(coalesce(sum(size * 2) over w, 0) as bigint) as raw, cast(coalesce(sum(size) over w, 0) as bigint) as enc from part_file window w as (partition by arch_key, medium order by part_no rows between unbounded preceding and 1 preceding)")
def atomic_frames(t: Tables) -> DataFrame:
    return reads.atomic_frames(t.part_file.withColumn("raw_size", F.col("size") * 2), ["arch_key", "medium"])


@query("select slug, string_agg(origin, ',' order by origin) as origins from (select distinct concat('s', substr(dle, 2)::int % 37) as slug, host as origin from archive) x group by slug having count(*) > 1")
def slug_collisions(t: Tables) -> DataFrame:
    slug = F.concat(F.lit("s"), (F.substring("dle", 2, 20).cast("int") % 37).cast("string"))
    return placement.slug_collisions(t.archive.select(slug.alias("slug"), F.col("host").alias("origin")).distinct())


@query("select run from archive group by run order by run desc limit 15")
def last_runs(t: Tables) -> DataFrame:
    return summaries.select_runs(t.archive, last=15)


@query(floor_sql() + " select medium, cast(sum(compressed) filter (where kind is null) as bigint) as reclaimable, count(*) filter (where kind is null) as copies from floor group by medium")
def reclaimable(t: Tables) -> DataFrame:
    free = F.col("kind").isNull()
    return floor_of(t).groupBy("medium").agg(F.sum(F.when(free, F.col("compressed"))).alias("reclaimable"), F.sum(free.cast("long")).alias("copies"))


@query(EVOLUTION + " select count(*) as growing from evo where per_day > 0")
def growing_sources(t: Tables) -> DataFrame:
    return trends.evolution(t.dump_stat).filter("per_day > 0").agg(F.count("*").alias("growing"))


@query(
    """with x as (select dle, ts, bytes, lag(ts) over (partition by dle order by ts) as p from progress_event), n as (select *, sum(case when p is null or ts > p + interval '6 hours' then 1 else 0 end) over (partition by dle order by ts rows between unbounded preceding and current row) as k from x)
    select dle, floor(epoch(min(ts)))::bigint as begin, floor(epoch(max(ts) + interval '6 hours'))::bigint as "end", count(*) as events, cast(sum(bytes) as bigint) as bytes from n group by dle, k"""
)
def activity_sessions(t: Tables) -> DataFrame:
    """Runs of activity of every source without a pause of six hours."""
    out = live.activity_sessions(t.progress_event, "dle", 6 * 3600)
    return out.select("dle", C.epoch("begin").alias("begin"), C.epoch("end").alias("end"), "events", "bytes")


@query(
    f"""with n as (select medium, seq, "at", used, lead("at") over (partition by medium order by "at", seq) as nx from usage_sample),
    z as (select medium, seq, "at", used from n union all select medium, -1, "at" + interval '2 hours', 0 from n where coalesce(nx > "at" + interval '2 hours', "at" + interval '2 hours' <= {ET})),
    p as (select *, lag(used) over (partition by medium order by "at", seq) as b from z) select medium, seq, "at", used from p where b is null or b <> used"""
)
def usage_falls(t: Tables) -> DataFrame:
    """Changes of every medium's total, where one that gave no sample for two hours fell to 0."""
    return live.usage_changes(live.with_silences(t.usage_sample, 2 * 3600, events_now())).select("medium", "seq", "at", "used")


@query("with b as (select medium, cast(sum(bytes) as bigint) as used from placement where medium <> 'tape' group by medium), k as (select medium, capacity as was from medium_dim union all select 'old', 0) select coalesce(b.medium, k.medium) as medium, coalesce(used, 0)::bigint as used from b full join k on b.medium = k.medium where was is null or was <> coalesce(used, 0)")
def emptied(t: Tables) -> DataFrame:
    """Samples to record now: what the media hold, and 0 for those that hold nothing any more."""
    totals = t.placement.filter("medium <> 'tape'").groupBy("medium").agg(F.sum("bytes").alias("bytes"))
    known = t.medium_dim.select("medium", F.col("capacity").alias("used")).unionByName(t.spark.createDataFrame([("old", 0)], "medium string, used bigint"))
    return live.emptied(totals, known, events_now()).select("medium", "used")
