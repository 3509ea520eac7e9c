"""Queries that apply the operators to the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.functions import columns as C
from fleetlens.operators import attention, chains, placement, reads, retention, summaries, trends
from fleetlens.plans.lineage import cut, preceding
from fleetlens.plans.tables import EVENTS_NOW, NOW, Tables, with_views
from fleetlens.sources import sinks
from fleetlens.streaming import live

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

AS_OF = "1999-06-30"
T = f"timestamp '{NOW}'"
ET = f"timestamp '{EVENTS_NOW}'"


def query(oracle: str | None = None):
    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if oracle:
            ORACLE[f.__name__] = with_views(oracle)
        return f

    return add


def now():
    return C.instant(NOW)


def events_now():
    return C.instant(EVENTS_NOW)


def targets(t: Tables, point: str = AS_OF) -> DataFrame:
    dates = t.spark.createDataFrame([(point,)], "point string")
    return chains.as_of_by_dle(t.archive, dates).select("dle", "point", "run")


def chain_rows(t: Tables) -> tuple[DataFrame, DataFrame]:
    based = cut(chains.base_of(t.archive))
    return based, chains.chains(based, targets(t))


BASED = """
    ranked as (select *, row_number() over (partition by dle order by run) as i from archive),
    based as (select a.dle, a.run, a.level, a.compressed, a.created_at, a.base_run, a.i,
        case when a.level = 0 then null
             when a.base_run is not null then (select max(b.run) from ranked b where b.dle = a.dle and b.run = a.base_run and b.i < a.i)
             else (select max(b.run) from ranked b where b.dle = a.dle and b.level = a.level - 1 and b.i < a.i) end as base from ranked a)"""
CHAIN = f"""
    with recursive {BASED},
    tips as (select dle, max(run) as run from archive where substr(run, 5, 10) <= '{AS_OF}' group by dle),
    chain as (select b.dle, b.run, b.level, b.base, b.compressed, 0 as depth from based b join tips t on t.dle = b.dle and t.run = b.run
              union all select b.dle, b.run, b.level, b.base, b.compressed, c.depth + 1 from chain c join based b on b.dle = c.dle and b.run = c.base)"""


@query(CHAIN + f" select dle, '{AS_OF}' as point, string_agg(run, ',' order by run) as runs, count(*) as links, cast(sum(compressed) as bigint) as bytes, min(level) > 0 as broken from chain group by dle")
def restore_chains(t: Tables) -> DataFrame:
    _, chain = chain_rows(t)
    return chains.chain_summary(chain, t.archive)


@query(f"with {BASED} select dle, run, level, base from based")
def base_of(t: Tables) -> DataFrame:
    return chains.base_of(t.archive).select("dle", "run", "level", "base")


STRANDED = f"""with recursive {BASED},
    ok as (select dle, run from based where level = 0 union all select b.dle, b.run from ok join based b on b.dle = ok.dle and b.base = ok.run),
    lost as (select b.dle, b.run, b.level, b.i, o.run is null as stranded from based b left join ok o on o.dle = b.dle and o.run = b.run)"""


@query(STRANDED + " select dle, run, level, stranded from lost")
def stranded(t: Tables) -> DataFrame:
    return chains.stranded(chains.base_of(t.archive))


@query(
    STRANDED
    + """, n as (select dle, max(i) as n from lost group by dle),
    c as (select dle, run, max(case when medium <> 'tape' then 1 else 0 end) as loose from placement group by dle, run)
    select count(*) filter (where i = n) as latest_stranded, count(*) filter (where i < n and loose = 1) as superseded, count(*) filter (where i < n and coalesce(loose, 0) = 0) as debris
    from lost join n using (dle) left join c using (dle, run) where stranded"""
)
def restorability(t: Tables) -> DataFrame:
    return chains.restorability(chains.stranded(chains.base_of(t.archive)), t.placement, t.medium_dim)


@query(f"select '{AS_OF}' as point, max(run) as run from archive where substr(run, 5, 10) <= '{AS_OF}'")
def as_of_date(t: Tables) -> DataFrame:
    return chains.as_of(t.archive, t.spark.createDataFrame([(AS_OF, None)], "point string, bound timestamp_ntz"))


@query("""select 'h' as point, max(run) as run from (select run, max(created_at) as "at" from archive group by run) r where r."at" <= timestamp '1998-03-04 05:59:59'""")
def as_of_hour(t: Tables) -> DataFrame:
    points = t.spark.createDataFrame([("h", "1998-03-04 05:59:59")], "point string, b string").select("point", F.col("b").cast("timestamp_ntz").alias("bound"))
    return chains.as_of(t.archive, points)


@query(f"select dle, '{AS_OF}' as point, max(run) as run, arg_max(level, run) as level from archive where substr(run, 5, 10) <= '{AS_OF}' group by dle")
def as_of_by_dle(t: Tables) -> DataFrame:
    return chains.as_of_by_dle(t.archive, t.spark.createDataFrame([(AS_OF,)], "point string"))


@query(
    """with recursive c as (select distinct dle, run from placement where arch_key % 41 <> 0), n as (select a.dle, a.run, a.level, coalesce(a.base_run, '') as base_run, c.run is not null as copy from archive a left join c using (dle, run)),
    w as (select dle, run, level, level as at_level, base_run as nx, [run] as seen, not copy as bare, false as looped from n
          union all select w.dle, w.run, w.level, n.level, n.base_run, list_append(seen, n.run), bare or not n.copy, list_contains(list_append(seen, n.run), n.base_run) and n.level > 0
          from w join n on n.dle = w.dle and n.run = w.nx where w.at_level > 0 and not list_contains(seen, w.nx)),
    e as (select *, row_number() over (partition by dle, run order by len(seen) desc) as rk from w)
    select dle, run, level, cast(len(seen) as int) as links, case when at_level > 0 and list_contains(seen, nx) then 'cycle' when bare then 'no copy' when at_level = 0 then 'complete' else 'base missing' end as verdict from e where rk = 1"""
)
def recovery_points(t: Tables) -> DataFrame:
    return chains.recovery_points(t.archive, t.placement.filter("arch_key % 41 <> 0"))


@query(
    CHAIN
    + f""", l as (select dle, count(*) as links from chain group by dle),
    h as (select c.dle, p.medium, count(*) as held from chain c join placement p on p.dle = c.dle and p.run = c.run and p.level = c.level group by c.dle, p.medium)
    select dle, '{AS_OF}' as point, medium, held, links, held = links as whole from h join l using (dle)"""
)
def chain_media(t: Tables) -> DataFrame:
    return chains.chain_media(chain_rows(t)[1], t.placement).select("dle", "point", "medium", "held", "links", "whole")


@query(
    CHAIN
    + f""", c as (select distinct c.dle, c.run, c.level, p.medium from chain c join placement p on p.dle = c.dle and p.run = c.run and p.level = c.level),
    l as (select dle, run, level, medium, label, min(part_no) as part_no from part_file where label <> '' group by dle, run, level, medium, label),
    o as (select *, concat(medium, coalesce((select ':' || string_agg(label, '+' order by part_no, label) from l where l.dle = c.dle and l.run = c.run and l.level = c.level and l.medium = c.medium), '')) as name from c),
    u as (select dle, medium, label, min(struct_pack(run := run, level := level, part_no := part_no)) as f from c join l using (dle, run, level, medium) group by dle, medium, label),
    w as (select dle, medium from c group by dle, medium having count(*) = (select count(*) from chain where chain.dle = c.dle)),
    wn as (select dle, string_agg(name, ', ' order by name) as media from (select dle, concat(medium, coalesce((select ':' || string_agg(label, '+' order by f, label) from u where u.dle = w.dle and u.medium = w.medium), '')) as name from w) z group by dle),
    m as (select dle, run, level, string_agg(name, ', ' order by name) as names from chain left join o using (dle, run, level) group by dle, run, level),
    s as (select dle, string_agg(concat('L', cast(level as string), ': ', coalesce(names, 'none')), ' · ' order by run, level) as media from m group by dle)
    select dle, '{AS_OF}' as point, wn.media is not null as one_place, coalesce(wn.media, s.media) as media from s left join wn using (dle)"""
)
def chain_places(t: Tables) -> DataFrame:
    _, parts = t.archive, t.part_file  # written in this order, as parts are made of archives and copies of parts
    return chains.chain_places(chain_rows(t)[1], t.placement, parts)


@query(CHAIN + f", x as (select distinct c.dle, p.medium, p.label from chain c join part_file p on p.run = c.run where p.label <> '') select dle, '{AS_OF}' as point, medium, string_agg(label, ',' order by label) as labels from x group by dle, medium")
def chain_labels(t: Tables) -> DataFrame:
    return chains.chain_labels(chain_rows(t)[1], t.part_file)


@query(
    CHAIN
    + f""", l as (select dle, count(*) as links from chain group by dle),
    h as (select c.dle, p.medium, count(*) as held from chain c join placement p on p.dle = c.dle and p.run = c.run and p.level = c.level group by c.dle, p.medium),
    w as (select h.dle, arg_min(h.medium, r.ord) as medium from h join l using (dle) join route r on r.dle = h.dle and r.medium = h.medium where held = links group by h.dle),
    f as (select dle, arg_min(medium, ord) as medium from route group by dle)
    select t.dle, '{AS_OF}' as point, coalesce(w.medium, f.medium, 'disk') as medium from tips t left join w using (dle) left join f using (dle)"""
)
def drill_medium(t: Tables) -> DataFrame:
    goal = cut(targets(t))
    chain = chains.chains(cut(chains.base_of(t.archive)), goal)
    return chains.drill_medium(chains.chain_media(chain, t.placement), t.route, goal, "disk")


RATES = [("disk", 0.0, 0.0, 0.0), ("cloud", 0.023, 0.09, 0.0004), ("tape", 0.004, 0.02, 0.0)]
RATE_SQL = "rates as (select * from (values ('disk', 0.0::double, 0.0::double, 0.0::double), ('cloud', 0.023::double, 0.09::double, 0.0004::double), ('tape', 0.004::double, 0.02::double, 0.0::double)) as r(medium, gib_month, gib_egress, per_1000))"


def rates(t: Tables) -> DataFrame:
    return t.spark.createDataFrame(RATES, "medium string, gib_month double, gib_egress double, per_1000 double")


@query(
    CHAIN
    + f""", {RATE_SQL}, best as (select *, row_number() over (partition by dle, run, level order by case when medium = 'disk' then 0 else 1 end, medium) as rk from placement),
    l as (select c.dle, c.run, b.medium, b.bytes, b.parts from chain c left join best b on b.dle = c.dle and b.run = c.run and b.level = c.level and rk = 1),
    s as (select dle, arg_min(medium, run) filter (where medium is not null) as medium, cast(sum(bytes) as bigint) as bytes, cast(sum(parts) as bigint) as parts from l group by dle)
    select dle, '{AS_OF}' as point, medium, bytes, parts, case when gib_month > 0 or gib_egress > 0 or per_1000 > 0 then round(bytes / 1073741824.0::double * gib_egress + parts / 1000.0::double * per_1000, 6) end as price
    from s left join rates using (medium)"""
)
def restore_cost(t: Tables) -> DataFrame:
    located = chains.located(chain_rows(t)[1].select("dle", "point", "run", "level"), t.placement, "disk")
    return summaries.restore_cost(located, rates(t))


@query("select run, substr(run, 5, 10) as date, count(*) as archives, cast(sum(compressed) as bigint) as bytes, max(unreadable) > 0 as partial, max(created_at) as last_at from archive group by run")
def run_summary(t: Tables) -> DataFrame:
    return summaries.run_summary(t.archive)


@query(
    """with m as (select dle, string_agg(medium, ',' order by medium) as media from (select distinct dle, medium from placement) x group by dle)
    select dle, arg_max(concat(host, ':', path), run) as display, count(*) as runs, cast(sum(compressed) as bigint) as bytes, arg_max(level, run) as last_level, max(case when level = 0 then substr(run, 5, 10) end) as last_full, max(created_at) as last_at, coalesce(max(media), '') as media,
        cast(substr(dle, 2) as int) % 9 = 0 as rest
    from archive left join m using (dle) group by dle"""
)
def dle_summary(t: Tables) -> DataFrame:
    resolved = configured(t).select("dle", (F.substring("dle", 2, 20).cast("int") % 9 == 0).alias("rest"))
    return summaries.dle_summary(t.archive, t.placement, resolved)


@query("select p.medium, count(*) as archives, count(distinct p.run) as runs, cast(sum(a.compressed) as bigint) as bytes from placement p join archive a using (run, dle, level) group by p.medium")
def medium_totals(t: Tables) -> DataFrame:
    return summaries.medium_totals(t.archive, t.placement)


@query(
    """with r as (select dle, level = 0 as f, arg_max(compressed / uncompressed::double, created_at) as rate from archive where uncompressed > 0 and compressed > 0 group by dle, level = 0),
    x as (select dle, max(case when f then rate end) as f, max(case when not f then rate end) as i from r group by dle)
    select dle, round(coalesce(f, i, 0.0::double), 9) as full_rate, round(coalesce(i, f, 0.0::double), 9) as incr_rate from (select distinct dle from archive) a left join x using (dle)"""
)
def compression_rates(t: Tables) -> DataFrame:
    return summaries.comprate(t.archive)


@query(
    """with r as (select p.medium, p.run, count(*) as n, sum(case when level = 0 then compressed else 0 end) as f, sum(case when level > 0 then compressed else 0 end) as i, max(created_at) as "at"
              from placement p join archive a using (run, dle, level) group by p.medium, p.run)
    select medium, cast(sum(n) as bigint) as archives, cast(sum(f) as bigint) as full_bytes, cast(sum(i) as bigint) as incr_bytes, arg_min("at", run) as first_at, arg_max("at", run) as last_at from r group by medium"""
)
def medium_stats(t: Tables) -> DataFrame:
    return summaries.medium_stats(t.archive, t.placement)


@query(
    """with r as (select p.medium, p.run, cast(sum(compressed) as bigint) as bytes from placement p join archive a using (run, dle, level) group by p.medium, p.run)
    select medium, run, bytes, cast(sum(bytes) over (partition by medium order by run) as bigint) as cumulative from r"""
)
def medium_growth_curve(t: Tables) -> DataFrame:
    return summaries.medium_growth_curve(t.archive, t.placement)


@query(
    """with p as (select * from part_file where label <> ''),
    tt as (select label, count(distinct concat(dle, '|', run, '|', level)) as archives, count(distinct run) as runs, max(run) as last_run from p group by label),
    f as (select label, sum(bytes) as bytes from (select sum(size) as bytes, arg_min(label, part_no) as label from p group by run, dle, level) x group by label)
    select label, archives, runs, last_run, cast(coalesce(bytes, 0) as bigint) as bytes from tt left join f using (label)"""
)
def per_volume(t: Tables) -> DataFrame:
    return summaries.per_volume(t.part_file)


@query(
    """with c as (select label, 32768 + size as cost from part_file where label <> ''
              union all select label, 65536 from (select distinct label, run, dle, level from part_file where label <> '') x
              union all select label, 65536 from volume)
    select label, count(*) as files, cast(sum(cost) as bigint) as used from c where label in (select label from volume) group by label"""
)
def volume_fill(t: Tables) -> DataFrame:
    return summaries.volume_fill(t.part_file, t.volume)


@query("with s as (select *, cast(sum(size) over (partition by medium, label order by pos) as bigint) as e from part_file where label <> '') select medium, label, pos, run, dle, e - size as begin, e as \"end\" from s")
def volume_segments(t: Tables) -> DataFrame:
    return summaries.volume_segments(t.part_file)


@query(
    """select case when level0 is null then 'total' when level0 then 'full' else 'incr' end as kind, count(*) as n, cast(sum(orig) as bigint) as orig, cast(sum(out) as bigint) as out, cast(sum(files) as bigint) as files, cast(sum(seconds) as bigint) as seconds,
        case when sum(orig) > 0 and sum(out) < sum(orig) then round(cast(sum(out) as double) * 100.0::double / cast(sum(orig) as double), 6) end as percent, round(cast(sum(orig) as double) / cast(sum(seconds) as double), 6) as rate
    from (select *, level = 0 as level0 from dump_stat) d group by cube (level0)"""
)
def dump_report(t: Tables) -> DataFrame:
    return summaries.dump_report(t.dump_stat)


@query(f"select dle, max(created_at) as last_at from (select concat('c', cast(c_custkey as string)) as dle from customer) c left join archive using (dle) group by dle having max(created_at) is null or epoch({T}) - epoch(max(created_at)) >= 30 * 86400")
def stale_dles(t: Tables) -> DataFrame:
    return summaries.stale_dles(configured(t), t.archive, 30, now())


def configured(t: Tables) -> DataFrame:
    key = F.col("c_custkey").cast("string")
    return t.customer.select(F.concat(F.lit("c"), key).alias("dle"), F.concat(F.lit("h"), (F.col("c_custkey") % 20).cast("string")).alias("host"))


@query(
    f"""with c as (select concat('c', cast(c_custkey as string)) as dle, concat('h', cast(c_custkey % 20 as string)) as host from customer),
    s as (select dle, epoch({T}) - epoch(max(created_at)) as age from c left join archive using (dle) group by dle),
    h as (select host, count(*) filter (where age is null or age >= 2592000) as stale, count(*) as "all" from c join s using (dle) group by host)
    select host, stale, "all", stale = "all" as whole from h where stale >= 2"""
)
def stale_hosts(t: Tables) -> DataFrame:
    return summaries.stale_hosts(summaries.stale_dles(configured(t), t.archive, 30, now()), configured(t))


@query(
    f"""with r as (select l.* from (select concat('c', cast(c_custkey as string)) as dle from customer) c left join (select dle as d, last_drill, ok from drill_ledger) l on l.d = c.dle)
    select count(*) as dles, count(last_drill) as drilled, count(*) - count(last_drill) as never, count(*) filter (where not ok) as failed,
           count(*) filter (where last_drill is null or not ok or floor(epoch({ET})) - floor(epoch(last_drill)) >= 604800) as overdue from r"""
)
def drill_coverage(t: Tables) -> DataFrame:
    return summaries.drill_coverage(configured(t), t.drill_ledger, 7, events_now())


@query(
    """select substr(run, 5, 10) as day, cast(sum(case when level = 0 then compressed else 0 end) as bigint) as full_bytes, cast(sum(case when level > 0 then compressed else 0 end) as bigint) as incr_bytes,
    count(*) filter (where level = 0) as fulls, count(*) filter (where level > 0) as incrs from archive group by run"""
)
def daily_load(t: Tables) -> DataFrame:
    return summaries.daily_load(t.archive)


@query(
    """with d as (select cast(sum(compressed) as bigint) as b from archive group by run), m as (select count(*) as days, max(b) as peak, cast(sum(b) as bigint) // count(*) as mean from d),
    v as (select days, peak, mean, round(sqrt(avg((b - mean)::double * (b - mean)::double)) / mean, 6) as cv from d, m group by days, peak, mean)
    select days, peak, mean, cv, case when cv < 0.35 then 'Even' when cv < 0.6 then 'Uneven' else 'Lumpy' end as verdict from v"""
)
def load_balance(t: Tables) -> DataFrame:
    return summaries.balance(summaries.daily_load(t.archive))


@query(
    f"""select dle, substr(run, 5, 10) as day, case when max(unreadable) > 0 then 'partial' when min(level) = 0 then 'full' else 'incr' end as mark, string_agg(distinct cast(level as string), ',' order by cast(level as string)) as levels,
    cast(sum(compressed) as bigint) as bytes, case when count(distinct run) = 1 then max(run) end as run
    from archive where cast(substr(run, 5, 10) as date) > date '2001-08-02' - 365 and cast(substr(run, 5, 10) as date) <= date '2001-08-02' group by 1, 2"""
)
def activity_matrix(t: Tables) -> DataFrame:
    return summaries.activity_matrix(t.archive, now(), 365).withColumn("day", F.col("day").cast("string"))


@query(f"with {RATE_SQL}, m as (select p.medium, cast(sum(a.compressed) as bigint) as bytes from placement p join archive a using (run, dle, level) group by p.medium) select medium, bytes, case when gib_month > 0 or gib_egress > 0 or per_1000 > 0 then round(bytes / 1073741824.0::double * gib_month, 6) end as price from m left join rates using (medium)")
def storage_cost(t: Tables) -> DataFrame:
    return summaries.storage_cost(summaries.medium_totals(t.archive, t.placement), rates(t))


@query(
    """with k as (select dle, run, level, label, pos, part_no, concat(lpad(label, 16, ' '), lpad(cast(pos as string), 20, '0')) as own from part_file where label <> '' and part_no = 0),
    e as (select a.*, greatest(a.own, coalesce((select max(b.own) from k b where b.dle = a.dle and b.level < a.level), a.own)) as eff from k a)
    select dle, run, level, label, pos, row_number() over (order by eff, level, own) as place from e"""
)
def read_order(t: Tables) -> DataFrame:
    refs = t.part_file.filter("label <> '' and part_no = 0").select("dle", "run", "level", F.lpad("label", 16, " ").alias("label"), "pos")
    return summaries.read_order(refs).withColumn("label", F.ltrim("label"))


@query("select * from archive where run in (select run from archive group by run order by run desc limit 20)")
def cap_runs(t: Tables) -> DataFrame:
    return summaries.cap_runs(t.archive, 20)


@query("select distinct run from archive where substr(run, 5, 10) >= '2000-01-01'")
def runs_since(t: Tables) -> DataFrame:
    return summaries.select_runs(t.archive, since="2000-01-01")


@query("select a.* from archive a where exists (select 1 from placement p where p.medium = 'disk' and p.run = a.run and p.dle = a.dle and p.level = a.level)")
def archives_on_disk(t: Tables) -> DataFrame:
    return placement.archives_on(t.archive, t.placement, "disk")


@query("select a.*, p.parts, p.bytes from archive a join (select run, dle, level, parts, bytes from placement where medium = 'cloud') p using (run, dle, level)")
def placed_archives_on_cloud(t: Tables) -> DataFrame:
    return placement.placed_archives_on(t.archive, t.placement, "cloud")


@query("select distinct label, run from part_file where label <> ''")
def runs_on_label(t: Tables) -> DataFrame:
    return placement.runs_on_label(t.part_file)


@query("select a.* from archive a where not exists (select 1 from placement p where p.medium = 'tape' and p.run = a.run and p.dle = a.dle and p.level = a.level)")
def missing_on_tape(t: Tables) -> DataFrame:
    return placement.missing_on(t.archive, t.placement, "tape")


@query("select label, string_agg(run, ',' order by run) as runs, count(*) as n from (select distinct label, run from part_file where label <> '' and label not in (select label from volume)) x group by label")
def missing_volumes(t: Tables) -> DataFrame:
    return placement.missing_volumes(t.part_file, t.volume)


@query("""select dle, 'h' as point, max(run) as run, arg_max(level, run) as level from archive where created_at <= timestamp '1998-03-04 05:59:59' group by dle""")
def as_of_hour_by_dle(t: Tables) -> DataFrame:
    points = t.spark.createDataFrame([("h", "1998-03-04 05:59:59")], "point string, b string").select("point", F.col("b").cast("timestamp_ntz").alias("bound"))
    return chains.as_of_by_dle(t.archive, points)


@query(CHAIN.replace("substr(run, 5, 10) <= '" + AS_OF + "'", "run <= 'run-1999-01-10.000000'") + " select dle, 'r' as point, string_agg(run, ',' order by run) as runs, count(*) as links, cast(sum(compressed) as bigint) as bytes, min(level) > 0 as broken from chain group by dle")
def chains_of_run(t: Tables) -> DataFrame:
    """What a restore of every source as of one run replays; most sources skipped that run."""
    goal = configured(t).select("dle", F.lit("r").alias("point"), F.lit("run-1999-01-10.000000").alias("run"))
    return chains.chain_summary(chains.chains(cut(chains.base_of(t.archive)), goal), t.archive)


CLASSES = f"""
    lf as (select dle, max(run) as last_full from archive where level = 0 group by dle),
    b as (select a.run, a.dle, a.level, a.created_at, a.compressed, lf.last_full from archive a left join lf using (dle)),
    marks as (
        select b.run, b.dle, b.level, r.medium, case when last_full is null or run >= last_full or (m.min_age_days > 0 and epoch({T}) - epoch(created_at) < m.min_age_days * 86400) then 3 else 1 end as class
        from b join route r using (dle) join medium_dim m on m.medium = r.medium
        union all
        select b.run, b.dle, b.level, 'tape', case when last_full is null or run >= last_full then 2 else 1 end from b
        union all
        select run, dle, level, 'cloud', 2 from placement where medium = 'disk' and run in (select run from placement where medium = 'disk' group by run order by run desc limit 100)),
    classes as (select run, dle, level, medium, max(class) as class from marks group by run, dle, level, medium),
    held as (select distinct run, dle, level, medium from placement)"""


def classes_of(t: Tables) -> DataFrame:
    return placement.copy_class(t.archive, t.placement, t.route, t.sync_rule, t.medium_dim, now())


@query(f"with {CLASSES} select run, dle, level, medium, class from classes")
def copy_class(t: Tables) -> DataFrame:
    return classes_of(t)


JUDGED = """, judged as (select run, medium, count(*) filter (where h) as held, count(*) filter (where class = 3) as routed, count(*) filter (where class = 3 and h) as routed_held,
        count(*) filter (where class = 2) as promised, count(*) filter (where class = 2 and h) as promised_held, count(*) filter (where class = 1) as aged
    from (select run, medium, c.class, h.dle is not null as h from classes c full join (select * from held) h using (run, dle, level, medium)) x group by run, medium)"""


@query(f"with {CLASSES}{JUDGED} select *, routed - routed_held as missing, promised - promised_held as behind from judged")
def judge_copies(t: Tables) -> DataFrame:
    return placement.judge_copies(classes_of(t), t.placement)


@query(
    f"""with {CLASSES}{JUDGED} select run, medium, case when held = 0 and routed > 0 then 'missing' when held = 0 and promised > 0 then 'not yet synced'
    when routed > routed_held then concat('partial ', cast(routed_held + promised_held as string), '/', cast(routed + promised as string)) when promised > promised_held then concat('behind ', cast(promised - promised_held as string)) when held > 0 then 'ok' else 'aged' end as status from judged"""
)
def copies_summary(t: Tables) -> DataFrame:
    return placement.copies_summary(placement.judge_copies(classes_of(t), t.placement))


@query(f"with {CLASSES} select run, dle, level, medium, coalesce(class, 0) as class, h.x is not null as held from classes full join (select *, 1 as x from held) h using (run, dle, level, medium) where exists (select 1 from archive a where a.run = run and a.dle = dle)")
def placement_grid(t: Tables) -> DataFrame:
    return placement.placement_grid(t.archive, classes_of(t), t.placement)


@query(
    f"""with {CLASSES}, n as (select a.run, a.dle, a.level, count(h.medium) as copies from archive a left join held h using (run, dle, level) group by a.run, a.dle, a.level),
    o as (select c.run, c.dle, c.level, max(case when class >= 2 then 1 else 0 end) as owed, max(case when class = 1 then 1 else 0 end) as aged from classes c left join (select *, 1 as x from held) h using (run, dle, level, medium) where h.x is null group by c.run, c.dle, c.level),
    j as (select n.*, case when copies = 0 then 'none' when owed = 1 then 'backfill' when aged = 1 then 'aged' else 'structural' end as reason from n left join o using (run, dle, level) where copies < 2),
    k as (select *, row_number() over (partition by reason order by run, dle) as rk from j)
    select reason, count(*) as n, min(copies) as least, max(case when rk = 1 then run end) as first_run, max(case when rk = 1 then dle end) as first_dle from k group by reason"""
)
def copies_posture(t: Tables) -> DataFrame:
    return placement.copies_posture(t.archive, classes_of(t), t.placement)


BACKLOG = f"""with {CLASSES}, miss as (select c.run, c.dle, c.level, b.compressed from classes c join b using (run, dle, level) where c.medium = 'cloud' and c.class >= 2 and not exists (select 1 from held h where h.medium = 'cloud' and h.run = c.run and h.dle = c.dle and h.level = c.level)),
    w as (select run, count(*) as archives, cast(sum(compressed) as bigint) as bytes from miss group by run),
    hh as (select m.run, h.medium, count(*) as n from miss m join held h using (run, dle, level) group by m.run, h.medium),
    src as (select run, arg_min(medium, case when medium = 'disk' then '0' else medium end) as source from hh join w using (run) where n = archives group by run)"""


@query(BACKLOG + " select run, source, archives, bytes from w left join src using (run)")
def sync_backlog(t: Tables) -> DataFrame:
    return placement.sync_backlog(t.archive, t.placement, classes_of(t), "cloud", "disk")


@query(
    BACKLOG
    + """, d as (select w.run, count(*) as archives, cast(sum(m.compressed) as bigint) as bytes from miss m join w using (run) join held h on h.run = m.run and h.dle = m.dle and h.level = m.level and h.medium = 'tape' group by w.run)
    select run, 'tape' as source, archives, bytes from d"""
)
def sync_backlog_from_tape(t: Tables) -> DataFrame:
    return placement.sync_backlog(t.archive, t.placement, classes_of(t), "cloud", "disk", source="tape")


@query(
    BACKLOG.replace("c.medium = 'cloud'", "c.medium = 'tape'").replace("h.medium = 'cloud'", "h.medium = 'tape'")
    + """, s as (select cast(sum(a.compressed) as bigint) as bytes from placement p join archive a using (run, dle, level) where p.medium = 'tape')
    select 'tape' as medium, cast(s.bytes + (select coalesce(sum(bytes), 0) from w) as bigint) as projected, capacity, capacity > 0 and s.bytes + (select coalesce(sum(bytes), 0) from w) > capacity as over from s, medium_dim where medium = 'tape'"""
)
def sync_capacity(t: Tables) -> DataFrame:
    backlog = placement.sync_backlog(t.archive, t.placement, classes_of(t), "tape", "disk")
    return placement.sync_capacity(backlog, summaries.medium_totals(t.archive, t.placement), t.medium_dim, "tape")


@query(BACKLOG + " select count(*) as runs, cast(coalesce(sum(bytes), 0) as bigint) as bytes from w")
def sync_lag(t: Tables) -> DataFrame:
    return placement.sync_lag(placement.sync_backlog(t.archive, t.placement, classes_of(t), "cloud", "disk"))


@query(
    """with s as (select distinct run, dle, level from placement where medium = 'disk'), h as (select distinct run, dle, level, medium from placement),
    o as (select s.*, r.medium as "to" from s join route r using (dle) where r.medium <> 'disk' and not exists (select 1 from h where h.run = s.run and h.dle = s.dle and h.level = s.level and h.medium = r.medium))
    select run, dle, level, "to" from o union all select run, dle, level, null from s where not exists (select 1 from o where o.run = s.run and o.dle = s.dle and o.level = s.level)"""
)
def drain_worklist(t: Tables) -> DataFrame:
    return placement.drain_worklist(t.placement, t.route, "disk")


@query("with r as (select dle, medium from route union select distinct dle, 'tape' from route) select dle, medium from r union select dle, 'cloud' from r where medium = 'disk'")
def reachable_media(t: Tables) -> DataFrame:
    return placement.reachable_media(t.route, t.sync_rule)


@query("with s as (select dle, level, seq, path, off from member), l as (select dle, level, seq, path, case when seq % 7 = 0 then off + 1 else off end as off from member where seq % 5 <> 0), a as (select *, row_number() over (partition by dle, level, path order by off) as nth from s), b as (select *, row_number() over (partition by dle, level, path order by off) as nth from l) select dle, level, path, nth, case when b.off is null then 'missing' when a.off is null then 'extra' else 'offset' end as problem from a full join b using (dle, level, path, nth) where a.off is null or b.off is null or a.off <> b.off")
def members_diff(t: Tables) -> DataFrame:
    """Every member of every archive against a listing that lacks some and has some elsewhere."""
    m = t.member.select("dle", "level", "seq", "path", "off")
    listed = m.filter("seq % 5 <> 0").withColumn("off", F.expr("case when seq % 7 = 0 then off + 1 else off end"))
    return placement.members_diff(m, listed, ("dle", "level"))


PINS = """h2 as (select *, max(y) over (partition by {d}medium, run) as ry, row_number() over (partition by {d}medium, dle order by run) as k, count(*) over (partition by {d}medium, dle) as n, sum(case when level = 0 then 1 else 0 end) over (partition by {d}medium, dle order by run) as seg from h),
    h3 as (select *, max(case when level = 0 then k end) over (partition by {d}medium, dle) as fi, max(case when not stranded and (ry or k = n) then k end) over (partition by {d}medium, dle, seg) as upto from h2),
    floor as (select {d}medium, run, dle, level, compressed, capacity, labeled, case when stranded and not y then 'CONDEMNED' when y then 'AGE' when level = 0 and k = fi then 'LAST_FULL' when seg > 0 and upto >= k then 'CHAIN' end as kind from h3)"""


def floor_sql() -> str:
    """The floor now, with broken chains judged over the whole catalog."""
    return (
        STRANDED
        + f""", h as (select p.medium, a.run, a.dle, a.level, a.base_run, a.compressed, m.capacity, m.labeled, coalesce(m.min_age_days > 0 and floor(epoch({T})) - floor(epoch(a.created_at)) < m.min_age_days * 86400, false) as y, l.stranded
           from (select distinct medium, run, dle, level from placement) p join archive a using (run, dle, level) join medium_dim m using (medium) join lost l on l.dle = a.dle and l.run = a.run),
    {PINS.format(d="")}"""
    )


def floor_by_day_sql(days: str) -> str:
    """The floor of each medium on each of `days`, with broken chains judged by what the medium held then."""
    return f"""with recursive {days},
    hh as (select day, p.medium, a.run, a.dle, a.level, a.base_run, a.compressed, m.capacity, m.labeled, coalesce(m.min_age_days > 0 and floor(epoch(day)) - floor(epoch(a.created_at)) < m.min_age_days * 86400, false) as y
        from (select distinct medium, run, dle, level from placement) p join archive a using (run, dle, level) join medium_dim m using (medium) join days on a.created_at <= day),
    bb as (select a.day, a.medium, a.dle, a.run, a.level, max(b.run) as base from hh a left join hh b on b.day = a.day and b.medium = a.medium and b.dle = a.dle and b.run < a.run and a.level > 0
        and (b.run = a.base_run or (coalesce(a.base_run, '') = '' and b.level = a.level - 1)) group by a.day, a.medium, a.dle, a.run, a.level),
    ok as (select day, medium, dle, run from bb where level = 0 union all select b.day, b.medium, b.dle, b.run from ok join bb b on b.day = ok.day and b.medium = ok.medium and b.dle = ok.dle and b.base = ok.run),
    h as (select hh.*, ok.run is null as stranded from hh left join ok using (day, medium, dle, run)),
    {PINS.format(d="day, ")}"""


FLOOR = floor_sql()
DAYS = f"days as (select {T} - interval 1 day * i as day from range(2, 60, 3) r(i))"


def held_of(t: Tables, media: DataFrame | None = None) -> DataFrame:
    """Copies with what the floor asks of them, written, as it reads them twice."""
    archive = t.archive.select("run", "dle", "level", "compressed", "base_run", "created_at")
    return cut(retention.held_archives(archive, t.placement, t.medium_dim if media is None else media))


def floor_of(t: Tables, media: DataFrame | None = None) -> DataFrame:
    return retention.retention_floor(held_of(t, media), chains.lost(t.archive.select("run", "dle", "level", "base_run")), now())


@query(FLOOR + " select medium, run, dle, level, kind from floor")
def retention_floor(t: Tables) -> DataFrame:
    return floor_of(t).select("medium", "run", "dle", "level", "kind")


@query(FLOOR + ", r as (select *, case kind when 'AGE' then 1 when 'LAST_FULL' then 2 else 3 end as s, row_number() over (partition by medium, run order by case kind when 'AGE' then 1 when 'LAST_FULL' then 2 else 3 end, dle) as rk from floor where kind is not null and kind <> 'CONDEMNED') select medium, run, kind, dle from r where rk = 1")
def floor_by_run(t: Tables) -> DataFrame:
    return retention.floor_by_run(floor_of(t))


@query(FLOOR + ", kept as (select distinct medium, run from floor where kind is not null and kind <> 'CONDEMNED') select label, last_run from volume where label not in (select p.label from part_file p join kept k on k.medium = p.medium and k.run = p.run)")
def reusable_volumes(t: Tables) -> DataFrame:
    return retention.reusable_volumes(floor_of(t), t.part_file, t.volume)


@query(
    FLOOR
    + """, u as (select medium, sum(compressed) as stored, sum(case when kind is not null and kind <> 'CONDEMNED' then compressed else 0 end) as protected,
        sum(case when labeled or (kind is not null and kind <> 'CONDEMNED') then compressed else 0 end) as residual, count(*) filter (where kind in ('LAST_FULL', 'CHAIN')) as chained from floor group by medium),
    s as (select m.medium, m.capacity, cast(coalesce(stored, 0) as bigint) as stored, cast(coalesce(protected, 0) as bigint) as protected, cast(coalesce(residual, 0) as bigint) as residual, coalesce(chained, 0) as chained from medium_dim m left join u using (medium))
    select medium, capacity, stored, protected, residual, capacity > 0 and stored > capacity as over, case when capacity > 0 then stored * 100 // capacity else 0 end as percent,
    case when capacity > 0 then capacity - protected else -1 end as room, capacity > 0 and residual > capacity as infeasible, capacity > 0 and residual > capacity and chained = 0 as age_bound from s"""
)
def capacity_status(t: Tables) -> DataFrame:
    return retention.capacity_status(floor_of(t), t.medium_dim)


@query()
def reclaim_plan(t: Tables) -> DataFrame:
    floor = cut(floor_of(t))
    half = floor.groupBy("medium").agg(F.expr("sum(compressed) div 2").alias("target"))
    return retention.reclaim_plan(floor, targets=half)


@query(FLOOR + ", r as (select medium, run, sum(compressed) as b from floor group by medium, run), n as (select medium, max(run) as newest, cast(arg_max(b, run) as bigint) as need from r group by medium), u as (select medium, cast(sum(case when kind is not null and kind <> 'CONDEMNED' then compressed else 0 end) as bigint) as p from floor group by medium) select medium, newest, need, case when capacity > 0 then capacity - p else -1 end as room, capacity = 0 or capacity - p >= need as fits from n join u using (medium) join medium_dim using (medium)")
def room_checks(t: Tables) -> DataFrame:
    return retention.room_checks(floor_of(t), t.medium_dim)


def sampled_days(t: Tables) -> DataFrame:
    """Every third day of the sixty up to NOW, the last of them two days before it."""
    return t.spark.range(2, 60, 3).select((C.instant(NOW) - F.make_dt_interval(days=F.col("id").cast("int"))).alias("day"))


@query(floor_by_day_sql(DAYS) + " select day, medium, cast(sum(compressed) as bigint) as protected, count(*) as copies from floor where kind is not null and kind <> 'CONDEMNED' group by day, medium")
def protected_history(t: Tables) -> DataFrame:
    return retention.protected_history(held_of(t), sampled_days(t))


@query(
    floor_by_day_sql(DAYS)
    + " select day, count(distinct label) as volumes from (select distinct day, medium, run from floor where kind is not null and kind <> 'CONDEMNED') f join part_file p using (medium, run) join volume v using (label) where v.written_at <= day group by day"
)
def volumes_in_use_history(t: Tables) -> DataFrame:
    archive = t.archive.select("run", "dle", "level", "base_run", "created_at", "compressed")
    # Parts summed by archive and label are copies, labels and all that volumes are told by: lines are gone through once.
    parts = cut(t.sql("select run, dle, level, medium, label, sum(size) as size from part_file group by arch_key, run, dle, level, medium, label"))
    view = f"parts_{uuid.uuid4().hex}"
    parts.createOrReplaceTempView(view)
    volume = t.spark.sql(with_views("select label, written_at from volume", t.views | {"part_file": f"select * from {view}"}))
    return retention.volumes_in_use_history(retention.held_archives(archive, parts, t.medium_dim), sampled_days(t), parts, volume)


EVOLUTION = """with e as (select *, floor(epoch(ended_at))::bigint as t, max(floor(epoch(ended_at))::bigint) over (partition by dle) as last from dump_stat),
    w as (select * from e where t >= last - 180 * 86400),
    f as (select dle, count(*) as fulls, arg_min(out, run_id) as ao, arg_max(out, run_id) as zo, arg_min(orig, run_id) as ar, arg_max(orig, run_id) as zr, arg_max(t, run_id) - arg_min(t, run_id) as span from w where level = 0 group by dle),
    m as (select dle, list_sort(list(out)) as s from w where level > 0 group by dle),
    delta as (select dle, cast(trunc(case when ao > 0 then (zo - ao)::double / ao::double * 100.0::double else 0.0::double end) as bigint) as percent from f where fulls >= 2),
    evo as (select dle, fulls, ao as first_out, zo as last_out, span, cast(trunc((zo - ao) * 86400.0::double / span) as bigint) as per_day, cast(trunc((zr - ar) * 86400.0::double / span) as bigint) as per_day_orig,
        cast(trunc(case when ao > 0 then (zo - ao)::double / ao::double * 100.0::double else 0.0::double end) as bigint) as percent, s[len(s) // 2 + 1] as median_incr from f left join m using (dle) where fulls >= 2 and span >= 86400)"""


@query(EVOLUTION + " select * from evo")
def evolution(t: Tables) -> DataFrame:
    return trends.evolution(t.dump_stat)


@query(EVOLUTION + " select dle, percent, percent >= 20 as warns from delta")
def trend_delta(t: Tables) -> DataFrame:
    return trends.trend_delta(t.dump_stat)


@query(
    """with e as (select *, floor(epoch("at"))::bigint as t, max(floor(epoch("at"))::bigint) over (partition by medium) as last from usage_sample), w as (select * from e where t >= last - 30 * 86400),
    g as (select medium, count(*) as n, min(used) as a, max(used) as z, max(t) - min(t) as span from w group by medium)
    select medium, cast(trunc((z - a) * 86400.0::double / span) as bigint) as per_day, case when 900000000 > z and cast(trunc((z - a) * 86400.0::double / span) as bigint) > 0 then (900000000 - z) // cast(trunc((z - a) * 86400.0::double / span) as bigint) end as full_in_days from g where n >= 2 and span >= 86400 and z > a"""
)
def usage_growth(t: Tables) -> DataFrame:
    capacity = t.usage_sample.select("medium").distinct().withColumn("capacity", F.lit(900000000).cast("long"))
    return trends.usage_growth(t.usage_sample, capacity)


#: Dumps with the newest run's sizes and times made odd for every second archive.
ODD = "(select d.* replace (case when newest and (cast(substr(dle, 2) as int)) % 2 = 0 then orig * 8 else orig end as orig, case when newest and (cast(substr(dle, 2) as int)) % 3 = 0 then seconds * 400 else seconds end as seconds) from (select *, run_id = (select max(run_id) from dump_stat) as newest from dump_stat) d) dd"
PRIORS = """with dd as (select *, {v} as v from {src}), l as (select max(run_id) as top from dd),
    r as (select *, row_number() over (partition by dle, level order by ended_at desc, run_id desc) as rk from dd where v is not null and run_id <> (select top from l)),
    b as (select dle, level, list_sort(list(v)) as s from r where rk <= 5 group by dle, level),
    q as (select n.dle, n.level, n.run_id, n.v, n.orig, n.seconds, b.s, (s[(len(s) + 1) // 2] + s[len(s) // 2 + 1]) // 2 as median from dd n join b using (dle, level) where n.run_id = (select top from l) and n.v is not null and len(s) >= 2)"""


def odd_dumps(t: Tables) -> DataFrame:
    newest = t.dump_stat.agg(F.max("run_id").alias("top"))
    n = F.substring("dle", 2, 20).cast("int")
    new = F.col("run_id") == F.col("top")
    rows = t.dump_stat.join(F.broadcast(newest), F.lit(True))
    return rows.withColumn("orig", F.when(new & (n % 2 == 0), F.col("orig") * 8).otherwise(F.col("orig"))).withColumn("seconds", F.when(new & (n % 3 == 0), F.col("seconds") * 400).otherwise(F.col("seconds"))).drop("top")


SIZES = (
    PRIORS.format(src=ODD, v="orig")
    + """, d as (select *, list_sort(list_transform(s, lambda x: abs(x - median))) as ds from q), z as (select *, (ds[(len(ds) + 1) // 2] + ds[len(ds) // 2 + 1]) // 2 as mad from d)
    select dle, level, run_id, v as orig, median, mad, case when v > median then 'grown' else 'shrunk' end as kind from z where median > 0 and abs(v - median) > 67108864 and abs(v - median) > 3 * mad and (v > 2 * median or (v * 2 < median and level = 0))"""
)
SLOW = PRIORS.format(src=ODD, v="case when orig > 0 and seconds > 0 then cast(floor(orig / seconds::double) as bigint) end") + " select dle, level, run_id, v as rate, median from q where median > 0 and v * 2 < median and seconds::double - orig / median::double > 300"


@query(SIZES)
def size_anomalies(t: Tables) -> DataFrame:
    return trends.size_anomalies(odd_dumps(t))


@query(SLOW)
def slow_dumps(t: Tables) -> DataFrame:
    return trends.slow_dumps(odd_dumps(t))


@query(
    """with e as (select *, floor(epoch(ended_at))::bigint as t, max(floor(epoch(ended_at))::bigint) over (partition by dle) as last from (select * replace (out * 100 as out) from dump_stat) d), w as (select * from e where level > 0 and t >= last - 1800 * 86400),
    m as (select dle, list_sort(list(out)) as s from w group by dle having count(*) >= 2), q as (select dle, s, s[len(s) // 2 + 1] as median from m), d as (select dle, median, list_sort(list_transform(s, lambda x: abs(x - median))) as ds from q),
    z as (select dle, median, (ds[(len(ds) + 1) // 2] + ds[len(ds) // 2 + 1]) // 2 as mad from d)
    select w.dle, run_id, out, median, mad from w join z using (dle) where median > 0 and out > 2 * median and out - median > 67108864 and out - median > 3 * mad"""
)
def incr_spikes(t: Tables) -> DataFrame:
    return trends.incr_spikes(t.dump_stat.withColumn("out", F.col("out") * 100), 1800)


def groups(t: Tables) -> DataFrame:
    return t.archive.select("dle", F.col("host").alias("group")).distinct()


@query(
    """with f as (select d.dle, d.ended_at, d.run_id, a.host as g, d.out - coalesce(lag(d.out) over (partition by d.dle order by d.ended_at, d.run_id), 0) as x from dump_stat d join (select distinct dle, host from archive) a using (dle) where level = 0),
    s as (select g, ended_at as "at", sum(x) as x from f group by g, ended_at), k as (select g as "group", "at", cast(sum(x) over (partition by g order by "at") as bigint) as total, max("at") over (partition by g) as last from s)
    select "group", "at", total from k where floor(epoch("at")) >= floor(epoch(last)) - 180 * 86400"""
)
def group_curve(t: Tables) -> DataFrame:
    return trends.group_curve(t.dump_stat, groups(t))


SEGMENTS = """with s as (select *, sum(case when level = 0 then 1 else 0 end) over (partition by dle order by run) as seg from archive), c as (select dle, seg, count(*) as archives, cast(sum(compressed) as bigint) as bytes from s group by dle, seg),
    n as (select dle, row_number() over (partition by dle order by seg desc) as nth, archives, bytes from c)"""


@query(SEGMENTS + " select * from n")
def chain_sizes(t: Tables) -> DataFrame:
    return trends.chain_sizes(t.archive)


@query(SEGMENTS + ", m as (select * from (values (1), (2), (4), (8)) as v(chains)) select chains, cast(sum(case when nth <= chains then bytes else 0 end) as bigint) as bytes from n, m where chains <= (select max(nth) from n) group by chains")
def restore_depth(t: Tables) -> DataFrame:
    return trends.restore_depth(t.archive)


@query(
    SEGMENTS
    + """, m as (select * from (values (1), (2), (4), (8)) as v(chains)), d as (select chains, cast(sum(case when nth <= chains then bytes else 0 end) as bigint) as bytes from n, m where chains <= (select max(nth) from n) group by chains),
    st as (select *, lead(chains) over (order by chains) as nx, lead(bytes) over (order by chains) as nb from d), f as (select medium, arg_max(chains + case when nb > bytes then (capacity - bytes)::double / (nb - bytes)::double * (nx - chains) else 0.0::double end, chains) as cycles from medium_dim left join st on bytes <= capacity where capacity > 0 group by medium)
    select medium, round(coalesce(cycles, 0.0::double), 6) as cycles from f"""
)
def capacity_depth(t: Tables) -> DataFrame:
    return trends.capacity_depth(trends.restore_depth(t.archive), t.medium_dim.select("medium", "capacity"))


STATE = f"""r as (select *, row_number() over (partition by dle order by run) as i, coalesce(lag(level) over (partition by dle order by run) <> level, true) as ch from archive),
    state as (select dle, case when max(case when level = 0 then i end) is null then -1 else (floor(epoch({T}))::bigint - floor(epoch(arg_max(created_at, i) filter (where level = 0)))::bigint) // 86400 end as days_since_full,
        arg_max(level, i) as last_level, max(i) - max(case when ch then i end) + 1 as at_level, max(i) - coalesce(max(case when level = 0 then i end), 0) as incrs_since_full, max(run) as last_run from r group by dle)"""


@query(f"with {STATE} select * from state")
def dle_state(t: Tables) -> DataFrame:
    return trends.dle_state(t.archive, now())


ESTIMATE = f"""l as (select dle, arg_max(orig, run_id) filter (where level = 0) as fo, arg_max(floor(epoch(ended_at))::bigint, run_id) filter (where level = 0) as ft, max(run_id) filter (where level = 0) as fr, greatest(arg_max(level, run_id), 1) as lv from dump_stat group by dle),
    m2 as (select d.dle, list_sort(list(orig) filter (where level = lv)) as s, list_sort(list(orig) filter (where level = lv + 1)) as n from dump_stat d join l using (dle) where level > 0 and run_id > fr group by d.dle),
    est as (select dle, case when fo is null then 0 else greatest(0, fo + coalesce(cast(trunc(per_day_orig * greatest(0.0::double, (floor(epoch({T})) - ft) / 86400.0::double)) as bigint), 0)) end as full_est,
        coalesce(s[len(s) // 2 + 1], 0) as same_est, coalesce(n[len(n) // 2 + 1], 0) as next_est from l left join evo using (dle) left join m2 using (dle))"""


@query(EVOLUTION + ", " + ESTIMATE + " select * from est")
def estimate_from_history(t: Tables) -> DataFrame:
    return trends.estimate_from_history(t.dump_stat, now())


def levels_of(t: Tables) -> tuple[DataFrame, DataFrame]:
    return trends.dle_state(t.archive, C.instant("1998-08-02 00:00:00")), trends.estimate_from_history(t.dump_stat, now())


@query(EVOLUTION
    + ", " + ESTIMATE + ", " + STATE.replace(NOW, "1998-08-02 00:00:00")
    + """, forced as (select distinct dle from archive where arch_key % 97 = 0),
    nl as (select dle, case when dle in (select dle from forced) or days_since_full < 0 or days_since_full >= 400 then 0 when last_level < 1 then 1 when last_level < 9 and next_est > 0 and at_level >= 2 and (same_est - next_est) * 100.0::double >= full_est * 5.0::double then last_level + 1 else last_level end as level,
        case when dle in (select dle from forced) then 'forced' when days_since_full < 0 then 'first full' when days_since_full >= 400 then 'cycle due' when last_level < 1 then 'after full' when last_level < 9 and next_est > 0 and at_level >= 2 and (same_est - next_est) * 100.0::double >= full_est * 5.0::double then 'bump' else 'hold' end as reason
    from state join est using (dle))
    select nl.dle, nl.level, reason, nl.level - 1 as base_level, max(a.run) as base_run from nl left join archive a on a.dle = nl.dle and a.level = nl.level - 1 group by nl.dle, nl.level, reason""")
def next_level(t: Tables) -> DataFrame:
    """The next level of each source and the run that it builds on."""
    state, estimate = levels_of(t)
    forced = t.archive.filter("arch_key % 97 = 0").select("dle").distinct()
    return trends.with_base(trends.next_level(state, estimate, forced, cycle=400), t.archive)


@query(EVOLUTION + ", " + ESTIMATE + " select cast(sum(full_est) as bigint) as fulls, 10000000000 as capacity, sum(full_est) <= 10000000000 as fits from est")
def cycle_fits(t: Tables) -> DataFrame:
    return trends.cycle_fits(trends.estimate_from_history(t.dump_stat, now()), 10_000_000_000)


@query(EVOLUTION
    + ", " + ESTIMATE + ", " + STATE
    + """, pk as (select dle, 2500 - days_since_full as due_in, days_since_full, full_est, case when days_since_full < 0 or days_since_full >= 2500 then 0 else 2500 - days_since_full end as slot from state join est using (dle)),
    pl as (select slot, sum(full_est) as load from pk group by slot), pc as (select pk.*, coalesce(a.load, 0) as today, b.load as own from pk left join pl a on a.slot = 0 join pl b on b.slot = pk.slot where pk.slot > 0 and days_since_full * 2 >= 2500),
    pm as (select max(load) as top, sum(load::double * load::double) as sq from pl)
    select dle, cast(due_in as bigint) as due_in, full_est, cast(greatest(today + full_est, own - full_est, coalesce((select max(load) from pl where pl.slot <> 0 and pl.slot <> pc.slot), 0)) as bigint) as peak,
        round((sq - today::double * today::double - own::double * own::double + (today + full_est)::double * (today + full_est)::double + (own - full_est)::double * (own - full_est)::double) / 1e18::double, 6) as square
    from pc, pm where today + full_est <= 1152921504606846976 and today + full_est <= top""")
def promotion_candidates(t: Tables) -> DataFrame:
    state, estimate = trends.dle_state(t.archive, now()), trends.estimate_from_history(t.dump_stat, now())
    return trends.promotion_candidates(state, estimate, cycle=2500, room=1 << 60)


TREE_CHAIN = "c as (select distinct dle, level, concat('run-2000-01-0', cast(level + 1 as string), '.000000') as run from member)"


def tree_inputs(t: Tables) -> tuple[DataFrame, DataFrame]:
    member = t.member.withColumn("run", F.concat(F.lit("run-2000-01-0"), (F.col("level") + 1).cast("string"), F.lit(".000000")))
    return member.select("dle", F.lit("p").alias("point"), "run", "level").distinct(), member


@query("with x as (select dle, level, seq, off, regexp_replace(path, '^/+|/+$', '', 'g') as path, ends_with(path, '/') as is_dir from member), k as (select *, row_number() over (partition by dle, path order by level desc, seq desc) as rk from x where path <> '') select dle, 'p' as point, path, concat('run-2000-01-0', cast(level + 1 as string), '.000000') as run, level, seq, off, is_dir, 1 as versions from k where rk = 1")
def tree_as_of(t: Tables) -> DataFrame:
    return chains.tree_as_of(*tree_inputs(t))


@query("""with k as (select distinct dle, regexp_replace(path, '^/+|/+$', '', 'g') as p, ends_with(path, '/') as d, level, seq from member),
    t as (select dle, p, arg_max(d, level * 100000000 + seq) as d from k where p <> '' group by dle, p)
    select dle, 'p' as point, split_part(p, '/', 1) as name, max(d or p like '%/%') as is_dir from t group by dle, split_part(p, '/', 1)""")
def list_dir(t: Tables) -> DataFrame:
    return chains.list_dir(chains.tree_as_of(*tree_inputs(t)), "")


@query(
    """with x as (select dle, level, seq, regexp_replace(path, '^/+|/+$', '', 'g') as path from member), k as (select *, row_number() over (partition by dle, path order by level desc, seq desc) as rk from x where path <> ''),
    t as (select * from k where rk = 1), w as (select dle, path from t where seq % 3 = 0),
    c as (select distinct t.dle, t.level, t.path from t join w on w.dle = t.dle and (t.path = w.path or starts_with(t.path, w.path || '/') or starts_with(w.path, t.path || '/')))
    select dle, 'p' as point, concat('run-2000-01-0', cast(level + 1 as string), '.000000') as run, level, string_agg(path, '|' order by path) as members, count(*) as n from c group by dle, level"""
)
def collect_selection(t: Tables) -> DataFrame:
    tree = chains.tree_as_of(*tree_inputs(t))
    wanted = tree.filter("seq % 3 = 0").select("dle", "point", "path")
    return chains.collect_selection(tree, wanted).withColumn("members", F.array_join("members", "|"))


def selection_of(t: Tables) -> DataFrame:
    return t.member.filter("seq % 4 < 2").select("dle", "level", "path").distinct()


@query(
    """with r as (select *, coalesce(lead(off) over (partition by dle, level order by seq), 4611686018427387903) as e from member), s as (select r.dle, r.level, r.off as st, r.e from r where exists (select 1 from member m where m.seq % 4 < 2 and m.dle = r.dle and m.level = r.level and m.path = r.path)),
    b as (select *, case when max(e) over (partition by dle, level order by st, e rows between unbounded preceding and 1 preceding) >= st then 0 else 1 end as nw from s), g as (select *, sum(nw) over (partition by dle, level order by st, e rows unbounded preceding) as g from b)
    select dle, level, min(st) as start, max(e) as "end", count(*) as n from g group by dle, level, g"""
)
def extents(t: Tables) -> DataFrame:
    return reads.extents(t.member, selection_of(t))


def frames_of(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Frames of 4096 raw bytes, half as long encoded, for every archive, and the archives' sizes."""
    totals = t.member.groupBy("dle", "level").agg((F.max("off") + 5000).alias("raw_total")).withColumn("enc_total", F.expr("raw_total div 2"))
    frame = totals.select("dle", "level", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("raw_total") - 1, F.lit(4096).cast("long"))).alias("seq", "raw")).withColumn("enc", F.expr("raw div 2"))
    return frame, totals


FETCH = """with r as (select *, coalesce(lead(off) over (partition by dle, level order by seq), 4611686018427387903) as e from member),
    sz as (select dle, level, max(off) + 5000 as raw_total from member group by dle, level),
    x as (select r.dle, r.level, r.off as st, least(r.e, raw_total) as e, raw_total from r join sz using (dle, level) where exists (select 1 from member m where m.seq % 4 < 2 and m.dle = r.dle and m.level = r.level and m.path = r.path)),
    f as (select dle, level, raw, least(raw + 4096, raw_total) as raw_end, raw // 2 as enc, case when raw + 4096 >= raw_total then raw_total // 2 else (raw + 4096) // 2 end as enc_end from (select dle, level, raw_total, unnest(range(0, raw_total, 4096)) as raw from sz) q),
    h as (select distinct f.dle, f.level, enc as enc_start, enc_end from x join f on f.dle = x.dle and f.level = x.level and raw < e and raw_end > st),
    b as (select *, case when max(enc_end) over (partition by dle, level order by enc_start, enc_end rows between unbounded preceding and 1 preceding) >= enc_start then 0 else 1 end as nw from h),
    g as (select *, sum(nw) over (partition by dle, level order by enc_start, enc_end rows unbounded preceding) as g from b)
    select dle, level, min(enc_start) as enc_start, max(enc_end) as enc_end, count(*) as n from g group by dle, level, g"""


@query(FETCH)
def fetch_groups(t: Tables) -> DataFrame:
    frame, totals = frames_of(t)
    return reads.fetch_groups(reads.extents(t.member, selection_of(t)), frame, totals)


#: What stands against a read by ranges, by source and level: 0 no index, 1 a selected member without an offset, 2 no frames, 3 no copy that serves ranges.
HINDRANCE = "(length(dle) + level) % 7"


@query(
    f"""with fg as ({FETCH}), tot as (select dle, level, (max(off) + 5000) // 2 as whole from member group by dle, level), chosen as (select dle, level, count(distinct path) as files from member where seq % 4 < 2 and path not like '%/' group by dle, level),
    p as (select dle, level, files, whole, {HINDRANCE} as h, count(enc_start) as n, sum(enc_end - enc_start) as b from tot join chosen using (dle, level) left join fg using (dle, level) group by dle, level, files, whole),
    d as (select *, case h when 0 then 'no index' when 1 then 'no offset' when 2 then 'no frames' when 3 then case when n > 0 then 'no ranged copy' else 'no groups' end else case when n > 0 then '' else 'no groups' end end as reason from p)
    select dle, level, files, case when reason = '' then 'ranged' else 'whole' end as mode, reason, case when reason = '' then n else 2 end as fetches, cast(case when reason = '' then b else whole end as bigint) as bytes, cast(whole as bigint) as whole,
        round(case when reason = '' then b else whole end / 1073741824.0::double * 0.09::double + case when reason = '' then n else 2 end / 1000.0::double * 0.0004::double, 6) as price from d"""
)
def selection_plan(t: Tables) -> DataFrame:
    """How a selection's archives are read, where some lack an index, an offset, frames or a copy that serves ranges."""
    frame, totals = frames_of(t)
    h = F.expr(HINDRANCE)
    index = t.member.filter(h != 0).withColumn("off", F.when((h == 1) & (F.col("seq") % 4 < 2), -1).otherwise(F.col("off")))
    ranged = totals.filter(h != 3).select("dle", "level")
    return reads.selection_plan(selection_of(t), index, frame.filter(h != 2), totals.withColumn("parts", F.lit(2)), rates(t), "cloud", ranged=ranged)


@query(
    """with sz as (select dle, level, max(off) + 5000 as raw_total from member group by dle, level), f as (select dle, level, raw // 4096 as seq, raw from (select dle, level, unnest(range(0, raw_total, 4096)) as raw from sz) q),
    c as (select dle, level, count(*) as n, max(raw) as last, case when count(*) > 1 then 4096 else 0 end as stride from f group by dle, level),
    m as (select *, lead(off) over (partition by dle, level order by seq) as nx from member), h as (select m.dle, m.level, m.off // 4096 as k, min(m.off) as st, arg_min(m.path, m.seq) as path, arg_max(coalesce(m.nx, -1), m.seq) as en from m group by 1, 2, 3),
    s as (select h.*, n, stride, case when en >= 0 then en else last + stride end - st as span, (k - 3 % n + n) % n as turn from h join c using (dle, level)),
    r as (select *, row_number() over (partition by dle, level order by case when stride <= 0 or span <= 4 * stride then 0 else 1 end, case when stride <= 0 or span <= 4 * stride then 0 else span end, turn) as rk from s)
    select dle, level, cast(k as int) as seq, k * 4096 as raw, path, cast(span as bigint) as span from r where rk = 1"""
)
def frame_sample(t: Tables) -> DataFrame:
    return reads.frame_sample(t.member, frames_of(t)[0], 3)


@query(
    """with p as (select *, sum(size) over (partition by arch_key, medium order by part_no) as e from part_file), r as (select arch_key, medium, cast(sum(size) as bigint) // 4 as st, cast(sum(size) as bigint) // 2 as en from part_file group by arch_key, medium)
    select arch_key, medium, st as start, en as "end", part_no, cast(greatest(st, e - size) - (e - size) as bigint) as "from", cast(least(en, e) - (e - size) as bigint) as "to" from p join r using (arch_key, medium) where e - size < en and e > st"""
)
def part_segments(t: Tables) -> DataFrame:
    keys = ["arch_key", "medium"]
    ranges = t.part_file.groupBy(*keys).agg(F.sum("size").alias("s")).select(*keys, F.expr("s div 4").alias("start"), F.expr("s div 2").alias("end"))
    return reads.part_segments(ranges, t.part_file, keys)


@query(CHAIN
    + f""", k as (select dle, count(*) as links, min(run) as full_at from chain group by dle having min(level) = 0)
    select c.dle, l.last_drill, k.links, k.full_at from (select concat('c', cast(c_custkey as string)) as dle from customer) c join k using (dle) left join (select dle as d, last_drill, ok from drill_ledger) l on l.d = c.dle
    where not coalesce(ok and floor(epoch({ET})) - floor(epoch(last_drill)) < 604800, false) order by last_drill is not null, last_drill, links desc, substr(full_at, 5, 10), c.dle limit 25""")
def drill_select(t: Tables) -> DataFrame:
    _, chain = chain_rows(t)
    links = cut(chain.filter("not broken").groupBy("dle").agg(F.count("*").alias("links"), F.min("run").alias("full_at")))
    return summaries.drill_select(configured(t), t.drill_ledger, links, 7, events_now(), 25)


@query(
    CHAIN
    + """, dm as (select dle, arg_min(medium, ord) as medium from route group by dle), ps as (select * replace (case when arch_key % 23 = 0 and part_no = 0 then null else size end as size) from part_file),
    k as (select run, dle, medium, count(*) as parts, min(case when size is null then 0 else 1 end) as sealed from ps group by run, dle, medium),
    x as (select c.dle, c.run, dm.medium, k.parts, coalesce(sealed, 0) as good from chain c join dm using (dle) left join k on k.dle = c.dle and k.run = c.run and k.medium = dm.medium),
    y as (select x.* from x where dle in (select dle from x group by dle having min(good) = 1))
    select y.dle, y.run, y.medium, cast(coalesce(l.drills, 0) % y.parts as int) as part_no, y.parts, p.size from y left join drill_ledger l on l.dle = y.dle join ps p on p.run = y.run and p.dle = y.dle and p.medium = y.medium and p.part_no = coalesce(l.drills, 0) % y.parts"""
)
def sample_plan(t: Tables) -> DataFrame:
    drilled = t.route.groupBy("dle").agg(F.min_by("medium", "ord").alias("medium"))
    parts = t.part_file.withColumn("size", F.when((F.col("arch_key") % 23 != 0) | (F.col("part_no") != 0), F.col("size")))
    return summaries.sample_plan(chain_rows(t)[1], parts, t.drill_ledger, drilled)


@query("select class, count(*) as n, class in ('integrity', 'pipeline', 'chain', 'missing') as is_failure from drill_ledger group by class")
def drill_classes(t: Tables) -> DataFrame:
    rows = attention.classified(t.drill_ledger, attention.drill_classes(t.spark))
    return rows.groupBy("class").agg(F.count("*").alias("n"), F.max("is_failure").alias("is_failure"))


POSTURE = (FLOOR
    + """, n as (select a.run, a.dle, count(distinct p.medium) as n from archive a left join placement p using (run, dle, level) group by a.run, a.dle),
    o as (select medium, sum(compressed) as s, max(capacity) as c from floor group by medium)
    select 'copies' as rule, min(n) as value, min(n) >= 2 as ok from n union all select 'media', count(distinct medium), count(distinct medium) >= 2 from placement
    union all select 'offsite', count(distinct medium), count(distinct medium) >= 1 from placement where medium not in (select medium from route where ord = 0)
    union all select 'errors', count(*) filter (where not ok), count(*) filter (where not ok) = 0 from drill_ledger
    union all select 'capacity', count(*) filter (where c > 0 and s > c), count(*) filter (where c > 0 and s > c) = 0 from o""")


@query(POSTURE)
def posture(t: Tables) -> DataFrame:
    status = retention.capacity_status(floor_of(t), t.medium_dim)
    return placement.posture(t.archive, t.placement, t.route, status, t.drill_ledger)


RUN_LOG = "(select event_id as id, event_type as command, case when event_type = 'error' then 'failure' else 'success' end as outcome, event_id % 9 = 0 as warns, ts, cast(round(value * 1000) as bigint) as moved from events) x"


#: Each medium five times, with capacities and volumes that give every kind of alert.
MEDIA = f"""(select concat(medium, '-', cast(k as string)) as medium, case k when 0 then stored when 1 then cast(residual * 1.05 as bigint) + stored - residual + 1 when 4 then 0 else stored * 2 + 1 end as capacity, stored as used, case k when 1 then stored else residual end as residual,
      case k when 3 then 4 else 0 end as volumes, case medium when 'tape' then 0 when 'disk' then 1 else 2 end as with_room, case when k = 2 then {T} + interval '10 days' when k = 1 then {T} end as over_at from media_use, (values (0), (1), (2), (3), (4)) as v(k))"""

ROLLUP = """rc as (select distinct dle, run from placement where arch_key % 41 <> 0), rn as (select a.dle, a.run, a.level, coalesce(a.base_run, '') as base_run, c.run is not null as copy from archive a left join rc c using (dle, run)),
    rt as (select dle, max(run) as run from archive group by dle),
    rw as (select dle, run, level as at_level, base_run as nx, [run] as seen, not copy as bare from rn semi join rt using (dle, run)
          union all select w.dle, w.run, n.level, n.base_run, list_append(seen, n.run), bare or not n.copy from rw w join rn n on n.dle = w.dle and n.run = w.nx where w.at_level > 0 and not list_contains(seen, w.nx)),
    re as (select *, row_number() over (partition by dle, run order by len(seen) desc) as rk from rw),"""


@query(
    "with recursive " + ROLLUP + re.sub(r"^\s*with\s+(recursive\s+)?", "", FLOOR)
    + f""", media_use as (select medium, cast(sum(compressed) as bigint) as stored, cast(sum(case when labeled or (kind is not null and kind <> 'CONDEMNED') then compressed else 0 end) as bigint) as residual from floor group by medium),
    md as (select *, case when used >= capacity then 'over capacity' when volumes > 0 then case with_room when 0 then 'no room' when 1 then 'last volume' end when residual / capacity::double >= 0.9 then 'retention pressure' when used / capacity::double < 0.9 and over_at < {T} + interval '30 days' then 'capacity forecast' end as topic from {MEDIA} m where capacity > 0),
    lr as (select *, row_number() over (partition by command order by ts desc, id desc) as rk from {RUN_LOG}), cf as (select concat('c', cast(c_custkey as string)) as dle, concat('h', cast(c_custkey % 20 as string)) as host from customer),
    od as (select c.dle from cf c left join drill_ledger l on l.dle = c.dle where coalesce(ok, true) and (last_drill is null or floor(epoch({ET})) - floor(epoch(last_drill)) >= 604800)),
    st as (select dle, any_value(host) as host from cf c left join (select dle, created_at from archive) a using (dle) group by dle having max(created_at) is null or epoch({T}) - epoch(max(created_at)) >= 2592000),
    hs as (select host, count(*) as n from st group by host having count(*) >= 2), f as (
    select 0 as rank, 'red' as severity, 'unrestorable' as topic, dle as subject from re where rk = 1 and (bare or at_level > 0)
    union all select 0, 'red', 'failed', command from lr where rk = 1 and outcome = 'failure' union all select 1, 'amber', 'warning', command from lr where rk = 1 and outcome <> 'failure' and warns
    union all select case when topic in ('over capacity', 'no room') then 0 else 1 end, case when topic in ('over capacity', 'no room') then 'red' else 'amber' end, topic, medium from md where topic is not null
    union all select 0, 'red', 'drill failing', dle from drill_ledger where not ok union all select 1, 'amber', 'drill overdue', count(*)::varchar from od having count(*) > 0
    union all select 1, 'amber', 'stale', host || ': ' || n || ' of ' || (select count(*) from cf where cf.host = hs.host) from hs union all select 1, 'amber', 'stale', dle from st where host not in (select host from hs)
    union all select 1, 'amber', 'size anomaly', dle from ({SIZES}) x union all select 1, 'amber', 'slow dump', dle from ({SLOW}) x
    union all select 0, 'red', 'recoverability', 'copies' where exists (select 1 from archive a where not exists (select 1 from placement p where p.dle = a.dle and p.run = a.run and p.level = a.level))
    union all select 1, 'amber', 'recoverability', 'media' where (select count(distinct medium) from placement) < 2) select * from f"""
)
def attention_list(t: Tables) -> DataFrame:
    """All findings of the fleet, over the real runs, drills, chains and copies, and media of all kinds."""
    archive = t.archive.select("arch_key", "run", "dle", "level", "compressed", "base_run", "created_at")
    copied = cut(placement.with_media(archive, t.placement.select("arch_key", "medium"), ["arch_key"]))
    floor = retention.floor_of_archives(copied.drop("arch_key"), t.medium_dim, now())
    status = retention.capacity_status(floor, t.medium_dim).filter("stored > 0").select("medium", "stored", "residual")
    cut(status).createOrReplaceTempView("media_use")
    media = t.spark.sql(f"select medium, capacity, used, residual, volumes, with_room, over_at from {MEDIA.replace(T, 'timestamp_ntz' + T.removeprefix('timestamp'))} m")
    points = chains.newest_points(copied.withColumn("copy", (F.size("media") > 0) & (F.col("arch_key") % 41 != 0)))
    ledger = cut(t.drill_ledger.select("dle", "last_drill", "ok"))
    overdue = summaries.drill_overdue(configured(t), ledger, 7, events_now())
    dumps = trends.of_newest_run(odd_dumps(t))
    facts = t.placement.agg(F.countDistinct("medium").alias("media"), F.countDistinct(F.when(F.col("medium") != "disk", F.col("medium"))).alias("offsite")).join(t.archive.agg(F.count("*").alias("archives")), F.lit(True))
    short = cut(placement.short_of(copied))
    classes = placement.copy_class(archive, t.placement, t.route, t.sync_rule, t.medium_dim, now(), of=short)
    copies = attention.copy_alerts(placement.short_posture(short, classes), F.col("media"), F.col("offsite"), F.col("archives"), facts)
    stale = summaries.stale_dles(configured(t), t.archive, 30, now())
    return attention.findings(summaries.last_per_command(run_log(t)), media, ledger, overdue, points, stale, configured(t), trends.size_anomalies(dumps), trends.slow_dumps(dumps), copies, now())


def run_log(t: Tables) -> DataFrame:
    warning = F.when(F.col("event_id") % 9 == 0, F.array(F.lit("w"))).otherwise(F.array().cast("array<string>"))
    return t.events.select(F.col("event_id").cast("string").alias("run_id"), F.col("event_type").alias("command"), F.when(F.col("event_type") == "error", "failure").otherwise("success").alias("outcome"), warning.alias("warnings"), F.col("ts").alias("started_at"), F.col("ts").alias("ended_at"), F.round(F.col("value") * 1000).cast("long").alias("bytes_moved"))


@query(f"select case when outcome = 'failure' then 'FAILED' when warns then 'WARNING' else 'OK' end as status, count(*) as runs, cast(sum(moved) as bigint) as bytes, min(ts) as first_at, max(ts) as last_at from {RUN_LOG} group by 1")
def run_digest(t: Tables) -> DataFrame:
    return summaries.digest(run_log(t))


@query(f"select cast(id as string) as run_id, command, case when outcome = 'failure' then 'FAILED' when warns then 'WARNING' else 'OK' end as status, ch as channel from {RUN_LOG}, (values ('mail', 'mail', ''), ('chat', 'mail', 'click'), ('beat', 'healthcheck', '')) as c(ch, kind, list) where kind = 'healthcheck' or ((outcome = 'failure' or warns) and (list = '' or list = command)) or (not (outcome = 'failure' or warns) and (list = command or (list = '' and command = 'dump')))")
def route_alerts(t: Tables) -> DataFrame:
    channels = t.spark.createDataFrame([("mail", "mail", []), ("chat", "mail", ["click"]), ("beat", "healthcheck", [])], "channel string, kind string, commands array<string>")
    return attention.route_alerts(run_log(t), channels)


@query("""with p as (select medium, seq, "at", used, lag(used) over (partition by medium order by "at", seq) as b from usage_sample) select medium, seq, "at", used from p where b is null or b <> used""")
def usage_changes(t: Tables) -> DataFrame:
    return live.usage_changes(t.usage_sample).select("medium", "seq", "at", "used")


@query(f"""with k as (select *, row_number() over (partition by medium, cast("at" as date) order by "at" desc, seq desc) as rk, count(*) over () as n from usage_sample) select medium, seq, "at", used from k where n <= 500 or floor(epoch({ET})) - floor(epoch("at")) <= 10 * 86400 or rk = 1""")
def thin_usage(t: Tables) -> DataFrame:
    return sinks.thin_usage(t.usage_sample, events_now(), 10, 500).select("medium", "seq", "at", "used")


@query(
    """with x as (select landing, floor(epoch(begin_at))::bigint as b, floor(epoch(end_at))::bigint as e, bytes from write_interval), r as (select *, max(e) over (partition by landing order by b, e rows between unbounded preceding and 1 preceding) as m from x),
    s as (select landing, cast(sum(greatest(0, e - greatest(b, coalesce(m, b)))) as bigint) as busy, max(e) - min(b) as wall, cast(sum(bytes) as bigint) as bytes from r group by landing)
    select landing, busy, wall, bytes, round(bytes / busy::double, 6) as rate, round(least(1.0::double, busy / wall::double), 6) as utilisation from s"""
)
def lane_busy(t: Tables) -> DataFrame:
    return live.lane_busy(t.write_interval, "landing")


@query(
    """with s as (select landing, ts, floor(epoch(ts))::bigint as t, sum(bytes) over (partition by landing order by ts, seq) as used from progress_event), n as (select landing, max(t) as nt, max(used) as nu, min(t) as ot, min(used) as ou from s group by landing),
    b as (select landing, max(t) as bt, max(used) as bu from s join n using (landing) where t <= nt - 30 group by landing)
    select landing, case when (select max(nt) from n) - nt <= 30 and nt - coalesce(bt, ot) >= 1 and nu > coalesce(bu, ou) then round((nu - coalesce(bu, ou)) / (nt - coalesce(bt, ot))::double, 6) else 0.0 end as rate from n left join b using (landing)"""
)
def rate_now(t: Tables) -> DataFrame:
    before = preceding(t.progress_event, ["landing"], [F.col("ts"), F.col("seq")], {"before": (F.sum, "bytes")})
    samples = before.withColumn("used", F.coalesce("before", F.lit(0).cast("long")) + F.col("bytes"))
    return live.rate_now(samples, samples.agg(F.max("ts").alias("now")), "landing")
