"""Backup metadata tables derived from the driver's tables, in SQL that Spark and DuckDB both read."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from fleetlens.plans.lineage import cut, tasks

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")

VIEWS: dict[str, str] = {
    "archive": """
        select arch_key, run, dle, host, path, level, compressed, uncompressed, file_count, unreadable,
               case when level = 0 then null when arch_key % 33 = 0 then 'run-1990-01-01.000000' when arch_key % 67 = 0 then after_run when arch_key % 101 = 0 then run
                    when arch_key % 5 < 2 then before_run end as base_run, created_at
        from (select *, lag(run) over (partition by dle order by run) as before_run, lead(run) over (partition by dle order by run) as after_run
              from (select o_orderkey as arch_key, concat('run-', cast(cast(o_orderdate as date) as string), '.000000') as run,
                           concat('c', cast(o_custkey as string)) as dle, concat('h', cast(o_custkey % 20 as string)) as host,
                           concat('/data/c', cast(o_custkey as string)) as path,
                           case substr(o_orderpriority, 1, 1) when '1' then 0 when '2' then 1 when '3' then 1 when '4' then 2 else 3 end as level,
                           cast(round(o_totalprice * 100) as bigint) as compressed,
                           cast(round(o_totalprice * 100) as bigint) * (1 + o_orderkey % 4) as uncompressed,
                           cast(o_orderkey % 1000 as bigint) as file_count,
                           cast(case when o_orderkey % 50 = 0 then 1 else 0 end as int) as unreadable,
                           o_orderdate + interval '1' second * cast(o_orderkey % 80000 as int) as created_at
                    from (select *, row_number() over (partition by o_custkey, cast(o_orderdate as date) order by o_orderkey desc) as rn from orders) o
                    where rn = 1) named) linked""",
    "part_line": """
        select l_orderkey, l_linenumber, max(l_suppkey) as supp, sum(cast(round(l_extendedprice * 100) as bigint)) as size
        from lineitem group by l_orderkey, l_linenumber""",
    "part_file": """
        select arch_key, run, dle, level, medium,
               cast(row_number() over (partition by arch_key, medium order by l_linenumber) - 1 as int) as part_no,
               case when medium = 'tape' then concat('T', cast(supp % 4 as string), '-', substr(run, 5, 10)) else '' end as label,
               cast(arch_key * 10 + l_linenumber as bigint) as pos, size
        from (select a.arch_key, a.run, a.dle, a.level, l.l_linenumber, l.supp, cast(l.size as bigint) as size,
                     case l.supp % 3 when 0 then 'disk' when 1 then 'cloud' else 'tape' end as medium
              from part_line l join archive a on a.arch_key = l.l_orderkey) m""",
    "placement": """
        select run, dle, level, medium, arch_key, count(*) as parts, cast(sum(size) as bigint) as bytes
        from part_file group by run, dle, level, medium, arch_key""",
    "dump_stat": """
        select run as run_id, created_at as ended_at, dle, level, uncompressed as orig, compressed as out, file_count as files,
               cast(arch_key % 600 + 1 as bigint) as seconds from archive""",
    "usage_sample": """
        select event_id as seq, ts as at, event_type as medium,
               cast(floor((day(ts) * 1440 + hour(ts) * 60 + minute(ts)) / 240.0) * 100000 as bigint) as used
        from events""",
    "drill_ledger": """
        select concat('c', cast(user_id as string)) as dle, ts as last_drill, event_type <> 'error' as ok,
               case when event_type = 'error' then case event_id % 5 when 0 then 'integrity' when 1 then 'pipeline' when 2 then 'chain' when 3 then 'missing' else 'odd' end
                    when event_id % 7 = 0 then 'skipped' else 'ok' end as class, n as drills
        from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rn, count(*) over (partition by user_id) as n from events) e
        where rn = 1""",
    "progress_event": """
        select event_id as seq, ts, concat('c', cast(user_id as string)) as dle, event_type as landing,
               cast(round(value * 1000) as bigint) as bytes from events""",
    "write_interval": """
        select event_id as seq, event_type as landing, ts as begin_at, ts + interval '1' second * cast(round(value) as int) as end_at,
               cast(round(value * 1000) as bigint) as bytes from events where value >= 1""",
    "route": """
        select concat('c', cast(c_custkey as string)) as dle, 'disk' as medium, 0 as ord from customer
        union all select concat('c', cast(c_custkey as string)), 'cloud', 1 from customer where c_custkey % 2 = 0""",
    "member": """
        select host as dle, cast(page_id % 3 as int) as level, page_id as seq, path,
               cast(coalesce(sum(n) over (partition by host, page_id % 3 order by page_id rows between unbounded preceding and 1 preceding), 0) as bigint) as off
        from (select page_id, length(html) as n, regexp_extract(url, '^https?://([^/]+)', 1) as host,
                     regexp_replace(regexp_replace(url, '^https?://[^/]+/', ''), '[?#].*$', '') as path from pages) p""",
    "medium_dim": """
        select * from (values ('disk', 'disk', 50000000000, 30, false), ('cloud', 'cloud', 0, 90, false), ('tape', 'tape', 200000000000, 0, true))
               as t(medium, type, capacity, min_age_days, labeled)""",
    "sync_rule": "select * from (values ('', 'tape', 0), ('disk', 'cloud', 100)) as t(src, dst, last_n)",
    "volume": """
        select label, 'main' as pool, cast(1 as int) as epoch, max(run) as last_run, count(distinct run) as runs, cast(sum(size) as bigint) as used,
               cast(concat(substr(min(run), 5, 10), ' 12:00:00') as timestamp) as written_at
        from part_file where label <> '' and label not like 'T1-%7' group by label""",
}

#: Views that a query writes when it first reads them.
WRITTEN = ("archive", "part_file", "placement")

#: The instants the questions are asked at.
NOW = "2001-08-02 00:00:00"
EVENTS_NOW = "2024-02-01 00:00:00"


def needed(sql: str, views: dict[str, str] = VIEWS) -> list[str]:
    """Views that sql reads, directly or through others, in order of definition."""
    found: set[str] = set()
    todo = [sql]
    while todo:
        words = set(re.findall(r"\b[a-z_]+\b", todo.pop()))
        new = {v for v in views if v in words} - found
        found |= new
        todo += [views[v] for v in new]
    return [v for v in views if v in found]


def with_views(sql: str, views: dict[str, str] = VIEWS) -> str:
    """sql with the views it needs in front, as one statement; sql may begin with its own `with` list."""
    own = sql.strip()
    heads = [f"{v} as ({views[v]})" for v in needed(own, views)]
    recursive = ""
    if m := re.match(r"with\s+(recursive\s+)?", own, re.I):
        recursive = m[1] or ""
        if heads:
            return f"with {recursive}" + ",\n".join(heads) + ",\n" + own[m.end() :]
        return own
    return ("with " + ",\n".join(heads) + "\n" if heads else "") + own


def dealt(n: int) -> dict[str, str]:
    """Views as VIEWS has them, with rows dealt to n tasks once for all that is done with them: orders by customer, in runs of a day and in the runs of a source, lines by order, for their sums, their archives, and parts and copies."""
    archive = VIEWS["archive"].replace("from orders)", f"from (select /*+ repartition({n}, o_custkey) */ * from orders) d)")
    archive = archive.replace("select o_orderkey as arch_key,", "select o_custkey, o_orderkey as arch_key,").replace("partition by dle", "partition by o_custkey")
    return {"archive": archive, "part_line": VIEWS["part_line"].replace("from lineitem", f"from (select /*+ repartition({n}, l_orderkey) */ * from lineitem) l")}


class Tables:
    """The views over one folder of driver tables; each attribute is a DataFrame."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.views = VIEWS | dealt(tasks(spark))
        for name in BASE:
            spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)

    def sql(self, text: str) -> DataFrame:
        """A statement over the views."""
        return self.spark.sql(with_views(text, self.views))

    def __getattr__(self, name: str) -> DataFrame:
        if name in WRITTEN:
            # Derived by shuffles and read several times by most queries: written once a query.
            written = self.__dict__[name] = cut(self.sql(f"select * from {name}"))
            # Views made of it from now on read what is written.
            view = f"written_{uuid.uuid4().hex}"
            written.createOrReplaceTempView(view)
            self.views[name] = f"select * from {view}"
            return written
        if name in VIEWS:
            return self.sql(f"select * from {name}")
        if name in BASE:
            return self.spark.table(name)
        raise AttributeError(name)
