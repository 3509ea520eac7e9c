"""Queries over configured sources: patterns with excludes, and groups by path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.operators import sources
from fleetlens.plans.queries import query
from fleetlens.plans.tables import Tables, with_views

#: Directories: the folders of all pages below their hosts, and those of the sources.
DIRS = """(select distinct concat('/www/', dle, '/', regexp_replace(path, '/?[^/]*$', '')) as path from member where path like '%/%'
    union select distinct concat('/data/', host, '/', dle) from archive union select distinct concat('/data/', host, '/', dle, '/L', cast(level as string)) from archive)"""

#: Sources of each host: a partition of its data, one of all levels below it, a selection of pages, plain ones; one malformed, one literal.
SPECS = """(select concat(host, '-', k) as origin,
      case k when 0 then concat('/data/', host) when 1 then '/data' when 4 then concat('/data/', host) when 5 then '/data/' end as base,
      case k when 0 then 'c[1-4]*' when 1 then concat(host, '/c?5*/L[0-1]') when 2 then concat('/www/*', substr(host, 2), '*/?[a-z]') when 3 then concat('/data/', host, '/x') when 4 then one when 5 then 'h[' when 6 then concat('/data/', host, '/c[^1-8]*') end as pattern,
      case k when 0 then concat('*.tmp|./', one, '/L0|./', two, '|./none/x|./', one, '/a/b|', '*~') when 1 then concat('./', host, '/', one, '/L1|./', host, '|*.o') when 2 then './a|*.b' when 3 then './c' when 4 then concat('./', one, '-not|./', one, '/d|e') end as exclude
    from (select host, min(dle) as one, max(dle) as two from archive group by host) h, (values (0), (1), (2), (3), (4), (5), (6)) as v(k))"""

@query(
    rf"""with dirs0 as (select string_split(trim(path, '/'), '/') as s from {DIRS} t), dirs as (select distinct s[1:i] as d from dirs0, unnest(range(1, len(s) + 1)) as u(i)),
    spec as (select origin, coalesce(base, '') as base, pattern, case when exclude is null then []::varchar[] else string_split(exclude, '|') end as x from {SPECS} t),
    sp as (select *, case when base = '' then list_position(list_transform(string_split(pattern, '/'), lambda s: regexp_matches(s, '[*?\[]')), true) end as f from spec),
    q as (select origin, base <> '' as based, x, case when base <> '' then base when array_to_string(string_split(pattern, '/')[:f - 1], '/') = '' then '/' else array_to_string(string_split(pattern, '/')[:f - 1], '/') end as root,
                 case when base <> '' then string_split(pattern, '/') else string_split(pattern, '/')[f:] end as g from sp where base <> '' or f > 0),
    r as (select *, case when trim(root, '/') = '' then []::varchar[] else string_split(trim(root, '/'), '/') end as rs from q),
    m as (select origin, based, x, root, array_to_string(d[len(rs) + 1:], '/') as rel, '/' || array_to_string(d, '/') as path from
          (select r.*, d, len(list_filter(range(1, len(g) + 1), lambda i: regexp_full_match(d[len(rs) + i], replace(replace(g[i], '*', '.*'), '?', '.')))) as ok from r join dirs on len(d) = len(rs) + len(g) and d[:len(rs)] = rs where not list_contains(g, 'h[')) z where ok = len(g)),
    e as (select origin, i, x[i] as e, substr(x[i], 3) as t from (select distinct origin, x from r where based) z, unnest(range(1, len(x) + 1)) as u(i) where starts_with(x[i], './')),
    o as (select m.origin, m.rel, e.i, t = rel as whole, './' || substr(t, length(rel) + 2) as own from m join e on e.origin = m.origin and (t = rel or starts_with(t, rel || '/'))),
    child as (select m.origin, root as base, path as source, 'child' as kind,
                list_concat(case when based then list_filter(x, lambda y: not starts_with(y, './')) else x end, coalesce((select list(own order by i) from o where o.origin = m.origin and o.rel = m.rel), [])) as exclude
              from m where not exists (select 1 from o where o.origin = m.origin and o.rel = m.rel and whole)),
    rest as (select origin, root as base, root as source, 'rest' as kind,
                list_concat(list_concat(list_filter(x, lambda y: not starts_with(y, './')), coalesce((select list(e.e order by i) from e where e.origin = r.origin and not exists (select 1 from o where o.origin = e.origin and o.i = e.i)), [])),
                            coalesce((select list('./' || rel order by rel) from m where m.origin = r.origin), [])) as exclude from r where based),
    plain as (select origin, null as base, pattern as source, 'plain' as kind, x as exclude from sp where base = '' and coalesce(f, 0) = 0)
    select origin, base, source, kind, array_to_string(exclude, '|') as exclude from (select * from child union all select * from rest union all select * from plain) z"""
)
def resolve_sources(t: Tables) -> DataFrame:
    """Seven kinds of sources for every host, over the directories of the pages and of the sources."""
    specs = t.spark.sql(with_views(f"select origin, base, pattern, split(exclude, '[|]') as exclude from {SPECS} t"))
    dirs = t.spark.sql(with_views(f"select path from {DIRS} t"))
    return sources.resolve_sources(specs, dirs).withColumn("exclude", F.array_join("exclude", "|"))


#: Sources as paths of several depths, some of which stand above others.
ITEMS = """(select distinct dle as host, concat('/', path) as path from member where path <> ''
    union select distinct host, path from archive union select distinct host, '/data' from archive where level = 3 and arch_key % 7 = 0
    union select distinct host, concat('/mnt/', cast(level as string), '/', substr(dle, 1, 2), '/', dle, case when arch_key % 2 = 0 then '/' else '' end) from archive where arch_key % 11 = 0
    union select distinct host, concat('/mnt-', cast(level as string)) from archive union select distinct host, '/mnt' from archive where arch_key % 13 = 0)"""


@query(
    f"""with it as (select host, path, case when rtrim(path, '/') = '' then '/' else rtrim(path, '/') end as p, row_number() over () as id from {ITEMS} t),
    s as (select *, '/' || split_part(p, '/', 2) as f, len(string_split(p, '/')) as depth from it),
    a as (select *, p = f and f <> '/' and exists (select 1 from s b where b.host = s.host and b.f > s.f and b.f < s.f || '/') as apart from s),
    up as (select a.*, array_to_string(string_split(p, '/')[:i], '/') as node, i from a, unnest(range(2, depth + 1)) as u(i)),
    st as (select host, f, apart, node, i, count(*) as n, bool_or(p = node) as own, sum(depth - i - 1) as noise from up group by all),
    k as (select c.host, c.f, c.apart, regexp_replace(c.node, '/[^/]*$', '') as node, count(*) as parts, bool_or(n >= 2) as populated, bool_or(n >= 2 and own) as covered from st c group by all),
    ok as (select st.* from st left join k using (host, f, apart, node) where own or (parts >= 2 and not covered and (not populated or noise <= 8))),
    g as (select up.id, up.host, up.path, up.p, arg_min(ok.node, ok.i) as base, arg_min(ok.n, ok.i) as n, arg_min(ok.own, ok.i) as own from up join ok using (host, f, apart, node) group by all)
    select host, path, base, case when n >= 2 then case when p = base then '' else substr(p, length(base) + 2) end end as label, n >= 2 and own as rooted from g where p <> '/'
    union all select host, path, p, null, false from it where p = '/'"""
)
def path_groups(t: Tables) -> DataFrame:
    """The display groups of all sources, paths of pages among them."""
    return sources.path_groups(t.spark.sql(with_views(f"select host, path from {ITEMS} t")))
