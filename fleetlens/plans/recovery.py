"""Queries over sources whose archiver stores files as deltas, and over many points in time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.operators import chains
from fleetlens.plans.queries import query
from fleetlens.plans.tables import Tables, with_views

#: Pages as files of their host that three levels hold: whole at level 0, whole or as deltas later, and each missing from some level.
DELTA_MEMBER = """(select dle, cast(lv as int) as level, concat('run-2000-01-0', cast(lv + 1 as string), '.000000') as run, seq, path as clean,
      case when lv > 0 and (seq + lv) % 3 = 0 and not path like '%/' then concat('./', regexp_replace(path, '[^/]*$', ''), 'INCREMENTAL.', regexp_extract(path, '([^/]*)$', 1)) else concat('./', path) end as path, seq * 10 as off
    from (select page_id as seq, regexp_replace(regexp_replace(url, '^https?://[^/]+/', ''), '[?#].*$', '') as path, regexp_extract(url, '^https?://([^/]+)', 1) as dle from pages) pg, (values (0), (1), (2)) as v(lv)
    where path <> '' and (seq + lv) % 5 <> 0)"""


def delta_tree(t: Tables) -> DataFrame:
    member = t.spark.sql(with_views(f"select dle, level, run, seq, path, off from {DELTA_MEMBER} m"))
    chain = member.select("dle", F.lit("p").alias("point"), "run", "level").distinct()
    return chains.tree_versions(chain, member)


#: The same in SQL: copies in order, counted from the last whole one on.
TREE = f"""m as (select *, position('INCREMENTAL.' in path) > 0 as delta, regexp_replace(clean, '/+$', '') as p, ends_with(clean, '/') as d from {DELTA_MEMBER} x),
    top as (select dle, max(run) as newest from m group by dle),
    seen as (select distinct dle, array_to_string(string_split(p, '/')[:i], '/') as p from (select m.dle, p from m join top on top.dle = m.dle and run = newest) q, unnest(range(1, len(string_split(p, '/')) + 1)) as u(i)),
    w as (select *, sum((not delta)::int) over (partition by dle, p order by run, seq) as g, max(run || lpad(seq::varchar, 12, '0')) over (partition by dle, p) as last from m semi join seen using (dle, p)),
    tree as (select dle, p as path, arg_max(d, run || lpad(seq::varchar, 12, '0')) as is_dir, arg_max(delta, run || lpad(seq::varchar, 12, '0')) as delta, arg_max(path, run || lpad(seq::varchar, 12, '0')) as member, arg_max(run, run || lpad(seq::varchar, 12, '0')) as run,
             arg_max(level, run || lpad(seq::varchar, 12, '0')) as level, max(g) as g from w group by dle, p),
    versions as (select tree.dle, tree.path, tree.is_dir, tree.delta, tree.member, tree.run, tree.level, string_agg(w.run || ' ' || w.path, '|' order by w.run, w.seq) as versions from tree join w on w.dle = tree.dle and w.p = tree.path and w.g = tree.g group by all)"""

#: Wanted: the paths of every third length and the first directory of some hosts.
WANTED = "wanted as (select dle, path from versions where length(path) % 3 = 0 union select distinct dle, split_part(path, '/', 1) from versions where length(dle) % 5 = 0)"
CHOSEN = """chosen as (select distinct v.dle, v.path from versions v join wanted w on w.dle = v.dle and (v.path = w.path or starts_with(v.path, w.path || '/'))),
    above as (select dle, path from chosen union select v.dle, v.path from versions v join chosen c on c.dle = v.dle and starts_with(c.path, v.path || '/'))"""


def shown(versions: str = "versions"):
    return F.array_join(F.transform(versions, lambda v: F.concat_ws(" ", v["run"], v["member"])), "|")


def wanted(tree: DataFrame) -> DataFrame:
    some = tree.filter(F.length("path") % 3 == 0).select("dle", "point", "path")
    return some.unionByName(tree.filter(F.length("dle") % 5 == 0).select("dle", "point", F.concat(F.lit("./"), F.substring_index("path", "/", 1), F.lit("/")).alias("path")))


@query(f"with {TREE} select dle, path, is_dir, versions from versions")
def tree_versions(t: Tables) -> DataFrame:
    """The tree of every host, each file with the copies it is put together from."""
    return delta_tree(t).select("dle", "path", "is_dir", shown().alias("versions"))


@query(f"with {TREE}, {WANTED}, {CHOSEN} select dle, run, level, string_agg(member, '|' order by path) as members, count(*) as n from versions join above using (dle, path) where not delta group by dle, run, level")
def selection_steps(t: Tables) -> DataFrame:
    """Members to extract for a selection of files and directories in every host."""
    tree = chains.cut(delta_tree(t))
    return chains.collect_selection(tree, wanted(tree)).select("dle", "run", "level", F.array_join("members", "|").alias("members"), "n")


@query(f"with {TREE}, {WANTED}, {CHOSEN} select dle, path, versions from versions join chosen using (dle, path) where delta")
def selection_assemblies(t: Tables) -> DataFrame:
    """Files of the same selection that are put together from deltas."""
    tree = chains.cut(delta_tree(t))
    return chains.collect_assemblies(tree, wanted(tree)).select("dle", "path", shown().alias("versions"))
