"""Queries over names and identifiers, pools and capacity, copies to read, and what a selection does not find."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions import columns as C
from fleetlens.operators import chains, placement, retention, summaries
from fleetlens.plans.more import SCAN, scanned
from fleetlens.plans.queries import FLOOR, configured, floor_of, now, query
from fleetlens.plans.recovery import DELTA_MEMBER, TREE, delta_tree
from fleetlens.plans.tables import Tables, with_views
from fleetlens.sources import readers

#: Bytes of the dump that `capacity_incoming` makes room for.
INCOMING = 40_000_000_000
#: Days that `expected_volume_fresh` keeps everything.
CENTURY = 36_500


@query(
    r"""with r as (select case event_type when 'error' then concat('rn-', strftime(ts, '%Y-%m-%d.%H%M%S')) when 'view' then strftime(ts, 'run-%Y-%m-%d.%H') when 'click' then strftime(ts, 'run-%Y-%m-%d') else strftime(ts, 'run-%Y-%m-%d.%H%M%S') end as run from events), d as (select distinct run from r)
    select run, regexp_matches(run, '^run-\d{4}-\d{2}-\d{2}\.\d+$') as valid, regexp_extract(run, '^run-(\d{4}-\d{2}-\d{2})\.(\d+)$', 1) as date,
    case when regexp_matches(run, '^run-\d{4}-\d{2}-\d{2}\.\d+$') then concat(substr(run, 1, 15), lpad(substr(run, 16), 18, '0')) else run end as key from d"""
)
def run_ids(t: Tables) -> DataFrame:
    """Run ids minted from every event, some of them cut or with another mark: whether each parses, its date, and the text it sorts by."""
    minted, kind = C.run_id("ts"), F.col("event_type")
    run = F.when(kind == "error", F.concat(F.lit("rn-"), F.substring(minted, 5, 99))).when(kind == "view", F.substring(minted, 1, 17)).when(kind == "click", F.substring(minted, 1, 14)).otherwise(minted)
    return t.events.select(run.alias("run")).distinct().select("run", C.run_valid("run").alias("valid"), C.run_date("run").alias("date"), C.run_key("run").alias("key"))


@query(
    """with d as (select distinct concat(host, ':', path) as display from archive union select distinct dle from archive union select distinct concat(regexp_extract(url, '^https?://([^/]+)', 1), ':', url) from pages)
    select display, case when position(':' in display) > 0 then split_part(display, ':', 1) else '' end as host, case when position(':' in display) > 0 then substr(display, position(':' in display) + 1) else display end as path from d"""
)
def display_parts(t: Tables) -> DataFrame:
    """Display ids of sources, of sources known by their slug alone, and of pages, whose paths hold colons, taken apart."""
    own = t.archive.select(C.dle_display("host", "path", "dle").alias("display"))
    bare = t.archive.select(C.dle_display(F.lit(""), F.lit(""), "dle").alias("display"))
    pages = t.pages.select(C.dle_display(F.regexp_extract("url", "^https?://([^/]+)", 1), "url", "url").alias("display"))
    return own.unionByName(bare).unionByName(pages).distinct().withColumn("parts", C.split_display("display")).select("display", "parts.host", "parts.path")


@query(
    rf"""with m as (select dle, level, seq, path, regexp_replace(path, '(^|/)INCREMENTAL\.([^/]*)$', '\1\2') as logical from {DELTA_MEMBER} x)
    select dle, level, seq, path, logical, regexp_replace(regexp_replace(logical, '\.[0-9]+$', ''), '_(fsm|vm|init)$', '') as relation from m"""
)
def logical_paths(t: Tables) -> DataFrame:
    """Every member of archives with deltas, the file it stands for and the table that file belongs to."""
    member = t.spark.sql(with_views(f"select dle, level, seq, path from {DELTA_MEMBER} m"))
    return member.select("*", C.logical_path("path").alias("logical"), C.relation_key("path").alias("relation"))


@query("select substr(label, 1, 2) as drive, count(*) as volumes, max(used) as size, greatest(max(used) - 65536, 0) as usable, count(*) * greatest(max(used) - 65536, 0) as bytes from volume group by 1")
def pool_sizes(t: Tables) -> DataFrame:
    """What the volumes of each drive hold together, each as large as the fullest one."""
    rows = t.volume.groupBy(F.substring("label", 1, 2).alias("drive")).agg(F.count("*").alias("volumes"), F.max("used").alias("size"))
    return rows.select("*", C.usable_volume("size").alias("usable"), C.pool_bytes("volumes", "size").alias("bytes"))


@query("with d as (select substr(run, 5, 10) as day, cast(sum(compressed) as bigint) as bytes from archive group by run), m as (select max(bytes) as most from d) select day, bytes, case when bytes <= 0 then 0 else least(4, 1 + cast(floor(bytes * 3.0::double / most) as int)) end as weight from d, m")
def load_weights(t: Tables) -> DataFrame:
    """How heavy each night was against the heaviest."""
    return summaries.load_weights(summaries.daily_load(t.archive))


@query("select distinct run from placement where medium = 'tape'")
def runs_on_tape(t: Tables) -> DataFrame:
    return placement.runs_on(t.placement, "tape")


@query(
    """with r as (select *, row_number() over (partition by run, dle, level order by case when medium = 'disk' then 0 else 1 end, medium) as rk from placement), c as (select * from placement where medium = 'cloud')
    select a.dle, a.run, a.level, r.medium as first, r.bytes as first_bytes, c.medium as forced, c.bytes as forced_bytes from archive a left join r on r.run = a.run and r.dle = a.dle and r.level = a.level and rk = 1 left join c on c.run = a.run and c.dle = a.dle and c.level = a.level"""
)
def copies_to_read(t: Tables) -> DataFrame:
    """The copy of each archive that a restore reads by itself, and the one it reads when told to read from the cloud."""
    refs = t.archive.select("dle", "run", "level")
    first = chains.located(refs, t.placement, "disk").select("dle", "run", "level", F.col("medium").alias("first"), F.col("bytes").alias("first_bytes"))
    return chains.located(first, t.placement, "disk", forced="cloud").select("dle", "run", "level", "first", "first_bytes", F.col("medium").alias("forced"), F.col("bytes").alias("forced_bytes"))


@query(
    FLOOR
    + f""", u as (select medium, sum(case when labeled or (kind is not null and kind <> 'CONDEMNED') then compressed else 0 end) as residual, count(*) filter (where kind in ('LAST_FULL', 'CHAIN')) as chained from floor group by medium),
    s as (select m.medium, m.capacity, cast(coalesce(residual, 0) as bigint) as residual, coalesce(chained, 0) as chained from medium_dim m left join u using (medium))
    select medium, residual, capacity > 0 and residual + {INCOMING} > capacity as infeasible, capacity > 0 and residual + {INCOMING} > capacity and chained = 0 as age_bound from s"""
)
def capacity_incoming(t: Tables) -> DataFrame:
    """Whether each medium could take in one more large dump after all that may go has gone."""
    return retention.capacity_status(floor_of(t), t.medium_dim, INCOMING).select("medium", "residual", "infeasible", "age_bound")


@query("with o as (select min(label) as label from volume where label not in (select label from part_file)) select label, 0::bigint as used, label is null as fresh from o")
def expected_volume_fresh(t: Tables) -> DataFrame:
    """The volume to load where every archive is too young to be written over: a fresh one."""
    media = t.medium_dim.withColumn("min_age_days", F.lit(CENTURY))
    floor = floor_of(t, media)
    return summaries.expected_volume(t.volume, retention.reusable_volumes(floor, t.part_file, t.volume), False)


@query(SCAN.replace("where pos % 9 <> 0", "where pos % 9 <> 0 and not starts_with(label, 'T3-')") + " select run, dle, level, 'tape' as medium, parts from c join g using (run, dle, level) where n = parts")
def assemble_pool(t: Tables) -> DataFrame:
    """A scan that meets volumes of another pool and volumes without one: the first are passed over."""
    pool = F.when(F.col("label").startswith("T3-"), "other").when(F.col("label").startswith("T2-"), "").otherwise("main")
    return scanned(t, pool)[0].select("run", "dle", "level", "medium", "parts")


@query(
    """with m as (select * from (values ('disk', 'disk', 50000000000), ('cloud', 'cloud', 0), ('tape', 'tape', 200000000000)) as v(medium, type, capacity)),
    r as (select concat('c', cast(c_custkey as string)) as dle, 'disk' as medium from customer), x as (select dle, medium from r union select dle, 'cloud' from r union select dle, 'tape' from r),
    h as (select distinct dle, medium from placement)
    select m.medium, m.type, m.capacity, count(*) as sources, count(h.dle) as holding from x join m using (medium) left join h on h.dle = x.dle and h.medium = x.medium group by all"""
)
def configured_media(t: Tables) -> DataFrame:
    """Media of a configuration given as rows, with the sources that its routes and rules bring to each and those that have a copy there."""
    media = [("disk", "disk", 50_000_000_000, 30, False), ("cloud", "cloud", 0, 90, False), ("tape", "tape", 200_000_000_000, 0, True)]
    dims = readers.dims(t.spark, media, [("*", "disk", 0)], [("disk", "cloud", 100), ("disk", "tape", 0)])
    route = configured(t).select("dle").crossJoin(F.broadcast(dims["route"].select("medium", "ord")))  # a row a route
    reach = placement.reachable_media(route, dims["sync_rule"])
    held = t.placement.select("dle", "medium").distinct().withColumn("held", F.lit(1))
    rows = reach.join(held, ["dle", "medium"], "left").groupBy("medium").agg(F.count("*").alias("sources"), F.count("held").alias("holding"))
    return rows.join(F.broadcast(dims["medium_dim"].select("medium", "type", "capacity")), "medium").select("medium", "type", "capacity", "sources", "holding")


@query(f"with {TREE} select tree.dle, tree.path, tree.run, tree.level, tree.is_dir, count(*) as versions from tree join w on w.dle = tree.dle and w.p = tree.path and w.g = tree.g group by all")
def tree_as_of_delta(t: Tables) -> DataFrame:
    """The newest copy of every path of hosts whose files are stored as deltas, and how many copies it is put together from."""
    member = t.spark.sql(with_views(f"select dle, level, run, seq, path, off from {DELTA_MEMBER} m"))
    chain = member.select("dle", F.lit("p").alias("point"), "run", "level").distinct()
    return chains.tree_as_of(chain, member, delta=True).select("dle", "path", "run", "level", "is_dir", F.col("versions").cast("long").alias("versions"))


@query(
    f"""with {TREE}, known as (select distinct dle, array_to_string(string_split(path, '/')[:i], '/') as path from versions, unnest(range(1, len(string_split(path, '/')) + 1)) as u(i)),
    asked as (select dle, path from versions union select dle, concat(path, '.gone') from versions union select dle, regexp_replace(path, '/?[^/]*$', '') from versions where position('/' in path) > 0)
    select dle, path from asked anti join known using (dle, path)"""
)
def selection_not_found(t: Tables) -> DataFrame:
    """Of paths, the directories above them and paths that never were: what a selection would not find."""
    tree = chains.cut(delta_tree(t))
    paths = F.array(F.col("path"), F.concat("path", F.lit(".gone")), F.when(F.contains("path", F.lit("/")), C.parent("path")))
    asked = tree.select("dle", "point", F.explode(paths).alias("path")).filter("path is not null").distinct()
    return chains.not_found(tree, asked).select("dle", "path")
