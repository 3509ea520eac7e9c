"""What configured sources stand for: directories behind patterns with excludes, and groups of sources by path."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from fleetlens.plans.lineage import cut

GLOB = r"[*?\[]"

#: A regular expression that nothing matches.
NOTHING = "(?!)"


def segment_regex(pattern: str) -> str:
    """A shell pattern for one path segment as a regular expression of the JVM: `*` any run of characters, `?` one, `[...]` and `[^...]` classes of characters and ranges, a backslash takes the next character as it is. A malformed pattern matches nothing."""
    chars, out = iter(pattern), []
    plain = lambda c: f"\\x{{{ord(c):x}}}"

    def one(c: str) -> str:
        if c in "-]":
            raise StopIteration
        return next(chars) if c == "\\" else c

    try:
        for c in chars:
            if c == "*":
                out.append("[^/]*")
            elif c == "?":
                out.append("[^/]")
            elif c == "[":
                c, ranges = next(chars), []
                inverse = c == "^"
                c = next(chars) if inverse else c
                while c != "]" or not ranges:
                    low = high = one(c)
                    c = next(chars)
                    if c == "-":
                        high = one(next(chars))
                        c = next(chars)
                    ranges.append((low, high))
                some = "".join(f"{plain(a)}-{plain(b)}" for a, b in ranges if a <= b)
                out.append(f"[{'^' if inverse else ''}{some}]" if some else "[^/]" if inverse else NOTHING)
            else:
                out.append(plain(next(chars) if c == "\\" else c))
    except StopIteration:
        return NOTHING
    return "^" + "".join(out) + "$"


@pandas_udf(StringType())
def _regex(segments: pd.Series) -> pd.Series:
    return segments.map(segment_regex, na_action="ignore")


def literal(name: Column) -> Column:
    """A name as a pattern that matches it alone."""
    return F.regexp_replace(name, r"([\\*?\[\]])", r"\\$1")


def _edges(dirs: DataFrame) -> DataFrame:
    """(parent, name) of the directories and of all above them; the root is ''."""
    parts = F.filter(F.split("path", "/"), lambda s: s != "")
    up = F.transform(F.sequence(F.lit(1), F.size("_s")), lambda i: F.struct(F.concat(F.when(i > 1, F.lit("/")).otherwise(""), F.array_join(F.slice("_s", 1, i - 1), "/")).alias("parent"), F.element_at("_s", i).alias("name")))
    return dirs.select(parts.alias("_s")).filter(F.size("_s") > 0).select(F.explode(up).alias("e")).select("e.*").distinct()


def matched_dirs(patterns: DataFrame, dirs: DataFrame) -> DataFrame:
    """(key, rel, path): directories that match patterns (key, root, pattern: relative to root), rel relative to root too.

    Directories are edges from parent to name, a level of a tree of names. Every pattern
    goes down the tree a segment at a time: a literal segment by equality of parent and
    name, one with wildcards by equality of parent and then its regular expression.
    """
    edges = cut(_edges(dirs))
    segments = F.split("pattern", "/")
    front = patterns.select("key", F.regexp_replace("root", "/$", "").alias("_at"), F.lit("").alias("rel"), segments.alias("_todo"))
    deepest = front.agg(F.max(F.size("_todo"))).first()[0] or 0
    found = None
    for _ in range(deepest):
        now = front.withColumn("_seg", F.element_at("_todo", 1)).withColumn("_todo", F.slice("_todo", 2, 1 << 20))
        exact = now.filter(~F.col("_seg").rlike(r"[*?\[\\]")).join(edges, (F.col("parent") == F.col("_at")) & (F.col("name") == F.col("_seg")))
        wild = now.filter(F.col("_seg").rlike(r"[*?\[\\]")).withColumn("_rule", _regex("_seg")).join(edges, F.col("parent") == F.col("_at")).filter(F.expr("name rlike _rule")).drop("_rule")
        down = exact.unionByName(wild)
        front = cut(down.select("key", F.concat_ws("/", "_at", "name").alias("_at"), F.when(F.col("rel") == "", F.col("name")).otherwise(F.concat_ws("/", "rel", "name")).alias("rel"), "_todo"))
        done = front.filter(F.size("_todo") == 0).select("key", "rel", F.col("_at").alias("path"))
        found = done if found is None else found.unionByName(done)
        front = front.filter(F.size("_todo") > 0)
    if found is None:
        return patterns.select("key", F.lit("").alias("rel"), F.lit("").alias("path")).limit(0)
    return found


def resolve_sources(patterns: DataFrame, dirs: DataFrame) -> DataFrame:
    """(origin, base, source, kind, exclude) of what each configured source stands for.

    patterns has origin, base, pattern and exclude (an array). Without wildcards and base
    a source is itself ('plain', no base), and so is a base with an empty pattern. Without
    a base, the directories that match are sources of their own ('child') below the
    pattern's literal beginning, each with the excludes as written. With a base, matches
    are children, and what the base has beside them is a source too ('rest'). Excludes
    that begin with ./ are then relative to the base: one below a child is the child's,
    relative to it; one that is a child takes it out; the others are the rest's. The rest
    excludes all children, also those taken out, their names escaped. Others go to all.

    A literal segment is matched too, a malformed one matches nothing, as does a root that
    is not there; null bases and excludes are empty; equal rows are one source; directories
    above those in dirs (path) are there too.
    """
    p = patterns.select("origin", F.coalesce("base", F.lit("")).alias("base"), F.coalesce("pattern", F.lit("")).alias("pattern"), F.coalesce("exclude", F.array().cast("array<string>")).alias("exclude")).distinct()
    segments = F.split("pattern", "/")
    first = F.array_position(F.transform(segments, lambda s: s.rlike(GLOB)), True).cast("int")
    head = F.array_join(F.slice(segments, F.lit(1), F.greatest(first - 1, F.lit(0))), "/")
    based = F.col("base") != ""
    root = F.when(based, F.col("base")).when(head == "", F.lit("/")).otherwise(head)
    rest_of = F.when(based, F.col("pattern")).otherwise(F.array_join(F.slice(segments, F.greatest(first, F.lit(1)), F.lit(1 << 20)), "/"))
    plain = F.when(based, F.col("pattern") == "").otherwise(first == 0)
    p = cut(p.select("*", F.struct("origin", "base", "pattern", "exclude").alias("key"), root.alias("root"), rest_of.alias("_rel"), plain.alias("plain"), based.alias("based")))
    none = F.lit(None).cast("string")
    itself = p.filter("plain").select("origin", none.alias("base"), F.when(F.col("based"), F.col("base")).otherwise(F.col("pattern")).alias("source"), F.lit("plain").alias("kind"), "exclude")
    todo = p.filter("not plain")
    matches = cut(matched_dirs(todo.select("key", "root", F.col("_rel").alias("pattern")), dirs))
    anchored = lambda x: x.startswith("./")
    mine = todo.filter("based").select("key", F.size(F.split("_rel", "/")).alias("_depth"), F.posexplode("exclude").alias("_n", "_x")).filter(anchored(F.col("_x")))
    tail = F.expr("substr(_x, 3)")
    mine = mine.withColumn("_tail", tail).withColumn("_segs", F.split("_tail", "/")).filter(F.size("_segs") >= F.col("_depth")).withColumn("rel", F.expr("array_join(slice(_segs, 1, _depth), '/')"))
    owned = mine.join(matches.select("key", "rel"), ["key", "rel"]).withColumn("_whole", F.size("_segs") == F.col("_depth"))
    below = F.when(~F.col("_whole"), F.struct("_n", F.concat(F.lit("./"), F.expr("substr(_tail, length(rel) + 2)")).alias("x")))
    by_child = owned.groupBy("key", "rel").agg(F.max("_whole").alias("_gone"), F.array_sort(F.collect_list(below)).alias("_own"))
    general = F.when(F.col("based"), F.filter("exclude", lambda x: ~anchored(x))).otherwise(F.col("exclude"))
    full = matches.join(todo.select("key", "origin", "root", "based", "exclude"), "key").join(by_child, ["key", "rel"], "left")
    own = F.coalesce(F.transform("_own", lambda s: s["x"]), F.array().cast("array<string>"))
    child = full.filter(~F.coalesce("_gone", F.lit(False))).select("origin", F.col("root").alias("base"), F.col("path").alias("source"), F.lit("child").alias("kind"), F.concat(general, own).alias("exclude"))
    carved = matches.groupBy("key").agg(F.transform(F.sort_array(F.collect_list("rel")), lambda r: F.concat(F.lit("./"), literal(r))).alias("_carves"))
    taken = owned.groupBy("key").agg(F.collect_set("_n").alias("_taken"))
    left = todo.filter("based").join(carved, "key", "left").join(taken, "key", "left")
    nothing = F.array().cast("array<string>")
    others = F.filter("exclude", lambda x, i: anchored(x) & ~F.coalesce(F.array_contains("_taken", i), F.lit(False)))
    rest = left.select("origin", F.col("root").alias("base"), F.col("root").alias("source"), F.lit("rest").alias("kind"), F.concat(general, others, F.coalesce("_carves", nothing)).alias("exclude"))
    return itself.unionByName(child).unionByName(rest)


#: Path text beyond the first segment that one group may repeat over its members.
NOISE = 8


def path_groups(items: DataFrame) -> DataFrame:
    """(host, path, base, label, rooted): the display group of each source, items (host, path).

    Sources of a host that share a directory below the root form a run. A run whose common
    directory is itself a source is one group, rooted there. Else it is split by the next
    path segment if a part of two or more has such a covering source, or if some part has
    two or more and the members' labels repeat more than NOISE segments beyond their first;
    parts are then grouped alike. A source alone is flat: no label, its own path as base.

    The tree of each run is folded into counts a directory, which decide whether a
    directory stays whole; a source's group is the topmost directory that does. Counts are
    partial before they are shuffled, so a host may have a third of all rows.

    Slashes at the end do not count; a source that stands above others is cut off from
    them where a path sorts between the two; sources without a host are flat; equal rows
    are sources each.
    """
    clean = F.regexp_replace("path", "/+$", "")
    rows = items.select("host", "path").withColumn("_p", F.when(clean == "", F.lit("/")).otherwise(clean)).withColumn("_s", F.split("_p", "/"))
    absolute = F.col("_p").startswith("/")
    first = F.when(absolute, F.concat(F.lit("/"), F.get("_s", F.lit(1)))).otherwise(F.get("_s", F.lit(0)))
    rows = rows.withColumn("_first", first).withColumn("_from", F.when(absolute, 2).otherwise(1)).withColumn("_depth", F.size("_s"))
    grouped = (F.coalesce("host", F.lit("")) != "") & (F.col("_first") != "/") & F.col("path").isNotNull()
    flat = rows.filter(~F.coalesce(grouped, F.lit(False))).select("host", "path", F.when(F.coalesce("host", F.lit("")) == "", F.col("path")).otherwise(F.col("_p")).alias("base"), F.lit(None).cast("string").alias("label"), F.lit(False).alias("rooted"))
    rows = rows.filter(grouped)
    after = F.lead("_first").over(Window.partitionBy("host").orderBy("_first"))
    firsts = rows.select("host", "_first").distinct().withColumn("_after", after)
    between = F.coalesce(F.col("_after").startswith(F.col("_first")) & (F.expr("substr(_after, length(_first) + 1, 1)") < "/"), F.lit(False))
    rows = cut(rows.join(firsts.withColumn("_between", between).drop("_after"), ["host", "_first"]).withColumn("_apart", F.col("_between") & (F.col("_p") == F.col("_first"))).drop("_between", "_s").withColumn("_id", F.monotonically_increasing_id()))
    run = ["host", "_first", "_apart"]
    prefixes = F.expr("transform(sequence(_from, _depth), i -> struct(array_join(slice(split(_p, '/'), 1, i), '/') as node, i as at))")
    nodes = rows.select(*run, "_p", "_depth", F.explode(prefixes).alias("x")).select(*run, "_p", "_depth", "x.*")
    stats = nodes.groupBy(*run, "node", "at").agg(F.count("*").alias("n"), F.max(F.col("_p") == F.col("node")).alias("own"), F.sum("_depth").alias("deep"))
    stats = cut(stats.withColumn("parent", F.regexp_replace("node", "/[^/]*$", "")))
    many = F.col("n") >= 2
    parts = stats.groupBy(*run, F.col("parent").alias("node")).agg(F.count("*").alias("parts"), F.max(many.cast("int")).alias("populated"), F.max(many & F.col("own")).alias("covered"))
    noise = F.col("deep") - F.col("n") * (F.col("at") + 1)
    whole = F.col("own") | ((F.col("parts") >= 2) & ~F.col("covered") & ((F.col("populated") == 0) | (noise <= NOISE)))
    kept = stats.join(parts, [*run, "node"], "left").filter(whole).select(*run, "node", "at", "n", "own")
    up = rows.select(*run, "path", "_p", "_id", F.explode(prefixes).alias("x")).select(*run, "path", "_p", "_id", "x.node")
    top = up.join(kept, [*run, "node"]).groupBy("_id", "host", "path", "_p").agg(F.min_by(F.struct("node", "n", "own"), "at").alias("g"))
    together = F.col("g.n") >= 2
    label = F.when(together, F.when(F.col("_p") == F.col("g.node"), F.lit("")).otherwise(F.expr("substr(_p, length(g.node) + 2)")))
    return top.select("host", "path", F.col("g.node").alias("base"), label.alias("label"), (together & F.col("g.own")).alias("rooted")).unionByName(flat)
