from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import chains, retention
from tests.helpers import COLUMNS, NOW, archive, random_catalog, slow_base, slow_floor, slow_reclaim, slow_stranded


def frame(spark, rows):
    return spark.createDataFrame(rows, COLUMNS)


def now():
    return F.lit(str(NOW)).cast("timestamp_ntz")


def many(seeds):
    """Several random catalogs as one: sources of each carry its number."""
    catalogs = {}
    for s in seeds:
        catalogs[s] = [(*r[:2], f"k{s}-{r[2]}", *r[3:]) for r in random_catalog(s)]
    return catalogs


def test_bases_and_stranded_match_the_walk(spark):
    catalogs = many(range(60))
    df = frame(spark, [r for rows in catalogs.values() for r in rows])
    based = {(r.dle, r.run): r.base for r in chains.base_of(df).collect()}
    lost = {(r.dle, r.run): r.stranded for r in chains.stranded(chains.base_of(df)).collect()}
    for rows in catalogs.values():
        for row in rows:
            assert based[row[2], row[1]] == slow_base(rows, row)
            assert lost[row[2], row[1]] == slow_stranded(rows, row)


def test_chain_is_walked_to_the_full(spark):
    rows = [archive("a", 9, 0), archive("a", 8, 1), archive("a", 7, 2), archive("a", 6, 1), archive("a", 5, 2), archive("b", 5, 1), archive("a", 4, 1, base="run-1990-01-01.000000")]
    df = frame(spark, rows)
    points = spark.createDataFrame([("2024-02-25",)], "point string")
    goal = chains.as_of_by_dle(df, points).select("dle", "point", "run")
    out = chains.chain_summary(chains.chains(chains.base_of(df), goal), df)
    got = {r.dle: (r.links, r.bytes, r.broken) for r in out.collect()}
    assert got == {"a": (3, 30, False), "b": (1, 10, True)}
    late = chains.as_of_by_dle(df, spark.createDataFrame([("2024-02-28",)], "point string")).select("dle", "point", "run")
    assert {r.dle: r.broken for r in chains.chain_summary(chains.chains(chains.base_of(df), late), df).collect()} == {"a": True, "b": True}


def test_as_of_bounds_and_odd_ids(spark):
    rows = [archive("a", 3, 0), archive("a", 2, 1)]
    df = frame(spark, rows).unionByName(frame(spark, [(0, "manual", "z", "h", "/", 0, 1, 1, 1, 0, None, None)]))
    points = spark.createDataFrame([("2024-02-27", None), ("x", dt.datetime(2024, 2, 28)), ("y", dt.datetime(2024, 2, 27, 23, 59, 59)), ("1990-01-01", None)], "point string, bound timestamp_ntz")
    got = {r.point: r.run for r in chains.as_of(df, points).collect()}
    assert got["1990-01-01"] == "manual"  # an id without a date always qualifies
    assert got["x"] != got["y"]  # a run at the bound is included
    late = frame(spark, [archive("a", 3, 0), (0, "manual", "z", "h", "/", 0, 1, 1, 1, 0, None, NOW), archive("a", 2, 1, at=dt.datetime(2024, 2, 28, 0, 0, 0, 500000))])
    bound = spark.createDataFrame([("p", dt.datetime(2024, 2, 28)), ("q", dt.datetime(2024, 2, 28, 0, 0, 1)), ("r", NOW)], "point string, bound timestamp_ntz")
    got = {r.point: r.run for r in chains.as_of(late, bound).collect()}
    assert got["p"] == archive("a", 3, 0)[1] and got["q"] == archive("a", 2, 1)[1]  # half a second after the bound is after it
    assert got["r"] == "run-2024-02-28.000000" or got["r"] == "manual"
    own = {(r.dle, r.point): (r.run, r.level) for r in chains.as_of_by_dle(late, bound).collect()}
    assert own["a", "p"][1] == 0 and own["a", "q"][1] == 1 and ("z", "p") not in own and own["z", "r"][0] == "manual"  # an id without a date is dated by its commit


def test_retention_floor_matches_the_rules(spark):
    catalogs = many(range(100, 160))
    held = frame(spark, [r for rows in catalogs.values() for r in rows]).withColumns({"medium": F.regexp_extract("dle", r"^(k\d+)-", 1), "capacity": F.lit(1000).cast("long"), "min_age_days": F.lit(3), "labeled": F.lit(False)})
    lost = chains.stranded(chains.base_of(held))
    got = {(r.medium, r.run, r.dle): r.kind for r in retention.retention_floor(held, lost, now()).collect()}
    for s, rows in catalogs.items():
        for (run, dle), kind in slow_floor(rows, rows, 3).items():
            assert got[f"k{s}", run, dle] == kind


@pytest.mark.parametrize("target", [0, 60, 200])
def test_reclaim_order_matches_deleting_one_by_one(spark, target):
    catalogs = many(range(200, 260))
    held = frame(spark, [r for rows in catalogs.values() for r in rows]).withColumns({"medium": F.regexp_extract("dle", r"^(k\d+)-", 1), "capacity": F.when(F.regexp_extract("dle", r"^k(\d+)-", 1).cast("int") % 5 == 0, 0).otherwise(1000).cast("long"), "min_age_days": F.lit(2), "labeled": F.lit(False)})
    floor = retention.retention_floor(held, chains.stranded(chains.base_of(held)), now())
    targets = spark.createDataFrame([(f"k{s}", target) for s in catalogs], "medium string, target bigint")
    got: dict[str, list] = {}
    for r in retention.reclaim_plan(floor, targets=targets).orderBy("medium", "place").collect():
        got.setdefault(r.medium, []).append((r.run, r.dle))
    for s, rows in catalogs.items():
        want = slow_reclaim(rows, slow_floor(rows, rows, 2), 0 if s % 5 == 0 else 1000, target)
        assert got.get(f"k{s}", []) == want


def test_a_run_that_skipped_the_source_and_long_chains(spark):
    rows = [archive("a", 30, 0)] + [archive("a", 29 - i, 1, base=archive("a", 30 - i, 0)[1]) for i in range(11)] + [archive("b", 10, 0)]
    df = frame(spark, rows)
    goal = spark.createDataFrame([("a", "p", archive("b", 10, 0)[1]), ("b", "p", archive("b", 10, 0)[1]), ("a", "q", archive("a", 29, 1)[1]), ("b", "q", archive("a", 29, 1)[1])], "dle string, point string, run string")
    got: dict = {}
    for r in chains.chains(chains.base_of(df), goal).orderBy("depth").collect():
        got.setdefault((r.dle, r.point), []).append((r.depth, r.level, r.broken))
    assert [d for d, _, _ in got["a", "p"]] == list(range(12)) and not any(b for *_, b in got["a", "p"])
    assert len(got["a", "q"]) == 2 and len(got["b", "p"]) == 1 and ("b", "q") not in got
    lost = {(r.dle, r.run): r.stranded for r in chains.stranded(chains.base_of(df.filter(F.col("run") != rows[5][1]))).collect()}
    assert sum(lost.values()) == 6


def test_restorability_counts(spark):
    rows = [archive("a", 9, 1), archive("a", 8, 0), archive("b", 9, 1), archive("b", 8, 0), archive("c", 9, 1), archive("d", 9, 1), archive("d", 8, 0)]
    df = frame(spark, rows)
    copies = spark.createDataFrame([("a", rows[0][1], "disk"), ("b", rows[0][1], "lto")], "dle string, run string, medium string")
    media = spark.createDataFrame([("disk", False), ("lto", True)], "medium string, labeled boolean")
    assert tuple(chains.restorability(chains.stranded(chains.base_of(df)), copies, media).first()) == (1, 1, 2)


def slow_kept(rows, min_age, day):
    from tests import helpers

    seen, old = [r for r in rows if r[-1] is None or r[-1] <= day], helpers.NOW
    helpers.NOW = day
    try:
        return {k for k, v in slow_floor(seen, seen, min_age).items() if v not in (None, "CONDEMNED")}
    finally:
        helpers.NOW = old


@pytest.mark.parametrize("seeds,days", [(range(300, 340), [11, 8, 5, 2]), (range(300, 306), [13 - i / 30 for i in range(365)])])
def test_kept_days_match_the_floor_of_each_day(spark, seeds, days):
    catalogs = {}
    for s, rows in many(seeds).items():
        # every third catalog commits out of order
        catalogs[s] = [(*r[:-1], r[-1] + dt.timedelta(days=(7 * i * s) % 5) if s % 3 == 0 else r[-1]) for i, r in enumerate(rows)]
    held = frame(spark, [r for rows in catalogs.values() for r in rows]).withColumns({"medium": F.regexp_extract("dle", r"^(k\d+)-", 1), "capacity": F.lit(0).cast("long"), "min_age_days": F.lit(3), "labeled": F.lit(False)})
    days = [NOW - dt.timedelta(days=d) for d in days]
    got: dict = {}
    for r in retention.kept_days(held, spark.createDataFrame([(d,) for d in days], "day timestamp_ntz")).collect():
        got.setdefault((r.medium, r.run, r.dle), set()).update(r.kept)
    for s, rows in catalogs.items():
        for k, day in enumerate(days):
            want = slow_kept(rows, 3, day)
            assert {(run, dle) for (m, run, dle), kept in got.items() if m == f"k{s}" and k in kept} == want, (s, k)


def test_recovery_points_name_the_fault(spark):
    a, b = archive("a", 9, 0), archive("a", 8, 1, base=archive("a", 9, 0)[1])
    c = archive("a", 7, 1, base="run-1990-01-01.000000")
    d, e = archive("b", 6, 1, base=archive("b", 5, 2)[1]), archive("b", 5, 2, base=archive("b", 6, 1)[1])
    f, g = archive("c", 9, 1, base="run-1990-01-01.000000"), archive("d", 9, 1, base=archive("d", 9, 1)[1])
    long = [archive("e", 30, 0)] + [archive("e", 29 - i, 1, base=archive("e", 30 - i, 0)[1]) for i in range(9)]
    df = frame(spark, [a, b, c, d, e, f, g, *long])
    bare = F.concat("dle", "run").isin("a" + a[1], "c" + f[1], "d" + g[1])
    copies = df.filter(~bare).select("run", "dle", "level")
    rows = {(r.dle, r.run): (r.verdict, r.links) for r in chains.recovery_points(df, copies).collect()}
    got = {k: v for k, (v, _) in rows.items() if k[0] != "e"}
    assert got == {("a", a[1]): "no copy", ("a", b[1]): "no copy", ("a", c[1]): "base missing", ("b", d[1]): "cycle", ("b", e[1]): "cycle", ("c", f[1]): "no copy", ("d", g[1]): "cycle"}  # the first fault from the tip, a cycle before any
    assert rows["b", d[1]][1] == 2 and rows["d", g[1]][1] == 1 and rows["e", long[-1][1]] == ("complete", 10)


def test_tree_with_deltas_and_census(spark):
    chain = spark.createDataFrame([("a", "p", "run-2024-01-01.000000", 0), ("a", "p", "run-2024-01-02.000000", 1)], "dle string, point string, run string, level int")
    rows = [("a", 0, "./x/", 0, 0), ("a", 0, "x/f", 1, 10), ("a", 0, "gone", 2, 20), ("a", 1, "x/INCREMENTAL.f", 0, 0), ("a", 1, "x/", 1, 5)]
    member = spark.createDataFrame(rows, "dle string, level int, path string, seq int, off bigint").withColumn("run", F.format_string("run-2024-01-%02d.000000", F.col("level") + 1))
    plain = {r.path: r.level for r in chains.tree_as_of(chain, member).collect()}
    assert plain == {"x": 1, "x/f": 0, "gone": 0, "x/INCREMENTAL.f": 1}
    delta = {r.path: (r.level, r.versions) for r in chains.tree_as_of(chain, member, delta=True).collect()}
    assert delta == {"x": (1, 1), "x/f": (1, 2)}
    tree = chains.tree_as_of(chain, member)
    wanted = spark.createDataFrame([("a", "p", "x"), ("a", "p", "nowhere")], "dle string, point string, path string")
    picked = {(r.level): list(r.members) for r in chains.collect_selection(tree, wanted, strict=False).collect()}
    assert picked == {0: ["x/f"], 1: ["x", "x/INCREMENTAL.f"]}
    assert [r.path for r in chains.not_found(tree, wanted).collect()] == ["nowhere"]
    assert [r.name for r in chains.list_dir(tree, "").collect()] == ["x", "gone"]


def test_chain_places(spark):
    chain = spark.createDataFrame([("a", "p", "run-1", 0), ("a", "p", "run-2", 1), ("b", "p", "run-1", 0), ("b", "p", "run-2", 1), ("b", "p", "run-3", 2)], "dle string, point string, run string, level int")
    held = [("a", "run-1", 0, "tape"), ("a", "run-2", 1, "tape"), ("a", "run-1", 0, "disk"), ("a", "run-2", 1, "disk"), ("a", "run-2", 1, "cloud"), ("b", "run-1", 0, "tape"), ("b", "run-2", 1, "disk"), ("b", "run-1", 0, "cloud")]
    parts = [("a", "run-1", 0, "tape", 0, "T2"), ("a", "run-1", 0, "tape", 1, "T1"), ("a", "run-2", 1, "tape", 0, "T2"), ("a", "run-2", 1, "tape", 1, "T0"), ("a", "run-1", 0, "disk", 0, ""), ("b", "run-1", 0, "tape", 1, "T1"), ("b", "run-1", 0, "tape", 0, "T3")]
    key = "dle string, run string, level int, medium string"
    got = chains.chain_places(chain, spark.createDataFrame(held, key), spark.createDataFrame(parts, key + ", part_no int, label string"))
    assert {r.dle: (r.one_place, r.media) for r in got.collect()} == {"a": (True, "disk, tape:T2+T1+T0"), "b": (False, "L0: cloud, tape:T3+T1 · L1: disk · L2: none")}


def test_long_sources_go_by_rounds_and_short_ones_by_lists(spark, monkeypatch):
    """Both ways give the same, and short sources write no rounds."""
    df = frame(spark, [r for rows in many(range(4)).values() for r in rows])

    def answers():
        based = chains.base_of(df)
        return sorted(map(tuple, based.select("dle", "run", "base").collect()), key=str), sorted(map(tuple, chains.stranded(based).collect()))

    rounds = []
    counting = chains.cut_counting
    monkeypatch.setattr(chains, "cut_counting", lambda *a: rounds.append(1) or counting(*a))
    short = answers()
    assert not rounds
    monkeypatch.setattr(chains, "LONG", 6)
    assert answers() == short and rounds
