"""Functions, placement, reads, verification, sources and streams on small hand-made tables."""

from __future__ import annotations

import datetime as dt
import gzip
import json

import pytest
from pyspark.sql import functions as F

from fleetlens.functions import columns as C
from fleetlens.operators import attention, chains, placement, reads, summaries, trends
from fleetlens.sources import readers, sinks
from fleetlens.streaming import live


def one(spark, column, *values):
    df = spark.createDataFrame([tuple(values)], [f"c{i}" for i in range(len(values))])
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("text", "size"), [("10", 10), ("1k", 1000), ("1 KiB", 1024), ("1.5GiB", 3 << 29), ("20MB/s", None), ("2.5", 2), (".5GB", 500_000_000), ("+5GB", 5_000_000_000), ("5.k", 5000), ("-1k", None), ("x", None), ("", None)]
)
def test_sizes(spark, text, size):
    assert one(spark, C.parse_bytes("c0"), text) == size


@pytest.mark.parametrize(("text", "size"), [("50MB/s", 50_000_000), ("50MB /s", 50_000_000), ("500KB/S", 500_000), ("1k", 1000), ("x/s", None)])
def test_rates(spark, text, size):
    assert one(spark, C.parse_rate("c0"), text) == size


@pytest.mark.parametrize(("text", "seconds"), [("30d", 2592000), ("2w", 1209600), ("1h30m", 5400), ("1.5h", 5400), ("500ms", 0.5), ("5", None), ("d", None)])
def test_durations(spark, text, seconds):
    assert one(spark, C.parse_duration("c0"), text) == seconds


def test_names_and_paths(spark):
    assert one(spark, C.dle_slug("c0", "c1"), "web 1", "/var/www/") == "web_1-var-www"
    assert one(spark, C.dle_slug("c0", "c1"), "h", "/") == "h-root"
    assert one(spark, C.dle_display("c0", "c1", "c2"), "", "", "slug") == "slug"
    assert tuple(one(spark, C.split_display("c0"), "h:/a:b")) == ("h", "/a:b") and tuple(one(spark, C.split_display("c0"), "nopath")) == ("", "nopath")
    assert tuple(one(spark, C.clean_member("c0"), "./a/b/")) == ("a/b", True) and one(spark, C.clean_member("c0"), "./").path is None
    assert one(spark, C.ancestors("c0"), "a/b/c") == ["a", "a/b"] and one(spark, C.ancestors("c0"), "a") == []
    assert one(spark, C.logical_path("c0"), "d/INCREMENTAL.f") == "d/f"
    assert one(spark, C.relation_key("c0"), "base/1/INCREMENTAL.24_vm") == "base/1/24" and one(spark, C.relation_key("c0"), "base/1/24.3") == "base/1/24"
    assert one(spark, C.run_date("c0"), "run-2024-01-02.001") == "2024-01-02" and one(spark, C.run_date("c0"), "odd") == ""
    assert one(spark, C.run_id("c0"), dt.datetime(2024, 1, 2, 3, 4, 5)) == "run-2024-01-02.030405"
    keys = [one(spark, C.run_key("c0"), r) for r in ("run-2024-01-02.9", "run-2024-01-02.010", "run-2024-01-03.1")]
    assert keys == sorted(keys)


def test_prices_charges_and_marks(spark):
    assert one(spark, C.monthly_cost("c0", "c1", "c2", "c3"), 1 << 30, 0.023, 0.0, 0.0) == 0.023
    assert one(spark, C.monthly_cost("c0", "c1", "c2", "c3"), 1 << 30, 0.0, 0.09, 0.0) == 0.0  # any rate makes a medium priced
    assert one(spark, C.read_cost("c0", "c1", "c2", "c3", "c4"), 1 << 30, 2000, 0.0, 0.09, 0.0004) == 0.0908
    assert one(spark, C.read_cost("c0", "c1", "c2", "c3", "c4"), 5, 1, 0.0, 0.0, 0.0) is None and one(spark, C.read_cost("c0", "c1", "c2", "c3", "c4"), 5, 1, 0.5, 0.0, 0.0) == 0.0
    assert one(spark, C.file_cost("c0", "c1"), "archive", 100) == 32868 and one(spark, C.file_cost("c0", "c1"), "label", 99999) == 65536
    assert one(spark, C.pool_bytes("c0", "c1"), 3, 100_000) == 3 * (100_000 - 65536) and one(spark, C.usable_volume("c0"), 10) == 0
    assert [one(spark, C.weight_bucket("c0", "c1"), v, 100) for v in (0, 1, 26, 34, 67, 90, 100)] == [0, 1, 1, 2, 3, 3, 4]
    assert one(spark, C.comp_pct("c0", "c1"), 100, 25) == 25.0 and one(spark, C.comp_pct("c0", "c1"), 100, 100) is None


KEYS = "run string, dle string, level int"


def test_merge_remove_and_force(spark):
    base = spark.createDataFrame([("r1", "disk", "a", 0, 1), ("r1", "disk", "b", 0, 1)], "run string, medium string, dle string, level int, parts int")
    newer = spark.createDataFrame([("r1", "disk", "a", 0, 7), ("r1", "tape", "a", 0, 2)], base.schema)
    merged = placement.merge_catalogs(base, newer)
    assert {(r.medium, r.dle): r.parts for r in merged.collect()} == {("disk", "a"): 7, ("disk", "b"): 1, ("tape", "a"): 2}
    arch = spark.createDataFrame([("r1", "a", 0), ("r1", "b", 0), ("r0", "c", 0)], KEYS)
    left, archives = placement.remove_copies(merged, arch, spark.createDataFrame([("r1", "a", 0, "disk"), ("r1", "b", 0, "disk")], KEYS + ", medium string"))
    assert [(r.medium, r.dle) for r in left.collect()] == [("tape", "a")]
    assert sorted(r.dle for r in archives.collect()) == ["a", "c"]  # b's last copy is gone
    flags = spark.createDataFrame([("a", "run-2024-01-02.1"), ("b", "run-2024-01-02.1")], "dle string, set_at string")
    runs = spark.createDataFrame([("run-2024-01-03.1", "a", 0), ("run-2024-01-01.1", "b", 0)], KEYS)
    assert [r.dle for r in placement.force_full_after(flags, runs).collect()] == ["b"]


def test_epochs_barcodes_and_refresh(spark):
    parts = spark.createDataFrame([("r1", "a", 0, "tape", "T1", 1), ("r1", "a", 0, "tape", "T2", 1), ("r2", "a", 1, "tape", "T2", 2)], KEYS + ", medium string, label string, epoch int")
    volume = spark.createDataFrame([("T1", 1), ("T2", 2)], "label string, epoch int")
    assert [r.run for r in placement.drop_stale_epoch(parts, volume).collect()] == ["r2"]
    seen = spark.createDataFrame([("B1", "T1", 1), ("B1", "T2", 2), ("B2", "T3", 1)], "barcode string, label string, seen int")
    assert {r.barcode: r.label for r in placement.barcode_map(seen).collect()} == {"B1": "T2", "B2": "T3"}
    shape = "dle string, origin string"
    planned = spark.createDataFrame([("a", "x")], shape)
    previous = spark.createDataFrame([("b", "y"), ("c", "y"), ("d", "z"), ("a", "x"), ("a2", "x")], shape)
    lost = lambda rows: spark.createDataFrame(rows, shape + ", source string")
    got = lambda rows: {r.dle: r.via for r in placement.refresh_resolved(planned, lost(rows), previous).collect()}
    assert got([("b", "y", "s"), ("n", "y", "s")]) == {"a": "planned", "b": "failed", "n": "failed"}  # units, known or not; their origin carries nothing
    assert got([(None, "y", None), ("c", "y", "s")]) == {"a": "planned", "b": "carried", "c": "failed"}
    assert got([(None, "x", "")]) == {"a": "planned", "a2": "carried"}
    assert placement.intended_dles(planned, previous).count() == 5


def test_slug_collisions(spark):
    slugs = spark.createDataFrame([("s", "x"), ("s", "y"), ("t", "x")], "slug string, origin string")
    assert [(r.slug, r.origins) for r in placement.slug_collisions(slugs).collect()] == [("s", "x,y")]


def test_orphans(spark):
    head = spark.createDataFrame([("m", "", 1, "archive", False, dt.datetime(2024, 1, 1)), ("m", "", 2, "archive", False, dt.datetime(2024, 2, 28)), ("m", "", 3, "archive", True, dt.datetime(2024, 2, 28)), ("m", "", 4, "label", False, None), ("m", "", 5, "archive", False, dt.datetime(2024, 1, 1))], "medium string, label string, pos int, kind string, torn boolean, modified timestamp_ntz")
    known = head.filter("pos = 5")
    got = placement.orphan_files(head, known, 30, F.lit("2024-03-01").cast("timestamp_ntz"))
    assert sorted(r.pos for r in got.collect()) == [1, 3]


def test_extents_and_frames(spark):
    rows = [("a", 0, i, f"p{i}", i * 10) for i in range(6)] + [("b", 0, 0, "p0", -1)]
    member = spark.createDataFrame(rows, "dle string, level int, seq int, path string, off bigint")
    chosen = member.filter("path in ('p0', 'p1', 'p3', 'p5')").select("dle", "level", "path")
    ranges = reads.extents(member, chosen)
    assert sorted((r.start, r.end) for r in ranges.collect()) == [(0, 20), (30, 40), (50, reads.OPEN)]
    frame = spark.createDataFrame([("a", 0, 0, 0, 0), ("a", 0, 1, 25, 8), ("a", 0, 2, 45, 15)], "dle string, level int, seq int, raw bigint, enc bigint")
    totals = spark.createDataFrame([("a", 0, 60, 20), ("b", 0, 9, 9)], "dle string, level int, raw_total bigint, enc_total bigint")
    groups = reads.fetch_groups(ranges, frame, totals)
    assert sorted((r.enc_start, r.enc_end) for r in groups.collect()) == [(0, 20)]
    first = reads.fetch_groups(ranges.filter("start = 0"), frame, totals)
    rates = spark.createDataFrame([("cloud", 1.0, 1.0)], "medium string, gib_egress double, per_1000 double")
    assert sorted((r.enc_start, r.enc_end) for r in first.collect()) == [(0, 8)]
    # Sources that each lack one thing; p9 is nowhere, d/ is a directory.
    index = spark.createDataFrame([(d, 0, i, p, -1 if d == "offset" and i else i * 10) for d in ("ok", "offset", "frames", "copy", "past", "dir") for i, p in enumerate(("p0", "p1", "d/"))], member.schema)
    wanted = spark.createDataFrame([(d, 0, p) for d in ("ok", "offset", "frames", "copy", "index") for p in ("p0", "p1", "d/")] + [("past", 0, "p9"), ("dir", 0, "d/")], chosen.schema)
    table = spark.createDataFrame([(d, 0, i, i * 10, i * 4) for d in ("ok", "offset", "copy", "past", "index", "dir") for i in range(3)], frame.schema)
    sizes = spark.createDataFrame([(d, 0, 30, 12, 3) for d in ("ok", "offset", "frames", "copy", "past", "index", "dir")], totals.schema.simpleString()[7:-1].replace(":", " ") + ", parts int")
    plan = reads.selection_plan(wanted, index, table, sizes, rates, "cloud", ranged=sizes.filter("dle <> 'copy'")).collect()
    assert {r.dle: (r.mode, r.reason, r.files, r.fetches, r.bytes, r.whole) for r in plan} == {
        "ok": ("ranged", "", 2, 1, 12, 12), "offset": ("whole", "no offset", 2, 3, 12, 12), "frames": ("whole", "no frames", 2, 3, 12, 12),
        "copy": ("whole", "no ranged copy", 2, 3, 12, 12), "index": ("whole", "no index", 2, 3, 12, 12), "past": ("whole", "no offset", 1, 3, 12, 12),
    }


def test_parts_cover_ranges(spark):
    parts = spark.createDataFrame([("x", 0, 10), ("x", 1, 5), ("x", 2, 10), ("y", 0, None)], "id string, part_no int, size bigint")
    ranges = spark.createDataFrame([("x", 8, 16), ("y", 0, 1)], "id string, start bigint, end bigint")
    got = sorted((r.part_no, r["from"], r["to"]) for r in reads.part_segments(ranges, parts, ["id"]).collect())
    assert got == [(0, 8, 10), (1, 0, 5), (2, 0, 1)]


def test_read_catalog_and_store(spark, tmp_path):
    pos = {"label": "T1", "epoch": 1, "pos": 4}
    doc = {
        "entries": [{"run": {"id": "run-2024-01-01.1", "archives": [{"run": "run-2024-01-01.1", "dle": "a", "level": 0, "compressed": 5, "created_at": "0001-01-01T00:00:00Z", "base_run": ""}]}, "placements": [{"medium": "tape", "archives": [{"dle": "a", "level": 0, "parts": [pos, pos], "seals": [{"size": 3, "sha256": "x", "raw_size": 4}], "commit": pos, "index": pos}]}]}],
        "volumes": {"T1": {"label": {"name": "T1", "pool": "main", "epoch": 1, "written_at": "2024-01-01T00:00:00Z"}, "barcode": "B", "used": 9}},
        "dles": {"a": {"force_full": True}, "b": {"force_full": False}},
        "resolved": {"run": "run-2024-01-01.1", "dles": [{"dle": "a", "origin": "o"}]},
    }
    (tmp_path / "catalog.json").write_text(json.dumps(doc, indent=1))
    t = readers.read_catalog(spark, str(tmp_path / "catalog.json"))
    row = t["archive"].first()
    assert row.created_at is None and row.base_run is None and row.parts == 1
    assert [(r.part_no, r.label, r.size) for r in t["part"].orderBy("part_no").collect()] == [(0, "T1", None), (1, "T1", None)]  # one seal for two parts counts for none
    assert t["volume"].first().pool == "main" and [r.dle for r in t["force_full"].collect()] == ["a"] and t["resolved_dle"].first().origin == "o" and t["placement"].first().parts == 2
    store = tmp_path / "store" / "runs" / "run-1"
    store.mkdir(parents=True)
    (store / "000001-a-L0.tar").write_bytes(b"abc")
    (store / "000001-a-L0.tar.hdr").write_text(json.dumps({"run": "run-1", "kind": "archive", "dle": "a", "level": 0, "part": 0}))
    (store / "000002-a-L0.tar").write_bytes(b"abcd")
    scanned = readers.scan_store(spark, str(tmp_path / "store"))
    assert {r.pos: (r.bytes, r.kind) for r in scanned.collect()} == {1: (3, "archive"), 2: (4, None)}
    assert [r.pos for r in placement.torn_files(scanned).collect()] == [2]


def test_assemble_fills_gaps_and_finds_orphans(spark):
    at = "label string, epoch int, pos bigint"
    parts = spark.createDataFrame([("r1", "a", 0, 0, "T1", 1, 1, "main"), ("r2", "a", 1, 0, "T1", 1, 5, "main"), ("r3", "b", 0, 0, "T9", 1, 2, "other"), ("r4", "b", 0, 0, "T1", 1, 9, "main")], KEYS + ", part int, " + at + ", pool string")
    commits = spark.createDataFrame([("r1", "a", 0, 2, [None, ("T2", 1, 7)]), ("r2", "a", 1, 2, None)], KEYS + ", parts int, part_map array<struct<label: string, epoch: int, pos: bigint>>")
    placed, orphans = readers.assemble(parts, commits, "tape", "main")
    assert [(r.run, [p.pos for p in r.positions]) for r in placed.collect()] == [("r1", [1, 7])]
    assert [(r.run, r.labels) for r in orphans.collect()] == [("r4", ["T1"])]
    report = readers.rebuild_report(placed, orphans, spark.createDataFrame([("r0",)], "run string")).first()
    assert (report.runs, report.unresolved) == (1, 1)


def test_torn_lines(spark, tmp_path):
    good = json.dumps({"command": "dump", "outcome": "success", "run_id": "r", "ended_at": "2024-01-01T00:00:00Z", "dump_stats": [{"dle": "a", "level": 0, "orig": 5}]})
    (tmp_path / "log").write_text(f"{good}\n{good}\n{good[:20]}")
    log = readers.read_run_log(spark, str(tmp_path / "log"))
    assert log.count() == 2
    assert readers.run_log_tables(log)["dump_stat"].count() == 2
    last = max((r.file, r.block, r.line) for r in log.collect())
    assert [(r.file, r.block, r.line) for r in sinks.compact_run_log(log, 1).collect()] == [last]
    (tmp_path / "bad").write_text(f"{good}\n{good[:20]}\n{good}\n")
    with pytest.raises(Exception, match="torn line"):
        readers.read_run_log(spark, str(tmp_path / "bad")).collect()
    assert readers.read_run_log(spark, str(tmp_path / "bad"), strict=False).count() == 2
    assert readers.read_usage(spark, str(tmp_path / "nothing")).count() == 0
    assert readers.read_drill_ledger(spark, str(tmp_path / "nothing")).count() == 0
    (tmp_path / "drill").write_text(json.dumps({"records": {"a": {"dle": "a", "last_drill": "2024-01-01T00:00:00Z", "ok": True, "drills": 3}}}))
    assert readers.read_drill_ledger(spark, str(tmp_path / "drill")).first().drills == 3


def test_member_index(spark, tmp_path):
    path = tmp_path / "run-2024-01-01.1-host-data-L2.idx.gz"
    path.write_bytes(gzip.compress(json.dumps({"members": [{"p": "b", "o": 0}, {"p": "a", "o": 9}], "frames": [[0, 0], [10, 5]], "units": [{"path": "u", "size": 3, "members": ["a"]}]}).encode()))
    t = readers.read_member_index(spark, str(path))
    assert [(r.run, r.dle, r.level, r.seq, r.path, r.off) for r in t["member"].orderBy("seq").collect()] == [("run-2024-01-01.1", "host-data", 2, 0, "b", 0), ("run-2024-01-01.1", "host-data", 2, 1, "a", 9)]
    assert [(r.raw, r.enc) for r in t["frame"].orderBy("seq").collect()] == [(0, 0), (10, 5)] and t["unit"].first().members == ["a"]


def test_run_log_sinks(spark, tmp_path):
    log = spark.createDataFrame([("a", dt.datetime(2024, 1, 1)), ("b", dt.datetime(2024, 1, 2))], "run_id string, ended_at timestamp")
    sinks.append_run_log(log, str(tmp_path / "out"), str(tmp_path / "latest"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2 and spark.read.json(str(tmp_path / "latest")).first().run_id == "b"
    media = readers.dims(spark, [("disk", "disk", 1, 1, False)], [("a", "disk", 0)], [("", "tape", 0)])
    assert media["route"].first().medium == "disk"
    rates = {r.medium: (r.gib_month, r.per_1000) for r in readers.cost_rate(spark, [("c", "aws-s3"), ("d", "local"), ("e", "new")], [("d", 1.0, None, None)]).collect()}
    assert rates == {"c": (0.023, 0.0004), "d": (1.0, 0.0), "e": (0.0, 0.0)}


def stat(spark, rows):
    return spark.createDataFrame([(f"run-2024-{1 + d // 28:02d}-{1 + d % 28:02d}.1", dt.datetime(2024, 1, 1) + dt.timedelta(days=d), dle, level, orig, out, 1, seconds) for dle, d, level, orig, out, seconds in rows], "run_id string, ended_at timestamp_ntz, dle string, level int, orig bigint, out bigint, files bigint, seconds bigint")


def test_medians_and_anomalies(spark):
    gib = 1 << 30
    rows = [("up", d, 0, gib, gib, 10) for d in range(4)] + [("up", 9, 0, 5 * gib, gib, 10)]
    rows += [("down", d, 0, 4 * gib, gib, 10) for d in range(4)] + [("down", 9, 0, gib, gib, 10)]
    rows += [("incr", d, 1, 4 * gib, gib, 10) for d in range(4)] + [("incr", 9, 1, gib, gib, 10)]
    rows += [("few", 0, 0, 1, 1, 1), ("few", 9, 0, 9 * gib, gib, 1)]
    rows += [("stored", d, 0, gib, gib, 10) for d in range(4)] + [("stored", 9, 0, gib, 9 * gib, 10)]  # stored sizes are not looked at
    rows += [("old", d, 0, gib, gib, 10) for d in range(4)] + [("old", 8, 0, 9 * gib, gib, 10)]  # not in the newest run
    rows += [("wide", d, 0, (1 + 3 * (d % 2)) * gib, gib, 10) for d in range(4)] + [("wide", 9, 0, 6 * gib, gib, 10)]  # swings as widely before
    rows += [("small", d, 0, 1000, 1, 10) for d in range(4)] + [("small", 9, 0, 9000, 1, 10)] + [("zero", d, 0, 0, 0, 10) for d in range(4)] + [("zero", 9, 0, gib, gib, 10)]
    df = stat(spark, rows)
    assert {r.dle: r.kind for r in trends.size_anomalies(df).collect()} == {"up": "grown", "down": "shrunk"}  # incrementals do not shrink
    assert one(spark, trends.upper_median(F.array(*map(F.lit, (4, 1, 3, 2)))), 0) == 3 and one(spark, trends.mean_median(F.array(*map(F.lit, (4, 1, 3, 2)))), 0) == 2
    slow = [("s", d, 0, 1000000, 1, 100) for d in range(3)] + [("s", 5, 0, 1000000, 1, 1000)] + [("quick", d, 0, 1000, 1, 2) for d in range(3)] + [("quick", 5, 0, 1000, 1, 5)]
    slow += [("gone", d, 0, 1000000, 1, 100) for d in range(3)] + [("gone", 4, 0, 1000000, 1, 1000)] + [("none", d, 0, 0, 1, 100) for d in range(3)] + [("none", 5, 0, 1000, 1, 1000)]
    assert [(r.dle, r.rate, r.median) for r in trends.slow_dumps(stat(spark, slow)).collect()] == [("s", 1000, 10000)]


def test_spikes_curves_and_trends(spark):
    mib = 1 << 20
    rows = [("two", 1, 1, 1, 100 * mib, 1), ("two", 2, 1, 1, 400 * mib, 1), ("even", 1, 1, 1, 100 * mib, 1), ("even", 2, 1, 1, 102 * mib, 1), ("even", 3, 1, 1, 104 * mib, 1), ("even", 4, 1, 1, 600 * mib, 1)]
    got = {r.dle: (r.out, r.median, r.mad) for r in trends.incr_spikes(stat(spark, rows)).collect()}
    assert got == {"even": (600 * mib, 104 * mib, 3 * mib)}  # deviations 4, 2, 0 and 496: the mean of 2 and 4
    groups = spark.createDataFrame([("a", "g"), ("b", "g")], "dle string, group string")
    curve = stat(spark, [("a", 0, 0, 99, 10, 1), ("b", 5, 0, 99, 7, 1), ("a", 200, 0, 99, 12, 1), ("b", 200, 0, 99, 9, 1), ("a", 210, 0, 99, 11, 1), ("a", 205, 1, 99, 50, 1)])
    assert [r.total for r in trends.group_curve(curve, groups).orderBy("at").collect()] == [21, 20]  # stored sizes; earlier fulls are carried, not shown
    same = stat(spark, [("a", 0, 0, 1, 10, 1), ("b", 0, 0, 1, 10, 1)]).unionByName(stat(spark, [("a", 0, 0, 1, 15, 1)]).withColumn("run_id", F.lit("run-2024-01-01.2")))
    assert [(r.dle, r.percent, r.warns) for r in trends.trend_delta(same).collect()] == [("a", 50.0, True)] and trends.evolution(same).collect() == []
    depth = spark.createDataFrame([(1, 100), (2, 200), (4, 300)], "chains int, bytes bigint")
    media = spark.createDataFrame([("none", 50), ("mid", 250), ("big", 999), ("open", 0)], "medium string, capacity bigint")
    assert {r.medium: r.cycles for r in trends.capacity_depth(depth, media).collect()} == {"none": 0.0, "mid": 3.0, "big": 4.0}


def test_drill_classes_and_selection(spark):
    ledger = spark.createDataFrame([(c,) for c in ("ok", "integrity", "pipeline", "chain", "missing", "skipped", "odd", "")], "class string")
    got = {r["class"]: (r.is_failure, bool(r.remedy)) for r in attention.classified(ledger, attention.drill_classes(spark)).collect()}
    assert {c for c, (bad, _) in got.items() if bad} == {"integrity", "pipeline", "chain", "missing"} and not got["odd"][1] and got["skipped"][1]
    configured = spark.createDataFrame([(x,) for x in "abcd"], "dle string")
    drills = spark.createDataFrame([("c", dt.datetime(2024, 2, 28), True), ("d", dt.datetime(2024, 1, 1), True)], "dle string, last_drill timestamp_ntz, ok boolean")
    links = spark.createDataFrame([("a", 2, "run-2024-01-02.1"), ("b", 2, "run-2024-01-02.0"), ("c", 1, "run-2024-01-01.1"), ("d", 9, "run-2024-01-01.1")], "dle string, links int, full_at string")
    assert [r.dle for r in summaries.drill_select(configured, drills, links, 7, F.lit("2024-03-01").cast("timestamp_ntz"), 9).collect()] == ["a", "b", "d"]  # fulls of one day tie
    chain = spark.createDataFrame([("a", "r1"), ("a", "r2"), ("b", "r1"), ("c", "r1")], "dle string, run string")
    parts = spark.createDataFrame([("r1", "a", "disk", 0, 5), ("r1", "a", "disk", 1, 6), ("r2", "a", "disk", 0, 7), ("r1", "a", "tape", 0, 5), ("r1", "b", "disk", 0, None), ("r1", "c", "tape", 0, 5)], "run string, dle string, medium string, part_no int, size bigint")
    counts = spark.createDataFrame([("a", 3)], "dle string, drills int")
    media = spark.createDataFrame([(x, "disk") for x in "abc"], "dle string, medium string")
    assert sorted((r.dle, r.run, r.part_no, r["size"]) for r in summaries.sample_plan(chain, parts, counts, media).collect()) == [("a", "r1", 1, 6), ("a", "r2", 0, 7)]


def test_frames_to_test(spark):
    frame = spark.createDataFrame([("a", 0, i, 100 * i, 10 * i) for i in range(5)] + [("b", 0, i, 10 * i, i) for i in range(3)], "dle string, level int, seq int, raw bigint, enc bigint")
    rows = [("a", 0, 0, "p0", 0), ("a", 0, 1, "p1", 20), ("a", 0, 2, "big", 150), ("a", 0, 3, "end", 480), ("b", 0, 0, "x", 5), ("b", 0, 1, "y", 25)]
    member = spark.createDataFrame(rows, "dle string, level int, seq int, path string, off bigint")
    pick = lambda n: {r.dle: (r.seq, r.path, r.span) for r in reads.frame_sample(member, frame, n).collect()}
    assert pick(0)["a"] == (0, "p0", 150) and pick(1)["a"] == (1, "big", 330) and pick(2)["a"] == (4, "end", 20) and pick(6)["a"] == (1, "big", 330)
    assert pick(0)["b"] == (0, "x", 20) and pick(1)["b"] == (2, "y", 5)  # no member begins in frame 1
    # A span over four frames is passed over; where all are, the least one is taken.
    far = spark.createDataFrame([("a", 0, 0, "p", 0), ("a", 0, 1, "q", 450), ("a", 0, 2, "r", 2000)], "dle string, level int, seq int, path string, off bigint")
    assert {r.seq for r in reads.frame_sample(far, frame.filter("dle = 'a'"), 0).collect()} == {4}
    only = spark.createDataFrame([("a", 0, 0, "p", 10)], "dle string, level int, seq int, path string, off bigint")
    assert [(r.seq, r.span) for r in reads.frame_sample(only, frame.filter("dle = 'a'"), 3).collect()] == [(0, 490)]
    # An archive with a member at an unknown offset has no sample; others have theirs.
    blind = member.unionByName(spark.createDataFrame([("b", 0, 2, "z", -1)], member.schema))
    assert [r.dle for r in reads.frame_sample(blind, frame, 0).collect()] == ["a"]


def test_units_by_name(spark):
    unit = spark.createDataFrame([("s", "table.users"), ("s", "table.users_old"), ("s", "table.users_old"), ("s", "users"), ("t", "table.log")], "dle string, path string")
    wanted = spark.createDataFrame([("s", "users"), ("s", "_old"), ("s", "table"), ("s", "none"), ("t", "log"), ("t", "log"), ("t", ""), ("u", "log")], "dle string, arg string")
    got = {(r.dle, r.arg): (r.path, r.matches) for r in chains.match_units(unit, wanted, strict=False).collect()}
    assert got == {("s", "users"): ("users", 1), ("s", "_old"): ("table.users_old", 1), ("s", "table"): (None, 2), ("s", "none"): (None, 0), ("t", "log"): ("table.log", 1), ("t", ""): ("table.log", 1), ("u", "log"): (None, 0)}
    for arg in ("table", "none"):
        with pytest.raises(Exception, match="units match " + arg):
            chains.match_units(unit, wanted.filter(wanted.arg == arg)).collect()


def test_members_of_archives_differ(spark):
    kind = "dle string, level int, path string, off bigint"
    recorded = spark.createDataFrame([("a", 0, "p", 1), ("a", 0, "p", 5), ("a", 1, "p", 1), ("a", 1, "q", -1)], kind)
    listed = spark.createDataFrame([("a", 0, "p", 1), ("a", 1, "p", 2), ("a", 1, "q", 9), ("a", 1, "r", 3)], kind)
    got = sorted((r.level, r.path, r.nth, r.problem) for r in placement.members_diff(recorded, listed, ("dle", "level")).collect())
    assert got == [(0, "p", 2, "missing"), (1, "p", 1, "offset"), (1, "r", 1, "extra")]


def test_weights_of_nights(spark):
    daily = spark.createDataFrame([("d1", 90, 0), ("d2", 29, 0), ("d3", 30, 0), ("d4", 0, 60), ("d5", 0, 0)], "day string, full_bytes bigint, incr_bytes bigint")
    assert {r.day: r.weight for r in summaries.load_weights(daily).collect()} == {"d1": 4, "d2": 1, "d3": 2, "d4": 3, "d5": 0}
    assert summaries.load_weights(daily.filter("day = ''")).count() == 0


def test_usage_that_falls_to_zero(spark):
    totals = spark.createDataFrame([("disk", 5), ("tape", 7)], "medium string, bytes bigint")
    known = spark.createDataFrame([("disk", 5), ("tape", 6), ("cloud", 3), ("old", 0)], "medium string, used bigint")
    got = {r.medium: r.used for r in live.emptied(totals, known, F.lit("2024-01-01").cast("timestamp_ntz")).collect()}
    assert got == {"tape": 7, "cloud": 0}


def test_levels(spark):
    state = spark.createDataFrame([("never", -1, 0, 1, 0), ("due", 9, 1, 1, 3), ("fresh", 1, 0, 1, 0), ("climb", 2, 1, 2, 2), ("hold", 2, 1, 1, 1), ("forced", 1, 0, 1, 0)], "dle string, days_since_full int, last_level int, at_level int, incrs_since_full int")
    est = state.select("dle", F.lit(1000).alias("full_est"), F.lit(500).alias("same_est"), F.lit(100).alias("next_est"))
    got = {r.dle: (r.level, r.reason) for r in trends.next_level(state, est, spark.createDataFrame([("forced",)], "dle string")).collect()}
    assert got == {"never": (0, "first full"), "due": (0, "cycle due"), "fresh": (1, "after full"), "climb": (2, "bump"), "hold": (1, "hold"), "forced": (0, "forced")}
    kept = spark.createDataFrame([("climb", "run-1", 1), ("climb", "run-2", 1), ("climb", "run-3", 0), ("due", "run-1", 0), ("hold", "run-1", 1)], "dle string, run string, level int")
    based = trends.with_base(trends.next_level(state, est, state.limit(0).select("dle")), kept)
    assert {r.dle: (r.level, r.base_level, r.base_run) for r in based.collect()} == {"never": (0, -1, None), "due": (0, -1, None), "fresh": (1, 0, None), "climb": (2, 1, "run-2"), "hold": (1, 0, None), "forced": (1, 0, None)}
    assert trends.cycle_fits(est, 5999).first().fits is False and trends.cycle_fits(est, 0).first().fits is True


def test_lanes_rates_and_eta(spark):
    t = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    lanes = spark.createDataFrame([("x", t(0), t(10), 100), ("x", t(5), t(15), 50), ("x", t(20), t(30), 50)], "lane string, begin_at timestamp_ntz, end_at timestamp_ntz, bytes bigint")
    r = live.lane_busy(lanes, "lane").first()
    assert (r.busy, r.wall, r.rate, r.utilisation) == (25, 30, 8.0, 0.833333)
    samples = spark.createDataFrame([("a", t(0), 0), ("a", t(29), 29), ("a", t(60), 600), ("b", t(0), 5), ("c", t(50), 9), ("c", t(58), 1)], "k string, ts timestamp_ntz, used bigint")
    got = {r.k: r.rate for r in live.rate_now(samples, spark.createDataFrame([(t(61),)], "now timestamp_ntz"), "k").collect()}
    assert got["a"] == round(571 / 31, 6) and got["b"] == 0.0 and got["c"] == 0.0
    snap = spark.createDataFrame([("r", 100, 10.0, 50, 1.0), ("s", 100, 0.0, 0, 0.0), ("t", 0, 0.0, 0, 0.0)], "run string, to_dump bigint, dump_rate double, to_drain bigint, drain_rate double")
    assert {r.run: r.seconds for r in live.eta(snap).collect()} == {"r": 50.0, "s": None, "t": 0.0}


def test_progress_stream_matches_the_batch(spark, tmp_path):
    rows = [("r", "a", 1, 10, 100, "dumping"), ("r", "a", 2, 100, 100, "done"), ("r", "b", 1, 5, 50, "waiting"), ("r", "c", 3, 7, 10, "holding")]
    events = spark.createDataFrame(rows, "run string, dle string, seq bigint, done bigint, total bigint, state string")
    events.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = live.write_progress(stream, str(tmp_path / "totals"), str(tmp_path / "ck"))
    q.processAllAvailable()
    q.stop()
    got = spark.read.parquet(str(tmp_path / "totals")).first()
    latest = live.latest_progress(events)
    assert tuple(got) == tuple(live.progress_totals(latest).first()) == ("r", 3, 1, 112, 160, 70)
    assert tuple(live.stage_split(latest).first()) == ("r", 100, 7, 0, 45)


def test_alerts_health_and_attention(spark):
    log = spark.createDataFrame([("1", "dump", "success", []), ("2", "sync", "success", []), ("3", "sync", "failure", [])], "run_id string, command string, outcome string, warnings array<string>")
    channels = spark.createDataFrame([("mail", "mail", []), ("ops", "mail", ["sync"]), ("beat", "healthcheck", [])], "channel string, kind string, commands array<string>")
    got = {(r.run_id, r.channel) for r in attention.route_alerts(log, channels).collect()}
    assert got == {("1", "mail"), ("1", "beat"), ("2", "ops"), ("2", "beat"), ("3", "mail"), ("3", "ops"), ("3", "beat")}
    health = spark.createDataFrame([(True, False, True, False), (True, True, True, False), (False, False, False, True)], "drilled boolean, ok boolean, was_ok boolean, overdue boolean")
    assert tuple(summaries.recovery_health(health).first()) == (1, 1, 1, 1)
    rows = attention.attention(("amber", "stale", spark.createDataFrame([("x",)], "subject string")), ("red", "lost", spark.createDataFrame([("y",)], "subject string")))
    assert [r.topic for r in rows.collect()] == ["lost", "stale"]
    landing = spark.createDataFrame([("d", 100, 5.0, 10.0), ("d", 100, 5.0, 10.0)], "landing string, bytes bigint, busy_seconds double, wall_seconds double")
    r = summaries.landing_stats(landing).first()
    assert (r.bytes, r.rate, r.utilisation) == (200, 20.0, 0.5)


def test_volumes_to_load(spark):
    volume = spark.createDataFrame([("T1", "run-1", 5), ("T2", "run-2", 7)], "label string, last_run string, used bigint")
    assert tuple(summaries.expected_volume(volume, volume, True).first()) == ("T2", 7, False) and tuple(summaries.expected_volume(volume, volume, False).first()) == ("T1", 0, False)
    assert tuple(summaries.expected_volume(volume, volume.filter("false"), False).first()) == (None, 0, True)
