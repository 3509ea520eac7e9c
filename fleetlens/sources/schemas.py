"""Explicit schemas of the backup metadata documents; nothing is inferred."""

from __future__ import annotations

ARCHIVE = (
    "run string, dle string, host string, path string, archiver string, archiver_name string, ext string, compress string, encrypt string, shape string, "
    "level int, compressed bigint, uncompressed bigint, file_count bigint, unreadable int, sha256 string, parts int, base_run string, created_at timestamp, "
    "part_seals array<struct<size: bigint, sha256: string, raw_size: bigint>>, part_map array<struct<label: string, epoch: int, pos: bigint>>, index_size bigint, index_pos bigint"
)
POS = "struct<label: string, epoch: int, pos: bigint>"
PLACED = f"struct<dle: string, level: int, parts: array<{POS}>, seals: array<struct<size: bigint, sha256: string, raw_size: bigint>>, commit: {POS}, index: {POS}>"
_NESTED_ARCHIVE = "struct<" + ", ".join(": ".join(f.split(" ", 1)) for f in ARCHIVE.split(", part_seals")[0].split(", ")) + ">"
CATALOG_ENTRY = f"run struct<id: string, archives: array<{_NESTED_ARCHIVE}>>, placements array<struct<medium: string, archives: array<{PLACED}>>>"
CATALOG_VOLUME = "label struct<name: string, pool: string, epoch: int, written_at: timestamp>, barcode string, used bigint"
CATALOG_DLE = "force_full boolean"
CATALOG_RESOLVED = "run string, dles array<struct<dle: string, origin: string, host: string, path: string>>"
RUN_LOG = (
    "command string, outcome string, exit_class string, error string, started_at timestamp, ended_at timestamp, warnings array<string>, run_id string, archives int, bytes_moved bigint, "
    "runs_copied int, archives_pruned int, failures int, tier string, "
    "drill_health array<struct<dle: string, display: string, ok: boolean, class: string, detail: string, was_ok: boolean, drilled: boolean, bytes: bigint>>, skipped int, overdue int, never_drilled array<string>, "
    "dump_stats array<struct<dle: string, host: string, path: string, level: int, orig: bigint, out: bigint, files: bigint, seconds: double, promoted: boolean, reason: string>>, "
    "landing_stats array<struct<landing: string, bytes: bigint, busy_seconds: double, wall_seconds: double>>"
)
USAGE = "at timestamp, medium string, used bigint, runs int"
DRILL_RECORD = "dle string, last_drill timestamp, tier string, medium string, as_of string, run_id string, ok boolean, class string, detail string, bytes bigint, drills int"
INDEX_UNIT = "path string, size bigint, members array<string>"
HEADER = "run string, kind string, dle string, host string, path string, archiver string, compress string, encrypt string, level int, base_run string, part int, split boolean, created_at timestamp, name string, pool string, epoch int"
