"""Random catalogs, and loops that answer for small ones what the operators answer with windows and joins."""

from __future__ import annotations

import datetime as dt
import random

NOW = dt.datetime(2024, 3, 1)
COLUMNS = "arch_key bigint, run string, dle string, host string, path string, level int, compressed bigint, uncompressed bigint, file_count bigint, unreadable int, base_run string, created_at timestamp_ntz"


def archive(dle: str, day: int, level: int, size: int = 10, base: str | None = None, at: dt.datetime | None = None, key: int = 0) -> tuple:
    when = NOW - dt.timedelta(days=day)
    return (key, f"run-{when:%Y-%m-%d}.000000", dle, "h", f"/d/{dle}", level, size, 2 * size, 1, 0, base, at or when)


def random_catalog(seed: int, sources: int = 3, days: int = 12) -> list[tuple]:
    rng = random.Random(seed)
    rows = []
    for s in range(sources):
        seen: list[str] = []
        for day in range(days, 0, -1):
            if rng.random() < 0.7:
                level = rng.choice([0, 1, 1, 2, 2, 3])
                base = rng.choice([*seen, "run-1990-01-01.000000"]) if level and seen and rng.random() < 0.2 else None
                rows.append(archive(f"c{s}", day, level, rng.randint(1, 50), base))
                seen.append(rows[-1][1])
    return rows


def slow_base(rows: list[tuple], row: tuple) -> str | None:
    _, run, dle, _, _, level, *_, base, _ = row
    earlier = [r for r in rows if r[2] == dle and r[1] < run]
    if level == 0:
        return None
    if base:
        return base if any(r[1] == base for r in earlier) else None
    return max((r[1] for r in earlier if r[5] == level - 1), default=None)


def slow_stranded(rows: list[tuple], row: tuple) -> bool:
    while row[5] > 0:
        base = slow_base(rows, row)
        if base is None:
            return True
        row = next(r for r in rows if r[2] == row[2] and r[1] == base)
    return False


def slow_floor(rows: list[tuple], catalog: list[tuple], min_age: int) -> dict[tuple[str, str], str | None]:
    """Pins of one medium: each rule in turn, chains walked one by one."""
    young = lambda r: min_age > 0 and r[-1] is not None and (NOW - r[-1]).total_seconds() < min_age * 86400
    lost = {(r[1], r[2]) for r in catalog if slow_stranded(catalog, r)}
    out: dict[tuple[str, str], str | None] = {(r[1], r[2]): None for r in rows}
    dead = {(r[1], r[2]) for r in rows if (r[1], r[2]) in lost and not young(r)}

    def keep(r: tuple, kind: str) -> None:
        if (r[1], r[2]) not in dead and out[r[1], r[2]] is None:
            out[r[1], r[2]] = kind

    for r in rows:
        if young(r):
            keep(r, "AGE")
    for r in rows:
        if r[5] == 0 and not any(x[2] == r[2] and x[5] == 0 and x[1] > r[1] for x in rows):
            keep(r, "LAST_FULL")
    fresh = {r[1] for r in rows if young(r)}
    for dle in {r[2] for r in rows}:
        line = sorted((r for r in rows if r[2] == dle), key=lambda r: r[1])
        for i, r in enumerate(line):
            if (r[1], dle) not in lost and (i == len(line) - 1 or r[1] in fresh):
                fulls = [j for j in range(i + 1) if line[j][5] == 0]
                for j in range(fulls[-1], i + 1) if fulls else ():
                    keep(line[j], "CHAIN")
    for key in dead:
        out[key] = "CONDEMNED"
    return out


def slow_reclaim(rows: list[tuple], pins: dict, capacity: int, target: int) -> list[tuple[str, str]]:
    """Deletes the oldest archive on which nothing depends, again and again."""
    left = sorted(rows, key=lambda r: (r[1], r[2]))
    total, out = sum(r[6] for r in left), []

    def pick(want) -> tuple | None:
        needed = {(slow_base(rows, r), r[2]) for r in left}
        return next((r for r in left if (r[1], r[2]) not in needed and want(pins[r[1], r[2]])), None)

    while r := pick(lambda k: k == "CONDEMNED"):
        left.remove(r)
        out.append((r[1], r[2]))
        total -= r[6]
    while capacity > 0 and total > max(target, 0) and (r := pick(lambda k: k in (None, "CONDEMNED"))):
        left.remove(r)
        out.append((r[1], r[2]))
        total -= r[6]
    return out
