"""Scalar functions over backup metadata, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RUN = r"^run-(\d{4}-\d{2}-\d{2})\.(\d+)$"

#: Multipliers of decimal and binary size units.
UNITS = {
    "": 1, "b": 1,
    "k": 1000, "kb": 1000, "kib": 1024,
    "m": 1000**2, "mb": 1000**2, "mib": 1024**2,
    "g": 1000**3, "gb": 1000**3, "gib": 1024**3,
    "t": 1000**4, "tb": 1000**4, "tib": 1024**4,
    "p": 1000**5, "pb": 1000**5, "pib": 1024**5,
}

#: Seconds of duration units.
SECONDS = {"w": 604800.0, "d": 86400.0, "h": 3600.0, "m": 60.0, "s": 1.0, "ms": 1e-3, "us": 1e-6, "ns": 1e-9}

VOLUME_BLOCK = 32 * 1024


def _c(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def epoch(ts: Column | str) -> Column:
    """Whole seconds since 1970-01-01 of a timestamp as written, whatever the session's time zone."""
    t = _c(ts)
    return (F.datediff(F.to_date(t), F.lit("1970-01-01").cast("date")).cast("long") * 86400 + F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)).cast("long")


def instant_key(at: Column | str) -> Column:
    """An instant as text whose order is that of time."""
    return F.date_format(_c(at), "yyyy-MM-dd HH:mm:ss.SSSSSS")


def instant(now: str) -> Column:
    return F.lit(now).cast("timestamp_ntz")


def run_id(ts: Column | str) -> Column:
    return F.concat(F.lit("run-"), F.date_format(_c(ts), "yyyy-MM-dd.HHmmss"))


def run_date(run: Column | str) -> Column:
    """The run's date as text, '' for an id that does not parse."""
    return F.regexp_extract(F.coalesce(_c(run), F.lit("")), RUN, 1)


def run_key(run: Column | str) -> Column:
    """A text that sorts as runs do: by date, then by the number behind it; other ids sort as they are."""
    r = _c(run)
    return F.when(r.rlike(RUN), F.concat(F.lit("run-"), run_date(r), F.lit("."), F.lpad(F.regexp_extract(r, RUN, 2), 18, "0"))).otherwise(r)


def run_valid(run: Column | str) -> Column:
    return F.coalesce(_c(run).rlike(RUN), F.lit(False))


def dle_slug(host: Column | str, path: Column | str) -> Column:
    """Key of a source: host and path with separators as dashes; an empty path is `root`."""
    inner = F.translate(F.regexp_replace(_c(path), r"^/+|/+$", ""), "/", "-")
    named = F.when(inner == "", F.lit("root")).otherwise(inner)
    return F.regexp_replace(F.concat(_c(host), F.lit("-"), named), r"[^a-zA-Z0-9._-]+", "_")


def dle_display(host: Column | str, path: Column | str, slug: Column | str) -> Column:
    h, p = F.coalesce(_c(host), F.lit("")), F.coalesce(_c(path), F.lit(""))
    return F.when((h == "") & (p == ""), _c(slug)).otherwise(F.concat(h, F.lit(":"), p))


def split_display(display: Column | str) -> Column:
    """(host, path) of a display id, cut at the first colon; without one all is path."""
    d = _c(display)
    at = F.instr(d, ":")
    return F.struct(F.when(at > 0, F.substring_index(d, ":", 1)).otherwise("").alias("host"), F.when(at > 0, F.substring(d, at + 1, F.length(d))).otherwise(d).alias("path"))


def parse_bytes(text: Column | str, strict: bool = False) -> Column:
    """Bytes of a size such as `1.5 GiB`, `20k` or `.5GB`; null (strict: an error) where it does not parse or is negative."""
    t = F.trim(F.lower(_c(text)))
    shape = r"^\+?([0-9]+\.?[0-9]*|\.[0-9]+)\s*([kmgtp]?i?b?)$"
    unit, factor = F.regexp_extract(t, shape, 2), F.lit(None).cast("double")
    for name, size in UNITS.items():
        factor = F.when(unit == name, F.lit(float(size))).otherwise(factor)
    value = F.when(t.rlike(shape), F.floor(F.regexp_extract(t, shape, 1).try_cast("double") * factor).cast("long"))
    return F.when(value.isNull() & _c(text).isNotNull(), F.raise_error(F.concat(F.lit("not a size: "), t)).cast("long")).otherwise(value) if strict else value


def parse_rate(text: Column | str, strict: bool = False) -> Column:
    """Bytes a second of a rate such as `50MB/s` or `50 MB`: a size with an optional `/s`."""
    return parse_bytes(F.regexp_replace(F.trim(_c(text)), r"\s*/[sS]$", ""), strict)


def parse_duration(text: Column | str) -> Column:
    """Seconds of a duration such as `30d`, `2w` or `1h30m`; null where it does not parse."""
    t = F.trim(_c(text))
    one = r"([0-9]+(?:\.[0-9]+)?)(ms|us|ns|[wdhms])"
    numbers, units = F.regexp_extract_all(t, F.lit(one), 1), F.regexp_extract_all(t, F.lit(one), 2)

    def seconds(n: Column, u: Column) -> Column:
        size = F.lit(None).cast("double")
        for name, s in SECONDS.items():
            size = F.when(u == name, F.lit(s)).otherwise(size)
        return n.try_cast("double") * size

    return F.when(t.rlike(f"^({one})+$"), F.aggregate(F.zip_with(numbers, units, seconds), F.lit(0.0), lambda a, x: a + x))


def clean_member(path: Column | str) -> Column:
    """(path, is_dir) of an archive member: one leading `./` and outer slashes taken off; a null path for the root."""
    p = _c(path)
    clean = F.regexp_replace(F.regexp_replace(p, r"^\./", ""), r"^/+|/+$", "")
    return F.struct(F.when(clean != "", clean).alias("path"), p.endswith("/").alias("is_dir"))


def ancestors(path: Column | str) -> Column:
    """Directories above a path, outermost first."""
    parts = F.split(_c(path), "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).otherwise(F.array().cast("array<string>"))


def parent(path: Column | str) -> Column:
    return F.regexp_replace(_c(path), r"/?[^/]*$", "")


def base_name(path: Column | str) -> Column:
    return F.substring_index(_c(path), "/", -1)


def logical_path(path: Column | str) -> Column:
    """Path of the file that a delta member stands for: the basename without its INCREMENTAL. mark."""
    return F.regexp_replace(_c(path), r"(^|/)INCREMENTAL\.([^/]*)$", "$1$2")


def relation_key(path: Column | str) -> Column:
    """Path of a table's first file: fork suffix and segment number taken off."""
    return F.regexp_replace(F.regexp_replace(logical_path(path), r"\.[0-9]+$", ""), r"_(fsm|vm|init)$", "")


def is_partial(unreadable: Column | str) -> Column:
    return F.coalesce(_c(unreadable) > 0, F.lit(False))


def run_status(outcome: Column | str, warnings: Column | str) -> Column:
    return F.when(_c(outcome) == "failure", "FAILED").when(F.coalesce(F.size(_c(warnings)), F.lit(0)) > 0, "WARNING").otherwise("OK")


def is_degrading(drilled: Column | str, ok: Column | str, was_ok: Column | str) -> Column:
    return _c(drilled) & ~_c(ok) & _c(was_ok)


def comp_pct(orig: Column | str, out: Column | str) -> Column:
    """Compressed size in percent of the original, null where there is no saving."""
    o, z = _c(orig), _c(out)
    return F.when((o > 0) & (z < o), F.round(z * F.lit(100.0) / o, 6))


def dump_rate(size: Column | str, seconds: Column | str) -> Column:
    s = _c(seconds)
    return F.when(s > 0, F.round(_c(size) / s, 6))


def priced(gib_month: Column | str, gib_egress: Column | str, per_1000: Column | str) -> Column:
    """Whether a medium has any rate."""
    return (_c(gib_month) > 0) | (_c(gib_egress) > 0) | (_c(per_1000) > 0)


def monthly_cost(size: Column | str, gib_month: Column | str, gib_egress: Column | str, per_1000: Column | str) -> Column:
    """Price of storing size bytes for a month, null for a medium without any rate."""
    return F.when(priced(gib_month, gib_egress, per_1000), F.round(_c(size) / F.lit(float(1 << 30)) * _c(gib_month), 6))


def read_cost(size: Column | str, objects: Column | str, gib_month: Column | str, gib_egress: Column | str, per_1000: Column | str) -> Column:
    """Price of reading size bytes in that many objects once, null for a medium without any rate."""
    return F.when(priced(gib_month, gib_egress, per_1000), F.round(_c(size) / F.lit(float(1 << 30)) * _c(gib_egress) + _c(objects) / F.lit(1000.0) * _c(per_1000), 6))


def file_cost(kind: Column | str, payload: Column | str) -> Column:
    """Bytes a file takes on a volume: a header block, and its payload; labels and commits fit in one block more."""
    p = _c(payload)
    return F.lit(VOLUME_BLOCK) + F.when(_c(kind).isin("label", "commit"), F.least(p, F.lit(VOLUME_BLOCK))).otherwise(p)


def usable_volume(size: Column | str) -> Column:
    return F.greatest(_c(size) - 2 * VOLUME_BLOCK, F.lit(0))


def pool_bytes(volumes: Column | str, size: Column | str) -> Column:
    return _c(volumes) * usable_volume(size)


def weight_bucket(value: Column | str, most: Column | str) -> Column:
    """0 for none, else 1 more than the whole thirds of the largest value, at most 4."""
    v, m = _c(value), _c(most)
    return F.when((v <= 0) | (m <= 0), 0).otherwise(F.least(F.lit(4), F.lit(1) + F.floor(v.cast("double") * 3.0 / m.cast("double")).cast("int")))


def balance_verdict(cv: Column | str) -> Column:
    c = _c(cv)
    return F.when(c < 0.35, "Even").when(c < 0.6, "Uneven").otherwise("Lumpy")
