"""Which bytes of an archive a selection needs, and what reading them costs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["dle", "level"]
#: Bytes of one bucket of the range joins: ranges meet in the buckets they touch, not in a nested loop.
BUCKET = 1 << 20
#: Stands for the open end of an archive's last extent.
OPEN = (1 << 62) - 1


def _merged(rows: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Ranges of each key with overlapping and adjacent ones as one; n counts what each took in."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_new", (reach.isNull() | (F.col(start) > reach)).cast("int"))
    rows = rows.withColumn("_g", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "_g").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n")).drop("_g")


def extents(member: DataFrame, selection: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, start, end, n): byte ranges of the selected members of each archive, neighbours as one.

    A member ends where the next begins, the last one at the archive's end (OPEN). An
    archive with an unknown offset (below 0) gives no range: it is read whole.
    """
    k = keys or KEY
    line = Window.partitionBy(*k).orderBy("seq")
    whole = Window.partitionBy(*k)
    rows = member.withColumn("_known", F.min("off").over(whole) >= 0).withColumn("end", F.coalesce(F.lead("off").over(line), F.lit(OPEN)))
    chosen = rows.filter("_known").join(selection, [*k, "path"], "left_semi")
    return _merged(chosen.select(*k, F.col("off").alias("start"), "end"), k, "start", "end")


def atomic_frames(part_file: DataFrame, keys: list[str]) -> DataFrame:
    """Frames of an archive whose parts stand alone: raw and encoded starts from the sums of the parts before (raw_size, size)."""
    w = Window.partitionBy(*keys).orderBy("part_no").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    return part_file.select(*keys, F.col("part_no").alias("seq"), F.coalesce(F.sum("raw_size").over(w), zero).alias("raw"), F.coalesce(F.sum("size").over(w), zero).alias("enc"))


def _buckets(start, end, size: int):
    return F.sequence(F.floor(start / size), F.floor((F.greatest(end, start + 1) - 1) / size))


def fetch_groups(ranges: DataFrame, frame: DataFrame, totals: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, enc_start, enc_end, n): encoded ranges to fetch for raw ranges: the frames that cover each, merged where they touch.

    totals has the raw and encoded size of each archive (raw_total, enc_total), which close
    the last frame and open ranges. A frame is found by the number of the bucket it
    touches, so the join is by equality; a range is cut at the archive's end first.
    """
    k = keys or KEY
    line = Window.partitionBy(*k).orderBy("seq")
    f = frame.join(totals, k).withColumn("raw_end", F.coalesce(F.lead("raw").over(line), F.col("raw_total"))).withColumn("enc_end", F.coalesce(F.lead("enc").over(line), F.col("enc_total")))
    f = f.filter("raw_end > raw").select(*k, "raw", "raw_end", "enc", "enc_end", F.explode(_buckets(F.col("raw"), F.col("raw_end"), BUCKET)).alias("_b"))
    r = ranges.join(totals, k).withColumn("end", F.least("end", "raw_total")).filter("end > start")
    r = r.select(*k, "start", "end", F.explode(_buckets(F.col("start"), F.col("end"), BUCKET)).alias("_b"))
    hit = r.join(f, [*k, "_b"]).filter((F.col("raw") < F.col("end")) & (F.col("raw_end") > F.col("start")))
    hit = hit.select(*k, F.col("enc").alias("enc_start"), "enc_end").distinct()
    return _merged(hit, k, "enc_start", "enc_end")


#: Bytes of one bucket where parts of archives meet ranges.
PART_BUCKET = 1 << 28


def part_segments(ranges: DataFrame, part_file: DataFrame, keys: list[str], bucket: int = PART_BUCKET) -> DataFrame:
    """(keys, part_no, from, to): pieces of parts that hold byte ranges (start, end) of an archive; archives with an unsealed part (null size) give none.

    Ranges and parts meet by equality in the buckets they touch; a pair is taken in the
    first bucket they share.
    """
    order = Window.partitionBy(*keys).orderBy("part_no")
    sealed = F.min(F.col("size").isNotNull()).over(Window.partitionBy(*keys))
    p = part_file.withColumn("_ok", sealed).filter("_ok").withColumn("_end", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    p = p.select(*keys, "part_no", (F.col("_end") - F.col("size")).alias("_start"), "_end").withColumn("_b", F.explode(_buckets(F.col("_start"), F.col("_end"), bucket)))
    total = part_file.groupBy(*keys).agg(F.sum("size").alias("_total"))
    r = ranges.join(total, keys).withColumn("_b", F.explode(_buckets(F.col("start"), F.greatest("start", F.least("end", "_total")), bucket))).drop("_total")
    hit = r.join(p, [*keys, "_b"]).filter((F.col("_start") < F.col("end")) & (F.col("_end") > F.col("start")) & (F.floor(F.greatest("start", "_start") / bucket) == F.col("_b")))
    return hit.select(*keys, "start", "end", "part_no", (F.greatest("start", "_start") - F.col("_start")).alias("from"), (F.least("end", "_end") - F.col("_start")).alias("to"))


def selection_plan(selection: DataFrame, member: DataFrame, frame: DataFrame, totals: DataFrame, cost_rate: DataFrame, medium: str, keys: list[str] | None = None, ranged: DataFrame | None = None) -> DataFrame:
    """(keys, files, mode, reason, fetches, bytes, whole, price): how each archive of a selection is read, and why.

    An archive is read by ranges where it can be, else whole. reason is '' or the first of
    what it lacks: a member index ('no index'), the offset of a member ('no offset'), a
    table of frames ('no frames'), frames under the selection ('no groups'), a copy on a
    medium that serves ranges ('no ranged copy': not in ranged, keys that have one; all
    have where it is None). totals may have parts, what a whole read fetches (else 1).
    Directories alone need no read: such archives are left out.
    """
    k = keys or KEY
    ranges = extents(member, selection, k)
    groups = fetch_groups(ranges, frame, totals, k)
    has = lambda rows, name: rows.select(*k, F.lit(True).alias(name))
    files = selection.filter(~F.col("path").endswith("/")).select(*k, "path").distinct().groupBy(*k).agg(F.count("*").alias("files"))
    sums = groups.groupBy(*k).agg(F.count("*").alias("_n"), F.sum(F.col("enc_end") - F.col("enc_start")).alias("_bytes"))
    # What is known of each archive meets in one sum, not in a join each.
    facts = files.unionByName(sums, allowMissingColumns=True)
    for rows, name in ((member, "_index"), (ranges, "_offset"), (frame, "_frames"), (totals if ranged is None else ranged, "_ranged")):
        facts = facts.unionByName(has(rows, name), allowMissingColumns=True)
    known = [F.max(c).alias(c) for c in facts.columns if c not in k]
    rows = facts.groupBy(*k).agg(*known).filter("files is not null").join(totals, k)
    lacks = F.when(F.col("_index").isNull(), "no index").when(F.col("_offset").isNull(), "no offset").when(F.col("_frames").isNull(), "no frames").when(F.col("_n").isNull(), "no groups").when(F.col("_ranged").isNull(), "no ranged copy").otherwise("")
    parts = F.coalesce(F.col("parts"), F.lit(1)) if "parts" in totals.columns else F.lit(1)
    rows = rows.withColumn("reason", lacks).withColumn("_by", F.col("reason") == "")
    rows = rows.withColumn("fetches", F.when(F.col("_by"), F.col("_n")).otherwise(parts).cast("long")).withColumn("bytes", F.when(F.col("_by"), F.col("_bytes")).otherwise(F.col("enc_total")))
    rates = cost_rate.filter(F.col("medium") == medium).select("gib_egress", "per_1000")
    price = F.round(F.col("bytes") / F.lit(float(1 << 30)) * F.col("gib_egress") + F.col("fetches") / F.lit(1000.0) * F.col("per_1000"), 6)
    return rows.join(F.broadcast(rates), F.lit(True)).select(*k, "files", F.when(F.col("_by"), "ranged").otherwise("whole").alias("mode"), "reason", "fetches", "bytes", F.col("enc_total").alias("whole"), price.alias("price"))


#: A frame's members may reach over so many frames before it is passed over.
SPAN_FRAMES = 4


def frame_sample(member: DataFrame, frame: DataFrame, n: int, keys: list[str] | None = None) -> DataFrame:
    """(keys, seq, raw, path, span): the frame of each archive to test, its first member, and the bytes from there to the end of its last one.

    Frames are taken in turn from number n on (in a circle) among those in which a member
    begins. The first whose span is at most SPAN_FRAMES frames is chosen; where none is,
    the one with the least span. The last member of an archive ends a frame after the last
    frame begins. Members find their frame in the buckets that both touch. An archive
    with a member whose offset is unknown (below 0) has no sample, as nothing anchors its list.
    """
    k = keys or KEY
    line = Window.partitionBy(*k).orderBy("seq")
    facts = frame.groupBy(*k).agg(F.count("*").alias("_n"), F.max("raw").alias("_last"), F.min(F.when(F.col("seq") == 1, F.col("raw"))).alias("_r1"), F.min(F.when(F.col("seq") == 0, F.col("raw"))).alias("_r0"))
    facts = facts.select(*k, "_n", "_last", F.coalesce(F.col("_r1") - F.col("_r0"), F.lit(0)).alias("_stride"))
    known = F.min("off").over(Window.partitionBy(*k)) >= 0
    m = member.withColumns({"_next": F.lead("off").over(line), "_known": known}).filter("_known").select(*k, F.col("seq").alias("_m"), "off", "_next", "path")
    ends = m.groupBy(*k).agg((F.max("off") + 1).alias("_most"))
    f = frame.join(ends, k).withColumn("_raw_end", F.coalesce(F.lead("raw").over(line), F.greatest("_most", F.col("raw") + 1))).filter("_raw_end > raw")
    f = f.select(*k, "seq", "raw", "_raw_end", F.explode(_buckets(F.col("raw"), F.col("_raw_end"), BUCKET)).alias("_b"))
    found = m.withColumn("_b", F.floor(F.col("off") / BUCKET)).join(f, [*k, "_b"]).filter((F.col("off") >= F.col("raw")) & (F.col("off") < F.col("_raw_end")))
    spans = found.groupBy(*k, "seq", "raw").agg(F.min("off").alias("_start"), F.min_by("path", "_m").alias("path"), F.max_by("_next", "_m").alias("_end")).join(facts, k)
    spans = spans.withColumn("span", F.coalesce("_end", F.col("_last") + F.col("_stride")) - F.col("_start"))
    turn = F.pmod(F.col("seq") - F.lit(n) % F.col("_n"), F.col("_n"))
    fits = (F.col("_stride") <= 0) | (F.col("span") <= SPAN_FRAMES * F.col("_stride"))
    rank = F.struct((~fits).cast("int").alias("over"), F.when(fits, F.lit(0).cast("long")).otherwise(F.col("span")).alias("s"), turn.alias("t"))
    return spans.groupBy(*k).agg(F.min_by(F.struct("seq", "raw", "path", "span"), rank).alias("p")).select(*k, "p.*")
