"""Stored copies of archives against what was recorded of them: one pass over the bytes gives part seals, checksums and member lists."""

from __future__ import annotations

import gzip
import hashlib
import tarfile
import zlib
from collections.abc import Iterator
from functools import partial
from itertools import islice

import pandas as pd
import pyarrow.fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.operators.placement import members_diff
from fleetlens.plans.lineage import cut, tasks

#: Bytes read at a time.
CHUNK = 1 << 20

#: Bytes a tar archive is listed by: what is left of them is copied for each member.
WINDOW = 1 << 14

#: A tar archive is whole blocks of so many bytes.
BLOCK = 512

#: What a check can find wrong. Integrity: other bytes than were recorded; pipeline: bytes that cannot be read or listed; missing: a copy without a position.
INTEGRITY, PIPELINE, MISSING = "integrity", "pipeline", "missing"

COPY = ["run", "dle", "level", "medium"]
ROW = "kind string, part_no int, sha string, bytes long, fault string, seq long, path string, off long"


class Parts:
    """The parts of a copy, one behind another, as one file to read, which is hashed as a whole and part by part on the way. done has (part number, sha, bytes, fault) of each part; fault is 'open' for one that cannot be read."""

    def __init__(self, parts: list[tuple[int, str]]) -> None:
        self.todo, self.stream = list(parts), None
        self.digest, self.size, self.done = hashlib.sha256(), 0, []

    def _close(self, fault: str | None) -> None:
        self.done.append((self.no, self.own.hexdigest(), self.own_size, fault))
        self.stream = None

    def read(self, n: int = CHUNK) -> bytes:
        out = b""
        while len(out) < n:
            if self.stream is None:
                if not self.todo:
                    break
                self.no, uri = self.todo.pop(0)
                self.own, self.own_size = hashlib.sha256(), 0
                try:
                    store, path = pyarrow.fs.FileSystem.from_uri(uri)
                    self.stream = store.open_input_stream(path)
                except OSError:
                    self._close("open")
                    continue
            try:
                got = self.stream.read(n - len(out))
            except OSError:
                self._close("open")
                continue
            if not got:
                self.stream.close()
                self._close(None)
                continue
            self.own.update(got)
            self.own_size += len(got)
            out += got
        self.digest.update(out)
        self.size += len(out)
        return out

    def drain(self) -> None:
        while self.read(CHUNK):
            pass


class Counted:
    """A stream that counts what it gives, in pieces of any size from larger reads."""

    def __init__(self, stream) -> None:
        self.stream, self.size = stream, 0
        self.got, self.at = b"", 0

    def read(self, n: int = CHUNK) -> bytes:
        if self.at == len(self.got):
            self.got, self.at = self.stream.read(CHUNK), 0
        out = self.got[self.at : self.at + n]
        self.at += len(out)
        self.size += len(out)
        return out


def _members(parts: Parts, packed: bool) -> Iterator[tuple]:
    """(place, path, offset) of each member of a tar archive, and (-1, '', -1) at the end of one that cannot be read to it."""
    plain = Counted(gzip.GzipFile(fileobj=parts, mode="rb") if packed else parts)
    try:
        with tarfile.open(fileobj=plain, mode="r|", bufsize=WINDOW) as tar:
            for i, m in enumerate(tar):
                yield i, m.name + ("/" if m.isdir() else ""), m.offset
                tar.members.clear()
        while plain.read(CHUNK):
            pass
        if plain.size % BLOCK:
            yield -1, "", -1
    except (tarfile.TarError, EOFError, OSError, zlib.error):
        yield -1, "", -1


def _read_copies(batches: Iterator[pd.DataFrame], listing: bool) -> Iterator[pd.DataFrame]:
    names = [*COPY, *(c.split()[0] for c in ROW.split(", "))]
    for batch in batches:
        for *copy, parts, listable, packed in batch[[*COPY, "parts", "listable", "packed"]].itertuples(index=False):
            source = Parts([(int(p["part_no"]), p["uri"]) for p in parts])
            listed = _members(source, packed) if listing and listable else iter(())
            while some := list(islice(listed, 10_000)):
                seqs, paths, offs = zip(*some, strict=True)
                known = dict(zip(COPY, copy, strict=True)) | {"kind": "member", "seq": seqs, "path": paths, "off": offs}
                yield pd.DataFrame({c: known.get(c) for c in names})
            source.drain()
            rows = [(*copy, "part", no, sha, size, fault, None, None, None) for no, sha, size, fault in source.done]
            rows.append((*copy, "copy", None, source.digest.hexdigest(), source.size, None, None, None, None))
            yield pd.DataFrame(rows, columns=names)


def read_copies(parts: DataFrame, archive: DataFrame | None = None, listing: bool = True) -> DataFrame:
    """(run, dle, level, medium, kind, part_no, sha, bytes, fault, seq, path, off), written: what one pass over the bytes of each copy found.

    parts has run, dle, level, medium, part_no and uri. A copy gives a row of kind 'part'
    for each part (sha, bytes, fault 'open' where it cannot be read), one of kind 'copy'
    (sha and bytes of all parts in order), and with listing one of kind 'member' for each
    member of its tar archive, with seq -1 where it cannot be listed to its end. archive
    (run, dle, level) may have compress ('gzip'; others are listed as they lie) and
    listable (false: read, not listed).

    Only addresses are shuffled: a task opens the parts where they lie, one after another,
    in memory that no part's size touches. Parts behind one that cannot be read are read too.
    Addresses are few bytes that stand for many, so they are dealt anew by a number of tasks that their size does not change.
    """
    of = F.array_sort(F.collect_list(F.struct("part_no", "uri")))
    rows = parts.groupBy(*COPY).agg(of.alias("parts"))
    known = archive.columns if archive is not None else []
    extra = [(F.coalesce("listable", F.lit(True)) if "listable" in known else F.lit(True)).alias("listable"), (F.coalesce(F.col("compress") == "gzip", F.lit(False)) if "compress" in known else F.lit(False)).alias("packed")]
    rows = rows.join(archive.select("run", "dle", "level", *extra), COPY[:3], "left") if archive is not None else rows.select("*", *extra)
    rows = rows.na.fill({"listable": True, "packed": False}).repartition(tasks(rows.sparkSession), F.xxhash64(*COPY))
    kinds = ", ".join(f"{c} {parts.schema[c].dataType.simpleString()}" for c in COPY)
    return cut(rows.mapInPandas(partial(_read_copies, listing=listing), f"{kinds}, {ROW}"))


def verify_parts(read: DataFrame, parts: DataFrame) -> DataFrame:
    """(run, dle, level, medium, part_no, verdict) of each recorded part (size, sha256): ok, integrity (other bytes or another size than sealed), pipeline (cannot be read), or skipped without a seal."""
    got = read.filter("kind = 'part'").select(*COPY, "part_no", F.col("sha").alias("_sha"), F.col("bytes").alias("_bytes"), "fault")
    rows = parts.select(*COPY, "part_no", "size", "sha256").join(got, [*COPY, "part_no"], "left")
    unread = F.col("_sha").isNull() | F.col("fault").isNotNull()
    bad = (F.col("_sha") != F.col("sha256")) | ~F.col("_bytes").eqNullSafe(F.col("size"))
    verdict = F.when(unread, PIPELINE).when(F.coalesce("sha256", F.lit("")) == "", "skipped").when(bad, INTEGRITY).otherwise("ok")
    return rows.select(*COPY, "part_no", verdict.alias("verdict"))


def stream_faults(read: DataFrame, parts: DataFrame) -> DataFrame:
    """(run, dle, level, medium, fault): the class of the first part in order that fails as the copy is read: integrity where a seal is broken, pipeline where it cannot be read."""
    bad = verify_parts(read, parts).filter(F.col("verdict").isin(INTEGRITY, PIPELINE))
    return bad.groupBy(*COPY).agg(F.min_by("verdict", "part_no").alias("fault"))


def _tally(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., n, unknown, sums) of lists of members (path, off): how many they are, how many have no known offset, and sums of 128 bits of hash a member, which tell lists apart in whatever order. The sums are of half words, so that they hold 2^31 members."""
    hashes = [F.xxhash64(F.lit(seed), "path", F.col("off").cast("long")) for seed in (1, 2)]
    halves = [half for h in hashes for half in (h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32))]
    unknown = F.count_if(~F.coalesce(F.col("off") >= 0, F.lit(False)))
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), unknown.alias("unknown"), F.array(*map(F.sum, halves)).alias("sums"))


def structural_verdict(read: DataFrame, parts: DataFrame, archive: DataFrame, member: DataFrame) -> DataFrame:
    """(run, dle, level, medium, class): class '' for a copy that lists cleanly as its index says, else what is wrong.

    A broken seal is integrity, and a part that cannot be read or a stream that cannot be
    listed to its end is pipeline. Members that differ from the index (member: run, dle,
    level, path, off) in names, numbers or known offsets are integrity. Nothing is compared
    where the archive has file_count 0, no index, or cannot be listed: then a clean stream
    is all there is to prove. Lists are compared where they lie, by sums over their
    members; only those with unknown offsets are shuffled.
    """
    copies = read.filter("kind = 'copy'").select(*COPY)
    listed = read.filter("kind = 'member'")
    broken = listed.filter("seq < 0").select(*COPY, F.lit(True).alias("_broken")).distinct()
    can_list = F.coalesce("listable", F.lit(True)) if "listable" in archive.columns else F.lit(True)
    compared = archive.filter(can_list & (F.coalesce("file_count", F.lit(0)) > 0)).select(*COPY[:3]).distinct()
    recorded = _tally(member, COPY[:3]).withColumnsRenamed({"n": "_n", "sums": "_sums"})
    indexed = cut(copies.join(compared, COPY[:3]).join(recorded, COPY[:3]))
    found = listed.filter("seq >= 0")
    same = F.col("n").eqNullSafe(F.col("_n")) & F.col("sums").eqNullSafe(F.col("_sums"))
    differs = indexed.filter("unknown = 0").join(_tally(found, COPY).drop("unknown"), COPY, "left").filter(~same).select(*COPY)
    partly = indexed.filter("unknown > 0").select(*COPY)
    if partly.head(1):
        # Members without an offset match any: their lists are paired member by member.
        problems = members_diff(member.join(partly, COPY[:3]).select(*COPY, "path", "off"), found.join(partly, COPY, "left_semi").select(*COPY, "path", "off"), tuple(COPY))
        differs = differs.unionByName(problems.select(*COPY).distinct())
    differs = differs.withColumn("_differs", F.lit(True))
    rows = copies.join(stream_faults(read, parts), COPY, "left").join(broken, COPY, "left").join(differs, COPY, "left")
    verdict = F.coalesce("fault", F.when(F.col("_broken"), F.lit(PIPELINE)), F.when(F.col("_differs"), F.lit(INTEGRITY)), F.lit(""))
    return rows.select(*COPY, verdict.alias("class"))


def checksum_verdict(read: DataFrame, parts: DataFrame, archive: DataFrame) -> DataFrame:
    """(run, dle, level, medium, class): a broken seal or other bytes than the archive's sha256 are integrity, whatever their number; a part that cannot be read is pipeline; '' is right."""
    copies = read.filter("kind = 'copy'").select(*COPY, "sha").join(archive.select(*COPY[:3], "sha256"), COPY[:3])
    wrong = ~F.col("sha").eqNullSafe(F.col("sha256"))
    return copies.join(stream_faults(read, parts), COPY, "left").select(*COPY, F.coalesce("fault", F.when(wrong, F.lit(INTEGRITY)), F.lit("")).alias("class"))


def verify_archives(read: DataFrame, parts: DataFrame, archive: DataFrame, placement: DataFrame, member: DataFrame | None = None, media: DataFrame | None = None, checksum: bool = True, structural: bool = True) -> DataFrame:
    """(run, dle, level, medium, class, skipped, bytes): a verdict for each copy that placement records, class '' where it is right.

    The structural verdict comes before the checksum's. A copy without parts is missing. A
    copy on a medium that is not in media (medium; null: all are) is skipped and not
    wrong. A run in archive that has no copy at all is one row without source and medium, missing.
    """
    of = placement.select(*COPY).distinct()
    known = media.select("medium", F.lit(True).alias("_known")).distinct() if media is not None else None
    of = of.join(known, "medium", "left") if known is not None else of.withColumn("_known", F.lit(True))
    there = read.filter("kind = 'copy'").select(*COPY, "bytes")
    rows = of.join(there, COPY, "left")
    classes: list[Column] = []
    if structural:
        rows = rows.join(structural_verdict(read, parts, archive, member).withColumnRenamed("class", "_structural"), COPY, "left")
        classes.append(F.col("_structural"))
    if checksum:
        rows = rows.join(checksum_verdict(read, parts, archive).withColumnRenamed("class", "_checksum"), COPY, "left")
        classes.append(F.col("_checksum"))
    skipped = F.col("_known").isNull()
    found = F.coalesce(*(F.when(c != "", c) for c in classes), F.lit(""))
    out = rows.select(*COPY, F.when(skipped, "").when(F.col("bytes").isNull(), MISSING).otherwise(found).alias("class"), skipped.alias("skipped"), F.when(skipped, 0).otherwise(F.coalesce("bytes", F.lit(0))).cast("long").alias("bytes"))
    bare = archive.select("run").distinct().join(placement.select("run").distinct(), "run", "left_anti")
    kinds = {c: placement.schema[c].dataType for c in COPY[1:]}
    return out.unionByName(bare.select("run", *(F.lit(None).cast(t).alias(c) for c, t in kinds.items()), F.lit(MISSING).alias("class"), F.lit(False).alias("skipped"), F.lit(0).cast("long").alias("bytes")))


def verify_report(verdicts: DataFrame) -> DataFrame:
    """(run, status, archives, failures, bytes, good, bad, skipped) of verify_archives' rows by run: archives checked on some copy, verdicts that failed, and the media whose copy of the run is whole, is not, or was not looked at.

    status is ok, skipped (no copy could be looked at), repairable (a whole copy remains beside
    one that failed), or failed.
    """
    bad = F.col("class") != ""
    copies = verdicts.groupBy("run", "medium").agg(F.max(bad).alias("bad"), F.min("skipped").alias("skipped"), F.sum(bad.cast("long")).alias("n"), F.sum("bytes").alias("bytes"))
    media = lambda c: F.array_join(F.sort_array(F.collect_set(F.when(c, F.col("medium")))), ",")
    runs = copies.groupBy("run").agg(F.sum("n").alias("failures"), F.sum("bytes").alias("bytes"), media(~F.col("bad") & ~F.col("skipped")).alias("good"), media(F.col("bad")).alias("bad"), media(F.col("skipped")).alias("skipped"))
    checked = verdicts.filter("not skipped and dle is not null").groupBy("run").agg(F.countDistinct("dle", "level").alias("archives"))
    status = F.when(F.col("failures") > 0, F.when(F.col("good") != "", "repairable").otherwise("failed")).when((F.col("good") == "") & (F.col("skipped") != ""), "skipped").otherwise("ok")
    return runs.join(checked, "run", "left").select("run", status.alias("status"), F.coalesce("archives", F.lit(0)).cast("long").alias("archives"), "failures", "bytes", "good", "bad", "skipped")
