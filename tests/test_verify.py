"""Verification of stored copies: each class, one pass for all results, parts of any size."""

from __future__ import annotations

import gzip
import hashlib
import io
import tarfile

import pytest

from fleetlens.operators import verify


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def tar_of(**files: bytes) -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as tar:
        for name, data in files.items():
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    return out.getvalue()


TAR = tar_of(f=b"12", g=b"345" * 5000, h=b"")
KEY = "run string, dle string, level int"


class Store:
    def __init__(self, spark, path):
        self.spark, self.path, self.parts, self.archives, self.placed = spark, path, [], [], []

    def archive(self, dle, data=TAR, files=3, listable=True, compress=None, checksum=None, run="r1"):
        self.archives.append((run, dle, 0, sha(data) if checksum is None else checksum, files, listable, compress))

    def copy(self, dle, medium, parts, recorded=None, sealed=True, run="r1", placed=True, absent=()):
        recorded = recorded or parts
        for no, (data, want) in enumerate(zip(parts, recorded, strict=True)):
            file = self.path / f"{run}-{dle}-{medium}-{no}"
            if no not in absent:
                file.write_bytes(data)
            self.parts.append((run, dle, 0, medium, no, f"file://{file}", len(want), sha(want) if sealed else None))
        if placed:
            self.placed.append((run, dle, 0, medium))

    def frames(self):
        make = self.spark.createDataFrame
        return (
            make(self.parts, f"{KEY}, medium string, part_no int, uri string, size bigint, sha256 string").repartition(3),
            make(self.archives, f"{KEY}, sha256 string, file_count bigint, listable boolean, compress string"),
            make(self.placed, f"{KEY}, medium string"),
        )


def index(spark, *dles, members=(("f", 0), ("g", 1024), ("h", 16896)), run="r1"):
    return spark.createDataFrame([(run, d, 0, p, o) for d in dles for p, o in members], f"{KEY}, path string, off bigint")


def test_classes(spark, tmp_path):
    s, half = Store(spark, tmp_path), [TAR[:700], TAR[700:]]
    changed = [half[0], half[1][:-1] + b"?"]
    names = ["good", "sealed", "unsealed", "cut", "short", "lost", "first", "none", "names", "moved", "uncounted", "unindexed", "opaque", "notar", "two"]
    for name in names:
        s.archive(name, **{"uncounted": {"files": 0}, "opaque": {"listable": False, "data": b"no tar"}, "notar": {"data": b"no tar" * 200}}.get(name, {}))
    for name in ("good", "names", "moved", "uncounted", "unindexed", "two"):
        s.copy(name, "disk", half)
    s.copy("sealed", "disk", changed, half)
    s.copy("unsealed", "disk", changed, half, sealed=False)
    s.copy("cut", "disk", [half[0], half[1][:100]], half, sealed=False)
    s.copy("short", "disk", [half[0], half[1][:-512]], half, sealed=False)  # whole blocks, all members
    s.copy("lost", "disk", [half[0][:-1] + b"?", half[1]], half, absent={1})  # a broken seal before a part that is gone
    s.copy("first", "disk", half, absent={0})
    s.placed.append(("r1", "none", 0, "disk"))
    s.copy("opaque", "disk", [b"no tar"])
    s.copy("notar", "disk", [b"no tar" * 200])
    s.copy("two", "tape", changed, half)
    s.copy("good", "vault", half)
    s.archive("x", run="r2")
    s.archive("y", run="r3")
    s.placed.append(("r3", "y", 0, "vault"))
    parts, archive, placement = s.frames()
    member = index(spark, *(n for n in names if n not in ("unindexed", "names", "moved")))
    member = member.unionByName(index(spark, "names", members=[("f", 0), ("g", 1024)])).unionByName(index(spark, "moved", members=[("f", 0), ("g", 1), ("h", -1)]))
    media = spark.createDataFrame([("disk",), ("tape",)], "medium string")
    read = verify.read_copies(parts.filter("medium <> 'vault'"), archive)
    bytes_read = {r.dle: r.bytes for r in read.filter("kind = 'copy' and medium = 'disk'").collect()}
    assert bytes_read["good"] == len(TAR) and bytes_read["cut"] == 800 and bytes_read["first"] == len(half[1])
    assert [(r.part_no, r.fault, r.bytes) for r in read.filter("kind = 'part' and dle = 'lost'").orderBy("part_no").collect()] == [(0, None, 700), (1, "open", 0)]

    deep = {(r.dle, r.medium): (r["class"], r.skipped) for r in verify.verify_archives(read, parts, archive, placement, member, media).collect()}
    want = {"good": "", "sealed": "integrity", "unsealed": "integrity", "cut": "pipeline", "short": "integrity", "lost": "integrity", "first": "pipeline", "none": "missing", "names": "integrity", "moved": "integrity", "uncounted": "", "unindexed": "", "opaque": "", "notar": "pipeline", "two": ""}
    assert deep == {**{(d, "disk"): (c, False) for d, c in want.items()}, ("two", "tape"): ("integrity", False), ("good", "vault"): ("", True), ("y", "vault"): ("", True), (None, None): ("missing", False)}
    only = {(r.dle, r.medium): r["class"] for r in verify.verify_archives(read, parts, archive, placement, media=media, structural=False).collect()}
    assert [only[d, "disk"] for d in ("cut", "short", "names", "moved", "notar", "first", "unsealed", "sealed", "lost", "none")] == ["integrity", "integrity", "", "", "", "pipeline", "integrity", "integrity", "integrity", "missing"]
    listed = {(r.dle, r.medium): r["class"] for r in verify.structural_verdict(read, parts, archive, member).collect()}
    assert [listed[d, "disk"] for d in ("cut", "short", "unsealed", "names", "moved", "uncounted", "unindexed", "notar")] == ["pipeline", "", "", "integrity", "integrity", "", "", "pipeline"]

    verdicts = verify.verify_archives(read, parts, archive, placement, member, media)
    report = {r.run: tuple(r)[1:] for r in verify.verify_report(verdicts).collect()}
    assert report["r2"] == ("failed", 0, 1, 0, "", "", "") and report["r3"] == ("skipped", 0, 0, 0, "", "", "vault")
    status, archives, failures, moved, good, bad, skipped = report["r1"]
    assert (status, archives, failures, good, bad, skipped) == ("failed", 15, 11, "", "disk,tape", "vault") and moved == sum(bytes_read.values()) + len(TAR)
    two = verdicts.filter("dle = 'two'")
    assert tuple(verify.verify_report(two).first()) == ("r1", "repairable", 1, 1, 2 * len(TAR), "disk", "tape", "")
    assert tuple(verify.verify_report(two.filter("medium = 'disk'")).first())[1] == "ok"

    seals = {(r.dle, r.part_no): r.verdict for r in verify.verify_parts(read, parts.filter("medium = 'disk'")).collect()}
    assert [seals[k] for k in (("good", 0), ("sealed", 0), ("sealed", 1), ("unsealed", 1), ("first", 0), ("first", 1), ("lost", 0), ("lost", 1))] == ["ok", "ok", "integrity", "skipped", "pipeline", "ok", "integrity", "pipeline"]


def test_packed_archives_are_listed_through_their_compression(spark, tmp_path):
    s, packed = Store(spark, tmp_path), gzip.compress(TAR)
    for name, data in (("good", packed), ("cut", packed[:-20]), ("odd", b"no gzip" * 9)):
        s.archive(name, data, compress="gzip")
        s.copy(name, "disk", [data[:50], data[50:]])
    parts, archive, placement = s.frames()
    read = verify.read_copies(parts, archive)
    got = {r.dle: r["class"] for r in verify.verify_archives(read, parts, archive, placement, index(spark, "good", "cut", "odd")).collect()}
    assert got == {"good": "", "cut": "pipeline", "odd": "pipeline"}
    assert [(r.path, r.off) for r in read.filter("dle = 'good' and seq >= 0").orderBy("seq").collect()] == [("f", 0), ("g", 1024), ("h", 16896)]
    unlisted = verify.read_copies(parts, archive, listing=False)
    assert unlisted.filter("kind = 'member'").count() == 0 and unlisted.filter("kind = 'copy'").count() == 3


def test_parts_over_two_gigabytes(spark, tmp_path):
    file, size = tmp_path / "large", (1 << 31) + 12345
    with file.open("wb") as f:
        f.truncate(size)
    zeros = hashlib.sha256()
    for at in range(0, size, 1 << 24):
        zeros.update(bytes(min(1 << 24, size - at)))
    parts = spark.createDataFrame([("r1", "a", 0, "disk", 0, f"file://{file}", size, zeros.hexdigest())], f"{KEY}, medium string, part_no int, uri string, size bigint, sha256 string")
    read = verify.read_copies(parts, listing=False)
    assert read.filter("kind = 'copy'").first().bytes == size
    assert verify.verify_parts(read, parts).first().verdict == "ok"


def test_nothing_stored(spark):
    parts = spark.createDataFrame([], f"{KEY}, medium string, part_no int, uri string, size bigint, sha256 string")
    archive = spark.createDataFrame([], f"{KEY}, sha256 string, file_count bigint")
    placement = spark.createDataFrame([], f"{KEY}, medium string")
    verdicts = verify.verify_archives(verify.read_copies(parts, archive), parts, archive, placement, index(spark))
    assert verdicts.count() == 0 and verify.verify_report(verdicts).count() == 0


@pytest.mark.parametrize("step", [1, 7, 700, 1 << 20])
def test_reads_of_any_size_give_the_same_digests(tmp_path, step):
    uris = []
    for no, data in enumerate((b"one", b"", b"two" * 500)):
        (tmp_path / str(no)).write_bytes(data)
        uris.append((no, f"file://{tmp_path}/{no}"))
    parts = verify.Parts([*uris, (3, f"file://{tmp_path}/gone")])
    got = b""
    while part := parts.read(step):
        got += part
    assert got == b"one" + b"two" * 500 and parts.digest.hexdigest() == sha(got) and parts.size == len(got)
    assert [(no, s, n, fault) for no, s, n, fault in parts.done] == [(0, sha(b"one"), 3, None), (1, sha(b""), 0, None), (2, sha(b"two" * 500), 1500, None), (3, sha(b""), 0, "open")]


def test_small_addresses_are_read_by_many_tasks(spark, tmp_path):
    """Addresses of all copies are few bytes, yet no task reads all copies."""
    s = Store(spark, tmp_path)
    for i in range(24):
        s.archive(f"c{i}")
        s.copy(f"c{i}", "disk", [TAR])
    parts, archive, _ = s.frames()
    read = verify.read_copies(parts, archive)
    files = {r.f for r in read.filter("kind = 'copy'").selectExpr("_metadata.file_path as f").collect()}
    assert len(files) > 1 and read.filter("kind = 'copy'").count() == 24
