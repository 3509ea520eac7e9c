"""Copies that the verification queries store: what is on disk, and what is read and shuffled of it."""

from __future__ import annotations

import gzip
import io
import os
import tarfile

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import verify
from fleetlens.plans import files
from fleetlens.plans.tables import Tables

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are not here")
def test_copies_are_stored_packed(spark):
    """What copies take on disk is a fraction of what is unpacked and listed of them."""
    t = Tables(spark, FOLDER)
    s = files.Stored(t)
    taken = s.parts.agg(F.sum("size")).first()[0]
    listed = s.read.filter("kind = 'member' and seq >= 0")
    assert listed.count() > s.parts.count() / 4 and listed.agg(F.sum(F.lit(512))).first()[0] > 2 * taken
    # Whole copies hold each archive of their host and month, as the table has them.
    whole = s.read.filter("kind = 'copy'").join(s.archive, ["run", "dle", "level"]).filter("sha = sha256").select(*verify.COPY)
    got = {(r.run, r.dle, r.path) for r in listed.join(whole, verify.COPY, "left_semi").collect()}
    wanted = t.archive.select(F.concat(F.lit("run-"), F.substring("run", 5, 7)).alias("run"), F.col("host").alias("dle"), F.concat("dle", F.lit("/"), "run").alias("path"))
    assert got == {tuple(r) for r in wanted.join(whole.select("run", "dle").distinct(), ["run", "dle"], "left_semi").collect()}


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are not here")
def test_seals_alone_list_nothing(spark):
    s = files.Stored(Tables(spark, FOLDER), listing=False)
    assert s.read.filter("kind = 'member'").count() == 0 and s.read.filter("kind = 'part'").count() == s.parts.count() > 0


def test_packed_archives_are_what_tarfile_writes():
    out, packed = io.BytesIO(), files.Packed()
    with tarfile.open(fileobj=out, mode="w", format=tarfile.USTAR_FORMAT) as tar:
        for i in range(400):
            name, size = f"c{i}/run-1996-03-{i % 28 + 1:02d}.000000", i * 37 % 900
            info = tarfile.TarInfo(name)
            info.size = size
            tar.addfile(info, io.BytesIO(b"y" * size))
            packed.add(name, size)
    parts = packed.close()
    assert gzip.decompress(b"".join(parts)) == out.getvalue() and len(gzip.decompress(parts[0])) == files.SPLIT
    changed = parts[1][:4] + b"?" + parts[1][5:]
    assert changed != parts[1] and gzip.decompress(parts[0] + changed) == out.getvalue()
