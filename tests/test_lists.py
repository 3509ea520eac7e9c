"""Members that copies list against their index, and how they are read."""

from __future__ import annotations

import io
import os

import pytest

from fleetlens.operators import verify

LISTS = "run string, dle string, level int"


@pytest.mark.parametrize("paired", [False, True])
def test_lists_are_compared_without_pairing_members(spark, monkeypatch, paired):
    """Only lists with unknown offsets are paired member by member; of others sums are compared, repeated members too."""
    lists = {"same": [("f", 0), ("f", 512), ("g", 1024)], "turned": [("g", 1024), ("f", 512), ("f", 0)], "once": [("f", 0), ("g", 1024)], "more": [("f", 0), ("f", 512), ("g", 1024), ("h", 1536)], "moved": [("f", 0), ("f", 512), ("g", 1025)], "swapped": [("f", 0), ("g", 512), ("f", 1024)], "twice": [("f", 0), ("f", 0), ("g", 1024)]}
    if paired:
        lists |= {"null": [("f", 0), ("f", 512), ("g", None)], "minus": [("f", 0), ("f", 512), ("g", -1)], "nullgone": [("f", 0), ("f", 512), ("h", None)], "nullmoved": [("f", 0), ("f", 513), ("g", None)]}
    else:
        monkeypatch.setattr(verify, "members_diff", None)
    wrong = {"once", "more", "moved", "swapped", "twice", "nullgone", "nullmoved"}
    make = spark.createDataFrame
    found = [("r", d, 0, "disk", "member", None, None, None, None, i, p, o) for d in lists for i, (p, o) in enumerate([("f", 0), ("f", 512), ("g", 1024)])]
    copies = [("r", d, 0, "disk", "copy", None, "", 0, None, None, None, None) for d in [*lists, "empty"]]
    read = make(found + copies, f"{LISTS}, medium string, {verify.ROW}")
    archive = make([("r", d, 0, 3) for d in [*lists, "empty"]], f"{LISTS}, file_count bigint")
    member = make([("r", d, 0, p, o) for d, m in (lists | {"empty": [("f", 0)]}).items() for p, o in m], f"{LISTS}, path string, off int")
    parts = make([], f"{LISTS}, medium string, part_no int, size bigint, sha256 string")
    got = {r.dle: r["class"] for r in verify.structural_verdict(read, parts, archive, member).collect()}
    assert got == {d: verify.INTEGRITY if d in wrong else "" for d in lists} | {"empty": verify.INTEGRITY}


def test_small_pieces_come_from_large_reads():
    """A tar is listed by small pieces, as what is left of a piece is copied for each member; the store is asked for large ones."""
    asked = []

    class Source(io.BytesIO):
        def read(self, n=-1):
            asked.append(n)
            return super().read(n)

    data = os.urandom(3 * verify.CHUNK // 2)
    counted, got = verify.Counted(Source(data)), b""
    while piece := counted.read(verify.WINDOW):
        got += piece
    assert got == data and counted.size == len(data) and set(asked) == {verify.CHUNK} and verify.WINDOW < verify.CHUNK
