"""Stores and documents read piece by piece, against whole reads."""

from __future__ import annotations

import gzip
import io
import json
import random

import pyspark.sql.datasource as ds
import pytest
from pyspark.sql import functions as F

from fleetlens.sources import readers, store


def random_value(rng: random.Random, depth: int = 0):
    kind = rng.randrange(8 if depth < 3 else 6)
    if kind < 2:
        return "".join(rng.choice('ab"\\/\n\té€😀{}[],: ') for _ in range(rng.randrange(12)))
    if kind < 6:
        return rng.choice([0, -12, 3.25, 1e-7, 12345678901234, True, False, None])
    if kind == 6:
        return [random_value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {f"k{i}": random_value(rng, depth + 1) for i in range(rng.randrange(4))}


def slow_entries(doc: dict, keys: dict[str, bool]) -> list[tuple]:
    out = []
    for key, value in doc.items():
        if keys.get(key) is False:
            out.append((key, None, 0, value))
        elif key in keys and isinstance(value, list):
            out += [(key, None, i, v) for i, v in enumerate(value)]
        elif key in keys and isinstance(value, dict):
            out += [(key, name, i, v) for i, (name, v) in enumerate(value.items())]
    return out


@pytest.mark.parametrize("chunk", [1, 2, 7, 64, 1 << 18])
def test_entries_are_those_of_a_whole_parse(monkeypatch, chunk):
    monkeypatch.setattr(store, "CHUNK", chunk)
    rng = random.Random(chunk)
    for _ in range(60):
        doc = {k: random_value(rng) for k in rng.sample(["a", "b", "c", "é"], rng.randrange(5))}
        keys = {"a": True, "é": True, "b": False}
        text = json.dumps(doc, indent=rng.choice([None, 1]), ensure_ascii=rng.random() < 0.5)
        got = [(k, n, i, json.loads(v)) for k, n, i, v in store.Pieces(io.BytesIO(text.encode())).entries(keys)]
        assert got == slow_entries(doc, keys)


@pytest.mark.parametrize("bad", ['{"a": [1, 2', '{"a": [1 2]}', '{"a" 1}', "[1]", '{"a": [1, x]}', '{"a": ["b]}', '{"a": 1,}', "{"])
def test_broken_documents_raise(bad):
    with pytest.raises(ValueError):
        list(store.Pieces(io.BytesIO(bad.encode())).entries({"a": True}))


def test_nothing_gives_nothing():
    for text in ("", " \n", "{}", '{"a": []}', '{"a": {}}', '{"a": null}', '{"b": [1]}'):
        assert list(store.Pieces(io.BytesIO(text.encode())).entries({"a": True})) == []


class Long:
    """A document of n entries that is made as it is read."""

    def __init__(self, n: int) -> None:
        self.parts, self.held = self._made(n), b""

    def _made(self, n: int):
        yield b'{"skipped": ['
        for i in range(n):
            yield b"," * (i > 0) + b'{"p": "' + b"x" * 90 + b'"}'
        yield b'], "entries": ['
        for i in range(n):
            yield b"," * (i > 0) + b'{"p": "' + b"y" * 90 + b'"}'
        yield b"]}"

    def read(self, n: int) -> bytes:
        while len(self.held) < n:
            part = next(self.parts, None)
            if part is None:
                break
            self.held += part
        out, self.held = self.held[:n], self.held[n:]
        return out


def test_a_long_document_is_read_in_bounded_memory():
    pieces = store.Pieces(Long(200_000))  # 40 MB
    assert sum(1 for _ in pieces.entries({"entries": True})) == 200_000
    assert pieces.most < 3 * store.CHUNK


def test_a_false_literal_far_inside_is_found_at_once():
    pieces = store.Pieces(io.BytesIO(b'{"a": [nope, ' + b"1, " * 1_000_000 + b"1]}"))
    with pytest.raises(ValueError):
        list(pieces.entries({"a": True}))
    assert pieces.most <= store.CHUNK


def test_documents_of_a_folder(spark, tmp_path):
    good = {"members": [{"p": f"f{i}", "o": i} for i in range(25_000)], "frames": [[0, 0]]}
    (tmp_path / "run-2024-01-01.1-a-L0.idx.gz").write_bytes(gzip.compress(json.dumps(good).encode()))
    (tmp_path / "run-2024-01-02.1-a-L1.idx.gz").write_bytes(gzip.compress(json.dumps(good).encode())[:-900])
    (tmp_path / "run-2024-01-03.1-é b%3A-L1.idx").write_text(json.dumps({"units": [], "members": [{"p": None, "extra": 1}, None]}))
    (tmp_path / "run-2024-01-04.1-a-L1.idx").write_text("")
    t = readers.read_member_index(spark, str(tmp_path))
    got = t["member"].groupBy("run", "dle", "level").agg(F.count("*").alias("n"), F.countDistinct("seq").alias("d"), F.max("off").alias("off")).orderBy("run").collect()
    assert [tuple(r) for r in got] == [("run-2024-01-01.1", "a", 0, 25_000, 25_000, 24_999), ("run-2024-01-03.1", "é b%3A", 1, 2, 2, None)]
    assert t["frame"].count() == 1 and t["unit"].count() == 0
    with pytest.raises(Exception, match="end|Error"):
        store.document_entries(spark, str(tmp_path / "run-2024-01-02.1-a-L1.idx.gz"), {"members": True}).count()


@pytest.fixture
def root(tmp_path):
    for run in ("run-1", "run-2", "run-é"):
        folder = tmp_path / "runs" / run
        folder.mkdir(parents=True)
        for pos in range(20):
            if pos != 3:
                (folder / f"{pos:06d}-a.tar").write_bytes(b"x" * pos)
            if pos != 5:
                (folder / f"{pos:06d}-a.tar.hdr").write_text("no json" if pos == 7 else json.dumps({"run": run, "dle": "a", "part": pos}))
        (folder / "notes.txt").write_text("not numbered")
    return tmp_path


def test_store_pairs_by_number(spark, root):
    got = readers.scan_store(spark, f"file:{root}").collect()
    assert len(got) == 60
    assert all((r.bytes is None) == (r.pos == 3) and (r.sidecar is None) == (r.pos == 5) and r.part == (None if r.pos in (5, 7) else r.pos) for r in got)
    assert all(r.bytes in (None, r.pos) and r.run in ("run-1", "run-2", "run-é") for r in got)
    assert readers.scan_store(spark, str(root / "nowhere")).collect() == []


def test_runs_that_a_filter_leaves_out_are_not_listed(spark, root, monkeypatch):
    seen = []
    monkeypatch.setattr(store, "listed", lambda folder, real=store.listed: seen.append(folder) or real(folder))

    def read(*filters):
        seen.clear()
        reader = store.StoreReader({"path": str(root)})
        left = list(reader.pushFilters(list(filters)))
        rows = [r for p in reader.partitions() for r in reader.read(p)]
        assert len(rows) == len({r[:2] for r in rows})
        return left, len(rows), {f.rpartition("/")[2] for f in seen}

    other = ds.GreaterThan(("pos",), 3)
    assert read(ds.EqualTo(("run",), "run-2"), other) == ([other], 20, {"run-2"})
    assert read(ds.In(("run",), ("run-1", "gone"))) == ([], 20, {"run-1", "gone"})
    assert read(ds.GreaterThan(("run",), "run-1"), ds.LessThanOrEqual(("run",), "run-2")) == ([], 20, {"runs", "run-2"})
    assert read(ds.StringStartsWith(("run",), "run-é")) == ([], 20, {"runs", "run-é"})
    assert read() == ([], 60, {"runs", "run-1", "run-2", "run-é"})
    assert read(ds.EqualTo(("run",), "run-2"), ds.EqualTo(("run",), "run-1")) == ([], 0, set())


@pytest.mark.parametrize("condition", ["run = 'run-2'", "run in ('run-1', 'gone')", "run > 'run-1' and pos > 3", "run like 'run-é%'", "run is null", "run <=> null", "run <> 'run-1'", "dle = 'a' or run = 'run-1'"])
def test_filters_change_no_row(spark, root, condition):
    scanned = readers.scan_store(spark, str(root))
    key = lambda r: (r.run, r.pos)
    whole = spark.createDataFrame(scanned.collect(), scanned.schema).filter(condition)
    assert sorted(map(key, scanned.filter(condition).collect())) == sorted(map(key, whole.collect()))
