"""Compaction of logs: nothing is lost before, at or after the switch, and appends meanwhile stay."""

from __future__ import annotations

import os

import pytest

from fleetlens.sources import ledger

SCHEMA = "n int, at timestamp, tags array<string>"


def append(spark, path, numbers):
    ledger.append_log(spark.createDataFrame([(n, None, [str(n)]) for n in numbers], SCHEMA).coalesce(1), path)


def read(spark, path):
    return [r.n for r in ledger.read_log(spark, path, SCHEMA).orderBy("place", "block", "line").collect()]


@pytest.fixture
def log(spark, tmp_path):
    path = f"{tmp_path}/log"
    append(spark, path, range(5))
    append(spark, path, range(5, 8))
    return path


def test_compaction_keeps_the_last_records_in_order(spark, log):
    assert read(spark, log) == list(range(8))
    assert not ledger.compact(spark, log, SCHEMA, ledger.last_records(4), over=8)
    assert ledger.compact(spark, log, SCHEMA, ledger.last_records(4), over=7)
    assert read(spark, log) == [4, 5, 6, 7]
    append(spark, log, [8, 9])
    assert read(spark, log) == [4, 5, 6, 7, 8, 9]
    assert ledger.compact(spark, log, SCHEMA, ledger.last_records(3)) and read(spark, log) == [7, 8, 9]
    assert ledger.vacuum(spark, log) > 0 and read(spark, log) == [7, 8, 9] and ledger.vacuum(spark, log) == 0
    append(spark, log, [10])
    assert read(spark, log) == [7, 8, 9, 10]
    assert ledger.read_log(spark, log, SCHEMA).filter("n = 8").first().tags == ["8"]


def test_appends_during_compaction_stay(spark, log):
    def keep(records):
        append(spark, log, [100])
        return ledger.last_records(2)(records)

    assert ledger.compact(spark, log, SCHEMA, keep)
    assert read(spark, log) == [6, 7, 100]


def test_a_crash_before_the_switch_changes_nothing(spark, log, monkeypatch):
    def stop(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(ledger.Folder, "create", stop)
    with pytest.raises(RuntimeError):
        ledger.compact(spark, log, SCHEMA, ledger.last_records(2))
    monkeypatch.undo()
    assert read(spark, log) == list(range(8))
    assert ledger.vacuum(spark, log) == 1 and read(spark, log) == list(range(8))  # what it wrote beside the log


def test_a_manifest_that_was_cut_off_does_not_count(spark, log):
    assert ledger.compact(spark, log, SCHEMA, ledger.last_records(4))
    with open(f"{log}/_log/2.manifest", "w") as f:
        f.write('{"base": [')
    assert read(spark, log) == [4, 5, 6, 7]
    assert ledger.compact(spark, log, SCHEMA, ledger.last_records(1)) and os.path.exists(f"{log}/_log/3.manifest")
    assert read(spark, log) == [7]


def test_of_two_compactions_one_counts(spark, log):
    def keep(records):
        assert ledger.compact(spark, log, SCHEMA, ledger.last_records(3))
        return ledger.last_records(1)(records)

    assert not ledger.compact(spark, log, SCHEMA, keep)
    assert read(spark, log) == [5, 6, 7]
    assert len([d for d in os.listdir(f"{log}/_log") if d.startswith("base-")]) == 1


def test_a_missing_log_is_empty(spark, tmp_path):
    path = f"{tmp_path}/none"
    assert read(spark, path) == [] and not ledger.compact(spark, path, SCHEMA, ledger.last_records(1)) and ledger.vacuum(spark, path) == 0


def test_torn_lines(spark, log):
    with open(f"{log}/part-00000-11111111-2222-3333-4444-555555555555-c000.json", "w") as f:
        f.write('{"n": 50}\n{"n": 5')
    assert sorted(read(spark, log)) == [*range(8), 50]
    assert ledger.compact(spark, log, SCHEMA, ledger.last_records(100)) and sorted(read(spark, log)) == [*range(8), 50]
