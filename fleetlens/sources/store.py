"""Files read piece by piece: address stores as a data source that lists only the runs asked for, and JSON documents as a stream of their entries."""

from __future__ import annotations

import codecs
import json
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringStartsWith

FILES = "run string, pos long, payload string, bytes long, modified timestamp, sidecar string, header string"
NAME = re.compile(r"(\d+)-[^/]*$")
#: Tasks that share a run, and what a scan's tasks are at least (where there are so many shares) and at most; between them a task has 16 shares.
SHARES, FEW, MANY = 8, 64, 2048


def located(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path as Spark shows it, and the path in it."""
    if path.startswith("file:") or "://" not in path:
        return pyarrow.fs.LocalFileSystem(), re.sub("^/+", "/", path.removeprefix("file:"))
    return pyarrow.fs.FileSystem.from_uri(path)


def listed(folder: str) -> list[pyarrow.fs.FileInfo]:
    store, path = located(folder)
    return store.get_file_info(pyarrow.fs.FileSelector(path, allow_not_found=True))


class Share(InputPartition):
    """Some shares of some runs: of a run's files those whose number leaves the share as remainder."""

    def __init__(self, units: list[tuple[str, int]]) -> None:
        self.units = units


class StoreReader(DataSourceReader):
    """Reads an address store. Filters on the run are settled while folders are listed; others are left to Spark."""

    TESTS = {
        EqualTo: lambda run, v: run == v,
        EqualNullSafe: lambda run, v: run == v,
        In: lambda run, v: run in v,
        GreaterThan: lambda run, v: run > v,
        GreaterThanOrEqual: lambda run, v: run >= v,
        LessThan: lambda run, v: run < v,
        LessThanOrEqual: lambda run, v: run <= v,
        StringStartsWith: lambda run, v: run.startswith(v),
    }

    def __init__(self, options: dict[str, str]) -> None:
        self.root = options["path"].rstrip("/")
        self.shares = int(options.get("shares", SHARES))
        self.tests: list[tuple[type, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            # Spark orders text by its UTF-8 bytes, Python by code points; these orders are the same.
            if type(f) in self.TESTS and f.attribute == ("run",) and f.value is not None:
                self.tests.append((type(f), f.value))
            else:
                yield f

    def _asked(self, run: str) -> bool:
        return all(self.TESTS[kind](run, value) for kind, value in self.tests)

    def partitions(self) -> list[InputPartition]:
        exact = [[value] if kind is not In else list(value) for kind, value in self.tests if kind in (EqualTo, EqualNullSafe, In)]
        # Runs that are named need no listing of all runs.
        names = exact[0] if exact else [i.base_name for i in listed(f"{self.root}/runs") if i.type == pyarrow.fs.FileType.Directory]
        units = [(run, k) for run in sorted({r for r in names if r is not None}) if self._asked(run) for k in range(self.shares)]
        n = min(len(units), max(FEW, len(units) // 16), MANY)
        return [Share(units[i::n]) for i in range(n)] or [Share([])]

    def read(self, partition: Share) -> Iterator[tuple]:
        for run, share in partition.units:
            folder = f"{self.root}/runs/{run}"
            found: dict[int, tuple[list, list]] = defaultdict(lambda: ([], []))
            for info in listed(folder):
                hit = NAME.match(info.base_name)
                if hit and info.type == pyarrow.fs.FileType.File and int(hit[1]) % self.shares == share:
                    found[int(hit[1])][info.base_name.endswith(".hdr")].append(info)
            for pos, (payloads, sidecars) in found.items():
                for head in sidecars or [None]:
                    text = None if head is None else self._text(f"{folder}/{head.base_name}")
                    side = None if head is None else f"{folder}/{head.base_name}"
                    for p in payloads or [None]:
                        yield (run, pos, None, None, None, side, text) if p is None else (run, pos, f"{folder}/{p.base_name}", p.size, p.mtime, side, text)

    @staticmethod
    def _text(path: str) -> str:
        store, inside = located(path)
        with store.open_input_stream(inside, compression=None) as stream:
            return stream.read().decode(errors="replace")


class AddressStore(DataSource):
    """`runs/<run>/<number>-<name>` payloads and their `.hdr` sidecars below a folder, paired by number. Payloads are not read.

    A run's files are dealt over `shares` tasks (8), each of which lists the run and reads
    the sidecars of its share, so that no run's sidecars are read by one task.
    """

    @classmethod
    def name(cls) -> str:
        return "address_store"

    def schema(self) -> str:
        return FILES

    def reader(self, schema) -> StoreReader:
        return StoreReader(dict(self.options))


def store_files(spark: SparkSession, root: str) -> DataFrame:
    """(run, pos, payload, bytes, modified, sidecar, header) of an address store. Filters on run reach the listing; for this Spark's pushdown to Python sources is switched on in the session."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(AddressStore)
    return spark.read.format("address_store").load(root)


#: Bytes read at a time, and characters of entries in a batch.
CHUNK = 1 << 18
BATCH = 1 << 22
#: An error so near to the end of what was read may be text that goes on; a longer literal does not exist.
NEAR = 16


class Pieces:
    """The entries of JSON documents in a stream of bytes, without holding more of it than one entry and a chunk."""

    def __init__(self, stream) -> None:
        self.stream, self.decoder, self.scanner = stream, codecs.getincrementaldecoder("utf-8")(), json.JSONDecoder()
        self.text, self.at, self.ended, self.most = "", 0, False, 0

    def _more(self) -> bool:
        if self.ended:
            return False
        # As much again as is held, so that an entry is scanned a number of times that its length doubles in.
        got = self.stream.read(max(CHUNK, len(self.text) - self.at))
        self.ended = not got
        self.text, self.at = self.text[self.at :] + self.decoder.decode(got, self.ended), 0
        self.most = max(self.most, len(self.text))
        return True

    def peek(self) -> str:
        """The next character that is no space, '' at the end."""
        while True:
            self.at = _SPACE.match(self.text, self.at).end()
            if self.at < len(self.text):
                return self.text[self.at]
            if not self._more():
                return ""

    def take(self, wanted: str) -> str:
        got = self.peek()
        if not got or got not in wanted:
            raise ValueError(f"{got or 'end'!r} instead of one of {wanted!r}")
        self.at += 1
        return got

    def value(self) -> str:
        """The text of the next value."""
        self.peek()
        while True:
            try:
                _, end = self.scanner.raw_decode(self.text, self.at)
                # A number may go on behind what is read of it, as 1e-7 does behind 1e.
                if self.ended or self.text[end : end + 1] in _AFTER or len(self.text) - end > NEAR:
                    out, self.at = self.text[self.at : end], end
                    return out
            except json.JSONDecodeError as e:
                if self.ended or (len(self.text) - e.pos > NEAR and not e.msg.startswith("Unterminated string")):
                    raise
            self._more()

    def _listed(self, ends: str) -> Iterator[None]:
        """Stands before each entry of what has just been opened."""
        if self.peek() == ends:
            self.at += 1
            return
        while True:
            yield
            if self.take("," + ends) == ends:
                return

    def _name(self) -> str:
        name = json.loads(self.value())
        self.take(":")
        return name

    def entries(self, keys: dict[str, bool]) -> Iterator[tuple[str, str | None, int, str]]:
        """(key, name, seq, text) of the values of top-level keys: one for each element or named value where keys says so, else the value whole."""
        while self.peek():
            self.take("{")
            for _ in self._listed("}"):
                key = self._name()
                kind = self.peek()
                if kind not in ("[", "{") or keys.get(key) is False:
                    text = self.value()
                    if keys.get(key) is False:
                        yield key, None, 0, text
                    continue
                self.at += 1
                for seq, _ in enumerate(self._listed("]" if kind == "[" else "}")):
                    name = self._name() if kind == "{" else None
                    text = self.value()
                    if key in keys:
                        yield key, name, seq, text


_SPACE = re.compile(r"[ \t\r\n]*")
_AFTER = tuple(" \t\r\n,:]}")
ENTRIES = "file string, key string, name string, seq long, value string"


def _opened(path: str) -> Pieces:
    store, inside = located(path)
    return Pieces(store.open_input_stream(inside))


def _whole(path: str) -> bool:
    try:
        for _ in _opened(path).entries({}):
            pass
    except (ValueError, OSError, EOFError, zlib.error):
        return False
    return True


def _entries(batches: Iterator[pa.RecordBatch], keys: dict[str, bool], lenient: bool) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("file", pa.string()), ("key", pa.string()), ("name", pa.string()), ("seq", pa.int64()), ("value", pa.string())])
    for batch in batches:
        for path in batch.column("path").to_pylist():
            if lenient and not _whole(path):
                continue
            rows, size = [], 0
            for entry in _opened(path).entries(keys):
                rows.append((path, *entry))
                size += len(entry[-1])
                if size > BATCH or len(rows) >= 10_000:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                    rows, size = [], 0
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def document_entries(spark: SparkSession, path: str | list[str], keys: dict[str, bool], lenient: bool = False) -> DataFrame:
    """(file, key, name, seq, value): entries of JSON documents, plain or gzipped, as text: a row for each element or named value of the top-level keys that are true, one for the whole value of those that are false.

    Spark lists the files and deals them by size; a document of any length takes the memory
    of its longest entry. A document that cannot be read to its end is an error, or
    (lenient) left out whole, for which it is read twice. Empty documents and keys that
    are missing or null give no row.
    """
    files = spark.read.format("binaryFile").load(path).select("path")
    return files.mapInArrow(partial(_entries, keys=keys, lenient=lenient), ENTRIES)
