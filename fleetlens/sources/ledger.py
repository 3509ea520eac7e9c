"""Logs of JSON lines that are compacted while others read and append: a manifest says which files stand for which."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.sources.readers import _lines
from fleetlens.sources.sinks import MICROS

#: Folder of manifests and compacted files inside a log's folder; Spark's own readers pass over it.
INSIDE = "_log"

#: Names of Spark's files: the place in their append, and the append.
PART = re.compile(r"^part-(\d+)-([0-9a-f-]{36})")


class Folder:
    """A log's folder in whatever store Spark reads."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, name: str):
        return self._path(f"{self.path}/{name}")

    def files(self, name: str = "") -> list[tuple[str, int]]:
        """(name, modified) of the files in a folder, hidden ones left out."""
        where = self.at(name) if name else self._path(self.path)
        if not self.fs.exists(where):
            return []
        found = [(s.getPath().getName(), s.getModificationTime()) for s in self.fs.listStatus(where) if s.isFile()]
        return [(n, m) for n, m in found if not n.startswith(("_", "."))]

    def read(self, name: str) -> bytes:
        stream = self.fs.open(self.at(name))
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def create(self, name: str, data: bytes) -> bool:
        """Write a new file; False where there is one already."""
        try:
            stream = self.fs.create(self.at(name), False)
        except Py4JJavaError as e:
            if "AlreadyExists" in str(e.java_exception):
                return False
            raise
        stream.write(bytearray(data))
        stream.close()
        return True

    def delete(self, name: str) -> None:
        self.fs.delete(self.at(name), True)


def _manifest(folder: Folder) -> tuple[int, dict]:
    """Number and content of the newest whole manifest; one that was not written to its end does not count, but its number is taken."""
    taken, best = 0, {"base": [], "replaced": []}
    numbers = sorted(int(n.split(".")[0]) for n, _ in folder.files(INSIDE) if re.fullmatch(r"\d+\.manifest", n))
    for n in numbers:
        taken = n
        try:
            best = json.loads(folder.read(f"{INSIDE}/{n}.manifest"))
        except ValueError:
            continue
    return taken, best


def _in_order(files: list[tuple[str, int]]) -> list[str]:
    """Files in order of appending: appends by their first file's time, within one by number."""
    groups: dict[str, list[tuple[int, int, str]]] = {}
    for name, modified in files:
        m = PART.match(name)
        groups.setdefault(m[2] if m else name, []).append((int(m[1]) if m else 0, modified, name))
    ordered = sorted(groups.values(), key=lambda g: (min(m for _, m, _ in g), g[0][2]))
    return [name for g in ordered for _, _, name in sorted(g)]


def snapshot(spark: SparkSession, path: str) -> tuple[int, list[str], list[str]]:
    """(manifest number, files that stand for what was compacted, files appended since), in order, relative to path."""
    folder = Folder(spark, path)
    number, manifest = _manifest(folder)
    replaced = set(manifest["replaced"])
    return number, manifest["base"], _in_order([(n, m) for n, m in folder.files() if n not in replaced])


def read_log(spark: SparkSession, path: str, schema: str, strict: bool = True, files: list[str] | None = None) -> DataFrame:
    """Records of a log with place, block and line, in which order they stand as they were appended. A missing log is an empty one; torn lines are as in the other readers."""
    if files is None:
        _, base, new = snapshot(spark, path)
        files = [*base, *new]
    if not files:
        return spark.createDataFrame([], f"place int, block bigint, line bigint, {schema}")
    places = spark.createDataFrame([(f.rpartition("/")[2], i) for i, f in enumerate(files)], "_name string, place int")
    rows = _lines(spark, [f"{path.rstrip('/')}/{f}" for f in files], schema, strict)
    return rows.withColumn("_name", F.regexp_extract("file", "([^/]+)$", 1)).join(places, "_name").drop("_name", "file").select("place", "block", "line", *(c for c in rows.columns if c not in ("file", "block", "line")))


def append_log(records: DataFrame, path: str) -> None:
    """Append records as JSON lines, in their order."""
    records.write.mode("append").options(timestampFormat=MICROS, timestampNTZFormat=MICROS[:-3]).json(path)


def compact(spark: SparkSession, path: str, schema: str, keep: Callable[[DataFrame], DataFrame], over: int = 0) -> bool:
    """Put what keep leaves of a log in the place of its files, if it has over `over` records; whether that was done.

    The new files are written beside the log, and count from the moment that a manifest
    with the next number is there. What is appended meanwhile is no part of them and
    stays. Whatever ends this before the manifest leaves the log as it was; after it,
    readers have the new files. Of two at once the second gives up and clears what it wrote.
    Files that were replaced are left for readers that have begun: see vacuum.
    """
    folder = Folder(spark, path)
    number, base, new = snapshot(spark, path)
    records = read_log(spark, path, schema, False, [*base, *new])
    if records.count() <= over:
        return False
    own = f"{INSIDE}/base-{uuid.uuid4().hex}"
    kept = keep(records).orderBy("place", "block", "line").drop("place", "block", "line")
    kept.write.options(timestampFormat=MICROS, timestampNTZFormat=MICROS[:-3]).json(f"{path.rstrip('/')}/{own}")
    files = [f"{own}/{f}" for f in _in_order(folder.files(own))]
    there = {n for n, _ in folder.files()}
    replaced = sorted({*new, *(n for n in _manifest(folder)[1]["replaced"] if n in there)})
    if folder.create(f"{INSIDE}/{number + 1}.manifest", json.dumps({"base": files, "replaced": replaced}).encode()):
        return True
    folder.delete(own)
    return False


def vacuum(spark: SparkSession, path: str) -> int:
    """Delete what no reader that begins now reads: replaced files, other compacted folders and older manifests; how many. To be run when readers and compactions that began earlier are done."""
    folder = Folder(spark, path)
    number, manifest = _manifest(folder)
    there = {n for n, _ in folder.files()}
    gone = [n for n in manifest["replaced"] if n in there]
    used = {b.rpartition("/")[0] for b in manifest["base"]}
    where = folder.at(INSIDE)
    if folder.fs.exists(where):
        for s in folder.fs.listStatus(where):
            name = f"{INSIDE}/{s.getPath().getName()}"
            if s.isDirectory() and name not in used or re.fullmatch(rf"{INSIDE}/\d+\.manifest", name) and int(name[len(INSIDE) + 1 :].split(".")[0]) < number:
                gone.append(name)
    for name in gone:
        folder.delete(name)
    return len(gone)


def last_records(n: int) -> Callable[[DataFrame], DataFrame]:
    """The last n records of a log, for compact."""
    return lambda log: log.orderBy(F.col("place").desc(), F.col("block").desc(), F.col("line").desc()).limit(n)
