"""Queries over files: the driver's tables are written as the documents, logs, indexes and stores that the readers read, and read back."""

from __future__ import annotations

import hashlib
import json
import tarfile
import uuid
import zlib
from collections.abc import Iterator
from functools import cached_property
from itertools import groupby

import pandas as pd
import pyarrow.fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.operators import verify
from fleetlens.plans.lineage import cut, shared_dir, tasks
from fleetlens.plans.queries import RUN_LOG, query, run_log
from fleetlens.plans.tables import Tables, with_views
from fleetlens.sources import ledger, readers, schemas, sinks


def folder(t: Tables, name: str) -> str:
    """A new folder of the shared one."""
    return f"{shared_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


@query(f"select cast(id as string) as run_id, command, outcome, moved as bytes_moved, warns as warned, ts as ended_at from {RUN_LOG}")
def run_log_files(t: Tables) -> DataFrame:
    """The run log appended to JSON line files and read back."""
    path = folder(t, "run-log")
    sinks.append_run_log(run_log(t), path, path + "-latest")
    return readers.read_run_log(t.spark, path).select("run_id", "command", "outcome", "bytes_moved", (F.size("warnings") > 0).alias("warned"), F.col("ended_at").cast("timestamp_ntz").alias("ended_at"))


@query(f"with b as (select id from {RUN_LOG} where id % 3 < 2 order by id % 3 desc, id desc limit 100) select cast(id as string) as run_id, command from {RUN_LOG} where id in (select id from b) or id % 3 = 2")
def compact_run_log(t: Tables) -> DataFrame:
    """A run log of two appends compacted to its last hundred records, and one more append read with them."""
    path = folder(t, "compacted-log")
    log = run_log(t).withColumn("_id", F.col("run_id").cast("int"))
    for k in (0, 1):
        ledger.append_log(log.filter(F.col("_id") % 3 == k).orderBy("_id").drop("_id"), path)
    ledger.compact(t.spark, path, schemas.RUN_LOG, ledger.last_records(100), over=100)
    ledger.append_log(log.filter("_id % 3 = 2").drop("_id"), path)
    ledger.vacuum(t.spark, path)
    return ledger.read_log(t.spark, path, schemas.RUN_LOG).select("run_id", "command")


@query("select medium, \"at\", used, cast(seq % 7 as int) as runs from usage_sample")
def usage_files(t: Tables) -> DataFrame:
    """The usage ledger as JSON lines, read back."""
    path = folder(t, "usage")
    t.usage_sample.select(F.col("at").cast("timestamp").alias("at"), "medium", "used", (F.col("seq") % 7).cast("int").alias("runs")).write.option("timestampFormat", sinks.MICROS).json(path)
    return readers.read_usage(t.spark, path).select("medium", F.col("at").cast("timestamp_ntz").alias("at"), "used", "runs")


@query("select dle, last_drill, ok, class, cast(drills as int) as drills from drill_ledger")
def drill_files(t: Tables) -> DataFrame:
    """The drill ledger as documents of a map from source to record, read back."""
    path = folder(t, "drills")
    record = F.struct("dle", F.col("last_drill").cast("timestamp").alias("last_drill"), "ok", "class", F.col("drills").cast("int").alias("drills"))
    docs = t.drill_ledger.groupBy(F.pmod(F.xxhash64("dle"), F.lit(64)).alias("b")).agg(F.map_from_entries(F.collect_list(F.struct("dle", record.alias("r")))).alias("records"))
    docs.select("records").write.option("maxRecordsPerFile", 1).option("timestampFormat", sinks.MICROS).json(path)
    return readers.read_drill_ledger(t.spark, path).select("dle", F.col("last_drill").cast("timestamp_ntz").alias("last_drill"), "ok", "class", "drills")


def catalogs(t: Tables) -> dict[str, DataFrame]:
    """A catalog document for each host and month, written and read back."""
    path = folder(t, "catalogs")
    key, n = ["host", "month", "run"], tasks(t.spark)
    month = F.substring("run", 5, 7).alias("month")
    archive = t.archive.withColumn("created_at", F.col("created_at").cast("timestamp")).select("host", month, "run", F.struct("run", "dle", "host", "path", "level", "compressed", "uncompressed", "file_count", "unreadable", "base_run", "created_at").alias("a"))
    # Parts are dealt by archive once, for their copies and the archive's host, and copies by document once, for all that is nested in it.
    at = F.struct(F.struct("label", F.lit(1).alias("epoch"), "pos").alias("at"), F.struct("size", F.lit("x").alias("sha256"), (F.col("size") * 2).alias("raw_size")).alias("seal"))
    parts = t.part_file.repartition(n, "arch_key").groupBy("arch_key", "run", "dle", "level", "medium").agg(F.array_sort(F.collect_list(F.struct("part_no", at.alias("x")))).alias("p"))
    placed = parts.join(t.archive.select("arch_key", "host"), "arch_key")
    placed = placed.select("host", month, "run", "medium", F.struct("dle", "level", F.transform("p", lambda p: p["x"]["at"]).alias("parts"), F.transform("p", lambda p: p["x"]["seal"]).alias("seals")).alias("c"))
    rows = archive.unionByName(placed, allowMissingColumns=True).repartition(n, "host", "month")
    media = rows.groupBy(*key, "medium").agg(F.collect_list("a").alias("archives"), F.collect_list("c").alias("copies"))
    placement = F.when(F.col("medium").isNotNull(), F.struct("medium", F.col("copies").alias("archives")))
    runs = media.groupBy(*key).agg(F.flatten(F.collect_list("archives")).alias("archives"), F.collect_list(placement).alias("placements"))
    entry = F.struct(F.struct(F.col("run").alias("id"), "archives").alias("run"), "placements")
    docs = runs.groupBy("host", "month").agg(F.collect_list(entry).alias("entries"))
    docs.select("entries").write.option("maxRecordsPerFile", 1).option("compression", "gzip").option("timestampFormat", sinks.MICROS).json(path)
    return readers.read_catalog(t.spark, path)


@query("select run, dle, host, level, compressed, base_run, created_at, 1 as parts from archive")
def catalog_archives(t: Tables) -> DataFrame:
    return catalogs(t)["archive"].select("run", "dle", "host", "level", "compressed", "base_run", F.col("created_at").cast("timestamp_ntz").alias("created_at"), "parts")


@query("select run, medium, dle, level, part_no, label, 1 as epoch, pos, size, size * 2 as raw_size from part_file")
def catalog_parts(t: Tables) -> DataFrame:
    return catalogs(t)["part"].select("run", "medium", "dle", "level", "part_no", "label", "epoch", "pos", "size", "raw_size")


@query("select concat('run-2024-01-0', cast(level + 1 as string), '.1') as run, dle, level, cast(row_number() over (partition by dle, level order by seq) - 1 as int) as seq, path, off from member")
def member_index_files(t: Tables) -> DataFrame:
    """Member indexes as gzipped documents in folders that carry their names, read back."""
    path = folder(t, "indexes")
    members = F.transform(F.array_sort(F.collect_list(F.struct("seq", F.col("path").alias("p"), F.col("off").alias("o")))), lambda m: F.struct(m["p"].alias("p"), m["o"].alias("o")))
    name = F.concat(F.lit("run-2024-01-0"), (F.col("level") + 1).cast("string"), F.lit(".1-"), F.col("dle"), F.lit("-L"), F.col("level").cast("string"), F.lit(".idx"))
    docs = t.member.groupBy("dle", "level").agg(members.alias("members")).select(name.alias("f"), "members")
    docs.write.partitionBy("f").option("compression", "gzip").json(path)
    return readers.read_member_index(t.spark, path)["member"].select("run", "dle", "level", "seq", "path", "off")


@query("select medium, case medium when 'cloud' then 0.023::double else 0.0::double end as gib_month, case medium when 'cloud' then 0.09::double when 'tape' then 0.02::double else 0.0::double end as gib_egress, case medium when 'cloud' then 0.0004::double else 0.0::double end as per_1000, count(*) as copies from placement group by medium")
def cost_rates(t: Tables) -> DataFrame:
    """Rates of the media in use, by scheme, one of them set by hand."""
    rates = readers.cost_rate(t.spark, [("disk", "local"), ("cloud", "aws-s3"), ("tape", "other")], [("tape", None, 0.02, None)])
    return t.placement.groupBy("medium").agg(F.count("*").alias("copies")).join(F.broadcast(rates), "medium").select("medium", "gib_month", "gib_egress", "per_1000", "copies")


def _write(uri: str, data: bytes) -> None:
    store, path = pyarrow.fs.FileSystem.from_uri(uri)
    store.create_dir(path.rpartition("/")[0])
    with store.open_output_stream(path) as out:
        out.write(data)


def _store(batches: Iterator[pd.DataFrame], root: str) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for run, pos, dle, size, odd in batch[["run", "pos", "dle", "size", "odd"]].itertuples(index=False):
            name = f"{root}/runs/{run}/{pos:06d}-{dle}.tar"
            if odd != 1:
                _write(name, b"x" * int(size))
            if odd != 2:
                _write(name + ".hdr", json.dumps({"run": run, "kind": "archive", "dle": dle, "level": 0, "part": 0}).encode())
        yield batch[["run"]].head(0)


#: A file for each month and host, its size the number of archives of the host in it.
STORED = "(select substr(run, 5, 7) as run, host as dle, count(*) as size, cast(substr(host, 2) as int) as pos, (cast(substr(host, 2) as int) + cast(substr(run, 10, 2) as int)) % 9 as odd from archive group by 1, 2, 4, 5) st"


@query(f"select run, pos, case when odd <> 1 then size end as bytes, case when odd <> 2 then dle end as dle, (odd = 1) <> (odd = 2) as torn from {STORED}")
def store_scan(t: Tables) -> DataFrame:
    """An address store of payloads and sidecars, some of them torn, scanned."""
    root = folder(t, "store")
    host = F.substring("host", 2, 9).cast("int")
    rows = t.archive.groupBy(F.substring("run", 5, 7).alias("run"), F.col("host").alias("dle"), host.alias("pos"), ((host + F.substring("run", 10, 2).cast("int")) % 9).alias("odd")).agg(F.count("*").alias("size"))
    cut(rows.mapInPandas(lambda b: _store(b, root), "run string"))
    found = readers.scan_store(t.spark, root)
    return found.select("run", "pos", "bytes", "dle", (F.col("payload").isNull() | F.col("sidecar").isNull()).alias("torn"))


#: Where the first part of a tar ends and the second begins.
SPLIT = 700

#: The header of a file without name and bytes, and the sum of its bytes beside those of the size.
BLANK = tarfile.TarInfo().tobuf(tarfile.USTAR_FORMAT)
BLANK_SUM = int(BLANK[148:154], 8) - sum(b"0" * 11)


def _header(name: str, size: int) -> bytes:
    """What tarfile writes before a file of a short name: there is one for each archive of the driver's tables."""
    own, digits = name.encode(), b"%011o" % size
    return own + BLANK[len(own) : 124] + digits + BLANK[135:148] + b"%06o" % (BLANK_SUM + sum(own) + sum(digits)) + BLANK[154:]


class Packed:
    """A tar archive gzipped as it is made, in two parts that are unpacked one behind another: memory holds what is packed."""

    def __init__(self) -> None:
        self.size, self.todo = 0, bytearray()
        self.packers = [zlib.compressobj(1, zlib.DEFLATED, 31) for _ in range(2)]
        self.parts = [bytearray(), bytearray()]

    def _pack(self) -> None:
        first = max(0, SPLIT - self.size)
        for no, data in enumerate((self.todo[:first], self.todo[first:])):
            self.parts[no] += self.packers[no].compress(data)
        self.size += len(self.todo)
        self.todo.clear()

    def add(self, name: str, size: int) -> None:
        self.todo += _header(name, size) + b"y" * size + bytes(-size % tarfile.BLOCKSIZE)
        if len(self.todo) > 1 << 16:
            self._pack()

    def close(self) -> list[bytes]:
        end = 2 * tarfile.BLOCKSIZE
        self.todo += bytes(end + -(self.size + len(self.todo) + end) % tarfile.RECORDSIZE)
        self._pack()
        return [bytes(part + packer.flush()) for part, packer in zip(self.parts, self.packers, strict=True)]


def _tars(batches: Iterator[pd.DataFrame], root: str) -> Iterator[pd.DataFrame]:
    """Writes the tar of each archive once for each of its copies, in two parts, the second with the copy's fault, and gives what a catalog records of them. An archive's rows come together: its copies (member false, medium as name, fault as size), then its members in order."""
    rows = (r for batch in batches for r in batch[["run", "dle", "member", "name", "size"]].itertuples(index=False, name=None))
    for (run, dle), own in groupby(rows, key=lambda r: r[:2]):
        tar, copies = Packed(), []
        for _, _, member, name, size in own:
            if not member:
                copies.append((name, size))
            elif copies:
                tar.add(name, size)
        parts, out = tar.close(), []
        whole, stored = hashlib.sha256(b"".join(parts)).hexdigest(), sum(map(len, parts))
        for medium, fault in copies:
            sealed = fault not in (2, 5)
            for no, part in enumerate(parts):
                uri = f"{root}/{medium}/{run}/{dle}.{no}"
                # The byte changed is one that unpacking does not look at: the fifth, of a time.
                changed = part[:4] + b"?" + part[5:] if no == 1 and fault in (1, 5) else part[: len(part) // 2] if no == 1 and fault == 2 else part
                if not (fault == 3 and no == 0):
                    _write(uri, changed)
                out.append((run, dle, 0, medium, no, uri, len(part), hashlib.sha256(part).hexdigest() if sealed else None, whole, stored))
        yield pd.DataFrame(out, columns=["run", "dle", "level", "medium", "part_no", "uri", "size", "sha256", "whole", "stored"])


#: An archive for each host and month, named in SQL that both engines read, with two copies. fault of a copy: 1 a byte changed, 2 cut short without seals, 3 a part gone, 4 no position, 5 a byte changed without seals. index of an archive: 6 lacks a member, 7 not counted, 9 none. Runs of a December have no copy.
HOST_MONTH = "(select concat('run-', substr(run, 5, 7)) as run, host as dle, cast(substr(host, 2) as int) as h, cast(substr(run, 10, 2) as int) as mo, count(*) as members from archive group by 1, 2, 3, 4) hm"
COPIES = f"(select run, dle, 0 as level, members, (h + mo) % 10 as idx, (h + 3 * mo + 2 * m) % 7 as fault, case when (h + mo + m) % 11 = 0 then 'vault' when m = 0 then 'disk' else 'tape' end as medium, m, h, mo from {HOST_MONTH}, (values (0), (1)) as v(m) where mo <> 12) cp"
CLASS = "case when medium = 'vault' then '' when fault = 4 then 'missing' when fault in (2, 3) then 'pipeline' when fault = 1 or idx = 6 or fault = 5 then 'integrity' else '' end"


class Stored:
    """Copies written as files, gzipped, and what is recorded of them: parts, archive, placement and the members index. read: what reading the copies found, their members too with listing."""

    def __init__(self, t: Tables, listing: bool = True) -> None:
        root = folder(t, "copies")
        # The archives are read three times, for a few columns: those are written, not the table.
        self.files = cut(t.sql("select concat('run-', substr(run, 5, 7)) as run, host, concat(dle, '/', run) as name, compressed % 900 as size from archive"))
        view = f"files_{uuid.uuid4().hex}"
        self.files.createOrReplaceTempView(view)
        here = lambda text: cut(t.sql(text.replace("from archive", f"from {view}")))
        copies = here(f"select run, dle, level, members, idx, fault, medium from {COPIES}")
        self.about = here(f"select run, dle, members, (h + mo) % 10 as idx from {HOST_MONTH}")
        heads = copies.filter("medium <> 'vault'").select("run", "dle", F.lit(False).alias("member"), F.col("medium").alias("name"), F.col("fault").cast("long").alias("size"))
        rows = heads.unionByName(self.files.select("run", F.col("host").alias("dle"), F.lit(True).alias("member"), "name", "size"))
        rows = rows.repartition(tasks(t.spark), "run", "dle").sortWithinPartitions("run", "dle", "member", "name")
        written = cut(rows.mapInPandas(lambda b: _tars(b, root), "run string, dle string, level int, medium string, part_no int, uri string, size long, sha256 string, whole string, stored long"))
        self.parts = written.join(copies.filter("fault = 4").select("run", "dle", "medium"), ["run", "dle", "medium"], "left_anti")
        self.placement = copies.select("run", "dle", "level", "medium")
        sums = written.groupBy("run", "dle").agg(F.max("whole").alias("sha256"))
        self.archive = self.about.join(sums, ["run", "dle"], "left").select("run", "dle", F.lit(0).alias("level"), "sha256", F.when(F.col("idx") == 7, 0).otherwise(F.col("members")).alias("file_count"), F.lit("gzip").alias("compress"))
        self.media = t.spark.createDataFrame([("disk",), ("tape",)], "medium string")
        self.read = verify.read_copies(self.parts, self.archive, listing)

    @cached_property
    def member(self) -> DataFrame:
        # Each member is a header and its bytes in whole blocks; one of another name stands for what an index lacks.
        order = Window.partitionBy("run", "dle").orderBy("name")
        room = (512 + 512 * F.ceil(F.col("size") / 512)).cast("long")
        at = self.files.withColumnRenamed("host", "dle").withColumns({"off": F.coalesce(F.sum(room).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")), "i": F.row_number().over(order) - 1})
        index = at.join(self.about.select("run", "dle", "idx"), ["run", "dle"]).filter("idx <> 9").withColumn("path", F.when(F.col("idx").isin(6, 7) & (F.col("i") == 0), "gone").otherwise(F.col("name")))
        return cut(index.select("run", "dle", F.lit(0).alias("level"), "path", "off"))


@query(f"select run, dle, medium, no as part_no, case when fault = 3 and no = 0 then 'pipeline' when fault in (2, 5) then 'skipped' when fault = 1 and no = 1 then 'integrity' else 'ok' end as verdict from {COPIES}, (values (0), (1)) as p(no) where medium <> 'vault' and fault <> 4")
def verify_parts(t: Tables) -> DataFrame:
    """Every stored part against its recorded size and checksum."""
    s = Stored(t, listing=False)
    return verify.verify_parts(s.read, s.parts).select("run", "dle", "medium", "part_no", "verdict")


@query(
    f"select run, dle, medium, {CLASS} as class, medium = 'vault' as skipped, structural, checksum from (select *, case when medium = 'vault' or fault = 4 then null when fault in (2, 3) then 'pipeline' when fault = 1 or idx = 6 then 'integrity' else '' end as structural,"
    " case when medium = 'vault' or fault = 4 then null when fault = 3 then 'pipeline' when fault in (1, 2, 5) then 'integrity' else '' end as checksum from " + COPIES + ") z union all select run, null, null, 'missing', false, null, null from " + HOST_MONTH + " where mo = 12 group by run"
)
def verify_archives(t: Tables) -> DataFrame:
    """Every copy, listed and hashed in one pass, with the verdicts of both checks alone beside that of both together."""
    s = Stored(t)
    deep = verify.verify_archives(s.read, s.parts, s.archive, s.placement, s.member, s.media).drop("bytes")
    alone = verify.structural_verdict(s.read, s.parts, s.archive, s.member).withColumnRenamed("class", "structural").join(verify.checksum_verdict(s.read, s.parts, s.archive).withColumnRenamed("class", "checksum"), verify.COPY)
    return deep.join(alone, verify.COPY, "left").select("run", "dle", "medium", "class", "skipped", "structural", "checksum")


@query(f"select run, dle, medium, case when fault in (2, 3) then 'pipeline' when fault = 1 or idx = 6 then 'integrity' else '' end as class from {COPIES} where medium <> 'vault' and fault <> 4")
def structural_verdicts(t: Tables) -> DataFrame:
    """Members of every copy, listed as it is read, against the index."""
    s = Stored(t)
    return verify.structural_verdict(s.read, s.parts, s.archive, s.member).select("run", "dle", "medium", "class")


@query(
    f"""with v as (select run, dle, medium, {CLASS} as class, medium = 'vault' as skipped from {COPIES}), c as (select run, medium, count(*) filter (where class <> '') as n, bool_and(skipped) as skipped from v group by run, medium),
    r as (select run, sum(n)::bigint as failures, coalesce(string_agg(medium, ',' order by medium) filter (where n = 0 and not skipped), '') as good, coalesce(string_agg(medium, ',' order by medium) filter (where n > 0), '') as bad, coalesce(string_agg(medium, ',' order by medium) filter (where skipped), '') as skipped from c group by run),
    a as (select run, count(distinct dle) as archives from v where not skipped group by run)
    select run, case when failures > 0 then case when good <> '' then 'repairable' else 'failed' end when good = '' and skipped <> '' then 'skipped' else 'ok' end as status, coalesce(archives, 0)::bigint as archives, failures, good, bad, skipped from r left join a using (run)
    union all select run, 'failed', 0::bigint, 1::bigint, '', '', '' from {HOST_MONTH} where mo = 12 group by run"""
)
def verify_report(t: Tables) -> DataFrame:
    """Verdicts of all copies, by run."""
    s = Stored(t)
    return verify.verify_report(verify.verify_archives(s.read, s.parts, s.archive, s.placement, s.member, s.media)).drop("bytes")
