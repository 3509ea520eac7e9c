"""Readers of catalogs, logs, ledgers, member indexes and stores."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetlens.sources import schemas as S
from fleetlens.sources import store


def known(ts: str | Column) -> Column:
    """A timestamp with the unknown instant as null."""
    t = F.col(ts) if isinstance(ts, str) else ts
    return F.when(F.year(t) > 1, t)


def _entries(spark: SparkSession, path: str | list[str], key: str, schema: str, lenient: bool = False) -> DataFrame:
    """(file, name, seq, v) of the elements or named values of a top-level key, parsed."""
    rows = store.document_entries(spark, path, {key: True}, lenient)
    return rows.select("file", "name", F.col("seq").cast("int").alias("seq"), F.from_json("value", schema).alias("v"))


def read_catalog(spark: SparkSession, path: str | list[str]) -> dict[str, DataFrame]:
    """Tables of one or many catalog documents: archive, placement, part, volume, force_full, resolved_dle; catalog_id is the document's path.

    Documents are read as streams of their entries, each table only those that it is made
    of, so a document may be of any length. One that cannot be parsed is an error.
    """
    entries = _entries(spark, path, "entries", S.CATALOG_ENTRY).select(F.col("file").alias("catalog_id"), F.col("v").alias("e"))
    archive = entries.select("catalog_id", F.explode("e.run.archives").alias("a")).select("catalog_id", "a.*")
    archive = archive.withColumns({"created_at": known("created_at"), "parts": F.greatest(F.coalesce("parts", F.lit(1)), F.lit(1)), "base_run": F.when(F.col("base_run") != "", F.col("base_run"))})
    placed = entries.select("catalog_id", F.col("e.run.id").alias("run"), F.explode("e.placements").alias("p")).select("catalog_id", "run", "p.medium", F.explode("p.archives").alias("a"))
    placement = placed.select("catalog_id", "run", "medium", "a.dle", "a.level", F.size("a.parts").alias("parts"))
    # Seals belong to parts by place, and only where there is one for each.
    aligned = F.when(F.size("a.seals") == F.size("a.parts"), F.col("a.seals"))
    part = placed.select("catalog_id", "run", "medium", "a.dle", "a.level", aligned.alias("seals"), F.posexplode("a.parts").alias("part_no", "at"))
    part = part.select("catalog_id", "run", "medium", "dle", "level", "part_no", "at.label", "at.epoch", "at.pos", F.get("seals", "part_no").alias("s")).select("*", "s.size", "s.sha256", "s.raw_size").drop("s")
    volume = _entries(spark, path, "volumes", S.CATALOG_VOLUME).select(F.col("file").alias("catalog_id"), F.col("name").alias("label"), "v.label.pool", "v.label.epoch", known("v.label.written_at").alias("written_at"), "v.barcode", "v.used")
    force = _entries(spark, path, "dles", S.CATALOG_DLE).filter("v.force_full").select(F.col("file").alias("catalog_id"), F.col("name").alias("dle"))
    # The sources of the latest run: one value, as the run's name belongs to each.
    last = store.document_entries(spark, path, {"resolved": False}).select(F.col("file").alias("catalog_id"), F.from_json("value", S.CATALOG_RESOLVED).alias("v"))
    resolved = last.select("catalog_id", "v.run", F.explode("v.dles").alias("d")).select("catalog_id", "run", "d.*")
    return {"archive": archive, "placement": placement, "part": part, "volume": volume, "force_full": force, "resolved_dle": resolved}


def _lines(spark: SparkSession, path: str | list[str], schema: str, strict: bool) -> DataFrame:
    """Records of JSON line files, with file, block and line: in this order they stand as they were appended.

    Files are split like any text: block is the byte at which a split begins, line rises
    within it. A torn last line of a file is left out; a torn line before it is an error
    (strict), or left out too.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"), "value")
    # A record is whole if it parses as an object; the corrupt column of a permissive parse tells.
    parsed = lines.filter(F.trim("value") != "").withColumn("r", F.from_json("value", schema + ", _torn string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_torn"}))
    rows = parsed.withColumn("_bad", F.col("r").isNull() | F.col("r._torn").isNotNull())
    if strict:
        last = rows.groupBy("file").agg(F.max(F.struct("block", "line")).alias("_last"))
        message = F.concat(F.lit("torn line "), F.col("value"), F.lit(" in "), F.col("file"))
        inside = F.col("_bad") & (F.struct("block", "line") < F.col("_last"))
        rows = rows.join(F.broadcast(last), "file").withColumn("_bad", F.when(inside, F.raise_error(message).cast("boolean")).otherwise(F.col("_bad")))  # a row for each file
    return rows.filter("not _bad").select("file", "block", "line", "r.*").drop("_torn")


def read_run_log(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    return _lines(spark, path, S.RUN_LOG, strict)


def run_log_tables(run_log: DataFrame) -> dict[str, DataFrame]:
    """The arrays of run records as tables: dump_stat, landing_stat, drill_health."""
    dump = run_log.select("run_id", "ended_at", F.explode("dump_stats").alias("s")).select("run_id", "ended_at", "s.*")
    landing = run_log.select("run_id", F.explode("landing_stats").alias("s")).select("run_id", "s.*")
    drill = run_log.select("run_id", "ended_at", F.explode("drill_health").alias("s")).select("run_id", "ended_at", "s.*")
    return {"dump_stat": dump, "landing_stat": landing, "drill_health": drill}


def _or_empty(spark: SparkSession, schema: str, read) -> DataFrame:
    try:
        return read()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_usage(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Usage samples; a missing ledger is an empty history."""
    return _or_empty(spark, "file string, block bigint, line bigint, " + S.USAGE, lambda: _lines(spark, path, S.USAGE, strict))


def read_drill_ledger(spark: SparkSession, path: str) -> DataFrame:
    """A row for each source in the ledger; a missing file is an empty ledger."""
    docs = _or_empty(spark, f"file string, name string, seq int, v struct<{S.DRILL_RECORD}>", lambda: _entries(spark, path, "records", S.DRILL_RECORD))
    rows = docs.select(F.coalesce("v.dle", "name").alias("dle"), "v.last_drill", "v.tier", "v.medium", "v.as_of", "v.run_id", "v.ok", "v.class", "v.detail", "v.bytes", "v.drills")
    return rows.withColumn("last_drill", known("last_drill"))


def read_member_index(spark: SparkSession, path: str | list[str]) -> dict[str, DataFrame]:
    """Tables member, frame and unit of index files `<run>-<dle>-L<level>.idx.gz`, read as streams of their entries; a file that cannot be decoded to its end is left out."""
    name = r"(run-\d{4}-\d{2}-\d{2}\.\d+)-([^/]+)-L(\d+)\.idx"
    key = [F.regexp_extract("file", name, 1).alias("run"), F.regexp_extract("file", name, 2).alias("dle"), F.regexp_extract("file", name, 3).cast("int").alias("level")]
    member = _entries(spark, path, "members", "p string, o bigint", lenient=True).select(*key, "seq", F.col("v.p").alias("path"), F.col("v.o").alias("off"))
    frame = _entries(spark, path, "frames", "array<bigint>", lenient=True).select(*key, "seq", F.get("v", F.lit(0)).alias("raw"), F.get("v", F.lit(1)).alias("enc"))
    unit = _entries(spark, path, "units", S.INDEX_UNIT, lenient=True).select(*key, "v.*")
    return {"member": member, "frame": frame, "unit": unit}


def scan_store(spark: SparkSession, root: str) -> DataFrame:
    """(run, pos, payload, bytes, modified, sidecar, header columns) of an address store: `runs/<run>/<number>-<name>` payloads and their `.hdr` sidecars, paired by number.

    Payloads are listed only; their content is not read. A filter on run lists only the
    runs it lets through. A sidecar that is no JSON has nulls for its columns.
    """
    head = F.from_json("header", S.HEADER.replace("run string", "run_name string").replace("path string", "source_path string"))
    rows = store.store_files(spark, root).select("run", "pos", "payload", "bytes", "modified", "sidecar", head.alias("h"))
    return rows.select("run", "pos", "payload", "bytes", "modified", "sidecar", "h.*").drop("run_name")


def assemble(parts: DataFrame, commits: DataFrame, medium: str, pool: str = "") -> tuple[DataFrame, DataFrame]:
    """(placements, orphans) from scanned files.

    parts: run, dle, level, part, label, epoch, pos, pool. commits: run, dle, level, parts, part_map. An
    archive takes each part where it was scanned, else where its footer says; one with a gap is dropped.
    Volumes of another pool are passed over. Orphans are runs of parts without a footer, with labels.
    """
    key = ["run", "dle", "level"]
    own = parts.filter((F.coalesce("pool", F.lit("")) == "") | (F.col("pool") == pool)) if pool else parts
    wanted = commits.select(*key, "parts", "part_map", F.explode(F.sequence(F.lit(0), F.greatest(F.coalesce("parts", F.lit(1)), F.lit(1)) - 1)).alias("part"))
    seen = own.select(*key, "part", F.struct("label", "epoch", "pos").alias("at"))
    rows = wanted.join(seen, [*key, "part"], "left").withColumn("at", F.coalesce("at", F.get("part_map", "part")))
    placed = rows.groupBy(*key).agg(F.count("*").alias("parts"), F.count("at").alias("_found"), F.array_sort(F.collect_list(F.struct("part", "at"))).alias("at"))
    placed = placed.filter("_found = parts").select(*key, F.lit(medium).alias("medium"), "parts", F.transform("at", lambda x: x["at"]).alias("positions"))
    orphans = own.join(commits.select(*key), key, "left_anti").groupBy("run").agg(F.sort_array(F.collect_set(F.when(F.col("label") != "", F.col("label")))).alias("labels"), F.count("*").alias("files"))
    return placed, orphans


def rebuild_report(placements: DataFrame, orphans: DataFrame, known_runs: DataFrame) -> DataFrame:
    """(runs, unresolved): runs found by a scan, and orphan runs that no catalog knows."""
    runs = placements.agg(F.countDistinct("run").alias("runs"))
    left = orphans.join(known_runs.unionByName(placements.select("run")).distinct(), "run", "left_anti").agg(F.count("*").alias("unresolved"))
    return runs.join(left, F.lit(True))


def dims(spark: SparkSession, media: list[tuple], routes: list[tuple], rules: list[tuple]) -> dict[str, DataFrame]:
    """Configuration as dimension tables: medium_dim, route, sync_rule."""
    return {
        "medium_dim": spark.createDataFrame(media, "medium string, type string, capacity bigint, min_age_days int, labeled boolean"),
        "route": spark.createDataFrame(routes, "dle string, medium string, ord int"),
        "sync_rule": spark.createDataFrame(rules, "src string, dst string, last_n int"),
    }


#: List prices by URL scheme, dollars a GiB and month, a GiB read, and 1000 reads.
RATES = [("aws-s3", 0.023, 0.09, 0.0004), ("local", 0.0, 0.0, 0.0)]


def cost_rate(spark: SparkSession, media: list[tuple[str, str]], overrides: list[tuple] = ()) -> DataFrame:
    """(medium, gib_month, gib_egress, per_1000): rates by each medium's scheme; overrides (medium, the three rates or null) come first."""
    base = spark.createDataFrame(media, "medium string, scheme string").join(spark.createDataFrame(RATES, "scheme string, gib_month double, gib_egress double, per_1000 double"), "scheme", "left")
    own = spark.createDataFrame(list(overrides), "medium string, m double, e double, g double")
    return base.join(own, "medium", "left").select("medium", F.coalesce("m", "gib_month", F.lit(0.0)).alias("gib_month"), F.coalesce("e", "gib_egress", F.lit(0.0)).alias("gib_egress"), F.coalesce("g", "per_1000", F.lit(0.0)).alias("per_1000"))
