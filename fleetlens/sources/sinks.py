"""Writers and compaction of logs and ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions import columns as C


#: Timestamps as they are written: none of their digits is lost.
MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def append_run_log(run_log: DataFrame, path: str, latest: str | None = None) -> None:
    """Append records as JSON lines, and write the newest one as the summary."""
    run_log.write.mode("append").options(timestampFormat=MICROS, timestampNTZFormat=MICROS[:-3]).json(path)
    if latest:
        run_log.orderBy(F.col("ended_at").desc()).limit(1).write.mode("overwrite").options(timestampFormat=MICROS, timestampNTZFormat=MICROS[:-3]).json(latest)


def compact_run_log(run_log: DataFrame, n: int = 1000) -> DataFrame:
    """The last n records in order of appending (file, block, line)."""
    return run_log.orderBy(F.col("file").desc(), F.col("block").desc(), F.col("line").desc()).limit(n)


def thin_usage(usage: DataFrame, now: Column, age_days: int = 30, cap: int = 5000) -> DataFrame:
    """All samples of age_days or younger, and of older ones the last of each medium and UTC day; a ledger of at most cap samples stays as it is."""
    last = Window.partitionBy("medium", F.to_date("at")).orderBy(F.col("at").desc(), F.col("seq").desc())
    size = F.broadcast(usage.agg(F.count("*").alias("_n")))
    young = C.epoch(now) - C.epoch("at") <= age_days * 86400
    rows = usage.join(size, F.lit(True)).withColumn("_r", F.row_number().over(last))
    return rows.filter((F.col("_n") <= cap) | young | (F.col("_r") == 1)).drop("_n", "_r")
