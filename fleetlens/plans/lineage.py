"""Cutting lineage in loops, in the folder all executors share, and totals along an order that no task holds whole."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset a local session, as in tests, has a folder beside its warehouse; on a cluster it must be set."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    return path.rstrip("/")


def tasks(spark: SparkSession) -> int:
    """Tasks for rows that are small but cost much each: as many as a shuffle has. Given as a number, they are not joined by their size."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def cut(df: DataFrame) -> DataFrame:
    """df written once to the shared folder and read back: later rounds do not repeat earlier ones, a lost executor costs nothing that is written, and the planner knows the size."""
    path = f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_counting(df: DataFrame, condition: Column) -> tuple[DataFrame, int]:
    """cut(df) and how many of its rows meet the condition, counted while they are written."""
    seen = Observation()
    out = cut(df.observe(seen, F.count_if(condition).alias("n")))
    return out, seen.get["n"]


def preceding(df: DataFrame, keys: list[str], order: list[Column], aggregates: dict[str, tuple]) -> DataFrame:
    """df with columns name: function (F.sum or F.max) of a column over the rows of the same keys before this one; null for the first.

    Rows are dealt by ranges of (keys, order). A range is worked on within itself, and only
    a row for each key and range meets in one task, so a key may have any number of rows.
    The order must tell all rows of a key apart.
    """
    dealt = cut(df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()))
    totals = dealt.groupBy(*keys, "_range").agg(*(f(c).alias(f"_t_{name}") for name, (f, c) in aggregates.items()))
    ahead = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, "_range", *(f(f"_t_{name}").over(ahead).alias(f"_b_{name}") for name, (f, _) in aggregates.items()))
    within = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.select("*", *(f(c).over(within).alias(f"_w_{name}") for name, (f, c) in aggregates.items())).join(totals, [*keys, "_range"])

    def both(name: str, f) -> Column:
        a, b = F.col(f"_b_{name}"), F.col(f"_w_{name}")
        return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b if f is F.sum else F.greatest(a, b))

    return out.select(*df.columns, *(both(name, f).alias(name) for name, (f, _) in aggregates.items()))
