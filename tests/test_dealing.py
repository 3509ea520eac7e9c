"""Rows are dealt to the tasks asked for, however small they are: joined by their size, tasks of large tables held ever more."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from fleetlens.plans import files
from fleetlens.plans import queries as fleet
from fleetlens.plans.tables import Tables

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are not here")


@pytest.fixture
def wide(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_written_tables(wide):
    t = Tables(wide, FOLDER)
    assert len(t.archive.inputFiles()) == 12 and len(t.part_file.inputFiles()) == 12


@pytest.mark.parametrize("name", ["copy_class"])
def test_copy_queries(wide, name):
    assert fleet.QUERIES[name](wide, FOLDER).rdd.getNumPartitions() == 12


def test_catalog_documents(spark):
    """A document for each host and month, gzipped, that holds every archive and every part."""
    t = Tables(spark, FOLDER)
    got = files.catalogs(t)
    docs = got["archive"].groupBy("catalog_id").agg(F.countDistinct("host", F.substring("run", 5, 7)).alias("n"), F.count("*").alias("archives"))
    rows = docs.agg(F.count("*").alias("docs"), F.max("n").alias("n"), F.sum("archives").alias("archives"), F.min(F.col("catalog_id").endswith(".gz")).alias("gzipped")).collect()[0]
    assert rows.n == 1 and rows.gzipped and rows.archives == t.archive.count()
    assert rows.docs == t.archive.select("host", F.substring("run", 5, 7)).distinct().count()
    assert got["part"].count() == t.part_file.count()
