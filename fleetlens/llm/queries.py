"""The queries that apply this package's operators to the driver tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm import classifier, decontamination, divergence, fingerprints, language_model, license_scan, mixing, packing, periodic_runs, quality_rules, similarity_join, token_counts, token_files
from fleetlens.llm.common import documents, let, shared_dir
from fleetlens.llm.oracles import ORACLE as ORACLE


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_table(documents(spark, sf_dir))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(documents(spark, sf_dir))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.quality_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(documents(spark, sf_dir))


def op5_similarity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_join.similarity_classes(documents(spark, sf_dir))


def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.language_model(documents(spark, sf_dir))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end=1)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(documents(spark, sf_dir))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    token_files.write_token_files(documents(spark, sf_dir), path, public_tokenizers.path("byte_bpe_50k.json"), end=2)
    return token_files.read_token_files(spark, path)


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contaminated_spans(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10)
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["length"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_audit(documents(spark, sf_dir), least_docs=30, top=50)


def with_tail_repeated(docs: DataFrame) -> DataFrame:
    """(doc_id, text) where, with h = crc32(doc_id as text) and g = h / 10 in whole numbers, a text of n > 0 words with h % 10 = 0 has each word from a = g % n on replaced by those that follow a, 1 + (n - a) / (3 + g % 8) of them again and again. A null id changes nothing."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def changed(w):
        n = F.size(w)
        a = (g % n).cast("int")
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("int")
        tail = F.transform(F.sequence(a, n - 1), lambda i: F.get(w, a + (i - a) % p))
        return F.when(n > 0, F.array_join(F.concat(F.slice(w, F.lit(1), a), tail), " ")).otherwise("")

    return docs.select("doc_id", F.when(F.col("text").isNotNull() & (h % 10 == 0), let(quality_rules.words_of(F.col("text")), changed)).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(with_tail_repeated(documents(spark, sf_dir)), exponent=4, least=6)
    best = periodic_runs.strongest(F.col("runs"))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    runs = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    slim = found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), best.alias("best"), F.sha2(runs, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    exponent = F.call_function("div", 1000 * F.col("best.length"), F.col("best.period"))
    return slim.select("doc_id", "n_runs", "best.start", "best.length", "best.period", exponent.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_mixing, op2_quality_rules, op3_quality_classifier, op4_license_scan, op5_similarity_join, op6_language_model, op7_packing,
        op8_token_counts, op9_fingerprints, op10_token_files, op11_decontamination, op12_source_divergence, op13_periodic_runs,
    )
}
