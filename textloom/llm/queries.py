"""The queries of the training-data operators and, where SQL can express one, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    exact_dedup,
    fill_middle,
    license_scan,
    line_dedup,
    lm_scoring,
    mixing,
    packing,
    periodic_runs,
    quality,
    simhash_dedup,
    substring_dedup,
    topk_search,
    url_filters,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents"), keep_text=False)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document: posterior of its labellers' votes, score and whether it is kept."""
    found = quality.classify(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "votes", "posterior", "score", "insulting", F.col("good").alias("kept"))


def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), stays="max")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents")).drop("spans")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document and epoch with its block's window and slot in the mixture."""
    return mixing.mix_sources(table(spark, sf_dir, "documents").select("doc_id", "source")).drop("row").withColumnRenamed("id", "doc_id")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document: its text without repeated lines."""
    return line_dedup.line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document: losses under the models of good labelled documents and of all documents."""
    good = table(spark, sf_dir, "labels").filter("quality = 1 and toxic = 0")
    found = lm_scoring.cross_entropy_difference(table(spark, sf_dir, "documents"), good)
    return found.select("doc_id", "n_tokens", *[F.round(c, 6).alias(c) for c in ("target_loss", "background_loss", "score")])


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash_dedup.simhash_groups(table(spark, sf_dir, "documents"))
    return groups.select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def op11_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = url_filters.labelled_pages(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))
    return url_filters.url_filter(pages).withColumnRenamed("id", "page_id").withColumn("purity", F.round("purity", 6))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document: the lengths of its parts, and digests of its output and of the text restored from that."""
    rows = fill_middle.fill_in_middle(table(spark, sf_dir, "documents"))
    return rows.select(
        F.col("id").alias("doc_id"),
        "n",
        "form",
        F.length("prefix").cast("long").alias("prefix_chars"),
        F.length("middle").cast("long").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fill_middle.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document: its strongest run, and digests of all runs and of the text without what they repeat."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = periodic_runs.periodic_runs(docs.withColumn("text", periodic_runs.repeated_tail(F.col("doc_id"), F.col("text"))))
    line = "array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')"
    return rows.select(
        F.col("id").alias("doc_id"),
        F.size("runs").cast("long").alias("n_runs"),
        "strongest.start",
        "strongest.length",
        "strongest.period",
        F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
        F.sha2(F.expr(line), 256).alias("runs_sha256"),
        F.sha2("text", 256).alias("collapsed_sha256"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_substring_dedup": op1_substring_dedup,
        "op2_quality_classifier": op2_quality_classifier,
        "op3_topk_search": op3_topk_search,
        "op4_exact_dedup": op4_exact_dedup,
        "op5_license_scan": op5_license_scan,
        "op6_best_fit_packing": op6_best_fit_packing,
        "op7_source_mixing": op7_source_mixing,
        "op8_line_dedup": op8_line_dedup,
        "op9_lm_scoring": op9_lm_scoring,
        "op10_simhash_near_dedup": op10_simhash_near_dedup,
        "op11_url_filters": op11_url_filters,
        "op12_fill_in_middle": op12_fill_in_middle,
        "op13_periodic_runs": op13_periodic_runs,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_substring_dedup": substring_dedup.ORACLE,
        "op3_topk_search": topk_search.ORACLE,
        "op4_exact_dedup": exact_dedup.ORACLE,
        "op5_license_scan": license_scan.oracle(),
        "op7_source_mixing": mixing.oracle(),
        "op9_lm_scoring": lm_scoring.ORACLE,
        "op11_url_filters": url_filters.oracle(),
        "op12_fill_in_middle": fill_middle.ORACLE,
        "op13_periodic_runs": periodic_runs.ORACLE,
    }
