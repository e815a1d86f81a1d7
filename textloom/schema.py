"""Tables of the content model, and blocks made from plain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.runs import RUNS

BLOCKS = (
    "doc_id string, seq long, block_id string, collection string, role string, level int, translatable boolean,"
    f" source_locale string, source {RUNS}, source_text string, targets map<string,string>, properties map<string,string>"
)
EDGES = "source_id string, target_id string, label string, valid_from timestamp, valid_to timestamp, tags map<string,string>"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def blocks_of_documents(docs: DataFrame) -> DataFrame:
    """A block per line of a document that holds more than white space."""
    lines = docs.select(
        F.col("doc_id").cast("string").alias("doc_id"), "lang", "source", F.posexplode(F.split("text", "\n")).alias("seq", "source_text")
    ).filter(F.col("source_text").rlike(r"(?U)\S"))
    return lines.select(
        "doc_id",
        F.col("seq").cast("long").alias("seq"),
        F.concat_ws(":", "doc_id", "seq").alias("block_id"),
        F.col("source").alias("collection"),
        F.when(F.col("seq") == 0, "heading").otherwise("paragraph").alias("role"),
        F.lit(None).cast("int").alias("level"),
        F.lit(True).alias("translatable"),
        F.col("lang").alias("source_locale"),
        "source_text",
    )
