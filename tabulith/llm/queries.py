"""Queries over the text tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulith.llm import contamination, packing, reading_level


def _read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    """Each post's container and place."""
    tokenizer = spark.conf.get("tabulith.tokenizer", packing.TOKENIZER)
    return packing.pack(packing.token_counts(_read(spark, d, "documents"), "doc_id", "text", tokenizer), "doc_id", "n_tokens")


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """Number of containers by unused tokens."""
    used = p7_containers(spark, d).where("n_tokens > 0").groupBy("container").agg(F.sum("n_tokens").alias("used"))
    return used.groupBy((packing.CAPACITY - F.col("used")).alias("unused")).agg(F.count("*").alias("n_containers"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Posts that hold a passage of an evaluation item."""
    return contamination.leaked(_read(spark, d, "documents"), _read(spark, d, "eval_items")).select("doc_id", "item_id")


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    """Evaluation items that leaked, with the number of posts."""
    return p8_found(spark, d).groupBy("item_id").agg(F.count("*").alias("n_docs"))


def p9_levels(spark: SparkSession, d: str) -> DataFrame:
    """Own words, score and level of each post."""
    return reading_level.reading_levels(_read(spark, d, "documents"), _read(spark, d, "reading_labels"), _read(spark, d, "eval_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """English posts of at least thirty own words whose prose is of level 4 or 5."""
    return p9_levels(spark, d).where((F.col("own_words") >= reading_level.LEAST_WORDS) & F.col("english") & (F.col("level") >= 3.5)).select("doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p7_containers, p7_fill, p8_found, p8_items, p9_levels, p9_found)}


def oracle_sql() -> dict[str, str]:
    """None: tokenizers, SimHash verification and trained models have no SQL form; the tests check them by brute force and held-out data."""
    return {}
