"""Copies of the test tables that are empty, or have NULLs in every column, repeated rows and ties."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import functions as F

TABLES = ("table_metadata", "table_schemas", "snapshots", "snapshot_refs", "manifest_files", "ingest_runs", "data_rows", "manifest_lists_raw", "documents", "eval_items", "reading_labels")


def empty(spark, folder: Path, source: str) -> str:
    for n in TABLES:
        spark.read.parquet(f"{source}/{n}.parquet").limit(0).coalesce(1).write.parquet(f"file://{folder}/{n}.parquet")
    return f"file://{folder}"


def nulled(spark, folder: Path, source: str, share: int = 4) -> str:
    """In each column every ``share``-th value, by a hash of the row and the column, is NULL; a third of the rows come twice; there is an extra column."""
    for n in TABLES:
        df = spark.read.parquet(f"{source}/{n}.parquet")
        row = F.xxhash64(*[F.col(c).cast("string") if "map" not in t and "array" not in t else F.to_json(F.struct(c)) for c, t in df.dtypes])
        df = df.withColumn("_row", row)
        df = df.select("_row", *[F.when(F.pmod(F.xxhash64("_row", F.lit(c)), F.lit(share)) != 0, F.col(c)).alias(c) for c in df.columns if c != "_row"])
        out = df.unionByName(df.where(F.pmod("_row", F.lit(3)) == 0)).withColumnRenamed("_row", "path")
        out.write.parquet(f"file://{folder}/{n}.parquet")
    return f"file://{folder}"
