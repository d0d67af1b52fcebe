"""Views of the catalog tables that several queries use: rows in force and comparable paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulith.functions.paths import same_file
from tabulith.operators.common import in_force
from tabulith.session import broadcast_if_small, materialize


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def metadata_in_force(meta: DataFrame) -> DataFrame:
    """Per table the row with the greatest ``last_updated_ms``; a ``current_snapshot_id`` of -1 becomes NULL."""
    t = in_force(meta.where("table_uuid IS NOT NULL"), ["table_uuid"], "last_updated_ms", ["last_updated_ms", "format_version", "current_snapshot_id"])
    return t.withColumn("current_snapshot_id", F.when(F.col("current_snapshot_id") != -1, F.col("current_snapshot_id")))


def snapshots_in_force(snapshots: DataFrame, columns: tuple[str, ...] = ("table_uuid", "manifest_list", "schema_id", "timestamp_ms", "expired_at")) -> DataFrame:
    """Per snapshot the row recorded last."""
    return in_force(snapshots.where("snapshot_id IS NOT NULL"), ["snapshot_id"], "recorded_at", columns)


def list_key(path: str):
    """A manifest list's comparable name; an empty one is NULL."""
    return F.when(F.col(path) != "", same_file(F.col(path)))


def live_manifests(meta: DataFrame, snapshots: DataFrame, manifests: DataFrame) -> DataFrame:
    """The manifests in the list of each table's current snapshot, each once (its row recorded last):
    ``table_uuid, partition_spec_id, content, path, manifest_length, entries``. ``entries`` is NULL where a count is unknown; manifests that are known to
    hold none are left out. The current snapshot must be one of that table and not expired. Content that is NULL is 0 (data)."""
    cur = metadata_in_force(meta).where("current_snapshot_id IS NOT NULL").select("table_uuid", F.col("current_snapshot_id").alias("snapshot_id"))
    snap = snapshots_in_force(snapshots, ("table_uuid", "manifest_list", "expired_at")).where("expired_at IS NULL").select("snapshot_id", "table_uuid", list_key("manifest_list").alias("list"))
    lists = cur.join(snap, ["table_uuid", "snapshot_id"]).where("list IS NOT NULL").select("table_uuid", "list")
    cols = ["partition_spec_id", "content", "manifest_length", "added_files_count", "existing_files_count"]
    rows = manifests.where("manifest_path IS NOT NULL").select("table_uuid", list_key("manifest_list").alias("list"), "manifest_path", "recorded_at", *cols)
    # most manifest rows stand in older lists: they go before paths are compared and rows are shuffled
    live = rows.join(broadcast_if_small(materialize(lists, "lists")), ["table_uuid", "list"], "left_semi").withColumn("path", same_file(F.col("manifest_path")))
    there = in_force(live, ["table_uuid", "list", "path"], "recorded_at", cols)
    entries = F.col("added_files_count") + F.col("existing_files_count")
    out = there.select("table_uuid", "partition_spec_id", F.coalesce("content", F.lit(0)).cast("int").alias("content"), "path", "manifest_length", entries.cast("long").alias("entries"))
    return out.where("entries IS NULL OR entries <> 0")
