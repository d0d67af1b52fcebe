"""Queries over the catalog tables, one per problem and more."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulith.catalog_tables import list_key, live_manifests, metadata_in_force, read, snapshots_in_force
from tabulith.functions.paths import month_of_millis, month_of_ntz
from tabulith.operators import compaction, hierarchy, incremental, orphans, schema_drift, shredding
from tabulith.operators.common import digest, in_force
from tabulith.session import materialize, new_dir
from tabulith.sources import avro_ocf


def _lineage(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "snapshots").select("table_uuid", "snapshot_id", "parent_snapshot_id", "timestamp_ms", "recorded_at")
    return hierarchy.hierarchy(rows, "snapshot_id", "parent_snapshot_id", scope="table_uuid", locality=["table_uuid", "timestamp_ms"], latest=["recorded_at"])


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Root and depth of each snapshot's lineage; -1 on and below circles."""
    t = _lineage(spark, d)
    return t.select("snapshot_id", F.coalesce("root", F.lit(-1).cast("long")).alias("root_snapshot_id"), F.coalesce("depth", F.lit(-1)).cast("int").alias("depth"))


def p1_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    """Each snapshot with parent, root, depth, numbers of children and descendants, and whether it is on or below a circle."""
    return _lineage(spark, d)


def p1_paths(spark: SparkSession, d: str) -> DataFrame:
    """Each snapshot's path from the root, in linked blocks (see ``with_paths``)."""
    t = materialize(_lineage(spark, d), "lineage")
    return hierarchy.with_paths(t, "snapshot_id", "parent_snapshot_id").select("snapshot_id", "depth", F.array_join("path_tail", ",").alias("path_tail"), "path_next")


def p1_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Each snapshot's descendants as an interval of places in preorder (see ``with_intervals``)."""
    t = materialize(_lineage(spark, d), "lineage")
    return hierarchy.with_intervals(t, "snapshot_id", "parent_snapshot_id").select("snapshot_id", "top", "first", "last")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Every change of a field from one schema version of a table to the next."""
    c = schema_drift.schema_changes(read(spark, d, "table_schemas"))
    return c.where("change <> 'moved'").select(F.col("t").alias("table_uuid"), F.col("v").alias("schema_id"), "field_id", "change").distinct()


def p2_script(spark: SparkSession, d: str) -> DataFrame:
    """The whole edit scripts, with moves and the values before and after."""
    return schema_drift.schema_changes(read(spark, d, "table_schemas"))


def p2_rows(spark: SparkSession, d: str) -> DataFrame:
    """All data rows of each table in its unified form."""
    return schema_drift.unify_rows(read(spark, d, "data_rows"), read(spark, d, "table_schemas"))


def p2_values(spark: SparkSession, d: str) -> DataFrame:
    """The fields of all data rows in typed columns, named and typed as the unified schema says."""
    return schema_drift.values(read(spark, d, "data_rows"), read(spark, d, "table_schemas"))


def _live(spark: SparkSession, d: str) -> DataFrame:
    return live_manifests(read(spark, d, "table_metadata"), read(spark, d, "snapshots"), read(spark, d, "manifest_files"))


GROUP = ["table_uuid", "partition_spec_id", "content"]


# the record that stands for a live manifest in a container of its own
MANIFEST = {"type": "record", "name": "live_manifest", "fields": [{"name": n, "type": ["null", k]} for n, k in (("table_uuid", "string"), ("path", "string"), ("manifest_length", "long"), ("entries", "long"))]}


def _consolidated(spark: SparkSession, d: str) -> DataFrame:
    """The assignment carried out: each live manifest that moves is an encoded container, whose blocks are copied into the new one it goes to. ``GROUP, piece,
    bin, files, blocks, records, bytes`` per new manifest. The tables hold rows of manifests, not their files; a container holds that row."""
    plan = materialize(compaction.assign(_live(spark, d), GROUP, "path", "manifest_length"), "assignment")
    moved = plan.where("bin IS NOT NULL").withColumn("target", F.to_json(F.struct(*GROUP, "piece", "bin")))

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pack = avro_ocf.packer(MANIFEST)
        for f in frames:
            rows = zip(f["table_uuid"], f["path"], f["manifest_length"], f["entries"], strict=True)
            yield pd.DataFrame({"target": f["target"], "content": [pack([{"table_uuid": t, "path": p, "manifest_length": int(n), "entries": None if pd.isna(e) else int(e)}]) for t, p, n, e in rows]})

    containers = moved.select("target", "table_uuid", "path", "manifest_length", "entries").mapInPandas(encode, "target string, content binary")
    done = materialize(compaction.join_containers(containers, "target", "content"), "consolidated")
    want = moved.count()
    got = done.agg(F.coalesce(F.sum("files"), F.lit(0)), F.coalesce(F.sum("records"), F.lit(0)), F.coalesce(F.sum("blocks"), F.lit(0))).first()
    if set(got) != {want}:
        raise RuntimeError(f"{want} manifests move, but the new ones hold {tuple(got)} files, records and blocks")
    keys = F.from_json("target", plan.select(*GROUP, "piece", "bin").schema)
    return done.select(*[keys.getField(c).alias(c) for c in (*GROUP, "piece", "bin")], "files", "blocks", "records", "bytes")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Groups of live manifests that need consolidation: those for which it was carried out. A group's mean is below the bound only if some of its manifests is, and
    that one moves, so no group in need is without a new manifest."""
    return _consolidated(spark, d).select(*GROUP).distinct()


def p3_consolidated(spark: SparkSession, d: str) -> DataFrame:
    """What consolidation did to each group: manifests before, new ones, copied blocks and the records in them."""
    return _consolidated(spark, d).groupBy(*GROUP).agg(F.sum("files").alias("n_before"), F.count("*").alias("n_after"), F.sum("blocks").alias("n_blocks"), F.sum("records").alias("n_records"))


def p3_assignment(spark: SparkSession, d: str) -> DataFrame:
    """Each live manifest and the new one it goes to (NULL: it stays)."""
    return compaction.assign(_live(spark, d), GROUP, "path", "manifest_length").select(*GROUP, "path", "manifest_length", "entries", "piece", "bin")


def _copied(spark: SparkSession, d: str) -> DataFrame:
    """The manifest rows, all columns, written as many small files, consolidated by copying blocks, and read back."""
    small, large = new_dir(spark, "small"), new_dir(spark, "large")
    read(spark, d, "manifest_files").write.option("maxRecordsPerFile", 1_000).parquet(small)
    compaction.compact_parquet(spark, small, large)
    return spark.read.parquet(large)


def p3_blockcopy(spark: SparkSession, d: str) -> DataFrame:
    """The copied rows and bytes per table."""
    return _copied(spark, d).groupBy("table_uuid").agg(F.count("*").alias("n_rows"), F.countDistinct("manifest_path").alias("n_paths"), F.sum("manifest_length").alias("n_bytes"))


def p3_blockcopy_columns(spark: SparkSession, d: str) -> DataFrame:
    """Of the copied rows per table the values in every column and in the nested summaries."""
    t = _copied(spark, d)
    nested = F.aggregate(F.coalesce("partitions", F.array()), F.lit(0).cast("long"), lambda a, p: a + 1 + F.coalesce(F.length(p["lower_bound"]), F.lit(0)) + F.coalesce(F.length(p["upper_bound"]), F.lit(0)))
    return t.groupBy("table_uuid").agg(*[F.count(c).alias(f"n_{c}") for c in t.columns if c != "table_uuid"], F.sum(nested).alias("n_bound_bytes"), F.max("recorded_at").alias("latest"))


SEP = "\x1f"


def _references(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """References (``ref_kind, table_uuid, from_key, period, key``) and targets (``key``) of all kinds; keys name their space."""
    snaps = materialize(snapshots_in_force(read(spark, d, "snapshots")).where("expired_at IS NULL"), "snapshots")

    def key(space: str, *parts) -> F.Column:
        return F.concat(F.lit(space), *[x for p in parts for x in (F.lit(SEP), p if not isinstance(p, str) else F.col(p).cast("string"))])

    def refs(df: DataFrame, kind: str, from_key: str, period, to) -> DataFrame:
        return df.select(F.lit(kind).alias("ref_kind"), "table_uuid", F.col(from_key).cast("string").alias("from_key"), period.alias("period"), to.alias("key")).where("key IS NOT NULL")

    meta = metadata_in_force(read(spark, d, "table_metadata"))
    named = in_force(read(spark, d, "snapshot_refs"), ["table_uuid", "ref_name"], "recorded_at", ["recorded_at", "snapshot_id"])
    month = month_of_millis(F.col("timestamp_ms"))
    r = refs(meta, "current_snapshot", "table_uuid", month_of_millis(F.col("last_updated_ms")), key("s", "table_uuid", "current_snapshot_id"))
    r = r.unionByName(refs(named, "ref", "ref_name", month_of_ntz(F.col("recorded_at")), key("s", "table_uuid", "snapshot_id")))
    r = r.unionByName(refs(snaps, "schema", "snapshot_id", month, key("c", "table_uuid", "schema_id")))
    r = r.unionByName(refs(snaps, "manifest_list", "snapshot_id", month, key("m", list_key("manifest_list"))))
    t = snaps.select(key("s", "table_uuid", "snapshot_id").alias("key"))
    t = t.unionByName(read(spark, d, "table_schemas").select(key("c", "table_uuid", "schema_id").alias("key")))
    # spellings repeat row after row: they are made comparable once each
    lists = read(spark, d, "manifest_files").select("manifest_list").distinct()
    return r, t.unionByName(lists.select(key("m", list_key("manifest_list")).alias("key")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Each reference without a target."""
    r, t = _references(spark, d)
    r = materialize(r, "references")
    return orphans.orphan_rows(r, t).select("table_uuid", "ref_kind", "from_key", F.col("period").alias("month_utc")).distinct()


def p4_counts(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references per table, kind and month."""
    return p4_found(spark, d).groupBy("table_uuid", "ref_kind", "month_utc").agg(F.count("*").alias("n_orphans"))


SUMMARY = {"contains_null": None, "contains_nan": None, "lower_bound": None, "upper_bound": None}
COUNTS = ("added_data_files_count", "existing_data_files_count", "deleted_data_files_count", "added_rows_count", "existing_rows_count", "deleted_rows_count")
LIST_SHAPE = {
    "format-version": None,
    "table": {"uuid": None, "name": None},
    "snapshot": {"snapshot-id": None, "timestamp-ms": None},
    "manifests": [{"manifest_path": None, "manifest_length": None, "partition_spec_id": None, "added_snapshot_id": None, **dict.fromkeys(COUNTS), "partitions": [SUMMARY]}],
}


def _flag(v: object) -> int:
    return -1 if v is None else int(v in (True, 1, "true", "True"))


def _bool(v: object) -> bool | None:
    return None if v is None else _flag(v) == 1


def _int(v: object) -> int | None:
    try:
        return None if v is None or isinstance(v, bool) else int(v)
    except (ValueError, TypeError):
        return None


def _text(v: object) -> str | None:
    return None if v is None else v if isinstance(v, str) else str(v)


def _shred(spark: SparkSession, d: str, ancestor: tuple[str, ...], columns: dict, keys: tuple[str, ...] = ("record_id",)) -> DataFrame:
    return shredding.shred_json(read(spark, d, "manifest_lists_raw"), "record_json", keys, LIST_SHAPE, ancestor, columns)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Each partition summary of the raw manifest lists, with its places."""
    t = _shred(spark, d, ("manifests", "partitions"), {"nan_flag": ("contains_nan", _flag, "int"), "has_lower": ("lower_bound", lambda v: int(v is not None), "int")})
    return t.withColumnsRenamed({"pos_1": "manifest_pos", "pos_2": "summary_pos"})


def p5_lists(spark: SparkSession, d: str) -> DataFrame:
    """The table of the raw manifest lists."""
    return _shred(spark, d, (), {"format_version": ("format-version", _int, "int"), "list_table_uuid": ("table_uuid", _text, "string"), "table_name": ("table_name", _text, "string"), "snapshot_id": ("snapshot_snapshot-id", _int, "bigint"), "timestamp_ms": ("snapshot_timestamp-ms", _int, "bigint")}, ("record_id", "table_uuid"))


def p5_manifests(spark: SparkSession, d: str) -> DataFrame:
    """The table of manifests, child of the lists by ``record_id``."""
    cols = {"manifest_path": ("manifest_path", _text, "string"), "manifest_length": ("manifest_length", _int, "bigint"), "partition_spec_id": ("partition_spec_id", _int, "int"), "added_snapshot_id": ("added_snapshot_id", _int, "bigint")}
    return _shred(spark, d, ("manifests",), cols | {c: (c, _int, "bigint") for c in COUNTS}).withColumnRenamed("pos_1", "manifest_pos")


def p5_summaries(spark: SparkSession, d: str) -> DataFrame:
    """The table of partition summaries, child of the manifests by ``record_id, manifest_pos``."""
    cols = {"contains_null": ("contains_null", _bool, "boolean"), "contains_nan": ("contains_nan", _bool, "boolean"), "lower_bound": ("lower_bound", _text, "string"), "upper_bound": ("upper_bound", _text, "string")}
    return _shred(spark, d, ("manifests", "partitions"), cols).withColumnsRenamed({"pos_1": "manifest_pos", "pos_2": "summary_pos"})


def p5_partitions(spark: SparkSession, d: str) -> DataFrame:
    """The partition summaries of ``manifest_files``, child of its rows by table, list and manifest as written. Of a row that came again, the one
    recorded last counts."""
    keys = ["table_uuid", "manifest_list", "manifest_path"]
    m = in_force(read(spark, d, "manifest_files"), keys, "recorded_at", ["partitions"])
    t = shredding.shred_columns(m, keys, "partitions")
    return t.select(*keys, "pos", "contains_null", "contains_nan", F.lower(F.hex("lower_bound")).alias("lower_bound"), F.lower(F.hex("upper_bound")).alias("upper_bound"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Snapshots still to be processed: current leaves that the tree of what succeeded runs saw does not hold."""
    two = metadata_in_force(read(spark, d, "table_metadata")).where("format_version = 2").select("table_uuid")
    snaps = read(spark, d, "snapshots").where("snapshot_id IS NOT NULL").join(two, "table_uuid", "left_semi")
    content = [c for c in snaps.columns if c != "recorded_at"]
    rows = snaps.select("table_uuid", "snapshot_id", "sequence_number", "expired_at", "recorded_at", digest(snaps, content).alias("g"))
    same = ["snapshot_id", "g", "table_uuid", "sequence_number", "expired_at"]
    versions = rows.groupBy(*same).agg(F.min("recorded_at").alias("first"), F.max("recorded_at").alias("last"))
    added = read(spark, d, "manifest_files").where("sequence_number IS NOT NULL AND added_snapshot_id IS NOT NULL").groupBy("table_uuid", F.col("added_snapshot_id").alias("snapshot_id")).agg(F.max("sequence_number").alias("added_seq"))
    versions = versions.join(added, ["table_uuid", "snapshot_id"], "left").withColumn("seq", F.coalesce("sequence_number", "added_seq"))
    versions = materialize(versions, "versions")
    runs = read(spark, d, "ingest_runs").where("status = 'succeeded'")
    seen = materialize(incremental.covered(versions, runs, "table_uuid", "seq", "first", "from_sequence", "to_sequence", "started_at"), "seen")
    leaf = F.struct("table_uuid", "g", "done", "expired_at")
    now = seen.groupBy("snapshot_id").agg(F.max_by(leaf, F.struct("last", "g")).alias("x")).where("x.expired_at IS NULL")
    # of several versions that runs saw, the one recorded last stands
    saved = seen.where("done").groupBy("snapshot_id").agg(F.max_by(leaf, F.struct("last", "g")).alias("x"))
    keys = ["table_uuid", "snapshot_id"]
    a, b = (materialize(t.select("x.table_uuid", "snapshot_id", "x.g.h1", "x.g.h2").withColumn("kh", digest(t.select("x.table_uuid", "snapshot_id"), keys)["h1"]), n) for t, n in ((now, "now"), (saved, "saved")))
    diff = incremental.changed_leaves(a, b, incremental.tree(a), incremental.tree(b), keys)
    return diff.where("change <> 'gone'").select(*keys).distinct()


def _replay(rows: DataFrame, content: list[str]) -> DataFrame:
    """``snapshot_id`` and content processed in three runs with failures between: all as recorded at the time, each content once."""
    store = incremental.IncrementalRuns(rows.sparkSession, new_dir(rows.sparkSession, "runs"), ["snapshot_id"], content)
    for until, fail in (("2024-01-01", None), ("2024-07-01", "leaves"), ("2024-07-01", "commit"), ("2024-07-01", None), (None, None)):
        part = in_force(rows.where(F.col("recorded_at") < until) if until else rows, ["snapshot_id"], "recorded_at", content)
        try:
            store.run(part, lambda t: t.select("snapshot_id", *content), fail_at=fail)
        except RuntimeError:
            continue
    return store.output()


def p6_replay(spark: SparkSession, d: str) -> DataFrame:
    """The snapshots replayed with table, parent and manifest list as content, as in its SQL; ``p6_replay_content`` takes all of it."""
    rows = read(spark, d, "snapshots").where("snapshot_id IS NOT NULL").select("table_uuid", "snapshot_id", "parent_snapshot_id", "manifest_list", "recorded_at")
    return _replay(rows, ["table_uuid", "parent_snapshot_id", "manifest_list"])


def p6_replay_content(spark: SparkSession, d: str) -> DataFrame:
    """The snapshots replayed with all columns but ``recorded_at`` as content: any correction is processed."""
    rows = read(spark, d, "snapshots").where("snapshot_id IS NOT NULL")
    return _replay(rows, [c for c in rows.columns if c not in ("snapshot_id", "recorded_at")])


def p6_replay_times(spark: SparkSession, d: str) -> DataFrame:
    """How often each snapshot was processed in the replay of all content: once, and again for each correction that a run saw."""
    return p6_replay_content(spark, d).groupBy("snapshot_id").agg(F.count("*").alias("n_times"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    names = ("p1_found", "p1_hierarchy", "p1_paths", "p1_descendants", "p2_found", "p2_script", "p2_rows", "p2_values", "p3_found", "p3_consolidated", "p3_assignment", "p3_blockcopy", "p3_blockcopy_columns", "p4_found", "p4_counts", "p5_found", "p5_lists", "p5_manifests", "p5_summaries", "p5_partitions", "p6_found", "p6_replay", "p6_replay_content", "p6_replay_times")
    return {n: globals()[n] for n in names}
