"""Table metadata files, format versions 1 and 2: parsing, validation, upgrade, and metadata DataFrames."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

from tabulith.functions.transforms import UNPARTITIONED, UNSORTED, PartitionSpec, SortOrder, field_to_json, fields_from_json
from tabulith.schema import TableSchema

MAIN = "main"
OPERATIONS = ("append", "replace", "overwrite", "delete")


class MetadataError(ValueError):
    """The metadata is invalid."""


class FormatVersionError(MetadataError):
    """The format version is missing or unknown."""


@dataclass(frozen=True)
class Summary:
    operation: str
    properties: dict[str, str] = field(default_factory=dict)

    @staticmethod
    def from_json(x: dict) -> Summary:
        if "operation" not in x:
            raise MetadataError("missing operation key")
        if x["operation"] not in OPERATIONS:
            raise MetadataError(f"invalid operation value {x['operation']!r}")
        return Summary(x["operation"], {k: v for k, v in x.items() if k != "operation"})

    def to_json(self) -> dict:
        return {"operation": self.operation, **self.properties}


@dataclass(frozen=True)
class Snapshot:
    snapshot_id: int
    timestamp_ms: int
    parent_id: int | None = None
    sequence_number: int = 0
    manifest_list: str = ""
    summary: Summary | None = None
    schema_id: int | None = None

    def __str__(self) -> str:
        op = f"{self.summary.operation}: " if self.summary else ""
        parent = "" if self.parent_id is None else f", parent_id={self.parent_id}"
        schema = "" if self.schema_id is None else f", schema_id={self.schema_id}"
        return f"{op}id={self.snapshot_id}{parent}{schema}"

    @staticmethod
    def from_json(x: dict) -> Snapshot:
        s = x.get("summary")
        return Snapshot(x["snapshot-id"], x["timestamp-ms"], x.get("parent-snapshot-id"), x.get("sequence-number", 0), x.get("manifest-list") or "", Summary.from_json(s) if s is not None else None, x.get("schema-id"))

    def to_json(self) -> dict:
        out = {"snapshot-id": self.snapshot_id, "sequence-number": self.sequence_number, "timestamp-ms": self.timestamp_ms}
        rest = {"parent-snapshot-id": self.parent_id, "manifest-list": self.manifest_list or None, "summary": self.summary and self.summary.to_json(), "schema-id": self.schema_id}
        return out | {k: v for k, v in rest.items() if v is not None}


@dataclass(frozen=True)
class SnapshotRef:
    snapshot_id: int
    type: str
    min_snapshots_to_keep: int | None = None
    max_snapshot_age_ms: int | None = None
    max_ref_age_ms: int | None = None

    @staticmethod
    def from_json(x: dict) -> SnapshotRef:
        if x.get("type") not in ("branch", "tag"):
            raise MetadataError("invalid snapshot ref type, should be 'branch' or 'tag'")
        return SnapshotRef(x["snapshot-id"], x["type"], x.get("min-snapshots-to-keep"), x.get("max-snapshot-age-ms"), x.get("max-ref-age-ms"))

    def to_json(self) -> dict:
        rest = {"min-snapshots-to-keep": self.min_snapshots_to_keep, "max-snapshot-age-ms": self.max_snapshot_age_ms, "max-ref-age-ms": self.max_ref_age_ms}
        return {"snapshot-id": self.snapshot_id, "type": self.type} | {k: v for k, v in rest.items() if v is not None}


@dataclass(frozen=True)
class TableMetadata:
    format_version: int
    table_uuid: str | None
    location: str
    last_updated_ms: int
    last_column_id: int
    schemas: tuple[TableSchema, ...]
    current_schema_id: int
    specs: tuple[PartitionSpec, ...]
    default_spec_id: int
    last_partition_id: int
    sort_orders: tuple[SortOrder, ...] = (UNSORTED,)
    default_sort_order_id: int = 0
    properties: dict[str, str] = field(default_factory=dict)
    snapshots: tuple[Snapshot, ...] = ()
    current_snapshot_id: int | None = None
    snapshot_log: tuple[tuple[int, int], ...] = ()  # (timestamp, snapshot)
    metadata_log: tuple[tuple[int, str], ...] = ()  # (timestamp, file)
    refs: dict[str, SnapshotRef] = field(default_factory=dict)
    last_sequence_number: int = 0

    def __post_init__(self) -> None:
        if self.current_schema_id not in [s.schema_id for s in self.schemas]:
            raise MetadataError(f"invalid metadata: current-schema-id {self.current_schema_id} can't be found in any schema")
        if self.default_spec_id not in [s.spec_id for s in self.specs]:
            raise MetadataError(f"invalid metadata: default-spec-id {self.default_spec_id} can't be found")
        if self.default_sort_order_id and self.default_sort_order_id not in [o.order_id for o in self.sort_orders]:
            raise MetadataError(f"invalid metadata: default-sort-order-id {self.default_sort_order_id} can't be found in {[o.order_id for o in self.sort_orders]}")
        if not self.last_updated_ms:
            raise MetadataError("invalid metadata: missing last-updated-ms")
        if not self.last_column_id:
            raise MetadataError("invalid metadata: missing last-column-id")

    # --- lookup

    def schema(self, schema_id: int | None = None) -> TableSchema:
        want = self.current_schema_id if schema_id is None else schema_id
        for s in self.schemas:
            if s.schema_id == want:
                return s
        raise MetadataError(f"no schema {want}")

    def spec(self, spec_id: int | None = None) -> PartitionSpec:
        want = self.default_spec_id if spec_id is None else spec_id
        return next((s for s in self.specs if s.spec_id == want), UNPARTITIONED)

    @property
    def sort_order(self) -> SortOrder:
        return next((o for o in self.sort_orders if o.order_id == self.default_sort_order_id), UNSORTED)

    def snapshot(self, snapshot_id: int | None) -> Snapshot | None:
        return next((s for s in self.snapshots if s.snapshot_id == snapshot_id), None)

    def snapshot_by_name(self, ref: str) -> Snapshot | None:
        return self.snapshot(self.refs[ref].snapshot_id) if ref in self.refs else None

    @property
    def current_snapshot(self) -> Snapshot | None:
        return self.snapshot(self.current_snapshot_id)

    def snapshot_at(self, timestamp_ms: int) -> Snapshot | None:
        """The current snapshot of a point in time, by the log; None before the first."""
        past = [(at, s) for at, s in self.snapshot_log if at <= timestamp_ms]
        return self.snapshot(max(past)[1]) if past else None

    # --- forms

    @staticmethod
    def parse(text: str | bytes) -> TableMetadata:
        x = json.loads(text)
        version = x.get("format-version") if isinstance(x, dict) else None
        if version not in (1, 2):
            raise FormatVersionError("invalid or missing format-version in table metadata")
        schemas = tuple(TableSchema.from_json(s) for s in x.get("schemas") or ([x["schema"]] if version == 1 and "schema" in x else ()))
        specs = tuple(PartitionSpec.from_json(s) for s in x.get("partition-specs") or ())
        default_spec = x.get("default-spec-id", 0)
        if version == 1 and not specs:
            specs = (PartitionSpec(fields_from_json(x.get("partition-spec") or ()), 0),)
            default_spec = 0
        last_partition = x.get("last-partition-id")
        if last_partition is None:
            last_partition = max((s.last_assigned_field_id for s in specs), default=0)
        current = x.get("current-snapshot-id")
        current = None if current == -1 else current
        refs = {k: SnapshotRef.from_json(v) for k, v in (x.get("refs") or {}).items()}
        if current is not None and MAIN not in refs:
            refs[MAIN] = SnapshotRef(current, "branch")
        orders = tuple(SortOrder.from_json(o) for o in x.get("sort-orders") or ())
        return TableMetadata(
            version,
            x.get("table-uuid"),
            x.get("location", ""),
            x.get("last-updated-ms", 0),
            x.get("last-column-id", 0),
            schemas,
            x.get("current-schema-id", schemas[0].schema_id if version == 1 and "schema" in x and schemas else 0),
            specs,
            default_spec,
            last_partition,
            orders or ((UNSORTED,) if version == 1 else ()),
            x.get("default-sort-order-id", 0),
            dict(x.get("properties") or {}),
            tuple(Snapshot.from_json(s) for s in x.get("snapshots") or ()),
            current,
            tuple((e["timestamp-ms"], e["snapshot-id"]) for e in x.get("snapshot-log") or ()),
            tuple((e["timestamp-ms"], e["metadata-file"]) for e in x.get("metadata-log") or ()),
            refs,
            x.get("last-sequence-number", 0),
        )

    def to_json(self) -> dict:
        out = {
            "format-version": self.format_version,
            "location": self.location,
            "last-updated-ms": self.last_updated_ms,
            "last-column-id": self.last_column_id,
            "schemas": [s.to_json() for s in self.schemas],
            "current-schema-id": self.current_schema_id,
            "partition-specs": [s.to_json() for s in self.specs],
            "default-spec-id": self.default_spec_id,
            "last-partition-id": self.last_partition_id,
            "properties": self.properties,
            "snapshots": [s.to_json() for s in self.snapshots],
            "snapshot-log": [{"timestamp-ms": at, "snapshot-id": s} for at, s in self.snapshot_log],
            "metadata-log": [{"timestamp-ms": at, "metadata-file": f} for at, f in self.metadata_log],
            "sort-orders": [o.to_json() for o in self.sort_orders],
            "default-sort-order-id": self.default_sort_order_id,
            "refs": {k: v.to_json() for k, v in self.refs.items()},
        }
        out |= {k: v for k, v in {"table-uuid": self.table_uuid, "current-snapshot-id": self.current_snapshot_id}.items() if v is not None}
        if self.format_version == 1:
            return out | {"schema": self.schema().to_json(), "partition-spec": [field_to_json(f) for f in self.spec().fields]}
        return out | {"last-sequence-number": self.last_sequence_number}

    def to_v2(self) -> TableMetadata:
        return replace(self, format_version=2, table_uuid=self.table_uuid or str(uuid.uuid4()))


# --- DataFrames: rows number as the metadata's own entries, which the driver has read


def snapshots_df(spark: SparkSession, m: TableMetadata) -> DataFrame:
    rows = [(s.snapshot_id, s.parent_id, s.sequence_number, s.timestamp_ms, s.manifest_list or None, s.summary and s.summary.operation, s.summary and s.summary.properties, s.schema_id) for s in m.snapshots]
    return spark.createDataFrame(rows, "snapshot_id bigint, parent_id bigint, sequence_number bigint, timestamp_ms bigint, manifest_list string, operation string, summary map<string,string>, schema_id int")


def history_df(spark: SparkSession, m: TableMetadata) -> DataFrame:
    """The snapshot log, and whether each entry is an ancestor of the current snapshot."""
    line: set[int] = set()
    s = m.current_snapshot
    while s is not None and s.snapshot_id not in line:
        line.add(s.snapshot_id)
        s = m.snapshot(s.parent_id)
    return spark.createDataFrame([(at, i, i in line) for at, i in m.snapshot_log], "made_current_ms bigint, snapshot_id bigint, is_current_ancestor boolean")


def refs_df(spark: SparkSession, m: TableMetadata) -> DataFrame:
    rows = [(n, r.type, r.snapshot_id, r.min_snapshots_to_keep, r.max_snapshot_age_ms, r.max_ref_age_ms) for n, r in m.refs.items()]
    return spark.createDataFrame(rows, "name string, type string, snapshot_id bigint, min_snapshots_to_keep int, max_snapshot_age_ms bigint, max_ref_age_ms bigint")


def schemas_df(spark: SparkSession, m: TableMetadata) -> DataFrame:
    rows = [(s.schema_id, i, s.name_of[i], str(f.type), f.required, f.doc) for s in m.schemas for i, f in s.by_id.items()]
    return spark.createDataFrame(rows, "schema_id int, field_id int, name string, type string, required boolean, doc string")


def metadata_log_df(spark: SparkSession, m: TableMetadata) -> DataFrame:
    return spark.createDataFrame(list(m.metadata_log), "timestamp_ms bigint, metadata_file string")
