"""Writing tables: data files with field ids, manifests with statistics, snapshots. Used for fixtures, tests and the local catalog."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import replace

import pandas as pd
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulith import types as t
from tabulith.functions.literals import cast, from_bytes, order_key, to_bytes
from tabulith.functions.transforms import FIRST_PARTITION_ID, PartitionField, PartitionSpec, SortOrder, parse_transform
from tabulith.schema import TableSchema
from tabulith.session import put_new
from tabulith.sources import avro_ocf
from tabulith.sources.filesystem import filesystem, read_bytes, spark_path, write_bytes
from tabulith.sources.metadata import MAIN, Snapshot, SnapshotRef, Summary, TableMetadata

# Ids of the columns of position-delete files.
PATH_ID, POS_ID = 2147483546, 2147483545


def _f(name: str, id: int, kind: object, optional: bool = False) -> dict:  # noqa: A002
    return {"name": name, "field-id": id, "type": ["null", kind] if optional else kind} | ({"default": None} if optional else {})


def _map(name: str, id: int, key: int, value: int, kind: str) -> dict:  # noqa: A002
    pair = {"type": "record", "name": f"k{key}_v{value}", "fields": [_f("key", key, "int"), _f("value", value, kind)]}
    return _f(name, id, {"type": "array", "logicalType": "map", "items": pair}, True)


# Names, ids and order of the fields of manifest lists and manifests.
def list_schema() -> dict:
    """Avro schema of a format-2 manifest list, with the field ids that the format fixes."""
    summary = {"type": "record", "name": "r508", "fields": [_f("contains_null", 509, "boolean"), _f("contains_nan", 518, "boolean", True), _f("lower_bound", 510, "bytes", True), _f("upper_bound", 511, "bytes", True)]}
    counts = (("added_files_count", 504, "int"), ("existing_files_count", 505, "int"), ("deleted_files_count", 506, "int"), ("added_rows_count", 512, "long"), ("existing_rows_count", 513, "long"), ("deleted_rows_count", 514, "long"))
    heads = (("manifest_path", 500, "string"), ("manifest_length", 501, "long"), ("partition_spec_id", 502, "int"), ("content", 517, "int"), ("sequence_number", 515, "long"), ("min_sequence_number", 516, "long"), ("added_snapshot_id", 503, "long"))
    return {"type": "record", "name": "manifest_file", "fields": [_f(*x) for x in heads + counts] + [_f("partitions", 507, {"type": "array", "items": summary, "element-id": 508}, True)]}


def _avro_type(kind: t.Type) -> object:
    if isinstance(kind, t.Decimal):
        return {"type": "bytes", "logicalType": "decimal", "precision": kind.precision, "scale": kind.scale}
    if isinstance(kind, t.Fixed) or kind == t.UUID:
        return {"type": "fixed", "name": "uuid_fixed" if kind == t.UUID else f"fixed_{kind.length}", "size": 16 if kind == t.UUID else kind.length} | ({"logicalType": "uuid"} if kind == t.UUID else {})
    logical = {"date": ("int", "date"), "time": ("long", "time-micros"), "timestamp": ("long", "timestamp-micros"), "timestamptz": ("long", "timestamp-micros")}.get(kind.name)
    return {"type": logical[0], "logicalType": logical[1]} if logical else {"binary": "bytes"}.get(kind.name, kind.name)


def entry_schema(partition: t.Struct) -> dict:
    """Avro schema of a format-2 manifest for files of one partition type."""
    part = {"type": "record", "name": "r102", "fields": [_f(f.name, f.id, _avro_type(f.type), True) for f in partition.fields]}
    data = {
        "type": "record",
        "name": "r2",
        "fields": [
            _f("content", 134, "int"),
            _f("file_path", 100, "string"),
            _f("file_format", 101, "string"),
            _f("partition", 102, part),
            _f("record_count", 103, "long"),
            _f("file_size_in_bytes", 104, "long"),
            _map("column_sizes", 108, 117, 118, "long"),
            _map("value_counts", 109, 119, 120, "long"),
            _map("null_value_counts", 110, 121, 122, "long"),
            _map("nan_value_counts", 137, 138, 139, "long"),
            _map("lower_bounds", 125, 126, 127, "bytes"),
            _map("upper_bounds", 128, 129, 130, "bytes"),
            _f("key_metadata", 131, "bytes", True),
            _f("split_offsets", 132, {"type": "array", "items": "long", "element-id": 133}, True),
            _f("equality_ids", 135, {"type": "array", "items": "int", "element-id": 136}, True),
            _f("sort_order_id", 140, "int", True),
        ],
    }
    return {"type": "record", "name": "manifest_entry", "fields": [_f("status", 0, "int"), _f("snapshot_id", 1, "long", True), _f("sequence_number", 3, "long", True), _f("file_sequence_number", 4, "long", True), _f("data_file", 2, data)]}


def footer_stats(path: str, kinds: dict[str, tuple[int, t.Type]]) -> dict:
    """Statistics of a Parquet file by field id, from its footer. NaNs aren't counted there, so their number stays unknown."""
    fs, p = filesystem(path)
    with fs.open_input_file(p) as f:
        size = f.size()
        m = pq.ParquetFile(f).metadata
    out: dict = {k: {} for k in ("column_sizes", "value_counts", "null_value_counts", "lower_bounds", "upper_bounds")}
    lows: dict[int, list] = {}
    highs: dict[int, list] = {}
    whole: dict[int, bool] = {}
    for g in range(m.num_row_groups):
        for c in range(m.num_columns):
            col = m.row_group(g).column(c)
            if col.path_in_schema not in kinds:
                continue
            i, kind = kinds[col.path_in_schema]
            s = col.statistics
            out["column_sizes"][i] = out["column_sizes"].get(i, 0) + col.total_compressed_size
            out["value_counts"][i] = out["value_counts"].get(i, 0) + m.row_group(g).num_rows
            known = s is not None and s.has_null_count
            whole[i] = whole.get(i, True) and known
            if known:
                out["null_value_counts"][i] = out["null_value_counts"].get(i, 0) + s.null_count
            if s is not None and s.has_min_max:
                lows.setdefault(i, []).append(s.min)
                highs.setdefault(i, []).append(s.max)
            elif not (known and s.null_count == m.row_group(g).num_rows):
                lows.setdefault(i, []).append(None)
    typed = {i: kind for i, kind in kinds.values()}
    for i, good in whole.items():
        if not good:
            out["null_value_counts"].pop(i, None)
    for i, vs in lows.items():
        if None not in vs:
            out["lower_bounds"][i] = _bound(min(vs), typed[i])
            out["upper_bounds"][i] = _bound(max(highs[i]), typed[i])
    return out | {"record_count": m.num_rows, "file_size_in_bytes": size, "split_offsets": [m.row_group(g).column(0).dictionary_page_offset or m.row_group(g).column(0).data_page_offset for g in range(m.num_row_groups)]}


def _bound(v: object, kind: t.Type) -> bytes:
    if kind in (t.BINARY, t.STRING) or isinstance(kind, t.Fixed):
        return v.encode() if isinstance(v, str) else bytes(v)
    if isinstance(v, int | float | bool):
        return to_bytes(v, kind)
    return to_bytes(cast(v, kind), kind)


def leaf_columns(schema: TableSchema) -> dict[str, tuple[int, t.Type]]:
    """Parquet paths of the columns that have statistics: primitives outside of lists and maps."""
    out: dict[str, tuple[int, t.Type]] = {}

    def visit(fields: Sequence[t.Field], prefix: str) -> None:
        for f in fields:
            if isinstance(f.type, t.Struct):
                visit(f.type.fields, prefix + f.name + ".")
            elif not t.children(f.type):
                out[prefix + f.name] = (f.id, f.type)

    visit(schema.fields, "")
    return out


def with_ids(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The rows in the order and types of ``schema``, whose field ids go into the files."""
    df, spark = df.to(schema), df.sparkSession
    # a projection that only changes metadata is removed by the optimizer, so the schema is set on the rows, which stay in Spark's own form
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(df._jdf.queryExecution().toRdd(), spark._jsparkSession.parseDataType(schema.json()), False), spark)


class TableWriter:
    """Appends to one table. Each call writes files, then manifest, list and metadata, the last of which alone makes it visible."""

    def __init__(self, spark: SparkSession, location: str, metadata: TableMetadata, version: int = 0) -> None:
        self.spark, self.location, self.metadata, self.version = spark, location.rstrip("/"), metadata, version

    @staticmethod
    def create(spark: SparkSession, location: str, schema: T.StructType | TableSchema, partition: Sequence[tuple[str, str]] = (), order: SortOrder | None = None, properties: dict[str, str] | None = None) -> TableWriter:
        """``partition``: pairs of a column and a transform's text."""
        s = schema if isinstance(schema, TableSchema) else TableSchema.from_spark(schema)
        fields = []
        for k, (name, text) in enumerate(partition):
            source = s.find(name)
            tr = parse_transform(text)
            tr.check(source.type)
            fields.append(PartitionField(source.id, FIRST_PARTITION_ID + k, name if text == "identity" else f"{name}_{tr.name}", tr))
        spec = PartitionSpec(tuple(fields))
        orders = (order,) if order and order.fields else (SortOrder(),)
        meta = TableMetadata(2, str(uuid.uuid4()), location.rstrip("/"), int(time.time() * 1000), s.highest_field_id, (s,), s.schema_id, (spec,), 0, spec.last_assigned_field_id, orders, orders[0].order_id, properties or {})
        w = TableWriter(spark, location, meta)
        w._publish(meta)
        return w

    @property
    def metadata_location(self) -> str:
        return f"{self.location}/metadata/v{self.version}.metadata.json"

    def _publish(self, meta: TableMetadata) -> None:
        """Write the next version's file. ``FileExistsError`` if another writer has: then nothing has happened but that files were written that nothing names."""
        path = f"{self.location}/metadata/v{self.version + 1}.metadata.json"
        put_new(self.spark, spark_path(path) if ":" in path.split("/")[0] else f"file://{path}", json.dumps(meta.to_json()).encode())
        self.version += 1
        self.metadata = meta

    def append(self, df: DataFrame, files: int | None = None, tag: str | None = None, per_manifest: int = 1000) -> int:
        """Add rows; returns the snapshot's id. Rows of a partition value come together, in one task unless they are many: adaptive execution splits
        large ones and joins small ones. ``files`` gives the number of tasks instead."""
        schema, spec, snap = self.metadata.schema(), self.metadata.spec(), self._new_id()
        folder = f"{self.location}/data/{snap}"
        keys = [(f"_p{f.field_id}", f.transform.column(F.col(schema.column_path(f.source_id)), schema.by_id[f.source_id].type)) for f in spec.fields]
        out = with_ids(df, schema.to_spark())
        if keys:
            out = out.withColumns({n: c.cast("string") for n, c in keys})
            out = out.repartition(files, *[F.col(n) for n, _ in keys]) if files else out.hint("rebalance", *[F.col(n) for n, _ in keys])
            out.sortWithinPartitions(*[n for n, _ in keys]).write.partitionBy(*[n for n, _ in keys]).parquet(spark_path(folder))
        else:
            (out.repartition(files) if files else out).write.parquet(spark_path(folder))
        entries = self._entries(folder, 0, leaf_columns(schema))
        return self._commit(snap, entries, 0, "append", tag, per_manifest)

    def add_files(self, files: list[dict], tag: str | None = None) -> int:
        """Add data files that were written elsewhere, by their entries (``content, file_path, file_format, partition, record_count,
        file_size_in_bytes`` and whatever statistics are known)."""
        return self._commit(self._new_id(), files, 0, "append", tag)

    def delete_positions(self, rows: DataFrame, tag: str | None = None) -> int:
        """Delete rows by (file_path, pos)."""
        snap = self._new_id()
        folder = f"{self.location}/data/{snap}-pos"
        s = T.StructType([T.StructField("file_path", T.StringType(), False, {t.FIELD_ID: PATH_ID}), T.StructField("pos", T.LongType(), False, {t.FIELD_ID: POS_ID})])
        kept = rows.select(F.coalesce("file_path", F.lit("")).alias("file_path"), F.coalesce(F.col("pos").cast("long"), F.lit(-1).cast("long")).alias("pos"))
        # files by ranges of path: each names few data files, and deletes of one data file may be any share of them
        with_ids(kept, s).repartitionByRange("file_path", "pos").sortWithinPartitions("file_path", "pos").write.parquet(spark_path(folder))
        entries = self._entries(folder, 1, {"file_path": (PATH_ID, t.STRING), "pos": (POS_ID, t.LONG)}, partitioned=False)
        return self._commit(snap, entries, 1, "delete", tag)

    def delete_equal(self, rows: DataFrame, columns: Sequence[str], tag: str | None = None) -> int:
        """Delete all rows so far that equal one of ``rows`` in the named columns, NULL equal to NULL."""
        schema, snap = self.metadata.schema(), self._new_id()
        folder = f"{self.location}/data/{snap}-eq"
        part = schema.select(columns)
        with_ids(rows, part.to_spark()).hint("rebalance").write.parquet(spark_path(folder))
        entries = self._entries(folder, 2, leaf_columns(part), [f.id for f in part.fields], partitioned=False)
        return self._commit(snap, entries, 1, "delete", tag)

    def publish_manifests(self, rows: list[dict], summary: dict[str, str], snap: int | None = None) -> int:
        """A snapshot with this list of manifests and the same rows of data."""
        return self._list(snap or self._new_id(), rows, "replace", summary)

    def replace_manifests(self, joined: dict[str, str], sizes: dict[str, int]) -> int:
        """A snapshot in whose list the old manifests' rows are those of the new ones they were joined into."""
        meta = self.metadata
        out: list[dict] = []
        new: dict[str, dict] = {}
        for r in avro_ocf.read(read_bytes(meta.current_snapshot.manifest_list))[1]:
            path = joined.get(r["manifest_path"])
            if path is None:
                out.append(r)
            elif path not in new:
                new[path] = r | {"manifest_path": path, "manifest_length": sizes[path]}
                out.append(new[path])
            else:
                new[path] |= combined_rows(new[path], r, meta)
        return self.publish_manifests(out, {"manifests-replaced": str(len(joined)), "manifests-created": str(len(sizes))})

    def evolve(self, schema: TableSchema) -> None:
        """Make a new schema current; files of older ones stay and are read by field id."""
        s = replace(schema, schema_id=max(x.schema_id for x in self.metadata.schemas) + 1)
        self._publish(replace(self.metadata, schemas=(*self.metadata.schemas, s), current_schema_id=s.schema_id, last_column_id=max(self.metadata.last_column_id, s.highest_field_id)))

    def tag(self, name: str, snapshot_id: int) -> None:
        self._publish(replace(self.metadata, refs=self.metadata.refs | {name: SnapshotRef(snapshot_id, "tag")}))

    def _new_id(self) -> int:
        return uuid.uuid4().int >> 65

    def _entries(self, folder: str, content: int, kinds: dict[str, tuple[int, t.Type]], equality: list[int] | None = None, partitioned: bool = True) -> list[dict]:
        listing = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(spark_path(folder)).select("path")

        def stats(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                yield pd.DataFrame({"path": f["path"], "stats": [json.dumps(footer_stats(p, kinds), default=lambda b: {"hex": b.hex()}) for p in f["path"]]})

        schema, spec = self.metadata.schema(), self.metadata.spec()
        out = []
        for r in listing.mapInPandas(stats, "path string, stats string").collect():  # one row per new file, which its manifest lists anyway
            s = json.loads(r.stats, object_hook=lambda d: bytes.fromhex(d["hex"]) if d.keys() == {"hex"} else d)
            s = {k: {int(i): x for i, x in v.items()} if isinstance(v, dict) else v for k, v in s.items()}
            part = {}
            for f in spec.fields if partitioned else ():
                kind = schema.by_id[f.source_id].type
                low = s["lower_bounds"].get(f.source_id)
                part[f.name] = f.transform.value(from_bytes(low, kind), kind)
            out.append({"content": content, "file_path": r.path, "file_format": "PARQUET", "partition": part, "equality_ids": equality, "sort_order_id": self.metadata.default_sort_order_id, **s})
        return sorted(out, key=lambda e: e["file_path"])

    def _commit(self, snap: int, files: list[dict], content: int, operation: str, tag: str | None, per_manifest: int = 1000) -> int:
        meta = self.metadata
        schema = meta.schema()
        spec = meta.spec() if content == 0 else PartitionSpec((), max(s.spec_id for s in meta.specs) + (1 if meta.spec().fields else 0))
        specs = meta.specs if content == 0 or not meta.spec().fields else meta.specs if any(not s.fields for s in meta.specs) else (*meta.specs, spec)
        if content:
            spec = next(s for s in specs if not s.fields)
        seq, kind = meta.last_sequence_number + 1, spec.partition_type(schema)
        rows = []
        for a in range(0, len(files), per_manifest):
            part = files[a : a + per_manifest]
            path = f"{self.location}/metadata/{uuid.uuid4().hex}-m{a // per_manifest}.avro"
            entries = [{"status": 1, "snapshot_id": snap, "sequence_number": None, "file_sequence_number": None, "data_file": f} for f in part]
            data = avro_ocf.write(entry_schema(kind), entries, {"format-version": "2", "content": "deletes" if content else "data", "partition-spec-id": str(spec.spec_id), "schema": json.dumps(schema.to_json()), "partition-spec": json.dumps(spec.to_json()["fields"])})
            write_bytes(path, data)
            rows.append({
                "manifest_path": path, "manifest_length": len(data), "partition_spec_id": spec.spec_id, "content": content, "sequence_number": seq, "min_sequence_number": seq, "added_snapshot_id": snap,
                "added_files_count": len(part), "existing_files_count": 0, "deleted_files_count": 0, "added_rows_count": sum(f["record_count"] for f in part), "existing_rows_count": 0, "deleted_rows_count": 0,
                "partitions": [_summary(part, f.name, f.type) for f in kind.fields],
            })
        parent = meta.current_snapshot
        if parent and parent.manifest_list:
            rows = avro_ocf.read(read_bytes(parent.manifest_list))[1] + rows
        return self._list(snap, rows, operation, {"added-files": str(len(files))}, tag, specs)

    def _list(self, snap: int, rows: list[dict], operation: str, summary: dict[str, str], tag: str | None = None, specs: tuple[PartitionSpec, ...] | None = None) -> int:
        """Write a manifest list and publish its snapshot as the current one."""
        meta = self.metadata
        parent, seq, now = meta.current_snapshot, meta.last_sequence_number + 1, max(int(time.time() * 1000), meta.last_updated_ms + 1)
        path = f"{self.location}/metadata/snap-{snap}-1-{uuid.uuid4().hex}.avro"
        write_bytes(path, avro_ocf.write(list_schema(), rows, {"format-version": "2", "snapshot-id": str(snap), "sequence-number": str(seq)}))
        s = Snapshot(snap, now, parent.snapshot_id if parent else None, seq, path, Summary(operation, summary), meta.current_schema_id)
        refs = meta.refs | {MAIN: SnapshotRef(snap, "branch")} | ({tag: SnapshotRef(snap, "tag")} if tag else {})
        log = (*meta.metadata_log, (meta.last_updated_ms, self.metadata_location))
        self._publish(replace(meta, snapshots=(*meta.snapshots, s), current_snapshot_id=snap, snapshot_log=(*meta.snapshot_log, (now, snap)), refs=refs, last_updated_ms=now, last_sequence_number=seq, metadata_log=log, specs=specs or meta.specs))
        return snap


def _summary(files: list[dict], name: str, kind: t.Type) -> dict:
    values = [f["partition"].get(name) for f in files]
    there = sorted(v for v in values if v is not None)
    return {"contains_null": len(there) < len(values), "contains_nan": False, "lower_bound": to_bytes(there[0], kind) if there else None, "upper_bound": to_bytes(there[-1], kind) if there else None}


def combined_rows(a: dict, b: dict, meta: TableMetadata) -> dict:
    """Counts, least sequence number and partition summaries of the rows of two manifests of one spec, as one row has them."""
    kinds = [f.type for f in next(s for s in meta.specs if s.spec_id == a["partition_spec_id"]).partition_type(meta.schema()).fields]
    counts = {k: None if a[k] is None or b[k] is None else a[k] + b[k] for k in a if k.endswith("_count")}
    low = [x["min_sequence_number"] for x in (a, b)]
    return counts | {"min_sequence_number": None if None in low else min(low), "partitions": _combined(a["partitions"], b["partitions"], kinds)}


def _combined(a: list[dict] | None, b: list[dict] | None, kinds: list[t.Type]) -> list[dict] | None:
    """Partition summaries of two manifests as one's; what one of them doesn't know isn't known."""
    if a is None or b is None or not len(a) == len(b) == len(kinds):
        return None

    def ends(x: dict, y: dict, name: str, kind: t.Type, pick) -> bytes | None:
        # a NULL bound means that there is no value
        there = [v[name] for v in (x, y) if v[name] is not None]
        return there[0] if len(there) == 1 else pick(there, key=lambda v: order_key(from_bytes(v, kind), kind)) if there else None

    def flag(x: dict, y: dict, name: str) -> bool | None:
        return True if x[name] or y[name] else None if x[name] is None or y[name] is None else False

    return [{"contains_null": flag(x, y, "contains_null"), "contains_nan": flag(x, y, "contains_nan"), "lower_bound": ends(x, y, "lower_bound", k, min), "upper_bound": ends(x, y, "upper_bound", k, max)} for x, y, k in zip(a, b, kinds, strict=True)]
