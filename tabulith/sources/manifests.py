"""Manifest lists and manifests as DataFrames, decoded in parallel by the executors."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulith import types as t
from tabulith.functions.literals import order_key
from tabulith.session import materialize
from tabulith.sources import avro_ocf
from tabulith.sources.filesystem import filesystem, read_bytes

SUMMARIES = "array<struct<contains_null:boolean,contains_nan:boolean,lower_bound:binary,upper_bound:binary>>"
MANIFESTS = (
    "manifest_path string, manifest_length bigint, partition_spec_id int, content int, sequence_number bigint, min_sequence_number bigint, added_snapshot_id bigint, added_files_count int, "
    f"existing_files_count int, deleted_files_count int, added_rows_count bigint, existing_rows_count bigint, deleted_rows_count bigint, partitions {SUMMARIES}"
)
ENTRIES = (
    "manifest_path string, spec_id int, status int, snapshot_id bigint, sequence_number bigint, file_sequence_number bigint, content int, file_path string, file_format string, partition map<int,string>, "
    "partition_json string, partition_known boolean, record_count bigint, file_size_in_bytes bigint, column_sizes map<int,bigint>, value_counts map<int,bigint>, null_value_counts map<int,bigint>, nan_value_counts map<int,bigint>, "
    "lower_bounds map<int,binary>, upper_bounds map<int,binary>, key_metadata binary, split_offsets array<bigint>, equality_ids array<int>, sort_order_id int"
)
# Format-1 names of counts and format-2 ones.
OLD_COUNTS = {"added_files_count": "added_data_files_count", "existing_files_count": "existing_data_files_count", "deleted_files_count": "deleted_data_files_count"}
EXISTING, ADDED, DELETED = 0, 1, 2
DATA, POSITION_DELETES, EQUALITY_DELETES = 0, 1, 2
#: A single manifest list of up to this many bytes is decoded by the driver, which keeps its rows as a local relation; a larger one is a task's work.
LOCAL_LIST_BYTES = 4 << 20
#: Manifests are decoded by at most this many tasks.
DECODE_TASKS = 10_000


def manifest_rows(data: bytes) -> list[dict]:
    """Rows of a manifest list. Format 1 has no content and no sequence numbers: they are 0. Counts that it leaves out stay NULL."""
    meta, records = avro_ocf.read(data)
    new = meta.get("format-version") == "2"
    out = []
    for r in records:
        row = {c.split(" ")[0]: r.get(c.split(" ")[0]) for c in MANIFESTS.split(", ")[:13]}
        if not new:
            row |= {k: r.get(v, r.get(k)) for k, v in OLD_COUNTS.items()} | {"content": 0, "sequence_number": 0, "min_sequence_number": 0}
        out.append(row | {"partitions": r.get("partitions")})
    return out


def _kinds(meta: dict[str, str]) -> dict[str, tuple[int | None, t.Type | None]]:
    """Id and type of each partition field, as the file's own schema has them; an id that it lacks is that of the field of that name in the
    spec that the file carries."""
    schema = meta["avro.schema"]
    try:
        named = {f["name"]: f.get("field-id") for f in json.loads(meta.get("partition-spec", "[]"))}
    except (ValueError, TypeError, KeyError):
        named = {}
    fields = next((f["type"] for f in json.loads(schema)["fields"] if f["name"] == "data_file"), {}).get("fields", ())
    part = next((f["type"] for f in fields if f["name"] == "partition"), {})
    out: dict[str, tuple[int | None, t.Type | None]] = {}
    for f in part.get("fields", ()):
        kind = f["type"]
        kind = next((k for k in kind if k != "null"), "null") if isinstance(kind, list) else kind
        logical = kind.get("logicalType") if isinstance(kind, dict) else None
        name = kind["type"] if isinstance(kind, dict) else kind
        typed: t.Type | None = {"boolean": t.BOOLEAN, "int": t.INT, "long": t.LONG, "float": t.FLOAT, "double": t.DOUBLE, "string": t.STRING, "bytes": t.BINARY}.get(name)
        if logical == "decimal":
            typed = t.Decimal(kind["precision"], kind.get("scale", 0))
        elif name == "fixed":
            typed = t.UUID if logical == "uuid" else t.Fixed(kind["size"])
        out[f["name"]] = (f.get("field-id", named.get(f["name"])), typed)
    return out


def _key(v: object, kind: t.Type | None) -> str | None:
    """The order key of a partition value as text (bytes as hex digits, which sort alike)."""
    if v is None or kind is None:
        return None
    if isinstance(kind, t.Decimal):
        from decimal import Decimal as Dec

        v = Dec(int.from_bytes(v, "big", signed=True)).scaleb(-kind.scale)
    if kind == t.UUID:
        return bytes(v).hex().upper()
    k = order_key(v, kind)
    return k.hex().upper() if isinstance(k, bytes) else k


def entry_rows(data: bytes, manifest: dict) -> list[dict]:
    """Entries of one manifest with what they inherit from its row: a snapshot id that is missing, and sequence numbers that are missing where
    the manifest has number 0 or the entry was added. Format-1 entries have number 0."""
    meta, records = avro_ocf.read(data)
    new = meta.get("format-version") == "2" or any("sequence_number" in r for r in records[:1])
    kinds = _kinds(meta)
    out = []
    for r in records:
        d = r["data_file"]
        row = {k: d.get(k) for k in ("file_path", "file_format", "record_count", "file_size_in_bytes", "column_sizes", "value_counts", "null_value_counts", "nan_value_counts", "lower_bounds", "upper_bounds", "key_metadata", "split_offsets", "equality_ids", "sort_order_id")}
        part = d.get("partition") or {}
        row["partition"] = {i: k for n, v in part.items() if (i := kinds.get(n, (None, None))[0]) is not None and (k := _key(v, kinds[n][1])) is not None}
        # a value whose field or type isn't known is left out of the map, which otherwise means NULL
        row["partition_known"] = all(n in kinds and kinds[n][0] is not None and (v is None or kinds[n][1] is not None) for n, v in part.items())
        row["partition_json"] = json.dumps({n: v.hex() if isinstance(v, bytes) else v for n, v in part.items()}, sort_keys=True)
        row |= {"status": r["status"], "snapshot_id": r.get("snapshot_id"), "content": d.get("content") or 0, "manifest_path": manifest["manifest_path"], "spec_id": manifest["partition_spec_id"]}
        seq, file_seq = r.get("sequence_number"), r.get("file_sequence_number")
        inherit = manifest["sequence_number"] == 0 or r["status"] == ADDED
        if not new:
            seq = file_seq = 0
        if row["snapshot_id"] is None:
            row["snapshot_id"] = manifest["added_snapshot_id"]
        if seq is None and inherit:
            seq = manifest["sequence_number"]
        if file_seq is None and inherit:
            file_seq = manifest["sequence_number"]
        out.append(row | {"sequence_number": seq, "file_sequence_number": file_seq})
    return out


def _frame(rows: list[dict], ddl: str) -> pd.DataFrame:
    names = _names(ddl)
    return pd.DataFrame({n: pd.Series([r.get(n) for r in rows], dtype=object) for n in names})


def _names(ddl: str) -> list[str]:
    out, depth, word = [], 0, ""
    for ch in ddl + ",":
        depth += (ch in "<(") - (ch in ">)")
        if ch == "," and depth == 0:
            out.append(word.split()[0])
            word = ""
        else:
            word += ch
    return out


def _local(spark: SparkSession, rows: list[dict], ddl: str) -> DataFrame:
    """Few rows as a local relation: Catalyst filters it while planning, without a job."""
    from pyspark.sql.pandas.types import to_arrow_schema

    empty = spark.createDataFrame([], ddl)
    return spark.createDataFrame(pa.Table.from_pylist([{n: r.get(n) for n in empty.columns} for r in rows], schema=to_arrow_schema(empty.schema)), empty.schema)


def _is_local(df: DataFrame) -> bool:
    return df._jdf.queryExecution().optimizedPlan().getClass().getSimpleName() == "LocalRelation"


def read_lists(spark: SparkSession, lists: list[str], props: dict[str, str] | None = None) -> DataFrame:
    """Rows of the named manifest lists; ``manifest_list`` names the list. A single one of up to ``LOCAL_LIST_BYTES`` becomes a local relation, else there
    is one task per list. No lists: no rows."""
    ddl = "manifest_list string, " + MANIFESTS
    lists = [x for x in lists if x]
    if len(lists) == 1:
        fs, path = filesystem(lists[0], props)
        info = fs.get_file_info(path)
        if not info.is_file:
            raise FileNotFoundError(lists[0])
        if info.size <= LOCAL_LIST_BYTES:
            return _local(spark, [{"manifest_list": lists[0], **r} for r in manifest_rows(read_bytes(lists[0], props))], ddl)
    src = spark.createDataFrame([(x,) for x in lists], "manifest_list string")

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for x in f["manifest_list"]:
                rows = [{"manifest_list": x, **r} for r in manifest_rows(read_bytes(x, props))]
                for a in range(0, len(rows), 5000):
                    yield _frame(rows[a : a + 5000], ddl)

    return src.repartition(max(1, min(len(lists), DECODE_TASKS))).mapInPandas(decode, ddl)


# numbers as texts: pandas turns a column of longs with a NULL among them into doubles, which don't hold a snapshot's id
HEADS = "manifest_path string, partition_spec_id string, sequence_number string, added_snapshot_id string"


def spread_manifests(manifests: DataFrame) -> DataFrame:
    """Each manifest once, over as many partitions as there are manifests, up to ``DECODE_TASKS``. The rows are tiny, so the number of partitions is given: left to
    adaptive execution, all of them would meet in one task. A local relation is sliced evenly as it is."""
    src = manifests.select(*[F.col(n).cast("string") for n in _names(HEADS)])
    if _is_local(src):
        return _local(src.sparkSession, [r.asDict() for r in {r.manifest_path: r for r in src.collect()}.values()], HEADS)  # no job: the rows are here
    src = materialize(src.dropDuplicates(["manifest_path"]), "manifests")
    return src.repartition(max(1, min(src.count(), DECODE_TASKS)), "manifest_path")


def read_entries(manifests: DataFrame, props: dict[str, str] | None = None, discard_deleted: bool = False) -> DataFrame:
    """Entries of the manifests in a table of manifest rows, each decoded where ``spread_manifests`` put its row."""

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for m in f.to_dict("records"):
                m = {k: v if k == "manifest_path" or v is None else int(v) for k, v in m.items()}
                rows = entry_rows(read_bytes(m["manifest_path"], props), m)
                for a in range(0, len(rows), 5000):
                    yield _frame(rows[a : a + 5000], ENTRIES)

    out = spread_manifests(manifests).mapInPandas(decode, ENTRIES)
    return out.where(F.col("status") != DELETED) if discard_deleted else out


def has_files(added: str = "added_files_count", existing: str = "existing_files_count"):
    """Whether a manifest may hold living files: a count that is unknown may be positive."""
    return F.coalesce(F.col(added) > 0, F.lit(True)) | F.coalesce(F.col(existing) > 0, F.lit(True))
