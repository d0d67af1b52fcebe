"""Queries over metadata, catalogs, the command line, literals and file formats: what the planner reads and what surrounds it."""

from __future__ import annotations

import contextlib
import hashlib
import io
import json
import threading
from collections.abc import Callable, Iterator
from dataclasses import replace
from datetime import datetime
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import unquote, urlparse

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulith import cli
from tabulith import types as t
from tabulith.catalog import CatalogError, load_catalog
from tabulith.catalog_tables import read
from tabulith.functions.literals import Beyond, CastError, cast
from tabulith.functions.transforms import PartitionSpec, SortOrder, parse_transform
from tabulith.operators import compaction, schema_drift
from tabulith.operators.common import in_force
from tabulith.plans import expressions as e
from tabulith.plans.scan import SnapshotTable
from tabulith.queries_tables import LINES, table
from tabulith.schema import TableSchema
from tabulith.session import new_dir
from tabulith.sources import avro_ocf
from tabulith.sources.datafiles import NAME_MAPPING
from tabulith.sources.filesystem import filesystem, read_bytes, write_bytes
from tabulith.sources.metadata import TableMetadata
from tabulith.sources.writer import TableWriter, entry_schema, list_schema
from tabulith.streaming.follow import appended_files

_made: dict[tuple[str, str, str], TableWriter] = {}


def _once(build: Callable[[SparkSession, str], TableWriter]) -> Callable[[SparkSession, str], SnapshotTable]:
    """The table that ``build`` writes, once a session and folder, loaded from its metadata file."""

    def load(spark: SparkSession, d: str) -> SnapshotTable:
        key = (spark.sparkContext.applicationId, d, build.__name__)
        if key not in _made:
            _made[key] = build(spark, d)
        return SnapshotTable.load(spark, ("test", build.__name__), _made[key].metadata_location)

    return load


def _renamed(w: TableWriter) -> None:
    """Make a schema current in which a column has another name, one is gone and one is new."""
    s = w.metadata.schema()
    fields = tuple(replace(f, name="customer_name") if f.name == "c_name" else f for f in s.fields if f.name != "c_acctbal") + (t.Field(100, "note", t.STRING),)
    w.evolve(TableSchema(fields))


def _later(df: DataFrame) -> DataFrame:
    return df.where("c_custkey % 2 <> 0").select("c_custkey", F.col("c_name").alias("customer_name"), "c_nationkey", "c_mktsegment", F.lit("new").alias("note"))


def _written(df: DataFrame, folder: str, ending: str, pack: Callable[[pd.DataFrame], bytes]) -> list[dict]:
    """Write a file per partition and return entries of data files for the table's manifest."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        held = list(frames)
        d = pd.concat(held) if held else pd.DataFrame()
        if len(d):
            data, path = pack(d), f"{folder}/part-{TaskContext.get().partitionId()}.{ending}"
            write_bytes(path, data)
            yield pd.DataFrame([{"path": path, "n": len(d), "size": len(data)}])

    rows = df.mapInPandas(run, "path string, n bigint, size bigint").collect()  # one row for each new file
    return [{"content": 0, "file_path": r.path, "file_format": ending.upper(), "partition": {}, "record_count": r.n, "file_size_in_bytes": r.size} for r in rows]


@_once
def _orc(spark: SparkSession, d: str) -> TableWriter:
    """Even customers in ORC files whose columns carry ids, then a new schema and the odd ones in Parquet."""
    df = read(spark, d, "customer")
    w = TableWriter.create(spark, f"{new_dir(spark, 'table')}/orc", df.schema)
    ids = w.metadata.schema().id_of

    def pack(f: pd.DataFrame) -> bytes:
        from pyarrow import orc

        tab = pa.Table.from_pandas(f, preserve_index=False)
        tab = tab.cast(pa.schema([x.with_metadata({"field.id": str(ids[x.name])}) for x in tab.schema]))
        out = io.BytesIO()
        orc.write_table(tab, out)
        return out.getvalue()

    w.add_files(_written(df.where("c_custkey % 2 = 0").repartition(4), f"{w.location}/data/orc", "orc", pack))
    _renamed(w)
    w.append(_later(df))
    return w


@_once
def _mapped(spark: SparkSession, d: str) -> TableWriter:
    """Even customers in Parquet files without ids, which a name mapping gives them, then a new schema and the odd ones in files with ids."""
    df = read(spark, d, "customer")
    s = TableSchema.from_spark(df.schema)
    mapping = [{"field-id": f.id, "names": ["an_earlier_name", f.name]} for f in s.fields]
    w = TableWriter.create(spark, f"{new_dir(spark, 'table')}/mapped", df.schema, properties={NAME_MAPPING: json.dumps(mapping)})

    def pack(f: pd.DataFrame) -> bytes:
        import pyarrow.parquet as pq

        out = io.BytesIO()
        pq.write_table(pa.Table.from_pandas(f, preserve_index=False), out)
        return out.getvalue()

    w.add_files(_written(df.where("c_custkey % 2 = 0").repartition(4), f"{w.location}/data/plain", "parquet", pack))
    _renamed(w)
    w.append(_later(df))
    return w


@_once
def _avro(spark: SparkSession, d: str) -> TableWriter:
    """Orders in Avro files with ids."""
    df = read(spark, d, "orders")
    w = TableWriter.create(spark, f"{new_dir(spark, 'table')}/avro", df.schema)
    kinds = {"long": "long", "string": "string", "double": "double", "timestamp": {"type": "long", "logicalType": "timestamp-micros"}}
    schema = {"type": "record", "name": "orders", "fields": [{"name": f.name, "field-id": f.id, "type": ["null", kinds[f.type.name]]} for f in w.metadata.schema().fields]}

    def pack(f: pd.DataFrame) -> bytes:
        rows = f.assign(o_orderdate=f["o_orderdate"].astype("datetime64[us]").astype("int64")).to_dict("records")
        return avro_ocf.write(schema, rows)

    w.add_files(_written(df.repartition(4), f"{w.location}/data/avro", "avro", pack))
    return w


def _older(schema: dict, drop: set[str], rename: dict[str, str]) -> dict:
    """A format-1 schema from one of format 2: without the fields that came later, under the older names; what the rest inherits is there."""
    return schema | {"fields": [f | {"name": rename.get(f["name"], f["name"])} for f in schema["fields"] if f["name"] not in drop]}


@_once
def _first_format(spark: SparkSession, d: str) -> TableWriter:
    """Parts in a table of format 1: metadata, manifest list and manifests have no sequence numbers and no content, and some counts are missing."""
    w = TableWriter.create(spark, f"{new_dir(spark, 'table')}/first", read(spark, d, "part").schema, [("p_size", "identity")])
    w.append(read(spark, d, "part"), per_manifest=7)
    m = w.metadata
    kind = m.spec().partition_type(m.schema())
    rows = avro_ocf.read(read_bytes(m.current_snapshot.manifest_list))[1]
    old = _older(entry_schema(kind), {"sequence_number", "file_sequence_number"}, {})
    data = next(f for f in old["fields"] if f["name"] == "data_file")
    old["fields"] = [f for f in old["fields"] if f["name"] != "data_file"] + [data | {"type": _older(data["type"], {"content", "equality_ids"}, {})}]
    counts = {"added_files_count": "added_data_files_count", "existing_files_count": "existing_data_files_count", "deleted_files_count": "deleted_data_files_count"}
    later = {"content", "sequence_number", "min_sequence_number", "deleted_files_count", "deleted_rows_count"}
    for r in rows:
        write_bytes(r["manifest_path"], avro_ocf.write(old, [x | {"snapshot_id": m.current_snapshot_id} for x in avro_ocf.read(read_bytes(r["manifest_path"]))[1]], {"partition-spec": json.dumps(m.spec().to_json()["fields"])}))
    write_bytes(m.current_snapshot.manifest_list, avro_ocf.write(_older(list_schema(), later, counts), [{counts.get(k, k): v for k, v in r.items() if k not in later} for r in rows]))
    doc = replace(m, format_version=1).to_json()
    for k in ("schemas", "current-schema-id", "partition-specs", "default-spec-id", "last-partition-id", "sort-orders", "default-sort-order-id", "refs"):
        doc.pop(k)
    for s in doc["snapshots"]:
        s.pop("sequence-number")
    w.version += 1
    write_bytes(w.metadata_location, json.dumps(doc).encode())
    return w


@_once
def _many_manifests(spark: SparkSession, d: str) -> TableWriter:
    """Suppliers appended twice with a manifest for each file, which are joined by copying blocks; then all manifests are merged by decoding them."""
    df = read(spark, d, "supplier")
    w = TableWriter.create(spark, f"{new_dir(spark, 'table')}/manifests", df.schema, [("s_nationkey", "identity")])
    w.append(df.where("s_suppkey % 2 = 0"), per_manifest=1)
    w.append(df.where("s_suppkey % 2 <> 0"), per_manifest=1)
    compaction.rewrite_manifests(w, min_files=2)
    compaction.merge_manifests(w)
    return w


def _beside(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two one-row aggregates in one row."""
    return a.withColumn("_k", F.lit(1)).join(b.withColumn("_k", F.lit(1)), "_k").drop("_k")


def schema_evolution_orc(spark: SparkSession, d: str) -> DataFrame:
    """A renamed column of ORC files is found by its id."""
    return _orc(spark, d).scan().to_df()


def schema_evolution_mapped(spark: SparkSession, d: str) -> DataFrame:
    """A renamed column of files without ids is found by the name mapping."""
    return _mapped(spark, d).scan(row_filter=e.And(e.not_null("customer_name"), e.at_least("c_custkey", 0))).to_df()


def scan_avro(spark: SparkSession, d: str) -> DataFrame:
    return _avro(spark, d).scan(["o_orderkey", "o_orderdate", "o_totalprice"], e.at_least("o_totalprice", 1000)).to_df()


def scan_format_1(spark: SparkSession, d: str) -> DataFrame:
    """A table of format 1, with skipping by its partition."""
    return _first_format(spark, d).scan(["p_partkey", "p_brand", "p_size"], e.And(e.at_least("p_size", 10), e.less("p_size", 30))).to_df()


def manifests_format_1(spark: SparkSession, d: str) -> DataFrame:
    """What the older manifests lack: sequence numbers and content are 0, unknown counts stay unknown, and the files are there."""
    tb = _first_format(spark, d)
    m = tb.manifests().agg(F.max("sequence_number").alias("sequence_number"), F.max("content").alias("content"), F.count("deleted_files_count").alias("known_deleted"), F.sum("added_files_count").cast("long").alias("added_files"))
    f = tb.files().agg(F.max("sequence_number").alias("file_sequence"), F.sum("record_count").alias("n_rows"), F.count_distinct("snapshot_id").alias("n_snapshots"))
    return _beside(m, f)


def incremental_rewritten(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the files that the second snapshot added, though its manifests have been joined and merged since."""
    tb = _many_manifests(spark, d)
    f = appended_files(tb, after=tb.metadata.snapshots[0].snapshot_id)
    return f.agg(F.sum("record_count").alias("n_rows"))


def manifests_rewritten(spark: SparkSession, d: str) -> DataFrame:
    """Of each version the manifests and the rows of its files: joined by block copies in the third, merged in the fourth."""
    tb = _many_manifests(spark, d)
    out = None
    for k, s in enumerate(tb.metadata.snapshots):
        m = tb.manifests(s).agg(F.count("*").alias("n_manifests"))
        f = tb.files(s).agg(F.sum("record_count").alias("n_rows"), F.count("*").alias("n_files"), F.count_distinct("sequence_number").alias("n_commits"))
        part = _beside(m, f).select(F.lit(k).alias("version"), F.lit(s.summary.operation).alias("operation"), "*")
        out = part if out is None else out.unionByName(part)
    return out


def scan_rewritten(spark: SparkSession, d: str) -> DataFrame:
    return _many_manifests(spark, d).scan(["s_suppkey", "s_name"], e.is_in("s_nationkey", [1, 3, 5, 7])).to_df()


# --- metadata --------------------------------------------------------------------------------------------------------------------


def metadata_documents(spark: SparkSession, d: str) -> DataFrame:
    """A metadata document of every table, of its own format version, parsed, checked, brought to format 2, written and parsed again."""
    meta = read(spark, d, "table_metadata")
    cols = ["last_updated_ms", "format_version", "table_location", "last_column_id", "last_sequence_number", "current_snapshot_id", "current_schema_id", "table_props"]
    rows = in_force(meta.where("table_uuid IS NOT NULL"), ["table_uuid"], "last_updated_ms", cols)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for r in f.itertuples(index=False):
                number = lambda v: None if pd.isna(v) else int(v)
                version, current, schema_id = number(r.format_version), number(r.current_snapshot_id), number(r.current_schema_id) or 0
                schema = {"type": "struct", "schema-id": schema_id, "fields": [{"id": 1, "name": "a", "required": True, "type": "long"}]}
                doc = {"format-version": version, "table-uuid": r.table_uuid, "location": r.table_location, "last-updated-ms": number(r.last_updated_ms), "last-column-id": number(r.last_column_id), "properties": dict(r.table_props or {})}
                doc |= {"current-snapshot-id": -1 if current is None else current, "snapshots": [{"snapshot-id": current, "timestamp-ms": 1}] if current not in (None, -1) else []}
                if version == 1:
                    doc |= {"schema": schema, "partition-spec": [{"name": "a", "transform": "identity", "source-id": 1, "field-id": 1000}]}
                else:
                    doc |= {"schemas": [schema], "current-schema-id": schema_id, "partition-specs": [{"spec-id": 0, "fields": []}], "default-spec-id": 0, "last-partition-id": 999, "sort-orders": [{"order-id": 0, "fields": []}], "default-sort-order-id": 0, "last-sequence-number": number(r.last_sequence_number) or 0}
                m = TableMetadata.parse(json.dumps(doc))
                up = TableMetadata.parse(json.dumps(m.to_v2().to_json()))
                again = TableMetadata.parse(json.dumps(m.to_json()))
                main = up.refs["main"].snapshot_id if "main" in up.refs else None
                out.append((r.table_uuid, m.format_version, up.format_version, up.location, up.last_updated_ms, up.current_snapshot and up.current_snapshot.snapshot_id, main, up.last_sequence_number, up.schema().schema_id, len(up.spec().fields), up.last_partition_id, up.sort_order.order_id, len(up.properties), again == m))
            names = [c.split()[0] for c in ddl.split(", ")]
            ids = ("current_snapshot_id", "main_snapshot_id")
            yield pd.DataFrame({n: pd.array(v, dtype="Int64") if n in ids else list(v) for n, v in zip(names, zip(*out, strict=True), strict=True)})

    ddl = "table_uuid string, version_read int, version_up int, location string, last_updated_ms bigint, current_snapshot_id bigint, main_snapshot_id bigint, sequence_number bigint, schema_id int, n_spec_fields int, last_partition_id int, order_id int, n_props int, same_again boolean"
    # ids as texts: pandas turns longs with a NULL among them into doubles
    return rows.select("table_uuid", *cols).withColumn("current_snapshot_id", F.col("current_snapshot_id").cast("string")).mapInPandas(run, ddl)


def schema_index(spark: SparkSession, d: str) -> DataFrame:
    """Of every readable schema version of every table each field's full name, and how many fields a projection to the last field id keeps."""
    names = read(spark, d, "table_schemas").select("table_uuid", "schema_id", "schema_json", "recorded_at")
    held = schema_drift.read_versions(names)

    def rebuilt(nodes: dict) -> TableSchema:
        kids: dict = {}
        for i in sorted(nodes):
            kids.setdefault(nodes[i].parent, []).append(nodes[i])

        def kind(n) -> object:
            parts = {k.name: k for k in kids.get(n.id, ())}
            if n.type == "struct":
                return {"type": "struct", "fields": [field(k) for k in kids.get(n.id, ())]}
            if n.type == "list":
                x = parts["element"]
                return {"type": "list", "element-id": x.id, "element": kind(x), "element-required": x.required}
            if n.type == "map":
                k, v = parts["key"], parts["value"]
                return {"type": "map", "key-id": k.id, "key": kind(k), "value-id": v.id, "value": kind(v), "value-required": v.required}
            return n.type

        def field(n) -> dict:
            return {"id": n.id, "name": n.name, "required": n.required, "type": kind(n)}

        return TableSchema.from_json({"fields": [field(n) for n in kids.get(None, ())]})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for tab, v, tree in zip(f["t"], f["v"], f["tree"], strict=True):
                s = rebuilt(schema_drift._load(tree))
                s = TableSchema.from_json(s.to_json())
                last = s.highest_field_id
                kept = len(s.prune({last}, True).by_id) if last else 0
                out += [(tab, v, i, name, s.find(name).id == i, last, kept) for i, name in s.name_of.items()]
            yield pd.DataFrame(out, columns=["table_uuid", "schema_id", "field_id", "full_name", "found", "highest", "kept"])

    return held.mapInPandas(run, "table_uuid string, schema_id int, field_id int, full_name string, found boolean, highest int, kept int")


def literal_casts(spark: SparkSession, d: str) -> DataFrame:
    """Casts of literals between types, for the values of all orders; NULL where a value can't be cast, and the name of the side where one is out of range."""
    far = {Beyond.ABOVE: "above", Beyond.BELOW: "below"}

    def tried(v: object, to: t.Type, source: t.Type | None = None) -> object:
        try:
            x = cast(v, to, source)
        except CastError:
            return None
        return far.get(x, x) if isinstance(x, Beyond) else x

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for key, price, at, text in zip(f["o_orderkey"], f["o_totalprice"], f["o_orderdate"], f["o_orderpriority"], strict=True):
                at = datetime.fromisoformat(str(at)) if at is not None else None
                iso = at.isoformat(timespec="microseconds")
                row = {
                    "o_orderkey": key, "wide": str(tried(key * 1_000_000, t.INT)), "narrow": str(tried(-key * 1_000_000, t.INT)), "whole": tried(key, t.LONG, t.INT), "number": tried(key, t.DOUBLE), "day": tried(key, t.DATE), "clock": tried(key, t.TIME), "exact": str(tried(key, t.Decimal(20, 2))),
                    "single": tried(price, t.FLOAT), "twice": tried(tried(price, t.FLOAT), t.DOUBLE, t.FLOAT), "money": str(tried(price, t.Decimal(15, 2))), "beyond": str(tried(price * 1e40, t.FLOAT)), "day_of": tried(at, t.DATE), "zoned": tried(at, t.TIMESTAMPTZ),
                    "text_int": tried(str(key), t.INT), "text_long": str(tried(str(key) + "0" * 17, t.LONG)), "text_number": tried(repr(price), t.DOUBLE), "text_exact": str(tried(f"{price:.3f}", t.Decimal(15, 1))), "text_day": tried(iso[:10], t.DATE), "text_clock": tried(iso[11:], t.TIME),
                    "text_at": tried(iso, t.TIMESTAMP), "text_zoned": tried(iso + "+02:00", t.TIMESTAMPTZ), "text_flag": tried("TRUE" if key % 2 else "f", t.BOOLEAN), "text_uuid": tried(hashlib.md5(str(key).encode()).hexdigest(), t.UUID), "text_same": tried(text, t.STRING),
                    "text_bytes": tried(text, t.BINARY) is not None, "wrong": tried(text, t.LONG) is not None, "fixed": len(tried(text.encode()[:1], t.Fixed(1), t.BINARY)),
                }
                out.append(row)
            yield pd.DataFrame(out, columns=[c.split()[0] for c in ddl.split(", ")])

    ddl = (
        "o_orderkey bigint, wide string, narrow string, whole bigint, number double, day int, clock bigint, exact string, single double, twice double, money string, beyond string, day_of int, zoned bigint, text_int int, text_long string, "
        "text_number double, text_exact string, text_day int, text_clock bigint, text_at bigint, text_zoned bigint, text_flag boolean, text_uuid string, text_same string, text_bytes boolean, wrong boolean, fixed int"
    )
    src = read(spark, d, "orders").where("o_orderdate IS NOT NULL AND o_totalprice IS NOT NULL AND o_orderpriority IS NOT NULL AND o_orderkey IS NOT NULL")
    return src.select("o_orderkey", "o_totalprice", F.col("o_orderdate").cast("string").alias("o_orderdate"), "o_orderpriority").mapInPandas(run, ddl)


# name, expression, SQL over lineitem
FILTERS: tuple[tuple[str, e.Expression, str], ...] = (
    ("eq", e.equal("l_linenumber", 3), "l_linenumber = 3"),
    ("ne", e.not_equal("l_quantity", 7), "l_quantity <> 7"),
    ("lt", e.less("l_shipdate", "1996-02-29T00:00:00.000000"), "l_shipdate < TIMESTAMP '1996-02-29'"),
    ("le", e.at_most("l_extendedprice", 2000.5), "l_extendedprice <= 2000.5"),
    ("gt", e.greater("l_shipdate", "1998-06-30T12:00:00.000000"), "l_shipdate > TIMESTAMP '1998-06-30 12:00:00'"),
    ("ge", e.at_least("l_orderkey", 1000), "l_orderkey >= 1000"),
    ("in", e.is_in("l_shipdate", ["1997-05-01T00:00:00.000000", "1997-08-01T00:00:00.000000"]), "l_shipdate IN (TIMESTAMP '1997-05-01', TIMESTAMP '1997-08-01')"),
    ("not_in", e.not_in("l_returnflag", ["A", "R"]), "l_returnflag NOT IN ('A', 'R')"),
    ("is_null", e.is_null("l_shipdate"), "l_shipdate IS NULL"),
    ("not_null", e.not_null("l_shipdate"), "l_shipdate IS NOT NULL"),
    ("is_nan", e.is_nan("l_discount"), "isnan(l_discount)"),
    ("not_nan", e.not_nan("l_discount"), "NOT isnan(l_discount)"),
    ("starts_with", e.starts_with("l_linestatus", "F"), "l_linestatus LIKE 'F%'"),
    ("not_starts_with", e.Not(e.starts_with("l_returnflag", "N")), "l_returnflag NOT LIKE 'N%'"),
    ("beyond", e.less("l_linenumber", 1 << 40), "l_linenumber IS NOT NULL"),
    ("both", e.And(e.greater("l_quantity", 40), e.Or(e.equal("l_returnflag", "A"), e.less("l_shipdate", "1995-01-01T00:00:00.000000"))), "l_quantity > 40 AND (l_returnflag = 'A' OR l_shipdate < TIMESTAMP '1995-01-01')"),
)


def filter_rules(spark: SparkSession, d: str) -> DataFrame:
    """Rows that each kind of filter leaves of lineitem with file skipping, and whether any file was skipped that shouldn't be."""
    tb, out = table(spark, d, "lineitem"), None
    for name, expr, _ in FILTERS:
        part = tb.scan(["l_orderkey"], expr).to_df().agg(F.count("*").alias("n"), F.sum("l_orderkey").alias("keys")).select(F.lit(name).alias("filter"), "n", "keys")
        out = part if out is None else out.unionByName(part)
    return out


def plan_files_table(spark: SparkSession, d: str) -> DataFrame:
    """The file tasks of lineitem: each starts at 0 and is as long as its file, and their rows are all rows."""
    p = table(spark, d, "lineitem").scan(LINES).plan_files()
    return p.agg(F.count("*").alias("n_tasks"), F.max("start").alias("greatest_start"), F.sum((F.col("length") > 0).cast("int")).alias("n_long"), F.sum((F.col("size_with_deletes") == F.col("length")).cast("int")).alias("n_without_deletes"), F.sum("record_count").alias("n_rows"))


def text_forms(spark: SparkSession, d: str) -> DataFrame:
    """How transforms, specs and sort orders read and write their text and JSON forms, strictly."""

    def said(f: Callable[[], object]) -> str:
        try:
            return str(f())
        except ValueError:
            return "error"

    field = {"source-id": 3, "transform": "bucket[4]", "direction": "desc", "null-order": "nulls-last"}
    order = lambda **k: SortOrder.from_json({"order-id": 2, "fields": [{a: b for a, b in (field | k).items() if b is not None}]})
    rows = [(x, said(lambda x=x: parse_transform(x))) for x in ("identity", "void", "year", "month", "day", "hour", "bucket[16]", "truncate[9]", "bucket[]", "truncate[-1]", "week", "")]
    rows += [("spec", said(lambda: PartitionSpec.from_json({"spec-id": 3, "fields": [{"source-id": 4, "field-id": 1001, "transform": "truncate[19]", "name": "str_truncate"}]}).to_json()["fields"][0]["transform"]))]
    rows += [("order", said(lambda: order().to_json()["fields"][0]["null-order"])), ("order without direction", said(lambda: order(direction=None))), ("order of bad nulls", said(lambda: order(**{"null-order": "maybe"}))), ("order id", said(lambda: order().order_id)), ("unsorted", said(lambda: SortOrder().order_id))]
    return spark.createDataFrame(rows, "case string, result string")


def file_systems(spark: SparkSession, d: str) -> DataFrame:
    """The data files of lineitem opened by their locations: as many bytes as the manifests say, and Parquet's mark at both ends."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for path in f["file_path"]:
                fs, p = filesystem(path)
                with fs.open_input_file(p) as x:
                    size = x.size()
                    head, _ = x.read(4), x.seek(size - 4)
                    out.append((path, size, bytes(head) == bytes(x.read(4)) == b"PAR1"))
            yield pd.DataFrame(out, columns=["p", "size", "marked"])

    files = table(spark, d, "lineitem").files().select("file_path", "file_size_in_bytes", F.get_json_object("partition_json", "$.l_shipdate_month").cast("int").alias("month"))
    opened = files.select("file_path").mapInPandas(run, "p string, size bigint, marked boolean")
    out = files.join(opened, F.col("file_path") == F.col("p"))
    return out.groupBy("month").agg((F.sum("size") == F.sum("file_size_in_bytes")).alias("same_size"), F.min("marked").alias("marked"))


# --- catalogs --------------------------------------------------------------------------------------------------------------------


def _attempt(f: Callable[[], object]) -> str:
    try:
        f()
    except CatalogError as x:
        return type(x).__name__
    return "done"


def _worked(cat, regions: dict[str, list[str]], make_table: Callable[[str], None]) -> list[tuple[str, str]]:
    """What a catalog says in the course of some work: a namespace for each region, a table for each nation."""
    out: list[tuple[str, str]] = []
    for r, nations in regions.items():
        cat.create_namespace(r, {"size": str(len(nations))})
        for n in nations:
            make_table(f"{r}.{n}")
    out += [("namespace", ".".join(x)) for x in cat.list_namespaces()]
    out += [("table", ".".join(x)) for r in regions for x in cat.list_tables(r)]
    out += [("size", f"{r}={cat.load_namespace_properties(r)['size']}") for r in regions]
    first = sorted(regions)[0]
    nation = sorted(regions[first])[0]
    got = cat.update_namespace_properties(first, ["size", "none"], {"kind": "region"})
    out += [(k, ",".join(sorted(v))) for k, v in got.items()]
    cat.rename_table(f"{first}.{nation}", f"{first}.other")
    out += [("renamed", _attempt(lambda: cat.load_table(f"{first}.{nation}"))), ("loaded", str(cat.load_table(f"{first}.other").scan().to_df().count()))]
    cat.drop_table(f"{first}.other")
    out += [("again", _attempt(lambda: cat.create_namespace(first))), ("full", _attempt(lambda: cat.drop_namespace(first))), ("missing", _attempt(lambda: cat.list_tables("nowhere"))), ("left", str(len(cat.list_tables(first)))), ("refreshed", str(cat.load_table(f"{first}.{sorted(regions[first])[1]}").refresh().metadata.format_version))]
    for n in sorted(regions[first])[1:]:
        cat.drop_table(f"{first}.{n}")
    out += [("emptied", _attempt(lambda: cat.drop_namespace(first))), ("namespaces", str(len(cat.list_namespaces())))]
    return out


def _regions(spark: SparkSession, d: str) -> dict[str, list[str]]:
    """The few regions and their nations, by name."""
    rows = read(spark, d, "region").join(read(spark, d, "nation"), F.col("r_regionkey") == F.col("n_regionkey")).select("r_name", "n_name").collect()
    out: dict[str, list[str]] = {}
    for r in sorted(rows):
        out.setdefault(r.r_name.replace(" ", "_"), []).append(r.n_name.replace(" ", "_"))
    return out


def catalog_local(spark: SparkSession, d: str) -> DataFrame:
    cat = load_catalog(spark, "local", f"{new_dir(spark, 'catalog')}/lake", {})
    one = spark.range(3)
    rows = _worked(cat, _regions(spark, d), lambda n: cat.create_table(n, one.schema).append(one, files=1))
    return spark.createDataFrame(rows, "step string, result string")


class _Service(BaseHTTPRequestHandler):
    """A small catalog service in memory, for the query that works with the REST catalog."""

    spaces: dict[str, dict[str, str]]
    tables: dict[tuple[str, str], str]
    token = "t0k"

    def _answer(self, code: int, body: object = None, kind: str = "Error") -> None:
        data = b"" if body is None and code < 300 else json.dumps(body if code < 300 else {"error": {"message": "no", "type": kind, "code": code}}).encode()
        self.send_response(code)
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        self.wfile.write(data)

    def _any(self) -> None:
        body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
        path = [unquote(x) for x in urlparse(self.path).path.strip("/").split("/")][1:]
        if path == ["oauth", "tokens"]:
            return self._answer(200, {"access_token": self.token})
        if self.headers.get("Authorization") != f"Bearer {self.token}":
            return self._answer(401)
        if path == ["config"]:
            return self._answer(200, {"defaults": {}, "overrides": {"prefix": "p"}})
        path, x = path[1:], json.loads(body) if body else {}
        if path == ["tables", "rename"]:
            a, b = ((i["namespace"][0], i["name"]) for i in (x["source"], x["destination"]))
            if a not in self.tables:
                return self._answer(404)
            self.tables[b] = self.tables.pop(a)
            return self._answer(204)
        if path == ["namespaces"]:
            if self.command == "GET":
                return self._answer(200, {"namespaces": [[n] for n in self.spaces]})
            name = x["namespace"][0]
            if name in self.spaces:
                return self._answer(409)
            self.spaces[name] = x["properties"]
            return self._answer(200, x)
        name = path[1]
        if name not in self.spaces:
            return self._answer(404)
        here = [k for k in self.tables if k[0] == name]
        if len(path) == 2:
            if self.command == "GET":
                return self._answer(200, {"properties": self.spaces[name]})
            if here:
                return self._answer(409)
            del self.spaces[name]
            return self._answer(204)
        if path[2] == "properties":
            gone = [k for k in x["removals"] if self.spaces[name].pop(k, None) is not None]
            self.spaces[name] |= x["updates"]
            return self._answer(200, {"removed": gone, "updated": list(x["updates"]), "missing": [k for k in x["removals"] if k not in gone]})
        if len(path) == 3:
            return self._answer(200, {"identifiers": [{"namespace": [n], "name": k} for n, k in here]})
        key = (name, path[3])
        if key not in self.tables:
            return self._answer(404)
        if self.command == "DELETE":
            del self.tables[key]
            return self._answer(204)
        return self._answer(200, {"metadata-location": self.tables[key], "metadata": json.loads(read_bytes(self.tables[key])), "config": {}})

    do_GET = do_POST = do_DELETE = _any

    def log_message(self, *args: object) -> None:
        pass


def catalog_rest(spark: SparkSession, d: str) -> DataFrame:
    """The same work over HTTP, with a token for a credential and a prefix that the service demands."""
    made = TableWriter.create(spark, f"{new_dir(spark, 'catalog')}/rest", spark.range(1).schema)
    made.append(spark.range(3), files=1)
    tables: dict[tuple[str, str], str] = {}
    service = type("Service", (_Service,), {"spaces": {}, "tables": tables})
    server = ThreadingHTTPServer(("127.0.0.1", 0), service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        cat = load_catalog(spark, "rest", f"http://127.0.0.1:{server.server_port}", {"credential": "me:secret"})
        rows = _worked(cat, _regions(spark, d), lambda n: tables.update({tuple(n.split(".")): made.metadata_location}))
    finally:
        server.shutdown()
    return spark.createDataFrame(rows, "step string, result string")


def command_line(spark: SparkSession, d: str) -> DataFrame:
    """What the commands print about a catalog with the nations in it."""
    uri = f"{new_dir(spark, 'catalog')}/cli"
    cat = load_catalog(spark, "local", uri, {})
    cat.create_namespace("world")
    nation = read(spark, d, "nation")
    cat.create_table("world.nation", nation.schema, [("n_regionkey", "identity")]).append(nation)
    out = []

    def run(name: str, *argv: str, keep: Callable[[str], str] = str.strip) -> None:
        text = io.StringIO()
        with contextlib.redirect_stdout(text), contextlib.redirect_stderr(io.StringIO()):
            code = cli.run(cli.parser().parse_args(["--uri", uri, *argv]), spark)
        out.append((name, code, keep(text.getvalue())))

    run("list", "list")
    run("tables", "list", "world")
    run("uuid", "uuid", "world.nation", keep=lambda x: str(len(x.strip())))
    run("location", "location", "world.nation", keep=lambda x: x.strip().rsplit("/", 2)[-1])
    run("schema", "schema", "world.nation", keep=lambda x: str(sum(": " in line for line in x.splitlines())))
    run("spec", "spec", "world.nation", keep=lambda x: str("identity(3)" in x))
    run("describe", "describe", "world.nation", keep=lambda x: str("Table format version | 2" in x))
    run("files", "files", "world.nation", keep=lambda x: str(x.count("Datafile: ")))
    run("history", "--output", "json", "files", "world.nation", "--history", keep=lambda x: str(len(json.loads(x))))
    run("set", "properties", "set", "table", "world.nation", "owner", "me")
    run("get", "properties", "get", "table", "world.nation", "owner")
    run("remove", "properties", "remove", "table", "world.nation", "owner")
    run("get again", "properties", "get", "table", "world.nation", "owner")
    run("rename", "rename", "world.nation", "world.land")
    run("missing", "describe", "table", "world.nation")
    run("drop", "drop", "table", "world.land")
    run("drop namespace", "drop", "namespace", "world")
    run("empty", "list")
    return spark.createDataFrame(out, "command string, code int, printed string")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        schema_evolution_orc, schema_evolution_mapped, scan_avro, scan_format_1, manifests_format_1, incremental_rewritten, manifests_rewritten, scan_rewritten, metadata_documents, schema_index, literal_casts, filter_rules,
        plan_files_table, text_forms, file_systems, catalog_local, catalog_rest, command_line,
    )
    return {f.__name__: f for f in own}
