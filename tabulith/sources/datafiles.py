"""Data files in their formats, with columns found by field id.

Parquet files with ids are read by Spark's own id matching. Of other files a task looks at the schema once; files of one physical layout are read together
under their own names and then brought into the table's form. Ids stand in the file (Parquet, ORC attributes, Avro) or follow from the table's name mapping.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulith import types as t
from tabulith.schema import TableSchema
from tabulith.sources import avro_ocf
from tabulith.sources.filesystem import filesystem, spark_path

FORMATS = ("parquet", "orc", "avro")
NAME_MAPPING = "schema.name-mapping.default"
LAYOUT_TASKS = 2_000
AVRO_ROWS = 5_000
WALL = "wall"  # a time without zone, which Spark's ORC reader gives as one of the JVM's zone
# Arrow's widths of types that may have been promoted since the file was written.
NARROW = {pa.int8(): "int", pa.int16(): "int", pa.int32(): "int", pa.int64(): "long", pa.float32(): "float", pa.float64(): "double"}


class UnresolvedColumns(ValueError):
    """A file names no field ids and the table has no name mapping for it."""


def _id(meta: dict | None) -> int | None:
    """The id in a field's metadata: Parquet's own, or an attribute whose last part is ``id``."""
    for k, v in (meta or {}).items():
        if k.decode() in ("PARQUET:field_id", "id") or k.decode().endswith(".id"):
            try:
                return int(v)
            except ValueError:
                return None
    return None


def _node(f: pa.Field) -> list:
    """[name, id, kind, children] of an Arrow field."""
    k = f.type
    if pa.types.is_struct(k):
        return [f.name, _id(f.metadata), "struct", [_node(k.field(i)) for i in range(k.num_fields)]]
    if pa.types.is_map(k):
        return [f.name, _id(f.metadata), "map", [["key", *_node(k.key_field)[1:]], ["value", *_node(k.item_field)[1:]]]]
    if pa.types.is_list(k) or pa.types.is_large_list(k):
        return [f.name, _id(f.metadata), "list", [["element", *_node(k.value_field)[1:]]]]
    if pa.types.is_decimal(k):
        return [f.name, _id(f.metadata), f"decimal({k.precision},{k.scale})", []]
    wall = pa.types.is_timestamp(k) and k.tz is None and (f.metadata or {}).get(b"spark.sql.catalyst.type") != b"timestamp_ntz"
    return [f.name, _id(f.metadata), WALL if wall else NARROW.get(k, ""), []]


def _layout(fmt: str, path: str, props: dict[str, str] | None) -> list:
    import pyarrow.parquet as pq
    from pyarrow import orc

    fs, p = filesystem(path, props)
    with fs.open_input_file(p) as f:
        schema = pq.ParquetFile(f).schema_arrow if fmt == "parquet" else orc.ORCFile(f).schema
    return [_node(x) for x in schema]


def _has_ids(nodes: list) -> bool:
    return any(n[1] is not None or _has_ids(n[3]) for n in nodes)


def _mapped(nodes: list, mapping: list[dict]) -> list:
    """The layout with the ids that the mapping gives to names, level by level."""
    by = {name: m for m in mapping for name in m.get("names", ())}
    return [[n[0], by.get(n[0], {}).get("field-id"), n[2], _mapped(n[3], by.get(n[0], {}).get("fields", ()))] for n in nodes]


def _layouts(spark: SparkSession, fmt: str, paths: list[str], props: dict[str, str] | None) -> dict[str, list[str]]:
    """Paths by layout (as JSON). As many layouts as there are ways in which the files were written."""

    def look(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(layout=[json.dumps(_layout(fmt, p, props)) for p in f["path"]])

    src = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, min(len(paths), LAYOUT_TASKS)))
    out: dict[str, list[str]] = {}
    for r in src.mapInPandas(look, "path string, layout string").collect():  # the paths are the driver's own
        out.setdefault(r.layout, []).append(r.path)
    return out


def _physical(nodes: list, fields: tuple[t.Field, ...], orc: bool) -> list[T.StructField]:
    """What to ask the file for, under its own names: the parts of ``fields`` that it has."""
    by = {n[1]: n for n in nodes if n[1] is not None}
    return [T.StructField(by[f.id][0], _physical_type(by[f.id], f.type, orc)) for f in fields if f.id in by]


def _physical_type(node: list, want: t.Type, orc: bool) -> T.DataType:
    kids = {n[0]: n for n in node[3]}
    if isinstance(want, t.Struct):
        return T.StructType(_physical(node[3], want.fields, orc))
    if isinstance(want, t.List):
        return T.ArrayType(_physical_type(kids["element"], want.element, orc))
    if isinstance(want, t.Map):
        return T.MapType(_physical_type(kids["key"], want.key, orc), _physical_type(kids["value"], want.value, orc))
    if orc and want == t.TIMESTAMP and node[2] == WALL:
        return T.TimestampType()
    narrow = want.name in ("int", "long", "float", "double") if isinstance(want, t.Primitive) else isinstance(want, t.Decimal)
    return t.to_spark(t.type_from_json(node[2])) if narrow and node[2] else t.to_spark(want, False)


def _shaped(c: Column, node: list, want: t.Type, zone: str | None) -> Column:
    """A column of the file's form in the table's: parts found by id, missing ones NULL, promoted types cast. ``zone`` (for ORC) is the JVM's."""
    kids = {n[0]: n for n in node[3]}
    if isinstance(want, t.Struct):
        by = {n[1]: n for n in node[3] if n[1] is not None}
        parts = [(_shaped(c.getField(by[f.id][0]), by[f.id], f.type, zone) if f.id in by else F.lit(None).cast(t.to_spark(f.type, False))).alias(f.name) for f in want.fields]
        return F.when(c.isNotNull(), F.struct(*parts)) if parts else c
    if isinstance(want, t.List):
        return F.transform(c, lambda x: _shaped(x, kids["element"], want.element, zone))
    if isinstance(want, t.Map):
        return F.transform_values(c, lambda k, v: _shaped(v, kids["value"], want.value, zone))
    if zone and want == t.TIMESTAMP and node[2] == WALL:
        return F.convert_timezone(F.current_timezone(), F.lit(zone), c.cast("timestamp_ntz"))
    return c.cast(t.to_spark(want, False))


def _parquet_by_id(spark: SparkSession, paths: list[str], schema: TableSchema, pushdown: bool) -> DataFrame:
    """Spark finds the columns by id, whatever they were called when the file was written. That takes a setting of the session that a scan was made in, and
    reader options don't reach it, so the scan is made in a copy of the session; what is built on it belongs to the user's session, whose settings stay.
    Spark looks for the columns of pushed filters by name, though: without ``pushdown`` none are."""
    copy = spark._jsparkSession.cloneSession()
    copy.conf().set("spark.sql.parquet.fieldId.read.enabled", "true")
    if not pushdown:
        copy.conf().set("spark.sql.parquet.filterPushdown", "false")
    reader = copy.read().schema(copy.parseDataType(schema.to_spark().json())).format("parquet")
    scan = reader.load(spark._jvm.PythonUtils.toSeq([spark_path(p) for p in paths]))
    return DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, scan.logicalPlan()), spark)


def read_files(spark: SparkSession, fmt: str, paths: list[str], schema: TableSchema, properties: dict[str, str], props: dict[str, str] | None = None, rows: bool = False, pushdown: bool = True) -> DataFrame:
    """The rows of the files with the columns of ``schema``; ``rows`` adds ``_tab_path`` and ``_tab_pos``, the file and the row's place in it (NULL for ORC,
    which has none). ``properties`` are the table's, ``props`` those of the file system. Columns that a file lacks are NULL. Files without ids
    need the table's name mapping; without one they raise ``UnresolvedColumns``, for going by current names would give wrong columns silently. ``pushdown`` must be off if a file may have another field under
    the name of one of these columns."""
    if fmt not in FORMATS:
        raise ValueError(f"no reader for {fmt} data files")
    mapping = json.loads(properties[NAME_MAPPING]) if NAME_MAPPING in properties else None
    if fmt == "avro":
        return _read_avro(spark, paths, schema, mapping, props, rows)

    def place(df: DataFrame) -> list[Column]:
        if not rows:
            return []
        return [F.col("_metadata.file_path").alias("_tab_path"), (F.col("_metadata.row_index") if fmt == "parquet" else F.lit(None).cast("long")).alias("_tab_pos")]

    def by_id(some: list[str]) -> DataFrame:
        df = _parquet_by_id(spark, some, schema, pushdown)
        return df.select("*", *place(df)) if rows else df

    if fmt == "parquet" and mapping is None:
        return by_id(paths)
    out, zone = None, spark._jvm.java.util.TimeZone.getDefault().getID() if fmt == "orc" else None
    for text, some in sorted(_layouts(spark, fmt, paths, props).items()):
        nodes = json.loads(text)
        if _has_ids(nodes):
            if fmt == "parquet":
                part = by_id(some)
                out = part if out is None else out.unionByName(part)
                continue
        elif mapping is None:
            raise UnresolvedColumns(f"{some[0]} names no field ids and the table has no {NAME_MAPPING}")
        else:
            nodes = _mapped(nodes, mapping)
        by = {n[1]: n for n in nodes if n[1] is not None}
        df = spark.read.schema(T.StructType(_physical(nodes, schema.fields, fmt == "orc"))).format(fmt).load([spark_path(p) for p in some])
        cols = [(_shaped(F.col("`" + by[f.id][0].replace("`", "``") + "`"), by[f.id], f.type, zone) if f.id in by else F.lit(None).cast(t.to_spark(f.type, False))).alias(f.name) for f in schema.fields]
        part = df.select(*cols, *place(df))
        out = part if out is None else out.unionByName(part)
    return out


# --- Avro --------------------------------------------------------------------------------------------------------------------------


def _avro_nodes(schema: dict, named: dict) -> list:
    return [_avro_node(f["name"], f.get("field-id"), f["type"], named) for f in schema["fields"]]


def _avro_node(name: str, i: int | None, kind: object, named: dict) -> list:
    if isinstance(kind, list):
        kind = next((k for k in kind if k != "null"), "null")
    if isinstance(kind, str):
        kind = named.get(kind, {"type": kind})
    what = kind["type"]
    if isinstance(what, dict | list):
        return _avro_node(name, i, what, named)
    if what == "record":
        return [name, i, "struct", _avro_nodes(kind, named)]
    if what == "array" and avro_ocf._is_map(kind):
        parts = {f["name"]: f for f in kind["items"]["fields"]}
        return [name, i, "map", [_avro_node(k, parts[k].get("field-id", kind.get(f"{k}-id")), parts[k]["type"], named) for k in ("key", "value")]]
    if what == "array":
        return [name, i, "list", [_avro_node("element", kind.get("element-id"), kind["items"], named)]]
    if what == "map":
        return [name, i, "map", [["key", kind.get("key-id"), "", []], _avro_node("value", kind.get("value-id"), kind["values"], named)]]
    return [name, i, "", [], kind]


def _avro_reader(node: list, want: t.Type):
    """A function from a decoded value to one that Arrow takes for the type."""
    kids = {n[0]: n for n in node[3]}
    if isinstance(want, t.Struct):
        by = {n[1]: n for n in node[3] if n[1] is not None}
        parts = [(f.name, by[f.id][0], _avro_reader(by[f.id], f.type)) for f in want.fields if f.id in by]
        return lambda v: None if v is None else {name: read(v.get(own)) for name, own, read in parts}
    if isinstance(want, t.List):
        one = _avro_reader(kids["element"], want.element)
        return lambda v: None if v is None else [one(x) for x in v]
    if isinstance(want, t.Map):
        key, value = _avro_reader(kids["key"], want.key), _avro_reader(kids["value"], want.value)
        return lambda v: None if v is None else [(key(k), value(x)) for k, x in v.items()]
    if isinstance(want, t.Decimal):
        from decimal import Decimal

        scale = (node[4] if len(node) > 4 else {}).get("scale", 0)
        return lambda v: None if v is None else Decimal(int.from_bytes(v, "big", signed=True)).scaleb(-scale)
    if want == t.UUID:
        import uuid

        return lambda v: None if v is None else v if isinstance(v, str) else str(uuid.UUID(bytes=bytes(v)))
    if want in (t.TIMESTAMP, t.TIMESTAMPTZ) and (node[4] if len(node) > 4 else {}).get("logicalType") == "timestamp-millis":
        return lambda v: None if v is None else v * 1000
    if want in (t.FLOAT, t.DOUBLE):
        return lambda v: None if v is None else float(v)
    return lambda v: v


def _read_avro(spark: SparkSession, paths: list[str], schema: TableSchema, mapping: list[dict] | None, props: dict[str, str] | None, rows: bool) -> DataFrame:
    """A file per task, decoded block by block."""
    from pyspark.sql.pandas.types import to_arrow_schema

    shape = schema.to_spark(False)
    full = T.StructType([T.StructField(f.name, f.dataType) for f in shape] + [T.StructField("_tab_path", T.StringType()), T.StructField("_tab_pos", T.LongType())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = to_arrow_schema(full)
        for b in batches:
            for path in b.column(0).to_pylist():
                fs, p = filesystem(path, props)
                with fs.open_input_stream(p, buffer_size=1 << 20) as f:
                    meta, sync = avro_ocf.read_header(f)
                    codec = meta.get("avro.codec", b"null").decode()
                    if codec not in avro_ocf.UNPACK:
                        raise avro_ocf.AvroError(f"codec {codec} isn't supported")
                    tree = json.loads(meta["avro.schema"])
                    avro_ocf._named(tree, named := {})
                    nodes = _avro_nodes(tree, named)
                    if not _has_ids(nodes):
                        if mapping is None:
                            raise UnresolvedColumns(f"{path} names no field ids and the table has no {NAME_MAPPING}")
                        nodes = _mapped(nodes, mapping)
                    one, read, at = avro_ocf.decoder(tree), _avro_reader(["", None, "struct", nodes], schema.struct), 0
                    for n, block in avro_ocf.blocks(f, sync):
                        stream = io.BytesIO(avro_ocf.UNPACK[codec](block))
                        for a in range(0, n, AVRO_ROWS):
                            k = min(AVRO_ROWS, n - a)
                            got = [read(one(stream)) | {"_tab_path": path, "_tab_pos": at + i} for i in range(k)]
                            at += k
                            yield from pa.Table.from_pylist(got, schema=target).to_batches()

    src = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)))
    out = src.mapInArrow(decode, full)
    return out if rows else out.select(*[F.col("`" + f.name.replace("`", "``") + "`") for f in shape])
