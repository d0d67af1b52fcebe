"""Metadata, manifests, skipping, scans, catalogs and the command line."""

from __future__ import annotations

import json
import math
import random
import threading
from datetime import datetime, timedelta
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, unquote, urlparse

import pytest
from pyspark.sql import functions as F

from tabulith import cli
from tabulith import types as t
from tabulith.catalog import NamespaceExists, NamespaceNotEmpty, NoSuchNamespace, NoSuchTable, TableExists, catalog_type, load_catalog
from tabulith.catalog.local import LocalCatalog
from tabulith.catalog.rest import AuthorizationExpired, BadRequest, Forbidden, OAuthError, RestCatalog, RestError, ServerError, ServiceUnavailable, Unauthorized
from tabulith.functions.literals import from_bytes, to_bytes
from tabulith.plans import expressions as e
from tabulith.plans.pruning import might_match, might_match_column
from tabulith.plans.scan import ScanError, SnapshotTable
from tabulith.schema import TableSchema
from tabulith.sources import avro_ocf, manifests
from tabulith.sources.metadata import FormatVersionError, MetadataError, Snapshot, SnapshotRef, TableMetadata
from tabulith.sources.writer import TableWriter, entry_schema, list_schema
from tabulith.streaming.follow import appended_files, follow
from tabulith.types import Field, SchemaError, Struct

PROBE = {"id": 1, "name": "probe", "type": "string", "required": True}
TAKEN = {"id": 2, "name": "taken", "type": "timestamptz", "required": True, "doc": "when it was taken"}
SALT = {"id": 3, "name": "salt", "type": "double", "required": False}
FIRST, SECOND, THIRD = 11, 12, 13


def v2(**change) -> str:
    out = {
        "format-version": 2, "table-uuid": "0f6f2a0e-2b7c-4b3a-9d51-6c1b5a7e4d10", "location": "file:///lake/sea/casts", "last-sequence-number": 9, "last-updated-ms": 1700000300000, "last-column-id": 3, "current-schema-id": 4,
        "schemas": [{"type": "struct", "schema-id": 3, "fields": [PROBE, TAKEN]}, {"type": "struct", "schema-id": 4, "identifier-field-ids": [1], "fields": [PROBE, TAKEN, SALT]}],
        "default-spec-id": 2, "partition-specs": [{"spec-id": 2, "fields": [{"name": "taken_day", "transform": "day", "source-id": 2, "field-id": 1000}]}], "last-partition-id": 1000, "default-sort-order-id": 1,
        "sort-orders": [{"order-id": 1, "fields": [{"transform": "truncate[3]", "source-id": 1, "direction": "desc", "null-order": "nulls-last"}]}], "properties": {"owner": "harbour"}, "current-snapshot-id": THIRD,
        "snapshots": [
            {"snapshot-id": FIRST, "timestamp-ms": 1700000100000, "sequence-number": 7, "summary": {"operation": "append", "added-files": "2"}, "manifest-list": "file:///lake/sea/casts/l1.avro", "schema-id": 3},
            {"snapshot-id": SECOND, "parent-snapshot-id": FIRST, "timestamp-ms": 1700000200000, "sequence-number": 8, "summary": {"operation": "overwrite"}, "manifest-list": "file:///lake/sea/casts/l2.avro"},
            {"snapshot-id": THIRD, "parent-snapshot-id": SECOND, "timestamp-ms": 1700000300000, "sequence-number": 9, "summary": {"operation": "delete"}, "manifest-list": "file:///lake/sea/casts/l3.avro", "schema-id": 4},
        ],
        "snapshot-log": [{"snapshot-id": FIRST, "timestamp-ms": 1700000100000}, {"snapshot-id": THIRD, "timestamp-ms": 1700000300000}], "metadata-log": [{"metadata-file": "file:///lake/sea/casts/v8.json", "timestamp-ms": 1700000200000}],
        "refs": {"winter": {"snapshot-id": FIRST, "type": "tag", "max-ref-age-ms": 5000}, "work": {"snapshot-id": SECOND, "type": "branch", "min-snapshots-to-keep": 2}},
    }
    return json.dumps({k: v for k, v in (out | change).items() if v != "gone"})


V1 = {"format-version": 1, "table-uuid": "4d1f5f57-0c55-4a2e-8d6e-0a4b1d7c9e22", "location": "file:///lake/sea/old", "last-updated-ms": 1600000000001, "last-column-id": 3, "schema": {"type": "struct", "fields": [PROBE, TAKEN, SALT]}, "partition-spec": [{"name": "probe", "transform": "identity", "source-id": 1, "field-id": 1000}], "properties": {}, "current-snapshot-id": -1, "snapshots": [{"snapshot-id": 77, "timestamp-ms": 1599999999999}]}


def test_metadata_v2():
    m = TableMetadata.parse(v2())
    assert m.current_snapshot.snapshot_id == THIRD and m.refs["main"] == SnapshotRef(THIRD, "branch") and m.snapshot_by_name("winter").snapshot_id == FIRST and m.snapshot_by_name("nope") is None
    assert m.schema().schema_id == 4 and m.schema(3).name_of == {1: "probe", 2: "taken"} and m.spec(99).fields == () and m.sort_order.order_id == 1
    assert m.snapshot_at(1700000299999).snapshot_id == FIRST and m.snapshot_at(1) is None
    own = json.loads(v2())
    want = own | {"refs": own["refs"] | {"main": {"snapshot-id": THIRD, "type": "branch"}}}
    got = m.to_json()
    want["schemas"] = [{**s, "identifier-field-ids": s.get("identifier-field-ids", [])} for s in want["schemas"]]
    assert got == want and TableMetadata.parse(json.dumps(got)) == m
    assert str(m.snapshots[2]) == f"delete: id={THIRD}, parent_id={SECOND}, schema_id=4"


def test_metadata_v1():
    m = TableMetadata.parse(json.dumps(V1))
    assert m.current_snapshot_id is None and m.refs == {} and m.last_partition_id == 1000 and m.sort_order.order_id == 0 and m.spec().fields[0].name == "probe"
    up = m.to_v2()
    assert up.format_version == 2 and "schema" not in up.to_json() and up.to_json()["last-sequence-number"] == 0 and TableMetadata.parse(json.dumps(m.to_json())).schema() == m.schema()
    assert TableMetadata.parse(json.dumps({k: v for k, v in V1.items() if k != "table-uuid"})).to_v2().table_uuid
    later = TableMetadata.parse(json.dumps(V1 | {"current-snapshot-id": 77}))
    assert later.refs["main"].snapshot_id == 77


@pytest.mark.parametrize(("change", "text"), [({"current-schema-id": 2}, "current-schema-id 2 can't be found in any schema"), ({"default-sort-order-id": 4}, "default-sort-order-id 4 can't be found"), ({"default-spec-id": 1}, "default-spec-id 1 can't be found"), ({"last-updated-ms": "gone"}, "missing last-updated-ms"), ({"last-column-id": "gone"}, "missing last-column-id"), ({"refs": {"a": {"snapshot-id": 1, "type": "foobar"}}}, "invalid snapshot ref type"), ({"snapshots": [{"snapshot-id": 1, "timestamp-ms": 1, "summary": {}}]}, "missing operation"), ({"snapshots": [{"snapshot-id": 1, "timestamp-ms": 1, "summary": {"operation": "foobar"}}]}, "invalid operation")])
def test_bad_metadata(change, text):
    with pytest.raises(MetadataError, match=text):
        TableMetadata.parse(v2(**change))


def test_format_version():
    for bad in (-1, 3, None, "2"):
        with pytest.raises(FormatVersionError):
            TableMetadata.parse(v2(**{"format-version": bad}))
    assert TableMetadata.parse(v2(**{"sort-orders": "gone", "default-sort-order-id": 0})).sort_order.order_id == 0


def test_snapshot_json():
    x = {"snapshot-id": 5, "parent-snapshot-id": 4, "sequence-number": 60, "timestamp-ms": 1700000400000, "manifest-list": "file:///lake/x.avro", "summary": {"operation": "replace", "by": "night run"}, "schema-id": 2}
    assert Snapshot.from_json(x).to_json() == x and Snapshot.from_json({"snapshot-id": 1, "timestamp-ms": 2}).to_json() == {"snapshot-id": 1, "timestamp-ms": 2, "sequence-number": 0}


# --- Avro and manifests


@pytest.mark.parametrize("codec", ["null", "deflate"])
def test_manifest_list(codec):
    rows = [{"manifest_path": "/m/1.avro", "manifest_length": 4321, "partition_spec_id": 0, "content": 1, "sequence_number": 3, "min_sequence_number": 3, "added_snapshot_id": 7182715666859000001, "added_files_count": 3, "existing_files_count": 0, "deleted_files_count": 0, "added_rows_count": 4500, "existing_rows_count": 0, "deleted_rows_count": 0, "partitions": [{"contains_null": True, "contains_nan": False, "lower_bound": b"\1\0\0\0", "upper_bound": None}]}]
    data = avro_ocf.write(list_schema(), rows, {"format-version": "2"}, codec)
    assert manifests.manifest_rows(data) == rows
    old = {"type": "record", "name": "manifest_file", "fields": [{"name": n, "type": k} for n, k in (("manifest_path", "string"), ("manifest_length", "long"), ("partition_spec_id", "int"), ("added_snapshot_id", ["null", "long"]), ("added_data_files_count", ["null", "int"]), ("added_rows_count", ["null", "long"]))]}
    got = manifests.manifest_rows(avro_ocf.write(old, [{"manifest_path": "p", "manifest_length": 1, "partition_spec_id": 0, "added_snapshot_id": 5, "added_data_files_count": 3}]))[0]
    assert (got["content"], got["sequence_number"], got["added_files_count"], got["existing_files_count"], got["added_snapshot_id"]) == (0, 0, 3, None, 5)


def test_entry_inheritance():
    part = Struct((Field(1000, "p", t.INT), Field(1001, "s", t.STRING), Field(1002, "n", t.Decimal(9, 2)), Field(1003, "u", t.UUID)))
    f = {"content": 0, "file_path": "f", "file_format": "PARQUET", "partition": {"p": -3, "s": "ab", "n": to_bytes(from_bytes(b"\x80", t.Decimal(9, 2)), t.Decimal(9, 2)), "u": None}, "record_count": 640, "file_size_in_bytes": 20480, "lower_bounds": {2: b"harbour", 3: b"\1"}, "null_value_counts": {1: 640}}
    entries = [{"status": s, "snapshot_id": i, "sequence_number": q, "file_sequence_number": q, "data_file": f} for s, i, q in ((1, None, None), (0, 7, None), (0, 7, 2), (2, 8, None))]
    data = avro_ocf.write(entry_schema(part), entries, {"format-version": "2"})
    got = manifests.entry_rows(data, {"manifest_path": "m", "partition_spec_id": 4, "sequence_number": 5, "added_snapshot_id": 99})
    assert [(r["snapshot_id"], r["sequence_number"], r["file_sequence_number"]) for r in got] == [(99, 5, 5), (7, None, None), (7, 2, 2), (8, None, None)]
    assert [r["sequence_number"] for r in manifests.entry_rows(data, {"manifest_path": "m", "partition_spec_id": 4, "sequence_number": 0, "added_snapshot_id": 99})] == [0, 0, 2, 0]
    assert got[0]["lower_bounds"] == {2: b"harbour", 3: b"\1"} and got[0]["null_value_counts"] == {1: 640} and set(got[0]["partition"]) == {1000, 1001, 1002} and got[0]["spec_id"] == 4


def test_avro_errors():
    for bad in (b"", b"Obj\1", b"nope" * 9):
        with pytest.raises((avro_ocf.AvroError, EOFError)):
            avro_ocf.read(bad)
    data = avro_ocf.write({"type": "record", "name": "r", "fields": [{"name": "a", "type": "long"}]}, [{"a": 1}])
    with pytest.raises(avro_ocf.AvroError):
        avro_ocf.read(data[:-1] + b"x")


# --- expressions and skipping

FLAT = TableSchema((Field(1, "i", t.INT), Field(2, "l", t.LONG, True), Field(3, "d", t.DOUBLE), Field(4, "s", t.STRING), Field(5, "b", t.BOOLEAN), Field(6, "ts", t.TIMESTAMP), Field(7, "n", t.Decimal(20, 2)), Field(8, "st", Struct((Field(9, "x", t.FLOAT), Field(10, "day", t.DATE))))))


def test_bind():
    got = e.bind(FLAT, e.Not(e.And(e.equal("I", "5"), e.Or(e.is_null("s"), e.less("st.X", 1)))), case_sensitive=False)
    assert got == e.Or(e.Bound("ne", FLAT.by_id[1], "`i`", 5), e.And(e.Bound("not_null", FLAT.by_id[4], "`s`"), e.Bound("ge", FLAT.by_id[9], "`st`.`x`", 1.0)))
    assert e.bind(FLAT, e.equal("i", 1 << 31)) == e.AlwaysFalse() and e.bind(FLAT, e.not_equal("i", 1 << 31)).op == "not_null"
    assert e.bind(FLAT, e.less("i", 1 << 31)).op == "not_null" and e.bind(FLAT, e.greater("i", 1 << 31)) == e.AlwaysFalse() and e.bind(FLAT, e.is_in("i", [1 << 40])) == e.AlwaysFalse()
    assert e.bind(FLAT, e.is_null("l")) == e.AlwaysFalse() and e.bind(FLAT, e.not_null("l")) == e.AlwaysTrue()
    for bad in (e.equal("nope", 1), e.equal("i", "x"), e.equal("i", None), got, e.starts_with("i", "x")):
        with pytest.raises(ValueError):
            e.bind(FLAT, bad)
    with pytest.raises(SchemaError):
        e.bind(FLAT, e.equal("I", 5))


def random_rows(r):
    return [(r.choice([None, r.randint(-5, 5), (1 << 31) - 1]), r.randint(-(1 << 40), 1 << 40), r.choice([None, math.nan, -0.0, 0.0, r.uniform(-3, 3), math.inf]), r.choice([None, "", "a", "ab", "b", "é", "\U0001f600"]), r.choice([None, True, False]), r.choice([None, datetime(1969, 12, 31) + timedelta(hours=r.randint(0, 99))]), r.choice([None, round(r.uniform(-1e9, 1e9), 2), 0]), r.choice([None, r.uniform(-1, 1)])) for _ in range(r.randint(0, 6))]


def stats(rows):
    """Statistics of a file, some of them left out or cut short."""
    from decimal import Decimal as D

    from tabulith.functions.literals import cast

    out = {"record_count": len(rows), "value_counts": {}, "null_value_counts": {}, "nan_value_counts": {}, "lower_bounds": {}, "upper_bounds": {}}
    for k, f in enumerate((*FLAT.fields[:7], FLAT.by_id[9])):
        col = [r[k] for r in rows]
        there = [cast(v, f.type) if not isinstance(v, float) or k != 6 else D(f"{v:.2f}") for v in col if v is not None and not (isinstance(v, float) and math.isnan(v))]
        out["value_counts"][f.id] = len(col)
        out["null_value_counts"][f.id] = sum(v is None for v in col)
        out["nan_value_counts"][f.id] = sum(isinstance(v, float) and math.isnan(v) for v in col)
        if there:
            out["lower_bounds"][f.id], out["upper_bounds"][f.id] = (to_bytes(v, f.type) for v in (min(there), max(there)))
    return out


def random_expr(r, depth=3):
    if depth and r.random() < 0.6:
        a, b = random_expr(r, depth - 1), random_expr(r, depth - 1)
        return r.choice([e.And(a, b), e.Or(a, b), e.Not(a)])
    name = r.choice(["i", "l", "d", "s", "b", "ts", "n", "st.x"])
    value = {"i": r.choice([0, 3, -5, 1 << 33]), "l": r.randint(-(1 << 40), 1 << 40), "d": r.choice([0.0, -0.0, 1.5, math.nan, math.inf]), "s": r.choice(["", "a", "b", "z"]), "b": True, "ts": "1970-01-02T00:00:00.000000", "n": r.choice([0, -5, 12345]), "st.x": 0.25}[name]
    op = r.choice(["eq", "ne", "lt", "le", "gt", "ge", "is_null", "not_null", "is_nan", "not_nan", "in", "not_in", "starts_with"])
    if op == "starts_with":
        return e.starts_with("s", r.choice(["", "a", "ab", "é"]))
    if name == "b" and op in ("lt", "le", "gt", "ge"):
        op = "eq"
    return e.Predicate(op, name, (value, value) if op.endswith("in") and op in ("in", "not_in") else None if op in e.UNARY else value)


def test_skipping_is_sound(spark):
    """No file with a matching row is skipped, in Python and in Spark, which agree."""
    r = random.Random(42)
    files = [random_rows(r) for _ in range(60)]
    ddl = "k int, i int, l bigint, d double, s string, b boolean, ts timestamp_ntz, n decimal(20,2), st struct<x:float>"
    from decimal import Decimal as D

    rows = [(k, *x[:6], None if x[6] is None else D(f"{x[6]:.2f}"), (x[7],)) for k, f in enumerate(files) for x in f]
    data = spark.createDataFrame(rows, ddl).cache()
    all_stats = [stats([(*x[:7], None if x[7] is None else from_bytes(to_bytes(x[7], t.FLOAT), t.FLOAT)) for x in f]) for f in files]
    cols = "record_count bigint, value_counts map<int,bigint>, null_value_counts map<int,bigint>, nan_value_counts map<int,bigint>, lower_bounds map<int,binary>, upper_bounds map<int,binary>"
    names = [c.split()[0] for c in cols.split(", ")]
    meta = spark.createDataFrame([(k, *[{i: bytearray(v) if isinstance(v, bytes) else v for i, v in s[n].items()} if isinstance(s[n], dict) else s[n] for n in names]) for k, s in enumerate(all_stats)], "k int, " + cols).cache()
    skipped = 0
    exprs = [random_expr(r) for _ in range(80)]
    bound = [e.bind(FLAT, x) for x in exprs]
    might = meta.select("k", *[might_match_column(b).alias(f"e{j}") for j, b in enumerate(bound)]).collect()
    hits = data.groupBy("k").agg(*[F.max(F.coalesce(e.to_column(b), F.lit(False))).alias(f"e{j}") for j, b in enumerate(bound)]).collect()
    hit = {(row.k, j) for row in hits for j in range(len(bound)) if row[f"e{j}"]}
    for row in might:
        for j, b in enumerate(bound):
            assert row[f"e{j}"] == might_match(b, all_stats[row.k]), (exprs[j], all_stats[row.k])
            assert row[f"e{j}"] or (row.k, j) not in hit, (exprs[j], files[row.k])
            skipped += not row[f"e{j}"]
    assert skipped > 500
    data.unpersist()
    meta.unpersist()


def test_unknown_statistics(spark):
    b = e.bind(FLAT, e.And(e.equal("i", 1), e.Or(e.is_null("s"), e.greater("d", 1.0))))
    for n, want in ((5, True), (0, False), (-1, True), (None, True)):
        s = {"record_count": n}
        assert might_match(b, s) is want
        df = spark.createDataFrame([(n, None, None, None, None, None)], "record_count bigint, value_counts map<int,bigint>, null_value_counts map<int,bigint>, nan_value_counts map<int,bigint>, lower_bounds map<int,binary>, upper_bounds map<int,binary>")
        assert df.select(might_match_column(b)).first()[0] is want


# --- scans


@pytest.fixture(scope="module")
def place(tmp_path_factory):
    return f"file://{tmp_path_factory.mktemp('tables')}"


def frame(spark, n, start=0):
    return spark.range(start, start + n).selectExpr("id", "concat('n', id % 5) AS name", "cast(id % 3 AS int) AS part", "named_struct('a', id * 2, 'b', named_struct('c', cast(id AS string))) AS s", "array(named_struct('x', id)) AS arr", "map('k', id) AS m", "cast(IF(id % 4 = 0, NULL, id / 2) AS double) AS v")


@pytest.fixture(scope="module")
def written(spark, place):
    w = TableWriter.create(spark, f"{place}/t", frame(spark, 1).schema, [("part", "identity"), ("name", "truncate[1]")])
    w.append(frame(spark, 100), tag="one")
    w.append(frame(spark, 50, 100))
    return w


def as_table(spark, w):
    return SnapshotTable(spark, ("ns", "t"), w.metadata, w.metadata_location)


def test_nested_projection(spark, written):
    tb = as_table(spark, written)
    df = tb.scan(["s.b.c", "id", "arr.x", "m"], e.And(e.less("s.a", 20), e.not_null("v"))).to_df()
    assert df.columns == ["id", "s", "arr", "m"] and df.schema["s"].dataType.simpleString() == "struct<b:struct<c:string>>"
    assert sorted(r.s.b.c for r in df.collect()) == ["1", "2", "3", "5", "6", "7", "9"]
    plan = tb.scan(["id"], e.equal("id", 7)).to_df()._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(id), EqualTo(id,7)]" in plan and "ReadSchema: struct<id:bigint>" in plan


def test_versions(spark, written):
    tb = as_table(spark, written)
    assert tb.scan().to_df().count() == 150 and tb.scan(ref="one").to_df().count() == 100 and tb.scan(limit=7).to_df().count() == 7
    assert tb.scan().min_sequence_number() == 1 and tb.scan(["id"]).use_ref("one").to_df().count() == 100
    for bad in ({"ref": "nope"}, {"snapshot_id": 1}, {"timestamp_ms": 5}, {"ref": "one", "snapshot_id": 3}):
        with pytest.raises(ScanError):
            tb.scan(**bad)
    with pytest.raises(ScanError):
        tb.scan(ref="one").use_ref("main")
    with pytest.raises(SchemaError):
        tb.scan(["nope"]).projection()
    added = appended_files(tb, after=tb.metadata.snapshots[0].snapshot_id)
    assert added.agg(F.sum("record_count")).first()[0] == 50 and appended_files(tb).agg(F.sum("record_count")).first()[0] == 150


def test_partition_skipping(spark, written):
    tb = as_table(spark, written)
    every = tb.scan(["id"], e.equal("part", 1), skipping=False)
    some = tb.scan(["id"], e.equal("part", 1))
    assert some.plan_files().count() * 3 == every.plan_files().count() == 6 and sorted(map(tuple, some.to_df().collect())) == sorted(map(tuple, every.to_df().collect()))
    for x in (e.starts_with("name", "n3"), e.is_null("part"), e.less("part", 0), e.not_equal("part", 1), e.is_in("part", [0, 2]), e.greater("id", 120), e.Not(e.starts_with("name", "n"))):
        a, b = (tb.scan(["id", "name"], x, skipping=k) for k in (True, False))
        assert sorted(map(tuple, a.to_df().collect())) == sorted(map(tuple, b.to_df().collect()))
    assert tb.scan(["id"], e.is_null("part")).plan_files().count() == 0 and tb.scan(["id"], e.equal("part", 9)).manifests().count() == 0


def test_empty_table(spark, place):
    w = TableWriter.create(spark, f"{place}/empty", frame(spark, 1).schema)
    tb = as_table(spark, w)
    assert tb.scan().to_df().count() == 0 and tb.scan(["s.a"]).to_df().columns == ["s"] and tb.scan().min_sequence_number() is None
    w.append(frame(spark, 0))
    assert as_table(spark, w).scan(row_filter=e.equal("id", 1)).to_df().count() == 0


def test_deletes(spark, place):
    w = TableWriter.create(spark, f"{place}/deletes", frame(spark, 1).schema, [("part", "identity")])
    w.append(frame(spark, 30))
    old = as_table(spark, w)
    path = sorted(r.file_path for r in old.files().select("file_path").collect())[0]
    first = [r.id for r in spark.read.parquet(path).select("id", "_metadata.row_index").orderBy("row_index").collect()]
    w.delete_positions(spark.createDataFrame([(path.replace("file:///", "file:/"), 0), (path, 2), (path, 2), ("elsewhere", 1), (None, None)], "file_path string, pos long"))
    w.delete_equal(spark.createDataFrame([(None, 1), (5.5, 2)], "v double, part int"), ["v", "part"])
    w.append(frame(spark, 12))
    got = sorted(r.id for r in as_table(spark, w).scan(["id"]).to_df().collect())
    want = [i for i in range(30) if i not in (first[0], first[2]) and not (i % 4 == 0 and i % 3 == 1) and not (i == 11)] + list(range(12))
    assert got == sorted(want)
    tasks = as_table(spark, w).scan(["id"]).plan_files()
    assert sorted(tuple(r) for r in tasks.groupBy(F.size("delete_files").alias("n"), "equality_deletes").count().collect()) == [(0, False, 3), (0, True, 2), (1, True, 1)]
    assert as_table(spark, w).scan(["id"], e.equal("part", 1)).to_df().where("id = 4").count() == 1
    assert tasks.where("size_with_deletes < length").count() == 0
    assert old.scan(["id"]).to_df().count() == 30


def test_follow(spark, place, tmp_path):
    w = TableWriter.create(spark, f"{place}/follow", frame(spark, 1).schema)
    seen = []

    def process(files):
        seen.append(sorted(r.record_count for r in files.collect()))
        return files

    w.append(frame(spark, 10), files=1)
    assert follow(as_table(spark, w), f"file://{tmp_path}/s", process) == 1
    w.append(frame(spark, 20), files=1)

    def broken(files):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        follow(as_table(spark, w), f"file://{tmp_path}/s", broken)
    assert follow(as_table(spark, w), f"file://{tmp_path}/s", process) == 2 and seen == [[10], [20]]


# --- catalogs


def test_local_catalog(spark, place, capsys):
    c = load_catalog(spark, "c", f"{place}/warehouse")
    assert isinstance(c, LocalCatalog) and c.list_namespaces() == []
    c.create_namespace("a", {"k": "v"})
    c.create_namespace("a.b")
    for call, kind in ((lambda: c.create_namespace("a"), NamespaceExists), (lambda: c.create_namespace("x.y"), NoSuchNamespace), (lambda: c.drop_namespace("a"), NamespaceNotEmpty), (lambda: c.drop_namespace("zz"), NoSuchNamespace), (lambda: c.load_table("a.t"), NoSuchTable), (lambda: c.load_table("t"), NoSuchTable), (lambda: c.list_tables("zz"), NoSuchNamespace)):
        with pytest.raises(kind):
            call()
    assert c.update_namespace_properties("a", ["k", "q"], {"n": "1"}) == {"removed": ["k"], "updated": ["n"], "missing": ["q"]} and c.load_namespace_properties("a") == {"n": "1"}
    w = c.create_table("a.t", frame(spark, 1).schema, [("id", "bucket[4]")])
    w.append(frame(spark, 20))
    with pytest.raises(TableExists):
        c.create_table("a.t", frame(spark, 1).schema)
    tb = c.load_table("a.t")
    assert tb.scan().to_df().count() == 20 and c.list_tables("a") == [("a", "t")] and c.list_namespaces("a") == [("a", "b")] and tb.refresh() == tb
    c.rename_table("a.t", "a.b.u")
    assert c.list_tables("a") == [] and c.load_table("a.b.u").scan().to_df().count() == 20
    uri = ["--uri", f"{place}/warehouse"]

    def run(*argv):
        code = cli.run(cli.parser().parse_args([*uri, *argv]), spark)
        return code, capsys.readouterr()

    assert run("list")[1].out == "a\n" and run("list", "a")[1].out == "a.b\n" and run("list", "a.b")[1].out == "a.b.u\n"
    assert run("uuid", "a.b.u")[1].out.strip() == tb.metadata.table_uuid and run("location", "a.b.u")[1].out.strip() == tb.location
    assert "  1: id: required long" in run("schema", "a.b.u")[1].out and "bucket[4](1)" in run("spec", "a.b.u")[1].out
    text = run("describe", "a.b.u")[1].out
    assert "Table format version | 2" in text and "Current Snapshot" in text and run("describe", "a")[1].out.startswith("key")
    assert run("describe", "a.nope")[0] == 1 and run("describe", "table", "a.nope")[0] == 1 and run("describe", "namespace", "a.nope")[0] == 1
    assert "Datafile: " in run("files", "a.b.u")[1].out and len(json.loads(run("--output", "json", "files", "a.b.u", "--history")[1].out)) == 1
    assert json.loads(run("--output", "json", "describe", "a.b.u")[1].out)["format-version"] == 2
    for kind, name in (("namespace", "a"), ("table", "a.b.u")):
        assert run("properties", "set", kind, name, "p", "1")[0] == 0 and run("properties", "get", kind, name, "p")[1].out == "1\n"
        assert run("properties", "remove", kind, name, "p")[0] == 0 and run("properties", "get", kind, name, "p")[0] == 1
    assert run("rename", "a.b.u", "a.t")[0] == 0 and run("drop", "table", "a.t")[0] == 0 and run("drop", "namespace", "a.b")[0] == 0 and run("list", "a")[1].out.strip() == ""


def test_file_systems(spark, tmp_path, monkeypatch):
    from tabulith.sources import filesystem as fs

    conf = spark.sparkContext._jsc.hadoopConfiguration()
    monkeypatch.setenv("AWS_S3_ENDPOINT", "http://localhost:9000")
    fs.configure(spark, {"s3.access-key-id": "k", "s3.region": "r", "s3.proxy-uri": "http://proxy:3128"})
    names = ("fs.s3a.access.key", "fs.s3a.endpoint.region", "fs.s3a.proxy.host", "fs.s3a.proxy.port", "fs.s3a.endpoint")
    assert [conf.get(n) for n in names] == ["k", "r", "proxy", "3128", "http://localhost:9000"]
    for n in names:
        conf.unset(n)
    assert fs.spark_path("s3://b/x") == fs.spark_path("s3n://b/x") == "s3a://b/x" and fs.spark_path("file:///x") == "file:///x"
    for place in (f"file://{tmp_path}/d/a", f"{tmp_path}/d/b"):
        fs.write_bytes(place, b"x")
        assert fs.read_bytes(place) == b"x"
        fs.remove(place)
    with pytest.raises(FileNotFoundError):
        fs.read_bytes(f"file://{tmp_path}/d/a")
    with pytest.raises(ValueError):
        fs.filesystem("nope://x/y")


def test_catalog_types():
    assert [catalog_type(u, p) for u, p in (("http://x", {}), ("https://x", {}), ("thrift://x", {}), ("/tmp/x", {}), ("http://x", {"type": "GLUE"}))] == ["rest", "rest", "hive", "local", "glue"]
    with pytest.raises(NotImplementedError):
        load_catalog(None, "c", "thrift://x")


class Server(BaseHTTPRequestHandler):
    answers: dict = {}
    seen: list = []

    def handle_any(self):
        size = int(self.headers.get("Content-Length") or 0)
        body = self.rfile.read(size).decode()
        url = urlparse(self.path)
        Server.seen.append((self.command, url.path, {k: v[0] for k, v in parse_qs(url.query).items()}, body, {k.lower(): v for k, v in self.headers.items()}))
        code, out = Server.answers.get((self.command, unquote(url.path)), (404, {"error": {"message": "not here", "type": "NotFound", "code": 404}}))
        data = b"" if out is None else json.dumps(out).encode()
        self.send_response(code)
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        self.wfile.write(data)

    do_GET = do_POST = do_DELETE = handle_any

    def log_message(self, *args):
        pass


@pytest.fixture
def rest(spark):
    server = HTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    Server.seen = []
    Server.answers = {("GET", "/v1/config"): (200, {"defaults": {"a": "1", "b": "1"}, "overrides": {"c": "3", "prefix": "pre"}}), ("POST", "/v1/oauth/tokens"): (200, {"access_token": "some_jwt", "token_type": "Bearer"})}
    uri = f"http://127.0.0.1:{server.server_port}"
    yield lambda **p: RestCatalog(spark, "rest", uri, {k.replace("_", "-") if k != "token" else k: v for k, v in p.items()})
    server.shutdown()


def test_rest(rest):
    c = rest(credential="client:secret", warehouse="s3://w", b="2", c="2")
    token, conf = Server.seen
    assert parse_qs(token[3]) == {"grant_type": ["client_credentials"], "client_id": ["client"], "client_secret": ["secret"], "scope": ["catalog"]} and "authorization" not in token[4]
    assert conf[2] == {"warehouse": "s3://w"} and conf[4]["authorization"] == "Bearer some_jwt" and conf[4]["x-client-version"] == "0.14.1"
    assert (c.props["a"], c.props["b"], c.props["c"]) == ("1", "2", "3")
    ns = "/v1/pre/namespaces"
    a = Server.answers
    a["GET", ns] = (200, {"namespaces": [["default"], ["a", "b"]]})
    assert c.list_namespaces() == [("default",), ("a", "b")] and c.list_namespaces("a.b") and Server.seen[-1][2] == {"parent": "a\x1fb"}
    a["POST", ns] = (200, {"namespace": ["n"], "properties": {}})
    c.create_namespace("n", {"p": "q"})
    assert json.loads(Server.seen[-1][3]) == {"namespace": ["n"], "properties": {"p": "q"}}
    a["DELETE", f"{ns}/a\x1fb"] = (204, None)
    c.drop_namespace("a.b")
    a["GET", f"{ns}/n"] = (200, {"properties": {"p": "q"}})
    assert c.load_namespace_properties("n") == {"p": "q"}
    a["POST", f"{ns}/n/properties"] = (200, {"removed": [], "updated": ["p"], "missing": ["z"]})
    assert c.update_namespace_properties("n", ["z"], {"p": "r"}) == {"removed": [], "updated": ["p"], "missing": ["z"]}
    a["GET", f"{ns}/n/tables"] = (200, {"identifiers": [{"namespace": ["n"], "name": "t"}]})
    assert c.list_tables("n") == [("n", "t")]
    a["GET", f"{ns}/n/tables/t"] = (200, {"metadata-location": "s3://w/m.json", "metadata": json.loads(v2()), "config": {"owner": "1", "x": "y"}})
    tb = c.load_table("n.t")
    assert tb.metadata.current_snapshot_id == THIRD and tb.props["owner"] == "1" and tb.props["x"] == "y" and tb.metadata_location == "s3://w/m.json" and tb.refresh() == tb
    a["DELETE", f"{ns}/n/tables/t"] = (200, None)
    c.drop_table("n.t")
    a["POST", "/v1/pre/tables/rename"] = (204, None)
    c.rename_table("n.t", "n.u")
    assert json.loads(Server.seen[-1][3])["destination"] == {"namespace": ["n"], "name": "u"}
    for call, kind in ((lambda: c.load_table("n.zz"), NoSuchTable), (lambda: c.list_tables("zz"), NoSuchNamespace), (lambda: c.load_namespace_properties("zz"), NoSuchNamespace), (lambda: c.load_table("t"), NoSuchTable), (lambda: c.list_tables(""), NoSuchNamespace)):
        with pytest.raises(kind):
            call()
    for code, kind in ((400, BadRequest), (401, Unauthorized), (403, Forbidden), (419, AuthorizationExpired), (422, RestError), (501, NotImplementedError), (503, ServiceUnavailable), (500, ServerError), (418, RestError)):
        a["GET", ns] = (code, {"error": {"message": "why", "type": "Kind", "code": code}})
        with pytest.raises(kind, match="Kind: why"):
            c.list_namespaces()
    a["POST", ns] = (409, {"error": {"message": "there", "type": "AlreadyExists", "code": 409}})
    with pytest.raises(NamespaceExists):
        c.create_namespace("n")


def test_rest_pages(rest, monkeypatch):
    """Listings that come in pages are read to the end."""
    c = rest(token="t0")
    pages = {None: {"namespaces": [["a"]], "next-page-token": "p 2"}, "p 2": {"namespaces": [["b"]], "next-page-token": "p3"}, "p3": {"namespaces": [["c"]]}}
    asked = []

    def call(method, path, *rest, **more):
        asked.append(parse_qs(urlparse(path).query).get("pageToken", [None])[0])
        return pages[asked[-1]]

    monkeypatch.setattr(c, "_call", call)
    assert c.list_namespaces() == [("a",), ("b",), ("c",)] and asked == [None, "p 2", "p3"]


def test_writers_at_a_time(spark, place):
    """Of two commits on the same version one fails and changes nothing."""
    w = TableWriter.create(spark, f"{place}/race", spark.range(1).schema)
    other = TableWriter(spark, w.location, w.metadata, w.version)
    w.append(spark.range(3))
    with pytest.raises(FileExistsError):
        other.append(spark.range(5))
    assert SnapshotTable.load(spark, ("t",), w.metadata_location).scan().to_df().count() == 3


def test_rest_tokens(rest):
    assert rest(token="t0") and Server.seen[0][4]["authorization"] == "Bearer t0"
    rest(credential="only-secret")
    assert "client_id" not in parse_qs(Server.seen[1][3])
    Server.answers["POST", "/v1/oauth/tokens"] = (401, {"error": "invalid_client", "error_description": "Credentials for key invalid_key do not match"})
    with pytest.raises(OAuthError, match="invalid_client: Credentials for key invalid_key do not match"):
        rest(credential="x:y")


def test_places_of_all_orders(spark):
    """Every order has its place within its status, whatever its key."""
    from tabulith import queries_tables
    from tests.compare import oracle, plain

    d = "/root/testdata/sf0.01"
    got = {tuple(plain(v) for v in r) for r in queries_tables.sort_order_places(spark, d).collect()}
    sql = "SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY year(o_orderdate) DESC NULLS LAST, o_orderkey) FROM orders"
    want = {tuple(plain(v) for v in r) for r in oracle(d, sql)[1]}
    assert got == want and max(k for k, *_ in got) > 2000


def test_places_within_ranges(spark):
    """One group holds nearly all rows; a NULL group is one too."""
    from tabulith.operators.common import places

    df = spark.range(5000).select(F.when(F.col("id") % 1000 == 1, "b").when(F.col("id") % 1000 != 2, "a").alias("g"), (F.col("id") * 7919 % 5003).alias("x"))
    rows = places(df, "g", [F.col("x").desc()]).collect()
    want = {}
    for g, x in sorted(((r.g, r.x) for r in rows), key=lambda p: -p[1]):
        want.setdefault(g, []).append(x)
    assert len(rows) == 5000 and set(want) == {"a", "b", None} and all(want[r.g][r.place - 1] == r.x for r in rows)
