"""Stages that must not end up in one task, runs at a time, and rewritten manifests."""

from __future__ import annotations

import json
import time

import pytest
from pyspark.sql import functions as F

from tabulith.operators import compaction
from tabulith.operators import incremental as inc
from tabulith.plans.scan import SnapshotTable
from tabulith.session import materialize, put_new
from tabulith.sources import avro_ocf, manifests
from tabulith.sources.filesystem import read_bytes, write_bytes
from tabulith.sources.metadata import Snapshot, Summary
from tabulith.sources.writer import TableWriter, entry_schema, list_schema
from tabulith.streaming.follow import appended_files
from tabulith.types import Struct


def entry(path):
    return {"status": 1, "snapshot_id": 1, "sequence_number": 1, "file_sequence_number": 1, "data_file": {"content": 0, "file_path": path, "file_format": "PARQUET", "partition": {}, "record_count": 1, "file_size_in_bytes": 1}}


@pytest.mark.parametrize("local", [True, False])
def test_manifests_are_spread(spark, tmp_path, local, monkeypatch):
    rows = []
    for i in range(1000):
        path = f"{tmp_path}/m{i}.avro"
        write_bytes(path, avro_ocf.write(entry_schema(Struct()), [entry(f"f{i}")], {"format-version": "2"}))
        rows.append({"manifest_path": path, "manifest_length": 1, "partition_spec_id": 0, "content": 0, "sequence_number": 1, "min_sequence_number": 1, "added_snapshot_id": 1, **dict.fromkeys(("added_files_count", "existing_files_count", "deleted_files_count", "added_rows_count", "existing_rows_count", "deleted_rows_count"), 1), "partitions": []})
    write_bytes(f"{tmp_path}/list.avro", avro_ocf.write(list_schema(), rows, {"format-version": "2"}))
    if not local:
        monkeypatch.setattr(manifests, "LOCAL_LIST_BYTES", 0)
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
    e = manifests.read_entries(manifests.read_lists(spark, [f"{tmp_path}/list.avro"]))
    per = [r["count"] for r in e.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(per) == 1000 and len(per) >= 8 and max(per) <= 200


def test_copies_are_spread(spark):
    plan = materialize(spark.range(20_000).select(F.concat(F.lit("p"), "id").alias("path"), F.concat(F.lit("t"), F.col("id") % 200).alias("target")), "plan")
    per = [r["count"] for r in compaction.spread_targets(plan).select(F.spark_partition_id().alias("at")).groupBy("at").count().collect()]
    assert sum(per) == 20_000 and len(per) > 50


def test_losing_run_changes_nothing(spark, tmp_path):
    """A second run starts, the first publishes, the second fails."""
    folder = f"file://{tmp_path}/state"
    a, b = (inc.IncrementalRuns(spark, folder, ["k"], ["v"]) for _ in range(2))
    one = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    two = one.unionByName(spark.createDataFrame([(3, "c")], one.schema))

    def meanwhile(t):
        assert a.run(one, lambda x: x) == 1
        return t

    with pytest.raises(FileExistsError):
        b.run(two.where("k <> 1"), meanwhile)
    assert sorted(map(tuple, a.output().collect())) == [(1, "a"), (2, "b")]
    done = a.commits(1)
    assert a._saved(done, inc.leaves(one, ["k"], ["v"]).limit(0)).count() == 2 and spark.read.parquet(f"{folder}/{done[0].folder}/tree").where("level = 0").first().n == 2
    assert b.run(two, lambda x: x) == 2 and sorted(map(tuple, b.output().collect())) == [(1, "a"), (2, "b"), (3, "c")]
    assert len(a.clean(int(time.time() * 1000) + 10_000)) == 1 and a.output().count() == 3


def test_leaves_of_changed_keys_alone(spark, tmp_path):
    """Runs write the leaves of changed keys until these come to half of all; keys that go and come back are new again."""
    runs = inc.IncrementalRuns(spark, f"file://{tmp_path}/state", ["k"], ["v"])
    df = lambda *x: spark.createDataFrame(list(x), "k long, v string")
    base = spark.range(100).selectExpr("id AS k", "'x' AS v")
    steps = [base, base.where("k <> 5"), base, base.unionByName(df((5, "y"), (None, "n"))), base.unionByName(df((5, "y"), (None, "n"))), base.withColumn("v", F.lit("z"))]
    got = []
    for s in steps:
        n = runs.run(s, lambda t: t)
        got.append(spark.read.parquet(f"file://{tmp_path}/state/{runs.commits(n)[-1].folder}/output").count())
    assert got == [100, 0, 1, 2, 0, 100]
    assert [c.base for c in runs.commits(6)] == [1, 1, 1, 1, 1, 6] and [c.n_changed for c in runs.commits(6)][:5] == [100, 1, 1, 3, 0]


def test_put_new(spark, tmp_path):
    put_new(spark, f"file://{tmp_path}/a/b.json", b"1")
    with pytest.raises(FileExistsError):
        put_new(spark, f"file://{tmp_path}/a/b.json", b"2")
    assert (tmp_path / "a/b.json").read_bytes() == b"1" and len(list((tmp_path / "a").iterdir())) == 1


def rewrite(spark, w):
    """A commit that only writes all entries into one new manifest, where they are existing ones."""
    m = w.metadata
    tb = SnapshotTable(spark, ("x",), m)
    rows = avro_ocf.read(read_bytes(m.current_snapshot.manifest_list))[1]
    entries = []
    for r in rows:
        entries += [{**x, "status": 0, "sequence_number": r["sequence_number"], "file_sequence_number": r["sequence_number"]} for x in avro_ocf.read(read_bytes(r["manifest_path"]))[1]]
    path = f"{w.location}/metadata/rewritten.avro"
    data = avro_ocf.write(entry_schema(m.spec().partition_type(m.schema())), entries, {"format-version": "2"})
    write_bytes(path, data)
    row = rows[0] | {"manifest_path": path, "manifest_length": len(data), "sequence_number": 9, "min_sequence_number": 1, "added_snapshot_id": 77, "added_files_count": 0, "existing_files_count": len(entries)}
    write_bytes(f"{w.location}/metadata/rewritten-list.avro", avro_ocf.write(list_schema(), [row], {"format-version": "2"}))
    s = Snapshot(77, m.last_updated_ms + 5, m.current_snapshot_id, 9, f"{w.location}/metadata/rewritten-list.avro", Summary("replace"), m.current_schema_id)
    from dataclasses import replace

    return replace(tb, metadata=replace(m, snapshots=(*m.snapshots, s), current_snapshot_id=77))


def test_appended_after_rewrite(spark, tmp_path):
    w = TableWriter.create(spark, f"file://{tmp_path}/t", spark.range(1).schema)
    first = w.append(spark.range(10), files=1)
    w.append(spark.range(20), files=2)
    tb = rewrite(spark, w)
    assert tb.scan().to_df().count() == 30 and {r.status for r in tb.entries().select("status").collect()} == {0}
    assert appended_files(tb).agg(F.sum("record_count")).first()[0] == 30
    assert appended_files(tb, after=first).agg(F.sum("record_count")).first()[0] == 20
    assert appended_files(tb, after=77).count() == 0


def test_unknown_partition_values_keep_files(spark, tmp_path):
    """A partition field without an id in the manifest is found by its name in the spec; if there is none, the file is kept."""
    from tabulith.plans import expressions as e

    w = TableWriter.create(spark, f"file://{tmp_path}/t", spark.range(1).schema, [("id", "identity")])
    w.append(spark.range(4))
    row = avro_ocf.read(read_bytes(w.metadata.current_snapshot.manifest_list))[1][0]
    meta, entries = avro_ocf.read(read_bytes(row["manifest_path"]))
    schema = json.loads(meta["avro.schema"])
    part = next(f for f in next(f for f in schema["fields"] if f["name"] == "data_file")["type"]["fields"] if f["name"] == "partition")
    for f in part["type"]["fields"]:
        f.pop("field-id")
    tb = SnapshotTable(spark, ("t",), w.metadata, w.metadata_location)
    for spec, kept in ((meta["partition-spec"], 1), ("[]", 4)):
        write_bytes(row["manifest_path"], avro_ocf.write(schema, entries, {"format-version": "2", "partition-spec": spec}))
        for x in entries:
            x["data_file"]["lower_bounds"] = x["data_file"]["upper_bounds"] = None
        write_bytes(row["manifest_path"], avro_ocf.write(schema, entries, {"format-version": "2", "partition-spec": spec}))
        scan = tb.scan(row_filter=e.equal("id", 2))
        assert scan.plan_files().count() == kept and [r.id for r in scan.to_df().collect()] == [2]


def test_names_that_were_other_fields(spark, tmp_path):
    """Two columns swap their names: filters go by id, also those that Spark would push to the files by name."""
    from tabulith import types as t
    from tabulith.plans import expressions as e
    from tabulith.schema import TableSchema

    df = spark.range(100).selectExpr("id AS a", "id + 1000 AS b")
    w = TableWriter.create(spark, f"file://{tmp_path}/t", df.schema)
    w.append(df)
    a, b = w.metadata.schema().fields
    w.evolve(TableSchema((t.Field(a.id, "b", a.type), t.Field(b.id, "a", b.type))))
    w.append(spark.range(5).selectExpr("id + 5000 AS b", "id + 7000 AS a"))
    tb = SnapshotTable.load(spark, ("t",), w.metadata_location)
    for skipping in (True, False):
        assert tb.scan(row_filter=e.at_least("a", 1000), skipping=skipping).to_df().count() == 105 and tb.scan(row_filter=e.less("b", 50), skipping=skipping).to_df().count() == 50
    assert spark.conf.get("spark.sql.parquet.fieldId.read.enabled") == "false"
    tb.scan().to_df().createOrReplaceTempView("swapped")
    assert spark.sql("SELECT count(*) AS n FROM swapped WHERE a >= 7000").first().n == 5


def test_formats(spark, tmp_path):
    """The same nested rows from Parquet, ORC and Avro files under other names, found by ids or by a mapping; deletes by place reach Avro files."""
    import pyarrow as pa
    from pyarrow import orc

    from tabulith import types as t
    from tabulith.schema import TableSchema
    from tabulith.sources.datafiles import NAME_MAPPING, UnresolvedColumns

    schema = TableSchema((t.Field(1, "k", t.LONG), t.Field(2, "s", t.Struct((t.Field(3, "x", t.INT), t.Field(4, "y", t.Decimal(9, 2))))), t.Field(5, "l", t.List(6, t.Struct((t.Field(7, "z", t.STRING),)))), t.Field(8, "m", t.Map(9, t.STRING, 10, t.DOUBLE)), t.Field(11, "d", t.DATE), t.Field(12, "u", t.UUID), t.Field(13, "at", t.TIMESTAMP), t.Field(14, "new", t.STRING)))
    from datetime import date, datetime
    from decimal import Decimal

    key = lambda i: {"some.id": str(i)}
    f = lambda n, k, i: pa.field(n, k, metadata=key(i))
    shape = pa.schema([f("k0", pa.int32(), 1), f("s0", pa.struct([f("y0", pa.decimal128(9, 2), 4), f("x0", pa.int32(), 3)]), 2), f("l0", pa.list_(f("element", pa.struct([f("z0", pa.string(), 7)]), 6)), 5), f("d0", pa.date32(), 11), f("at0", pa.timestamp("us"), 13)])
    rows = [{"k0": i, "s0": {"y0": Decimal(i), "x0": -i}, "l0": [{"z0": str(i)}, None], "d0": date(2024, 1, 2), "at0": datetime(2024, 1, 2, 3, 4, 5, 6)} for i in range(4)] + [{"k0": None}]
    orc.write_table(pa.Table.from_pylist(rows, schema=shape), f"{tmp_path}/a.orc")
    orc.write_table(pa.Table.from_pylist(rows, schema=pa.schema([x.remove_metadata() for x in shape.remove_metadata()])).select(["k0", "d0"]), f"{tmp_path}/b.orc")
    rec = lambda name, *fields: {"type": "record", "name": name, "fields": list(fields)}
    av = lambda n, k, i: {"name": n, "type": ["null", k], "field-id": i}
    s = rec("r", av("k9", "long", 1), av("s9", rec("s", av("x9", "int", 3), av("y9", {"type": "bytes", "logicalType": "decimal", "precision": 9, "scale": 2}, 4)), 2), av("l9", {"type": "array", "items": ["null", rec("e", av("z9", "string", 7))], "element-id": 6}, 5), av("m9", {"type": "map", "values": "double", "key-id": 9, "value-id": 10}, 8), av("u9", {"type": "fixed", "name": "u", "size": 16, "logicalType": "uuid"}, 12), av("at9", {"type": "long", "logicalType": "timestamp-millis"}, 13))
    data = [{"k9": 10 + i, "s9": {"x9": i, "y9": bytes([i])}, "l9": [{"z9": "q"}, None], "m9": {"a": 1.5}, "u9": b"\1" * 16, "at9": 5} for i in range(3)]
    write_bytes(f"{tmp_path}/c.avro", avro_ocf.write(s, data, per_block=2))
    w = TableWriter.create(spark, f"file://{tmp_path}/t", schema)
    entry = lambda path, kind, n: {"content": 0, "file_path": f"file://{tmp_path}/{path}", "file_format": kind, "partition": {}, "record_count": n, "file_size_in_bytes": 1}
    w.add_files([entry("a.orc", "ORC", 5), entry("c.avro", "AVRO", 3)])
    load = lambda: SnapshotTable.load(spark, ("t",), w.metadata_location)
    got = {r.k: r for r in load().scan().to_df().collect()}
    assert set(got) == {0, 1, 2, 3, None, 10, 11, 12} and load().scan().to_df().columns == [x.name for x in schema.fields]
    assert (got[2].s.x, got[2].s.y, got[2].l, got[2].d, got[2].at, got[2].new, got[2].m) == (-2, Decimal(2), [("2",), None], date(2024, 1, 2), datetime(2024, 1, 2, 3, 4, 5, 6), None, None) and got[None].s is None
    assert (got[11].s.x, got[11].s.y, got[11].l, got[11].m, got[11].u, got[11].at) == (1, Decimal("0.01"), [("q",), None], {"a": 1.5}, "01010101-0101-0101-0101-010101010101", datetime(1970, 1, 1, 0, 0, 0, 5000))
    w.delete_positions(spark.createDataFrame([(f"file:{tmp_path}/c.avro", 2), (f"file:{tmp_path}/c.avro", 0)], "file_path string, pos long"))
    assert sorted(r.k for r in load().scan(["k"]).to_df().collect() if r.k is not None) == [0, 1, 2, 3, 11]
    w.add_files([entry("b.orc", "ORC", 5)])
    with pytest.raises(UnresolvedColumns):
        load().scan(["k"]).to_df()
    from dataclasses import replace

    mapped = replace(load(), metadata=replace(load().metadata, properties={NAME_MAPPING: json.dumps([{"field-id": 1, "names": ["k", "k0"]}, {"field-id": 11, "names": ["d0"]}])}))
    assert sorted(r.k for r in mapped.scan(["k", "d", "new"]).to_df().collect() if r.k is not None) == [0, 0, 1, 1, 2, 2, 3, 3, 11]


def test_ids_stay_whole_beside_nulls(spark, tmp_path):
    """A manifest without a snapshot id beside one with nineteen digits; keys of records too."""
    from tabulith.operators import shredding

    big = 8_182_715_666_859_000_001
    rows = []
    for i, snap in enumerate((big, None)):
        path = f"{tmp_path}/m{i}.avro"
        write_bytes(path, avro_ocf.write(entry_schema(Struct()), [entry(f"f{i}") | {"snapshot_id": None}], {"format-version": "2"}))
        rows.append((path, 0, 5, snap))
    m = spark.createDataFrame(rows, "manifest_path string, partition_spec_id int, sequence_number bigint, added_snapshot_id bigint").coalesce(1)
    assert {r.file_path: r.snapshot_id for r in manifests.read_entries(m).collect()} == {"f0": big, "f1": None}
    df = spark.createDataFrame([(big, '{"a": [{"b": 1}]}'), (None, '{"a": [{"b": 2}]}')], "k bigint, j string").coalesce(1)
    got = shredding.shred_json(df, "j", ["k"], {"a": [{"b": None}]}, ("a",), {"b": ("b", lambda v: v, "bigint")}).collect()
    assert {(r.k, r.pos_1, r.b) for r in got} == {(big, 0, 1), (None, 0, 2)}
