from __future__ import annotations

import glob
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tabulith.operators import compaction as c
from tabulith.sources import avro_ocf
from tabulith.sources import parquet_blocks as b


def sample(n, start=0):
    return pa.table({"k": pa.array(range(start, start + n), pa.int64()), "s": pa.array([None if i % 5 == 0 else f"text {i % 13}" for i in range(n)], pa.string()), "l": pa.array([[i, None] for i in range(n)], pa.list_(pa.int64())), "d": pa.array([{"x": i * 0.5} for i in range(n)], pa.struct([("x", pa.float64())]))})


@pytest.mark.parametrize("codec", ["snappy", "none", "zstd"])
def test_join(tmp_path, codec):
    parts = []
    for i, n in enumerate((10, 0, 1000, 3)):
        pq.write_table(sample(n, i * 10_000), tmp_path / f"{i}.parquet", compression=codec, row_group_size=300, write_page_index=True, use_dictionary=i % 2 == 0)
        parts.append(f"file://{tmp_path}/{i}.parquet")
    out = b.join_files(parts, f"file://{tmp_path}/out.parquet")
    assert out["rows"] == 1013 and out["files"] == 4
    got = pq.read_table(tmp_path / "out.parquet")
    assert got.equals(pa.concat_tables([pq.read_table(tmp_path / f"{i}.parquet") for i in range(4)]))
    assert pq.ParquetFile(tmp_path / "out.parquet").metadata.num_row_groups == out["blocks"]
    again = b.join_files([f"file://{tmp_path}/out.parquet", parts[0]], f"file://{tmp_path}/twice.parquet")  # what was joined can be joined
    assert again["rows"] == 1023 and pq.read_table(tmp_path / "twice.parquet").num_rows == 1023


def test_refusals(tmp_path):
    pq.write_table(pa.table({"a": [1]}), tmp_path / "a.parquet")
    pq.write_table(pa.table({"a": ["x"]}), tmp_path / "b.parquet")
    (tmp_path / "c.parquet").write_bytes(b"PAR1 no parquet at all PAR2")
    (tmp_path / "d.parquet").write_bytes(b"")
    for other in "bcd":
        with pytest.raises(b.Incompatible):
            b.join_files([str(tmp_path / "a.parquet"), str(tmp_path / f"{other}.parquet")], str(tmp_path / "out.parquet"))
    assert not glob.glob(str(tmp_path / "out.parquet*"))


def test_avro_join():
    schema = {"type": "record", "name": "r", "fields": [{"name": "a", "type": "long"}, {"name": "b", "type": ["null", "string"]}]}
    rows = [[{"a": i, "b": None if i % 3 else str(i)} for i in range(n)] for n in (0, 5, 2500)]
    files = [avro_ocf.write(schema, r, {"x": "1"}) for r in rows]
    assert avro_ocf.read(avro_ocf.join(files))[1] == sum(rows, [])
    with pytest.raises(avro_ocf.AvroError):
        avro_ocf.join([files[0], avro_ocf.write(schema, rows[0], {"x": "2"})])


def test_compact(spark, tmp_path):
    df = spark.range(5000).withColumn("t", F.concat(F.lit("v"), F.col("id") % 7))
    df.repartition(40).write.parquet(f"file://{tmp_path}/in")
    spark.range(10).selectExpr("cast(id AS int) AS id", "'x' AS t").write.mode("append").parquet(f"file://{tmp_path}/in")  # of another schema
    r = c.compact_parquet(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out", target_bytes=20_000).collect()
    assert sum(x.rows for x in r) == 5010 and sum(x.files for x in r) >= 41 and len(r) < 12
    files = [x.target for x in r if x.rows != 10]
    assert spark.read.parquet(*files).exceptAll(df).count() == 0 and spark.read.parquet(*files).count() == 5000
    with pytest.raises(FileExistsError):
        c.compact_parquet(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out")


def test_assign(spark):
    r = random.Random(1)
    rows = [("a", f"f{i}", r.randint(1, 1000)) for i in range(500)] + [("a", "big", 9000), ("a", "unknown", None), ("b", "few", 5), (None, "n", 1)] + [(None, f"n{i}", 1) for i in range(12)]
    df = spark.createDataFrame(rows, "g string, path string, size long").withColumn("piece0", F.lit(1))
    out = c.assign(df, ["g"], "path", "size", target=10_000, small_mean=5000).collect()
    assert sorted((x.g or "", x.path) for x in out) == sorted((g or "", p) for g, p, _ in rows)
    assert {x.path for x in out if x.bin is None} == {"big", "unknown", "few"}
    sums: dict = {}
    for x in out:
        if x.bin is not None:
            sums[x.g, x.piece, x.bin] = sums.get((x.g, x.piece, x.bin), 0) + x.size
    full = [v for (g, *_), v in sums.items() if g == "a"]
    assert max(full) <= 11_000 and sum(full) == sum(s for g, _, s in rows[:500])
    assert c.assign(df.limit(0), ["g"], "path", "size").count() == 0
    cut = c.assign(df, ["g"], "path", "size", target=100, small_mean=5000)  # pieces of bounded size
    assert cut.agg(F.countDistinct("piece")).first()[0] > 5


def test_need(spark):
    df = spark.createDataFrame([("a", 10)] * 10 + [("b", 10)] * 9 + [("c", None)] * 20 + [("d", 1 << 20)] * 20, "g string, size long")
    assert [r.g for r in c.groups_in_need(df, ["g"], "size").collect()] == ["a"]


def test_containers(spark):
    schema = {"type": "record", "name": "r", "fields": [{"name": "a", "type": "long"}]}
    pack = avro_ocf.packer(schema)
    rows = [(f"t{i % 3}", pack([{"a": i}, {"a": -i}])) for i in range(30)] + [("t0", None), (None, pack([])), (None, pack([{"a": 7}]))]
    df = spark.createDataFrame(rows, "target string, content binary")
    got = {r.target: r for r in c.join_containers(df, "target", "content", keep=True).collect()}
    assert {k: (r.files, r.blocks, r.records) for k, r in got.items()} == {"t0": (11, 10, 20), "t1": (10, 10, 20), "t2": (10, 10, 20), None: (2, 1, 1)}
    assert sorted(x["a"] for x in avro_ocf.read(bytes(got["t1"].content))[1]) == sorted([*range(1, 30, 3), *range(-28, 0, 3)])
    assert c.join_containers(df.limit(0), "target", "content").count() == 0
    other = avro_ocf.packer({**schema, "name": "other"})
    with pytest.raises(Exception, match="differ"):
        c.join_containers(spark.createDataFrame([("t", pack([])), ("t", other([]))], df.schema), "target", "content").collect()


def test_rewrite_manifests(spark, tmp_path):
    from tabulith.plans import expressions as e
    from tabulith.plans.scan import SnapshotTable
    from tabulith.sources.writer import TableWriter

    df = spark.range(60).selectExpr("id", "cast(id % 20 AS int) AS part")
    w = TableWriter.create(spark, f"file://{tmp_path}/t", df.schema, [("part", "identity")])
    w.append(df, per_manifest=1)
    w.append(df.where("id < 6").withColumn("part", F.lit(None).cast("int")), per_manifest=1)
    before = SnapshotTable(spark, ("t",), w.metadata)
    files = sorted((r.file_path, r.sequence_number, r.snapshot_id) for r in before.files().collect())
    r = c.rewrite_manifests(w, min_files=2).collect()
    assert [(x.files, x.blocks, x.records) for x in r] == [(20, 20, 20)]
    after = SnapshotTable(spark, ("t",), w.metadata)
    assert sorted((x.file_path, x.sequence_number, x.snapshot_id) for x in after.files().collect()) == files
    rows = {x.sequence_number: x for x in after.manifests().collect()}
    assert len(rows) == 2 and (rows[1].added_files_count, rows[1].added_rows_count, bytes(rows[1].partitions[0].lower_bound), bytes(rows[1].partitions[0].upper_bound), rows[1].partitions[0].contains_null) == (20, 60, b"\0\0\0\0", b"\x13\0\0\0", False)
    assert after.scan(row_filter=e.equal("part", 7)).to_df().count() == 3 and after.scan().to_df().count() == 66 and after.metadata.current_snapshot.summary.operation == "replace"
    assert c.rewrite_manifests(w, min_files=2).count() == 0 and w.metadata.current_snapshot.snapshot_id == after.metadata.current_snapshot_id
