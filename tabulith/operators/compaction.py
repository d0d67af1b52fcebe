"""Far too many small files: which groups need consolidation, which file goes where, and the consolidation itself.

Planning is an aggregation and a window over pieces of bounded size. Consolidation copies encoded blocks and rewrites footers, it
never decodes rows (``sources.parquet_blocks`` for Parquet, ``sources.avro_ocf`` for Avro such as manifests).
"""

from __future__ import annotations

import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from tabulith.session import materialize
from tabulith.sources import avro_ocf, parquet_blocks
from tabulith.sources.filesystem import read_bytes, write_bytes

MIN_FILES = 10
SMALL_MEAN = 1 << 20
TARGET = 8 << 20
PIECE_FILES = 50_000
PIECE_TARGETS = 64
COPY_TASKS = 50_000


def groups_in_need(files: DataFrame, group: Sequence[str], size: str, min_files: int = MIN_FILES, small_mean: int = SMALL_MEAN) -> DataFrame:
    """Groups of at least ``min_files`` files whose mean ``size`` is below ``small_mean``: ``group, n_files, n_bytes``.

    A NULL size is unknown and left out of the mean; a group of unknown sizes only isn't in need. NULL group values are values.
    """
    stats = files.groupBy(*group).agg(F.count("*").alias("n_files"), F.sum(size).alias("n_bytes"), F.avg(size).alias("mean"))
    return stats.where((F.col("n_files") >= min_files) & (F.col("mean") < small_mean)).drop("mean")


def assign(files: DataFrame, group: Sequence[str], path: str, size: str, target: int = TARGET, **limits: int) -> DataFrame:
    """Add ``piece`` and ``bin``: each file of a group in need goes to exactly one new file ``(group, piece, bin)`` of about ``target``
    bytes; files that have three quarters of it already, or whose size is unknown, stay as they are (NULL). Files of other groups get
    NULL too.

    A group is cut into pieces of bounded size by the hash of the path, so no task holds a large group. In a piece the files are
    lined up by size (ties by path) and cut where the sum passes a multiple of the target; a new file deviates from the target by
    less than one old file. A path should occur once per group: repeated ones get places of their own.
    """
    need = groups_in_need(files, group, size, **limits).select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)], "n_files", "n_bytes")
    joined = files.join(need, [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(group)], "left").drop(*[f"_g{i}" for i in range(len(group))])
    pieces = F.greatest(F.ceil(F.col("n_bytes") / (PIECE_TARGETS * target)), F.ceil(F.col("n_files") / PIECE_FILES), F.lit(1))
    move = F.col("n_files").isNotNull() & F.col(size).isNotNull() & (F.col(size) < target * 3 // 4)
    w = Window.partitionBy(*group, "piece").orderBy(F.col(size).desc(), F.col(path)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    moved = joined.where(move).withColumn("piece", F.pmod(F.xxhash64(path), pieces).cast("int"))
    moved = moved.withColumn("bin", F.floor((F.sum(size).over(w) - F.col(size) / 2) / target).cast("int"))
    stay = joined.where(~F.coalesce(move, F.lit(False))).withColumn("piece", F.lit(None).cast("int")).withColumn("bin", F.lit(None).cast("int"))
    return moved.unionByName(stay).drop("n_files", "n_bytes")


def spread_targets(plan: DataFrame) -> DataFrame:
    """The written ``plan`` over as many partitions as it has targets, up to ``COPY_TASKS``. Its rows are but paths, so adaptive execution would put
    them, and all the copying, into one task if the number of partitions weren't given."""
    return plan.repartition(max(1, min(plan.select("target").distinct().count(), COPY_TASKS)), "target")


def join_containers(containers: DataFrame, target: str, content: str, keep: bool = False) -> DataFrame:
    """Join Avro containers (binary ``content``) by ``target``, a text: ``target, files, blocks, records, bytes`` and, with ``keep``, the new ``content``.

    Encoded blocks are copied, not decoded; containers of one target must have one schema, codec and metadata, and each new one is checked for header, blocks and
    records. A NULL content is an empty container; a NULL target is one of its own. The bytes of one target are one task's, so targets must be bounded, as ``assign``'s are.
    """
    ddl = "target string, files int, blocks bigint, records bigint, bytes bigint" + (", content binary" if keep else "")

    def copy(d: pd.DataFrame) -> pd.DataFrame:
        data = [bytes(x) for x in d["_c"] if x is not None]
        new, blocks, records = avro_ocf.join_counted(data) if data else (b"", 0, 0)
        return pd.DataFrame([{"target": d["_t"].iloc[0], "files": len(d), "blocks": blocks, "records": records, "bytes": len(new)} | ({"content": new} if keep else {})])

    return containers.select(F.col(target).alias("_t"), F.col(content).alias("_c")).groupBy("_t").applyInPandas(copy, ddl)


def compact_avro(spark: SparkSession, plan: DataFrame, props: dict[str, str] | None = None) -> DataFrame:
    """Carry out a written plan (``path, target``) on Avro files such as manifests: ``target, files, blocks, records, bytes`` per new file, already
    written. Each is checked for header, blocks and records and then appears whole. Old files stay."""

    def copy(d: pd.DataFrame) -> pd.DataFrame:
        new, blocks, records = avro_ocf.join_counted([read_bytes(p, props) for p in sorted(d["path"])])
        out = d["target"].iloc[0]
        write_bytes(out, new, props)
        return pd.DataFrame([{"target": out, "files": len(d), "blocks": blocks, "records": records, "bytes": len(new)}])

    return materialize(spread_targets(plan.select("path", "target")).groupBy("target").applyInPandas(copy, "target string, files int, blocks bigint, records bigint, bytes bigint"), "joined")


def rewrite_manifests(writer, target: int = TARGET, **limits: int) -> DataFrame:
    """Join a table's small manifests by copying their blocks, and publish a snapshot that lists the new ones: ``target, files, blocks, records, bytes``.

    Entries may inherit snapshot and sequence number from their manifest's row, so only manifests with the same ones, of one spec and content, are joined and
    the new row keeps them; rows, statistics and deletes mean what they did. Counts are added up, partition summaries combined. Nothing to do: no
    snapshot, no rows.
    """
    from tabulith.plans.scan import SnapshotTable

    spark, m = writer.spark, writer.metadata
    table = SnapshotTable(spark, ("rewrite",), m)
    group = ["partition_spec_id", "content", "sequence_number", "added_snapshot_id"]
    plan = assign(table.manifests(), group, "manifest_path", "manifest_length", target, **limits).where("bin IS NOT NULL")
    name = F.concat(F.lit(f"{writer.location}/metadata/joined-"), F.sha1(F.to_json(F.struct(F.lit(m.last_sequence_number), *group, "piece", "bin"))), F.lit(".avro"))
    plan = materialize(plan.select(F.col("manifest_path").alias("path"), name.alias("target")), "plan")
    plan = plan.join(plan.groupBy("target").agg(F.count("*").alias("n")).where("n > 1"), "target", "left_semi")
    done = compact_avro(spark, materialize(plan, "plan"))
    made = {r.target: r for r in done.collect()}  # a row for each new manifest, all of which the new list holds
    if made:
        writer.replace_manifests({r.path: r.target for r in plan.collect()}, {k: r.bytes for k, r in made.items()})
    return done


def merge_manifests(writer, target: int = TARGET, **limits: int) -> int | None:
    """Merge a table's manifests of any age, by decoding their entries: what these inherit is written out, added ones become existing ones and deleted ones go.
    Returns the id of the new snapshot; None if there is nothing to merge.

    For manifests that ``rewrite_manifests`` can't join. Rows and deletes mean what they did, and ``appended_files`` still finds what each snapshot added.
    """
    from tabulith.plans.scan import SnapshotTable
    from tabulith.sources.manifests import DELETED, entry_rows
    from tabulith.sources.writer import combined_rows

    spark, m = writer.spark, writer.metadata
    rows = {r["manifest_path"]: r for r in avro_ocf.read(read_bytes(m.current_snapshot.manifest_list))[1]}
    group = ["partition_spec_id", "content"]
    plan = assign(SnapshotTable(spark, ("merge",), m).manifests(), group, "manifest_path", "manifest_length", target, **({"min_files": 2, "small_mean": 1 << 62} | limits)).where("bin IS NOT NULL")
    name = F.concat(F.lit(f"{writer.location}/metadata/merged-"), F.sha1(F.to_json(F.struct(F.lit(m.last_sequence_number), *group, "piece", "bin"))), F.lit(".avro"))
    plan = materialize(plan.select(F.col("manifest_path").alias("path"), name.alias("target"), "partition_spec_id", *[F.col(c).cast("string").alias(c) for c in ("sequence_number", "added_snapshot_id")]), "plan")
    plan = materialize(plan.join(plan.groupBy("target").agg(F.count("*").alias("n")).where("n > 1"), "target", "left_semi"), "plan")

    def merge(d: pd.DataFrame) -> pd.DataFrame:
        out, first, numbers = [], None, []
        for r in d.sort_values("path").itertuples(index=False):
            data = read_bytes(r.path)
            meta, entries = avro_ocf.read(data)
            first = first or meta
            known = {"manifest_path": r.path, "partition_spec_id": r.partition_spec_id, "sequence_number": r.sequence_number, "added_snapshot_id": r.added_snapshot_id}
            for x, y in zip(entries, entry_rows(data, {k: None if pd.isna(v) else v if k == "manifest_path" else int(v) for k, v in known.items()}), strict=True):
                if x["status"] != DELETED:
                    out.append(x | {"status": 0} | {k: y[k] for k in ("snapshot_id", "sequence_number", "file_sequence_number")})
                    numbers.append(y["sequence_number"])
        data = avro_ocf.write(json.loads(first["avro.schema"]), out, {k: v for k, v in first.items() if not k.startswith("avro.")})
        write_bytes(d["target"].iloc[0], data)
        return pd.DataFrame([{"target": d["target"].iloc[0], "bytes": len(data), "n": len(out), "n_rows": sum(x["data_file"]["record_count"] for x in out), "least": min((n for n in numbers if n is not None), default=0)}])

    made = {r.target: r for r in spread_targets(plan).groupBy("target").applyInPandas(merge, "target string, bytes bigint, n bigint, n_rows bigint, least bigint").collect()}  # one row for each new manifest
    if not made:
        return None
    snap, new = writer._new_id(), {}
    into = {r.path: r.target for r in plan.select("path", "target").collect()}
    for path, r in rows.items():
        k = into.get(path, path)
        new[k] = new[k] | combined_rows(new[k], r, m) if k in new else dict(r)
    for k, r in made.items():
        new[k] |= {"manifest_path": k, "manifest_length": r.bytes, "sequence_number": m.last_sequence_number + 1, "min_sequence_number": r.least, "added_snapshot_id": snap, "added_files_count": 0, "existing_files_count": r.n, "deleted_files_count": 0, "added_rows_count": 0, "existing_rows_count": r.n_rows, "deleted_rows_count": 0}
    return writer.publish_manifests(list(new.values()), {"manifests-replaced": str(len(into)), "manifests-created": str(len(made))}, snap)


def compact_parquet(spark: SparkSession, source: str, target: str, target_bytes: int = 128 << 20) -> DataFrame:
    """Join the Parquet files under ``source`` into files of about ``target_bytes`` under ``target`` by copying their blocks.

    Files of different schemas never meet: the schema's bytes are part of the group. Each old file goes whole into exactly one new
    one, empty ones (no row) too. Returns a report: ``target, files, blocks, rows, bytes`` per new file, already carried out; the
    sums over all of it equal those of the source or the call fails. ``target`` must not exist; readers switch to it when this returns.
    """
    from tabulith.session import hadoop_fs

    fs, p = hadoop_fs(spark, target)
    if fs.exists(p):
        raise FileExistsError(target)
    fs.mkdirs(p)
    listing = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(source).select("path", "length")

    def feet(frames):
        for d in frames:
            out = []
            for path, n in zip(d["path"], d["length"], strict=True):
                f = parquet_blocks.read_footer(path)
                out.append((path, int(n), pd.util.hash_array(pd.array([f.schema], dtype=object).to_numpy())[0].astype("int64"), f.rows, len(f.groups)))
            yield pd.DataFrame(out, columns=["path", "length", "kind", "rows", "blocks"])

    n = listing.count()
    files = materialize(listing.repartition(max(1, min(n, 4 * spark.sparkContext.defaultParallelism)), "path").mapInPandas(feet, "path string, length long, kind long, rows long, blocks int"), "footers")
    plan = assign(files, ["kind"], "path", "length", target_bytes, min_files=1, small_mean=1 << 62)
    name = F.concat(F.lit(f"{target.rstrip('/')}/part-"), F.hex("kind"), F.lit("-"), F.coalesce(F.concat_ws("-", "piece", "bin"), F.concat(F.lit("x"), F.hex(F.xxhash64("path")))), F.lit(".parquet"))

    def copy(d: pd.DataFrame) -> pd.DataFrame:
        out = d["target"].iloc[0]
        r = parquet_blocks.join_files(sorted(d["path"]), out)
        return pd.DataFrame([{"target": out, **r}])

    plan = materialize(plan.withColumn("target", name).select("path", "target"), "plan")
    done = materialize(spread_targets(plan).groupBy("target").applyInPandas(copy, "target string, files int, blocks int, rows long, bytes long"), "compacted")
    a = files.agg(F.count("*"), F.coalesce(F.sum("blocks"), F.lit(0)), F.coalesce(F.sum("rows"), F.lit(0))).first()
    b = done.agg(F.coalesce(F.sum("files"), F.lit(0)), F.coalesce(F.sum("blocks"), F.lit(0)), F.coalesce(F.sum("rows"), F.lit(0))).first()
    if tuple(a) != tuple(b):
        raise RuntimeError(f"the new files hold {tuple(b)} files, blocks and rows; the source {tuple(a)}")
    return done
