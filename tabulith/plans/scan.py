"""Scans of table versions: which files, which columns, which deletes, and the rows.

Planning is done on DataFrames of manifests and entries. What it leaves is read by Spark's own columnar readers, with the columns found by field
id; only files that deletes apply to pass through anti joins. The driver holds the paths of the surviving files, as Spark's file index does anyway.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulith import types as t
from tabulith.functions.paths import same_file
from tabulith.functions.transforms import PartitionSpec
from tabulith.plans.expressions import AlwaysTrue, Bound, Expression, bind, fold, to_column
from tabulith.plans.pruning import might_match_column, partition_condition, project, summary_condition
from tabulith.schema import TableSchema
from tabulith.session import materialize
from tabulith.sources.datafiles import FORMATS, read_files
from tabulith.sources.filesystem import read_bytes, spark_path
from tabulith.sources.manifests import DATA, EQUALITY_DELETES, MANIFESTS, POSITION_DELETES, has_files, read_entries, read_lists
from tabulith.sources.metadata import Snapshot, TableMetadata
from tabulith.sources.writer import PATH_ID, POS_ID


class ScanError(ValueError):
    """The scan's options contradict each other or name nothing."""


@dataclass
class SnapshotTable:
    """A table at one version of its metadata."""

    spark: SparkSession
    identifier: tuple[str, ...]
    metadata: TableMetadata
    metadata_location: str = ""
    props: dict[str, str] = field(default_factory=dict)
    catalog: object = None

    @staticmethod
    def load(spark: SparkSession, identifier: Sequence[str], location: str, props: dict[str, str] | None = None, catalog: object = None) -> SnapshotTable:
        return SnapshotTable(spark, tuple(identifier), TableMetadata.parse(read_bytes(location, props)), location, dict(props or {}), catalog)

    def refresh(self) -> SnapshotTable:
        if self.catalog is None:
            raise ScanError("the table came from no catalog")
        return self.catalog.load_table(self.identifier)

    @property
    def location(self) -> str:
        return self.metadata.location

    def __eq__(self, other: object) -> bool:
        return isinstance(other, SnapshotTable) and (self.identifier, self.metadata_location, self.metadata) == (other.identifier, other.metadata_location, other.metadata)

    def scan(self, select: Sequence[str] = ("*",), row_filter: Expression = AlwaysTrue(), snapshot_id: int | None = None, ref: str | None = None, timestamp_ms: int | None = None, case_sensitive: bool = True, limit: int | None = None, skipping: bool = True) -> TableScan:  # noqa: B008
        """At most one of ``snapshot_id``, ``ref`` and ``timestamp_ms`` chooses the version; without, the current one is read."""
        if sum(x is not None for x in (snapshot_id, ref, timestamp_ms)) > 1:
            raise ScanError("a scan reads one snapshot: give an id, a ref or a time")
        m = self.metadata
        if ref is not None:
            snap = m.snapshot_by_name(ref)
            if snap is None:
                raise ScanError(f"cannot scan unknown ref={ref}")
        elif timestamp_ms is not None:
            snap = m.snapshot_at(timestamp_ms)
            if snap is None:
                raise ScanError(f"there was no snapshot at {timestamp_ms}")
        elif snapshot_id is not None:
            snap = m.snapshot(snapshot_id)
            if snap is None:
                raise ScanError(f"there is no snapshot {snapshot_id}")
        else:
            snap = m.current_snapshot
        explicit = ref is not None or timestamp_ms is not None or snapshot_id is not None
        return TableScan(self, snap, tuple(select), row_filter, case_sensitive, limit, skipping, explicit)

    # --- metadata tables

    def manifests(self, snapshot: Snapshot | None = None) -> DataFrame:
        snap = snapshot or self.metadata.current_snapshot
        return read_lists(self.spark, [snap.manifest_list] if snap and snap.manifest_list else [], self.props).drop("manifest_list")

    def entries(self, snapshot: Snapshot | None = None, discard_deleted: bool = False) -> DataFrame:
        return read_entries(self.manifests(snapshot), self.props, discard_deleted)

    def files(self, snapshot: Snapshot | None = None) -> DataFrame:
        return self.entries(snapshot, True)

    def all_files(self) -> DataFrame:
        """``snapshot, manifest_list`` and entries of all snapshots, deleted entries too."""
        rows = [(s.snapshot_id, s.schema_id, s.manifest_list) for s in self.metadata.snapshots if s.manifest_list]
        snaps = self.spark.createDataFrame(rows, "snapshot bigint, schema_id int, manifest_list string")
        lists = read_lists(self.spark, [r[2] for r in rows], self.props)
        return snaps.join(lists.select("manifest_list", "manifest_path"), "manifest_list").join(read_entries(lists, self.props), "manifest_path")


@dataclass
class TableScan:
    table: SnapshotTable
    snapshot: Snapshot | None
    select: tuple[str, ...]
    row_filter: Expression
    case_sensitive: bool
    limit: int | None
    skipping: bool = True
    explicit: bool = False

    @property
    def schema(self) -> TableSchema:
        """The schema of the snapshot if one was asked for and names it, else the current one."""
        m = self.table.metadata
        return m.schema(self.snapshot.schema_id if self.explicit and self.snapshot and self.snapshot.schema_id is not None else None)

    def projection(self) -> TableSchema:
        return self.schema.select(self.select, self.case_sensitive)

    def use_ref(self, name: str) -> TableScan:
        if self.explicit:
            raise ScanError(f"cannot override the snapshot, already set to {self.snapshot.snapshot_id}")
        return self.table.scan(self.select, self.row_filter, ref=name, case_sensitive=self.case_sensitive, limit=self.limit, skipping=self.skipping)

    def _bound(self) -> Expression:
        return bind(self.schema, self.row_filter, self.case_sensitive)

    def _by_spec(self, condition) -> Column:
        """A condition that differs by partition spec; unknown specs keep all."""
        if isinstance(self._bound(), AlwaysTrue):
            return F.lit(True)
        out = F.lit(True)
        for s in self.table.metadata.specs:
            tree = project(self._bound(), self._known(s), self.schema)
            out = F.when(F.col("_spec") == s.spec_id, condition(tree, s)).otherwise(out)
        return out

    def _known(self, spec: PartitionSpec) -> PartitionSpec:
        return replace(spec, fields=tuple(f for f in spec.fields if f.source_id in self.schema.by_id))

    @cached_property
    def _manifests(self) -> DataFrame:
        m = self.table.manifests(self.snapshot) if self.snapshot else self.table.spark.createDataFrame([], MANIFESTS)
        m = m.where(has_files()).withColumn("_spec", F.col("partition_spec_id"))
        if self.skipping:
            m = m.where((F.col("content") != DATA) | self._by_spec(lambda tree, s: summary_condition(tree, s, F.col("partitions"))))
        return m.drop("_spec")

    def manifests(self) -> DataFrame:
        """Rows of the manifests that might hold matching rows, and of all manifests of deletes."""
        return self._manifests

    def min_sequence_number(self) -> int | None:
        """The least sequence number of the data manifests; None without any."""
        return self.manifests().where(F.col("content") == DATA).agg(F.min("min_sequence_number")).first()[0]

    def entries(self) -> DataFrame:
        """Living entries: data files that might hold matching rows, and all delete files."""
        e = read_entries(self.manifests(), self.table.props, True).withColumn("_spec", F.col("spec_id"))
        if self.skipping:
            keys = lambda i: F.try_element_at("partition", F.lit(i))
            known = lambda i: F.coalesce("partition_known", F.lit(False))
            keep = self._by_spec(lambda tree, s: partition_condition(tree, keys, known)) & might_match_column(self._bound())
            e = e.where((F.col("content") != DATA) | keep)
        return e.drop("_spec")

    def plan_files(self) -> DataFrame:
        """A task per data file: ``file_path, file_format, spec_id, partition_json, sequence_number, record_count, start, length, size_with_deletes,
        delete_files`` (the position-delete files that name it and aren't older) and ``equality_deletes`` (whether younger equality deletes reach its
        partition). The size is that of the file and its position-delete files."""
        return self._with_deletes(materialize(self.entries(), "entries"))

    def _with_deletes(self, e: DataFrame) -> DataFrame:
        spark = self.table.spark
        data = e.where(F.col("content") == DATA)
        head = data.select("file_path", same_file(F.col("file_path")).alias("p"), "spec_id", "partition_json", "sequence_number")
        info = ("file_path", "sequence_number", "file_size_in_bytes", "file_format")
        bound = lambda m: same_file(F.try_element_at(m, F.lit(PATH_ID)).cast("string"))
        pos = e.where(F.col("content") == POSITION_DELETES).select(F.struct(*info).alias("d"), F.col("spec_id").alias("dspec"), F.col("partition_json").alias("dpart"), bound("lower_bounds").alias("lo"), bound("upper_bounds").alias("hi"))
        # a delete file whose bounds are one path names that data file; others are asked which ones they name
        named = pos.where("lo = hi").withColumn("q", F.col("lo"))
        spanning = pos.where("NOT coalesce(lo = hi, false)")
        paths = [(r.k, r.f) for r in spanning.select(F.col("d.file_path").alias("f"), F.lower("d.file_format").alias("k")).collect()]
        if paths:
            inside = self._positions(paths).select(F.col("_p").alias("q"), "_d").distinct()
            named = named.unionByName(spanning.join(inside, same_file(F.col("d.file_path")) == F.col("_d")).drop("_d"))
        here = (F.col("dpart") == "{}") | ((F.col("spec_id") == F.col("dspec")) & (F.col("partition_json") == F.col("dpart")))
        found = head.join(named, F.col("p") == F.col("q")).where(here & (F.col("sequence_number") <= F.col("d.sequence_number"))).groupBy("file_path").agg(F.collect_set("d").alias("delete_files"))
        # of equality deletes the youngest of a partition tells whether any applies: no list of them per file
        eq = e.where(F.col("content") == EQUALITY_DELETES)
        youngest = eq.groupBy(F.col("spec_id").alias("dspec"), F.col("partition_json").alias("dpart")).agg(F.max("sequence_number").alias("young"))
        everywhere = youngest.where("dpart = '{}'").agg(F.max("young")).first()[0]
        scoped = youngest.where("dpart <> '{}'")
        none = F.expr("cast(array() as array<struct<file_path:string,sequence_number:bigint,file_size_in_bytes:bigint,file_format:string>>)")
        out = data.join(found, "file_path", "left").join(scoped, (F.col("spec_id") == F.col("dspec")) & (F.col("partition_json") == F.col("dpart")), "left")
        out = out.withColumn("delete_files", F.coalesce("delete_files", none))
        extra = F.aggregate("delete_files", F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x["file_size_in_bytes"], F.lit(0)))
        reach = F.coalesce(F.col("sequence_number") < F.greatest(F.coalesce("young", F.lit(-1)), F.lit(-1 if everywhere is None else everywhere)), F.lit(False))
        return out.select("file_path", "file_format", "spec_id", "partition_json", "sequence_number", "record_count", F.lit(0).cast("long").alias("start"), F.col("file_size_in_bytes").alias("length"), (F.col("file_size_in_bytes") + extra).alias("size_with_deletes"), "delete_files", reach.alias("equality_deletes"))

    def to_df(self) -> DataFrame:
        out = self._rows()
        return out if self.limit is None else out.limit(self.limit)

    def _rows(self) -> DataFrame:
        spark = self.table.spark
        bound, wanted = self._bound(), self.projection()
        filter_ids = _ids(bound)
        plan = entries = None
        if not self.manifests().where(F.col("content") != DATA).select("content").take(1):
            rows = self.entries().select("file_path", "file_format", F.lit(False).alias("dirty")).collect()
        else:
            entries = materialize(self.entries(), "entries")
            plan = materialize(self._with_deletes(entries), "tasks")
            rows = plan.select("file_path", "file_format", ((F.size("delete_files") > 0) | F.col("equality_deletes")).alias("dirty")).collect()
        formats = {r.file_format.lower() for r in rows}
        if not formats <= set(FORMATS):
            raise ScanError(f"no reader for {', '.join(sorted(formats - set(FORMATS)))} data files")
        equality: dict[tuple[int, ...], DataFrame] = {}
        positions: list[tuple[str, str]] = []
        if any(r.dirty for r in rows):
            deleted = plan.select(F.explode("delete_files").alias("d")).select(F.lower("d.file_format").alias("k"), F.col("d.file_path").alias("f"))
            positions = [(r.k, r.f) for r in deleted.distinct().collect()]
            eq = entries.where(F.col("content") == EQUALITY_DELETES)
            equality = {tuple(r.equality_ids): eq.where(F.col("equality_ids") == F.array(*[F.lit(i) for i in r.equality_ids])) for r in eq.select("equality_ids").distinct().collect()}
        need = {i for ids in equality for i in ids} | filter_ids
        plain_schema = _read_schema(self.schema, wanted, filter_ids)
        parts = []
        for fmt in sorted(formats):
            clean = [r.file_path for r in rows if r.file_format.lower() == fmt and not r.dirty]
            dirty = [r.file_path for r in rows if r.file_format.lower() == fmt and r.dirty]
            if clean:
                parts.append(self._finish(self._read(fmt, clean, plain_schema), bound, wanted))
            if dirty:
                if fmt == "orc" and positions:
                    raise ScanError("ORC files have no row positions: position deletes can't be applied to them")
                full = self._read(fmt, dirty, _read_schema(self.schema, wanted, need & set(self.schema.by_id)), rows=True)
                cols = [c for c in full.columns if c not in ("_tab_path", "_tab_pos")]
                full = full.withColumn("_tab_path", same_file(F.col("_tab_path")))
                parts.append(self._finish(self._apply(full, plan, positions, equality).select(*cols), bound, wanted))
        if not parts:
            return spark.createDataFrame([], wanted.to_spark(False))
        return reduce(DataFrame.unionByName, parts)

    def _finish(self, df: DataFrame, bound: Expression, wanted: TableSchema) -> DataFrame:
        df = df if isinstance(bound, AlwaysTrue) else df.where(to_column(bound))
        names = [f.name for f in wanted.fields]
        return df.select(*[_shaped(f, next(x for x in self.schema.fields if x.id == f.id)) for f in wanted.fields]) if names else df.select()

    def _read(self, fmt: str, paths: list[str], schema: TableSchema, rows: bool = False) -> DataFrame:
        # a name that was another field's in any version may be so in a file
        reused = any(s.id_of.get(name, i) != i for s in self.table.metadata.schemas for i, name in schema.name_of.items())
        return read_files(self.table.spark, fmt, paths, schema, self.table.metadata.properties, self.table.props, rows, not reused)

    def _positions(self, files: list[tuple[str, str]]) -> DataFrame:
        """``_p, _at, _d`` of position-delete files (format, path): the data file named, the place in it, and the delete file."""
        spark, out = self.table.spark, None
        for fmt in sorted({k for k, _ in files}):
            paths = [p for k, p in files if k == fmt]
            if fmt == "avro":
                shape = TableSchema((t.Field(PATH_ID, "file_path", t.STRING), t.Field(POS_ID, "pos", t.LONG)))
                d = read_files(spark, fmt, paths, shape, {}, self.table.props, rows=True)
            elif fmt in FORMATS:  # the names are fixed
                d = spark.read.schema("file_path string, pos bigint").format(fmt).load([spark_path(p) for p in paths]).select("*", F.col("_metadata.file_path").alias("_tab_path"))
            else:
                raise ScanError(f"no reader for {fmt} delete files")
            part = d.select(same_file(F.col("file_path")).alias("_p"), F.col("pos").alias("_at"), same_file(F.col("_tab_path")).alias("_d"))
            out = part if out is None else out.unionByName(part)
        return out

    def _apply(self, df: DataFrame, plan: DataFrame, positions: list[tuple[str, str]], equality: dict[tuple[int, ...], DataFrame]) -> DataFrame:
        files = plan.select(same_file(F.col("file_path")).alias("_f"), F.col("sequence_number").alias("_seq"), F.col("partition_json").alias("_part"), F.col("spec_id").alias("_spec_id"))
        if positions:
            # the plan has paired data and delete files that belong together
            pairs = plan.select(same_file(F.col("file_path")).alias("_f"), F.explode("delete_files.file_path").alias("_df")).select("_f", same_file(F.col("_df")).alias("_d"))
            d = self._positions(positions)
            d = d.join(pairs.withColumnRenamed("_d", "_dd"), (F.col("_d") == F.col("_dd")) & (F.col("_p") == F.col("_f")), "left_semi").select("_p", "_at").distinct()
            df = df.join(d, (F.col("_tab_path") == F.col("_p")) & (F.col("_tab_pos") == F.col("_at")), "left_anti")
        if equality:
            df = df.join(files.distinct(), F.col("_tab_path") == F.col("_f"))
        for ids, group in equality.items():
            part = TableSchema(tuple(self.schema.by_id[i] for i in ids), 0)
            names = [f.name for f in part.fields]
            found = group.select("file_path", F.lower("file_format").alias("k")).distinct().collect()
            read = [self._read(k, [r.file_path for r in found if r.k == k], part, rows=True) for k in sorted({r.k for r in found})]
            d = reduce(DataFrame.unionByName, read).select(*[F.col(n).alias(f"_e{k}") for k, n in enumerate(names)], same_file(F.col("_tab_path")).alias("_d"))
            meta = group.select(same_file(F.col("file_path")).alias("_d"), F.col("sequence_number").alias("_dseq"), F.col("spec_id").alias("_dspec"), F.col("partition_json").alias("_dpart")).distinct()
            cond = reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(f"_e{k}")) for k, n in enumerate(names)])
            everywhere = [s.spec_id for s in self.table.metadata.specs if not s.fields]
            same = F.col("_dspec").isin(everywhere) | ((F.col("_dspec") == F.col("_spec_id")) & (F.col("_dpart") == F.col("_part")))
            df = df.join(d.join(meta, "_d"), cond & (F.col("_seq") < F.col("_dseq")) & same, "left_anti")
        return df


def _ids(bound: Expression) -> set[int]:
    def leaf(b: Bound) -> set[int]:
        return {b.field.id}

    return fold(bound, leaf, set(), set(), lambda a, b: a | b, lambda a, b: a | b)


def _read_schema(schema: TableSchema, wanted: TableSchema, more: set[int]) -> TableSchema:
    """Top-level columns of the projection, pruned inside, and what filters and deletes need."""
    keep = {i for i, f in wanted.by_id.items() if not isinstance(f.type, t.Struct | t.List | t.Map)} | set(more)
    empty = {f.id for f in wanted.fields if isinstance(f.type, t.Struct) and not f.type.fields}
    return schema.prune(keep | empty, True)


def _shaped(wanted, full) -> Column:
    """A column as the projection has it: parts that only a filter needed are taken out of structs."""

    def shape(c: Column, w: t.Type, h: t.Type) -> Column:
        if isinstance(w, t.Struct) and isinstance(h, t.Struct) and w != h:
            by = {f.id: f for f in h.fields}
            return F.when(c.isNotNull(), F.struct(*[shape(c.getField(by[f.id].name), f.type, by[f.id].type).alias(f.name) for f in w.fields]))
        return c

    return shape(F.col("`" + wanted.name + "`"), wanted.type, full.type).alias(wanted.name)
