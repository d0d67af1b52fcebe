"""Queries over snapshot tables: projection, filters, skipping, transforms, versions and deletes.

Each writes the given tables as snapshot tables into the shared folder first (once a session and folder), then reads them through the planner.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabulith import types as t
from tabulith.catalog_tables import read
from tabulith.functions.transforms import SortField, SortOrder, Transform
from tabulith.operators.common import places
from tabulith.plans import expressions as e
from tabulith.plans.scan import SnapshotTable
from tabulith.schema import TableSchema
from tabulith.session import new_dir
from tabulith.sources.metadata import history_df, metadata_log_df, refs_df, schemas_df, snapshots_df
from tabulith.sources.writer import TableWriter
from tabulith.streaming.follow import appended_files

_built: dict[tuple[str, str, str], TableWriter] = {}
CUT = "1998-07-01"  # the first snapshot of lineitem holds what was shipped before, the second all


def _build(spark: SparkSession, d: str, name: str) -> TableWriter:
    key = (spark.sparkContext.applicationId, d, name)
    if key in _built:
        return _built[key]
    base = name.split("@")[0]
    df = read(spark, d, base)
    place = f"{new_dir(spark, 'table')}/{base}"
    if name == "lineitem":
        w = TableWriter.create(spark, place, df.schema, [("l_shipdate", "month")])
        w.append(df.where(F.col("l_shipdate") < F.lit(CUT).cast("timestamp_ntz")), tag="early")
        w.append(df.where(F.col("l_shipdate") >= F.lit(CUT).cast("timestamp_ntz")))
    elif name == "customer@renamed":
        w = TableWriter.create(spark, place, df.schema)
        w.append(df.where("c_custkey % 2 = 0"))
        s = w.metadata.schema()
        fields = tuple(t.Field(f.id, {"c_name": "customer_name"}.get(f.name, f.name), f.type) for f in s.fields if f.name != "c_acctbal") + (t.Field(100, "note", t.STRING),)
        w.evolve(TableSchema(fields))
        w.append(df.where("c_custkey % 2 <> 0").select("c_custkey", F.col("c_name").alias("customer_name"), "c_nationkey", "c_mktsegment", F.lit("new").alias("note")))
    elif name == "orders@positions":
        w = TableWriter.create(spark, place, df.schema, [("o_orderdate", "year")])
        w.append(df)
        files = [r.file_path for r in _table(spark, w).files().select("file_path").collect()]
        gone = spark.read.parquet(*files).where("o_orderkey % 7 = 0").select(F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.row_index").alias("pos"))
        w.delete_positions(gone)
        w.append(df.where("o_orderkey % 7 = 0").withColumn("o_orderstatus", F.lit("again")))  # younger than the deletes
    elif name == "orders@equality":
        nulled = df.withColumn("o_orderpriority", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")))
        w = TableWriter.create(spark, place, df.schema, [("o_custkey", "bucket[4]")])
        w.append(nulled)
        w.delete_equal(nulled.where("o_orderpriority IS NULL OR o_orderpriority LIKE '1%'").select("o_orderstatus", "o_orderpriority").distinct(), ["o_orderstatus", "o_orderpriority"])
        w.append(nulled.where("o_orderkey % 11 = 0").withColumn("o_totalprice", F.lit(-1.0)))
    elif name == "customer@nested":
        nested = df.selectExpr("c_custkey", "named_struct('name', c_name, 'home', named_struct('nation', c_nationkey, 'segment', c_mktsegment)) AS who", "c_acctbal")
        w = TableWriter.create(spark, place, nested.schema)
        w.append(nested, files=4)
    elif name == "customer@nan":
        w = TableWriter.create(spark, place, df.schema)
        w.append(df.withColumn("c_acctbal", F.when(F.col("c_custkey") % 10 != 0, F.col("c_acctbal")).otherwise(F.lit(float("nan")))), files=4)
    elif base == "orders":
        w = TableWriter.create(spark, place, df.schema, [("o_orderdate", "year"), ("o_orderkey", "bucket[4]")])
        w.append(df)
    else:
        w = TableWriter.create(spark, place, df.schema)
        w.append(df, files=8)
    _built[key] = w
    return w


def _table(spark: SparkSession, w: TableWriter) -> SnapshotTable:
    return SnapshotTable.load(spark, ("test", "table"), w.metadata_location)


def table(spark: SparkSession, d: str, name: str) -> SnapshotTable:
    return _table(spark, _build(spark, d, name))


def scan_project(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").scan(["c_custkey", "c_name", "c_acctbal"]).to_df()


def scan_project_case_insensitive(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").scan(["C_NAME", "c_CUSTKEY"], case_sensitive=False).to_df()


def prune_by_id(spark: SparkSession, d: str) -> DataFrame:
    tb = table(spark, d, "part")
    kept = tb.metadata.schema().prune({1, 3, 6}, True)
    return tb.scan([f.name for f in kept.fields]).to_df()


LINES = ("l_orderkey", "l_partkey", "l_quantity", "l_shipdate")


def _lines(expr: e.Expression, select: tuple[str, ...] = LINES, name: str = "lineitem", **options) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: table(spark, d, name).scan(select, expr, **options).to_df()


def transform_counts(name: str, column: str, tr: Transform, kind: t.Type) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        df = table(spark, d, name).scan([column]).to_df()
        return df.groupBy(tr.column(F.col(column), kind).alias("part")).agg(F.count("*").alias("n"))

    return run


def transform_truncate_signed(spark: SparkSession, d: str) -> DataFrame:
    """Truncation of negative numbers and decimals goes down."""
    df = table(spark, d, "customer").scan(["c_acctbal"]).to_df()
    n, x = F.col("c_acctbal").cast("long"), F.col("c_acctbal").cast("decimal(12,2)")
    df = df.select(Transform("truncate", 100).column(n, t.LONG).alias("whole"), Transform("truncate", 500).column(x, t.Decimal(12, 2)).cast("double").alias("dec"))
    return df.groupBy("whole", "dec").agg(F.count("*").alias("n"))


def sort_order_places(spark: SparkSession, d: str) -> DataFrame:
    """Places of all orders within their status in the declared order: year of the date descending with NULLs last, then status, then key."""
    tb = table(spark, d, "orders")
    s = tb.metadata.schema()
    order = SortOrder(1, (SortField(s.id_of["o_orderdate"], Transform("year"), "desc"), SortField(s.id_of["o_orderstatus"], Transform("identity"), "asc"), SortField(s.id_of["o_orderkey"], Transform("identity"), "asc")))
    df = tb.scan(["o_orderkey", "o_orderdate", "o_orderstatus"]).to_df()
    return places(df, "o_orderstatus", order.columns(s)).select("o_orderkey", "o_orderstatus", "place")


def pruning_soundness(spark: SparkSession, d: str) -> DataFrame:
    """With and without skipping, side by side: a row that one of them lacks would show."""
    expr = e.And(e.at_least("l_shipdate", "1997-03-15T00:00:00.000000"), e.And(e.less("l_shipdate", "1997-06-10T00:00:00.000000"), e.greater("l_quantity", 45)))
    tb = table(spark, d, "lineitem")
    on, off = (tb.scan(LINES, expr, skipping=s).to_df().groupBy(*LINES).agg(F.count("*").alias("n")) for s in (True, False))
    both = on.join(off.withColumnRenamed("n", "m"), list(LINES), "full")
    return both.select(*LINES, F.coalesce("n", F.lit(0)).alias("n_skipping"), F.coalesce("m", F.lit(0)).alias("n_whole"))


def pruning_files(spark: SparkSession, d: str) -> DataFrame:
    """Data files and rows that remain after skipping, and all."""
    expr = e.And(e.at_least("l_shipdate", "1997-03-15T00:00:00.000000"), e.less("l_shipdate", "1997-06-10T00:00:00.000000"))
    tb = table(spark, d, "lineitem")
    kept = tb.scan(LINES, expr).plan_files().agg(F.count("*").alias("files_kept"), F.sum("record_count").alias("rows_kept"))
    every = tb.scan(LINES, expr, skipping=False).plan_files().agg(F.count("*").alias("files_all"), F.sum("record_count").alias("rows_all"))
    return kept.withColumn("k", F.lit(1)).join(every.withColumn("k", F.lit(1)), "k").drop("k")


def file_stats(spark: SparkSession, d: str) -> DataFrame:
    """Value and NULL counts and bounds per month, from the manifests alone."""
    tb = table(spark, d, "lineitem")
    s = tb.metadata.schema()
    i, q = F.lit(s.id_of["l_orderkey"]), F.lit(s.id_of["l_shipdate"])
    f = tb.files()
    month = F.get_json_object("partition_json", "$.l_shipdate_month").cast("int")
    from tabulith.plans.pruning import bound_key

    number = lambda c, kind: F.conv(F.substring(bound_key(F.try_element_at(c, i), kind), 18, 16), 16, -10).cast("long")
    out = f.select(month.alias("month"), "record_count", F.try_element_at("value_counts", q).alias("v"), F.try_element_at("null_value_counts", q).alias("u"), number("lower_bounds", t.LONG).alias("lo"), number("upper_bounds", t.LONG).alias("hi"))
    return out.groupBy("month").agg(F.sum("record_count").alias("n_rows"), F.sum("v").alias("n_values"), F.sum("u").alias("n_nulls"), F.min("lo").alias("least_key"), F.max("hi").alias("greatest_key"))


def manifests_table(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "lineitem").manifests()
    return m.groupBy("content", "sequence_number").agg(F.sum("added_rows_count").cast("long").alias("added_rows"), F.sum("added_files_count").cast("long").alias("added_files"))


def files_table(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "orders").files()
    return f.groupBy(F.get_json_object("partition_json", "$.o_orderdate_year").cast("int").alias("year")).agg(F.sum("record_count").alias("n_rows"))


def all_files_table(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "lineitem").all_files()
    return f.groupBy("sequence_number").agg(F.sum("record_count").alias("n_rows"), F.countDistinct("snapshot").alias("n_snapshots"))


def snapshots_table(spark: SparkSession, d: str) -> DataFrame:
    s = snapshots_df(spark, table(spark, d, "lineitem").metadata)
    return s.select("sequence_number", "operation", F.col("parent_id").isNull().alias("is_first"))


def refs_table(spark: SparkSession, d: str) -> DataFrame:
    return refs_df(spark, table(spark, d, "lineitem").metadata).select("name", "type")


def history_table(spark: SparkSession, d: str) -> DataFrame:
    return history_df(spark, table(spark, d, "lineitem").metadata).groupBy("is_current_ancestor").agg(F.count("*").alias("n"))


def schemas_table(spark: SparkSession, d: str) -> DataFrame:
    return schemas_df(spark, table(spark, d, "customer@renamed").metadata).select("schema_id", "field_id", "name", "type")


def time_travel_id(spark: SparkSession, d: str) -> DataFrame:
    tb = table(spark, d, "lineitem")
    return tb.scan(LINES, snapshot_id=tb.metadata.snapshots[0].snapshot_id).to_df()


def time_travel_tag(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").scan(LINES, e.greater("l_quantity", 25), ref="early").to_df()


def time_travel_timestamp(spark: SparkSession, d: str) -> DataFrame:
    tb = table(spark, d, "lineitem")
    return tb.scan(LINES, timestamp_ms=tb.metadata.snapshots[0].timestamp_ms).to_df()


def schema_evolution(spark: SparkSession, d: str) -> DataFrame:
    """One column renamed, one dropped, one added between two snapshots; all rows in the current form."""
    return table(spark, d, "customer@renamed").scan().to_df()


def position_deletes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders@positions").scan(["o_orderkey", "o_orderstatus", "o_totalprice"]).to_df()


def equality_deletes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders@equality").scan(["o_orderkey", "o_orderpriority", "o_totalprice"]).to_df()


def incremental_append(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the files that the second snapshot added."""
    tb = table(spark, d, "lineitem")
    f = appended_files(tb, after=tb.metadata.snapshots[0].snapshot_id)
    return f.agg(F.sum("record_count").alias("n_rows"))


def scan_nested(spark: SparkSession, d: str) -> DataFrame:
    """A part of a struct, filtered by another one that is read but not returned."""
    df = table(spark, d, "customer@nested").scan(["c_custkey", "who.home.nation"], e.And(e.at_least("who.name", "Customer#000000100"), e.not_equal("WHO.HOME.SEGMENT", "BUILDING")), case_sensitive=False).to_df()
    return df.select("c_custkey", F.col("who.home.nation").alias("nation"), F.lit(df.schema["who"].dataType.simpleString()).alias("shape"))


def scan_limit(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").scan(["n_nationkey"], limit=7).to_df().agg(F.count("*").alias("n"))


def min_sequence_number(spark: SparkSession, d: str) -> DataFrame:
    """Least sequence number of the data manifests of each version."""
    tb = table(spark, d, "orders@positions")
    rows = [(k, tb.scan(snapshot_id=s.snapshot_id).min_sequence_number()) for k, s in enumerate(tb.metadata.snapshots)]
    return spark.createDataFrame(rows, "version int, least bigint")


def manifest_pruning(spark: SparkSession, d: str) -> DataFrame:
    """Manifests that may hold rows of a month of the first snapshot, and all."""
    tb = table(spark, d, "lineitem")
    kept = tb.scan(LINES, e.And(e.at_least("l_shipdate", "1997-03-15T00:00:00.000000"), e.less("l_shipdate", "1997-06-10T00:00:00.000000")))
    return kept.manifests().agg(F.count("*").alias("kept")).withColumn("every", F.lit(tb.manifests().count()))


def delete_plan(spark: SparkSession, d: str) -> DataFrame:
    """Data files by the number of position-delete files that apply and whether equality deletes do."""
    plan = table(spark, d, "orders@positions").scan(["o_orderkey"]).plan_files()
    return plan.groupBy(F.size("delete_files").alias("position_deletes"), "equality_deletes").agg(F.count("*").alias("n_files"))


def metadata_log_table(spark: SparkSession, d: str) -> DataFrame:
    return metadata_log_df(spark, table(spark, d, "lineitem").metadata).agg(F.count("*").alias("n_earlier"))


AND_OR_NOT = e.Or(e.Not(e.Or(e.less("l_quantity", 40), e.equal("l_returnflag", "N"))), e.And(e.equal("l_linenumber", 1), e.Not(e.not_equal("l_linestatus", "F"))))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        scan_project, scan_project_case_insensitive, prune_by_id, transform_truncate_signed, sort_order_places, pruning_soundness, pruning_files, file_stats, manifests_table, files_table, all_files_table,
        snapshots_table, refs_table, history_table, schemas_table, time_travel_id, time_travel_tag, time_travel_timestamp, schema_evolution, position_deletes, equality_deletes, incremental_append,
        scan_nested, scan_limit, min_sequence_number, manifest_pruning, delete_plan, metadata_log_table,
    )
    docs = ("doc_id", "lang", "author")
    year = Transform("year")
    return {f.__name__: f for f in own} | {
        "filter_eq": _lines(e.equal("l_returnflag", "R")),
        "filter_ne": _lines(e.not_equal("l_returnflag", "R")),
        "filter_is_null": _lines(e.is_null("lang"), docs, "documents"),
        "filter_not_null": _lines(e.And(e.not_null("lang"), e.not_null("author")), docs, "documents"),
        "filter_and_or_not": _lines(AND_OR_NOT),
        "filter_true": _lines(e.AlwaysTrue(), ("n_nationkey", "n_name"), "nation"),
        "filter_false": _lines(e.AlwaysFalse(), ("n_nationkey", "n_name"), "nation"),
        "filter_cast_literal": _lines(e.at_least("o_orderdate", "2000-02-29T00:00:00.000000"), ("o_orderkey", "o_orderdate"), "orders"),
        "filter_out_of_range": _lines(e.Or(e.equal("l_linenumber", 3_000_000_000), e.And(e.less("l_linenumber", 3_000_000_000), e.equal("l_returnflag", "A")))),
        "filter_in": _lines(e.is_in("l_linenumber", (1, 3, 7))),
        "filter_not_in": _lines(e.not_in("l_linenumber", (1, 3, 7))),
        "filter_range": _lines(e.And(e.greater("l_quantity", 10), e.at_most("l_quantity", 12.0))),
        "filter_starts_with": _lines(e.starts_with("p_name", "p"), ("p_partkey", "p_name"), "part"),
        "filter_not_starts_with": _lines(e.Not(e.starts_with("p_brand", "Brand#1")), ("p_partkey", "p_brand"), "part"),
        "sort_order_apply": sort_order_places,
        "filter_is_nan": _lines(e.And(e.is_nan("c_acctbal"), e.greater("c_acctbal", 1e300)), ("c_custkey", "c_name"), "customer@nan"),
        "filter_not_nan_of_some": _lines(e.not_nan("c_acctbal"), ("c_custkey", "c_acctbal"), "customer@nan"),
        "filter_not_nan": _lines(e.not_nan("c_acctbal"), ("c_custkey", "c_acctbal"), "customer"),
        "transform_identity": transform_counts("lineitem", "l_returnflag", Transform("identity"), t.STRING),
        "transform_void": transform_counts("lineitem", "l_returnflag", Transform("void"), t.STRING),
        "transform_truncate_long": transform_counts("lineitem", "l_orderkey", Transform("truncate", 100), t.LONG),
        "transform_truncate_text": transform_counts("customer", "c_mktsegment", Transform("truncate", 3), t.STRING),
        "transform_year": transform_counts("orders", "o_orderdate", year, t.TIMESTAMP),
        "transform_month": transform_counts("orders", "o_orderdate", Transform("month"), t.TIMESTAMP),
        "transform_day": transform_counts("orders", "o_orderdate", Transform("day"), t.TIMESTAMP),
        "transform_hour": transform_counts("events", "ts", Transform("hour"), t.TIMESTAMP),
        "transform_bucket_long": transform_counts("orders", "o_orderkey", Transform("bucket", 16), t.LONG),
        "transform_bucket_text": transform_counts("customer", "c_name", Transform("bucket", 16), t.STRING),
    }
