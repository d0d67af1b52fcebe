"""Pieces that several operators share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulith.session import materialize


def comparable(df: DataFrame, name: str) -> Column:
    """``df[name]`` in a form that can be compared and grouped: maps become arrays of entries in key order."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.MapType):
        return F.array_sort(F.map_entries(F.col(name)))
    return F.col(name)


def in_force(df: DataFrame, keys: Sequence[str], latest: str, columns: Sequence[str]) -> DataFrame:
    """Per key the row with the greatest ``latest``; of rows that tie, the greatest in the order of ``columns``.

    An aggregation with map-side combine, so one key may hold any share of the rows. Rows whose keys are all NULL are kept
    as one group; a NULL ``latest`` is older than any other. ``columns`` are those that the result keeps beside the keys.
    """
    rest = [c for c in columns if c not in keys]
    order = F.struct(F.col(latest).alias("_l"), *[comparable(df, c).alias(f"_{i}") for i, c in enumerate(rest)])
    best = F.max_by(F.struct(*[F.col(c) for c in rest]), order).alias("_b")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_b.{c}").alias(c) for c in rest])


def digest(df: DataFrame, names: Sequence[str]) -> Column:
    """Two independent 64-bit hashes of the named columns as a struct; equal rows give equal digests, NULLs count as values."""
    parts = [F.coalesce(F.to_json(F.struct(comparable(df, n).alias("v"))), F.lit("-")) for n in names]
    text = F.concat_ws("\x1f", *parts)
    return F.struct(F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(0x5BD1E995), text).alias("h2"))


def places(df: DataFrame, group: str, order: Sequence[Column]) -> DataFrame:
    """``df`` with ``place`` (from 1) of each row within its group (NULL is one) in the given order.

    Rows are partitioned by ranges of group and order and counted within them; offsets per range and group do the rest, so a group may
    hold any share of the rows. Rows that tie in all of ``order`` get places in any order.
    """
    ranged = materialize(df.repartitionByRange(F.col(group), *order).withColumn("_range", F.spark_partition_id()), "ranges")
    # at most one row for each range and one for each group
    sizes = ranged.groupBy(F.col(group).alias("_g"), F.col("_range").alias("_r")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_g").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_g", "_r", F.coalesce(before, F.lit(0)).alias("_before"))
    within = ranged.withColumn("_k", F.row_number().over(Window.partitionBy(group, "_range").orderBy(*order)))
    out = within.join(offsets, (F.col("_range") == F.col("_r")) & F.col(group).eqNullSafe(F.col("_g")))
    return out.withColumn("place", (F.col("_k") + F.col("_before"))).drop("_g", "_r", "_range", "_k", "_before", "_n")


def dyadic_blocks(lo: str, hi: str) -> Column:
    """The range of whole numbers from ``lo`` to ``hi`` (SQL, not negative) as an array of disjoint blocks ``l, i``, at most two per level: a block holds the numbers
    n with n >> l = i. What is in the range is in exactly one of them, so a range join becomes an equi-join."""
    # blocks of level l: an odd low end or an even high end can't be part of a block of the level above
    none = "cast(array() as array<struct<l:int,i:bigint>>)"
    return F.expr(
        f"aggregate(sequence(0, 62), named_struct('lo', cast({lo} as bigint), 'hi', cast({hi} as bigint), 'out', {none}), (z, l) -> CASE WHEN z.lo > z.hi THEN z ELSE named_struct("
        "'lo', (z.lo + 1) div 2, 'hi', (z.hi + 1) div 2 - 1, 'out', concat(z.out,"
        f" CASE WHEN z.lo % 2 = 1 THEN array(named_struct('l', l, 'i', z.lo)) ELSE {none} END,"
        f" CASE WHEN z.hi % 2 = 0 AND NOT (z.lo = z.hi AND z.lo % 2 = 1) THEN array(named_struct('l', l, 'i', z.hi)) ELSE {none} END)) END, z -> z.out)"
    )
