"""References to records that do not exist: a skew-aware split anti-join.

References are first aggregated per key and period, so a key counts once per period however many rows hold it. Keys that still
have many rows or references are heavy: at most ``1 / heavy_share`` of them exist, so they are broadcast against the targets. All other keys
meet the targets in a shuffled anti-join. Both parts are united.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulith.session import materialize


def split_heavy(counts: DataFrame, heavy_share: float) -> DataFrame:
    """Of ``key, n`` the keys with at least ``heavy_share`` of the sum of n: fewer than 1 / heavy_share rows by arithmetic."""
    total = counts.agg(F.sum("n")).first()[0] or 0  # one number
    return counts.where(F.col("n") >= total * heavy_share).select("key")


def missing_keys(refs: DataFrame, targets: DataFrame, heavy_share: float = 0.01) -> DataFrame:
    """``key, period, n`` of the references whose key no row of ``targets`` (column ``key``) has.

    ``refs`` has ``key`` and ``period``; NULL keys refer to nothing and are left out. ``targets`` may repeat keys and hold NULLs.
    With no targets every reference is an orphan; with no references the result is empty.
    """
    agg = refs.where("key IS NOT NULL").groupBy("key", "period").agg(F.count("*").alias("n"))
    agg = materialize(agg, "refs")
    heavy = materialize(split_heavy(agg.groupBy("key").agg(F.sum("n").alias("n")), heavy_share), "heavy")
    there = targets.select("key").where("key IS NOT NULL")
    found = there.join(F.broadcast(heavy), "key", "left_semi").distinct()  # as many rows as heavy keys, at most
    big = agg.join(F.broadcast(heavy), "key", "left_semi").join(F.broadcast(found), "key", "left_anti")
    small = agg.join(F.broadcast(heavy), "key", "left_anti").join(there.distinct(), "key", "left_anti")
    return big.unionByName(small)


def orphan_rows(refs: DataFrame, targets: DataFrame, heavy_share: float = 0.01) -> DataFrame:
    """The rows of ``refs`` (all their columns) whose ``key`` no target has, by way of :func:`missing_keys`."""
    keys = materialize(missing_keys(refs, targets, heavy_share), "orphans")
    heavy = split_heavy(keys.groupBy("key").agg(F.sum("n").alias("n")), heavy_share)
    only = keys.select("key").distinct()
    big = refs.join(F.broadcast(only.join(F.broadcast(heavy), "key", "left_semi")), "key", "left_semi")
    light = only.join(F.broadcast(heavy), "key", "left_anti")
    return big.unionByName(refs.join(light, "key", "left_semi"))
