"""Processing only new or changed records: Merkle trees over ranges of key hashes.

Each record has a leaf: the hash of its key and a digest of its content. The range of 64-bit key hashes is divided again and again
by ``FANOUT``; an inner node's digest is an order-free combination of the digests below it, so it is built by partial aggregation. The trees of
what is there and of what was done are compared from the root; only below nodes that differ are the next ones compared, and
only the leaves of ranges that still differ are read. A run publishes its output and its tree together, by creating one small
file; what was not published never happened.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulith.operators.common import digest, dyadic_blocks
from tabulith.session import broadcast_if_small, hadoop_fs, materialize, put_new

FANOUT_BITS = 4
RANGE_ROWS = 16  # leaves of a finest range, about: the depth follows from their number
LEVELS = 7  # of the finest ranges of all, 16^7


def leaves(df: DataFrame, keys: Sequence[str], content: Sequence[str]) -> DataFrame:
    """``keys, h1, h2, kh`` of each record; equal keys with several contents give a leaf each."""
    return df.select(*keys, digest(df, content).alias("d"), digest(df, keys)["h1"].alias("kh")).select(*keys, "d.h1", "d.h2", "kh").distinct()


def depth_for(n: int) -> int:
    """Levels below the root for ``n`` leaves."""
    return min(LEVELS, max(1, math.ceil(math.log(max(n, 1) / RANGE_ROWS, 1 << FANOUT_BITS)))) if n > RANGE_ROWS else 1


def tree(leaf: DataFrame) -> DataFrame:
    """``level, node, s1, s2, n`` of all inner nodes of a written table of leaves; level 0 is the root. A digest is the exclusive or of well mixed 64-bit
    hashes, twice over, with the count. A node is the first bits of its key hashes, so trees of different depth have the same nodes where both have any."""
    levels = depth_for(leaf.count())
    mixed = leaf.select("kh", F.xxhash64("kh", "h1", "h2").alias("a"), F.xxhash64("h2", "kh", "h1").alias("b"))
    fine = materialize(mixed.groupBy(_node(levels).alias("node")).agg(*_sums()), "ranges")
    out = fine.select(F.lit(levels).alias("level"), "node", "s1", "s2", "n")
    for lv in range(levels - 1, -1, -1):
        up = fine.groupBy(F.shiftright("node", FANOUT_BITS * (levels - lv)).alias("node")).agg(*[F.expr(f"bit_xor({c})").alias(c) for c in ("s1", "s2")], F.sum("n").alias("n"))
        out = out.unionByName(up.select(F.lit(lv).alias("level"), "node", "s1", "s2", "n"))
    return out


def _node(level: int):
    return F.shiftrightunsigned("kh", 64 - FANOUT_BITS * level) if level else F.lit(0).cast("long")


def _sums() -> list:
    return [F.expr("bit_xor(a)").alias("s1"), F.expr("bit_xor(b)").alias("s2"), F.count("*").alias("n")]


def common_level(now: DataFrame, saved: DataFrame) -> int:
    """The finest level that both trees have; 0, the root, if one of them is empty."""
    return min(t.agg(F.max("level")).first()[0] or 0 for t in (now, saved))


def changed_ranges(now: DataFrame, saved: DataFrame) -> DataFrame:
    """The ranges ``p`` of the finest level that both trees have whose digests differ, found by going down from the root; children of equal nodes are
    never compared."""
    diff = None
    for lv in range(common_level(now, saved) + 1):
        a = now.where(F.col("level") == lv).select("node", "s1", "s2", "n")
        b = saved.where(F.col("level") == lv).select(F.col("node").alias("node_b"), F.col("s1").alias("t1"), F.col("s2").alias("t2"), F.col("n").alias("m"))
        if diff is not None:
            a = a.join(diff, F.shiftright("node", FANOUT_BITS) == F.col("p"), "left_semi")
            b = b.join(diff, F.shiftright("node_b", FANOUT_BITS) == F.col("p"), "left_semi")
        both = a.join(b, F.col("node") == F.col("node_b"), "full")
        same = F.col("s1").eqNullSafe(F.col("t1")) & F.col("s2").eqNullSafe(F.col("t2")) & F.col("n").eqNullSafe(F.col("m"))
        # written, for the next level reads it twice; broadcast only if it is small
        diff = broadcast_if_small(materialize(both.where(~same).select(F.coalesce("node", "node_b").alias("p")), f"differ{lv}"))
    return diff


def changed_leaves(now: DataFrame, saved: DataFrame, now_tree: DataFrame, saved_tree: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Leaves of ``now`` that ``saved`` does not hold, with ``change`` 'added' or 'changed', and keys only ``saved`` holds as 'gone'."""
    ranges, at = changed_ranges(now_tree, saved_tree), _node(common_level(now_tree, saved_tree))
    a = now.join(ranges, at == F.col("p"), "left_semi")
    b = saved.join(ranges, at == F.col("p"), "left_semi")
    new = a.alias("a").join(b.alias("b"), [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*keys, "kh", "h1", "h2")], "left_anti")
    old_keys = b.select(*[F.col(k).alias(f"_o{i}") for i, k in enumerate(keys)]).distinct()
    tagged = new.join(old_keys.withColumn("_was", F.lit(True)), [F.col(k).eqNullSafe(F.col(f"_o{i}")) for i, k in enumerate(keys)], "left")
    out = tagged.select(*keys, "h1", "h2", "kh", F.when(F.col("_was"), "changed").otherwise("added").alias("change"))
    gone = b.alias("b").join(a.alias("a"), [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys], "left_anti").select(*keys, "h1", "h2", "kh", F.lit("gone").alias("change"))
    return out.unionByName(gone)


class IncrementalRuns:
    """Runs over a growing table whose state lives in ``folder``.

    A run writes its output, its tree and its leaves into a folder of its own, ``attempt-ID``, and last ``commit-N.json``, which names that folder. Creating
    that file is the only step that counts: it appears whole and fails if it is there already (see ``session.put_new``), so of two runs at a time one
    wins, and the loser, like a run that died, leaves nothing but a folder that no commit names. Published folders are never written again.

    Leaves are written whole only when those that changed since come to half of them; other runs write the leaves of changed keys alone.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: Sequence[str], content: Sequence[str]) -> None:
        self.spark, self.folder, self.keys, self.content = spark, folder.rstrip("/"), list(keys), list(content)

    def last(self) -> int:
        """Number of the last published run, 0 before the first."""
        fs, p = hadoop_fs(self.spark, self.folder)
        if not fs.exists(p):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return max([0, *(int(n[7:-5]) for n in names if n.startswith("commit-") and n.endswith(".json"))])

    def commits(self, until: int) -> list:
        """What the commits up to ``until`` say, in order: one small row each."""
        if not until:
            return []
        ddl = "run int, folder string, base int, n_leaves bigint, n_changed bigint"
        rows = self.spark.read.schema(ddl).json([f"{self.folder}/commit-{i}.json" for i in range(1, until + 1)]).collect()
        return sorted(rows, key=lambda r: r.run)

    def _saved(self, done: list, none: DataFrame) -> DataFrame:
        """The leaves that the published runs saw: of each key those of the last run that wrote it."""
        if not done:
            return none
        parts = None
        for c in done[done[-1].base - 1 :]:
            d = self.spark.read.schema(T.StructType([*none.schema.fields, T.StructField("gone", T.BooleanType())])).parquet(f"{self.folder}/{c.folder}/leaves").withColumn("_run", F.lit(c.run))
            parts = d if parts is None else parts.unionByName(d)
        if done[-1].base == done[-1].run:
            return parts.drop("gone", "_run")
        # a key's rows are few: its contents at one time
        newest = parts.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(self.keys)]).agg(F.max("_run").alias("_top"))
        live = parts.join(newest, [*[F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(self.keys)], F.col("_run") == F.col("_top")], "left_semi")
        return live.where("NOT gone").drop("gone", "_run")

    def _compared(self, df: DataFrame, done: list) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
        """(records to process, leaves now, tree now, leaves of changed keys)."""
        now = materialize(leaves(df, self.keys, self.content), "leaves")
        now_tree = materialize(tree(now), "tree")
        saved = self._saved(done, now.limit(0))
        saved_tree = self.spark.read.schema(now_tree.schema).parquet(f"{self.folder}/{done[-1].folder}/tree") if done else now_tree.limit(0)
        diff = materialize(changed_leaves(now, saved, now_tree, saved_tree, self.keys), "changed")
        want = diff.where("change <> 'gone'").select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(self.keys)], F.col("h1").alias("_h1"), F.col("h2").alias("_h2")).distinct()
        d = df.withColumn("_d", digest(df, self.content))
        todo = d.join(want, [*[F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(self.keys)], F.col("_d.h1") == F.col("_h1"), F.col("_d.h2") == F.col("_h2")], "left_semi")
        touched = diff.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(self.keys)]).distinct()
        same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(self.keys)]
        gone = diff.where("change = 'gone'").select(*now.columns, F.lit(True).alias("gone"))
        moved = now.join(touched, same, "left_semi").withColumn("gone", F.lit(False)).unionByName(gone)
        return todo.dropDuplicates([*self.keys, "_d"]).drop("_d"), now, now_tree, moved

    def pending(self, df: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(records to process, leaves now, tree now)."""
        return self._compared(df, self.commits(self.last()))[:3]

    def run(self, df: DataFrame, process: Callable[[DataFrame], DataFrame], fail_at: str | None = None) -> int:
        """Process what is new or changed, publish, and return the run's number. ``fail_at`` (tests): raise before that step. If another run published that
        number meanwhile, ``FileExistsError`` is raised and nothing has happened."""
        done = self.commits(self.last())
        n = len(done) + 1
        todo, now, now_tree, moved = self._compared(df, done)
        moved = materialize(moved, "moved")
        n_leaves, n_moved = now.count(), moved.count()
        since = n_moved + sum(c.n_changed for c in done[done[-1].base :]) if done else 0
        whole = not done or 2 * since > done[done[-1].base - 1].n_leaves
        attempt = f"attempt-{uuid.uuid4().hex}"
        state = now.withColumn("gone", F.lit(False)) if whole else moved
        for name, part in (("output", process(todo)), ("leaves", state.repartitionByRange("kh").sortWithinPartitions("kh")), ("tree", now_tree)):
            if fail_at == name:
                raise RuntimeError(f"failed before {name}")
            part.write.parquet(f"{self.folder}/{attempt}/{name}")
        if fail_at == "commit":
            raise RuntimeError("failed before commit")
        commit = {"run": n, "folder": attempt, "base": n if whole else done[-1].base, "n_leaves": n_leaves, "n_changed": n_moved}
        put_new(self.spark, f"{self.folder}/commit-{n}.json", json.dumps(commit).encode())
        return n

    def output(self) -> DataFrame | None:
        """Output of all published runs; None before the first."""
        done = self.commits(self.last())
        return self.spark.read.parquet(*[f"{self.folder}/{c.folder}/output" for c in done]) if done else None

    def clean(self, older_than_ms: int) -> list[str]:
        """Remove the folders of attempts that no commit names and that have not been touched since ``older_than_ms`` (epoch): runs still at work are younger."""
        fs, p = hadoop_fs(self.spark, self.folder)
        kept = {c.folder for c in self.commits(self.last())}
        gone = [s.getPath() for s in (fs.listStatus(p) if fs.exists(p) else []) if s.getPath().getName().startswith("attempt-") and s.getPath().getName() not in kept and s.getModificationTime() < older_than_ms]
        for x in gone:
            fs.delete(x, True)
        return sorted(x.getName() for x in gone)


def covered(points: DataFrame, runs: DataFrame, group: str, at: str, since: str, start: str, end: str, started: str) -> DataFrame:
    """``points`` with ``done``: whether a run of the group with start < at <= end began at or after ``since``.

    A run's range is cut into dyadic blocks (at most two per level) that keep the latest start of any run over them; a point looks up
    the one block of each level that it lies in. So neither many runs nor many points of one group meet each other in pairs.
    ``runs`` may repeat; empty ranges and NULLs cover nothing, and a point without a position isn't covered.
    """
    whole = runs.select(F.col(group).alias("_g"), F.col(start).alias("_a"), F.col(end).alias("_b"), F.col(started).alias("_s")).where("_a < _b AND _s IS NOT NULL AND _b >= 0")
    whole = whole.withColumn("_a", F.greatest("_a", F.lit(-1)))
    blocks = whole.select("_g", "_s", F.explode(dyadic_blocks("_a + 1", "_b")).alias("b")).groupBy("_g", F.col("b.l").alias("_l"), F.col("b.i").alias("_i")).agg(F.max("_s").alias("_s"))
    blocks = materialize(blocks, "blocks")
    used = [r._l for r in blocks.select("_l").distinct().collect()]  # 63 numbers at most
    p = points.withColumn("_pid", F.struct(group, at, since))
    want = p.where(F.col(at) >= 0).select(group, at, since).distinct().withColumn("_l", F.explode(F.array(*[F.lit(x) for x in sorted(used)]) if used else F.expr("cast(array() as array<int>)")))
    want = want.withColumn("_i", F.expr(f"shiftright(`{at}`, _l)"))
    hit = want.join(blocks, (F.col(group) == F.col("_g")) & (want._l == blocks._l) & (want._i == blocks._i) & (F.col("_s") >= F.col(since))).select(F.col(group).alias("_hg"), F.col(at).alias("_ha"), F.col(since).alias("_hs")).distinct().withColumn("_hit", F.lit(True))
    out = p.drop("_pid").join(hit, (F.col(group) == F.col("_hg")) & (F.col(at) == F.col("_ha")) & (F.col(since) == F.col("_hs")), "left")
    return out.withColumn("done", F.coalesce("_hit", F.lit(False))).drop("_hg", "_ha", "_hs", "_hit")
