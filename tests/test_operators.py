"""Orphans, shredding, incremental runs, and comparable paths."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from tabulith.functions.paths import month_of_millis, same_file
from tabulith.operators import incremental as inc
from tabulith.operators import orphans, shredding
from tabulith.queries import LIST_SHAPE, _flag


def test_same_file(spark):
    pairs = [("s3a://b/x//y/./z", "s3:/b/x/y/z"), ("s3n://b/x", "s3:/b/x"), ("file:/a/b", "file:/a/b"), ("file:///a/./././b", "file:/a/b"), ("s3://B/x", "s3:/B/x"), ("/a//b/.", "/a/b"), ("s3://b/.hidden/..x", "s3:/b/.hidden/..x"), ("", ""), (None, None), ("gs://b/.//.//c", "gs:/b/c")]
    got = spark.createDataFrame(pairs, "a string, b string").select(same_file(F.col("a")).alias("c"), "b").collect()
    assert [r.c for r in got] == [r.b for r in got]


def test_month(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = spark.createDataFrame([(0,), (1704067199999,), (1704067200000,), (-1,), (None,)], "m long").select(month_of_millis(F.col("m")).alias("x")).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert [r.x for r in got] == ["1970-01", "2023-12", "2024-01", "1969-12", None]


@pytest.mark.parametrize("share", [0.01, 0.2, 2.0])
def test_orphans(spark, share):
    r = random.Random(3)
    refs = [(r.choice(["hot", "hot", "cold", *map(str, range(60))]), r.choice(["p", "q"]), i) for i in range(600)] + [(None, "p", 0), ("none", None, 1), ("none", None, 1)]
    targets = [(str(i),) for i in range(0, 60, 2)] * 2 + [("hot",), (None,), ("other",)]
    a = spark.createDataFrame(refs, "key string, period string, n int")
    b = spark.createDataFrame(targets, "key string")
    there = {k for (k,) in targets}
    want = [x for x in refs if x[0] is not None and x[0] not in there]
    assert sorted(map(str, map(tuple, orphans.orphan_rows(a, b, share).select("key", "period", "n").collect()))) == sorted(map(str, want))
    counts = {(x.key, x.period): x.n for x in orphans.missing_keys(a.drop("n"), b, share).collect()}
    assert sum(counts.values()) == len(want)
    assert orphans.missing_keys(a, b.limit(0)).agg(F.sum("n")).first()[0] == 602
    assert orphans.orphan_rows(a.limit(0), b).count() == 0


def walk(record, shape, path=()):
    """Summaries by plain recursion."""
    out = []
    ms = shredding.unwrap(record.get("manifests")) if isinstance(record, dict) else None
    for i, m in enumerate([] if ms is None else ms if isinstance(ms, list) else [ms]):
        m = shredding.unwrap(m)
        ps = shredding.unwrap(m.get("partitions")) if isinstance(m, dict) else None
        for j, p in enumerate([] if ps is None else ps if isinstance(ps, list) else [ps]):
            p = shredding.unwrap(p)
            if isinstance(p, dict):
                out.append((i, j, _flag(shredding.unwrap(p.get("contains_nan"))), int(shredding.unwrap(p.get("lower_bound")) is not None)))
    return out


def wild(r, depth=0):
    """Random records with every kind of dirt."""
    wrap = lambda k, v: {k: v} if r.random() < 0.2 else v

    def summary():
        x = {}
        if r.random() < 0.7:
            x["contains_nan"] = wrap("boolean", r.choice([True, False, None]))
        if r.random() < 0.7:
            x["lower_bound"] = wrap("bytes", r.choice(["", "ff", None]))
        return r.choice([x, x, x, None, 3, "s", {**x, "extra": [1]}])

    def many(f):
        n = r.randint(0, 4)
        x = [f() for _ in range(n)]
        return r.choice([wrap("array", x), x, f(), None])

    def manifest():
        x = {"manifest_path": "p"} if r.random() < 0.5 else {}
        if r.random() < 0.9:
            x["partitions"] = many(summary)
        return r.choice([x, x, x, x, None])

    return {"manifests": many(manifest)} if r.random() < 0.95 else r.choice([[], None, 5, {}])


def test_shredding(spark):
    r = random.Random(11)
    records = [wild(r) for _ in range(500)]
    rows = []
    for i, x in enumerate(records):
        text = json.dumps(x)
        for _ in range(r.choice([0, 0, 1, 2])):
            text = json.dumps(text)
        rows.append((i, text))
    rows += rows[:50] + [(-1, "{"), (-2, None), (-3, "")]
    df = spark.createDataFrame(rows, "record_id long, record_json string").repartition(3)
    cols = {"nan": ("contains_nan", _flag, "int"), "low": ("lower_bound", lambda v: int(v is not None), "int")}
    got = shredding.shred_json(df, "record_json", ["record_id"], LIST_SHAPE, ("manifests", "partitions"), cols)
    want = {(i, *x) for i, rec in enumerate(records) for x in walk(rec, LIST_SHAPE)}
    assert sorted(map(tuple, got.collect())) == sorted(want)
    lists = shredding.shred_json(df, "record_json", ["record_id"], LIST_SHAPE, (), {"v": ("format-version", lambda v: v, "int")})
    assert lists.count() == 503
    assert shredding.shred_json(df.limit(0), "record_json", ["record_id"], LIST_SHAPE, ("manifests",), {}).count() == 0


def test_levels():
    s = shredding.Shredder({"a": [{"b": [None], "c": None}]})
    for x in ({"a": [{"b": [1, 2], "c": 9}, {"b": []}, None]}, {}, {"a": []}):
        s.add(x)
    b = s.columns[0]
    assert (b.values, b.rep, b.deep) == ([1, 2, None, None, None, None], [0, 2, 1, 1, 0, 0], [6, 6, 4, 2, 0, 1])
    t = shredding.assemble(s.columns, ("a", "b"))
    assert t[["record", "pos_1", "pos_2", ""]].values.tolist() == [[0, 0, 0, 1], [0, 0, 1, 2]]


def test_typed_columns(spark):
    df = spark.sql("SELECT 1 AS k, array(named_struct('x', 1), NULL, named_struct('x', NULL)) AS p UNION ALL SELECT 2, NULL UNION ALL SELECT 3, array()")
    assert sorted(map(str, shredding.shred_columns(df, ["k"], "p").collect())) == ["Row(k=1, pos=0, x=1)", "Row(k=1, pos=2, x=None)"]


@pytest.mark.parametrize("seed", range(3))
def test_covered(spark, seed):
    r = random.Random(seed)
    points = [(r.choice("ab"), r.choice([None, *range(40)]), r.randint(0, 9)) for _ in range(300)]
    runs = [(r.choice("ab"), a, a + r.randint(-2, 12), r.choice([None, *range(10)])) for a in (r.randint(-1, 40) for _ in range(25))]
    runs += runs[:5]
    p = spark.createDataFrame(points, "g string, at long, since int")
    q = spark.createDataFrame(runs, "g string, a long, b long, s int")
    got = sorted(map(str, map(tuple, inc.covered(p, q, "g", "at", "since", "a", "b", "s").select("g", "at", "since", "done").collect())))
    want = sorted(str((g, x, t, x is not None and any(h == g and a < x <= b and s is not None and s >= t for h, a, b, s in runs))) for g, x, t in points)
    assert got == want
    assert inc.covered(p, q.limit(0), "g", "at", "since", "a", "b", "s").where("done").count() == 0


def test_merkle(spark):
    old = spark.createDataFrame([(i, f"v{i % 5}", {"m": str(i % 3)}) for i in range(2000)] + [(None, "x", None)], "k long, v string, m map<string,string>")
    new = old.where("k <> 7 OR k IS NULL").withColumn("v", F.when(F.col("k") == 11, "other").otherwise(F.col("v"))).unionByName(spark.createDataFrame([(5000, "new", None)], old.schema))
    a, b = (inc.leaves(x, ["k"], ["v", "m"]) for x in (new, old))
    ta, tb = inc.tree(a), inc.tree(b)
    assert {(r.k, r.change) for r in inc.changed_leaves(a, b, ta, tb, ["k"]).collect()} == {(11, "changed"), (5000, "added"), (7, "gone")}
    assert inc.changed_ranges(ta, ta).count() == 0 and inc.changed_ranges(ta, tb).count() == 3
    assert inc.changed_leaves(a, b.limit(0), ta, tb.limit(0), ["k"]).where("change = 'added'").count() == 2001


def test_runs_tell_maps_apart(spark, tmp_path):
    runs = inc.IncrementalRuns(spark, f"file://{tmp_path}/state", ["k"], ["m"])
    df = spark.createDataFrame([(1, {"a": "1"}), (1, {"a": "2"}), (1, {"a": "2"})], "k long, m map<string,string>")
    runs.run(df, lambda t: t)
    assert runs.output().count() == 2


def test_runs_survive_failures(spark, tmp_path):
    runs = inc.IncrementalRuns(spark, f"file://{tmp_path}/state", ["k"], ["v"])
    one = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "k long, v string")
    two = spark.createDataFrame([(1, "a"), (2, "B"), (3, "c"), (None, "n")], "k long, v string")
    keep = lambda t: t
    for step in ("output", "leaves", "tree", "commit"):
        with pytest.raises(RuntimeError):
            runs.run(one, keep, fail_at=step)
        assert runs.last() == 0 and runs.output() is None
    assert runs.run(one, keep) == 1
    assert sorted(map(tuple, runs.output().collect())) == [(1, "a"), (2, "b")]
    for step in ("leaves", "commit"):
        with pytest.raises(RuntimeError):
            runs.run(two, keep, fail_at=step)
    assert runs.run(two, keep) == 2
    assert sorted(map(str, map(tuple, runs.output().collect()))) == sorted(map(str, [(1, "a"), (2, "b"), (2, "B"), (3, "c"), (None, "n")]))
    assert runs.run(two, keep) == 3 and runs.output().count() == 5
    with pytest.raises(Exception, match="exist"):  # another run has published this number
        runs.last = lambda: 2
        runs.run(two, keep)


def test_replay_of_all_content(spark, tmp_path):
    """A correction of any column but recorded_at is processed again, a row that merely comes again is not."""
    from tabulith import queries

    at = ["2023-06-01", "2024-03-01", "2024-09-01"]
    base = {"t": "'a'", "p": "1L", "s": "5L", "ms": "7L", "l": "'x'", "c": "0", "m": "map('operation', 'append')", "e": "CAST(NULL AS timestamp_ntz)"}
    changes = [{}, {"p": "2L"}, {"s": "6L"}, {"ms": "8L"}, {"l": "'y'"}, {"c": "1"}, {"m": "map('operation', 'delete')"}, {"e": "timestamp_ntz'2024-02-01'"}]
    rows = []
    for k, change in enumerate(changes):
        for r in (base, base | change, base | change):
            rows.append(f"({r['t']}, {k}L, {r['p']}, {r['s']}, {r['ms']}, {r['l']}, {r['c']}, {r['m']}, {r['e']}, timestamp_ntz'{at[len(rows) % 3]}')")
    names = "table_uuid, snapshot_id, parent_snapshot_id, sequence_number, timestamp_ms, manifest_list, schema_id, summary, expired_at, recorded_at"
    spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS v({names})").write.parquet(f"{tmp_path}/snapshots.parquet")
    n = {r.snapshot_id: r["count"] for r in queries.p6_replay_content(spark, str(tmp_path)).groupBy("snapshot_id").count().collect()}
    assert n == {k: 1 if k == 0 else 2 for k in range(len(changes))}
