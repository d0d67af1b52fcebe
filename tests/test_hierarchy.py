from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tabulith.operators import hierarchy as h


def brute(parent: dict) -> dict:
    """(root, depth, on circle, descendants) by walking."""
    out = {}
    kids: dict = {}
    for v, p in parent.items():
        kids.setdefault(p, []).append(v)
    for v in parent:
        seen, u = [], v
        while u is not None and u not in seen:
            seen.append(u)
            u = parent[u]
        circle = u == v
        below, stack = 0, [v]
        if not circle:
            while stack:
                x = stack.pop()
                below += 1
                stack += kids.get(x, [])
        out[v] = (None if u is not None else seen[-1], None if u is not None else len(seen) - 1, circle, None if circle else below - 1)
    return out


def forest(n: int, seed: int, chain: float, loops: float) -> dict:
    r = random.Random(seed)
    names = r.sample(range(10**9), n)
    parent = {}
    for i, v in enumerate(names):
        if i == 0 or r.random() < 0.02:
            parent[v] = None
        elif r.random() < chain:
            parent[v] = names[i - 1]
        else:
            parent[v] = names[r.randrange(i)]
    for v in names:
        if r.random() < loops:
            parent[v] = r.choice(names)
    return parent


@pytest.mark.parametrize("seed", range(200))
def test_chunk(seed):
    parent = forest(seed % 40 + 1, seed, 0.5, 0.1)
    kids = {v: sum(1 for p in parent.values() if p == v) for v in parent}
    rows = h.contract_chunk(list(parent), list(parent.values()), [1] * len(parent), [0] * len(parent), [1] * len(parent), [kids[v] for v in parent])
    want = brute(parent)
    got = {r[0]: (None if r[8] else r[2], None if r[8] else r[3], r[7], None if r[7] else r[6] - 1) for r in rows}
    assert all(r[1] == h.DONE for r in rows)
    assert got == want


def table(spark, parent: dict, order: list | None = None):
    place = {v: i for i, v in enumerate(order or parent)}
    return spark.createDataFrame([(v, p, place[v]) for v, p in parent.items()], "id bigint, parent bigint, at int")


def check(spark, parent: dict, **options):
    got = {r.id: (r.root, r.depth, r.on_circle, r.n_descendants) for r in h.hierarchy(table(spark, parent), "id", "parent", **options).collect()}
    assert got == brute(parent)


@pytest.mark.parametrize(("n", "chain", "loops", "chunk", "locality"), [(400, 0.9, 0.0, 50, ["at"]), (400, 0.97, 0.01, 40, ["at"]), (300, 0.95, 0.01, 60, []), (120, 0.0, 0.3, 30, []), (300, 1.0, 0.0, 100, [])])
def test_many_chunks(spark, n, chain, loops, chunk, locality):
    check(spark, forest(n, n + chunk, chain, loops), chunk_rows=chunk, locality=locality)


def test_star_and_one_circle(spark):
    check(spark, {0: None} | {i: 0 for i in range(1, 200)}, chunk_rows=30)
    check(spark, {i: (i + 1) % 150 for i in range(150)}, chunk_rows=20, locality=["at"])


def test_dirt(spark):
    rows = [(1, None, "a", 1), (2, 1, "a", 1), (2, 1, "a", 1), (3, 2, "b", 1), (4, 99, "a", 1), (None, 1, "a", 1), (5, 5, None, 1), (6, 4, "a", 1), (6, 2, "a", 2), (7, 8, None, 1), (8, None, None, 1)]
    df = spark.createDataFrame(rows, "v long, p long, g string, at int").selectExpr("v", "p", "g", "at", "1 AS root", "'x' AS depth", "2 AS up", "3 AS id")
    got = {r.v: (r.root, r.depth, r.on_circle) for r in h.hierarchy(df, "v", "p", scope="g", latest=["at"]).collect()}
    assert got == {1: (1, 0, False), 2: (1, 1, False), 3: (3, 0, False), 4: (4, 0, False), 5: (None, None, True), 6: (1, 2, False), 7: (8, 1, False), 8: (8, 0, False)}


def test_empty(spark):
    assert h.hierarchy(spark.createDataFrame([], "v long, p long"), "v", "p").count() == 0


def test_text_keys(spark):
    df = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b")], "v string, p string")
    assert {r.v: r.depth for r in h.hierarchy(df, "v", "p").collect()} == {"a": 0, "b": 1, "c": 2}


def test_paths_and_descendants(spark):
    parent = forest(150, 5, 0.95, 0.01)
    tree = h.hierarchy(table(spark, parent), "id", "parent")
    paths = h.with_paths(tree, "id", "parent", block=8)
    assert all(len(r.path_tail) <= 8 for r in paths.where("path_tail IS NOT NULL").collect())
    got = {r.id: list(r.path) for r in h.expand_paths(paths, tree, "id").collect()}
    want = brute(parent)

    def path(v):
        out = [v]
        while parent[out[-1]] is not None:
            out.append(parent[out[-1]])
        return out[::-1]

    assert got == {v: path(v) for v, x in want.items() if x[0] is not None}
    some = tree.where("id % 3 = 0")
    pairs = {(r.ancestor, r.descendant) for r in h.expand_descendants(tree, some, "id", "parent").collect()}
    assert pairs == {(a, v) for v in got for a in got[v][:-1] if a % 3 == 0} | {(a, v) for v in pairs_below_circle(parent, want) for a in pairs_below_circle(parent, want)[v] if a % 3 == 0}


def pairs_below_circle(parent: dict, want: dict) -> dict:
    """Ancestors off the circle of nodes below one."""
    out = {}
    for v, x in want.items():
        if x[0] is None and not x[2]:
            line, u = [], parent[v]
            while not want[u][2]:
                line.append(u)
                u = parent[u]
            out[v] = line
    return out


@pytest.mark.parametrize(("n", "chain", "loops"), [(150, 0.95, 0.01), (150, 0.2, 0.03)])
def test_descendants_as_intervals(spark, n, chain, loops):
    from tabulith.session import materialize

    parent = forest(n, 5, chain, loops)
    tree = materialize(h.hierarchy(table(spark, parent), "id", "parent"), "tree")
    rows = h.with_intervals(tree, "id", "parent").collect()
    want = brute(parent)
    assert len(rows) == n and {r.id for r in rows if r.first is None} == {v for v, x in want.items() if x[2]}
    got = {(a.id, b.id) for a in rows for b in rows if a.top is not None and a.top == b.top and a.first < b.first <= a.last}
    above = set()
    for v in parent:
        u = parent[v]
        while u is not None and not want[u][2] and not want[v][2]:
            above.add((u, v))
            u = parent[u]
    assert got == above and len(got) > 100


def test_a_long_chain_expands_in_few_jobs(spark):
    """The number of jobs doesn't go with the depth."""
    from tabulith.session import intermediate_tables, materialize

    n = 20_000
    chain = spark.range(n).select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"))
    sc = spark.sparkContext
    with intermediate_tables():
        tree = materialize(h.hierarchy(chain, "id", "parent", locality=["id"]), "tree")
        some = spark.createDataFrame([(n - 1,), (5,), (777_777,), (None,)], "id long")
        sc.setJobGroup("chain", "chain")
        paths = materialize(h.with_paths(tree, "id", "parent"), "paths")
        got = {r.id: r.path for r in h.expand_paths(paths, some, "id").collect()}
        assert got == {5: list(range(6)), n - 1: list(range(n))}
        below = h.expand_descendants(tree, some, "id", "parent")
        assert sorted(r.distance for r in below.where("ancestor = 5").select("distance").collect()) == list(range(1, n - 5)) and below.count() == n - 6
        assert len(sc.statusTracker().getJobIdsForGroup("chain")) < 300
        sc.setJobGroup("", "")
