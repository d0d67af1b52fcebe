"""Parent-child links to full hierarchies by tree contraction.

Rounds of contraction alternate leaf raking and compression of unary chains until nothing is left; every removed node leaves a
record of what it hung from. Read in reverse, the records give root and depth (upwards) and subtree sizes (downwards). A core
that no rake or compression can end is a circle: it shrinks to a node that is its own parent.

A round works on chunks of bounded size (neighbours in ``locality`` order, found by range partitioning) and contracts all that
lies within a chunk; only nodes with links across chunks survive it. Where the order says nothing about the links and a round
removes little, rounds of joins follow instead, which compress local maxima of a random priority along the chains. Once the
survivors fit one chunk, that chunk ends it. No task ever holds more than a chunk, whatever the shape of the forest.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulith.operators.common import comparable, dyadic_blocks
from tabulith.session import materialize

LIVE, RAKED, COMPRESSED, DONE, CREDIT = range(5)


def contract_chunk(ids: list, parents: list, dist: list, extra: list, size: list, kids: list) -> list[tuple]:
    """Contract one chunk; rows (id, kind, up, dist, down, extra, size, circle, bad).

    ``dist`` is the distance to the parent, ``extra`` the nodes contracted into the edge to it, ``size`` the nodes contracted into
    the node itself, ``kids`` the number of living children anywhere. LIVE rows carry the node on. RAKED and COMPRESSED rows hang
    ``dist`` below ``up``; a COMPRESSED one has ``extra`` nodes more than ``down``. DONE rows name their root in ``up``. CREDIT rows
    add ``size`` to a node of another chunk.
    """
    n = len(ids)
    at = {v: i for i, v in enumerate(ids)}
    none, outside = -1, -2
    par = [none if p is None else at.get(p, outside) for p in parents]
    far = list(parents)
    left, near, mark = list(kids), [0] * n, [0] * n
    circle = [False] * n
    for i, p in enumerate(par):
        if p == i:  # its own parent: a circle of one
            par[i], circle[i] = none, True
            left[i] -= 1
        elif p >= 0:
            near[p] += 1
            mark[p] ^= i
    kind = [LIVE] * n
    up = [none] * n
    down = [none] * n
    order: list[int] = []
    credits: list[tuple] = []
    stack = [i for i in range(n) if left[i] == 0]
    todo = range(n)
    while True:
        while stack:
            i = stack.pop()
            p = par[i]
            order.append(i)
            if p == none:
                kind[i] = DONE
                continue
            kind[i], up[i] = RAKED, p
            if p == outside:
                credits.append((far[i], CREDIT, None, 0, None, 0, size[i] + extra[i], False, False))
                continue
            size[p] += size[i] + extra[i]
            left[p] -= 1
            near[p] -= 1
            mark[p] ^= i
            if left[p] == 0:
                stack.append(p)
        for i in todo:
            if kind[i] != LIVE or left[i] != 1 or near[i] != 1 or par[i] == none:
                continue
            c, p = mark[i], par[i]
            kind[i], up[i], down[i] = COMPRESSED, p, c
            order.append(i)
            base = extra[c] + size[i]
            extra[c] = base + extra[i]
            extra[i] = base  # from here on what lies between it and below, itself included
            dist_i = dist[i]
            dist[c] += dist_i
            if p == c:  # the circle is closed
                par[c], circle[c] = none, True
                left[c] -= 1
                near[c] -= 1
                mark[c] ^= i
                if left[c] == 0:
                    stack.append(c)
            else:
                par[c], far[c] = p, far[i]
                if p >= 0:
                    mark[p] ^= i ^ c
        if not stack:
            break
    # expansion within the chunk, in reverse order of removal
    root: list = [None] * n
    bad = [False] * n
    total: list = [None] * n
    out = []
    for i in reversed(order):
        p = up[i]
        if kind[i] == DONE:
            root[i], dist[i], bad[i], total[i] = ids[i], 0, circle[i], size[i]
            out.append((ids[i], DONE, ids[i], 0, None, 0, None if circle[i] else size[i], circle[i], circle[i]))
            continue
        done = False
        if p == outside:
            root[i] = far[i]
        elif kind[p] == LIVE:
            root[i] = ids[p]
        else:
            root[i], bad[i] = root[p], bad[p]
            dist[i] += dist[p]
            done = kind[p] == DONE
        c = down[i]
        below = None
        if c == none:
            total[i] = size[i]
        elif kind[c] == LIVE:
            below = ids[c]
        else:
            circle[i] = circle[c]
            if total[c] is not None:
                total[i] = extra[i] + total[c]
            else:
                below = far[c]
                extra[i] += extra[c]
        far[i] = below
        if done and below is None:
            kind[i] = DONE
            out.append((ids[i], DONE, root[i], dist[i], None, 0, None if circle[i] else total[i], circle[i], bad[i]))
        elif below is None:
            out.append((ids[i], RAKED, root[i], dist[i], None, 0, None if circle[i] else total[i], circle[i], bad[i]))
        else:
            out.append((ids[i], COMPRESSED, root[i], dist[i], below, extra[i], None, False, bad[i]))
    for i in range(n):
        if kind[i] == LIVE:
            out.append((ids[i], LIVE, ids[i] if circle[i] else None if par[i] == none else far[i] if par[i] == outside else ids[par[i]], dist[i], None, extra[i], size[i], circle[i], False))
    return out + credits


def _record(key: T.DataType) -> T.StructType:
    f = T.StructField
    return T.StructType([f("id", key), f("kind", T.IntegerType()), f("up", key), f("dist", T.LongType()), f("down", key), f("extra", T.LongType()), f("size", T.LongType()), f("circle", T.BooleanType()), f("bad", T.BooleanType())])


def _arrow_contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = list(batches)
    if not held:
        return
    t = pa.Table.from_batches(held)
    if not t.num_rows:
        return
    names = ("id", "up", "dist", "extra", "size", "kids")
    rows = contract_chunk(*[t.column(c).to_pylist() for c in names])
    kind = t.schema.field("id").type
    types = (kind, pa.int32(), kind, pa.int64(), kind, pa.int64(), pa.int64(), pa.bool_(), pa.bool_())
    cols = [pa.array(c, k) for c, k in zip(zip(*rows), types, strict=True)]
    yield from pa.table(cols, names=["id", "kind", "up", "dist", "down", "extra", "size", "circle", "bad"]).to_batches(max_chunksize=20_000)


def _with_kids(live: DataFrame) -> DataFrame:
    kids = live.where("up IS NOT NULL").groupBy(F.col("up").alias("_k")).agg(F.count("*").alias("kids"), F.max("id").alias("child"))
    return live.join(kids, live.id == kids._k, "left").drop("_k").withColumn("kids", F.coalesce("kids", F.lit(0)))


def _join_round(nodes: DataFrame, salt: int) -> DataFrame:
    """One rake and one compression as joins, for links that no order of the rows reflects. ``nodes`` has kids and child."""
    own = F.col("up") == F.col("id")
    nodes = nodes.withColumn("leaf", F.col("kids") - F.coalesce(own.cast("int"), F.lit(0)) == 0)
    unary = (F.col("kids") == 1) & F.col("up").isNotNull() & ~own
    nodes = nodes.withColumn("rank", F.when(unary, F.xxhash64("id", F.lit(salt))))
    p = nodes.select(F.col("id").alias("pid"), F.col("rank").alias("prank"))
    c = nodes.select(F.col("id").alias("cid"), F.col("rank").alias("crank"), F.col("leaf").alias("cleaf"))
    j = nodes.join(p, F.col("up") == F.col("pid"), "left").join(c, F.when(unary, F.col("child")) == F.col("cid"), "left")
    # equal hashes, should they come up, are ordered by id
    above = F.col("prank").isNull() | (F.struct("rank", "id") > F.struct("prank", F.col("pid")))
    below = F.col("crank").isNull() | (F.struct("rank", "id") > F.struct("crank", F.col("cid")))
    pick = F.col("rank").isNotNull() & ~F.coalesce("cleaf", F.lit(True)) & above & below
    return j.withColumn("pick", pick)


def _join_records(j: DataFrame) -> DataFrame:
    null = F.lit(None).cast(j.schema["id"].dataType)
    no, zero = F.lit(False), F.lit(0).cast("long")
    gone = j.where("leaf")
    self_loop = F.coalesce(F.col("up") == F.col("id"), F.lit(False))
    has_up = F.col("up").isNotNull() & ~self_loop

    def rec(d: DataFrame, *c) -> DataFrame:
        names = ("id", "kind", "up", "dist", "down", "extra", "size", "circle", "bad")
        return d.select(*[(x if not isinstance(x, int) else F.lit(x)).alias(n) for n, x in zip(names, c, strict=True)])

    raked = rec(gone.where(has_up), F.col("id"), RAKED, F.col("up"), F.col("dist"), null, zero, F.col("size"), no, no)
    credit = rec(gone.where(has_up), F.col("up"), CREDIT, null, zero, null, zero, F.col("size") + F.col("extra"), no, no)
    roots = rec(gone.where(~has_up), F.col("id"), DONE, F.col("id"), zero, null, zero, F.when(~self_loop, F.col("size")), self_loop, self_loop)
    cut = j.where("pick")
    spliced = rec(cut.alias("i").join(j.select(F.col("id").alias("_c"), F.col("extra").alias("_e")), F.col("child") == F.col("_c")), F.col("id"), COMPRESSED, F.col("up"), F.col("dist"), F.col("child"), F.col("_e") + F.col("size"), F.lit(None).cast("long"), no, no)
    moved = cut.select(F.col("child").alias("_m"), F.col("up").alias("_up"), F.col("dist").alias("_d"), (F.col("size") + F.col("extra")).alias("_s"))
    stay = j.where(~F.col("leaf") & ~F.col("pick")).join(moved, F.col("id") == F.col("_m"), "left")
    live = rec(stay, F.col("id"), LIVE, F.coalesce("_up", "up"), F.col("dist") + F.coalesce("_d", F.lit(0)), null, F.col("extra") + F.coalesce("_s", F.lit(0)), F.col("size"), no, no)
    return raked.unionByName(credit).unionByName(roots).unionByName(spliced).unionByName(live)


def hierarchy(
    df: DataFrame,
    id: str,  # noqa: A002
    parent: str,
    scope: str | None = None,
    locality: Sequence[str] = (),
    latest: Sequence[str] = (),
    chunk_rows: int = 100_000,
) -> DataFrame:
    """Root, depth, circle and number of descendants of each node.

    Returns ``id, scope?, parent, root, depth, on_circle, below_circle, n_children, n_descendants``; one row per id.

    * A NULL id is no node. Of several rows of an id, the one with the greatest ``latest`` columns counts (then the greatest of
      all used columns), so repeated rows and ties do no harm.
    * A parent that is NULL, that has no row, or that has another ``scope`` (NULL is a scope of its own) is none: the node is a root.
    * On a circle, and below one, ``root`` and ``depth`` are NULL; on a circle ``n_descendants`` is NULL too.
    * Further columns of ``df`` are ignored, whatever their names. An empty table gives an empty result.

    ``locality`` names columns in whose order parents and children tend to be near each other; it changes speed, not the result.
    """
    spark = df.sparkSession
    key = df.schema[id].dataType
    sc = comparable(df, scope) if scope else F.lit(None).cast("string")
    loc = [comparable(df, c) for c in locality]
    used = F.struct(F.col(parent).cast(key).alias("up"), sc.alias("scope"), F.struct(*(loc or [F.col(id)])).alias("loc"))
    rows = df.where(F.col(id).isNotNull()).groupBy(F.col(id).alias("id")).agg(F.max_by(used, F.struct(*[comparable(df, c).alias(f"o{i}") for i, c in enumerate(latest)], used)).alias("b"))
    rows = rows.select("id", "b.up", "b.scope", "b.loc")
    known = rows.select(F.col("id").alias("_p"), F.col("scope").alias("_s"))
    nodes = rows.join(known, (F.col("up") == F.col("_p")) & F.col("scope").eqNullSafe(F.col("_s")), "left").select("id", "scope", "loc", F.col("_p").alias("up"))
    nodes = materialize(nodes, "nodes")
    live = nodes.select("id", "loc", "up", F.lit(1).cast("long").alias("dist"), F.lit(0).cast("long").alias("extra"), F.lit(1).cast("long").alias("size"))
    count = live.count()
    levels: list[DataFrame] = []
    local = True
    while count:
        with_kids = _with_kids(live)
        one = count <= chunk_rows
        if local or one:
            shape = with_kids.select("id", "up", "dist", "extra", "size", "kids", "loc")
            shape = shape.coalesce(1) if one else shape.repartitionByRange(-(-count // chunk_rows), "loc", "id")
            rec = shape.drop("loc").mapInArrow(_arrow_contract, _record(key))
        else:
            j = materialize(_join_round(with_kids.drop("loc"), len(levels)), "round")
            rec = _join_records(j)
        rec = materialize(rec, f"level{len(levels)}")
        levels.append(rec)
        credit = rec.where(F.col("kind") == CREDIT).groupBy(F.col("id").alias("_c")).agg(F.sum("size").alias("_more"))
        kept = rec.where(F.col("kind") == LIVE).select("id", "up", "dist", "extra", "size")
        alive = kept.count()
        local = local and alive < 0.75 * count
        count = alive
        if count:
            live = kept.join(credit, F.col("id") == F.col("_c"), "left").withColumn("size", F.col("size") + F.coalesce("_more", F.lit(0))).drop("_c", "_more").join(nodes.select("id", "loc"), "id")
    names = ["id", "root", "depth", "circle", "bad", "total"]
    solved: DataFrame | None = None
    for rec in reversed(levels):
        done = rec.where(F.col("kind") == DONE).select("id", F.col("up").alias("root"), F.col("dist").alias("depth"), "circle", "bad", F.col("size").alias("total"))
        if solved is not None:
            wait = rec.where(F.col("kind").isin(RAKED, COMPRESSED))
            s, t = solved.alias("s"), solved.select(F.col("id").alias("t_id"), F.col("circle").alias("t_circle"), F.col("total").alias("t_total"))
            w = wait.alias("w").join(s, F.col("w.up") == F.col("s.id")).join(t, F.col("w.down") == F.col("t_id"), "left")
            # what hangs from a circle through a compressed edge lies on it exactly if the node below does
            circle = F.coalesce("t_circle", F.col("w.circle"))
            total = F.when(F.col("w.down").isNull(), F.col("w.size")).otherwise(F.col("w.extra") + F.col("t_total"))
            back = w.select(F.col("w.id").alias("id"), F.col("s.root").alias("root"), (F.col("w.dist") + F.col("s.depth")).alias("depth"), circle.alias("circle"), F.col("s.bad").alias("bad"), F.when(~circle, total).alias("total"))
            done = solved.unionByName(done).unionByName(back)
        solved = done.select(*names)
        if len(levels) > 4 and rec is not levels[0]:
            solved = materialize(solved, "solved")
    if solved is None:
        solved = spark.createDataFrame([], T.StructType([T.StructField("id", key), T.StructField("root", key), T.StructField("depth", T.LongType()), T.StructField("circle", T.BooleanType()), T.StructField("bad", T.BooleanType()), T.StructField("total", T.LongType())]))
    kids = nodes.where("up IS NOT NULL").groupBy(F.col("up").alias("_k")).agg(F.count("*").alias("n"))
    out = nodes.join(solved, "id").join(kids, F.col("id") == F.col("_k"), "left")
    cols = [F.col("id").alias(id)] + ([F.col("scope").alias(scope)] if scope else [])
    return out.select(
        *cols,
        F.col("up").alias(parent),
        F.when(~F.col("bad"), F.col("root")).alias("root"),
        F.when(~F.col("bad"), F.col("depth")).alias("depth"),
        F.col("circle").alias("on_circle"),
        (F.col("bad") & ~F.col("circle")).alias("below_circle"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n_children"),
        (F.col("total") - 1).alias("n_descendants"),
    )


def with_paths(tree: DataFrame, id: str, parent: str, block: int = 32) -> DataFrame:  # noqa: A002
    """Add each node's path as ``path_tail`` and ``path_next``; nodes on or below a circle get NULL for both.

    Full paths of a lineage of length n take n*n/2 ids. So a path is kept in blocks: ``path_tail`` holds the ids from the last
    ancestor whose depth is a multiple of ``block`` down to the node, ``path_next`` the parent of its first id, whose own row goes
    on with it (NULL: the tail starts at the root). Nothing is left out, and a row never holds more than ``block`` ids. ``block`` is
    a power of two. The tails come from pointer doubling: log2(block) joins.
    """
    if block < 1 or block & (block - 1):
        raise ValueError("block must be a power of two")
    cur = tree.where("depth IS NOT NULL").select(F.col(id).alias("v"), F.col(parent).alias("anc"), F.array(F.col(id)).alias("tail"))
    step = 1
    while step < block:
        cur = materialize(cur, "tails") if step in (4, 16) else cur
        p = cur.select(F.col("v").alias("_v"), F.col("anc").alias("_a"), F.col("tail").alias("_t"))
        cur = cur.join(p, F.col("anc") == F.col("_v"), "left").select("v", F.when(F.col("_v").isNotNull(), F.col("_a")).alias("anc"), F.when(F.col("_v").isNull(), F.col("tail")).otherwise(F.concat("_t", "tail")).alias("tail"))
        step *= 2
    keep = (F.col("depth") % block + 1).cast("int")
    out = tree.join(cur, F.col(id) == F.col("v"), "left")
    tail = F.slice("tail", F.size("tail") - keep + 1, keep)
    nxt = F.when(keep < F.size("tail"), F.try_element_at("tail", F.size("tail") - keep)).otherwise(F.col("anc"))
    return out.withColumn("path_tail", F.when(F.col("tail").isNotNull(), tail)).withColumn("path_next", F.when(F.col("tail").isNotNull(), nxt)).drop("v", "anc", "tail")


def _lines(intervals: DataFrame, id: str, ancestors: DataFrame | None = None, descendants: DataFrame | None = None) -> DataFrame:  # noqa: A002
    """All pairs ``ancestor, descendant, distance`` whose one end is in the ids given, from written intervals in preorder.

    An ancestor's interval is cut into dyadic blocks and a descendant looks up the one block of each level that it lies in: an equi-join that gives each pair once and
    no others, whatever the depth.
    """
    some = lambda d, ids: d if ids is None else d.join(ids.select(F.col(id).alias("_i")).where("_i IS NOT NULL").distinct(), F.col(id) == F.col("_i"), "left_semi")
    a = some(intervals.where("last > first"), ancestors).select(F.col(id).alias("ancestor"), "top", F.col("hops").alias("_h"), F.explode(dyadic_blocks("first + 1", "last")).alias("_b"))
    a = materialize(a.select("ancestor", F.col("top").alias("_t"), "_h", "_b.l", "_b.i"), "blocks")
    used = sorted(r.l for r in a.select("l").distinct().collect())  # 63 numbers at most
    levels = F.array(*[F.lit(x) for x in used]) if used else F.expr("cast(array() as array<int>)")
    d = some(intervals.where("first > 0"), descendants).select(F.col(id).alias("descendant"), "top", "hops", F.col("first").alias("_f"), F.explode(levels).alias("_l")).withColumn("_at", F.expr("shiftright(_f, _l)"))
    return d.join(a, (F.col("top") == F.col("_t")) & (F.col("_l") == F.col("l")) & (F.col("_at") == F.col("i"))).select("ancestor", "descendant", (F.col("hops") - F.col("_h")).cast("int").alias("distance"))


def expand_paths(paths: DataFrame, ids: DataFrame, id: str) -> DataFrame:  # noqa: A002
    """Whole paths (``id``, ``path`` from the root down) of the nodes in ``ids`` that have one. The number of jobs goes with the logarithm of the depth."""
    up = F.when(F.size("path_tail") > 1, F.try_element_at("path_tail", F.size("path_tail") - 1)).otherwise(F.col("path_next"))
    some = paths.where("path_tail IS NOT NULL")
    iv = materialize(with_intervals(some.select(id, up.alias("_up"), "on_circle", "n_descendants"), id, "_up").select(id, "top", "first", "last", "hops"), "intervals")
    want = ids.select(F.col(id).alias("_w")).where("_w IS NOT NULL").distinct()
    own = iv.join(want, F.col(id) == F.col("_w"), "left_semi").select(F.col(id).alias("descendant"), F.col(id).alias("ancestor"), F.lit(0).alias("distance"))
    lines = _lines(iv, id, descendants=ids).unionByName(own)
    far = F.array_sort(F.collect_list(F.struct((-F.col("distance")).alias("d"), F.col("ancestor").alias("a"))))
    return lines.groupBy(F.col("descendant").alias(id)).agg(far.alias("_p")).select(id, F.col("_p.a").alias("path"))


def expand_descendants(tree: DataFrame, ids: DataFrame, id: str, parent: str) -> DataFrame:  # noqa: A002
    """All pairs (``ancestor``, ``descendant``, ``distance``) below the nodes in ``ids``. The number of jobs goes with the logarithm of the depth.
    Nodes on a circle have no defined descendants and give no pair."""
    iv = materialize(with_intervals(tree, id, parent).where("top IS NOT NULL").select(id, "top", "first", "last", "hops"), "intervals")
    return _lines(iv, id, ancestors=ids)


def with_intervals(tree: DataFrame, id: str, parent: str) -> DataFrame:  # noqa: A002
    """Add ``top``, ``first``, ``last`` and ``hops``: u is below v just if both have the same ``top`` and v.first < u.first <= v.last; ``hops`` counts the links up to
    ``top``.

    ``first`` is the place in preorder (siblings by id) below ``top``, the topmost ancestor; of nodes below a circle that is the one that hangs
    from it. Nodes on a circle have no defined descendants and get NULL. All descendants of all nodes take one row each. Not from the
    contraction records: sizes of earlier siblings are summed by ranges, then up the path by pointer doubling, log2(depth) joins.
    """
    circle = tree.where("on_circle").select(F.col(id).alias("_c"))
    nodes = tree.where("NOT on_circle").select(F.col(id).alias("v"), F.col(parent).alias("p"), (F.col("n_descendants") + 1).alias("w"))
    nodes = materialize(nodes.join(circle, F.col("p") == F.col("_c"), "left").select("v", F.when(F.col("_c").isNull(), F.col("p")).alias("p"), "w"), "nodes")
    kids = materialize(nodes.where("p IS NOT NULL").repartitionByRange("p", "v").withColumn("r", F.spark_partition_id()), "kids")
    # a node with many children spans many ranges
    ahead = F.sum("w").over(Window.partitionBy("p").orderBy("r").rowsBetween(Window.unboundedPreceding, -1))
    ranges = kids.groupBy("p", "r").agg(F.sum("w").alias("w")).select("p", "r", F.coalesce(ahead, F.lit(0)).alias("ahead"))
    within = F.sum("w").over(Window.partitionBy("p", "r").orderBy("v").rowsBetween(Window.unboundedPreceding, -1))
    kids = kids.select("v", "p", "r", F.coalesce(within, F.lit(0)).alias("within")).join(ranges, ["p", "r"])
    done = nodes.where("p IS NULL").select("v", F.col("v").alias("top"), F.lit(0).cast("long").alias("first"), F.lit(0).cast("long").alias("hops"))
    more = materialize(kids.select("v", F.col("p").alias("anc"), (F.col("within") + F.col("ahead") + 1).alias("first"), F.lit(1).cast("long").alias("hops")), "places")
    while not more.isEmpty():
        ends = done.select(F.col("v").alias("_v"), F.col("top"), F.lit(None).cast(more.schema["anc"].dataType).alias("_a"), F.col("first").alias("_f"), F.col("hops").alias("_h"))
        on = more.select(F.col("v").alias("_v"), F.lit(None).cast(more.schema["v"].dataType).alias("top"), F.col("anc").alias("_a"), F.col("first").alias("_f"), F.col("hops").alias("_h"))
        step = more.join(ends.unionByName(on), F.col("anc") == F.col("_v")).select("v", F.col("_a").alias("anc"), "top", (F.col("first") + F.col("_f")).alias("first"), (F.col("hops") + F.col("_h")).alias("hops"))
        step = materialize(step, "doubled")
        done = done.unionByName(step.where("top IS NOT NULL").select("v", "top", "first", "hops"))
        more = step.where("top IS NULL").select("v", "anc", "first", "hops")
    return tree.join(done, F.col(id) == F.col("v"), "left").withColumn("last", F.col("first") + F.col("n_descendants")).drop("v")
