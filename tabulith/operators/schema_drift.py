"""Schemas that drift between files: edit scripts between versions and one form for all rows.

Two nested schemas are ordered labelled trees (fields, list elements, map keys and values) with stable ids as labels. Their edit
script is that of the tree edit distance (Zhang and Shasha), worked out for every pair: deleting and inserting a field cost 1, mapping a field to the one of the
same id costs a quarter for each differing attribute and a half for another parent, fields of different ids never map. Siblings are put in id order first, so their
order in the text plays no part. What a mapping keeps in place was changed or not; of the rest, fields that both versions hold were moved: the
distance between what remains of both trees groups them, until no field of both remains. What is never mapped was added or removed.

A script compiled is a projection: it brings rows written under one version into the form of another.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import datetime, timezone
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulith.functions.paths import same_file
from tabulith.operators.common import in_force
from tabulith.session import materialize
from tabulith.types import to_spark

ATTRIBUTE_COST = 0.25
PARENT_COST = 0.5
CHANGES = ("added", "removed", "moved", "renamed", "type", "required")
LAG_BLOCK = 64


class Node(NamedTuple):
    id: int
    parent: int | None
    name: str
    type: str
    required: bool


def _fields(tree: dict) -> dict[int, Node]:
    """All fields by id; a stack holds what is still to be read, so a schema may be as deep as it likes."""
    out: dict[int, Node] = {}
    stack = [(f["id"], None, f["name"], f["type"], f.get("required")) for f in tree["fields"]]
    while stack:
        i, parent, name, kind, required = stack.pop()
        text = kind.get("type") if isinstance(kind, dict) else kind
        if not isinstance(text, str) or isinstance(i, bool) or not isinstance(i, int):
            raise ValueError("no type or id")
        if i in out:
            raise ValueError(f"field id {i} twice")
        out[i] = Node(i, parent, str(name), "".join(text.split()), required is True)
        if isinstance(kind, dict):
            if text == "struct":
                stack += [(f["id"], i, f["name"], f["type"], f.get("required")) for f in kind["fields"]]
            elif text == "list":
                stack.append((kind["element-id"], i, "element", kind["element"], kind.get("element-required")))
            elif text == "map":
                stack += [(kind["key-id"], i, "key", kind["key"], True), (kind["value-id"], i, "value", kind["value"], kind.get("value-required"))]
    return out


def parse_schema(text: str | None) -> dict[int, Node] | None:
    """Fields by id of a schema as written in a metadata file, None for what can't be read (also what is nested deeper than Python's JSON parser goes,
    some thousands of levels). A text encoded twice is decoded."""
    try:
        tree = json.loads(text) if text else None
        if isinstance(tree, str):
            tree = json.loads(tree)
        return _fields(tree)
    except (ValueError, TypeError, KeyError, AttributeError, RecursionError):
        return None


def canonical(nodes: dict[int, Node]) -> str:
    return json.dumps([list(nodes[i]) for i in sorted(nodes)], separators=(",", ":"))


@lru_cache(maxsize=4096)
def _load(text: str) -> dict[int, Node]:
    return {x[0]: Node(*x) for x in json.loads(text)}


def _postorder(nodes: dict[int, Node]) -> tuple[list[int], list[int]]:
    """Ids in postorder, and for each the position of its leftmost leaf. A node whose parent isn't among the nodes stands at the top."""
    kids: dict[int | None, list[int]] = {}
    for i in sorted(nodes):
        kids.setdefault(nodes[i].parent if nodes[i].parent in nodes else None, []).append(i)
    order: list[int] = []
    first: list[int] = []
    stack = [(i, None) for i in reversed(kids.get(None, ()))]
    while stack:
        i, start = stack.pop()
        if start is None:
            stack.append((i, len(order)))
            stack += [(k, None) for k in reversed(kids.get(i, ()))]
        else:
            first.append(start)
            order.append(i)
    order.append(-1)  # the root that both trees share
    first.append(0)
    return order, first


def change_cost(x: Node, y: Node) -> float:
    return ATTRIBUTE_COST * sum(p != q for p, q in zip(x[2:], y[2:], strict=True)) + PARENT_COST * (x.parent != y.parent)


def tree_mapping(old: dict[int, Node], new: dict[int, Node]) -> set[int]:
    """Ids that a minimum-cost ordered tree mapping keeps in place (Zhang-Shasha).

    A row of a forest's table at a time: what a cell takes from the row above is known at once, what it takes from its left neighbour is a running minimum.
    Where one of two subtrees is a leaf, their distance needs no table: the leaf is mapped if the other holds its id.
    """
    a, la = _postorder(old)
    b, lb = _postorder(new)
    there = {v: q for q, v in enumerate(b)}
    n, m = len(a), len(b)
    left_a, left_b = np.array(la), np.array(lb)
    cost = np.full((n, m), np.inf)  # of mapping two nodes
    for p, i in enumerate(a):
        if i in there:
            cost[p, there[i]] = change_cost(old[i], new[i]) if i != -1 else 0.0
    size_a, size_b = np.arange(n) - left_a + 1, np.arange(m) - left_b + 1
    dist = np.full((n, m), np.inf)
    for p, i in enumerate(a):
        if la[p] == p:
            dist[p] = size_b + 1
            q = there.get(i)
            if q is not None:
                inside = (left_b <= q) & (np.arange(m) >= q)
                dist[p][inside] += min(cost[p, q] - 2, 0)
    back = {v: p for p, v in enumerate(a)}
    for q, i in enumerate(b):
        if lb[q] == q:
            dist[:, q] = size_a + 1
            p = back.get(i)
            if p is not None:
                inside = (left_a <= p) & (np.arange(n) >= p)
                dist[:, q][inside] += min(cost[p, q] - 2, 0)

    def forest(i: int, j: int) -> np.ndarray:
        li, lj = la[i], lb[j]
        w = j - lj + 2
        f = np.empty((i - li + 2, w))
        steps = np.arange(w)
        f[0] = steps
        whole = left_b[lj : j + 1] == lj
        jump = left_b[lj : j + 1] - lj
        for x in range(1, i - li + 2):
            p = x + li - 1
            up = f[x - 1]
            side = f[la[p] - li][jump] + dist[p, lj : j + 1]
            if la[p] == li:
                side = np.where(whole, up[:-1] + cost[p, lj : j + 1], side)
            row = np.empty(w)
            row[0] = up[0] + 1
            row[1:] = np.minimum(up[1:] + 1, side)
            f[x] = np.minimum.accumulate(row - steps) + steps
            if la[p] == li:
                dist[p, lj : j + 1][whole] = f[x, 1:][whole]
        return f

    def keyroots(left: list[int]) -> list[int]:
        return [i for i in sorted({v: i for i, v in enumerate(left)}.values()) if left[i] != i]

    roots_b = keyroots(lb)
    for i in keyroots(la):
        for j in roots_b:
            forest(i, j)
    kept: set[int] = set()
    stack = [(n - 1, m - 1)]
    while stack:
        i, j = stack.pop()
        f = forest(i, j)
        li, lj = la[i], lb[j]
        x, y = i - li + 1, j - lj + 1
        while x > 0 or y > 0:
            p, q = x + li - 1, y + lj - 1
            if x > 0 and f[x, y] == f[x - 1, y] + 1:
                x -= 1
            elif y > 0 and f[x, y] == f[x, y - 1] + 1:
                y -= 1
            elif la[p] == li and lb[q] == lj:
                if a[p] != -1:
                    kept.add(a[p])
                x, y = x - 1, y - 1
            else:
                stack.append((p, q))
                x, y = la[p] - li, lb[q] - lj
    return kept


def edit_script(old: dict[int, Node], new: dict[int, Node]) -> list[tuple[int, str, str | None, str | None]]:
    """(field id, change, before, after); change is added, removed, renamed, type, required or moved.

    All of it is read off mappings: the first one keeps fields in place; each further one, between what the earlier ones left of both trees, is of fields that
    are put back together. Mapped fields with another parent have moved; one that goes along with its parent hasn't moved itself. What no mapping holds was
    removed or added.
    """
    out: list[tuple[int, str, str | None, str | None]] = []
    x, y = dict(old), dict(new)
    while kept := tree_mapping(x, y):
        for i in kept:
            p, q = old[i], new[i]
            if p.parent != q.parent:
                out.append((i, "moved", str(p.parent), str(q.parent)))
            out += [(i, what, str(v), str(w)) for what, v, w in (("renamed", p.name, q.name), ("type", p.type, q.type), ("required", p.required, q.required)) if v != w]
        x, y = {i: v for i, v in x.items() if i not in kept}, {i: v for i, v in y.items() if i not in kept}
    out += [(i, "removed", v.name, None) for i, v in x.items()] + [(i, "added", None, v.name) for i, v in y.items()]
    return sorted(out, key=lambda r: (r[0], CHANGES.index(r[1])))


def read_versions(schemas: DataFrame, table: str = "table_uuid", version: str = "schema_id", text: str = "schema_json", latest: str = "recorded_at") -> DataFrame:
    """``table, version, tree`` with one row per version held: the latest copy that can be read. Rows without table or version are none."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in frames:
            trees = [parse_schema(x) for x in d["_text"]]
            yield d.drop(columns="_text").assign(tree=[None if t is None else canonical(t) for t in trees])

    src = schemas.select(F.col(table).alias("t"), F.col(version).cast("int").alias("v"), F.col(latest).alias("at"), F.col(text).alias("_text")).where("t IS NOT NULL AND v IS NOT NULL")
    kind = src.schema["t"].dataType.simpleString()
    at = src.schema["at"].dataType.simpleString()
    parsed = src.mapInPandas(parse, f"t {kind}, v int, at {at}, tree string").where("tree IS NOT NULL")
    return in_force(parsed, ["t", "v"], "at", ["tree"])


def with_previous(versions: DataFrame) -> DataFrame:
    """Add ``prev``, the next lower version held of the same table. Windows run over blocks of version numbers and then over the
    blocks' greatest ones, so that a table with very many versions isn't one task's work."""
    from pyspark.sql import Window

    keys = versions.select("t", "v", F.floor(F.col("v") / LAG_BLOCK).alias("blk"))
    tops = keys.groupBy("t", "blk").agg(F.max("v").alias("top"))
    before = tops.withColumn("below", F.lag("top").over(Window.partitionBy("t").orderBy("blk"))).select("t", "blk", "below")
    inner = keys.withColumn("p", F.lag("v").over(Window.partitionBy("t", "blk").orderBy("v")))
    return inner.join(before, ["t", "blk"]).select("t", "v", F.coalesce("p", "below").alias("prev"))


def schema_changes(schemas: DataFrame, **names: str) -> DataFrame:
    """Every change from version to version: ``t, v, prev, field_id, change, before, after``; ``v`` is the later version.

    A version without a lower one changes nothing. Copies in other layouts and unreadable copies beside a good one make no
    difference; a version of which no copy can be read is not held. NULL tables, NULL versions and empty input give no rows.
    """
    vs = read_versions(schemas, **names)
    pairs = with_previous(vs).where("prev IS NOT NULL")
    new = pairs.join(vs, ["t", "v"]).withColumnRenamed("tree", "new")
    both = new.join(vs.select("t", F.col("v").alias("prev"), F.col("tree").alias("old")), ["t", "prev"]).where("old <> new")

    def diff(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in frames:
            rows = [(t, v, p, *c) for t, v, p, x, y in zip(d["t"], d["v"], d["prev"], d["old"], d["new"], strict=True) for c in edit_script(_load(x), _load(y))]
            yield pd.DataFrame(rows, columns=["t", "v", "prev", "field_id", "change", "before", "after"])

    kind = both.schema["t"].dataType.simpleString()
    return both.select("t", "v", "prev", "old", "new").mapInPandas(diff, f"t {kind}, v int, prev int, field_id int, change string, before string, after string")


# --- one form for all rows -------------------------------------------------------------------------------------------------


def _convert(value: object, kind: str) -> tuple[object, bool]:
    """The value as the type demands, and whether that was possible; text is kept as it is where it wasn't."""
    if value is None:
        return None, True
    try:
        if kind in ("int", "long"):
            if isinstance(value, bool):
                return value, False
            x = int(value) if not isinstance(value, float) or value.is_integer() else None
            return (x, True) if x is not None else (value, False)
        if kind in ("float", "double"):
            return (value, False) if isinstance(value, bool) else (float(value), True)
        if kind.startswith("decimal"):
            return (value, False) if isinstance(value, bool) else (str(value), _number(str(value)))
        if kind == "boolean":
            if isinstance(value, str) and value.lower() in ("true", "false"):
                return value.lower() == "true", True
            return value, isinstance(value, bool)
        if kind in ("timestamp", "timestamptz") and isinstance(value, str):
            x = datetime.fromisoformat(value)
            if kind == "timestamp":
                return (x.astimezone(timezone.utc).replace(tzinfo=None) if x.tzinfo else x).isoformat(timespec="microseconds"), True
            return (x if x.tzinfo else x.replace(tzinfo=timezone.utc)).astimezone(timezone.utc).isoformat(timespec="microseconds"), True
        if kind == "string":
            return value if isinstance(value, str) else json.dumps(value), True
    except (ValueError, TypeError, OverflowError):
        return value, False
    return value, True


def _number(text: str) -> bool:
    from decimal import Decimal, InvalidOperation

    try:
        return Decimal(text).is_finite()
    except InvalidOperation:
        return False


class Projection:
    """An edit script from one version's tree to another's, compiled: names, types and parents after it for the fields of the first; applied to the payload
    of a row. Fields that the script removes stay, under their own names, so no data is lost."""

    def __init__(self, have: dict[int, Node], script: list[tuple[int, str, str | None, str | None]]) -> None:
        self.have = have
        change = {(i, what): after for i, what, _, after in script}
        self.name = {i: change.get((i, "renamed"), n.name) for i, n in have.items()}
        self.kind = {i: change.get((i, "type"), n.type) for i, n in have.items()}
        self.kids: dict[int | None, dict[str, int]] = {}
        for n in have.values():
            self.kids.setdefault(n.parent, {})[n.name] = n.id
        # moves within one object's structs are carried out; out of or into a list or map there is no one row to go to
        self.parent = {i: n.parent for i, n in have.items()}
        for (i, what), after in change.items():
            if what == "moved" and i in have:
                to = None if after == "None" else int(after)
                if (to is None or to in have) and self._scope(to) == self._scope(have[i].parent) and (to is None or self.have[to].type == self.kind[to] == "struct"):
                    self.parent[i] = to
        for i in have:  # moves that would close a circle, because a part of the way there isn't in this version, are left out
            seen, at = set(), i
            while at is not None and at not in seen:
                seen.add(at)
                at = self.parent[at]
            if at is not None:
                self.parent[i] = have[i].parent
        self.moves = any(self.parent[i] != n.parent for i, n in have.items())

    def _scope(self, i: int | None) -> int | None:
        """The nearest list element or map part that a place lies in."""
        while i is not None and self.have[i].type == "struct" and (p := self.have[i].parent) is not None and self.have[p].type not in ("list", "map"):
            i = p
        return i if i is not None and self.have[i].parent is not None and self.have[self.have[i].parent].type in ("list", "map") else None

    def apply(self, payload: dict) -> tuple[dict, int, int]:
        """The row keyed by the names after the script, and the numbers of unknown keys and of values that can't be converted."""
        self.unknown = self.failed = 0
        out = self._object(None, payload)
        return out, self.unknown, self.failed

    def _object(self, parent: int | None, value: dict) -> dict:
        out: dict[str, object] = {}
        if not self.moves:
            self._fill(parent, value, lambda i, v: out.__setitem__(self.name[i], v))
            return out
        got: dict[int, object] = {}
        self._fill(parent, value, got.__setitem__, spread=True)
        made: dict[int | None, dict] = {parent: out}
        for i in got:  # the structs above a field are there if it is
            at = self.parent[i]
            while at not in made:
                made[at] = {}
                at = self.parent[at]
        for i, v in {**{i: m for i, m in made.items() if i != parent}, **{i: v for i, v in got.items() if i not in made}}.items():
            made[self.parent[i]][self.name[i]] = v
        return out

    def _fill(self, parent: int | None, value: dict, put, spread: bool = False) -> None:
        names = self.kids.get(parent, {})
        for k, v in value.items():
            i = names.get(k)
            if i is None:
                self.unknown += 1
            elif spread and isinstance(v, dict) and self.have[i].type == self.kind[i] == "struct":
                put(i, {})
                self._fill(i, v, put, True)
            else:
                put(i, self._value(i, v))

    def _value(self, i: int, v: object) -> object:
        old, kind, parts = self.have[i].type, self.kind[i], self.kids.get(i, {})
        if v is None:
            return None
        if old == kind == "struct" and isinstance(v, dict):
            return self._object(i, v)
        if old == kind == "list" and isinstance(v, list):
            return [self._value(parts["element"], x) for x in v]
        if old == kind == "map" and isinstance(v, dict):
            return {k: self._value(parts["value"], x) for k, x in v.items()}
        if kind in ("struct", "list", "map"):
            self.failed += 1
            return v
        new, good = _convert(v, kind)
        self.failed += not good
        return new


def _nodes(versions: DataFrame) -> DataFrame:
    """``t, v, id, parent, name, kind, def`` of every field of every version."""
    n = versions.select("t", "v", F.explode(F.from_json("tree", "array<array<string>>")).alias("n"))
    return n.select("t", "v", F.col("n")[0].cast("int").alias("id"), F.col("n")[1].cast("int").alias("parent"), F.col("n")[2].alias("name"), F.col("n")[3].alias("kind"), F.to_json("n").alias("def"))


def _under_version(rows: DataFrame, schemas: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows in force with ``used``, the version they were written under; versions; unified trees)."""
    vs = read_versions(schemas)
    vs = materialize(vs, "versions")
    nodes = _nodes(vs)
    top = nodes.where("parent IS NULL").select("t", "v", "name")
    # the unified tree: of each field id the latest definition
    latest = nodes.groupBy("t", "id").agg(F.max_by("def", "v").alias("def"))
    union = latest.groupBy("t").agg(F.sort_array(F.collect_list(F.struct("id", "def"))).alias("fs")).select("t", F.concat(F.lit("["), F.array_join("fs.def", ","), F.lit("]")).alias("union"))
    recs = in_force(rows.where("record_id IS NOT NULL"), ["record_id"], "recorded_at", ["table_uuid", "schema_id", "file_path", "payload"])
    recs = recs.withColumn("file", same_file(F.col("file_path")))
    keys = recs.select(F.col("table_uuid").alias("t"), "file", F.col("schema_id").alias("said"), F.explode(F.json_object_keys("payload")).alias("name")).distinct()
    known = top.withColumnRenamed("v", "said").withColumn("hit", F.lit(1))
    fit = keys.join(known, ["t", "said", "name"], "left").groupBy("t", "file", "said").agg(F.count("*").alias("n"), F.count("hit").alias("m"))
    misfit = fit.where("said IS NULL OR m < n").select("t", "file", F.col("said").alias("s0"))
    width = top.groupBy("t", "v").agg(F.count("*").alias("width"))
    tried = keys.join(misfit, (keys.t == misfit.t) & keys.file.eqNullSafe(misfit.file) & keys.said.eqNullSafe(misfit.s0), "left_semi").join(top, ["t", "name"])
    score = tried.groupBy("t", "file", "said", "v").agg(F.count("*").alias("m")).join(width, ["t", "v"])
    best = score.groupBy("t", "file", "said").agg(F.max_by("v", F.struct("m", F.when(F.col("v") == F.col("said"), 1).otherwise(0), -F.col("width"), "v")).alias("used"))
    b = best.select(F.col("t").alias("bt"), F.col("file").alias("bf"), F.col("said").alias("bs"), "used")
    picked = recs.join(b, (F.col("table_uuid") == F.col("bt")) & F.col("file").eqNullSafe(F.col("bf")) & F.col("schema_id").eqNullSafe(F.col("bs")), "left")
    picked = picked.withColumn("used", F.coalesce("used", "schema_id")).select("record_id", "table_uuid", "schema_id", "payload", "used")
    return picked, vs, union


def unify_rows(rows: DataFrame, schemas: DataFrame) -> DataFrame:
    """All rows of each table in one form: ``record_id, table_uuid, schema_id, used_schema_id, row_json, unknown_keys, unconverted``.

    The unified schema of a table holds every field id of any version under its latest name and type, so no version loses data.
    ``row_json`` is keyed by these names; an absent key stays absent, a null stays null, numbers written as text become numbers.
    The version that a file was written under is the declared one if that explains all keys of the file, otherwise the one that
    explains most of them (then the one that leaves the fewest fields without a key, then the latest): writers lag behind. A
    table without any readable schema keeps its payload as it is, with ``used_schema_id`` NULL. Repeated records count once, the
    latest of them. Rows whose payload is no JSON object have a NULL ``row_json``.
    """
    picked, vs, union = _under_version(rows, schemas)
    full = picked.join(vs.select("t", "v", "tree"), (F.col("table_uuid") == F.col("t")) & (F.col("used") == F.col("v")), "left").drop("t", "v").join(union, F.col("table_uuid") == F.col("t"), "left").drop("t")

    def project(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made: dict[tuple[str, str], Projection] = {}
        for d in frames:
            out = []
            for r, t, s, text, used, tree, want in d[["record_id", "table_uuid", "schema_id", "payload", "used", "tree", "union"]].itertuples(index=False):
                s, used = (None if pd.isna(x) else int(x) for x in (s, used))
                try:
                    x = json.loads(text)
                    x = json.loads(x) if isinstance(x, str) else x
                except (ValueError, TypeError, RecursionError):
                    x = None
                if not isinstance(x, dict):
                    out.append((r, t, s, used, None, 0, 0))
                elif tree is None:
                    out.append((r, t, s, None, json.dumps(x, sort_keys=True), 0, 0))
                else:
                    if (tree, want) not in made:
                        if len(made) > 2000:
                            made.clear()
                        made[tree, want] = Projection(_load(tree), edit_script(_load(tree), _load_union(want)))
                    y, unknown, failed = made[tree, want].apply(x)
                    out.append((r, t, s, used, json.dumps(y, sort_keys=True), unknown, failed))
            yield pd.DataFrame(out, columns=["record_id", "table_uuid", "schema_id", "used_schema_id", "row_json", "unknown_keys", "unconverted"]).astype({"schema_id": "Int32", "used_schema_id": "Int32"})

    return full.mapInPandas(project, "record_id bigint, table_uuid string, schema_id int, used_schema_id int, row_json string, unknown_keys int, unconverted int")


@lru_cache(maxsize=2048)
def _load_union(text: str) -> dict[int, Node]:
    """The unified tree, whose definitions came through arrays of texts. Of fields with the same latest name in one struct all but the one of the greatest id get
    ``_ID`` after theirs: they are different fields."""
    out = {int(x[0]): Node(int(x[0]), None if x[1] is None else int(x[1]), x[2], x[3], x[4] in (True, "true")) for x in json.loads(text)}
    taken: set[tuple[int | None, str]] = {(n.parent, n.name) for n in out.values()}
    seen: set[tuple[int | None, str]] = set()
    for i in sorted(out, reverse=True):
        n = out[i]
        if n.parent is not None and (n.parent not in out or out[n.parent].type != "struct"):
            continue
        if (n.parent, n.name) in seen:
            name = f"{n.name}_{i}"
            while (n.parent, name) in taken:
                name += "_"
            out[i] = n = n._replace(name=name)
            taken.add((n.parent, name))
        seen.add((n.parent, n.name))
    return out


def typed_rows(rows: DataFrame, schemas: DataFrame, table: object) -> DataFrame:
    """All rows of one table in typed columns: ``record_id`` and a column for each top-level field of the unified schema, in id order.

    A field called ``record_id`` gets ``_ID`` after it. Values that the type can't take are NULL, as are absent ones. A table without any readable schema gives
    its record ids alone.
    """
    from tabulith.types import type_from_json

    vs, union = _under_version(rows, schemas)[1:]
    one = union.where(F.col("t") == F.lit(table)).first()
    own = rows.where(F.col("table_uuid") == F.lit(table))
    if one is None:
        return own.select("record_id").where("record_id IS NOT NULL").distinct()
    nodes = _load_union(one["union"])
    kids: dict[int | None, list[Node]] = {}
    for i in sorted(nodes):
        kids.setdefault(nodes[i].parent, []).append(nodes[i])

    def spark(n: Node) -> T.DataType:
        parts = {k.name: k for k in kids.get(n.id, ())}
        if n.type == "struct":
            return T.StructType([T.StructField(k.name, spark(k)) for k in kids.get(n.id, ())])
        if n.type == "list":
            return T.ArrayType(spark(parts["element"]))
        if n.type == "map":
            return T.MapType(spark(parts["key"]), spark(parts["value"]))
        return to_spark(type_from_json(n.type), False)

    top = kids.get(None, ())
    shape = T.StructType([T.StructField(n.name, spark(n)) for n in top])
    unified = unify_rows(own, schemas).select("record_id", F.from_json("row_json", shape, {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}).alias("r"))
    return unified.select("record_id", *[F.col("r").getField(n.name).alias(n.name if n.name.lower() != "record_id" else f"{n.name}_{n.id}") for n in top])


def values(rows: DataFrame, schemas: DataFrame) -> DataFrame:
    """The fields of all rows outside of lists and maps, one row for each that is there and not null, typed as the unified schema of its table says:
    ``record_id, used_schema_id, field_id, name, kind, whole, number, flag, micros, day, text, n_parts``.

    Which column holds the value follows from ``kind``: int and long ``whole``; float, double and decimal ``number``; boolean ``flag``; timestamps ``micros`` since
    1970 in UTC; date ``day``; list and map ``n_parts``, their length; all others ``text``. A value that the type can't take leaves all of them NULL. Structs have no row, their
    parts have. Nothing here is Python: a level of the payload is exploded and joined with the version's names at a time.
    """
    picked, vs, _ = _under_version(rows, schemas)
    nodes = _nodes(vs)
    now = nodes.groupBy("t", "id").agg(F.max_by(F.struct("name", "kind"), "v").alias("u")).select("t", "id", F.col("u.name").alias("name"), F.col("u.kind").alias("kind"))
    own = nodes.select("t", F.col("v").alias("used"), F.col("parent").alias("up"), F.col("name").alias("key"), "id", F.col("kind").alias("wrote"))
    cur = picked.where("used IS NOT NULL").select("record_id", F.col("table_uuid").alias("t"), "used", F.lit(None).cast("int").alias("up"), F.col("payload").alias("j"))
    out = None
    while True:
        each = cur.select("record_id", "t", "used", "up", F.explode(F.from_json("j", "map<string,string>")).alias("key", "j")).where("j IS NOT NULL")
        found = materialize(each.alias("e").join(own.alias("o"), (F.col("e.t") == F.col("o.t")) & (F.col("e.used") == F.col("o.used")) & (F.col("e.key") == F.col("o.key")) & F.col("e.up").eqNullSafe(F.col("o.up"))).select("record_id", "e.t", "e.used", "id", "wrote", "j"), "values")
        leaf = found.where("wrote <> 'struct'").select("record_id", "t", "used", "id", "j")
        out = leaf if out is None else out.unionByName(leaf)
        cur = found.where("wrote = 'struct'").select("record_id", "t", "used", F.col("id").alias("up"), "j")
        if cur.isEmpty():  # a round for each level of structs
            break
    full = out.join(now, ["t", "id"])
    zoned = F.col("j").rlike(r"(Z|[+-]\d\d:?\d\d)$")
    when = lambda kinds, c: F.when(F.col("kind").isin(*kinds), c)
    parts = F.when(F.col("kind") == "list", F.json_array_length("j")).when(F.col("kind") == "map", F.size(F.json_object_keys("j")))
    plain = ~F.col("kind").isin("int", "long", "float", "double", "boolean", "timestamp", "timestamptz", "date", "list", "map", "struct") & ~F.col("kind").startswith("decimal")
    return full.select(
        "record_id",
        F.col("used").alias("used_schema_id"),
        F.col("id").alias("field_id"),
        "name",
        "kind",
        when(("int", "long"), F.expr("try_cast(j AS bigint)")).alias("whole"),
        F.when(F.col("kind").isin("float", "double") | F.col("kind").startswith("decimal"), F.expr("try_cast(j AS double)")).alias("number"),
        when(("boolean",), F.when(F.lower("j").isin("true", "false"), F.lower("j") == "true")).alias("flag"),
        when(("timestamp", "timestamptz"), F.unix_micros(F.when(zoned, F.expr("try_cast(j AS timestamp)")).otherwise(F.expr("try_cast(concat(j, 'Z') AS timestamp)")))).alias("micros"),
        when(("date",), F.expr("try_cast(j AS date)")).alias("day"),
        F.when(plain, F.col("j")).alias("text"),
        F.when(parts >= 0, parts).alias("n_parts"),
    )
