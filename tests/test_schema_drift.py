from __future__ import annotations

import itertools
import json
import random

import pytest

from tabulith.operators import schema_drift as s


def node(i, parent, name=None, kind="int", required=False):
    return s.Node(i, parent, name or f"n{i}", kind, required)


def brute_kept(old: dict, new: dict) -> float:
    """Least cost over all mappings of equal ids that keep ancestry (order by id is kept by every such mapping of sorted siblings or not)."""
    oa, la = s._postorder(old)
    ob, _ = s._postorder(new)
    pa, pb = {v: k for k, v in enumerate(oa)}, {v: k for k, v in enumerate(ob)}

    def above(nodes, x, y):
        while y is not None and y != x:
            y = nodes[y].parent
        return y == x

    common = sorted(old.keys() & new.keys())
    best = float("inf")
    for n in range(len(common) + 1):
        for kept in itertools.combinations(common, n):
            ok = all((pa[x] < pa[y]) == (pb[x] < pb[y]) and above(old, x, y) == above(new, x, y) and above(old, y, x) == above(new, y, x) for x, y in itertools.combinations(kept, 2))
            if ok:
                cost = len(old) + len(new) - 2 * n + sum(s.change_cost(old[x], new[x]) for x in kept)
                best = min(best, cost)
    return best


def cost(old, new, kept):
    return len(old) + len(new) - 2 * len(kept) + sum(s.change_cost(old[x], new[x]) for x in kept)


def tree(r, n):
    out = {}
    for i in r.sample(range(1, 9), n):
        out[i] = node(i, r.choice([None, *out]), r.choice("ab"), r.choice(("int", "struct")), r.random() < 0.5)
    return out


@pytest.mark.parametrize("seed", range(150))
def test_mapping_costs_least(seed):
    r = random.Random(seed)
    old, new = tree(r, r.randint(0, 6)), tree(r, r.randint(0, 6))
    assert cost(old, new, s.tree_mapping(old, new)) == pytest.approx(brute_kept(old, new))


def schema(fields):
    return json.dumps({"type": "struct", "fields": fields})


A = [{"id": 1, "name": "a", "type": "int", "required": True}, {"id": 2, "name": "p", "type": {"type": "struct", "fields": [{"id": 3, "name": "x", "type": "decimal(9, 2)"}]}}, {"id": 4, "name": "l", "type": {"type": "list", "element-id": 5, "element": "int"}}]
B = [{"id": 2, "name": "P", "type": {"type": "struct", "fields": []}}, {"id": 1, "name": "a", "type": "long"}, {"id": 3, "name": "x", "type": "decimal(9,2)"}, {"id": 4, "name": "l", "type": {"type": "map", "key-id": 6, "key": "int", "value-id": 7, "value": "int", "value-required": True}}]


def test_script():
    got = {(i, c) for i, c, _, _ in s.edit_script(s.parse_schema(schema(A)), s.parse_schema(schema(B)))}
    assert got == {(1, "type"), (1, "required"), (2, "renamed"), (3, "moved"), (4, "type"), (5, "removed"), (6, "added"), (7, "added")}


def test_unreadable():
    for text in (None, "", "{", "[]", "1", '{"fields": 3}', '{"fields": [{"id": 1}]}', schema([A[0], A[0]])):
        assert s.parse_schema(text) is None
    assert s.parse_schema(json.dumps(schema(A))) == s.parse_schema(schema(A))


DDL = "table_uuid string, schema_id int, schema_json string, recorded_at timestamp_ntz, field_id string, t int"


def test_changes(spark):
    rows = [("t", 0, schema(A)), ("t", 0, json.dumps(json.loads(schema(A)), indent=1)), ("t", 0, schema(A)[:40]), ("t", 70, schema(B)), ("t", 200, schema(B)), ("t", None, schema(A)), (None, 1, schema(A)), ("u", 3, "broken"), ("u", 4, schema(A))]
    df = spark.createDataFrame([(*r, None, "x", 1) for r in rows], DDL)
    got = {(r.t, r.v, r.prev, r.field_id, r.change) for r in s.schema_changes(df).collect()}
    assert {x[:3] for x in got} == {("t", 70, 0)} and len(got) == 8
    assert s.schema_changes(df.limit(0)).count() == 0


def test_unified_rows(spark):
    schemas = spark.createDataFrame([("t", 0, schema(A), None, "", 1), ("t", 1, schema(B[:2] + B[3:]), None, "", 1)], DDL)
    ddl = "record_id long, table_uuid string, schema_id int, file_path string, payload string, recorded_at timestamp_ntz, v int, tree string"
    rows = [
        (1, "t", 0, "s3://f/1", '{"a": "7", "p": {"x": 1.5}, "l": [1, null]}'),
        (1, "t", 0, "s3://f/1", '{"a": "7", "p": {"x": 1.5}, "l": [1, null]}'),
        (2, "t", 1, "s3://f/2", '{"a": 8, "P": null, "l": {"k": 2}}'),
        (3, "t", 1, "s3://f/3", '{"a": 9, "p": {"x": "2"}, "zzz": 1}'),
        (4, "t", None, "s3://f/4", '{"P": {}}'),
        (5, "t", 0, "s3://f/5", "[1]"),
        (6, "gone", 0, "s3://f/6", '{"q": 1}'),
        (None, "t", 0, "s3://f/6", '{"q": 1}'),
        (7, "t", 0, None, None),
    ]
    got = {r.record_id: r for r in s.unify_rows(spark.createDataFrame([(*r, None, 1, "") for r in rows], ddl), schemas).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6, 7}
    assert json.loads(got[1].row_json) == {"a": 7, "P": {"x": "1.5"}, "l": [1, None]} and got[1].unconverted == 1  # a list can't become a map
    assert json.loads(got[2].row_json) == {"a": 8, "P": None, "l": {"k": 2}}
    assert got[3].used_schema_id == 0 and got[3].unknown_keys == 1  # the writer lagged behind
    assert got[4].used_schema_id == 1
    assert got[5].row_json is None and got[7].row_json is None
    assert json.loads(got[6].row_json) == {"q": 1} and got[6].used_schema_id is None


def apply_script(old, new, script):
    """The tree that a script makes of the old one; only what was added is looked up in the new one."""
    out = {i: n for i, n in old.items() if (i, "removed") not in {(x, c) for x, c, _, _ in script}}
    for i, change, _, after in script:
        if change == "added":
            out[i] = new[i]
        elif change == "moved":
            out[i] = out[i]._replace(parent=None if after == "None" else int(after))
        elif change in ("renamed", "type", "required"):
            out[i] = out[i]._replace(**{{"renamed": "name"}.get(change, change): after if change != "required" else after == "True"})
    return out


@pytest.mark.parametrize("seed", range(60))
def test_script_leads_to_the_new_tree(seed):
    r = random.Random(1000 + seed)
    old, new = tree(r, r.randint(0, 8)), tree(r, r.randint(0, 8))
    script = s.edit_script(old, new)
    assert apply_script(old, new, script) == new
    assert {(i, c) for i, c, _, _ in script if c in ("added", "removed")} == {(i, "added") for i in new.keys() - old.keys()} | {(i, "removed") for i in old.keys() - new.keys()}
    assert {i for i, c, _, _ in script if c == "moved"} == {i for i in old.keys() & new.keys() if old[i].parent != new[i].parent}


def test_rows_come_from_the_mapping(monkeypatch):
    old, new = s.parse_schema(schema(A)), s.parse_schema(schema(B))
    monkeypatch.setattr(s, "tree_mapping", lambda a, b: set())
    assert {c for _, c, _, _ in s.edit_script(old, new)} == {"added", "removed"}


def test_a_moved_struct_takes_its_fields_along():
    old = {1: node(1, None, "a", "struct"), 2: node(2, None, "b", "struct"), 3: node(3, 2, "c", "struct"), 4: node(4, 3, "d"), 5: node(5, 3, "e")}
    new = {**old, 3: node(3, 1, "c", "struct")}
    assert s.edit_script(old, new) == [(3, "moved", "2", "1")]
    deep = {i: node(i, i - 1 or None, kind="struct") for i in range(1, 3001)}  # deeper than Python recurses
    assert len(s._postorder(deep)[0]) == 3001


def test_projection_moves_fields():
    have = {1: node(1, None, "a", "struct"), 2: node(2, 1, "x"), 3: node(3, None, "b", "struct"), 4: node(4, 3, "y"), 5: node(5, None, "l", "list"), 6: node(6, 5, "element", "struct"), 7: node(7, 6, "z")}
    want = {**have, 2: node(2, 3, "x2", "long"), 7: node(7, None, "z")}
    p = s.Projection(have, s.edit_script(have, want))
    assert p.apply({"a": {"x": "1"}, "b": {"y": 2}, "l": [{"z": 3}]}) == ({"a": {}, "b": {"x2": 1, "y": 2}, "l": [{"z": 3}]}, 0, 0)
    assert p.apply({"a": {"x": None}, "q": 1}) == ({"a": {}, "b": {"x2": None}}, 1, 0)


def test_equal_names_stay_apart():
    union = s._load_union(json.dumps([["3", None, "x", "int", "false"], ["9", None, "x", "int", "false"], ["4", None, "l", "list", "false"], ["5", "4", "element", "int", "false"], ["6", "4", "element", "long", "false"]]))
    assert {i: n.name for i, n in union.items()} == {3: "x_3", 9: "x", 4: "l", 5: "element", 6: "element"}
    have = {3: node(3, None, "x"), 9: node(9, None, "y")}
    assert s.Projection(have, s.edit_script(have, union)).apply({"x": 1, "y": 2})[0] == {"x_3": 1, "x": 2}


def test_typed(spark):
    fields = [{"id": 1, "name": "a", "type": "long"}, {"id": 2, "name": "p", "type": {"type": "struct", "fields": [{"id": 3, "name": "x", "type": "decimal(9,2)"}, {"id": 4, "name": "ts", "type": "timestamp"}]}}, {"id": 5, "name": "l", "type": {"type": "list", "element-id": 6, "element": "int"}}, {"id": 7, "name": "record_id", "type": "date"}, {"id": 8, "name": "z", "type": "timestamptz"}]
    schemas = spark.createDataFrame([("t", 0, schema(fields), None, "", 1), ("u", 0, schema(fields[:1]), None, "", 1)], DDL)
    rows = [(1, "t", 0, "f", '{"a": "7", "p": {"x": "1.50", "ts": "2024-01-02T03:04:05.000006"}, "l": [1, 2], "record_id": "2024-05-06", "z": "2024-01-02T03:04:05+01:00"}'), (2, "t", 0, "f", '{"a": "seven", "p": null, "l": {}}'), (3, "u", 0, "f", '{"a": 3}'), (4, "gone", 0, "f", '{"a": 3}'), (5, "t", 0, "f", "x")]
    df = spark.createDataFrame([(*r, None, 1) for r in rows], "record_id long, table_uuid string, schema_id int, file_path string, payload string, recorded_at timestamp_ntz, kind int")
    t = s.typed_rows(df, schemas, "t")
    assert [f"{n}:{k}" for n, k in t.dtypes] == ["record_id:bigint", "a:bigint", "p:struct<x:decimal(9,2),ts:timestamp_ntz>", "l:array<int>", "record_id_7:date", "z:timestamp"]
    got = {r.record_id: r for r in t.collect()}
    assert set(got) == {1, 2, 5} and (got[1].a, str(got[1].p.x), str(got[1].p.ts), got[1].l, str(got[1].record_id_7)) == (7, "1.50", "2024-01-02 03:04:05.000006", [1, 2], "2024-05-06") and got[2].a is None and got[5].a is None
    assert s.typed_rows(df, schemas, "gone").columns == ["record_id"] and s.typed_rows(df, schemas, "gone").count() == 1
    v = {(r.record_id, r.field_id): r for r in s.values(df, schemas).collect()}
    assert set(v) == {(1, 1), (1, 3), (1, 4), (1, 5), (1, 7), (1, 8), (2, 1), (2, 5), (3, 1)}
    assert (v[1, 1].whole, v[1, 3].number, v[1, 4].micros, v[1, 5].n_parts, str(v[1, 7].day), v[1, 8].micros) == (7, 1.5, 1704164645000006, 2, "2024-05-06", 1704161045000000)
    assert (v[2, 1].whole, v[2, 5].n_parts, v[3, 1].whole) == (None, None, 3) and s.values(df.limit(0), schemas).count() == 0
