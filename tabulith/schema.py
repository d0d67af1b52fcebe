"""Versioned schemas: lookup by id or dotted name, projection by names or ids, JSON and Spark forms."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import types as T

from tabulith.types import Field, List, Map, SchemaError, Struct, Type, children, field_from_json, field_to_json, from_spark, to_spark, walk


@dataclass(frozen=True)
class TableSchema:
    fields: tuple[Field, ...]
    schema_id: int = 0
    identifier_ids: tuple[int, ...] = ()

    @property
    def struct(self) -> Struct:
        return Struct(self.fields)

    @cached_property
    def by_id(self) -> dict[int, Field]:
        return {f.id: f for f in walk(self.fields)}

    @cached_property
    def name_of(self) -> dict[int, str]:
        """Full dotted path of each id."""
        out: dict[int, str] = {}

        def visit(fields: tuple[Field, ...], prefix: str) -> None:
            for f in fields:
                out[f.id] = prefix + f.name
                visit(children(f.type), out[f.id] + ".")

        visit(self.fields, "")
        return out

    @cached_property
    def id_of(self) -> dict[str, int]:
        """Full paths, and short ones that leave out ``element`` before the fields of a list's struct; full names win."""
        full: dict[str, int] = {}
        short: dict[str, int] = {}

        def visit(fields: tuple[Field, ...], prefix: str, brief: str) -> None:
            for f in fields:
                name = prefix + f.name
                if name in full:
                    raise SchemaError(f"{name} names two fields: {full[name]} and {f.id}")
                full[name] = f.id
                if brief != prefix:
                    short[brief + f.name] = f.id
                if isinstance(f.type, List):
                    element = f.type.fields[0]
                    inner = name + ".element"
                    visit((element,), name + ".", name + ".")
                    if isinstance(element.type, Struct):
                        for g in element.type.fields:
                            add_short(g, inner + ".", brief + f.name + ".")
                else:
                    visit(children(f.type), name + ".", brief + f.name + ".")

        def add_short(f: Field, prefix: str, brief: str) -> None:
            short.setdefault(brief + f.name, f.id)
            for g in children(f.type) if isinstance(f.type, Struct) else ():
                add_short(g, prefix + f.name + ".", brief + f.name + ".")

        visit(self.fields, "", "")
        return short | full

    @cached_property
    def _lower(self) -> dict[str, set[int]]:
        out: dict[str, set[int]] = {}
        for name, i in self.id_of.items():
            out.setdefault(name.lower(), set()).add(i)
        return out

    def find(self, name: str | int, case_sensitive: bool = True) -> Field:
        """The field of an id or a dotted name; SchemaError if there is none or, without regard to case, more than one."""
        if isinstance(name, int):
            if name not in self.by_id:
                raise SchemaError(f"no field has id {name}")
            return self.by_id[name]
        if case_sensitive:
            found = {self.id_of[name]} if name in self.id_of else set()
        else:
            found = self._lower.get(name.lower(), set())
        if len(found) != 1:
            raise SchemaError(f"could not find column {name}" if not found else f"column {name} is ambiguous")
        return self.by_id[next(iter(found))]

    def find_type(self, name: str | int, case_sensitive: bool = True) -> Type:
        return self.find(name, case_sensitive).type

    def column_path(self, field_id: int) -> str:
        """The path of a field that isn't inside a list or map, quoted for Spark."""
        parts: list[str] = []

        def visit(fields: tuple[Field, ...]) -> bool:
            for f in fields:
                if f.id == field_id or (isinstance(f.type, Struct) and visit(f.type.fields)):
                    parts.append("`" + f.name.replace("`", "``") + "`")
                    return True
            return False

        if not visit(self.fields):
            raise SchemaError(f"field {field_id} isn't a column or a part of a struct column")
        return ".".join(reversed(parts))

    @property
    def highest_field_id(self) -> int:
        return max(self.by_id, default=0)

    def select(self, names: Iterable[str], case_sensitive: bool = True) -> TableSchema:
        """Projection to the named columns, in schema order; ``*`` keeps all."""
        names = list(names)
        if "*" in names:
            return self
        return self.prune({self.find(n, case_sensitive).id for n in names}, True)

    def prune(self, ids: set[int], full_types: bool = False) -> TableSchema:
        """Only what the ids select. A selected struct keeps all of its parts with ``full_types``, else only those selected too (perhaps
        none); a selected list or map needs ``full_types``. A list or map stays around selected parts; a map whose key is selected stays whole."""
        fields = _prune_fields(self.fields, set(ids), full_types)
        left = {f.id for f in walk(fields)}
        return TableSchema(fields, self.schema_id, tuple(i for i in self.identifier_ids if i in left))

    def __str__(self) -> str:
        return "table {\n" + "".join(f"\t{f}\n" for f in self.fields) + "}"

    def tree(self) -> str:
        out = [f"Current Schema, id={self.schema_id}"]

        def visit(fields: tuple[Field, ...], depth: int) -> None:
            for f in fields:
                out.append("  " * depth + str(f))
                visit(children(f.type), depth + 1)

        visit(self.fields, 1)
        return "\n".join(out)

    # --- forms

    def to_json(self) -> dict:
        return {"type": "struct", "fields": [field_to_json(f) for f in self.fields], "schema-id": self.schema_id, "identifier-field-ids": list(self.identifier_ids)}

    @staticmethod
    def from_json(x: dict) -> TableSchema:
        out = TableSchema(tuple(field_from_json(f) for f in x["fields"]), x.get("schema-id", 0), tuple(x.get("identifier-field-ids") or ()))
        seen: set[int] = set()
        for f in walk(out.fields):
            if f.id in seen:
                raise SchemaError(f"field id {f.id} twice")
            seen.add(f.id)
        return out

    def to_spark(self, ids: bool = True) -> T.StructType:
        return to_spark(self.struct, ids)

    @staticmethod
    def from_spark(schema: T.StructType, schema_id: int = 0) -> TableSchema:
        return TableSchema(from_spark(schema).fields, schema_id)


def _prune_fields(fields: tuple[Field, ...], ids: set[int], full: bool) -> tuple[Field, ...]:
    out = []
    for f in fields:
        kept = _prune_field(f, ids, full)
        if kept is not None:
            out.append(kept)
    return tuple(out)


def _prune_field(f: Field, ids: set[int], full: bool) -> Field | None:
    chosen = f.id in ids
    if chosen and (full or not children(f.type)) and not (isinstance(f.type, Struct) and not f.type.fields):
        return f
    inner = _prune_type(f.type, ids, full)
    if chosen:
        if isinstance(f.type, List | Map):
            raise SchemaError(f"cannot explicitly project List or Map types, {f.id}:{f.name} of type {f.type} was selected")
        return replace(f, type=inner if inner is not None else Struct(()))
    return None if inner is None else replace(f, type=inner)


def _prune_type(kind: Type, ids: set[int], full: bool) -> Type | None:
    """What the ids select inside a type, None if nothing."""
    if isinstance(kind, Struct):
        fields = _prune_fields(kind.fields, ids, full)
        return None if not fields else kind if fields == kind.fields else Struct(fields)
    if isinstance(kind, List):
        e = _prune_field(kind.fields[0], ids, full)
        return None if e is None else replace(kind, element=e.type)
    if isinstance(kind, Map):
        key, value = kind.fields
        v = _prune_field(value, ids, full)
        if v is not None:
            return replace(kind, value=v.type)
        return kind if _prune_field(key, ids, full) is not None else None
    return None
