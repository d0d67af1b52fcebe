"""Table types with field ids, their JSON form, and their Spark types."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import types as T


class SchemaError(ValueError):
    """A schema or a name in it is invalid."""


class TypeTextError(SchemaError):
    """A type's text can't be read."""


# The names of primitive types.
PRIMITIVES = ("boolean", "int", "long", "float", "double", "date", "time", "timestamp", "timestamptz", "string", "uuid", "binary")
_SPARK = {
    "boolean": T.BooleanType(),
    "int": T.IntegerType(),
    "long": T.LongType(),
    "float": T.FloatType(),
    "double": T.DoubleType(),
    "date": T.DateType(),
    "time": T.LongType(),  # microseconds of the day: Parquet files of Spark's own time type need a switch
    "timestamp": T.TimestampNTZType(),
    "timestamptz": T.TimestampType(),
    "string": T.StringType(),
    "uuid": T.StringType(),
    "binary": T.BinaryType(),
}


@dataclass(frozen=True)
class Primitive:
    name: str

    def __str__(self) -> str:
        return self.name


@dataclass(frozen=True)
class Decimal:
    precision: int
    scale: int

    def __str__(self) -> str:
        return f"decimal({self.precision}, {self.scale})"


@dataclass(frozen=True)
class Fixed:
    length: int

    def __str__(self) -> str:
        return f"fixed[{self.length}]"


@dataclass(frozen=True)
class Field:
    id: int
    name: str
    type: Type
    required: bool = False
    doc: str | None = None
    initial_default: object = field(default=None, compare=False)
    write_default: object = field(default=None, compare=False)

    def __str__(self) -> str:
        return f"{self.id}: {self.name}: {'required' if self.required else 'optional'} {self.type}" + (f" ({self.doc})" if self.doc else "")


@dataclass(frozen=True)
class Struct:
    fields: tuple[Field, ...] = ()

    def __str__(self) -> str:
        return "struct<" + ", ".join(f"{f.name}: {f.type}" for f in self.fields) + ">"


@dataclass(frozen=True)
class List:
    element_id: int
    element: Type
    element_required: bool = False

    @property
    def fields(self) -> tuple[Field, ...]:
        return (Field(self.element_id, "element", self.element, self.element_required),)

    def __str__(self) -> str:
        return f"list<{self.element}>"


@dataclass(frozen=True)
class Map:
    key_id: int
    key: Type
    value_id: int
    value: Type
    value_required: bool = True

    @property
    def fields(self) -> tuple[Field, ...]:
        return (Field(self.key_id, "key", self.key, True), Field(self.value_id, "value", self.value, self.value_required))

    def __str__(self) -> str:
        return f"map<{self.key}, {self.value}>"


Type = Primitive | Decimal | Fixed | Struct | List | Map

BOOLEAN, INT, LONG, FLOAT, DOUBLE, DATE, TIME, TIMESTAMP, TIMESTAMPTZ, STRING, UUID, BINARY = map(Primitive, PRIMITIVES)


def children(kind: Type) -> tuple[Field, ...]:
    return kind.fields if isinstance(kind, Struct | List | Map) else ()


def walk(fields: tuple[Field, ...]) -> Iterator[Field]:
    """All fields, parents first."""
    for f in fields:
        yield f
        yield from walk(children(f.type))


def type_from_json(x: object) -> Type:
    if isinstance(x, str):
        if x in PRIMITIVES:
            return Primitive(x)
        if m := re.fullmatch(r"decimal\(\s*(\d+)\s*,\s*(\d+)\s*\)", x):
            return Decimal(int(m[1]), int(m[2]))
        if m := re.fullmatch(r"fixed\[\s*(\d+)\s*\]", x):
            return Fixed(int(m[1]))
        raise TypeTextError(f"unknown type {x!r}")
    try:
        kind = x["type"]
        if kind == "struct":
            return Struct(tuple(field_from_json(f) for f in x["fields"]))
        if kind == "list":
            return List(x["element-id"], type_from_json(x["element"]), bool(x.get("element-required", False)))
        if kind == "map":
            return Map(x["key-id"], type_from_json(x["key"]), x["value-id"], type_from_json(x["value"]), bool(x.get("value-required", True)))
    except (KeyError, TypeError) as e:
        raise TypeTextError(f"incomplete type {x!r}") from e
    raise TypeTextError(f"unknown type {x!r}")


def field_from_json(x: dict) -> Field:
    return Field(x["id"], x["name"], type_from_json(x["type"]), bool(x.get("required", False)), x.get("doc"), x.get("initial-default"), x.get("write-default"))


def type_to_json(kind: Type) -> object:
    if isinstance(kind, Struct):
        return {"type": "struct", "fields": [field_to_json(f) for f in kind.fields]}
    if isinstance(kind, List):
        return {"type": "list", "element-id": kind.element_id, "element": type_to_json(kind.element), "element-required": kind.element_required}
    if isinstance(kind, Map):
        return {"type": "map", "key-id": kind.key_id, "key": type_to_json(kind.key), "value-id": kind.value_id, "value": type_to_json(kind.value), "value-required": kind.value_required}
    return str(kind)


def field_to_json(f: Field) -> dict:
    out = {"id": f.id, "name": f.name, "required": f.required, "type": type_to_json(f.type)}
    extra = {"doc": f.doc, "initial-default": f.initial_default, "write-default": f.write_default}
    return out | {k: v for k, v in extra.items() if v is not None}


# --- Spark ------------------------------------------------------------------------------------------------------------------

FIELD_ID = "parquet.field.id"


def to_spark(kind: Type, ids: bool = True) -> T.DataType:
    if isinstance(kind, Struct):
        return T.StructType([field_to_spark(f, ids) for f in kind.fields])
    if isinstance(kind, List):
        return T.ArrayType(to_spark(kind.element, ids), not kind.element_required)
    if isinstance(kind, Map):
        return T.MapType(to_spark(kind.key, ids), to_spark(kind.value, ids), not kind.value_required)
    if isinstance(kind, Decimal):
        return T.DecimalType(kind.precision, kind.scale)
    if isinstance(kind, Fixed):
        return T.BinaryType()
    return _SPARK[kind.name]


def field_to_spark(f: Field, ids: bool = True) -> T.StructField:
    meta = ({FIELD_ID: f.id} if ids else {}) | ({"comment": f.doc} if f.doc else {})
    return T.StructField(f.name, to_spark(f.type, ids), not f.required, meta)


class _Ids:
    def __init__(self) -> None:
        self.last = 0

    def next(self) -> int:
        self.last += 1
        return self.last


def from_spark(kind: T.DataType, ids: _Ids | None = None) -> Type:
    """A table type for a Spark type. Ids that a field's metadata has are kept, others are numbered from 1, parents first."""
    ids = ids or _Ids()
    if isinstance(kind, T.StructType):
        numbered = [(f, f.metadata[FIELD_ID] if FIELD_ID in (f.metadata or {}) else ids.next()) for f in kind.fields]
        return Struct(tuple(Field(i, f.name, from_spark(f.dataType, ids), not f.nullable, (f.metadata or {}).get("comment")) for f, i in numbered))
    if isinstance(kind, T.ArrayType):
        return List(ids.next(), from_spark(kind.elementType, ids), not kind.containsNull)
    if isinstance(kind, T.MapType):
        k, v = ids.next(), ids.next()
        return Map(k, from_spark(kind.keyType, ids), v, from_spark(kind.valueType, ids), not kind.valueContainsNull)
    if isinstance(kind, T.DecimalType):
        return Decimal(kind.precision, kind.scale)
    if isinstance(kind, T.ByteType | T.ShortType):
        return INT
    for name, t in _SPARK.items():
        if type(t) is type(kind) and name not in ("time", "uuid"):
            return Primitive(name)
    raise SchemaError(f"no table type for {kind.simpleString()}")
