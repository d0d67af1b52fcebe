"""Partition transforms: text form, value on the driver, Spark column, and partition specs."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import timedelta
from decimal import Decimal as Dec

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulith import types as t
from tabulith.functions.literals import EPOCH
from tabulith.schema import TableSchema
from tabulith.types import SchemaError

FIRST_PARTITION_ID = 1000


class TransformError(ValueError):
    """A transform's text is invalid."""


M = 0xFFFFFFFF


def murmur3(data: bytes, seed: int = 0) -> int:
    """The 32-bit x86 hash as a signed integer."""

    def mix(k: int) -> int:
        k = k * 0xCC9E2D51 & M
        return (k << 15 | k >> 17) * 0x1B873593 & M

    h, n = seed, len(data)
    for i in range(0, n - n % 4, 4):
        h ^= mix(int.from_bytes(data[i : i + 4], "little"))
        h = ((h << 13 | h >> 19) & M) * 5 + 0xE6546B64 & M
    if n % 4:
        h ^= mix(int.from_bytes(data[n - n % 4 :], "little"))
    h ^= n
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
        h = (h ^ h >> shift) * factor & M
    return h - (1 << 32) if h >> 31 else h


def _zero_prefix() -> int:
    """The int whose Spark hash (seed 42) is 0, found by running the hash of one word backwards. Spark hashes several columns one after
    another, each with the result so far as its seed: after this int, a long is hashed with seed 0, as the format wants it."""
    inverse = lambda a: pow(a, -1, 1 << 32)
    h = 4  # the final mix maps 0 to 0; before it the length was mixed in
    h = (h - 0xE6546B64) * inverse(5) & M
    h = (h >> 13 | h << 19) & M
    k = h ^ 42
    k = k * inverse(0x1B873593) & M
    k = (k >> 15 | k << 17) & M
    k = k * inverse(0xCC9E2D51) & M
    return k - (1 << 32) if k >> 31 else k


ZERO_PREFIX = _zero_prefix()


@F.pandas_udf(T.IntegerType())
def _hash_bytes(values: pd.Series) -> pd.Series:
    codes, unique = pd.factorize(values)
    hashes = np.array([murmur3(bytes(x)) for x in unique] + [0], dtype=np.int64)
    return pd.Series(pd.array(hashes[codes], dtype="Int32")).mask(codes < 0)


@F.pandas_udf(T.BinaryType())
def _decimal_bytes(values: pd.Series) -> pd.Series:
    def one(v: Dec | None) -> bytes | None:
        if v is None:
            return None
        n = int(v.scaleb(-v.as_tuple().exponent))
        return n.to_bytes((n.bit_length() if n >= 0 else (n + 1).bit_length()) // 8 + 1, "big", signed=True)

    return values.map(one)


@dataclass(frozen=True)
class Transform:
    name: str  # identity, void, bucket, truncate, year, month, day, hour
    arg: int | None = None

    def __str__(self) -> str:
        return self.name if self.arg is None else f"{self.name}[{self.arg}]"

    def result_type(self, source: t.Type) -> t.Type:
        if self.name in ("bucket", "year", "month", "hour"):
            return t.INT
        return t.DATE if self.name == "day" else source

    def check(self, source: t.Type) -> None:
        """SchemaError if values of the type have no such transform."""
        text = isinstance(source, t.Decimal | t.Fixed) or source in (t.INT, t.LONG, t.STRING, t.BINARY)
        good = {
            "bucket": text or source in (t.DATE, t.TIME, t.TIMESTAMP, t.TIMESTAMPTZ, t.UUID),
            "truncate": text and not isinstance(source, t.Fixed),
            "year": source in (t.DATE, t.TIMESTAMP, t.TIMESTAMPTZ),
            "month": source in (t.DATE, t.TIMESTAMP, t.TIMESTAMPTZ),
            "day": source in (t.DATE, t.TIMESTAMP, t.TIMESTAMPTZ),
            "hour": source in (t.TIMESTAMP, t.TIMESTAMPTZ),
        }.get(self.name, not t.children(source))
        if not good:
            raise SchemaError(f"{self} has no meaning for {source}")

    def column(self, c: Column, source: t.Type) -> Column:
        """The transform of a column; NULL stays NULL. All but the bucket of texts, binaries and decimals stays in the JVM."""
        self.check(source)
        if self.name == "identity":
            return c
        if self.name == "void":
            return F.lit(None).cast(t.to_spark(source))
        if self.name == "truncate":
            return self._truncate(c, source)
        if self.name == "bucket":
            return F.pmod(self._hash(c, source).bitwiseAND(0x7FFFFFFF), F.lit(self.arg))
        day = c.cast("date") if source != t.TIMESTAMPTZ else F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.unix_micros(c) / 86_400_000_000).cast("int"))
        if self.name == "year":
            return F.year(day) - 1970
        if self.name == "month":
            return (F.year(day) - 1970) * 12 + F.month(day) - 1
        if self.name == "day":
            return day
        us = F.unix_micros(c) if source == t.TIMESTAMPTZ else _ntz_micros(c)
        return ((us - F.pmod(us, F.lit(3_600_000_000))) / 3_600_000_000).cast("int")

    def _truncate(self, c: Column, source: t.Type) -> Column:
        w = self.arg
        if source in (t.INT, t.LONG):
            return (c - F.pmod(c, F.lit(w))).cast(t.to_spark(source))
        if isinstance(source, t.Decimal):
            unit = F.lit(Dec(w).scaleb(-source.scale)).cast(t.to_spark(source))
            return (c - F.pmod(c, unit)).cast(t.to_spark(source))
        return F.substring(c, 1, w)

    def _hash(self, c: Column, source: t.Type) -> Column:
        if source in (t.INT, t.LONG, t.TIME, t.DATE, t.TIMESTAMP, t.TIMESTAMPTZ):
            n = F.unix_date(c) if source == t.DATE else F.unix_micros(c) if source == t.TIMESTAMPTZ else _ntz_micros(c) if source == t.TIMESTAMP else c
            n = n.cast("long")
            return F.when(n.isNotNull(), F.hash(F.lit(ZERO_PREFIX), n))
        if isinstance(source, t.Decimal):
            return _hash_bytes(_decimal_bytes(c))
        return _hash_bytes(F.unhex(F.regexp_replace(c, "-", "")) if source == t.UUID else c.cast("binary"))

    def value(self, v: object, source: t.Type) -> object:
        """The transform of one value in the files' form (dates in days, timestamps in microseconds); None for None."""
        if v is None or self.name == "void":
            return None
        if self.name == "identity":
            return v
        if self.name == "truncate":
            if source in (t.INT, t.LONG):
                return v - v % self.arg
            if isinstance(source, t.Decimal):
                n = int(v.scaleb(source.scale))
                return Dec(n - n % self.arg).scaleb(-source.scale)
            return v[: self.arg]
        if self.name == "bucket":
            if source in (t.INT, t.LONG, t.TIME, t.DATE, t.TIMESTAMP, t.TIMESTAMPTZ):
                data = (v % (1 << 64)).to_bytes(8, "little")
            elif isinstance(source, t.Decimal):
                n = int(v.scaleb(source.scale))
                data = n.to_bytes((n.bit_length() if n >= 0 else (n + 1).bit_length()) // 8 + 1, "big", signed=True)
            else:
                data = bytes.fromhex(v.replace("-", "")) if source == t.UUID else v.encode() if isinstance(v, str) else bytes(v)
            return (murmur3(data) & 0x7FFFFFFF) % self.arg
        days = v if source == t.DATE else v // 86_400_000_000
        if self.name == "day":
            return days
        if self.name == "hour":
            return v // 3_600_000_000
        d = EPOCH.date() + timedelta(days=days)
        return d.year - 1970 if self.name == "year" else (d.year - 1970) * 12 + d.month - 1

    @property
    def keeps_order(self) -> bool:
        return self.name in ("identity", "truncate", "year", "month", "day", "hour")


def _ntz_micros(c: Column) -> Column:
    """Microseconds of a timestamp without zone, whatever the session's zone."""
    day = F.unix_date(c.cast("date")).cast("long") * 86_400_000_000
    seconds = F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)
    return day + seconds.cast("long") * 1_000_000 + F.date_format(c, "SSSSSS").cast("long")


def parse_transform(text: str) -> Transform:
    if m := re.fullmatch(r"(bucket|truncate)\[([0-9]+)\]", text):
        if int(m[2]) > 0:
            return Transform(m[1], int(m[2]))
    elif text in ("identity", "void", "year", "month", "day", "hour"):
        return Transform(text)
    raise TransformError(f"invalid transform syntax: {text}")


@dataclass(frozen=True)
class PartitionField:
    source_id: int
    field_id: int
    name: str
    transform: Transform

    def __str__(self) -> str:
        return f"{self.field_id}: {self.name}: {self.transform}({self.source_id})"


@dataclass(frozen=True)
class PartitionSpec:
    fields: tuple[PartitionField, ...] = ()
    spec_id: int = 0

    def by_source(self, source_id: int) -> tuple[PartitionField, ...]:
        return tuple(f for f in self.fields if f.source_id == source_id)

    def compatible_with(self, other: PartitionSpec) -> bool:
        """Whether both have the same fields but for spec id and field ids."""
        brief = lambda s: [(f.source_id, f.name, f.transform) for f in s.fields]
        return brief(self) == brief(other)

    @property
    def last_assigned_field_id(self) -> int:
        return max((f.field_id for f in self.fields), default=FIRST_PARTITION_ID)

    def partition_type(self, schema: TableSchema) -> t.Struct:
        """The struct of partition values; a field whose source is gone is left out."""
        return t.Struct(tuple(t.Field(f.field_id, f.name, f.transform.result_type(schema.by_id[f.source_id].type)) for f in self.fields if f.source_id in schema.by_id))

    def __str__(self) -> str:
        return "[" + ("\n" if self.fields else "") + "".join(f"\t{f}\n" for f in self.fields) + "]"

    def to_json(self) -> dict:
        return {"spec-id": self.spec_id, "fields": [field_to_json(f) for f in self.fields]}

    @staticmethod
    def from_json(x: dict) -> PartitionSpec:
        return PartitionSpec(fields_from_json(x["fields"]), x.get("spec-id", 0))


def field_to_json(f: PartitionField) -> dict:
    return {"source-id": f.source_id, "field-id": f.field_id, "transform": str(f.transform), "name": f.name}


def fields_from_json(xs: Sequence[dict]) -> tuple[PartitionField, ...]:
    return tuple(PartitionField(x["source-id"], x.get("field-id", FIRST_PARTITION_ID + i), x["name"], parse_transform(x["transform"])) for i, x in enumerate(xs))


UNPARTITIONED = PartitionSpec()


@dataclass(frozen=True)
class SortField:
    source_id: int
    transform: Transform
    direction: str = "asc"
    null_order: str = ""

    def __post_init__(self) -> None:
        if not self.null_order:
            object.__setattr__(self, "null_order", "nulls-first" if self.direction == "asc" else "nulls-last")

    def __str__(self) -> str:
        source = str(self.source_id) if self.transform.name == "identity" else f"{self.transform}({self.source_id})"
        return f"{source} {self.direction} {self.null_order}"

    def to_json(self) -> dict:
        return {"source-id": self.source_id, "transform": str(self.transform), "direction": self.direction, "null-order": self.null_order}

    @staticmethod
    def from_json(x: dict) -> SortField:
        if x.get("direction") not in ("asc", "desc"):
            raise SchemaError("invalid sort direction, must be 'asc' or 'desc'")
        if x.get("null-order") not in ("nulls-first", "nulls-last"):
            raise SchemaError("invalid null order, must be 'nulls-first' or 'nulls-last'")
        return SortField(x["source-id"], parse_transform(x["transform"]), x["direction"], x["null-order"])


@dataclass(frozen=True)
class SortOrder:
    order_id: int = 0
    fields: tuple[SortField, ...] = ()

    def __str__(self) -> str:
        return "[" + ("\n" if self.fields else "") + "".join(f"{f}\n" for f in self.fields) + "]"

    def columns(self, schema: TableSchema) -> list[Column]:
        """The order as Spark sort columns."""
        out = []
        for f in self.fields:
            source = schema.find(f.source_id)
            c = f.transform.column(F.col(schema.column_path(source.id)), source.type)
            out.append(getattr(c, f"{f.direction}_{f.null_order.replace('-', '_')}")())
        return out

    def to_json(self) -> dict:
        return {"order-id": self.order_id, "fields": [f.to_json() for f in self.fields]}

    @staticmethod
    def from_json(x: dict) -> SortOrder:
        fields = tuple(SortField.from_json(f) for f in x.get("fields") or ())
        return SortOrder((x.get("order-id") or 1) if fields else 0, fields)


UNSORTED = SortOrder()
