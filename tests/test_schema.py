"""Types, schemas, literals, transforms and orders: fixtures of the format."""

from __future__ import annotations

import math
import struct
from datetime import date, datetime, timezone
from datetime import time as day_time
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulith import types as t
from tabulith.functions import literals as lit
from tabulith.functions import transforms as tr
from tabulith.schema import TableSchema
from tabulith.types import Field, List, Map, SchemaError, Struct

NESTED = TableSchema(
    (
        Field(2, "station", t.STRING, True),
        Field(5, "crew", Struct((Field(6, "lead", t.STRING), Field(7, "size", t.INT, True), Field(8, "home", Struct((Field(9, "port", t.STRING),)))))),
        Field(10, "bottles", List(11, Struct((Field(12, "salt", t.FLOAT), Field(13, "temp", t.FLOAT))), True)),
        Field(14, "tags", List(15, t.STRING, True), True),
        Field(16, "limits", Map(17, t.INT, 18, Map(19, t.STRING, 20, t.DOUBLE, True))),
        Field(21, "valid", t.BOOLEAN),
    ),
    4,
    (2,),
)


def test_names():
    assert NESTED.id_of == {
        "station": 2, "crew": 5, "crew.lead": 6, "crew.size": 7, "crew.home": 8, "crew.home.port": 9, "bottles": 10, "bottles.element": 11, "bottles.element.salt": 12, "bottles.element.temp": 13, "bottles.salt": 12, "bottles.temp": 13,
        "tags": 14, "tags.element": 15, "limits": 16, "limits.key": 17, "limits.value": 18, "limits.value.key": 19, "limits.value.value": 20, "valid": 21,
    }
    assert NESTED.name_of[13] == "bottles.element.temp" and NESTED.name_of[20] == "limits.value.value"
    assert NESTED.find("CREW.Home.port", case_sensitive=False).id == 9 and NESTED.highest_field_id == 21
    ports = TableSchema((Field(3, "by_port", Map(4, t.LONG, 5, Struct((Field(6, "berth", t.STRING),)))),))
    assert "by_port.value.berth" in ports.id_of and "by_port.berth" not in ports.id_of
    for bad in ("nope", "crew.nope", 99):
        with pytest.raises(SchemaError):
            NESTED.find(bad)
    with pytest.raises(SchemaError, match="ambiguous"):
        TableSchema((Field(1, "a", t.INT), Field(2, "A", t.INT))).find("a", case_sensitive=False)
    with pytest.raises(SchemaError):
        _ = TableSchema((Field(1, "a", t.INT), Field(2, "a", t.INT))).id_of
    assert TableSchema(()).highest_field_id == 0


def test_json_round_trip():
    kinds = [Field(30, "d", t.Decimal(9, 2)), Field(31, "f", t.Fixed(16), doc="x"), Field(32, "u", t.UUID, initial_default="1")]
    s = TableSchema((*NESTED.fields, *kinds), 3, (1, 2))
    assert TableSchema.from_json(s.to_json()) == s
    assert t.type_from_json("decimal(9,2)") == t.Decimal(9, 2) and t.type_from_json("fixed[ 3 ]") == t.Fixed(3)
    assert t.type_from_json({"type": "map", "key-id": 1, "key": "int", "value-id": 2, "value": "int"}).value_required
    assert not t.type_from_json({"type": "list", "element-id": 1, "element": "int"}).element_required
    for bad in ("integer", "decimal(9)", "fixed", "decimal(9,2)x", 5, {"type": "set"}, {"type": "list"}):
        with pytest.raises(SchemaError):
            t.type_from_json(bad)


def test_prune():
    assert [f.name for f in NESTED.prune({2}).fields] == ["station"] and NESTED.prune({2}).identifier_ids == (2,) and NESTED.prune({21}).identifier_ids == ()
    for full in (False, True):
        assert NESTED.prune({15}, full).fields == (NESTED.fields[3],)
        assert NESTED.prune({19}, full).fields == NESTED.prune({20}, full).fields == (NESTED.fields[4],)
        assert NESTED.prune({6}, full).fields == (Field(5, "crew", Struct((Field(6, "lead", t.STRING),))),)
        assert NESTED.prune({9, 13}, full).fields == (Field(5, "crew", Struct((Field(8, "home", Struct((Field(9, "port", t.STRING),))),))), Field(10, "bottles", List(11, Struct((Field(13, "temp", t.FLOAT),)), True)))
        empty = TableSchema((Field(5, "crew", Struct(())),))
        assert empty.prune({5}, full) == empty
    for i, text in ((14, "14:tags of type list<string>"), (16, "16:limits of type map<int, map<string, double>>")):
        with pytest.raises(SchemaError, match=f"cannot explicitly project List or Map types, {text} was selected"):
            NESTED.prune({i})
        assert len(NESTED.prune({i}, True).fields) == 1
    assert NESTED.prune({5}).fields == (Field(5, "crew", Struct(())),)
    assert NESTED.prune(set(range(21)), True).fields[:5] == NESTED.fields[:5]
    ports = TableSchema((Field(3, "by_port", Map(4, t.LONG, 5, Struct((Field(6, "berth", t.STRING), Field(7, "depth", t.DOUBLE, True))), True), True),))
    assert ports.prune({7}).fields[0].type.value == Struct((Field(7, "depth", t.DOUBLE, True),))
    assert NESTED.select(["CREW.Size", "station"], case_sensitive=False).name_of == {2: "station", 5: "crew", 7: "crew.size"}
    assert NESTED.select(["*"]) is NESTED


def test_spark_forms():
    s = NESTED.to_spark()
    assert s["station"].metadata == {t.FIELD_ID: 2} and not s["station"].nullable and s["tags"].dataType == T.ArrayType(T.StringType(), False)
    flat = TableSchema((Field(1, "a", t.LONG), Field(2, "b", Struct((Field(3, "c", t.DATE),))), Field(4, "z", t.TIMESTAMPTZ)))
    assert TableSchema.from_spark(flat.to_spark()) == flat
    assert NESTED.column_path(9) == "`crew`.`home`.`port`"
    with pytest.raises(SchemaError):
        NESTED.column_path(12)
    assert str(NESTED.fields[3]) == "14: tags: required list<string>" and str(Field(1, "a", t.INT, doc="d")) == "1: a: optional int (d)"
    assert str(NESTED.fields[1].type) == "struct<lead: string, size: int, home: struct<port: string>>"


CASTS = [
    ("abc", t.STRING, "abc"), ("-12", t.INT, -12), ("+12", t.LONG, 12), ("2.718", t.DOUBLE, 2.718), ("1492-10-12", t.DATE, -174301), ("2021-03-04", t.DATE, 18690), ("true", t.BOOLEAN, True), ("F", t.BOOLEAN, False),
    ("05:06:07.89", t.TIME, 18367890000), ("2021-03-04T05:06:07.890123", t.TIMESTAMP, 1614834367890123), ("2021-03-04T05:06:07.890123+03:30", t.TIMESTAMPTZ, 1614821767890123),
    ("0F6F2A0E-2B7C-4B3A-9D51-6C1B5A7E4D10", t.UUID, "0f6f2a0e-2b7c-4b3a-9d51-6c1b5a7e4d10"), ("71.250", t.Decimal(9, 3), D("71.250")),
    ("2147483648", t.INT, lit.Beyond.ABOVE), ("-2147483649", t.INT, lit.Beyond.BELOW), ("9223372036854775808", t.LONG, lit.Beyond.ABOVE), ("-9223372036854775809", t.LONG, lit.Beyond.BELOW),
    ("5e+38", t.FLOAT, lit.Beyond.ABOVE), ("-4.4e+38", t.FLOAT, lit.Beyond.BELOW), ("9e+308", t.DOUBLE, lit.Beyond.ABOVE),
    (71, t.INT, 71), (71, t.LONG, 71), (71, t.FLOAT, 71.0), (71, t.DOUBLE, 71.0), (9, t.DATE, 9), (9, t.TIME, 9), (71, t.Decimal(9, 2), D("71.00")), (71, t.Decimal(9, 0), D("71")),
    (1 << 31, t.INT, lit.Beyond.ABOVE), (-(1 << 31) - 1, t.INT, lit.Beyond.BELOW), (1 << 40, t.DATE, lit.Beyond.ABOVE), (71.25, t.DOUBLE, 71.25), (71.26, t.Decimal(9, 1), D("71.3")), (71.25, t.Decimal(9, 4), D("71.2500")),
    (3.5e38, t.FLOAT, lit.Beyond.ABOVE), (b"\0\1\2", t.Fixed(3), b"\0\1\2"), (b"\0\1\2", t.BINARY, b"\0\1\2"), (D("1.50"), t.Decimal(9, 2), D("1.50")), (D("1.5"), t.Decimal(9, 2), D("1.50")), (True, t.BOOLEAN, True),
    (datetime(1970, 1, 2), t.DATE, 1), (datetime(1969, 12, 31, 23), t.DATE, -1), (datetime(1970, 1, 1, 0, 0, 1, tzinfo=timezone.utc), t.TIMESTAMPTZ, 1_000_000), (date(1970, 1, 3), t.DATE, 2), (day_time(0, 0, 1), t.TIME, 1_000_000),
]


@pytest.mark.parametrize(("value", "kind", "want"), CASTS, ids=str)
def test_cast(value, kind, want):
    assert lit.cast(value, kind) == want


def test_cast_single_precision():
    assert lit.cast("2.718", t.FLOAT) == struct.unpack("<f", struct.pack("<f", 2.718))[0]
    assert lit.cast(struct.unpack("<f", struct.pack("<f", 71.26))[0], t.Decimal(9, 4), t.FLOAT) == D("71.2600")


BAD = [
    (True, t.INT), (True, t.STRING), (5, t.STRING), (5, t.BOOLEAN), (5, t.TIMESTAMP), (5, t.UUID), (5, t.BINARY), (1.5, t.INT), (1.5, t.DATE), (1.5, t.STRING), ("abc", t.INT), ("1.5", t.INT), ("x", t.DOUBLE), ("2017-8-18", t.DATE),
    ("2017-13-18", t.DATE), ("25:00:00", t.TIME), ("2017-08-18T14:21:01", t.TIMESTAMP), ("2017-08-18T14:21:01.919234+00:00", t.TIMESTAMP), ("2017-08-18T14:21:01.919234", t.TIMESTAMPTZ), ("abc", t.UUID), ("yes", t.BOOLEAN), ("abc", t.BINARY),
    ("abc", t.Fixed(3)), ("x", t.Decimal(9, 2)), (b"\0\1", t.Fixed(3)), (b"\0", t.STRING), (date(2020, 1, 1), t.TIMESTAMP), (day_time(1), t.DATE), (D("1.555"), t.Decimal(9, 2)), (D("1.5"), t.INT), (lit.Beyond.ABOVE, t.INT), (float("nan"), t.Decimal(9, 2)), (object(), t.INT),
]


@pytest.mark.parametrize(("value", "kind"), BAD, ids=str)
def test_bad_cast(value, kind):
    with pytest.raises(lit.CastError):
        lit.cast(value, kind)


# How single values stand in bounds; the format gives some of these, the others are our own
BYTES = [
    (t.BOOLEAN, b"\0", False), (t.BOOLEAN, b"\1", True), (t.INT, b"\xd2\4\0\0", 1234), (t.LONG, b"\xd2\4\0\0\0\0\0\0", 1234), (t.FLOAT, b"\0\0\x90\xc0", -4.5), (t.DOUBLE, b"\x8d\x97\x6e\x12\x83\xc0\xf3\x3f", 1.2345), (t.DATE, b"\xe8\3\0\0", 1000),
    (t.TIME, b"\0\xe8vH\x17\0\0\0", 100000000000), (t.TIMESTAMP, b"\x80\x1a\6\0\0\0\0\0", 400000), (t.STRING, b"ABC", "ABC"), (t.Fixed(3), b"foo", b"foo"), (t.BINARY, b"foo", b"foo"),
    (t.UUID, bytes.fromhex("f79c3e09677c4bbda4793f349cb785e7"), "f79c3e09-677c-4bbd-a479-3f349cb785e7"), (t.Decimal(5, 2), b"09", D("123.45")), (t.Decimal(7, 4), b"\xed\x29\x79", D("-123.4567")), (t.Decimal(7, 4), b"\x12\xd6\x87", D("123.4567")),
    (t.Decimal(10, 3), b"\x0b", D("0.011")), (t.Decimal(10, 3), b"", D("0.000")), (t.Decimal(9, 0), b"\0\x80", D(128)), (t.Decimal(9, 0), b"\xff\0", D(-256)),
    (t.INT, b"\xff\xff\xff\xff", -1), (t.LONG, b"\0\0\0\0\0\0\0\x80", -(1 << 63)), (t.STRING, "é".encode(), "é"), (t.STRING, b"", ""), (t.FLOAT, b"\0\0\x80\x3f", 1.0), (t.DATE, b"\xff\xff\xff\xff", -1),
]


@pytest.mark.parametrize(("kind", "data", "value"), BYTES, ids=str)
def test_bytes(kind, data, value):
    assert lit.from_bytes(data, kind) == value and lit.to_bytes(value, kind) == data


def test_order_keys():
    cases = {
        t.LONG: [-(1 << 63), -256, -1, 0, 1, 255, 256, (1 << 63) - 1], t.DOUBLE: [-math.inf, -1e300, -1.5, -0.0, 1e-300, 2.5, math.inf], t.FLOAT: [-1.5, 0.0, 1.5], t.Decimal(20, 2): [D("-12345678901.23"), D("-0.01"), D(0), D("0.01"), D("99999999999.00")],
        t.STRING: ["", "a", "aa", "b", "é"], t.BOOLEAN: [False, True], t.BINARY: [b"", b"\0", b"\x7f", b"\x80"],
    }
    for kind, values in cases.items():
        keys = [lit.order_key(v, kind) for v in values]
        assert keys == sorted(keys) and len(set(keys)) == len(keys)
    assert lit.order_key(0.0, t.DOUBLE) == lit.order_key(-0.0, t.DOUBLE)


@pytest.mark.parametrize("text", ["identity", "void", "year", "month", "day", "hour", "bucket[5]", "bucket[100]", "truncate[10]", "truncate[255]"])
def test_transform_text(text):
    assert str(tr.parse_transform(text)) == text


@pytest.mark.parametrize("text", ["foobar", "bucket", "truncate", "bucket[]", "truncate[]", "bucket[-1]", "truncate[-1]", "bucketfoo[4]", "bucket[0]", "bucket[4]x"])
def test_bad_transform(text):
    with pytest.raises(tr.TransformError) as e:
        tr.parse_transform(text)
    assert text in str(e.value)


# Hashes that the format names
def test_hash_vectors():
    b = lambda v, k: tr.Transform("bucket", 1 << 31).value(v, k)
    assert tr.murmur3(b"hello") == 0x248BFA47 and b(34, t.INT) == b(34, t.LONG) == 2017239379
    assert tr.murmur3(bytes.fromhex("f79c3e09677c4bbda4793f349cb785e7")) == 1488055340
    assert b(17486, t.DATE) == -653330422 & 0x7FFFFFFF and b(1510871468000000, t.TIMESTAMP) == -2047944441 & 0x7FFFFFFF
    assert b(D("14.20"), t.Decimal(9, 2)) == -500754589 & 0x7FFFFFFF and tr.murmur3(b"\0\1\2\3") == -188683207


def test_transforms_agree(spark):
    """Columns and single values give the same."""
    rows = [(-7, -70000000000, "ähm text", date(1969, 12, 31), datetime(1969, 12, 31, 23, 59, 59, 999999), D("-1.55"), b"\1\2\3\4\5"), (12, 5, "", date(2017, 11, 16), datetime(2017, 11, 16, 22, 31, 8), D("14.20"), b""), (None,) * 7]
    df = spark.createDataFrame(rows, "i int, l long, s string, d date, ts timestamp_ntz, n decimal(9,2), b binary")
    kinds = {"i": t.INT, "l": t.LONG, "s": t.STRING, "d": t.DATE, "ts": t.TIMESTAMP, "n": t.Decimal(9, 2), "b": t.BINARY}
    plain = [{c: None if v is None else lit.cast(v, kinds[c]) for c, v in zip(kinds, r, strict=True)} for r in rows]
    for text in ("identity", "void", "bucket[16]", "truncate[3]", "year", "month", "day", "hour"):
        x = tr.parse_transform(text)
        for c, k in kinds.items():
            try:
                x.check(k)
            except SchemaError:
                continue
            out = [r[0] for r in df.select(x.column(F.col(c), k)).collect()]
            out = [None if v is None else lit.cast(v, x.result_type(k)) if not isinstance(v, int) else v for v in out]
            assert out == [x.value(p[c], k) for p in plain], (text, c)
    assert tr.Transform("truncate", 10).value(-5, t.INT) == -10


def test_specs():
    f = tr.PartitionField(1, 1000, "x", tr.parse_transform("truncate[19]"))
    g = tr.PartitionField(2, 1001, "y", tr.parse_transform("bucket[25]"))
    spec = tr.PartitionSpec((f, g), 3)
    assert tr.PartitionSpec.from_json(spec.to_json()) == spec and spec.last_assigned_field_id == 1001 and tr.UNPARTITIONED.last_assigned_field_id == 1000
    other = tr.PartitionSpec((tr.PartitionField(1, 1005, "x", f.transform), g), 4)
    assert spec.compatible_with(other) and spec != other and not spec.compatible_with(tr.PartitionSpec((f,)))
    s = TableSchema((Field(1, "a", t.STRING), Field(2, "b", t.LONG)))
    assert spec.partition_type(s) == Struct((Field(1000, "x", t.STRING), Field(1001, "y", t.INT)))
    assert str(spec) == "[\n\t1000: x: truncate[19](1)\n\t1001: y: bucket[25](2)\n]" and str(tr.UNPARTITIONED) == "[]"


def test_orders():
    x = {"source-id": 19, "transform": "identity", "direction": "asc", "null-order": "nulls-first"}
    o = tr.SortOrder.from_json({"order-id": 0, "fields": [x, x | {"transform": "bucket[4]", "direction": "desc", "null-order": "nulls-last"}]})
    assert o.order_id == 1 and str(o) == "[\n19 asc nulls-first\nbucket[4](19) desc nulls-last\n]" and tr.SortOrder.from_json(o.to_json()) == o
    assert tr.SortOrder.from_json({"order-id": 7, "fields": []}) == tr.UNSORTED
    assert tr.SortField(1, tr.Transform("void"), "desc").null_order == "nulls-last"
    for bad in ({"direction": "down"}, {"null-order": "nulls"}, {"direction": None}):
        with pytest.raises(SchemaError):
            tr.SortOrder.from_json({"order-id": 1, "fields": [x | bad]})
    with pytest.raises(tr.TransformError):
        tr.SortOrder.from_json({"order-id": 1, "fields": [x | {"transform": "foobar"}]})
