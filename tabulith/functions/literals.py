"""Values of the table types: casts at bind time, single-value bytes, and text keys in the values' order."""

from __future__ import annotations

import math
import re
import struct
import uuid as _uuid
from datetime import date, datetime, timedelta, timezone
from datetime import time as day_time
from decimal import ROUND_HALF_UP, InvalidOperation
from decimal import Decimal as Dec
from enum import Enum

from tabulith import types as t


class CastError(ValueError):
    """The value can't become one of that type."""


class Beyond(Enum):
    """Stands for a value outside the range of the type that it was cast to."""

    ABOVE = "above the greatest value"
    BELOW = "below the least value"


EPOCH = datetime(1970, 1, 1)
RANGE = {"int": (-(1 << 31), (1 << 31) - 1), "long": (-(1 << 63), (1 << 63) - 1)}
FLOAT_MAX = 3.4028234663852886e38
# Spellings of truth values.
TRUE = ("1", "t", "T", "true", "TRUE", "True")
FALSE = ("0", "f", "F", "false", "FALSE", "False")


def native_type(value: object) -> t.Type:
    """The type that a Python value has before any cast."""
    if isinstance(value, bool):
        return t.BOOLEAN
    if isinstance(value, int):
        return t.INT if RANGE["int"][0] <= value <= RANGE["int"][1] else t.LONG
    if isinstance(value, float):
        return t.DOUBLE
    if isinstance(value, str):
        return t.STRING
    if isinstance(value, bytes | bytearray):
        return t.BINARY
    if isinstance(value, Dec):
        return t.Decimal(38, max(0, -value.as_tuple().exponent))
    if isinstance(value, _uuid.UUID):
        return t.UUID
    if isinstance(value, datetime):
        return t.TIMESTAMPTZ if value.tzinfo else t.TIMESTAMP
    if isinstance(value, date):
        return t.DATE
    if isinstance(value, day_time):
        return t.TIME
    raise CastError(f"{value!r} has no table type")


def micros(value: datetime) -> int:
    if value.tzinfo:
        value = value.astimezone(timezone.utc).replace(tzinfo=None)
    return (value - EPOCH) // timedelta(microseconds=1)


def cast(value: object, to: t.Type, source: t.Type | None = None) -> object:
    """The value as one of type ``to``, or a ``Beyond``. Dates are days, times and timestamps microseconds, as in the files.

    ``source`` is the type of a value that is given in this form already; Python's own dates and times are understood too.
    """
    if isinstance(value, Beyond):
        raise CastError("a value out of range can't be cast again")
    if isinstance(value, datetime):
        value, source = micros(value), source or (t.TIMESTAMPTZ if value.tzinfo else t.TIMESTAMP)
    elif isinstance(value, date):
        value, source = (value - EPOCH.date()).days, source or t.DATE
    elif isinstance(value, day_time):
        value, source = ((value.hour * 60 + value.minute) * 60 + value.second) * 1_000_000 + value.microsecond, source or t.TIME
    source = source or native_type(value)
    kind = source.name if isinstance(source, t.Primitive) else type(source).__name__
    if kind == "string":
        return _from_text(value, to)
    if source == to and kind not in ("Decimal",):
        return value
    if kind in ("int", "long"):
        if to in (t.INT, t.LONG):
            return _in_range(value, to.name)
        if to in (t.FLOAT, t.DOUBLE):
            return float(value)
        if to == t.DATE:
            return _in_range(value, "int")
        if to == t.TIME:
            return value
        if isinstance(to, t.Decimal):
            return _decimal(Dec(value), to)
    elif kind in ("float", "double"):
        if to == t.DOUBLE:
            return value
        if to == t.FLOAT:
            return _float(value)
        if isinstance(to, t.Decimal) and math.isfinite(value):
            return _decimal(Dec(repr(_single(value)) if kind == "float" else repr(value)), to)
    elif kind in ("binary", "Fixed"):
        if to == t.BINARY:
            return bytes(value)
        if isinstance(to, t.Fixed) and len(value) == to.length:
            return bytes(value)
    elif kind in ("timestamp", "timestamptz"):
        if to == t.DATE:
            return value // 86_400_000_000
        if to in (t.TIMESTAMP, t.TIMESTAMPTZ):
            return value
    elif kind == "Decimal" and isinstance(to, t.Decimal) and -value.as_tuple().exponent <= to.scale:
        return _decimal(value, to)
    raise CastError(f"{source} can't be cast to {to}")


def _in_range(value: int, kind: str) -> object:
    lo, hi = RANGE[kind]
    return Beyond.ABOVE if value > hi else Beyond.BELOW if value < lo else value


def _single(value: float) -> float:
    """The shortest decimal of the nearest single-precision value."""
    x = struct.unpack("<f", struct.pack("<f", value))[0]
    for digits in range(6, 10):
        if struct.unpack("<f", struct.pack("<f", float(f"{x:.{digits}g}")))[0] == x:
            return float(f"{x:.{digits}g}")
    return x


def _float(value: float) -> object:
    if math.isfinite(value) and abs(value) > FLOAT_MAX:
        return Beyond.ABOVE if value > 0 else Beyond.BELOW
    return struct.unpack("<f", struct.pack("<f", value))[0]


def _decimal(value: Dec, to: t.Decimal) -> Dec:
    try:
        return value.quantize(Dec(1).scaleb(-to.scale), rounding=ROUND_HALF_UP)
    except InvalidOperation as e:
        raise CastError(f"{value} doesn't fit {to}") from e


def _from_text(text: str, to: t.Type) -> object:
    try:
        if to == t.STRING:
            return text
        if to in (t.INT, t.LONG):
            if re.fullmatch(r"[+-]?\d+", text):
                return _in_range(int(text), to.name)
        elif to in (t.FLOAT, t.DOUBLE):
            x = float(text)
            if math.isinf(x) and "inf" not in text.lower():
                return Beyond.ABOVE if x > 0 else Beyond.BELOW
            return _float(x) if to == t.FLOAT else x
        elif to == t.DATE:
            if re.fullmatch(r"\d{4}-\d\d-\d\d", text):
                return (date.fromisoformat(text) - EPOCH.date()).days
        elif to == t.TIME:
            if m := re.fullmatch(r"(\d\d):(\d\d):(\d\d)(?:\.(\d{1,6}))?", text):
                h, mi, s = (int(x) for x in m.groups()[:3])
                day_time(h, mi, s)
                return ((h * 60 + mi) * 60 + s) * 1_000_000 + int((m[4] or "0").ljust(6, "0"))
        elif to == t.TIMESTAMP:
            if re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{6}", text):
                return micros(datetime.fromisoformat(text))
        elif to == t.TIMESTAMPTZ:
            if re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{6}[+-]\d\d:\d\d", text):
                return micros(datetime.fromisoformat(text))
        elif to == t.UUID:
            return str(_uuid.UUID(text))
        elif to == t.BOOLEAN:
            if text in TRUE + FALSE:
                return text in TRUE
        elif isinstance(to, t.Decimal):
            x = Dec(text)
            if x.is_finite():
                return _decimal(x, to)
    except (ValueError, InvalidOperation) as e:
        raise CastError(f"{text!r} isn't a {to}") from e
    raise CastError(f"{text!r} isn't a {to}")


# --- single values as bytes -------------------------------------------------------------------------------------------------

_PACK = {"int": "<i", "long": "<q", "float": "<f", "double": "<d", "date": "<i", "time": "<q", "timestamp": "<q", "timestamptz": "<q"}


def to_bytes(value: object, kind: t.Type) -> bytes:
    if isinstance(kind, t.Decimal):
        n = int(value.scaleb(kind.scale))
        return n.to_bytes((n.bit_length() if n >= 0 else (n + 1).bit_length()) // 8 + 1, "big", signed=True) if n else b""
    if isinstance(kind, t.Fixed) or kind == t.BINARY:
        return bytes(value)
    if kind == t.BOOLEAN:
        return b"\1" if value else b"\0"
    if kind == t.STRING:
        return value.encode()
    if kind == t.UUID:
        return _uuid.UUID(str(value)).bytes
    return struct.pack(_PACK[kind.name], value)


def from_bytes(data: bytes | None, kind: t.Type) -> object:
    """The value, None for None. Bounds written before an int became a long, or a float a double, are understood."""
    if data is None:
        return None
    data = bytes(data)
    if isinstance(kind, t.Decimal):
        return Dec(int.from_bytes(data, "big", signed=True)).scaleb(-kind.scale)
    if isinstance(kind, t.Fixed) or kind == t.BINARY:
        return data
    if kind == t.BOOLEAN:
        return data != b"\0"
    if kind == t.STRING:
        return data.decode("utf-8", "surrogateescape")
    if kind == t.UUID:
        return str(_uuid.UUID(bytes=data))
    if kind.name in ("float", "double"):
        return struct.unpack("<f" if len(data) == 4 else "<d", data)[0]
    return int.from_bytes(data, "little", signed=True)


def order_key(value: object, kind: t.Type) -> str | bytes:
    """A text (bytes for text and binary types) that sorts as the value does; ``plans.pruning`` makes the same of bounds in the JVM."""
    if isinstance(kind, t.Fixed) or kind in (t.BINARY, t.STRING, t.UUID):
        return to_bytes(value, kind)
    if kind == t.BOOLEAN:
        return "1" if value else "0"
    if kind in (t.FLOAT, t.DOUBLE):
        h = struct.pack(">f" if kind == t.FLOAT else ">d", value + 0.0).hex().upper()
        return "0" + h.translate(str.maketrans("0123456789ABCDEF", "FEDCBA9876543210")) if h[0] in "89ABCDEF" else "1" + h
    n = int(value.scaleb(kind.scale)) if isinstance(kind, t.Decimal) else int(value)
    return ("0" if n < 0 else "1") + (n % (1 << 128)).to_bytes(16, "big").hex().upper()
