"""Avro object container files: reading, writing, and joining by copying blocks."""

from __future__ import annotations

import bz2
import io
import json
import lzma
import os
import struct
import zlib
from collections.abc import Callable, Iterator, Sequence

MAGIC = b"Obj\x01"


class AvroError(ValueError):
    """The data isn't an Avro container or has a part that isn't supported."""


def _read_long(f) -> int:
    n = shift = 0
    while True:
        b = f.read(1)
        if not b:
            raise EOFError
        n |= (b[0] & 0x7F) << shift
        if b[0] < 0x80:
            return (n >> 1) ^ -(n & 1)
        shift += 7


def _long(n: int) -> bytes:
    n = n << 1 if n >= 0 else (-n << 1) - 1
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _snappy(data: bytes) -> bytes:
    import pyarrow as pa

    body, n, shift, at = data[:-4], 0, 0, 0
    while True:  # the size stands first
        b = body[at]
        n |= (b & 0x7F) << shift
        at += 1
        shift += 7
        if b < 0x80:
            break
    return pa.decompress(body, n, codec="snappy", asbytes=True)


def _zstd(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompressobj().decompress(data)


UNPACK: dict[str, Callable[[bytes], bytes]] = {"null": bytes, "deflate": lambda b: zlib.decompress(b, -15), "snappy": _snappy, "zstandard": _zstd, "bzip2": bz2.decompress, "xz": lzma.decompress}


def _deflate(data: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, -15)
    return c.compress(data) + c.flush()


PACK: dict[str, Callable[[bytes], bytes]] = {"null": bytes, "deflate": _deflate}


def _named(schema: object, names: dict) -> None:
    if isinstance(schema, list):
        for s in schema:
            _named(s, names)
    elif isinstance(schema, dict):
        if schema.get("type") in ("record", "fixed", "enum"):
            names[schema["name"]] = schema
        for f in schema.get("fields", ()):
            _named(f["type"], names)
        for k in ("items", "values"):
            if k in schema:
                _named(schema[k], names)
        if isinstance(schema.get("type"), dict | list):
            _named(schema["type"], names)


def _is_map(schema: dict) -> bool:
    """Whether an array of key-value records stands for a map."""
    items = schema.get("items")
    return schema.get("logicalType") == "map" or (isinstance(items, dict) and [f["name"] for f in items.get("fields", ())] == ["key", "value"])


def decoder(schema: object, names: dict | None = None) -> Callable:
    """A function from a stream to the next value of the schema. Arrays of key-value records give dicts."""
    if names is None:
        _named(schema, names := {})
    if isinstance(schema, str) and schema in names:
        schema = names[schema]
    if isinstance(schema, list):
        kinds = [decoder(s, names) for s in schema]
        return lambda f: kinds[_read_long(f)](f)
    kind = schema["type"] if isinstance(schema, dict) else schema
    if isinstance(kind, dict | list):
        return decoder(kind, names)
    if kind == "record":
        parts = [(x["name"], decoder(x["type"], names)) for x in schema["fields"]]
        return lambda f: {n: d(f) for n, d in parts}
    if kind in ("array", "map"):
        item = decoder(schema["items" if kind == "array" else "values"], names)
        text = decoder("string")
        pair = (lambda f: (text(f), item(f))) if kind == "map" else item
        as_map = kind == "array" and _is_map(schema)

        def read(f) -> object:
            out = []
            while n := _read_long(f):
                if n < 0:
                    n = -n
                    _read_long(f)
                out += [pair(f) for _ in range(n)]
            return {x["key"]: x["value"] for x in out} if as_map else dict(out) if kind == "map" else out

        return read
    if kind == "fixed":
        size = schema["size"]
        return lambda f: f.read(size)
    if kind == "enum":
        symbols = schema["symbols"]
        return lambda f: symbols[_read_long(f)]
    simple: dict[str, Callable] = {
        "null": lambda f: None,
        "boolean": lambda f: f.read(1) != b"\0",
        "int": _read_long,
        "long": _read_long,
        "float": lambda f: struct.unpack("<f", f.read(4))[0],
        "double": lambda f: struct.unpack("<d", f.read(8))[0],
        "bytes": lambda f: f.read(_read_long(f)),
        "string": lambda f: f.read(_read_long(f)).decode(),
    }
    if kind not in simple:
        raise AvroError(f"unknown type {kind!r}")
    return simple[kind]


def encoder(schema: object, names: dict | None = None) -> Callable[[object], bytes]:
    if names is None:
        _named(schema, names := {})
    if isinstance(schema, str) and schema in names:
        schema = names[schema]
    if isinstance(schema, list):  # null and one other type
        other = next(i for i, s in enumerate(schema) if s != "null")
        e = encoder(schema[other], names)
        return lambda v: _long(schema.index("null")) if v is None else _long(other) + e(v)
    kind = schema["type"] if isinstance(schema, dict) else schema
    if isinstance(kind, dict | list):
        return encoder(kind, names)
    if kind == "record":
        parts = [(x["name"], encoder(x["type"], names)) for x in schema["fields"]]
        return lambda v: b"".join(e(v.get(n)) for n, e in parts)
    if kind == "array":
        e, as_map = encoder(schema["items"], names), _is_map(schema)

        def write(v: object) -> bytes:
            items = [{"key": k, "value": x} for k, x in v.items()] if as_map and isinstance(v, dict) else v
            return (_long(len(items)) + b"".join(map(e, items)) if items else b"") + b"\0"

        return write
    if kind == "map":
        e = encoder(schema["values"], names)
        return lambda v: (_long(len(v)) + b"".join(encoder("string")(k) + e(x) for k, x in v.items()) if v else b"") + b"\0"
    if kind == "fixed":
        return bytes
    simple: dict[str, Callable[[object], bytes]] = {
        "null": lambda v: b"",
        "boolean": lambda v: b"\1" if v else b"\0",
        "int": _long,
        "long": _long,
        "float": lambda v: struct.pack("<f", v),
        "double": lambda v: struct.pack("<d", v),
        "bytes": lambda v: _long(len(v)) + bytes(v),
        "string": lambda v: _long(len(b := v.encode())) + b,
    }
    if kind not in simple:
        raise AvroError(f"unknown type {kind!r}")
    return simple[kind]


_META = decoder({"type": "map", "values": "bytes"})


def read_header(f) -> tuple[dict[str, bytes], bytes]:
    """Metadata and sync marker; the stream then stands at the first block."""
    if f.read(4) != MAGIC:
        raise AvroError("not an Avro object container file")
    return _META(f), f.read(16)


def blocks(f, sync: bytes) -> Iterator[tuple[int, bytes]]:
    """(number of records, encoded block) of each block."""
    while True:
        try:
            n = _read_long(f)
        except EOFError:
            return
        data = f.read(_read_long(f))
        if f.read(16) != sync:
            raise AvroError("a block doesn't end with the file's marker")
        yield n, data


def read(data: bytes) -> tuple[dict[str, str], list[dict]]:
    """(metadata, records) of a whole file."""
    f = io.BytesIO(data)
    meta, sync = read_header(f)
    codec = meta.get("avro.codec", b"null").decode()
    if codec not in UNPACK:
        raise AvroError(f"codec {codec} isn't supported")
    one = decoder(json.loads(meta["avro.schema"]))
    out = []
    for n, block in blocks(f, sync):
        b = io.BytesIO(UNPACK[codec](block))
        out += [one(b) for _ in range(n)]
    return {k: v.decode("utf-8", "replace") for k, v in meta.items()}, out


def packer(schema: object, meta: dict[str, str] | None = None, codec: str = "null") -> Callable[[Sequence[dict]], bytes]:
    """A function from records to a container of one block; the header is made once."""
    head = {"avro.schema": json.dumps(schema).encode(), "avro.codec": codec.encode()} | {k: v.encode() for k, v in (meta or {}).items()}
    start, one = MAGIC + encoder({"type": "map", "values": "bytes"})(head), encoder(schema)

    def pack(records: Sequence[dict]) -> bytes:
        sync, data = os.urandom(16), PACK[codec](b"".join(map(one, records)))
        return b"".join((start, sync, _long(len(records)), _long(len(data)), data, sync) if records else (start, sync))

    return pack


def write(schema: object, records: Sequence[dict], meta: dict[str, str] | None = None, codec: str = "deflate", per_block: int = 1000) -> bytes:
    head = {"avro.schema": json.dumps(schema).encode(), "avro.codec": codec.encode()} | {k: v.encode() for k, v in (meta or {}).items()}
    sync, one = os.urandom(16), encoder(schema)
    out = [MAGIC, encoder({"type": "map", "values": "bytes"})(head), sync]
    for a in range(0, len(records), per_block):
        part = records[a : a + per_block]
        data = PACK[codec](b"".join(map(one, part)))
        out += [_long(len(part)), _long(len(data)), data, sync]
    return b"".join(out)


def join(files: Sequence[bytes]) -> bytes:
    """One file from the blocks of several that have the same schema, codec and metadata; see ``join_counted``."""
    return join_counted(files)[0]


def join_counted(files: Sequence[bytes]) -> tuple[bytes, int, int]:
    """(file, blocks, records): one file from the blocks of several that have the same schema, codec and metadata. Blocks are copied as they are encoded and only
    the markers between them rewritten; then the new file's header, blocks and records are compared with those of the old ones. Entries of manifests that
    inherit a sequence number keep their meaning only beside entries of the same one."""
    first: bytes | None = None
    sync, out, blocks_, count = os.urandom(16), [], 0, 0
    for data in files:
        f = io.BytesIO(data)
        meta, own = read_header(f)
        head = data[len(MAGIC) : f.tell() - 16]
        if first is None:
            first, first_meta = head, meta
            out += [MAGIC, head, sync]
        elif head != first and meta != first_meta:
            raise AvroError("the files' schemas, codecs or metadata differ")
        for n, block in blocks(f, own):
            out += [_long(n), _long(len(block)), block, sync]
            blocks_ += 1
            count += n
    res = b"".join(out)
    f = io.BytesIO(res)
    meta, own = read_header(f)
    got = [n for n, _ in blocks(f, own)]
    if (len(got), sum(got)) != (blocks_, count) or meta != first_meta:
        raise AvroError("the joined file doesn't hold what the old ones do")
    return res, blocks_, count
