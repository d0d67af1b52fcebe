"""Joining Parquet files by copying their encoded column blocks.

Only footers are decoded (Thrift's compact protocol, kept generically, so fields unknown here survive). The pages of each row group
are copied byte by byte; the offsets in its metadata are moved. Page indexes and Bloom filters, whose own contents hold file
positions or lie elsewhere, are left out of the new footer: readers then use the row groups' statistics.
"""

from __future__ import annotations

import struct
from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow.fs as pafs
import pyarrow.parquet as pq

MAGIC = b"PAR1"
# compact protocol type codes, fixed by the format
TRUE, FALSE, BYTE, I16, I32, I64, DOUBLE, BINARY, LIST, SET, MAP, STRUCT = range(1, 13)


class Incompatible(ValueError):
    """The files' schemas differ, or one isn't plain Parquet."""


class _Reader:
    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def varint(self) -> int:
        out = shift = 0
        while True:
            b = self.data[self.at]
            self.at += 1
            out |= (b & 0x7F) << shift
            if b < 0x80:
                return out
            shift += 7

    def zigzag(self) -> int:
        n = self.varint()
        return (n >> 1) ^ -(n & 1)

    def take(self, n: int) -> bytes:
        self.at += n
        return self.data[self.at - n : self.at]

    def value(self, kind: int) -> object:
        if kind in (TRUE, FALSE):  # only inside lists; in structs the type is the value
            return self.take(1)[0]
        if kind == BYTE:
            return self.take(1)[0]
        if kind in (I16, I32, I64):
            return self.zigzag()
        if kind == DOUBLE:
            return self.take(8)
        if kind == BINARY:
            return self.take(self.varint())
        if kind in (LIST, SET):
            head = self.take(1)[0]
            n = head >> 4 if head >> 4 != 15 else self.varint()
            return (head & 15, [self.value(head & 15) for _ in range(n)])
        if kind == MAP:
            n = self.varint()
            if not n:
                return (0, 0, [])
            kinds = self.take(1)[0]
            return (kinds >> 4, kinds & 15, [(self.value(kinds >> 4), self.value(kinds & 15)) for _ in range(n)])
        if kind == STRUCT:
            return self.struct()
        raise Incompatible(f"unknown type {kind} in a footer")

    def struct(self) -> dict[int, tuple[int, object]]:
        out: dict[int, tuple[int, object]] = {}
        last = 0
        while head := self.take(1)[0]:
            last = last + (head >> 4) if head >> 4 else self.zigzag()
            kind = head & 15
            out[last] = (kind, None if kind in (TRUE, FALSE) else self.value(kind))
        return out


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _zigzag(n: int) -> bytes:
    return _varint(n << 1 if n >= 0 else (-n << 1) - 1)


def _write(kind: int, v: object) -> bytes:
    if kind in (TRUE, FALSE, BYTE):
        return bytes([v])
    if kind in (I16, I32, I64):
        return _zigzag(v)
    if kind == DOUBLE:
        return v
    if kind == BINARY:
        return _varint(len(v)) + v
    if kind in (LIST, SET):
        sub, items = v
        head = bytes([len(items) << 4 | sub]) if len(items) < 15 else bytes([0xF0 | sub]) + _varint(len(items))
        return head + b"".join(_write(sub, x) for x in items)
    if kind == MAP:
        a, b, items = v
        return _varint(len(items)) + (bytes([a << 4 | b]) + b"".join(_write(a, x) + _write(b, y) for x, y in items) if items else b"")
    out, last = bytearray(), 0
    for i in sorted(v):
        sub, x = v[i]
        step = i - last
        out += bytes([step << 4 | sub]) if 0 < step < 16 else bytes([sub]) + _zigzag(i)
        last = i
        if sub not in (TRUE, FALSE):
            out += _write(sub, x)
    return bytes(out) + b"\0"


@dataclass
class Footer:
    meta: dict
    size: int  # of the file

    @property
    def schema(self) -> bytes:
        return _write(*self.meta[2])

    @property
    def rows(self) -> int:
        return self.meta[3][1]

    @property
    def groups(self) -> list[dict]:
        return self.meta[4][1][1]


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (pafs.LocalFileSystem(), path)


def read_footer(path: str) -> Footer:
    fs, p = open_fs(path)
    with fs.open_input_file(p) as f:
        size = f.size()
        if size < 12:
            raise Incompatible(f"{path} is too short for Parquet")
        f.seek(size - 8)
        n, magic = struct.unpack("<I4s", f.read(8))
        if magic != MAGIC:
            raise Incompatible(f"{path} isn't plain Parquet")
        f.seek(size - 8 - n)
        return Footer(_Reader(f.read(n)).struct(), size)


def _span(group: dict) -> tuple[int, int]:
    """First byte of a row group's pages and the one after its last."""
    spans = []
    for c in group[1][1][1]:
        m = c[3][1]
        start = m[9][1]
        if 11 in m and m[11][1] > 0:
            start = min(start, m[11][1])
        spans.append((start, start + m[7][1]))
    return min(a for a, _ in spans), max(b for _, b in spans)


def _moved(group: dict, by: int, ordinal: int) -> dict:
    cols = []
    for c in group[1][1][1]:
        m = {k: v for k, v in c[3][1].items() if k not in (14, 15)}
        for k in (9, 10, 11):
            if k in m and m[k][1] > 0:
                m[k] = (m[k][0], m[k][1] + by)
        chunk = {k: v for k, v in c.items() if k not in (1, 4, 5, 6, 7)} | {3: (STRUCT, m)}
        chunk[2] = (I64, 0)
        cols.append(chunk)
    out = group | {1: (LIST, (STRUCT, cols)), 7: (I16, min(ordinal, 32767))}
    if 5 in out:
        out[5] = (I64, out[5][1] + by)
    if ordinal > 32767:
        out.pop(7)
    return out


def join_files(sources: Sequence[str], target: str, buffer: int = 8 << 20) -> dict[str, int]:
    """Write ``target`` from the blocks of ``sources`` (all of one schema) and check it: its schema, number of blocks and rows.

    The file is written under another name and moved when it has been checked, so a failed task leaves no half a file.
    """
    feet = [read_footer(p) for p in sources]
    for p, f in zip(sources, feet, strict=True):
        if f.schema != feet[0].schema:
            raise Incompatible(f"{p} has another schema than {sources[0]}")
    fs, out_path = open_fs(target)
    part = f"{out_path}.{struct.unpack('<Q', __import__('os').urandom(8))[0]:x}.part"
    groups: list[dict] = []
    with fs.open_output_stream(part) as out:
        out.write(MAGIC)
        at = 4
        for path, foot in zip(sources, feet, strict=True):
            src, p = open_fs(path)
            with src.open_input_file(p) as f:
                for g in foot.groups:
                    start, end = _span(g)
                    f.seek(start)
                    left = end - start
                    while left:
                        data = f.read(min(left, buffer))
                        if not data:
                            raise Incompatible(f"{path} ends within a block")
                        out.write(data)
                        left -= len(data)
                    groups.append(_moved(g, at - start, len(groups)))
                    at += end - start
        meta = feet[0].meta | {3: (I64, sum(f.rows for f in feet)), 4: (LIST, (STRUCT, groups))}
        raw = _write(STRUCT, meta)
        out.write(raw + struct.pack("<I", len(raw)) + MAGIC)
    with fs.open_input_file(part) as f:
        got = pq.ParquetFile(f)
        first_fs, first = open_fs(sources[0])
        with first_fs.open_input_file(first) as g:
            same = got.schema.equals(pq.ParquetFile(g).schema)
        if not same or got.metadata.num_rows != sum(f.rows for f in feet) or got.metadata.num_row_groups != sum(len(f.groups) for f in feet):
            fs.delete_file(part)
            raise Incompatible(f"{target} doesn't hold what its sources do")
    size = fs.get_file_info(part).size
    fs.move(part, out_path)
    return {"files": len(sources), "blocks": len(groups), "rows": sum(f.rows for f in feet), "bytes": size}
