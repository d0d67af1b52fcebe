"""Deeply nested records to flat tables by columnar shredding.

Each leaf path of a record tree becomes a column of (value, repetition level, definition level). The repetition level says at
which repeated ancestor an entry starts anew, the definition level how much of its path is there. The tables of the repeated
ancestors are rebuilt from these level sequences alone.

A shape is a dict of fields: ``None`` for a leaf, a dict for an object, a list with one shape for a repeated part. Every part is
optional. A repeated part has three definition steps (the list is there, a place is there, the place isn't null), an object and
a leaf one each.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WRAPPERS = frozenset(("array", "bytes", "boolean", "int", "long"))  # fixed values: one-key union wrappers


@dataclass
class Leaf:
    path: tuple[str, ...]
    lists: tuple[tuple[str, ...], ...]  # the paths of the repeated ancestors
    steps: tuple[int, ...]  # the definition level at which a place of each of them is there
    top: int  # the definition level of a value
    values: list = field(default_factory=list)
    rep: list[int] = field(default_factory=list)
    deep: list[int] = field(default_factory=list)


def leaves(shape: dict, path: tuple[str, ...] = (), lists: tuple = (), steps: tuple = (), level: int = 0) -> Iterator[Leaf]:
    for name, kind in shape.items():
        own, at, here = (*path, name), level + 1, kind
        mine, marks = lists, steps
        if isinstance(kind, list):
            mine, marks, at, here = (*lists, own), (*steps, level + 2), level + 3, kind[0]
        if isinstance(here, dict):
            yield from leaves(here, own, mine, marks, at)
        else:
            yield Leaf(own, mine, marks, at)


def unwrap(value: object) -> object:
    """Without union wrappers: an object whose only key names a type stands for its value."""
    while isinstance(value, dict) and len(value) == 1 and (k := next(iter(value))) in WRAPPERS:
        value = value[k]
    return value


class Shredder:
    def __init__(self, shape: dict) -> None:
        self.shape = shape
        self.columns = list(leaves(shape))
        self.tree = self._bind(shape, iter(self.columns))

    def _bind(self, shape: dict, cols: Iterator[Leaf]) -> list:
        out = []
        for name, kind in shape.items():
            repeated = isinstance(kind, list)
            here = kind[0] if repeated else kind
            sub = self._bind(here, cols) if isinstance(here, dict) else next(cols)
            out.append((name, repeated, sub, self._all(sub)))
        return out

    def _all(self, sub: list | Leaf) -> list[Leaf]:
        return [sub] if isinstance(sub, Leaf) else [x for _, _, _, xs in sub for x in xs]

    def add(self, record: object) -> None:
        """Append a record; what isn't an object is an empty one."""
        self._object(self.tree, record if isinstance(record, dict) else {}, 0, 0, 0)

    def _object(self, tree: list, value: dict, rep: int, depth: int, level: int) -> None:
        for name, repeated, sub, cols in tree:
            v = unwrap(value.get(name))
            if v is None:
                self._stop(cols, rep, level)
            elif not repeated:
                self._one(sub, cols, v, rep, depth, level + 1)
            else:
                items = v if isinstance(v, list) else [v]  # a lone object stands for an array of one
                if not items:
                    self._stop(cols, rep, level + 1)
                for k, x in enumerate(items):
                    x = unwrap(x)
                    r = rep if k == 0 else depth + 1
                    if x is None:
                        self._stop(cols, r, level + 2)
                    else:
                        self._one(sub, cols, x, r, depth + 1, level + 3)

    def _one(self, sub: list | Leaf, cols: list[Leaf], v: object, rep: int, depth: int, level: int) -> None:
        if isinstance(sub, Leaf):
            sub.values.append(v)
            sub.rep.append(rep)
            sub.deep.append(level)
        elif isinstance(v, dict):
            self._object(sub, v, rep, depth, level)
        else:  # a scalar where an object is due is no object
            self._stop(cols, rep, level - 1)

    def _stop(self, cols: list[Leaf], rep: int, level: int) -> None:
        for c in cols:
            c.values.append(None)
            c.rep.append(rep)
            c.deep.append(level)


def _running(starts: np.ndarray, counted: np.ndarray) -> np.ndarray:
    """Number of counted entries so far since the last start, less one."""
    total = np.cumsum(counted)
    base = np.where(starts, total - counted, 0)
    return total - np.maximum.accumulate(base) - 1


def assemble(columns: Sequence[Leaf], ancestor: tuple[str, ...] = ()) -> pd.DataFrame:
    """The table of a repeated ancestor (``()``: of the records) from the level sequences of the leaves directly below it.

    Columns: ``record`` (position of the record), ``pos_1 .. pos_k`` (places in the k nested lists; they count null places too),
    ``present`` (the place isn't null) and a column per leaf, named by its path below the ancestor, joined by ``_``. A place
    makes a row whether or not it is null.
    """
    out = None
    for c in columns:
        if (c.lists[-1] if c.lists else ()) != ancestor:
            continue
        k = len(c.lists)
        rep, deep = np.asarray(c.rep, dtype=np.int32), np.asarray(c.deep, dtype=np.int32)
        if out is None:
            there = deep >= c.steps[-1] if k else np.ones(len(rep), bool)
            data = {"record": (np.cumsum(rep == 0) - 1)[there]}
            for i in range(k):
                data[f"pos_{i + 1}"] = _running(rep <= i, (rep <= i + 1) & (deep >= c.steps[i]))[there]
            data["present"] = (deep > c.steps[-1])[there] if k else there
            out = data
        values = np.empty(len(c.values), dtype=object)
        values[:] = c.values
        out["_".join(c.path[len(ancestor) :])] = values[deep >= c.steps[-1] if k else slice(None)]
    return pd.DataFrame(out if out is not None else {"record": []})


def parse_record(text: str | None) -> object:
    """A JSON text, however often it was encoded; None for what can't be read."""
    try:
        x = json.loads(text) if text else None
        while isinstance(x, str):
            x = json.loads(x)
        return x
    except (ValueError, RecursionError):
        return None


def pruned(shape: dict, ancestor: tuple[str, ...], wanted: Iterable[str]) -> dict:
    """The part of a shape that the table of ``ancestor`` needs: the way to it, and of what lies directly below it the ``wanted`` leaves (one at least, to carry
    the levels)."""
    if ancestor:
        name, kind = ancestor[0], shape[ancestor[0]]
        inner = pruned(kind[0] if isinstance(kind, list) else kind, ancestor[1:], wanted)
        return {name: [inner] if isinstance(kind, list) else inner}
    names = set(wanted)

    def keep(part: dict, prefix: str) -> dict:
        out = {}
        for n, k in part.items():
            if isinstance(k, dict):
                if inner := keep(k, f"{prefix}{n}_"):
                    out[n] = inner
            elif k is None and prefix + n in names:
                out[n] = None
        return out

    def first(part: dict) -> dict:
        for n, k in part.items():
            if k is None:
                return {n: None}
            if isinstance(k, dict) and (inner := first(k)):
                return {n: inner}
        return {}

    return keep(shape, "") or first(shape) or shape


def shred_json(df: DataFrame, text: str, keys: Sequence[str], shape: dict, ancestor: tuple[str, ...], columns: dict[str, tuple[str, Callable[[object], object], str]], null_places: bool = False) -> DataFrame:
    """The flat table of one repeated ancestor of the JSON in ``text``: ``keys``, ``pos_1..pos_k`` and ``columns``.

    ``columns`` maps an output name to (leaf, function of its value or None, type of the result). Keys and positions link a child to
    its parent: the parent's row has the same ones but for the last position. Null places count but make no row unless
    ``null_places``. Unreadable texts, and empty ones, make no rows below the records; the table of the records has them with
    NULLs. Records that are repeated give equal rows, of which one is kept.
    """
    depth = sum(1 for _ in _lists(shape, ancestor))
    kinds = {k: df.schema[k].dataType for k in keys}
    out = T.StructType([T.StructField(k, kinds[k]) for k in keys] + [T.StructField(f"pos_{i + 1}", T.IntegerType()) for i in range(depth)])
    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in out] + [f"`{n}` {t}" for n, (_, _, t) in columns.items()])

    part = pruned(shape, ancestor, [leaf for leaf, _, _ in columns.values()]) if isinstance(_at(shape, ancestor), dict) else shape

    arrow = {"int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}

    def shred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for d in batches:  # keys stay in Arrow's form: pandas would turn longs with a NULL among them into doubles
            s = Shredder(part)
            for x in d.column(len(keys)).to_pylist():
                s.add(parse_record(x))
            t = assemble(s.columns, ancestor)
            t = t if null_places else t[t["present"].astype(bool)]
            at = pa.array(t["record"].to_numpy(dtype=np.int64))
            cols = [d.column(i).take(at) for i in range(len(keys))] + [pa.array(t[f"pos_{i + 1}"].to_numpy(dtype=np.int32)) for i in range(depth)]
            for leaf, f, kind in columns.values():
                cols.append(pa.array([f(v) for v in t[leaf]], type=arrow.get(kind, pa.string())))
            yield from pa.Table.from_arrays(cols, names=names).to_batches(max_chunksize=10_000)

    names = [*keys, *[f"pos_{i + 1}" for i in range(depth)], *columns]
    # copies of a record that are written alike go before they are parsed, others after
    return df.select(*keys, text).distinct().mapInArrow(shred, ddl).distinct()


def _at(shape: dict, ancestor: tuple[str, ...]) -> object:
    """The shape of one entry of a repeated part."""
    here: object = shape
    for name in ancestor:
        here = here[name]
        here = here[0] if isinstance(here, list) else here
    return here


def _lists(shape: dict, ancestor: tuple[str, ...]) -> Iterator[str]:
    here: object = shape
    for name in ancestor:
        here = here[name]
        if isinstance(here, list):
            yield name
            here = here[0]


def shred_columns(df: DataFrame, keys: Sequence[str], array: str, prefix: str = "") -> DataFrame:
    """The child table of a typed ``array<struct>`` column: ``keys, pos`` and the struct's fields. Null places count but make no
    row. The column is shredded already (Parquet keeps it by levels), so its places are read off with a position."""
    kind = df.schema[array].dataType.elementType
    t = df.select(*keys, F.posexplode(array).alias("pos", "_e")).where("_e IS NOT NULL")
    return t.select(*keys, "pos", *[F.col(f"_e.{f.name}").alias(prefix + f.name) for f in kind.fields])
