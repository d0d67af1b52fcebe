"""Skipping files by their statistics: might any row match?

The same rules twice: over a dict of one file's statistics, and as a Spark condition over a table of files, which needs no Python. Bounds may have
been cut short, so they limit values but aren't values. What isn't known never skips a file.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabulith import types as t
from tabulith.functions.literals import from_bytes, order_key
from tabulith.functions.transforms import PartitionSpec
from tabulith.plans.expressions import AlwaysFalse, AlwaysTrue, And, Bound, Expression, Or, fold
from tabulith.schema import TableSchema


def might_match(expr: Expression, stats: dict) -> bool:
    """``stats``: record_count, value_counts, null_value_counts, nan_value_counts, lower_bounds, upper_bounds, the latter five by field id."""
    n = stats.get("record_count")
    if n == 0:
        return False
    if n is not None and n < 0:
        return True

    def get(what: str, i: int) -> object:
        return (stats.get(what) or {}).get(i)

    def leaf(b: Bound) -> bool:
        i, kind = b.field.id, b.field.type
        values, nulls, nans = (get(x, i) for x in ("value_counts", "null_value_counts", "nan_value_counts"))
        if b.op == "is_null":
            return nulls is None or nulls > 0
        only_nulls = values is not None and nulls is not None and values > 0 and values == nulls
        if only_nulls:
            return False
        if b.op == "is_nan":
            return nans is None or nans > 0
        only_nans = values is not None and nans is not None and values > 0 and nans + (nulls or 0) >= values
        if b.op == "not_nan":
            return not only_nans
        if b.op not in ("eq", "lt", "le", "gt", "ge", "in", "starts_with"):
            return True
        wanted = b.value if isinstance(b.value, tuple) else (b.value,)
        nan = any(isinstance(v, float) and math.isnan(v) for v in wanted)
        if nan or (b.op in ("gt", "ge") and kind in (t.FLOAT, t.DOUBLE) and nans != 0):
            return True  # NaN is the greatest value and in no bound
        if only_nans:
            return False
        lo, hi = (from_bytes(get(x, i), kind) for x in ("lower_bounds", "upper_bounds"))
        lo, hi = (None if isinstance(x, float) and math.isnan(x) else x for x in (lo, hi))
        order = lambda v: order_key(v, kind)
        lo, hi = (None if x is None else order(x) for x in (lo, hi))
        if b.op == "starts_with":
            p = order(b.value)
            return (hi is None or hi >= p) and (lo is None or lo[: len(p)] <= p)
        keys = [order(v) for v in wanted]
        if b.op in ("eq", "in"):
            return any((lo is None or k >= lo) and (hi is None or k <= hi) for k in keys)
        k = keys[0]
        return {"lt": lo is None or lo < k, "le": lo is None or lo <= k, "gt": hi is None or hi > k, "ge": hi is None or hi >= k}[b.op]

    return fold(expr, leaf, True, False, lambda a, b: a and b, lambda a, b: a or b)


def bound_key(c: Column, kind: t.Type) -> Column:
    """Of a single value's bytes the text or bytes that ``literals.order_key`` gives; NULL for NULL, NaN and other lengths than the type's."""
    if isinstance(kind, t.Fixed) or kind in (t.BINARY, t.STRING, t.UUID):
        return c
    if kind == t.BOOLEAN:
        return F.when(c.isNotNull(), F.when(F.hex(c) == "00", "0").otherwise("1"))
    h = F.hex(c)
    if not isinstance(kind, t.Decimal):  # little endian
        pairs = [F.substring(h, 2 * k + 1, 2) for k in range(7, -1, -1)]
        h = F.concat(*pairs)
    negative = F.substring(h, 1, 1) >= "8"
    if kind in (t.FLOAT, t.DOUBLE):
        size, top = (4, "7F800000") if kind == t.FLOAT else (8, "7FF0000000000000")
        h = F.when(h == "8" + "0" * (2 * size - 1), "0" * 2 * size).otherwise(h)
        plain = F.when(negative, F.concat(F.translate(F.substring(h, 1, 1), "89ABCDEF", "01234567"), F.substring(h, 2, 16))).otherwise(h)
        key = F.when(F.substring(h, 1, 1) >= "8", F.concat(F.lit("0"), F.translate(h, "0123456789ABCDEF", "FEDCBA9876543210"))).otherwise(F.concat(F.lit("1"), h))
        return F.when((F.length(c) == size) & (plain <= top), key)
    h = F.when(h == "", "00").otherwise(h)
    return F.when(c.isNotNull(), F.when(negative, F.concat(F.lit("0"), F.lpad(h, 32, "F"))).otherwise(F.concat(F.lit("1"), F.lpad(h, 32, "0"))))


def might_match_column(expr: Expression) -> Column:
    """The condition over columns ``record_count`` and the five maps by field id."""

    def lit(v: object, kind: t.Type) -> Column:
        k = order_key(v, kind)
        return F.lit(bytearray(k)) if isinstance(k, bytes) else F.lit(k)

    def leaf(b: Bound) -> Column:
        i, kind = F.lit(b.field.id), b.field.type
        values, nulls, nans = (F.try_element_at(F.col(x), i) for x in ("value_counts", "null_value_counts", "nan_value_counts"))
        if b.op == "is_null":
            return F.coalesce(nulls > 0, F.lit(True))
        some = ~F.coalesce((values > 0) & (values == nulls), F.lit(False))
        if b.op == "is_nan":
            return some & F.coalesce(nans > 0, F.lit(True))
        numbers = ~F.coalesce((values > 0) & (nans + F.coalesce(nulls, F.lit(0)) >= values), F.lit(False))
        if b.op == "not_nan":
            return some & numbers
        if b.op not in ("eq", "lt", "le", "gt", "ge", "in", "starts_with"):
            return some
        wanted = b.value if isinstance(b.value, tuple) else (b.value,)
        if any(isinstance(v, float) and math.isnan(v) for v in wanted):
            return some
        lo, hi = (bound_key(F.try_element_at(F.col(x), i), kind) for x in ("lower_bounds", "upper_bounds"))
        if b.op in ("eq", "in"):
            hit = F.lit(False)
            for v in wanted:
                k = lit(v, kind)
                hit = hit | (F.coalesce(lo <= k, F.lit(True)) & F.coalesce(hi >= k, F.lit(True)))
        elif b.op == "starts_with":
            p = order_key(b.value, kind)
            hit = F.coalesce(hi >= F.lit(bytearray(p)), F.lit(True)) & F.coalesce(F.substring(lo, 1, len(p)) <= F.lit(bytearray(p)), F.lit(True))
        else:
            k = lit(b.value, kind)
            side = {"lt": lo < k, "le": lo <= k, "gt": hi > k, "ge": hi >= k}[b.op]
            hit = F.coalesce(side, F.lit(True))
        if kind in (t.FLOAT, t.DOUBLE):
            unknown = ~F.coalesce(nans == 0, F.lit(False))
            return some & ((unknown | hit) if b.op in ("gt", "ge") else (numbers & hit))
        return some & hit

    n = F.col("record_count")
    tree = fold(expr, leaf, F.lit(True), F.lit(False), lambda a, b: a & b, lambda a, b: a | b)
    return F.when(n == 0, False).when(n < 0, True).otherwise(tree)


# --- partitions ---------------------------------------------------------------------------------------------------------------


def project(expr: Expression, spec: PartitionSpec, schema: TableSchema) -> Expression:
    """What a row's match implies for its partition values: a tree over the fields of the spec's partition type (by field id). It keeps every
    partition that might hold a match. Predicates that a transform says nothing about become true."""

    def leaf(b: Bound) -> Expression:
        out: Expression = AlwaysTrue()
        for f in spec.by_source(b.field.id):
            implied = _implied(b, f, f.transform.result_type(b.field.type))
            out = implied if isinstance(out, AlwaysTrue) else And(out, implied)
        return out

    def both(a: Expression, b: Expression) -> Expression:
        return b if isinstance(a, AlwaysTrue) else a if isinstance(b, AlwaysTrue) else And(a, b)

    def either(a: Expression, b: Expression) -> Expression:
        return AlwaysTrue() if isinstance(a, AlwaysTrue) or isinstance(b, AlwaysTrue) else Or(a, b)

    return fold(expr, leaf, AlwaysTrue(), AlwaysFalse(), both, either)


def _implied(b: Bound, f, kind: t.Type) -> Expression:
    tr = f.transform
    field = t.Field(f.field_id, f.name, kind)
    make = lambda op, v=None: Bound(op, field, f.name, v)
    if tr.name == "void":
        return AlwaysTrue()
    if b.op in ("is_null", "not_null"):
        return make(b.op)
    if tr.name == "identity":
        return make(b.op, b.value)
    value = lambda v: tr.value(v, b.field.type)
    if b.op == "eq":
        return make("eq", value(b.value))
    if b.op == "in":
        return make("in", tuple(dict.fromkeys(map(value, b.value))))
    if b.op in ("lt", "le", "gt", "ge") and tr.keeps_order:
        return make("le" if b.op in ("lt", "le") else "ge", value(b.value))
    if b.op == "starts_with" and tr.name == "truncate":
        return make("starts_with", b.value[: tr.arg]) if len(b.value) <= tr.arg else make("eq", b.value[: tr.arg])
    return AlwaysTrue()


def partition_condition(expr: Expression, keys: Callable[[int], Column], known: Callable[[int], Column] = lambda i: F.lit(True)) -> Column:
    """A projected tree as a condition on order keys of partition values (``keys`` of a field id; NULL for a NULL value). A value that isn't
    ``known`` may be any."""

    def lit(v: object, kind: t.Type) -> Column:
        k = order_key(v, kind)
        return F.lit(k.hex().upper() if isinstance(k, bytes) else k)

    def leaf(b: Bound) -> Column:
        return F.when(known(b.field.id), test(b)).otherwise(True)

    def test(b: Bound) -> Column:
        c, kind = keys(b.field.id), b.field.type
        match b.op:
            case "is_null":
                return c.isNull()
            case "not_null" | "ne" | "not_in" | "not_nan" | "not_starts_with":
                return c.isNotNull()
            case "eq":
                return c == lit(b.value, kind)
            case "in":
                return c.isin([lit(v, kind) for v in b.value])
            case "starts_with":
                return c.startswith(b.value.encode().hex().upper())
            case "is_nan":
                return c.isNotNull()
        k = lit(b.value, kind)
        return {"lt": c < k, "le": c <= k, "gt": c > k, "ge": c >= k}[b.op]

    return F.coalesce(fold(expr, leaf, F.lit(True), F.lit(False), lambda a, b: a & b, lambda a, b: a | b), F.lit(False))


def summary_condition(expr: Expression, spec: PartitionSpec, summaries: Column) -> Column:
    """A projected tree as a condition on a manifest's partition summaries (array in spec order, NULL or short: unknown)."""
    place = {f.field_id: k for k, f in enumerate(spec.fields)}

    def lit(v: object, kind: t.Type) -> Column:
        k = order_key(v, kind)
        return F.lit(bytearray(k)) if isinstance(k, bytes) else F.lit(k)

    def leaf(b: Bound) -> Column:
        s, kind = F.get(summaries, F.lit(place[b.field.id])), b.field.type
        if b.op == "is_null":
            return F.coalesce(s["contains_null"], F.lit(True))
        lo, hi = bound_key(s["lower_bound"], kind), bound_key(s["upper_bound"], kind)
        if b.op in ("eq", "in"):
            hit = F.lit(False)
            for v in b.value if isinstance(b.value, tuple) else (b.value,):
                hit = hit | (F.coalesce(lo <= lit(v, kind), F.lit(True)) & F.coalesce(hi >= lit(v, kind), F.lit(True)))
            return hit if kind not in (t.FLOAT, t.DOUBLE) else F.lit(True)
        if b.op in ("lt", "le"):
            return F.coalesce(lo <= lit(b.value, kind), F.lit(True))
        if b.op in ("gt", "ge") and kind not in (t.FLOAT, t.DOUBLE):
            return F.coalesce(hi >= lit(b.value, kind), F.lit(True))
        return F.lit(True)

    return fold(expr, leaf, F.lit(True), F.lit(False), lambda a, b: a & b, lambda a, b: a | b)
