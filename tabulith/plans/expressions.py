"""Filter expressions: building, inverting, binding to a schema, and compiling to Spark columns.

Rows follow SQL's three-valued logic: a comparison with NULL is unknown and keeps no row; NaN equals NaN and is the greatest value, as in Spark.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabulith import types as t
from tabulith.functions.literals import EPOCH, Beyond, cast
from tabulith.schema import TableSchema


class Expression:
    def __and__(self, other: Expression) -> Expression:
        return And(self, other)

    def __or__(self, other: Expression) -> Expression:
        return Or(self, other)

    def __invert__(self) -> Expression:
        return Not(self)


@dataclass(frozen=True)
class AlwaysTrue(Expression):
    pass


@dataclass(frozen=True)
class AlwaysFalse(Expression):
    pass


@dataclass(frozen=True)
class And(Expression):
    left: Expression
    right: Expression


@dataclass(frozen=True)
class Or(Expression):
    left: Expression
    right: Expression


@dataclass(frozen=True)
class Not(Expression):
    child: Expression


#: Each operation and its opposite.
OPPOSITE = {
    "eq": "ne", "ne": "eq", "lt": "ge", "ge": "lt", "gt": "le", "le": "gt", "is_null": "not_null", "not_null": "is_null",
    "is_nan": "not_nan", "not_nan": "is_nan", "in": "not_in", "not_in": "in", "starts_with": "not_starts_with", "not_starts_with": "starts_with",
}
UNARY = frozenset(("is_null", "not_null", "is_nan", "not_nan"))


@dataclass(frozen=True)
class Predicate(Expression):
    op: str
    name: str
    value: object = None  # a tuple for in and not_in


@dataclass(frozen=True)
class Bound(Expression):
    """A predicate on a field of a schema, its value cast to the field's type."""

    op: str
    field: t.Field
    path: str
    value: object = None


def equal(name: str, value: object) -> Expression:
    return Predicate("eq", name, value)


def not_equal(name: str, value: object) -> Expression:
    return Predicate("ne", name, value)


def is_null(name: str) -> Expression:
    return Predicate("is_null", name)


def not_null(name: str) -> Expression:
    return Predicate("not_null", name)


def is_nan(name: str) -> Expression:
    return Predicate("is_nan", name)


def not_nan(name: str) -> Expression:
    return Predicate("not_nan", name)


def is_in(name: str, values) -> Expression:
    return Predicate("in", name, tuple(values))


def not_in(name: str, values) -> Expression:
    return Predicate("not_in", name, tuple(values))


def less(name: str, value: object) -> Expression:
    return Predicate("lt", name, value)


def at_most(name: str, value: object) -> Expression:
    return Predicate("le", name, value)


def greater(name: str, value: object) -> Expression:
    return Predicate("gt", name, value)


def at_least(name: str, value: object) -> Expression:
    return Predicate("ge", name, value)


def starts_with(name: str, value: str) -> Expression:
    return Predicate("starts_with", name, value)


def fold(expr: Expression, leaf: Callable, true: object, false: object, both: Callable, either: Callable) -> object:
    """The result of a tree without Not from those of its leaves."""
    if isinstance(expr, AlwaysTrue):
        return true
    if isinstance(expr, AlwaysFalse):
        return false
    if isinstance(expr, And | Or):
        f = both if isinstance(expr, And) else either
        return f(*(fold(x, leaf, true, false, both, either) for x in (expr.left, expr.right)))
    if isinstance(expr, Not):
        raise ValueError("the tree must be free of Not")
    return leaf(expr)


def invert(expr: Expression) -> Expression:
    """The opposite, without a Not; under three-valued logic both are unknown together."""
    if isinstance(expr, AlwaysTrue):
        return AlwaysFalse()
    if isinstance(expr, AlwaysFalse):
        return AlwaysTrue()
    if isinstance(expr, And):
        return Or(invert(expr.left), invert(expr.right))
    if isinstance(expr, Or):
        return And(invert(expr.left), invert(expr.right))
    if isinstance(expr, Not):
        return rewrite_not(expr.child)
    if isinstance(expr, Predicate):
        return Predicate(OPPOSITE[expr.op], expr.name, expr.value)
    return Bound(OPPOSITE[expr.op], expr.field, expr.path, expr.value)


def rewrite_not(expr: Expression) -> Expression:
    if isinstance(expr, Not):
        return invert(expr.child)
    if isinstance(expr, And):
        return And(rewrite_not(expr.left), rewrite_not(expr.right))
    if isinstance(expr, Or):
        return Or(rewrite_not(expr.left), rewrite_not(expr.right))
    return expr


def _beyond(op: str, value: Beyond, field: t.Field, path: str) -> Expression:
    """A comparison with a value out of the type's range is settled but for NULLs."""
    above = value is Beyond.ABOVE
    holds = op == "ne" or (op in ("lt", "le") and above) or (op in ("gt", "ge") and not above)
    return Bound("not_null", field, path) if holds else AlwaysFalse()


def bind(schema: TableSchema, expr: Expression, case_sensitive: bool = True) -> Expression:
    """Names become fields and values become values of their types. The tree is freed of Not first. Binding twice is an error."""
    expr = rewrite_not(expr)

    def leaf(p: Expression) -> Expression:
        if isinstance(p, Bound):
            raise ValueError("the expression is bound already")
        field = schema.find(p.name, case_sensitive)
        path = schema.column_path(field.id)
        if p.op in UNARY:
            if p.op in ("is_nan", "not_nan") and field.type not in (t.FLOAT, t.DOUBLE):
                return AlwaysFalse() if p.op == "is_nan" else Bound("not_null", field, path)
            if field.required and p.op in ("is_null", "not_null") and path.count("`") == 2:
                return AlwaysFalse() if p.op == "is_null" else AlwaysTrue()
            return Bound(p.op, field, path)
        if p.op in ("in", "not_in"):
            values = tuple(dict.fromkeys(v for v in (cast(x, field.type) for x in p.value) if not isinstance(v, Beyond)))
            if not values:
                return AlwaysFalse() if p.op == "in" else Bound("not_null", field, path)
            return Bound(p.op, field, path, values)
        if p.op.endswith("starts_with"):
            if field.type != t.STRING or not isinstance(p.value, str):
                raise ValueError("starts_with needs a text column and a text")
            return Bound(p.op, field, path, p.value)
        if p.value is None:
            raise ValueError("use is_null to look for NULL")
        value = cast(p.value, field.type)
        return _beyond(p.op, value, field, path) if isinstance(value, Beyond) else Bound(p.op, field, path, value)

    return fold(expr, leaf, AlwaysTrue(), AlwaysFalse(), And, Or)


def spark_literal(value: object, kind: t.Type) -> Column:
    if kind == t.DATE:
        return F.lit(EPOCH.date() + timedelta(days=value)) if -719162 <= value <= 2932896 else F.date_add(F.lit(date(1970, 1, 1)), F.lit(value))
    if kind == t.TIMESTAMP:
        return F.lit((EPOCH + timedelta(microseconds=value)).isoformat()).cast("timestamp_ntz")
    if kind == t.TIMESTAMPTZ:
        return F.timestamp_micros(F.lit(value).cast("long"))
    if isinstance(kind, t.Fixed) or kind == t.BINARY:
        return F.lit(bytearray(value))
    return F.lit(value).cast(t.to_spark(kind))


def to_column(expr: Expression, column: Callable[[Bound], Column] | None = None) -> Column:
    """A bound tree as a Spark condition. Catalyst pushes it to the scan."""
    column = column or (lambda b: F.col(b.path))

    def leaf(b: Bound) -> Column:
        c = column(b)
        lit = lambda v: spark_literal(v, b.field.type)
        match b.op:
            case "eq":
                return c == lit(b.value)
            case "ne":
                return c != lit(b.value)
            case "lt":
                return c < lit(b.value)
            case "le":
                return c <= lit(b.value)
            case "gt":
                return c > lit(b.value)
            case "ge":
                return c >= lit(b.value)
            case "is_null":
                return c.isNull()
            case "not_null":
                return c.isNotNull()
            case "is_nan":
                return F.isnan(c)
            case "not_nan":
                return c.isNotNull() & ~F.isnan(c)
            case "in":
                return c.isin([lit(v) for v in b.value])
            case "not_in":
                return ~c.isin([lit(v) for v in b.value])
            case "starts_with":
                return c.startswith(b.value)
            case _:
                return ~c.startswith(b.value)

    return fold(expr, leaf, F.lit(True), F.lit(False), lambda a, b: a & b, lambda a, b: a | b)

