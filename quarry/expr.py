"""The query builder: predicates, references, reductions and the query that holds them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from typing import Any

ASC, DESC = "asc", "desc"


@dataclass(frozen=True)
class Ref:
    """A field of the record."""

    name: str


@dataclass(frozen=True)
class Out:
    """An output column of an aggregate."""

    name: str


@dataclass(frozen=True)
class Leaf:
    op: str
    left: Any
    value: Any = None


@dataclass(frozen=True)
class Every:
    parts: tuple


@dataclass(frozen=True)
class Some:
    parts: tuple


@dataclass(frozen=True)
class Negation:
    parts: tuple


@dataclass(frozen=True)
class Length:
    """Number of different elements of an array field."""

    ref: Ref


@dataclass(frozen=True)
class Position:
    """Place of a field's value, or of an array's first listed element, in a list."""

    ref: Ref
    values: Any


@dataclass(frozen=True)
class Metric:
    function: str
    field: str | None = None
    distinct: bool = False
    alias: str | None = None

    def AS(self, alias: str) -> Metric:  # noqa: N802
        return replace(self, alias=alias)


@dataclass(frozen=True)
class Order:
    by: Any
    direction: str = ASC


def _left(field: Any) -> Any:
    return Ref(field) if isinstance(field, str) else field


def _leaf(op: str):
    def make(field, value):
        return Leaf(op, _left(field), value)

    make.__name__ = op.upper()
    return make


EQ, GT, GTE, LT, LTE = (_leaf(op) for op in ("eq", "gt", "gte", "lt", "lte"))
IN, HASALL, HASANY, PREFIX, SUFFIX, CONTAINS = (_leaf(op) for op in ("in", "hasall", "hasany", "prefix", "suffix", "contains"))


def NOT(*parts) -> Negation:  # noqa: N802
    return Negation(parts)


def AND(*parts) -> Every:  # noqa: N802
    return Every(parts)


def OR(*parts) -> Some:  # noqa: N802
    return Some(parts)


def NE(field, value) -> Negation:  # noqa: N802
    return NOT(EQ(field, value))


NOTEQ = NE


def NOTIN(field, values) -> Negation:  # noqa: N802
    return NOT(IN(field, values))


def HAS(field, value) -> Leaf:  # noqa: N802
    return HASALL(field, [value])


def HASNONE(field, values) -> Negation:  # noqa: N802
    return NOT(HASANY(field, values))


def ISNULL(field) -> Leaf:  # noqa: N802
    return Leaf("isnull", _left(field))


def NOTNULL(field) -> Negation:  # noqa: N802
    return NOT(ISNULL(field))


EXISTS = NOTNULL


def REF(name: str) -> Ref:  # noqa: N802
    return Ref(name)


def OUT(name: str) -> Out:  # noqa: N802
    return Out(name)


def LEN(field) -> Length:  # noqa: N802
    return Length(_left(field))


def POS(field, values) -> Position:  # noqa: N802
    return Position(_left(field), values)


def ROWCOUNT() -> Metric:  # noqa: N802
    return Metric("rowcount")


def COUNT(field: str | Metric) -> Metric:  # noqa: N802
    """COUNT(field), or COUNT(DISTINCT(field))."""
    return Metric("count", field.field, True) if isinstance(field, Metric) else Metric("count", field)


def DISTINCT(field: str) -> Metric:  # noqa: N802
    return Metric("distinct", field)


def SUM(field: str) -> Metric:  # noqa: N802
    return Metric("sum", field)


def AVG(field: str) -> Metric:  # noqa: N802
    return Metric("avg", field)


def MIN(field: str) -> Metric:  # noqa: N802
    return Metric("min", field)


def MAX(field: str) -> Metric:  # noqa: N802
    return Metric("max", field)


@dataclass(frozen=True)
class Q:
    """A query. Filters given together are joined by AND; every method returns a new query."""

    filters: tuple = ()
    orders: tuple[Order, ...] = ()
    skip: int = 0
    most: int = 0
    groups: tuple[str, ...] = ()
    reductions: tuple[Metric, ...] = ()
    havings: tuple = ()
    projection: tuple[str, ...] = ()

    def where(self, *filters) -> Q:
        return replace(self, filters=self.filters + filters)

    def sort(self, field: str, direction: str = ASC) -> Q:
        return replace(self, orders=(*self.orders, Order(Ref(field), direction)))

    def sort_by(self, by, direction: str = ASC) -> Q:
        return replace(self, orders=(*self.orders, Order(_left(by), direction)))

    def sort_out(self, name: str, direction: str = ASC) -> Q:
        return replace(self, orders=(*self.orders, Order(Out(name), direction)))

    def offset(self, n: int) -> Q:
        return replace(self, skip=n)

    def limit(self, n: int) -> Q:
        return replace(self, most=n)

    def group(self, *fields: str) -> Q:
        return replace(self, groups=self.groups + fields)

    def metrics(self, *metrics: Metric) -> Q:
        return replace(self, reductions=self.reductions + metrics)

    def having(self, *conditions) -> Q:
        return replace(self, havings=self.havings + conditions)

    def select(self, *fields: str) -> Q:
        return replace(self, projection=self.projection + fields)


def query(*filters) -> Q:
    return Q(tuple(filters))


def aggregate(*metrics: Metric) -> Q:
    return Q(reductions=tuple(metrics))


def is_list(value: Any) -> bool:
    return isinstance(value, (list, tuple, set, frozenset)) or (isinstance(value, Sequence) and not isinstance(value, (str, bytes, bytearray)))
