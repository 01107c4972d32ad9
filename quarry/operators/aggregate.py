"""Reductions: filter, group and metrics, HAVING, order of the outputs, window - in that order, as one plan."""

from __future__ import annotations

import operator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import expr as E
from ..errors import InvalidQuery
from ..functions.columns import literal, logical, quoted
from ..plans import ir
from ..plans.bounds import ALL, NONE, normalise
from ..schema import FLOATS, KEY, Field, Schema
from .filters import compile_filter, to_column
from .ordering import check_window, window

_COMPARE = {"eq": operator.eq, "gt": operator.gt, "gte": operator.ge, "lt": operator.lt, "lte": operator.le}
_MOST_UNSIGNED = str(2**64 - 1)


@dataclass(frozen=True)
class Output:
    """A column of the result and the kind it is compared as."""

    name: str
    kind: str


def aggregated(df: DataFrame, q: E.Q, schema: Schema) -> DataFrame:
    if q.projection:
        raise InvalidQuery("an aggregate has no projection")
    check_window(q)
    groups = [_scalar(name, schema, grouping=True) for name in q.groups]
    if not groups and not q.reductions:
        raise InvalidQuery("an aggregate needs groups or metrics")
    alone = [m for m in q.reductions if m.function == "distinct"]
    if alone and (groups or len(q.reductions) > 1):
        raise InvalidQuery("DISTINCT must be the only metric and can't be grouped")
    fields = [None if m.function == "rowcount" else _metric_field(m, schema) for m in q.reductions]
    outputs = [Output(f.name, _kind(f)) for f in groups] + [Output(m.alias or _default_name(m), _metric_kind(m, f)) for m, f in zip(q.reductions, fields, strict=True)]
    for i, out in enumerate(outputs):
        if any(out.name == other.name for other in outputs[:i]):
            raise InvalidQuery(f"two outputs are called {out.name!r}")
    having = ir.prepare(q.havings, lambda test: _check_having(test, outputs), E.Out)
    orders = [_order(o, outputs) for o in q.orders]
    condition = compile_filter(q.filters, schema)
    rows = df if condition is None else df.where(condition)
    names = [o.name for o in outputs]
    if alone:
        result = rows.select(logical(fields[0]).alias(names[0])).distinct()
    elif not q.reductions:
        result = rows.select(*(logical(f).alias(f.name) for f in groups)).distinct()
    else:
        metrics = [_metric(m, f).alias(o.name) for m, f, o in zip(q.reductions, fields, outputs[len(groups) :], strict=True)]
        result = rows.groupBy(*(logical(f).alias(f.name) for f in groups)).agg(*metrics) if groups else rows.agg(*metrics)
    if having != ir.TRUE:
        kinds = {o.name: o.kind for o in outputs}
        result = result.where(F.coalesce(to_column(having, lambda test: _having(test, kinds[test.field])), F.lit(False)))
    if orders or groups or alone:  # group keys, or the distinct value, settle ties and are the order where none is given
        ties = [quoted(n).asc_nulls_last() for n in (names[: len(groups)] or names[: len(alone)])]
        result = result.orderBy(*orders, *ties)
    return window(result, q)


def _kind(f: Field) -> str:
    return "int64" if f.compared == "time" else f.compared


def _scalar(name: str, schema: Schema, grouping: bool) -> Field:
    """A field that may be grouped by, or counted as distinct."""
    if name == KEY:
        raise InvalidQuery(f"{KEY} can only be filtered")
    f = schema.field(name)
    if f is None or not f.index:
        raise InvalidQuery(f"no index for field {name!r}")
    if f.index == "measure":
        raise InvalidQuery(f"{name!r} is a measure and can't be {'grouped by' if grouping else 'listed'}")
    if f.array:
        raise InvalidQuery(f"{name!r} is an array")
    return f


def _metric_field(m: E.Metric, schema: Schema) -> Field:
    if m.field is None or not isinstance(m.field, str):
        raise InvalidQuery(f"{m.function} needs a field")
    if m.function == "distinct" or m.distinct:
        return _scalar(m.field, schema, grouping=False)
    f = None if m.field == KEY else schema.field(m.field)
    if f is None or not f.index:
        raise InvalidQuery(f"{KEY} can only be filtered" if m.field == KEY else f"no index for field {m.field!r}")
    if f.array:
        raise InvalidQuery(f"{m.field!r} is an array")
    if m.function in ("sum", "avg") and not f.numeric:
        raise InvalidQuery(f"{m.function} needs a number, {m.field!r} is {f.compared}")
    return f


def _default_name(m: E.Metric) -> str:
    if m.function == "rowcount":
        return "count"
    return f"{m.function}_{'distinct_' if m.distinct else ''}{m.field}"


def _metric_kind(m: E.Metric, f: Field | None) -> str:
    if m.function in ("rowcount", "count"):
        return "int64"
    if m.function == "avg":
        return "float64"
    if m.function == "sum":
        return "float64" if f.kind in FLOATS else "uint64" if f.kind == "uint64" else "int64"
    return _kind(f)


def _metric(m: E.Metric, f: Field | None) -> Column:
    if m.function == "rowcount":
        return F.count(F.lit(1))
    c = logical(f)
    if m.function == "count":
        return F.count_distinct(c) if m.distinct else F.count(c)
    if m.function == "sum":
        return _sum(c, f)
    if m.function == "avg":
        return F.avg(c.cast("double") if f.kind == "uint64" else c)
    return F.min(c) if m.function == "min" else F.max(c)


def _sum(c: Column, f: Field) -> Column:
    """The sum in the field's own kind: 0 of nothing, an error where it does not fit (bigint sums raise under ANSI)."""
    if f.kind == "uint64":
        total = F.coalesce(F.sum(c), F.lit(0).cast("decimal(30,0)"))
        return F.when(total <= F.lit(_MOST_UNSIGNED).cast("decimal(30,0)"), total).otherwise(F.raise_error(F.lit("unsigned sum overflow"))).cast("decimal(20,0)")
    kind = "double" if f.kind in FLOATS else "bigint"
    return F.coalesce(F.sum(c.cast(kind)), F.lit(0).cast(kind))


def _check_having(test: ir.Test, outputs: list[Output]) -> None:
    if test.field not in [o.name for o in outputs]:
        raise InvalidQuery(f"no output {test.field!r}")
    if test.op not in (*_COMPARE, "in", "isnull"):
        raise InvalidQuery(f"{test.op} can't be used in HAVING")
    if test.op == "in" and not (isinstance(test.value, tuple) and test.value):
        raise InvalidQuery(f"{test.field}: no values provided")
    if test.op != "in" and isinstance(test.value, tuple):
        raise InvalidQuery(f"{test.field}: {test.op} takes one value")


def _having(test: ir.Test, kind: str) -> Column:
    c = quoted(test.field)
    if test.op == "isnull":
        hit = c.isNull()
    elif test.op == "in":
        hit = F.lit(False)
        for v in test.value:
            hit = hit | _holds("eq", v, kind, c)
    else:
        hit = _holds(test.op, test.value, kind, c)
    return ~hit if test.negated else hit  # never null


def _holds(op: str, value: Any, kind: str, c: Column) -> Column:
    """Two-valued comparison of an output with a literal: null equals null, and orders with nothing."""
    if value is None:
        return c.isNull() if op == "eq" else F.lit(False)
    if kind in ("string", "bool") and not isinstance(value, str if kind == "string" else bool):
        return F.lit(False)
    if kind in FLOATS and isinstance(value, int) and not isinstance(value, bool) and int(float(value)) != value:
        # a whole number that no double equals: compare with the doubles on either side
        if op == "eq":
            return F.lit(False)
        above = float(value) > value
        op = {"gt": "gte" if above else "gt", "gte": "gte" if above else "gt", "lt": "lt" if above else "lte", "lte": "lt" if above else "lte"}[op]
    bound = normalise(op, value, kind)
    if bound is NONE:
        return F.lit(False)
    if bound is ALL:
        return c.isNotNull()
    return F.coalesce(_COMPARE[bound.op](c, literal(bound.value, kind)), F.lit(False))


def _order(order: E.Order, outputs: list[Output]) -> Column:
    if not isinstance(order.by, E.Out):
        raise InvalidQuery("aggregates are ordered by outputs only")
    if order.by.name not in [o.name for o in outputs]:
        raise InvalidQuery(f"no output {order.by.name!r}")
    if order.direction not in (E.ASC, E.DESC):
        raise InvalidQuery(f"unknown direction {order.direction!r}")
    c = quoted(order.by.name)
    return c.asc_nulls_last() if order.direction == E.ASC else c.desc_nulls_last()

