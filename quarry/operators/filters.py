"""Normal forms to columns. Negated tests include the rows where the field is null; no composite is ever negated."""

from __future__ import annotations

import functools
import operator
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import expr as E
from ..errors import InvalidQuery
from ..functions.columns import column, elements, instant, literal, quoted
from ..plans import ir
from ..plans.bounds import ALL, NONE, Bound, normalise
from ..schema import KEY, Field, Schema

_COMPARE = {"eq": operator.eq, "gt": operator.gt, "gte": operator.ge, "lt": operator.lt, "lte": operator.le}
_TEXT = {"prefix": Column.startswith, "suffix": Column.endswith, "contains": Column.contains}
_ARRAY = ("hasall", "hasany")


def compile_filter(filters: tuple, schema: Schema) -> Column | None:
    """The condition as a column, or None where every row matches. Nulls count as false."""
    node = ir.prepare(filters, lambda test: check(test, schema))
    return None if node == ir.TRUE else to_column(node, lambda test: compile_test(test, schema))


def to_column(node: Any, leaf) -> Column:
    if isinstance(node, ir.Test):
        return leaf(node)
    if not node.parts:
        return F.lit(isinstance(node, ir.All))
    join = operator.and_ if isinstance(node, ir.All) else operator.or_
    return functools.reduce(join, (to_column(p, leaf) for p in node.parts))


def resolve(name: str, schema: Schema) -> Field | None:
    """The queryable field of that name; None stands for the key."""
    if name == KEY:
        if not schema.key_queryable:
            raise InvalidQuery(f"{KEY} is not indexed in {schema.name}")
        return None
    f = schema.field(name)
    if f is None or not f.index:
        raise InvalidQuery(f"no index for field {name!r}")
    if f.index == "measure":
        raise InvalidQuery(f"{name!r} is a measure and can only be aggregated")
    return f


def check(test: ir.Test, schema: Schema) -> None:
    """Raise for a test that the field or the literal does not allow, whatever else the query says."""
    f = resolve(test.field, schema)
    values = test.value if isinstance(test.value, tuple) else None
    if f is None:
        _check_key(test, schema)
    elif test.op == "isnull" or test.op == "eq" and test.value is None:
        if f.array:
            raise InvalidQuery(f"{test.field}: an array can't be tested for null")
    elif test.op in _ARRAY:
        if not f.array:
            raise InvalidQuery(f"{test.field}: {test.op} needs an array field")
        if not values:
            raise InvalidQuery(f"{test.field}: no values provided")
    elif test.op == "in":
        if f.array:
            raise InvalidQuery(f"{test.field}: IN needs a scalar field")
        if test.value is not None and values is None:
            raise InvalidQuery(f"{test.field}: IN needs a list")
        if not values:
            raise InvalidQuery(f"{test.field}: no values provided")
    elif test.op == "eq" and f.array:
        if values is None:
            raise InvalidQuery(f"{test.field}: an array is compared with a list")
    elif values is not None:
        raise InvalidQuery(f"{test.field}: {test.op} takes one value, not a list")
    if f is not None and test.op != "isnull":
        for v in values if values is not None else (test.value,):
            if v is not None and (test.op not in _TEXT or f.compared == "string"):
                normalise("eq", v, f.compared, test.field)


def _check_key(test: ir.Test, schema: Schema) -> None:
    if test.op == "isnull" or test.value is None:
        raise InvalidQuery(f"{KEY} is never null")
    if test.op in _ARRAY:
        raise InvalidQuery(f"{KEY} is no array")
    values = test.value if isinstance(test.value, tuple) else (test.value,)
    if test.op == "in" and (not isinstance(test.value, tuple) or not values):
        raise InvalidQuery(f"{KEY}: no values provided")
    if test.op != "in" and isinstance(test.value, tuple):
        raise InvalidQuery(f"{KEY}: {test.op} takes one value, not a list")
    if test.op in _TEXT and schema.key_kind != "string":
        raise InvalidQuery(f"{KEY} is a number")
    wanted = (str,) if schema.key_kind == "string" else (int, float)
    if any(v is None or isinstance(v, bool) or not isinstance(v, wanted) for v in values):
        raise InvalidQuery(f"{KEY}: a literal of the key's kind is needed")


def compile_test(test: ir.Test, schema: Schema) -> Column:
    f = resolve(test.field, schema)
    if f is None:
        f = Field("_", schema.key_kind, nullable=False)
        return _scalar(test, f, quoted(schema.key))
    if f.array:
        hit = _array(test, f)
        return ~hit if test.negated else hit  # never null: the array is not
    return _scalar(test, f, column(f))


def _scalar(test: ir.Test, f: Field, c: Column) -> Column:
    if test.op == "isnull" or test.op == "eq" and test.value is None:
        return c.isNotNull() if test.negated else c.isNull()
    if test.op == "in":
        return _in(test, f, c)
    if test.op in _TEXT:
        if test.value is None or f.compared != "string":
            return F.lit(test.negated)
        return _signed(_TEXT[test.op](c, test.value), c, test.negated)
    bound = NONE if test.value is None else normalise(test.op, test.value, f.compared, test.field)
    return _bound(bound, f, c, test.negated)


def _signed(hit: Column, c: Column, negated: bool) -> Column:
    return c.isNull() | ~hit if negated else hit


def _bound(bound: Bound, f: Field, c: Column, negated: bool) -> Column:
    if bound is NONE:
        return F.lit(negated)
    if bound is ALL:
        return c.isNull() if negated else c.isNotNull()
    if f.compared == "time":
        return _signed(_time(bound, f, c), c, negated)
    if bound.op == "eq" and negated:
        return ~c.eqNullSafe(literal(bound.value, f.compared))
    return _signed(_COMPARE[bound.op](c, literal(bound.value, f.compared)), c, negated)


def _time(bound: Bound, f: Field, c: Column) -> Column:
    """Whole seconds, as ranges on the column itself so that they reach the scan."""
    at = instant(bound.value, f)
    after = instant(bound.value + 1, f)
    return {"eq": (c >= at) & (c < after), "gt": c >= after, "gte": c >= at, "lt": c < at, "lte": c < after}[bound.op]


def _in(test: ir.Test, f: Field, c: Column) -> Column:
    has_null = any(v is None for v in test.value)
    bounds = [b for b in (normalise("eq", v, f.compared, test.field) for v in test.value if v is not None) if b is not NONE]
    if f.compared == "time":
        hit = functools.reduce(operator.or_, (_time(b, f, c) for b in bounds)) if bounds else None
    else:
        hit = c.isin([literal(b.value, f.compared) for b in bounds]) if bounds else None
    if has_null:
        if hit is None:
            return c.isNotNull() if test.negated else c.isNull()
        return c.isNotNull() & ~hit if test.negated else hit | c.isNull()
    return F.lit(test.negated) if hit is None else _signed(hit, c, test.negated)


def _array(test: ir.Test, f: Field) -> Column:
    """Tests on the set of an array's elements; the result is never null."""
    held = elements(f)
    if test.op in _ARRAY or test.op == "eq":
        wanted = [v for v in test.value if v is not None]
        bounds = {b: None for b in (normalise("eq", v, f.compared, test.field) for v in wanted)}
        known = [literal(b.value, f.compared) for b in bounds if b is not NONE]
        if test.op == "hasany":
            return F.arrays_overlap(held, F.array(*known)) if known else F.lit(False)
        if NONE in bounds:
            return F.lit(False)
        every = functools.reduce(operator.and_, (F.array_contains(held, v) for v in known), F.lit(True))
        return every if test.op == "hasall" else (F.size(held) == len(known)) & every
    if test.value is None:
        return F.lit(False)
    one = Field("_", f.kind)
    positive = ir.Test(test.op, test.field, test.value)
    return F.exists(held, lambda x: _scalar(positive, one, x))
