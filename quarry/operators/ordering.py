"""Record order and windows: one sort key, nulls last in both directions, ties by ascending key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import expr as E
from ..errors import InvalidQuery
from ..functions.columns import column, elements, literal, logical, quoted
from ..plans.bounds import NONE, normalise
from ..schema import KEY, Schema
from .filters import _time, resolve


def check_window(q: E.Q) -> None:
    for n in (q.skip, q.most):
        if isinstance(n, bool) or not isinstance(n, int) or n < 0:
            raise InvalidQuery("offset and limit must be whole numbers from 0 on")


def ordered(df: DataFrame, q: E.Q, schema: Schema, tie: Column) -> DataFrame:
    """Sort and cut a DataFrame as the query says. Without an order, a window counts in order of the key."""
    check_window(q)
    if len(q.orders) > 1:
        raise InvalidQuery("records can be sorted by one key only")
    if q.orders:
        df, keys = _keys(df, q.orders[0], schema, tie)
        df = df.orderBy(*keys)
    elif q.skip or q.most:
        df = df.orderBy(tie.asc())
    return window(df, q)


def window(df: DataFrame, q: E.Q) -> DataFrame:
    df = df.offset(q.skip) if q.skip else df
    return df.limit(q.most) if q.most else df


def _direction(c: Column, direction: str) -> Column:
    if direction not in (E.ASC, E.DESC):
        raise InvalidQuery(f"unknown direction {direction!r}")
    return c.asc_nulls_last() if direction == E.ASC else c.desc_nulls_last()


def _keys(df: DataFrame, order: E.Order, schema: Schema, tie: Column) -> tuple[DataFrame, list[Column]]:
    by, direction = order.by, order.direction
    if isinstance(by, E.Out):
        raise InvalidQuery("records can't be sorted by an output")
    if isinstance(by, E.Ref):
        f = resolve(by.name, schema)
        if f is None:
            key = quoted(schema.key)
            return df, [key.asc() if direction == E.ASC else key.desc()]
        if f.array:  # a record stands at its least element, or its greatest going down; records without elements drop out
            held = elements(f)
            edge = F.array_min(held) if direction == E.ASC else F.array_max(held)
            return df.where(F.size(held) > 0), [_direction(edge, direction), tie.asc()]
        return df, [_direction(logical(f), direction), tie.asc()]
    if isinstance(by, E.Length) and isinstance(by.ref, E.Ref):
        f = None if by.ref.name == KEY else resolve(by.ref.name, schema)
        if f is None or not f.array:
            raise InvalidQuery(f"LEN needs an array field, not {by.ref.name!r}")
        return df, [_direction(F.size(elements(f)), direction), tie.asc()]
    if isinstance(by, E.Position) and isinstance(by.ref, E.Ref):
        rank = position(by, schema)
        return df, [tie.asc()] if rank is None else [_direction(rank, direction), tie.asc()]
    raise InvalidQuery(f"records can't be sorted by {by!r}")


def position(by: E.Position, schema: Schema) -> Column | None:
    """The place in the list, null for values that are not in it; None for an empty list."""
    if not E.is_list(by.values):
        raise InvalidQuery("POS needs a list of values")
    f = None if by.ref.name == KEY else resolve(by.ref.name, schema)
    if f is None:
        raise InvalidQuery(f"POS can't be used with {KEY}")
    rank, place, seen = None, 0, set()
    for v in by.values:
        if v is None:
            test, name = None if f.array else column(f).isNull(), None
        else:
            bound = normalise("eq", v, f.compared, f.name)
            name = bound if bound is NONE else bound.value
            value = None if bound is NONE else literal(bound.value, f.compared)
            if bound is NONE:
                test = None
            elif f.array:
                test = F.array_contains(elements(f), value)
            else:
                test = _time(bound, f, column(f)) if f.compared == "time" else column(f) == value
        if test is None or name in seen:
            continue
        seen.add(name)
        rank = F.when(test, F.lit(place)) if rank is None else rank.when(test, F.lit(place))
        place += 1
    return rank
