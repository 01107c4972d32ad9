"""Literals brought into the exact domain of the field they are compared with.

Spark would widen an integer column to double to compare it with a fractional literal, which is wrong beyond 2**53. Here a
comparison becomes one on the field's own kind, or NONE (never true), or ALL (true for every value that is not null).
"""

from __future__ import annotations

import datetime as dt
import math
from dataclasses import dataclass
from decimal import Decimal
from typing import Any

from ..errors import InvalidQuery
from ..schema import FLOATS, INTEGERS

UTC = dt.timezone.utc


@dataclass(frozen=True)
class Bound:
    op: str
    value: Any = None


NONE, ALL = Bound("none"), Bound("all")


def normalise(op: str, value: Any, kind: str, name: str = "") -> Bound:
    """``op`` is eq, gt, gte, lt or lte; ``value`` is not null."""
    if kind in INTEGERS:
        return _integer(op, value, *INTEGERS[kind])
    if kind in FLOATS:
        return Bound(op, float(value)) if _is_number(value) else NONE
    if kind == "time":
        return _integer(op, unix_seconds(value) if isinstance(value, (dt.datetime, dt.date)) else value, *INTEGERS["int64"])
    if kind == "bool":
        if isinstance(value, str):
            raise InvalidQuery(f"{name}: a string can't be compared with a boolean")
        return Bound(op, value) if isinstance(value, bool) else NONE
    if kind == "string":
        if not isinstance(value, str):
            raise InvalidQuery(f"{name}: {value!r} can't be compared with a string")
        return Bound(op, value)
    raise InvalidQuery(f"{name}: {kind} fields can't be compared")


def _is_number(value: Any) -> bool:
    return isinstance(value, (int, float, Decimal)) and not isinstance(value, bool)


def _integer(op: str, value: Any, least: int, most: int) -> Bound:
    """The comparison on integers that is true for the same values as the one with ``value``."""
    if not _is_number(value):
        return NONE
    upward = op in ("gt", "gte")
    if isinstance(value, float) and not math.isfinite(value):
        high = math.isnan(value) or value > 0  # NaN is above everything
        return NONE if op == "eq" or high == upward else ALL
    whole = math.floor(value)
    if whole != value:
        if op == "eq":
            return NONE
        op, whole = ("gt", whole) if upward else ("lt", whole + 1)
    if whole < least:
        return ALL if upward else NONE
    if whole > most:
        return NONE if upward or op == "eq" else ALL
    return Bound(op, int(whole))


def unix_seconds(value: dt.datetime | dt.date) -> int:
    """Whole seconds since 1970, rounded down; a time without a zone is in UTC."""
    if not isinstance(value, dt.datetime):
        value = dt.datetime(value.year, value.month, value.day)
    if value.tzinfo is None:
        value = value.replace(tzinfo=UTC)
    return (value - dt.datetime(1970, 1, 1, tzinfo=UTC)) // dt.timedelta(seconds=1)
