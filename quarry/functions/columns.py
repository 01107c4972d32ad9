"""Column expressions that more than one operator needs."""

from __future__ import annotations

import datetime as dt
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.bounds import UTC
from ..schema import Field, spark_type

_LITERALS = {"int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint", "uint64": "decimal(20,0)", "float32": "float", "float64": "double"}


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def column(f: Field) -> Column:
    """The field as queries see it."""
    return f.projection if f.projection is not None else quoted(f.name)


def literal(value: Any, kind: str) -> Column:
    """A literal of the field's own type, so that comparisons need no cast and reach the scan."""
    return F.lit(value).cast(_LITERALS[kind]) if kind in _LITERALS else F.lit(value)


def elements(f: Field) -> Column:
    """An array field as a set: null is empty, null elements don't count."""
    return F.array_distinct(F.filter(F.coalesce(column(f), F.array().cast(spark_type(f))), lambda x: x.isNotNull()))


def seconds(c: Column) -> Column:
    """Whole seconds since 1970, rounded down."""
    return F.unix_seconds(c.cast("timestamp"))


def instant(unix: int, f: Field) -> Column:
    """A literal time at a whole second, of the column's own type."""
    at = dt.datetime.fromtimestamp(0, UTC) + dt.timedelta(seconds=unix)
    return F.lit(f"{at:%Y-%m-%d %H:%M:%S}").cast("timestamp_ntz") if f.naive else F.lit(at)


def logical(f: Field) -> Column:
    """What sorting, grouping and aggregates work on: seconds for times, the value otherwise."""
    return seconds(column(f)) if f.kind == "time" and f.projection is None and not f.array else column(f)
