"""Partial updates: which field a name means, checked conversion of values, and the difference of two records."""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Mapping
from decimal import Decimal
from typing import Any

from .errors import InvalidPatch
from .schema import FLOATS, INTEGERS, Field, Schema


def convert(value: Any, f: Field) -> Any:
    """The value as the field stores it; an error where anything would be lost."""
    if value is None:
        if not f.nullable:
            raise InvalidPatch(f"{f.name} can't be null")
        return None
    if f.array:
        if not isinstance(value, (list, tuple)):
            raise InvalidPatch(f"{f.name} takes a list")
        return [None if v is None else _one(v, f) for v in value]
    return _one(value, f)


def _one(value: Any, f: Field) -> Any:
    number = isinstance(value, (int, float, Decimal)) and not isinstance(value, bool)
    if f.kind in INTEGERS:
        least, most = INTEGERS[f.kind]
        if not number or isinstance(value, float) and not math.isfinite(value) or value != int(value) or not least <= value <= most:
            raise InvalidPatch(f"{f.name}: {value!r} does not fit {f.kind}")
        return Decimal(int(value)) if f.kind == "uint64" else int(value)
    if f.kind in FLOATS:
        if not number:
            raise InvalidPatch(f"{f.name}: {value!r} is no number")
        if f.kind == "float32" and math.isfinite(value) and abs(value) > 3.4028235677973366e38:
            raise InvalidPatch(f"{f.name}: {value!r} does not fit {f.kind}")
        return float(value)
    wanted = {"bool": bool, "string": str, "time": dt.datetime, "binary": (bytes, bytearray), "map": Mapping, "struct": (Mapping, tuple)}[f.kind]
    if not isinstance(value, wanted):
        raise InvalidPatch(f"{f.name}: {value!r} is no {f.kind}")
    return value


def apply_patch(schema: Schema, record: Mapping[str, Any], patch: Mapping[str, Any], strict: bool = False) -> dict[str, Any]:
    """A new record. Unknown names are ignored unless ``strict``; of two names for one field the later wins."""
    changed = dict(record)
    for name, value in patch.items():
        f = schema.named(name)
        if f is not None:
            changed[f.name] = convert(value, f)
        elif strict:
            raise InvalidPatch(f"no field is called {name!r}")
    return changed


def same(a: Any, b: Any) -> bool:
    """Equality of stored values: zeros of either sign are equal, and so are all NaNs."""
    if isinstance(a, float) and isinstance(b, float):
        return a == b or math.isnan(a) and math.isnan(b)
    if isinstance(a, dt.datetime) and isinstance(b, dt.datetime):
        zone = lambda t: t if t.tzinfo else t.replace(tzinfo=dt.timezone.utc)
        return zone(a) == zone(b)
    if isinstance(a, Mapping) and isinstance(b, Mapping):
        return a.keys() == b.keys() and all(same(a[k], b[k]) for k in a)
    if isinstance(a, (list, tuple)) and isinstance(b, (list, tuple)):
        return len(a) == len(b) and all(map(same, a, b))
    return type(a) is type(b) and a == b


def make_patch(schema: Schema, old: Mapping[str, Any] | None, new: Mapping[str, Any] | None, json: bool = False) -> dict[str, Any]:
    """The fields in which two records differ: all of them without an old record, none without a new one."""
    patch: dict[str, Any] = {}
    for f in schema.fields if new is not None else ():
        if old is not None and same(old.get(f.name), new.get(f.name)):
            continue
        name = f.json if json and f.json is not None else f.name
        if not name or name == "-" or schema.named(name) is not f:
            raise InvalidPatch(f"{f.name} has no name that a patch could use")
        patch[name] = new.get(f.name)
    return patch
