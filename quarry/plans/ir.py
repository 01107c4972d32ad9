"""Validation and normal form of filters.

A filter becomes a tree of All, Any_ and Test, where negation stands at the leaves only: a negated test is the complement of
the test over all rows, nulls included, so it must never be built by negating a column that may be null.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from .. import expr as E
from ..errors import InvalidQuery


@dataclass(frozen=True)
class Test:
    op: str
    field: str
    value: Any = None
    negated: bool = False


@dataclass(frozen=True)
class All:
    parts: tuple


@dataclass(frozen=True)
class Any_:
    parts: tuple


TRUE, FALSE = All(()), Any_(())


def prepare(filters: tuple, check: Callable[[Test], None], left: type = E.Ref) -> Any:
    """The normal form of filters joined by AND; ``check`` raises for tests that the field does not allow."""
    return simplify(All(tuple(_walk(f, False, check, left) for f in filters)))


def _walk(node: Any, negated: bool, check: Callable[[Test], None], left: type) -> Any:
    if isinstance(node, (E.Every, E.Some)):
        if not node.parts:
            raise InvalidQuery("AND and OR need at least one operand")
        parts = tuple(_walk(p, negated, check, left) for p in node.parts)
        return All(parts) if isinstance(node, E.Every) != negated else Any_(parts)
    if isinstance(node, E.Negation):
        if len(node.parts) != 1:
            raise InvalidQuery("NOT takes exactly one operand")
        return _walk(node.parts[0], not negated, check, left)
    if isinstance(node, E.Leaf):
        if not isinstance(node.left, left):
            raise InvalidQuery(f"the left side of a predicate must be a {'field' if left is E.Ref else 'output'} reference")
        if isinstance(node.value, (E.Ref, E.Out, E.Leaf, E.Every, E.Some, E.Negation, E.Metric, E.Length, E.Position)):
            raise InvalidQuery(f"the right side of a predicate on {node.left.name!r} must be a literal")
        test = Test(node.op, node.left.name, _frozen(node.value), negated)
        check(test)
        return test
    raise InvalidQuery(f"not a filter: {node!r}")


def _frozen(value: Any) -> Any:
    """Lists become tuples, so that tests can be compared."""
    return tuple(_frozen(v) for v in value) if E.is_list(value) else value


def simplify(node: Any) -> Any:
    """Flatten nested parts, fold constants and drop repeated parts. Contradictions are left to Catalyst."""
    if isinstance(node, Test):
        return node
    kind, unit, zero = (All, TRUE, FALSE) if isinstance(node, All) else (Any_, FALSE, TRUE)
    parts: list = []
    for p in map(simplify, node.parts):
        for part in p.parts if isinstance(p, kind) else (p,):
            if part == zero:
                return zero
            if not any(_same(part, q) for q in parts):
                parts.append(part)
    if not parts:
        return unit
    return parts[0] if len(parts) == 1 else kind(tuple(parts))


def _same(a: Any, b: Any) -> bool:
    """Equal parts; 1, 1.0 and True are different literals."""
    return a == b and repr(a) == repr(b)
