"""Literals against exact arithmetic."""

import datetime as dt
import math
from fractions import Fraction

import pytest
from hypothesis import given
from hypothesis import strategies as st

from quarry.plans.bounds import ALL, NONE, normalise, unix_seconds
from quarry.schema import INTEGERS

OPS = {"eq": lambda a, b: a == b, "gt": lambda a, b: a > b, "gte": lambda a, b: a >= b, "lt": lambda a, b: a < b, "lte": lambda a, b: a <= b}
NUMBERS = st.one_of(st.integers(-(2**70), 2**70), st.floats(allow_nan=True), st.sampled_from([2.0**63, -(2.0**63), 2.0**64, 0.5, -0.5, 127.5, 9007199254740992.0]))


def exact(op, value, literal):
    if isinstance(literal, float) and math.isnan(literal):
        return op in ("lt", "lte")
    if isinstance(literal, float) and math.isinf(literal):
        return OPS[op](0, literal)
    return OPS[op](value, Fraction(literal))


@given(st.sampled_from(sorted(INTEGERS)), st.sampled_from(sorted(OPS)), NUMBERS, st.integers(-(2**64), 2**64))
def test_integers(kind, op, literal, value):
    least, most = INTEGERS[kind]
    near = [v for v in (value, least, most, *((math.floor(literal), math.ceil(literal)) if math.isfinite(literal) else ())) if least <= v <= most]
    bound = normalise(op, literal, kind)
    for v in near:
        got = bound is ALL if bound in (ALL, NONE) else OPS[bound.op](v, bound.value)
        assert got == exact(op, v, literal)
    assert bound in (ALL, NONE) or least <= bound.value <= most


def test_other_kinds():
    assert normalise("eq", "7", "int64") is NONE and normalise("gt", True, "int32") is NONE
    assert normalise("eq", 5, "bool") is NONE and normalise("eq", True, "bool").value is True
    assert normalise("lt", 3, "float64").value == 3.0 and normalise("eq", "x", "float32") is NONE
    for kind, literal in (("string", 5), ("bool", "1"), ("binary", b"x")):
        with pytest.raises(ValueError):
            normalise("eq", literal, kind)


def test_seconds_round_down():
    assert unix_seconds(dt.datetime(1969, 12, 31, 23, 59, 59, 500_000)) == -1
    assert unix_seconds(dt.datetime(2024, 1, 1, 1, tzinfo=dt.timezone(dt.timedelta(hours=1)))) == unix_seconds(dt.date(2024, 1, 1)) == 1704067200
