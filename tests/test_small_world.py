"""All predicates, orders and windows on small tables, against an evaluator over lists of dicts."""

import functools
import itertools

import pytest
from pyspark.sql import functions as F

from quarry.expr import (
    AND, CONTAINS, DESC, EQ, GT, GTE, HAS, HASALL, HASANY, HASNONE, IN, ISNULL, LEN, LT, LTE, NE, NOT, NOTIN, NOTNULL, OR, POS, PREFIX, SUFFIX, Every, Leaf, Negation, Some, query,
)
from quarry.operators.filters import compile_filter
from quarry.schema import Schema
from quarry.sources.collection import Collection

NAMES = ["id", "country", "name", "age", "score", "active", "tags", "full_name", "opt"]
WORLDS = {
    "empty": [],
    "single": [(1, "", "solo", 0, 0.0, False, None, "FN-000", None)],
    "overlap": [
        (1, "NL", "alice", 20, 10.0, True, ["go", "db"], "FN-001", None), (2, "DE", "bob", 30, 20.0, False, ["go"], "FN-002", "opt-a"), (3, "NL", "carol", 30, 20.0, True, ["db", "ops"], "FN-003", ""),
        (4, "PL", "dave", 40, 20.0, False, None, "ZZ-004", "opt-b"), (5, "Finland", "eve", 25, 15.0, True, ["go", "go", "db"], "FN-005", None), (6, "Thailand", "alice", 18, 30.0, False, [], "AA-006", "opt-a"),
    ],
    "ties": [
        (10, "NL", "tie", 10, 1.0, True, ["go"], "FN-tie", None), (11, "NL", "tie", 10, 1.0, True, ["go", "db"], "FN-tie", "opt-a"),
        (12, "NL", "tie", 10, 1.0, False, ["db"], "FN-tie", None), (20, "Iceland", "cold", 99, 100.0, False, ["ops"], "ZZ-cold", "opt-z"),
    ],
}
TYPES = "id long, country string, name string, age int, score double, active boolean, tags array<string>, full_name string, opt string"
LEAVES = [
    EQ("country", "NL"), NE("country", "NL"), EQ("opt", None), NE("opt", None), EQ("opt", ""), GT("age", 20), GTE("age", 20.5), LT("score", 20), LTE("age", 2**40), GT("opt", None), EQ("age", 20.5),
    IN("name", ["alice", "bob"]), IN("opt", [None, "opt-a"]), NOTIN("opt", ["opt-a"]), NOTIN("opt", ["opt-a", None]), HASALL("tags", ["go", "db"]), HASANY("tags", ["go", "ops"]), HASNONE("tags", ["go"]), HAS("tags", "db"),
    EQ("tags", ["db", "go", "go"]), EQ("tags", []), ISNULL("opt"), NOTNULL("opt"), PREFIX("full_name", "FN"), PREFIX("opt", ""), SUFFIX("name", "e"), CONTAINS("full_name", "-00"), EQ("active", True), GT("tags", "e"),
    PREFIX("tags", "o"), LT("score", float("nan")), EQ("age", "x"),
]
ORDERS = {
    "none": lambda q: q, "age": lambda q: q.sort("age"), "score": lambda q: q.sort("score", DESC), "name": lambda q: q.sort("full_name"), "opt": lambda q: q.sort("opt"), "opt_desc": lambda q: q.sort("opt", DESC),
    "pos": lambda q: q.sort_by(POS("tags", ["go", "db", "ops"])), "len": lambda q: q.sort_by(LEN("tags"), DESC), "pos_opt": lambda q: q.sort_by(POS("opt", [None, "opt-b", "opt-a"]), DESC),
}
WINDOWS = [(0, 0), (0, 1), (1, 2), (10, 3)]


def holds(node, row) -> bool:
    if isinstance(node, (Every, Some)):
        return (all if isinstance(node, Every) else any)(holds(p, row) for p in node.parts)
    if isinstance(node, Negation):
        return not holds(node.parts[0], row)
    assert isinstance(node, Leaf)
    value, literal, op = row[node.left.name], node.value, node.op
    if node.left.name == "tags":
        held = set(value or [])
        if op in ("hasall", "hasany", "eq"):
            return {"hasall": set(literal) <= held, "hasany": bool(set(literal) & held), "eq": set(literal) == held}[op]
        return any(scalar(op, v, literal) for v in held)
    return scalar(op, value, literal)


def scalar(op, value, literal) -> bool:
    if op == "isnull" or op == "eq" and literal is None:
        return value is None
    if op == "in":
        return value in literal
    if value is None or literal is None:
        return False
    if isinstance(value, str) != isinstance(literal, str):
        return False
    if literal != literal:  # NaN is above every other number
        return op in ("lt", "lte")
    return {
        "eq": lambda: value == literal, "gt": lambda: value > literal, "gte": lambda: value >= literal, "lt": lambda: value < literal, "lte": lambda: value <= literal,
        "prefix": lambda: value.startswith(literal), "suffix": lambda: value.endswith(literal), "contains": lambda: literal in value,
    }[op]()


def sorted_as(order, rows):
    def last(key, reverse):
        def compare(a, b):
            x, y = key(a), key(b)
            if x is None or y is None:
                return (x is None) - (y is None) or a["id"] - b["id"]
            return ((x > y) - (x < y)) * (-1 if reverse else 1) or a["id"] - b["id"]

        return functools.cmp_to_key(compare)

    place = lambda listed: lambda r: next((i for i, v in enumerate(listed) if v in (r["tags"] or [])), None)
    keys = {
        "none": (lambda r: 0, False), "age": (lambda r: r["age"], False), "score": (lambda r: r["score"], True), "name": (lambda r: r["full_name"], False), "opt": (lambda r: r["opt"], False),
        "opt_desc": (lambda r: r["opt"], True), "pos": (place(["go", "db", "ops"]), False), "len": (lambda r: len(set(r["tags"] or [])), True),
        "pos_opt": (lambda r: {None: 0, "opt-b": 1, "opt-a": 2}.get(r["opt"]), True),
    }
    return sorted(rows, key=last(*keys[order]))


def world(spark, name):
    df = spark.createDataFrame(WORLDS[name], TYPES)
    return Collection(df, Schema.of(df, "id", "world")), [dict(zip(NAMES, r, strict=True)) for r in WORLDS[name]]


def variants():
    """Leaves by themselves, negated, and in pairs with either sign."""
    yield from LEAVES
    yield from (NOT(f) for f in LEAVES)
    for a, b in itertools.islice(itertools.combinations(LEAVES, 2), 0, None, 7):
        yield from (OR(a, NOT(b)), AND(NOT(a), b), NOT(AND(a, OR(b, NOT(a)))), NOT(OR(a, b)))


@pytest.mark.parametrize("name", WORLDS)
def test_filters(spark, name):
    collection, rows = world(spark, name)
    filters = list(variants())
    for i in range(0, len(filters), 60):
        part = filters[i : i + 60]
        columns = [F.coalesce(c, F.lit(False)).alias(f"f{k}") if (c := compile_filter((f,), collection.schema)) is not None else F.lit(True).alias(f"f{k}") for k, f in enumerate(part)]
        got = {r["id"]: r for r in collection.df.select("id", *columns).collect()}
        for row in rows:
            for k, f in enumerate(part):
                assert got[row["id"]][f"f{k}"] == holds(f, row), (f, row)


@pytest.mark.parametrize("name", ["overlap", "ties"])
@pytest.mark.parametrize("order", ORDERS)
def test_orders_and_windows(spark, name, order):
    collection, rows = world(spark, name)
    for f, (skip, most) in itertools.product([NE("opt", "opt-a"), OR(EQ("country", "NL"), GT("age", 25))], WINDOWS):
        q = ORDERS[order](query(f)).offset(skip).limit(most)
        want = [r["id"] for r in sorted_as(order, [r for r in rows if holds(f, r)])][skip:]
        want = want[:most] if most else want
        got = [r["id"] for r in collection.query_keys(q).collect()]
        assert got == want if order != "none" or skip or most else sorted(got) == want
        assert [r["id"] for r in collection.query(q).collect()] == got
    assert collection.count(f) == sum(holds(f, r) for r in rows)


@pytest.mark.parametrize("f", [NE("opt", "opt-a"), OR(EQ("country", "NL"), NOT(GT("age", 25))), NOT(IN("opt", [None, "opt-b"]))])
def test_rewrites_change_nothing(spark, f):
    collection, _ = world(spark, "overlap")
    keys = lambda *fs: sorted(r["id"] for r in collection.query_keys(query(*fs)).collect())
    want = keys(f)
    always, never = OR(EQ("age", 1), NOT(EQ("age", 1))), AND(LT("age", None), EQ("age", 1))
    for same in (AND(f, f), OR(f, f), NOT(NOT(f)), AND(f, always), OR(f, never), AND(OR(f, never), always)):
        assert keys(same) == want
    assert keys(f, f) == want and sorted(want + keys(NOT(f))) == [1, 2, 3, 4, 5, 6]


def test_sort_on_arrays_drops_empty_ones(spark):
    collection, _ = world(spark, "overlap")
    assert [r["id"] for r in collection.query_keys(query().sort("tags")).collect()] == [1, 3, 5, 2]
    assert [r["id"] for r in collection.query_keys(query().sort("tags", DESC)).collect()] == [3, 1, 2, 5]


def test_filters_reach_the_scan(spark, tmp_path):
    collection, _ = world(spark, "overlap")
    collection.df.write.parquet(str(tmp_path / "w"))
    stored = Collection(spark.read.parquet(str(tmp_path / "w")), collection.schema)
    plan = stored.explain(query(NOT(LTE("age", 20)), PREFIX("name", "a")))
    assert "StringStartsWith(name,a)" in plan and "Or(IsNull(age),GreaterThan(age,20))" in plan


def test_traces(spark, tmp_path):
    from quarry.sources.trace import Tracer

    collection, _ = world(spark, "overlap")
    collection.df.write.parquet(str(tmp_path / "w"))
    stored, events = Collection(spark.read.parquet(str(tmp_path / "w")), collection.schema), []
    tracer = Tracer(events.append, every=2)
    for _ in range(4):
        rows = tracer.collect("query", stored.query(query(GT("age", 20)).sort("age").limit(2)))
    assert len(events) == 2 and events[0].rows == len(rows) == 2 and "TakeOrderedAndProject" in events[0].operators and "GreaterThan(age,20)" in events[0].pushed[0]
