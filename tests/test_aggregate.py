"""Values, kinds and nulls of reductions."""

from decimal import Decimal

import pytest
from pyspark.errors import PySparkException

from quarry.expr import AVG, COUNT, DESC, DISTINCT, EQ, EXISTS, GT, IN, ISNULL, LT, LTE, MAX, MIN, NE, NOT, OUT, Q, ROWCOUNT, SUM, aggregate, query
from quarry.schema import KEY, Schema
from quarry.sources.collection import Collection


def of(spark, rows, types, **how):
    df = spark.createDataFrame(rows, types)
    return Collection(df, Schema.of(df, "id", **how))


def got(collection, q):
    return [tuple(r) for r in collection.aggregate(q).collect()]


@pytest.fixture(scope="module")
def nulls(spark):
    return of(spark, [(1, "a", 10), (2, None, 20), (3, None, None), (4, "b", None)], "id long, segment string, amount long", measures=["amount"])


def test_null_groups_come_last(nulls):
    q = Q().group("segment").metrics(ROWCOUNT(), COUNT("amount"), SUM("amount"), MIN("amount"), MAX("amount"))
    assert got(nulls, q) == [("a", 1, 1, 10, 10, 10), ("b", 1, 0, 0, None, None), (None, 2, 1, 20, 20, 20)]
    assert nulls.aggregate(q).columns == ["segment", "count", "count_amount", "sum_amount", "min_amount", "max_amount"]


def test_nothing(nulls):
    nothing = query(EQ(KEY, 99))
    assert got(nulls, nothing.metrics(ROWCOUNT(), SUM("amount"), AVG("amount"), MAX("segment"))) == [(0, 0, None, None)]
    assert got(nulls, nothing.group("segment").metrics(ROWCOUNT())) == []


def test_distinct(nulls):
    assert got(nulls, aggregate(DISTINCT("segment"))) == [("a",), ("b",), (None,)]
    assert got(nulls, aggregate(DISTINCT("segment")).offset(1).limit(1)) == [("b",)]
    assert got(nulls, aggregate(COUNT(DISTINCT("segment")).AS("n"), ROWCOUNT())) == [(2, 4)]


@pytest.mark.parametrize("condition, want", [
    (EQ(OUT("segment"), None), [None]), (NE(OUT("segment"), "a"), ["b", None]), (NOT(EXISTS(OUT("segment"))), [None]), (GT(OUT("s"), 0), ["a", None]), (ISNULL(OUT("m")), ["b"]), (IN(OUT("m"), [None, 10.0]), ["a", "b"]),
    (NOT(LT(OUT("m"), 15)), ["b", None]), (EQ(OUT("segment"), 5), []), (NE(OUT("segment"), 5), ["a", "b", None]), (LT(OUT("segment"), None), []),
])
def test_having(nulls, condition, want):
    q = Q().group("segment").metrics(SUM("amount").AS("s"), MAX("amount").AS("m")).having(condition)
    assert [r[0] for r in got(nulls, q)] == want


def test_having_compares_numbers_exactly(spark):
    big = 2**53 + 1
    c = of(spark, [(1, "a", big), (2, "b", big - 1)], "id long, g string, v long", measures=["v"])
    q = Q().group("g").metrics(SUM("v").AS("s"), AVG("v").AS("f"))
    assert [r[0] for r in got(c, q.having(EQ(OUT("s"), float(2**53))))] == ["b"]
    assert [r[0] for r in got(c, q.having(GT(OUT("s"), float(2**53))))] == ["a"]
    assert got(c, q.having(EQ(OUT("f"), big))) == [] and len(got(c, q.having(LTE(OUT("f"), big)))) == 2


def test_orders(nulls):
    q = Q().group("segment").metrics(ROWCOUNT().AS("n"), MAX("amount").AS("m"))
    assert [r[0] for r in got(nulls, q.sort_out("n", DESC))] == [None, "a", "b"]
    assert [r[0] for r in got(nulls, q.sort_out("m", DESC))] == [None, "a", "b"]
    assert [r[0] for r in got(nulls, q.sort_out("n").sort_out("segment", DESC).limit(1))] == ["b"]


def test_overflow_is_an_error(spark):
    c = of(spark, [(1, 2**63 - 1, Decimal(2**64 - 1)), (2, 1, Decimal(1))], "id long, v long, u decimal(20,0)", uint64=["u"])
    for metric in (SUM("v"), SUM("u")):
        with pytest.raises(PySparkException):
            got(c, aggregate(metric))
    assert got(c, query(EQ(KEY, 1)).metrics(SUM("u"))) == [(Decimal(2**64 - 1),)]
    assert got(c, aggregate(AVG("v")))[0][0] == pytest.approx(2.0**62)


def test_floats(spark):
    nan = float("nan")
    c = of(spark, [(1, 0.0), (2, -0.0), (3, nan), (4, nan), (5, float("inf")), (6, None)], "id long, v double")
    assert [r[1] for r in got(c, Q().group("v").metrics(ROWCOUNT()))] == [2, 1, 2, 1]
    assert str(got(c, aggregate(MAX("v"), COUNT(DISTINCT("v"))))) == "[(nan, 3)]"


def test_count_agrees_with_rowcount(nulls):
    for f in (EQ("segment", None), NE("segment", "a"), GT("segment", "a")):
        assert nulls.count(f) == got(nulls, query(f).metrics(ROWCOUNT()))[0][0]
