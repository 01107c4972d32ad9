"""Queries and schemas that must be refused."""

import pytest

from quarry.errors import InvalidQuery, InvalidSchema, NoIndex
from quarry.expr import (
    AND, AVG, COUNT, DISTINCT, EQ, GT, HASALL, HASANY, IN, ISNULL, LEN, MAX, NOT, OR, OUT, POS, PREFIX, Q, REF, ROWCOUNT, SUM, aggregate, query,
)
from quarry.schema import KEY, Field, Schema
from quarry.sources.collection import Collection


@pytest.fixture(scope="module")
def people(spark):
    df = spark.createDataFrame([(1, "US", "a", 30, 10, ["x"], b"z")], "id long, country string, name string, age int, spent long, tags array<string>, blob binary")
    return Collection(df, Schema.of(df, "id", "people", measures=["spent"]))


@pytest.mark.parametrize("f", [
    EQ("nobody", 1), EQ("spent", 1), EQ("blob", b"z"), AND(), OR(), NOT(), NOT(EQ("age", 1), EQ("age", 2)), EQ("age", [1]), GT("age", [1]), IN("age", []), IN("age", None), IN("age", 3), IN("tags", ["x"]), HASANY("age", [1]),
    HASALL("tags", []), HASANY("tags", None), ISNULL("tags"), EQ("tags", None), EQ("tags", "x"), EQ("name", 5), GT("age", REF("spent")), EQ(OUT("age"), 1), EQ(KEY, None), EQ(KEY, "a"), PREFIX(KEY, "1"), HASANY(KEY, [1]), ISNULL(KEY),
    OR(EQ("age", 1), EQ("nobody", 1)), AND(GT("age", None), IN("name", [])), "age",
])
def test_filters(people, f):
    with pytest.raises(InvalidQuery):
        people.query(query(f))
    with pytest.raises(InvalidQuery):
        people.count_of(f)


@pytest.mark.parametrize("q", [
    query().sort("age").sort("name"), query().sort("spent"), query().sort("nobody"), query().sort_by(LEN("age")), query().sort_by(LEN(KEY)), query().sort_by(POS("name", "a b")), query().sort_by(POS(KEY, [1])), query().sort_out("age"),
    query().sort("age", "up"), query().limit(-1), query().offset(1.5), query().select("age"), query().group("age"), query().metrics(ROWCOUNT()), query().having(GT(OUT("age"), 1)),
])
def test_record_queries(people, q):
    with pytest.raises(InvalidQuery):
        people.query(q)


@pytest.mark.parametrize("q", [
    Q(), Q().group("spent").metrics(ROWCOUNT()), Q().group("tags"), Q().group(KEY), Q().group("nobody"), aggregate(SUM("name")), aggregate(AVG("tags")), aggregate(MAX("tags")), aggregate(SUM(KEY)), aggregate(DISTINCT("spent")),
    aggregate(DISTINCT("tags")), aggregate(COUNT(DISTINCT("spent"))), aggregate(DISTINCT("age"), ROWCOUNT()), Q().group("country").metrics(DISTINCT("age")), aggregate(ROWCOUNT(), ROWCOUNT()), Q().group("age").metrics(SUM("spent").AS("age")),
    aggregate(ROWCOUNT()).having(GT(OUT("other"), 1)), aggregate(ROWCOUNT()).having(GT("count", 1)), aggregate(ROWCOUNT()).having(IN(OUT("count"), [])), aggregate(ROWCOUNT()).having(PREFIX(OUT("count"), "1")), aggregate(ROWCOUNT()).sort("age"),
    aggregate(ROWCOUNT()).sort_out("other"), aggregate(ROWCOUNT()).select("age"), query(EQ("spent", 1)).metrics(ROWCOUNT()), aggregate(ROWCOUNT()).having(EQ(OUT("count"), [1])),
])
def test_aggregates(people, q):
    with pytest.raises(InvalidQuery):
        people.aggregate(q)


def test_transparent_collections_can_be_read_but_not_queried(spark):
    df = spark.createDataFrame([("k", 1)], "id string, v int")
    plain = Collection(df, Schema.of(df, "id", unindexed=["v"]))
    assert plain.get("k")["v"] == 1 and plain.get("other") is None and plain.scan_keys().count() == 1
    for call in (lambda: plain.query(query()), lambda: plain.count_of(), lambda: plain.aggregate(aggregate(ROWCOUNT())), plain.index_stats):
        with pytest.raises(NoIndex):
            call()


def test_string_keys_are_queried_only_with_an_index(spark):
    df = spark.createDataFrame([("k", 1), ("m", 2)], "id string, v int")
    with pytest.raises(InvalidQuery):
        Collection(df, Schema.of(df, "id")).query(query(EQ(KEY, "k")))
    assert Collection(df, Schema.of(df, "id", string_key_index=True)).count(GT(KEY, "k")) == 1


@pytest.mark.parametrize("make", [
    lambda: Field(KEY, "int64"), lambda: Field("a", "complex"), lambda: Field("a", "int64", "primary"), lambda: Field("a", "string", "measure"), lambda: Field("a", "int64", "unique", array=True), lambda: Field("a", "binary"),
    lambda: Schema("s", "id", "float64", (Field("a", "int64"),)), lambda: Schema("s", "id", "int64", ()), lambda: Schema("s", "id", "int64", (Field("a", "int64"), Field("a", "int32"))),
    lambda: Schema("s", "id", "int64", (Field("a", "int64", aliases=("x",)), Field("b", "int64", aliases=("x",)))).with_index({"x": "index"}), lambda: Schema("s", "id", "int64", (Field("a", "int64"),)).with_index({KEY: "index"}),
    lambda: Schema("s", "id", "int64", (Field("a", "int64", aliases=("x",)),)).with_index({"a": "index", "x": "unique"}),
])
def test_schemas(make):
    with pytest.raises(InvalidSchema):
        make()


def test_index_kinds_can_be_given_anew():
    schema = Schema("s", "id", "int64", (Field("a", "int64", aliases=("x",)), Field("b", "int64")))
    assert [f.index for f in schema.with_index({"x": "measure"}).fields] == ["measure", None]
    assert schema.with_index({}).transparent
