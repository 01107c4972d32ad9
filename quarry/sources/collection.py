"""A collection: a keyed DataFrame with a declared schema, and the reads on it.

Every read returns a lazy DataFrame (or, for ``count`` and ``get``, runs one job), compiled from validated queries to plain
columns, so pruning, pushdown and physical planning are Catalyst's.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from .. import expr as E
from ..errors import InvalidQuery, NoIndex
from ..functions.columns import column, elements, logical, quoted
from ..operators.aggregate import aggregated
from ..operators.filters import compile_filter
from ..operators.ordering import ordered
from ..schema import Field, Schema


class Collection:
    """Reads on one version of a collection. ``tie`` names the column whose order settles ties: the key, unless the store
    keeps the order in which string keys were first written."""

    def __init__(self, df: DataFrame, schema: Schema, tie: str | None = None):
        self.df, self.schema, self.tie = df, schema, tie or schema.key

    @property
    def columns(self) -> list[str]:
        return [self.schema.key, *(f.name for f in self.schema.fields)]

    def _records(self, df: DataFrame) -> DataFrame:
        return df.select(*(quoted(c) for c in self.columns))

    def _need_index(self) -> None:
        if self.schema.transparent:
            raise NoIndex(f"{self.schema.name} has no indexed field")

    # records by key

    def get(self, key: Any) -> Row | None:
        """The record with that key, or None."""
        found = self._records(self.df.where(quoted(self.schema.key) == F.lit(key))).take(1)
        return found[0] if found else None

    def scan(self, seek: Any = None) -> DataFrame:
        """Records in order of the key, from ``seek`` on."""
        key = quoted(self.schema.key)
        rows = self.df if seek is None else self.df.where(key >= F.lit(seek))
        return self._records(rows.orderBy(key.asc()))

    def scan_keys(self, seek: Any = None) -> DataFrame:
        """Keys in order, from ``seek`` on."""
        key = quoted(self.schema.key)
        rows = self.df.select(key)
        return (rows if seek is None else rows.where(key >= F.lit(seek))).orderBy(key.asc())

    def each(self, visit: Callable[[Row], bool], seek: Any = None) -> None:
        """Call ``visit`` with one record after another, a partition at a time, until it returns False."""
        for row in self.scan(seek).toLocalIterator():
            if not visit(row):
                return

    # queries

    def _selected(self, q: E.Q) -> DataFrame:
        self._need_index()
        if q.groups or q.reductions or q.havings:
            raise InvalidQuery("a record query has no groups, metrics or HAVING")
        if q.projection:
            raise InvalidQuery("a record query returns whole records")
        condition = compile_filter(q.filters, self.schema)
        rows = self.df if condition is None else self.df.where(condition)
        return ordered(rows, q, self.schema, quoted(self.tie))

    def query(self, q: E.Q) -> DataFrame:
        """Whole records, filtered, sorted and cut."""
        return self._records(self._selected(q))

    def query_keys(self, q: E.Q) -> DataFrame:
        """The keys of the same records in the same order."""
        return self._selected(q).select(quoted(self.schema.key))

    def count_of(self, *filters) -> DataFrame:
        """One row with the number of records that match all filters."""
        self._need_index()
        condition = compile_filter(filters, self.schema)
        return (self.df if condition is None else self.df.where(condition)).agg(F.count(F.lit(1)).alias("count"))

    def count(self, *filters) -> int:
        return self.count_of(*filters).first()[0]

    def aggregate(self, q: E.Q) -> DataFrame:
        """Grouped or ungrouped reductions; the columns are the groups, then the metrics."""
        self._need_index()
        return aggregated(self.df, q, self.schema)

    def explain(self, q: E.Q) -> str:
        """The physical plan of a record query or an aggregate."""
        df = self.aggregate(q) if q.groups or q.reductions else self.query(q)
        return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))

    # statistics

    def stats(self) -> DataFrame:
        """Number of records and the last key."""
        key = quoted(self.schema.key)
        return self.df.agg(F.count(F.lit(1)).alias("keys"), F.max(key).alias("last_key"))

    def _indexed(self) -> list[Field]:
        return [f for f in self.schema.fields if f.queryable]

    def _values(self) -> DataFrame:
        """A row for each (field, value) of a record, from one pass over the columns; an array gives each of its elements once.
        A value is shuffled as 128 bits of hash and its length in bytes (8 for what is no string), never as itself."""
        def one(f: Field) -> Column:
            values = elements(f) if f.array else F.filter(F.array(logical(f)), lambda x: x.isNotNull())
            length = (lambda x: F.octet_length(x)) if f.kind == "string" else (lambda x: F.lit(8))
            return F.transform(values, lambda x: F.struct(F.lit(f.name).alias("field"), F.xxhash64(x).alias("h1"), F.xxhash64(F.lit(1), x).alias("h2"), length(x).alias("bytes")))

        return self.df.select(F.explode(F.concat(*map(one, self._indexed()))).alias("v")).select("v.*")

    def _value_counts(self) -> DataFrame:
        return self._values().groupBy("field", "h1", "h2", "bytes").agg(F.count(F.lit(1)).alias("n"))

    def index_stats(self) -> DataFrame:
        """For each queryable field: different values, entries (values over all records) and bytes of the different values."""
        self._need_index()
        return self._value_counts().groupBy("field").agg(F.count(F.lit(1)).alias("distinct"), F.sum("n").alias("entries"), F.sum("bytes").cast("long").alias("bytes"))

    def planner_stats(self) -> DataFrame:
        """For each queryable field: how many values it has and how many records they hold (total, mean, most, median, 95th
        percentile). The percentiles are exact; they keep one entry for each different count, of which n records can't have
        more than the root of 2 n."""
        self._need_index()
        rank = lambda p: F.percentile("n", F.lit(p))
        return self._value_counts().groupBy("field").agg(
            F.count(F.lit(1)).alias("distinct"), F.sum("n").alias("total"), F.avg("n").alias("mean"), F.max("n").alias("most"), rank(0.5).alias("p50"), rank(0.95).alias("p95")
        )

    def field_counts(self) -> DataFrame:
        """For each field, the records in which it is not null, from one aggregate."""
        counts = self.df.agg(*(F.count(column(f)).alias(f"n{i}") for i, f in enumerate(self.schema.fields)))
        pairs = F.array(*(F.struct(F.lit(f.name).alias("field"), F.col(f"n{i}").alias("records")) for i, f in enumerate(self.schema.fields)))
        return counts.select(F.explode(pairs).alias("v")).select("v.*")

    def null_count(self, name: str) -> int:
        """Records in which a field is null."""
        f = self.schema.field(name)
        if f is None:
            raise InvalidQuery(f"no field {name!r}")
        return self.df.where(column(f).isNull()).count()
