"""Streams into and over collections.

Compiled filters are plain columns, so they work on a streaming DataFrame as on any other; ``upserts`` feeds a stream of
records into a store, one transaction per micro-batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from ..operators.filters import compile_filter
from ..schema import Schema
from ..sources.store import StoredCollection


def matching(stream: DataFrame, schema: Schema, *filters) -> DataFrame:
    """The rows of a stream that match all filters."""
    condition = compile_filter(filters, schema)
    return stream if condition is None else stream.where(condition)


def upserts(stream: DataFrame, target: StoredCollection) -> DataStreamWriter:
    """A writer that sets every record of the stream by its key. A micro-batch is one commit, so it is visible as a whole. It is
    merged by a join; only where the target has hooks do its records pass through the driver, which bounds the size of a batch
    (set the source's rate limit)."""

    def write(batch: DataFrame, _: int) -> None:
        if not target.hooks:
            target.merge(batch)
            return
        names = [f.name for f in target.schema.fields]
        with target.store.update() as tx:
            for row in batch.toLocalIterator():
                target.set(tx, row[target.schema.key], {n: row[n] for n in names if n in batch.columns})

    return stream.writeStream.foreachBatch(write)
