"""Exact duplicates by an extendible-hash index on shared files, with DataFrame operations only.

Two texts are equal when they are the same after deleting ASCII white space.

* Entries. One pass writes a narrow row per document (id, length, 64-bit hash, SHA-256) to the shared folder.
* Directory. The different hashes are counted by their first bits. Starting from one bucket, every bucket with more than
  ``capacity`` hashes splits into two by the next bit, and the directory doubles with the deepest bucket, until all fit. It
  says for each prefix of ``depth`` bits which bucket holds it, is written once, and has about four times n / capacity rows.
* Buckets. Documents find their bucket in the directory and are grouped in it by (hash, normalised bytes): equality is a
  comparison of bytes and never of hashes, and copies collapse in the map tasks before anything is shuffled, so a group with
  a third of all rows costs one row per map task. Owner tasks take ranges of buckets, chain the texts that share a hash
  (slot 0, 1, ...) and write their buckets, in order, to a file each.
* Lookup. Each entry goes through the directory to its bucket, and there to the place in the chain whose text it has; bytes
  have been compared by then, so the chain is told apart by SHA-256. The join is a sort-merge join, whose hot keys adaptive
  execution splits.

Cases: null text is the empty text and equal to any text of white space only. Ties in length go to the smallest id; a
null id comes after all others. If the same id occurs more than once with the text that stays, one of those rows is kept.
An empty table gives an empty result. Other columns pass through ``drop_exact_duplicates``, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, named, read_table, shuffle_partitions

#: Hashes that a bucket holds before it splits: a share of all, within these bounds.
LEAST_CAPACITY, MOST_CAPACITY, PLANNED_BUCKETS = 1 << 10, 1 << 20, 1 << 12
#: Rows of the directory, and rows with a repeated id, up to which they are broadcast.
DIRECTORY_BROADCAST, REPEATS_BROADCAST = 1 << 17, 100_000


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def _keyed(rows: DataFrame, id_: Column, text: Column, *carry: str) -> DataFrame:
    """The columns ``carry`` with the id, the length of the original text, the normalised text and its hash."""
    return rows.select(*carry, id_.cast("long").alias("_q_id"), F.length(F.coalesce(text, F.lit(""))).alias("_q_len"), normalised(text).alias("_q_norm")).withColumn("_q_hash", F.xxhash64("_q_norm"))


def _entries(rows: DataFrame, id_: Column, text: Column, *carry: str) -> DataFrame:
    return _keyed(rows, id_, text, *carry).withColumn("_q_sha", F.sha2("_q_norm", 256)).drop("_q_norm")


def _whole(value) -> Column:
    return (F.lit(Decimal(value)) if isinstance(value, int) else value).cast("decimal(38,0)")


def _rank_key() -> Column:
    """Longest text first, then smallest id, null ids last, as one number that a hash aggregate can take the maximum of."""
    after = F.coalesce(_whole(2**63) - _whole(F.col("_q_id")), _whole(0))
    return _whole(_whole(F.col("_q_len")) * _whole(2**66) + after)


# directory


@dataclass
class Directory:
    """_q_prefix (the first ``depth`` bits of a hash), _q_bucket (the lowest hash that the bucket can hold), _q_depth (its own depth)."""

    table: DataFrame
    depth: int
    rows: int

    def place(self, rows: DataFrame) -> DataFrame:
        """Rows that have a _q_hash, with their bucket."""
        table = self.table.select("_q_prefix", "_q_bucket")
        table = F.broadcast(table) if self.rows <= DIRECTORY_BROADCAST else table
        return rows.withColumn("_q_prefix", _prefix(self.depth)).join(table, "_q_prefix").drop("_q_prefix")


def _prefix(depth: int) -> Column:
    return F.shiftrightunsigned("_q_hash", 64 - depth) if depth else F.lit(0).cast("long")


def default_capacity(n: int) -> int:
    return min(MOST_CAPACITY, max(LEAST_CAPACITY, n // PLANNED_BUCKETS))


def build_directory(entries: DataFrame, capacity: int | None = None) -> Directory:
    """The directory of the hashes in _q_hash. Only counts by prefix take part; a hash that occurs often counts once."""
    hashes = materialise(entries.select("_q_hash").distinct(), "exact-hashes")
    n = hashes.count()
    capacity = capacity or default_capacity(n)
    depth = min(64, max(0, math.ceil(math.log2(max(1, n) / capacity))) + 2)
    while True:
        counts = materialise(hashes.groupBy(_prefix(depth).alias("_q_prefix")).agg(F.count(F.lit(1)).alias("_q_n")), "exact-counts")
        if depth == 64 or counts.filter(F.col("_q_n") > capacity).isEmpty():
            break
        depth = min(64, depth + 2)
    # all doublings at once: the bucket of a prefix is its first stretch of bits that holds few enough
    levels = counts.withColumn("_q_depth", F.explode(F.sequence(F.lit(0), F.lit(depth))))
    levels = levels.withColumn("_q_stem", F.when(F.col("_q_depth") > 0, F.expr(f"shiftrightunsigned(_q_prefix, {depth} - _q_depth)")).otherwise(F.lit(0).cast("long")))
    fits = levels.groupBy("_q_depth", "_q_stem").agg(F.sum("_q_n").alias("_q_sum")).filter((F.col("_q_sum") <= capacity) | (F.col("_q_depth") == depth)).drop("_q_sum")
    first = levels.join(fits, ["_q_depth", "_q_stem"]).groupBy("_q_prefix").agg(F.min("_q_depth").alias("_q_depth"))
    low = F.when(F.col("_q_depth") > 0, F.expr(f"shiftleft(shiftrightunsigned(_q_prefix, {depth} - _q_depth), 64 - _q_depth)")).otherwise(F.lit(0).cast("long"))
    table = materialise(first.withColumn("_q_bucket", low), "exact-directory")
    return Directory(table, depth, table.count())


# buckets


def build_index(keyed: DataFrame, directory: Directory) -> DataFrame:
    """The index, written to the shared folder bucket by bucket: a row per different text, with its bucket, hash, slot in the
    chain, SHA-256, kept id and size."""
    placed = directory.place(keyed.withColumn("_q_rank", _rank_key()).select("_q_hash", "_q_norm", "_q_rank"))
    grouped = placed.groupBy("_q_bucket", "_q_hash", "_q_norm").agg(F.max("_q_rank").alias("_q_rank"), F.count(F.lit(1)).alias("_q_size"))
    # narrow rows are written before they are dealt out by ranges, which reads them twice
    narrow = materialise(grouped.select("_q_bucket", "_q_hash", F.sha2("_q_norm", 256).alias("_q_sha"), "_q_rank", "_q_size"), "exact-groups")
    owners = narrow.repartitionByRange(shuffle_partitions(keyed.sparkSession), "_q_bucket")
    chained = owners.withColumn("_q_slot", F.row_number().over(Window.partitionBy("_q_bucket", "_q_hash").orderBy("_q_sha")) - 1)
    return materialise(chained, "exact-buckets")


def look_up(entries: DataFrame, index: DataFrame, directory: Directory) -> DataFrame:
    """Entries with their group's kept id and size, and whether the row has the kept id and length."""
    joined = directory.place(entries).join(index.select("_q_bucket", "_q_hash", "_q_sha", "_q_rank", "_q_size"), ["_q_bucket", "_q_hash", "_q_sha"])
    low = F.col("_q_rank") % _whole(2**66)
    return joined.withColumn("_q_keep", F.when(low > 0, _whole(_whole(2**63) - low).cast("long"))).withColumn("_q_best", _rank_key() == F.col("_q_rank"))


def _first_of_repeats(entries: DataFrame) -> tuple[DataFrame, int]:
    """Of each (id, text) that occurs more than once, the first row's number; how many there are."""
    repeats = entries.groupBy("_q_id", "_q_len", "_q_hash", "_q_sha").agg(F.min("_q_row").alias("_q_first"), F.count(F.lit(1)).alias("_q_times")).filter("_q_times > 1").drop("_q_times")
    repeats = materialise(repeats, "exact-repeats")
    return repeats, repeats.count()


def _one_of_repeats(rows: DataFrame, repeats: DataFrame, n: int) -> DataFrame:
    """Clear _q_best on all but the first of the rows that repeat an id and a text."""
    if not n:
        return rows
    names = ["_q_id", "_q_len", "_q_hash", "_q_sha"]
    right = repeats.select(*(F.col(c).alias(f"{c}_r") for c in names), "_q_first")
    right = F.broadcast(right) if n <= REPEATS_BROADCAST else right
    same = F.col("_q_id").eqNullSafe(F.col("_q_id_r")) & (F.col("_q_len") == F.col("_q_len_r")) & (F.col("_q_hash") == F.col("_q_hash_r")) & (F.col("_q_sha") == F.col("_q_sha_r"))
    best = F.col("_q_best") & (F.col("_q_first").isNull() | (F.col("_q_row") == F.col("_q_first")))
    return rows.join(right, same, "left").withColumn("_q_best", best)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int | None = None) -> DataFrame:
    """A row per document: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text)."""
    id_, text = named((id_col, text_col))
    entries = materialise(_entries(docs, id_, text).withColumn("_q_row", F.monotonically_increasing_id()), "exact-entries")
    directory = build_directory(entries, capacity)
    index = build_index(_keyed(docs, id_, text), directory)
    decided = _one_of_repeats(look_up(entries, index, directory), *_first_of_repeats(entries))
    return decided.select(
        F.col("_q_id").alias("doc_id"), F.col("_q_keep").alias("keep_id"), F.col("_q_size").alias("group_size"),
        F.col("_q_best").alias("kept"), F.col("_q_sha").alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with all of its columns."""
    rows = docs.select(F.struct(*named(docs.columns)).alias("_q_all"))
    id_, text = F.col("_q_all")[id_col], F.col("_q_all")[text_col]
    entries = materialise(_entries(rows, id_, text).withColumn("_q_row", F.monotonically_increasing_id()), "exact-entries")
    repeats, n = _first_of_repeats(entries)
    carry = ("_q_all",)
    if n:  # row numbers must be the same in every pass, so they are written with the rows
        rows = materialise(rows.withColumn("_q_row", F.monotonically_increasing_id()), "exact-rows")
        carry = ("_q_all", "_q_row")
        repeats, n = _first_of_repeats(_entries(rows, id_, text, "_q_row"))
    directory = build_directory(entries, capacity)
    index = build_index(_keyed(rows, id_, text), directory)
    stays = _one_of_repeats(look_up(_entries(rows, id_, text, *carry), index, directory), repeats, n).filter("_q_best")
    return stays.select("_q_all.*")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read_table(spark, sf_dir, "documents"))


OP2_SQL = r"""
with t as (
  select doc_id, length(coalesce(text, '')) as len, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as norm from documents
)
select doc_id,
       first_value(doc_id) over w as keep_id,
       cast(count(*) over (partition by norm) as bigint) as group_size,
       row_number() over w = 1 as kept,
       sha256(norm) as text_sha256
from t
window w as (partition by norm order by len desc, doc_id nulls last rows between unbounded preceding and unbounded following)
"""
