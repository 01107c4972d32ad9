"""Sharding by jump consistent hashing, with DataFrame operations only.

The law is ``key``: an integer id and the number of shards decide the shard, and adding a shard moves rows only into the
new one. The jump hash (Lamping and Veach, 2014) needs no table of ring points. Its 64-bit linear congruential generator
is computed in 32-bit halves, since SQL integers raise an error on overflow. One run of jumps gives both the shard among
n and the shard among n + 1: it is the last jump below n, unless the next one lands on n.

Slots number the rows of a shard from 0 without a gap. A shard is cut into chunks by the generator's next bits, rows are
numbered within (shard, chunk) and the sizes of the chunks before are added, so no task gets a whole shard. The chunk
sizes come from a pass that reads only the id.

Cases: a null id hashes as 0; a null text has no bytes; repeated rows share a shard and have slots of their own; an empty
table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, whole_text

SHARDS = 40
#: Rows that a chunk of a shard is planned for.
CHUNK_ROWS = 20_000
#: Bytes that a row has besides its text.
ROW_BYTES = 16
#: The multiplier of the jump hash's generator: a fixed value of the published algorithm.
MULTIPLIER = 2862933555777941757
#: Jumps allowed; their number is about ln(shards), and more than this raises an error instead of giving a wrong shard.
MAX_JUMPS = 64

_LOW, _HIGH = MULTIPLIER & 0xFFFFFFFF, MULTIPLIER >> 32


def _product(x: Column, y: int) -> Column:
    """A 32-bit product that is right modulo 2**32 and stays far below 2**63."""
    half = _long(65535)
    return x.bitwiseAND(half) * _long(y) + F.shiftleft((F.shiftright(x, 16) * _long(y)).bitwiseAND(half), 16)


def _long(value: int) -> Column:
    return F.lit(value).cast("long")


def _jump(state: Column) -> Column:
    """One turn of the jump hash's loop: step the generator, keep the last jump in b and draw the next in j."""
    word = _long(0xFFFFFFFF)
    low = _product(state["lo"], _LOW) + _long(1)
    carry = F.shiftright(low, 32) + F.shiftright(F.shiftright(state["lo"], 16) * _long(_LOW), 16)
    high = (carry + _product(state["hi"], _LOW) + _product(state["lo"], _HIGH)).bitwiseAND(word)
    after = F.floor((state["j"] + _long(1)) * (F.lit(2147483648.0) / (F.shiftright(high, 1) + _long(1)))).cast("long")
    return F.struct(low.bitwiseAND(word).alias("lo"), high.alias("hi"), state["j"].alias("b"), after.alias("j"))


def jump_state(key: Column, shards: int) -> Column:
    """Struct of lo and hi (the generator's state), b (the shard among ``shards``) and j (the next jump, at or past ``shards``)."""
    key = F.coalesce(key.cast("long"), _long(0))
    start = F.struct(key.bitwiseAND(_long(0xFFFFFFFF)).alias("lo"), F.shiftrightunsigned(key, 32).alias("hi"), _long(0).alias("b"), _long(0).alias("j"))
    turns = F.sequence(F.lit(1), F.lit(min(shards, MAX_JUMPS)))
    done = F.aggregate(turns, start, lambda state, _: F.when(state["j"] >= shards, state).otherwise(_jump(state)))
    return done if shards <= MAX_JUMPS else F.when(done["j"] >= shards, done).otherwise(F.raise_error(F.lit("too many jumps")))


def shard_documents(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """A row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard (the shard among shards + 1)."""
    chunks = max(1, math.ceil(docs.count() / (shards * chunk_rows)))

    def placed(*carry: Column) -> DataFrame:
        state = docs.select(F.col(id_col).cast("long").alias("_q_id"), *carry, jump_state(F.col(id_col), shards).alias("_q_s"))
        return state.select(
            "*", F.col("_q_s.b").cast("int").alias("_q_shard"), (F.col("_q_s.hi") % chunks).cast("int").alias("_q_chunk"),
            F.when(F.col("_q_s.j") == shards, F.lit(shards)).otherwise(F.col("_q_s.b")).cast("int").alias("_q_grown"),
        ).drop("_q_s")

    counts = placed().groupBy("_q_shard", "_q_chunk").agg(F.count(F.lit(1)).alias("_q_n"))
    before = Window.partitionBy("_q_shard").orderBy("_q_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_q_offset", F.coalesce(F.sum("_q_n").over(before), _long(0))).drop("_q_n")
    text = whole_text(text_col)
    rows = placed((F.octet_length(text) + F.lit(ROW_BYTES)).cast("long").alias("_q_size"), F.crc32(text.cast("binary")).alias("_q_crc"))
    within = Window.partitionBy("_q_shard", "_q_chunk").orderBy(F.asc_nulls_first("_q_id"), "_q_crc", "_q_size")
    numbered = rows.withColumn("_q_rank", F.row_number().over(within) - 1)
    return numbered.join(offsets, ["_q_shard", "_q_chunk"]).select(
        F.col("_q_id").alias("doc_id"), F.col("_q_size").alias("size"), F.col("_q_crc").alias("text_crc32"), F.lit("key").alias("law"),
        F.col("_q_shard").alias("shard"), (F.col("_q_offset") + F.col("_q_rank")).cast("long").alias("slot"), F.col("_q_grown").alias("grown_shard"),
    )


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(read_table(spark, sf_dir, "documents"))


def _crc_bits() -> list[int]:
    """What each bit of a byte adds to a CRC-32, by the rule of its polynomial."""
    found = []
    for bit in range(8):
        c = 1 << bit
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        found.append(c)
    return found


#: SQL for the table entry of the byte {0}: an exclusive or over its bits.
_CRC_SQL = "0"
for _bit, _value in enumerate(_crc_bits()):
    _CRC_SQL = f"xor({_CRC_SQL}, (({{0}} >> {_bit}) & 1) * {_value})"

OP8_SQL = f"""
with recursive t as (
  select row_number() over () as r, doc_id, encode(coalesce(text, '')) as b,
         cast((cast(coalesce(doc_id, 0) as hugeint) + 18446744073709551616::hugeint) % 18446744073709551616::hugeint as hugeint) as key
  from documents
), loop as (
  select r, key, 0::bigint as b, 0::bigint as j from t
  union all
  select r, k, j, cast(floor((j + 1) * (2147483648::double / cast((k >> 33) + 1 as double))) as bigint)
  from (select r, (key * {MULTIPLIER}::hugeint + 1) % 18446744073709551616::hugeint as k, j from loop where j < {SHARDS})
), done as (
  select r, b as shard, case when j = {SHARDS} then {SHARDS} else b end as grown, cast((key >> 32) % (select greatest(1, ceil(count(*) / {SHARDS * CHUNK_ROWS}.0)) from documents)::bigint as bigint) as chunk
  from loop where j >= {SHARDS}
), sums as (
  select r, doc_id, octet_length(b) + {ROW_BYTES} as size,
         xor(list_reduce(list_prepend(4294967295::bigint, list_transform(regexp_extract_all(hex(b), '..'), lambda h: cast('0x' || h as bigint))),
             lambda c, x: xor(c >> 8, {_CRC_SQL.format("xor(c & 255, x)")})), 4294967295) as crc
  from t
)
select doc_id, cast(size as bigint) as size, cast(crc as bigint) as text_crc32, 'key' as law, cast(shard as integer) as shard,
       row_number() over (partition by shard order by chunk, doc_id nulls first, crc, size) - 1 as slot, cast(grown as integer) as grown_shard
from sums join done using (r)
"""
