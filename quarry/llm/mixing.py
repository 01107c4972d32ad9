"""Mixing sources to target weights by a low-discrepancy schedule.

Targets. Sources in code-point order, null last, weigh 1, 2, 3, repeating. A target is a share of all words by weight, but
never above ``MOST`` times the source's own words; what that leaves over goes to the others by weight until none is above.
That fixed point has a closed form: with sources sorted by the level at which they are full, one running sum finds the level
that all others share, so it takes one window over the table of sources and no loop.

Schedule. A slot takes one block of ``BLOCK`` words. Slot t has the point frac((t + 1) * golden ratio), which falls into one
source's stretch of the cumulative targets; the k-th slot of a source takes the k-th block of the source's words. Slots are
ranked in chunks (rank in the chunk plus the counts of the chunks before), so no task holds a whole source. Golden-ratio
points hit every stretch almost in proportion; the few blocks by which a source is over or short at the end are left out or
appended after the last slot, so each source gives its rounded target exactly. The schedule decides the order of the mix:
a document's first slot is where its first words are taken, and mixed rows are written in the order of their slots.

Blocks. The documents of a source are shuffled by the MD5 of seed and id and laid end to end; block k covers words
k * BLOCK to (k + 1) * BLOCK of that stream, and after its end the stream starts again, at most ``MOST`` times. Stream
positions come from running sums in buckets of the hash. Documents are joined to blocks by (source, block), a key that holds
about BLOCK words, so a hot source spreads over many keys.

Cases: null or empty texts have size 0 and are taken 0 times; null sources are one source, last in order; repeated rows are
documents of their own; an empty table, or one without words, gives targets of 0; a document of which nothing is taken has no slot. The order of
input rows has no influence, so reruns agree. Other columns pass through ``apply_mix``, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, materialise, named, read_table, shuffle_partitions, unused, whole_text

#: Words that one slot takes.
BLOCK = 4096
#: Times that a source may be repeated.
MOST = 3
WEIGHTS = (1, 2, 3)
SEED = "mix"
#: Rows that a hash bucket of a source's stream, and slots that a chunk of the schedule, are planned for.
BUCKET_ROWS, CHUNK_SLOTS = 2_000, 1 << 14
GOLDEN = (math.sqrt(5) - 1) / 2


def word_count(text: str = "text") -> Column:
    return F.regexp_count(whole_text(text), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target for a table of (source, size): the capped shares, as one running sum over the sources."""
    totals = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    order = Window.partitionBy(F.lit(0)).orderBy(F.asc_nulls_last("source"))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(order) - 1) % len(WEIGHTS) + 1).cast("int"))
    weighed = totals.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * MOST)
    by_level = Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("weight"), F.asc_nulls_last("source"))
    everything = Window.partitionBy(F.lit(0))
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    )
    # a source is full when the level that would be shared from it on is at least its own; those come first in this order
    levels = weighed.withColumn("place", F.row_number().over(by_level)).withColumn("level", level).withColumn("full", F.col("level") * F.col("weight") >= F.col("cap"))
    shared = F.min(F.when(~F.col("full"), F.struct("place", "level"))).over(everything)
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(shared["level"] * F.col("weight"))
    return levels.select("source", "source_size", target.alias("target"))


def _streams(docs: DataFrame, buckets_bits: int) -> DataFrame:
    """Documents with the first word's place in their source's shuffled stream."""
    digits = max(1, math.ceil(buckets_bits / 4))
    keyed = docs.withColumn("_q_bucket", F.substring("_q_order", 1, digits))
    sums = keyed.groupBy("source", "_q_bucket").agg(F.sum("size").alias("_q_sum"))
    before = Window.partitionBy("source").orderBy("_q_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("source", "_q_bucket", F.coalesce(F.sum("_q_sum").over(before), F.lit(0)).alias("_q_base"))
    within = Window.partitionBy("source", "_q_bucket").orderBy("_q_order", "size", "_q_row").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("_q_within", F.coalesce(F.sum("size").over(within), F.lit(0)))
    offsets = offsets.select(F.col("source").alias("_q_s"), F.col("_q_bucket").alias("_q_b"), "_q_base")
    joined = placed.join(offsets, F.col("source").eqNullSafe(F.col("_q_s")) & (F.col("_q_bucket") == F.col("_q_b")))
    return joined.withColumn("_q_start", (F.col("_q_base") + F.col("_q_within")).cast("long"))


def schedule(targets: DataFrame, total_words: int, block: int = BLOCK) -> DataFrame:
    """source, slot, rank (of the slot in its source) for every slot that takes a block; rows of the table of sources meet slots by a range of points."""
    spark = targets.sparkSession
    slots = max(1, math.ceil(total_words / block))
    # points fall into equal cells; a source is listed for each cell that its stretch touches, and cells outnumber sources
    grid = max(1024, 4 * targets.count())
    order = Window.partitionBy(F.lit(0)).orderBy(F.asc_nulls_last("source"))
    upto = F.sum("target").over(order.rowsBetween(Window.unboundedPreceding, 0))
    whole = F.sum("target").over(Window.partitionBy(F.lit(0)))
    stretch = targets.filter("target > 0").withColumn("_q_to", upto / whole).withColumn("_q_from", F.coalesce(F.lag("_q_to").over(order), F.lit(0.0)))
    last = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("_q_to"), F.desc_nulls_first("source"))) == 1
    stretch = stretch.withColumn("_q_to", F.when(last, F.lit(2.0)).otherwise(F.col("_q_to")))
    cell = lambda c: F.least(F.floor(c * grid), F.lit(grid - 1)).cast("int")
    listed = stretch.withColumn("_q_cell", F.explode(F.sequence(cell(F.col("_q_from")), cell(F.col("_q_to")))))
    point = (F.col("id") + 1) * F.lit(GOLDEN)
    points = spark.range(slots).withColumn("_q_point", point - F.floor(point)).withColumn("_q_cell", cell(F.col("_q_point")))
    drawn = points.join(listed, "_q_cell").filter((F.col("_q_point") >= F.col("_q_from")) & (F.col("_q_point") < F.col("_q_to")))
    drawn = drawn.select("source", F.col("id").alias("slot"), (F.col("id") / CHUNK_SLOTS).cast("long").alias("_q_chunk"))
    counts = drawn.groupBy("source", "_q_chunk").agg(F.count(F.lit(1)).alias("_q_n"))
    before = Window.partitionBy("source").orderBy("_q_chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(F.col("source").alias("_q_s"), F.col("_q_chunk").alias("_q_c"), F.coalesce(F.sum("_q_n").over(before), F.lit(0)).alias("_q_base"))
    ranked = drawn.withColumn("_q_rank", F.row_number().over(Window.partitionBy("source", "_q_chunk").orderBy("slot")) - 1)
    joined = ranked.join(bases, F.col("source").eqNullSafe(F.col("_q_s")) & (F.col("_q_chunk") == F.col("_q_c")))
    drawn = joined.select("source", "slot", (F.col("_q_rank") + F.col("_q_base")).cast("long").alias("rank"))
    # what a source needs beyond its drawn slots follows the last slot, in order of source
    needed = targets.select(F.col("source").alias("_q_s"), F.ceil(F.round("target") / block).cast("long").alias("_q_need"))
    have = drawn.groupBy("source").agg(F.count(F.lit(1)).alias("_q_have"))
    state = needed.join(have, F.col("_q_s").eqNullSafe(F.col("source")), "left").select(F.col("_q_s").alias("source"), "_q_need", F.coalesce("_q_have", F.lit(0)).alias("_q_have"))
    short = state.filter("_q_need > _q_have").select("source", F.lit(slots).cast("long").alias("slot"), F.explode(F.sequence("_q_have", F.col("_q_need") - 1)).alias("rank"))
    limits = needed.filter("_q_need > 0")
    used = drawn.join(limits, F.col("source").eqNullSafe(F.col("_q_s")) & (F.col("rank") < F.col("_q_need"))).select("source", "slot", "rank")
    return used.unionByName(short.select("source", "slot", F.col("rank").cast("long")))


def mix(docs: DataFrame, block: int = BLOCK, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: tuple[str, ...] = ()) -> DataFrame:
    """A row per document: doc_id, size, source_size, target, taken, then the columns ``carry``."""
    spark = docs.sparkSession
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(text_col).alias("size"), key.alias("_q_order"), *(F.col(c).alias(f"_q_c_{c}") for c in carry))
    narrow = materialise(narrow.withColumn("_q_row", F.monotonically_increasing_id()), "mix-sizes")
    targets = materialise(source_targets(narrow), "mix-targets")
    n, words = narrow.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    streams = _streams(narrow, math.ceil(math.log2(max(2, n / BUCKET_ROWS))))
    near = targets.select(F.col("source").alias("_q_ts"), "source_size", "target")
    streams = streams.join(near, F.col("source").eqNullSafe(F.col("_q_ts")))
    # a slot's rank says which block of the repeated stream it takes; the last block of a source ends at its target
    slots = schedule(targets, words, block).join(near, F.col("source").eqNullSafe(F.col("_q_ts")))
    place = F.col("rank") * block
    parts = slots.withColumn("_q_from", place).withColumn("_q_to", F.least(place + block, F.round("target").cast("long"))).filter("_q_to > _q_from")
    # cut where the stream starts again; a lap is one pass over it
    lap = F.explode(F.sequence(F.floor(F.col("_q_from") / F.col("source_size")), F.floor((F.col("_q_to") - 1) / F.col("source_size"))))
    laps = parts.withColumn("_q_lap", lap)
    base = F.col("_q_lap") * F.col("source_size")
    pieces = laps.select("source", "slot", "_q_lap", (F.greatest("_q_from", base) - base).alias("_q_a"), (F.least("_q_to", base + F.col("source_size")) - base).alias("_q_z"))
    cell = lambda a, z: F.explode(F.sequence(F.floor(F.col(a) / block), F.floor((F.col(z) - 1) / block)))
    pieces = pieces.withColumn("_q_cell", cell("_q_a", "_q_z"))
    edge = F.col("_q_cell") * block
    cut = pieces.select(F.col("source").alias("_q_ps"), F.col("_q_cell").alias("_q_pc"), "slot", "_q_lap", F.greatest("_q_a", edge).alias("_q_a"), F.least("_q_z", edge + block).alias("_q_z"))
    spans = streams.filter("size > 0").select("source", "_q_row", F.col("_q_start"), (F.col("_q_start") + F.col("size")).alias("_q_end")).withColumn("_q_cell", cell("_q_start", "_q_end"))
    met = spans.join(cut, F.col("source").eqNullSafe(F.col("_q_ps")) & (F.col("_q_cell") == F.col("_q_pc")))
    met = met.withColumn("_q_common", F.least("_q_end", "_q_z") - F.greatest("_q_start", "_q_a")).filter("_q_common > 0")
    first = [F.min(F.when(F.col("_q_lap") == k, F.col("slot"))) for k in range(MOST)]
    taken = met.groupBy(F.col("_q_row").alias("_q_tr")).agg(F.sum("_q_common").cast("long").alias("_q_taken"), F.array(*first).alias("slots"))
    result = streams.join(taken, F.col("_q_row") == F.col("_q_tr"), "left")
    return result.select("doc_id", "size", "source_size", "target", F.coalesce("_q_taken", F.lit(0)).cast("long").alias("taken"), "slots", *(F.col(f"_q_c_{c}").alias(c) for c in carry))


def apply_mix(docs: DataFrame, block: int = BLOCK, seed: str = SEED) -> DataFrame:
    """The mixed documents: each row as often as its words are taken, rounded to whole copies, so at most MOST times. Rows come in
    the order of the slots that take them."""
    number, copy, slot = unused(docs, "_q_number"), unused(docs, "_q_copy"), unused(docs, "_q_slot")
    numbered = materialise(docs.withColumn(number, F.monotonically_increasing_id()), "mix-documents")
    times = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(F.lit(0)).cast("int")
    mixed = mix(numbered, block, seed, carry=(number,)).select(number, F.slice("slots", F.lit(1), times).alias(slot)).filter(F.size(slot) > 0)
    copies = numbered.join(mixed.select(number, F.posexplode(slot).alias(copy, slot)), number)
    return copies.repartitionByRange(shuffle_partitions(docs.sparkSession), slot, number).sortWithinPartitions(slot, number, copy).select(*named(docs.columns))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(read_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.array_min("slots").alias("first_slot"))


OP9_SQL = rf"""
with sized as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size,
         md5('{SEED}:' || coalesce(cast(doc_id as varchar), '')) as k
  from documents
), totals as (
  select source, cast(sum(size) as bigint) as source_size, 1 + (row_number() over (order by encode(source) nulls last) - 1) % 3 as weight from sized group by source
), leveled as (
  select *, {MOST} * source_size as cap,
         (sum(source_size) over ()::bigint - coalesce(sum({MOST} * source_size) over b, 0)::bigint) / (sum(weight) over ()::bigint - coalesce(sum(weight) over b, 0)::bigint)::double as level
  from totals
  window b as (order by ({MOST} * source_size) / weight::double, encode(source) nulls last rows between unbounded preceding and 1 preceding)
), targets as (
  select source, source_size,
         case when level * weight >= cap then cap::double
              else weight * first_value(level) over (order by level * weight >= cap, cap / weight::double, encode(source) nulls last) end as target
  from leveled
), streams as (
  select sized.*, source_size, target, cast(round(target) as bigint) as quota,
         cast(coalesce(sum(size) over (partition by sized.source order by k, size rows between unbounded preceding and 1 preceding), 0) as bigint) as start
  from sized join targets on sized.source is not distinct from targets.source
), mixed as (
  select *, case when size = 0 then 0 else size * (quota // source_size) + greatest(0, least(size, quota % source_size - start)) end as taken from streams
), counted as (
  select cast(greatest(1, ceil(sum(size) / {BLOCK}.0)) as bigint) as slots from sized
), cumulative as (
  select source, sum(target) over (order by encode(source) nulls last rows between unbounded preceding and current row) / sum(target) over () as upto from targets where target > 0
), stretches as (
  select source, coalesce(lag(upto) over (order by encode(source) nulls last), 0) as a, case when row_number() over (order by encode(source) desc nulls first) = 1 then 2 else upto end as z
  from cumulative
), points as (
  select t, (t + 1) * {GOLDEN:.17e} - floor((t + 1) * {GOLDEN:.17e}) as x from (select unnest(generate_series(0, (select slots - 1 from counted))) as t)
), drawn as (
  select source, t as slot, row_number() over (partition by source order by t) - 1 as rank from points join stretches on x >= a and x < z
)
select doc_id, size, source_size, target, taken, case when taken > 0 then coalesce(slot, (select slots from counted)) end as first_slot
from mixed left join drawn on mixed.source is not distinct from drawn.source and rank = start // {BLOCK}
"""
