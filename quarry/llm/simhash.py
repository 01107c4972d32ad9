"""SimHash near-duplicates with bit-sliced comparison.

Fingerprints. A document's words (ASCII lower case) make shingles of four; each shingle is hashed with XXH64, and a bit of the
fingerprint is set where more than half of the hashes have it. Equal fingerprints become one row before anything is compared.

Candidates. 64 bits are cut into p pieces. Fingerprints at most ``RADIUS`` bits apart agree on some p - RADIUS pieces, so
each is listed once under every choice of p - RADIUS pieces, and only rows with the same key are compared. p grows with the
number of fingerprints (5 pieces: 5 lists with keys of 12 to 13 bits; 6: 15 lists with 21 bits; ...), so that keys hold about
``KEY_ROWS`` rows; no link can be missed at any p, and there is no cap: a key with more than ``SPLIT_ROWS`` rows is cut into
parts by another hash and every pair of parts becomes a task of its own.

Comparison. The rows of a key are stored as 64 bit planes, 64 rows to a word. A query row XORs each plane with its own bit; a
carry-save counter of three bits and an overflow bit adds the plane for all 64 rows at once. After every few planes the
words in which all 64 distances exceed the radius are abandoned. A key's links are reduced to a spanning forest at once, so
dense groups give no more edges than rows.

Components. Edges of all keys are contracted: every vertex follows its smallest neighbour to the end of that chain, by
doubling, edges between joined vertices disappear, and the rest repeat. Stars and chains of any length end in few rounds.

Cases: null texts count as empty; texts without words have fingerprint zero and link like any other; texts of fewer than
four words have their whole sequence as the only shingle; null ids never name a component unless all its ids are null;
repeated rows link to each other; an empty table gives an empty result. Only id and text are read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Carried, materialise, named, read_table, ship_package, shuffle_partitions, slices, unused

SHINGLE, RADIUS, SEED = 4, 4, 42
#: Rows that a key is planned to hold, and rows from which a key is cut into parts.
KEY_ROWS, SPLIT_ROWS = 4096, 1 << 15
#: Planes between two looks for words to abandon.
PLANES_AT_ONCE = 8
#: Query rows times words compared at once.
PAIRS_AT_ONCE = 1 << 17

_BIT = np.uint64(1) << np.arange(64, dtype=np.uint64)
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


# fingerprints


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The SimHash of a text's word shingles, unsigned."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    joined = memoryview(b" ".join(words))
    ends = list(itertools.accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[: len(words) - shingle]]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a : z - 1], seed) for a, z in zip(starts, ends[shingle - 1 :], strict=True)], np.uint64)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[i : i + (1 << 16)]).view(np.uint8)
        counts += np.unpackbits(part.reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(_BIT[counts * 2 > len(hashes)].sum())


def fingerprints(docs: DataFrame, keep: Sequence[str] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns ``keep`` with _q_id and _q_fp (the fingerprint as a signed long) appended."""
    carried = Carried(docs, keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_q_text"):
                found = np.array([fingerprint(x or b"") for x in part.column("_q_text").to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(part.num_columns - 1)] + [pa.array(found)], names=[*carried.names, "_q_id", "_q_fp"])

    ship_package(docs.sparkSession)
    schema = T.StructType([*carried.fields, T.StructField("_q_id", T.LongType()), T.StructField("_q_fp", T.LongType())])
    prints = docs.select(*carried.inside(), F.col(id_col).cast("long").alias("_q_id"), F.col(text_col).cast("binary").alias("_q_text")).mapInArrow(run, schema)
    return prints.select(*carried.outside(), "_q_id", "_q_fp")


# bit-sliced comparison


def bit_planes(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Planes (64 by words) of fingerprints, and for each word which of its 64 places are filled."""
    words = -(-len(rows) // 64)
    full = np.zeros(words * 64, np.uint64)
    full[: len(rows)] = rows
    bits = np.unpackbits(full.view(np.uint8).reshape(words, 64, 8), axis=2, bitorder="little")
    planes = np.packbits(bits.transpose(2, 0, 1), axis=2, bitorder="little").reshape(64, words, 8)
    filled = np.full(words, _ALL)
    if len(rows) % 64:
        filled[-1] = (np.uint64(1) << np.uint64(len(rows) % 64)) - np.uint64(1)
    return np.ascontiguousarray(planes).view(np.uint64).reshape(64, words), filled


def wide_planes(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Planes of fingerprints of several words (words by rows), one word's after another's."""
    both = [bit_planes(word) for word in words]
    return np.concatenate([p for p, _ in both]), both[0][1]


def near_words(queries: np.ndarray, planes: np.ndarray, filled: np.ndarray, query_of: np.ndarray, word_of: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Compare queries (one row of numbers for each 64 planes) with words of 64 rows, pair by pair. Pairs with a row within the radius, and which rows those are."""
    queries = np.atleast_2d(queries)
    counter = [np.zeros(len(query_of), np.uint64) for _ in range(radius.bit_length())]
    over = ~filled[word_of]
    for first in range(0, len(planes), PLANES_AT_ONCE):
        asked = queries[first >> 6][query_of] >> np.uint64(first & 63)
        for plane in range(PLANES_AT_ONCE):
            carry = (np.uint64(0) - ((asked >> np.uint64(plane)) & np.uint64(1))) ^ planes[first + plane][word_of]
            for k, held in enumerate(counter):
                counter[k] = held ^ carry
                carry &= held
            over |= carry
        if first + PLANES_AT_ONCE <= radius:
            continue  # nothing can be beyond the radius yet
        live = (over | _above(counter, radius)) != _ALL
        if not live.all():
            query_of, word_of, over, *counter = (x[live] for x in (query_of, word_of, over, *counter))
    return query_of, word_of, ~(over | _above(counter, radius))


def _above(counter: Sequence[np.ndarray], radius: int) -> np.ndarray:
    """Where the counter, lowest bit first, exceeds the radius."""
    out = np.zeros_like(counter[0]) if counter else np.zeros(1, np.uint64)
    equal = ~out
    for k in range(len(counter) - 1, -1, -1):
        if radius >> k & 1:
            equal &= counter[k]
        else:
            out |= equal & counter[k]
            equal &= ~counter[k]
    return out


def spanning_edges(rows: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Edges (index pairs) that connect exactly the rows that links within the radius connect. A search spreads from one row
    at a time over the rows not reached yet, so a dense group is reached in few steps and never listed pair by pair."""
    rows = np.atleast_2d(rows)
    planes, free = wide_planes(rows)
    edges, words = [], len(free)
    for seed in range(rows.shape[1]):
        if not free[seed >> 6] >> np.uint64(seed & 63) & np.uint64(1):
            continue
        free[seed >> 6] &= ~(np.uint64(1) << np.uint64(seed & 63))
        front = np.array([seed])
        while len(front):
            reached = np.zeros(words, np.uint64)
            open_words = np.flatnonzero(free)
            step = max(1, PAIRS_AT_ONCE // max(1, len(open_words)))
            for i in range(0, len(front), step):
                part = front[i : i + step]
                q, w = np.repeat(np.arange(len(part)), len(open_words)), np.tile(open_words, len(part))
                _, hit, bits = near_words(rows[:, part], planes, free, q, w, radius)
                np.bitwise_or.at(reached, hit, bits)
                free &= ~reached
                open_words = np.flatnonzero(free)
                if not len(open_words):
                    break
            front = _places(reached)
            edges += [(seed, int(k)) for k in front]
    return edges


def _places(words: np.ndarray) -> np.ndarray:
    """Row numbers of the set bits."""
    some = np.flatnonzero(words)
    bits = np.unpackbits(words[some].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    at, bit = np.nonzero(bits)
    return some[at] * 64 + bit


def small_keys_edges(rows: np.ndarray, sizes: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links within each of many small keys, whose rows follow one another; compared together. Index pairs, smaller index first."""
    words = -(-sizes // 64)
    starts = np.cumsum(sizes) - sizes
    shifted = np.repeat(np.cumsum(words) * 64 - words * 64 - starts, sizes) + np.arange(len(rows))
    padded = np.zeros(int(words.sum()) * 64, np.uint64)
    padded[shifted] = rows
    planes, _ = bit_planes(padded)
    filled = np.packbits(np.bincount(shifted, minlength=len(padded)).astype(bool).reshape(-1, 64), axis=1, bitorder="little").view(np.uint64).ravel()
    row_at = np.zeros(len(padded), np.int64)
    row_at[shifted] = np.arange(len(rows))
    each = np.repeat(words, sizes)
    query_of = np.repeat(np.arange(len(rows)), each)
    first_word = np.repeat(np.cumsum(words) - words, sizes)
    word_of = np.arange(len(query_of)) - np.repeat(np.cumsum(each) - each, each) + first_word[query_of]
    left, right = [], []
    for i in range(0, len(query_of), PAIRS_AT_ONCE):
        q, w, bits = near_words(rows, planes, filled, query_of[i : i + PAIRS_AT_ONCE], word_of[i : i + PAIRS_AT_ONCE], radius)
        at, bit = np.nonzero(np.unpackbits(bits.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")) if len(bits) else (np.zeros(0, int), np.zeros(0, int))
        a, b = q[at], row_at[w[at] * 64 + bit]
        left.append(a[a < b])
        right.append(b[a < b])
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, int), np.zeros(0, int))


# candidates and components


def pieces_for(n: int, radius: int = RADIUS, key_rows: int = KEY_ROWS) -> int:
    """The number of pieces at which keys hold about ``key_rows`` rows of ``n``."""
    for p in range(radius + 1, 2 * radius + 1):
        if n <= key_rows << (64 * (p - radius) // p):
            return p
    return 2 * radius


def key_masks(pieces: int, radius: int = RADIUS) -> list[int]:
    """A mask of the fingerprint for each choice of the pieces that have to agree."""
    edges = [64 * i // pieces for i in range(pieces + 1)]
    part = [((1 << (z - a)) - 1) << a for a, z in itertools.pairwise(edges)]
    return [sum(chosen) for chosen in itertools.combinations(part, pieces - radius)]


def _edges_of_keys(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Edges of the keys of a partition, whose rows come sorted by key; a key's rows are held together, never more than two parts of one."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for batch in itertools.chain(batches, [None]):
        if batch is not None and batch.num_rows:
            held.append(tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)))
            last = held[-1]
            if len(held) > 1 and all((last[i][0] == last[i][-1]) and last[i][0] == held[-2][i][-1] for i in (0, 1)):
                continue  # one key goes on through the whole batch
        if not held or batch is not None and not batch.num_rows:
            continue
        kind, key, rows = (np.concatenate(x) for x in zip(*held, strict=True))
        change = np.flatnonzero((kind[1:] != kind[:-1]) | (key[1:] != key[:-1])) + 1
        cut = len(rows) if batch is None else (int(change[-1]) if len(change) else 0)
        held = [(kind[cut:], key[cut:], rows[cut:])] if cut < len(rows) else []
        if cut:
            sizes = np.diff(np.concatenate(([0], change[change < cut], [cut])))
            yield _edge_batch(rows[:cut].view(np.uint64), sizes, radius)


def _edge_batch(rows: np.ndarray, sizes: np.ndarray, radius: int) -> pa.RecordBatch:
    starts = np.cumsum(sizes) - sizes
    left, right = [], []
    small = (sizes > 1) & (sizes <= 1024)
    if small.any():
        pick = np.repeat(small, sizes)
        a, b = small_keys_edges(rows[pick], sizes[small], radius)
        own = np.flatnonzero(pick)
        left.append(own[a])
        right.append(own[b])
    for k in np.flatnonzero(sizes > 1024):
        found = np.array(spanning_edges(rows[starts[k] : starts[k] + sizes[k]], radius), np.int64).reshape(-1, 2) + starts[k]
        left.append(found[:, 0])
        right.append(found[:, 1])
    a, b = (np.concatenate(x) if x else np.zeros(0, int) for x in (left, right))
    return pa.RecordBatch.from_arrays([pa.array(rows[x].view(np.int64)) for x in (a, b)], names=["_q_a", "_q_b"])


def links(different: DataFrame, n: int, radius: int = RADIUS, key_rows: int = KEY_ROWS, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """Edges (_q_a, _q_b) that connect what links within the radius connect, for ``n`` different fingerprints in _q_fp."""
    spark = different.sparkSession
    masks = key_masks(pieces_for(n, radius, key_rows), radius)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    listed = different.select("_q_fp", F.posexplode(F.array(*(F.col("_q_fp").bitwiseAND(F.lit(m).cast("long")) for m in signed))).alias("_q_kind", "_q_key"))
    tasks = split_keys(listed, F.col("_q_fp"), split_rows)
    ship_package(spark)
    dealt = tasks.select("_q_kind", "_q_task", "_q_fp").repartition(shuffle_partitions(spark), "_q_kind", "_q_task").sortWithinPartitions("_q_kind", "_q_task")
    return dealt.mapInArrow(lambda batches: _edges_of_keys(batches, radius), "_q_a long, _q_b long")


def split_keys(listed: DataFrame, row: Column, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """Rows of keys (_q_kind, _q_key) with the task that compares them: the key, or for a key of more than ``split_rows`` rows
    each pair of its parts, so that any two rows of a key meet in a task."""
    sizes = listed.groupBy("_q_kind", "_q_key").agg(F.count(F.lit(1)).alias("_q_n")).filter(F.col("_q_n") > split_rows)
    large = materialise(sizes.withColumn("_q_parts", F.ceil(F.col("_q_n") / split_rows).cast("int")).drop("_q_n"), "simhash-large")
    if large.isEmpty():
        return listed.withColumn("_q_task", F.col("_q_key"))
    # a row of part i goes to the tasks (i, j) and (j, i) of every part j
    marked = listed.join(large, ["_q_kind", "_q_key"], "left")
    own = F.pmod(F.xxhash64(F.lit(1), row), F.coalesce("_q_parts", F.lit(1))).cast("int")
    paired = marked.withColumn("_q_own", own).withColumn("_q_other", F.explode(F.sequence(F.lit(0), F.coalesce("_q_parts", F.lit(1)) - 1)))
    task = F.when(F.col("_q_parts").isNull(), F.col("_q_key")).otherwise(F.xxhash64("_q_key", F.least("_q_own", "_q_other"), F.greatest("_q_own", "_q_other")))
    return paired.withColumn("_q_task", task)


def components(edges: DataFrame) -> DataFrame:
    """vertex, root for every vertex of the edges (_q_a, _q_b); vertices of one component share the root."""
    current = materialise(edges.filter("_q_a <> _q_b").distinct(), "components-edges")
    both = current.select(F.explode(F.array("_q_a", "_q_b")).alias("vertex")).distinct()
    assigned = both.withColumn("root", F.col("vertex"))
    while not current.isEmpty():
        around = current.union(current.select("_q_b", "_q_a"))
        least = _to_the_end(materialise(around.groupBy("_q_a").agg(F.least(F.min("_q_b"), F.col("_q_a")).alias("_q_least")), "components-least"))
        assigned = materialise(assigned.join(least, assigned["root"] == least["_q_a"], "left").select("vertex", F.coalesce("_q_least", "root").alias("root")), "components-roots")
        other = least.select(F.col("_q_a").alias("_q_x"), F.col("_q_least").alias("_q_y"))
        moved = current.join(least, "_q_a").select("_q_least", "_q_b").join(other, F.col("_q_b") == F.col("_q_x")).select(F.col("_q_least").alias("_q_a"), F.col("_q_y").alias("_q_b"))
        current = materialise(moved.filter("_q_a <> _q_b").select(F.least("_q_a", "_q_b").alias("_q_a"), F.greatest("_q_a", "_q_b").alias("_q_b")).distinct(), "components-edges")
    return assigned


def _to_the_end(least: DataFrame) -> DataFrame:
    """Follow each vertex's smallest neighbour to that one's and so on, doubling the way each time, so chains take few rounds."""
    while True:
        up = least.select(F.col("_q_a").alias("_q_x"), F.col("_q_least").alias("_q_y"))
        further = least.join(up, least["_q_least"] == up["_q_x"]).select("_q_a", F.col("_q_y").alias("_q_least"), (F.col("_q_y") < F.col("_q_least")).alias("_q_moved"))
        further = materialise(further, "components-least")
        least = further.select("_q_a", "_q_least")
        if further.filter("_q_moved").isEmpty():
            return least


def near_duplicate_groups(prints: DataFrame, radius: int = RADIUS, key_rows: int = KEY_ROWS, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """_q_fp, _q_root, component_id for every different fingerprint of ``prints`` (_q_id, _q_fp): a fingerprint that stands for
    its component and no other, and the smallest id of the component."""
    different = materialise(prints.groupBy("_q_fp").agg(F.min("_q_id").alias("_q_least_id")), "simhash-different")
    roots = components(links(different.select("_q_fp"), different.count(), radius, key_rows, split_rows))
    rooted = different.join(roots, different["_q_fp"] == roots["vertex"], "left").select("_q_fp", "_q_least_id", F.coalesce("root", "_q_fp").alias("_q_root"))
    # written, so that the join deals both sides out anew and can split a hot root
    least = materialise(rooted.groupBy("_q_root").agg(F.min("_q_least_id").alias("component_id")), "simhash-least")
    return rooted.join(least, "_q_root").select("_q_fp", "_q_root", "component_id")


def simhash_near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """A row per document: doc_id, fingerprint (16 hexadecimal digits), component_id."""
    prints = materialise(fingerprints(docs, (), id_col, text_col), "simhash-prints")
    joined = prints.join(near_duplicate_groups(prints, radius), "_q_fp")
    return joined.select(F.col("_q_id").alias("doc_id"), F.lower(F.lpad(F.hex("_q_fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row of each component, with all columns of ``docs``: the row with the smallest id, the first of repeated ones; a row
    without an id stays only where its component has no id at all."""
    columns, number = docs.columns, unused(docs, "_q_row")
    rows = materialise(docs.withColumn(number, F.monotonically_increasing_id()), "simhash-rows")
    prints = materialise(fingerprints(rows, (number,)).withColumnRenamed(number, "_q_row"), "simhash-prints")
    joined = prints.join(near_duplicate_groups(prints, radius), "_q_fp").filter(F.col("_q_id").eqNullSafe(F.col("component_id")))
    # components are told apart by their root, as several may have the same smallest id or none
    first = joined.groupBy("_q_root").agg(F.min("_q_row").alias(number)).select(number)
    return rows.join(first, number, "left_semi").select(*named(columns))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_near_dedup(read_table(spark, sf_dir, "documents"))
