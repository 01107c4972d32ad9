"""SimHash near-duplicates at a given similarity of word shingles; the near-duplicate stage of the pipeline.

Two texts are linked where the Jaccard similarity of their sets of five-word shingles (words in ASCII lower case) is 0.8 or
more. Links are followed to whole components, and one row of each stays. Fingerprints find the pairs, shingles decide them.

Fingerprints. ``WORDS`` times 64 SimHash bits over the different shingles of a text. A bit differs with probability
angle / pi, and sets at similarity 0.8 are an angle of arccos(8/9) apart, so they differ in 39 of 256 bits on average;
``RADIUS`` lies more than two standard deviations above.

Families. A key is a choice of the fingerprint's bits. With the number of rows the number of bits grows, so that a key
holds about ``KEY_ROWS`` rows, and with the bits the number of keys, so that texts at similarity 0.8 share one with
probability ``RECALL`` (more similar ones with more). The rows of a key are compared by the bit-sliced counters of
``simhash``, reduced to a spanning forest at once; no key is capped, and large ones are dealt out in pairs of parts. What
the forests of all keys connect is a family. Recall is a matter of chance and no less at any size; the README has what was
measured.

Links. The rows of a family meet once with their texts (large families in pairs of parts), and shingle sets are intersected
through an index from shingle to rows. A row that is asked joins all rows similar to it; rows of the largest component
needn't be asked, since all others are, so a family of copies costs a few questions and no list of pairs.

Cases: null texts count as empty; texts without words are equal to each other; texts of fewer than five words have their
whole sequence as the only shingle; components are told apart by a row of their own, so ids may be null or repeated; any
other column passes through, whatever its name.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, named, ship_package, shuffle_partitions, slices, unused
from .simhash import SPLIT_ROWS, components, near_words, spanning_edges, split_keys, wide_planes

SHINGLE, LEAST, SEED = 5, 0.8, 42
#: 64-bit words of a fingerprint, and differing bits up to which shingles are looked at.
WORDS, RADIUS = 4, 52
#: Rows that a key is planned to hold, and the planned share of pairs at LEAST that meet in a key.
KEY_ROWS, RECALL = 512, 0.99
#: Rows of a key up to which all pairs are compared at once, and words that one comparison takes.
SMALL, PAIRS_AT_ONCE = 4096, 1 << 15
#: Rows and bytes of text of a family that are one part.
PART_ROWS, PART_BYTES = 1 << 10, 8 << 20
#: Row numbers that are broadcast rather than joined by a shuffle of the texts.
BROADCAST_ROWS = 1 << 18
#: Shingle hashes that are counted at once.
HASHES_AT_ONCE = 1 << 12

PRINTS = tuple(f"_q_p{k}" for k in range(WORDS))
_RANDOM = np.random.default_rng(SEED)
_SALT = _RANDOM.integers(0, 1 << 63, (WORDS, 1), np.uint64)
_TURN = _RANDOM.integers(0, 1 << 62, (2, WORDS, 1), np.uint64) << np.uint64(1) | np.uint64(1)
_BIT = np.uint64(1) << np.arange(64, dtype=np.uint64)
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


# shingles and fingerprints


def shingles(text: bytes) -> np.ndarray:
    """The different shingles of a text, as sorted hashes."""
    import xxhash

    words = text.lower().split()
    digest = xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        return np.array([digest(b" ".join(words), SEED)], np.uint64)
    joined = memoryview(b" ".join(words))
    ends = list(itertools.accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[: len(words) - SHINGLE]]
    return np.unique(np.array([digest(joined[a : z - 1], SEED) for a, z in zip(starts, ends[SHINGLE - 1 :], strict=True)], np.uint64))


def wide_print(hashes: np.ndarray) -> np.ndarray:
    """``WORDS`` fingerprint words: a bit is set where more than half of the hashes, mixed once for each word, have it."""
    counts = np.zeros((WORDS, 64), np.int64)
    for i in range(0, len(hashes), HASHES_AT_ONCE):
        x = (hashes[i : i + HASHES_AT_ONCE] ^ _SALT) * _TURN[0]
        x ^= x >> np.uint64(29)
        x *= _TURN[1]
        x ^= x >> np.uint64(32)
        counts += np.unpackbits(x.view(np.uint8), axis=1, bitorder="little").reshape(WORDS, -1, 64).sum(1, dtype=np.int64)
    return np.where(counts * 2 > len(hashes), _BIT, np.uint64(0)).sum(1, dtype=np.uint64)


def printed(rows: DataFrame) -> DataFrame:
    """_q_row and the fingerprint words (as signed longs) of every row of ``rows`` (_q_row, _q_text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_q_text"):
                prints = np.array([wide_print(shingles(x or b"")) for x in part.column("_q_text").to_pylist()], np.uint64).reshape(-1, WORDS).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(prints[:, k]) for k in range(WORDS))], names=["_q_row", *PRINTS])

    ship_package(rows.sparkSession)
    return rows.mapInArrow(run, f"_q_row long, {', '.join(f'{p} long' for p in PRINTS)}")


# keys


def key_masks(n: int, key_rows: int = KEY_ROWS, recall: float = RECALL) -> list[list[int]]:
    """For each key of a corpus of ``n`` rows, masks of the fingerprint's words that choose its bits."""
    bits = min(64, max(0, math.ceil(math.log2(max(1, n) / key_rows))))
    agree = (1 - math.acos(2 * LEAST / (1 + LEAST)) / math.pi) ** bits
    times = 1 if agree >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - agree))
    random, masks = np.random.default_rng(SEED), []
    for _ in range(times):
        chosen = [0] * WORDS
        for place in random.permutation(64 * WORDS)[:bits].tolist():
            chosen[place >> 6] |= 1 << (place & 63)
        masks.append([m - (1 << 64) if m >> 63 else m for m in chosen])
    return masks


def _whole_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Key sizes, rows and fingerprints (words by rows) of some keys at a time, from rows sorted by key."""
    held: list[np.ndarray] = []
    waiting = 0
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            if not batch.num_rows:
                continue
            held.append(np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(batch.num_columns)]))
            waiting += batch.num_rows
            if waiting < SMALL or (held[-1][:2, -1] == held[0][:2, 0]).all():
                continue
        if not held:
            return
        data = np.concatenate(held, axis=1)
        change = np.flatnonzero((data[:2, 1:] != data[:2, :-1]).any(0)) + 1
        cut = data.shape[1] if batch is None else int(change[-1])
        held, waiting = ([data[:, cut:]], data.shape[1] - cut) if cut < data.shape[1] else ([], 0)
        if cut:
            yield np.diff(np.concatenate(([0], change[change < cut], [cut]))), data[2, :cut], data[3:, :cut].view(np.uint64)


def pairs_within(prints: np.ndarray, sizes: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (a before b) within the radius and in one key; the rows of a key follow one another."""
    n, starts = prints.shape[1], np.cumsum(sizes) - sizes
    words = -(-sizes // 64)
    key = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(n) + (np.cumsum(words) * 64 - words * 64 - starts)[key]
    padded = np.zeros((len(prints), int(words.sum()) * 64), np.uint64)
    padded[:, place] = prints
    planes, _ = wide_planes(padded)
    row_at = np.zeros(padded.shape[1], np.int64)
    row_at[place] = np.arange(n)
    filled = np.packbits(np.bincount(place, minlength=padded.shape[1]).astype(bool).reshape(-1, 64), axis=1, bitorder="little").view(np.uint64).ravel()
    # a row is compared with those after it
    after = place + 1
    first = after >> 6
    each = np.maximum(np.cumsum(words)[key] - first, 0)
    upto = np.concatenate(([0], np.cumsum(each)))
    at = 0
    while at < n:
        z = max(at + 1, int(np.searchsorted(upto, upto[at] + PAIRS_AT_ONCE, "right")) - 1)
        own = each[at:z]
        q = np.repeat(np.arange(at, z), own)
        w = np.arange(len(q)) - np.repeat(upto[at:z] - upto[at], own) + first[q]
        q, w, bits = near_words(prints, planes, filled, q, w, radius)
        bits = bits & np.where(w == first[q], _ALL << (after[q] & 63).astype(np.uint64), _ALL)
        hit, bit = np.nonzero(np.unpackbits(bits.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")) if len(bits) else (np.zeros(0, int), np.zeros(0, int))
        if len(hit):
            yield q[hit], row_at[w[hit] * 64 + bit]
        at = z


def join_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (each row's is the least row of its component) after joining the rows a with the rows b."""
    while True:
        low, high = np.minimum(labels[a], labels[b]), np.maximum(labels[a], labels[b])
        differ = low < high
        if not differ.any():
            return labels
        np.minimum.at(labels, high[differ], low[differ])
        while (labels[labels] != labels).any():
            labels = labels[labels]


def _forests(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Edges that connect what links within the radius connect, key by key."""
    for sizes, rows, prints in _whole_keys(batches):
        starts = np.cumsum(sizes) - sizes
        small = (sizes > 1) & (sizes <= SMALL)
        own = np.flatnonzero(np.repeat(small, sizes))
        labels = np.arange(len(own))
        for a, b in pairs_within(prints[:, own], sizes[small], radius):
            labels = join_labels(labels, a, b)
        b = np.flatnonzero(labels < np.arange(len(own)))
        found = [(own[labels[b]], own[b])]
        for k in np.flatnonzero(sizes > SMALL):
            edges = np.array(spanning_edges(prints[:, starts[k] : starts[k] + sizes[k]], radius), np.int64).reshape(-1, 2) + starts[k]
            found.append((edges[:, 0], edges[:, 1]))
        for a, b in found:
            yield pa.RecordBatch.from_arrays([pa.array(rows[a]), pa.array(rows[b])], names=["_q_a", "_q_b"])


def families(prints: DataFrame, n: int, key_rows: int = KEY_ROWS, split_rows: int = SPLIT_ROWS, radius: int = RADIUS) -> DataFrame:
    """vertex, root of the rows that links within the radius connect with another, for ``n`` rows (_q_row and the fingerprint)."""
    masks = key_masks(n, key_rows)
    keys = F.array(*(F.xxhash64(F.lit(i), *(F.col(p).bitwiseAND(F.lit(m).cast("long")) for p, m in zip(PRINTS, mask, strict=True) if m)) for i, mask in enumerate(masks)))
    listed = prints.select("_q_row", *PRINTS, F.posexplode(keys).alias("_q_kind", "_q_key"))
    tasks = split_keys(listed, F.col("_q_row"), split_rows).select("_q_kind", "_q_task", "_q_row", *PRINTS)
    dealt = tasks.repartition(shuffle_partitions(prints.sparkSession), "_q_kind", "_q_task").sortWithinPartitions("_q_kind", "_q_task")
    return components(dealt.mapInArrow(lambda batches: _forests(batches, radius), "_q_a long, _q_b long"))


# links and components


def similar_links(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Edges that connect exactly the shingle sets that similarities of ``LEAST`` or more connect."""
    n, sizes = len(sets), np.array([len(x) for x in sets], np.int64)
    values, token = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(n), sizes)[np.argsort(token, kind="stable")]
    ends = np.cumsum(np.bincount(token, minlength=len(values)))
    first = np.cumsum(sizes) - sizes
    labels, asked, edges = np.arange(n), np.zeros(n, bool), []
    while True:
        open_rows = np.flatnonzero(~asked & (labels != np.bincount(labels).argmax()))
        if not len(open_rows):
            return edges
        x = int(open_rows[0])
        asked[x] = True
        own = token[first[x] : first[x] + sizes[x]]
        counts = ends[own] - np.concatenate(([0], ends))[own]
        at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - ends[own], counts)
        common = np.bincount(owner[at], minlength=n)
        near = np.flatnonzero((5 * common >= 4 * (sizes + sizes[x] - common)) & (labels != labels[x]))
        _, one = np.unique(labels[near], return_index=True)
        for y in near[one].tolist():
            edges.append((x, y))
            labels[labels == labels[y]] = labels[x]


def _links_in_families(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of the families (_q_root, _q_task) of a partition, whose rows follow one another; texts are cut into shingles as they come."""
    held, rows, sets = None, [], []

    def flush() -> Iterator[pa.RecordBatch]:
        if len(rows) > 1:
            edges = similar_links(sets)
            yield pa.RecordBatch.from_arrays([pa.array([rows[e[k]] for e in edges], pa.int64()) for k in (0, 1)], names=["_q_a", "_q_b"])
        rows.clear()
        sets.clear()

    for batch in batches:
        for root, task, row, text in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3), strict=True):
            if held != (root, task):
                yield from flush()
                held = root, task
            rows.append(row)
            sets.append(shingles(text.as_py() or b""))
    yield from flush()


def links(rows: DataFrame, members: DataFrame, part_rows: int = PART_ROWS, part_bytes: int = PART_BYTES) -> DataFrame:
    """Edges (_q_a, _q_b) between similar rows of a family, for ``rows`` (_q_row, _q_text) and ``members`` (vertex, root)."""
    chosen = members.select(F.col("vertex").alias("_q_row"), F.col("root").alias("_q_root"))
    with_root = _among(rows, chosen, "inner")
    sized = with_root.withColumn("_q_bytes", F.coalesce(F.octet_length("_q_text"), F.lit(0)))
    sizes = sized.groupBy("_q_root").agg(F.count(F.lit(1)).alias("_q_n"), F.sum("_q_bytes").alias("_q_sum"))
    parts = F.greatest(F.ceil(F.col("_q_n") / part_rows), F.ceil(F.col("_q_sum") / part_bytes)).cast("int")
    large = materialise(sizes.select("_q_root", parts.alias("_q_parts")).filter("_q_parts > 1"), "similar-large")
    if large.isEmpty():
        tasks = with_root.withColumn("_q_task", F.lit(0).cast("long"))
    else:  # a row of part i goes to the tasks (i, j) and (j, i) of every part j
        marked = with_root.join(F.broadcast(large) if large.count() <= BROADCAST_ROWS else large, "_q_root", "left").withColumn("_q_parts", F.coalesce("_q_parts", F.lit(1)))
        own = F.pmod(F.xxhash64(F.lit(2), "_q_row"), F.col("_q_parts"))
        paired = marked.withColumn("_q_own", own).withColumn("_q_other", F.explode(F.sequence(F.lit(0), F.col("_q_parts") - 1)))
        tasks = paired.withColumn("_q_task", (F.least("_q_own", "_q_other") * F.col("_q_parts") + F.greatest("_q_own", "_q_other")).cast("long"))
    dealt = tasks.select("_q_root", "_q_task", "_q_row", "_q_text").repartition(shuffle_partitions(rows.sparkSession), "_q_root", "_q_task").sortWithinPartitions("_q_root", "_q_task")
    return dealt.mapInArrow(_links_in_families, "_q_a long, _q_b long")


def _among(rows: DataFrame, chosen: DataFrame, how: str) -> DataFrame:
    """Join on _q_row, by a broadcast of the chosen rows where these are few."""
    return rows.join(F.broadcast(chosen) if chosen.count() <= BROADCAST_ROWS else chosen, "_q_row", how)


def similar_components(rows: DataFrame, key_rows: int = KEY_ROWS, split_rows: int = SPLIT_ROWS, radius: int = RADIUS, part_rows: int = PART_ROWS) -> DataFrame:
    """vertex, root for every row of ``rows`` (_q_row, _q_text) that is similar to another."""
    prints = materialise(printed(rows), "similar-prints")
    return components(links(rows, families(prints, prints.count(), key_rows, split_rows, radius), part_rows))


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, with all columns of ``docs``: the row with the smallest id, the first of repeated ones; a row
    without an id stays only where its component has no id at all."""
    columns, number = docs.columns, unused(docs, "_q_row")
    rows = materialise(docs.withColumn(number, F.monotonically_increasing_id()), "similar-all")
    found = similar_components(rows.select(F.col(number).alias("_q_row"), F.col(text_col).cast("binary").alias("_q_text")))
    members = materialise(found.select(F.col("vertex").alias("_q_row")), "similar-vertices")
    placed = _among(rows.select(F.col(number).alias("_q_row"), F.col(id_col).cast("long").alias("_q_id")), members, "left_semi")
    placed = placed.join(found, placed["_q_row"] == found["vertex"])
    # written, so that the join deals both sides out anew and can split a hot root
    stays = materialise(placed.groupBy("root").agg(F.min(F.struct(F.col("_q_id").isNull(), "_q_id", "_q_row"))["_q_row"].alias("_q_stays")), "similar-stays")
    goes = materialise(placed.join(stays, "root").filter("_q_row <> _q_stays").select(F.col("_q_row").alias(number)), "similar-gone")
    return rows.join(F.broadcast(goes) if goes.count() <= BROADCAST_ROWS else goes, number, "left_anti").select(*named(columns))
