"""Repeated substrings, found by prefix-free parsing and suffix order.

A byte goes where a string of ``LENGTH`` bytes covers it that also starts anywhere else in the corpus. Comparing every start
with every other is done through a parse, so that only a phrase end in each stretch of text is looked at.

* Parse. A rolling hash of ``GRAM`` bytes is computed at every byte. The trigger of a start p is the place with the least
  hash among p .. p + WINDOW - 1 (the first of equal ones). It depends on nothing but the string at p, so equal strings have
  their triggers at the same distance, and phrases that end at triggers are at most WINDOW long. All starts with one trigger
  t are decided together: they are told apart by the end of the phrase before t and by the text after t.
* Candidates. Strings that repeat agree on the ``LENGTH - WINDOW + 1`` bytes after their trigger. Triggers whose hash of
  these bytes occurs once are done; this only prunes, a hash collision costs time and nothing else.
* Contexts. For the others (phrase before t, LENGTH bytes from t) is counted by its bytes in the map tasks, so that any number
  of copies is one row of a map task.
* Order. Contexts that share a trigger's bytes meet in a task in the order of the text after t (the suffixes of the parse),
  with the common prefix of neighbours; the phrases before t are sorted by their reversed bytes (the suffixes of the
  dictionary), with the common suffix of neighbours. At distance o two contexts hold the same string just when they share o
  bytes before t and LENGTH - o after it: both orders, cut where the common part is shorter, give the classes, and a class
  of two starts or more repeats. No hash takes part in this.
* A trigger that occurs more than ``HOT`` times is looked at in ``PARTS`` ranges of the distance o, each with contexts cut
  to what that range can see, so that a passage with countless surroundings falls together again before it is shuffled.

Passages. A run of 50 words can be shorter than LENGTH. The same parse over words (a hash each) instead of bytes finds the
50-word sequences, whatever white space is between the words, that also occur in another document and do not lie within
what is removed already. Triggers whose ten words occur in one document only, or only within removed bytes, are done; the
others' sequences are compared by hashes of 64 bits; of those within removed bytes only the ones whose hash is marked as
that of an open one. Marks are a table of fixed size that keeps rows from joins which can't find anything; when it fills up,
with some hundred million keys, joins get more rows and find the same. They are reported and not removed.

Cases: null texts are empty; rows with the same id and text are one document for passages; documents shorter than LENGTH lose nothing; repeated rows are occurrences of each other;
strings never cross documents; a text of one repeated byte is handled like any other; null ids stay null. Only id and text
are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialise, read_table, ship_package, shuffle_partitions, slices, whole_text

LENGTH, WINDOW, GRAM = 400, 256, 16
#: Occurrences from which a trigger's distances are looked at in parts, and how many parts.
HOT, PARTS = 20_000, 8
#: Bytes parsed and contexts ordered at once, and contexts cut from a document at once.
BYTES_AT_ONCE, CONTEXTS_AT_ONCE, CUT_AT_ONCE = 1 << 20, 1 << 14, 1 << 12
#: Bits of a place in what is parsed at once. Hashes give up as many, the same for every block, so that equal strings agree.
PLACE_BITS = 22
#: Bytes of contexts that a map task holds to count equal ones.
TABLE_BYTES = 32 << 20

_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)


@dataclass(frozen=True)
class Rule:
    """Which strings repeat: their length, and how triggers are chosen."""

    length: int = LENGTH
    window: int = WINDOW
    gram: int = GRAM
    hot: int = HOT
    parts: int = PARTS

    def ranges(self, hot: bool) -> list[tuple[int, int, int]]:
        """Number, first and last distance of each range of distances."""
        if not hot:
            return [(0, 0, self.window - 1)]
        step = -(-self.window // self.parts)
        return [(1 + k, a, min(a + step, self.window) - 1) for k, a in enumerate(range(0, self.window, step))]


#: Passages: words, with the places among which a trigger is chosen and the words that are hashed for it.
PASSAGES = Rule(50, 41, 10)
#: Names of rows (two numbers each) that are broadcast rather than joined by a shuffle of the texts.
BROADCAST_ROWS = 1 << 20
#: Places, as a power of two, of a table that marks hashes. It goes to the driver and the executors: 16 MB at any size.
MARK_BITS = 27


# the parse


def _powers(base: int, n: int) -> np.ndarray:
    powers = np.full(n, base, np.uint64)
    powers[0] = 1
    return np.cumprod(powers, dtype=np.uint64)


def rolling_hashes(b: np.ndarray, gram: int) -> np.ndarray:
    """A mixed hash of the ``gram`` bytes from each place on, by doubling."""
    h, width, base, done = b.astype(np.uint64) + np.uint64(1), 1, _BASE, None
    at = 0
    while gram:
        if gram & 1:
            part = h[at : len(b) - width + 1]
            done = part if done is None else done[: len(part)] * np.uint64(pow(base, 1, 1 << 64)) + part[: len(done)]
            at += width
        gram >>= 1
        if gram:
            h = h[:-width] * np.uint64(base) + h[width:]
            width, base = width * 2, base * base % (1 << 64)
    done = done * _MIX
    done ^= done >> np.uint64(29)
    return done * np.uint64(_BASE)


def _window_least(values: np.ndarray, window: int) -> np.ndarray:
    """The least of each ``window`` values from each place on, by doubling."""
    width = 1
    while width * 2 <= window:
        values = np.minimum(values[:-width], values[width:])
        width *= 2
    rest = window - width
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def triggers(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of documents laid end to end: document, place of each trigger, first start that has it (both within the document), key of the bytes after it."""
    empty = np.zeros(0, np.int64)
    if not len(sizes) or sizes.max() < rule.length:
        return empty, empty, empty, empty
    bits = np.uint64(max(PLACE_BITS, int(len(data)).bit_length()))
    hashes = rolling_hashes(data, rule.gram)
    least = _window_least((hashes >> bits << bits) | np.arange(len(hashes), dtype=np.uint64), rule.window)
    place = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    counts = np.maximum(sizes - rule.length + 1, 0)
    valid = np.repeat(starts, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    of = np.repeat(np.arange(len(sizes)), counts)
    t = place[valid]
    new = np.concatenate(([True], (t[1:] != t[:-1]) | (of[1:] != of[:-1])))
    t, first, of = t[new], valid[new], of[new]
    span = rule.length - rule.window + 1
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(data)), dtype=np.uint64)))
    key = (sums[t + span] - sums[t]) * _powers(pow(_BASE, -1, 1 << 64), len(data))[t]
    key = (key ^ (key >> np.uint64(31))) * _MIX
    return of, t - starts[of], first - starts[of], key.view(np.int64)


def triggers_in_pieces(data: np.ndarray, rule: Rule, most: int = BYTES_AT_ONCE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Place, first start and key of the triggers of one document, for about ``most`` starts at once."""
    last = -1
    for a in range(0, max(0, len(data) - rule.length + 1), most):
        piece = data[a : a + most + rule.length - 1]
        _, t, first, key = triggers(piece, np.zeros(1, np.int64), np.array([len(piece)]), rule)
        new = t + a > last  # the piece before may have its last trigger in common with this one
        last = int(t[-1]) + a
        yield t[new] + a, first[new] + a, key[new]


def _triggers_of(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", most=BYTES_AT_ONCE):
            texts = part.column("text").to_pylist()
            sizes = np.array([len(x) for x in texts], np.int64)
            data = np.frombuffer(b"".join(texts), np.uint8)
            if len(texts) == 1:
                found = ((np.zeros(len(t), np.int64), t, first, key) for t, first, key in triggers_in_pieces(data, rule))
            else:
                found = [triggers(data, np.cumsum(sizes) - sizes, sizes, rule)]
            for of, t, first, key in found:
                columns = [part.column(c).take(pa.array(of)) for c in ("dk", "tk")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(t.astype(np.int32)), pa.array(first.astype(np.int32)), pa.array(key)], names=["dk", "tk", "t", "first", "key"])


# contexts


def _candidates(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[list[tuple[int, int, int, int, bytes, bytes]]]:
    """Contexts of the candidate triggers of one row after another, some at once: (id, hash, place, part, phrase before, text after)."""
    for batch in batches:
        for part in slices(batch, "text", most=BYTES_AT_ONCE):
            for row in range(part.num_rows):
                text, dk, tk = (part.column(c)[row].as_py() for c in ("text", "dk", "tk"))
                found, made = part.column("found")[row].values, []
                for t, first, hot in zip(*(found.field(c).to_pylist() for c in ("t", "first", "hot")), strict=True):
                    for number, low, high in rule.ranges(hot):
                        if t - first < low:
                            break
                        made.append((dk, tk, t, number, text[max(first, t - high) : t], text[t : t + rule.length - low]))
                    if len(made) >= CUT_AT_ONCE:
                        yield made
                        made = []
                yield made


def _contexts_of(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[pa.RecordBatch]:
    """Each different context of a map task with its count; the table is passed on when it grows too large."""
    seen: dict[tuple[int, bytes, bytes], int] = {}
    held = 0

    def passed_on() -> Iterator[pa.RecordBatch]:
        rows = list(seen.items())
        for i in range(0, len(rows), 8192):
            keys, counts = zip(*rows[i : i + 8192], strict=True)
            numbers, es, rs = zip(*keys, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(es, pa.binary()), pa.array(rs, pa.binary()), pa.array(counts, pa.int64())], names=["part", "e", "r", "n"])
        seen.clear()

    for made in _candidates(batches, rule):
        for _, _, _, number, e, r in made:
            times = seen.get((number, e, r), 0)
            seen[number, e, r] = times + 1
            held += 0 if times else len(e) + len(r) + 200
        if held > TABLE_BYTES:
            yield from passed_on()
            held = 0
    yield from passed_on()


def _occurrences_of(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[pa.RecordBatch]:
    """Where each context occurs, with only the context's digest."""
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
    for made in _candidates(batches, rule):
        if made:
            columns = zip(*((dk, tk, t, number, _digest(number, e, r)) for dk, tk, t, number, e, r in made), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["dk", "tk", "t", "part", "context"])


def _digest(number: int, e: bytes, r: bytes) -> bytes:
    return hashlib.blake2b(b"%d,%d," % (number, len(e)) + e + r, digest_size=16).digest()


# suffix order


def _matrix(values: list[bytes], width: int) -> np.ndarray:
    """Rows of bytes, filled up with zeros."""
    return np.frombuffer(b"".join(v.ljust(width, b"\0") for v in values), np.uint8).reshape(len(values), width)


def _common(rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Length of the prefix that each row shares with the row before it."""
    out = np.zeros(len(rows), np.int64)
    if len(rows) > 1:
        differ = rows[1:] != rows[:-1]
        n = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
        out[1:] = np.minimum(n, np.minimum(sizes[1:], sizes[:-1]))
    return out


def repeated_distances(group: np.ndarray, e: list[bytes], r: list[bytes], n: np.ndarray, rule: Rule, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For contexts sorted by (group, r): which distances o (columns) give a string that starts more than once."""
    size_e, size_r = np.array([len(x) for x in e]), np.array([len(x) for x in r])
    after = _common(_matrix(r, max(1, rule.length)), size_r)
    after[0] = -1
    after[1:][group[1:] != group[:-1]] = -1
    backwards = _matrix([x[::-1] for x in e], max(1, rule.window))
    order = np.lexsort(np.concatenate((size_e[None, :], np.ascontiguousarray(backwards).T[::-1])))
    before = _common(backwards[order], size_e[order])
    before[0] = -1
    out = np.zeros((len(e), rule.window), bool)
    for o in range(int(low.min(initial=0)), int(high.max(initial=-1)) + 1):
        rows = np.flatnonzero((size_e >= o) & (size_r >= rule.length - o) & (low <= o) & (o <= high))
        if not len(rows):
            continue
        class_r = np.cumsum(after < rule.length - o)[rows]
        class_e = np.empty(len(e), np.int64)
        class_e[order] = np.cumsum(before < o)
        both = class_r * (len(e) + 1) + class_e[rows]
        _, which, times = np.unique(both, return_inverse=True, return_counts=True)
        total = np.bincount(which, n[rows])
        out[rows, o] = total[which] > 1
    return out


def _decide(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[pa.RecordBatch]:
    """Rows (key, part, e, r, n) in the order of (key, part, r, e) to the repeated ranges of distances of each context."""
    limits = {number: (low, high) for hot in (False, True) for number, low, high in rule.ranges(hot)}
    held: list[pa.RecordBatch] = []
    waiting = 0

    def flush(table: pa.Table) -> pa.RecordBatch:
        key, part, n = (table.column(c).to_numpy() for c in ("key", "part", "n"))
        change = np.concatenate(([False], (key[1:] != key[:-1]) | (part[1:] != part[:-1])))
        group = np.cumsum(change)
        alone = (np.bincount(group)[group] == 1) & (n == 1)
        pick = np.flatnonzero(~alone)
        e, r = (table.column(c).take(pa.array(pick)).to_pylist() for c in ("e", "r"))
        # the same context from several map tasks: its rows follow one another
        first = np.array([not i or group[pick[i]] != group[pick[i - 1]] or r[i] != r[i - 1] or e[i] != e[i - 1] for i in range(len(pick))], bool)
        at = np.flatnonzero(first)
        if len(at):
            n = n.copy()
            n[pick[at]] = np.add.reduceat(n[pick], at)
        pick, e, r = pick[at], [e[i] for i in at], [r[i] for i in at]
        low, high = (np.array([limits[p][i] for p in part[pick]], np.int64) for i in (0, 1))
        mask = repeated_distances(group[pick], e, r, n[pick], rule, low, high) if len(pick) else np.zeros((0, rule.window), bool)
        edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
        row, from_o = np.nonzero(edge == 1)
        _, to_o = np.nonzero(edge == -1)
        contexts = [_digest(int(part[pick[k]]), e[k], r[k]) for k in row]
        return pa.RecordBatch.from_arrays([pa.array(contexts, pa.binary()), pa.array(from_o.astype(np.int32)), pa.array((to_o - 1).astype(np.int32))], names=["context", "low", "high"])

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column("key")
        more = not held or keys[-1] != held[-1].column("key")[-1]  # in order: otherwise all of the batch belongs to the last key
        held.append(batch)
        waiting += batch.num_rows
        if waiting >= CONTEXTS_AT_ONCE and more:
            table = pa.Table.from_batches(held).combine_chunks()
            key = table.column("key").to_numpy()
            change = np.flatnonzero(key[1:] != key[:-1])
            if len(change):  # whole keys only; the last one may go on
                cut = int(change[-1]) + 1
                yield flush(table.slice(0, cut))
                table = table.slice(cut)
            held, waiting = table.to_batches(), table.num_rows
    if waiting:
        yield flush(pa.Table.from_batches(held).combine_chunks())


# passages of words


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and byte after the last (within its text) of every word, and the number of words of each text."""
    sizes = np.array([len(x) + 1 for x in texts], np.int64)
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    letter = np.concatenate(([False], (data != 32) & ((data < 9) | (data > 13)), [False]))
    edges = np.flatnonzero(letter[1:] != letter[:-1])
    starts, ends = edges[::2], edges[1::2]
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(data)), dtype=np.uint64)))
    hashes = (sums[ends] - sums[starts]) * _powers(pow(_BASE, -1, 1 << 64), len(data))[starts] * _MIX
    base = np.cumsum(sizes) - sizes
    of = np.searchsorted(base, starts, "right") - 1
    return hashes ^ (hashes >> np.uint64(32)), starts - base[of], ends - base[of], np.bincount(of, minlength=len(texts))


def _inside(runs: list[list[int]], start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether the bytes from start to end lie within one of the runs, which are in order and apart."""
    if not runs:
        return np.zeros(len(start), bool)
    a, z = np.array(runs, np.int64).T
    at = np.searchsorted(a, start, "right") - 1
    return (at >= 0) & (end <= z[np.maximum(at, 0)])


def word_triggers(texts: list[bytes], runs: list[list[list[int]]], rule: Rule) -> Iterator[tuple[np.ndarray, ...]]:
    """Of each text: key, first and last start of every trigger, whether each start is open (not within a removed run), and the words' bytes and hashes."""
    hashes, begin, end, counts = words_of(texts)
    base = np.cumsum(counts) - counts
    of, _, first, key = triggers(hashes, base, counts, rule)
    for k, n in enumerate(counts.tolist()):
        own = slice(*np.searchsorted(of, (k, k + 1)).tolist())
        b, z = begin[base[k] : base[k] + n], end[base[k] : base[k] + n]
        starts = max(0, n - rule.length + 1)
        open_ = ~_inside(runs[k], b[:starts], z[rule.length - 1 :]) if starts else np.zeros(0, bool)
        yield key[own], first[own], np.append(first[own][1:], starts) - 1 if starts else first[own], open_, b, z, hashes[base[k] : base[k] + n]


# the operator


def _runs(found: list[dict] | None) -> list[list[int]]:
    runs: list[list[int]] = []
    for a, z in sorted((x["a"], x["z"]) for x in found or ()):
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], z)
        else:
            runs.append([a, z])
    return runs


def _remove(batches: Iterator[pa.RecordBatch], passages: Rule, whole: bool) -> Iterator[pa.RecordBatch]:
    """For each row what is removed, and then a row for each key of its word triggers."""
    schema = pa.schema([("dk", pa.int64()), ("tk", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("spans", pa.list_(pa.struct([("a", pa.int32()), ("z", pa.int32())]))), ("sha", pa.string()), ("kept", pa.binary()), ("key", pa.int64()), ("open", pa.bool_())])
    for batch in batches:
        for part in slices(batch, "text", most=BYTES_AT_ONCE):
            texts = part.column("text").to_pylist()
            runs = [_runs(found) for found in part.column("spans").to_pylist()]
            kept = [b"".join(text[a:z] for a, z in zip([0, *(z for _, z in own)], [*(a for a, _ in own), len(text)], strict=True)) for text, own in zip(texts, runs, strict=True)]
            numbers = [[len(x) for x in texts], [sum(z - a for a, z in own) for own in runs], [len(own) for own in runs]]
            none = lambda kind: pa.nulls(len(texts), kind)
            shas = pa.array([hashlib.sha256(x).hexdigest() for x in kept])
            yield pa.RecordBatch.from_arrays([part.column("dk"), part.column("tk"), *(pa.array(x, pa.int64()) for x in numbers), pa.array([[{"a": a, "z": z} for a, z in own] for own in runs], schema.field("spans").type), shas, pa.array(kept, pa.binary()) if whole else none(pa.binary()), none(pa.int64()), none(pa.bool_())], schema=schema)
            of, keys, opens = [], [], []
            for k, (key, first, last, open_, *_) in enumerate(word_triggers(texts, runs, passages)):
                if len(key):
                    before = np.concatenate(([0], np.cumsum(open_)))
                    some = before[last + 1] > before[first]
                    own, which = np.unique(key, return_inverse=True)
                    of.append(np.full(len(own), k))
                    keys.append(own)
                    opens.append(np.bincount(which, some) > 0)
            if of:
                at = pa.array(np.concatenate(of))
                rest = [pa.nulls(len(at), schema.field(c).type) for c in ("n_bytes", "n_removed", "n_spans", "spans", "sha", "kept")]
                yield pa.RecordBatch.from_arrays([part.column("dk").take(at), part.column("tk").take(at), *rest, pa.array(np.concatenate(keys)), pa.array(np.concatenate(opens))], schema=schema)


def _passage_starts(batches: Iterator[pa.RecordBatch], passages: Rule, marks: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """The starts of the triggers with the keys asked for, with the hash of the words from there on: those that are open; with
    ``marks``, the others whose hash is marked."""
    for batch in batches:
        for part in slices(batch, "text", most=BYTES_AT_ONCE):
            texts, runs = part.column("text").to_pylist(), [_runs(found) for found in part.column("spans").to_pylist()]
            asked = part.column("keys").to_pylist()
            of, places, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
            for k, (key, first, last, open_, _, _, hashes) in enumerate(word_triggers(texts, runs, passages)):
                some = np.isin(key, np.array(asked[k], np.int64))
                if not some.any():
                    continue
                sizes = (last - first + 1)[some]
                starts = np.repeat(first[some], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                hashed = rolling_hashes(hashes, passages.length)
                starts = starts[open_[starts] if marks is None else ~open_[starts] & is_marked(marks, hashed[starts])]
                of.append(np.full(len(starts), k))
                places.append(starts)
                found.append(hashed[starts])
            at = pa.array(np.concatenate(of))
            columns = [pa.array(np.concatenate(places).astype(np.int32)), pa.array(np.concatenate(found).view(np.int64))]
            yield pa.RecordBatch.from_arrays([part.column("dk").take(at), part.column("tk").take(at), *columns], names=["dk", "tk", "p", "h"])


def is_marked(marks: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = hashes & np.uint64(len(marks) * 64 - 1)
    return (marks[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)


def marked(hashes: DataFrame, column: str, bits: int = MARK_BITS) -> np.ndarray:
    """A table of 2**bits marks, whatever the number of hashes: a mark for the last bits of each."""
    place = F.col(column).bitwiseAND(F.lit((1 << bits) - 1).cast("long")).alias("_q_place")
    bit = F.expr("shiftleft(1L, cast(_q_place & 63 as int))")
    found = hashes.select(place).groupBy(F.shiftright("_q_place", 6).alias("_q_at")).agg(F.bit_or(bit).alias("_q_bits")).toArrow()
    marks = np.zeros(1 << (bits - 6), np.uint64)
    marks[found.column(0).to_numpy()] = found.column(1).to_numpy().view(np.uint64)
    return marks


def only_marked(rows: DataFrame, column: str, marks: np.ndarray) -> DataFrame:
    """Rows whose hash has a mark: all whose hash was marked, and few others until the marks fill up."""
    shared = rows.sparkSession.sparkContext.broadcast(marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(is_marked(shared.value, batch.column(column).to_numpy().view(np.uint64))))

    return rows.mapInArrow(run, rows.schema)


def _passages(rows: DataFrame, spans: DataFrame, keyed: DataFrame, rule: Rule) -> DataFrame:
    """dk, tk, starts: where open passages begin that occur in another document."""
    document = F.struct("dk", "tk")
    elsewhere = F.min(document) < F.max(document)
    often = materialise(keyed.groupBy("key").agg(elsewhere.alias("two"), F.max("open").alias("open")).filter("two and open").select(F.col("key").alias("_q_key")), "suffix-passage-keys")
    keyed = only_marked(keyed.select("dk", "tk", "key"), "key", marked(often, "_q_key"))
    asked = keyed.join(often, keyed["key"] == often["_q_key"]).groupBy("dk", "tk").agg(F.collect_set("key").alias("keys"))
    asked = materialise(asked, "suffix-passage-rows")
    few = F.broadcast(asked.select("dk", "tk")) if asked.count() <= BROADCAST_ROWS else asked.select("dk", "tk")
    # repeated rows are one document; what else is asked of a text is joined after it is known to be one of the few
    texts = rows.join(few, ["dk", "tk"], "left_semi").join(asked, ["dk", "tk"]).join(spans.dropDuplicates(["dk", "tk"]), ["dk", "tk"], "left")
    schema = "dk long, tk long, p int, h long"
    starts = materialise(texts.mapInArrow(lambda b: _passage_starts(b, rule, None), schema), "suffix-passages")
    # of the sequences within removed bytes only those count that may equal an open one
    shared = rows.sparkSession.sparkContext.broadcast(marked(starts, "h"))
    closed = materialise(texts.mapInArrow(lambda b: _passage_starts(b, rule, shared.value), schema), "suffix-passages-closed")
    both = starts.select("h", "dk", "tk").union(closed.select("h", "dk", "tk"))
    repeated = materialise(both.groupBy("h").agg(elsewhere.alias("two")).filter("two").select(F.col("h").alias("_q_h")), "suffix-passage-hashes")
    met = only_marked(starts, "h", marked(repeated, "_q_h"))
    met = met.join(repeated, met["h"] == repeated["_q_h"])
    found = materialise(met.groupBy("dk", "tk").agg(F.sort_array(F.collect_set("p")).alias("starts")), "suffix-passage-starts")
    discard(often, asked, starts, closed, repeated)
    return found


def remove_repeats(docs: DataFrame, rule: Rule = Rule(), id_col: str = "doc_id", text_col: str = "text", passages: Rule = PASSAGES, whole: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the bytes that stay; null unless ``whole``), n_passages and
    n_passage_words (runs of words covered by open passages, and their words)."""
    spark = docs.sparkSession
    ship_package(spark)
    text = whole_text(text_col).cast("binary")
    # a row is named by its id and a hash of its text; the hash's last bit says that the id is null
    null = F.col(id_col).isNull().cast("long")
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("dk"), F.xxhash64(text).bitwiseAND(F.lit(-2).cast("long")).bitwiseOR(null).alias("tk"), text.alias("text"))
    places = materialise(rows.mapInArrow(lambda b: _triggers_of(b, rule), "dk long, tk long, t int, first int, key long"), "suffix-triggers")
    # written, so that the join deals both sides out anew and can split a hot key
    often = materialise(places.groupBy("key").agg(F.count(F.lit(1)).alias("_q_n")).filter("_q_n > 1").select(F.col("key").alias("_q_key"), (F.col("_q_n") > rule.hot).alias("hot")), "suffix-keys")
    likely = only_marked(places, "key", marked(often, "_q_key"))
    candidates = likely.join(often, likely["key"] == often["_q_key"]).select("dk", "tk", F.struct("t", "first", "hot").alias("one"))
    listed = materialise(candidates.groupBy("dk", "tk").agg(F.collect_set("one").alias("found")), "suffix-candidates")
    discard(places, often)
    dealt = rows.repartition(shuffle_partitions(spark), "dk", "tk")
    with_found = dealt.join(listed, ["dk", "tk"])
    contexts = with_found.mapInArrow(lambda b: _contexts_of(b, rule), "part int, e binary, r binary, n long")
    lows = F.create_map(*(F.lit(x) for hot in (False, True) for number, low, _ in rule.ranges(hot) for x in (number, low)))
    highs = F.create_map(*(F.lit(x) for hot in (False, True) for number, _, high in rule.ranges(hot) for x in (number, high)))
    low, high = F.element_at(lows, F.col("part")), F.element_at(highs, F.col("part"))
    shared_after, shared_before = F.substring(F.col("r"), F.lit(1), F.lit(rule.length) - high), F.substring(F.col("e"), F.greatest(F.length("e") - low + 1, F.lit(1)), low)
    keyed = contexts.select(F.xxhash64("part", shared_after, shared_before).alias("key"), "part", "e", "r", "n")
    ordered = keyed.repartition(shuffle_partitions(spark), "key").sortWithinPartitions("key", "part", "r", "e")
    decisions = ordered.mapInArrow(lambda b: _decide(b, rule), "context binary, low int, high int")
    occurrences = with_found.mapInArrow(lambda b: _occurrences_of(b, rule), "dk long, tk long, t int, part int, context binary")
    met = occurrences.join(decisions, "context").select("dk", "tk", F.struct((F.col("t") - F.col("high")).alias("a"), (F.col("t") - F.col("low") + rule.length).alias("z")).alias("span"))
    spans = met.groupBy("dk", "tk").agg(F.collect_set("span").alias("spans"))
    schema = "dk long, tk long, n_bytes long, n_removed long, n_spans long, spans array<struct<a: int, z: int>>, sha string, kept binary, key long, open boolean"
    last = materialise(dealt.join(spans, ["dk", "tk"], "left").mapInArrow(lambda b: _remove(b, passages, whole), schema), "suffix-removed")
    starts = _passages(rows, last.filter("n_spans > 0").select("dk", "tk", "spans"), last.filter("key is not null").select("dk", "tk", "key", "open"), passages)
    final = last.filter("key is null").join(starts, ["dk", "tk"], "left")
    # runs of words that follow one another with a distance below the length are one
    apart = F.size(F.filter(F.sequence(F.lit(1), F.size("starts")), lambda i: (i == 1) | (F.element_at("starts", i) - F.element_at("starts", F.greatest(i - 1, F.lit(1))) > passages.length)))
    covered = F.aggregate(
        F.sequence(F.lit(1), F.size("starts")), F.lit(0), lambda n, i: n + F.when(i == 1, F.lit(passages.length)).otherwise(F.least(F.lit(passages.length), F.element_at("starts", i) - F.element_at("starts", F.greatest(i - 1, F.lit(1))))).cast("int")
    )
    some = F.col("starts").isNotNull()
    return final.select(
        F.when(F.col("tk").bitwiseAND(F.lit(1).cast("long")) == 0, F.col("dk")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.col("sha").alias("kept_sha256"), "kept",
        F.when(some, apart).otherwise(0).cast("long").alias("n_passages"), F.when(some, covered).otherwise(0).cast("long").alias("n_passage_words"),
    )


def op6_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(read_table(spark, sf_dir, "documents"), whole=False)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages", "n_passage_words", (F.col("n_spans") + F.col("n_passages")).alias("n_repeats"))
