"""Quality classifier: supervised subword embeddings, trained by stochastic gradient descent in numpy.

A document's features are its words, the character n-grams of its words (with a space as the mark of a word's edge) and, for
each word, its shape: length, share of the document's words, and whether it repeats the word before. All are hashed into one
table of learned vectors. The document is the mean of its features' vectors; a softmax layer over it gives the score.

Training takes a bounded sample: at most ``SAMPLE`` labelled documents of at most ``SAMPLE_BYTES`` bytes, those whose ids
hash lowest, never from the held-out quarter (crc32 of the id as text, modulo 4, is 2). Since everything after the table is
linear up to the softmax, scoring folds the output layer into one number per table row; that table (``2**BITS`` floats, a
fixed size) is what executors get. Every document is scored over its whole text, in blocks of whole documents or, when one is longer than a block, in pieces of
it that end at white space.

Cases: null and empty texts have no features and get the score of the bias alone; a repeated row gets the same score;
a document with several labels counts with the largest, null labels and labels other than 0 and 1 are left out; with no
labels, or one class only, every score is the share of label 1 (1 if there are none). Columns other than id and text are
not read and pass through ``keep_good`` as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Carried, named, read_table, ship_package, slices

BITS, DIMENSIONS = 18, 6
GRAMS = (3, 4)
#: Features with a zero vector that every document has besides its own: short texts lean to the bias.
PRIOR = 40
#: Times that a word's shape (length with share, and share with whether it repeats the word before) counts beside its n-grams.
SHAPE_TIMES = 3
SAMPLE, SAMPLE_BYTES = 4000, 1 << 15
EPOCHS, BATCH, RATE = 6, 64, 0.3
THRESHOLD = 0.7
BYTES_AT_ONCE = 1 << 20
SEED = 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX = np.uint64(0xD6E8FEB86659FD93)
_SPACES = re.compile(rb"[\x09-\x0D\x20]")
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _powers(base: np.uint64, n: int) -> np.ndarray:
    powers = np.full(n, base, np.uint64)
    powers[0] = 1
    return np.cumprod(powers, dtype=np.uint64)


def _slot(h: np.ndarray, kind: int) -> np.ndarray:
    """Row of the table for 64-bit hashes of one kind of feature."""
    h = (h + np.uint64(kind)) * _MIX
    h ^= h >> np.uint64(32)
    h *= _BASE
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def _padded(joined: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Bytes with every white space as a space, some before and after them, and which are not white space."""
    data = np.frombuffer(b" " + joined + b" " * max(GRAMS), np.uint8)
    letter = ~_SPACE[data]
    return np.where(letter, data, 32).astype(np.uint64), letter


def _grams(b: np.ndarray, letter: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Table rows of the n-grams of each length, and their places."""
    for n in GRAMS:
        m = len(b) - n + 1
        h, inside = b[:m].copy(), letter[1 : m + 1].copy()
        for k in range(1, n):
            h = h * _MIX + b[k : m + k]
            if 1 < k < n - 1:
                inside &= letter[k : m + k]
        at = np.flatnonzero(inside)
        yield _slot(h[at], n), at


def _words(b: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first place and length of every word."""
    edges = np.flatnonzero(letter[1:] != letter[:-1]) + 1
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return starts.astype(np.uint64), starts, starts
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((b + np.uint64(1)) * _powers(_BASE, len(b)), dtype=np.uint64)))
    return (sums[ends] - sums[starts]) * _powers(_BACK, len(b))[starts], starts, ends - starts


def _shapes(sizes: np.ndarray, share: np.ndarray, again: np.ndarray) -> list[np.ndarray]:
    """Table rows of the words' shapes."""
    share = np.log2(share).astype(np.int64)
    return [_slot((np.minimum(sizes, 15) * 64 + share).astype(np.uint64), 2), _slot((share * 2 + again).astype(np.uint64), 5)] * SHAPE_TIMES


def feature_blocks(texts: Sequence[bytes], most: int = BYTES_AT_ONCE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashed features of some documents, kind by kind: (table rows, document numbers in ascending order)."""
    if len(texts) == 1 and len(texts[0]) > most:
        yield from ((rows, np.zeros(len(rows), np.int64)) for rows in _long_features(texts[0], most))
        return
    b, letter = _padded(b" ".join(texts))
    owner = np.repeat(np.arange(len(texts)), np.array([len(t) for t in texts], np.int64) + 1)
    owner = np.concatenate(([0], owner, np.full(len(b) - 1 - len(owner), max(len(texts) - 1, 0))))
    for rows, at in _grams(b, letter):
        yield rows, owner[at + 1]
    words, starts, sizes = _words(b, letter)
    if not len(words):
        return
    of = owner[starts]
    yield _slot(words, 1), of
    total = np.bincount(of, minlength=len(texts))
    _, same, times = np.unique(words ^ (of.astype(np.uint64) * _MIX), return_inverse=True, return_counts=True)
    again = np.concatenate(([False], (words[1:] == words[:-1]) & (of[1:] == of[:-1])))
    yield from ((rows, of) for rows in _shapes(sizes, total[of] / times[same], again))


def pieces_of(text: bytes, most: int) -> Iterator[bytes]:
    """A text cut after white space into pieces of at most ``most`` bytes; a longer word stays whole."""
    start = 0
    while len(text) - start > most:
        spaces = np.flatnonzero(_SPACE[np.frombuffer(text, np.uint8, most, start)])
        further = None if len(spaces) else _SPACES.search(text, start + most)
        end = start + int(spaces[-1]) + 1 if len(spaces) else further.end() if further else len(text)
        yield text[start:end]
        start = end
    yield text[start:]


def _long_features(text: bytes, most: int) -> Iterator[np.ndarray]:
    """The features of one long document, piece by piece: words are counted over all of it first."""
    known, times = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for piece in pieces_of(text, most):
        found, n = np.unique(_words(*_padded(piece))[0], return_counts=True)
        known, same = np.unique(np.concatenate((known, found)), return_inverse=True)
        times = np.bincount(same, np.concatenate((times, n)), len(known)).astype(np.int64)
    total, last = times.sum(), np.zeros(0, np.uint64)
    for piece in pieces_of(text, most):
        b, letter = _padded(piece)
        yield from (rows for rows, _ in _grams(b, letter))
        words, _, sizes = _words(b, letter)
        if len(words):
            yield _slot(words, 1)
            again = np.concatenate((last == words[:1] if len(last) else [False], words[1:] == words[:-1]))
            yield from _shapes(sizes, total / times[np.searchsorted(known, words)], again)
            last = words[-1:]


@dataclass
class Model:
    """Vectors of the table's rows, the output layer, and the score where nothing could be learned."""

    vectors: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    constant: float | None = None

    def folded(self) -> tuple[np.ndarray, float, float | None]:
        """The table with the output layer folded in: one number per row, the difference of the biases, the constant."""
        return (self.vectors @ (self.weights[:, 1] - self.weights[:, 0])).astype(np.float64), float(self.bias[1] - self.bias[0]), self.constant


def score_texts(texts: Sequence[bytes], folded: tuple[np.ndarray, float, float | None]) -> np.ndarray:
    """Scores from 0 to 1, as the softmax over the mean vector gives them."""
    table, bias, constant = folded
    if constant is not None:
        return np.full(len(texts), constant)
    total, n = np.zeros(len(texts)), np.zeros(len(texts))
    for rows, of in feature_blocks(texts):
        total += np.bincount(of, table[rows], len(texts))
        n += np.bincount(of, minlength=len(texts))
    return 1 / (1 + np.exp(-np.clip(total / (n + PRIOR) + bias, -50, 50)))


def train(texts: Sequence[bytes], labels: Sequence[int], epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> Model:
    """Stochastic gradient descent with per-row step sizes on the softmax loss."""
    y = np.asarray(labels, np.int64)
    random = np.random.default_rng(seed)
    vectors = random.normal(0, 0.1, (1 << BITS, DIMENSIONS))
    weights, bias = random.normal(0, 0.5, (DIMENSIONS, 2)), np.zeros(2)
    if not len(y) or y.min() == y.max():
        return Model(vectors, weights, bias, float(y.mean()) if len(y) else 1.0)
    documents = []
    for text in texts:
        rows = [r for r, _ in feature_blocks([text])]
        found, times = np.unique(np.concatenate(rows), return_counts=True) if rows else (np.zeros(0, np.int64), np.zeros(0))
        documents.append((found, times / (times.sum() + PRIOR)))
    seen, seen_out = np.full(1 << BITS, 1e-6), 1e-6
    for epoch in range(epochs):
        order = random.permutation(len(y))
        step = rate * (1 - epoch / epochs)
        for i in range(0, len(order), BATCH):
            batch = order[i : i + BATCH]
            rows = np.concatenate([documents[k][0] for k in batch])
            share = np.concatenate([documents[k][1] for k in batch])
            at = np.repeat(np.arange(len(batch)), [len(documents[k][0]) for k in batch])
            own = vectors[rows] * share[:, None]
            hidden = np.stack([np.bincount(at, own[:, d], len(batch)) for d in range(DIMENSIONS)], axis=1)
            logits = hidden @ weights + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(batch)), y[batch]] -= 1
            back = (p @ weights.T)[at] * share[:, None]
            touched, slot = np.unique(rows, return_inverse=True)
            gradient = np.stack([np.bincount(slot, back[:, d], len(touched)) for d in range(DIMENSIONS)], axis=1)
            seen[touched] += (gradient**2).mean(1)
            vectors[touched] -= step * gradient / np.sqrt(seen[touched])[:, None]
            out = hidden.T @ p / len(batch)
            seen_out += (out**2).mean()
            weights -= step * 0.1 * out / np.sqrt(seen_out)
            bias -= step * 0.1 * p.mean(0)
    return Model(vectors, weights, bias)


def held_out(id_col: str = "doc_id"):
    """Rows that training never sees. A null id counts as the text ''."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def training_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> tuple[list[bytes], list[int]]:
    """At most ``sample`` labelled texts of at most ``most_bytes`` bytes with their labels, in a fixed order."""
    usable = labels.select(F.col("doc_id").alias("_q_id"), F.col("quality").alias("_q_label")).filter(F.col("_q_id").isNotNull() & F.col("_q_label").isin(0, 1) & ~held_out("_q_id"))
    chosen = usable.groupBy("_q_id").agg(F.max("_q_label").alias("_q_label")).orderBy(F.xxhash64("_q_id"), "_q_id").limit(sample)
    texts = docs.select(F.col("doc_id").alias("_q_doc"), F.coalesce(F.col("text"), F.lit("")).alias("_q_text")).filter(F.octet_length("_q_text") <= most_bytes)
    joined = texts.join(F.broadcast(chosen), F.col("_q_doc") == F.col("_q_id"))  # chosen has at most ``sample`` rows of two numbers
    rows = joined.orderBy(F.xxhash64("_q_id"), "_q_id", "_q_text").limit(sample).select("_q_text", "_q_label").collect()
    return [r[0].encode() for r in rows], [int(r[1]) for r in rows]


def score_documents(docs: DataFrame, model: Model, keep: Sequence[str] = ("doc_id",), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns ``keep`` with _q_score appended."""
    table = docs.sparkSession.sparkContext.broadcast(model.folded())
    carried = Carried(docs, keep)
    schema = T.StructType([*carried.fields, T.StructField("_q_score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_q_text", most=BYTES_AT_ONCE):
                scores = score_texts([x or b"" for x in part.column("_q_text").to_pylist()], table.value)
                yield pa.RecordBatch.from_arrays([part.column(n) for n in carried.names] + [pa.array(scores)], names=[*carried.names, "_q_score"])

    ship_package(docs.sparkSession)
    scored = docs.select(*carried.inside(), F.col(text_col).cast("binary").alias("_q_text")).mapInArrow(run, schema)
    return scored.select(*carried.outside(), "_q_score")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose score reaches the threshold, with all their columns."""
    scored = score_documents(docs, train(*training_sample(docs, labels)), docs.columns)
    return scored.filter(F.col("_q_score") >= threshold).select(*named(docs.columns))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = train(*training_sample(docs, read_table(spark, sf_dir, "labels")))
    scored = score_documents(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), F.col("_q_score").alias("score"), (F.col("_q_score") >= THRESHOLD).cast("int").alias("predicted"))
