"""Personal data: fixed patterns, and a semi-Markov conditional random field that adds what they miss.

The base finds, for each kind by itself, the leftmost non-overlapping matches of a pattern, and drops those that fail the
kind's check (address parts, Luhn digit, number of digits) without trying again. Base spans always stay.

The field works on what the base leaves. A sequence is a run of digit groups (and their separators) or of words around an
at sign, possibly written out; its units are the groups. A segment is up to ``LONGEST`` units with a kind, or one unit that
is nothing; its score is a weighted sum of features of the whole span - digits, groups, separators, check digit, parts,
what touches its ends - which no per-token tagger could have. Dynamic programming over the units chooses boundaries and
kinds together. The weights are trained here, by gradient ascent on the exact conditional likelihood (forward and backward
sums over all segmentations), on sequences made from a seed. A phone number without its plus sign or run into a card number,
a card with dots, an address with bracketed dots or an e-mail address with "[at]" are found this way; version numbers,
dates, prices and hexadecimal keys are not.

Cases: null and empty texts have no spans; offsets are code points; repeated rows give equal results; digits other than
ASCII ones never count; long texts cost time in proportion to their length, whatever runs they hold. Only id and text are
read. A segment has at most ``LONGEST`` units, so an entity in more groups than that, such as a card in 16 single digits,
is found only where the base finds it.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, ship_package, slices

KINDS = ("email", "ip", "card", "phone")
#: Units of the longest segment.
LONGEST = 8
#: Segments that are scored at once.
SEGMENTS_AT_ONCE = 4096
SEED, EXAMPLES, ROUNDS, RATE, DECAY = 7, 240, 25, 0.5, 1e-3

Span = tuple[int, int, str]

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_SET = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")


# base patterns


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def _emails(text: str) -> list[Span]:
    """Only characters around an at sign are looked at: a match holds exactly one, and starts where the run before it does."""
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_SET:
            start -= 1
        m = _EMAIL.match(text, start) if start < at else None
        if m:
            found.append((m.start(), m.end(), "email"))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return found


def base_spans(text: str) -> list[Span]:
    """All base spans, by start and then kind as listed."""
    found = _emails(text)
    found += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(map(_small, m.group().split(".")))]
    found += [(m.start(), m.end(), "card") for m in _CARD.finditer(text) if 14 <= len(d := _digits(m.group())) <= 19 and luhn(d)]
    found += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 10 <= len(_digits(m.group())) <= 15]
    return in_order(found)


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


# sequences and features

_RUN = re.compile(r"[+(]{0,2}[0-9](?:[\x20().+/\[\]-]{0,3}[0-9])+\)?")
_GROUP = re.compile(r"[0-9]+")
_AT = re.compile(r"@|\[at\]|\(at\)|\x20at\x20", re.IGNORECASE)
_HOST = re.compile(r"[\x20]?[A-Za-z0-9-]+(?:[\x20]?(?:\.|\[dot\]|\(dot\)|\x20dot\x20)[\x20]?[A-Za-z0-9-]+)+", re.IGNORECASE)
#: A word, at and a host or the end of a sentence, as prose has them.
_PROSE = re.compile(r"[A-Za-z-]+\x20at\x20[^\[(]*\.|.*\x20at\x20.*\.\x20", re.IGNORECASE)
_JOINER = re.compile(r"[\x20]?(?:@|\[at\]|\(at\)|\x20at\x20|\.|\[dot\]|\(dot\)|\x20dot\x20)[\x20]?", re.IGNORECASE)

Unit = tuple[int, int]
FEATURES = 35


def sequences(text: str, taken: list[Span]) -> Iterator[list[Unit]]:
    """Units of each sequence outside the spans already taken."""
    pieces, at = [], 0
    for start, end, _ in sorted(taken):
        if end > at:
            pieces += [text[at : max(at, start)], "\0" * (end - max(at, start))]
            at = end
    free = "".join(pieces) + text[at:]
    for m in _RUN.finditer(free):
        if m.end() - m.start() >= 7:
            groups = [(g.start() + m.start(), g.end() + m.start()) for g in _GROUP.finditer(m.group())]
            if sum(z - a for a, z in groups) >= 7 or _four_small(free, groups):
                yield [(_opened(free, a, m.start()), z) for a, z in groups]
    for start, end in _written(free):
        cuts = [(j.start() + start, j.end() + start) for j in _JOINER.finditer(free[start:end])]
        yield list(zip([start, *(z for _, z in cuts)], [*(a for a, _ in cuts), end], strict=True))


def _written(text: str) -> Iterator[Unit]:
    """Where a word, an at sign in any form and a host follow each other. Both ways from each at sign only: runs between at signs
    are looked at once, so the time is in proportion to the text's length."""
    done, at = 0, _AT.search(text)
    while at:
        start = at.start() - (text[at.start() - 1 : at.start()] == " ")
        last = start
        while start > done and text[start - 1] in _LOCAL_SET:
            start -= 1
        host = _HOST.match(text, at.end()) if start < last else None
        if host:
            yield start, host.end()
            done = host.end()
        at = _AT.search(text, max(at.start() + 1, done))


def _four_small(text: str, groups: list[Unit]) -> bool:
    """Whether four groups in a row could be an address, however few digits these have."""
    small = [_small(text[a:z]) for a, z in groups]
    return any(all(small[i : i + 4]) for i in range(len(small) - 3))


def _opened(text: str, start: int, least: int) -> int:
    """A group's start with the plus sign and opening bracket right before it."""
    while start > least and text[start - 1] in "+(":
        start -= 1
    return start


def span_features(text: str, start: int, end: int, units: int) -> np.ndarray:
    """What a whole span looks like."""
    span, f = text[start:end], np.zeros(FEATURES)
    digits = _digits(span)
    n = len(digits)
    before, after = text[start - 1 : start], text[end : end + 1]
    has_at = bool(re.search(r"@|\[at\]|\(at\)|\x20at\x20", span, re.IGNORECASE))
    f[0] = 1
    f[1 + sum(n > edge for edge in (0, 6, 9, 11, 13, 15, 16, 19))] = 1  # places 1 to 9
    f[10 + min(units, 6)] = 1  # places 11 to 16
    f[17] = n >= 12 and luhn(digits)
    f[18] = span[:1] == "+"
    f[19] = "(" in span
    f[20] = span.count("(") != span.count(")")
    parts = _GROUP.findall(span)
    f[21] = len(parts) == 4 and all(map(_small, parts)) and "." in span
    f[22] = len(parts) > 1 and all(len(p) == 4 for p in parts)
    f[23] = len(parts) >= 3 and [len(p) for p in parts[-3:]] in ([3, 3, 4], [2, 3, 4])
    f[24] = has_at
    f[25] = has_at and bool(re.search(r"(?:\.|dot[\])]?)\x20?[A-Za-z]{2,6}$", span))
    f[26] = before.isalnum() or before in tuple("=\"'#$€_-./") and before != ""
    f[27] = after.isalnum() or after in ("_", "=", "%", "/", "-")
    f[28] = len(set(re.findall(r"[\x20./-]", span))) > 1
    f[29] = "/" in span
    f[30] = bool(re.match(r"(?:19|20)[0-9]{2}[-./][0-9]{1,2}[-./][0-9]{1,2}$|[0-9]{1,2}[-./][0-9]{1,2}[-./](?:19|20)[0-9]{2}$", span))
    f[31] = span[:1] == "0" and span[:2] != "00"
    f[32] = bool(re.search(r"[A-Za-z]", span)) and not has_at
    f[33] = len(parts) == 4 and not all(map(_small, parts))
    f[34] = has_at and bool(_PROSE.match(span))
    return f


class Lattice:
    """All segments of a sequence: where they begin and end in units, and their features."""

    def __init__(self, text: str, units: list[Unit]):
        self.text, self.units = text, units

    def segments(self) -> Iterator[tuple[int, int]]:
        """First unit and unit after the last, by the latter."""
        return ((i, j) for j in range(1, len(self.units) + 1) for i in range(max(0, j - LONGEST), j))

    @functools.cached_property
    def pairs(self) -> list[tuple[int, int]]:
        return list(self.segments())

    @functools.cached_property
    def features(self) -> np.ndarray:
        return self.features_of(self.pairs)

    def features_of(self, segments: list[tuple[int, int]]) -> np.ndarray:
        return np.stack([span_features(self.text, self.units[i][0], self.end(self.text, i, j), j - i) for i, j in segments])

    def end(self, text: str, i: int, j: int) -> int:
        """A span takes a closing bracket after its last group only for an opening one inside."""
        start, end = self.units[i][0], self.units[j - 1][1]
        return end + 1 if text[end : end + 1] == ")" and text.count("(", start, end) > text.count(")", start, end) else end

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """Segments by kinds."""
        return self.features @ weights.T

    def best(self, weights: np.ndarray) -> list[tuple[int, int, int]]:
        """The best segmentation's entities: first unit, unit after the last, kind."""
        best, back = [0.0], [None]
        waiting, held = self.segments(), iter(())
        for j in range(1, len(self.units) + 1):
            best.append(best[j - 1])
            back.append(None)
            for i in range(max(0, j - LONGEST), j):
                scores = next(held, None)
                if scores is None:  # scores of a long sequence are never held together
                    held = iter((self.features_of(list(itertools.islice(waiting, SEGMENTS_AT_ONCE))) @ weights.T).tolist())
                    scores = next(held)
                kind = max(range(len(KINDS)), key=scores.__getitem__)
                if best[i] + scores[kind] > best[j]:
                    best[j], back[j] = best[i] + scores[kind], (i, j, kind)
        found, j = [], len(self.units)
        while j:
            if back[j]:
                found.append(back[j])
                j = back[j][0]
            else:
                j -= 1
        return found[::-1]

    def gradient(self, weights: np.ndarray, gold: list[tuple[int, int, int]]) -> np.ndarray:
        """Of the log-likelihood: the gold segments' features less the expected ones."""
        scores, n = self.scores(weights), len(self.units)
        total = np.logaddexp.reduce(scores, axis=1)
        forward, backward = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
        forward[0] = backward[n] = 0
        for j in range(1, n + 1):
            forward[j] = np.logaddexp(forward[j], forward[j - 1])
            for k, (i, z) in enumerate(self.pairs):
                if z == j:
                    forward[j] = np.logaddexp(forward[j], forward[i] + total[k])
        for i in range(n - 1, -1, -1):
            backward[i] = np.logaddexp(backward[i], backward[i + 1])
            for k, (a, z) in enumerate(self.pairs):
                if a == i:
                    backward[i] = np.logaddexp(backward[i], backward[z] + total[k])
        starts, ends = np.array(self.pairs).T
        p = np.exp(forward[starts][:, None] + scores + backward[ends][:, None] - forward[n])
        change = -(p.T @ self.features)
        for i, j, kind in gold:
            change[kind] += self.features[self.pairs.index((i, j))]
        return change


# training


def made_examples(n: int = EXAMPLES, seed: int = SEED) -> list[tuple[str, list[Span]]]:
    """Sentences with personal data in forms that the base misses, and with things that only look alike."""
    r = np.random.default_rng(seed)
    d = lambda k: "".join(map(str, r.integers(0, 10, k)))
    word = lambda: "".join(r.choice(list("etaoinshrdlu"), int(r.integers(2, 8))))

    def card(k: int) -> str:
        body = str(r.integers(1, 10)) + d(k - 2)
        return body + next(c for c in "0123456789" if luhn(body + c))

    def fours(x: str, sep: str) -> str:
        return sep.join(x[i : i + 4] for i in range(0, len(x), 4))

    def entity() -> tuple[str, str]:
        pick = int(r.integers(0, 15))
        ip, low = [str(x) for x in r.integers(1, 256, 4)], [str(x) for x in r.integers(0, 20, 4)]
        return [
            (f"({d(3)}) {d(3)}-{d(4)}", "phone"), (f"{d(3)}-{d(3)}-{d(4)}", "phone"), (f"+{r.integers(1, 99)} ({d(3)}) {d(3)}-{d(4)}", "phone"), (f"{d(3)}.{d(3)}.{d(4)}", "phone"),
            (f"{d(3)} {d(3)} {d(4)}", "phone"), (fours(card(16), "."), "card"), (fours(card(16), "/"), "card"), ("[.]".join(ip), "ip"), (" . ".join(ip), "ip"),
            (f"{word()}.{word()}[at]{word()}.com", "email"), (f"{word()}{d(2)} (at) {word()} dot org", "email"), (f"{word()} at {word()} dot com", "email"),
            (f"{word()}.{word()} at {word()}.com", "email"), (f"{word()}{d(2)} at {word()}.org", "email"), ("[.]".join(low), "ip"),
        ][pick]

    def other() -> str:
        pick = int(r.integers(0, 16))
        return [
            f"{r.integers(1900, 2100)}-{d(2)}-{d(2)}", f"{d(2)}/{d(2)}/{r.integers(1900, 2100)}", f"version {d(1)}.{d(1)}.{d(2)}.{d(4)}", f"${d(3)},{d(3)}.{d(2)}", d(int(r.integers(7, 14))), d(int(r.integers(17, 40))),
            f"{d(4)} {d(4)}", f"{d(5)}-{d(4)}", f"{d(1)}-{d(3)}-{d(5)}-{d(1)}", f"{word()}{d(7)}{word()}", f"{d(3)} {d(2)} {d(1)} {d(5)} {d(2)}", f"{d(4)}.{d(4)}.{d(3)}.{d(4)}",
            f"{word()} at {word()}. {word()}", f"{word()} at {d(1)}.{d(2)}", f"{d(1)}-{d(1)}-{d(2)}-{d(1)}", f"{d(1)} {d(1)} {d(2)} {d(1)}",
        ][pick]

    made = []
    for _ in range(n):
        text, spans = word() + " ", []
        for _ in range(int(r.integers(1, 4))):
            if r.random() < 0.6:
                value, kind = entity()
                spans.append((len(text), len(text) + len(value), kind))
                text += value
                if kind == "phone" and r.random() < 0.3:
                    number = card(16)
                    spans.append((len(text) + 1, len(text) + 17, "card"))
                    text += " " + number
            else:
                text += other()
            text += r.choice([" ", ". ", ", "]) + word() + " "
        made.append((text, spans))
    return made


@functools.lru_cache(maxsize=4)
def trained(seed: int = SEED, examples: int = EXAMPLES, rounds: int = ROUNDS) -> np.ndarray:
    """Weights, kinds by features."""
    lattices = []
    for text, spans in made_examples(examples, seed):
        for units in sequences(text, []):
            lattice = Lattice(text, units)
            place = {(units[i][0], lattice.end(text, i, j)): (i, j) for i, j in lattice.pairs}
            gold = [(*place[a, z], KINDS.index(kind)) for a, z, kind in spans if (a, z) in place]
            lattices.append((lattice, gold))
    weights, seen = np.zeros((len(KINDS), FEATURES)), np.full((len(KINDS), FEATURES), 1e-6)
    weights[:, 0] = -1
    order = np.random.default_rng(seed)
    for _ in range(rounds):
        for k in order.permutation(len(lattices)):
            change = lattices[k][0].gradient(weights, lattices[k][1]) - DECAY * weights
            seen += change**2
            weights += RATE * change / np.sqrt(seen)
    return weights


def find_spans(text: str | None, weights: np.ndarray) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans."""
    if not text:
        return [], []
    base = base_spans(text)
    added = []
    for units in sequences(text, base):
        lattice = Lattice(text, units)
        added += [(units[i][0], lattice.end(text, i, j), KINDS[kind]) for i, j, kind in lattice.best(weights)]
    return base, in_order(base + added)


def find_pii(docs: DataFrame, weights: np.ndarray | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base and spans: arrays of (start, end, kind)."""
    weights = trained() if weights is None else weights
    one = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_q_text"):
                found = [find_spans(t, weights) for t in part.column("_q_text").to_pylist()]
                columns = [pa.array([[dict(zip(("start", "end", "kind"), s, strict=True)) for s in spans] for spans in which], pa.list_(one)) for which in zip(*found, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["doc_id", "base", "spans"])

    ship_package(docs.sparkSession)
    span = "array<struct<start: int, end: int, kind: string>>"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_q_text")).mapInArrow(run, f"doc_id long, base {span}, spans {span}")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(read_table(spark, sf_dir, "documents"))
    as_text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(as_text("base").cast("binary"), 256).alias("base_sha256"), as_text("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))
