"""Token ids in Arrow stream files of equal-length sequences.

Documents are dealt to tasks by ranges of their id, those that share one by a hash of their texts. Each task tokenizes its documents in ascending id order and writes two
files to the shared folder: the token stream, as record batches of fixed-size lists (ids and a mask that is false only on
the padding of the last sequence), and the documents' ids and lengths. Files are in Arrow's stream format, uncompressed, so a
reader can map them and look at any sequence without a copy. They are written under a name of the attempt and then renamed:
a task that runs again replaces its files by equal ones.

Tokenizing goes through the tokenizers library, word by word: neither its normalizer nor its pre-splitting pattern joins
anything across white space, so a text's ids are those of its words in a row. A single mark beside letters or digits is a
match of its own and may be parted from them too. Words are looked up in a bounded table, and those not in it are encoded
together. A text with unusual white space, a letter whose lower case depends on others, a sign that the library's Unicode
tables don't know, or what may open a special token goes to the library as a whole.

Cases: null and empty texts have the end id only; null doc_ids come first; rows with the same id follow one another, in
order of a hash of their texts; an empty table writes empty files. Ids of up to 16 bits are stored in 16 bits.
"""

from __future__ import annotations

import functools
import os
import re
import sys
import unicodedata
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, read_table, shared_path, ship_package, shuffle_partitions, slices

#: Ids in a sequence, and sequences in a record batch.
LENGTH, BATCH = 1024, 256
END_ID = 1
#: Words in a worker's newer table (the older one is as large), and words that are encoded in one string.
WORDS, TOGETHER = 400_000, 256

#: White space that Python's split() knows otherwise than the library, and letters whose lower case depends on others.
_UNUSUAL = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff\u03a3\u0130]")
_ASCII_UNUSUAL = re.compile("[\x1c-\x1f]")
#: A mark next to another sign: together they are one match of the pattern and must not be parted.
_MARKS_TOGETHER = re.compile(r"[.,;:!?](?:(?=[^\s\w]|_)|(?<=[^\s\w].)|(?<=_.))")


def marks_unknown_to(normalize: Callable[[str], str]) -> str:
    """Signs that another NFC orders or composes otherwise than Python's, as its tables are of another version of Unicode."""
    found = set()
    for code in range(0x300, sys.maxunicode + 1):
        sign = chr(code)
        order, parts = unicodedata.combining(sign), unicodedata.decomposition(sign)
        pair = ""
        if order:
            pair = sign + "\u0334" if order > 1 else "\u0301" + sign
            if normalize(pair) != unicodedata.normalize("NFC", pair):
                found.add(sign)
        if parts and parts[0] != "<" and " " in parts:
            pair = unicodedata.normalize("NFD", sign)
            if normalize(pair) != unicodedata.normalize("NFC", pair):
                found.update(pair[1:])
    return "".join(sorted(found))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordTokenizer:
    """Ids of texts as packed integers, by way of a table of words."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        # words of letters that are in lower case and normal form need the model alone
        self.letters = Tokenizer(self.library.model)
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.type = np.dtype("<u2") if max(vocabulary.values()) < 1 << 16 else np.dtype("<u4")
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        unknown = marks_unknown_to(normalizers.NFC().normalize_str)
        self.unknown = re.compile(f"[{re.escape(unknown)}]" if unknown else r"(?!)")
        # None: the word holds an unknown sign, so texts with it go to the library as they are
        self.words: dict[str, bytes | None] = {}
        self.before: dict[str, bytes | None] = {}

    def pack(self, ids: Sequence[int]) -> bytes:
        return np.asarray(ids, self.type).tobytes()

    def whole(self, text: str) -> bytes:
        return self.pack(self.library.encode(text, add_special_tokens=False).ids)

    def encode(self, texts: Sequence[str | None]) -> list[bytes]:
        """The packed ids of each text, without an end id."""
        normal = [unicodedata.normalize("NFC", t or "") for t in texts]
        split = [None if "<|" in t or (not t.isascii() and _UNUSUAL.search(t)) or _ASCII_UNUSUAL.search(t) else _words(t) for t in normal]
        new = set().union(*(words for words in split if words)).difference(self.words)
        if len(self.words) + len(new) > WORDS:  # words of the table before last are forgotten
            self.words, self.before = {}, self.words
            new = set().union(*(words for words in split if words))
        again = {w for w in new if w in self.before}
        self.words.update((w, self.before[w]) for w in again)
        self._learn(new - again)
        return [self.whole(t or "") if (ids := self._looked_up(words)) is None else ids for t, words in zip(texts, split, strict=True)]

    def _looked_up(self, words: list[str] | None) -> bytes | None:
        """The ids of a text's words in a row, unless the library has to see the text as a whole."""
        if words is None:
            return None
        try:
            return b"".join(map(self.words.__getitem__, words))
        except TypeError:  # a word with an unknown sign
            return None

    def _learn(self, new: set[str]) -> None:
        """Put words into the table. Words of letters are encoded together: each ends in its only token with an end mark. Some
        letters' normal form is a letter and a combining mark, at which the pattern splits; words with these go to the library."""
        odd = {w for w in new if not w.isascii() and self.unknown.search(w)}
        self.words.update(dict.fromkeys(odd))
        new = new - odd
        letters = [w for w in new if w.isalpha() and unicodedata.is_normalized("NFC", w)]
        width = self.type.itemsize
        for i in range(0, len(letters), TOGETHER):
            part = letters[i : i + TOGETHER]
            ids = np.array(self.letters.encode(" ".join(part), add_special_tokens=False).ids, self.type)
            stops = ((np.flatnonzero(self.ends[ids]) + 1) * width).tolist()
            packed = ids.tobytes()
            if len(stops) == len(part):
                self.words.update((w, packed[a:z]) for w, a, z in zip(part, [0, *stops], stops, strict=False))
            else:
                self.words.update((w, self.whole(w)) for w in part)
        self.words.update((w, self.whole(w)) for w in new.difference(letters))


def _words(text: str) -> list[str]:
    """Pieces whose ids, joined, are the text's: words in lower case, with marks parted from letters where they stand alone."""
    text = text.lower()
    if not _MARKS_TOGETHER.search(text):
        for mark in ".,;:!?":
            if mark in text:
                text = text.replace(mark, f" {mark} ")
    return text.split()


@functools.lru_cache(maxsize=2)
def word_tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def _filesystem(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{os.path.abspath(uri)}")


class SequenceWriter:
    """Cuts a stream of packed ids into sequences and writes them batch by batch."""

    def __init__(self, sink, item: pa.DataType, length: int = LENGTH, batch: int = BATCH):
        self.item, self.length, self.size = item, length, length * batch
        self.schema = pa.schema([("ids", pa.list_(item, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.out = pa.ipc.new_stream(sink, self.schema)
        self.type = np.dtype(item.to_pandas_dtype())
        self.held = bytearray()

    def add(self, ids: bytes) -> None:
        self.held += ids
        step = self.size * self.type.itemsize
        while len(self.held) >= step:
            self._write(np.frombuffer(bytes(self.held[:step]), self.type), self.size)
            del self.held[:step]

    def _write(self, ids: np.ndarray, real: int) -> None:
        mask = np.arange(len(ids)) < real
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x, t), self.length) for x, t in ((ids, self.item), (mask, pa.bool_()))]
        self.out.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def close(self) -> None:
        if self.held:
            ids = np.frombuffer(bytes(self.held), self.type)
            self._write(np.concatenate((ids, np.zeros(-len(ids) % self.length, self.type))), len(ids))
        self.out.close()


class SequenceReader:
    """Random access to the sequences of a file; local files are mapped, and what is returned are views of the map."""

    def __init__(self, uri: str):
        files, path = _filesystem(uri)
        source = pa.memory_map(path) if isinstance(files, pyarrow.fs.LocalFileSystem) else files.open_input_file(path)
        self.batches = list(pa.ipc.open_stream(source))
        self.starts = np.cumsum([0, *(b.num_rows for b in self.batches)])

    def __len__(self) -> int:
        return int(self.starts[-1])

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of sequence i."""
        k = int(np.searchsorted(self.starts, i, "right")) - 1
        row = i - int(self.starts[k])
        ids, mask = (self.batches[k].column(c)[row].values for c in (0, 1))
        return ids.to_numpy(), mask.to_numpy(zero_copy_only=False)

    def stream(self) -> Iterator[np.ndarray]:
        """All real ids, batch by batch."""
        for batch in self.batches:
            ids, mask = batch.column(0).flatten(), batch.column(1).flatten()
            yield ids.to_numpy()[: mask.true_count]


def write_sequences(docs: DataFrame, folder: str, tokenizer: str | None = None, length: int = LENGTH, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the files; part, path, n_docs, n_tokens of each, as a table in the shared folder."""
    tokenizer = tokenizer or default_tokenizer()
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_tokenizer(tokenizer)
        end, width = coder.pack([end_id]), coder.type.itemsize
        context = TaskContext.get()
        files, root = _filesystem(folder)
        files.create_dir(root, recursive=True)
        part = context.partitionId()
        names = [f"{root}/part-{part:06d}.{kind}.arrow" for kind in ("ids", "docs")]
        attempt = [f"{n}.{context.taskAttemptId()}" for n in names]
        n_docs = n_tokens = 0
        index = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64())])
        with files.open_output_stream(attempt[0]) as ids_file, files.open_output_stream(attempt[1]) as docs_file, pa.ipc.new_stream(docs_file, index) as documents:
            writer = SequenceWriter(ids_file, pa.from_numpy_dtype(coder.type), length)
            for batch in batches:
                for piece in slices(batch, "_q_text"):
                    coded = [x + end for x in coder.encode(piece.column("_q_text").to_pylist())]
                    counts = [len(x) // width for x in coded]
                    for x in coded:
                        writer.add(x)
                    documents.write_batch(pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(counts, pa.int64())], schema=index))
                    n_docs, n_tokens = n_docs + len(counts), n_tokens + sum(counts)
            writer.close()
        for temporary, name in zip(attempt, names, strict=True):
            files.move(temporary, name)
        yield pa.RecordBatch.from_pydict({"part": [part], "path": [f"{folder}/part-{part:06d}"], "n_docs": [n_docs], "n_tokens": [n_tokens]}, schema=manifest)

    manifest = pa.schema([("part", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])
    ship_package(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_q_text"))
    order = ["doc_id", F.xxhash64("_q_text")]  # rows that share an id, or have none, are parted by their texts
    ranges = rows.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    written = ranges.mapInArrow(run, "part int, path string, n_docs long, n_tokens long")
    return materialise(written.repartition(1 + shuffle_partitions(spark) // 1000), "arrow-manifest")  # a row for each file


def read_documents(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read from the files."""
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    placed = manifest.filter("n_docs > 0").withColumn("_q_start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("_q_start").to_pylist(), strict=True):
                yield from _read_file(path, start)

    ship_package(manifest.sparkSession)
    files = max(1, manifest.count())
    return placed.select("path", "_q_start").repartition(files).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _read_file(path: str, start: int) -> Iterator[pa.RecordBatch]:
    files, root = _filesystem(path)
    stream, held = SequenceReader(f"{path}.ids.arrow").stream(), np.zeros(0, np.uint16)
    with files.open_input_stream(f"{root}.docs.arrow") as source:
        for batch in pa.ipc.open_stream(source):
            counts, sums = batch.column("n_tokens").to_numpy(), []
            for n in counts:
                while len(held) < n:
                    held = np.concatenate((held, next(stream))) if len(held) else next(stream)
                sums.append(zlib.crc32(held[:n].astype("<u4").tobytes()))
                held = held[n:]
            ends = start + np.cumsum(counts)
            columns = [batch.column("doc_id"), pa.array(ends - counts, pa.int64()), batch.column("n_tokens"), pa.array(sums, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32"])
            start = int(ends[-1]) if len(ends) else start


def op7_arrow_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return read_documents(write_sequences(docs, shared_path(spark, "arrow-tokens")))
