"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Texts are encoded in Arrow batches on the executors. A long text is first cut at safe boundaries so that the library never
holds one huge piece list: a cut goes between a character that is not white space and white space that is one plain space
followed by a letter, where the pre-splitting pattern always starts a new match (`` ?\\p{L}+`` begins at that space and no
alternative can reach over it). The ids of the pieces, joined, are therefore the ids of the whole text. Decoding works on
raw bytes, so ids that end inside a character are no error.

Cases: null and empty texts have no ids and decode to no bytes; repeated rows are encoded alike; other columns pass
through untouched, and a column named like one of the two results is replaced by it.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Carried, read_table, ship_package, slices

#: Characters from which a text is cut before it is encoded.
LONG_TEXT = 1 << 16
_SAFE_CUT = re.compile(r"(?<=[a-z.,]) (?=[a-zA-Z])")


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


@functools.lru_cache(maxsize=4)
def encoding(ranks_path: str, pattern: str):
    """The tiktoken encoding, once per worker process. It has no special tokens, so their strings are ordinary text."""
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("quarry", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def split_safely(text: str, size: int = LONG_TEXT) -> Iterator[str]:
    """Pieces of at least ``size`` characters, cut only where the pattern always starts a new match; joined they are the text."""
    start = 0
    while len(text) - start > size:
        cut = _SAFE_CUT.search(text, start + size)
        if not cut:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encode_text(text: str | None, ranks_path: str, pattern: str, size: int = LONG_TEXT) -> list[int]:
    if not text:
        return []
    encode = encoding(ranks_path, pattern).encode_ordinary
    if len(text) <= size:
        return encode(text)
    return [i for piece in split_safely(text, size) for i in encode(piece)]


def encode_and_decode(docs: DataFrame, text_col: str = "text", ranks_path: str | None = None, pattern: str | None = None, keep: tuple[str, ...] | None = None) -> DataFrame:
    """Append token_ids (array of int) and decoded (binary: the bytes that the ids stand for) to the columns ``keep`` (all but the text unless given)."""
    ranks_path, pattern = ranks_path or default_ranks(), pattern or default_pattern()
    names = [c for c in (docs.columns if keep is None else keep) if c not in ("token_ids", "decoded") and (keep is not None or c != text_col)]
    carried = Carried(docs, names)
    schema = T.StructType(carried.fields + [T.StructField("token_ids", T.ArrayType(T.IntegerType(), False), False), T.StructField("decoded", T.BinaryType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoding(ranks_path, pattern)
        for batch in batches:
            for part in slices(batch, "_q_text"):
                ids = [encode_text(t, ranks_path, pattern) for t in part.column("_q_text").to_pylist()]
                columns = [part.column(c) for c in carried.names] + [pa.array(ids, pa.list_(pa.int32())), pa.array([coder.decode_bytes(x) for x in ids], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=[*carried.names, "token_ids", "decoded"])

    ship_package(docs.sparkSession)
    coded = docs.select(*carried.inside(), F.col(text_col).alias("_q_text")).mapInArrow(run, schema)
    return coded.select(*carried.outside(), "token_ids", "decoded")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_and_decode(read_table(spark, sf_dir, "documents"), keep=("doc_id",))
    return coded.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
