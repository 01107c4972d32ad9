"""The registered queries over whole small tables against plain code, and columns with awkward names."""

import hashlib
import re
import zlib
from pathlib import Path

import numpy as np
import pytest
import xxhash

from quarry import llm
from quarry.llm import arrow_output, bpe, exact_dedup, media, mixing, pii, quality, simhash

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def test_ten_queries_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in llm.queries()) == list(range(1, 11))
    assert llm.oracle_sql().keys() <= llm.queries().keys()


def test_op1(spark, texts):
    rows = media.op1_media(spark, DATA).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        full = media.padded(texts[r.doc_id].encode())
        stored = media.jpeg_from_bytes(texts[r.doc_id].encode())
        assert (r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256) == (sha(full), zlib.crc32(full[-64:]), len(stored), sha(stored))


def test_op1_features(spark, texts):
    """The feature from the payload in plain loops: its bytes are rows of 64 blocks of 8 x 8 pixels, and cells of an 8 x 8 grid above the mean are set."""
    for r in media.op1_media(spark, DATA).collect():
        payload = media.padded(texts[r.doc_id].encode())
        rows = [payload[i : i + 64] for i in range(0, len(payload), 64)]
        cells = []
        for i in range(8):
            own = rows[i * len(rows) // 8 : max((i + 1) * len(rows) // 8, i * len(rows) // 8 + 1)]
            cells += [sum(sum(x[8 * j : 8 * j + 8]) for x in own) / len(own) / 8 for j in range(8)]
        bits = int("".join("01"[int(c > np.mean(cells))] for c in cells), 2)
        assert r.feature == f"512x{8 * len(rows)}:{bits:016x}"


def test_op3(spark, texts):
    prints = {}
    for i, text in texts.items():
        words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        words = re.findall(r"[^\x20\x09-\x0D]+", words)
        hashes = [xxhash.xxh64_intdigest(" ".join(words[k : k + 4]).encode(), 42) for k in range(max(1, len(words) - 3))] if words else [0]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    least = {i: i for i in texts}
    while True:  # the smallest id spreads over links until nothing changes
        after = {i: min(least[j] for j in texts if (prints[i] ^ prints[j]).bit_count() <= 4) for i in texts}
        if after == least:
            break
        least = after
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op3_simhash(spark, DATA).collect()} == {i: (f"{prints[i]:016x}", least[i]) for i in texts}


def test_op4(spark, texts):
    coder = bpe.encoding(bpe.default_ranks(), bpe.default_pattern())
    for r in bpe.op4_bpe(spark, DATA).collect():
        ids = coder.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids)).encode()), sha(texts[r.doc_id].encode()))


def test_op7(spark, texts):
    library, position, want = arrow_output.word_tokenizer(arrow_output.default_tokenizer()).library, 0, []
    for i in sorted(texts):
        ids = library.encode(texts[i], add_special_tokens=False).ids + [1]
        want.append((i, position, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        position += len(ids)
    assert sorted(map(tuple, arrow_output.op7_arrow_output(spark, DATA).collect())) == want


def test_op10(spark, texts):
    weights = pii.trained()
    for r in pii.op10_pii(spark, DATA).collect():
        base, spans = pii.find_spans(texts[r.doc_id], weights)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[2] == k for s in base) for k in pii.KINDS]
        assert r.base_sha256 == sha(",".join(f"{k}:{a}:{z}" for a, z, k in base).encode()) and r.spans == ",".join(f"{k}:{a}:{z}" for a, z, k in spans)


def test_awkward_column_names(spark):
    docs = spark.createDataFrame([(1, "some words here", "s", 1, 2, "b"), (2, "some words here", "t", 3, 4, "c"), (3, "", "s", 5, 6, "d")], "doc_id long, text string, source string, `a.b` int, `size` int, `kept``x` string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    for call in (lambda d: quality.keep_good(d, labels), exact_dedup.drop_exact_duplicates, simhash.drop_near_duplicates, mixing.apply_mix):
        assert call(docs).columns == docs.columns and call(docs).count() >= 1
    assert bpe.encode_and_decode(docs).columns == ["doc_id", "source", "a.b", "size", "kept`x", "token_ids", "decoded"]
    assert bpe.encode_and_decode(docs).count() == 3
