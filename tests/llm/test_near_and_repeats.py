"""SimHash groups and repeated substrings against brute force, and the pipeline."""

import collections
import hashlib
import random
import re
from pathlib import Path

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from quarry.llm import simhash, suffix

DATA = Path("/root/testdata/sf0.001")


def frame(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, "x") for i, t in zip(ids or range(len(texts)), texts, strict=True)], "doc_id long, text string, component_id string")


def print_by_hand(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(n, edges):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def clustered(seed, centres=40):
    r, rows = random.Random(seed), []
    for _ in range(centres):
        own = [r.getrandbits(64)]
        for _ in range(r.randrange(25)):
            x = r.choice(own)
            for _ in range(r.randrange(8)):
                x ^= 1 << r.randrange(64)
            own.append(x)
        rows += own
    return np.array(list(dict.fromkeys(rows)), np.uint64)


def test_fingerprints():
    r = random.Random(1)
    for text in ["", " \t", "A", "a B c", "a b c d", "A b\x0bC d E", "é É x y z", *(" ".join(r.choice("abcd") for _ in range(r.randrange(60))) for _ in range(60)), "w " * 3000]:
        assert simhash.fingerprint(text.encode()) == print_by_hand(text)


@pytest.mark.parametrize("radius", [0, 2, 4])
def test_bit_sliced_comparison(radius):
    rows = clustered(radius)
    near = [(i, j) for j in range(len(rows)) for i in range(j) if bin(int(rows[i]) ^ int(rows[j])).count("1") <= radius]
    a, b = simhash.small_keys_edges(rows, np.array([len(rows)]), radius)
    assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == sorted(near)
    assert roots(len(rows), simhash.spanning_edges(rows, radius)) == roots(len(rows), near)
    sizes = np.array([1, 70, 2, len(rows) - 73])
    of = np.repeat(np.arange(4), sizes)
    a, b = simhash.small_keys_edges(rows, sizes, radius)
    assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == sorted((i, j) for i, j in near if of[i] == of[j])


def test_every_near_pair_shares_a_key():
    r = random.Random(2)
    for pieces in range(5, 9):
        masks = simhash.key_masks(pieces)
        for _ in range(300):
            x = r.getrandbits(64)
            y = x
            for bit in r.sample(range(64), 4):
                y ^= 1 << bit
            assert any(x & m == y & m for m in masks)
    assert simhash.pieces_for(10**5) == 5 and simhash.pieces_for(10**9) == 6 and simhash.pieces_for(10**30) == 8


@pytest.mark.parametrize("key_rows, split_rows", [(4096, 1 << 15), (4096, 6), (1, 1 << 15)])
def test_links_and_components(spark, key_rows, split_rows):
    rows = clustered(9, 15)
    near = [(i, j) for j in range(len(rows)) for i in range(j) if bin(int(rows[i]) ^ int(rows[j])).count("1") <= 4]
    ids = [7 * i + 3 for i in range(len(rows))]
    prints = spark.createDataFrame([(i, int(x)) for i, x in zip(ids, rows.view(np.int64), strict=True)] + [(None, int(rows.view(np.int64)[0]))], "_q_id long, _q_fp long")
    got = {r._q_fp: r.component_id for r in simhash.near_duplicate_groups(prints, 4, key_rows, split_rows).collect()}
    assert [got[int(x)] for x in rows.view(np.int64)] == [ids[k] for k in roots(len(rows), near)]


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(50, 60), (70, 60)], "_q_a long, _q_b long")
    got = {r.vertex: r.root for r in simhash.components(edges).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in (50, 60, 70)} == {50}


def test_simhash_query_and_rows_that_stay(spark):
    r = random.Random(4)
    base = [" ".join(r.choice(["ab", "cd", "ef", "gh", "ij"]) + str(r.randrange(40)) for _ in range(150)) for _ in range(12)]
    texts = base + [b + " tail" for b in base] + [None, "", "\n"] + base[:2]
    ids = [*range(len(texts) - 2), 0, 1]
    got = simhash.simhash_near_dedup(frame(spark, texts, ids)).collect()
    prints = [print_by_hand(t) for t in texts]
    root = roots(len(texts), [(i, j) for j in range(len(texts)) for i in range(j) if bin(prints[i] ^ prints[j]).count("1") <= 4])
    least = {}
    for i, k in zip(ids, root, strict=True):
        least[k] = min(least.get(k, 10**9), i)
    assert sorted((x.doc_id, x.fingerprint, x.component_id) for x in got) == sorted((i, f"{p:016x}", least[k]) for i, p, k in zip(ids, prints, root, strict=True))
    left = simhash.drop_near_duplicates(frame(spark, texts, ids))
    assert sorted(x.doc_id for x in left.collect()) == sorted(set(least.values())) and left.columns == ["doc_id", "text", "component_id"]


def test_unlike_rows_without_ids_or_with_one_id_stay(spark):
    r = random.Random(6)
    texts = [" ".join(r.choice("abcdefgh") + str(r.randrange(90)) for _ in range(80)) for _ in range(9)]
    rows = [*texts, texts[0], texts[6]]
    ids = [None, None, None, 7, 7, 7, 5, None, 9, None, None]
    left = simhash.drop_near_duplicates(frame(spark, rows, ids)).collect()
    assert sorted(x.text for x in left) == sorted(texts)
    assert {x.text: x.doc_id for x in left} == dict(zip(texts, ids, strict=False))


def repeats_by_hand(texts, n):
    count = collections.Counter(t[p : p + n] for t in texts for p in range(len(t) - n + 1))
    found = []
    for t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - n + 1):
            if count[t[p : p + n]] > 1:
                gone[p : p + n] = b"\1" * n
        kept = bytes(x for x, g in zip(t, gone, strict=True) if not g)
        found.append((len(t), sum(gone), sum(g and (not i or not gone[i - 1]) for i, g in enumerate(gone)), kept))
    return found


def passages_by_hand(texts, n_bytes, n_words, words_pattern=rb"[^\x20\x09-\x0D]+"):
    """Runs and words of word sequences that occur in another text and are not all removed, for different texts."""
    words = [[(m.start(), m.end(), m.group()) for m in re.finditer(words_pattern, t)] for t in texts]
    where = collections.defaultdict(set)
    for k, w in enumerate(words):
        for p in range(len(w) - n_words + 1):
            where[tuple(x[2] for x in w[p : p + n_words])].add(k)
    count = collections.Counter(t[p : p + n_bytes] for t in texts for p in range(len(t) - n_bytes + 1))
    found = []
    for k, (t, w) in enumerate(zip(texts, words, strict=True)):
        gone = bytearray(len(t))
        for p in range(len(t) - n_bytes + 1):
            if count[t[p : p + n_bytes]] > 1:
                gone[p : p + n_bytes] = b"\1" * n_bytes
        hit = bytearray(len(w))
        for p in range(len(w) - n_words + 1):
            a, z = w[p][0], w[p + n_words - 1][1]
            if len(where[tuple(x[2] for x in w[p : p + n_words])]) > 1 and not all(gone[a:z]):
                hit[p : p + n_words] = b"\1" * n_words
        found.append((sum(g and (not i or not hit[i - 1]) for i, g in enumerate(hit)), sum(hit)))
    return found


def test_passages(spark):
    r = random.Random(15)
    word = lambda: "".join(r.choice("abcdé") for _ in range(r.randrange(1, 5)))
    shared = [[word() for _ in range(r.randrange(8, 30))] for _ in range(8)]
    texts = []
    for _ in range(60):
        words = []
        for _ in range(r.randrange(6)):
            words += r.choice(shared) if r.random() < 0.5 else [word() for _ in range(r.randrange(1, 25))]
        texts.append("".join(w + r.choice([" ", " ", "\n", "  "]) for w in words) + str(len(texts)))
    texts += ["", None, " ".join(shared[0]), "  ".join(shared[0])]
    got = sorted(suffix.remove_repeats(frame(spark, texts), suffix.Rule(60, 40, 4), passages=suffix.Rule(10, 7, 4)).collect(), key=lambda x: x.doc_id)
    want = passages_by_hand([(t or "").encode() for t in texts], 60, 10)
    assert [(x.n_passages, x.n_passage_words) for x in got] == want and sum(n > 0 for n, _ in want) > 20
    assert [(x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept)) for x in got] == repeats_by_hand([(t or "").encode() for t in texts], 60)


@pytest.mark.parametrize("hot, alphabet", [(10**6, "abc é"), (2, "ab"), (2, "abcdefghij é")])
def test_repeats(spark, hot, alphabet):
    r = random.Random(5)
    passages = ["".join(r.choice(alphabet) for _ in range(r.randrange(5, 120))) for _ in range(12)]
    noise = lambda: "".join(r.choice("abcdefgh é") for _ in range(r.randrange(1, 80)))
    texts = ["".join(r.choice(passages) if r.random() < 0.5 else noise() for _ in range(r.randrange(9))) for _ in range(80)]
    texts += [None, "", "a" * 300, "a" * 39, "a" * 41, "ab" * 90, texts[5], texts[5], f"{texts[7]}zz", "b" * 40]
    got = suffix.remove_repeats(frame(spark, texts), suffix.Rule(40, 24, 4, hot, 5)).collect()
    want = repeats_by_hand([(t or "").encode() for t in texts], 40)
    assert [(x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept)) for x in sorted(got, key=lambda x: x.doc_id)] == want


def test_repeats_of_repeated_rows_and_null_ids(spark):
    text = "".join(random.Random(6).choice("abcdefgh") for _ in range(60))
    got = suffix.remove_repeats(frame(spark, [text, text, text, "other " * 3], [1, 1, None, None]), suffix.Rule(40, 24, 4)).collect()
    assert sorted((str(x.doc_id), x.n_removed) for x in got) == [("1", 60), ("1", 60), ("None", 0), ("None", 60)]


def test_triggers_depend_on_the_string_alone():
    r, rule = random.Random(8), suffix.Rule(40, 24, 4)
    shared = bytes(r.randrange(97, 100) for _ in range(60))
    seen = []
    for before in (b"", b"xyz", b"ab" * 20):
        text = before + shared + b"q" * 10
        of, t, first, _ = suffix.triggers(np.frombuffer(text, np.uint8), np.array([0]), np.array([len(text)]), rule)
        trigger_of = {p: int(t[np.searchsorted(first, p, "right") - 1]) - len(before) for p in range(len(before), len(before) + 21)}
        seen.append([trigger_of[p] for p in range(len(before), len(before) + 21)])
    assert seen[0] == seen[1] == seen[2]


@pytest.mark.parametrize("most", [1, 7, 40, 500])
def test_triggers_of_a_long_document_in_pieces(most):
    r, rule = random.Random(9), suffix.Rule(40, 24, 4)
    for n in (0, 39, 40, 41, 300, 1500):
        data = np.frombuffer(bytes(r.randrange(97, 100) for _ in range(n)), np.uint8)
        want = suffix.triggers(data, np.array([0]), np.array([n]), rule)[1:]
        pieces = list(suffix.triggers_in_pieces(data, rule, most))
        got = [np.concatenate([p[k] for p in pieces] or [np.zeros(0, np.int64)]) for k in range(3)]
        assert all(np.array_equal(a, b) for a, b in zip(got, want, strict=True))


def test_repeats_of_documents_beyond_a_block(spark, monkeypatch):
    r = random.Random(10)
    shared = "".join(r.choice("abcdefgh é") for _ in range(900))
    texts = ["".join(r.choice("abcdefgh é") for _ in range(700)) + shared[k : 900 - 3 * k] + "xyz" * k for k in range(5)] + [shared * 3, "", "short"]
    want = repeats_by_hand([t.encode() for t in texts], 40)
    monkeypatch.setattr(suffix, "CUT_AT_ONCE", 3)
    rows = frame(spark, texts).selectExpr("doc_id as dk", "doc_id as tk", "cast(text as binary) as text").toArrow().to_batches()
    rule = suffix.Rule(40, 24, 4)
    whole = [tuple(x.values()) for b in suffix._triggers_of(iter(rows), rule) for x in b.to_pylist()]
    monkeypatch.setattr(suffix, "BYTES_AT_ONCE", 100)
    monkeypatch.setattr(suffix.triggers_in_pieces, "__defaults__", (100,))
    assert [tuple(x.values()) for b in suffix._triggers_of(iter(rows), rule) for x in b.to_pylist()] == whole
    got = suffix.remove_repeats(frame(spark, texts), rule).collect()
    assert [(x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept)) for x in sorted(got, key=lambda x: x.doc_id)] == want


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
def test_repeats_on_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    want = repeats_by_hand([d.text.encode() for d in docs], 400)
    got = {x.doc_id: x for x in suffix.op6_suffix(spark, str(DATA)).collect()}
    for d, (n, removed, spans, kept) in zip(docs, want, strict=True):
        assert (got[d.doc_id].n_bytes, got[d.doc_id].n_removed, got[d.doc_id].n_spans, got[d.doc_id].kept_sha256) == (n, removed, spans, hashlib.sha256(kept).hexdigest())
    words = passages_by_hand([d.text.encode() for d in docs], 400, 50)
    assert [(got[d.doc_id].n_passages, got[d.doc_id].n_passage_words) for d in docs] == words


@pytest.mark.parametrize("call", [simhash.simhash_near_dedup, simhash.drop_near_duplicates, suffix.remove_repeats])
def test_empty_tables(spark, call):
    assert call(frame(spark, [])).count() == 0


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
def test_pipeline_stages_against_plain_code(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, rows = docs.columns, {r.doc_id: r for r in docs.collect()}
    kept = [set(rows)]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialise(stage(spark, docs, str(DATA)), f"test-{name}")
        assert docs.columns == columns
        got = [r.doc_id for r in docs.collect()]
        assert set(got) <= kept[-1] and (name == "mix" or len(got) == len(set(got)))
        kept.append(set(got))
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    assert all(i not in kept[1] for i, q in labels.items() if q == 0) or sum(i in kept[1] for i, q in labels.items() if q == 0) <= 2
    assert sum(i not in kept[1] for i, q in labels.items() if q == 1) <= 2
    plain = collections.defaultdict(list)
    for i in kept[1]:
        plain["".join(c for c in rows[i].text if c not in " \t\n\v\f\r")].append((-len(rows[i].text), i))
    assert kept[2] == {min(g)[1] for g in plain.values()}
    ids = sorted(kept[2])
    words = [rows[i].text.lower().split() for i in ids]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in words]
    root = roots(len(ids), [(i, j) for j in range(len(ids)) for i in range(j) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])])
    assert kept[3] == {ids[k] for k in set(root)}
    last = corpus_pipeline.STAGES[-1][1](spark, docs, str(DATA)).collect()
    assert {r.doc_id for r in last} == kept[4] and all(bytes(r.decoded).decode() == rows[r.doc_id].text for r in last)
    assert corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "mix", "bpe"]
