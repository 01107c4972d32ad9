"""Similar texts against brute force over their shingle sets."""

import random

import numpy as np
import pytest

import corpus_pipeline
from quarry.llm import simhash, similar


def frame(spark, texts, ids):
    return spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")


def sets(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def roots(found):
    parent = list(range(len(found)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for j in range(len(found)):
        for i in range(j):
            if jaccard(found[i], found[j]) >= 0.8 and find(i) != find(j):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(found))]


def edited(r, text, changes):
    words = text.split()
    for at in r.sample(range(len(words)), changes):
        words[at] = f"new{r.randrange(10**6)}"
    return " ".join(words)


def test_components_by_hand(spark):
    r = random.Random(3)
    bases = [" ".join(f"w{r.randrange(3000)}" for _ in range(r.choice([40, 100, 300]))) for _ in range(14)]
    texts = bases + [edited(r, b, k) for b in bases for k in (1, 2, 3)] + ["", None, "a b", "A  b", "a c"]
    rows = spark.createDataFrame([(i, (t or "").encode()) for i, t in enumerate(texts)], "_q_row long, _q_text binary")
    got = {x.vertex: x.root for x in similar.similar_components(rows).collect()}
    want = roots([sets(t) for t in texts])
    assert 20 < len(set(want)) < len(texts) - 10
    assert [got.get(i, i) for i in range(len(texts))] == want


def test_stage_drops_copies_at_nine_tenths(spark):
    """One word in 100 changed: similarity about 0.9, which a radius of four bits mostly misses."""
    r = random.Random(5)
    bases = [" ".join(f"w{r.randrange(3000)}" for _ in range(100)) for _ in range(20)]
    copies = [edited(r, b, 1) for b in bases]
    left = corpus_pipeline.near_stage(spark, frame(spark, bases + copies, range(40)), "")
    assert left.columns == ["doc_id", "text"] and sorted(x.doc_id for x in left.collect()) == list(range(20))


def test_ids_null_or_shared(spark):
    r = random.Random(6)
    texts = [" ".join(f"w{r.randrange(3000)}" for _ in range(80)) for _ in range(6)]
    rows = frame(spark, [*texts, texts[0], texts[5]], [None, None, 7, 7, 5, None, 9, None])
    left = {x.text: x.doc_id for x in similar.drop_similar(rows).collect()}
    assert left == dict(zip(texts, [9, None, 7, 7, 5, None], strict=True)) and similar.drop_similar(rows).count() == 6


def test_recall_of_the_keys():
    """Pairs just above the bound share a key and lie within the radius, at several corpus sizes."""
    r, met = random.Random(7), []
    for _ in range(700):
        base = " ".join(f"w{r.randrange(10**6)}" for _ in range(200))
        other = edited(r, base, 4)
        if 0.8 <= jaccard(sets(base), sets(other)) < 0.85:
            a, b = (similar.wide_print(similar.shingles(t.encode())) for t in (base, other))
            far = [int(x) ^ int(y) for x, y in zip(a, b, strict=True)]
            near = sum(x.bit_count() for x in far) <= similar.RADIUS
            met.append([near and any(not any(x & m for x, m in zip(far, mask, strict=True)) for mask in similar.key_masks(n)) for n in (100, 200_000, 10**9)])
    assert len(met) > 300 and (np.mean(met, axis=0) > 0.96).all()


def test_wide_prints_by_hand():
    r = random.Random(8)
    for n in (1, 2, 5, 5000):
        hashes = np.array([r.getrandbits(64) for _ in range(n)], np.uint64)
        want = []
        for k in range(similar.WORDS):
            mixed = []
            for h in hashes.tolist():
                x = (h ^ int(similar._SALT[k, 0])) * int(similar._TURN[0, k, 0]) % 2**64
                x = (x ^ x >> 29) * int(similar._TURN[1, k, 0]) % 2**64
                mixed.append(x ^ x >> 32)
            want.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in mixed) > n))
        assert similar.wide_print(hashes).tolist() == want


def test_pairs_and_forests_by_hand():
    r = np.random.default_rng(9)
    sizes = np.array([1, 200, 3, 70, 64])
    key = np.repeat(np.arange(5), sizes)
    prints = r.integers(0, 1 << 63, (3, len(key)), np.uint64)
    for _ in range(600):  # near copies of other rows
        a, b = r.integers(0, len(key), 2)
        prints[:, a] = prints[:, b]
        prints[r.integers(0, 3), a] ^= np.uint64(int(r.integers(0, 1 << 8)))
    distance = lambda i, j: sum((int(x) ^ int(y)).bit_count() for x, y in zip(prints[:, i], prints[:, j], strict=True))
    near = {(i, j) for j in range(len(key)) for i in range(j) if key[i] == key[j] and distance(i, j) <= 9}
    got = [p for a, b in similar.pairs_within(prints, sizes, 9) for p in zip(a.tolist(), b.tolist(), strict=True)]
    assert len(got) == len(set(got)) and set(got) == near and len(near) > 60
    want = [0] * len(key)
    for i in range(len(key)):
        want[i] = min([i] + [j for j in range(i) if (j, i) in near])
    labels = np.arange(len(key))
    for a, b in similar.pairs_within(prints, sizes, 9):
        labels = similar.join_labels(labels, a, b)
    by_edges = np.arange(len(key))
    edges = simhash.spanning_edges(prints[:, 1:201], 9)
    by_edges = similar.join_labels(by_edges, np.array([1 + a for a, _ in edges]), np.array([1 + b for _, b in edges]))
    assert (by_edges[1:201] == labels[1:201]).all() and labels.tolist() == joined(len(key), near) and all(w >= x for w, x in zip(want, labels, strict=True))


def joined(n, pairs):
    label = list(range(n))
    for a, b in sorted(pairs):
        low, high = sorted((label[a], label[b]))
        label = [low if x == high else x for x in label]
    return label


def test_links_of_a_family_by_hand():
    r = random.Random(12)
    for n in (1, 2, 30, 90):
        base = [r.getrandbits(64) for _ in range(60)]
        sets = [np.array(sorted({x if r.random() > 0.08 else r.getrandbits(64) for x in base}), np.uint64) for _ in range(n)]
        near = {(i, j) for j in range(n) for i in range(j) if jaccard(set(sets[i].tolist()), set(sets[j].tolist())) >= 0.8}
        assert joined(n, similar.similar_links(sets)) == joined(n, near) and len(similar.similar_links(sets)) < n


@pytest.mark.parametrize("key_rows, split_rows, part_rows", [(4, 1 << 15, 1 << 10), (512, 10, 2), (512, 1 << 15, 3)])
def test_small_keys_and_parts_of_keys(spark, key_rows, split_rows, part_rows):
    r = random.Random(11)
    bases = [" ".join(f"w{r.randrange(3000)}" for _ in range(100)) for _ in range(12)]
    texts = bases + [edited(r, b, k) for b in bases for k in (1, 2, 4)] * 2
    rows = spark.createDataFrame([(i, t.encode()) for i, t in enumerate(texts)], "_q_row long, _q_text binary")
    got = {x.vertex: x.root for x in similar.similar_components(rows, key_rows, split_rows, part_rows=part_rows).collect()}
    assert [got.get(i, i) for i in range(len(texts))] == roots([sets(t) for t in texts])


def test_columns_of_any_name_pass_through(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g", 5, 6, "x"), (2, "A b c d e f g", 7, 8, "y"), (3, None, 9, 1, "z")], "doc_id long, text string, _q_row int, _Q_ROW_ int, `a.b` string")
    left = similar.drop_similar(docs)
    assert left.columns == docs.columns and sorted(map(tuple, left.collect()), key=lambda x: x[0]) == [(1, "a b c d e f g", 5, 6, "x"), (3, None, 9, 1, "z")]


def test_empty_table(spark):
    assert similar.drop_similar(frame(spark, [], [])).count() == 0
