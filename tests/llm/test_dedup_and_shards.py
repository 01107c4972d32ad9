"""Exact duplicates, sharding and mixing: small cases, and SQL on the small tables."""

import hashlib
import re
from pathlib import Path

import duckdb
import pytest

from quarry.llm import exact_dedup, mixing, sharding

DATA = Path("/root/testdata/sf0.001")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, _q_x int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0, "x", 1) for i, t, s in rows], DOCS)


ROWS = [
    (5, "a b", "s1"), (3, "ab", "s1"), (4, "a\tb\n", "s2"), (9, None, "s1"), (8, "", "s1"), (7, " \x0b", None), (1, "a\xa0b", "s3"), (2, "x", "s1"), (2, "x", "s1"), (None, "y", "s1"), (6, "y", "s2"), (None, "z", None),
    (11, "long " * 30_000, "s2"), (12, "Ab", "s2"),
]


def dedup_by_hand(rows):
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i or 0))
    return {norm: (None if min(g)[1] else min(g)[2], len(g)) for norm, g in groups.items()}


@pytest.mark.parametrize("capacity", [1, 4, None])
def test_exact_dedup(spark, capacity):
    got = exact_dedup.exact_dedup(frame(spark, ROWS), capacity=capacity).collect()
    want = dedup_by_hand(ROWS)
    assert len(got) == len(ROWS)
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    for i, t, _ in ROWS:
        keep, size = want[re.sub(r"[\x20\x09-\x0D]", "", t or "")]
        if i is not None:
            assert (by_id[i].keep_id, by_id[i].group_size) == (keep, size)
    assert sum(r.kept for r in got) == len(want)
    assert sorted(r.kept for r in got if r.doc_id == 2) == [False, True]


def test_exact_dedup_keeps_rows_with_their_columns(spark):
    docs = frame(spark, ROWS)
    left = exact_dedup.drop_exact_duplicates(docs)
    assert left.columns == docs.columns and left.count() == len(dedup_by_hand(ROWS))
    assert {r.doc_id for r in left.collect()} == {i for i, _ in dedup_by_hand(ROWS).values()}


def entries_of(docs):
    return exact_dedup._entries(docs, docs.doc_id, docs.text)


def test_index_buckets_split_where_they_are_too_full(spark):
    docs = frame(spark, [(i, f"text {i}", "s") for i in range(300)])
    directory = exact_dedup.build_directory(entries_of(docs), 20)
    index = exact_dedup.build_index(exact_dedup._keyed(docs, docs.doc_id, docs.text), directory)
    hashes = sorted(r._q_hash % 2**64 for r in entries_of(docs).collect())

    def split(low, depth):  # the textbook's splits, one bit at a time
        inside = [h for h in hashes if h >> (64 - depth) == low >> (64 - depth)] if depth else hashes
        return {(low, depth): len(inside)} if len(inside) <= 20 else split(low, depth + 1) | split(low | 1 << (63 - depth), depth + 1)

    want = {k: n for k, n in split(0, 0).items() if n}
    assert {(r._q_bucket % 2**64, r._q_depth) for r in directory.table.collect()} == set(want)
    assert {r._q_bucket % 2**64: r["count"] for r in index.groupBy("_q_bucket").count().collect()} == {low: n for (low, _), n in want.items()}
    assert index.where("_q_slot > 0").count() == 0 and len(want) > 15


def test_rows_are_found_through_the_directory(spark):
    """With a directory that names other buckets than those the index has, or lacks one, rows aren't found."""
    docs = frame(spark, [(i, f"text {i}", "s") for i in range(100)])
    entries, keyed = entries_of(docs), exact_dedup._keyed(docs, docs.doc_id, docs.text)
    directory = exact_dedup.build_directory(entries, 10)
    index = exact_dedup.build_index(keyed, directory)
    assert exact_dedup.look_up(entries, index, directory).count() == 100
    moved = directory.table.withColumn("_q_bucket", exact_dedup.F.col("_q_bucket") + 1)
    assert exact_dedup.look_up(entries, index, exact_dedup.Directory(moved, directory.depth, directory.rows)).count() == 0
    bucket = directory.table.first()._q_bucket
    lacking = exact_dedup.Directory(directory.table.where(f"_q_bucket <> {bucket}"), directory.depth, directory.rows)
    assert exact_dedup.look_up(entries, index, lacking).count() == 100 - index.where(f"_q_bucket = {bucket}").count() < 100


def test_equal_hashes_are_chained(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *_: exact_dedup.F.lit(7).cast("long"))
    docs = frame(spark, [(1, "a", "s"), (2, "b", "s"), (3, "a ", "s"), (4, "c", "s")])
    index = exact_dedup.build_index(exact_dedup._keyed(docs, docs.doc_id, docs.text), exact_dedup.build_directory(entries_of(docs), 1))
    assert sorted(r["_q_slot"] for r in index.collect()) == [0, 1, 2]
    assert {r.doc_id: r.keep_id for r in exact_dedup.exact_dedup(docs, capacity=1).collect()} == {1: 3, 2: 2, 3: 3, 4: 4}


def test_columns_with_names_of_our_own(spark):
    docs = spark.createDataFrame([(1, "a b", "s", 1, 2, 3, 4, 5, 6), (2, "ab", "s", 7, 8, 9, 1, 2, 3)], "doc_id long, text string, source string, _q_id int, _q_norm int, _q_row int, _q_number int, _q_copies int, _q_all int")
    assert exact_dedup.drop_exact_duplicates(docs).columns == docs.columns and [tuple(r) for r in exact_dedup.drop_exact_duplicates(docs).collect()] == [(1, "a b", "s", 1, 2, 3, 4, 5, 6)]
    mixed = mixing.apply_mix(docs, 1)
    assert mixed.columns == docs.columns and {tuple(r) for r in mixed.collect()} <= {tuple(r) for r in docs.collect()} and mixed.count()


def jump(key, shards):
    b, j, key = -1, 0, key & (1 << 64) - 1
    while j < shards:
        b, key = j, (key * sharding.MULTIPLIER + 1) & (1 << 64) - 1
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_shards_are_those_of_the_published_algorithm(spark):
    keys = [0, 1, 2, 41, -1, -(2**63), 2**63 - 1, 10**12, *range(1000, 1300)]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for shards in (1, 2, 40, 1000):
        got = df.select("k", sharding.jump_state(df.k, shards).b.alias("b")).collect()
        assert {r.k: r.b for r in got} == {k: jump(k, shards) for k in keys}


def test_sharding(spark):
    rows = [(i, "t" * (i % 7), "s") for i in range(2000)] + ROWS
    got = sharding.shard_documents(frame(spark, rows), chunk_rows=3).collect()
    assert len(got) == len(rows)
    slots = {}
    for r in got:
        assert r.shard == jump(r.doc_id or 0, 40) and r.grown_shard == jump(r.doc_id or 0, 41) and r.grown_shard in (r.shard, 40)
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = {r.doc_id: r.size for r in got}
    assert sizes[9] == 16 and sizes[1] == 16 + 4


def water_filling(sizes):
    weights = {s: 1 + i % 3 for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, (s or "").encode())))}
    total, full, target = sum(sizes.values()), set(), {}
    while True:
        rest, share = total - sum(3 * sizes[s] for s in full), sum(weights[s] for s in sizes if s not in full)
        target = {s: 3.0 * sizes[s] if s in full else rest * weights[s] / share for s in sizes}
        over = {s for s in sizes if s not in full and target[s] > 3 * sizes[s]}
        if not over:
            return target
        full |= over


@pytest.mark.parametrize("block", [1, 7, 4096])
def test_mixing(spark, block):
    rows = [(i, " ".join(["w"] * (i * 7 % 23)), f"s{i % 5 if i % 3 else 0}") for i in range(400)] + [(None, "a b", None), (900, None, "empty"), (901, "", None), (2007, "x y z", "s1"), (2007, "x y z", "s1")]
    first = mixing.mix(frame(spark, rows), block).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    target, taken, source = water_filling(sizes), {}, {i: s for i, _, s in rows}
    assert len(first) == len(rows)
    for r in first:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(target[s]) and 0 <= r.taken <= 3 * r.size
        taken[s] = taken.get(s, 0) + r.taken
    assert all(taken[s] == pytest.approx(round(target[s]), abs=1) for s in sizes)
    assert sorted(map(str, mixing.mix(frame(spark, rows).repartition(3), block).collect())) == sorted(map(str, first))


def test_the_schedule_mixes_evenly(spark):
    targets = spark.createDataFrame([("a", 9000, 6000.0), ("b", 9000, 3000.0), (None, 900, 1000.0)], "source string, source_size long, target double")
    slots = sorted((r.slot, str(r.source)) for r in mixing.schedule(targets, 10_000, 10).collect())
    assert [sum(s == name for _, s in slots) for name in ("a", "b", "None")] == [600, 300, 100]
    for i in range(0, 900, 100):  # every stretch has about the same shares
        assert abs(sum(s == "a" for _, s in slots[i : i + 100]) - 60) <= 4


def test_slots_are_those_of_the_points(spark):
    """First slots against a plain walk over the schedule, and a schedule of other points gives others."""
    block, rows = 5, [(i, " ".join(["w"] * (1 + i * 7 % 23)), f"s{i % 3}") for i in range(120)]
    got = {r.doc_id: r for r in mixing.mix(frame(spark, rows), block).collect()}
    target = water_filling({s: sum(len(t.split()) for _, t, o in rows if o == s) for s in ("s0", "s1", "s2")})
    total, slots, upto = sum(target.values()), {s: [] for s in target}, {}
    for s in sorted(target):
        upto[s] = sum(target[x] for x in target if x <= s) / total
    n = -(-sum(r.size for r in got.values()) // block)
    for t in range(n):
        x = (t + 1) * mixing.GOLDEN % 1
        slots[next((s for s in sorted(target) if x < upto[s]), "s2")].append(t)
    for s in target:
        at, quota = 0, round(target[s])
        own = sorted((i for i, _, o in rows if o == s), key=lambda i: hashlib.md5(f"mix:{i}".encode()).hexdigest())
        size = got[own[0]].source_size
        for i in own:
            want = []
            for lap in range(mixing.MOST):
                rank = (lap * size + at) // block
                want.append(None if lap * size + at >= quota else slots[s][rank] if rank < len(slots[s]) else n)
            assert got[i].slots == (want if got[i].taken else None)
            at += got[i].size
    changed = mixing.schedule(spark.createDataFrame([(s, 0, t) for s, t in target.items()], "source string, source_size long, target double"), int(total), block)
    assert {(r.source, r["rank"]): r.slot for r in changed.collect() if r.slot < n} == {(s, k): t for s, ts in slots.items() for k, t in enumerate(ts) if k < -(-round(target[s]) // block)}


def test_mixed_copies(spark):
    docs = frame(spark, [(i, "a b c d", "s0" if i < 20 else "s1") for i in range(40)])
    mixed = mixing.apply_mix(docs, 4)
    assert mixed.columns == docs.columns and abs(mixed.count() - 40) <= 1
    assert max(r["count"] for r in mixed.groupBy("doc_id").count().collect()) <= 3
    slot = {r.doc_id: r.slots[0] for r in mixing.mix(docs, 4).collect() if r.taken}
    order = [slot[r.doc_id] for r in mixed.collect()]
    assert len(set(order)) > 10 and [x for i, x in enumerate(order) if x not in order[:i]] == sorted(set(order))


@pytest.mark.parametrize("call", [exact_dedup.exact_dedup, exact_dedup.drop_exact_duplicates, sharding.shard_documents, mixing.mix, mixing.apply_mix])
def test_empty_tables(spark, call):
    assert call(frame(spark, [])).count() == 0


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
@pytest.mark.parametrize("query, sql", [(exact_dedup.op2_exact_dedup, exact_dedup.OP2_SQL), (mixing.op9_mixing, mixing.OP9_SQL), (sharding.op8_sharding, sharding.OP8_SQL)])
def test_sql(spark, query, sql):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{DATA}/documents.parquet'")
    want = con.execute(sql)
    names = [c[0] for c in want.description]
    got = query(spark, str(DATA))
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(repr, map(tuple, got.select(*names).collect()))) == sorted(map(repr, want.fetchall()))
