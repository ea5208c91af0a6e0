"""SimHash groups against brute force over all pairs."""

import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from siftwell.llm import simhash as sh


def plain(text):
    words = (text or "").encode().lower().split()
    own = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    count = [0] * 64
    for s in own:
        h = xxhash.xxh64_intdigest(s, 42)
        for i in range(64):
            count[i] += h >> i & 1
    return sum(1 << i for i in range(64) if count[i] * 2 > len(own)) if own else 0


def brute(fps, radius=4):
    label = {i: i for i, _ in fps}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    ids, bits = [i for i, _ in fps], np.array([f for _, f in fps], np.uint64)
    for k in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(bits[:k] ^ bits[k]) <= radius):
            a, b = find(ids[j]), find(ids[k])
            label[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def check(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = sh.near_duplicates(df, **more).collect()
    fps = [(i, plain(t)) for i, t in rows]
    assert {r.id: r.fp % 2**64 for r in out} == dict(fps)
    assert {r.id: r.component for r in out} == brute(fps)


def test_small_corpus(spark):
    rng = random.Random(3)
    base = [[f"t{rng.randrange(400)}" for _ in range(200)] for _ in range(6)]
    rows = [(1000, None), (1001, ""), (1002, " \n"), (1003, "One two"), (1004, "one TWO"), (1005, "É é"), (1006, "word " * 5000)]
    for i in range(150):
        words = list(rng.choice(base))
        for _ in range(rng.randrange(4)):
            words[rng.randrange(200)] = "x%d" % rng.randrange(99)
        rows.append((i * 3, " ".join(words)))
    check(spark, rows)
    check(spark, rows, block=7)


def test_whole_table(spark):
    check(spark, [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()])


def test_edges(spark):
    out = sh.near_duplicates(spark.createDataFrame([(None, "a b c d e"), (5, "a b c d e"), (5, "a b c d e")], "doc_id long, text string")).collect()
    assert sorted((r.id or 0, r.component or 0) for r in out) == [(0, 0), (5, 5), (5, 5)]
    assert sh.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize(("n", "radius"), [(10, 4), (10**6, 4), (10**10, 4), (10**5, 10), (10**8, 7)])
def test_any_plan_keeps_every_pair(n, radius):
    """Two fingerprints within the radius share a bucket in which one of them is at home."""
    rng = np.random.default_rng(5)
    sample = rng.integers(0, 2**63, 3000, dtype=np.int64).astype(np.uint64)
    parts = sh.plan(sample, n, radius)
    for _ in range(40):
        x = rng.integers(0, 2**63, 1, dtype=np.int64).astype(np.uint64)
        y = x.copy()
        for bit in rng.choice(64, radius, replace=False):
            y ^= np.uint64(1) << np.uint64(bit)
        assert any(np.bitwise_count(np.uint64(sh.part_values(x, p)[0] ^ sh.part_values(y, p)[0])) <= t for p, t in parts)
        made = []
        for fp in (x, y):
            batch = pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64)), pa.array([1]), pa.array([0]), pa.array([0])], names=["fp", "id", "n", "fp2"])
            made.append({(r["part"], r["key"]): r["home"] for b in sh._signatures(parts)(iter((batch,))) for r in b.to_pylist()})
        assert any(made[0][k] or made[1][k] for k in made[0].keys() & made[1].keys())


def test_rows_of_plans_at_scale():
    sample = np.random.default_rng(2).integers(0, 2**63, 3000, dtype=np.int64).astype(np.uint64)
    for n in (10**6, 10**8, 10**10):
        assert sum(sh.rows_for(len(p), t) for p, t in sh.plan(sample, n)) < 100


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similar(a, b):
    return len(a & b) >= 0.8 * len(a | b)


def jaccard_groups(rows, linked):
    label = {i: i for i, _ in rows}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, j in linked:
        a, b = find(i), find(j)
        label[max(a, b)] = min(a, b)
    return {i: find(i) for i, _ in rows}


@pytest.mark.parametrize("more", [{}, {"block": 7, "block_bytes": 4096}])
def test_verified_groups(spark, more):
    """Groups lie within the components of all pairs whose five-word shingles are similar, and hold nearly all such pairs."""
    rng = random.Random(8)
    base = [[f"t{rng.randrange(4000)}" for _ in range(rng.choice((30, 120, 300)))] for _ in range(12)]
    rows = [(1000, None), (1001, ""), (1003, "One two"), (1004, "one TWO"), (1006, "word " * 5000)]
    for i in range(200):
        words = list(rng.choice(base))
        for _ in range(rng.randrange(1 + len(words) // 40)):
            words[rng.randrange(len(words))] = "x%d" % rng.randrange(9999)
        rows.append((i * 3, " ".join(words)))
    got = {r.id: r.component for r in sh.similar_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), **more).collect()}
    made = [(i, shingles(t), sh.fingerprint(t, 5)) for i, t in rows]
    pairs = [(a, b) for k, a in enumerate(made) for b in made[:k] if similar(a[1], b[1])]
    sure = jaccard_groups(rows, [(a[0], b[0]) for a, b in pairs])
    assert all(sure[i] == sure[c] for i, c in got.items())  # no group joins texts that similar pairs don't join
    assert sum(got[a[0]] == got[b[0]] for a, b in pairs) >= 0.97 * len(pairs) > 500
