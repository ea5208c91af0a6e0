"""Operator 11 against plain loops over words and their single edits."""

import collections
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from siftwell.llm import queries, spelling

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, least=6, occurrences=5, every=199):
    seen = collections.Counter()
    for d, t in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(FOLD)
            if d is not None and (h := zlib.crc32(f"{d}:{w}".encode())) % every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            seen[w] += 1
    v = {w: n for w, n in seen.items() if len(w) >= least and n >= occurrences}
    wild, near = collections.defaultdict(list), {w: set() for w in v}
    for w in v:
        for i in range(len(w)):
            wild[w[:i] + "\0" + w[i + 1 :]].append(w)
    for w in v:
        for i in range(len(w)):
            near[w].update(wild[w[:i] + "\0" + w[i + 1 :]])
            if (s := w[:i] + w[i + 1 :]) in v:
                near[w].add(s)
                near[s].add(w)
        near[w].discard(w)
    form = {}
    for w, n in v.items():
        best = min(near[w], key=lambda x: (-v[x], x), default=None)
        form[w] = best if best is not None and v[best] >= 5 * n else None

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted(((w, form[w], root(w), n, len(near[w]), v[form[w]] if form[w] else None) for w, n in v.items()), key=repr)


def found(spark, docs, **more):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    return sorted(map(tuple, spelling.group_variants(df, **more).collect()), key=repr)


def test_query_on_its_table(spark):
    folder = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, queries.op11_spelling_variants(spark, folder).collect()), key=repr) == brute(docs)


def test_dense_neighbourhoods(spark):
    """Few letters, so that many words are near in several ways; equal letters in a row; chains of forms."""
    rng = random.Random(3)
    docs = []
    for d in range(40):
        words = ["".join(rng.choice("aabé") for _ in range(rng.randint(5, 8))) for _ in range(300)]
        words += ["colour"] * 30 + ["color"] * 9 + ["colours"] * rng.randint(1, 4) + ["Coloures"] * (d % 4 == 0) + ["ÀCCENT", "Àccent"]
        docs.append((d if d else None, " ".join(words) + " end."))
    docs += docs[:2]
    for every in (199, 7):
        got = found(spark, docs, every=every)
        assert got == brute(docs, every=every)
    assert any(r[1] and r[2] != r[1] for r in got)


def test_edges(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, None), (2, ""), (None, "123 short words only")]) == []
    long = "a" * 60_000  # rests of equal letters are one rest
    other = "ab" * 30_000
    docs = [(i, f"{long} {other} {other[:100]}x{other[101:]} {long}a") for i in range(5)] + [(9, f"{long}\n" * 30)]
    got = {r[0]: r[1:] for r in found(spark, docs, every=1 << 40)}
    assert len(got) == 4 and got[long + "a"] == (long, long, 5, 1, 35) and got[long][3] == 1 and got[other][3] == 1
    clash = spark.createDataFrame([(1, "colours " * 5, "x", 2)], "doc_id long, text string, word string, n long")
    assert [tuple(r) for r in spelling.group_variants(clash, every=1 << 40).collect()] == [("colours", None, "colours", 5, 0, None)]


def test_keys_and_collisions():
    words = ["abcdef", "abcdf", "abccdef", "ébcdef"]
    row, place, key = spelling.rest_keys(words)
    rest = [words[r] if p < 0 else words[r][: p >> 1] + words[r][(p >> 1) + 1 :] for r, p in zip(row, place)]
    same = collections.defaultdict(set)
    for k, s in zip(key.tolist(), rest, strict=True):
        same[k].add(s)
    assert all(len(s) == 1 for s in same.values()) and len(same) == len(set(rest))
    assert [words[r] for r, p in zip(row, place) if p >= 0 and p & 1] == ["abccdef"]
    # other words under the same key and place are told apart
    at, near, other = spelling.near_of(np.zeros(4, np.int64), np.array([2, 2, 2, 2]), ["axcdef", "aycdef", "bxcdef", "zzzzzz"], np.array([5, 9, 7, 6]))
    assert sorted(zip(at.tolist(), near.tolist(), other.tolist())) == [(0, 1, 1), (1, 1, 0)]


@pytest.mark.parametrize("step", [1, 2, 3, 100])
def test_groups_across_batches(step):
    rows = pa.RecordBatch.from_pydict({"key": [1, 1, 1, 2, 3, 3, 4], "place": [0, 0, 2, 0, -1, 0, 0], "id": range(7), "n": range(7)})
    parts = [rows.slice(i, step) for i in range(0, 7, step)]
    assert [i for b in spelling._meet(iter(parts)) for i in b["id"].to_pylist()] == [0, 1, 4, 5]
