"""Repeated passages against brute force over all windows."""

import hashlib
import random
import re

from siftwell.llm import substring_dedup as sd

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window=20):
    docs = sorted((i, WORD.findall(t or "")) for i, t in rows)
    first = {}
    gone = {i: set() for i, _ in docs}
    for i, w in docs:
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            if key in first:
                gone[i].update(range(s, s + window))
            else:
                first[key] = (i, s)
    return {i: (len(w), len(gone[i]), " ".join(x for j, x in enumerate(w) if j not in gone[i])) for i, w in docs}


def got(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return {r.id: (r.n_words, r.n_removed, r.kept) for r in sd.remove_repeats(df, **more).collect()}


def corpus(n, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(12)] + ["é", "日本", "x" * 50]
    passages = [[rng.choice(words) for _ in range(rng.choice((20, 21, 33, 60)))] for _ in range(5)]
    rows = []
    for i in range(n):
        text = []
        for _ in range(rng.randrange(6)):
            text += rng.choice(passages) if rng.random() < 0.5 else [rng.choice(words) for _ in range(rng.randrange(40))]
        if text and rng.random() < 0.3:
            text[rng.randrange(len(text))] = "edit"
        rows.append((i, rng.choice((" ", "\n", "  \t")).join(text)))
    return rows


def test_matches_brute_force(spark):
    rows = corpus(60, 1) + [(100, None), (101, ""), (102, "same " * 300), (103, "same " * 30), (104, "a b c")]
    assert got(spark, rows) == brute(rows)


def test_other_window_sizes(spark):
    rows = corpus(25, 2)
    assert got(spark, rows, window=7, k=3) == brute(rows, 7)


def test_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    want = brute(rows)
    have = {r.id: (r.n_words, r.n_removed, r.kept) for r in sd.remove_repeats(df).collect()}
    assert have == want
    assert sum(x[1] for x in want.values()) > 1000


def test_edges(spark):
    text = " ".join(f"u{i}" for i in range(30))
    out = sd.remove_repeats(spark.createDataFrame([(1, text, 5), (1, text, 6), (None, text, 7)], "doc_id long, text string, id int"), carry=("id",)).collect()
    assert sorted(r.n_removed for r in out) == [0, 0, 0] and sorted(r.row.id for r in out) == [5, 6, 7] and out[0].text == text
    assert sd.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert hashlib.sha256(out[0].kept.encode()).hexdigest()


def balanced(n, a, b):
    """The words over two letters whose polynomials agree modulo 2**64 at any odd base, from 2**11 letters on."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join(a if x else b for x in bits), "".join(b if x else a for x in bits)


def test_no_structural_collisions(spark):
    """Words, and sequences of words, that collide under polynomials modulo 2**64 are told apart."""
    import numpy as np

    from siftwell.llm import decontaminate
    from siftwell.llm import words as tw

    one, two = balanced(4096, "a", "b")
    data = np.frombuffer(f"{one} {two}".encode(), np.uint8)
    starts, ends, _ = tw.spans(data, np.array([0, len(data)]))
    for seed in (0, 1):
        assert len(set(tw.sound_words(data, starts, ends, seed).tolist())) == 2
    offs = np.array([0, len(data)])
    assert len(set(decontaminate.word_ids(offs, data)[0].tolist())) == 2
    filler = [f"w{i}" for i in range(15)]
    rows = [(i + 1, " ".join([*filler, word, *filler])) for i, word in enumerate((one, two))]
    assert got(spark, rows) == brute(rows)
    assert [got(spark, rows)[i][1] for i in (1, 2)] == [0, 0]
    first, second = balanced(2048, "left ", "right ")
    rows = [(1, first), (2, second)]
    assert got(spark, rows, window=2048) == brute(rows, 2048)


def test_sound_hashes_move_with_their_spans():
    import numpy as np

    from siftwell.llm import words as tw

    rng = np.random.default_rng(3)
    values = rng.integers(0, 2**63, 300, dtype=np.int64).astype(np.uint64)
    values[200:250] = values[17:67]
    h = tw.sound_hash(values, np.array([17, 200, 17, 18, 0]), np.array([67, 250, 66, 67, 0]), 1)
    assert h[0] == h[1] and len(set(h.tolist())) == 4
    big = np.full(1 << 17, 2**64 - 1, np.uint64)  # largest values
    p = int(tw.PRIME)
    low, high = p, 2**31 - 1
    want = [sum(v * pow(b, i, p) for i in range(1 << 17)) % p for v, b in zip((low, high), tw._SOUND[0])]
    assert want == [0, 0] and tw.sound_hash(big, np.array([0]), np.array([1 << 17]))[0] == tw.sound_hash(np.zeros(1 << 17, np.uint64), np.array([0]), np.array([1 << 17]))[0]
