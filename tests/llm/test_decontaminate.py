"""Leaks: planted passages are found, alignment equals a plain one, clean documents stay."""

import random

import numpy as np

from siftwell.llm import decontaminate as de


def plain_align(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    best = 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
            best = max(best, h[i][j])
    return best


def full_score(item, words):
    """The whole text aligned, without any seed."""
    number = {w: i for i, w in enumerate(dict.fromkeys([*item, *words]))}
    return de.align(*(np.array([number[w] for w in x], np.uint64) for x in (item, words)))[0]


def test_alignment():
    rng = random.Random(4)
    for _ in range(60):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(1, 25))] for _ in range(2))
        assert de.align(np.array(a, np.uint64), np.array(b, np.uint64))[0] == plain_align(a, b)


def corpus(seed=5):
    rng = random.Random(seed)
    common, rare = [f"c{i}" for i in range(15)], [f"r{i}" for i in range(3000)]
    sentence = lambda n: [rng.choice(common if rng.random() < 0.5 else rare) for _ in range(n)]
    items = {i: sentence(rng.randrange(20, 50)) for i in range(12)}
    docs, want = {}, set()
    for d in range(200):
        words = sentence(rng.randrange(300))
        if d % 4 == 0:
            i = rng.randrange(12)
            part = list(items[i])
            for _ in range(len(part) // 10):
                part[rng.randrange(len(part))] = "edit"
            words[len(words) // 2 : len(words) // 2] = part
            want.add((d, i))
        docs[d] = words
    for d in range(1000, 1100):  # one passage in a third of the rows
        docs[d] = sentence(20) + items[3]
        want.add((d, 3))
    return items, docs, want


def test_planted(spark):
    items, docs, want = corpus()
    bench = spark.createDataFrame([(i, " ".join(w).upper()) for i, w in items.items()], "item_id long, text string")
    rows = [(d, ", ".join(w)) for d, w in docs.items()] + [(5000, None), (5001, ""), (None, " ".join(items[0])), (5002, "z " * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {(r.id, r.item): r.score for r in de.leaks(df, bench).collect()}
    # any pair whose whole alignment reaches the threshold, by brute force
    brute = set()
    for d, w in docs.items():
        for i, item in items.items():
            if full_score(item, w) >= de.THRESHOLD * 2 * len(item):
                brute.add((d, i))
    assert want <= brute and set(got) == brute
    assert got == {(r.id, r.item): r.score for r in de.leaks(df, bench, broadcast_limit=0).collect()}


def test_edges(spark):
    items, docs, _ = corpus()
    bench = spark.createDataFrame([(1, None, 1), (2, "", 1), (None, "a b c d", 1), (3, "a b", 1), (4, "a b c", 1), (4, "a b c", 1)], "item_id long, text string, id int")
    df = spark.createDataFrame([(7, "x a b c y", 1), (7, "x a b c y", 1), (8, None, 1)], "doc_id long, text string, item int")
    assert sorted((r.id, r.item, r.score) for r in de.leaks(df, bench).collect()) == [(7, 4, 1.0), (7, 4, 1.0)]
    assert de.leaks(df.where("false"), bench).count() == 0 and de.leaks(df, bench.where("false")).count() == 0


def test_edited_beside_exact_copies(spark):
    """Copies with a fifth to three tenths of the words changed, of items that stand in the corpus unchanged too; all pairs aligned."""
    rng = random.Random(8)
    common, rare = [f"c{i}" for i in range(15)], [f"r{i}" for i in range(3000)]
    sentence = lambda n: [rng.choice(common if rng.random() < 0.3 else rare) for _ in range(n)]
    items = {i: sentence(30) for i in range(8)}
    docs, want = {}, set()
    for d in range(120):
        i, part, kind = d % 8, list(items[d % 8]), d // 8 % 5
        if kind == 1:  # every 4th word
            part[3::4] = [f"x{d}y{k}" for k in range(len(part[3::4]))]
        elif kind == 2:
            for k in rng.sample(range(30), rng.randrange(6, 10)):
                part[k] = f"x{d}y{k}"
        elif kind == 3:  # one run in common, words put in between the others
            part = part[:3] + [w for k, p in enumerate(part[3:]) for w in ([p, f"x{d}y{k}"] if k % 2 else [p])]
        elif kind == 4:
            part = sentence(30)
        docs[d] = sentence(rng.randrange(40)) + part + sentence(rng.randrange(40))
        want |= {(d, i)} if kind < 4 else set()
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in docs.items()], "doc_id long, text string").repartition(3)
    brute = {(d, i): s / (2 * len(item)) for d, w in docs.items() for i, item in items.items() if (s := plain_align(item, w)) >= de.THRESHOLD * 2 * len(item)}
    got = [(r.id, r.item, r.score, r.seeds, r.low, r.end) for r in de.leaks(df, bench).collect()]
    assert want <= set(brute) and {(d, i): s for d, i, s, *_ in got} == brute
    assert sorted(got) == sorted(tuple(r) for r in de.leaks(df, bench, broadcast_limit=0).collect())


def test_index():
    """One row a run and item, with the run's places; an item may repeat a run."""
    words = [np.array(w, np.uint64) for w in ([1] * 9, [1, 1, 1, 2, 3], [4, 5, 6])]
    x = de.index(np.arange(3), words, 3)
    assert [len(w) - 2 for w in words] == [int(x.count[x.item == i].sum()) for i in range(3)]
    assert (x.first[x.item == 0], x.last[x.item == 0]) == ([0], [6])


def test_recall_of_seeds(spark):
    """Of all pairs that reach the threshold when whole texts are aligned without seeds, at least nine in ten are found."""
    rng = random.Random(21)
    words = [f"w{i}" for i in range(2000)]
    items = {i: [rng.choice(words) for _ in range(rng.randrange(15, 60))] for i in range(20)}
    docs = {}
    for d in range(400):
        part = list(items[d % 20])
        for k in rng.sample(range(len(part)), int(len(part) * rng.uniform(0, 0.36))):
            part[k] = rng.choice(words) if rng.random() < 0.7 else f"{part[k]} {rng.choice(words)}"
        docs[d] = [rng.choice(words) for _ in range(20)] + " ".join(part).split() + [rng.choice(words) for _ in range(20)]
    brute = {(d, i) for d, w in docs.items() for i, item in items.items() if full_score(item, w) >= de.THRESHOLD * 2 * len(item)}
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    got = {(r.id, r.item) for r in de.leaks(spark.createDataFrame([(d, " ".join(w)) for d, w in docs.items()], "doc_id long, text string"), bench).collect()}
    recall = len(got & brute) / len(brute)
    print("recall against whole alignment", recall, len(brute))
    assert got <= brute and len(brute) > 250 and recall >= 0.9
