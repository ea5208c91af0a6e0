"""Greedy batches against the plain loop."""

import random

import numpy as np
import pytest

from siftwell.operators import batches


def plain(sizes, most, limit):
    out, n, size, number = [], 0, 0, -1
    for s in sizes:
        if number < 0 or n >= most or size + s > limit:
            number, n, size = number + 1, 0, 0
        n, size = n + 1, size + s
        out.append(number)
    return out


@pytest.mark.parametrize("most, limit, block", [(3, 50, 8), (8, 1000, 8), (1, 10, 5), (5, 0, 16), (40, 200, 4096)])
def test_as_the_loop(spark, most, limit, block):
    rng = random.Random(most * limit + block)
    groups = {g: [rng.choice([0, 0, 1, 5, rng.randint(0, 60), limit + 1 if rng.random() < 0.1 else 3]) for _ in range(n)] for g, n in (("a", 700), ("b", 1), (None, 33), ("c", block), ("d", block + 1))}
    rows = [(g, i * 3, s) for g, sizes in groups.items() for i, s in enumerate(sizes)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, k long, before long").repartition(4)
    got = batches.greedy_batches(df, "g", ["k"], "before", most, limit, block=block).collect()
    want = sorted((repr(g), i * 3, b) for g, sizes in groups.items() for i, b in enumerate(plain(sizes, most, limit)))
    assert sorted((repr(r.g), r.k, r.batch) for r in got) == want


def test_edges(spark):
    assert batches.greedy_batches(spark.createDataFrame([], "g long, k long, s long"), "g", ["k"], "s", 2, 5).collect() == []
    null_sizes = spark.createDataFrame([(1, 1, None), (1, 2, 9), (1, 3, None)], "g long, k long, s long")
    assert sorted((r.k, r.batch) for r in batches.greedy_batches(null_sizes, "g", ["k"], "s", 5, 5).collect()) == [(1, 0), (2, 1), (3, 2)]
    with pytest.raises(ValueError, match="positive"):
        batches.greedy_batches(null_sizes, "g", ["k"], "s", 0, 5)


def test_a_group_is_many_blocks():
    """Pointers lead into the next block at most, and jumping follows them to its end."""
    sizes = np.random.default_rng(1).integers(0, 9, 3000)
    before = np.cumsum(sizes) - sizes
    follow = batches.successors(before, sizes, 7, 20)
    assert (follow - np.arange(3000) <= 7).all() and (follow > np.arange(3000)).all()
    to, count = batches.jumps(follow, 2000, 7)
    for entry in range(7):
        i, n = entry, 0
        while i < 2000:
            i, n = follow[i], n + 1
        assert (to[entry], count[entry]) == (i, n)
