"""Neighbours against brute force: recall and exact scores at several sizes, with and without structure."""

import numpy as np
import pytest

from siftwell.llm import ann, queries


def brute(rows, asked, k):
    good = {}
    for i, v in rows:
        if i is not None and v is not None and None not in v and np.isfinite(v).all() and any(v):
            good[i] = np.array(v, np.float64)
    out = {}
    for q in asked:
        if q in good:
            s = sorted((-(good[q] * v).sum(), i) for i, v in good.items() if i != q)[:k]
            out[q] = [(i, -x) for x, i in s]
    return out


def test_small_table(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(150)]
    rows += [(200 + i, rows[3][1]) for i in range(40)]  # copies
    rows += [(300, None), (301, [0.0] * 8), (302, [float("nan")] * 8), (303, [1.0] * 7 + [None]), (304, [float("inf")] * 8), (305, [1.0, 2.0]), (None, rows[0][1]), (5, rows[5][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = ann.search(df, df.where("vec_id % 5 = 0 or vec_id is null"), k=6).collect()
    want = brute([r for r in rows if r[0] != 305], [r[0] for r in rows if r[0] is not None and r[0] % 5 == 0 and r[0] != 305], 6)
    have = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        have.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert len(have[r.query_id]) == r["rank"]
    assert have.keys() == want.keys() and all(len(have[q]) == 6 for q in want)
    score = {q: dict(v) for q, v in brute([r for r in rows if r[0] != 305], list(want), 1000).items()}
    for q, found in have.items():  # exact scores, best first, ties to the smaller id
        assert all(np.isclose(s, score[q][i]) for i, s in found) and found == sorted(found, key=lambda f: (-f[1], f[0]))
    assert sum(len({i for i, _ in have[q]} & {i for i, _ in want[q]}) for q in want) >= 0.95 * 6 * len(want)


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], 9), (20, [0.5, 1.0], 9)], "vec_id long, embedding array<double>, query_id int")
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in ann.search(df, df).orderBy("query_id").collect()] == [(0, 1, 20, 0.5), (20, 1, 0, 0.5)]
    assert ann.search(df.where("false"), df).count() == 0


def recall(spark, folder, k=20):
    df = spark.read.parquet(f"{folder}/embeddings.parquet")
    rows = df.orderBy("vec_id").collect()
    ids = np.array([r.vec_id for r in rows])
    x = np.array([r.embedding for r in rows], np.float64)
    got = {}
    for r in queries.op1_ann(spark, folder).collect():
        got.setdefault(r.query_id, {})[r.vec_id] = r.score
    hits = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        s[q] = -np.inf
        best = ids[np.argsort(-s, kind="stable")[:k]]
        hits += len(set(best.tolist()) & got[ids[q]].keys())
        total += k
        for i, v in list(got[ids[q]].items())[:3]:
            assert abs(v - float(x[np.searchsorted(ids, i)] @ x[q])) < 1e-12
    return hits / total


def test_recall_on_tables(spark):
    for folder in ("sf0.01", "sf0.1"):
        assert recall(spark, f"/root/testdata/{folder}") >= 0.95


@pytest.mark.parametrize("n", [500, 1000, 10_000, 50_000])
def test_clustered_vectors(n):
    """The forest as tasks use it, on clustered vectors of unequal norms: recall, and products looked at against all of them."""
    rng = np.random.default_rng(n)
    centres = rng.normal(size=(max(8, n // 200), 32))
    x = (centres[rng.integers(0, len(centres), n)] + rng.normal(size=(n, 32)) * 0.25) * rng.uniform(0.8, 1.2, (n, 1))
    sample = x[rng.permutation(n)[: ann.SAMPLE]]
    depth = max(6, int(np.ceil(np.log2(n / ann.BLOCK))))
    forest = ann.fit(sample, float(np.linalg.norm(x, axis=1).max()), depth, 20)
    cells = forest.leaves(x)
    sizes = np.bincount(cells.ravel(), minlength=len(forest.cuts) << depth)
    asked = np.arange(0, n, max(20, n // 200))
    rows, found = forest.search(x[asked], sizes, 21)
    hits = products = 0
    for r, q in enumerate(asked):
        own = found[rows == r]
        products += sizes[own].sum()
        met = np.isin(cells, own).any(axis=1)
        s = x @ x[q]
        s[q] = -np.inf
        hits += met[np.argpartition(-s, 20)[:20]].sum()
    assert hits / (20 * len(asked)) >= 0.95 and products / len(asked) < n / 2, (hits / (20 * len(asked)), products / len(asked) / n)


def test_extreme_components(spark):
    """Norms that overflow when squared, denormal ones, and sums in which large parts cancel."""
    rows = [(0, [1e200, 1e200]), (1, [1e200, -1e200]), (2, [1e-310, 0.0]), (3, [3e199, 1.0]), (4, [1.0, 1.0]), (5, [1e16, 1.0]), (6, [1e16, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(df, df.where("vec_id in (2, 4)"), k=6).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got[4][:4] == [0, 3, 6, 5] or set(got[4][:2]) == {0, 3}
    assert {k: sorted(v) for k, v in got.items()} == {2: [0, 1, 3, 4, 5, 6], 4: [0, 1, 2, 3, 5, 6]}


@pytest.mark.parametrize("n", [500, 5000, 20_000])
def test_products_of_vectors_without_structure(n):
    """Nearly all leaves are needed then, but no more products than brute force."""
    x = np.random.default_rng(n).normal(size=(n, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    depth = max(6, int(np.ceil(np.log2(n / ann.BLOCK))))
    forest = ann.fit(x[: ann.SAMPLE], 1.0, depth, 20)
    sizes = np.bincount(forest.leaves(x).ravel(), minlength=len(forest.cuts) << depth)
    rows, found = forest.search(x[:100], sizes, 21)
    assert sizes[found].sum() <= n * 100, sizes[found].sum() / n / 100


def test_shelves():
    """Neighbouring leaves of one tree up to the limit; a larger leaf stands alone."""
    assert ann.shelves(np.array([3, 3, 3, 0, 9, 1, 0, 0]), 2, 6).tolist() == [0, 0, 1, 1, 2, 3, 3, 3]


@pytest.mark.parametrize("trees", [1, 8])
def test_all_leaves_give_brute_force(spark, monkeypatch, trees):
    """Ties, copies, repeated rows and shelves of several blocks, with every leaf taken; what several trees find counts once."""

    def whole(*args):
        forest = fit(*args)
        return ann.Forest(*(np.concatenate([a] * trees)[:trees] for a in (forest.normals, forest.cuts)), forest.depth, forest.norm, trees << forest.depth)

    fit = ann.fit
    for name, value in {"fit": whole, "SHELF": 40, "QUERY_BLOCK": 16}.items():
        monkeypatch.setattr(ann, name, value)
    rng = np.random.default_rng(4)
    rows = [(i, [float(v) for v in rng.integers(-2, 3, 4)]) for i in range(600)]
    rows += [(600 + i, rows[7][1]) for i in range(50)]  # copies
    df = spark.createDataFrame(rows + rows[:40], "vec_id long, embedding array<float>").repartition(3)
    want = brute(rows, range(0, 650, 5), 6)
    have = {}
    for r in sorted(ann.search(df, df.where("vec_id % 5 = 0"), k=6).collect(), key=lambda r: (r.query_id, r["rank"])):
        have.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert len(have[r.query_id]) == r["rank"]
    assert have == want
