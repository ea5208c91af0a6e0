"""Operator 4: quality scores from preference pairs (Bradley-Terry).

Features of a whole text: shares of kinds of characters, word lengths, shares of distinct words, of distinct runs of three words
and of distinct lines, repeats of neighbours, words that end in symbols. The model is linear in the features and their hinges;
its weights maximise the likelihood that the better document of each pair (one labelled 1, one labelled 0) scores higher, a
logistic loss on feature differences. Every labelled training row takes part: rows are put into buckets of about ``linear.BUCKET`` by a hash
of the id, and the pairs are all those of a bucket (rows of a rare label are in several buckets, so that none is without pairs). Gradient and
curvature of the pairs are sums over rows, so no pair is formed; tasks send sums to the driver, which makes Newton's steps. Means, spreads and
the hinges' knots (on a grid of 1 / ``GRID`` standard deviations) are counted over all rows too. The cut lies between the two neighbouring scores
of training rows where the weight below goes beyond the share of label 0 among labelled rows; scores are shifted so that the cut is 0.3 of 1.

Defined results: null and empty texts get the features of an empty text; without pairs every score is 0.5. Each row of an id that repeats counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm import linear
from siftwell.llm import words as tw

PAIRS, CUT = 30_000, 0.3
#: The weights' penalty for each ``PAIRS`` pairs; cells of a standard deviation, standard deviations on either side of the mean; cells of scores.
RIDGE, GRID, REACH, CELLS = 3.0, 64, 6, 4096
KNOTS = (0.05, 0.25, 0.5, 0.75, 0.95)
_KIND = np.zeros(256, np.int64)
_NAMES = ("upper", "lower", "digit", "space", "newline", "stop", "bang", "mark", "hash", "pipe", "quote", "other", "high")
for _i, _bytes in enumerate(
    (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t", b"\n\r", b".,;:", b"!?", b"*&%$", b"#@", b"|<>{}[]\\/", b"'\"", b"", bytes(range(128, 256)))
):
    _KIND[list(_bytes)] = _i
_KIND[[b for b in range(128) if _KIND[b] == 0 and not 65 <= b <= 90]] = 11
_LINES = np.zeros(256, bool)
_LINES[[10, 13]] = True


def _distinct(rows: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """Distinct hashes of each row."""
    key = tw.mix(hashes + rows.astype(np.uint64) * np.uint64(tw.ODD))
    return np.bincount(rows[np.unique(key, return_index=True)[1]], minlength=n).astype(np.float64)


def features(offs: np.ndarray, data: np.ndarray) -> np.ndarray:
    n, kinds = len(offs) - 1, len(_NAMES)
    low, high = int(offs[0]), int(offs[-1])
    size = np.diff(offs)
    kind = np.zeros((n, kinds), np.int64)
    for a in range(low, high, tw.PIECE):
        b = min(high, a + tw.PIECE)
        rows = np.searchsorted(offs, np.arange(a, b), side="right") - 1 if n > 1 else np.zeros(b - a, np.int64)
        kind += np.bincount(rows * kinds + _KIND[data[a:b]], minlength=n * kinds).reshape(n, kinds)
    starts, ends, rows = tw.spans(data, offs)
    words = np.bincount(rows, minlength=n).astype(np.float64)
    some = np.maximum(words, 1)
    hashes = tw.word_hashes(data, starts, ends)
    length = (ends - starts).astype(np.float64)
    mean = np.bincount(rows, length, n) / some
    longest = np.zeros(n)
    np.maximum.at(longest, rows, length)
    with_symbol = np.isin(_KIND[data[ends - 1]], (6, 7, 8, 9, 11)) if len(ends) else np.zeros(0, bool)
    same = np.zeros(len(rows), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (rows[1:] == rows[:-1])
    three = tw.grams(hashes, 3)
    whole = rows[: len(three)] == rows[2:] if len(three) else np.zeros(0, bool)
    triples = np.bincount(rows[: len(three)][whole], minlength=n)
    line_starts, line_ends, line_rows = tw.spans(data, offs, _LINES)
    lines = np.bincount(line_rows, minlength=n)
    line_hash = tw.word_hashes(data, line_starts, line_ends)
    letters = np.maximum(kind[:, 0] + kind[:, 1], 1)
    return np.column_stack(
        [
            kind / np.maximum(size, 1)[:, None],
            kind[:, 0] / letters,
            np.log1p(words),
            mean,
            np.log1p(longest),
            _distinct(rows, hashes, n) / np.sqrt(some),
            _distinct(rows, hashes, n) / some,
            _distinct(rows[: len(three)][whole], three[whole], n) / np.maximum(triples, 1),
            np.bincount(rows[same], minlength=n) / some,
            np.bincount(rows[with_symbol], minlength=n) / some,
            _distinct(line_rows, line_hash, n) / np.maximum(lines, 1),
            lines / some,
        ]
    )


def fit(x: np.ndarray, y: np.ndarray, share: float, pairs: int = PAIRS, seed: int = 11) -> linear.Scaled | None:
    """Weights by pairs and the shift that puts the quantile ``share`` of the sample's scores (weighted back to it) at the cut."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return None
    rng = np.random.default_rng(seed)
    model = linear.Scaled.of(x)
    z = model.expand(x)
    apart = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    model.weights = linear.newton(apart, np.ones(pairs), ridge=3.0)
    score = z @ model.weights
    weight = np.where(y == 1, (1 - share) / len(good), share / len(bad))
    order = np.argsort(score)
    at = min(len(order) - 1, int(np.searchsorted(np.cumsum(weight[order]), share)))
    cut = (score[order[at]] + score[order[max(0, at - 1)]]) / 2
    model.shift = float(np.log(CUT / (1 - CUT)) - cut)
    return model


def _scaled(rows: linear.Buckets) -> linear.Scaled | None:
    """Means, spreads and knots of all rows."""
    weights = (1 / rows.copies[1], 1 / rows.copies[0])
    sides = lambda step: lambda *own: sum(w * step(x) for x, w in zip(own, weights, strict=True) if len(x))
    first = rows.each(sides(lambda x: np.append(x.sum(axis=0), len(x))))
    if first is None:
        return None
    n, mean = first[-1], first[:-1] / first[-1]
    spread = np.sqrt(rows.each(sides(lambda x: ((x - mean) ** 2).sum(axis=0))) / n)
    model, width = linear.Scaled(mean, np.where(spread > 1e-12, spread, 1.0), np.zeros((0, len(mean)))), 2 * REACH * GRID + 1

    def cells(x: np.ndarray) -> np.ndarray:
        at = np.rint((model.plain(x) + REACH) * GRID).astype(np.int64) + np.arange(len(mean)) * width
        return np.bincount(at.ravel(), minlength=len(mean) * width).astype(np.float64)

    counts = np.cumsum(rows.each(sides(cells)).reshape(len(mean), width), axis=1)
    model.knots = np.array([(counts < q * n - 1e-6).sum(axis=1) / GRID - REACH for q in KNOTS])
    return model


def _pair_sums(model: linear.Scaled, w: np.ndarray):
    """Loss, number, gradient and curvature of all pairs of a bucket, as one row."""

    def step(good: np.ndarray, bad: np.ndarray) -> np.ndarray:
        d = len(w)
        if not len(good) or not len(bad):
            return np.zeros(2 + d + d * d)
        a, b = model.expand(good), model.expand(bad)
        loss, grad, curve = 0.0, np.zeros(d), np.zeros((d, d))
        high, low = a @ w, b @ w
        for k in range(0, len(a), 256):
            part = a[k : k + 256]
            for j in range(0, len(b), 4096):
                other = b[j : j + 4096]
                apart = high[k : k + 256, None] - low[None, j : j + 4096]
                p = linear.sigmoid(apart)
                q = p * (1 - p)
                loss += np.logaddexp(0, -apart).sum()
                grad += (p - 1).sum(axis=1) @ part - (p - 1).sum(axis=0) @ other
                across = part.T @ (q @ other)
                curve += (part * q.sum(axis=1)[:, None]).T @ part + (other * q.sum(axis=0)[:, None]).T @ other - across - across.T
        return np.concatenate([[loss, len(a) * len(b)], grad, curve.ravel()])

    return step


def _cut(rows: linear.Buckets, model: linear.Scaled, share: float) -> float:
    """Halfway between the neighbouring scores of all rows where the weight below goes beyond ``share``."""
    low, high = (s * (1 + 2 * REACH * np.abs(model.weights).sum()) for s in (-1, 1))
    for _ in range(4):  # each narrows the place by CELLS

        def counts(good: np.ndarray, bad: np.ndarray, low: float = low, high: float = high) -> np.ndarray:
            cell = [np.clip(np.floor((model.score(x) - low) / (high - low) * CELLS), -1, CELLS).astype(np.int64) + 1 if len(x) else np.zeros(0, np.int64) for x in (bad, good)]
            return np.concatenate([np.bincount(c, minlength=CELLS + 2) for c in cell]).astype(np.float64)

        own = rows.each(counts).reshape(2, -1)
        total = own.sum(axis=1)
        below = np.cumsum(own, axis=1) * (np.array([share, 1 - share]) / total)[:, None]
        at = int(np.searchsorted(below.sum(axis=0), share * (1 + 1e-9), side="right"))
        if not 1 <= at <= CELLS:
            break
        step = (high - low) / CELLS
        low, high = low + (at - 1) * step, low + at * step
        if not low < high:
            break

    def around(good: np.ndarray, bad: np.ndarray) -> np.ndarray:
        s = np.concatenate([model.score(x) for x in (good, bad) if len(x)])
        return np.array([-s[s < low].max(initial=-np.inf), s[s >= low].min(initial=np.inf)])

    before, after = rows.each(around, np.minimum)
    before = -before
    ends = [v for v in (before, after) if np.isfinite(v)]
    return float(np.mean(ends))


def fit_all(rows: linear.Buckets, share: float, steps: int = 40) -> linear.Scaled | None:
    """``fit`` over all rows: the same loss for each ``PAIRS`` pairs, minimised by Newton's method with halved steps."""
    model = _scaled(rows)
    if model is None:
        return None
    d = model.expand(model.mean[None]).shape[1]

    def at(w: np.ndarray):
        got = rows.each(_pair_sums(model, w))
        loss, grad, curve = got[0], got[2 : 2 + d], got[2 + d :].reshape(d, d)
        each = PAIRS / max(1, got[1])
        return loss * each + RIDGE / 2 * (w @ w), grad * each + RIDGE * w, curve * each + RIDGE * np.eye(d), got[1]

    w = np.zeros(d)
    now, grad, curve, pairs = at(w)
    if not pairs:
        return None
    for _ in range(steps):
        step, size = np.linalg.solve(curve, grad), 1.0
        after = at(w - step)
        while after[0] > now and size > 1e-4:
            size /= 2
            after = at(w - size * step)
        if after[0] > now:
            break
        w, before = w - size * step, now
        now, grad, curve, _ = after
        if before - now < 1e-7 * max(1.0, before):
            break
    model.weights = w
    model.shift = float(np.log(CUT / (1 - CUT)) - _cut(rows, model, share))
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held: int = 0) -> linear.Scaled | None:
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where(F.crc32(F.col("id").cast("string")) % folds != held)
    rows = linear.buckets(linear.feature_rows(texts, features), linear.training_labels(labels, label, id_col, folds, held))
    usable = labels.where(F.col(label).isin(0, 1) & (F.crc32(F.col(id_col).cast("string")) % folds != held))
    return fit_all(rows, usable.agg(F.avg((F.col(label) == 0).cast("double"))).first()[0]) if rows else None


def score(docs: DataFrame, model: linear.Scaled | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offs, data = tw.buffers(batch.column(1))
            own = [linear.sigmoid(shared.value.score(features(offs[a : b + 1], data))) if shared.value else np.full(b - a, 0.5) for a, b in tw.pieces(offs)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate([np.zeros(0), *own]))], names=["id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, score double")
