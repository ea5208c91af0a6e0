"""Operator 8: language of a text by a byte convolutional network in numpy.

A text is cut into windows of ``LENGTH`` bytes (the last one padded; each sees the first bytes of the next). Filters of widths 2,
3 and 4 run over the bytes, each filter's largest response in a window is kept, and a softmax layer gives the window's languages.
A filter on one-hot bytes is a sum of table rows, so inference looks up byte pairs. A text's distribution is the mean of its
windows', weighed by their letters, and every window of the whole text counts.

The network is trained with Adam on the driver, on a bounded sample: ``PER_LANGUAGE`` texts of each language (fewer where all would be over
``ROWS``), ``PER_TEXT`` windows of each. Weights are a few hundred kB and go to the tasks as a broadcast.

Defined results: ``und`` with score 0 if the text is null or has no letter, or if nothing could be learned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwell.llm import words as tw

WIDTHS, FILTERS, LENGTH = (2, 3, 4), 12, 128
#: Texts learned from, of each language and of all, and windows of each.
PER_LANGUAGE, ROWS, PER_TEXT = 800, 100_000, 4
_LETTER = regex.compile(r"\p{L}")
_COUNTS = np.zeros(256, bool)
_COUNTS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


@dataclass
class Network:
    languages: list[str]
    filters: list[np.ndarray]  # by width: offset, byte, filter
    bias: np.ndarray
    dense: np.ndarray
    shift: np.ndarray

    def compiled(self) -> list[tuple[np.ndarray, ...]]:
        """Per width, tables by byte pair (first * 256 + second) or, for the odd last byte, by byte."""
        out = []
        for f in self.filters:
            tables = [(f[j][:, None, :] + f[j + 1][None, :, :]).reshape(65536, -1).astype(np.float32) for j in range(0, len(f) - 1, 2)]
            out.append((*tables, f[-1].astype(np.float32)) if len(f) % 2 else tuple(tables))
        return out

    def pooled(self, windows: np.ndarray, tables: list[tuple[np.ndarray, ...]]) -> np.ndarray:
        """Largest responses; windows are rows of LENGTH + 3 bytes."""
        n = windows.shape[1] - max(WIDTHS) + 1
        pairs = windows[:, :-1].astype(np.int64) * 256 + windows[:, 1:]
        out = []
        for width, own in zip(WIDTHS, tables, strict=True):
            total = own[0][pairs[:, :n]]
            for k, t in enumerate(own[1:], 1):
                total += t[pairs[:, 2 * k : 2 * k + n]] if t.shape[0] == 65536 else t[windows[:, width - 1 : width - 1 + n]]
            out.append(total.max(axis=1))
        return np.concatenate(out, axis=1)

    def predict(self, windows: np.ndarray, tables: list[tuple[np.ndarray, ...]]) -> np.ndarray:
        return softmax(np.tanh(self.pooled(windows, tables) + self.bias) @ self.dense + self.shift)


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def cut(text: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Windows of the bytes of a text."""
    n = max(1, -(-len(text) // length))
    padded = np.zeros(n * length + max(WIDTHS) - 1, np.uint8)
    padded[: len(text)] = text
    return np.lib.stride_tricks.sliding_window_view(padded, length + max(WIDTHS) - 1)[::length]


def gradients(net: Network, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross entropy of windows x with languages y, and its gradients: filters by width, bias, dense layer, shift."""
    n = x.shape[1] - max(WIDTHS) + 1
    rows = np.arange(len(x))[:, None]
    best, at = [], []
    for w, f in zip(WIDTHS, net.filters, strict=True):
        response = sum(f[j][x[:, j : j + n]] for j in range(w))
        at.append(response.argmax(axis=1))
        best.append(np.take_along_axis(response, at[-1][:, None, :], axis=1)[:, 0])
    hidden = np.tanh(np.concatenate(best, axis=1) + net.bias)
    p = softmax(hidden @ net.dense + net.shift)
    loss = float(-np.log(p[np.arange(len(x)), y] + 1e-300).mean())
    p[np.arange(len(x)), y] -= 1
    p /= len(x)
    back = (p @ net.dense.T) * (1 - hidden**2)
    grads = []
    for i, w in enumerate(WIDTHS):
        g = np.zeros_like(net.filters[i])
        part = back[:, i * FILTERS : (i + 1) * FILTERS]
        for j in range(w):
            np.add.at(g[j], (x[rows, at[i] + j], np.arange(FILTERS)[None, :]), part)
        grads.append(g)
    return loss, [*grads, back.sum(axis=0), hidden.T @ p, p.sum(axis=0)]


def fit(windows: np.ndarray, y: np.ndarray, languages: list[str], epochs: int = 14, batch: int = 128, rate: float = 0.02, seed: int = 3) -> Network:
    """Adam on the cross entropy, with small weight decay on filters and the dense layer."""
    rng = np.random.default_rng(seed)
    k = FILTERS * len(WIDTHS)
    net = Network(languages, [rng.normal(0, 0.3, (w, 256, FILTERS)) for w in WIDTHS], np.zeros(k), rng.normal(0, 0.3, (k, len(languages))), np.zeros(len(languages)))
    weights = [*net.filters, net.bias, net.dense, net.shift]
    decay = [*(1e-5 for _ in WIDTHS), 0.0, 1e-4, 0.0]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    t = 0
    for epoch in range(epochs):
        order = rng.permutation(len(windows))
        pace = rate * (0.5 + 0.5 * np.cos(np.pi * epoch / epochs))
        for a in range(0, len(order), batch):
            own = order[a : a + batch]
            _, grads = gradients(net, windows[own].astype(np.int64), y[own])
            t += 1
            for w, g, d, m, v in zip(weights, grads, decay, first, second, strict=True):
                g = g + d * w
                m *= 0.9
                m += 0.1 * g
                v *= 0.99
                v += 0.01 * g * g
                w -= pace * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return net


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 3, held: int = 1, per_language: int = PER_LANGUAGE) -> Network | None:
    """The network, or None where no row can be learned from. Every value of ``lang_col`` is learned.

    Of each language at most ``per_language`` rows, and of all together ``ROWS``, the first by a hash of id and text.
    """
    own = docs.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull()).where(F.crc32(F.col(id_col).cast("string")) % folds != held)
    own = own.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    counts = {r.lang: r["count"] for r in own.groupBy("lang").count().collect()}  # as many as the network has outputs
    if not counts:
        return None
    each = max(1, min(per_language, ROWS // len(counts)))
    share = docs.sparkSession.createDataFrame([(k, min(1.0, (each + 8 * each**0.5 + 64) / n)) for k, n in counts.items()], "lang string, share double")

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offs, data = tw.buffers(batch.column(1))
            windows = []
            for i in range(batch.num_rows):
                all_of = cut(data[offs[i] : offs[i + 1]])
                windows.append([all_of[j].tobytes() for j in np.unique(np.linspace(0, len(all_of) - 1, PER_TEXT).astype(int))])
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(3), pa.array(windows, pa.list_(pa.binary()))], names=["lang", "h", "windows"])

    # one pass: a limit on the hash by language, then the first rows of what is left
    own = own.join(F.broadcast(share), "lang").withColumn("h", F.xxhash64("id")).where(F.col("h") < F.col("share") * 2.0**64 - 2.0**63)
    drawn = own.select("id", "text", "lang", "h").mapInArrow(sample, "lang string, h long, windows array<binary>")
    first = Window.partitionBy("lang").orderBy("h", "windows")
    rows = drawn.withColumn("n", F.row_number().over(first)).where(F.col("n") <= each).select("lang", "windows").collect()
    pairs = sorted((r.lang, bytes(w)) for r in rows for w in r.windows)
    languages = sorted(counts)
    number = {name: i for i, name in enumerate(languages)}
    windows = np.frombuffer(b"".join(w for _, w in pairs), np.uint8).reshape(-1, LENGTH + max(WIDTHS) - 1)
    return fit(windows, np.array([number[name] for name, _ in pairs]), languages)


def predict(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        tables = net.compiled() if net else []
        for batch in batches:
            offs, data = tw.buffers(batch.column(1))
            n = batch.num_rows
            size = np.diff(offs)
            number = np.maximum(1, -(-size // LENGTH))
            sums = np.zeros((n, len(net.languages) if net else 1))
            for a, b in tw.pieces(np.concatenate(([0], np.cumsum(number))), 512) if net else ():
                parts = [cut(data[offs[i] : offs[i + 1]]) for i in range(a, b)]
                rows = np.repeat(np.arange(a, b), number[a:b])
                windows = np.concatenate(parts)
                for k in range(0, len(windows), 512):
                    own = windows[k : k + 512]
                    weight = _COUNTS[own[:, :LENGTH]].sum(axis=1) + 1e-3
                    np.add.at(sums, rows[k : k + 512], net.predict(own, tables) * weight[:, None])
            share = sums / np.maximum(sums.sum(axis=1, keepdims=True), 1e-12)
            letters = np.array([bool(net) and _LETTER.search(t.as_py() or "") is not None for t in batch.column(1)], bool)
            best = share.argmax(axis=1)
            lang = [net.languages[k] if ok else "und" for k, ok in zip(best.tolist(), letters.tolist(), strict=True)]
            score = np.where(letters, share.max(axis=1) if n else 0, 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["id", "lang", "score"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, lang string, score double")
