"""Operator 9: benchmark passages in documents, by n-gram seeds and Smith-Waterman alignment.

Words are runs of letters and digits (any byte of 128 or more counts as a letter), A-Z lower-cased. Every run of ``N`` words of a
text that some test item has too is a seed: a text is aligned with each item that it shares a run with. No run is left out as
too frequent, since an item's exact copies make the runs that an edited copy altered rarer than those it kept, so any rank among
an item's runs can leave an edited copy without seeds. Local alignment of words, +2 for equal ones, -1 for a change, insertion or
deletion, in the stretches around the seeds; they are wide enough for any alignment through a seed that reaches ``THRESHOLD``.
The score is the alignment's share of the item's full score; ``THRESHOLD`` and more is reported.

What frequent runs bring is bounded without loss: an alignment has no more equal words than the item has words that occur in the
stretch, so a stretch with too few of them for the threshold is not aligned. A text that shares no run with an item is not met.

While the items have at most ``BROADCAST`` runs (checked), they go to every task as a broadcast, and documents are read once and
never dealt; beyond that runs meet in a join.

Defined results: items of under N words, null texts and rows with null id have no runs and no result; rows of one id are
rows of their own; an item id that is repeated counts each text; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm import words as tw
from siftwell.session import cut_lineage

N, THRESHOLD, BROADCAST = 3, 0.5, 500_000
MATCH, OTHER = 2, -1
#: Meetings of runs and items that are held at once for one text.
MET = 1 << 20

_FOLD = np.arange(256)
_FOLD[65:91] += 32
_SPLIT = np.ones(256, bool)
_SPLIT[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def word_ids(offs: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and rows of the words of a piece of texts."""
    starts, ends, rows = tw.spans(data, offs, _SPLIT)
    return tw.sound_words(data, starts, ends, 0, _FOLD), rows


class Index(NamedTuple):
    """The items' runs: ``grams`` sorted; those of grams[i] are rows edge[i] to edge[i + 1] of the columns below, by item."""

    grams: np.ndarray
    edge: np.ndarray
    item: np.ndarray
    first: np.ndarray
    last: np.ndarray
    count: np.ndarray
    ids: np.ndarray
    words: list[np.ndarray]


def index(ids: np.ndarray, words: list[np.ndarray], n: int) -> Index:
    """One row a run and item, with the run's first and last place in it and their number."""
    made = [tw.grams(w, n) for w in words]
    size = np.array([len(g) for g in made], np.int64)
    gram = np.concatenate([np.zeros(0, np.uint64), *made])
    item = np.repeat(np.arange(len(made)), size)
    place = np.arange(len(gram)) - np.repeat(np.cumsum(size) - size, size)
    order = np.lexsort((place, item, gram))
    gram, item, place = gram[order], item[order], place[order]
    new = np.flatnonzero(np.append(True, (gram[1:] != gram[:-1]) | (item[1:] != item[:-1]))) if len(gram) else np.zeros(0, np.int64)
    end = np.append(new[1:], len(gram))
    grams, edge = np.unique(gram[new], return_index=True)
    return Index(grams, np.append(edge, len(new)), item[new], place[new], place[end - 1] if len(new) else place[:0], end - new if len(new) else new, ids, words)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... for sizes[i] numbers, one after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def _runs(n: int):
    """(gram, id, key, at) of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2))
            offs, data = tw.buffers(batch.column(1))
            for a, b in tw.pieces(offs):
                words, rows = word_ids(offs[a : b + 1], data)
                grams = tw.grams(words, n)
                at = np.flatnonzero(rows[: len(grams)] == rows[n - 1 :]) if len(grams) else np.zeros(0, np.int64)
                own = rows[at]
                columns = [tw.signed(grams[at]), ids[a + own], keys[a + own], (at - np.searchsorted(rows, own)).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["gram", "id", "key", "at"])

    return run


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        offs, data = tw.buffers(batch.column(1))
        words, rows = word_ids(offs, data)
        edge = np.searchsorted(rows, np.arange(batch.num_rows + 1)).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(edge), pa.array(tw.signed(words)))
        yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["item", "words"])


def _keyed_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for made in _items(iter((batch,))):
            yield pa.RecordBatch.from_arrays([made.column(0), batch.column(2), made.column(1)], names=["item", "test", "words"])


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Best local score and the end of the alignment in the text."""
    best, end = 0, 0
    above = np.zeros(len(text) + 1, np.int64)
    step = np.arange(len(text) + 1)
    for word in item:
        row = np.zeros(len(text) + 1, np.int64)
        np.maximum(above[:-1] + np.where(text == word, MATCH, OTHER), above[1:] + OTHER, out=row[1:])
        np.maximum(row, 0, out=row)
        row = np.maximum.accumulate(row + step) - step  # words of the text left out
        at = int(row.argmax())
        if row[at] > best:
            best, end = int(row[at]), at
        above = row
    return best, end


def _best(item: np.ndarray, words: np.ndarray, low: np.ndarray, high: np.ndarray, threshold: float) -> tuple[float, int, int]:
    """Best score, start of its stretch and end of the alignment; the stretches of the seeds come ordered by ``low``."""
    spans: list[list[int]] = []
    for a, b in zip(np.maximum(low, 0).tolist(), np.minimum(high, len(words)).tolist(), strict=True):
        if spans and a <= spans[-1][1] and b - spans[-1][0] < 8 * len(item):
            spans[-1][1] = max(b, spans[-1][1])
        elif not spans or b > spans[-1][1]:
            spans.append([a, b])
    best = (0.0, 0, 0)
    for a, b in spans:
        held = np.sort(words[a:b])
        equal = int((held[np.minimum(np.searchsorted(held, item), len(held) - 1)] == item).sum())
        if equal < threshold * len(item):
            continue
        score, end = align(item, words[a:b])
        best = max(best, (score / (MATCH * len(item)), -a, a + end))
    return best[0], -best[1], best[2]


def _slack(size: np.ndarray | int, threshold: float) -> np.ndarray:
    """Words of a text that an alignment which reaches the threshold may leave out: equal words less these make the score."""
    return np.ceil(np.asarray(size) * MATCH * (1 - min(threshold, 1)) / -OTHER).astype(np.int64) + 1


_NAMES = ("id", "item", "score", "seeds", "low", "end")
_TYPES = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64())


def _batch(out: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*out, strict=True)) if out else [[]] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], names=list(_NAMES))


def _search(known, n: int, threshold: float):
    """Results of the texts against all items of the index, a broadcast."""

    def found(x: Index, size: np.ndarray, slack: np.ndarray, words: np.ndarray, at: np.ndarray, gram: np.ndarray) -> Iterator[tuple]:
        kinds, own, times = np.unique(gram, return_inverse=True, return_counts=True)
        order, begin = np.argsort(own, kind="stable"), np.cumsum(times) - times
        each = x.edge[kinds + 1] - x.edge[kinds]
        rows, kind = _ranges(x.edge[kinds], each), np.repeat(np.arange(len(kinds)), each)
        by_item = np.argsort(x.item[rows], kind="stable")
        rows, kind = rows[by_item], kind[by_item]
        items, first = np.unique(x.item[rows], return_index=True)
        met = np.add.reduceat(times[kind], first)
        first = np.append(first, len(rows))
        done = 0
        while done < len(items):
            to = max(done + 1, int(np.searchsorted(np.cumsum(met[done:]), MET, side="right")) + done)
            part, of = rows[first[done] : first[to]], kind[first[done] : first[to]]
            place = at[order[_ranges(begin[of], times[of])]]
            part = np.repeat(part, times[of])
            item = x.item[part]
            low, high = place - x.last[part] - slack[item], place - x.first[part] + size[item] + slack[item]
            sort = np.lexsort((low, item))
            low, high, item, count = low[sort], high[sort], item[sort], x.count[part][sort]
            edge = np.append(np.searchsorted(item, items[done:to]), len(item))
            for i, a, b in zip(items[done:to].tolist(), edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                score, start, end = _best(x.words[i], words, low[a:b], high[a:b], threshold)
                if score >= threshold:
                    yield int(x.ids[i]), score, int(count[a:b].sum()), start, end
            done = to

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x: Index = known.value
        marks = np.zeros(1 << 22, bool)
        marks[(x.grams >> np.uint64(42)).astype(np.int64)] = True
        size = np.array([len(w) for w in x.words], np.int64)
        slack = _slack(size, threshold)
        for batch in batches:
            out: list[tuple] = []
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            offs, data = tw.buffers(batch.column(1))
            for a, b in tw.pieces(offs):
                words, rows = word_ids(offs[a : b + 1], data)
                grams = tw.grams(words, n)
                if not len(grams) or not len(x.grams):
                    continue
                at = np.flatnonzero((rows[: len(grams)] == rows[n - 1 :]) & marks[(grams >> np.uint64(42)).astype(np.int64)])
                gram = np.minimum(np.searchsorted(x.grams, grams[at]), len(x.grams) - 1)
                hit = x.grams[gram] == grams[at]
                at, gram = at[hit], gram[hit]
                edge = np.append(np.flatnonzero(np.append(True, rows[at][1:] != rows[at][:-1])), len(at)) if len(at) else [0]
                for s, e in zip(edge[:-1], edge[1:], strict=True):
                    row = rows[at[s]]
                    begin, end = np.searchsorted(rows, (row, row + 1))
                    out += [(int(ids[a + row]), *f) for f in found(x, size, slack, words[begin:end], at[s:e] - begin, gram[s:e])]
            yield _batch(out)

    return run


def _score(threshold: float):
    """Results of the texts against the items that the join brought."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            offs, data = tw.buffers(batch.column(1))
            for i in range(batch.num_rows):
                words, _ = word_ids(offs[i : i + 2], data)
                for c in batch.column(2)[i].as_py():
                    item = np.array(c["words"], np.int64).view(np.uint64)
                    slack = int(_slack(len(item), threshold))
                    at, place = (np.array([s[k] for s in c["seeds"]], np.int64) for k in ("at", "place"))
                    low = np.sort(at - place)
                    score, start, end = _best(item, words, low - slack, low + len(item) + slack, threshold)
                    if score >= threshold:
                        out.append((batch.column(0)[i].as_py(), c["item"], score, len(low), start, end))
            yield _batch(out)

    return run


def leaks(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    n: int = N, threshold: float = THRESHOLD, broadcast_limit: int = BROADCAST,
) -> DataFrame:
    """id, item, score, seeds (hits of seeds), low (first word of the aligned stretch), end (word after the alignment)."""
    shape = "id long, item long, score double, seeds long, low long, end long"
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    tests = items.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).alias("text")).where("item is not null and text is not null").distinct()
    read = cut_lineage(tests.mapInArrow(_items, "item long, words array<long>").where(F.size("words") >= n))
    if (read.agg(F.sum(F.size("words") - (n - 1))).first()[0] or 0) <= broadcast_limit:
        rows = read.orderBy("item", "words").collect()
        known = index(np.array([r.item for r in rows], np.int64), [np.array(r.words, np.int64).view(np.uint64) for r in rows], n)
        return own.mapInArrow(_search(docs.sparkSession.sparkContext.broadcast(known), n, threshold), shape)
    key = F.xxhash64("text")  # rows of one id are told apart by their text
    tests = tests.withColumnRenamed("item", "id").withColumn("key", key)
    grams = tests.mapInArrow(_runs(n), "gram long, id long, key long, at int").select("gram", F.col("id").alias("item"), F.col("key").alias("test"), F.col("at").alias("place"))
    own = own.withColumn("key", key)
    hits = own.mapInArrow(_runs(n), "gram long, id long, key long, at int")
    met = hits.join(grams, "gram").groupBy("id", "key", "item", "test").agg(F.collect_set(F.struct("at", "place")).alias("seeds"))
    whole = tests.mapInArrow(_keyed_items, "item long, test long, words array<long>")
    asked = met.join(whole, ["item", "test"]).groupBy("id", "key").agg(F.collect_list(F.struct("item", "words", "seeds")).alias("asked"))
    return own.join(asked, ["id", "key"]).select("id", "text", "asked").mapInArrow(_score(threshold), shape)
