"""Operator 2: removal of repeated passages by seeds and extension.

Words are runs of bytes other than ASCII white space. A *window* is ``window`` consecutive words of a document. A word is
removed if a window that covers it has the same words as a window that starts earlier (smaller id, or same document and
smaller start).

Seeds: of the k-word hashes inside each window the smallest is the window's anchor (the rightmost of equal ones), as in
winnowing; it depends on the window's words alone, so equal windows have equal anchors at equal places. The windows of one
anchor stand side by side; the stretch of words that they cover is the anchor *extended both ways* as far as the seed speaks
for it, here called a block.

1. Each task keeps the earliest of equal blocks that it has read (``_Seen``); later ones are repeats for certain. The earliest
   go to the seed's partition: one row a block and task where ids rise, a few where they don't, so that a passage which a third
   of the documents share brings no more rows there than there were tasks, whatever their size.
2. There the earliest block of equal ones stays; where blocks of one seed differ (edges of repeats, edited copies), their
   earliest ones are compared window by window in a second, much smaller exchange. Adjacent repeated windows merge into
   maximal repeats when they are applied to the texts.

No pair of documents is ever formed, so groups of thousands of copies cost as much as their rows.

Defined results: a null text has no words. A row with null id is neither a source nor changed. Rows that share an id count
as one document: equal places in them don't remove each other. Empty input gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwell.llm import words as tw
from siftwell.session import cut_lineage

#: at: the first window's start in the upper half; twice the number of windows beyond it, plus 1 for a repeat, in the lower one.
SEEDS = "k1 long, k2 long, id long, at long"


def _batch(k1, k2, ids, s, e, repeat) -> pa.RecordBatch:
    at = (s.astype(np.int64) << 32) | ((e - s).astype(np.int64) << 1) | int(repeat)
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (k1, k2, ids, at)], names=["k1", "k2", "id", "at"])


def _unpacked(found: DataFrame) -> DataFrame:
    s = F.shiftright("at", 32).cast("int")
    return found.withColumn("s", s).withColumn("e", s + F.shiftright(F.col("at").bitwiseAND(0xFFFFFFFF), 1).cast("int")).withColumn("repeat", F.col("at").bitwiseAND(1) == 1)


class _Seen:
    """The earliest places of the keys that a task has met, for up to ``most`` keys; what it doesn't hold travels."""

    def __init__(self, most: int = 1 << 20):
        self.most = most
        self.h, self.k2 = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.ids, self.s = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def earlier(self, k1, k2, ids, s) -> np.ndarray:
        """Which of the (distinct) keys have been met at an earlier place; keeps the earliest of all."""
        h = tw.mix(k1) ^ k2
        at = np.searchsorted(self.h, h)
        near = np.minimum(at, max(0, len(self.h) - 1))
        hit = (self.h[near] == h) & (self.k2[near] == k2) if len(self.h) else np.zeros(len(h), bool)
        out = np.zeros(len(h), bool)
        own = near[hit]
        out[hit] = (self.ids[own] < ids[hit]) | ((self.ids[own] == ids[hit]) & (self.s[own] < s[hit]))
        now = hit & ~out
        self.ids[near[now]], self.s[near[now]] = ids[now], s[now]
        new = np.flatnonzero(~hit)[: max(0, self.most - len(self.h))]
        new = new[np.argsort(h[new], kind="stable")]
        self.h, self.k2, self.ids, self.s = (np.insert(a, at[new], b[new]) for a, b in ((self.h, h), (self.k2, k2), (self.ids, ids), (self.s, s)))
        return out


def _earliest(k1, k2, ids, s, e, seen: _Seen | None = None) -> Iterator[pa.RecordBatch]:
    """The earliest of equal keys as they are; the others, merged where they touch, as repeats under a key of their own."""
    if not len(k1):
        return
    order = np.lexsort((s, ids, k2, k1))
    new = np.ones(len(k1), bool)
    new[1:] = (k1[order[1:]] != k1[order[:-1]]) | (k2[order[1:]] != k2[order[:-1]])
    first = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    same = ~new & (ids[order] == ids[first]) & (s[order] == s[first])
    stay, again = np.sort(order[new]), order[~new & ~same]  # in the order of the texts, which packs better
    if seen is not None:
        gone = seen.earlier(k1[stay], k2[stay], ids[stay], s[stay])
        stay, again = stay[~gone], np.concatenate((again, stay[gone]))
    yield _batch(tw.signed(k1[stay]), tw.signed(k2[stay]), ids[stay], s[stay], e[stay], False)
    if len(again):
        ids, s, e = ids[again], s[again], e[again]
        order = np.lexsort((s, ids))
        ids, s, e = ids[order], s[order], e[order]
        cut = np.ones(len(ids), bool)
        cut[1:] = (ids[1:] != ids[:-1]) | (s[1:] > e[:-1] + 1)
        at = np.flatnonzero(cut)
        ends = np.maximum.reduceat(e, at)
        key = tw.mix(ids[at].astype(np.uint64) * np.uint64(tw.ODD) + s[at].astype(np.uint64))
        yield _batch(tw.signed(key), np.zeros(len(at), np.int64), ids[at], s[at], ends, True)


def _blocks(window: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Seen()
        for batch in batches:
            ids_all = batch.column(0).to_numpy(zero_copy_only=False)
            offs, data = tw.buffers(batch.column(1))
            for a, b in tw.pieces(offs, 2 << 20):
                starts, ends, rows = tw.spans(data, offs[a : b + 1])
                if len(starts) < window:
                    continue
                hashes = tw.sound_words(data, starts, ends)
                seeds = tw.grams(hashes, k)
                anchor = tw.sliding_argmin(seeds, window - k + 1)
                at = np.flatnonzero(rows[: len(anchor)] == rows[window - 1 :][: len(anchor)])
                if not len(at):
                    continue
                own = anchor[at]
                cut = np.ones(len(at), bool)
                cut[1:] = (own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1)
                left = np.flatnonzero(cut)
                s, e = at[left], at[np.append(left[1:], len(at)) - 1]
                row = rows[s]
                base = np.searchsorted(rows, row)  # the document's first word
                yield from _earliest(
                    seeds[own[left]], tw.sound_hash(hashes, s, e + window, 1), ids_all[a + row], (s - base).astype(np.int32), (e - base).astype(np.int32), seen
                )

    return run


def _windows(window: int):
    """Every window of the blocks in question of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids_all = batch.column(0).to_numpy(zero_copy_only=False)
            offs, data = tw.buffers(batch.column(1))
            ranges = batch.column(2)
            cuts, flat = ranges.offsets.to_numpy(), ranges.values
            lo, hi = flat.field(0).to_numpy(zero_copy_only=False), flat.field(1).to_numpy(zero_copy_only=False)
            for a, b in tw.pieces(offs):
                starts, ends, rows = tw.spans(data, offs[a : b + 1])
                base = np.searchsorted(rows, np.arange(b - a))
                n = cuts[a + 1 : b + 1] - cuts[a:b]
                shift = np.repeat(base, n)
                s, e = lo[cuts[a] : cuts[b]] + shift, hi[cuts[a] : cuts[b]] + shift
                size = e - s + 1
                at = np.repeat(s - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())
                at = at[at + window <= len(rows)]
                at = at[rows[at] == rows[at + window - 1]]
                first, second = (tw.sound_words(data, starts, ends, seed) for seed in (0, 1))
                own = (at - base[rows[at]]).astype(np.int32)
                # two hashes of the whole window, 96 bits together
                check = tw.sound_hash(second, at, at + window, 1) >> np.uint64(32)
                yield from _earliest(tw.sound_hash(first, at, at + window, 0), check, ids_all[a + rows[at]], own, own)

    return run


def _apply(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            carried = batch.num_columns > 3
            offs, data = tw.buffers(batch.column(1))
            ranges = batch.column(2)
            cuts, flat = ranges.offsets.to_numpy(), ranges.values
            lo, hi = flat.field(0).to_numpy(zero_copy_only=False), flat.field(1).to_numpy(zero_copy_only=False)
            total, removed, kept = [], [], []
            for i in range(batch.num_rows):
                own = data[offs[i] : offs[i + 1]].tobytes().split()
                gone = 0
                if cuts[i + 1] > cuts[i]:
                    edge = np.zeros(len(own) + 1, np.int64)
                    s, e = (np.minimum(x, len(own)) for x in (lo[cuts[i] : cuts[i + 1]], hi[cuts[i] : cuts[i + 1]] + window))
                    np.add.at(edge, s, 1)
                    np.add.at(edge, e, -1)
                    stay = np.cumsum(edge)[:-1] == 0
                    gone = len(own) - int(stay.sum())
                    own = [own[j] for j in np.flatnonzero(stay)]
                total.append(len(own) + gone)
                removed.append(gone)
                kept.append(b" ".join(own).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string()), *((batch.column(1), batch.column(3)) if carried else ())],
                names=["id", "n_words", "n_removed", "kept", *(("text", "row") if carried else ())],
            )

    return run


def _later(found: DataFrame) -> DataFrame:
    """Adds ``rank`` among equal keys and ``mixed``, whether the seed has different blocks. One exchange, by the seed."""
    by_seed = found.repartition("k1")
    equal = Window.partitionBy("k1", "k2").orderBy("id", "at")
    seed = Window.partitionBy("k1")
    return by_seed.withColumn("rank", F.rank().over(equal)).withColumn("mixed", F.min("k2").over(seed) < F.max("k2").over(seed))


def repeated_ranges(docs: DataFrame, window: int = 20, k: int = 5) -> DataFrame:
    """id and ranges (first and last start of repeated windows), one row a document that has any. ``docs`` has id and body."""
    known = docs.where("id is not null")
    found = _unpacked(_later(known.mapInArrow(_blocks(window, k), SEEDS)))
    found = cut_lineage(found.where("repeat or rank > 1 or mixed").select("id", "s", "e", (F.col("repeat") | (F.col("rank") > 1)).alias("repeat")))
    ask = found.where("not repeat").groupBy("id").agg(F.collect_list(F.struct("s", "e")).alias("ranges"))
    again = known.join(ask, "id").select("id", "body", "ranges").mapInArrow(_windows(window), SEEDS)
    by_window = _unpacked(again.repartition("k1").withColumn("rank", F.rank().over(Window.partitionBy("k1", "k2").orderBy("id", "at"))))
    sure = found.where("repeat").select("id", "s", "e").unionAll(by_window.where("repeat or rank > 1").select("id", "s", "e"))
    return sure.groupBy("id").agg(F.collect_list(F.struct("s", "e")).alias("ranges"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, k: int = 5, carry: tuple[str, ...] = ()) -> DataFrame:
    """id, n_words, n_removed, kept (words that stay, joined by one space).

    With ``carry`` also text, as it was, and row, a struct of the named columns.
    """
    if not 0 < k <= window:
        raise ValueError("k must lie between 1 and window")
    extra = [F.struct(*carry).alias("row")] if carry else []
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("body"), *extra)
    known = own.where("id is not null")
    ranges = repeated_ranges(own.select("id", "body"), window, k)
    none = F.array().cast("array<struct<s:int,e:int>>")
    columns = ["id", "body", F.coalesce("ranges", none).alias("ranges"), *(["row"] if carry else [])]
    # the same exchange of the texts serves the windows in question and this join
    joined = known.join(ranges, "id", "left").select(*columns)
    joined = joined.unionAll(own.where("id is null").withColumn("ranges", none).select(*columns))
    row = f", text string, row {own.schema['row'].dataType.simpleString()}" if carry else ""
    return joined.mapInArrow(_apply(window), f"id long, n_words long, n_removed long, kept string{row}")
