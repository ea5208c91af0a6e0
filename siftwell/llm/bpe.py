"""Operator 10: byte-level BPE by ranks, encoding and decoding.

A text is cut by a pattern and each match is encoded by itself: a match that is a token is that token, any other starts as
its bytes, and in each round the leftmost pair of lowest rank merges, until no pair has a rank.

A task encodes each distinct match that it meets once. Matches are put into padded matrices by length; in every round each
row merges its own leftmost minimum-rank pair, only the two pairs beside the merge are looked up again in a hash table of
pairs, and finished rows are moved out. Matches of over ``LONG`` bytes, for which rounds would cost the square of the length,
are merged in the same order with a heap. The table of distinct matches is a cache that is emptied at ``CACHE`` entries.

Defined results: null text counts as empty and has no ids; ids of rows (also null or repeated) are carried along.
"""

from __future__ import annotations

import base64
import functools
import heapq
from collections.abc import Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm import words as tw

LONG, CACHE = 256, 200_000
#: Bytes from which a text is encoded in runs of so many matches, and ids that are decoded at a time.
LARGE, RUN = 4 << 20, 200_000
NONE = np.int32(2**31 - 1)


class PairTable:
    """(left id, right id) -> id of the merged token, which is its rank; open addressing, looked up by whole arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        self.shift = 64 - max(4, int(np.ceil(np.log2(4 * len(left) + 1))))
        self.keys = np.full(1 << (64 - self.shift), -1, np.int64)
        self.ids = np.full(len(self.keys), NONE, np.int32)
        keys = (left.astype(np.int64) << 32) | right
        todo, at = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = self.keys[at] < 0
            slot, first = np.unique(at[free], return_index=True)
            put = np.flatnonzero(free)[first]
            self.keys[slot], self.ids[slot] = keys[todo[put]], merged[todo[put]]
            stay = np.ones(len(todo), bool)
            stay[put] = False
            todo, at = todo[stay], (at[stay] + 1) % len(self.keys)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(tw.ODD)) >> np.uint64(self.shift)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks; NONE where there is no such pair or an end is below zero."""
        keys = (left.astype(np.int64) << 32) | right
        out = np.full(keys.shape, NONE, np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        at = self._slot(keys.ravel()[todo])
        flat, own = out.ravel(), keys.ravel()
        while len(todo):
            held = self.keys[at]
            same = held == own[todo]
            flat[todo[same]] = self.ids[at[same]]
            go = ~same & (held >= 0)
            todo, at = todo[go], (at[go] + 1) % len(self.keys)
        return flat.reshape(keys.shape)


class Vocabulary:
    def __init__(self, path: str):
        with open(path, "rb") as file:
            pairs = [line.split() for line in file if line.strip()]
        self.ranks = {base64.b64decode(a): int(b) for a, b in pairs}
        self.tokens = {b: a for a, b in self.ranks.items()}
        split = [(self.ranks[t[:i]], self.ranks[t[i:]], r) for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        left, right, merged = (np.array(x, np.int64) for x in zip(*split, strict=True)) if split else (np.zeros(0, np.int64),) * 3
        self.pairs = PairTable(left, right, merged.astype(np.int32))
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)

    def encode_long(self, piece: bytes) -> np.ndarray:
        """The same merges in the same order, for a long match: the leftmost lowest pair comes off a heap."""
        ids = self.byte[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        text = [bytes([b]) for b in piece]
        heap = []

        def push(i: int) -> None:
            j = after[i]
            if j < n and (rank := self.ranks.get(text[i] + text[j])) is not None:
                heap.append((rank, i, len(text[i]), len(text[j]))) if starting else heapq.heappush(heap, (rank, i, len(text[i]), len(text[j])))

        starting = True
        for i in range(n - 1):
            push(i)
        heapq.heapify(heap)
        starting = False
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if len(text[i]) != a or j >= n or len(text[j]) != b or not a:
                continue
            text[i], ids[i], text[j] = text[i] + text[j], rank, b""
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        return np.array([x for x, t in zip(ids, text, strict=True) if t], np.int32)

    def encode_matrix(self, pieces: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        """Padded ids and their counts, of matches of at most ``width`` bytes."""
        n = len(pieces)
        size = np.fromiter(map(len, pieces), np.int64, n)
        ids = np.full((n, width), -1, np.int32)
        ids[np.arange(width) < size[:, None]] = self.byte[np.frombuffer(b"".join(pieces), np.uint8)]
        if width < 2:
            return ids, size
        rank = self.pairs.find(ids[:, :-1], ids[:, 1:])
        final, count = ids.copy(), size.copy()
        row = np.arange(n)
        place = np.arange(width)
        while len(row):
            at = rank.argmin(axis=1)  # of equal ranks the leftmost
            best = rank[np.arange(len(row)), at]
            done = best == NONE
            if done.any():
                final[row[done]] = ids[done]
                row, ids, rank, at, best = (x[~done] for x in (row, ids, rank, at, best))
                if not len(row):
                    break
            line = np.arange(len(row))
            ids[line, at] = best
            count[row] -= 1
            source = np.minimum(place + (place > at[:, None]), width - 1)
            ids = np.take_along_axis(ids, source, axis=1)
            ids[:, -1] = -1
            source = np.minimum(place[:-1] + (place[:-1] > at[:, None]), width - 2)
            rank = np.take_along_axis(rank, source, axis=1)
            rank[:, -1] = NONE
            inner = at < width - 1
            rank[line[inner], at[inner]] = self.pairs.find(ids[line[inner], at[inner]], ids[line[inner], at[inner] + 1])
            left = at > 0
            rank[line[left], at[left] - 1] = self.pairs.find(ids[line[left], at[left] - 1], ids[line[left], at[left]])
        return final, count

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all matches one after another, and how many each has."""
        out: list[np.ndarray | None] = [None] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            whole = self.ranks.get(p)
            if whole is not None:
                out[i] = np.array([whole], np.int32)
            elif len(p) > LONG:
                out[i] = self.encode_long(p)
            elif p:
                buckets.setdefault(1 << max(1, (len(p) - 1).bit_length()) if len(p) > 16 else len(p) + len(p) % 2, []).append(i)
            else:
                out[i] = np.zeros(0, np.int32)
        for width, members in buckets.items():
            step = max(1, (1 << 20) // width)
            for k in range(0, len(members), step):
                own = members[k : k + step]
                ids, count = self.encode_matrix([pieces[i] for i in own], width)
                for i, line, c in zip(own, ids, count.tolist(), strict=True):
                    out[i] = line[:c]
        counts = np.fromiter(map(len, out), np.int64, len(out))
        return (np.concatenate(out) if out else np.zeros(0, np.int32)), counts

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Cache:
    """Ids of the distinct matches met so far, in one array."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.int32)
        self.start = np.zeros(1, np.int64)

    def look_up(self, found: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the matches in a row, and how many ids each has."""
        if len(self.place) > CACHE:
            self.clear()
        new = list(set(found).difference(self.place))
        if new:
            ids, counts = self.vocab.encode([x.encode() for x in new])
            used = int(self.start[-1])
            if used + len(ids) > len(self.ids):
                self.ids = np.concatenate((self.ids[:used], np.zeros(used + 2 * len(ids), np.int32)))
            self.ids[used : used + len(ids)] = ids
            self.place.update(zip(new, range(len(self.place), len(self.place) + len(new)), strict=True))
            self.start = np.concatenate((self.start, used + np.cumsum(counts)))
        at = np.fromiter(map(self.place.__getitem__, found), np.int64, len(found))
        size = self.start[at + 1] - self.start[at]
        edge = np.cumsum(size)
        source = np.arange(int(edge[-1]) if len(edge) else 0) + np.repeat(self.start[at] - (edge - size), size)
        return self.ids[source], size


def _decoded(vocab: Vocabulary, lists: pa.ListArray) -> pa.Array:
    cuts, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
    out = [b"".join(vocab.decode(flat[k : min(b, k + RUN)].tolist()) for k in range(a, b, RUN)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return pa.array(out, pa.binary())


def _encode(path: str, pattern: str, decoded: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rule = Cache(vocabulary(path)), regex.compile(pattern)
        find, matches = rule.findall, rule.finditer
        for batch in batches:
            texts = batch.column(1)
            offs, _ = tw.buffers(texts)
            for a, b in tw.pieces(offs, 1 << 20):
                if offs[b] - offs[a] > LARGE:  # one text, in runs of matches
                    each = (m.group() for m in matches(texts[a].as_py()))
                    ids = np.concatenate([known.look_up(list(run))[0] for run in batched(each, RUN)] or [np.zeros(0, np.int32)])
                    edge = np.array([0, len(ids)])
                else:
                    found, each = [], []
                    for i in range(a, b):
                        own = find(texts[i].as_py() or "")
                        found += own
                        each.append(len(own))
                    ids, size = known.look_up(found)
                    edge = np.concatenate(([0], np.cumsum(size)))[np.concatenate(([0], np.cumsum(each)))]
                lists = pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(ids))
                more = [_decoded(known.vocab, lists)] if decoded else []
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists, *more], names=["id", "ids", *(["decoded"] if decoded else [])])

    return run


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _decoded(vocab, batch.column(1))], names=["id", "ids", "decoded"])

    return run


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """id and ids (array of int) of every row; with ``decoded`` also what decode() gives for them, in the same pass."""
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return own.mapInArrow(_encode(path, pattern, decoded), "id long, ids array<int>" + (", decoded binary" if decoded else ""))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """id, ids and decoded (binary): the bytes that the ids stand for, which need not be UTF-8 for ids that aren't from encode()."""
    own = encoded.select("id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
    return own.mapInArrow(_decode(path), "id long, ids array<int>, decoded binary")
