"""Operator 7: SimHash near-duplicates found with the generalised pigeonhole principle.

Fingerprint: A-Z is lower-cased, words are runs of anything but ASCII white space, shingles are four consecutive words joined
by a space, repeats included (fewer words: the whole sequence; none: fingerprint zero). A bit is set if it is set in over half
the shingles' XXH64 (seed 42). Documents whose fingerprints differ in at most ``radius`` bits are linked; a component is named
by its smallest id.

Search: the 64 bits are cut into m parts, correlated bits together. If part i has threshold t_i (-1: not searched) and the
thresholds add up to radius - m + 1, any linked pair lies within t_i in some part i. A dynamic programme chooses m and the
thresholds by the rows and candidate pairs that they cost, estimated on a bounded sample of fingerprints (``SAMPLE``); the
choice changes the cost only, never the result. Each distinct fingerprint goes to the bucket of its value in every part with
t_i >= 0, for t_i = 1 also to those with one set bit cleared (one of two values that differ in one bit has it set), and beyond
to all within half of t_i, rounded up, so that two neighbours meet half-way.

Only distinct fingerprints are searched, so exact copies cost a row. A bucket of over ``BLOCK`` fingerprints is cut into blocks
and each pair of blocks is a group of its own, so no group has over about twice that. A group answers with a spanning forest
of its verified links, never with all pairs. Components come from rounds of star contraction.

Defined results: null text counts as empty; a row with null id has its fingerprint and, alone, a null component; repeated ids
are rows of their own; empty input gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm import words as tw
from siftwell.operators.graph import connected_components
from siftwell.session import cut_lineage

SHINGLE, RADIUS = 4, 4
#: Sampled fingerprints, those of them that are held against each other for the plan, rows of a block; keys of buckets that may be broadcast.
SAMPLE, PAIRED, BLOCK, FEW_KEYS = 20_000, 2_000, 4096, 100_000
#: Radius for a Jaccard similarity of 0.8, the same for two fingerprints together, and bytes of shingles of a block.
WIDE, BOTH, BLOCK_BYTES = 12, 30, 16 << 20
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_LANE = (np.arange(8) * 256)[None, :]
_WEIGHT = np.uint64(1) << np.arange(64, dtype=np.uint64)


def _shingles(words: list[bytes], shingle: int) -> list[bytes]:
    """Runs of ``shingle`` words, cut out of the joined text."""
    edge = np.zeros(len(words) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1, out=edge[1:])
    whole = b" ".join(words)
    return [whole[a:b] for a, b in zip(edge[: len(words) - shingle + 1].tolist(), (edge[shingle:] - 1).tolist(), strict=True)]


def _segments(raw: bytes, size: int = 1 << 22) -> Iterator[list[bytes]]:
    """The words of a text in segments that end between words."""
    at = 0
    while at < len(raw):
        to = min(len(raw), at + size)
        while to < len(raw) and not tw.SPACES[raw[to]]:
            to += 1
        yield raw[at:to].split()
        at = to


def shape(text: str | None, shingle: int = SHINGLE, seed: int = 42, both: bool = False) -> tuple[int, int, int, int]:
    """Fingerprint, number of distinct shingles, a hash of the sequence of words, and a second fingerprint of the hashes mixed."""
    carry: list[bytes] = []
    total, second, count, made = np.zeros((8, 8), np.int64), np.zeros((8, 8), np.int64), 0, []
    whole = xxhash.xxh64(seed=seed)

    def add(own: list[bytes]) -> int:
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, own, repeat(seed)), np.uint64, len(own))
        for bits, own_hashes in ((total, hashes), (second, tw.mix(hashes)))[: 1 + both]:
            lanes = own_hashes.view(np.uint8).reshape(-1, 8) + _LANE
            bits += np.bincount(lanes.ravel(), minlength=2048).reshape(8, 256) @ _BITS
        made.append(hashes)
        return len(own)

    for words in _segments((text or "").encode().lower()):
        whole.update(b" ".join(words) + b" ")
        words = carry + words
        if len(words) >= shingle:
            count += add(_shingles(words, shingle))
        carry = words[-(shingle - 1) :] if shingle > 1 else []
    if not count and carry:
        count = add([b" ".join(carry)])
    distinct = len(np.unique(np.concatenate(made))) if both and made else 0
    first, other = (int(_WEIGHT[bits.ravel() * 2 > count].sum()) for bits in (total, second))
    return first, distinct, whole.intdigest(), other


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = 42) -> int:
    return shape(text, shingle, seed)[0]


def _fingerprints(shingle: int, seed: int, both: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [shape(t.as_py(), shingle, seed, both) for t in batch.column(1)]
            columns = [np.array([m[k] for m in made], np.uint64).view(np.int64) for k in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns)], names=["id", "fp", "n", "h", "fp2"])

    return run


def correlated_parts(bits: np.ndarray, m: int) -> list[np.ndarray]:
    """m parts of the bit positions, of even sizes; each grows by the position that correlates most with what it has."""
    spread = bits.std(axis=0)
    scaled = np.where(spread > 0, (bits - bits.mean(axis=0)) / np.where(spread > 0, spread, 1), 0)
    like = np.abs(scaled.T @ scaled) / max(1, len(bits))
    np.fill_diagonal(like, 0)
    left, parts = list(range(bits.shape[1])), []
    for i in range(m):
        size = len(left) // (m - i)
        own = [max(left, key=lambda x: like[x, left].sum())]
        left.remove(own[0])
        while len(own) < size:
            own.append(max(left, key=lambda x: like[x, own].sum()))
            left.remove(own[-1])
        parts.append(np.array(sorted(own)))
    return parts


def part_values(fps: np.ndarray, part: np.ndarray) -> np.ndarray:
    """The bits of a part, packed."""
    out = np.zeros(len(fps), np.int64)
    for k, bit in enumerate(part):
        out |= ((fps >> np.uint64(bit)) & np.uint64(1)).astype(np.int64) << k
    return out


def rows_for(width: int, t: int) -> float:
    """Rows a fingerprint for threshold t of a part; for 1 on average."""
    return (1, 1 + width / 2)[t] if t < 2 else float(sum(comb(width, k) for k in range((t + 1) // 2 + 1)))


def expected_cost(values: np.ndarray, width: int, n: int, most: int) -> dict[int, float]:
    """Rows and comparisons for thresholds -1 to ``most`` of a part, for n fingerprints like those of the sample.

    A pair of distance d meets in as many buckets as the neighbourhoods of both have in common.
    """
    some = values[:PAIRED]
    apart = np.zeros(width + 1)
    for k in range(0, len(some), 100):  # small pieces: the driver holds little
        apart += np.bincount(np.bitwise_count(some[k : k + 100, None] ^ some[None, :]).ravel(), minlength=width + 1)
    apart[0] -= len(some)
    share = apart / max(1, len(some) * (len(some) - 1))
    pairs = [max(share[d], comb(width, d) / 2.0**width) * n * n / 2 for d in range(min(most, width) + 1)]
    row, pair = 40.0, 0.006  # as measured: some 10 us a row, 1.5 ns a comparison
    out = {-1: 0.0}
    for t in range(min(most, width) + 1):
        reach = (t + 1) // 2
        meet = [rows_for(width, t) if d == 0 else max(1.0, 2.0 * width ** max(0, reach - (d + 1) // 2)) for d in range(t + 1)]
        copies = max(1.0, n * rows_for(width, t) / 2.0**width / BLOCK)  # a row goes to each block of its bucket
        out[t] = n * row * rows_for(width, t) * copies + pair * sum(p * m for p, m in zip(pairs, meet, strict=False))
    return out


def thresholds(costs: list[dict[int, float]], total: int) -> tuple[float, list[int]]:
    """The cheapest thresholds with the given sum, by dynamic programming over the parts."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for have, (price, chosen) in best.items():
            for t, more in cost.items():
                if have + t not in step or price + more < step[have + t][0]:
                    step[have + t] = (price + more, [*chosen, t])
        best = step
    return best.get(total, (float("inf"), []))


def plan(sample: np.ndarray, n: int, radius: int = RADIUS) -> list[tuple[np.ndarray, int]]:
    """Parts with their thresholds, those of -1 left out."""
    if not len(sample):
        return []
    bits = ((sample[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.float64)
    found = (float("inf"), [])
    for m in range(1, radius + 2):
        parts = correlated_parts(bits, m)
        price, chosen = thresholds([expected_cost(part_values(sample, p), len(p), n, min(radius, 4)) for p in parts], radius - m + 1)
        if price < found[0]:
            found = (price, [(p, t) for p, t in zip(parts, chosen, strict=True) if t >= 0])
    return found[1]


def _neighbourhood(width: int, flips: int) -> np.ndarray:
    """What to flip to reach every value within so many bits, those of fewer bits first."""
    return np.array([sum(1 << k for k in c) for f in range(flips + 1) for c in combinations(range(width), f)], np.int64)


def _signatures(parts: list[tuple[np.ndarray, int]]):
    names = ["part", "key", "fp", "id", "n", "fp2", "home"]

    def rows(part: int, keys: np.ndarray, which: np.ndarray | slice, own: list[np.ndarray], home: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), part, np.int32)), pa.array(keys), *(pa.array(c[which]) for c in own), pa.array(np.full(len(keys), home, np.int32))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [batch.column(k).to_numpy() for k in range(4)]
            for i, (part, t) in enumerate(parts):
                keys = part_values(own[0].view(np.uint64), part)
                if t == 1:  # one of two values that differ in a bit has it set
                    yield rows(i, keys, slice(None), own, True)
                    for k in range(len(part)):
                        has = (keys >> k) & 1 == 1
                        yield rows(i, keys[has] ^ (1 << k), has, own, False)
                    continue
                flips = _neighbourhood(len(part), (t + 1) // 2)
                for flip in flips.tolist():  # two values within t meet where one has flipped t // 2 bits at most
                    yield rows(i, keys ^ flip, slice(None), own, flip.bit_count() <= t // 2)

    return run


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same components with one edge a node, to the component's smallest."""
    nodes, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        before = label.copy()
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        np.minimum.at(label, before, label)
        label = label[label]
        if (label == before).all():
            break
    far = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[far], nodes[label[far]]


def _near(group: np.ndarray, rows: list[np.ndarray], radius: int, ratio: float) -> tuple[np.ndarray, np.ndarray]:
    """Links within groups of rows (fp, id, n, fp2) that stand together: fingerprints within the radius, sizes within the ratio.

    With a ratio both fingerprints together must be within BOTH, which keeps chance links out.
    """
    a, b = [], []

    def close(x: list, y: list) -> np.ndarray:
        """Where rows x are close to rows y, or to the row y."""
        apart = np.bitwise_count(x[0] ^ y[0])
        at = np.flatnonzero(apart <= radius)
        if not ratio or not len(at):
            return at
        (second, size), (second_y, size_y) = ((c[3][at], c[2][at]) if np.ndim(c[0]) else (c[3], c[2]) for c in (x, y))
        near = apart[at] + np.bitwise_count(second ^ second_y) <= BOTH
        return at[near & (np.minimum(size, size_y) >= ratio * np.maximum(size, size_y))]

    edge = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    size = np.diff(np.append(edge, len(group)))
    for s, n in zip(edge[size > 256], size[size > 256], strict=True):  # breadth first: each row meets those not yet reached
        own = [c[s : s + n] for c in rows]
        while len(own[0]):
            front = [[c[0] for c in own]]
            own = [c[1:] for c in own]
            while front and len(own[0]):
                f = front.pop()
                hit = close(own, f)
                if len(hit):
                    b.append(own[1][hit])
                    a.append(np.full(len(b[-1]), f[1]))
                    front += map(list, zip(*(c[hit] for c in own), strict=True))
                    own = [np.delete(c, hit) for c in own]
    small = np.repeat(size <= 256, size)
    group, rows = group[small], [c[small] for c in rows]
    at = np.arange(len(group))
    for d in range(1, 256):
        at = at[at + d < len(group)]
        at = at[group[at] == group[at + d]]
        if not len(at):
            break
        hit = at[close([c[at] for c in rows], [c[at + d] for c in rows])]
        a.append(rows[1][hit])
        b.append(rows[1][hit + d])
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
    other = a != b
    return spanning(a[other], b[other])


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: int, rows: int) -> Iterator[list[np.ndarray]]:
    """Columns of rows that come ordered by their first ``keys`` columns, in parts that end between groups."""
    rest: list[np.ndarray] | None = None
    for batch in batches:
        own = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        rest = own if rest is None else [np.concatenate(x) for x in zip(rest, own, strict=True)]
        if len(rest[0]) < rows:
            continue
        last = np.ones(len(rest[0]), bool)
        for k in rest[:keys]:
            last &= k == k[-1]
        cut = int(np.argmax(last))
        if cut:
            yield [x[:cut] for x in rest]
            rest = [x[cut:] for x in rest]
    if rest is not None and len(rest[0]):
        yield rest


def _groups(keys: list[np.ndarray]) -> np.ndarray:
    """Numbers of the groups of equal keys."""
    change = np.zeros(len(keys[0]), bool)
    for k in keys:
        change[1:] |= k[1:] != k[:-1]
    return np.cumsum(change)


def _links(radius: int, ratio: float):
    """Links of rows that come ordered by bucket and pair of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in _whole_groups(batches, 1, 20_000):
            a, b = _near(_groups(own[:1]), [own[1].view(np.uint64), own[2], own[3], own[4].view(np.uint64)], radius, ratio)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = 42, both: bool = False) -> DataFrame:
    """id, fp (the 64 bits as a signed long), h (hash of the words) and, if ``both``, n (distinct shingles) and fp2 of every row."""
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return own.mapInArrow(_fingerprints(shingle, seed, both), "id long, fp long, n long, h long, fp2 long")


def _in_blocks(rows: DataFrame, keys: list[str], own: str, columns: list[str], hashed: bool = False) -> DataFrame:
    """Every row with column c, the number of its group's blocks, once for each pair (x, y) of blocks that its own is in; ordered for it.

    The keys and the pair, or a hash of them, come first.
    """
    block = F.pmod(F.xxhash64(own), F.col("c")).cast("int")
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.col("c") - 1), lambda x: F.struct(F.least(x, block).alias("x"), F.greatest(x, block).alias("y"))))
    met = rows.select(*keys, pair.alias("p"), *columns)
    if hashed:
        return met.select(F.xxhash64(*keys, "p").alias("g"), *columns).repartition("g").sortWithinPartitions("g")
    met = met.select(*keys, "p.x", "p.y", *columns)
    return met.repartition(*keys, "x", "y").sortWithinPartitions(*keys, "x", "y")


def links(distinct: DataFrame, radius: int = RADIUS, block: int = BLOCK, ratio: float = 0.0) -> DataFrame:
    """Edges a, b between ids that span the components of all pairs within the radius, whose n are within the ratio.

    ``distinct`` has fp, id, n and fp2.
    """
    size = distinct.count()
    sample = tw.hash_sample(distinct.select("fp"), "fp", size, SAMPLE).collect()
    parts = plan(np.array([r.fp for r in sample], np.int64).view(np.uint64), size, radius)
    rows = distinct.select("fp", "id", "n", "fp2").mapInArrow(_signatures(parts), "part int, key long, fp long, id long, n long, fp2 long, home int")
    live = rows.groupBy("part", "key").agg(F.count("*").alias("rows"), F.sum("home").alias("homes")).where("homes > 0 and rows > 1").drop("homes")
    if sum(2 ** len(p) for p, _ in parts) <= FEW_KEYS:
        live = F.broadcast(live)
    met = rows.join(live, ["part", "key"]).withColumn("c", F.ceil(F.col("rows") / block).cast("int"))
    # groups of buckets and blocks go by a hash: two that share it are only compared for nothing
    return _in_blocks(met, ["part", "key"], "fp", ["fp", "id", "n", "fp2"], True).mapInArrow(_links(radius, ratio), "a long, b long")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = 42, radius: int = RADIUS, block: int = BLOCK
) -> DataFrame:
    """id, fp, component of every row; links are fingerprints within the radius."""
    every = cut_lineage(fingerprints(docs, id_col, text_col, shingle, seed).select("id", "fp"))
    distinct = cut_lineage(every.where("id is not null").groupBy("fp").agg(F.min("id").alias("id")).withColumns({"n": F.lit(0).cast("long"), "fp2": F.lit(0).cast("long")}))
    # one id may stand for several fingerprints, if rows repeat it; that only joins what is one document anyway
    found = connected_components(links(distinct, radius, block))
    named = distinct.join(found.withColumnRenamed("node", "id"), "id", "left").select("fp", F.coalesce("component", "id").alias("component"))
    return every.join(named, "fp", "left").select("id", "fp", F.when(F.col("id").isNotNull(), F.col("component")).alias("component"))


def _verified(shingle: int, radius: int, similarity: float):
    """Links of at least the similarity among the texts of each pair of blocks: each row meets those not yet reached."""

    def group(fps: np.ndarray, ids: np.ndarray, texts: np.ndarray) -> Iterator[tuple[int, int]]:
        sets = []
        for t in texts:
            data = np.frombuffer(t.encode().lower(), np.uint8)
            starts, ends, _ = tw.spans(data, np.array([0, len(data)]))
            words = tw.sound_words(data, starts, ends)
            sets.append(np.unique(tw.grams(words, min(shingle, len(words)))) if len(words) else np.zeros(0, np.uint64))
        size = np.array([len(x) for x in sets])
        left = np.argsort(ids, kind="stable")
        while len(left):
            front, left = [left[0]], left[1:]
            while front and len(left):
                i = front.pop()
                near = (np.bitwise_count(fps[left] ^ fps[i]) <= radius) & (np.minimum(size[left], size[i]) >= similarity * np.maximum(size[left], size[i]))
                for k in np.flatnonzero(near).tolist():
                    both = len(np.intersect1d(sets[i], sets[left[k]], assume_unique=True))
                    near[k] = both >= similarity * (size[i] + size[left[k]] - both)
                front += left[near].tolist()
                yield from ((int(ids[i]), int(ids[k])) for k in left[near])
                left = left[~near]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in _whole_groups(batches, 3, 1):
            edge = np.flatnonzero(np.append(True, np.diff(_groups(own[:3])) > 0))
            found = [e for s, t in zip(edge, np.append(edge[1:], len(own[0])), strict=True) for e in group(own[3][s:t].view(np.uint64), own[4][s:t], own[5][s:t])]
            yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return run


def similar_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, radius: int = WIDE, seed: int = 42, block: int = BLOCK, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """id and component of every row: components of pairs whose sets of shingles have a Jaccard similarity of at least ``similarity``.

    Candidates are the pairs within the radius (wide enough for nearly all such pairs; README has the recall) with sizes that the
    similarity allows and second fingerprints that agree as well, so that chance links don't grow with the square of the table. Their components are cut into blocks, and within each pair of blocks the texts' shingles decide: each row
    meets those that no link has reached, so a group of copies costs its rows, not its pairs.
    """
    every = cut_lineage(fingerprints(docs, id_col, text_col, shingle, seed, True))
    kinds = cut_lineage(every.where("id is not null").groupBy("fp", "h").agg(F.min("id").alias("id"), F.min("n").alias("n"), F.min("fp2").alias("fp2")))
    met = connected_components(links(kinds, radius, block, similarity)).withColumnRenamed("node", "id")
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    own = own.where("text is not null").join(kinds.join(met, "id").select("id", "fp", "component"), "id")
    # sizes come from the fingerprints, so the texts are dealt twice only: to their ids and to their blocks
    number = kinds.join(met, "id").groupBy("component").agg(F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum(F.col("n") * 8) / block_bytes)).cast("int").alias("c"))
    edges = _in_blocks(own.join(number, "component"), ["component"], "id", ["fp", "id", "text"]).mapInArrow(_verified(shingle, radius, similarity), "a long, b long")
    found = connected_components(edges).withColumnRenamed("node", "id")
    named = kinds.join(found, "id", "left").select("fp", "h", F.coalesce("component", "id").alias("component"))
    return every.join(named, ["fp", "h"], "left").select("id", F.when(F.col("id").isNotNull(), F.col("component")).alias("component"))
