"""Operator 1: nearest neighbours by inner product with a forest of random-projection trees.

Index: vectors get one more component, sqrt(M^2 - |x|^2) with M the largest norm, so that the largest inner product is the
nearest vector. Each of up to ``TREES`` trees cuts space by random hyperplanes at medians of a bounded sample (``SAMPLE`` vectors,
fitted on the driver); every vector is then put into one leaf of each tree. Search: a query takes the leaves of all trees in
order of their margin; the number taken is the smallest that reaches ``RECALL`` on the sample, with as many of the trees as
make that cheapest, at every size of the table. With one tree no vector is multiplied twice for a query, so that products never
exceed those of brute force. Candidates of the taken leaves are ranked exactly, in double precision; a query takes more leaves
where these hold fewer vectors than it asks for.

Work is dealt by shelves, neighbouring leaves of a tree that together hold at most ``SHELF`` vectors: a query goes to a shelf
once, with the leaves that it takes there, and one list of its best comes back. A shelf of many vectors or queries is cut into
blocks of bounded size and all pairs of its blocks are searched, so no task holds a whole leaf. Equal vectors are indexed once,
with the k + 1 smallest of their ids, which is all that an answer can use.

Defined results: vectors that are null, zero, of another length than most, or hold null or non-finite components take no part
(as queries neither); rows that repeat an id and vector count once; a row with null id takes no part; empty tables give an
empty result. Equal scores go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm import words as tw
from siftwell.session import cut_lineage

#: Most trees, vectors that they are fitted on, the share of the sample's neighbours that the leaves taken must hold.
TREES, SAMPLE, RECALL = 8, 32_768, 0.98
#: Vectors of a leaf, by which the depth is chosen; most vectors of a shelf, most queries of its blocks, and shelves of a table that has no more vectors.
BLOCK, SHELF, QUERY_BLOCK, SHELVES = 2048, 16_384, 16_384, 48


@dataclass
class Forest:
    """Complete trees of one depth; node i has children 2i+1 and 2i+2."""

    normals: np.ndarray  # tree, node, component
    cuts: np.ndarray  # tree, node
    depth: int
    norm: float
    probes: int

    def extended(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Vectors as shares of the largest norm, with one component more; queries at unit length, which their order doesn't depend on."""
        if query:
            x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True), 5e-324)
            x = x / np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 5e-324)[:, None]
            return np.column_stack((x, np.zeros(len(x))))
        x = x / self.norm
        return np.column_stack((x, np.sqrt(np.maximum(1 - np.einsum("ij,ij->i", x, x), 0))))

    def first(self, trees: int) -> Forest:
        return Forest(self.normals[:trees], self.cuts[:trees], self.depth, self.norm, trees << self.depth)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The cell (tree * leaves + leaf) of each vector in each tree."""
        x, out = self.extended(x, False), []
        for t in range(len(self.normals)):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                side = np.einsum("ij,ij->i", x, self.normals[t, node]) >= self.cuts[t, node]
                node = 2 * node + 1 + side
            out.append((t << self.depth) + node - (1 << self.depth) + 1)
        return np.column_stack(out)

    def order(self, x: np.ndarray) -> np.ndarray:
        """All cells for each query, by the largest margin on their far side."""
        trees, nodes = self.cuts.shape
        margin = (self.extended(x, True) @ self.normals.reshape(trees * nodes, -1).T - self.cuts.ravel()).reshape(len(x), trees, nodes)
        worst = np.full((len(x), trees, 1), -np.inf)
        for level in range(self.depth):
            m = margin[:, :, (1 << level) - 1 : (2 << level) - 1]
            below = np.empty((len(x), trees, 2 << level))
            below[..., 0::2] = np.where(m >= 0, np.maximum(worst, m), worst)
            below[..., 1::2] = np.where(m >= 0, worst, np.maximum(worst, -m))
            worst = below
        return np.argsort(worst.reshape(len(x), -1), axis=1, kind="stable")

    def search(self, x: np.ndarray, sizes: np.ndarray | None = None, least: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Rows and cells: the first cells of each query, in an order that all trees share.

        With ``sizes`` of the cells a query goes on until the cells of one tree hold ``least`` vectors, or all do.
        """
        trees = len(self.cuts)
        total = trees << self.depth
        rows, cells = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        piece = max(1, (1 << 20) // total)
        for a in range(0, len(x), piece):
            order = self.order(x[a : a + piece])
            found = np.full(len(order), min(self.probes, total))
            if sizes is not None:
                held, reach = sizes[order], np.full(len(order), total)
                for t in range(trees):
                    enough = np.cumsum(np.where(order >> self.depth == t, held, 0), axis=1) >= least
                    reach = np.minimum(reach, np.where(enough[:, -1], enough.argmax(axis=1) + 1, total))
                found = np.maximum(found, reach)
            rows.append(np.repeat(np.arange(a, a + len(order)), found))
            cells.append(order[np.arange(total) < found[:, None]])
        return np.concatenate(rows), np.concatenate(cells)


def shelves(sizes: np.ndarray, trees: int, most: int) -> np.ndarray:
    """A number for each cell: neighbouring cells of a tree stand together while they hold at most so many vectors."""
    out, own, held = np.zeros(len(sizes), np.int64), -1, 0
    for cell, n in enumerate(sizes.tolist()):
        if cell % (len(sizes) // trees) == 0 or held + n > most:
            own, held = own + 1, 0
        out[cell], held = own, held + n
    return out


def fit(sample: np.ndarray, norm: float, depth: int, k: int, trees: int = TREES, recall: float = RECALL, seed: int = 7) -> Forest:
    """Trees from the sample, and the number of leaves that reaches the recall on it."""
    rng = np.random.default_rng(seed)
    nodes = (1 << depth) - 1
    forest = Forest(np.zeros((trees, nodes, sample.shape[1] + 1)), np.zeros((trees, nodes)), depth, norm, trees << depth)
    x = forest.extended(sample, False)
    for t in range(trees):
        at = np.zeros(len(x), np.int64)
        for level in range(depth):
            for node in range((1 << level) - 1, (2 << level) - 1):
                own = np.flatnonzero(at == node)
                normal = rng.normal(size=x.shape[1])
                if len(own) > 1:
                    a, b = x[rng.choice(own, 2, replace=False)]
                    if np.linalg.norm(a - b) > 0:
                        normal = a - b
                normal /= np.linalg.norm(normal)
                along = x[own] @ normal
                forest.normals[t, node], forest.cuts[t, node] = normal, np.median(along) if len(own) else 0.0
                at[own] = 2 * node + 1 + (along >= forest.cuts[t, node])
    if len(sample) < 2:
        return forest
    k = min(k, len(sample) - 1)
    asked = rng.choice(len(sample), min(300 if depth < 9 else 100, len(sample)), replace=False)
    scores = forest.extended(sample[asked], True)[:, :-1] @ x[:, :-1].T
    scores[np.arange(len(asked)), asked] = -np.inf
    best = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    options = []
    for own in {trees, max(1, trees // 2), max(1, trees // 4), 1}:
        some = forest.first(own)
        cells, order = some.leaves(sample), some.search(sample[asked])[1].reshape(len(asked), -1)
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(order.shape[1])[None, :], axis=1)
        needed = np.sort(np.stack([place[i, cells[b]].min(axis=1) for i, b in enumerate(best)]).ravel())
        some.probes = int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) + 1
        options.append(some)
    return min(options, key=lambda f: (f.probes, -len(f.cuts)))  # every leaf holds as many vectors


def _vectors(column: pa.Array) -> np.ndarray:
    """Rows of equal length."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _packed(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)


def _distinct(keep: int):
    """Equal vectors of a batch, with their smallest ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = batch.column(0).to_numpy(), np.ascontiguousarray(_vectors(batch.column(1)).astype(np.float64) + 0.0)
            raw = x.view(f"V{x.shape[1] * 8}").ravel()
            groups: dict[bytes, list[int]] = {}
            for i, r in zip(ids.tolist(), raw.tolist(), strict=True):
                groups.setdefault(r, []).append(i)
            own = [sorted(set(v))[:keep] for v in groups.values()]
            yield pa.RecordBatch.from_arrays([pa.array(groups.keys(), pa.binary()), pa.array(own, pa.list_(pa.int64()))], names=["vec", "ids"])

    return run


def _block(ids: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    return (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.int64) % np.maximum(blocks, 1)


def _copies(times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row so many times, and the number of the copy."""
    at = np.repeat(np.arange(len(times)), times)
    return at, np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)


def _place(forest: Forest, shelf_of: np.ndarray, blocks: np.ndarray, query_blocks: np.ndarray):
    """Each vector in each of its cells, once for every block of the shelf's queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                part = batch.slice(a, 2048)
                cells = forest.leaves(_packed(part.column(0)))
                row, cell = np.repeat(np.arange(len(cells)), cells.shape[1]), cells.ravel()
                shelf = shelf_of[cell]
                first = part.column(1).flatten().take(pa.array(part.column(1).offsets.to_numpy()[:-1] - part.column(1).offsets[0].as_py())).to_numpy()
                block = _block(first[row], blocks[shelf])
                at, other = _copies(query_blocks[shelf])
                take = pa.array(row[at])
                columns = [pa.array(v) for v in (shelf[at], block[at], other, cell[at])]
                yield pa.RecordBatch.from_arrays([*columns, part.column(0).take(take), part.column(1).take(take)], names=["shelf", "block", "qblock", "cell", "vec", "ids"])

    return run


def _taken(forest: Forest, x: np.ndarray, shelf_of: np.ndarray, sizes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, pa.ListArray]:
    """Queries, shelves and the cells that the query takes there."""
    row, cell = forest.search(x, sizes, least)
    key = row * (shelf_of[-1] + 1) + shelf_of[cell]
    order = np.argsort(key, kind="stable")
    start = np.flatnonzero(np.diff(key[order], prepend=-1))
    lists = pa.ListArray.from_arrays(pa.array(np.append(start, len(key)), pa.int32()), pa.array(cell[order]))
    return row[order][start], shelf_of[cell[order][start]], lists


def _probe(forest: Forest, shelf_of: np.ndarray, sizes: np.ndarray, least: int, blocks: np.ndarray, query_blocks: np.ndarray):
    """Each query in each of its shelves, once for every block of the shelf's vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                ids, x = part.column(0).to_numpy(), np.ascontiguousarray(_vectors(part.column(1)).astype(np.float64))
                row, shelf, cells = _taken(forest, x, shelf_of, sizes, least)
                qblock = _block(ids[row], query_blocks[shelf])
                at, other = _copies(blocks[shelf])
                packed = pa.array([v.tobytes() for v in x], pa.binary()).take(pa.array(row[at]))
                columns = [pa.array(v) for v in (shelf[at], other, qblock[at], ids[row[at]])]
                yield pa.RecordBatch.from_arrays([*columns, packed, cells.take(pa.array(at))], names=["shelf", "block", "qblock", "qid", "qvec", "cells"])

    return run


BEST = pa.list_(pa.struct([("less", pa.float64()), ("id", pa.int64())]))


def _exact(x: np.ndarray, q: np.ndarray, at: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Products from the first component to the last."""
    parts = [np.add.accumulate(x[at[a : a + 8192]] * q[row[a : a + 8192]], axis=1)[:, -1] for a in range(0, len(at), 8192)]
    return np.nan_to_num(np.concatenate(parts), nan=-np.inf, posinf=np.inf, neginf=-np.inf)


def _first_of(row: np.ndarray, most: int, *columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first rows of each query by the columns (the least important one first), and their places."""
    order = np.lexsort((*columns, row))
    row = row[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return order[place < most], place[place < most]


def _rank(k: int):
    """The k best of a block of vectors for each of a block of queries, in the cells that it takes; scores are computed row by row in one order."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            left = left.sort_by("cell")
            ids = left.column("ids").combine_chunks()
            x, starts, lengths, flat = _packed(left.column("vec").combine_chunks()), ids.offsets.to_numpy()[:-1], np.diff(ids.offsets.to_numpy()), ids.values.to_numpy()
            first = flat[starts]
            cells, begin = np.unique(left.column("cell").to_numpy(), return_index=True)
            # a large cell in pieces, as all of its scores may be equal
            pieces = [(c, i, min(i + BLOCK, e)) for c, (b, e) in enumerate(zip(begin, np.append(begin[1:], len(x)), strict=True)) for i in range(b, e, BLOCK)]
            # what rounding can move a sum of products by, at most
            long = np.sqrt(np.einsum("ij,ij->i", x, x)).max()
            for a in range(0, right.num_rows, 512):
                part = right.slice(a, 512).combine_chunks()
                asked, q = part.column("qid").to_numpy(), _packed(part.column("qvec").combine_chunks())
                doubt = np.sqrt(np.einsum("ij,ij->i", q, q)) * long * (4 * x.shape[1] * np.finfo(float).eps)
                own = part.column("cells").combine_chunks()
                cell = own.flatten().to_numpy()
                at = np.searchsorted(cells, cell)
                here = cells[np.minimum(at, len(cells) - 1)] == cell
                takes = np.zeros((len(q), len(cells)), bool)
                takes[np.repeat(np.arange(len(q)), np.diff(own.offsets.to_numpy()))[here], at[here]] = True
                row, vec, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
                edge = np.full(len(q), -np.inf)  # the score that the k + 1 best so far have; the query itself may be one of them
                for c, b, e in pieces:
                    some = np.flatnonzero(takes[:, c])
                    if not len(some):
                        continue
                    rough, least = q[some] @ x[b:e].T, edge[some]
                    new = least == -np.inf
                    if e - b > k and new.any():
                        least[new] = np.partition(np.nan_to_num(rough[new], nan=-np.inf, posinf=np.inf, neginf=-np.inf), e - b - k - 1, axis=1)[:, e - b - k - 1]
                    r, v = np.nonzero(~(rough < (least - doubt[some])[:, None]))  # sums that overflow are looked at too
                    if not len(r):
                        continue
                    r, v = some[r], v + b
                    row, vec, score = np.append(row, r), np.append(vec, v), np.append(score, _exact(x, q, v, r))
                    keep, place = _first_of(row, k + 1, first[vec], -score)
                    row, vec, score = row[keep], vec[keep], score[keep]
                    edge[row[place == k]] = score[place == k]
                # equal vectors give all of their ids
                at, copy = _copies(lengths[vec])
                row, score, number = row[at], score[at], flat[starts[vec][at] + copy]
                other = number != asked[row]
                row, score, number = row[other], score[other], number[other]
                keep, _ = _first_of(row, k, number, -score)
                found = pa.StructArray.from_arrays([pa.array(-score[keep]), pa.array(number[keep])], fields=list(BEST.value_type))
                offsets = np.searchsorted(row[keep], np.arange(len(q) + 1))
                out.append(pa.table([pa.array(asked), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), found, type=BEST)], names=["qid", "best"]))
        return pa.concat_tables(out) if out else pa.table([pa.array([], pa.int64()), pa.array([], BEST)], names=["qid", "best"])

    return run


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    own = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec")).where("id is not null")
    good = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    return own.where(F.coalesce(good, F.lit(False)))


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), the neighbour's id and score for each row of ``queries`` against all of ``vectors``."""
    names = f"query_id long, rank int, {id_col} long, score double"
    every, asked = usable(vectors, id_col, vec_col), usable(queries, id_col, vec_col)
    sizes = every.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if sizes is None:
        return vectors.sparkSession.createDataFrame([], names)
    every, asked = (x.where(F.size("vec") == sizes.d) for x in (every, asked))
    packed = every.mapInArrow(_distinct(k + 1), "vec binary, ids array<long>")
    # two steps: one vector that is most of the table gathers short lists only
    salted = packed.groupBy("vec", F.pmod(F.spark_partition_id(), F.lit(64)).alias("salt")).agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids"))
    distinct = cut_lineage(salted.groupBy("vec").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids")))
    n = distinct.count()
    largest = every.agg(F.max(F.array_max(F.transform("vec", lambda x: F.abs(x.cast("double")))))).first()[0]
    # in two factors, as squares of large components overflow
    norm = largest * every.agg(F.max(F.aggregate("vec", F.lit(0.0), lambda a, x: a + (x.cast("double") / largest) * (x.cast("double") / largest)))).first()[0] ** 0.5
    sample = tw.hash_sample(distinct.select("vec"), "vec", n, SAMPLE).collect()
    x = np.frombuffer(b"".join(r.vec for r in sample), np.float64).reshape(-1, sizes.d)
    depth = max(6, min(12, int(np.ceil(np.log2(max(1, n / BLOCK))))))
    forest = fit(x, norm, depth, k)
    trees, least = len(forest.cuts), k + 1

    def counted(df: DataFrame, column: str, find, number: int) -> np.ndarray:
        """Rows of each cell or shelf; their number is a constant of the forest."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a in range(0, batch.num_rows, 2048):
                    column = batch.column(0).slice(a, 2048)
                    own = _packed(column) if pa.types.is_binary(column.type) else _vectors(column).astype(np.float64)
                    place, times = np.unique(find(own), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(times)], names=["place", "n"])

        out = np.zeros(number, np.int64)
        for r in df.select(column).mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect():
            out[r.place] = r.n
        return out

    sizes = counted(distinct, "vec", forest.leaves, trees << depth)
    shelf_of = shelves(sizes, trees, min(SHELF, -(-n * trees // SHELVES)))
    blocks = -(-np.bincount(shelf_of, sizes).astype(np.int64) // SHELF)
    query_blocks = -(-counted(asked, "vec", lambda x: _taken(forest, x, shelf_of, sizes, least)[1], len(blocks)) // QUERY_BLOCK)
    left = distinct.mapInArrow(_place(forest, shelf_of, blocks, query_blocks), "shelf long, block long, qblock long, cell long, vec binary, ids array<long>")
    right = asked.select("id", "vec").mapInArrow(_probe(forest, shelf_of, sizes, least, blocks, query_blocks), "shelf long, block long, qblock long, qid long, qvec binary, cells array<long>")
    keys = ("shelf", "block", "qblock")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_rank(k), "qid long, best array<struct<less:double,id:long>>")
    every_list = found.groupBy("qid").agg(F.array_sort(F.flatten(F.collect_list("best"))).alias("all"))
    # what several trees find stands side by side; array_distinct would compare all pairs
    best = every_list.select("qid", F.slice(F.filter("all", lambda x, i: (i == 0) | (x != F.get("all", i - 1))), 1, k).alias("best"))
    out = best.select(F.col("qid").alias("query_id"), F.posexplode("best").alias("at", "b"))
    return out.select("query_id", (F.col("at") + 1).alias("rank"), F.col("b.id").alias(id_col), (-F.col("b.less")).alias("score"))
