"""Operator 13: alignment of two tokenizers' tokens, with counts of linked ids in id-striped dense matrices.

Both tokenizers encode a text; byte offsets where a token of either ends cut it into *groups*. A token of A and one of B are
*linked* where their bytes overlap. The count of an id pair is the number of documents that hold it linked; a link is *best* where no
other B id has a higher count with its A id.

1. One pass encodes the texts. A text is cut into units at single spaces between other characters: the byte-level pattern begins a
   match there, and no piece of B has a space behind another character, so both tokenizers cut there too and units are encoded and
   aligned by themselves; each distinct unit that a task meets once. A piece of texts gives one row a document and, for each *stripe*
   of A ids, one packed block: its distinct (A id, B id) pairs with their numbers of documents, and which document holds how
   many links of which pair. Only this pass reads the texts; its rows go to the shared folder.
2. Blocks are partitioned by stripe and salt. A task adds the documents of the pairs with ``np.add.at`` to the stripe's dense matrix (A ids of
   the stripe by all B ids) and sends on what isn't zero; these partial matrices are added up by stripe in the same way, and row
   maxima give each A id its highest count.
3. The counted pairs of a stripe go to each of its salts, where the blocks' links are (the same partitioning), ahead of them: a task
   holds one stripe's matrix and scores block by block. Sums by document are the only thing that is grouped by row.

The number of salts rises with the number of pieces, so a task reads at most ``BLOCKS`` blocks of a stripe. All aggregates are sums of
what documents hold, no pair of documents is formed, and nothing but the number of pieces reaches the driver.

Defined results: texts that are null, empty, or whose tokens' bytes aren't those of space + text under both tokenizers have no tokens,
no groups and no links. Every row is a document, also where ids are null or repeated. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm import words as tw
from siftwell.session import cut_lineage

STRIPES, BLOCKS, CACHE, CACHE_BYTES, RUN = 128, 4096, 200_000, 64 << 20, 64
#: Bytes of text in one piece, and B ids that a pair's code leaves room for.
PIECE, WIDE = 8 << 20, 1 << 24
UNIT = re.compile(r"(?<=\S)(?= \S)")
SCHEMA = "id long, row long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, stripe int, pairs binary, links binary"


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: printable ones as they are, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """Tokens of a byte-level vocabulary (.json): special strings are plain text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        self.model.encode_special_tokens = True
        self.size = self.model.get_vocab_size()
        letters = byte_letters()
        self.bytes = [b""] * self.size
        for token, i in self.model.get_vocab().items():
            self.bytes[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.model.encode_batch_fast(texts, add_special_tokens=False)]


class Pieces:
    """Tokens of a piece vocabulary (.model) that puts a space before the text itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.model.get_piece_size()
        names = [self.model.id_to_piece(i) for i in range(self.size)]
        self.bytes = [bytes([int(t[3:-1], 16)]) if self.model.is_byte(i) else t.replace("▁", " ").encode() for i, t in enumerate(names)]
        if any("▁" in t.lstrip("▁") for i, t in enumerate(names) if not self.model.is_control(i)):
            raise ValueError("pieces must not hold a space behind another character")

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode([t[1:] for t in texts], num_threads=1)  # the model adds the first space


@functools.lru_cache(maxsize=2)
def tokenizers(a: str, b: str) -> tuple[ByteLevel, Pieces]:
    return ByteLevel(a), Pieces(b)


class Units:
    """What the units met so far align to: counts, the text of their groups, and the codes of their links."""

    def __init__(self, a: ByteLevel, b: Pieces):
        self.a, self.b = a, b
        self.names_a, self.names_b = ([str(i) for i in range(t.size)] for t in (a, b))
        self.size_a, self.size_b = (np.array([len(x) for x in t.bytes], np.int64) for t in (a, b))
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.groups: list[str | None] = []  # None: bytes differ
        self.counts = np.zeros((0, 3), np.int64)  # A tokens, B tokens, groups
        self.codes = np.zeros(1 << 16, np.int64)
        self.start = np.zeros(1, np.int64)
        self.held = 0

    def _encoded(self, texts: list[str]) -> list[tuple[list[int], list[int]] | None]:
        """Ids of both, or None where their bytes aren't the text."""
        out = []
        for text, a, b in zip(texts, self.a.encode(texts), self.b.encode(texts), strict=True):
            raw = text.encode()
            same = b"".join(map(self.a.bytes.__getitem__, a)) == raw and b"".join(map(self.b.bytes.__getitem__, b)) == raw
            out.append((a, b) if same else None)
        return out

    def _learn(self, new: list[str]) -> None:
        """All new units in one go. Most are encoded many in a row, as they would stand in a text; their bytes tell them apart again."""
        whole = [u for u in new if not (u[1].isspace() or u[-1].isspace())]
        runs = [whole[i : i + RUN] for i in range(0, len(whole), RUN)]
        flat, known = [], []
        single = [u for u in new if u[1].isspace() or u[-1].isspace()]
        for run, ids in zip(runs, self._encoded(list(map("".join, runs))), strict=True):
            if ids is None:
                single += run
            else:
                flat.append(ids)
                known += run
        unknown = []
        for unit, ids in zip(single, self._encoded(single), strict=True):
            if ids is None:
                unknown.append(unit)
            else:
                flat.append(ids)
                known.append(unit)
        last = np.cumsum(np.fromiter((len(u.encode()) for u in known), np.int64, len(known)))
        a, b = (np.fromiter(chain.from_iterable(ids[i] for ids in flat), np.int64) for i in range(2))
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        ends = np.union1d(ends_a, ends_b)  # between two of these lies one pair of tokens that overlap
        codes = a[np.searchsorted(ends_a, ends)] * WIDE + b[np.searchsorted(ends_b, ends)]
        cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
        n_a, n_b, n_cuts, sizes = (np.diff(np.searchsorted(x, last, side="right"), prepend=0) for x in (ends_a, ends_b, cuts, ends))
        names_a, names_b = ([names[i] for i in ids.tolist()] for names, ids in ((self.names_a, a), (self.names_b, b)))
        to_a, to_b = ((np.searchsorted(x, cuts) + 1).tolist() for x in (ends_a, ends_b))
        parts = [
            names_a[x] + "|" + names_b[y] if u == x + 1 and v == y + 1 else ",".join(names_a[x:u]) + "|" + ",".join(names_b[y:v])
            for x, u, y, v in zip([0, *to_a], to_a, [0, *to_b], to_b, strict=False)
        ]
        edges = np.cumsum(n_cuts).tolist()
        self.groups += [";".join(parts[x:y]) for x, y in zip([0, *edges], edges, strict=False)] + [None] * len(unknown)
        self.place.update(zip([*known, *unknown], range(len(self.place), len(self.place) + len(new)), strict=True))
        self.counts = np.concatenate((self.counts, np.stack((n_a, n_b, n_cuts), axis=1), np.zeros((len(unknown), 3), np.int64)))
        used = int(self.start[-1])
        if used + len(codes) > len(self.codes):
            self.codes = np.concatenate((self.codes[:used], np.zeros(used + 2 * len(codes), np.int64)))
        self.codes[used : used + len(codes)] = codes
        self.start = np.concatenate((self.start, used + np.cumsum(sizes), np.full(len(unknown), used + len(codes))))
        self.held += 64 * len(new) + 2 * sum(map(len, new)) + 16 * (len(a) + len(b))

    def align(self, texts: list[str | None]):
        """Per text A tokens, B tokens, groups, links and the groups' text; the codes of all links, text after text."""
        if len(self.place) > CACHE or self.held > CACHE_BYTES:
            self.clear()
        split = [UNIT.split(" " + t) if t else [] for t in texts]
        new = list({u for own in split for u in own}.difference(self.place))
        if new:
            self._learn(new)
        at = [[self.place[u] for u in own] for own in split]
        out = np.zeros((len(texts), 4), np.int64)
        digests: list[str] = []
        keep = []
        for i, own in enumerate(at):
            names = [self.groups[j] for j in own]
            if not own or None in names:
                digests.append("")
                continue
            digests.append(hashlib.sha256(";".join(names).encode()).hexdigest())
            own = np.array(own, np.int64)
            out[i, :3] = self.counts[own].sum(axis=0)
            size = self.start[own + 1] - self.start[own]
            edge = np.cumsum(size)
            out[i, 3] = edge[-1]
            keep.append(self.codes[np.arange(int(edge[-1])) + np.repeat(self.start[own] - (edge - size), size)])
        return out, digests, np.concatenate(keep) if keep else np.zeros(0, np.int64)


_codec = pa.Codec("zstd", 1)


def packed(*arrays: np.ndarray) -> bytes:
    """Integer arrays, each in the smallest type that holds it, compressed together."""
    out = []
    for a in arrays:
        top = int(a.max()) if len(a) else 0
        kind = next(t for t, most in (("u1", 1 << 8), ("u2", 1 << 16), ("u4", 1 << 32), ("u8", 1 << 64)) if top < most)
        out.append(np.array([len(a), int(kind[1])], "<u8").tobytes() + a.astype("<" + kind).tobytes())
    raw = b"".join(out)
    return len(raw).to_bytes(8, "little") + _codec.compress(raw, asbytes=True)


def unpacked(data: bytes) -> list[np.ndarray]:
    raw = _codec.decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)
    at, out = 0, []
    while at < len(raw):
        n, width = np.frombuffer(raw, "<u8", 2, at).tolist()
        out.append(np.frombuffer(raw, f"<u{width}", n, at + 16).astype(np.int64))
        at += 16 + n * width
    return out


def blocks(lengths: np.ndarray, codes: np.ndarray, stripes: int) -> Iterator[tuple[int, bytes, bytes]]:
    """The packed blocks of a piece, by stripe: pairs (codes' steps, documents that hold them) and links (document, number of links)."""
    rows = np.repeat(np.arange(len(lengths)), lengths)
    order = np.lexsort((rows, codes, (codes // WIDE) % stripes))
    codes, rows = codes[order], rows[order]
    fresh = np.ones(len(codes), bool)
    fresh[1:] = (codes[1:] != codes[:-1]) | (rows[1:] != rows[:-1])
    at = np.flatnonzero(fresh)
    times = np.diff(np.append(at, len(codes)))
    codes, rows = codes[at], rows[at]
    stripe = (codes // WIDE) % stripes
    edges = np.flatnonzero(np.append(True, stripe[1:] != stripe[:-1])) if len(stripe) else np.zeros(0, np.int64)
    for a, b in zip(edges, np.append(edges[1:], len(codes)), strict=True):
        own = codes[a:b]
        first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        documents = np.diff(np.append(first, len(own)))
        yield int(stripe[a]), packed(np.diff(own[first], prepend=0), documents), packed(rows[a:b], times[a:b])


def _aligned(a: str, b: str, stripes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = Units(*tokenizers(a, b))
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        kinds = [pa.int64()] * 6 + [pa.string(), pa.int32(), pa.binary(), pa.binary()]
        number = TaskContext.get().partitionId() << 38
        for batch in batches:
            texts = batch.column(1)
            offs, _ = tw.buffers(texts)
            for lo, hi in tw.pieces(offs, PIECE):
                out, digests, found = [], [], []
                for c, d in tw.pieces(offs[lo : hi + 1], 1 << 19):
                    counts, own, codes = units.align([texts[i].as_py() for i in range(lo + c, lo + d)])
                    out.append(counts)
                    digests += own
                    found.append(codes)
                counts, n = np.concatenate(out), hi - lo
                row = number + np.arange(n)
                columns = [batch.column(0).slice(lo, n), pa.array(row), *(pa.array(counts[:, i]) for i in range(4)), pa.array(digests)]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.nulls(n, t) for t in kinds[7:])], names=names)
                made = list(blocks(counts[:, 3], np.concatenate(found), stripes))
                if made:
                    m = len(made)
                    columns = [pa.nulls(m, pa.int64()), pa.array(np.full(m, number)), *(pa.nulls(m, t) for t in kinds[2:7])]
                    columns += [pa.array([x[i] for x in made], t) for i, t in enumerate(kinds[7:])]
                    yield pa.RecordBatch.from_arrays(columns, names=names)
                number += n

    return run


class Stripe:
    """One stripe's dense matrix: its A ids (those with the same remainder) by all B ids."""

    def __init__(self, stripe: int, stripes: int, size_a: int, size_b: int):
        self.stripe, self.stripes = stripe, stripes
        self.count = np.zeros((-(-(size_a - stripe) // stripes), size_b), np.int64)
        self.met = np.zeros(len(self.count), bool)

    def place(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return codes // WIDE // self.stripes, codes % WIDE

    def add(self, codes: np.ndarray, n: np.ndarray) -> None:
        at = self.place(codes)
        np.add.at(self.count, at, n)
        self.met[at[0]] = True

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes, in their order, counts, and which counts are their row's maximum, of all pairs met."""
        rows = np.flatnonzero(self.met)
        own = self.count[rows]
        best = own.max(axis=1, initial=0)
        at_a, at_b = np.nonzero(own)
        n = own[at_a, at_b]
        return (rows[at_a] * self.stripes + self.stripe) * WIDE + at_b, n, n == best[at_a]


def _counted(stripes: int, size_a: int, size_b: int):
    """Adds up rows of (stripe, salt, pairs) that come stripe by stripe and salt by salt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = None, None

        def done():
            codes, n, top = held.pairs()
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([packed(np.diff(codes, prepend=0), n, top)], pa.binary())], names=["stripe", "pairs"])

        for batch in batches:
            for stripe, salt, data in zip(*(batch.column(i) for i in range(3)), strict=True):
                own = (stripe.as_py(), salt.as_py())
                if own != key:
                    if held is not None:
                        yield done()
                    held, key = Stripe(own[0], stripes, size_a, size_b), own
                steps, n = unpacked(data.as_py())[:2]
                held.add(np.cumsum(steps), n)
        if held is not None:
            yield done()

    return run


def _scored(stripes: int, size_a: int, size_b: int):
    """Sums by row, from blocks that follow their stripe's counted pairs (those have no links)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = best = None
        for batch in batches:
            for row, stripe, pairs, links in zip(*(batch.column(i) for i in range(4)), strict=True):
                steps, n, *more = unpacked(pairs.as_py())
                codes = np.cumsum(steps)
                if not links.is_valid:
                    held = Stripe(stripe.as_py(), stripes, size_a, size_b)
                    held.add(codes, n)
                    top = more[0] > 0
                    best = np.zeros(len(held.count), np.int64)
                    best[held.place(codes[top])[0]] = n[top]
                    continue
                at_a, at_b = held.place(codes)
                count = held.count[at_a, at_b]
                top = (count == best[at_a]).astype(np.int64)
                rows, times = unpacked(links.as_py())
                order = np.argsort(rows, kind="stable")
                rows, weight = rows[order], times[order]
                first = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
                sums = [np.add.reduceat(np.repeat(x, n)[order] * weight, first) for x in (top, count)]
                yield pa.RecordBatch.from_arrays([pa.array(row.as_py() + rows[first]), *map(pa.array, sums)], names=["row", "n_best", "count_sum"])

    return run


def _salted(rows: DataFrame, *order: str) -> DataFrame:
    return rows.repartition("stripe", "salt").sortWithinPartitions("stripe", "salt", *order)


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", stripes: int = STRIPES, per_salt: int = BLOCKS) -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row."""
    return _align(docs, path_a, path_b, id_col, text_col, stripes, per_salt)[0]


def _align(docs, path_a, path_b, id_col, text_col, stripes, per_salt) -> tuple[DataFrame, DataFrame]:
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sizes = tuple(t.size for t in tokenizers(path_a, path_b))
    made = cut_lineage(own.mapInArrow(_aligned(path_a, path_b, stripes), SCHEMA))
    pieces = made.where("stripe is not null").agg(F.count_distinct("row")).first()[0]
    salts = max(1, -(-pieces // per_salt))
    block = made.where("stripe is not null").select("row", "stripe", (F.abs(F.xxhash64("row")) % salts).cast("int").alias("salt"), "pairs", "links")
    part = _salted(block.select("stripe", "salt", "pairs")).mapInArrow(_counted(stripes, *sizes), "stripe int, pairs binary")
    if salts > 1:  # partial matrices of one stripe
        part = _salted(part.select("stripe", F.lit(0).alias("salt"), "pairs")).mapInArrow(_counted(stripes, *sizes), "stripe int, pairs binary")
    counted = cut_lineage(part)
    ahead = counted.select(F.lit(-1).cast("long").alias("row"), "stripe", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), "pairs", F.lit(None).cast("binary").alias("links"))
    scored = _salted(ahead.unionAll(block), "row").select("row", "stripe", "pairs", "links").mapInArrow(_scored(stripes, *sizes), "row long, n_best long, count_sum long")
    sums = scored.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    none = F.lit(0).cast("long")
    out = made.where("stripe is null").join(sums, "row", "left")
    out = out.select("id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", none).alias("n_best"), F.coalesce("count_sum", none).alias("count_sum"), "groups_sha256")
    return out, counted


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data in batch.column(0):
            steps, n, top = unpacked(data.as_py())
            codes = np.cumsum(steps)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (codes // WIDE, codes % WIDE, n, top > 0)], names=["id_a", "id_b", "documents", "best"])


def linked_ids(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", stripes: int = STRIPES, per_salt: int = BLOCKS) -> DataFrame:
    """id_a, id_b, documents (that hold the pair linked) and best, one row a linked pair of ids."""
    counted = _align(docs, path_a, path_b, id_col, text_col, stripes, per_salt)[1]
    return counted.select("pairs").mapInArrow(_listed, "id_a long, id_b long, documents long, best boolean")
