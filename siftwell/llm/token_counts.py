"""Operator 6: token counts as the library of a vocabulary gives them, with overlap resynchronisation for huge texts.

Ordinary texts go to the library whole, in small batches. A text of over ``chunk`` characters is encoded in overlapping chunks
with offsets. Two neighbours are spliced at a position where both begin a new pre-token (the library's word number changes):
the pre-tokenizer's pattern looks only ahead, so from a common beginning on both cut alike, and merges never cross a
pre-token. On the left the last pre-tokens are not trusted, as their continuation is cut off. Where the overlap has no common
beginning it is doubled, at last up to the whole left chunk, which then is one chunk with a right one that is four times
as long each time, so that the work for a word of any length is in proportion to it. Memory is bounded by chunks, or by the longest stretch without a boundary, and the count
is that of the whole text.

Special strings inside texts are tokens, as is the library's default; a chunk border inside one has no common beginning
there. Defined results: null counts as an empty text; ids (null, repeated) are carried along.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm import words as tw

CHUNK, OVERLAP, DISTRUST = 1 << 15, 512, 3


@functools.lru_cache(maxsize=2)
def tokenizer(path: str):
    """encode(list of texts) -> token counts, and the offsets and word numbers of one text."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return (lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]), None
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()

    def parts(text: str) -> tuple[np.ndarray, np.ndarray]:
        """Where tokens begin, and which of them begin a pre-token."""
        made = model.encode(text, add_special_tokens=False)
        starts = np.fromiter((a for a, _ in made.offsets), np.int64, len(made))
        numbers = np.array([-1 if w is None else w for w in made.word_ids], np.int64)
        fresh = np.ones(len(made), bool)
        fresh[1:] = (numbers[1:] != numbers[:-1]) | (numbers[1:] < 0)
        return starts, fresh

    return (lambda texts: [len(x) for x in model.encode_batch_fast(texts, add_special_tokens=False)]), parts


def spliced_count(text: str, parts, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of the whole text, from chunks that overlap."""
    total, own_from, start, end, step = 0, 0, 0, min(len(text), chunk), chunk
    starts, fresh = parts(text[start:end])
    starts = starts + start
    while end < len(text):
        width = overlap
        heads = starts[fresh]
        heads = heads[:-DISTRUST]
        while True:
            left = max(start, end - width)
            if left > own_from and not (heads > left).any():
                width *= 2
                continue
            if left <= own_from:  # no room: the left chunk is encoded again together with a right one that grows fourfold each time
                left, step = own_from, 4 * step
                far = min(len(text), end + step)
                more, more_fresh = parts(text[left:far])
                more = more + left
                break
            far = min(len(text), end + chunk)
            more, more_fresh = parts(text[left:far])
            more = more + left
            common = np.intersect1d(heads[heads > left], more[more_fresh])
            if len(common):
                cut = int(common[len(common) // 2])
                total += int(np.searchsorted(starts, cut) - np.searchsorted(starts, own_from))
                own_from, step = cut, chunk
                break
            width *= 2
        start, end, starts, fresh = left, far, more, more_fresh
    return total + int(len(starts) - np.searchsorted(starts, own_from))


def _count(path: str, chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, parts = tokenizer(path)
        for batch in batches:
            texts = batch.column(1)
            offs, _ = tw.buffers(texts)
            made: list[int] = []
            for a, b in tw.pieces(offs, 1 << 19):
                own = [texts[i].as_py() or "" for i in range(a, b)]
                if len(own) == 1 and parts is not None and len(own[0]) > chunk:
                    made.append(spliced_count(own[0], parts, chunk, overlap))
                    continue
                huge = [i for i, t in enumerate(own) if parts is not None and len(t) > chunk]
                found = counts(["" if i in huge else t for i, t in enumerate(own)])
                for i in huge:
                    found[i] = spliced_count(own[i], parts, chunk, overlap)
                made += found
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offs), pa.int64()), pa.array(made, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """id, n_bytes, n_tokens, over_limit of every row."""
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    out = own.mapInArrow(_count(path, chunk, overlap), "id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
