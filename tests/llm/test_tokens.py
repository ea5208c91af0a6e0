"""BPE and token counts against the public libraries."""

import base64
import random

import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from siftwell.llm import bpe, token_counts

RANKS, JSON = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")
ODD = ["", " ", "\n\n  \t x", "é" * 700, "a" * 3000, " " * 999, "ab" * 400 + "c", "<|endoftext|> x<|endoftext|>", "日本語のテキスト" * 90, "\u0000﻿𝔘𝔫", "it's we'll I'D", "1234567890" * 50, "!?" * 300]


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def random_texts(n, seed):
    rng = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyz ABC.,'!019éñßçüö日𝔘\n\t"
    return ["".join(rng.choice(letters[: rng.choice((3, 27, len(letters)))]) for _ in range(rng.randrange(1, 400))) for _ in range(n)]


def test_bpe_as_the_library(spark, library):
    rows = list(enumerate(ODD + random_texts(200, 4))) + [(999, None), (None, "null id"), (1, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = bpe.decode(bpe.encode(df, RANKS, P.PATTERN), RANKS).collect()
    want = sorted(((-1 if i is None else i), library.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows)
    assert sorted(((-1 if r.id is None else r.id), r.ids, bytes(r.decoded)) for r in out) == want
    both = bpe.encode(df, RANKS, P.PATTERN, decoded=True).collect()
    assert sorted(((-1 if r.id is None else r.id), r.ids, bytes(r.decoded)) for r in both) == want
    assert bpe.decode(bpe.encode(df.where("false"), RANKS, P.PATTERN), RANKS).count() == 0


def test_matrix_and_heap_agree(library):
    vocab = bpe.vocabulary(RANKS)
    for text in random_texts(60, 8) + ["aaaa" * 60, "abab" * 60]:
        piece = text.encode()[: bpe.LONG]
        ids, count = vocab.encode_matrix([piece], len(piece))
        assert ids[0, : count[0]].tolist() == vocab.encode_long(piece).tolist()


def test_bpe_on_the_table(spark, library):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in df.collect()}
    for r in bpe.decode(bpe.encode(df, RANKS, P.PATTERN), RANKS).collect():
        assert r.ids == library.encode_ordinary(texts[r.id]) and bytes(r.decoded).decode() == texts[r.id]


def test_counts_as_the_library(spark):
    model = Tokenizer.from_file(JSON)
    table = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    rows = list(enumerate(ODD + random_texts(100, 5) + table)) + [(9999, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for chunk, overlap in ((token_counts.CHUNK, token_counts.OVERLAP), (300, 8), (64, 4)):
        got = {r.id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(df, JSON, chunk=chunk, overlap=overlap).collect()}
        for i, t in rows:
            n = len(model.encode(t or "", add_special_tokens=False))
            assert got[i] == (len((t or "").encode()), n, n > 512), (i, chunk, t)


def test_sentencepiece_and_empty(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert [r.n_tokens > 0 for r in token_counts.count_tokens(df, P.path("piece_bpe_32k.model")).orderBy("id").collect()] == [True, False]
    assert token_counts.count_tokens(df.where("false"), JSON).count() == 0


def test_words_without_a_boundary():
    """Texts of one word: equal to the library, and the work grows with the length, not with its square."""
    counts, parts = token_counts.tokenizer(JSON)
    rng = random.Random(6)
    encoded = []

    def counted(text):
        encoded.append(len(text))
        return parts(text)

    for n in (1 << 17, 1 << 19, 1 << 21):
        for text in ("a" * n, "".join(rng.choices("abcdefgh", k=n)), "word " * 9000 + "x" * n + " and words" * 9000):
            encoded.clear()
            assert token_counts.spliced_count(text, counted) == counts([text])[0]
            assert sum(encoded) < 5 * len(text)
