"""Properties of the text helpers against the public libraries and plain readings."""

import base64
import re

import numpy as np
import public_tokenizers as P
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from siftwell.llm import bpe
from siftwell.llm import words as tw

RANKS = P.path("byte_bpe_50k.tiktoken")
_ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=_ranks, special_tokens={})
CACHE = bpe.Cache(bpe.vocabulary(RANKS))
RULE = regex.compile(P.PATTERN)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=300))
def test_bpe_round_trip(text):
    text = text.encode("utf-8", "ignore").decode()
    ids, size = CACHE.look_up(RULE.findall(text))
    assert ids.tolist() == LIBRARY.encode_ordinary(text) and size.sum() == len(ids)
    assert bpe.vocabulary(RANKS).decode(ids.tolist()) == text.encode()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab é\n\t\x0b\x85\xa0", max_size=40), min_size=1, max_size=6))
def test_words_of_texts(texts):
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    offs = np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64)
    starts, ends, rows = tw.spans(data, offs)
    want = [(i, w.encode()) for i, t in enumerate(texts) for w in re.findall(r"[^\x20\x09-\x0D]+", t)]
    assert [(int(r), data[a:b].tobytes()) for a, b, r in zip(starts, ends, rows)] == want
    hashes = tw.word_hashes(data, starts, ends)
    assert len(set(hashes.tolist())) == len({w for _, w in want})


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=60), st.integers(1, 20))
def test_sliding_minimum(values, width):
    got = tw.sliding_argmin(np.array(values, np.uint64), width)
    want = [max(range(i, i + width), key=lambda j: (-values[j], j)) for i in range(len(values) - width + 1)]
    assert got.tolist() == want
