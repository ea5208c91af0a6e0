"""Operator 13 against whole texts encoded by the libraries and aligned token by token."""

import collections
import hashlib
import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siftwell.llm import alignment, queries

A, B = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


def tokens(t):
    """Ids and bytes of both, by the libraries, of the whole text."""
    a, b = alignment.tokenizers(A, B)
    ids_a, ids_b = a.encode([" " + t])[0], b.model.encode(t)
    return ids_a, [a.bytes[i] for i in ids_a], ids_b, [b.bytes[i] for i in ids_b]


def brute(docs):
    per, count = [], collections.Counter()
    for d, t in docs:
        t = t or ""
        ids_a, bytes_a, ids_b, bytes_b = tokens(t)
        raw = (" " + t).encode()
        if not t or b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
            per.append((d, 0, 0, 0, [], ""))
            continue
        links, groups, i, j, x, y = [], [], 0, 0, 0, 0
        while i < len(ids_a):
            end_a, end_b = sum(map(len, bytes_a[: i + 1])), sum(map(len, bytes_b[: j + 1]))
            links.append((ids_a[i], ids_b[j]))
            i, j = i + (end_a <= end_b), j + (end_b <= end_a)
            if end_a == end_b:
                groups.append(",".join(map(str, ids_a[x:i])) + "|" + ",".join(map(str, ids_b[y:j])))
                x, y = i, j
        per.append((d, len(ids_a), len(ids_b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
        count.update(set(links))
    top = collections.Counter()
    for (a, _), n in count.items():
        top[a] = max(top[a], n)
    return sorted(((d, n_a, n_b, g, len(own), sum(count[p] == top[p[0]] for p in own), sum(count[p] for p in own), s) for d, n_a, n_b, g, own, s in per), key=repr), count


def found(spark, docs, **more):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    return sorted(map(tuple, alignment.align(df, A, B, **more).collect()), key=repr)


ODD = ["", None, " ", "  ", "a", " lead", "trail ", "two  spaces", "a\nb", "tab\t x", "▁ piece", "<0x0A> <s> </s> <unk> <|endoftext|>", "naïve café", "日本語 テキスト", "é é", " nbsp x  y", "don't it's 12,000.5", "\x00 nul", "🙂👍🏽 ok"]


def test_odd_texts(spark):
    docs = list(enumerate(ODD)) + [(None, "a b"), (3, "a b"), (3, "a b")]
    for more in ({}, {"stripes": 3, "per_salt": 1}):
        assert found(spark, docs, **more) == brute(docs)[0]
    assert found(spark, []) == []


def test_query_on_its_table(spark):
    folder = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, queries.op13_token_alignment(spark, folder).collect()), key=repr) == brute(docs)[0]


def test_pieces_salts_and_pairs(spark, monkeypatch):
    rng = random.Random(5)
    words = ["the", "tokenizer", "straße", "42", "x;y", "\n", "  "]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 30)))) for i in range(300)] + [(900, "word " * 20_000), (901, "x" * 20_000)]
    want, count = brute([d for d in docs if d[0] < 900])
    assert [r for r in found(spark, docs[:300], stripes=7, per_salt=2)] == want
    got = found(spark, docs, stripes=7)
    assert [r for r in got if r[0] >= 900][0][1:3] == (len(tokens("word " * 20_000)[0]), len(tokens("word " * 20_000)[2]))
    pairs = alignment.linked_ids(spark.createDataFrame(docs[:300], "doc_id long, text string"), A, B, stripes=5)
    assert {(r.id_a, r.id_b): r.documents for r in pairs.collect()} == dict(count)


@given(st.text(st.characters(codec="utf-8") | st.sampled_from(" \t\n'aé▁<>0x"), max_size=60))
@settings(max_examples=300, deadline=None)
def test_units_are_cut_where_both_cut(text):
    """Units encoded by themselves give the tokens of the whole text."""
    a, b = alignment.tokenizers(A, B)
    units = alignment.UNIT.split(" " + text) if text else []
    ids_a, bytes_a, ids_b, bytes_b = tokens(text)
    if text:
        assert [i for x in a.encode(units) for i in x] == ids_a
        assert [i for x in b.encode(units) for i in x] == ids_b


def test_cache_is_emptied(monkeypatch):
    monkeypatch.setattr(alignment, "CACHE", 3)
    units = alignment.Units(*alignment.tokenizers(A, B))
    for text in ("one two three four", "five six", "one two"):
        fresh = alignment.Units(*alignment.tokenizers(A, B))
        for got, want in zip(units.align([text, None]), fresh.align([text, None]), strict=True):
            assert list(map(str, got)) == list(map(str, want))


@pytest.mark.parametrize("arrays", [([0, 255, 256],), ([1], [], [2**40])])
def test_packing(arrays):
    import numpy as np

    arrays = [np.array(a, np.int64) for a in arrays]
    assert [a.tolist() for a in alignment.unpacked(alignment.packed(*arrays))] == [a.tolist() for a in arrays]
