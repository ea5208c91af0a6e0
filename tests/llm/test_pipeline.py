"""The pipeline's stages against plain readings of what each must keep."""

import base64
import hashlib

import public_tokenizers as P
import tiktoken
from test_decontaminate import full_score
from test_simhash import jaccard_groups, shingles
from test_simhash import plain as fingerprint
from test_substring_dedup import brute as repeats

import corpus_pipeline as cp


def similar_pairs(made):
    """All pairs of a Jaccard similarity of 0.8 or more, by the shingles that they share."""
    holders = {}
    for k, (_, own) in enumerate(made):
        for x in own or {()}:
            holders.setdefault(x, []).append(k)
    common = {}
    for ks in holders.values():
        for n, i in enumerate(ks):
            for j in ks[:n]:
                common[i, j] = common.get((i, j), 0) + 1
    return [(made[i], made[j]) for (i, j), n in common.items() if n >= 0.8 * (len(made[i][1] or {()}) + len(made[j][1] or {()}) - n)]


def de_words(text):
    import re

    return re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower())


def leaked(item, words):
    """The whole text aligned, if it has at all as many of the item's words as the threshold takes."""
    have = set(words)
    return len(item) > 2 and sum(w in have for w in item) >= 0.5 * len(item) and full_score(item, words) >= len(item)


def test_stages(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names, steps = docs.columns, [docs]
    for _, stage in cp.STAGES:
        steps.append(stage(spark, steps[-1], folder).cache())
        if stage is not cp.encode_tokens:
            assert steps[-1].columns == names
    rows = [[tuple(r) for r in s.collect()] for s in steps]
    toxic = {r.doc_id for r in spark.read.parquet(f"{folder}/labels.parquet").where("toxic = 1").collect()}
    clean = {r.doc_id for r in spark.read.parquet(f"{folder}/labels.parquet").where("toxic = 0").collect()}
    kept = {r[0] for r in rows[1]}
    every = {r[0] for r in rows[0]}
    assert len(kept & toxic) <= 0.25 * len(toxic & every) and len(kept & clean) >= 0.98 * len(clean & every)
    assert sorted(rows[1]) == sorted(r for r in rows[0] if r[0] in kept)  # the rows are as they were
    made = [(r[0], shingles(r[1])) for r in rows[1]]
    groups = jaccard_groups(made, [(a[0], b[0]) for a, b in similar_pairs(made)])
    left = {r[0] for r in rows[2]}
    # nobody goes without a group, every group keeps its first, and nearly all the others go
    assert {i for i, g in groups.items() if i == g} <= left
    others = [i for i, g in groups.items() if i != g]
    assert len(left & set(others)) <= 0.05 * len(others) + 1
    want = repeats([(r[0], r[1]) for r in rows[2]])
    for r in rows[3]:
        before = next(x for x in rows[2] if x[0] == r[0])
        assert r[1] == (want[r[0]][2] if want[r[0]][1] else before[1])
    bench = [(r.item_id, de_words(r.text)) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    leaks = {r[0] for r in rows[3] if any(leaked(item, de_words(r[1])) for _, item in bench)}
    assert leaks and {r[0] for r in rows[4]} == {r[0] for r in rows[3]} - leaks
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r[0]: r[1] for r in rows[4]}
    assert len(rows[5]) == len(texts)
    for i, n, ids, decoded in rows[5]:
        want_ids = library.encode_ordinary(texts[i])
        assert (n, ids, decoded) == (len(want_ids), hashlib.sha256(" ".join(map(str, want_ids)).encode()).hexdigest(), hashlib.sha256(texts[i].encode()).hexdigest())
    assert sorted(map(tuple, cp.run(spark, folder).collect())) == sorted(rows[5])


def test_edge_rows(spark, tmp_path):
    """Nulls in every column, repeated rows, long texts, clashing columns and no rows at all."""
    import random

    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 8)))
    text = " ".join(word() for _ in range(60))
    long = " ".join(word() for _ in range(900_000))  # over 4 MB
    rows = [(1, text, "en", "s", 1, 7), (1, text, "en", "s", 1, 7), (2, text, None, None, None, None), (None, text, "en", "s", 1, 7), (3, None, "en", "s", 1, 7), (4, "", "en", "s", 1, 7), (5, long, "en", "s", 1, 7), (6, "x" * 3_000_000, "en", "s", 1, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id int").withColumnRenamed("id", "body")
    spark.createDataFrame([(1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(long.split()[500:540])), (None, "a b c"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now, seen = docs, []
    for _, stage in cp.STAGES:
        now = stage(spark, now, str(tmp_path)).cache()
        seen.append(sorted((-1 if r.doc_id is None else r.doc_id) for r in now.collect()))
    every = [-1, 1, 1, 2, 3, 4, 5, 6]
    assert seen == [every, [-1, 1, 1, 3, 5, 6], [-1, 1, 1, 3, 5, 6], [-1, 1, 1, 3, 6], [-1, 1, 1, 3, 6]]
    none = docs.where("false")
    for _, stage in cp.STAGES:
        none = stage(spark, none, str(tmp_path))
        assert none.count() == 0


def test_long_texts_as_short_ones(spark):
    import numpy as np

    from siftwell.llm import bpe, quality, simhash

    text = ("Some wörds, and more. " * 220_000)[: 9 << 19]
    assert simhash.fingerprint(text) == fingerprint(text)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = bpe.decode(bpe.encode(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN), P.path("byte_bpe_50k.tiktoken")).first()
    assert got.ids == library.encode_ordinary(text) and bytes(got.decoded).decode() == text
    raw = np.frombuffer(text.encode(), np.uint8)
    assert quality.features(np.array([0, len(raw)]), raw).shape[0] == 1
