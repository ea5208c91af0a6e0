"""Toxicity, quality and language: held-out accuracy, the automaton against edit distance, defined edge cases."""

import random

import numpy as np
import pytest

from siftwell.llm import language_id, quality, queries, toxicity

FOLDER = "/root/testdata/sf0.1"


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    n1 = y.sum()
    return (rank[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))


@pytest.mark.parametrize(("query", "label", "least", "cut"), [(queries.op4_quality, "quality", 0.97, 0.95), (queries.op5_toxicity, "toxic", 0.92, 0.96)])
def test_held_out(spark, query, label, least, cut):
    got = {r.doc_id: r for r in query(spark, FOLDER).collect()}
    truth = {r.doc_id: r[label] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    own = [i for i in truth if i in got and got[i].held_out]
    score, y = np.array([got[i].score for i in own]), np.array([truth[i] for i in own])
    right = np.mean([got[i].predicted == truth[i] for i in own])
    assert len(own) > 500 and auc(score, y) >= least and right >= cut, (auc(score, y), right)


def distance(a, b):
    """Edits with swaps of neighbours (optimal string alignment)."""
    d = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_automaton_is_edit_distance():
    terms = ("idiot", "moron", "scum", "clown", "worthless")
    rng = random.Random(1)
    known = toxicity.automaton(toxicity.Lexicon(terms, ("stemx",)))
    edits, longest = known.edits, known.longest
    for _ in range(3000):
        w = list(rng.choice(terms))
        for _ in range(rng.randrange(3)):
            k = rng.randrange(len(w) + 1)
            kind = rng.randrange(4)
            if kind == 0:
                w.insert(k, rng.choice("abidlmnorst"))
            elif kind == 1 and w:
                del w[min(k, len(w) - 1)]
            elif kind == 2 and w:
                w[min(k, len(w) - 1)] = rng.choice("abidlmnorst")
            elif len(w) > 1:
                k = min(k, len(w) - 2)
                w[k], w[k + 1] = w[k + 1], w[k]
        state = np.array([1])
        for c in w:
            state = known.follow(state, known.codes[[ord(c)]])
        state = state[0]
        best = min((e for t in terms if (e := distance(w, t)) <= (1 if len(t) >= toxicity.FUZZY_FROM else 0)), default=9)
        assert edits[state] == best, "".join(w)
        assert best == 9 or len(w) <= longest


def found(text):
    data = np.frombuffer(text.encode(), np.uint8)
    return toxicity.matches(np.array([0, len(data)]), data)


def test_matches_and_context():
    assert found("you are an 1d10t, a m0ron and st upid").get("edits").tolist() == [0, 0]
    assert found("such an idoit! idïot $tupid worthles clown*** idiot$$$").get("edits").tolist() == [1, 1, 0, 1, 0, 0]
    plain, quote, mark = found("what an idiot"), found("he said the word idiot"), found('a sign with "idiot" on it')
    assert plain["weight"][0] > quote["weight"][0] and mark["quoted"][0] and not plain["quoted"][0]
    assert found("you idiot")["weight"][0] > plain["weight"][0]
    data = np.frombuffer("Stemmed stemée ste lostem".encode(), np.uint8)
    assert toxicity.matches(np.array([0, len(data)]), data, toxicity.Lexicon(stems=("stem",)))["stem"].tolist() == [True, True]
    assert len(found("a nice clear text, scam and lone") ["row"]) == 0


def test_language_held_out(spark):
    got = queries.op8_language_id(spark, FOLDER).collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang").collect()}
    own = [r for r in got if r.held_out]
    assert len(own) > 2000 and np.mean([r.lang_pred == truth[r.doc_id] for r in own]) >= 0.98


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, None), (2, "", "en"), (3, "123 !!", "en"), (None, "some words", "en"), (3, "again some", None), (4, "x" * 300_000, "fr")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(2, 1, None), (None, 1, 1), (77, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality.score(docs, quality.train(docs, labels)).count() == 6
    tox = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert len(tox) == 6 and all(r.score == 0 for r in tox)
    assert toxicity.keep_below(docs, toxicity.Model(toxicity.Lexicon(), None)).count() == 6
    lang = {(r.id, r.lang) for r in language_id.predict(docs, language_id.train(docs)).collect()}
    assert {(1, "und"), (2, "und")} <= lang and (3, "und") in lang
    none = docs.where("false")
    assert language_id.train(none) is None and language_id.predict(docs, None).where("lang <> 'und'").count() == 0
    assert quality.score(none, None).count() == 0 and toxicity.score(none, toxicity.Model(toxicity.Lexicon(), None)).count() == 0 and language_id.predict(none, None).count() == 0


def test_quality_learns_from_every_row(spark):
    """Texts of both labels are the same for all rows that a sample of ``linear.PER_CLASS`` would take; only the rest tell them apart."""
    from siftwell.llm import linear

    n = linear.PER_CLASS + 1500
    labels = spark.range(2 * n).selectExpr("id as doc_id", "cast(id % 2 as int) as quality")
    placed = labels.selectExpr("*", f"row_number() over (partition by quality order by xxhash64(doc_id)) > {linear.PER_CLASS + 100} as rest")
    docs = placed.selectExpr("doc_id", "case when not rest then 'a plain text of words' when quality = 1 then 'some other words of prose' else '### @@@ ###' end as text")
    model = quality.train(docs, labels, folds=1000)
    got = {r.id: r.score for r in quality.score(spark.createDataFrame([(1, "some other words of prose"), (0, "### @@@ ###")], "doc_id long, text string"), model).collect()}
    assert got[1] > got[0] + 0.2


def test_quality_fit_is_that_of_all_pairs(spark):
    """In one bucket the weights are those of all pairs formed; rare labels stand in several buckets and count once."""
    from siftwell.llm import linear

    rng = np.random.default_rng(8)
    y = np.array([1] * 90 + [0] * 60)
    x = rng.normal(size=(150, 3)) + y[:, None] * np.array([0.8, 0.0, -0.4])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    labels = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)], "id long, y int")
    model = quality.fit_all(linear.buckets(rows, labels), 0.4)
    z = model.expand(x)
    apart = (z[y == 1][:, None] - z[y == 0][None]).reshape(-1, z.shape[1])
    plain = linear.newton(apart, np.ones(len(apart)), ridge=quality.RIDGE * len(apart) / quality.PAIRS, steps=60)
    assert np.allclose(model.weights, plain, atol=1e-2) and np.allclose(model.mean, x.mean(axis=0)) and np.allclose(model.spread, x.std(axis=0))
    assert np.abs(model.knots - np.quantile(model.plain(x), quality.KNOTS, axis=0)).max() < 0.2
    score = linear.sigmoid(model.score(x))
    assert (score < quality.CUT).sum() == 60 and not np.isclose(score, quality.CUT, atol=1e-9).any()

    many = spark.range(4000).selectExpr("id", "array(cast(id % 7 as double), cast(id % 2 as double)) as x", "cast(id % 40 = 0 as int) as y")
    own = linear.buckets(many.select("id", "x"), many.select("id", "y"))
    assert own.copies[1] > 1 and own.rows.where("size(good) = 0 or size(bad) = 0").count() == 0
    plain = np.array([[i % 7, i % 2] for i in range(4000)], float)
    model = quality.fit_all(own, 0.975)
    assert np.allclose(model.mean, plain.mean(axis=0)) and np.allclose(model.spread, plain.std(axis=0))
