"""Features, losses, networks and scores of operators 4, 5 and 8 against plain readings; clashing columns and long texts."""

import math
import random
from collections import Counter

import numpy as np
import pytest
import public_tokenizers as P

from siftwell.llm import bpe, language_id, linear, quality, simhash, substring_dedup, token_counts, toxicity
from test_classifiers import distance

KINDS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", " \t", "\n\r", ".,;:", "!?", "*&%$", "#@", "|<>{}[]\\/", "'\"")


def raw(texts):
    data = [t.encode() for t in texts]
    return np.cumsum([0, *map(len, data)]), np.frombuffer(b"".join(data), np.uint8)


def plain_quality(text):
    """Features by the description, a text at a time."""
    own = text.encode()
    kind = lambda b: 12 if b >= 128 else next((i for i, k in enumerate(KINDS) if chr(b) in k), 11)
    count = Counter(map(kind, own))
    words, lines = own.split(), [x for x in own.replace(b"\r", b"\n").split(b"\n") if x]
    three = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    some = max(1, len(words))
    return [
        *(count[k] / max(1, len(own)) for k in range(13)), count[0] / max(1, count[0] + count[1]), math.log1p(len(words)), sum(map(len, words)) / some, math.log1p(max(map(len, words), default=0)),
        len(set(words)) / math.sqrt(some), len(set(words)) / some, len(set(three)) / max(1, len(three)), sum(a == b for a, b in zip(words, words[1:])) / some,
        sum(kind(w[-1]) in (6, 7, 8, 9, 11) for w in words) / some, len(set(lines)) / max(1, len(lines)), len(lines) / some,
    ]


def test_quality_features():
    rng = random.Random(2)
    bag = ["word", "Word", "é!", "x#", "3.5", "a", "the", "{y}", "\n", "\r\n", "  ", "\t", "~"]
    texts = ["", " ", *(rng.choice((" ", "")).join(rng.choice(bag) for _ in range(rng.randrange(80))) for _ in range(120))]
    assert np.allclose(quality.features(*raw(texts)), [plain_quality(t) for t in texts])


def test_pair_loss_is_least():
    """The weights are where the loss of the pairs has no slope, by numeric differences."""
    rng = np.random.default_rng(3)
    apart = rng.normal(size=(400, 6)) + 0.3
    w = linear.newton(apart, np.ones(400), ridge=3.0)
    loss = lambda w: sum(math.log1p(math.exp(-float(d @ w))) for d in apart) + 1.5 * float(w @ w)
    for k in range(6):
        step = np.eye(6)[k] * 1e-5
        assert abs(loss(w + step) - loss(w - step)) / 2e-5 < 1e-3
    assert all(loss(w) < loss(w + rng.normal(size=6) * 0.01) for _ in range(20))


def test_quality_scores_and_cut():
    """A Bradley-Terry model by hand on the same features gives the same order, and the cut is the quantile of the scores."""
    rng = np.random.default_rng(4)
    y = (rng.random(300) < 0.6).astype(float)
    x = rng.normal(size=(300, 4)) + y[:, None] * np.array([1.0, 0.0, -0.5, 0.0])
    model = quality.fit(x, y, share=0.4, pairs=4000)
    score = linear.sigmoid(model.score(x))
    below = np.where(y == 1, 0.6 / (y == 1).sum(), 0.4 / (y == 0).sum())[score < quality.CUT].sum()
    assert abs(below - 0.4) < 0.02
    plain = [sum(w * v for w, v in zip(model.weights, model.expand(row[None, :])[0])) + model.shift for row in x]
    assert np.allclose(model.score(x), plain)
    good, bad = score[y == 1], score[y == 0]
    assert (good[:, None] > bad[None, :]).mean() > 0.75


def network(seed=5, languages=("a", "b", "c")):
    rng = np.random.default_rng(seed)
    k = language_id.FILTERS * len(language_id.WIDTHS)
    return language_id.Network(list(languages), [rng.normal(0, 0.5, (w, 256, language_id.FILTERS)) for w in language_id.WIDTHS], rng.normal(size=k), rng.normal(size=(k, len(languages))), rng.normal(size=len(languages)))


def test_forward_pass():
    net, rng = network(), np.random.default_rng(6)
    windows = rng.integers(0, 256, (5, language_id.LENGTH + 3)).astype(np.uint8)
    got = net.predict(windows, net.compiled())
    for row, p in zip(windows, got):
        hidden = []
        for w, f in zip(language_id.WIDTHS, net.filters):
            for c in range(language_id.FILTERS):
                hidden.append(max(sum(f[j, row[i + j], c] for j in range(w)) for i in range(language_id.LENGTH)))
        out = np.tanh(np.array(hidden) + net.bias) @ net.dense + net.shift
        assert np.allclose(p, np.exp(out) / np.exp(out).sum(), atol=1e-5)


def test_network_gradients():
    net, rng = network(), np.random.default_rng(7)
    x, y = rng.integers(0, 256, (6, language_id.LENGTH + 3)), np.array([0, 1, 2, 0, 1, 2])
    _, grads = language_id.gradients(net, x, y)
    for weights, g in zip([*net.filters, net.bias, net.dense, net.shift], grads):
        for at in [tuple(rng.integers(0, n) for n in g.shape) for _ in range(6)] + [np.unravel_index(np.abs(g).argmax(), g.shape)]:
            keep = weights[at]
            losses = []
            for d in (1e-6, -1e-6):
                weights[at] = keep + d
                losses.append(language_id.gradients(net, x, y)[0])
            weights[at] = keep
            assert abs((losses[0] - losses[1]) / 2e-6 - g[at]) < 1e-4 * max(1, abs(g[at]))


def test_many_languages(spark):
    """Every language is learned and can be predicted, however many there are."""
    rng = random.Random(9)
    kinds = {f"l{i:03}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(3)) for _ in range(4)] for i in range(300)}
    rows = [(i, " ".join(rng.choice(own) for _ in range(60)), name) for i, (name, own) in enumerate(x for x in kinds.items() for _ in range(10))]
    net = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(net.languages) == 300 and net.dense.shape[1] == 300
    got = {r.id: r.lang for r in language_id.predict(spark.createDataFrame(rows, "doc_id long, text string, lang string"), net).collect()}
    assert len(set(got.values())) > 256


def test_samples_are_bounded_by_rows(spark):
    """An id that repeats a thousand times brings one row to the training sample."""
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(1000)] + [(i, "other") for i in range(2, 40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 40)] * 3, "doc_id long, toxic int")
    rows = linear.labelled(docs, labels, "toxic").collect()
    assert len({r.id for r in rows}) == len(rows) <= 39 and all(r.text == "text 0" for r in rows if r.id == 1)
    few = linear.labelled(docs, labels, "toxic", per_class=5).collect()
    assert len(few) == 10 and {r.place for r in few} == {1, 2, 3, 4, 5}


def test_misspelled_learned_terms():
    """One edit in a learned word of any script is met; words with two edits, and ordinary ones, are not."""
    learned = ("schwachkopf", "imbécile", "придурок", "ηλίθιος", "غبيجدا")
    known = toxicity.automaton(toxicity.Lexicon(("zzzzzzzz",), ("schwach",), learned))
    rng = random.Random(1)
    letters = "abcdeéопридηλίαبج"
    for word in learned:
        for _ in range(60):
            w = list(word)
            k, kind = rng.randrange(len(w)), rng.randrange(4)
            if kind == 0:
                w.insert(k, rng.choice(letters))
            elif kind == 1:
                del w[k]
            elif kind == 2:
                w[k] = rng.choice(letters)
            elif k + 1 < len(w):
                w[k], w[k + 1] = w[k + 1], w[k]
            made = "".join(w)
            m = toxicity.matches(*raw([f"so {made} sagt"]), known)
            least = min(distance(made, t) for t in learned)
            assert len(m["row"]) == 1 and (m["stem"][0] or (m["edits"][0] == least and m["learned"][0])), made
    for made in ("привет", "schwxchkxpf", "ηxίxιος", "wort", "ббббббб"):
        assert len(toxicity.matches(*raw([made]), known)["row"]) == 0


def test_alphabet_of_a_thousand_letters():
    """Each letter of the lexicon stands for itself, and a word of letters that no term has is no match, however many letters there are."""
    rng = random.Random(4)
    letters = [chr(0x4E00 + i) for i in range(1000)]
    learned = tuple(sorted({"".join(letters[(5 * i + j) % 1000] for j in range(5)) for i in range(200)}))
    known = toxicity.automaton(toxicity.Lexicon((), ("".join(letters[7:11]),), learned[:199]))
    assert known.gap > 900
    for _ in range(400):
        w = list(rng.choice(learned))
        for _ in range(rng.randrange(3)):
            k, kind = rng.randrange(len(w)), rng.randrange(4)
            if kind == 0:
                w.insert(k, rng.choice(letters))
            elif kind == 1:
                del w[k]
            elif kind == 2:
                w[k] = chr(0x5E00 + rng.randrange(1000))
            elif k + 1 < len(w):
                w[k], w[k + 1] = w[k + 1], w[k]
        made = "".join(w)
        m = toxicity.matches(*raw([made]), known)
        best = 0 if made.startswith("".join(letters[7:11])) else min(distance(made, t) for t in learned[:199])
        assert m["edits"].tolist() == ([best] if best < 2 and len(made) >= 3 else []), made
    for _ in range(200):
        assert len(toxicity.matches(*raw(["".join(chr(0x5E00 + rng.randrange(1000)) for _ in range(5))]), known)["row"]) == 0


def test_every_term_of_the_sample_is_learned(spark):
    """No cap on 2,800 candidates: the cover needs 400 words, each in three toxic texts of its own; a very long word is learned by a stem."""
    name = lambda i: chr(0x4E00 + i) * 3
    rows = [(3 * i + j, " ".join(name(7 * i + k) for k in range(7)), 1) for i in range(400) for j in range(3)] + [(10_000 + i, "so wie da", 0) for i in range(5_100)]
    rows += [(20_000 + i, "q" * 100_000, 1) for i in range(3)]
    lexicon = toxicity.learn(spark.createDataFrame(rows, "id long, text string, y int"))
    assert set(lexicon.words) == {name(7 * i) for i in range(400)} and lexicon.stems == ("qqqq",)


def test_learned_lexicon(spark):
    rows = [(i, f"ein gutes wort nummer{i} und mehr ist", 0) for i in range(60)] + [(100 + i, f"du {'vollpfosten' if i % 2 else 'vollpfostenhaft'} ist wort {i}", 1) for i in range(60)]
    lexicon = toxicity.learn(spark.createDataFrame(rows, "id long, text string, y int"))
    known = toxicity.automaton(lexicon)
    for text in ("vollpfosten", "vollpfosen", "volpfosten", "vollpfsotenhaft"):
        assert len(toxicity.matches(*raw([text]), known)["row"]) == 1, (text, lexicon)
    assert len(toxicity.matches(*raw(["gutes wort und mehr"]), known)["row"]) == 0


def plain_matches(text):
    """Matches by edit distance and contexts by the description, a word at a time; letters and blanks only."""
    words, out = text.split(), []
    for i, w in enumerate(words):
        best = min((distance(w, t) for t in toxicity.LEXICON if abs(len(t) - len(w)) < 2 and (len(t) >= toxicity.FUZZY_FROM or t == w)), default=9)
        if len(w) < 3 or best > 1:
            continue
        near = words[max(0, i - 6) : i] + words[i + 1 : i + 7]
        quoted, addressed = any(x in toxicity.REPORT for x in near), any(x in toxicity.ADDRESS for x in near)
        out.append((i, best, quoted, addressed, (1.0 if best == 0 else 0.7) * (0.35 if quoted else 1.0) * (1.25 if addressed else 1.0)))
    return len(words), out


def test_contexts_weights_and_scores():
    rng = random.Random(3)
    bag = ["idiot", "idoit", "morn", "moron", "scum", "scam", "said", "word", "you", "are", "house", "tree", "worthles", "clown", "a", "of", "river", "mountain", "lake", "stone", "cloud"]
    texts = [" ".join(rng.choice(bag) for _ in range(rng.randrange(40))) for _ in range(150)]
    m = toxicity.matches(*raw(texts))
    x = toxicity.features(*raw(texts))
    score, number = toxicity.Model(toxicity.Lexicon(), None).score(*raw(texts))
    for i, t in enumerate(texts):
        n, want = plain_matches(t)
        own = m["row"] == i
        assert m["words"][i] == n and m["edits"][own].tolist() == [w[1] for w in want], t
        assert m["quoted"][own].tolist() == [w[2] for w in want] and m["addressed"][own].tolist() == [w[3] for w in want]
        assert np.allclose(m["weight"][own], [w[4] for w in want])
        weight = sum(w[4] for w in want)
        assert np.isclose(x[i, -1], weight) and x[i, -2] == number[i] == len(want) and np.isclose(score[i], 1 - 0.6**weight)


@pytest.mark.parametrize("call", ["quality", "toxicity", "language", "tokens", "bpe", "simhash", "similar", "substring"])
def test_clashing_columns(spark, call):
    """Columns named like the operators' own change nothing."""
    plain = [(1, "some words here " * 9, "en"), (2, None, None), (None, "x", "fr")]
    one = spark.createDataFrame(plain, "doc_id long, text string, lang string")
    two = spark.createDataFrame([(*r, 7, "q", 0.5, 3, "z", 1, 2, 3) for r in plain], "doc_id long, text string, lang string, id int, body string, score double, y int, h string, n int, fp int, component int")
    run = {
        "quality": lambda d: quality.score(d, None), "toxicity": lambda d: toxicity.score(d, toxicity.Model(toxicity.Lexicon(), None)), "language": lambda d: language_id.predict(d, language_id.train(d)),
        "tokens": lambda d: token_counts.count_tokens(d, P.path("byte_bpe_50k.json")), "bpe": lambda d: bpe.encode(d, P.path("byte_bpe_50k.tiktoken"), P.PATTERN), "simhash": simhash.near_duplicates,
        "similar": simhash.similar_groups, "substring": substring_dedup.remove_repeats,
    }[call]
    assert sorted(map(str, run(one).collect())) == sorted(map(str, run(two).collect()))


def test_session_stays_as_it_is(spark):
    before = {r.key: r.value for r in spark.sql("SET").collect()}
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    for out in (simhash.near_duplicates(docs), substring_dedup.remove_repeats(docs), quality.score(docs, None)):
        out.collect()
    after = {r.key: r.value for r in spark.sql("SET").collect()}
    assert {k: v for k, v in after.items() if "arrow" in k or "parquet" in k or "shuffle" in k} == {k: v for k, v in before.items() if "arrow" in k or "parquet" in k or "shuffle" in k}


def test_repeats_in_very_long_texts(spark):
    """Texts of over a piece each, with passages shared between them and within them."""
    rng = random.Random(12)
    passage = " ".join(f"p{rng.randrange(10**6)}" for _ in range(40))
    long = lambda k: " ".join(f"{k}{rng.randrange(10**9)}" for _ in range(250_000))
    rows = [(1, long("a") + " " + passage), (2, long("b") + f" {passage} mid {passage} " + long("c")), (3, passage)]
    got = {r.id: (r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()}
    assert got == {1: (250_040, 0), 2: (500_081, 80), 3: (40, 40)}
