"""Operator 5: toxicity from a lexicon met with Levenshtein automata, weighed by context.

The lexicon has fixed terms and what labelled texts teach: words, and stems of 4 to 7 letters that stand for every word that begins
with them, each with the words that it was learned from. They are counted on a bounded sample (``LEARN_FROM`` texts of either label); of all terms that are ``LIFT`` times as
frequent in toxic texts, a greedy cover takes the one that explains most toxic texts not yet explained, until too few are left. Words of
under 3 letters aren't learned; those of over ``LONGEST`` letters are learned by their stems only, which match them whole.

The lexicon is a trie. Its intersection with the Levenshtein automaton of each word (up to one insertion, deletion, change or
swap of neighbours; none for terms of under five letters, nor for stems, whose learned words are met so instead) is made
deterministic once, as a sorted table of states and letters; words run through it side by side. Letters are code points in lower case;
digits and signs that stand for letters are read as those, letters that no term holds count as one.

Each match has a context of ``WINDOW`` words on either side: quotation marks around it or reporting words mean quotation and
lower its weight, words that address somebody raise it. A document's counts of exact and misspelled matches, weights and
densities go to a logistic model fitted on a bounded sample of labelled rows (``linear.PER_CLASS`` of either label).

Defined results: null and empty texts have no match; without labels of both kinds the score is 1 - 0.6 ** weight.
"""

from __future__ import annotations

import functools
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm import linear
from siftwell.llm import words as tw
from siftwell.session import cut_lineage

WINDOW, FUZZY_FROM = 6, 5
# Abusive terms, reporting words, words that address somebody.
LEXICON = (
    "idiot idiots idiotic moron morons moronic stupid stupidity dumb dumbass imbecile cretin loser losers scum scumbag trash garbage clown clowns pathetic worthless disgusting "
    "filthy vermin parasite bastard bitch asshole jackass jerk coward liar fool foolish ugly freak creep pervert degenerate wretch swine dunce dimwit halfwit simpleton braindead "
    "useless despicable repulsive vile nasty hateful crap shit fuck fucking motherfucker bullshit whore slut retard retarded"
).split()
REPORT = "said says say called calls call quoted quote quotes wrote writes word words term phrase insult insults alleged reported heard shouted article".split()
ADDRESS = "you your youre yours u ur are is this such these those all".split()

#: What a folded text holds besides letters: gaps between words, and one letter for all beyond the basic plane.
GAP, FAR = 0x20, 0xFFFF
_SIGNS = {ord("$"): ord("s"), ord("@"): ord("a")}
_QUOTES = np.array(sorted(map(ord, "\"'`\u00ab\u00bb\u2018\u2019\u201a\u201c\u201d\u201e")), np.uint32)


@functools.cache
def _fold() -> np.ndarray:
    """Code points of the basic plane as lower-case letters; digits that stand for letters are read as those, anything else is a gap."""
    out = np.full(1 << 16, GAP, np.uint16)
    for i in range(1 << 16):
        if unicodedata.category(chr(i))[0] in "LM":
            low = chr(i).lower()
            out[i] = ord(low) if len(low) == 1 else i
    for c, to in zip("0123456789", "oizeasgtbg", strict=True):
        out[ord(c)] = ord(to)
    out[FAR] = FAR
    return out


def letters(offs: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded code points of the texts, which of them are quotation marks, and where texts begin."""
    low, high = int(offs[0]), int(offs[-1])
    raw = data[low:high]
    begin = (raw < 0x80) | (raw >= 0xC0)  # continuation bytes go with the letter that they continue
    place = np.zeros(len(begin) + 1, np.int64 if len(begin) >> 31 else np.int32)
    np.cumsum(begin, out=place[1:])
    points, own = raw[begin].astype(np.uint32), place[offs - low]
    wide = np.flatnonzero(points >= 0xC0)
    if len(wide):
        at, lead = np.flatnonzero(begin)[wide], points[wide]
        follow = lambda k: raw[np.minimum(at + k, len(raw) - 1)].astype(np.uint32) & 0x3F
        two, three = ((lead & 0x1F) << 6) | follow(1), ((lead & 0x0F) << 12) | (follow(1) << 6) | follow(2)
        points[wide] = np.where(lead < 0xE0, two, np.where(lead < 0xF0, three, FAR))
    out = _fold()[points]
    for sign, letter in _SIGNS.items():
        here = np.flatnonzero(points == sign)
        here = here[here + 1 < len(out)]
        out[here[out[here + 1] != GAP]] = letter
    return out, np.isin(points, _QUOTES), own


LEARN_FROM, LIFT, LONGEST, STEMS = 2_500, 25, 24, (4, 5, 6, 7)
DEAD, START, WHOLE = 0, 1, 2


@dataclass(frozen=True)
class Lexicon:
    """Terms, stems (they stand for every word that begins with them) and learned words, in lower case.

    Terms and learned words of ``FUZZY_FROM`` letters and more are met with an edit too.
    """

    terms: tuple[str, ...] = tuple(LEXICON)
    stems: tuple[str, ...] = ()
    words: tuple[str, ...] = ()


@dataclass(frozen=True)
class Automaton:
    """Codes of code points (the lexicon's letters, then one for all other letters, then the gap), transitions, edits of accepted states
    (9: not accepted), whether those accept a learned word, and the longest term plus one.

    Sorted keys (state * codes + code) have the transitions by letter; every other letter leads to the ``other`` state. So the size is that
    of the letters that states ask for, however many letters the lexicon has. DEAD matches nothing more; WHOLE is entered by a stem and
    stays.
    """

    codes: np.ndarray
    gap: int
    keys: np.ndarray
    target: np.ndarray
    other: np.ndarray
    edits: np.ndarray
    learned: np.ndarray
    longest: int

    def follow(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        key = state.astype(np.int64) * (self.gap + 1) + code
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.target[at], self.other[state])


@functools.lru_cache(maxsize=4)
def automaton(lexicon: Lexicon, fuzzy_from: int = FUZZY_FROM) -> Automaton:
    every = [*((t, 0) for t in lexicon.terms), *((t, 1) for t in lexicon.stems), *((t, 2) for t in lexicon.words)]
    alphabet = "abcdefghijklmnopqrstuvwxyz" + "".join(sorted({c for t, _ in every for c in t} - set("abcdefghijklmnopqrstuvwxyz")))
    number_of = {c: i for i, c in enumerate(alphabet)}
    other = len(alphabet)
    codes = np.full(1 << 16, other, np.uint16)
    codes[GAP] = other + 1
    for c, i in number_of.items():
        codes[ord(c)] = i
    children: list[dict[int, int]] = [{}]
    ends: dict[int, tuple[int, bool]] = {}
    stem_ends: set[int] = set()
    for term, kind in every:
        node = 0
        for c in term:
            code = number_of[c]
            if code not in children[node]:
                children[node][code] = len(children)
                children.append({})
            node = children[node][code]
        if kind == 1:
            stem_ends.add(node)
        else:
            ends.setdefault(node, (len(term), kind == 2))
    #: Nodes below which no term ends can only be reached without edits.
    live = [False] * len(children)
    for node in range(len(children) - 1, -1, -1):
        live[node] = node in ends or any(live[c] for c in children[node].values())

    def closed(states: dict[tuple[int, int], int]) -> frozenset:
        """With the deletions; a state is (node, letter awaited by a swap or -1) -> edits."""
        for (node, wait), edits in list(states.items()):
            if wait < 0 and edits == 0:
                for child in children[node].values():
                    if live[child] and states.get((child, -1), 9) > 1:
                        states[child, -1] = 1
        return frozenset(states.items())

    def steps(state: frozenset) -> tuple[frozenset, dict[int, frozenset]]:
        """The states after a letter that none of them asks for, and after each of the others. The cost is that of the letters asked for."""
        rest: dict[tuple[int, int], int] = {}
        more: dict[int, dict[tuple[int, int], int]] = defaultdict(dict)

        def put(out: dict[tuple[int, int], int], key: tuple[int, int], edits: int) -> None:
            if out.get(key, 9) > edits and (edits == 0 or live[key[0]]):
                out[key] = edits

        for (node, wait), edits in state:
            if wait >= 0:
                put(more[wait], (node, -1), edits)
                continue
            for letter, child in children[node].items():
                put(more[letter], (child, -1), edits)
            if edits == 0:
                put(rest, (node, -1), 1)
                for first, kid in children[node].items():
                    put(rest, (kid, -1), 1)
                    for letter, swapped in children[kid].items():
                        if first != letter:
                            put(more[letter], (swapped, first), 1)

        def finished(own: dict[tuple[int, int], int]) -> frozenset:
            out = {**rest, **own, **{k: min(rest[k], own[k]) for k in own.keys() & rest.keys()}}
            if any(edits == 0 and node in stem_ends for (node, _), edits in own.items()):
                return whole
            return closed(out)

        return finished({}), {letter: finished(own) for letter, own in more.items()}

    whole = frozenset({((-1, -1), 0)})
    start = closed({(0, -1): 0})
    number, rows, rest, todo = {frozenset(): DEAD, start: START, whole: WHOLE}, [{}, {}, {}], [DEAD, DEAD, WHOLE], [start]

    def place(state: frozenset) -> int:
        if state not in number:
            number[state] = len(rows)
            rows.append({})
            rest.append(DEAD)
            todo.append(state)
        return number[state]

    while todo:
        state = todo.pop()
        own = number[state]
        unasked, asked = steps(state)
        rest[own] = place(unasked)
        rows[own] = {letter: to for letter, then in asked.items() if (to := place(then)) != rest[own]}
    edits, learned = np.full(len(rows), 9, np.int8), np.zeros(len(rows), bool)
    edits[WHOLE] = 0
    for state, i in number.items():
        best = min(((e, ends[node][1]) for (node, wait), e in state if wait < 0 and node in ends and (e == 0 or ends[node][0] >= fuzzy_from)), default=None)
        if best:
            edits[i], learned[i] = best
    width = other + 2
    pairs = sorted((state * width + letter, to) for state, row in enumerate(rows) for letter, to in row.items())
    keys, target = np.array([*pairs, (np.iinfo(np.int64).max, DEAD)], np.int64).T.copy()
    return Automaton(codes, other + 1, keys, target.astype(np.int32), np.array(rest, np.int32), edits, learned, max((len(t) for t, _ in every), default=0) + 1)


_SEED = 1


def _word_hash(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of words of folded code points."""
    return tw.span_hash(tw.mix(points.astype(np.uint64) + np.uint64(_SEED)), starts, ends, _SEED)


def _hash_set(words: list[str]) -> np.ndarray:
    return np.array([_word_hash(np.array(list(map(ord, w))), np.array([0]), np.array([len(w)]))[0] for w in sorted(words)], np.uint64)


_REPORT, _ADDRESS = _hash_set(REPORT), _hash_set(ADDRESS)


def matches(offs: np.ndarray, data: np.ndarray, lexicon: Lexicon | Automaton = Lexicon(), window: int = WINDOW) -> dict[str, np.ndarray]:  # noqa: B008
    """Row, edits, weight, quoted, addressed, stem (learned, by a stem) and learned (by a word) of every match, and the words of each row."""
    known = automaton(lexicon) if isinstance(lexicon, Lexicon) else lexicon
    points, quotes, own = letters(offs, data)
    codes = known.codes[points]
    gap = np.zeros(known.gap + 1, bool)
    gap[known.gap] = True
    starts, ends, rows = tw.spans(codes, own, gap)
    size = ends - starts
    at = np.flatnonzero(size >= 3)
    state = np.full(len(at), START, np.int32)
    left = size[at]
    found, found_state = [], []
    for j in range(known.longest + 2):
        done = (left == j) | (state == WHOLE)
        if done.any():
            found.append(at[done])
            found_state.append(state[done])
        live = ~done & (state != DEAD)
        at, state, left = at[live], state[live], left[live]
        if not len(at):
            break
        state = known.follow(state, codes[starts[at] + j])
    hit, last = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (found, found_state))
    order = np.argsort(hit, kind="stable")
    order = order[known.edits[last[order]] < 9]
    hit, last = hit[order], last[order]
    e, stem, learned = known.edits[last], last == WHOLE, known.learned[last]
    quoted, addressed = np.zeros(len(hit), bool), np.zeros(len(hit), bool)
    if len(hit):
        before, after = np.maximum(starts[hit] - 1, 0), np.minimum(ends[hit], len(points) - 1)
        quoted = quotes[before] & quotes[after]
        for d in [*range(-window, 0), *range(1, window + 1)]:
            near = np.clip(hit + d, 0, len(rows) - 1)
            same = (rows[near] == rows[hit]) & (near != hit) & (size[near] < 16)  # no word of the two lists is longer
            h = np.zeros(len(hit), np.uint64)
            if same.any():
                unique, back = np.unique(near[same], return_inverse=True)
                length = size[unique]
                flat = np.repeat(starts[unique] - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
                edge = np.append(0, np.cumsum(length))
                h[same] = _word_hash(points[flat], edge[:-1], edge[1:])[back]
            quoted |= same & np.isin(h, _REPORT)
            addressed |= same & np.isin(h, _ADDRESS)
    weight = np.where(e == 0, 1.0, 0.7) * np.where(quoted, 0.35, 1.0) * np.where(addressed, 1.25, 1.0)
    return {"row": rows[hit], "edits": e, "weight": weight, "quoted": quoted, "addressed": addressed, "stem": stem, "learned": learned, "words": np.bincount(rows, minlength=len(offs) - 1)}


def features(offs: np.ndarray, data: np.ndarray, lexicon: Lexicon | Automaton = Lexicon()) -> np.ndarray:  # noqa: B008
    """The last column is the weight of all matches, the one before their number."""
    m, n = matches(offs, data, lexicon), len(offs) - 1
    count = lambda which, w=None: np.bincount(m["row"][which], None if w is None else w[which], n).astype(np.float64)
    every = np.ones(len(m["row"]), bool)
    exact, fuzzy, stem, weight = count((m["edits"] == 0) & ~m["stem"]), count((m["edits"] > 0) & ~m["learned"]), count(m["stem"]), count(every, m["weight"])
    near = count((m["edits"] > 0) & m["learned"])
    quoted, addressed = count(m["quoted"]), count(m["addressed"])
    density = weight / np.maximum(m["words"], 20) * 100
    flags = [exact > 0, exact > 1, stem > 0, stem > 1, fuzzy > 1, near > 0, exact + stem > 0]
    return np.column_stack([*flags, np.log1p(exact), np.log1p(stem), np.log1p(fuzzy), np.log1p(near), np.log1p(weight), np.log1p(density), np.log1p(quoted), np.log1p(addressed), count(every), weight])


def _terms(text: bytes) -> set[tuple[str, bool]]:
    """Distinct words and stems of a text."""
    points, _, _ = letters(np.array([0, len(text)]), np.frombuffer(text, np.uint8))
    words = set(points.astype("<u4").tobytes().decode("utf-32-le", "replace").split())
    return {(w, False) for w in words if 3 <= len(w) <= LONGEST} | {(w[:k], True) for w in words for k in STEMS if len(w) >= k}


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with each term, added up within a piece of the batch."""
    for batch in batches:
        for a in range(0, batch.num_rows, 256):
            every, toxic = Counter(), Counter()
            for text, y in zip(batch.column(1).slice(a, 256), batch.column(2).slice(a, 256), strict=True):
                own = _terms((text.as_py() or "").encode())
                every.update(own)
                if y.as_py():
                    toxic.update(own)
            terms = list(every)
            columns = [[t for t, _ in terms], [s for _, s in terms], [every[t] for t in terms], [toxic[t] for t in terms]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.bool_(), pa.int64(), pa.int64()), strict=True)], names=["term", "stem", "n", "n1"])


def _incidence(candidates: dict[tuple[str, bool], int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [sorted(candidates[t] for t in _terms((x.as_py() or "").encode()) if t in candidates) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.list_(pa.int32()))], names=["id", "terms"])

    return run


def learn(rows: DataFrame) -> Lexicon:
    """The lexicon from id, text and y of a bounded sample of labelled rows."""
    totals = rows.agg(F.count("*").alias("n"), F.sum("y").alias("n1")).first()
    if not totals.n1 or totals.n == totals.n1:
        return Lexicon()
    counted = rows.select("id", "text", "y").mapInArrow(_count_terms, "term string, stem boolean, n long, n1 long").groupBy("term", "stem").agg(F.sum("n").alias("n"), F.sum("n1").alias("n1"))
    least = max(3, round(totals.n1 * 0.002))
    lift = (F.col("n1") / totals.n1) / ((F.col("n") - F.col("n1") + 0.5) / (totals.n - totals.n1))
    best = counted.where((F.col("n1") >= least) & (lift >= LIFT)).orderBy(F.desc("n1"), "stem", "term").collect()  # terms of the bounded sample
    candidates = {(r.term, r.stem): i for i, r in enumerate(best)}
    texts = rows.where("y = 1").select("id", "text").mapInArrow(_incidence(candidates), "id long, terms array<int>").collect()
    gain, members, chosen = np.zeros(len(best), np.int64), [[] for _ in best], []
    for k, r in enumerate(texts):
        gain[r.terms] += 1
        for i in r.terms:
            members[i].append(k)
    explained = np.zeros(len(texts), bool)
    while len(best) and gain.max() >= least:
        top = int(gain.argmax())  # of equal ones the first: most frequent, word before stem
        chosen.append(best[top])
        for k in members[top]:
            if not explained[k]:
                explained[k] = True
                gain[texts[k].terms] -= 1
    stems = tuple(sorted(r.term for r in chosen if r.stem))
    words = {r.term for r in chosen if not r.stem} | {r.term for r in best if not r.stem and r.term.startswith(stems or ("\0",))}
    return Lexicon(tuple(LEXICON), stems, tuple(sorted(words - set(LEXICON))))


@dataclass
class Model:
    lexicon: Lexicon
    linear: linear.Scaled | None

    def __post_init__(self) -> None:
        self.automaton = automaton(self.lexicon)

    def score(self, offs: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores and numbers of matches."""
        x = features(offs, data, self.automaton)
        return linear.sigmoid(self.linear.score(x)) if self.linear else 1 - 0.6 ** x[:, -1], x[:, -2].astype(np.int64)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held: int = 0) -> Model:
    rows = cut_lineage(linear.labelled(docs, labels, label, id_col, text_col, folds, held))  # bounded; one pass over the texts
    lexicon = learn(rows.where(F.col("place") <= LEARN_FROM))
    x, y = linear.collect_training(linear.feature_rows(rows.select("id", "text", "y"), functools.partial(features, lexicon=automaton(lexicon))))
    if len(set(y.tolist())) < 2:
        return Model(lexicon, None)
    model = linear.Scaled.of(x, ())
    z = np.column_stack([model.expand(x), np.ones(len(x))])
    weights = linear.newton(z, y, ridge=1.0)
    model.weights, model.shift = weights[:-1], float(weights[-1])
    return Model(lexicon, model)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score and matches (number of matched words) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offs, data = tw.buffers(batch.column(1))
            own = [shared.value.score(offs[a : b + 1], data) for a, b in tw.pieces(offs)] or [(np.zeros(0), np.zeros(0, np.int64))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.concatenate(x)) for x in zip(*own, strict=True))], names=["id", "score", "matches"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, score double, matches long")


def keep_below(docs: DataFrame, model: Model, limit: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, unchanged, whose score is under the limit. A map over the rows: nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offs, data = tw.buffers(batch.column(place))
            stay = [shared.value.score(offs[a : b + 1], data)[0] < limit for a, b in tw.pieces(offs)]
            yield batch.filter(pa.array(np.concatenate([np.zeros(0, bool), *stay])))

    return docs.mapInArrow(run, docs.schema)
