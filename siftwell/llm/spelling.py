"""Operator 11: spelling variants of words, found by rolling-hash deletions.

Two words are near if one code point inserted, deleted or replaced makes one the other. Then either both leave the same rest when the
code point at one place is taken from each (replaced), or one is the other without a code point (inserted, deleted).

1. Words are counted with built-in functions, combined before the exchange, so a frequent word sends a row a task.
2. Each word gives an integer key for itself and for each of its rests: prefix and suffix polynomial hashes of all words of a batch are two
   running sums, and a rest's hash is the prefix before its place plus the suffix after it. Rows of (key, place, word's number, n)
   go to the partition of their key's upper bits and are sorted there; what meets nothing with its key and place, or no whole word
   with its key, ends here. Strings don't travel, so a word of any length costs what it is long.
3. The rest is joined with the words; rows of one key are told apart by their strings (``pandas.factorize``), which undoes collisions.
   A group of one rest and one place has at most as many members as there are letters, and all that a member needs of it is its
   size and its two best words: no pair is formed.
4. A word's form is its near word of largest n if that is at least ``ratio`` times its own. Along forms n grows by that ratio, so
   chains are short; roots are found by pointer jumping over the words that have a form.

Defined results: null texts have no words; a row with null id is counted, its words are never cut. Repeated rows count again. An empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm import words as tw
from siftwell.session import cut_lineage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BASE = 0x9E6D62D06F6A9A9B
#: Code points of words in one piece of a batch, and the bits of a key that name its partition.
PIECE, RADIX = 1 << 18, 12
KEYS = "key long, place int, id long, n long"


def word_runs(text: Column, least: int) -> Column:
    """Maximal runs of Latin letters with at least ``least`` of them, A-Z lower-cased."""
    run = F.explode(F.regexp_extract_all(text, F.lit(f"[A-Za-zÀ-ÿ]{{{least},}}"), F.lit(0)))
    return run


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 6, occurrences: int = 5, every: int = 199) -> DataFrame:
    """word and n. In every ``every``-th (document, run) by CRC-32 of ``<id>:<run>`` the run loses the code point at that CRC modulo its length."""
    runs = docs.select(F.col(id_col).cast("long").cast("string").alias("id"), word_runs(F.col(text_col), least).alias("run"))
    ascii_only = F.octet_length("run") == F.char_length("run")
    run = F.when(ascii_only, F.lower("run")).otherwise(F.translate("run", UPPER, LOWER))
    runs = runs.select("id", run.alias("run")).withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run")))
    place = (F.col("h") % F.char_length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), place), F.substring("run", place + 2, F.char_length("run")))
    word = F.when(F.col("h") % every == 0, cut).otherwise(F.col("run"))
    counts = runs.select(word.alias("word")).where(F.char_length("word") >= least).groupBy("word").agg(F.count("*").alias("n"))
    return counts.where(F.col("n") >= occurrences)


def rest_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which word, which place and key, for all words and all their rests. A place is -1 for the whole word, else twice the position
    taken out, plus 1 where it follows an equal letter and so gives the same rest as that letter's."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    edge = np.cumsum(size)
    start = edge - size
    row = np.repeat(np.arange(len(words)), size)
    place = np.arange(len(letters)) - start[row]
    most = int(size.max(initial=1))
    up, down = tw.powers(BASE, most + 1)
    prefix, suffix = np.zeros(len(letters) + 1, np.uint64), np.zeros(len(letters) + 1, np.uint64)
    np.cumsum(letters * up[place], out=prefix[1:])  # c_j B^j
    np.cumsum(letters * up[place] * down[1], out=suffix[1:])  # c_j B^(j-1)
    before = prefix[:-1] - prefix[start][row]
    after = suffix[edge][row] - suffix[1:]
    odd = np.uint64(tw.ODD)
    whole = tw.mix(prefix[edge] - prefix[start] + size.astype(np.uint64) * odd)
    rest = tw.mix(before + after + (size[row] - 1).astype(np.uint64) * odd)
    again = np.zeros(len(letters), bool)
    again[1:] = (letters[1:] == letters[:-1]) & (place[1:] > 0)
    return (
        np.concatenate((np.arange(len(words)), row)),
        np.concatenate((np.full(len(words), -1), 2 * place + again)).astype(np.int32),
        np.concatenate((whole, rest)),
    )


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        offs, _ = tw.buffers(batch.column(1))
        ids, n = (batch.column(i).to_numpy() for i in (0, 2))
        for a, b in tw.pieces(offs, PIECE):
            row, place, key = rest_keys(batch.column(1).slice(a, b - a).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (tw.signed(key), place, ids[a + row], n[a + row])], names=["key", "place", "id", "n"])


def _sorted_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole groups of rows that come sorted by their first column, key."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        key = batch.column(0).to_numpy()
        if not len(key):
            continue
        cut = int(np.searchsorted(key, key[-1]))
        if cut or (held and held[-1].column(0)[-1].as_py() != key[0]):
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def _meeting(key: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Rows, sorted by key and place, that share both with another, or a key with a whole word (or a rest with one that is it)."""
    same = np.zeros(len(key) + 1, bool)
    same[1:-1] = (key[1:] == key[:-1]) & (place[1:] >> 1 == place[:-1] >> 1)
    group = np.cumsum(np.append(True, key[1:] != key[:-1])) - 1
    first = (place >= 0) & (place & 1 == 0)
    whole, rests = (np.bincount(group, weights=x, minlength=group[-1] + 1)[group] > 0 for x in (place < 0, first))
    return same[1:] | same[:-1] | (first & whole) | ((place < 0) & rests)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _sorted_groups(batches):
        stay = _meeting(rows["key"].to_numpy(), rows["place"].to_numpy())
        if stay.any():
            yield from rows.filter(pa.array(stay)).combine_chunks().to_batches()


def _best(rows: pd.DataFrame, by: list[str]) -> pd.DataFrame:
    """Rows with ``near``, how many others their group has, and ``other``, the position of the best other one."""
    rows = rows.sort_values([*by, "n", "rank"], ascending=[True] * len(by) + [False, True], kind="stable")
    new = np.append(True, (rows[by].to_numpy()[1:] != rows[by].to_numpy()[:-1]).any(axis=1))
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(rows)))
    first = np.repeat(at, size)
    rows = rows.assign(near=np.repeat(size, size) - 1)
    where = rows["at"].to_numpy()
    second = where[np.minimum(first + 1, len(rows) - 1)]
    return rows.assign(other=np.where(new, second, where[first]))


def near_of(key: np.ndarray, place: np.ndarray, words: list[str], n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions, numbers of near words and positions of the best near word, for rows of whole keys; a word may come up several times."""
    plain = place >> 1
    rests = [w if p < 0 else w[:q] + w[q + 1 :] for w, p, q in zip(words, place.tolist(), plain.tolist(), strict=True)]
    rest = pd.factorize(np.array(rests, object))[0]
    rank = pd.factorize(np.array(words, object), sort=True)[0]  # by code points
    rows = pd.DataFrame({"rest": rest, "place": plain, "n": n, "rank": rank, "at": np.arange(len(words))})
    replaced = _best(rows[rows["place"] >= 0], ["rest", "place"])
    replaced = replaced[replaced["near"] > 0]
    whole = rows[rows["place"] < 0].set_index("rest")["at"]
    longer = rows[(place >= 0) & (place & 1 == 0) & rows["rest"].isin(whole.index).to_numpy()]
    shorter = whole.reindex(longer["rest"]).to_numpy()
    # the best of the longer words for each whole word
    ranked = _best(longer, ["rest"]).drop_duplicates("rest")
    lead = whole.reindex(ranked["rest"]).to_numpy()
    parts = [
        (replaced["at"], replaced["near"], replaced["other"]),
        (longer["at"], np.ones(len(longer)), shorter),
        (lead, ranked["near"] + 1, ranked["at"]),
    ]
    return tuple(np.concatenate([np.asarray(p[i], np.int64) for p in parts]) for i in range(3))


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _sorted_groups(batches):
        words, n = rows["word"].to_pylist(), rows["n"].to_numpy()
        at, near, other = near_of(rows["key"].to_numpy(), rows["place"].to_numpy(), words, n)
        if len(at):
            named = rows["word"].take(pa.array(other))
            columns = [rows["id"].take(pa.array(at)), pa.chunked_array([pa.array(near)]), named, pa.chunked_array([pa.array(n[other])])]
            yield from pa.table(columns, names=["id", "near", "best", "best_n"]).combine_chunks().to_batches()


def _by_radix(rows: DataFrame) -> DataFrame:
    return rows.repartition(F.shiftrightunsigned("key", 64 - RADIX)).sortWithinPartitions("key", "place")


def near_words(words: DataFrame) -> DataFrame:
    """id, n_near, best and best_n (largest n, ties to the first in code-point order) of the words that have a near one. ``words``: id, word, n."""
    met = _by_radix(words.select("id", "word", "n").mapInArrow(_keys, KEYS)).mapInArrow(_meet, KEYS)
    named = met.join(words.select("id", "word"), "id")
    found = _by_radix(named).select("key", "place", "id", "n", "word").mapInArrow(_near, "id long, near long, best string, best_n long")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word"))).alias("b")
    return found.groupBy("id").agg(F.sum("near").alias("n_near"), best).select("id", "n_near", F.col("b.word").alias("best"), (-F.col("b.n")).alias("best_n"))


def roots(forms: DataFrame) -> DataFrame:
    """word and root, the last one of a chain of forms. ``forms``: word and form, which has no cycle."""
    up = cut_lineage(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")))
    while not up.where("moved").isEmpty():
        ahead = up.select(F.col("word").alias("root"), F.col("root").alias("further"))
        up = up.select("word", "root").join(ahead, "root", "left")
        up = cut_lineage(up.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
    return up.select("word", "root")


def group_variants(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 6, occurrences: int = 5, ratio: int = 5, every: int = 199
) -> DataFrame:
    """word, form (null if none), root, n, n_near, form_n of every word."""
    counts = count_words(docs, id_col, text_col, least, occurrences, every)
    words = cut_lineage(counts.withColumn("id", F.monotonically_increasing_id()))
    own = F.col("best_n") >= ratio * F.col("n")
    out = words.join(near_words(words), "id", "left").select(
        "word", F.when(own, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(own, F.col("best_n")).alias("form_n")
    )
    out = cut_lineage(out)
    out = out.join(roots(out.where("form is not null").select("word", "form")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
