"""Operator 12 against plain dictionaries; its runs, levels and recovery."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from siftwell.llm import line_dedup as ld

BLANK = " \t\n\x0b\x0c\r"
FOLD = str.maketrans(ld.UPPER, ld.LOWER)


def key(line):
    return line.strip(BLANK).translate(FOLD)


def brute(docs, least=40, documents=5):
    holders = collections.defaultdict(set)
    for d, t in docs:
        if d is not None:
            for line in (t or "").split("\n"):
                if len(key(line)) >= least:
                    holders[key(line)].add(d)
    top = {k: max(v) for k, v in holders.items() if len(v) >= documents}
    out = []
    for d, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if d is None or top.get(key(x), d) == d]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def some_docs(n=120, seed=1):
    rng = random.Random(seed)
    common = [f"The Common Línea number {i} " + "x" * 30 for i in range(12)] + ["ÀÉ " + "y" * 40, " \x0b" + "z" * 39 + "\t", "short"]
    docs = []
    for d in range(n):
        lines = [rng.choice(common) if rng.random() < 0.4 else f"own {d} {rng.random()} " + "w" * 30 for _ in range(rng.randint(0, 9))]
        lines = [x.upper() if rng.random() < 0.1 else x + " " * rng.randint(0, 2) for x in lines] + [common[0]] * (d % 3 == 0) * 2
        docs.append((d, "\n".join(lines)))
    return docs + [(None, common[0]), (200, None), (201, ""), (202, "\n\n"), docs[3], (docs[4][0], docs[5][1]), (203, (common[1] + "\n") * 2000 + "end")]


@pytest.mark.parametrize("batches, broadcast", [(1, 1000), (4, 1000), (5, 0)])
def test_as_plain_dictionaries(spark, batches, broadcast):
    docs = some_docs()
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("key", F.lit("clash")).withColumn("gone", F.lit(1)).repartition(5)
    got = ld.drop_shared_lines(df, batches=batches, broadcast=broadcast)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(docs)


def test_empty_table(spark):
    assert ld.drop_shared_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    only = spark.createDataFrame([(None, None)], "doc_id long, text string")
    assert [tuple(r) for r in ld.drop_shared_lines(only).collect()] == [(None, 1, 0, "")]


def batch(spark, *docs):
    return spark.createDataFrame(docs, "doc_id long, text string")


def state(index):
    return [(r[0], r[1], r[2]) for r in index.runs]


def test_levels_and_recovery(spark, tmp_path):
    a, b, c = ("a" * 40, "b" * 40, "c" * 40)
    folder = f"{tmp_path}/runs"
    index = ld.LineRuns(spark, folder)
    index.add(batch(spark, (9, f"{a}\n{b}"), (8, a)), 0)
    assert state(index) == [(0, 0, 0)]
    index.add(batch(spark, (7, f"{a}\n{c}\n{c}")), 1)
    index.add(batch(spark, (6, b)), 2)
    assert state(index) == [(1, 0, 1), (0, 2, 2)]
    # the third batch's key was known, so its run holds a count and no owner
    assert [(r.n, r.top) for r in spark.table(index.runs[-1][3]).collect()] == [(1, None)]
    found = ld.LineRuns.open(spark, folder)  # another session finds the runs
    assert state(found) == state(index)
    found.add(batch(spark, (6, b)), 2)  # is there already
    found.add(batch(spark, (5, f"{b}\n{c}")), 3)
    assert state(found) == [(2, 0, 3)]
    assert sorted((r.n, r.top) for r in found.totals().collect()) == [(2, 7), (3, 9), (3, 9)]
    with pytest.raises(ValueError, match="order"):
        ld.LineRuns.open(spark, folder).add(batch(spark, (1, a)), -1)
    found.remove()
    assert state(ld.LineRuns.open(spark, folder)) == []


def test_stopped_compaction(spark, tmp_path, monkeypatch):
    """The merged run is written, the old ones are still there: they count once."""
    index = ld.LineRuns(spark, f"{tmp_path}/runs")
    index.add(batch(spark, (2, "a" * 40)), 0)
    monkeypatch.setattr(ld.LineRuns, "_drop", lambda self, run: None)
    index.add(batch(spark, (1, "a" * 40)), 1)
    monkeypatch.undo()
    found = ld.LineRuns.open(spark, f"{tmp_path}/runs")
    assert state(found) == [(1, 0, 1)] and [(r.n, r.top) for r in found.totals().collect()] == [(2, 2)]


def test_runs_meet_without_an_exchange(spark, tmp_path):
    index = ld.LineRuns(spark, f"{tmp_path}/runs")
    index.add(batch(spark, (2, "a" * 40)), 0)
    index.add(batch(spark, (1, "b" * 40)), 1)
    index.add(batch(spark, (0, "b" * 40)), 2)
    one, two = (spark.table(r[3]) for r in index.runs)
    plan = one.join(two.hint("merge"), "key", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    main = ld.drop_shared_lines(batch(spark, (2, "a" * 40)))._jdf.queryExecution().toString()
    assert "Python" not in main and "Arrow" not in main and "Pandas" not in main
