"""The event log: golden cases, and batch, stream and a plain loop against each other."""

import collections
import random
import time

import pytest

from siftwell.streaming import eventlog as ev
from siftwell.streaming import ingest as st

SCHEMA = "operation long, event_id string, arrival long, sequence long, status string, content string"
ALLOWED = {None: frozenset("ab"), "a": frozenset("abc"), "b": frozenset("bc"), "c": frozenset()}


def plain(rows):
    logs, out = collections.defaultdict(list), []
    for operation, event, arrival, sequence, status, content in sorted(rows, key=lambda r: r[2]):
        if operation is None:
            continue
        log = logs[operation]  # accepted events
        last = log[-1] if log else (None, 0, None, None)
        known = [x for x in log if x[0] == event]
        place = last[1] + 1 if sequence is None else sequence
        if known:
            same = known[0][2:] == (status, content) and sequence in (None, known[0][1])
            out.append((operation, event, arrival, known[0][1] if same else sequence, "repeated" if same else "conflict"))
        elif place <= last[1]:
            out.append((operation, event, arrival, sequence, "stale"))
        elif status not in ALLOWED[last[2]]:
            out.append((operation, event, arrival, sequence, "illegal"))
        else:
            log.append((event, place, status, content))
            out.append((operation, event, arrival, place, "accepted"))
    return sorted(out, key=repr)


def some_rows(n=600, seed=2):
    rng = random.Random(seed)
    rows = [
        (rng.choice([1, 1, 1, 2, 3, 4, 5, None]), f"e{rng.randint(1, 80)}", i, rng.choice([None, i // 5, i // 5, rng.randint(1, 200)]), rng.choice("aaaaabbbbbbbbbbbbbbbbbbbc"), rng.choice("xxxxxy"))
        for i in range(n)
    ]
    rows += [(o, e, n + i, s, t, c) for i, (o, e, _, s, t, c) in enumerate(rows[:200])]  # delivered again
    rng.shuffle(rows)
    return rows


def outcomes(df):
    return sorted(map(tuple, df.select("operation", "event_id", "arrival", "sequence", "outcome").collect()), key=repr)


@pytest.mark.parametrize("per_batch", [10_000, 7])
def test_stored_log(spark, per_batch):
    rows = some_rows()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", per_batch)
    try:
        got = outcomes(ev.append_log(spark.createDataFrame(rows, SCHEMA).repartition(3), ALLOWED))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == plain(rows)
    assert set(r[4] for r in got) == {"accepted", "repeated", "conflict", "stale", "illegal"}
    assert ev.append_log(spark.createDataFrame([], SCHEMA), ALLOWED).collect() == []


def test_golden(spark):
    rows = [
        (1, "x", 1, 5, "a", "p"), (1, "y", 2, 3, "a", "p"), (1, "z", 3, 6, "b", "p"), (1, "w", 4, 4, "b", "p"), (1, "x", 5, 5, "a", "p"),
        (1, "x", 6, 5, "a", "other"), (1, "x", 7, None, "a", "p"), (1, "v", 8, None, "b", "p"), (1, "u", 9, 9, "a", "p"), (1, "t", 10, 7, "b", "p"), (1, "s", 11, 20, "c", "p"), (1, "r", 12, 21, "c", "p"),
    ]
    got = {r.arrival: (r.outcome, r.sequence) for r in ev.append_log(spark.createDataFrame(rows, SCHEMA), ALLOWED).collect()}
    assert got == {
        1: ("accepted", 5), 2: ("stale", 3), 3: ("accepted", 6), 4: ("stale", 4), 5: ("repeated", 5), 6: ("conflict", 5),
        7: ("repeated", 5), 8: ("accepted", 7), 9: ("illegal", 9), 10: ("stale", 7), 11: ("accepted", 20), 12: ("illegal", 21),
    }
    events = spark.createDataFrame(rows, SCHEMA)
    assert [tuple(r) for r in ev.heads(ev.append_log(events, ALLOWED), events).collect()] == [(1, 20, "c")]


def stream(spark, folder, keep_ms=None):
    own = spark.newSession()
    own.conf.set(*ev.PROVIDER)
    own.conf.set("spark.sql.shuffle.partitions", "2")
    log = st.file_stream(own, f"{folder}/in", 1)
    st.ingest(ev.append_stream(log, ALLOWED, keep_ms), f"{folder}/out", f"{folder}/offsets", once=keep_ms is not None)
    return spark.read.parquet(f"{folder}/out")


def add(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    time.sleep(0.05)  # files are read in the order of their times


def test_stream_as_stored_log(spark, tmp_path):
    """Micro-batches, and a stop between them: state goes on from the checkpoint."""
    rows = sorted(some_rows(300, 5), key=lambda r: r[2])
    rows = [r for r in rows if r[0] is not None]
    for a, b in ((0, 100), (100, 230)):
        add(spark, tmp_path, random.Random(a).sample(rows[a:b], b - a))
    stream(spark, tmp_path)
    add(spark, tmp_path, rows[230:])
    assert outcomes(stream(spark, tmp_path)) == plain(rows)


def test_ids_expire(spark, tmp_path):
    add(spark, tmp_path, [(1, "x", 1, 5, "a", "p")])
    stream(spark, tmp_path, keep_ms=50)
    time.sleep(0.2)
    add(spark, tmp_path, [(1, "x", 2, 5, "a", "p")])
    assert [r[4] for r in outcomes(stream(spark, tmp_path, keep_ms=50))] == ["accepted", "stale"]


def test_state_holds_ids_in_blocks(spark, tmp_path):
    """The state has far fewer entries than ids, so that accepting one isn't a call of its own; ids that come again in later batches are found."""
    chain = [(k % 3, f"e{k}", k, None, "a" if k < 3 else "b" if k // 3 % 2 else "a", "p") for k in range(1500)]
    again = [(r[0], r[1], 5000 + i, None, r[4], "p" if i % 2 else "other") for i, r in enumerate(chain[::4])]
    own = spark.newSession()
    own.conf.set(*ev.PROVIDER)
    own.conf.set("spark.sql.shuffle.partitions", "2")
    for rows in (chain[:700], chain[700:], again):
        add(spark, tmp_path, rows)
    log = ev.append_stream(st.file_stream(own, f"{tmp_path}/in", 1), {None: frozenset("a"), "a": frozenset("b"), "b": frozenset("a")})
    query = log.writeStream.foreachBatch(lambda b, n: b.write.parquet(f"{tmp_path}/out/batch={n}")).option("checkpointLocation", f"{tmp_path}/offsets").trigger(availableNow=True).start()
    query.awaitTermination()
    got = outcomes(spark.read.parquet(f"{tmp_path}/out"))
    kinds = [r[4] for r in got]
    assert kinds.count("accepted") == 1500 and kinds.count("repeated") == 187 and kinds.count("conflict") == 188
    assert query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] < 150


@pytest.mark.parametrize("held", [2, 512])
def test_blocks_as_one_dictionary(monkeypatch, held):
    monkeypatch.setattr(ev.Blocks, "HELD", held)
    monkeypatch.setattr(ev.Blocks, "BLOCK", 4)

    class State(dict):
        containsKey, getValue, updateValue = dict.__contains__, dict.__getitem__, dict.__setitem__

    state, plain, rng = State(), {}, random.Random(3)
    for _ in range(40):
        ids = ev.Blocks(state, 7, len(plain))
        for _ in range(rng.randrange(60)):
            event = f"é{rng.randrange(2000)}"
            assert ids.known(event) == plain.get(event)
            if event not in plain:
                plain[event] = (rng.randrange(9), "a", rng.choice((None, "p")))
                ids.remember(event, plain[event])
        ids.write()
        assert ids.n == len(plain)
    assert len(plain) > 500 and len(state) < len(plain)
