"""Leases, steps and latencies of streams."""

import time

from siftwell.streaming import eventlog as ev
from siftwell.streaming import ingest as st
from siftwell.streaming import leases as le


def own_session(spark):
    own = spark.newSession()
    own.conf.set(*ev.PROVIDER)
    own.conf.set("spark.sql.shuffle.partitions", "2")
    return own


def send(spark, folder, *requests):
    spark.createDataFrame(list(requests), "item string, owner string, kind string").coalesce(1).write.mode("append").parquet(f"{folder}/in")


def batch(own, folder, lease_ms, most=5):
    """One run over what is there; rows of this run only."""
    target = f"{folder}/out"
    before = own.read.parquet(target).count() if folder.joinpath("out").exists() else 0
    st.ingest(le.lease_stream(st.file_stream(own, f"{folder}/in"), lease_ms, most), target, f"{folder}/offsets", once=True)
    rows = own.read.parquet(target).orderBy("batch").collect()
    return sorted((r.item, r.owner, r.outcome, r.attempts) for r in rows[before:])


def test_claims(spark, tmp_path):
    own = own_session(spark)
    send(spark, tmp_path, ("x", "a", "claim"), ("x", "a", "claim"), ("x", "b", "claim"), ("x", "b", "done"), ("x", "a", "renew"), (None, "a", "claim"))
    assert batch(own, tmp_path, 600_000, 2) == [("x", "a", "claimed", 1), ("x", "a", "held", 1), ("x", "a", "renewed", 1), ("x", "b", "busy", 1), ("x", "b", "lost", 1)]
    send(spark, tmp_path, ("x", "a", "failed"), ("x", "b", "claim"), ("x", "b", "failed"), ("x", "a", "claim"), ("y", "a", "claim"), ("y", "a", "done"), ("y", "b", "claim"))
    assert batch(own, tmp_path, 600_000, 2) == sorted(
        [("x", "a", "failed", 1), ("x", "b", "claimed", 2), ("x", "b", "failed", 2), ("x", "a", "exhausted", 2), ("y", "a", "claimed", 1), ("y", "a", "done", 1), ("y", "b", "finished", 1)]
    )


def test_a_lease_that_ran_out_goes_to_the_next(spark, tmp_path):
    own = own_session(spark)
    send(spark, tmp_path, ("x", "a", "claim"))
    assert batch(own, tmp_path, 100) == [("x", "a", "claimed", 1)]
    time.sleep(0.3)
    send(spark, tmp_path, ("x", "b", "claim"), ("x", "a", "done"))
    got = batch(own, tmp_path, 100)
    assert got == sorted([("x", "a", "expired", 1), ("x", "b", "claimed", 2), ("x", "a", "lost", 2)])


def test_leases_end_without_an_event(spark, tmp_path):
    own = own_session(spark)
    send(spark, tmp_path, ("x", "a", "claim"), ("z", "c", "claim"), ("z", "c", "done"))
    target = str(tmp_path / "out")
    write = le.lease_stream(st.file_stream(own, f"{tmp_path}/in"), 1_500).writeStream.format("parquet").option("path", target)
    stream = write.option("checkpointLocation", f"{tmp_path}/offsets").trigger(processingTime="300 milliseconds").start()
    rows = lambda: sorted((r.item, r.owner, r.outcome) for r in spark.read.schema(le.OUT).parquet(target).collect())
    try:
        deadline = time.time() + 60
        while time.time() < deadline and not any(r[2] == "expired" for r in rows()):
            time.sleep(0.3)
        assert rows() == [("x", "a", "claimed"), ("x", "a", "expired"), ("z", "c", "claimed"), ("z", "c", "done")]
        send(spark, tmp_path, ("x", "a", "done"), ("x", "b", "claim"))
        while time.time() < deadline and len(rows()) < 6:
            time.sleep(0.3)
    finally:
        stream.stop()
    assert {("x", "a", "lost"), ("x", "b", "claimed")} <= set(rows())


def test_steps_of_streams(spark, tmp_path):
    """Starts, batches and ends are stored as they happen; a failed stream says so; no job is run for them."""
    own = own_session(spark)
    listener = st.StepListener(own, f"{tmp_path}/steps")
    own.streams.addListener(listener)
    try:
        spark.range(10).write.parquet(f"{tmp_path}/in")
        st.ingest(st.file_stream(own, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/offsets")
        broken = st.file_stream(own, f"{tmp_path}/in").selectExpr("raise_error(cast(id as string)) as x")
        try:
            st.ingest(broken, f"{tmp_path}/out2", f"{tmp_path}/offsets2")
        except Exception:  # it must fail
            pass
        deadline = time.time() + 30
        read = lambda: [(r.run, r.sequence, r.stage, r.status) for r in st.recorded_steps(spark, f"{tmp_path}/steps").orderBy("run", "sequence").collect()]
        while time.time() < deadline and sum(r[2] == "query" for r in read()) < 4:
            time.sleep(0.2)
    finally:
        own.streams.removeListener(listener)
    by_run = {}
    for run, sequence, stage, status in read():
        by_run.setdefault(run, []).append((sequence, stage, status))
    assert sorted(v[-1][1:] for v in by_run.values()) == [("query", "done"), ("query", "failed")]
    good = next(v for v in by_run.values() if v[-1][2] == "done")
    assert [s for s, _, _ in good] == list(range(len(good))) and good[0][1:] == ("query", "started") and ("batch", "done 0 rows 10") in [g[1:] for g in good]


def test_latencies_of_overlapping_stages(spark):
    rows = [
        ("a", "started", 0.0, None), ("b", "started", 1.0, None), ("a", "progress", 2.0, None), ("b", "completed", 3.5, 9.0), ("a", "completed", 5.0, None),
        ("a", "completed", 6.0, None), ("a", "progress", 6.5, 0.25), ("a", "started", 7.0, None), ("a", "started", 8.0, None), ("a", "error", 8.0, None), ("c", "error", 1.0, 4.0),
    ]
    df = spark.createDataFrame([(s, p, t, o) for s, p, t, o in rows], "stage string, phase string, t double, own double").selectExpr("stage", "phase", "timestamp_millis(cast(t * 1000 as long)) as ts", "t", "own")
    got = {(r.stage, r.phase, r.t): r.latency for r in st.stage_latencies(df, ["stage"], "phase", "ts", "own").collect()}
    assert got == {
        ("a", "started", 0.0): None, ("b", "started", 1.0): None, ("a", "progress", 2.0): 2.0, ("b", "completed", 3.5): 2.5, ("a", "completed", 5.0): 5.0, ("a", "completed", 6.0): None,
        ("a", "progress", 6.5): 0.25, ("a", "started", 7.0): None, ("a", "started", 8.0): None, ("a", "error", 8.0): 0.0, ("c", "error", 1.0): 4.0,
    }
