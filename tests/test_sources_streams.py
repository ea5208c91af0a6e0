"""Sources, sinks and streams on temporary folders."""

import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from siftwell.sources import readers as rd
from siftwell.sources import writers as wr
from siftwell.streaming import ingest as st


def test_lines_and_documents(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1, "b": "x"}\n\nbroken\n{"a": "no", "b": "y"}\n')
    got = rd.read(spark, "jsonl", str(tmp_path / "a.jsonl"), schema="a long, b string")
    assert {r.line_state: r["count"] for r in got.groupBy("line_state").count().collect()} == {"ok": 1, "blank": 1, "malformed": 2}
    (tmp_path / "d.json").write_text(json.dumps([{"k": 1}, {"k": 2}], indent=1))
    assert rd.read(spark, "json", str(tmp_path / "d.json"), schema="k long").agg(F.sum("k")).first()[0] == 3
    with pytest.raises(ValueError, match="unknown source"):
        rd.read(spark, "nope", "x")


def test_files_and_manifest(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x/one.md").write_text("# one")
    (tmp_path / "x/two.bin").write_text("two")
    assert [r.content for r in rd.read(spark, "text_files", str(tmp_path / "x")).collect()] == ["# one"]
    assert rd.read(spark, "manifest", str(tmp_path / "x")).count() == 2
    (tmp_path / "c.yaml").write_text("companies:\n- {id: a, name: A}\n- {id: b, name: B}\n")
    assert rd.read(spark, "yaml", str(tmp_path / "c.yaml"), key="companies", schema="id string, name string").count() == 2


def test_sqlite_source(spark, tmp_path):
    path = str(tmp_path / "f.db")
    with sqlite3.connect(path) as con:
        con.execute('CREATE TABLE "my t" (id INTEGER PRIMARY KEY, name TEXT, score REAL)')
        con.executemany('INSERT INTO "my t" VALUES (?, ?, ?)', [(i, f"n{i}", i / 2 if i % 3 else None) for i in range(1, 101)])
        con.execute("CREATE TABLE empty (x TEXT)")
    df = rd.read(spark, "sqlite", path, table="my t", parts=3)
    assert df.dtypes == [("id", "bigint"), ("name", "string"), ("score", "double")]
    assert df.where("id > 50").count() == 50 and df.where("score is null").count() == 33
    assert rd.read(spark, "sqlite", path, table="empty").count() == 0


def test_snapshots_appear_whole(spark, tmp_path):
    folder = str(tmp_path / "snap")
    wr.write_snapshot(spark.range(3), folder, 1)
    wr.write_snapshot(spark.range(5), folder, 2)
    (tmp_path / "snap/version=3").mkdir()  # was interrupted
    assert wr.latest_snapshot(spark, folder).count() == 5
    wr.write_lines(spark.range(2), str(tmp_path / "lines"))
    wr.append_trace(spark.range(2).withColumn("token", F.lit("s")), str(tmp_path / "trace"), ["token"])
    assert {r.token for r in spark.read.json(str(tmp_path / "trace")).collect()} == {"[REDACTED]"}


def test_reports(spark):
    df = spark.createDataFrame([(2, "a|b"), (1, None)], "k long, v string")
    assert wr.report_markdown(df, "T").splitlines()[-2:] == ["| 1 |  |", "| 2 | a\\|b |"]
    assert json.loads(wr.report_json(df))[0]["k"] in (1, 2)
    with pytest.raises(ValueError):
        wr.report_json(df, 1)


def test_stream_is_replayed_without_doubles(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(10).withColumn("v", F.lit(1)).write.parquet(source)
    st.ingest(st.file_stream(spark, source), target, str(tmp_path / "c1"))
    st.ingest(st.file_stream(spark, source), target, str(tmp_path / "c1"))  # nothing new
    spark.range(5, 12).withColumn("v", F.lit(2)).write.mode("append").parquet(source)
    st.ingest(st.file_stream(spark, source), target, str(tmp_path / "c1"))
    st.ingest(st.file_stream(spark, source), target, str(tmp_path / "c2"))  # lost offsets: batch 0 replaces itself
    got = {r.id: r.v for r in st.ingested(spark, target, "id").collect()}
    assert set(got) == set(range(12)) and got[11] == 2


def test_lines_are_replaced_whole(spark, tmp_path):
    path = f"{tmp_path}/lines"
    wr.write_lines(spark.range(3), path)
    broken = spark.range(3).select(F.raise_error(F.lit("no")).cast("long").alias("id"))
    with pytest.raises(Exception, match="no"):
        wr.write_lines(broken, path)
    assert spark.read.json(path).count() == 3
    wr.write_lines(spark.range(5), path)
    assert spark.read.json(path).count() == 5
    import os

    assert sorted(os.listdir(tmp_path)) == ["lines"] or all(n.endswith(".tmp") for n in os.listdir(tmp_path) if n != "lines")
    os.rename(path, f"{path}.0a.old")  # as a crash between the renames leaves it
    assert wr.restore_lines(spark, path) and not wr.restore_lines(spark, path)
    assert spark.read.json(path).count() == 5


def test_steps_and_traces(spark, tmp_path):
    for n, (stage, status) in enumerate([("fetch", "started"), ("fetch", "done"), ("write", "done")]):
        st.record_step(spark, f"{tmp_path}/steps", "r1", n, stage, status)
    st.record_step(spark, f"{tmp_path}/steps", "r1", 2, "write", "failed")
    rows = st.recorded_steps(spark, f"{tmp_path}/steps").orderBy("sequence").collect()
    assert [(r.run, r.sequence, r.stage, r.status) for r in rows] == [("r1", 0, "fetch", "started"), ("r1", 1, "fetch", "done"), ("r1", 2, "write", "failed")]
    for k in "ab":
        wr.append_trace(spark.createDataFrame([(k, "s")], "who string, token string"), f"{tmp_path}/trace-{k}", ["token"])
    got = rd.read_traces(spark, f"{tmp_path}/trace-a", f"{tmp_path}/trace-b").collect()
    assert {(r.who, r.token) for r in got} == {("a", "[REDACTED]"), ("b", "[REDACTED]")} and len({r.trace_file for r in got}) == 2
