"""Structured Streaming: idempotent ingest, sessions, run steps."""

from __future__ import annotations

import json
from collections.abc import Sequence
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from siftwell.operators.ranking import first_per_key


def file_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A Parquet table as a stream, be it a folder or one file; the schema is read from what is there."""
    own = spark.readStream.schema(spark.read.parquet(path).schema)
    return (own.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else own).parquet(f"{path[:-1]}[{path[-1]}]")  # as a pattern, which may name a file


def ingest(stream: DataFrame, target: str, checkpoint: str, once: bool = False) -> None:
    """Append each micro-batch under its own number. A batch that is replayed after a failure replaces itself, and the stream's
    offsets move on only after the write, so nothing is lost or doubled.

    Streams whose state expires by processing time never run out of batches; ``once`` ends them after one.
    """
    trigger = {"once": True} if once else {"availableNow": True}

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start().awaitTermination()


def ingested(spark: SparkSession, target: str, key: str) -> DataFrame:
    """What was ingested, each key once, the newest batch first."""
    return first_per_key(spark.read.parquet(target), [key], [F.desc("batch")]).drop("batch")


def dispositions(known: DataFrame, batch: DataFrame, key: str, content: Sequence[str]) -> DataFrame:
    """inserted, changed or reused for every row of a batch."""
    mark = F.xxhash64(*content)
    own = batch.withColumn("_m", mark).join(known.select(key, mark.alias("_k")), key, "left")
    kind = F.when(F.col("_k").isNull(), "inserted").when(F.col("_k") == F.col("_m"), "reused").otherwise("changed")
    return own.select(*batch.columns, kind.alias("disposition"))


def sessions(rows: DataFrame, key: str, ts: str, gap: str, watermark: str | None = None) -> DataFrame:
    """Runs of events with pauses under the gap; works on streams (with a watermark) and on tables."""
    own = rows.withColumn("_t", F.col(ts).cast("timestamp"))
    own = own.withWatermark("_t", watermark) if watermark else own
    out = own.groupBy(key, F.session_window("_t", gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def progress(query) -> list[dict]:
    """What each micro-batch did, for a run log."""
    return [{"batch": p["batchId"], "rows": p["numInputRows"], "ms": p["durationMs"].get("triggerExecution")} for p in query.recentProgress]


STEPS = "run string, sequence long, stage string, status string, at timestamp"


def record_step(spark: SparkSession, folder: str, run: str, sequence: int, stage: str, status: str) -> None:
    """One step event of a run, stored as it happens; the same step written twice replaces itself."""
    row = spark.createDataFrame([(run, sequence, stage, status)], "run string, sequence long, stage string, status string").withColumn("at", F.current_timestamp())
    row.drop("run", "sequence").write.mode("overwrite").json(f"{folder}/run={run}/sequence={sequence}")


def recorded_steps(spark: SparkSession, folder: str) -> DataFrame:
    """All step events, from the store."""
    return spark.read.schema(STEPS).json(folder).select("run", "sequence", "stage", "status", "at")


class StepListener(StreamingQueryListener):
    """Writes what happens to a session's streams as steps (``STEPS``), one small file each, without a Spark job.

    Stages are ``query`` (started, done, failed) and ``batch`` (done, with its number in the status). A file appears whole under a name that its run
    and sequence give, in the layout that ``recorded_steps`` reads. Runs are the streams' run ids, so a restart is a run of its own.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.next: dict[str, int] = {}

    def write(self, run: str, stage: str, status: str) -> None:
        sequence = self.next.get(run, 0)
        self.next[run] = sequence + 1
        line = json.dumps({"stage": stage, "status": status, "at": datetime.now(UTC).isoformat()})
        context = self.spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path
        own = path(f"{self.folder}/run={run}/sequence={sequence}/step.json")
        beside = path(f"{self.folder}/run={run}/sequence={sequence}/_step.json")  # readers pass over names with an underscore
        fs = own.getFileSystem(context._jsc.hadoopConfiguration())
        out = fs.create(beside, True)
        try:
            out.write(bytearray(f"{line}\n".encode()))
        finally:
            out.close()
        if not fs.rename(beside, own):
            raise OSError(f"{own.toString()} could not be written")

    def onQueryStarted(self, event) -> None:
        self.write(str(event.runId), "query", "started")

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.write(str(p.runId), "batch", f"done {p.batchId} rows {p.numInputRows}")

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.write(str(event.runId), "query", "failed" if event.exception else "done")


def stage_latencies(events: DataFrame, span: Sequence[str], phase: str, ts: str, own: str | None = None) -> DataFrame:
    """Events of stages with ``latency``, the seconds since their span's last start.

    A span is what the columns ``span`` name, so stages may overlap. ``phase`` is started, completed, error or anything between: a start begins anew,
    completed and error end the span, others don't. Starts have none; without an open start the latency is the event's ``own``, if it has one.
    Ties of time count as starts before ends.
    """
    order = F.when(F.col(phase) == "started", 0).when(F.col(phase).isin("completed", "error"), 2).otherwise(1)
    before = Window.partitionBy(*span).orderBy(ts, order).rowsBetween(Window.unboundedPreceding, -1)
    bound = F.col(phase).isin("started", "completed", "error")
    last = F.last(F.when(bound, F.struct(F.col(phase).alias("phase"), F.col(ts).alias("ts"))), ignorenulls=True).over(before)
    seconds = lambda c: F.unix_micros(c.cast("timestamp")) / 1e6
    since = F.when(last["phase"] == "started", F.greatest(seconds(F.col(ts)) - seconds(last["ts"]), F.lit(0.0)))
    fallback = F.col(own) if own else F.lit(None).cast("double")
    return events.withColumn("latency", F.when(F.col(phase) == "started", None).otherwise(F.coalesce(since, fallback)))
