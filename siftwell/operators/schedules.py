"""Recurrence, queues, retention and retries over event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def due_occurrences(schedules: DataFrame, done: DataFrame, key: str, first: str, last: str, until: Column) -> DataFrame:
    """Daily occurrences of each schedule that are due and were not executed: the newest is claimed, older ones are skipped."""
    days = F.explode(F.sequence(F.to_date(first), F.to_date(last))).alias("day")
    open_ = schedules.select(key, days).where(F.col("day") <= until).join(done.select(key, "day"), [key, "day"], "left_anti")
    newest = open_.groupBy(key).agg(F.max("day").alias("claimed"), F.count("*").alias("_n"))
    return newest.select(key, "claimed", (F.col("_n") - 1).alias("skipped"))


def unacknowledged(sent: DataFrame, acked: DataFrame, keys: list[str]) -> DataFrame:
    return sent.join(acked.select(*keys), keys, "left_anti")


def unacknowledged_ranges(sent: DataFrame, acked: DataFrame, device: str, sequence: str, after: DataFrame | None = None, block: int = 10_000) -> DataFrame:
    """device, first, last and n of the runs of consecutive sequences that were sent and not acknowledged: what is sent again, and nothing else.

    ``after`` (device, cursor) leaves out what a device has beyond doubt; acknowledgements missing ahead of later ones are still found behind it.
    Runs are built in blocks of sequences and only then joined at the blocks' borders, so a device with very many messages is many tasks.
    """
    open_ = sent.select(device, F.col(sequence).cast("long").alias("_s")).distinct().join(acked.select(device, F.col(sequence).cast("long").alias("_s")).distinct(), [device, "_s"], "left_anti")
    if after is not None:
        open_ = open_.join(after.select(device, F.col("cursor").alias("_c")), device, "left").where(F.col("_c").isNull() | (F.col("_s") > F.col("_c")))
    inner = Window.partitionBy(device, F.floor(F.col("_s") / block)).orderBy("_s")
    parts = open_.withColumn("_k", F.col("_s") - F.row_number().over(inner)).groupBy(device, F.floor(F.col("_s") / block).alias("_b"), "_k").agg(F.min("_s").alias("_f"), F.max("_s").alias("_l"))
    along = Window.partitionBy(device).orderBy("_f")
    fresh = (F.col("_f") != F.lag("_l").over(along) + 1).cast("int")
    runs = parts.withColumn("_new", F.coalesce(fresh, F.lit(1))).withColumn("_run", F.sum("_new").over(along))
    return runs.groupBy(device, "_run").agg(F.min("_f").alias("first"), F.max("_l").alias("last"), F.sum(F.col("_l") - F.col("_f") + 1).alias("n")).drop("_run")


def compacted(rows: DataFrame, pinned: DataFrame, key: str, ts: str, before: Column, details: str, waiting: DataFrame | None = None, waiting_key: str = "event_id") -> DataFrame:
    """Details of rows older than a time go, unless the key is pinned or the row still waits for its acknowledgement."""
    own = rows.join(pinned.select(key).distinct().withColumn("_p", F.lit(True)), key, "left")
    keep = F.col("_p").isNotNull()
    if waiting is not None:
        own = own.join(waiting.select(waiting_key).distinct().withColumn("_w", F.lit(True)), waiting_key, "left")
        keep = keep | F.col("_w").isNotNull()
    return own.withColumn(details, F.when((F.col(ts) < before) & ~keep, None).otherwise(F.col(details))).drop("_p", "_w").select(*rows.columns)


def retry_state(attempts: Column, last_ts: Column, now: Column, base: int = 60, limit: int = 5, longest: int = 3600) -> Column:
    """exhausted, waiting or ready under an exponential pause after each attempt."""
    pause = F.least(F.lit(longest), F.lit(base) * F.pow(F.lit(2), attempts - 1))
    age = F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(last_ts.cast("timestamp"))
    return F.when(attempts >= limit, "exhausted").when(age < pause, "waiting").otherwise("ready")


def leased_state(started: Column, ended: Column, attempts: Column, now: Column, lease: int = 180, base: int = 60, limit: int = 5, longest: int = 3600) -> Column:
    """running while the last attempt's lease holds; an attempt that never ended and outlived its lease counts as failed at the lease's end."""
    seconds = lambda c: F.unix_seconds(c.cast("timestamp"))
    open_ = ended.isNull() & started.isNotNull()
    over = F.when(open_, seconds(started) + lease).otherwise(seconds(ended))
    held = open_ & (seconds(now) < over)
    return F.when(started.isNull(), "ready").when(held, "running").otherwise(retry_state(attempts, F.timestamp_seconds(over), now, base, limit, longest))


def scope_digest(*parts: str | Column) -> Column:
    """A digest of what a run covers, in a stated order."""
    return F.sha2(F.to_json(F.array(*(F.lit(p) if isinstance(p, str) else p for p in parts))), 256)


def resume_states(work: DataFrame, attempts: DataFrame, key: str, digest: Column, most: int = 3) -> DataFrame:
    """pending, retry, exhausted or done for each row of the work. ``attempts``: key, scope, ok; only those of the same scope count."""
    own = attempts.where(F.col("scope") == digest).groupBy(key).agg(F.count_if(~F.col("ok")).alias("_failed"), F.bool_or("ok").alias("_done"))
    state = F.when(F.col("_done"), "done").when(F.col("_failed") >= most, "exhausted").when(F.col("_failed") > 0, "retry").otherwise("pending")
    return work.join(own, key, "left").select(*work.columns, state.alias("state"))
