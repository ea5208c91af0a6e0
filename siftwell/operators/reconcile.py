"""Snapshots against state: what is new, changed, missing, back; guarded merges."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reconcile_presence(state: DataFrame, seen: DataFrame, runs: DataFrame, key: str, scope: str, grace_runs: int = 2, grace_days: float = 3.0) -> DataFrame:
    """The next state of each key.

    ``state``: key, scope, status (active, missing, inactive), missing_runs, missing_since, last_missing_at. ``seen``: keys observed.
    ``runs``: scope, observed_at, complete. Scopes without a complete run stay as they are. Seen keys are active (restored if they
    were missing). Others count a run unless this observation counted already; they turn inactive after max(2, grace_runs) runs and
    grace_days, and never while the age is unknown. Inactive stays until seen.
    """
    good = runs.where("complete").groupBy(scope).agg(F.max("observed_at").alias("observed_at"))
    rows = state.join(seen.select(key).distinct().withColumn("_seen", F.lit(True)), key, "left").join(good, scope, "left")
    again = F.col("last_missing_at").eqNullSafe(F.col("observed_at"))
    counted = F.col("missing_runs") + F.when(again, 0).otherwise(1)
    since = F.coalesce("missing_since", "observed_at")
    age = (F.unix_micros(F.col("observed_at").cast("timestamp")) - F.unix_micros(since.cast("timestamp"))) / 86_400e6
    gone = (counted >= max(2, grace_runs)) & F.coalesce(age >= grace_days, F.lit(False))
    idle, here = F.col("observed_at").isNull(), F.coalesce("_seen", F.lit(False))
    status = F.when(idle, F.col("status")).when(here, "active").when((F.col("status") == "inactive") | gone, "inactive").otherwise("missing")
    action = (
        F.when(idle, "unchanged").when(here & (F.col("status") == "active"), "observed").when(here, "restored").when(F.col("status") == "inactive", "unchanged").when(gone, "inactivated").otherwise("missing")
    )
    counts = lambda now, keep, reset: F.when(idle, F.col(keep)).when(here, reset).when(F.col("status") == "inactive", F.col(keep)).otherwise(now)
    return rows.select(
        key, scope, status.alias("status"), action.alias("action"), counts(counted, "missing_runs", F.lit(0)).alias("missing_runs"), counts(since, "missing_since", F.lit(None)).alias("missing_since"),
        counts(F.col("observed_at"), "last_missing_at", F.lit(None)).alias("last_missing_at"),
    )


def merge(target: DataFrame, incoming: DataFrame, key: str, rules: Mapping[str, Column], fixed: Sequence[str] = (), guard: Column | None = None) -> DataFrame:
    """A full outer merge. Columns come from the incoming row (in the rules as ``new.x``, the old as ``old.x``) unless a rule says
    otherwise; fixed columns never change once they are there; where the guard fails the old row stays whole."""
    t, i = target.select(F.struct("*").alias("old")), incoming.select(F.struct("*").alias("new"))
    both = t.join(i, F.col(f"old.{key}") == F.col(f"new.{key}"), "full_outer")
    absent, no_new = F.col("old").isNull(), F.col("new").isNull()
    stay = no_new | (~absent & ~F.coalesce(guard, F.lit(False))) if guard is not None else no_new
    out = []
    for c in target.columns:
        new = F.col(f"new.{c}")
        value = F.coalesce(F.col(f"old.{c}"), new) if c == key or c in fixed else rules.get(c, new)
        out.append(F.when(absent, new).when(stay, F.col(f"old.{c}")).otherwise(value).alias(c))
    action = F.when(absent, "inserted").when(no_new, "kept").when(stay, "guarded").otherwise("updated")
    return both.select(*out, action.alias("action"))


def change_kinds(stored: DataFrame, incoming: DataFrame, key: str, fingerprint: str) -> DataFrame:
    """key and kind of each incoming row: new, changed or reused."""
    own = stored.select(key, F.col(fingerprint).alias("_old"))
    kind = F.when(F.col("_old").isNull(), "new").when(F.col("_old") == F.col(fingerprint), "reused").otherwise("changed")
    return incoming.join(own, key, "left").select(key, kind.alias("kind"))


def sync_plan(stored: DataFrame, incoming: DataFrame, key: str, content: Sequence[str]) -> DataFrame:
    """delete, skip, update or insert for every key of either side."""
    mark = F.struct(*content)
    both = stored.select(key, mark.alias("_o")).join(incoming.select(key, mark.alias("_n")), key, "full_outer")
    action = F.when(F.col("_n").isNull(), "delete").when(F.col("_o").isNull(), "insert").when(F.col("_o") == F.col("_n"), "skip").otherwise("update")
    return both.select(key, action.alias("action"))


def prune(rows: DataFrame, key: str, managed: Column, keep: DataFrame) -> DataFrame:
    """What stays: unmanaged rows, and managed ones on the list."""
    return rows.join(keep.select(key).distinct().withColumn("_keep", F.lit(True)), key, "left").where(~managed | F.col("_keep").isNotNull()).drop("_keep")


def advance_stage(now: Column, target: Column, order: Sequence[str], always: str) -> Column:
    """The later of two stages; the always-stage is reached from anywhere."""
    names = F.array(*map(F.lit, order))
    return F.when(target == always, target).when(F.array_position(names, target) > F.array_position(names, now), target).otherwise(now)
