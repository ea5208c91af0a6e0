"""Daily roll-ups, health findings and evaluation metrics."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.operators.joins import compare


def days(rows: DataFrame, first: date, last: date) -> DataFrame:
    """One row for each day; ``rows`` only gives the session."""
    return rows.sparkSession.range(1).select(F.explode(F.sequence(F.lit(first.isoformat()).cast("date"), F.lit(last.isoformat()).cast("date"))).alias("day"))


def in_days(rows: DataFrame, ts: str, first: date, last: date) -> DataFrame:
    """Rows of [first, last + 1 day) as a range that reaches the scan, with their day."""
    low, high = (F.lit(d.isoformat()).cast("timestamp_ntz") for d in (first, last))
    return rows.where((F.col(ts) >= low) & (F.col(ts) < high + F.expr("INTERVAL 1 DAY"))).withColumn("day", F.to_date(ts))


def densified(calendar: DataFrame, groups: DataFrame, zero: Sequence[str]) -> DataFrame:
    """Each day of the calendar, with zeros where there were no rows."""
    return calendar.join(groups, "day", "left").fillna(0, list(zero))


def daily_outcomes(rows: DataFrame, ts: str, failed: Column, first: date, last: date) -> DataFrame:
    groups = in_days(rows, ts, first, last).groupBy("day").agg(F.count_if(~failed).alias("ok"), F.count_if(failed).alias("failed"))
    return densified(days(rows, first, last), groups, ["ok", "failed"])


def histogram_by_day(rows: DataFrame, ts: str, kind: Column, first: date, last: date) -> DataFrame:
    """day and a list of (kind, n) in the order of kinds."""
    counts = in_days(rows, ts, first, last).groupBy("day", kind.alias("kind")).agg(F.count("*").alias("n"))
    return counts.groupBy("day").agg(F.array_sort(F.collect_list(F.struct("kind", "n"))).alias("kinds"))


def whole_number(column: str) -> Column:
    """A count from text: null unless it is a whole number of at least zero."""
    value = F.col(column).try_cast("bigint")
    return F.when(value >= 0, value)


def token_totals(rows: DataFrame, group: str, total: Column, first: Column, second: Column) -> DataFrame:
    """The explicit total of each row, else the sum of its parts, added up."""
    own = F.coalesce(total, first + second)
    return rows.groupBy(group).agg(F.sum(own).alias("tokens"), F.count_if(own.isNull()).alias("unknown"))


def timings(rows: DataFrame, group: str, value: Column) -> DataFrame:
    v = value.cast("decimal(28,6)")
    stats = rows.groupBy(group).agg(F.count(v).alias("n"), F.sum(v).alias("total"), F.max(v).alias("longest"))
    return stats.withColumn("mean", F.round(F.col("total") / F.col("n"), 6))


def quantity_changes(before: DataFrame, after: DataFrame, key: str, n: str, share: float = 0.5) -> DataFrame:
    """Keys whose number changed by at least ``share`` of the earlier one, or from nothing to something."""
    both = compare(before, after, key, n).select(key, F.coalesce("old_value", F.lit(0)).alias("before"), F.coalesce("new_value", F.lit(0)).alias("after"))
    hit = F.when(F.col("before") == 0, F.col("after") > 0).otherwise(F.abs(F.col("after") - F.col("before")) / F.col("before") >= share)
    return both.where(hit)


def health_issues(runs: DataFrame, key: str, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """For each kind of issue, how many keys have it and which, in order."""
    found = F.filter(F.array(*(F.when(F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules)), lambda x: x.isNotNull())
    each = runs.select(key, F.explode(found).alias("issue"))
    return each.groupBy("issue").agg(F.count("*").alias("n"), F.array_sort(F.collect_set(key)).alias("ids"))


def ratio(part: Column, whole: Column, empty: float | None = None) -> Column:
    """A share, or what stands for it where there is nothing to share."""
    return F.when(whole == 0, F.lit(empty)).otherwise(F.round(part / whole, 6))


def retrieval_metrics(cases: DataFrame) -> DataFrame:
    """relevant, cited (arrays) and answered of each case -> mean recall and precision over answerable cases, refusal accuracy."""
    hits = F.size(F.array_intersect("relevant", "cited"))
    answerable = F.size("relevant") > 0
    recall = F.when(answerable, hits / F.size("relevant")).otherwise(F.when(F.size("cited") == 0, 1.0).otherwise(0.0))
    precision = F.when(F.size("cited") > 0, hits / F.size("cited")).otherwise(F.when(answerable, 0.0).otherwise(1.0))
    return cases.agg(
        F.round(F.avg(F.when(answerable, recall)), 6).alias("recall"), F.round(F.avg(F.when(answerable, precision)), 6).alias("precision"),
        F.round(F.avg((F.col("answered") == answerable).cast("double")), 6).alias("refusal_accuracy"), F.count("*").alias("cases"),
    )
