"""Filters and ordered cases over catalogue rows. NULL is never true, and zero is a score."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def all_of(*conditions: Column | None) -> Column:
    """AND of those conditions that are given."""
    return reduce(lambda a, b: a & b, [c for c in conditions if c is not None], F.lit(True))


def browse_base(cohort: int = 2027, batches: Sequence[str] = ("formal", "early"), inactive: str = "inactive:") -> Column:
    """What browsing shows: confirmed jobs of a cohort in some batches that aren't marked inactive; a null reference is active."""
    active = F.col("source_ref").isNull() | ~F.startswith("source_ref", F.lit(inactive))
    return (F.col("cohort") == cohort) & (F.lower("cohort_status") == "confirmed") & F.col("batch").isin(*batches) & active


def text_contains(text: str | None, *columns: str) -> Column | None:
    """Literal substring in lower case over the joined columns; % and _ mean themselves."""
    if not text:
        return None
    joined = F.lower(F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in columns)))
    return F.contains(joined, F.lit(text.lower()))


def like_any(pattern: str | None, *columns: str) -> Column | None:
    """The pattern language of LIKE, unescaped, over any of the columns, ignoring case."""
    if not pattern:
        return None
    return reduce(lambda a, b: a | b, (F.coalesce(F.lower(c).like(f"%{pattern.lower()}%"), F.lit(False)) for c in columns))


def on_day(column: str, day: date | None) -> Column | None:
    """A day of a timestamp as a half-open range, which reaches the scan."""
    if day is None:
        return None
    first = F.lit(day.isoformat()).cast("timestamp_ntz")
    return (F.col(column) >= first) & (F.col(column) < first + F.expr("INTERVAL 1 DAY"))


def score_band(score: str) -> Column:
    """high from 70, medium from 60, low below; null without a score."""
    s = F.col(score)
    return F.when(s >= 70, "high").when(s >= 60, "medium").when(s < 60, "low")


def evaluation(score: str = "score", screen: str = "screen", capture: str = "capture_status") -> Column:
    """scored, excluded, jd_incomplete, pending (eligible and captured) or unscored."""
    return (
        F.when(F.col(score).isNotNull(), "scored")
        .when(F.col(screen).isin("not_target", "internship", "doctorate", "direction_out"), "excluded")
        .when(F.col(screen) == "jd_incomplete", "jd_incomplete")
        .when((F.col(screen) == "eligible") & (F.col(capture) == "complete"), "pending")
        .otherwise("unscored")
    )


def first_containing(subject: Column, rules: Sequence[tuple[str, str]], default: str) -> Column:
    """Label of the first rule whose text the subject contains."""
    out = F.lit(default)
    for text, label in reversed(rules):
        out = F.when(F.contains(subject, F.lit(text)), label).otherwise(out)
    return out


def first_failing(rules: Sequence[tuple[str, Column]]) -> Column:
    """Name of the first rule that fails (a null counts as failing), null if all hold."""
    out = F.lit(None).cast("string")
    for name, rule in reversed(rules):
        out = F.when(F.coalesce(rule, F.lit(False)), out).otherwise(name)
    return out


def first_matching(subject: Column | str, rules: Sequence[tuple[str, str]], default: str) -> Column:
    """Label of the first regex that is found in the subject; the order is the specification."""
    own = F.col(subject) if isinstance(subject, str) else subject
    out = F.lit(default)
    for pattern, label in reversed(rules):
        out = F.when(own.rlike(pattern), label).otherwise(out)
    return out


def first_present(rows: DataFrame, names: Sequence[str]) -> Column:
    """The first non-null of those columns that the table has; null if it has none."""
    have = [F.col(n) for n in names if n in rows.columns]
    return F.coalesce(*have) if have else F.lit(None)


def pagination(complete: str, more: str, pages: str, total: str) -> Column:
    """complete, incomplete or unknown, from flags and counters that may be null."""
    done = F.coalesce(F.col(complete) & ~F.coalesce(F.col(more), F.lit(False)), F.lit(False)) | F.coalesce(F.col(pages) >= F.col(total), F.lit(False))
    short = F.coalesce(F.col(more), F.lit(False)) | F.coalesce(F.col(pages) < F.col(total), F.lit(False))
    return F.when(short, "incomplete").when(done, "complete").otherwise("unknown")
