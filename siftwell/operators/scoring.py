"""Bounded scores, quality decisions and reuse decisions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Caps by evidence level and by the number of missing core requirements, labels from scores.
EVIDENCE_CAPS = (("direct", 100), ("partial", 89), ("adjacent", 79), ("insufficient", 49))
MISSING_CAPS = ((0, 100), (1, 84), (2, 74))
MANY_MISSING_CAP, NO_CORE_CAP, ONE_CORE_CAP = 64, 79, 89


def capped_score(parts: Sequence[Column], level: Column, direct_core: Column, missing: Column) -> Column:
    """The sum of the parts under every cap that applies; 90 and more needs two direct core matches."""
    by_level, by_missing = F.lit(49), F.lit(MANY_MISSING_CAP)
    for name, cap in EVIDENCE_CAPS:
        by_level = F.when(level == name, cap).otherwise(by_level)
    for n, cap in MISSING_CAPS:
        by_missing = F.when(missing == n, cap).otherwise(by_missing)
    total = sum(parts[1:], parts[0])
    score = F.least(F.lit(100), total, by_level, by_missing, F.when(direct_core == 0, NO_CORE_CAP).otherwise(100))
    return F.when((score >= 90) & (direct_core < 2), ONE_CORE_CAP).otherwise(score)


def recommendation(score: Column) -> Column:
    return F.when(score >= 80, "recommended").when(score >= 60, "consider").otherwise("not_recommended")


def reuse_decision(same: Column, complete: Column, target: Column) -> Column:
    return F.when(~target, "filter").when(same & complete, "reuse").otherwise("analyze")


def text_quality(text: Column, shell: str, sections: Sequence[str], truncated_at: int = 500) -> Column:
    """Ordered reasons: empty, shell, missing_section, truncated, complete."""
    body = F.trim(F.coalesce(text, F.lit("")))
    missing = F.lit(False)
    for s in sections:
        missing = missing | ~F.contains(F.lower(body), F.lit(s))
    return (
        F.when(body == "", "empty")
        .when(body.rlike(shell), "shell")
        .when(missing, "missing_section")
        .when((F.length(body) == truncated_at) & ~body.rlike(r"[.!?。！？]$"), "truncated")
        .otherwise("complete")
    )


def evidence_flags(text: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Names of all rules that are found, in the order of the rules."""
    return F.array_compact(F.array(*(F.when(text.rlike(pattern), F.lit(name)) for name, pattern in rules)))
