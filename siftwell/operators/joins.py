"""Joins of the catalogue: enrichment, lookups, ranges, several keys, comparison of two sides."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.operators.ranking import first_per_key


def enrich(rows: DataFrame, companies: DataFrame, analyses: DataFrame) -> DataFrame:
    """Jobs with company and analysis; jobs without either stay. Spark broadcasts a side only if its size allows."""
    out = rows.join(companies, "company_id", "left")
    return out.join(analyses, out.id == analyses.job_id, "left").drop("job_id")


def effective_score(own: str, analysed: str, status: str) -> Column:
    """Null while a status other than '' and 'complete' holds, else the first score there is; zero is a score."""
    hidden = (F.col(status) != "") & (F.col(status) != "complete")
    return F.when(hidden, None).otherwise(F.coalesce(own, analysed))


def join_if_needed(rows: DataFrame, other: DataFrame, on: str, text: str | None, columns: list[str]) -> DataFrame:
    """The join is part of the plan only if a text filter looks at the other side."""
    if text is None:
        return rows
    hit = reduce(lambda a, b: a | b, (F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(text.lower())) for c in columns))
    return rows.join(other, on, "left").where(hit)


def latest_lookup(rows: DataFrame, history: DataFrame, key: str, order: list[Column], value: str, as_name: str) -> DataFrame:
    """Each row with the value of its key's first history row in the given order."""
    latest = first_per_key(history, [key], order).select(key, F.col(value).alias(as_name))
    return rows.join(latest, key, "left")


def unpivot_keys(rows: DataFrame, id_col: str, keys: list[str], id_name: str, carry: list[str] | None = None) -> DataFrame:
    """(method, value, id) and the columns to carry for every key that is there."""
    pairs = F.array(*(F.struct(F.lit(k).alias("method"), F.col(k).cast("string").alias("value")) for k in keys))
    return rows.select(F.col(id_col).alias(id_name), *(carry or []), F.inline(pairs)).where("value is not null and value <> ''")


def multi_key_match(left: DataFrame, right: DataFrame, left_id: str, right_id: str, keys: list[str], same: str | None = None) -> DataFrame:
    """Rows of the left whose keys, together, lead to exactly one row of the right: matched, ambiguous or new.

    The right is one row for each (method, value), with its smallest and largest id, so no pairs are formed: a left row has one match
    where the smallest and the largest id over all its keys are the same. With ``same`` both sides must agree on that column.
    """
    side = lambda rows, id_col, name: unpivot_keys(rows, id_col, keys, name, [same] if same else [])
    by = ["method", "value", *([same] if same else [])]
    ends = side(right, right_id, "right_id").groupBy(*by).agg(F.min("right_id").alias("low"), F.max("right_id").alias("high"))
    found = side(left, left_id, "left_id").join(ends, by).groupBy("left_id").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    out = left.select(F.col(left_id).alias("left_id")).join(found, "left_id", "left")
    one = F.col("low") == F.col("high")
    status = F.when(F.col("low").isNull(), "new").when(one, "matched").otherwise("ambiguous")
    return out.select("left_id", status.alias("status"), F.when(one, F.col("low")).alias("right_id"))


def points_in_intervals(points: DataFrame, intervals: DataFrame, at: str, start: str, end: str, width: int, group: str | None = None) -> DataFrame:
    """start <= at < end by bins of ``width`` seconds, so that it is an equi-join; an interval meets each of its bins."""
    bin_of = lambda c: F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / width)
    bins = intervals.withColumn("_bin", F.explode(F.sequence(bin_of(start), bin_of(end))))
    keys = ["_bin", *([group] if group else [])]
    return points.withColumn("_bin", bin_of(at)).join(bins, keys).where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("_bin")


def overlapping_pairs(events: DataFrame, id_col: str, start: str, end: str, group: str, width: int = 86_400) -> DataFrame:
    """Pairs of one group with max(start) < min(end), each once, with the stretch they share.

    An interval goes to each bin of ``width`` seconds that it touches, and a pair counts in the bin where its overlap begins, so a
    group of many intervals is met bin by bin and not all with all.
    """
    bin_of = lambda c: F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / width)
    binned = events.where(F.col(start) <= F.col(end)).withColumn("_bin", F.explode(F.sequence(bin_of(start), bin_of(end))))
    a = binned.select(F.col(group), "_bin", F.col(id_col).alias("first_id"), F.col(start).alias("_s"), F.col(end).alias("_e"))
    b = binned.select(F.col(group), "_bin", F.col(id_col).alias("second_id"), F.col(start).alias("_s2"), F.col(end).alias("_e2"))
    met = a.join(b, [group, "_bin"]).where((F.col("first_id") < F.col("second_id")) & (F.col("_s") < F.col("_e2")) & (F.col("_s2") < F.col("_e")))
    met = met.where(F.col("_bin") == F.floor(F.unix_seconds(F.greatest("_s", "_s2").cast("timestamp")) / width))
    return met.select(group, "first_id", "second_id", F.greatest("_s", "_s2").alias("overlap_start"), F.least("_e", "_e2").alias("overlap_end"))


def fill_missing(rows: DataFrame, catalog: DataFrame, id_col: str, name_col: str, fields: list[str]) -> DataFrame:
    """Null fields from the catalogue row with the same id, else with the same name in lower case (of several the smallest id)."""
    by_id = catalog.select(F.col(id_col), *(F.col(f).alias(f"_i_{f}") for f in fields))
    by_name = first_per_key(catalog.withColumn("_name", F.lower(name_col)), ["_name"], [F.col(id_col)]).select("_name", *(F.col(f).alias(f"_n_{f}") for f in fields))
    out = rows.withColumn("_name", F.lower(name_col)).join(by_id, id_col, "left").join(by_name, "_name", "left")
    return out.select(*(F.coalesce(c, f"_i_{c}", f"_n_{c}").alias(c) if c in fields else c for c in rows.columns))


def compare(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """Both sides by key: added, removed, changed or same."""
    a, b = old.select(key, F.col(value).alias("old_value")), new.select(key, F.col(value).alias("new_value"))
    kind = (
        F.when(~F.col("_a"), "added").when(~F.col("_b"), "removed").when(F.col("old_value").eqNullSafe(F.col("new_value")), "same").otherwise("changed")
    )
    both = a.withColumn("_a", F.lit(True)).join(b.withColumn("_b", F.lit(True)), key, "full_outer")
    both = both.withColumn("_a", F.coalesce("_a", F.lit(False))).withColumn("_b", F.coalesce("_b", F.lit(False)))
    return both.select(key, "old_value", "new_value", kind.alias("change"))


def resequence(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """Positions from 1 within a group by a total order."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(group).orderBy(*order)))


def least_near(asked: DataFrame, rows: DataFrame, keys: list[str], at: str, id_col: str, asker: str, width: float) -> DataFrame:
    """asker, keys, n and least: how many rows with the same keys have ``abs(asked.at - rows.at) < width``, and their smallest id. None: no row.

    No pairs are formed but at the ends of a range. Values fall into units, under a 4,000th of ``width``, and units into blocks of about
    ``width``: a range is the last part of one block, the first part of a later one, and the block between them if there is one. Parts
    are running counts and minima over the units of a block, which the range's ends are sorted among. In the units where a range may end the distinct
    values are compared themselves. Values that are null, not finite or of 1e12 and more are near nothing.
    """
    unit = 2.0 ** (math.floor(math.log2(width)) - 12)  # a power of two, so that units are exact
    size = int(width / unit)
    good = reduce(lambda x, k: x & F.col(k).isNotNull(), keys, (F.abs(at) < 1e12) & ~F.isnan(at))
    cells = rows.where(good).groupBy(*keys, F.col(at).cast("double").alias("_v")).agg(F.count("*").alias("n"), F.min(id_col).alias("least")).withColumn("_u", F.floor(F.col("_v") / unit))
    ends = asked.where(good).select(asker, *keys, F.col(at).cast("double").alias("_at"), F.floor(F.col(at).cast("double") / unit).alias("_q"))
    block = lambda u: F.floor(u / F.lit(size))
    low, high = F.col("_q") - (size - 2), F.col("_q") + (size - 2)  # all units between are nearer than width
    way = lambda up, b, u: F.struct(F.lit(up).alias("_up"), b.alias("_b"), (u if up else -u).cast("long").alias("_o"))
    parts = F.array(way(False, block(low), low), way(True, block(high), high))
    between = F.when(block(high) - block(low) == 2, F.array(way(True, block(low) + 1, block(high) * size - 1))).otherwise(F.slice(parts, 1, 0))
    tasks = ends.select(asker, *keys, F.inline(F.concat(parts, between)))
    units = cells.groupBy(*keys, "_u").agg(F.sum("n").alias("n"), F.min("least").alias("least"))
    both = units.select(*keys, "n", "least", F.inline(F.array(*(way(up, block(F.col("_u")), F.col("_u")) for up in (False, True)))))
    run = Window.partitionBy(*keys, "_up", "_b").orderBy("_o")  # up to and with the same unit
    sorted_in = tasks.unionByName(both, allowMissingColumns=True)
    inner = sorted_in.select(asker, *keys, F.sum("n").over(run).alias("n"), F.min("least").over(run).alias("least")).where(F.col(asker).isNotNull() & F.col("n").isNotNull())
    edge = ends.withColumn("_u", F.explode(F.array(*(F.col("_q") + d * s for d in (size - 1, size, size + 1) for s in (-1, 1)))))
    outer = edge.join(cells, [*keys, "_u"]).where(F.abs(F.col("_at") - F.col("_v")) < width).select(asker, *keys, "n", "least")
    return inner.unionByName(outer).groupBy(asker, *keys).agg(F.sum("n").alias("n"), F.min("least").alias("least"))


def best_of_agreements(left: DataFrame, right: DataFrame, left_id: str, right_id: str, on: list[str], equal: dict[str, float], near: tuple[str, float, float]) -> DataFrame:
    """left_id, right_id, confidence and margin: the best right row with the same ``on`` for each left row that has any, and its lead over the second.

    A pair's confidence adds the points of the columns in ``equal`` that both have the same, and those of ``near`` (column, width, points) if the
    values differ by less than the width; at most 1, to four digits. The smaller right id wins ties. No pairs are formed: for each set of
    agreements the rights that have at least these are counted and their smallest id is taken. The best confidence is that of the best set that
    any right has, and the second that of the lowest level that two rights reach, counted by inclusion and exclusion.
    """
    column, width, points = near
    names = sorted(equal)
    total = None
    sets = [frozenset(n for k, n in enumerate(names) if i >> k & 1) for i in range(1 << len(names))]
    for own in sets:
        keys = [*on, *sorted(own)]
        met = left.select(left_id, *keys).join(right.groupBy(*keys).agg(F.count("*").alias("n"), F.min(right_id).alias("least")), keys)
        close = least_near(left, right, keys, column, right_id, left_id, width)
        for found, is_near in ((met, False), (close, True)):
            part = found.select(left_id, F.lit(_code(own, is_near, names)).alias("code"), "n", "least")
            total = part if total is None else total.unionByName(part)
    return _levels(total, left_id, right_id, names, equal, points)


def _code(own: frozenset[str], is_near: bool, names: list[str]) -> int:
    return sum(1 << k for k, n in enumerate(names) if n in own) | (is_near << len(names))


def _levels(total: DataFrame, left_id: str, right_id: str, names: list[str], equal: dict[str, float], points: float) -> DataFrame:
    """The best confidence, its smallest id and the second best, from (left id, code of a set, n, least) of rights that agree at least in that set."""
    full = (1 << len(names)) * 2 - 1
    weight = [*(equal[n] for n in names), points]
    value = [round(min(1.0, sum(w for k, w in enumerate(weight) if code >> k & 1)), 4) for code in range(full + 1)]
    # rights that agree in just a set: alternating sums over the sets above it
    at_least = [F.coalesce(F.sum(F.when(F.col("code") == c, F.col("n"))), F.lit(0)) for c in range(full + 1)]
    rows = total.groupBy(left_id).agg(*(n.alias(f"_n{c}") for c, n in enumerate(at_least)), *(F.min(F.when(F.col("code") == c, F.col("least"))).alias(f"_l{c}") for c in range(full + 1)))
    just = [reduce(lambda a, b: a + b, (F.col(f"_n{d}") * (-1) ** (d ^ c).bit_count() for d in range(full + 1) if d & c == c)) for c in range(full + 1)]
    best = second = F.lit(None).cast("double")
    chosen = F.lit(None).cast("long")
    reached = F.lit(0)
    for v in sorted(set(value), reverse=True):
        own = [c for c in range(full + 1) if value[c] == v]
        here = reduce(lambda a, b: a + b, (just[c] for c in own))
        up = reached + here
        # where nothing is better, the rights of at least such a set all have this value
        least = F.array_min(F.array(*(F.col(f"_l{c}") for c in own)))
        chosen = F.when(best.isNull() & (up > 0), least).otherwise(chosen)
        second = F.when(second.isNull() & (up > 1), v).otherwise(second)
        best = F.when(best.isNull() & (up > 0), v).otherwise(best)
        reached = up
    return rows.select(left_id, chosen.alias(right_id), best.alias("confidence"), (best - F.coalesce(second, F.lit(0.0))).alias("margin"))
