"""Counts and facets over catalogue rows, each in one aggregation."""

from __future__ import annotations

from collections.abc import Collection, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions import text as tf


def known_stages(wanted: Sequence[str], known: Collection[str]) -> list[str]:
    """The wanted stages; an unknown one is an error, not an empty answer."""
    if unknown := [w for w in wanted if w not in known]:
        raise ValueError(f"unknown stages: {unknown}")
    return list(wanted)


def named_query(rows: DataFrame, name: str, wanted: str) -> DataFrame:
    """Rows whose normalised name contains the wanted one or is contained in it; unique or ambiguous on every row."""
    key, ask = tf.name_key(F.col(name)), "".join(c for c in wanted.lower() if c.isalnum() or c in "+#")
    hit = rows.where(F.contains(key, F.lit(ask)) | F.contains(F.lit(ask), key))
    number = hit.agg(F.count("*")).scalar()
    return hit.withColumn("status", F.when(number == 1, "unique").otherwise("ambiguous"))


def numbered(rows: DataFrame, keys: list[str], order: list[Column], name: str = "n") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def has_pairs(meta: Column, wanted: Mapping[str, str]) -> Column:
    return reduce(lambda a, b: a & b, (F.coalesce(F.try_element_at(meta, F.lit(k)) == v, F.lit(False)) for k, v in wanted.items()), F.lit(True))


def without(rows: DataFrame, heavy: Collection[str]) -> DataFrame:
    """All columns but the heavy ones, which then aren't read."""
    return rows.select(*(c for c in rows.columns if c not in heavy))


def freshness(rows: DataFrame, key: str, seen: list[str], current_from: str) -> DataFrame:
    newest = F.max(F.coalesce(*seen))
    state = F.when(F.col("seen").isNull(), "unknown").when(F.col("seen") >= F.lit(current_from).cast("timestamp_ntz"), "current").otherwise("stale")
    return rows.groupBy(key).agg(newest.alias("seen")).withColumn("state", state)


def stage_counts(rows: DataFrame, text_filter: Column | None, stage: str) -> DataFrame:
    """Groups count rows under the filter; the totals come from the groups, which are few, as scalar subqueries."""
    keep = F.lit(True) if text_filter is None else F.coalesce(text_filter, F.lit(False))
    groups = rows.groupBy(F.col(stage).alias("stage")).agg(F.count_if(keep).alias("n"), F.count("*").alias("_all"))
    total, every = groups.agg(F.sum("n")).scalar(), groups.agg(F.sum("_all")).scalar()
    return groups.where("n > 0").select("stage", "n", total.alias("total"), every.alias("unfiltered"))


def company_facet(rows: DataFrame, group: str, unit: str, score: str, title: str, id_col: str) -> DataFrame:
    """Count, mean of the scores there are, best score with its title (of equal ones the smallest id), distinct units."""
    best = F.min_by(title, F.when(F.col(score).isNotNull(), F.struct(-F.col(score), F.col(id_col))))
    return rows.groupBy(group).agg(
        F.count("*").alias("n"), F.round(F.avg(score), 6).alias("mean"), F.max(score).alias("best"), F.count_distinct(unit).alias("units"), best.alias("best_title")
    )


def browse_stats(rows: DataFrame) -> DataFrame:
    unscored = F.col("score").isNull()
    return rows.agg(
        F.count("*").alias("jobs"), F.count_distinct("company_id").alias("companies"), F.count_if(F.col("score") >= 70).alias("high"), F.count_if(unscored).alias("unscored"),
        F.count_if(unscored & (F.col("capture_status") == "complete")).alias("pending"), F.count_if(F.col("capture_status") != "complete").alias("incomplete"),
    )


def revision(tables: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    parts = [df.agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.max(column).alias("newest")) for name, (df, column) in tables.items()]
    return reduce(DataFrame.unionByName, parts)
