"""First rows, top rows and margins under total orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key; Spark drops later ones before the exchange (group limit)."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def top_per_key(rows: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= k)


def page(rows: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """One page of a total order: a distributed top-k of offset + limit rows."""
    return rows.orderBy(*order).offset(offset).limit(limit)


def with_margin(rows: DataFrame, keys: list[str], score: str, tie: list[Column]) -> DataFrame:
    """Best row of each key and its lead over the second (the whole score if there is none)."""
    w = Window.partitionBy(*keys).orderBy(F.col(score).desc(), *tie)
    ranked = rows.withColumn("_n", F.row_number().over(w)).withColumn("_next", F.lead(score).over(w))
    return ranked.where("_n = 1").withColumn("margin", F.col(score) - F.coalesce("_next", F.lit(0.0))).drop("_n", "_next")
