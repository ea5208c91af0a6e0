"""The job catalogue that the queries run on: orders, customers and nations in the roles of jobs, companies and organizations.

``JOBS`` is the same view as SQL, for the oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.operators import joins
from siftwell.session import table


def companies(spark: SparkSession, folder: str) -> DataFrame:
    customer, nation = table(spark, folder, "customer"), table(spark, folder, "nation")
    return customer.join(nation, customer.c_nationkey == nation.n_nationkey, "left").select(
        F.col("c_custkey").alias("company_id"), F.col("c_name").alias("company_name"), F.col("n_name").alias("organization"), F.col("c_mktsegment").alias("segment")
    )


def job_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Jobs alone, before any join."""
    k = F.col("o_orderkey")
    return table(spark, folder, "orders").select(
        k.alias("id"),
        F.col("o_custkey").alias("company_id"),
        F.col("o_orderpriority").alias("priority"),
        (F.lit(2024) + k % 4).cast("int").alias("cohort"),
        F.when(F.col("o_orderstatus") == "F", "Confirmed").when(F.col("o_orderstatus") == "O", "confirmed").otherwise("unconfirmed").alias("cohort_status"),
        F.when(k % 3 == 0, "formal").when(k % 3 == 1, "early").otherwise("internship").alias("batch"),
        F.when(k % 10 == 0, None).when(k % 7 == 0, F.concat(F.lit("inactive:"), k.cast("string"))).otherwise(F.concat(F.lit("ref:"), k.cast("string"))).alias("source_ref"),
        F.when(k % 11 == 0, None).otherwise(k * 37 % 101).cast("int").alias("job_score"),
        F.when(k % 6 == 0, "pending").when(k % 5 == 0, "failed").otherwise("complete").alias("capture_status"),
        F.when(k % 5 == 0, "moka").when(k % 5 == 1, "feishu").when(k % 5 == 2, "beisen").otherwise("web").alias("source"),
        F.col("o_totalprice").alias("price"),
        F.col("o_orderdate").alias("first_seen"),
    )


def analyses(spark: SparkSession, folder: str) -> DataFrame:
    """One analysis for two of three jobs."""
    k = F.col("o_orderkey")
    return table(spark, folder, "orders").where(k % 3 != 1).select(
        k.alias("job_id"), (k * 53 % 101).cast("int").alias("analysis_score"), F.when(k % 4 == 0, "complete").when(k % 4 == 1, "failed").when(k % 4 == 2, "").alias("analysis_status")
    )


def jobs(spark: SparkSession, folder: str) -> DataFrame:
    """Jobs with their company and analysis, and the effective score."""
    rows = joins.enrich(job_rows(spark, folder), companies(spark, folder), analyses(spark, folder))
    title = F.concat_ws(" ", "priority", "segment")
    return rows.withColumn("title", title).withColumn("score", joins.effective_score("job_score", "analysis_score", "analysis_status"))


JOBS = """
jobs AS (
  SELECT o_orderkey AS id, o_custkey AS company_id, c_name AS company_name, n_name AS organization, c_mktsegment AS segment,
    o_orderpriority AS priority, concat_ws(' ', o_orderpriority, c_mktsegment) AS title,
    CAST(2024 + o_orderkey % 4 AS INTEGER) AS cohort,
    CASE o_orderstatus WHEN 'F' THEN 'Confirmed' WHEN 'O' THEN 'confirmed' ELSE 'unconfirmed' END AS cohort_status,
    CASE o_orderkey % 3 WHEN 0 THEN 'formal' WHEN 1 THEN 'early' ELSE 'internship' END AS batch,
    CASE WHEN o_orderkey % 10 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN 'inactive:' || o_orderkey ELSE 'ref:' || o_orderkey END AS source_ref,
    CAST(CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderkey * 37 % 101 END AS INTEGER) AS job_score,
    CASE WHEN o_orderkey % 6 = 0 THEN 'pending' WHEN o_orderkey % 5 = 0 THEN 'failed' ELSE 'complete' END AS capture_status,
    CASE o_orderkey % 5 WHEN 0 THEN 'moka' WHEN 1 THEN 'feishu' WHEN 2 THEN 'beisen' ELSE 'web' END AS source,
    o_totalprice AS price, o_orderdate AS first_seen, analysis_score, analysis_status,
    CASE WHEN analysis_status <> '' AND analysis_status <> 'complete' THEN NULL
         ELSE coalesce(CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderkey * 37 % 101 END, analysis_score) END AS score
  FROM orders
  LEFT JOIN customer ON o_custkey = c_custkey
  LEFT JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN (SELECT o_orderkey AS job_id, CAST(o_orderkey * 53 % 101 AS INTEGER) AS analysis_score,
      CASE o_orderkey % 4 WHEN 0 THEN 'complete' WHEN 1 THEN 'failed' WHEN 2 THEN '' ELSE NULL END AS analysis_status
    FROM orders WHERE o_orderkey % 3 <> 1) ON job_id = o_orderkey)
"""
BASE = "cohort = 2027 AND lower(cohort_status) = 'confirmed' AND batch IN ('formal', 'early') AND (source_ref IS NULL OR source_ref NOT LIKE 'inactive:%')"
