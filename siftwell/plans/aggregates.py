"""Roll-ups, health reports and metrics (A9-A30, P-family counters)."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from siftwell.operators import joins, reports
from siftwell.plans.jobs import JOBS, job_rows, jobs
from siftwell.plans.registry import query
from siftwell.session import table

FIRST, LAST = date(2023, 12, 30), date(2024, 1, 12)
SPAN = "ts >= TIMESTAMP '2023-12-30' AND ts < TIMESTAMP '2024-01-13'"


@query("a09_daily_outcomes", f"""SELECT CAST(d AS DATE) AS day, coalesce(ok, 0) AS ok, coalesce(failed, 0) AS failed FROM generate_series(TIMESTAMP '2023-12-30', TIMESTAMP '2024-01-12', INTERVAL 1 DAY) AS g(d)
  LEFT JOIN (SELECT CAST(ts AS DATE) AS dd, count_if(event_type <> 'error') AS ok, count_if(event_type = 'error') AS failed FROM events WHERE {SPAN} GROUP BY 1) ON dd = CAST(d AS DATE)""")
def a09(spark, folder):
    return reports.daily_outcomes(table(spark, folder, "events"), "ts", F.col("event_type") == "error", FIRST, LAST)


@query("a10_failures_by_type", f"SELECT day, string_agg(kind || '=' || n, ',' ORDER BY kind) AS kinds FROM (SELECT CAST(ts AS DATE) AS day, coalesce(CASE WHEN event_id % 3 = 0 THEN event_type END, 'unknown') AS kind, count(*) AS n FROM events WHERE {SPAN} GROUP BY 1, 2) GROUP BY day")
def a10(spark, folder):
    kind = F.coalesce(F.when(F.col("event_id") % 3 == 0, F.col("event_type")), F.lit("unknown"))
    out = reports.histogram_by_day(table(spark, folder, "events"), "ts", kind, FIRST, LAST)
    return out.select("day", F.array_join(F.transform("kinds", lambda k: F.concat(k["kind"], F.lit("="), k["n"].cast("string"))), ",").alias("kinds"))


@query("a11_token_totals", """WITH e AS (SELECT user_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k, event_id FROM events)
  SELECT user_id, CAST(sum(coalesce(CASE WHEN event_id % 2 = 0 AND k >= 0 THEN k END, k + CASE WHEN event_id % 5 <> 0 THEN 1 END)) AS BIGINT) AS tokens,
  count_if(coalesce(CASE WHEN event_id % 2 = 0 AND k >= 0 THEN k END, k + CASE WHEN event_id % 5 <> 0 THEN 1 END) IS NULL) AS unknown FROM e GROUP BY user_id""")
def a11(spark, folder):
    rows = table(spark, folder, "events").withColumn("k", F.get_json_object("props", "$.k"))
    total, part = F.when(F.col("event_id") % 2 == 0, reports.whole_number("k")), F.when(F.col("event_id") % 5 != 0, 1)
    return reports.token_totals(rows, "user_id", total, reports.whole_number("k"), part)


@query("a12_stage_timings", """SELECT event_type, count(v) AS n, CAST(sum(v) AS DOUBLE) AS total, CAST(max(v) AS DOUBLE) AS longest, round(CAST(sum(v) AS DOUBLE) / count(v), 4) AS mean FROM (SELECT event_type, CAST(value AS DECIMAL(28,6)) AS v FROM events) GROUP BY event_type""")
def a12(spark, folder):
    out = reports.timings(table(spark, folder, "events"), "event_type", F.col("value"))
    return out.select("event_type", "n", *(F.col(c).cast("double").alias(c) for c in ("total", "longest")), F.round(F.col("mean").cast("double"), 4).alias("mean"))


@query("a13_totals", "SELECT count(DISTINCT day) AS days, CAST(sum(n) AS BIGINT) AS n, CAST(sum(failed) AS BIGINT) AS failed FROM (SELECT CAST(ts AS DATE) AS day, count(*) AS n, count_if(event_type = 'error') AS failed FROM events GROUP BY 1)")
def a13(spark, folder):
    """Totals from the day groups, not from the rows again."""
    daily = table(spark, folder, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("failed"))
    return daily.agg(F.count("*").alias("days"), F.sum("n").alias("n"), F.sum("failed").alias("failed"))


@query("a14_pipeline_summary", f"WITH {JOBS} SELECT capture_status, count(*) AS n, count(DISTINCT company_id) AS companies, min(id) AS first_id, max(id) AS last_id FROM jobs GROUP BY capture_status")
def a14(spark, folder):
    return job_rows(spark, folder).groupBy("capture_status").agg(F.count("*").alias("n"), F.count_distinct("company_id").alias("companies"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


HALVES = """WITH h AS (SELECT o_custkey, count_if(o_orderdate < TIMESTAMP '1998-06-01') AS before, count_if(o_orderdate >= TIMESTAMP '1998-06-01') AS after FROM orders GROUP BY o_custkey)"""


@query("a15_quantity_changes", f"{HALVES} SELECT o_custkey, before, after FROM h WHERE CASE WHEN before = 0 THEN after > 0 ELSE abs(after - before) / before >= 0.5 END")
def a15(spark, folder):
    rows = table(spark, folder, "orders")
    early = F.col("o_orderdate") < F.lit("1998-06-01").cast("timestamp_ntz")
    before, after = (rows.where(c).groupBy("o_custkey").agg(F.count("*").alias("n")) for c in (early, ~early))
    return reports.quantity_changes(before, after, "o_custkey", "n")


@query("a15b_health_issues", """WITH r AS (SELECT l_suppkey, count(*) AS n, count_if(l_returnflag = 'R') AS r, avg(l_discount) AS d FROM lineitem GROUP BY l_suppkey), i AS (
  SELECT 'many_returns' AS issue, l_suppkey FROM r WHERE r * 3 > n UNION ALL SELECT 'few_rows', l_suppkey FROM r WHERE n < 590 UNION ALL SELECT 'discounts', l_suppkey FROM r WHERE d > 0.0505)
  SELECT issue, count(*) AS n, string_agg(CAST(l_suppkey AS VARCHAR), ',' ORDER BY l_suppkey) AS ids FROM i GROUP BY issue""")
def a15b(spark, folder):
    runs = table(spark, folder, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("rows"), F.count_if(F.col("l_returnflag") == "R").alias("r"), F.avg("l_discount").alias("d"))
    mean = F.round("d", 12)  # the last digits of a mean depend on the order in which partial sums meet, which must not decide at the limit
    rules = [("many_returns", F.col("r") * 3 > F.col("rows")), ("few_rows", F.col("rows") < 590), ("discounts", mean > 0.0505)]
    out = reports.health_issues(runs, "l_suppkey", rules)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return out.select("issue", "n", F.when(F.size("ids") > 0, ids).alias("ids"))  # an issue of the rows without a supplier alone names none


@query("a16_completion_gaps", "SELECT conv_id, bool_or(length(text) < 40) AS short, bool_and(role <> 'system') AS open FROM conversations GROUP BY conv_id")
def a16(spark, folder):
    """Predicates over nested rows."""
    nested = table(spark, folder, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct(F.length("text").alias("size"), "role")).alias("turns"))
    return nested.select("conv_id", F.exists("turns", lambda t: t["size"] < 40).alias("short"), F.forall("turns", lambda t: t["role"] != "system").alias("open"))


@query("a17_retrieval_metrics", """WITH c AS (SELECT l_orderkey AS case_id, list(DISTINCT l_partkey) AS rel, list(DISTINCT CASE WHEN l_linenumber % 2 = 0 THEN l_partkey END) FILTER (l_linenumber % 2 = 0) AS cit FROM lineitem WHERE l_orderkey % 5 <> 0 GROUP BY 1),
  x AS (SELECT len(list_intersect(rel, coalesce(cit, []))) AS h, len(rel) AS r, len(coalesce(cit, [])) AS c FROM c)
  SELECT round(avg(h / r), 6) AS recall, round(avg(CASE WHEN c > 0 THEN h / c ELSE 0 END), 6) AS precision, round(avg(CASE WHEN c > 0 THEN 1.0 ELSE 0.0 END), 6) AS refusal_accuracy, count(*) AS cases FROM x""")
def a17(spark, folder):
    rows = table(spark, folder, "lineitem").where("l_orderkey % 5 <> 0").groupBy(F.col("l_orderkey").alias("case_id"))
    cases = rows.agg(F.collect_set("l_partkey").alias("relevant"), F.collect_set(F.when(F.col("l_linenumber") % 2 == 0, F.col("l_partkey"))).alias("cited"))
    return reports.retrieval_metrics(cases.withColumn("answered", F.size("cited") > 0))


@query("a18_site_summary", """WITH s AS (SELECT o_custkey, count(*) AS expected, count_if(o_orderstatus <> 'P') * 2 AS found FROM orders GROUP BY o_custkey)
  SELECT CAST(sum(least(found, expected)) AS BIGINT) AS recovered, CAST(sum(expected) AS BIGINT) AS expected, round(sum(least(found, expected)) / sum(expected), 6) AS recovery FROM s""")
def a18(spark, folder):
    """Micro average: what was found beyond the expected doesn't make up for other sites."""
    sites = table(spark, folder, "orders").groupBy("o_custkey").agg(F.count("*").alias("e"), (F.count_if(F.col("o_orderstatus") != "P") * 2).alias("f"))
    out = sites.agg(F.sum(F.least("f", "e")).alias("recovered"), F.sum("e").alias("expected"))
    return out.withColumn("recovery", reports.ratio(F.col("recovered"), F.col("expected")))


@query("a19_strategy_delta", """WITH s AS (SELECT l_shipdate < TIMESTAMP '1999-01-01' AS base, count(*) AS n, avg(l_quantity) AS q FROM lineitem GROUP BY 1)
  SELECT a.n AS base_n, b.n AS other_n, round(b.q - a.q, 6) AS delta FROM s a JOIN s b ON a.base AND NOT b.base""")
def a19(spark, folder):
    base = F.col("l_shipdate") < F.lit("1999-01-01").cast("timestamp_ntz")
    out = table(spark, folder, "lineitem").agg(F.count_if(base).alias("base_n"), F.count_if(~base).alias("other_n"), F.avg(F.when(base, F.col("l_quantity"))).alias("a"), F.avg(F.when(~base, F.col("l_quantity"))).alias("b"))
    return out.select("base_n", "other_n", F.round(F.col("b") - F.col("a"), 6).alias("delta"))


@query("a20_area_summary", "SELECT p_type AS area, count(*) AS cases, count_if(p_size >= 20) AS passed, round(count_if(p_size >= 20) / count(*), 6) AS rate FROM part GROUP BY p_type")
def a20(spark, folder):
    out = table(spark, folder, "part").groupBy(F.col("p_type").alias("area")).agg(F.count("*").alias("cases"), F.count_if(F.col("p_size") >= 20).alias("passed"))
    return out.withColumn("rate", reports.ratio(F.col("passed"), F.col("cases")))


PERIODS = """WITH o AS (SELECT o_custkey AS k, max(o_orderkey % 5) AS v FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01' GROUP BY 1), n AS (SELECT o_custkey AS k, max(o_orderkey % 5) AS v FROM orders WHERE o_orderdate >= TIMESTAMP '2001-01-01' GROUP BY 1),
  c AS (SELECT coalesce(o.k, n.k) AS k, o.v AS old_value, n.v AS new_value, CASE WHEN o.k IS NULL THEN 'added' WHEN n.k IS NULL THEN 'removed' WHEN o.v IS NOT DISTINCT FROM n.v THEN 'same' ELSE 'changed' END AS change FROM o FULL JOIN n ON o.k = n.k)"""


def periods(spark, folder):
    rows = table(spark, folder, "orders").select(F.col("o_custkey").alias("k"), (F.col("o_orderkey") % 5).alias("v"), "o_orderdate")
    sides = (rows.where(c).groupBy("k").agg(F.max("v").alias("v")) for c in ("o_orderdate < timestamp_ntz'1996-01-01'", "o_orderdate >= timestamp_ntz'2001-01-01'"))
    return joins.compare(*sides, "k", "v")


@query("a21_golden_summary", f"{PERIODS} SELECT change, count(*) AS n FROM c GROUP BY change")
def a21(spark, folder):
    return periods(spark, folder).groupBy("change").agg(F.count("*").alias("n"))


@query("j18_full_compare", f"{PERIODS} SELECT k, old_value, new_value, change FROM c")
def j18(spark, folder):
    return periods(spark, folder)


@query("a23_identity_groups", "SELECT c, count(*) AS groups, CAST(sum(n) AS BIGINT) AS documents FROM (SELECT count(DISTINCT source) > 1 AS c, count(*) AS n FROM documents GROUP BY sha256(text)) GROUP BY c")
def a23(spark, folder):
    groups = table(spark, folder, "documents").groupBy(F.sha2("text", 256).alias("key")).agg((F.count_distinct("source") > 1).alias("c"), F.count("*").alias("n"))
    return groups.groupBy("c").agg(F.count("*").alias("groups"), F.sum("n").alias("documents"))


@query("a23b_change_matrix", "SELECT l_discount > 0.05 AS url, l_tax > 0.04 AS body, l_quantity > 25 AS title, count(*) AS n FROM lineitem GROUP BY 1, 2, 3")
def a23b(spark, folder):
    return table(spark, folder, "lineitem").groupBy((F.col("l_discount") > 0.05).alias("url"), (F.col("l_tax") > 0.04).alias("body"), (F.col("l_quantity") > 25).alias("title")).agg(F.count("*").alias("n"))


@query("a24_reason_breakdown", "SELECT l_linestatus AS state, l_returnflag AS reason, count(*) AS n FROM lineitem GROUP BY 1, 2")
def a24(spark, folder):
    return table(spark, folder, "lineitem").groupBy(F.col("l_linestatus").alias("state"), F.col("l_returnflag").alias("reason")).agg(F.count("*").alias("n"))


@query("a25_resume_counters", f"""WITH {JOBS} SELECT coalesce(nullif(analysis_status, ''), 'none') || ':' || capture_status AS state, count(*) AS total, count_if(score IS NOT NULL) AS completed, count_if(score IS NULL) AS pending FROM jobs GROUP BY 1""")
def a25(spark, folder):
    state = F.concat_ws(":", F.coalesce(F.nullif("analysis_status", F.lit("")), F.lit("none")), "capture_status")
    return jobs(spark, folder).groupBy(state.alias("state")).agg(F.count("*").alias("total"), F.count_if(F.col("score").isNotNull()).alias("completed"), F.count_if(F.col("score").isNull()).alias("pending"))


@query("a26_persistence_stats", "SELECT count(*) AS rows, count(p_size) AS sized, CAST(NULL AS BIGINT) AS unavailable FROM part")
def a26(spark, folder):
    """A count whose source isn't there is null, never zero."""
    return table(spark, folder, "part").agg(F.count("*").alias("rows"), F.count("p_size").alias("sized"), F.lit(None).cast("bigint").alias("unavailable"))


@query("a27_progress", "SELECT count(*) AS total, count_if(o_orderstatus <> 'P') AS attempted, count_if(o_orderstatus = 'F') AS complete, count_if(o_orderstatus = 'O') AS retry, greatest(0, count(*) - count_if(o_orderstatus = 'F')) AS remaining FROM orders")
def a27(spark, folder):
    s = F.col("o_orderstatus")
    out = table(spark, folder, "orders").agg(F.count("*").alias("total"), F.count_if(s != "P").alias("attempted"), F.count_if(s == "F").alias("complete"), F.count_if(s == "O").alias("retry"))
    return out.withColumn("remaining", F.greatest(F.lit(0), F.col("total") - F.col("complete")))


@query("a28_write_statistics", "SELECT count_if(o_orderkey % 3 = 0) AS inserted, count_if(o_orderkey % 3 = 1) AS updated, count_if(o_orderkey % 3 = 2) AS reused FROM orders")
def a28(spark, folder):
    k = F.col("o_orderkey") % 3
    return table(spark, folder, "orders").agg(*(F.count_if(k == i).alias(n) for i, n in enumerate(("inserted", "updated", "reused"))))


@query("a29_next_sequence", "SELECT conv_id, max(turn) + 1 AS next FROM conversations GROUP BY conv_id")
def a29(spark, folder):
    return table(spark, folder, "conversations").groupBy("conv_id").agg((F.max("turn") + 1).alias("next"))


@query("a30_median_timing", "SELECT event_type, median(value) AS median, max(value) AS longest FROM events GROUP BY event_type")
def a30(spark, folder):
    return table(spark, folder, "events").groupBy("event_type").agg(F.median("value").alias("median"), F.max("value").alias("longest"))
