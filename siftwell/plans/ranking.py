"""Windows, orders and limits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siftwell.operators.ranking import first_per_key, page, top_per_key, with_margin
from siftwell.plans.registry import query
from siftwell.session import table


@query("w01_row_number", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations")
def w01(spark, folder):
    return table(spark, folder, "conversations").select("conv_id", "turn", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).alias("n"))


@query("w02_scope_total", "SELECT n_name, count(*) OVER () AS total FROM nation WHERE n_regionkey < 3")
def w02(spark, folder):
    """The size of the scope beside its rows as a scalar subquery, so rows stay where they are."""
    rows = table(spark, folder, "nation").where("n_regionkey < 3")
    return rows.select("n_name", rows.agg(F.count("*")).scalar().alias("total"))


@query("w03_first_per_key", "SELECT o_custkey, arg_min(o_orderkey, -epoch(o_orderdate) + o_orderkey / 1e9) AS newest FROM orders GROUP BY o_custkey")
def w03(spark, folder):
    return first_per_key(table(spark, folder, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", F.col("o_orderkey").alias("newest"))


@query("w05_baseline_overlays", """WITH b AS (SELECT o_custkey, max(o_orderdate) AS d FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey) SELECT o_orderkey FROM orders JOIN b USING (o_custkey) WHERE o_orderdate >= d""")
def w05(spark, folder):
    """The newest full baseline of each scope and whatever is newer."""
    rows = table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus")
    base = F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate"))).over(Window.partitionBy("o_custkey"))
    return rows.withColumn("base", base).where("o_orderdate >= base").select("o_orderkey")


@query("w06_margin", "SELECT o_custkey, o_orderkey, round(o_totalprice - coalesce(nxt, 0), 2) AS margin FROM (SELECT *, row_number() OVER w AS n, lead(o_totalprice) OVER w AS nxt FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)) WHERE n = 1")
def w06(spark, folder):
    best = with_margin(table(spark, folder, "orders"), ["o_custkey"], "o_totalprice", [F.col("o_orderkey")])
    return best.select("o_custkey", "o_orderkey", F.round("margin", 2).alias("margin"))


@query("w07_best_per_url", "SELECT k, page_id FROM (SELECT split_part(url, '/', 3) AS k, page_id, row_number() OVER (PARTITION BY split_part(url, '/', 3) ORDER BY length(html) DESC, page_id) AS n FROM pages) WHERE n = 1 ORDER BY page_id LIMIT 30")
def w07(spark, folder):
    rows = table(spark, folder, "pages").select(F.split_part("url", F.lit("/"), F.lit(3)).alias("k"), "page_id", F.length("html").alias("size"))
    return page(first_per_key(rows, ["k"], [F.desc("size"), F.col("page_id")]).select("k", "page_id"), [F.col("page_id")], 0, 30)


@query("w08_keep_first", "SELECT p_name, min(p_partkey) AS first_id FROM part GROUP BY p_name")
def w08(spark, folder):
    """Keep-first by the input's order, here its id."""
    return table(spark, folder, "part").groupBy("p_name").agg(F.min("p_partkey").alias("first_id"))


@query("w08b_ordered_distinct", "SELECT conv_id, string_agg(role, ',' ORDER BY t) AS roles FROM (SELECT conv_id, role, min(turn) AS t FROM conversations GROUP BY 1, 2) GROUP BY conv_id")
def w08b(spark, folder):
    turns = F.array_sort(F.collect_list(F.struct("turn", "role")))
    return table(spark, folder, "conversations").groupBy("conv_id").agg(turns.alias("t")).select("conv_id", F.array_join(F.array_distinct(F.transform("t", lambda x: x["role"])), ",").alias("roles"))


@query("w09_change", "SELECT day, n, n - lag(n) OVER (ORDER BY day) AS delta, round((n - lag(n) OVER (ORDER BY day)) / lag(n) OVER (ORDER BY day), 6) AS change FROM (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1)")
def w09(spark, folder):
    """Previous against current by the calendar: a join on the day before, which needs no single-partition window."""
    daily = table(spark, folder, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    before = daily.select(F.date_add("day", 1).alias("day"), F.col("n").alias("m"))
    out = daily.join(before, "day", "left").withColumn("delta", F.col("n") - F.col("m"))
    return out.select("day", "n", "delta", F.round(F.try_divide("delta", "m"), 6).alias("change"))


@query("t06_schedule_order", "SELECT event_id FROM events WHERE event_type = 'signup' ORDER BY CASE WHEN event_id % 4 = 0 THEN NULL ELSE CAST(ts AS DATE) END ASC NULLS LAST, event_id LIMIT 100")
def t06(spark, folder):
    rows = table(spark, folder, "events").where("event_type = 'signup'").withColumn("d", F.when(F.col("event_id") % 4 != 0, F.to_date("ts")))
    return page(rows.select("event_id", "d"), [F.asc_nulls_last("d"), F.col("event_id")], 0, 100).select("event_id")


@query("t08_due_queue", "SELECT event_id FROM events WHERE ts <= TIMESTAMP '2024-01-10' AND event_type = 'view' ORDER BY ts, event_id LIMIT 1")
def t08(spark, folder):
    """The earliest that is due. Spark has no row locks: exclusive claims are the state store's matter."""
    return page(table(spark, folder, "events").where("ts <= timestamp_ntz'2024-01-10' and event_type = 'view'").select("event_id", "ts"), [F.col("ts"), F.col("event_id")], 0, 1).select("event_id")


@query("t09_after_cursor", "SELECT event_id FROM events WHERE user_id = 8 AND event_id > 40 AND event_type <> 'error' ORDER BY event_id LIMIT 50")
def t09(spark, folder):
    """One page after a cursor."""
    return page(table(spark, folder, "events").where("user_id = 8 and event_id > 40 and event_type <> 'error'").select("event_id"), [F.col("event_id")], 0, 50)


@query("t10_pending_queue", "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F' ORDER BY CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 1 END, o_orderkey LIMIT 60")
def t10(spark, folder):
    rows = table(spark, folder, "orders").where("o_orderstatus <> 'F'").select("o_orderkey", F.when(F.col("o_orderstatus") == "P", 0).otherwise(1).alias("first"))
    return page(rows, [F.col("first"), F.col("o_orderkey")], 0, 60).select("o_orderkey")


@query("t11_plausible", "SELECT o_custkey, o_orderkey, n AS rank FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders WHERE o_totalprice > 100000) WHERE n <= 10")
def t11(spark, folder):
    return top_per_key(table(spark, folder, "orders").where("o_totalprice > 100000"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 10).select("o_custkey", "o_orderkey", "rank")
