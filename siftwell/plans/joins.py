"""Joins of the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwell.operators import joins as j
from siftwell.operators.ranking import first_per_key
from siftwell.plans.jobs import JOBS, analyses, companies, job_rows, jobs
from siftwell.plans.registry import query
from siftwell.session import table


@query("j01_enriched_jobs", f"WITH {JOBS} SELECT id, company_name, organization, analysis_score, score FROM jobs")
def j01(spark, folder):
    return jobs(spark, folder).select("id", "company_name", "organization", "analysis_score", "score")


@query("j02_join_if_needed", "SELECT count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE position('00012' IN c_name) > 0 UNION ALL SELECT count(*) FROM orders")
def j02(spark, folder):
    rows, own = job_rows(spark, folder), companies(spark, folder)
    parts = [j.join_if_needed(rows, own, "company_id", t, ["company_name"]).agg(F.count("*").alias("n")) for t in ("00012", None)]
    return parts[0].unionAll(parts[1])


@query("j03_resume_plan", f"WITH {JOBS} SELECT id, company_name, analysis_status FROM jobs WHERE company_id IN (1, 5, 9, 77)")
def j03(spark, folder):
    rows = job_rows(spark, folder).where(F.col("company_id").isin(1, 5, 9, 77))
    return j.enrich(rows, companies(spark, folder), analyses(spark, folder)).select("id", "company_name", "analysis_status")


@query("j04_analysed_jobs", f"WITH {JOBS} SELECT id, company_name, analysis_score, count(*) OVER () AS scope FROM jobs WHERE analysis_score > 90")
def j04(spark, folder):
    """Inner to analyses, left to companies, with the scope's size beside the rows."""
    found = analyses(spark, folder).where("analysis_score > 90")
    rows = job_rows(spark, folder).join(found, F.col("id") == F.col("job_id")).join(companies(spark, folder), "company_id", "left")
    size = found.agg(F.count("*")).scalar()  # ids of analyses are unique, so their number is the scope's
    return rows.select("id", "company_name", "analysis_score", size.alias("scope"))


@query("j05_task_calls", "SELECT o_orderkey, count(*) AS calls, round(sum(l_quantity), 2) AS quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def j05(spark, folder):
    """The calls are added up before the join: one row a task goes through it."""
    calls = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("calls"), F.round(F.sum("l_quantity"), 2).alias("quantity"))
    return table(spark, folder, "orders").select("o_orderkey").join(calls, "o_orderkey")


@query("j06_application_job", "SELECT conv_id, turn, user_id FROM conversations LEFT JOIN (SELECT user_id FROM events GROUP BY user_id) ON conv_id = user_id")
def j06(spark, folder):
    users = table(spark, folder, "events").select("user_id").distinct()
    return table(spark, folder, "conversations").join(users, F.col("conv_id") == F.col("user_id"), "left").select("conv_id", "turn", "user_id")


@query("j07_latest_stage", """SELECT o_orderkey, stage FROM orders LEFT JOIN (SELECT l_orderkey, l_returnflag || l_linestatus AS stage, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem) ON o_orderkey = l_orderkey AND n = 1""")
def j07(spark, folder):
    history = table(spark, folder, "lineitem").withColumn("state", F.concat("l_returnflag", "l_linestatus")).withColumnRenamed("l_orderkey", "o_orderkey")
    order = [F.desc("l_shipdate"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")]
    return j.latest_lookup(table(spark, folder, "orders").select("o_orderkey"), history, "o_orderkey", order, "state", "stage")


@query("j08_no_open_rows", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def j08(spark, folder):
    waiting = table(spark, folder, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, folder, "customer").select("c_custkey").join(waiting, "c_custkey", "left_anti")


@query("j09_linked_jobs", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 9000)")
def j09(spark, folder):
    linked = table(spark, folder, "customer").where("c_mktsegment = 'BUILDING' and c_acctbal > 9000").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, folder, "orders").join(linked, "o_custkey", "left_semi").select("o_orderkey")


TWO = "WITH l AS (SELECT doc_id AS id, sha256(text) AS a, substr(text, 1, 30) AS b FROM documents WHERE doc_id % 2 = 0), r AS (SELECT doc_id AS id, sha256(text) AS a, substr(text, 1, 30) AS b FROM documents WHERE doc_id % 2 = 1)"


@query("j10_multi_key_identity", f"""{TWO}, m AS (SELECT DISTINCT l.id AS lid, r.id AS rid FROM l JOIN r ON l.a = r.a UNION SELECT l.id, r.id FROM l JOIN r ON l.b = r.b)
  SELECT l.id AS left_id, CASE WHEN count(rid) = 0 THEN 'new' WHEN count(rid) = 1 THEN 'matched' ELSE 'ambiguous' END AS status, CASE WHEN count(rid) = 1 THEN min(rid) END AS right_id FROM l LEFT JOIN m ON l.id = lid GROUP BY l.id""")
def j10(spark, folder):
    rows = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("a"), F.substring("text", 1, 30).alias("b"))
    return j.multi_key_match(rows.where("id % 2 = 0"), rows.where("id % 2 = 1"), "id", "id", ["a", "b"])


@query("j11_lead_reconciliation", """WITH lead AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN 'new ' ELSE '' END || p_name || CASE WHEN p_partkey % 3 = 0 THEN ' project' ELSE '' END AS name FROM part), alias AS (SELECT p_name AS name, min(p_partkey) AS company FROM part GROUP BY p_name),
  e AS (SELECT lead.id, company, length(alias.name) AS n FROM lead JOIN alias ON lead.name = alias.name OR starts_with(lead.name, alias.name || ' '))
  SELECT lead.id, max_by(company, n) AS company, CASE WHEN count(company) > 0 THEN 'matched' ELSE 'new' END AS bucket FROM lead LEFT JOIN e ON lead.id = e.id GROUP BY lead.id""")
def j11(spark, folder):
    """By name, else by the longest name that is a whole-word prefix: leads are exploded into their prefixes, so both are equi-joins."""
    rows = table(spark, folder, "part")
    leads = rows.select(F.col("p_partkey").alias("id"), F.concat(F.when(F.col("p_partkey") % 5 == 0, "new ").otherwise(""), "p_name", F.when(F.col("p_partkey") % 3 == 0, " project").otherwise("")).alias("lead"))
    alias = rows.groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("company"))
    words = F.split("lead", " ")
    prefixes = leads.select("id", F.explode(F.transform(F.sequence(F.lit(1), F.size(words)), lambda n: F.array_join(F.slice(words, F.lit(1), n), " "))).alias("name"))
    hit = prefixes.join(alias, "name").groupBy("id").agg(F.max_by("company", F.length("name")).alias("company"))
    return leads.join(hit, "id", "left").select("id", "company", F.when(F.col("company").isNull(), "new").otherwise("matched").alias("bucket"))


@query("j12_alias_index", "SELECT p_name AS alias, count(*) AS companies, count(*) > 1 AS ambiguous, min(p_partkey) AS first_id FROM part GROUP BY p_name")
def j12(spark, folder):
    return table(spark, folder, "part").groupBy(F.col("p_name").alias("alias")).agg(F.count("*").alias("companies"), (F.count("*") > 1).alias("ambiguous"), F.min("p_partkey").alias("first_id"))


@query("j13_scored_match", """WITH a AS (SELECT s.s_suppkey AS mail, c.c_custkey AS app, round(least(CAST(1.0 AS DOUBLE), CASE WHEN right(s_name, 2) = right(c_name, 2) THEN CAST(0.45 AS DOUBLE) ELSE 0 END + CASE WHEN abs(s_acctbal - c_acctbal) < 500 THEN CAST(0.45 AS DOUBLE) ELSE 0 END + CASE WHEN s_suppkey % 5 = c_custkey % 5 THEN CAST(0.12 AS DOUBLE) ELSE 0 END), 4) AS confidence
    FROM supplier s JOIN customer c ON s.s_nationkey = c.c_nationkey), r AS (SELECT *, row_number() OVER w AS n, lead(confidence) OVER w AS nxt FROM a WINDOW w AS (PARTITION BY mail ORDER BY confidence DESC, app))
  SELECT mail, app, confidence, round(confidence - coalesce(nxt, 0), 4) AS margin, CASE WHEN confidence < 0.65 THEN 'unresolved' WHEN confidence - coalesce(nxt, 0) < 0.1499 THEN 'ambiguous' ELSE 'matched' END AS decision FROM r WHERE n = 1""")
def j13(spark, folder):
    """Additive scores of candidates with the same company key, the best one and its lead."""
    s = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("mail"), F.col("s_nationkey").alias("nation"), F.right("s_name", F.lit(2)).alias("name"), (F.col("s_suppkey") % 5).alias("rest"), F.col("s_acctbal").alias("balance"))
    c = table(spark, folder, "customer").select(F.col("c_custkey").alias("app"), F.col("c_nationkey").alias("nation"), F.right("c_name", F.lit(2)).alias("name"), (F.col("c_custkey") % 5).alias("rest"), F.col("c_acctbal").alias("balance"))
    best = j.best_of_agreements(s, c, "mail", "app", ["nation"], {"name": 0.45, "rest": 0.12}, ("balance", 500.0, 0.45))
    decision = F.when(F.col("confidence") < 0.65, "unresolved").when(F.col("margin") < 0.1499, "ambiguous").otherwise("matched")
    return best.select("mail", "app", "confidence", F.round("margin", 4).alias("margin"), decision.alias("decision"))


@query("j14_points_in_intervals", """SELECT a.event_id, b.event_id AS interval_id FROM events a JOIN (SELECT event_id, user_id, ts AS s, ts + INTERVAL 6 HOUR AS e FROM events WHERE event_type = 'signup') b
  ON a.user_id = b.user_id AND a.ts >= b.s AND a.ts < b.e WHERE a.event_type = 'error'""")
def j14(spark, folder):
    rows = table(spark, folder, "events")
    spans = rows.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("interval_id"), F.col("ts").alias("s"), (F.col("ts") + F.expr("INTERVAL 6 HOUR")).alias("e"))
    points = rows.where("event_type = 'error'").select("user_id", "event_id", "ts")
    return j.points_in_intervals(points, spans, "ts", "s", "e", 6 * 3600, "user_id").select("event_id", "interval_id")


@query("j15_overlaps", """WITH e AS (SELECT event_id, user_id, ts AS s, ts + INTERVAL 90 MINUTE AS e FROM events WHERE event_type IN ('signup', 'purchase'))
  SELECT a.user_id, a.event_id AS first_id, b.event_id AS second_id, greatest(a.s, b.s) AS overlap_start, least(a.e, b.e) AS overlap_end FROM e a JOIN e b ON a.user_id = b.user_id AND a.event_id < b.event_id AND a.s < b.e AND b.s < a.e""")
def j15(spark, folder):
    spans = table(spark, folder, "events").where(F.col("event_type").isin("signup", "purchase")).select("event_id", "user_id", F.col("ts").alias("s"), (F.col("ts") + F.expr("INTERVAL 90 MINUTE")).alias("e"))
    return j.overlapping_pairs(spans, "event_id", "s", "e", "user_id", width=5400)


@query("j16_fill_missing", """WITH r AS (SELECT c_custkey AS id, upper(c_name) AS name, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS segment FROM customer), c AS (SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer WHERE c_custkey % 3 <> 0)
  SELECT r.id, r.name, coalesce(r.segment, a.segment, b.segment) AS segment FROM r LEFT JOIN c a ON r.id = a.id LEFT JOIN (SELECT lower(name) AS k, min_by(segment, id) AS segment FROM c GROUP BY 1) b ON lower(r.name) = b.k""")
def j16(spark, folder):
    rows = table(spark, folder, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    gaps = rows.select("id", F.upper("name").alias("name"), F.when(F.col("id") % 2 == 0, F.col("segment")).alias("segment"))
    return j.fill_missing(gaps, rows.where("id % 3 <> 0"), "id", "name", ["segment"])


@query("j17_previous_run", """WITH r AS (SELECT o_custkey, year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1, 2) SELECT a.o_custkey, a.n AS current, b.n AS previous FROM r a LEFT JOIN r b ON a.o_custkey = b.o_custkey AND b.y = 1997 WHERE a.y = 1998""")
def j17(spark, folder):
    runs = table(spark, folder, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n"))
    now, before = (runs.where(F.col("y") == y).select("o_custkey", F.col("n").alias(name)) for y, name in ((1998, "current"), (1997, "previous")))
    return now.join(before, "o_custkey", "left")


@query("j19_manifest_compare", """WITH a AS (SELECT doc_id AS path, sha256(text) AS h FROM documents WHERE doc_id % 5 <> 0), b AS (SELECT doc_id AS path, sha256(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 6 <> 0)
  SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.path = b.path WHERE a.h IS DISTINCT FROM b.h""")
def j19(spark, folder):
    """Which files of a manifest came, went or changed."""
    docs = table(spark, folder, "documents").withColumnRenamed("doc_id", "path")
    a = docs.where("path % 5 <> 0").select("path", F.sha2("text", 256).alias("h"))
    b = docs.where("path % 6 <> 0").select("path", F.sha2(F.concat("text", F.when(F.col("path") % 7 == 0, "!").otherwise("")), 256).alias("h"))
    return j.compare(a, b, "path", "h").where("change <> 'same'").select("path", "change")


@query("j20_blind_eval", """SELECT b.item_id, coalesce(n, 0) AS observed, n IS NULL AS failed FROM benchmark b LEFT JOIN (SELECT turn AS item_id, count(*) AS n FROM conversations GROUP BY turn) o ON b.item_id = o.item_id""")
def j20(spark, folder):
    """Every case of the manifest; one without an observation failed."""
    seen = table(spark, folder, "conversations").groupBy(F.col("turn").alias("item_id")).agg(F.count("*").alias("n"))
    out = table(spark, folder, "benchmark").select("item_id").join(seen, "item_id", "left")
    return out.select("item_id", F.coalesce("n", F.lit(0)).alias("observed"), F.col("n").isNull().alias("failed"))


@query("j21_schedule_lookup", "SELECT user_id, first_error FROM (SELECT DISTINCT user_id FROM events) LEFT JOIN (SELECT user_id AS u, min(event_id) AS first_error FROM events WHERE event_type = 'error' AND value > 30 GROUP BY 1) ON user_id = u")
def j21(spark, folder):
    rows = table(spark, folder, "events")
    errors = rows.where("event_type = 'error' and value > 30").groupBy("user_id").agg(F.min("event_id").alias("first_error"))
    return rows.select("user_id").distinct().join(errors, "user_id", "left")


@query("j22_existing_rows", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey = 330) OR l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 499000)")
def j22(spark, folder):
    """Either key leads to a row: one semi join with the union of the keys."""
    wanted = table(spark, folder, "orders").where("o_custkey = 330 or o_totalprice > 499000").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, folder, "lineitem").join(wanted, "l_orderkey", "left_semi").select("l_orderkey", "l_linenumber", "l_partkey")


@query("j23_resequence", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY length(text), turn) AS sequence_no FROM conversations")
def j23(spark, folder):
    rows = table(spark, folder, "conversations").withColumn("size", F.length("text"))
    return j.resequence(rows, "conv_id", ["size", "turn"], "sequence_no").select("conv_id", "turn", "sequence_no")


@query("j07b_max_by", "SELECT l_orderkey, max(l_shipdate) AS shipped FROM lineitem GROUP BY l_orderkey")
def j07b(spark, folder):
    return first_per_key(table(spark, folder, "lineitem"), ["l_orderkey"], [F.desc("l_shipdate")]).select("l_orderkey", F.col("l_shipdate").alias("shipped"))
