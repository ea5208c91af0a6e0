"""Catalogue browsing: filters, pages, facets, stages."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions import text as tf
from siftwell.operators import facets
from siftwell.operators import predicates as p
from siftwell.operators.ranking import page
from siftwell.plans.jobs import BASE, JOBS, companies, job_rows, jobs
from siftwell.plans.registry import query
from siftwell.session import table

WITH = f"WITH {JOBS} "
PLATFORMS = (("moka", "Moka"), ("feishu", "Feishu"), ("beisen", "Beisen"))


def base(spark: SparkSession, folder: str) -> DataFrame:
    return jobs(spark, folder).where(p.browse_base())


@query("p01_browse_base", f"{WITH} SELECT id, batch, source_ref FROM jobs WHERE {BASE}")
def p01(spark, folder):
    return job_rows(spark, folder).where(p.browse_base()).select("id", "batch", "source_ref")


@query("p02_search_jobs", f"""{WITH}, hit AS (SELECT * FROM jobs WHERE (lower(title) LIKE '%1-urgent%' OR lower(city) LIKE '%1-urgent%' OR lower(company_name) LIKE '%1-urgent%')
  AND cohort = 2027 AND batch IN ('early', 'formal') AND job_score >= 40)
  SELECT id, title, job_score, first_seen, (SELECT count(*) FROM hit) AS total FROM hit ORDER BY job_score DESC NULLS LAST, first_seen DESC, id LIMIT 25 OFFSET 5""".replace("city", "organization"))
def p02(spark, folder):
    """The page together with the number of all matches."""
    keep = p.all_of(p.like_any("1-URGENT", "title", "organization", "company_name"), F.col("cohort") == 2027, F.col("batch").isin("early", "formal"), F.col("job_score") >= 40)
    hit = jobs(spark, folder).where(keep)
    total = hit.agg(F.count("*")).scalar()
    order = [F.desc_nulls_last("job_score"), F.desc("first_seen"), F.col("id")]
    return page(hit.select("id", "title", "job_score", "first_seen"), order, 5, 25).withColumn("total", total)


@query("p03_browse_text", f"{WITH} SELECT id, title FROM jobs WHERE {BASE} AND position('000001' IN lower(concat_ws(' ', coalesce(company_name, ''), coalesce(title, ''), coalesce(organization, '')))) > 0")
def p03(spark, folder):
    return base(spark, folder).where(p.text_contains("000001", "company_name", "title", "organization")).select("id", "title")


@query("p03b_literal_percent", f"{WITH} SELECT count(*) AS n FROM jobs WHERE position('1%' IN lower(title)) > 0 OR position('1_u' IN lower(title)) > 0")
def p03b(spark, folder):
    return jobs(spark, folder).where(p.text_contains("1%", "title") | p.text_contains("1_U", "title")).agg(F.count("*").alias("n"))


@query("p04_company_filter", f"{WITH} SELECT id FROM jobs WHERE {BASE} AND (CAST(company_id AS VARCHAR) IN ('NATION_3', '77', 'Customer#000000042') OR company_name IN ('NATION_3', '77', 'Customer#000000042') OR coalesce(organization, company_name) IN ('NATION_3', '77', 'Customer#000000042'))")
def p04(spark, folder):
    wanted = ["NATION_3", "77", "Customer#000000042"]
    hit = F.col("company_id").cast("string").isin(wanted) | F.col("company_name").isin(wanted) | F.coalesce("organization", "company_name").isin(wanted)
    return base(spark, folder).where(hit).select("id")


@query("p05_score_band", f"{WITH} SELECT id, CASE WHEN score >= 70 THEN 'high' WHEN score >= 60 THEN 'medium' WHEN score < 60 THEN 'low' END AS band FROM jobs WHERE {BASE}")
def p05(spark, folder):
    return base(spark, folder).select("id", p.score_band("score").alias("band"))


SCREEN_SQL = "CASE WHEN id % 13 = 0 THEN 'internship' WHEN id % 17 = 0 THEN 'not_target' WHEN id % 19 = 0 THEN 'jd_incomplete' ELSE 'eligible' END"


@query("p06_evaluation_filter", f"""{WITH}, e AS (SELECT id, CASE WHEN score IS NOT NULL THEN 'scored' WHEN screen IN ('not_target', 'internship', 'doctorate', 'direction_out') THEN 'excluded'
  WHEN screen = 'jd_incomplete' THEN 'jd_incomplete' WHEN screen = 'eligible' AND capture_status = 'complete' THEN 'pending' ELSE 'unscored' END AS evaluation
  FROM (SELECT *, {SCREEN_SQL} AS screen FROM jobs WHERE {BASE})) SELECT id, evaluation FROM e WHERE evaluation <> 'scored'""")
def p06(spark, folder):
    out = base(spark, folder).withColumn("screen", F.expr(SCREEN_SQL)).withColumn("evaluation", p.evaluation())
    return out.where("evaluation <> 'scored'").select("id", "evaluation")


@query("p07_effective_score", f"{WITH} SELECT id, job_score, analysis_score, analysis_status, score FROM jobs")
def p07(spark, folder):
    return jobs(spark, folder).select("id", "job_score", "analysis_score", "analysis_status", "score")


@query("p08_platform_label", f"{WITH} SELECT id, CASE WHEN source LIKE '%moka%' THEN 'Moka' WHEN source LIKE '%feishu%' THEN 'Feishu' WHEN source LIKE '%beisen%' THEN 'Beisen' ELSE 'Other' END AS platform FROM jobs WHERE {BASE}")
def p08(spark, folder):
    return base(spark, folder).select("id", p.first_containing(F.col("source"), PLATFORMS, "Other").alias("platform"))


@query("p09_unicode_fold", "SELECT doc_id, sha256(replace(lower(text), 'ß', 'ss')) AS folded FROM documents")
def p09(spark, folder):
    return table(spark, folder, "documents").select("doc_id", F.sha2(tf.fold("text"), 256).alias("folded"))


@query("p10_first_seen_day", f"{WITH} SELECT id FROM jobs WHERE CAST(first_seen AS DATE) = DATE '1998-10-03'")
def p10(spark, folder):
    return job_rows(spark, folder).where(p.on_day("first_seen", date(1998, 10, 3))).select("id")


@query("p11_id_list", "SELECT o_orderkey AS id FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 37 = 0 AND c_acctbal > 0)")
def p11(spark, folder):
    """Membership in a list of any length as a semi join."""
    wanted = table(spark, folder, "customer").where("c_custkey % 37 = 0 and c_acctbal > 0").select(F.col("c_custkey").alias("company_id"))
    return job_rows(spark, folder).join(wanted, "company_id", "left_semi").select("id")


@query("p12_mail_query", """SELECT event_id, ts, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-03 12:00:00' AND CAST(ts AS DATE) <= DATE '2024-01-09' AND event_type IN ('error', 'signup') AND value > 2
  ORDER BY ts DESC, event_id DESC LIMIT 200""")
def p12(spark, folder):
    """From an exact time, to the end of a day; newest first, ties by id; T7."""
    rows = table(spark, folder, "events").where("ts >= timestamp_ntz'2024-01-03 12:00:00' and ts < timestamp_ntz'2024-01-10' and value > 2").where(F.col("event_type").isin("error", "signup"))
    return page(rows.select("event_id", "ts", "event_type"), [F.desc("ts"), F.desc("event_id")], 0, 200)


@query("p13_source_list", """SELECT s_suppkey, s_name, CASE WHEN s_acctbal < 0 THEN 'unusable' ELSE 'ready' END AS status FROM supplier JOIN nation ON s_nationkey = n_nationkey
  WHERE (lower(s_name) LIKE '%00001%' OR lower(n_name) LIKE '%00001%' OR CAST(s_suppkey AS VARCHAR) LIKE '%00001%') AND s_acctbal >= 0""")
def p13(spark, folder):
    rows = table(spark, folder, "supplier").join(table(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    rows = rows.withColumn("status", F.when(F.col("s_acctbal") < 0, "unusable").otherwise("ready")).withColumn("ref", F.col("s_suppkey").cast("string"))
    return rows.where(p.like_any("00001", "s_name", "n_name", "ref") & (F.col("status") != "unusable")).select("s_suppkey", "s_name", "status")


@query("p14_application_search", "SELECT o_orderkey, o_orderstatus FROM orders JOIN customer ON o_custkey = c_custkey WHERE position('machin' IN lower(c_mktsegment)) > 0 AND o_orderstatus IN ('O', 'P')")
def p14(spark, folder):
    rows = table(spark, folder, "orders").join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.where(p.text_contains("Machin", "c_mktsegment") & F.col("o_orderstatus").isin(facets.known_stages(["O", "P"], {"O", "P", "F"}))).select("o_orderkey", "o_orderstatus")


@query("p15_application_query", r"""WITH n AS (SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z0-9+#]+', '', 'g') AS k FROM part), m AS (SELECT * FROM n WHERE position('redwid' IN k) > 0 OR position(k IN 'redwid') > 0)
  SELECT p_partkey, CASE WHEN (SELECT count(*) FROM m) = 1 THEN 'unique' ELSE 'ambiguous' END AS status FROM m""")
def p15(spark, folder):
    """Containment either way of normalised names, with the status of the whole answer on its rows."""
    return facets.named_query(table(spark, folder, "part"), "p_name", "Red wid.").select("p_partkey", "status")


@query("p16_source_eligibility", """SELECT p_partkey FROM part WHERE p_brand = 'Brand#2' AND position('ring' IN p_name) + position('bolt' IN p_name) > 0 AND p_type IN ('SMALL', 'LARGE', 'PROMO')""")
def p16(spark, folder):
    rows = table(spark, folder, "part")
    types = F.arrays_overlap(F.split("p_type", "/"), F.array(*map(F.lit, ("SMALL", "LARGE", "PROMO"))))
    return rows.where((F.col("p_brand") == "Brand#2") & types & F.exists(F.array(F.lit("ring"), F.lit("bolt")), lambda w: F.contains("p_name", w))).select("p_partkey")


@query("p17_first_failing_reason", """SELECT reason, count(*) AS n FROM (SELECT CASE WHEN NOT p_size >= 10 THEN 'size' WHEN NOT p_type <> 'PROMO' THEN 'type' WHEN NOT p_retailprice < 1000 THEN 'price' END AS reason FROM part) GROUP BY reason""")
def p17(spark, folder):
    """The first failing rule of each row and how often each excludes; A22."""
    rules = [("size", F.col("p_size") >= 10), ("type", F.col("p_type") != "PROMO"), ("price", F.col("p_retailprice") < 1000)]
    return table(spark, folder, "part").groupBy(p.first_failing(rules).alias("reason")).agg(F.count("*").alias("n"))


@query("p18_row_shape", """SELECT event_id, CASE WHEN try_cast(k AS BIGINT) IS NULL THEN 'bad_k' WHEN try_cast(k AS BIGINT) < 10 THEN 'small_k' WHEN value < 1 THEN 'bad_value' END AS code
  FROM (SELECT event_id, value, json_extract_string(props, '$.k') AS k FROM events)""")
def p18(spark, folder):
    k = F.col("k").try_cast("bigint")
    code = F.when(k.isNull(), "bad_k").when(k < 10, "small_k").when(F.col("value") < 1, "bad_value")
    return table(spark, folder, "events").withColumn("k", F.get_json_object("props", "$.k")).select("event_id", code.alias("code"))


ACCEPT = """WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) AS n FROM lineitem)"""


@query("p19_crawl_acceptance", f"""{ACCEPT} SELECT reason, count(*) AS n FROM (SELECT CASE WHEN l_orderkey % 97 = 0 THEN 'invalid_id' WHEN n > 1 THEN 'duplicate_id' WHEN l_quantity < 3 THEN 'missing_title' WHEN l_partkey % 50 = 0 THEN 'bad_url' ELSE 'accepted' END AS reason FROM r) GROUP BY reason""")
def p19(spark, folder):
    rows = facets.numbered(table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"], [F.col(c) for c in ("l_partkey", "l_suppkey", "l_extendedprice")])
    rules = [("invalid_id", F.col("l_orderkey") % 97 != 0), ("duplicate_id", F.col("n") == 1), ("missing_title", F.col("l_quantity") >= 3), ("bad_url", F.col("l_partkey") % 50 != 0)]
    return rows.groupBy(F.coalesce(p.first_failing(rules), F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))


@query("p20_pagination_state", """SELECT conv_id, CASE WHEN more OR pages < total THEN 'incomplete' WHEN done OR pages >= total THEN 'complete' ELSE 'unknown' END AS state FROM (
  SELECT conv_id, max(turn) + 1 AS pages, CASE WHEN conv_id % 3 = 0 THEN NULL ELSE 4 END AS total, conv_id % 7 = 0 AS more, conv_id % 2 = 0 AND NOT conv_id % 7 = 0 AS done FROM conversations GROUP BY conv_id)""")
def p20(spark, folder):
    c = F.col("conv_id")
    runs = table(spark, folder, "conversations").groupBy("conv_id").agg((F.max("turn") + 1).alias("pages")).withColumns({"total": F.when(c % 3 != 0, 4), "more": c % 7 == 0, "done": (c % 2 == 0) & (c % 7 != 0)})
    return runs.select("conv_id", p.pagination("done", "more", "pages", "total").alias("state"))


@query("p21_url_kind", r"""SELECT page_id, CASE WHEN NOT regexp_matches(url, '^https?://') THEN NULL WHEN position('/login' IN url) > 0 THEN 'login_page' WHEN regexp_matches(url, '^https?://m\.') THEN 'mobile' WHEN position('/fr/' IN url) > 0 THEN 'article' WHEN regexp_matches(regexp_extract(url, '^https?://([^/?#:]+)', 1), '(^|\.)example\.org$') THEN 'aggregator' ELSE 'form' END AS kind FROM pages""")
def p21(spark, folder):
    return table(spark, folder, "pages").select("page_id", tf.url_kind("url").alias("kind"))


@query("p22_metadata_filter", "SELECT event_id FROM events WHERE json_extract_string(props, '$.k') = '69' AND event_type = 'error'")
def p22(spark, folder):
    """Rows whose metadata map holds all wanted pairs."""
    meta = F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("type"), F.col("event_type")))
    return table(spark, folder, "events").where(facets.has_pairs(meta, {"k": "69", "type": "error"})).select("event_id")


@query("p23_summary_projection", "SELECT doc_id, lang, source, n_chars FROM documents")
def p23(spark, folder):
    return facets.without(table(spark, folder, "documents"), {"text"})


@query("p24_field_alias", "SELECT c_custkey AS id, c_name AS name FROM customer")
def p24(spark, folder):
    rows = table(spark, folder, "customer")
    return rows.select(p.first_present(rows, ["id", "company_id", "c_custkey"]).alias("id"), p.first_present(rows, ["name", "c_name"]).alias("name"))


@query("p25_visibility_gate", f"{WITH} SELECT id, CASE WHEN capture_status = 'complete' THEN source_ref WHEN source_ref IS NULL THEN NULL ELSE 'excluded:' || capture_status END AS ref FROM jobs")
def p25(spark, folder):
    gate = F.when(F.col("capture_status") == "complete", F.col("source_ref")).when(F.col("source_ref").isNotNull(), F.concat(F.lit("excluded:"), "capture_status"))
    return job_rows(spark, folder).select("id", gate.alias("ref"))


@query("browse_page", f"{WITH} SELECT id, company_name, title, score, first_seen FROM jobs WHERE {BASE} ORDER BY score DESC NULLS LAST, first_seen DESC NULLS LAST, lower(company_name), title, id LIMIT 50 OFFSET 50")
def browse_page(spark, folder):
    """The flagship page."""
    order = [F.desc_nulls_last("score"), F.desc_nulls_last("first_seen"), F.lower("company_name"), F.col("title"), F.col("id")]
    return page(base(spark, folder).select("id", "company_name", "title", "score", "first_seen"), order, 50, 50)


@query("t01_order_newest", f"{WITH} SELECT id, first_seen FROM jobs WHERE {BASE} ORDER BY first_seen DESC NULLS LAST, id LIMIT 40")
def t01(spark, folder):
    return page(base(spark, folder).select("id", "first_seen"), [F.desc_nulls_last("first_seen"), F.col("id")], 0, 40)


@query("t01b_order_company", f"{WITH} SELECT id, company_name FROM jobs WHERE {BASE} ORDER BY lower(company_name), title, id LIMIT 40")
def t01b(spark, folder):
    return page(base(spark, folder).select("id", "company_name", "title"), [F.lower("company_name"), F.col("title"), F.col("id")], 0, 40).drop("title")


@query("t03_featured", f"{WITH} SELECT id, score FROM jobs WHERE {BASE} AND score >= 70 ORDER BY score DESC, first_seen DESC, company_name, id LIMIT 10")
def t03(spark, folder):
    rows = base(spark, folder).where("score >= 70").select("id", "score", "first_seen", "company_name")
    return page(rows, [F.desc("score"), F.desc("first_seen"), F.col("company_name"), F.col("id")], 0, 10).select("id", "score")


@query("a01_total", f"{WITH} SELECT count(*) AS total FROM jobs WHERE {BASE}")
def a01(spark, folder):
    return job_rows(spark, folder).where(p.browse_base()).agg(F.count("*").alias("total"))


@query("a02_count_per_company", "SELECT o_custkey AS company_id, count(*) AS n FROM orders WHERE NOT (o_orderkey % 7 = 0 AND o_orderkey % 10 <> 0) GROUP BY o_custkey")
def a02(spark, folder):
    active = F.col("source_ref").isNull() | ~F.startswith("source_ref", F.lit("inactive:"))
    return job_rows(spark, folder).where(active).groupBy("company_id").agg(F.count("*").alias("n"))


@query("a03_freshness", """SELECT o_custkey AS company_id, max(coalesce(CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate + INTERVAL 3 DAY END, o_orderdate)) AS seen,
  CASE WHEN max(coalesce(CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate + INTERVAL 3 DAY END, o_orderdate)) >= TIMESTAMP '2000-06-01' THEN 'current' ELSE 'stale' END AS state FROM orders GROUP BY o_custkey""")
def a03(spark, folder):
    rows = job_rows(spark, folder).withColumn("last_seen", F.when(F.col("id") % 2 == 0, F.col("first_seen") + F.expr("INTERVAL 3 DAY")))
    return facets.freshness(rows, "company_id", ["last_seen", "first_seen"], "2000-06-01")


@query("a04_stage_counts", """WITH t AS (SELECT o_orderstatus FROM orders JOIN customer ON o_custkey = c_custkey WHERE position('build' IN lower(c_mktsegment)) > 0)
  SELECT o_orderstatus AS stage, count(*) AS n, (SELECT count(*) FROM t) AS total, (SELECT count(*) FROM orders) AS unfiltered FROM t GROUP BY o_orderstatus""")
def a04(spark, folder):
    """Counts under the text filter but not the stage filter, the total from them, and the unfiltered total."""
    rows = table(spark, folder, "orders").join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return facets.stage_counts(rows, p.text_contains("build", "c_mktsegment"), "o_orderstatus")


@query("a05_company_facet", f"""{WITH} SELECT organization, count(*) AS n, round(avg(score), 6) AS mean, max(score) AS best, count(DISTINCT company_id) AS units,
  (SELECT min_by(title, id) FROM jobs j WHERE j.organization = b.organization AND j.score = max(b.score) AND {BASE.replace('source_ref', 'j.source_ref').replace('cohort ', 'j.cohort ').replace('cohort_status', 'j.cohort_status').replace('batch', 'j.batch')}) AS best_title
  FROM jobs b WHERE {BASE} GROUP BY organization""")
def a05(spark, folder):
    """Company facet; of equal best scores the smallest id names the title. Sort where it is shown."""
    return facets.company_facet(base(spark, folder), "organization", "company_id", "score", "title", "id")


@query("a06_browse_stats", f"""{WITH} SELECT count(*) AS jobs, count(DISTINCT company_id) AS companies, count_if(score >= 70) AS high, count_if(score IS NULL) AS unscored,
  count_if(score IS NULL AND capture_status = 'complete') AS pending, count_if(capture_status <> 'complete') AS incomplete FROM jobs WHERE {BASE}""")
def a06(spark, folder):
    return facets.browse_stats(base(spark, folder))


@query("a07_platforms", f"{WITH} SELECT list_sort(list(DISTINCT CASE source WHEN 'moka' THEN 'Moka' WHEN 'feishu' THEN 'Feishu' WHEN 'beisen' THEN 'Beisen' ELSE 'Other' END)) AS platforms FROM jobs WHERE {BASE}")
def a07(spark, folder):
    return base(spark, folder).agg(F.array_sort(F.collect_set(p.first_containing(F.col("source"), PLATFORMS, "Other"))).alias("platforms"))


@query("a08_revision", "SELECT 'orders' AS name, count(*) AS n, max(o_orderdate) AS newest FROM orders UNION ALL SELECT 'events', count(*), max(ts) FROM events")
def a08(spark, folder):
    """What a cached answer depends on: rows and newest change of each table."""
    return facets.revision({"orders": (table(spark, folder, "orders"), "o_orderdate"), "events": (table(spark, folder, "events"), "ts")})


@query("facet_by_company", f"{WITH} SELECT company_id, organization, count(*) AS n FROM jobs WHERE {BASE} GROUP BY company_id, organization")
def facet_by_company(spark, folder):
    """Aggregated before the join, as the dimension is looked up once a company."""
    counts = job_rows(spark, folder).where(p.browse_base()).groupBy("company_id").agg(F.count("*").alias("n"))
    return counts.join(companies(spark, folder), "company_id", "left").select("company_id", "organization", "n")
