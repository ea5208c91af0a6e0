"""Sampling, batching and matching helpers."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwell.operators import batches as b
from siftwell.operators import pages as pg
from siftwell.operators.ranking import first_per_key, page
from siftwell.plans.registry import query
from siftwell.session import table


@query("n01_hash_sample", "SELECT c_nationkey, c_custkey FROM (SELECT c_nationkey, c_custkey, h, row_number() OVER (PARTITION BY c_nationkey ORDER BY h) AS n FROM (SELECT c_nationkey, c_custkey, sha256(c_nationkey || '|' || c_name) AS h FROM customer)) WHERE n = 1 ORDER BY h LIMIT 10")
def n01(spark, folder):
    """A sample that is the same on every run: the smallest hash of each group, then the first ten by hash."""
    rows = table(spark, folder, "customer").select("c_nationkey", "c_custkey", F.sha2(F.concat_ws("|", F.col("c_nationkey").cast("string"), "c_name"), 256).alias("h"))
    return page(first_per_key(rows, ["c_nationkey"], [F.col("h")]), [F.col("h")], 0, 10).select("c_nationkey", "c_custkey")


GROUPS, QUOTA = ("3-MEDIUM", "1-URGENT", "5-LOW"), 6


@query("n02_stratified_sample", f"""WITH RECURSIVE c AS (SELECT CAST(o_custkey AS VARCHAR) AS k, list_intersect(list_distinct(list(o_orderpriority)), {list(GROUPS)}) AS g,
    list_distinct(list(o_orderstatus || CASE WHEN o_totalprice > 250000 THEN '!' ELSE '' END) || list(CAST(year(o_orderdate) AS VARCHAR))) AS t, count(*) AS w FROM orders GROUP BY o_custkey),
  al AS (SELECT list({{'k': k, 'g': g, 't': t, 'w': w}}) AS rows FROM c),
  f AS (SELECT 0 AS step, CAST([] AS VARCHAR[]) AS used, CAST([] AS VARCHAR[]) AS covered, CAST([] AS VARCHAR[]) AS groups, CAST(NULL AS VARCHAR) AS grp, CAST(NULL AS VARCHAR) AS key
    UNION ALL SELECT step + 1, list_append(used, pick.k), list_distinct(covered || pick.t), list_append(groups, grp), grp, pick.k FROM (
      SELECT *, list_sort(list_transform(list_filter(free, lambda x: list_contains(x.g, grp)), lambda x: {{'a': -len(list_filter(x.t, lambda y: NOT list_contains(covered, y))), 'b': len(x.g) <> 1, 'c': -x.w, 'k': x.k, 't': x.t}}))[1] AS pick FROM (
        SELECT *, list_sort(list_filter(list_transform([{", ".join(f"{{'f': len(list_filter(groups, lambda y: y = '{g}')), 'n': len(list_filter(free, lambda x: list_contains(x.g, '{g}'))), 'i': {i}, 'g': '{g}'}}" for i, g in enumerate(GROUPS))}], lambda x: x), lambda x: x.f < {QUOTA} AND x.n > 0))[1].g AS grp FROM (
          SELECT f.step, f.used, f.covered, f.groups, list_filter(al.rows, lambda x: NOT list_contains(f.used, x.k)) AS free FROM f, al))) WHERE grp IS NOT NULL)
  SELECT step AS rank, grp, key FROM f WHERE step > 0""")
def n02(spark, folder):
    """Customers for review: a quota for each order priority, statuses and years covered as widely as may be."""
    big = F.when(F.col("o_totalprice") > 250_000, "!").otherwise("")
    tags = F.array_union(F.collect_set(F.concat("o_orderstatus", big)), F.collect_set(F.year("o_orderdate").cast("string")))
    rows = table(spark, folder, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("groups"), tags.alias("tags"), F.count("*").alias("n"))
    chosen = pg.balanced_sample(rows, "o_custkey", "groups", "tags", "n", list(GROUPS), QUOTA)
    return spark.createDataFrame([(i, g, k) for i, (g, k) in enumerate(chosen, 1)], "rank int, grp string, key string")


BATCHES = """WITH RECURSIVE c AS (SELECT conv_id, turn, length(text) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
  f AS (SELECT conv_id, turn, k, size, 1 AS n, CAST(0 AS BIGINT) AS batch FROM c WHERE k = 1
    UNION ALL SELECT c.conv_id, c.turn, c.k, CASE WHEN f.n >= 3 OR f.size + c.size > 1000 THEN c.size ELSE f.size + c.size END,
      CASE WHEN f.n >= 3 OR f.size + c.size > 1000 THEN 1 ELSE f.n + 1 END, CASE WHEN f.n >= 3 OR f.size + c.size > 1000 THEN f.batch + 1 ELSE f.batch END
    FROM f JOIN c ON c.conv_id = f.conv_id AND c.k = f.k + 1)
  SELECT conv_id, turn, batch FROM f"""


@query("n03_batches", BATCHES)
def n03(spark, folder):
    """Turns of a conversation in batches of at most three and at most 1000 characters; a longer turn stands alone."""
    turns = table(spark, folder, "conversations").select("conv_id", "turn", F.length("text").alias("size"))
    return b.greedy_batches(turns, "conv_id", ["turn"], "size", 3, 1000).select("conv_id", "turn", "batch")


@query("n03b_document_batches", """WITH RECURSIVE c AS (SELECT source, doc_id, n_chars AS size, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents),
  f AS (SELECT source, doc_id, k, size, 1 AS n, CAST(0 AS BIGINT) AS batch FROM c WHERE k = 1
    UNION ALL SELECT c.source, c.doc_id, c.k, CASE WHEN f.n >= 40 OR f.size + c.size > 100000 THEN c.size ELSE f.size + c.size END,
      CASE WHEN f.n >= 40 OR f.size + c.size > 100000 THEN 1 ELSE f.n + 1 END, CASE WHEN f.n >= 40 OR f.size + c.size > 100000 THEN f.batch + 1 ELSE f.batch END
    FROM f JOIN c ON c.source = f.source AND c.k = f.k + 1)
  SELECT source, batch, count(*) AS n, CAST(sum(s.n_chars) AS BIGINT) AS size, min(doc_id) AS first_id FROM f JOIN documents s USING (source, doc_id) GROUP BY source, batch""")
def n03b(spark, folder):
    """Documents of a source packed for review: at most 40 rows and 100,000 characters a batch."""
    docs = table(spark, folder, "documents").select("source", "doc_id", "n_chars")
    out = b.greedy_batches(docs, "source", ["doc_id"], "n_chars", 40, 100_000)
    return out.groupBy("source", "batch").agg(F.count("*").alias("n"), F.sum("n_chars").alias("size"), F.min("doc_id").alias("first_id"))


@query("n04_staleness_gate", """SELECT d.doc_id, CASE WHEN d.doc_id % 6 = 0 THEN 'missing' WHEN d.doc_id % 7 = 0 THEN 'identity_mismatch' WHEN d.doc_id % 11 = 0 THEN 'stale' ELSE 'planned' END AS decision FROM documents d""")
def n04(spark, folder):
    """A frozen manifest against the current rows."""
    k = F.col("doc_id")
    docs = table(spark, folder, "documents").select("doc_id", "source", F.sha2("text", 256).alias("mark"))
    frozen = docs.select("doc_id", F.when(k % 7 == 0, "?").otherwise(F.col("source")).alias("s"), F.when(k % 11 == 0, "?").otherwise(F.col("mark")).alias("m"))
    now = docs.where("doc_id % 6 <> 0")
    decision = F.when(F.col("mark").isNull(), "missing").when(F.col("s") != F.col("source"), "identity_mismatch").when(F.col("m") != F.col("mark"), "stale").otherwise("planned")
    return frozen.join(now, "doc_id", "left").select("doc_id", decision.alias("decision"))


@query("n05_import_plan", "SELECT doc_id, CASE WHEN quality IS NULL THEN 'no_decision' WHEN toxic = 1 THEN 'rejected' WHEN quality = 1 THEN 'write' ELSE 'keep' END AS plan FROM documents LEFT JOIN labels USING (doc_id)")
def n05(spark, folder):
    plan = F.when(F.col("quality").isNull(), "no_decision").when(F.col("toxic") == 1, "rejected").when(F.col("quality") == 1, "write").otherwise("keep")
    return table(spark, folder, "documents").select("doc_id").join(table(spark, folder, "labels"), "doc_id", "left").select("doc_id", plan.alias("plan"))


KEY = r"' ' || trim(regexp_replace(lower(coalesce({}, '')), '[^\p{{L}}\p{{N}}+#]+', ' ', 'g')) || ' '"
MATCHED = rf"""WITH r AS (SELECT conv_id AS page, turn AS record, regexp_extract(text, '^\S+ \S+') AS title FROM conversations WHERE role = 'user'),
  e AS (SELECT c.conv_id AS page, c.turn AS entry, CASE c.conv_id % 8 WHEN 0 THEN r.record WHEN 1 THEN 0 WHEN 4 THEN r.record END AS record_id, CASE c.conv_id % 8 WHEN 2 THEN r.title WHEN 4 THEN 'Another title' END AS title,
    CASE WHEN c.conv_id % 8 = 7 THEN '' ELSE c.text || CASE WHEN c.conv_id % 8 IN (3, 5) THEN ' ' || r.title ELSE '' END END AS context
    FROM conversations c LEFT JOIN r ON r.page = c.conv_id AND r.record = c.turn - 1 + CASE WHEN c.conv_id % 8 = 5 THEN -2 * (c.turn // 4) ELSE 0 END WHERE c.role = 'assistant'),
  rk AS (SELECT page, record, {KEY.format("title")} AS k FROM r), ek AS (SELECT page, entry, record_id, {KEY.format("title")} AS tk, {KEY.format("context")} AS ck FROM e),
  m AS (SELECT rk.page, rk.record, ek.entry, ek.record_id, ek.tk, k <> '  ' AND k = tk AS titled, k <> '  ' AND contains(ck, k) AS inside FROM rk JOIN ek USING (page)),
  s AS (SELECT *, count_if(titled) OVER (PARTITION BY page, entry) AS by_title, count_if(inside) OVER (PARTITION BY page, entry) AS by_context FROM m),
  g AS (SELECT page, record, count_if(record_id = record) AS id_n, min(entry) FILTER (WHERE record_id = record) AS id_entry,
      bool_and((tk = '  ' OR titled AND by_title = 1) AND (by_context = 0 OR inside AND by_context = 1)) FILTER (WHERE record_id = record) AS id_fits,
      count_if(titled AND record_id IS NULL) AS title_n, min(entry) FILTER (WHERE titled AND record_id IS NULL) AS title_entry, max(by_title) FILTER (WHERE titled AND record_id IS NULL) AS title_by,
      count_if(inside AND record_id IS NULL) AS context_n, min(entry) FILTER (WHERE inside AND record_id IS NULL) AS context_entry, max(by_context) FILTER (WHERE inside AND record_id IS NULL) AS context_by,
      count(*) AS n_ent, count_if(record_id IS NULL AND tk = '  ') AS bare, min(entry) AS one FROM s GROUP BY page, record),
  d AS (SELECT rk.page, rk.record, g.*, CASE WHEN id_n > 1 THEN 'status_entry_ambiguous' WHEN id_n = 1 THEN CASE WHEN id_fits THEN 'record_id' ELSE 'target_job_mismatch' END
      WHEN title_n > 1 THEN 'status_entry_ambiguous' WHEN title_n = 1 THEN CASE WHEN title_by = 1 THEN 'unique_title' ELSE 'target_job_mismatch' END
      WHEN n_ent = 1 AND bare = 1 AND count(*) OVER (PARTITION BY rk.page) = 1 THEN 'unique_page'
      WHEN context_n > 1 THEN 'status_entry_ambiguous' WHEN context_n = 1 THEN CASE WHEN context_by = 1 THEN 'unique_context' ELSE 'target_job_mismatch' END ELSE 'status_entry_not_matched' END AS d
    FROM rk LEFT JOIN g ON g.page = rk.page AND g.record = rk.record)
  SELECT page, record, CASE d WHEN 'record_id' THEN id_entry WHEN 'unique_title' THEN title_entry WHEN 'unique_page' THEN one WHEN 'unique_context' THEN context_entry END AS entry,
    CASE WHEN d IN ('record_id', 'unique_title', 'unique_page', 'unique_context') THEN d END AS method, CASE d WHEN 'record_id' THEN 0.99 WHEN 'unique_title' THEN 0.95 WHEN 'unique_page' THEN 0.95 WHEN 'unique_context' THEN 0.9 END::DOUBLE AS confidence,
    CASE WHEN d NOT IN ('record_id', 'unique_title', 'unique_page', 'unique_context') THEN d END AS reason FROM d"""


@query("n06_reciprocal", MATCHED)
def n06(spark, folder):
    """Turns of a user as records, the answers as entries that name, title or quote one of them, or nothing."""
    turns = table(spark, folder, "conversations")
    k, t = F.col("conv_id") % 8, F.col("turn")
    records = turns.where("role = 'user'").select(F.col("conv_id").alias("page"), F.col("turn").alias("record"), F.regexp_extract("text", r"^\S+ \S+", 0).alias("title"))
    meant = t - 1 + F.when(k == 5, -2 * F.floor(t / 4)).otherwise(0)
    answers = turns.where("role = 'assistant'").withColumn("meant", meant).join(records, (F.col("page") == F.col("conv_id")) & (F.col("record") == F.col("meant")), "left")
    named = F.when(k.isin(0, 4), F.col("record")).when(k == 1, 0)
    title = F.when(k == 2, F.col("title")).when(k == 4, "Another title")
    context = F.when(k == 7, "").otherwise(F.concat("text", F.when(k.isin(3, 5), F.concat(F.lit(" "), F.col("title"))).otherwise("")))
    entries = answers.select(F.col("conv_id").alias("page"), t.alias("entry"), named.cast("long").alias("record_id"), title.alias("title"), context.alias("context"))
    return pg.match_entries(records, entries)


@query("n07_alias_resolver", "SELECT alias, min(p_partkey) AS canonical FROM (SELECT p_name AS alias, p_partkey FROM part UNION ALL SELECT CAST(p_partkey AS VARCHAR), p_partkey FROM part UNION ALL SELECT p_brand, p_partkey FROM part) GROUP BY alias")
def n07(spark, folder):
    """Any of id, name and alias; the first registration wins."""
    rows = table(spark, folder, "part").select("p_partkey", F.explode(F.array(F.col("p_name"), F.col("p_partkey").cast("string"), F.col("p_brand"))).alias("alias"))
    return rows.groupBy("alias").agg(F.min("p_partkey").alias("canonical"))


@query("n08_catalog_index", "SELECT o_custkey, lower(o_orderpriority) AS title, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS ids FROM orders GROUP BY 1, 2")
def n08(spark, folder):
    groups = table(spark, folder, "orders").groupBy("o_custkey", F.lower("o_orderpriority").alias("title")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("ids"))
    return groups.withColumn("ids", F.array_join(F.col("ids").cast("array<string>"), ","))


@query("n09_capture_binding", "SELECT page_id, length(html) > 1000 AND page_id % 5 <> 0 AND starts_with(url, 'http') AS bound FROM pages")
def n09(spark, folder):
    valid, same = F.length("html") > 1000, F.col("page_id") % 5 != 0
    return table(spark, folder, "pages").select("page_id", (valid & same & F.startswith("url", F.lit("http"))).alias("bound"))


@query("n10_token_rejection", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'consumed' WHEN event_type = 'error' THEN 'rejected' WHEN ts < TIMESTAMP '2024-01-05' THEN 'expired' WHEN value < 1 THEN 'unapproved' END AS code FROM events")
def n10(spark, folder):
    code = F.when(F.col("event_id") % 5 == 0, "consumed").when(F.col("event_type") == "error", "rejected").when(F.expr("ts < timestamp_ntz'2024-01-05'"), "expired").when(F.col("value") < 1, "unapproved")
    return table(spark, folder, "events").select("event_id", code.alias("code"))


@query("n11_utm_only", r"SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '([?&])utm[^&#=]*=[^&#]*', '\1', 'g'), '([?&])&+', '\1', 'g'), '[?&]+(#|$)', '\1') AS url FROM pages")
def n11(spark, folder):
    """Only utm parameters go; every other byte stays."""
    out = F.regexp_replace("url", r"([?&])utm[^&#=]*=[^&#]*", "$1")
    return table(spark, folder, "pages").select("page_id", F.regexp_replace(F.regexp_replace(out, r"([?&])&+", "$1"), r"[?&]+(#|$)", "$1").alias("url"))


CAPTURE = "SELECT source, count(*) AS n, count_if(n_chars < 500) AS short, count(DISTINCT sha256(text)) AS texts, CASE WHEN count_if(n_chars < 500) * 2 > count(*) THEN 'poor' ELSE 'good' END AS status FROM documents GROUP BY source"


@query("n12_capture_report", CAPTURE)
def n12(spark, folder):
    short = F.count_if(F.col("n_chars") < 500)
    return table(spark, folder, "documents").groupBy("source").agg(F.count("*").alias("n"), short.alias("short"), F.count_distinct(F.sha2("text", 256)).alias("texts"), F.when(short * 2 > F.count("*"), "poor").otherwise("good").alias("status"))


@query("n12b_capture_summary", f"SELECT status, count(*) AS sources, CAST(sum(n) AS BIGINT) AS documents FROM ({CAPTURE}) GROUP BY status")
def n12b(spark, folder):
    return n12(spark, folder).groupBy("status").agg(F.count("*").alias("sources"), F.sum("n").alias("documents"))
