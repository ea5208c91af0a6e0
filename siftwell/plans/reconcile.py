"""Snapshot reconciliation and merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwell.operators import reconcile as r
from siftwell.plans.registry import query
from siftwell.session import table

STATE = """s AS (SELECT c_custkey AS id, c_nationkey AS scope, CASE c_custkey % 4 WHEN 0 THEN 'active' WHEN 1 THEN 'missing' WHEN 2 THEN 'inactive' ELSE 'active' END AS status, CASE c_custkey % 4 WHEN 1 THEN c_custkey % 3 + 1 WHEN 2 THEN 3 ELSE 0 END AS missing_runs,
   CASE WHEN c_custkey % 4 IN (1, 2) AND c_custkey % 5 <> 0 THEN TIMESTAMP '2024-01-01' + to_days(CAST(c_custkey % 6 AS INTEGER)) END AS missing_since, CASE WHEN c_custkey % 8 = 1 THEN TIMESTAMP '2024-01-07' END AS last_missing_at FROM customer),
 g AS (SELECT n_nationkey AS scope, CASE WHEN n_nationkey % 4 <> 3 THEN TIMESTAMP '2024-01-07' END AS obs FROM nation),
 x AS (SELECT s.*, obs, EXISTS (SELECT 1 FROM orders WHERE o_custkey = id AND o_orderstatus = 'P') AS seen, missing_runs + CASE WHEN last_missing_at IS NOT DISTINCT FROM obs THEN 0 ELSE 1 END AS cnt, coalesce(missing_since, obs) AS since FROM s JOIN g USING (scope)),
 y AS (SELECT *, cnt >= 2 AND coalesce(epoch(obs) - epoch(since) >= 3 * 86400, false) AS gone FROM x)"""


def presence(spark, folder):
    k = F.col("c_custkey")
    at = F.lit("2024-01-07").cast("timestamp_ntz")
    state = table(spark, folder, "customer").select(
        k.alias("id"), F.col("c_nationkey").alias("scope"), F.when(k % 4 == 1, "missing").when(k % 4 == 2, "inactive").otherwise("active").alias("status"),
        F.when(k % 4 == 1, k % 3 + 1).when(k % 4 == 2, 3).otherwise(0).alias("missing_runs"),
        F.when((k % 4).isin(1, 2) & (k % 5 != 0), F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(cast(c_custkey % 6 as int))")).alias("missing_since"), F.when(k % 8 == 1, at).alias("last_missing_at"),
    )
    runs = table(spark, folder, "nation").select(F.col("n_nationkey").alias("scope"), at.alias("observed_at"), (F.col("n_nationkey") % 4 != 3).alias("complete"))
    seen = table(spark, folder, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("id"))
    return r.reconcile_presence(state, seen, runs, "id", "scope")


@query("r01_presence", f"""WITH {STATE} SELECT id, CASE WHEN obs IS NULL THEN status WHEN seen THEN 'active' WHEN status = 'inactive' OR gone THEN 'inactive' ELSE 'missing' END AS status,
  CASE WHEN obs IS NULL THEN 'unchanged' WHEN seen AND status = 'active' THEN 'observed' WHEN seen THEN 'restored' WHEN status = 'inactive' THEN 'unchanged' WHEN gone THEN 'inactivated' ELSE 'missing' END AS action,
  CASE WHEN obs IS NULL THEN missing_runs WHEN seen THEN 0 WHEN status = 'inactive' THEN missing_runs ELSE cnt END AS missing_runs FROM y""")
def r01(spark, folder):
    return presence(spark, folder).select("id", "status", "action", "missing_runs")


@query("r02_action_counts", f"""WITH {STATE} SELECT CASE WHEN obs IS NULL THEN 'unchanged' WHEN seen AND status = 'active' THEN 'observed' WHEN seen THEN 'restored' WHEN status = 'inactive' THEN 'unchanged' WHEN gone THEN 'inactivated' ELSE 'missing' END AS action, count(*) AS n FROM y GROUP BY 1""")
def r02(spark, folder):
    return presence(spark, folder).groupBy("action").agg(F.count("*").alias("n"))


@query("r03_title_availability", "SELECT p_name, p_brand, bool_or(p_size > 25) AS active FROM part WHERE p_brand <> 'Brand#7' GROUP BY p_name, p_brand")
def r03(spark, folder):
    """Within complete scopes a title is available if the last list has it."""
    rows = table(spark, folder, "part").where("p_brand <> 'Brand#7'")
    listed = rows.where("p_size > 25").select("p_name", "p_brand").distinct().withColumn("_in", F.lit(True))
    return rows.select("p_name", "p_brand").distinct().join(listed, ["p_name", "p_brand"], "left").select("p_name", "p_brand", F.coalesce("_in", F.lit(False)).alias("active"))


@query("r04_deactivation_plan", "SELECT o_custkey, count_if(o_orderstatus = 'P') AS to_deactivate, CASE WHEN count_if(o_orderpriority = '5-LOW') > 0 THEN 'blocked' ELSE 'ready' END AS plan FROM orders GROUP BY o_custkey")
def r04(spark, folder):
    blocked = F.count_if(F.col("o_orderpriority") == "5-LOW") > 0
    return table(spark, folder, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "P").alias("to_deactivate"), F.when(blocked, "blocked").otherwise("ready").alias("plan"))


def sides(spark, folder):
    rows = table(spark, folder, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("score"), F.col("c_nationkey").alias("version"))
    return rows.where("id % 3 <> 0"), rows.where("id % 2 = 0").select("id", F.upper("name").alias("name"), F.when(F.col("id") % 5 != 0, F.col("score") + 1).alias("score"), (F.col("version") + F.col("id") % 3 - 1).cast("int").alias("version"))


SIDES = "t AS (SELECT c_custkey AS id, c_name AS name, c_acctbal AS score, c_nationkey AS version FROM customer WHERE c_custkey % 3 <> 0), i AS (SELECT c_custkey AS id, upper(c_name) AS name, CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal + 1 END AS score, CAST(c_nationkey + c_custkey % 3 - 1 AS INTEGER) AS version FROM customer WHERE c_custkey % 2 = 0)"


@query("r05_upsert", f"WITH {SIDES} SELECT coalesce(t.id, i.id) AS id, coalesce(i.name, t.name) AS name, round(CASE WHEN i.id IS NULL THEN t.score ELSE i.score END, 2) AS score, coalesce(i.version, t.version) AS version, CASE WHEN t.id IS NULL THEN 'inserted' WHEN i.id IS NULL THEN 'kept' ELSE 'updated' END AS action FROM t FULL JOIN i ON t.id = i.id")
def r05(spark, folder):
    return r.merge(*sides(spark, folder), "id", {}).withColumn("score", F.round("score", 2))


@query("r06_preserving_upsert", f"WITH {SIDES} SELECT coalesce(t.id, i.id) AS id, coalesce(t.name, i.name) AS name, round(coalesce(CASE WHEN i.score BETWEEN 0 AND 10000 THEN i.score END, CASE WHEN t.id IS NULL THEN i.score ELSE t.score END), 2) AS score, coalesce(i.version, t.version) AS version, CASE WHEN t.id IS NULL THEN 'inserted' WHEN i.id IS NULL THEN 'kept' ELSE 'updated' END AS action FROM t FULL JOIN i ON t.id = i.id")
def r06(spark, folder):
    """A valid incoming score wins, else the last one stays; the name never changes."""
    new = F.when(F.col("new.score").between(0, 10_000), F.col("new.score"))
    return r.merge(*sides(spark, folder), "id", {"score": F.coalesce(new, F.col("old.score"))}, fixed=("name",)).withColumn("score", F.round("score", 2))


@query("r08_guarded_upsert", f"WITH {SIDES} SELECT coalesce(t.id, i.id) AS id, CASE WHEN t.id IS NULL OR i.version > t.version THEN i.name ELSE t.name END AS name, CASE WHEN t.id IS NULL THEN 'inserted' WHEN i.id IS NULL THEN 'kept' WHEN i.version > t.version THEN 'updated' ELSE 'guarded' END AS action FROM t FULL JOIN i ON t.id = i.id")
def r08(spark, folder):
    """Only a newer version may overwrite."""
    return r.merge(*sides(spark, folder), "id", {}, guard=F.col("new.version") > F.col("old.version")).select("id", "name", "action")


@query("r09_attempt_heads", "SELECT user_id, max(event_id) AS last_attempt, count(*) AS attempts, CAST(sum(CASE WHEN event_type IN ('purchase', 'signup') THEN 1 ELSE 0 END) AS BIGINT) AS successes, arg_max(event_type, event_id) AS status FROM events GROUP BY user_id")
def r09(spark, folder):
    return table(spark, folder, "events").groupBy("user_id").agg(F.max("event_id").alias("last_attempt"), F.count("*").alias("attempts"), F.count_if(F.col("event_type").isin("purchase", "signup")).alias("successes"), F.max_by("event_type", "event_id").alias("status"))


@query("r11_change_kinds", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'new' WHEN doc_id % 7 = 0 THEN 'changed' ELSE 'reused' END AS kind FROM documents WHERE doc_id % 2 = 0")
def r11(spark, folder):
    """By fingerprint against what is stored."""
    docs = table(spark, folder, "documents")
    stored = docs.where("doc_id % 3 <> 0").select("doc_id", F.sha2("text", 256).alias("mark"))
    now = docs.where("doc_id % 2 = 0").select("doc_id", F.sha2(F.concat("text", F.when(F.col("doc_id") % 7 == 0, "+").otherwise("")), 256).alias("mark"))
    return r.change_kinds(stored, now, "doc_id", "mark")


@query("r12_chunk_sync", "SELECT doc_id, CASE WHEN doc_id % 2 <> 0 THEN 'delete' WHEN doc_id % 3 = 0 THEN 'insert' WHEN doc_id % 5 = 0 THEN 'update' ELSE 'skip' END AS action FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 <> 0")
def r12(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", F.sha2("text", 256).alias("hash"), F.lit("m1").alias("model"))
    now = docs.where("doc_id % 2 = 0").withColumn("model", F.when(F.col("doc_id") % 5 == 0, "m2").otherwise("m1"))
    return r.sync_plan(docs.where("doc_id % 3 <> 0"), now, "doc_id", ["hash", "model"])


@query("r13_prune", "SELECT doc_id FROM documents WHERE source NOT IN ('src0', 'src1') OR doc_id % 4 = 0")
def r13(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "source")
    return r.prune(docs, "doc_id", F.col("source").isin("src0", "src1"), docs.where("doc_id % 4 = 0")).select("doc_id")


STAGE_ORDER = ("view", "click", "signup", "purchase")


@query("r15_stage_advance", """WITH e AS (SELECT event_id, user_id, event_type, CASE event_id % 4 WHEN 0 THEN 'view' WHEN 1 THEN 'click' WHEN 2 THEN 'signup' ELSE 'purchase' END AS now FROM events)
  SELECT event_id, CASE WHEN event_type = 'error' THEN 'error' WHEN list_position(['view', 'click', 'signup', 'purchase'], event_type) > list_position(['view', 'click', 'signup', 'purchase'], now) THEN event_type ELSE now END AS stage FROM e""")
def r15(spark, folder):
    """A stage only moves on; the rejection stage is always reached."""
    k = F.col("event_id") % 4
    now = F.when(k == 0, "view").when(k == 1, "click").when(k == 2, "signup").otherwise("purchase")
    return table(spark, folder, "events").select("event_id", r.advance_stage(now, F.col("event_type"), STAGE_ORDER, "error").alias("stage"))


@query("r15b_stage_fold", """SELECT user_id, CASE WHEN bool_or(event_type = 'error') THEN 'error' ELSE ['view', 'click', 'signup', 'purchase'][max(list_position(['view', 'click', 'signup', 'purchase'], event_type))] END AS stage FROM events GROUP BY user_id""")
def r15b(spark, folder):
    """The same folded over a log: the highest rank is a partial aggregate, no order is needed."""
    names = F.array(*map(F.lit, STAGE_ORDER))
    best = F.max(F.array_position(names, F.col("event_type")))
    rows = table(spark, folder, "events").groupBy("user_id").agg(F.bool_or(F.col("event_type") == "error").alias("rejected"), best.alias("rank"))
    return rows.select("user_id", F.when(F.col("rejected"), "error").otherwise(F.try_element_at(names, F.col("rank").cast("int"))).alias("stage"))


@query("r16_latest_review", "SELECT user_id, arg_max(value, event_id) AS review FROM events WHERE event_type = 'purchase' GROUP BY user_id")
def r16(spark, folder):
    return table(spark, folder, "events").where("event_type = 'purchase'").groupBy("user_id").agg(F.max_by("value", "event_id").alias("review"))


@query("r17_stale_tasks", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' AND o_orderdate < TIMESTAMP '1998-01-01' THEN 'stopped' ELSE o_orderstatus END AS status, CASE WHEN o_orderstatus = 'P' AND o_orderdate < TIMESTAMP '1998-01-01' THEN 'recoverable:' || o_orderpriority END AS reason FROM orders")
def r17(spark, folder):
    stale = F.expr("o_orderstatus = 'P' and o_orderdate < timestamp_ntz'1998-01-01'")
    return table(spark, folder, "orders").select("o_orderkey", F.when(stale, "stopped").otherwise(F.col("o_orderstatus")).alias("status"), F.when(stale, F.concat(F.lit("recoverable:"), "o_orderpriority")).alias("reason"))


@query("r18_rescreen", "SELECT p_partkey, p_type AS before, CASE WHEN p_size > 40 THEN 'LARGE' ELSE p_type END AS after FROM part WHERE CASE WHEN p_size > 40 THEN 'LARGE' ELSE p_type END <> p_type")
def r18(spark, folder):
    """Rules anew over the catalogue; only rows whose outcome changed are written."""
    after = F.when(F.col("p_size") > 40, "LARGE").otherwise(F.col("p_type"))
    return table(spark, folder, "part").select("p_partkey", F.col("p_type").alias("before"), after.alias("after")).where("before <> after")


@query("d18_capture_reconcile", """SELECT d.doc_id, CASE WHEN d.doc_id % 3 = 0 THEN 'new' WHEN incoming = '' THEN 'unchanged' WHEN sha256(incoming) <> sha256(text) THEN 'changed' ELSE 'scored' END AS bucket, length(CASE WHEN incoming = '' THEN text ELSE incoming END) AS size
  FROM (SELECT doc_id, text, CASE WHEN doc_id % 5 = 0 THEN '' WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END AS incoming FROM documents) d""")
def d18(spark, folder):
    """An empty incoming text neither changes nor overwrites the stored one."""
    k = F.col("doc_id")
    docs = table(spark, folder, "documents").select("doc_id", "text", F.when(k % 5 == 0, "").when(k % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("incoming"))
    known = docs.where("doc_id % 3 <> 0").select("doc_id", F.sha2("text", 256).alias("stored"))
    bucket = F.when(F.col("stored").isNull(), "new").when(F.col("incoming") == "", "unchanged").when(F.sha2("incoming", 256) != F.col("stored"), "changed").otherwise("scored")
    return docs.join(known, "doc_id", "left").select("doc_id", bucket.alias("bucket"), F.length(F.when(F.col("incoming") == "", F.col("text")).otherwise(F.col("incoming"))).alias("size"))
