"""Event logs, schedules and streams."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Window
from pyspark.sql import functions as F

from siftwell.operators import schedules as sc
from siftwell.plans.registry import query
from siftwell.session import cut_lineage, remove_folder, shared_folder, table
from siftwell.streaming import eventlog as ev
from siftwell.streaming import ingest as st


@query("x01_stream_ingest", "SELECT event_type, count(*) AS n, min(event_id) AS first_id FROM events GROUP BY event_type")
def x01(spark, folder):
    """The events as a stream into a table, each once, through a checkpoint in the shared folder."""
    place = f"{shared_folder(spark)}/ingest-{uuid4().hex}"
    st.ingest(st.file_stream(spark, f"{folder}/events.parquet"), f"{place}/rows", f"{place}/offsets")
    out = cut_lineage(st.ingested(spark, f"{place}/rows", "event_id").groupBy("event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id")))
    remove_folder(spark, place)
    return out


@query("x02_dispositions", "SELECT CASE WHEN event_id % 3 = 0 THEN 'inserted' WHEN event_id % 5 = 0 THEN 'changed' ELSE 'reused' END AS disposition, count(*) AS n FROM events WHERE event_id % 2 = 0 GROUP BY 1")
def x02(spark, folder):
    rows = table(spark, folder, "events").select("event_id", "value")
    batch = rows.where("event_id % 2 = 0").withColumn("value", F.when(F.col("event_id") % 5 == 0, F.col("value") + 1).otherwise(F.col("value")))
    return st.dispositions(rows.where("event_id % 3 <> 0"), batch, "event_id", ["value"]).groupBy("disposition").agg(F.count("*").alias("n"))


#: What may follow what in the log below; before the first event there is no status.
FOLLOW = {None: frozenset(("signup", "view", "click", "error")), "signup": frozenset(("view", "click", "error")), "view": frozenset(("view", "click", "purchase", "error")),
          "click": frozenset(("view", "click", "purchase")), "purchase": frozenset(("view", "signup")), "error": frozenset(("signup", "view"))}


def operation_log(events):
    """The events as a log with deliveries out of order and given twice, some of them changed the second time; every fifth sequence is left open."""
    k = F.col("event_id")
    late = F.when(k % 7 == 0, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    own = events.select("user_id", "event_id", "event_type", "props", F.explode(late).alias("late"))
    arrival = F.when(F.col("late"), (k + 4000) * 2 + 1).otherwise(k * 2)
    status = F.when(F.col("late") & (k % 21 == 0), "error").otherwise(F.col("event_type"))
    sequence = F.when(k % 5 != 0, k + 1 + k * 7919 % 2500)
    return own.select(F.col("user_id").alias("operation"), F.concat(F.lit("e"), k.cast("string")).alias("event_id"), arrival.alias("arrival"), sequence.alias("sequence"), status.alias("status"), F.col("props").alias("content"))


APPENDED = """WITH RECURSIVE d AS (SELECT *, false AS late FROM events UNION ALL SELECT *, true FROM events WHERE event_id % 7 = 0),
  g AS (SELECT user_id AS operation, 'e' || event_id AS event_id, CASE WHEN late THEN (event_id + 4000) * 2 + 1 ELSE event_id * 2 END AS arrival,
    CASE WHEN event_id % 5 <> 0 THEN event_id + 1 + event_id * 7919 % 2500 END AS sequence, CASE WHEN late AND event_id % 21 = 0 THEN 'error' ELSE event_type END AS status, props AS content FROM d),
  l AS (SELECT *, row_number() OVER (PARTITION BY operation ORDER BY arrival) AS k FROM g),
  f AS (SELECT DISTINCT operation, CAST(0 AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS event_id, CAST(NULL AS BIGINT) AS arrival, CAST(NULL AS BIGINT) AS sequence, CAST(NULL AS VARCHAR) AS outcome,
      CAST(NULL AS VARCHAR) AS present, CAST(0 AS BIGINT) AS last, CAST([] AS STRUCT(e VARCHAR, s BIGINT, t VARCHAR, c VARCHAR)[]) AS ids FROM l
    UNION ALL SELECT operation, k, event_id, arrival, CASE WHEN outcome = 'accepted' THEN place WHEN outcome = 'repeated' THEN b.s ELSE sequence END, outcome,
      CASE WHEN outcome = 'accepted' THEN status ELSE present END, CASE WHEN outcome = 'accepted' THEN place ELSE last END,
      CASE WHEN outcome = 'accepted' THEN list_append(ids, {'e': event_id, 's': place, 't': status, 'c': content}) ELSE ids END
    FROM (SELECT *, CASE WHEN b IS NOT NULL THEN CASE WHEN coalesce(sequence, b.s) = b.s AND b.t = status AND b.c = content THEN 'repeated' ELSE 'conflict' END
        WHEN place <= last THEN 'stale' WHEN NOT list_contains(CASE coalesce(present, '') WHEN '' THEN ['signup', 'view', 'click', 'error'] WHEN 'signup' THEN ['view', 'click', 'error']
          WHEN 'view' THEN ['view', 'click', 'purchase', 'error'] WHEN 'click' THEN ['view', 'click', 'purchase'] WHEN 'purchase' THEN ['view', 'signup'] ELSE ['signup', 'view'] END, status) THEN 'illegal'
        ELSE 'accepted' END AS outcome
      FROM (SELECT l.*, f.present, f.last, f.ids, list_filter(f.ids, lambda x: x.e = l.event_id)[1] AS b, coalesce(l.sequence, f.last + 1) AS place FROM f JOIN l ON l.operation = f.operation AND l.k = f.k + 1)))
  SELECT operation, event_id, arrival, sequence, outcome FROM f WHERE k > 0"""


@query("x03_monotone_log", APPENDED)
def x03(spark, folder):
    """Repeated, conflicting, stale, illegal and accepted events of a stored log."""
    return ev.append_log(operation_log(table(spark, folder, "events")), FOLLOW)


@query("x03b_monotone_stream", APPENDED)
def x03b(spark, folder):
    """The same as a stream with its state in the checkpoint, written batch by batch to the shared folder."""
    place = f"{shared_folder(spark)}/log-{uuid4().hex}"
    own = spark.newSession()
    own.conf.set(*ev.PROVIDER)
    log = operation_log(st.file_stream(own, f"{folder}/events.parquet"))
    st.ingest(ev.append_stream(log, FOLLOW), f"{place}/rows", f"{place}/offsets")
    out = cut_lineage(spark.read.parquet(f"{place}/rows").drop("batch"))
    remove_folder(spark, place)
    return out


@query("x04_outbox", "SELECT user_id, event_id FROM events e WHERE event_type <> 'error' AND NOT EXISTS (SELECT 1 FROM events a WHERE a.user_id = e.user_id AND a.event_type = 'error' AND a.event_id = e.event_id + 1)")
def x04(spark, folder):
    rows = table(spark, folder, "events").select("user_id", "event_id", "event_type")
    acked = rows.where("event_type = 'error'").select("user_id", (F.col("event_id") - 1).alias("event_id"))
    return sc.unacknowledged(rows.where("event_type <> 'error'"), acked, ["user_id", "event_id"]).select("user_id", "event_id")


@query("x04b_resend_ranges", """WITH s AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq FROM events),
  u AS (SELECT user_id, seq, seq - row_number() OVER (PARTITION BY user_id ORDER BY seq) AS k FROM s WHERE event_type NOT IN ('click', 'view') AND seq > user_id % 4)
  SELECT user_id, min(seq) AS first, max(seq) AS last, count(*) AS n FROM u GROUP BY user_id, k""")
def x04b(spark, folder):
    """Each user's messages in their own sequence, of which clicks and views were acknowledged: the ranges to send again after a cursor."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    sent = table(spark, folder, "events").select("user_id", "event_type", F.row_number().over(w).alias("seq"))
    cursors = sent.select("user_id", (F.col("user_id") % 4).alias("cursor")).distinct()
    return sc.unacknowledged_ranges(sent, sent.where("event_type in ('click', 'view')"), "user_id", "seq", cursors, block=16)


@query("x06_due_occurrences", """WITH o AS (SELECT c_custkey AS id, CAST(d AS DATE) AS day FROM customer, generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-05', INTERVAL 1 DAY) AS g(d) WHERE d <= TIMESTAMP '2024-01-04'),
  x AS (SELECT c_custkey AS id, DATE '2024-01-01' + CAST(c_custkey % 5 AS INTEGER) AS day FROM customer WHERE c_custkey % 3 = 0)
  SELECT id, max(day) AS claimed, count(*) - 1 AS skipped FROM o WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.id = o.id AND x.day = o.day) GROUP BY id""")
def x06(spark, folder):
    k = F.col("c_custkey")
    plans = table(spark, folder, "customer").select(k.alias("id"), F.lit("2024-01-01").cast("date").alias("first"), F.lit("2024-01-05").cast("date").alias("last"))
    done = table(spark, folder, "customer").where("c_custkey % 3 = 0").select(k.alias("id"), F.date_add(F.lit("2024-01-01").cast("date"), (k % 5).cast("int")).alias("day"))
    return sc.due_occurrences(plans, done, "id", "first", "last", F.lit("2024-01-04").cast("date"))


@query("x07_retention", """SELECT event_id, CASE WHEN ts < TIMESTAMP '2024-01-08' AND user_id NOT IN (SELECT conv_id FROM conversations) AND event_id NOT IN (SELECT event_id FROM events e WHERE event_type = 'purchase'
  AND NOT EXISTS (SELECT 1 FROM events a WHERE a.user_id = e.user_id AND a.event_id > e.event_id AND a.event_type = 'view')) THEN NULL ELSE props END AS props FROM events""")
def x07(spark, folder):
    """Old details go but those of pinned users and of purchases that no later view has acknowledged."""
    events = table(spark, folder, "events")
    pinned = table(spark, folder, "conversations").select(F.col("conv_id").alias("user_id"))
    seen = events.where("event_type = 'view'").groupBy("user_id").agg(F.max("event_id").alias("upto"))
    waiting = events.where("event_type = 'purchase'").join(seen, "user_id", "left").where("upto is null or upto < event_id")
    out = sc.compacted(events, pinned, "user_id", "ts", F.lit("2024-01-08").cast("timestamp_ntz"), "props", waiting)
    return out.select("event_id", "props")


@query("x08_retry_state", """WITH a AS (SELECT user_id, count(*) AS n, max(ts) AS t FROM events WHERE event_type = 'error' GROUP BY user_id)
  SELECT user_id, CASE WHEN n >= 16 THEN 'exhausted' WHEN floor(epoch(TIMESTAMP '2024-02-01') - floor(epoch(t))) < least(2000000, 600 * pow(2, n - 1)) THEN 'waiting' ELSE 'ready' END AS state FROM a""")
def x08(spark, folder):
    rows = table(spark, folder, "events").where("event_type = 'error'").groupBy("user_id").agg(F.count("*").alias("n"), F.max("ts").alias("t"))
    return rows.select("user_id", sc.retry_state(F.col("n"), F.col("t"), F.lit("2024-02-01").cast("timestamp_ntz"), 600, 16, 2_000_000).alias("state"))


@query("x08b_lease_state", """WITH a AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS n, max(ts) FILTER (WHERE event_type = 'click') AS s, max(ts) FILTER (WHERE event_type = 'error') AS e FROM events GROUP BY user_id),
  b AS (SELECT user_id, n, s, CASE WHEN e >= s THEN e END AS e FROM a), c AS (SELECT *, CASE WHEN e IS NULL AND s IS NOT NULL THEN floor(epoch(s)) + 172800 ELSE floor(epoch(e)) END AS over FROM b)
  SELECT user_id, CASE WHEN s IS NULL THEN 'ready' WHEN e IS NULL AND epoch(TIMESTAMP '2024-01-20') < over THEN 'running' WHEN n >= 6 THEN 'exhausted' WHEN epoch(TIMESTAMP '2024-01-20') - over < least(500000, 40000 * pow(2, n - 1)) THEN 'waiting' ELSE 'ready' END AS state FROM c""")
def x08b(spark, folder):
    """Clicks as attempts that errors end; an attempt without an end holds its lease and then counts as failed, without any further event."""
    at = lambda kind: F.max(F.when(F.col("event_type") == kind, F.col("ts")))
    rows = table(spark, folder, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "click").alias("n"), at("click").alias("s"), at("error").alias("e"))
    ended = F.when(F.col("e") >= F.col("s"), F.col("e"))
    state = sc.leased_state(F.col("s"), ended, F.col("n"), F.lit("2024-01-20").cast("timestamp_ntz"), 172_800, 40_000, 6, 500_000)
    return rows.select("user_id", state.alias("state"))


@query("x09_freshness_gate", "SELECT user_id, max(ts) < TIMESTAMP '2024-01-20' AS sync FROM events WHERE event_type <> 'error' GROUP BY user_id")
def x09(spark, folder):
    return table(spark, folder, "events").where("event_type <> 'error'").groupBy("user_id").agg((F.max("ts") < F.lit("2024-01-20").cast("timestamp_ntz")).alias("sync"))


@query("x10_stage_latency", """WITH e AS (SELECT event_id, user_id, event_id % 3 AS part, value, CASE event_type WHEN 'signup' THEN 'started' WHEN 'view' THEN 'started' WHEN 'purchase' THEN 'completed' ELSE event_type END AS phase,
    floor(epoch(ts) * 1000000) AS t, CASE event_type WHEN 'click' THEN 1 WHEN 'signup' THEN 0 WHEN 'view' THEN 0 ELSE 2 END AS o FROM events),
  b AS (SELECT e.event_id, arg_max(s.phase, s.t * 4 + s.o) AS phase, arg_max(s.t, s.t * 4 + s.o) AS t FROM e JOIN e s ON s.user_id = e.user_id AND s.part = e.part AND s.phase <> 'click' AND (s.t < e.t OR s.t = e.t AND s.o < e.o) GROUP BY e.event_id)
  SELECT e.event_id, CASE WHEN e.phase = 'started' THEN NULL WHEN b.phase = 'started' THEN round((e.t - b.t) / 1000000, 3) ELSE round(e.value, 3) END AS latency FROM e LEFT JOIN b ON b.event_id = e.event_id""")
def x10(spark, folder):
    """Views as starts, purchases and errors as ends and clicks between them, in three overlapping stages of every user."""
    kind = F.col("event_type")
    phase = F.when(kind.isin("signup", "view"), "started").when(kind == "purchase", "completed").otherwise(kind)
    rows = table(spark, folder, "events").select("event_id", "user_id", "ts", "value", (F.col("event_id") % 3).alias("part"), phase.alias("phase"))
    return st.stage_latencies(rows, ["user_id", "part"], "phase", "ts", "value").select("event_id", F.round("latency", 3).alias("latency"))


@query("x11_sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS cut FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  s AS (SELECT user_id, ts, sum(cut) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS finish, count(*) AS n FROM s GROUP BY user_id, k""")
def x11(spark, folder):
    out = st.sessions(table(spark, folder, "events"), "user_id", "ts", "2 hours")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("finish"), "n")


@query("r14_resume_scope", """WITH s AS (SELECT o_orderkey AS id, CASE WHEN o_custkey % 4 = 0 THEN 'old' ELSE 'now' END AS scope FROM orders), a AS (SELECT l_orderkey AS id, count(*) FILTER (WHERE l_returnflag <> 'N') AS failed, count(*) FILTER (WHERE l_returnflag = 'N' AND l_quantity > 40) AS done FROM lineitem GROUP BY 1)
  SELECT s.id, CASE WHEN scope = 'old' THEN 'pending' WHEN done > 0 THEN 'done' WHEN failed >= 3 THEN 'exhausted' WHEN failed > 0 THEN 'retry' ELSE 'pending' END AS state FROM s LEFT JOIN a ON s.id = a.id""")
def r14(spark, folder):
    """What a run still has to do: attempts of the same scope count, three failures end it, other scopes' attempts don't matter."""
    work = table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_custkey") % 4 == 0, "old").otherwise("now").alias("s"))
    ok = F.when(F.col("l_returnflag") != "N", F.lit(False)).when(F.col("l_quantity") > 40, F.lit(True))
    tries = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("id"), ok.alias("ok")).where("ok is not null").join(work, "id")
    attempts = tries.select("id", F.when(F.col("s") == "old", "older digest").otherwise(sc.scope_digest("now")).alias("scope"), "ok")
    return sc.resume_states(work.select("id"), attempts, "id", sc.scope_digest("now"), 3)
