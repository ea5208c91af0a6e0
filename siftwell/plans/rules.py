"""Ordered rules, scores and flags."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siftwell.functions import text as tf
from siftwell.operators import assertions as a
from siftwell.operators import predicates as p
from siftwell.operators import scoring as s
from siftwell.plans.jobs import JOBS, job_rows, jobs
from siftwell.plans.registry import query
from siftwell.session import table

CATEGORIES = (("ring|coin", "jewellery"), ("widget|gear", "machine"), ("(red|blue) ", "coloured"), ("bolt|nut|screw", "fastener"))


def cases(subject: str, rules, default: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({subject}, '{r}') THEN '{label}'" for r, label in rules) + f" ELSE '{default}' END"


@query("c01_category", f"SELECT p_partkey, {cases('p_name', CATEGORIES, 'other')} AS category FROM part")
def c01(spark, folder):
    return table(spark, folder, "part").select("p_partkey", p.first_matching("p_name", CATEGORIES, "other").alias("category"))


TRACKS = (("(?i)LOW", "internship"), ("(?i)high", "early"), ("NOT SPECIFIED", "social"))


@query("c02_track", f"SELECT o_orderkey, {cases('o_orderpriority', TRACKS, 'formal')} AS track FROM orders")
def c02(spark, folder):
    return table(spark, folder, "orders").select("o_orderkey", p.first_matching("o_orderpriority", TRACKS, "formal").alias("track"))


@query("c03_internship_reason", f"""WITH {JOBS} SELECT id, CASE WHEN batch = 'internship' THEN 'batch' WHEN regexp_matches(title, 'LOW') THEN 'title' WHEN source = 'web' AND id % 5 = 4 THEN 'url' WHEN regexp_matches(substr(title, 1, 6), 'MED|2-H') THEN 'header' END AS reason FROM jobs""")
def c03(spark, folder):
    t = F.col("title")
    reason = F.when(F.col("batch") == "internship", "batch").when(t.rlike("LOW"), "title").when((F.col("source") == "web") & (F.col("id") % 5 == 4), "url").when(F.substring(t, 1, 6).rlike("MED|2-H"), "header")
    return jobs(spark, folder).select("id", reason.alias("reason"))


@query("c04_marker_unless", r"SELECT p_partkey, regexp_matches(regexp_replace(p_name, 'small ring|red bolt', '', 'g'), 'ring|bolt') AS marked FROM part")
def c04(spark, folder):
    """A marker counts only outside of the allowed phrases."""
    return table(spark, folder, "part").select("p_partkey", F.regexp_replace("p_name", "small ring|red bolt", "").rlike("ring|bolt").alias("marked"))


SIGNALS = (("metal", "ring", "ring"), ("metal", "bolt", "bolt|nut"), ("toy", "widget", "widget|gear"), ("words", "the", "then|thethe"), ("words", "ion", "tionion"))
GATE = a.RoleGate("red|blue", "red gear", "bolt|gear", "machine|ening")
BONUS, HEADINGS = "bonus points|preferred qualifications", "responsibilities|requirements"
SECTIONS = ("requirements: machine ", "preferred qualifications: machine thethe ", "bonus points bolt preferred qualifications ring requirements: ", "responsibilities tionion bonus points: ")


@query("c05_directions", rf"""WITH p AS (SELECT d.doc_id, trim(regexp_replace(p_name, '\s+', ' ', 'g')) AS title,
    trim(regexp_replace(regexp_replace(list_extract({list(SECTIONS)}, CAST(d.doc_id % {len(SECTIONS)} + 1 AS INTEGER)) || text || ' requirements ' || p_name, '(?is)(?:{BONUS})\s*:?.*?({HEADINGS}|$)', ' \1', 'g'), '\s+', ' ', 'g')) AS body
    FROM documents d JOIN part ON p_partkey = d.doc_id % 100 + 1),
  s AS (SELECT doc_id, title, body, unnest([{", ".join(f"{{'direction': '{d}', 'signal': '{n}', 'pattern': '(?i){r}', 'near': '(?i).{{0,20}}(?:{r}).{{0,20}}', 'k': {i}}}" for i, (d, n, r) in enumerate(SIGNALS))}]) AS x FROM p
    WHERE NOT (regexp_matches(title, '(?i){GATE.barred}') AND NOT regexp_matches(title, '(?i){GATE.barred_unless}')) AND (regexp_matches(title, '(?i){GATE.title}') OR regexp_matches(body, '(?i){GATE.body}')))
  SELECT doc_id, x.direction AS direction, x.signal AS signal, CASE WHEN regexp_matches(title, x.pattern) THEN 'title' ELSE 'body' END AS source,
    regexp_extract(CASE WHEN regexp_matches(title, x.pattern) THEN title ELSE body END, x.near) AS excerpt FROM s WHERE regexp_matches(title, x.pattern) OR regexp_matches(body, x.pattern)""")
def c05(spark, folder):
    """Signals of whole texts by source, without their bonus sections, behind a gate of titles and words."""
    section = F.element_at(F.array(*map(F.lit, SECTIONS)), (F.col("doc_id") % len(SECTIONS) + 1).cast("int"))
    docs = table(spark, folder, "documents").join(table(spark, folder, "part"), F.col("p_partkey") == F.col("doc_id") % 100 + 1)
    body = F.concat(section, "text", F.lit(" requirements "), "p_name")
    return docs.select("doc_id", F.inline(a.directions("p_name", body, SIGNALS, GATE, BONUS, HEADINGS)))


@query("c06_screen", f"""WITH {JOBS} SELECT id, CASE WHEN NOT (cohort = 2027 AND lower(cohort_status) = 'confirmed') THEN 'not_target' WHEN batch = 'internship' THEN 'internship' WHEN regexp_matches(title, '^1-') THEN 'doctorate' WHEN capture_status <> 'complete' THEN 'jd_incomplete' WHEN segment = 'MACHINERY' THEN 'direction_out' ELSE 'eligible' END AS screen FROM jobs""")
def c06(spark, folder):
    target = (F.col("cohort") == 2027) & (F.lower("cohort_status") == "confirmed")
    rules = [("not_target", target), ("internship", F.col("batch") != "internship"), ("doctorate", ~F.col("title").rlike("^1-")), ("jd_incomplete", F.col("capture_status") == "complete"), ("direction_out", F.coalesce(F.col("segment") != "MACHINERY", F.lit(True)))]
    return jobs(spark, folder).select("id", F.coalesce(p.first_failing(rules), F.lit("eligible")).alias("screen"))


@query("c07_title_screen", r"SELECT p_partkey, CASE WHEN NOT regexp_matches(p_name, '(^|[^a-z0-9])(red|blue|small)([^a-z0-9]|$)') THEN 'keyword_missing' WHEN regexp_matches(p_name, '(^|[^a-z0-9])bolt([^a-z0-9]|$)') THEN 'keyword_excluded' ELSE 'passed' END AS screen FROM part")
def c07(spark, folder):
    """Whole-word keywords: guards by lookaround, where SQL captures the neighbours."""
    name = F.col("p_name")
    rule = F.when(~name.rlike("(?<![a-z0-9])(red|blue|small)(?![a-z0-9])"), "keyword_missing").when(name.rlike("(?<![a-z0-9])bolt(?![a-z0-9])"), "keyword_excluded").otherwise("passed")
    return table(spark, folder, "part").select("p_partkey", rule.alias("screen"))


@query("c08_aliases", "SELECT p_type, CASE p_type WHEN 'ECONOMY' THEN 'cheap' WHEN 'PROMO' THEN 'cheap' WHEN 'STANDARD' THEN 'plain' ELSE lower(p_type) END AS direction, count(*) AS n FROM part GROUP BY p_type")
def c08(spark, folder):
    alias = F.create_map(*(F.lit(x) for pair in (("ECONOMY", "cheap"), ("PROMO", "cheap"), ("STANDARD", "plain")) for x in pair))
    return table(spark, folder, "part").groupBy("p_type").agg(F.count("*").alias("n")).select("p_type", F.coalesce(F.try_element_at(alias, "p_type"), F.lower("p_type")).alias("direction"), "n")


@query("c09_text_quality", r"""SELECT doc_id, CASE WHEN trim(text) = '' THEN 'empty' WHEN regexp_matches(trim(text), '!! [A-Z]+!!') THEN 'shell' WHEN NOT (position('the' IN lower(text)) > 0) THEN 'missing_section' WHEN length(trim(text)) = 500 AND NOT regexp_matches(trim(text), '[.!?]$') THEN 'truncated' ELSE 'complete' END AS reason FROM documents""")
def c09(spark, folder):
    return table(spark, folder, "documents").select("doc_id", s.text_quality(F.col("text"), "!! [A-Z]+!!", ["the"]).alias("reason"))


@query("c10_evidence_valid", "SELECT doc_id, n_chars = length(text) AND sha256(text) = sha256(CASE WHEN doc_id % 9 = 0 THEN text || ' ' ELSE text END) AS valid FROM documents")
def c10(spark, folder):
    stated = F.sha2(F.concat("text", F.when(F.col("doc_id") % 9 == 0, " ").otherwise("")), 256)
    return table(spark, folder, "documents").select("doc_id", ((F.col("n_chars") == F.length("text")) & (F.sha2("text", 256) == stated)).alias("valid"))


@query("c11_retry_required", f"WITH {JOBS} SELECT id, capture_status <> 'complete' OR (score IS NULL AND analysis_status = 'failed') AS retry FROM jobs")
def c11(spark, folder):
    retry = (F.col("capture_status") != "complete") | (F.col("score").isNull() & (F.col("analysis_status") == "failed"))
    return jobs(spark, folder).select("id", retry.alias("retry"))


SCORE = """SELECT *, least(100, l_quantity + 20 + l_linenumber * 5, CASE l_returnflag WHEN 'A' THEN 100 WHEN 'N' THEN 89 ELSE 49 END, CASE l_partkey % 4 WHEN 0 THEN 100 WHEN 1 THEN 84 WHEN 2 THEN 74 ELSE 64 END, CASE WHEN l_suppkey % 3 = 0 THEN 79 ELSE 100 END) AS raw FROM lineitem"""


@query("c12_capped_score", f"""WITH a AS ({SCORE}), b AS (SELECT *, CASE WHEN raw >= 90 AND l_suppkey % 3 < 2 THEN 89 ELSE raw END AS s FROM a)
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(s AS INTEGER) AS score, CASE WHEN s >= 80 THEN 'recommended' WHEN s >= 60 THEN 'consider' ELSE 'not_recommended' END AS recommendation FROM b""")
def c12(spark, folder):
    level = F.when(F.col("l_returnflag") == "A", "direct").when(F.col("l_returnflag") == "N", "partial").otherwise("insufficient")
    parts = [F.col("l_quantity").cast("int"), F.lit(20), F.col("l_linenumber") * 5]
    score = s.capped_score(parts, level, F.col("l_suppkey") % 3, F.col("l_partkey") % 4).cast("int")
    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", score.alias("score"))
    return rows.withColumn("recommendation", s.recommendation(F.col("score")))


@query("c13_payload_consistent", "SELECT l_orderkey, bool_and(l_quantity BETWEEN 1 AND 50 AND l_discount <= 0.1 AND NOT (l_tax = 0 AND l_discount = 0)) AS consistent FROM lineitem GROUP BY l_orderkey")
def c13(spark, folder):
    ok = F.col("l_quantity").between(1, 50) & (F.col("l_discount") <= 0.1) & ~((F.col("l_tax") == 0) & (F.col("l_discount") == 0))
    return table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.bool_and(ok).alias("consistent"))


@query("c14_reuse_decision", f"WITH {JOBS} SELECT id, CASE WHEN cohort <> 2027 THEN 'filter' WHEN score IS NOT NULL AND capture_status = 'complete' THEN 'reuse' ELSE 'analyze' END AS decision FROM jobs")
def c14(spark, folder):
    return jobs(spark, folder).select("id", s.reuse_decision(F.col("score").isNotNull(), F.col("capture_status") == "complete", F.col("cohort") == 2027).alias("decision"))


@query("c15_screening_state", f"WITH {JOBS} SELECT CASE WHEN cohort <> 2027 OR batch = 'internship' THEN 'excluded' WHEN capture_status <> 'complete' THEN 'deferred' ELSE 'passed' END AS state, count(*) AS n FROM jobs GROUP BY 1")
def c15(spark, folder):
    state = F.when((F.col("cohort") != 2027) | (F.col("batch") == "internship"), "excluded").when(F.col("capture_status") != "complete", "deferred").otherwise("passed")
    return job_rows(spark, folder).groupBy(state.alias("state")).agg(F.count("*").alias("n"))


#: What a posting says of its campaign, one of these behind each document.
NOTICES = ("campus recruitment 2027", "27届 New Grad", "27 campus recruitment", "© 2026 campus recruitment", "2026-05 campus recruitment", "2026年 5月 new grad 2025", "new graduate and 2024 or 2024, 25届",
           "2023 is more than twenty-four characters from campus recruitment", "5-26届 campus recruitment of 12026", "nothing to state")
MARKER = "campus recruitment|new ?grad(?:uate)?"
PLACES = rf"""WITH w AS (SELECT doc_id, trim(regexp_replace(text || ' ' || list_extract([{", ".join(f"'{n}'" for n in NOTICES)}], CAST(doc_id % {len(NOTICES)} + 1 AS INTEGER)), '\s+', ' ', 'g')) AS c FROM documents),
  n AS (SELECT doc_id, CASE WHEN length(c) > 200 AND NOT regexp_matches(substr(c, 1, length(c) - 110), '(?i){MARKER}') THEN right(c, 200) ELSE c END AS c FROM w),
  p AS (SELECT doc_id, c, unnest(range(1, length(c) + 1)) AS p FROM n),
  q AS (SELECT doc_id, c, p, regexp_extract(substr(c, p, 5), '^(20[0-9][0-9]|[12][0-9])([^0-9]|$)', 1) AS y FROM p WHERE substr(c, p, 1) IN ('1', '2') AND (p = 1 OR NOT regexp_matches(substr(c, p - 1, 1), '[0-9]'))),
  r AS (SELECT *, p + length(y) AS e FROM q WHERE y <> ''),
  f AS (SELECT * FROM r WHERE NOT contains(substr(c, greatest(1, p - 4), least(4, p - 1)), '©') AND NOT regexp_matches(substr(c, e, 12), '^ ?(年? ?[0-9]{{1,2}} ?月|[-/.] ?[0-9]{{1,2}})')
    AND (length(y) = 4 OR regexp_matches(substr(c, e, 4), '^ ?届') AND (p = 1 OR NOT regexp_matches(substr(c, p - 1, 1), '[-/.月]')))
    AND (regexp_matches(substr(c, e, 60), '(?i)^.{{0,24}}({MARKER})') OR regexp_matches(substr(c, greatest(1, p - 60), least(60, p - 1)), '(?i)({MARKER}).{{0,24}}$'))),
  d AS (SELECT doc_id, c, y, p, CASE WHEN length(y) = 2 THEN 2000 + CAST(y AS INTEGER) ELSE CAST(y AS INTEGER) END AS year FROM f)"""


def postings(spark, folder):
    notice = F.element_at(F.array(*map(F.lit, NOTICES)), (F.col("doc_id") % len(NOTICES) + 1).cast("int"))
    return table(spark, folder, "documents").select("doc_id", a.campaign_years(F.concat("text", F.lit(" "), notice), MARKER).alias("years"))


@query("c16_cohort_years", PLACES + " SELECT doc_id, coalesce(years, '') AS years FROM documents LEFT JOIN (SELECT doc_id, string_agg(DISTINCT CAST(year AS VARCHAR), ',' ORDER BY CAST(year AS VARCHAR)) AS years FROM d GROUP BY doc_id) USING (doc_id)")
def c16(spark, folder):
    """Campaign years of whole postings: dates, ©, longer numbers, two digits and the distance each decide for some of them."""
    return postings(spark, folder).select("doc_id", F.array_join(F.array_sort(F.col("years.year")).cast("array<string>"), ",").alias("years"))


@query("c16b_year_near_marker", PLACES + " SELECT doc_id, year, substr(c, greatest(p - 40, 1), least(p - 1, 40) + length(y) + 45) AS context FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, year ORDER BY p) AS k FROM d) WHERE k = 1")
def c16b(spark, folder):
    """Each year with the text around its first place."""
    return postings(spark, folder).select("doc_id", F.inline("years"))


@query("c17_inherited_cohort", f"""WITH {JOBS}, c AS (SELECT company_id, max(CASE WHEN cohort_status = 'Confirmed' THEN cohort END) AS campaign FROM jobs GROUP BY company_id) SELECT id, coalesce(CASE WHEN id % 2 = 0 THEN cohort END, campaign) AS cohort FROM jobs JOIN c USING (company_id)""")
def c17(spark, folder):
    """The company's campaign where the job itself has no cohort."""
    own = F.when(F.col("id") % 2 == 0, F.col("cohort"))
    campaign = F.max(F.when(F.col("cohort_status") == "Confirmed", F.col("cohort"))).over(Window.partitionBy("company_id"))
    return job_rows(spark, folder).select("id", F.coalesce(own, campaign).alias("cohort"))


@query("c18_hit_rank", r"SELECT page_id, 50 + CASE WHEN position('/en/' IN url) > 0 THEN 15 ELSE 0 END + CASE WHEN regexp_matches(url, 'example\.org') THEN 10 ELSE 0 END + CASE WHEN regexp_matches(url, '/[0-9]+') THEN 20 WHEN starts_with(url, 'https') THEN 10 ELSE 0 END - CASE WHEN position('news' IN lower(html)) > 0 THEN 20 ELSE 0 END AS score FROM pages WHERE NOT position('/login' IN url) > 0")
def c18(spark, folder):
    url = F.col("url")
    points = lambda cond, n: F.when(cond, n).otherwise(0)
    adapter = F.when(url.rlike("/[0-9]+"), 20).when(F.startswith(url, F.lit("https")), 10).otherwise(0)
    score = F.lit(50) + points(F.contains(url, F.lit("/en/")), 15) + points(url.rlike(r"example\.org"), 10) + adapter - points(F.contains(F.lower("html"), F.lit("news")), 20)
    return table(spark, folder, "pages").where(~F.contains(url, F.lit("/login"))).select("page_id", score.alias("score"))


@query("c19_blacklist", "SELECT p_partkey FROM part WHERE regexp_matches(p_name, 'widget|ring') AND NOT regexp_matches(p_name, 'red')")
def c19(spark, folder):
    return table(spark, folder, "part").where(F.col("p_name").rlike("widget|ring") & ~F.col("p_name").rlike("red")).select("p_partkey")


WORDS = a.StatusWords(
    stages=(("rejected", "rejected|turned down"), ("offer", "offer(?:ed)?"), ("interview", "interview"), ("written_test", "test|exam"), ("applied", "applied|submitted")),
    condition=r"\b(?:if|unless)\b", negation=r"\b(?:not|never|no|without)\b", denial=r"\b(?:not|never|will)\b", future=r"\b(?:will|would)\b", badge="applied via referral",
)
SAID = ("Not offered", "offered 2024-01-02", "offered 2024-13-02", "first interview", "If the interview goes well", "interview, no exam needed", "interview not scheduled", "the exam will follow", "2024-02-03 Submitted",
        "applied via referral", "Rejected!", "an offer after the test", "offered; interview done", "Submitted with success")


def stated(words, rows: str) -> str:
    """SQL of the clauses of ``rows`` (id, said), with what each is about, its status, label and whether it has a date."""
    day = "20[0-9]{2}-[0-9]{1,2}-[0-9]{1,2}"
    about = " ".join(f"WHEN regexp_matches(label, '(?i){p}') THEN '{n}'" for n, p in words.stages)
    sure = " ".join(f"WHEN regexp_matches(label, '(?i){p}') THEN CASE WHEN NOT regexp_matches(label, '(?i)(?:{words.negation}).*(?:{p})|(?:{p}).*(?:{words.denial})|(?:{words.future}).*(?:{p})') THEN '{n}' END" for n, p in words.stages)
    return rf"""c AS (SELECT id, unnest(list_filter(list_transform(string_split_regex(said, '[,;!?\n]+|\.'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> '')) AS clause FROM ({rows})),
  k AS (SELECT id, row_number() OVER () AS pos, clause, trim(regexp_replace(clause, '^(?:{day})\s*|\s*(?:{day})$', '', 'g')) AS label, regexp_extract(clause, '{day}') AS day FROM c),
  z AS (SELECT id, pos, label, day <> '' AS dated, CASE {about} END AS about, CASE WHEN day <> '' AND try_cast(day AS DATE) IS NULL OR regexp_matches(label, '(?i){words.condition}') OR regexp_full_match(label, '(?i){words.badge}') THEN NULL {sure} END AS status FROM k)"""


def said(key: str, n: int = len(SAID)):
    return F.element_at(F.array(*map(F.lit, SAID)), (F.col(key) % n + 1).cast("int"))


SAID_SQL = f"list_extract([{', '.join(repr(x) for x in SAID)}], CAST(KEY % {len(SAID)} + 1 AS INTEGER))"


@query("c20_stage_label", f"""WITH {stated(WORDS, "SELECT event_id AS id, event_type || '; ' || " + SAID_SQL.replace("KEY", "event_id") + " AS said FROM events")}
  SELECT e.event_id, s.stage FROM events e LEFT JOIN (SELECT id, arg_min(status, pos) AS stage FROM z WHERE status IS NOT NULL GROUP BY id) s ON s.id = e.event_id""")
def c20(spark, folder):
    """Labels of other systems to stages: negated, conditional, future and badly dated ones state nothing."""
    label = F.concat("event_type", F.lit("; "), said("event_id"))
    return table(spark, folder, "events").select("event_id", a.label_status(label, WORDS).alias("stage"))


@query("c21_literal_status", f"""WITH {stated(WORDS, "SELECT conv_id * 1000 + turn AS id, replace(text, '.', ' ') || chr(10) || " + SAID_SQL.replace("KEY", "(conv_id + turn)") + " || chr(10) || " + SAID_SQL.replace("KEY", "(conv_id * 5)") + " AS said FROM conversations")},
  g AS (SELECT id, bool_or(status IS NULL AND about IS NOT NULL AND NOT regexp_full_match(label, '(?i){WORDS.badge}')) AS doubt, count(DISTINCT status) FILTER (WHERE status <> 'applied') AS kinds,
    max(status) FILTER (WHERE status <> 'applied') AS later, arg_max(label, pos) FILTER (WHERE status <> 'applied') AS later_label, arg_max(label, pos) FILTER (WHERE status = 'applied' AND (dated OR regexp_matches(label, '(?i)success'))) AS proof FROM z GROUP BY id)
  SELECT conv_id, turn, CASE WHEN doubt OR kinds > 1 THEN NULL WHEN kinds = 1 THEN later WHEN proof IS NOT NULL THEN 'applied' END AS status, CASE WHEN doubt OR kinds > 1 THEN NULL WHEN kinds = 1 THEN later_label ELSE proof END AS label
  FROM conversations LEFT JOIN g ON g.id = conv_id * 1000 + turn""")
def c21(spark, folder):
    """The one status that a record's whole text asserts; contradictions and doubts give none."""
    k = F.col("conv_id")
    rows = table(spark, folder, "conversations").withColumns({"_a": k + F.col("turn"), "_b": k * 5})
    text = F.concat_ws("\n", F.replace("text", F.lit("."), F.lit(" ")), said("_a"), said("_b"))
    return rows.select("conv_id", "turn", a.literal_status(text, WORDS).alias("s")).select("conv_id", "turn", F.col("s.status").alias("status"), F.col("s.label").alias("label"))


FLAGS = (("script", "<script"), ("link", "https?://"), ("ignore", "ignore (all|previous)"), ("token", "(?i)token|secret|password"), ("hidden", "display: ?none"), ("form", "<form"), ("frame", "<iframe"), ("login", "(?i)log ?in"))


@query("c22_content_flags", "SELECT page_id, concat_ws(',', " + ", ".join(f"CASE WHEN regexp_matches(substr(html, 1, 20000), '{r}') THEN '{n}' END" for n, r in FLAGS) + ") AS flags FROM pages")
def c22(spark, folder):
    """Flags of untrusted content; the first 20,000 characters are the rule's own scope."""
    return table(spark, folder, "pages").select("page_id", F.array_join(s.evidence_flags(F.substring("html", 1, 20_000), FLAGS), ",").alias("flags"))


@query("redacted_mail")
def redacted_mail(spark, folder):
    """Mail redaction; its lookarounds have no counterpart in the oracle's regex dialect."""
    return table(spark, folder, "conversations").select("conv_id", "turn", tf.redact("text").alias("text"))


@query("redacted_emails", r"SELECT doc_id, sha256(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[email]', 'g')) AS h FROM documents")
def redacted_emails(spark, folder):
    return table(spark, folder, "documents").select("doc_id", F.sha2(tf.redact("text", ((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[email]"),)), 256).alias("h"))
