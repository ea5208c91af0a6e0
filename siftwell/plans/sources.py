"""Sources as queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwell.functions import cards
from siftwell.functions import text as tf
from siftwell.operators import identity as ident
from siftwell.plans.registry import query
from siftwell.session import table
from siftwell.sources import readers as rd


@query("s01_open_table", "SELECT r_regionkey, r_name FROM region")
def s01(spark, folder):
    return rd.read(spark, "parquet", f"{folder}/region.parquet").select("r_regionkey", "r_name")


@query("s04_exploded_events", "SELECT event_id, u.k AS k, u.n AS n FROM (SELECT event_id, unnest([{'k': 'k', 'n': CAST(json_extract_string(props, '$.k') AS BIGINT)}, {'k': 'id', 'n': event_id}]) AS u FROM events)")
def s04(spark, folder):
    rows = table(spark, folder, "events").withColumn("m", F.map_concat(F.from_json("props", "map<string,bigint>"), F.create_map(F.lit("id"), F.col("event_id"))))
    return rows.select("event_id", F.explode_outer("m").alias("k", "n"))


@query("s05_lenient_casts", "SELECT event_id, try_cast(raw AS INTEGER) AS raw, raw IS NOT NULL AND try_cast(raw AS INTEGER) IS NULL AS rejected FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type ELSE json_extract_string(props, '$.k') END AS raw FROM events)")
def s05(spark, folder):
    rows = table(spark, folder, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise(F.get_json_object("props", "$.k")).alias("raw"))
    return rd.quarantine(rows, {"event_id": "bigint", "raw": "int"}).select("event_id", "raw", (F.size("rejected") > 0).alias("rejected"))


@query("s06_line_accounting", "SELECT CASE WHEN event_id % 9 = 0 THEN 'blank' WHEN event_id % 5 = 0 THEN 'malformed' ELSE 'ok' END AS line_state, count(*) AS n FROM events GROUP BY 1")
def s06(spark, folder):
    """Lines of a capture with blank and broken ones among them, counted in one pass."""
    k = F.col("event_id")
    lines = table(spark, folder, "events").select(F.when(k % 9 == 0, " ").when(k % 5 == 0, F.substring("props", 1, 5)).otherwise(F.col("props")).alias("line"))
    return rd.parse_lines(lines, "line", "k bigint").groupBy("line_state").agg(F.count("*").alias("n"))


@query("s08_overlapping_pages", """WITH p AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey, l_linenumber FROM lineitem), r AS (SELECT id, l_partkey FROM p UNION ALL SELECT id, l_partkey + CASE WHEN id % 7 = 0 THEN 1 ELSE 0 END FROM p WHERE l_linenumber = 2)
  SELECT id, count(*) AS copies FROM r GROUP BY id HAVING count(DISTINCT l_partkey) = 1""")
def s08(spark, folder):
    """Pages that overlap (a line in each order is read again, changed in some): equal copies of an id count once, differing ones go."""
    rows = table(spark, folder, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "l_partkey", "l_linenumber")
    again = rows.where("l_linenumber = 2").withColumn("l_partkey", F.col("l_partkey") + F.when(F.col("id") % 7 == 0, 1).otherwise(0))
    return ident.resolve_duplicates(rows.unionByName(again).select("id", "l_partkey"), "id", ["l_partkey"])[0].select("id", "copies")


@query("s08b_capture_resume", """WITH p AS (SELECT user_id, event_id % 40 AS page, count(*) AS total, max(event_id) AS newest FROM events GROUP BY 1, 2), t AS (SELECT *, lag(total) OVER (PARTITION BY user_id ORDER BY page) AS before FROM p)
  SELECT user_id, min(page) FILTER (WHERE total <> before) - 1 AS reread_from, max(page) AS next_page FROM t GROUP BY user_id""")
def s08b(spark, folder):
    """Where a capture goes on: from the overlap before the first page whose stated total changed, else after the last page."""
    pages = table(spark, folder, "events").groupBy("user_id", (F.col("event_id") % 40).alias("page")).agg(F.count("*").alias("total"))
    return rd.capture_resume(pages, "user_id", "page", "total")


@query("s09_packed_sheet", "SELECT lower(p_name) AS name, array_to_string(list_sort(list(DISTINCT CASE WHEN p_type = 'PROMO' THEN 'special' ELSE p_type END)), ',') AS labels FROM part GROUP BY 1")
def s09(spark, folder):
    """Base64 and zlib: every part is packed by a task and read back, so SQL sees what was packed."""
    import base64
    import zlib

    import pandas as pd
    from pyspark.sql import types as T

    pack = F.pandas_udf(lambda s: s.map(lambda t: base64.b64encode(zlib.compress(t.encode())).decode()) if isinstance(s, pd.Series) else s, T.StringType())
    rows = table(spark, folder, "part").select(F.to_json(F.array(F.struct(F.col("p_name").alias("name"), F.array("p_type").alias("options")))).alias("j"))
    return rd.sheet_rows(rows.select(pack("j").alias("p")), "p", {"PROMO": "special"}).select("name", F.array_join("labels", ",").alias("labels"))


@query("s13_joined_fields", "SELECT p_partkey, concat_ws(chr(10), nullif(trim(p_name), ''), nullif(trim(p_brand), ''), nullif(trim(p_type), '')) AS content FROM part")
def s13(spark, folder):
    return table(spark, folder, "part").select("p_partkey", rd.joined_fields(["p_name", "p_brand", "p_type"]).alias("content"))


@query("s14_redacted_structure", "SELECT event_id, '[REDACTED]' AS token, json_extract_string(props, '$.k') AS k FROM events")
def s14(spark, folder):
    m = F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("Token"), F.lit("x")))
    own = rd.redact_keys(m, ["token", "password"])
    return table(spark, folder, "events").select("event_id", F.try_element_at(own, F.lit("Token")).alias("token"), F.try_element_at(own, F.lit("k")).alias("k"))


@query("s18_source_manifest", """WITH a AS (SELECT source, doc_id // 1000 AS k, count(*) AS n, sha256(coalesce(string_agg(sha256(text), ',' ORDER BY doc_id, sha256(text)), '')) AS h FROM documents GROUP BY 1, 2),
  b AS (SELECT source, k // 1000 AS k, sum(n) AS n, sha256(string_agg(h, ',' ORDER BY k)) AS h FROM a GROUP BY source, k // 1000)
  SELECT source, CAST(sum(n) AS BIGINT) AS files, sha256(string_agg(h, ',' ORDER BY k)) AS mark FROM b GROUP BY source""")
def s18(spark, folder):
    """A digest of every source: of its texts' digests in ranges of a thousand ids, of those ranges' by the thousand, and of these, so no row holds a whole source."""
    rows = table(spark, folder, "documents").select("source", F.col("doc_id").alias("k"), F.lit(1).cast("long").alias("n"), F.sha2("text", 256).alias("h"))
    for keys in (["source", F.floor(F.col("k") / 1000).alias("k")],) * 2 + (["source"],):
        own = F.array_sort(F.collect_list(F.struct("k", "h")))
        rows = rows.groupBy(*keys).agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.transform(own, lambda x: x["h"]), ","), 256).alias("h"))
    return rows.select("source", F.col("n").alias("files"), F.col("h").alias("mark"))


@query("s19_path_get", "SELECT event_id, json_extract_string(j, '$.a[0].k') AS k FROM (SELECT event_id, '{\"a\":[' || props || ']}' AS j FROM events)")
def s19(spark, folder):
    rows = table(spark, folder, "events").select("event_id", F.concat(F.lit('{"a":['), "props", F.lit("]}")).alias("j"))
    return rows.select("event_id", rd.path_get("j", "a.0.k").alias("k"))


@query("s20_page_texts")
def s20(spark, folder):
    """Visible text and links of pages by an HTML parser, which SQL lacks."""
    return table(spark, folder, "pages").select("page_id", tf.html_text("html").alias("h")).select("page_id", "h.text", F.size("h.links").alias("links"), "h.active")


#: Titles on the test's pages: a word or two without marks; their cards hold an article's words, their links to details one of a few words.
PAGE_RULES = cards.PostingRules(title=r"^[^\W\d_]+( [^\W\d_]+){0,5}[.]?$", noise=r"^(the|and|of)$", card=r"(tion|ment|lich)", detail=r"^(the|and|of|to|in|der|die|la|le)$", elsewhere=r"^/(que|sch)")


@query("s20b_page_postings")
def s20b(spark, folder):
    """One row a posting: anchors, and texts by their nearest card."""
    rows = table(spark, folder, "pages").select("page_id", F.explode(cards.postings("html", "url", PAGE_RULES)).alias("p"))
    return rows.select("page_id", "p.title", "p.url", "p.kind")


@query("s22_observations", "SELECT user_id, count(DISTINCT event_type || '|' || floor(value)) AS observed, count(*) AS raw, max(ts) AS finished FROM events GROUP BY user_id")
def s22(spark, folder):
    """What a run observed, each observation once, with the evidence of the run."""
    key = F.concat_ws("|", "event_type", F.floor("value").cast("string"))
    return table(spark, folder, "events").groupBy("user_id").agg(F.count_distinct(key).alias("observed"), F.count("*").alias("raw"), F.max("ts").alias("finished"))


@query("s24_full_sync", """SELECT coalesce(n.id, o.id) AS id, coalesce(n.name, o.name) AS name, CASE WHEN o.id IS NULL THEN 'inserted' WHEN n.id IS NULL THEN 'kept' ELSE 'updated' END AS action
  FROM (SELECT c_custkey AS id, upper(c_name) AS name FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT -1 - s_suppkey, s_name FROM supplier) o FULL JOIN (SELECT c_custkey AS id, c_name AS name FROM customer) n ON o.id = n.id""")
def s24(spark, folder):
    """A full snapshot over a target that lacks some rows, has older names for others and holds rows of its own."""
    from siftwell.operators.reconcile import merge

    rows = table(spark, folder, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    own = table(spark, folder, "supplier").select((-1 - F.col("s_suppkey")).alias("id"), F.col("s_name").alias("name"))
    target = rows.where("id % 3 <> 0").withColumn("name", F.upper("name")).unionByName(own)
    return merge(target, rows, "id", {}).select("id", "name", "action")


@query("s16_mailbox_cursor", """WITH m AS (SELECT user_id, event_id, CASE WHEN user_id % 3 = 0 THEN 2 ELSE 1 END AS validity, event_id % 5000 AS uid FROM events)
  SELECT user_id, event_id FROM m WHERE uid > CASE WHEN validity = 1 THEN 2500 ELSE 0 END""")
def s16(spark, folder):
    """Messages after the cursor of each mailbox; a mailbox whose validity changed is read from its beginning."""
    rows = table(spark, folder, "events").select("user_id", "event_id", F.when(F.col("user_id") % 3 == 0, 2).otherwise(1).alias("validity"), (F.col("event_id") % 5000).alias("uid"))
    cursors = rows.select("user_id").distinct().withColumns({"validity": F.lit(1), "last_uid": F.lit(2500)})
    return rd.after_cursor(rows, cursors, "user_id", "validity", "uid").select("user_id", "event_id")


KEY = b"key of the sender"
PADDED = [bytes(b ^ pad for b in KEY.ljust(64, b"\0")).hex() for pad in (0x36, 0x5C)]


@query("hmac_sha256", f"SELECT doc_id, sha256(unhex('{PADDED[1]}') || unhex(sha256(unhex('{PADDED[0]}') || encode(text)))) AS mac FROM documents")
def hmac(spark, folder):
    """Keyed digests with built-in functions only."""
    return table(spark, folder, "documents").select("doc_id", tf.hmac_sha256(KEY, "text").alias("mac"))
