"""Keys, fingerprints, duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwell.functions import text as tf
from siftwell.operators import identity as ident
from siftwell.plans.registry import query
from siftwell.session import table


def digest_sql(*parts: str) -> str:
    return "sha256(concat_ws(chr(31), " + ", ".join(f"coalesce('v' || CAST({p} AS VARCHAR), 'n')" for p in parts) + "))"


@query("d01_title_key", r"SELECT doc_id, sha256(regexp_replace(lower(text), '[^\p{L}\p{N}_]+', '', 'g')) AS k FROM documents")
def d01(spark, folder):
    return table(spark, folder, "documents").select("doc_id", F.sha2(tf.title_key("text"), 256).alias("k"))


@query("d01b_title_key_exact")
def d01b(spark, folder):
    """NFKC and full case folding before the key; SQL has neither."""
    return table(spark, folder, "documents").select("doc_id", F.sha2(tf.title_key(tf.casefolded("text")), 256).alias("k"))


@query("d02_compact_title", r"SELECT conv_id, turn, sha256(trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g'))) AS k FROM conversations")
def d02(spark, folder):
    return table(spark, folder, "conversations").select("conv_id", "turn", F.sha2(tf.compact("text"), 256).alias("k"))


@query("d03_posting_title", r"SELECT p_partkey, regexp_replace(lower(regexp_replace(p_name || ' (A' || p_partkey || ')', '\s*[\(\[][A-Za-z]{0,3}[0-9]{3,}[\)\]]\s*$', '')), '[^\p{L}\p{N}+#/&.\-]+', '', 'g') AS k FROM part")
def d03(spark, folder):
    name = F.concat("p_name", F.lit(" (A"), F.col("p_partkey").cast("string"), F.lit(")"))
    return table(spark, folder, "part").select("p_partkey", tf.posting_title_key(name).alias("k"))


@query("d04_card_title", r"SELECT p_partkey, regexp_replace(p_name || ' - ' || p_type, '\s+', '', 'g') AS k FROM part")
def d04(spark, folder):
    return table(spark, folder, "part").select("p_partkey", tf.card_title_key(F.concat(F.lit("No. "), F.col("p_partkey").cast("string"), F.lit(" "), "p_name", F.lit(" - "), "p_type")).alias("k"))


@query("d05_company_key", r"SELECT c_custkey, regexp_replace(lower(c_name), '[^\p{L}\p{N}]+', '', 'g') AS k FROM customer")
def d05(spark, folder):
    return table(spark, folder, "customer").select("c_custkey", tf.company_key("c_name").alias("k"))


URL = r"""WITH m AS (SELECT page_id, lower(regexp_extract(url, '^(https?)://', 1)) AS scheme, regexp_replace(lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)), '^www\.', '') AS host,
  regexp_extract(url, '^https?://[^/?#:]+(:[0-9]+)?([^?#]*)', 2) AS path, regexp_extract(url, '\?([^#]*)', 1) AS q, regexp_extract(url, '#(.*)$', 1) AS f FROM pages),
 k AS (SELECT *, list_sort(list_filter(list_transform(string_split(q, '&'), lambda x: lower(split_part(x, '=', 1)) || '=' || regexp_replace(x, '^[^=]*=?', '')),
  lambda x: split_part(x, '=', 1) <> '' AND split_part(x, '=', 1) NOT IN ('from', 'ref', 'referrer', 'recommendcode', 'shareid', 'source', 'spm') AND NOT starts_with(x, 'utm_'))) AS kept FROM m)
 SELECT page_id, scheme || '://' || host || CASE WHEN rtrim(path, '/') = '' THEN '/' ELSE rtrim(path, '/') END || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END || CASE WHEN f = '' THEN '' ELSE '#' || f END AS url FROM k"""


@query("d06_canonical_url", URL)
def d06(spark, folder):
    return table(spark, folder, "pages").select("page_id", tf.canonical_url_native("url").alias("url"))


@query("d06b_canonical_url_exact", URL)
def d06b(spark, folder):
    return table(spark, folder, "pages").select("page_id", tf.canonical_url("url").alias("url"))


@query("d07_page_url", "SELECT page_id, regexp_replace(split_part(split_part(url, '#', 1), '?', 1), '/+$', '') || CASE WHEN position('#/' IN url) > 0 THEN '#' || split_part(url, '#', 2) ELSE '' END AS page FROM pages")
def d07(spark, folder):
    """Without a query; a fragment stays only if it is a route; addresses with credentials give null."""
    base = F.regexp_replace(F.substring_index(F.substring_index("url", "#", 1), "?", 1), "/+$", "")
    route = F.when(F.contains("url", F.lit("#/")), F.concat(F.lit("#"), F.substring_index("url", "#", -1))).otherwise("")
    return table(spark, folder, "pages").select("page_id", F.when(~F.col("url").rlike("^[a-z]+://[^/?#]*@"), F.concat(base, route)).alias("page"))


@query("d08_source_identity", r"""SELECT page_id, CASE WHEN regexp_matches(host, '^m\.') THEN 'mobile:' || split_part(host, '.', 2) ELSE 'web:' || host || ':' || path END AS source_identity
  FROM (SELECT page_id, regexp_extract(url, '^https?://([^/?#:]+)', 1) AS host, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path FROM pages)""")
def d08(spark, folder):
    """Platform and tenant where the host tells them, else host and path."""
    host, path = F.regexp_extract("url", r"^https?://([^/?#:]+)", 1), F.regexp_extract("url", r"^https?://[^/?#]+([^?#]*)", 1)
    own = F.when(host.rlike(r"^m\."), F.concat(F.lit("mobile:"), F.split_part(host, F.lit("."), F.lit(2)))).otherwise(F.concat(F.lit("web:"), host, F.lit(":"), path))
    return table(spark, folder, "pages").select("page_id", own.alias("source_identity"))


@query("d09_duplicates_kept", "SELECT l_orderkey, count(*) AS copies, min(l_partkey) AS l_partkey FROM lineitem WHERE l_linenumber < 3 GROUP BY l_orderkey HAVING count(DISTINCT l_partkey) = 1")
def d09(spark, folder):
    return ident.resolve_duplicates(table(spark, folder, "lineitem").where("l_linenumber < 3").select("l_orderkey", "l_partkey"), "l_orderkey", ["l_partkey"])[0]


@query("d09b_duplicates_quarantined", "SELECT l_orderkey, count(DISTINCT l_partkey) AS versions, count(*) AS copies FROM lineitem WHERE l_linenumber < 3 GROUP BY l_orderkey HAVING count(DISTINCT l_partkey) > 1")
def d09b(spark, folder):
    return ident.resolve_duplicates(table(spark, folder, "lineitem").where("l_linenumber < 3").select("l_orderkey", "l_partkey"), "l_orderkey", ["l_partkey"])[1]


@query("d10_business_key", f"SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 0 THEN {digest_sql(chr(39) + 'v1' + chr(39), 'o_custkey', 'o_orderpriority', 'o_orderkey')} ELSE {digest_sql(chr(39) + 'v1' + chr(39), 'o_custkey', 'o_orderpriority', 'o_orderstatus')} END AS business_key FROM orders")
def d10(spark, folder):
    rows = table(spark, folder, "orders")
    url = F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderkey").cast("string"))
    return rows.select("o_orderkey", ident.business_key(F.col("o_custkey"), F.col("o_orderpriority"), url, F.col("o_orderstatus")).alias("business_key"))


@query("d11_content_fingerprint", "SELECT p_partkey, sha256('{\"brand\":\"' || p_brand || '\",\"name\":\"' || p_name || '\",\"size\":' || p_size || '}') AS fingerprint FROM part")
def d11(spark, folder):
    """SHA-256 of canonical JSON: keys in order, white space compacted."""
    doc = F.to_json(F.struct(tf.compact("p_brand").alias("brand"), tf.compact("p_name").alias("name"), F.col("p_size").alias("size")))
    return table(spark, folder, "part").select("p_partkey", F.sha2(doc, 256).alias("fingerprint"))


@query("d12_profile_fingerprint", "SELECT c_custkey, sha256('{' || concat_ws(',', CASE WHEN c_custkey % 2 = 0 THEN '\"name\":\"' || c_name || '\"' END, '\"nation\":' || c_nationkey, '\"segment\":\"' || c_mktsegment || '\"') || '}') AS fingerprint FROM customer".replace('\\"', '"'))
def d12(spark, folder):
    """SHA-256 of the fields that are there, in order; an absent one doesn't appear."""
    fields = F.struct(F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    return table(spark, folder, "customer").select("c_custkey", F.sha2(F.to_json(fields), 256).alias("fingerprint"))


@query("d13_stable_id", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE sha256(concat_ws('|', c_custkey, c_mktsegment)) END AS stable_id FROM customer")
def d13(spark, folder):
    explicit = F.when(F.col("c_custkey") % 2 == 0, F.col("c_name"))
    return table(spark, folder, "customer").select("c_custkey", ident.stable_id(explicit, F.col("c_custkey"), F.col("c_mktsegment")).alias("stable_id"))


@query("d14_scope_digest", "SELECT n_regionkey, sha256(string_agg(n_name, ',' ORDER BY n_name)) AS scope FROM nation GROUP BY n_regionkey")
def d14(spark, folder):
    return table(spark, folder, "nation").groupBy("n_regionkey").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("n_name")), ","), 256).alias("scope"))


@query("d15_message_key", f"SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'message_id:' || {digest_sql('conv_id', 'role', 'turn')} ELSE 'content:' || {digest_sql('conv_id', 'text')} END AS k FROM conversations")
def d15(spark, folder):
    message = F.when(F.col("turn") % 2 == 0, F.col("turn").cast("string"))
    return table(spark, folder, "conversations").select("conv_id", "turn", ident.message_key(F.col("conv_id"), F.col("role"), message, F.col("text")).alias("k"))


@query("d16_survivors", """SELECT doc_id, first_value(doc_id) OVER (PARTITION BY sha256(text) ORDER BY CASE WHEN doc_id % 10 = 3 THEN 0 ELSE 1 END, n_chars, doc_id) AS survivor FROM documents""")
def d16(spark, folder):
    """A marked copy first, then the shortest, then the smallest id; links are repointed to it."""
    rows = table(spark, folder, "documents").select("doc_id", "n_chars", F.sha2("text", 256).alias("key"))
    return ident.survivors(rows, "key", "doc_id", [F.when(F.col("doc_id") % 10 == 3, 0).otherwise(1), F.col("n_chars"), F.col("doc_id")])


@query("d17_identity_conflict", r"SELECT page_id, CASE WHEN a = b THEN a END AS native_id FROM (SELECT page_id, regexp_extract(url, '/([0-9]+)', 1) AS a, CASE WHEN page_id % 3 = 0 THEN CAST(page_id AS VARCHAR) ELSE regexp_extract(url, '/([0-9]+)', 1) END AS b FROM pages)")
def d17(spark, folder):
    parsed = F.regexp_extract("url", "/([0-9]+)", 1)
    stated = F.when(F.col("page_id") % 3 == 0, F.col("page_id").cast("string")).otherwise(parsed)
    return table(spark, folder, "pages").select("page_id", ident.conflict(parsed, stated).alias("native_id"))


@query("d19_platform_parts", r"SELECT page_id, regexp_extract(url, '^https?://(?:m\.|www\.)?([^./]+)\.', 1) AS tenant, regexp_extract(url, '/([0-9]+)', 1) AS native_id FROM pages")
def d19(spark, folder):
    return table(spark, folder, "pages").select("page_id", F.regexp_extract("url", r"^https?://(?:m\.|www\.)?([^./]+)\.", 1).alias("tenant"), F.regexp_extract("url", "/([0-9]+)", 1).alias("native_id"))


@query("d20_reuse_key", "SELECT sha256(text) AS key, count(*) AS uses, min(doc_id) AS fetched FROM documents GROUP BY 1")
def d20(spark, folder):
    """One row a reuse key, before anything expensive is done for it."""
    return table(spark, folder, "documents").groupBy(F.sha2("text", 256).alias("key")).agg(F.count("*").alias("uses"), F.min("doc_id").alias("fetched"))
