"""Retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwell.functions import text as tf
from siftwell.operators import retrieval as v
from siftwell.operators.ranking import top_per_key
from siftwell.plans.registry import query
from siftwell.session import table

TOKENS = r"regexp_extract_all(lower(text), '([a-z0-9_]+|[\x{3400}-\x{9fff}]|[\p{L}\p{N}])', 1)"
TERMS = f"""q AS (SELECT item_id AS query_id, token, count(*) AS qn FROM (SELECT item_id, unnest({TOKENS}) AS token FROM benchmark) GROUP BY ALL),
 d AS (SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest({TOKENS}) AS token FROM documents) GROUP BY ALL),
 t AS (SELECT query_id, sum(qn) AS total FROM q GROUP BY 1),
 l AS (SELECT q.query_id, doc_id, sum(least(n, qn)) / any_value(total) AS lexical FROM q JOIN d USING (token) JOIN t ON q.query_id = t.query_id GROUP BY 1, 2)"""


def lexical(spark, folder):
    return v.lexical_scores(table(spark, folder, "benchmark"), table(spark, folder, "documents"), "item_id", "text", "doc_id", "text")


@query("v01_tokens", f"SELECT item_id, len({TOKENS}) AS n, sha256(array_to_string({TOKENS}, ' ')) AS h FROM benchmark")
def v01(spark, folder):
    return table(spark, folder, "benchmark").select("item_id", F.size(tf.tokens("text")).cast("long").alias("n"), F.sha2(F.array_join(tf.tokens("text"), " "), 256).alias("h"))


@query("v02_lexical_top", f"WITH {TERMS} SELECT query_id, doc_id, round(lexical, 9) AS lexical, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY lexical DESC, doc_id) AS rank FROM l) WHERE rank <= 5")
def v02(spark, folder):
    best = top_per_key(lexical(spark, folder), ["query_id"], [F.desc("lexical"), F.col("doc_id")], 5)
    return best.withColumn("lexical", F.round("lexical", 9))


VEC = "v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), c AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e)) / sqrt(list_dot_product(b.e, b.e)) AS cosine FROM v a, v b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)"


@query("v03_cosine_top", f"WITH {VEC} SELECT query_id, doc_id, round(cosine, 6) AS cosine FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, doc_id) AS n FROM c) WHERE n <= 10")
def v03(spark, folder):
    """One vector in fifty as queries against all vectors."""
    rows = table(spark, folder, "embeddings")
    return v.cosine_top(rows.where("vec_id % 50 = 0"), rows, "vec_id", "embedding", 10).select("query_id", "doc_id", F.round("cosine", 6).alias("cosine"))


HYBRID = f"""{TERMS}, e AS (SELECT a.item_id AS query_id, b.vec_id AS doc_id, list_dot_product(x.e, b.e) / sqrt(list_dot_product(x.e, x.e)) / sqrt(list_dot_product(b.e, b.e)) AS cosine
   FROM benchmark a JOIN (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) x ON x.vec_id = a.item_id, (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) b),
 s AS (SELECT l.query_id, l.doc_id, lexical, e.cosine, lexical * 0.6 + greatest(e.cosine, 0) * 0.4 AS score FROM l JOIN e ON l.query_id = e.query_id AND l.doc_id = e.doc_id),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, round(lexical, 9) DESC, round(cosine, 9) DESC, doc_id) AS rank FROM s)"""


def hybrid(spark, folder):
    vectors = table(spark, folder, "embeddings")
    q = vectors.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    d = vectors.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("d"))
    have = vectors.select(F.col("vec_id").alias("doc_id"))
    docs = table(spark, folder, "documents").join(have, "doc_id", "left_semi")  # texts without a vector have no score
    lexical = v.lexical_scores(table(spark, folder, "benchmark"), docs, "item_id", "text", "doc_id", "text")
    scored = lexical.join(q, "query_id").join(d, "doc_id").withColumn("cosine", v.cosine("q", "d")).drop("q", "d")
    scored = scored.withColumn("exact", v.hybrid("lexical", "cosine"))  # ranks go by rounded scores, thresholds by these
    scored = scored.withColumns({"score": F.round("exact", 9), "lexical": F.round("lexical", 9), "cosine": F.round("cosine", 9)})
    return v.retrieve(scored, 5)


@query("v04_hybrid", f"WITH {HYBRID} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM r WHERE rank <= 5")
def v04(spark, folder):
    return hybrid(spark, folder).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query("v05_hashed_embedding")
def v05(spark, folder):
    """Feature hashing with a digest that SQL lacks; tests hold it against a plain reading."""
    return table(spark, folder, "benchmark").select("item_id", tf.hashed_embedding("text").alias("embedding"))


@query("v06_chunks")
def v06(spark, folder):
    return v.chunk_table(table(spark, folder, "documents"), "doc_id", "text").select("doc", "index", "chunk", "chunk_id")


@query("v07_document_fingerprint", "SELECT doc_id, sha256(concat_ws(':', source, doc_id, sha256(text))) AS fingerprint FROM documents")
def v07(spark, folder):
    """V8: what an incremental index compares."""
    return table(spark, folder, "documents").select("doc_id", F.sha2(F.concat_ws(":", "source", F.col("doc_id").cast("string"), F.sha2("text", 256)), 256).alias("fingerprint"))


@query("v08_refreshed_index")
def v08(spark, folder):
    """An index of older documents brought up to date: some texts changed since, some documents are new and some are gone."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    mark = F.sha2("text", 256)
    older = docs.where("doc_id % 7 <> 0").withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit(" more"))).otherwise(F.col("text"))).withColumn("mark", mark)
    index = v.chunk_table(older, "doc_id", "text").join(older.select(F.col("doc_id").alias("doc"), "mark"), "doc")
    return v.refresh_index(index, docs.where("doc_id % 11 <> 0"), "doc_id", "text", mark).select("doc", "index", "chunk_id")


@query("v09_filtered_vectors", "WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), q AS (SELECT e AS qe FROM v WHERE vec_id = 7) SELECT vec_id, round(greatest(0, 1 - (1 - list_dot_product(e, qe) / sqrt(list_dot_product(e, e)) / sqrt(list_dot_product(qe, qe)))), 6) AS score FROM v, q WHERE label = 3 ORDER BY list_dot_product(e, qe) / sqrt(list_dot_product(e, e)) DESC, vec_id LIMIT 8")
def v09(spark, folder):
    """T5: exact search within a metadata filter; the one query vector is a scalar subquery."""
    rows = table(spark, folder, "embeddings")
    one = rows.where("vec_id = 7").select("embedding").scalar()
    scored = rows.where("label = 3").withColumn("q", one).select("vec_id", v.cosine("embedding", "q").alias("c"))
    return scored.orderBy(F.desc("c"), "vec_id").limit(8).select("vec_id", F.round(F.greatest(F.col("c"), F.lit(0.0)), 6).alias("score"))


@query("v10_grounding", f"WITH {HYBRID} SELECT item_id AS query_id, coalesce(string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY rank), '') AS evidence, count(doc_id) = 0 AS refused FROM benchmark LEFT JOIN (SELECT * FROM r WHERE rank <= 5 AND score >= 0.5) x ON x.query_id = item_id GROUP BY item_id")
def v10(spark, folder):
    """Evidence over the threshold, best first, or a refusal."""
    asked = table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"))
    out = v.grounded(asked, hybrid(spark, folder), 0.5, "exact")
    return out.select("query_id", F.array_join(F.col("evidence").cast("array<string>"), ",").alias("evidence"), "refused")


@query("v11_clean_source", r"SELECT doc_id, sha256(substr(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', ' ', 'g'), '(?i)\b(password|passwd|token|api[_-]?key|secret)\s*[:=]\s*\S+', '\1=[REDACTED]', 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g'), 1, 100000)) AS h FROM documents")
def v11(spark, folder):
    return table(spark, folder, "documents").select("doc_id", F.sha2(tf.clean_source("text"), 256).alias("h"))


@query("v12_unique_guard", "SELECT source, n_chars, count(*) AS n FROM documents GROUP BY ALL HAVING count(*) > 1")
def v12(spark, folder):
    return v.guard_unique(table(spark, folder, "documents"), "source", "n_chars")


@query("v12b_preview", "SELECT source, count(*) AS documents, CAST(sum(n_chars) AS BIGINT) AS chars, max(n_chars) AS longest FROM documents GROUP BY source")
def v12b(spark, folder):
    return table(spark, folder, "documents").groupBy("source").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("chars"), F.max("n_chars").alias("longest"))
