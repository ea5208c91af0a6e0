"""Lexical and vector retrieval over chunks, and what may be answered from it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions import text as tf
from siftwell.operators.ranking import top_per_key


def term_counts(rows: DataFrame, id_col: str, text_col: str, as_id: str) -> DataFrame:
    """(id, token, n)."""
    return rows.select(F.col(id_col).alias(as_id), F.explode(tf.tokens(text_col)).alias("token")).groupBy(as_id, "token").agg(F.count("*").alias("n"))


#: Rows of (query, token) up to which the queries go to every task, and pairs of a query and a document that a task is dealt.
ASKED, MEETINGS = 500_000, 1_000_000


def lexical_scores(queries: DataFrame, docs: DataFrame, query_id: str, query_text: str, doc_id: str, doc_text: str) -> DataFrame:
    """query_id, doc_id, lexical: the share of a query's tokens, with repeats, that the document has. Pairs without any aren't listed.

    Documents are dealt once, by id; while the queries are few (checked) they are broadcast, so tokens that no query asks for go
    before they are counted, frequent tokens meet where their documents are, and the sums need no further exchange. The number of
    tasks grows with the documents, so that each has about ``MEETINGS`` pairs to sum. Many queries meet the documents' counted tokens in a join.
    """
    q = term_counts(queries, query_id, query_text, "query_id").withColumnRenamed("n", "qn")
    total = Window.partitionBy("query_id")
    q = q.withColumn("total", F.sum("qn").over(total))
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(doc_text).alias("text"))
    few = q.limit(ASKED + 1).count() <= ASKED
    if few:
        asked = F.broadcast(q.select("token").distinct())
        tasks = -(-own.count() * queries.count() // MEETINGS)
        d = own.repartition(max(tasks, 1), "doc_id").select("doc_id", F.explode(tf.tokens("text")).alias("token")).join(asked, "token", "left_semi").groupBy("doc_id", "token").agg(F.count("*").alias("n"))
        met = d.join(F.broadcast(q), "token")
    else:
        met = term_counts(own, "doc_id", "text", "doc_id").join(q, "token")
    both = met.groupBy("query_id", "doc_id").agg(F.sum(F.least("n", "qn")).alias("covered"), F.first("total").alias("total"))
    return both.select("query_id", "doc_id", (F.col("covered") / F.col("total")).alias("lexical"))


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: str, b: str) -> Column:
    """0 for a zero vector; vectors of different lengths are an error."""
    na, nb = F.sqrt(dot(a, a)), F.sqrt(dot(b, b))
    value = F.when((na == 0) | (nb == 0), 0.0).otherwise(dot(a, b) / na / nb)
    return F.when(F.size(a) != F.size(b), F.raise_error("vectors differ in length")).otherwise(value)


#: Queries and rows that meet in one group, and pairs whose exact cosines are taken at once.
QUERIES_A_GROUP, ROWS_A_GROUP, PAIRS_AT_ONCE = 4096, 20_000, 100_000


def _nearest(ids: np.ndarray, q: np.ndarray, others: np.ndarray, r: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best pairs of each query with another id, by cosine, then the smaller id.

    A product of matrices finds what may be among them; cosines of these are added up term by term, as equal vectors need for equal values.
    """
    nq, nr = (np.sqrt(np.cumsum(x * x, axis=1)[:, -1]) for x in (q, r))
    uq, ur = (np.divide(x, n[:, None], out=np.zeros_like(x), where=n[:, None] > 0) for x, n in ((q, nq), (r, nr)))
    found = []
    for at in range(0, len(q), 128):
        near = uq[at : at + 128] @ ur.T
        near[ids[at : at + 128, None] == others] = -np.inf
        last = np.partition(near, max(len(r) - k, 0), axis=1)[:, max(len(r) - k, 0)] - 1e-9
        i, j = np.nonzero(np.isfinite(near) & (near >= last[:, None]))
        i += at
        cos = np.zeros(len(i))
        for a in range(0, len(i), PAIRS_AT_ONCE):
            p, o = i[a : a + PAIRS_AT_ONCE], j[a : a + PAIRS_AT_ONCE]
            dots = np.cumsum(q[p] * r[o], axis=1)[:, -1]  # from the first term to the last
            some = (nq[p] > 0) & (nr[o] > 0)
            cos[a : a + PAIRS_AT_ONCE][some] = dots[some] / nq[p][some] / nr[o][some]
        order = np.lexsort((others[j], -cos, i))
        i, j, cos = i[order], j[order], cos[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        found.append((ids[i[place < k]], others[j[place < k]], cos[place < k]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def cosine_top(queries: DataFrame, rows: DataFrame, id_col: str, vector: str, k: int) -> DataFrame:
    """query_id, doc_id, cosine: the k rows with other ids that are nearest to each query, by cosine, then the smaller id. Exact.

    Queries in groups meet rows in groups, both of bounded size, as matrices; each group of queries goes once to each of rows. A zero vector has
    the cosine 0; null vectors take no part.
    """
    known = F.col(vector).isNotNull()
    q, r = (x.where(known).select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("e")) for x in (queries, rows))
    blocks, salts = max(1, -(-q.count() // QUERIES_A_GROUP)), max(1, -(-r.count() // ROWS_A_GROUP))
    own = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = q.withColumn("_b", own(blocks)).withColumn("_s", each(salts)).repartition(blocks * salts, "_b", "_s")
    r = r.withColumn("_s", own(salts)).withColumn("_b", each(blocks)).repartition(blocks * salts, "_b", "_s")

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        if not len(a) or not len(b):
            return pa.table({"query_id": pa.array([], pa.int64()), "doc_id": pa.array([], pa.int64()), "cosine": pa.array([], pa.float64())})
        if len({n for t in (a, b) for n in pc.unique(pc.list_value_length(t["e"])).to_pylist()}) > 1:
            raise ValueError("vectors differ in length")
        ids = [t["id"].to_numpy() for t in (a, b)]
        vectors = [t["e"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(t), -1) for t in (a, b)]
        return pa.table(dict(zip(("query_id", "doc_id", "cosine"), _nearest(ids[0], vectors[0], ids[1], vectors[1], k), strict=True)))

    best = q.groupBy("_b", "_s").cogroup(r.groupBy("_b", "_s")).applyInArrow(meet, "query_id long, doc_id long, cosine double")
    return top_per_key(best, ["query_id"], [F.desc("cosine"), F.col("doc_id")], k)


def hybrid(lexical: str, cos: str, weights: tuple[float, float] = (0.6, 0.4)) -> Column:
    a, b = (w / sum(weights) for w in weights)
    return F.col(lexical) * a + F.greatest(F.col(cos), F.lit(0.0)) * b


def retrieve(scored: DataFrame, k: int) -> DataFrame:
    """The k best of each query by score, lexical, cosine, then the smaller id."""
    return top_per_key(scored, ["query_id"], [F.desc("score"), F.desc("lexical"), F.desc("cosine"), F.col("doc_id")], k)


def grounded(queries: DataFrame, found: DataFrame, threshold: float = 0.2, score: str = "score") -> DataFrame:
    """For each query the ids that are good enough, best first, or a refusal. ``score`` names the column that the threshold is for."""
    accepted = found.where(F.col(score) >= threshold).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))).alias("_e"))
    evidence = F.transform("_e", lambda e: e["doc_id"])
    out = queries.select("query_id").join(accepted, "query_id", "left")
    return out.select("query_id", F.coalesce(evidence, F.array().cast("array<bigint>")).alias("evidence"), F.col("_e").isNull().alias("refused"))


def chunk_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, index, chunk and chunk_id of every chunk."""
    rows = docs.select(F.col(id_col).alias("doc"), F.posexplode(tf.chunks(text_col)).alias("index", "chunk"))
    return rows.withColumn("chunk_id", F.sha2(F.concat_ws(":", F.col("doc").cast("string"), F.col("index").cast("string"), "chunk"), 256))


def guard_unique(rows: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def refresh_index(index: DataFrame, docs: DataFrame, id_col: str, text_col: str, fingerprint: Column) -> DataFrame:
    """The next state of an index of chunks (doc, mark, index, chunk, chunk_id).

    Documents with the same fingerprint keep their chunks; only new and changed ones are cut again; those that are gone leave.
    """
    own = docs.withColumn("mark", fingerprint)
    known = index.select(F.col("doc").alias(id_col), F.col("mark").alias("_m")).distinct()
    changed = own.join(known, id_col, "left").where(~F.col("mark").eqNullSafe(F.col("_m"))).drop("_m")
    kept = index.join(own.select(F.col(id_col).alias("doc"), "mark"), ["doc", "mark"], "left_semi")
    cut = chunk_table(changed, id_col, text_col).join(changed.select(F.col(id_col).alias("doc"), "mark"), "doc")
    return kept.select("doc", "mark", "index", "chunk", "chunk_id").unionByName(cut.select("doc", "mark", "index", "chunk", "chunk_id"))
