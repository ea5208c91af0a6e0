"""One query for each operator, over whole tables and with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm import alignment, ann, bpe, decontaminate, language_id, licenses, line_dedup, quality, simhash, spelling, substring_dedup, token_counts, toxicity
from siftwell.session import table


def op1_ann(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return ann.search(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op2_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = substring_dedup.remove_repeats(table(spark, folder, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


def op7_simhash(spark: SparkSession, folder: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, folder, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op3_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    out = licenses.scan(table(spark, folder, "documents"))
    joined = [F.array_join(c, ",").alias(c) for c in ("base_labels", "labels")]
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_base", "first_word", "last_word", *joined, "score")


def held_out(folds: int, held: int) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == held, F.lit(False))


def op4_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    out = quality.score(docs, quality.train(docs, table(spark, folder, "labels"))).withColumnRenamed("id", "doc_id")
    return out.select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    out = toxicity.score(docs, toxicity.train(docs, table(spark, folder, "labels"))).withColumnRenamed("id", "doc_id")
    return out.select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    out = token_counts.count_tokens(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.withColumnRenamed("id", "doc_id")


def op8_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    out = language_id.predict(docs, language_id.train(docs)).withColumnRenamed("id", "doc_id")
    return out.select("doc_id", held_out(3, 1).alias("held_out"), F.col("lang").alias("lang_pred"), "score")


def op9_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each document and test item that it holds a passage of."""
    out = decontaminate.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return out.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "score", "seeds", F.col("low").alias("first_word"), F.col("end").alias("end_word"))


def token_digests(docs: DataFrame) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    out = bpe.encode(docs, ranks, public_tokenizers.PATTERN, decoded=True)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return out.select(
        F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op10_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return token_digests(table(spark, folder, "documents"))


def op11_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.group_variants(table(spark, folder, "documents"))


def op12_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = line_dedup.drop_shared_lines(table(spark, folder, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op13_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    paths = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return alignment.align(table(spark, folder, "documents"), *paths).withColumnRenamed("id", "doc_id")


QUERIES = {
    f.__name__: f
    for f in (
        op1_ann, op2_substring_dedup, op3_license_scan, op4_quality, op5_toxicity, op6_token_counts, op7_simhash, op8_language_id, op9_decontamination, op10_byte_bpe,
        op11_spelling_variants, op12_line_dedup, op13_token_alignment,
    )
}
#: SQL where it can say what the operator returns; the other operators search by an index whose recall is under 1, train models, hash
#: shingles, encode tokens or align words, and tests hold those against brute force, the public libraries or held-out labels.
ORACLES: dict[str, str] = {
    "op3_license_scan": licenses.oracle(),
    "op12_line_dedup": line_dedup.ORACLE,
    "op2_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        t AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM d),
        k AS (SELECT doc_id, word, pos, list(word) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS win FROM t),
        m AS (SELECT doc_id, word, pos, len(win) = 20 AND row_number() OVER (PARTITION BY array_to_string(win, ' '), len(win) ORDER BY doc_id, pos) > 1 AS again FROM k),
        g AS (SELECT doc_id, word, pos, bool_or(again) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM m),
        a AS (SELECT doc_id, count(*) AS n_words, count_if(gone) AS n_removed, string_agg(CASE WHEN NOT gone THEN word END, ' ' ORDER BY pos) AS kept FROM g GROUP BY doc_id)
        SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents LEFT JOIN a USING (doc_id)""",
}
