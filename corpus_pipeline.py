"""The corpus pipeline: toxicity, near-duplicates, repeated passages, benchmark leaks, tokens.

Each stage gets what its predecessor kept and decides on the whole of it. All but the last return the columns of
``documents``. Between stages the rows are written to the cluster's shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm import decontaminate, simhash, substring_dedup, toxicity
from siftwell.llm.queries import token_digests
from siftwell.session import cut_lineage, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under 0.5 stay."""
    scored = toxicity.keep_below(docs, toxicity.train(docs, table(spark, sf_dir, "labels")), 0.5)
    return scored.select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents whose five-word shingles are similar by 0.8 the one with the smallest id stays; rows without an id stay."""
    found = simhash.similar_groups(docs)
    away = found.where("component <> id").select(F.col("id").alias("doc_id")).distinct()
    return docs.join(away, "doc_id", "left_anti").select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that stand earlier too; others stay as they are."""
    out = substring_dedup.remove_repeats(docs, carry=("lang", "source", "n_chars"))
    changed = F.col("n_removed") > 0
    text = F.when(changed, F.col("kept")).otherwise(F.col("text"))
    size = F.when(changed, F.char_length("kept").cast("long")).otherwise(F.col("row.n_chars"))
    return out.select(F.col("id").alias("doc_id"), text.alias("text"), "row.lang", "row.source", size.alias("n_chars"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage stay."""
    found = decontaminate.leaks(docs, table(spark, sf_dir, "benchmark"))
    return docs.join(found.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_anti").select(*COLUMNS)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded bytes."""
    return token_digests(docs)


STAGES = [
    ("toxicity", drop_toxic), ("simhash", drop_near_duplicates), ("substring_dedup", cut_repeats), ("decontamination", drop_leaks), ("byte_bpe", encode_tokens),
]
#: The stages train models, hash shingles and encode tokens, which SQL can't express; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut_lineage(docs)
    return docs
