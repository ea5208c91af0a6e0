"""Every query of the library against its SQL; those without SQL must at least give rows."""

import oracle
import pytest

from siftwell.plans import catalog


@pytest.fixture(scope="module")
def con():
    return oracle.connection()


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, con, name):
    names, rows = oracle.rows_of_spark(catalog.queries()[name](spark, oracle.FOLDER))
    sql = catalog.oracles().get(name)
    if sql is None:
        assert rows
        return
    assert (names, rows) == oracle.rows_of_sql(con, sql)


def test_exact_title_keys(spark):
    import hashlib
    import unicodedata

    import regex

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{oracle.FOLDER}/documents.parquet").collect()}
    for r in catalog.queries()["d01b_title_key_exact"](spark, oracle.FOLDER).collect():
        key = regex.sub(r"[^\p{L}\p{N}_]+", "", unicodedata.normalize("NFKC", texts[r.doc_id]).casefold())
        assert r.k == hashlib.sha256(key.encode()).hexdigest()


def test_refreshed_index_as_a_new_one(spark):
    """Bringing an old index up to date gives what indexing the present documents gives."""
    from siftwell.operators.retrieval import chunk_table

    docs = spark.read.parquet(f"{oracle.FOLDER}/documents.parquet").where("doc_id % 11 <> 0")
    want = chunk_table(docs, "doc_id", "text").select("doc", "index", "chunk_id").collect()
    assert sorted(map(tuple, catalog.queries()["v08_refreshed_index"](spark, oracle.FOLDER).collect())) == sorted(map(tuple, want))
