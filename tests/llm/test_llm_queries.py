"""The queries on the small tables, against SQL or brute force, and the pipeline stage by stage."""

import pytest
from compare import duck_rows, spark_rows
from conftest import SMALL

import corpus_pipeline
from tessella.llm import queries, toxicity


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, name):
    assert spark_rows(queries.queries()[name](spark, SMALL)) == duck_rows(SMALL, queries.oracle_sql()[name])


@pytest.mark.parametrize("name", ["op1_quality", "op3_pii", "op5_byte_bpe", "op7_token_counts", "op8_near_dedup", "op10_toxicity"])
def test_one_row_for_each_document(spark, name):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = queries.queries()[name](spark, SMALL)
    assert sorted(r["doc_id"] for r in out.select("doc_id").collect()) == sorted(r["doc_id"] for r in docs.select("doc_id").collect())


def test_url_filter_blocks_listed_hosts(spark):
    out = queries.op9_url_filter(spark, SMALL).collect()
    assert any(r["blocked"] for r in out) and not all(r["blocked"] for r in out)


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "pii", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns, name
        assert out.count() <= docs.count()
    packed = corpus_pipeline.run(spark, SMALL)
    assert packed.count() > 0 and {"doc_id", "sequence_id", "offset"} <= set(packed.columns)


def test_toxic_documents_go(spark):
    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    kept = {r["doc_id"] for r in toxicity.keep_clean(docs, labels).select("doc_id").collect()}
    scores = {r["doc_id"]: r["predicted"] for r in toxicity.scored(docs, labels).collect()}
    assert kept == {i for i, p in scores.items() if p == 0}
