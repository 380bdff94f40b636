"""The pipeline's stages against plain Python, and the registered queries on the given tables."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

import __spark_entry__ as contract
import corpus_pipeline
from riskweave.llm import mixing, queries, simhash

FOLDER = "/root/testdata/sf0.001"


def test_every_operator_is_registered():
    names = contract.queries()
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)] == [1] * 10 and "pipeline" in names
    assert set(contract.oracle_sql()) <= set(names)


def test_stages_in_order(spark):
    docs = queries.table(spark, FOLDER, "documents")
    before = docs.collect()
    kept = None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns
        rows = out.collect()
        assert not Counter(rows) - Counter(before)
        if name == "simhash_near_duplicates":
            found = {r["doc_id"]: r["component"] for r in simhash.near_duplicates(docs, "doc_id", "text").collect()}
            assert sorted(r["doc_id"] for r in rows) == sorted(set(found.values()))
        if name == "source_mixing":
            assert Counter(rows) == Counter(before)
        before, kept = rows, rows
        docs = spark.createDataFrame(rows, docs.schema)
    got = {r["doc_id"]: r["decoded_sha256"] for r in corpus_pipeline.run(spark, FOLDER).collect()}
    assert got == {r["doc_id"]: hashlib.sha256(r["text"].encode()).hexdigest() for r in kept}


def test_run_holds_the_mixed_order_on_several_files(spark):
    # Files of one row group or less are split and packed by size, so they are not read in order.
    settings = {
        "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "7",
        "spark.sql.files.maxPartitionBytes": "64k", "spark.sql.files.openCostInBytes": "1k",
    }
    old = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        docs = queries.table(spark, FOLDER, "documents")
        for _, stage in corpus_pipeline.STAGES[:2]:
            docs = stage(spark, docs, FOLDER)
        order = mixing.mixed(docs, "doc_id", "source", queries.TARGET_WEIGHTS, queries.OTHER_WEIGHT)
        want = [r["doc_id"] for r in order.orderBy("slot", "place").collect()]
        got = corpus_pipeline.run(spark, FOLDER).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sorted(r["position"] for r in got) == list(range(len(want)))
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["position"])] == want != sorted(want)


@pytest.mark.parametrize("rows", [0, 3])
def test_odd_documents_pass_every_stage(spark, rows):
    schema = queries.table(spark, FOLDER, "documents").schema
    odd = [Row(None, None, None, None, None), Row(1, "", "en", "src0", 0), Row(1, "", "en", "src0", 0)][:rows]
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.createDataFrame(odd, schema), FOLDER).count() <= rows


HELPERS = ("_fp", "_root", "_place", "_KEY", "_source", "_slot", "_row", "_statistics", "_base_failed", "_kept", "_text", "fp")


def test_columns_named_like_helpers_stay(spark):
    docs = queries.table(spark, FOLDER, "documents")
    wide = docs.withColumns({name: F.concat(F.lit(name), F.col("doc_id").cast("string")) for name in HELPERS})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, wide, FOLDER)
        assert out.columns == wide.columns
        rows = out.collect()
        assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in stage(spark, docs, FOLDER).collect()}
        assert all(r[h] == f"{h}{r['doc_id']}" for r in rows for h in HELPERS)
    ids = corpus_pipeline.STAGES[-1][1]
    assert Counter(ids(spark, wide, FOLDER).collect()) == Counter(ids(spark, docs, FOLDER).collect())
