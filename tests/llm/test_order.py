import corpus_pipeline as cp
from sievelog.llm import common, mixing


def test_last_stage_keeps_the_training_order(spark, tables):
    """Over several files, which Spark deals to tasks by size."""
    docs = common.table(spark, tables, "documents")
    scratch = common.Scratch(spark, "t")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        want = [r["doc_id"] for r in mixing.curriculum(docs).select("doc_id").collect()]
        mixed = scratch.save(cp.mixing_stage(spark, docs, tables), "mixing")
        assert mixed.select("_metadata.file_path").distinct().count() > 1
        last = cp.sentencepiece_stage(spark, mixed, tables)
        assert [r["doc_id"] for r in last.select("doc_id").collect()] == want
        again = common.in_order(scratch.save(last, "last"))
        assert [r["doc_id"] for r in again.select("doc_id").collect()] == want
        assert [r["doc_id"] for r in mixed.select("doc_id").collect()] != want
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_rows_that_no_file_has_keep_their_order(spark):
    df = spark.range(5)
    assert [r["id"] for r in common.in_order(df).collect()] == list(range(5))
